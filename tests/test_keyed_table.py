"""The keyed table on disk: what is moved, what is rewritten."""

import os
import re

import pytest
from pyspark.sql import functions as F

from rillmark.sources import kv


@pytest.fixture
def held(spark, tmp_path):
    out = kv.KeyedTable(spark, f"{tmp_path}/t", spark.range(1).selectExpr("id AS key", "id AS a").schema, parts=8, buckets=4)
    out.put(spark.range(100).selectExpr("id AS key", "id * 2 AS a"))
    return out


def names(held):
    return {os.path.join(d, x): os.stat(os.path.join(d, x)).st_mtime_ns for d, _, files in os.walk(held.path) for x in files if x.startswith("part-")}


def test_get_moves_the_keys_and_not_the_table(spark, held):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = held.get(spark.range(0, 200, 7).withColumnRenamed("id", "key"), ["a"], ("absent",))
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, found.collect())) == [(k, 2 * k) for k in range(0, 100, 7)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall("Exchange", plan)) == 1 and "Bucketed: true" in plan
    table = plan[plan.index("FileScan") - 200 : plan.index("FileScan")]
    assert "Exchange" not in table


def test_writes_rewrite_the_folders_they_touch(spark, held):
    before = names(held)
    held.put(spark.createDataFrame([(5, 50, "x"), (1000, 7, None)], "key bigint, a bigint, b string"))
    after = names(held)
    touched = {d for d in {os.path.dirname(p) for p in before | after} if {p for p in before if p.startswith(d + "/")} != {p for p in after if p.startswith(d + "/")}}
    assert 1 <= len(touched) <= 2 and all(after[p] == t for p, t in before.items() if os.path.dirname(p) not in touched)
    rows = {r["key"]: (r["a"], r["b"]) for r in held.rows().collect()}
    assert rows == {k: (2 * k, None) for k in range(100)} | {5: (50, "x"), 1000: (7, None)}


def test_clear_and_several_rows_of_a_key(spark, held):
    held.put(spark.createDataFrame([(200, 1), (200, 2)], "key bigint, a bigint"))
    assert held.get(spark.createDataFrame([(200,)], "key bigint"), ["a"]).count() == 2
    held.put(spark.createDataFrame([(200, 9)], "key bigint, a bigint"))
    assert [r["a"] for r in held.rows().where("key = 200").collect()] == [9, 9]
    before = names(held)
    held.clear(spark.createDataFrame([(200,), (3,), (3,), (777,)], "key bigint"))
    assert sorted(r["key"] for r in held.rows().collect()) == [k for k in range(100) if k != 3]
    assert any(p in names(held) for p in before)
    held.clear(held.rows().select("key"))
    assert held.rows().count() == 0 and not names(held)
    again = kv.KeyedTable(spark, held.path, held.rows().schema, parts=8, buckets=4)
    again.put(spark.range(3).selectExpr("id AS key", "id AS a"))
    assert held.rows().agg(F.sum("a")).first()[0] == 3


def test_null_keys_and_another_session(spark, held):
    with pytest.raises(ValueError, match="null"):
        held.put(spark.createDataFrame([(None, 1)], "key bigint, a bigint"))
    spark.sql(f"DROP TABLE {held.name}")
    assert kv.KeyedTable(spark, held.path, spark.range(1).selectExpr("id AS key", "id AS a").schema, parts=8, buckets=4).rows().count() == 100
