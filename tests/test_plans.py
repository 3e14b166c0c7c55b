"""What plans must not hold, and exact results of operators that narrow down instead of gathering."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from rillmark.functions import prompts as Q
from rillmark.operators import balance as P
from rillmark.operators import batch as B
from rillmark.operators import masked as K
from rillmark.operators import metrics as M
from rillmark.plans import catalog
from rillmark.sources import files


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


WEAK = ["latency_stats", "summary_by_ratio", "messages_digest", "generations_table", "capped_split", "dense_group_labels", "whole_multiples", "must_pause", "balanced_and_restored", "rows_subsample", "queue_drop_oldest", "bootstrap_reducers"]


@pytest.mark.parametrize("name", WEAK)
def test_no_window_over_everything_and_no_function_row_by_row(spark, sf_dir, name):
    """Windows without partitions are only over numbered ranges, of which there are few."""
    p = plan(catalog.queries()[name](spark, sf_dir))
    assert "BatchEvalPython" not in p and "percentile(" not in p
    for spec in re.findall(r"windowspecdefinition\(([^)]*)\)", p):
        first = spec.split(" ")[0]
        assert " ASC" not in spec[: len(first) + 4] or first.startswith("_range"), spec


def test_ranges_of_texts_that_begin_alike(spark):
    spark_rows = spark.range(4000).select(F.lit(7).alias("c"), F.concat(F.lit("https://example.org/"), F.col("id")).alias("u"))
    for order in (["u"], ["c", "u"]):
        sizes = [r["n"] for r in B.with_ranges(spark_rows, order).groupBy("_range").agg(F.count(F.lit(1)).alias("n")).collect()]
        assert len(sizes) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(sizes) < 2 * 4000 / len(sizes)
    numbered = B.with_row_index(spark_rows, ["c", "u"]).collect()
    assert [r["u"] for r in sorted(numbered, key=lambda r: r["row_idx"])] == sorted(f"https://example.org/{k}" for k in range(4000))
    odd = spark.createDataFrame([(None, None), (None, 1.0), ("b", float("nan")), ("b", None), ("a", math.inf), ("é", -0.5)], "t string, x double")
    got = sorted(B.with_row_index(odd, ["t", "x"]).collect(), key=lambda r: r["row_idx"])
    assert [r["t"] for r in got] == [None, None, "a", "b", "b", "é"] and got[3]["x"] is None and B.with_row_index(odd.limit(0), ["t", "x"]).count() == 0


def test_percentiles_are_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(g, float(v)) for g in ("a", None) for v in rng.integers(0, 9, 300)] + [("b", 4.5), ("c", None), ("d", 1.0), ("d", 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r["g"]: (r["n"], r["percentiles"]) for r in M.percentiles(df, ["g"], "v", shares).collect()}
    assert set(got) == {"a", None, "b", "d"}
    for g, (n, told) in got.items():
        held = [v for x, v in rows if x == g and v is not None]
        assert n == len(held) and np.allclose(told, np.percentile(held, [100 * s for s in shares]))
    assert M.percentiles(df.where("false"), ["g"], "v", shares).count() == 0
    cube = M.summarise(df.withColumn("h", F.col("v") > 4), ["g", "h"], {"n": F.count("v")}, cube=True, exact={"p50": ("v", 0.5)}).collect()
    whole = next(r for r in cube if r["level"] == "")
    assert whole["p50"] == np.median([v for _, v in rows if v is not None]) and next(r for r in cube if r["level"] == "g" and r["g"] == "d")["p50"] == 1.5


def test_digest_of_runs(spark, monkeypatch):
    import hashlib

    def plain(hashes, run):
        level = 0
        while level < 3 or len(hashes) > 1:
            hashes = [hashlib.sha256("".join(hashes[k : k + run]).encode()).hexdigest() for k in range(0, len(hashes), run)]
            level += 1
        return hashes[0] if hashes else hashlib.sha256(b"").hexdigest()

    for run, n in ((64, 5), (2, 23), (3, 1), (2, 0)):
        monkeypatch.setattr(Q, "DIGEST_RUN", run)
        df = spark.range(n).select(F.col("id").alias("o"), F.struct(F.col("id").alias("x")).alias("m"))
        want = plain([hashlib.sha256(f'{{"x":{k}}}'.encode()).hexdigest() for k in range(n)], run)
        assert Q.messages_digest(df, "m", "o").first()["digest"] == want


def test_caps_labels_and_samples(spark):
    df = spark.range(40).select(F.col("id").alias("o"), F.when(F.col("id") % 3 == 0, "x").when(F.col("id") % 3 == 1, "y").alias("s"))
    got = sorted(r["o"] for r in Q.capped_split(df, "s", "o", {"x": 4, "z": 2}).collect())
    assert got == sorted([0, 3, 6, 9, *range(1, 40, 3), *range(2, 40, 3)])
    labels = K.dense_labels(spark.createDataFrame([(2.0000000001,), (2.0,), (-1.0,), (7.5,), (None,)], "g double"), "g")
    assert {r["g"]: r["label"] for r in labels.collect() if r["g"] is not None} == {-1.0: labels.where("g = -1").first()["label"], 2.0: labels.where("g = 2").first()["label"], 2.0000000001: labels.where("g = 2").first()["label"], 7.5: labels.where("g = 7.5").first()["label"]}
    numbered = spark.range(50).withColumnRenamed("id", "row_idx")
    assert sorted(r[0] for r in B.subsample(numbered, 7).collect()) == list(range(7)) and B.subsample(numbered, 7, "s").count() == 7
    assert [r[0] for r in spark.range(1, 13).select(B.multiple_with(F.col("id"), 6)).collect()] == [math.lcm(k, 6) for k in range(1, 13)]
    order = [3, 0, 2, 1]
    assert spark.createDataFrame([(order,)], "a array<int>").select(P.restored(F.col("a"))).first()[0] == P.restore([order])


def test_samples_of_a_step_and_counts_of_sinks(spark, tmp_path):
    df = spark.range(60).select((F.col("id") % 2).alias("step"), F.col("id").alias("input"), F.lit("o").alias("output"), F.lit(1.0).alias("score"))
    got = {r["step"]: [s["input"] for s in r["samples"]] for r in files.generations_table(df, n=3).collect()}
    assert got == {0: [0, 2, 4], 1: [1, 3, 5]} and "WindowGroupLimit" in plan(files.generations_table(df, n=3))
    counts = files.fan_out(df, [lambda d: d.write.parquet(f"{tmp_path}/a"), lambda d: d.where("step = 0").write.json(f"{tmp_path}/b")])
    assert counts == [60, 60] and spark.read.json(f"{tmp_path}/b").count() == 30


def test_reports_that_cannot_be_read(spark, tmp_path):
    good = '{"target_ratio":1.5,"is_cropped":true,"is_filled":false,"crop_box":[0,0,1,0.5],"fill_color":null}'

    def report(*rows):
        path = f"{tmp_path}/{len(rows)}-{abs(hash(rows))}"
        spark.createDataFrame([(r, i, None) for r, i in rows], "response string, image string, messages array<struct<content string>>").write.json(path)
        return files.read_crop_report(spark, path)

    details, operations = report((good, "/a/b.c.jpg"), (good.replace("1.5", "2"), "b.c.png"), (good.replace("true", "false").replace("[0,0,1,0.5]", "null"), "x"))
    assert sorted((r["image_id"], r["target_ratio"], r["title"]) for r in details.collect()) == [("b.c", 1.5, ""), ("b.c", 2.0, "")]
    assert {r["operation"]: r["n"] for r in operations.collect()} == {"crop": 2, "keep": 1}
    with pytest.raises(Exception, match="given twice: b at 1.5"):
        report((good, "b.jpg"), (good, "/other/b.png"))[0].collect()
    with pytest.raises(Exception, match="can't be read"):
        report(("{", "b.jpg"))[1].collect()


def test_sft_files(spark, tmp_path):
    df = spark.range(30).select(F.array(F.struct(F.lit("user").alias("role"), F.col("id").cast("string").alias("content"))).alias("messages"), F.lit(True).alias("enable_thinking"), F.lit(1).alias("other"))
    df.where("messages[0].content < '3'").coalesce(1).write.parquet(f"{tmp_path}/a")
    df.where("messages[0].content >= '3'").coalesce(1).withColumn("messages", F.when(F.col("messages")[0]["content"] != "9", F.col("messages"))).write.parquet(f"{tmp_path}/b")
    rows = files.read_sft(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).orderBy("row_idx").collect()
    assert rows[0].asDict().keys() == {"row_idx", "messages", "enable_thinking"} and [r["row_idx"] for r in rows] == list(range(30))
    said = [r["messages"][0]["content"] if r["messages"] else None for r in rows]
    assert said.count(None) == 1 and said[:3] == ["0", "1", "2"] and said.index("29") < said.index("3")
    assert [r["row_idx"] for r in files.read_sft(spark, [f"{tmp_path}/a"], sample=4).orderBy("row_idx").collect()] == [0, 1, 2, 3]
    one, two = ({r["row_idx"] for r in files.read_sft(spark, [f"{tmp_path}/a"], sample=5, seed=s).collect()} for s in ("x", "y"))
    assert len(one) == len(two) == 5 and one != two
    with pytest.raises(B.BatchError, match="no column"):
        files.read_sft(spark, [f"{tmp_path}/a"], messages="absent")
    assert Q.labelled(spark.createDataFrame([("a",), ("",), (None,)], "x string"), "x").count() == 1
