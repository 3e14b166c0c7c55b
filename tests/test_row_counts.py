"""Queries on tables whose rows don't divide, and on values that engines round in their own ways."""

import glob
import os

import duckdb
import pytest

from rillmark.operators import batch as B
from rillmark.plans import catalog


def both(spark, folder, name):
    """The rows of a query and of its SQL, sorted, with floats told apart by their sign as well."""
    c = duckdb.connect()
    for f in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df, twin = catalog.queries()[name](spark, str(folder)), c.sql(catalog.oracle_sql()[name])
    assert df.columns == twin.columns
    return sorted(repr(tuple(r)) for r in df.collect()), sorted(map(repr, twin.fetchall()))


def some_documents(folder, n):
    ids = f"SELECT 7 * i + 3 AS doc_id, 'text ' || i AS text, 'en' AS lang, 'web' AS source, 6 AS n_chars FROM range({n}) r(i)"
    duckdb.sql(f"COPY ({ids}) TO '{folder}/documents.parquet'")


@pytest.mark.parametrize("n", [4, 5, 7, 102])
def test_chunks_of_rows_that_do_not_divide(spark, tmp_path, n):
    some_documents(tmp_path, n)
    got, want = both(spark, tmp_path, "rows_chunk")
    assert got == want and len(got) == n


def test_fewer_rows_than_chunks(spark):
    with pytest.raises(B.BatchError):
        B.chunk(spark.range(3).withColumnRenamed("id", "row_idx"), 4, 3, rest=True)


@pytest.mark.parametrize("n", [3, 50, 102])
def test_mini_batches_of_rows_that_do_not_divide(spark, tmp_path, n):
    some_documents(tmp_path, n)
    got, want = both(spark, tmp_path, "rows_mini_batches")
    assert got == want and len(got) == 2 * n
    if n % 50:
        with pytest.raises(B.BatchError):
            B.mini_batches(spark.range(n).withColumnRenamed("id", "row_idx"), 50, 2, "s", n)


def test_strict_box_of_prices_at_a_half(spark, tmp_path):
    """A box just inside or outside the last 100 characters, by a price that is rounded to even."""
    parts = "SELECT i AS p_partkey, CAST(5 AS INT) AS p_size, 960 + i + h AS p_retailprice FROM range(120) r(i), (SELECT unnest([0, 0.5]::DOUBLE[]) AS h)"
    duckdb.sql(f"COPY ({parts}) TO '{tmp_path}/part.parquet'")
    got, want = both(spark, tmp_path, "grade_strict_box")
    assert got == want and len(set(r[-5:] for r in got)) == 2


@pytest.mark.parametrize("n", [1, 2, 6, 101, 102, 103])
def test_reward_model_split_of_halves(spark, tmp_path, n):
    some_documents(tmp_path, n)
    got, want = both(spark, tmp_path, "reward_model_split")
    assert got == want and len(got) == n + (n % 4 == 2)


def some_vectors(folder):
    """Numbers on either side of zero and of halves at the fifth decimal."""
    x = "[-0.00004, 0.03125, -0.03125, -0.0, 1e-9]::FLOAT[]"
    duckdb.sql(f"COPY (SELECT i AS vec_id, CAST(i AS INT) AS label, {x} AS embedding FROM range(10) r(i)) TO '{folder}/embeddings.parquet'")


def test_padded_lists_keep_negative_zeros(spark, tmp_path):
    some_vectors(tmp_path)
    got, want = both(spark, tmp_path, "pad_right_lists")
    assert got == want and all("[-0.0" in r for r in got)


def test_lists_without_padding_keep_negative_zeros(spark, tmp_path):
    some_vectors(tmp_path)
    got, want = both(spark, tmp_path, "remove_left_padding")
    assert got == want and all("[-0.0" in r for r in got)
