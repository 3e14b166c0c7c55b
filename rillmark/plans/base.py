"""Registration of queries with their SQL, and the views that map tables to the data model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        name = f.__name__
        if name in QUERIES:
            raise ValueError(name)
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column | str) -> Column:
    """Six decimals and no negative zero, as the SQL twins round."""
    return F.round(F.col(x) if isinstance(x, str) else x, 6) + F.lit(0.0)


def s6(x: str) -> str:
    return f"(round({x}, 6) + 0.0)"


def r8(x: Column | str) -> Column:
    """Eight decimals, for values that end in a five at the seventh."""
    return F.round(F.col(x) if isinstance(x, str) else x, 8) + F.lit(0.0)


def s8(x: str) -> str:
    return f"(round({x}, 8) + 0.0)"


TOKENS_SQL = """tok AS MATERIALIZED (
  SELECT o_custkey AS uid, l_orderkey AS traj,
    CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INT) AS pos,
    CASE WHEN l_returnflag <> 'R' THEN 1 ELSE 0 END AS mask, l_quantity / 50 AS reward, l_extendedprice / 1e5 AS value,
    -l_discount AS old_lp, -(l_discount + l_tax) / 1.5 AS rollout_lp, -l_tax AS ref_lp, -(l_discount * 0.7 + l_tax * 0.4) AS lp,
    l_quantity / 50 - 0.5 AS advantage, 0.3 + l_tax AS sum_pi_squared, o_orderpriority AS prio
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
TRAJ_SQL = """traj AS MATERIALIZED (SELECT uid, traj, prio, sum(reward) AS score, sum(mask) AS length FROM tok GROUP BY ALL)"""


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as tokens: an order is a trajectory, its customer the prompt."""
    from pyspark.sql import Window

    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("uid"), F.col("o_orderpriority").alias("prio"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return (
        table(spark, sf_dir, "lineitem")
        .join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .select(
            "uid", F.col("l_orderkey").alias("traj"), (F.row_number().over(order) - 1).alias("pos"), F.when(F.col("l_returnflag") != "R", 1).otherwise(0).alias("mask"),
            (F.col("l_quantity") / 50).alias("reward"), (F.col("l_extendedprice") / 1e5).alias("value"), (-F.col("l_discount")).alias("old_lp"),
            (-(F.col("l_discount") + F.col("l_tax")) / 1.5).alias("rollout_lp"), (-F.col("l_tax")).alias("ref_lp"), (-(F.col("l_discount") * 0.7 + F.col("l_tax") * 0.4)).alias("lp"),
            (F.col("l_quantity") / 50 - 0.5).alias("advantage"), (0.3 + F.col("l_tax")).alias("sum_pi_squared"), "prio",
        )
    )


def trajectories(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.advantage import trajectories as of

    return of(tokens(spark, sf_dir), keep=("prio",))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a query that writes and reads again: under ``spark.checkpoint.dir``, or
    on this machine where the session names none and runs here."""
    import tempfile
    import uuid

    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = tempfile.mkdtemp(prefix="scratch-")
    return f"{root}/{name}-{uuid.uuid4()}"
