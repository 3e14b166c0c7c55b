"""Masked statistics over token rows (``mask`` 0/1) and group statistics over trajectories.

Values outside the mask never count, not even as NaN: they are replaced, not multiplied."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MEAN_EPS = 1e-8
WHITEN_EPS = 1e-8


def inside(x: Column, mask: Column) -> Column:
    return F.when(mask > 0, x).otherwise(F.lit(0.0))


def masked_sum(x: Column, mask: Column) -> Column:
    return F.sum(inside(x, mask))


def masked_mean(x: Column, mask: Column, eps: float = MEAN_EPS) -> Column:
    return masked_sum(x, mask) / (F.sum(mask) + F.lit(eps))


def plain_masked_mean(x: Column, mask: Column) -> Column:
    """Without the small term: null over an empty mask."""
    return F.avg(F.when(mask > 0, x))


def whitening(df: DataFrame, value: str, mask: str) -> DataFrame:
    """One row (_mean, _var) of the batch: masked mean and its Bessel-corrected variance; an
    error if the mask covers fewer than two tokens."""
    x, m = F.col(value), F.col(mask)
    on = F.when(m > 0, x)
    sums = df.agg(masked_sum(x, m).alias("_s"), F.sum(m).cast("double").alias("_n"), F.count(on).alias("_c"), F.avg(on).alias("_a"), F.var_pop(on).alias("_v"))
    n, mean = F.col("_n"), F.col("_s") / (F.col("_n") + MEAN_EPS)
    squares = F.col("_c") * (F.col("_v") + (F.col("_a") - mean) ** 2)  # around the mean that has the small term
    variance = F.when(n < 2, F.raise_error(F.lit("variance over fewer than two tokens"))).otherwise(squares / (n + MEAN_EPS) * n / (n - 1))
    return sums.select(mean.alias("_mean"), variance.alias("_var"))


def whiten(df: DataFrame, value: str, mask: str, out: str, keep_mean: bool = False) -> DataFrame:
    """Scale all positions by the masked mean and variance of the whole batch."""
    stats = whitening(df, value, mask)
    scaled = (F.col(value) - F.col("_mean")) / F.sqrt(F.col("_var") + WHITEN_EPS)
    return df.crossJoin(F.broadcast(stats)).withColumn(out, scaled + F.col("_mean") if keep_mean else scaled).drop("_mean", "_var")  # one row


def group_stats(df: DataFrame, group: list[str], value: str, eps: float = 0.0) -> DataFrame:
    """Adds g_n, g_mean, g_std of each row's group: sample deviation with the variance
    floored at ``eps``; a group of one has mean 0 and deviation 1."""
    w = Window.partitionBy(*group)
    n = F.count(F.lit(1)).over(w)
    mean = F.when(n == 1, 0.0).otherwise(F.avg(value).over(w))
    std = F.when(n == 1, 1.0).otherwise(F.sqrt(F.greatest(F.var_samp(value).over(w), F.lit(eps))))
    return df.withColumns({"g_n": n, "g_mean": mean, "g_std": std})


def dense_labels(df: DataFrame, group: str, out: str = "label") -> DataFrame:
    """Labels 0.. by ascending group key, numbers near a whole number as that number."""
    key = F.col(group)
    if dict(df.dtypes)[group] in ("double", "float"):
        key = F.when(F.abs(key - F.round(key)) <= 1e-6, F.round(key)).otherwise(key)
    df = df.withColumn("_key", key)
    from .batch import with_row_index

    named = with_row_index(df.select("_key").distinct(), ["_key"], out).withColumn(out, F.col(out).cast("int"))
    return df.join(named, "_key").drop("_key")


def mean_across_ranks(df: DataFrame, value: str, mask: str, rank: str) -> DataFrame:
    """One row: the masked mean over all ranks, from each rank's sums."""
    each = df.groupBy(rank).agg(masked_sum(F.col(value), F.col(mask)).alias("s"), F.sum(mask).alias("n"))
    return each.agg((F.sum("s") / F.sum("n")).alias("mean"))


def spread_stats(df: DataFrame, value: str) -> DataFrame:
    """(mean, max, min, std) of a column, the deviation Bessel-corrected."""
    return df.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"))
