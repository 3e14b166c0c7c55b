"""Importance weights, rejection masks and diagnostics of off-policy tokens.

``lr`` is the log-ratio of the training policy to the one that sampled; each function
takes token rows with (traj, mask) and Columns for log-probabilities."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .masked import inside, masked_mean

BOUND = 20.0
def _path():
    return Window.partitionBy("traj")



@dataclass(frozen=True)
class Band:
    low: float | None
    high: float


def parse_band(text: float | str) -> Band:
    """``high`` truncates; ``low_high`` keeps a band."""
    if isinstance(text, bool):
        raise TypeError("a threshold is a number or 'low_high'")
    parts = str(text).split("_")
    if len(parts) > 2:
        raise ValueError(f"bad threshold {text!r}")
    numbers = [float(p) for p in parts]
    if any(not n > 0 for n in numbers) or (len(numbers) == 2 and numbers[0] > numbers[1]):
        raise ValueError(f"thresholds are positive and ascending: {text!r}")
    return Band(numbers[0] if len(numbers) == 2 else None, numbers[-1])


def band_bounds(text: Column) -> Column:
    """struct<low, high> of thresholds in a column; null where they aren't positive and ascending."""
    parts = F.split(text, "_")
    number = lambda k: F.get(parts, k).try_cast("double")
    low, high = F.when(F.size(parts) == 2, number(F.lit(0))), number(F.size(parts) - 1)
    ok = (F.size(parts) <= 2) & (high > 0) & F.when(F.size(parts) == 2, (low > 0) & (low <= high)).otherwise(True)
    return F.when(F.coalesce(ok, F.lit(False)), F.struct(low.alias("low"), high.alias("high")))


def clamp(x: Column, bound: float = BOUND) -> Column:
    return F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))


def importance_weights(tokens: DataFrame, lr: Column, level: str, threshold: float | str, normalise: bool = False) -> DataFrame:
    """Adds ``raw_weight`` and ``weight``: exp of the bounded log-ratio of a token, or of its
    trajectory's sum; zero outside the mask; truncated, or zero outside a band."""
    band = parse_band(threshold)
    m = F.col("mask")
    if level == "token":
        log = clamp(lr)
    elif level == "sequence":
        log = clamp(F.sum(inside(lr, m)).over(_path()))
    else:
        raise ValueError(f"unknown level {level!r}")
    raw = F.exp(log) * m
    kept = F.least(raw, F.lit(band.high)) if band.low is None else F.when((raw >= band.low) & (raw <= band.high), raw).otherwise(0.0)
    out = tokens.withColumn("raw_weight", raw).withColumn("weight", kept)
    if normalise:
        if level == "token":
            mean = out.agg(masked_mean(F.col("weight"), m).alias("_mean"))
        else:
            each = out.where("mask > 0").groupBy("traj").agg(F.max("weight").alias("w"))
            mean = each.agg(F.avg("w").alias("_mean"))
        out = out.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("weight") / F.greatest(F.col("_mean"), F.lit(1e-8))).drop("_mean")  # one row
    return out


def divergences(lr: Column) -> dict[str, Column]:
    return {"k1": lr, "k2": 0.5 * lr * lr, "k3": F.exp(lr) - 1 - lr}


def rejection_mask(tokens: DataFrame, lr: Column, options: dict[str, float | str]) -> DataFrame:
    """Adds ``new_mask``: the mask where every option holds.  An option is token_kN, seq_sum_kN,
    seq_mean_kN or seq_max_kN; k1 takes a band of the ratio (low defaults to 1/high), the
    others an upper bound."""
    m = F.col("mask")
    bounded = clamp(lr)
    kinds = divergences(bounded)
    keep = F.lit(True)
    for name, threshold in options.items():
        level, _, kind = name.rpartition("_")
        if kind not in kinds or level not in ("token", "seq_sum", "seq_mean", "seq_max") or (level == "seq_max" and kind == "k1"):
            raise ValueError(f"unknown option {name!r}")
        band = parse_band(threshold)
        x = kinds[kind]
        value = {
            "token": x, "seq_sum": F.sum(inside(x, m)).over(_path()),
            "seq_mean": F.sum(inside(x, m)).over(_path()) / (F.sum(m).over(_path()) + 1e-8), "seq_max": F.max(F.when(m > 0, x)).over(_path()),
        }[level]
        if kind == "k1":
            low = 1 / band.high if band.low is None else band.low
            ok = (value >= F.log(F.lit(low))) & (value <= F.log(F.lit(band.high)))
        else:
            if band.low is not None:
                raise ValueError("only k1 takes a band")
            ok = value <= band.high
        keep = keep & F.coalesce(ok, F.lit(False))
    return tokens.withColumn("_lr", lr).withColumn("new_mask", F.when(keep, m).otherwise(0)).drop("_lr")


def weight_metrics(tokens: DataFrame, high: float, low: float) -> DataFrame:
    """One row: mean, max, min, std, effective share, and fractions beyond the thresholds of
    the raw weights inside the mask."""
    w = F.when(F.col("mask") > 0, F.col("raw_weight"))
    c = F.when(F.col("mask") > 0, F.col("weight"))
    return tokens.agg(
        F.avg(c).alias("mean"), F.max(w).alias("max"), F.min(w).alias("min"), F.stddev_samp(c).alias("std"),
        (F.avg(c) * F.avg(c) / F.avg(c * c)).alias("ess"), F.avg((w > high).cast("double")).alias("fraction_high"), F.avg((w < low).cast("double")).alias("fraction_low"),
    )


def rejection_metrics(tokens: DataFrame, value: Column) -> DataFrame:
    """One row: value's mean, max, min, std inside the mask, and shares of tokens and
    trajectories that lost tokens."""
    v = F.when(F.col("mask") > 0, value)
    lost = (F.col("mask") > 0) & (F.col("new_mask") == 0)
    tok = tokens.agg(F.avg(v).alias("mean"), F.max(v).alias("max"), F.min(v).alias("min"), F.stddev_samp(v).alias("std"), (F.count_if(lost) / F.sum("mask")).alias("masked_fraction"))
    seq = tokens.groupBy("traj").agg(F.max(lost.cast("int")).alias("hit")).agg(F.avg("hit").alias("seq_masked_fraction"))
    return tok.crossJoin(F.broadcast(seq))  # one row each


def diagnostics(tokens: DataFrame, train: Column, rollout: Column) -> DataFrame:
    """One row: perplexities of both policies, their log difference, KL estimates and
    chi-square terms over tokens and trajectories."""
    m = F.col("mask")
    lr = train - rollout
    seq = tokens.groupBy("traj").agg(
        masked_mean(train, m).alias("t"), masked_mean(rollout, m).alias("r"), F.sum(inside(lr, m)).alias("s"), F.sum(m).alias("n"),
        F.sum(inside(F.exp(clamp(2 * lr)), m)).alias("rho2"), F.sum(inside(F.exp(lr) - lr - 1, m)).alias("k3"), F.sum(inside(-lr, m)).alias("k1"),
    ).where("n > 0")
    d = F.col("r") - F.col("t")
    return seq.agg(
        F.avg(F.exp(-F.col("t"))).alias("training_ppl"), F.avg(F.exp(-F.col("r"))).alias("rollout_ppl"), F.avg(d).alias("log_ppl_diff"), F.avg(F.abs(d)).alias("log_ppl_abs_diff"),
        F.max(d).alias("log_ppl_diff_max"), F.min(d).alias("log_ppl_diff_min"), F.avg(F.exp(d)).alias("ppl_ratio"), (F.sum("k1") / F.sum("n")).alias("kl"), (F.sum("k3") / F.sum("n")).alias("k3_kl"),
        (F.sum("rho2") / F.sum("n") - 1).alias("chi2_token"), (F.avg(F.exp(clamp(2 * F.col("s")))) - 1).alias("chi2_seq"),
    )


def correct(tokens: DataFrame, lr: Column, level: str | None = "token", threshold: float | str = 2.0, options: dict[str, float | str] | None = None) -> DataFrame:
    """Weights and rejection at once; ``mask`` becomes the shrunken one, the old is ``old_mask``."""
    out = importance_weights(tokens, lr, level, threshold) if level else tokens
    out = rejection_mask(out, lr, options) if options else out.withColumn("new_mask", F.col("mask"))
    return out.withColumnRenamed("mask", "old_mask").withColumnRenamed("new_mask", "mask")


def bypass(tokens: DataFrame, old: str = "old_lp", rollout: str = "rollout_lp") -> DataFrame:
    """Take the sampling policy's log-probabilities as the old ones."""
    return tokens.withColumn(old, F.col(rollout))
