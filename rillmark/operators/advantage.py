"""Advantages and returns.

Outcome estimators work on trajectories: the score of one is the plain sum of its token
rewards, and what they give is one number per trajectory, broadcast over its masked
tokens.  Estimators that recur over a trajectory walk gathered arrays; those that relate
equal positions of a group work on token rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batch import with_ranges
from .masked import group_stats, whiten

EPS = 1e-6
_REGISTRY: dict[str, Callable[..., DataFrame]] = {}


def register(name: str) -> Callable:
    """Register an estimator; another function under a taken name is an error."""

    def put(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        if _REGISTRY.setdefault(name, f) is not f:
            raise ValueError(f"{name} is registered with another function")
        return f

    return put


def estimator(name: str) -> Callable[..., DataFrame]:
    if name not in _REGISTRY:
        raise ValueError(f"unknown estimator {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def trajectories(tokens: DataFrame, uid: str = "uid", traj: str = "traj", keep: tuple[str, ...] = ()) -> DataFrame:
    """(uid, traj, score, length) with partial sums before the shuffle."""
    return tokens.groupBy(uid, traj, *keep).agg(F.sum("reward").alias("score"), F.sum("mask").alias("length"))


def broadcast_scalar(tokens: DataFrame, scalars: DataFrame, value: str = "advantage", traj: str = "traj") -> DataFrame:
    """A trajectory's number on each of its tokens, zero outside the mask."""
    return tokens.join(scalars.select(traj, F.col(value).alias("_scalar")), traj).withColumn(value, F.col("_scalar") * F.col("mask")).drop("_scalar")


def _grouped(traj: DataFrame, by: list[str]) -> DataFrame:
    return group_stats(traj, by, "score")


@register("grpo")
def grpo(traj: DataFrame, by: list[str], scale: bool = True) -> DataFrame:
    """Score less the group's mean, over its deviation; ``scale=False`` only centres."""
    g = _grouped(traj, by)
    centred = F.col("score") - F.col("g_mean")
    return g.withColumn("advantage", centred / (F.col("g_std") + EPS) if scale else centred)


register("grpo_vectorized")(lambda traj, by, scale=True: grpo(traj, by, scale))


@register("grpo_passk")
def pass_at_k(traj: DataFrame, by: list[str], tie: str = "traj", scale: bool = True) -> DataFrame:
    """Only the best of a group gets its lead over the second; groups of one are an error."""
    w = Window.partitionBy(*by)
    ranked = w.orderBy(F.desc("score"), tie)
    g = traj.withColumns({"_k": F.row_number().over(ranked), "_next": F.lead("score").over(ranked), "g_n": F.count(F.lit(1)).over(w), "_std": F.stddev_samp("score").over(w)})
    lead = F.col("score") - F.col("_next")
    best = F.when(F.col("g_n") < 2, F.raise_error(F.lit("pass@k needs two trajectories in each group"))).when(F.col("_k") == 1, lead / (F.col("_std") + EPS) if scale else lead).otherwise(0.0)
    return g.withColumn("advantage", best).drop("_k", "_next", "_std")


@register("rloo")
def rloo(traj: DataFrame, by: list[str]) -> DataFrame:
    """n/(n-1) of the score less the mean; a lone trajectory keeps its score."""
    g = _grouped(traj, by)
    n = F.col("g_n")
    return g.withColumn("advantage", F.when(n > 1, n * (F.col("score") - F.col("g_mean")) / (n - 1)).otherwise(F.col("score")))


@register("rloo_vectorized")
def rloo_zero(traj: DataFrame, by: list[str]) -> DataFrame:
    """As rloo, but a lone trajectory has none."""
    w = Window.partitionBy(*by)
    g = traj.withColumns({"g_n": F.count(F.lit(1)).over(w), "_sum": F.sum("score").over(w)})
    n = F.col("g_n")
    return g.withColumn("advantage", F.when(n > 1, (n * F.col("score") - F.col("_sum")) / (n - 1)).otherwise(0.0)).drop("_sum")


@register("opo")
def opo(traj: DataFrame, by: list[str]) -> DataFrame:
    """The baseline is the mean score weighted by length; none for a lone trajectory."""
    w = Window.partitionBy(*by)
    g = traj.withColumns({"g_n": F.count(F.lit(1)).over(w), "_base": F.try_divide(F.sum(F.col("length") * F.col("score")).over(w), F.sum("length").over(w))})
    return g.withColumn("advantage", F.col("score") - F.when(F.col("g_n") > 1, F.coalesce("_base", F.lit(0.0))).otherwise(0.0)).drop("_base")


@register("gpg")
def gpg(traj: DataFrame, by: list[str], f_norm: float = 1.0) -> DataFrame:
    """Centred scores times rows over rows with a nonzero score."""
    g = _grouped(traj, by)
    alpha = traj.agg((F.count(F.lit(1)) / F.greatest(F.count_if(F.col("score") != 0), F.lit(1))).alias("_alpha"))
    return g.crossJoin(F.broadcast(alpha)).withColumn("advantage", F.col("_alpha") * (F.col("score") - F.col("g_mean")) / f_norm).drop("_alpha")  # one row


def whitened_outcome(tokens: DataFrame, scalars: DataFrame, out: str = "advantage") -> DataFrame:
    """A trajectory's number tiled over its mask, whitened over the batch, and masked."""
    tiled = broadcast_scalar(tokens, scalars)
    return whiten(tiled, "advantage", "mask", out).withColumn(out, F.col(out) * F.col("mask"))


@register("reinforce_plus_plus_baseline")
def reinforce_pp_baseline(tokens: DataFrame, by: list[str]) -> DataFrame:
    """Centred scores, tiled and whitened."""
    return whitened_outcome(tokens, grpo(trajectories(tokens, keep=tuple(c for c in by if c != "uid")), by, scale=False))


@register("gdpo")
def gdpo(scores: DataFrame, tokens: DataFrame, by: list[str], keys: dict[str, float]) -> DataFrame:
    """Each reward key normalised within its group, summed by weight, whitened.

    ``scores`` has a row per trajectory with one column per key; keys weigh 1 unless told."""
    missing = [k for k in keys if k not in scores.columns]
    if missing:
        raise ValueError(f"no such reward keys: {missing}")
    total = scores
    weighted = None
    for k, weight in keys.items():
        total = group_stats(total, by, k)
        part = F.lit(weight) * (F.col(k) - F.col("g_mean")) / (F.col("g_std") + EPS)
        total = total.withColumn(f"_part_{k}", part).drop("g_n", "g_mean", "g_std")
        weighted = F.col(f"_part_{k}") if weighted is None else weighted + F.col(f"_part_{k}")
    return whitened_outcome(tokens, total.withColumn("advantage", weighted))


def _scan(tokens: DataFrame, columns: list[str], out: dict[str, str], walk: Callable[[dict[str, np.ndarray], list, int], dict[str, np.ndarray]]) -> DataFrame:
    """(uid, traj, pos, ...): recurrences from the last token to the first.

    Trajectories are gathered as arrays; ``walk(columns, steps)`` gets the tokens of many of
    them end to end, and for each distance from the end the trajectories that have such a
    token and where it lies.  So the work follows the tokens, in vectors over trajectories."""
    gathered = tokens.groupBy("uid", "traj").agg(F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), *columns))).alias("_tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(2)
            flat = lists.flatten()
            size = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
            ends, by = np.cumsum(size), np.argsort(-size, kind="stable")
            left = np.searchsorted(-size[by], -np.arange(int(size.max(initial=0))), side="left")  # how many are longer
            steps = [(by[: left[k]], ends[by[: left[k]]] - 1 - k) for k in range(len(left))]
            held = {c: flat.field(c).to_numpy(zero_copy_only=False).astype(float) for c in columns}
            made = walk(held, steps, len(size))
            owner = pa.array(np.repeat(np.arange(len(size)), size))
            values = [flat.field("pos"), *(pa.array(made[c], {"int": pa.int32(), "double": pa.float64()}[t], safe=False) for c, t in out.items())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), batch.column(1).take(owner), *values], names=["uid", "traj", "pos", *out])

    kinds = dict(gathered.dtypes)
    return gathered.mapInArrow(run, f"uid {kinds['uid']}, traj {kinds['traj']}, pos int, " + ", ".join(f"{c} {t}" for c, t in out.items()))


def gae_raw(tokens: DataFrame, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """(uid, traj, pos, mask, raw_advantage, returns): generalised advantages before
    whitening.  Positions outside the mask pass the later value and sum through."""

    def walk(t: dict[str, np.ndarray], steps: list, n: int) -> dict[str, np.ndarray]:
        following, last, kept = np.zeros(n), np.zeros(n), np.empty(len(t["mask"]))
        for who, at in steps:
            on = t["mask"][at] > 0
            new = t["reward"][at] + gamma * following[who] - t["value"][at] + gamma * lam * last[who]
            last[who] = np.where(on, new, last[who])
            following[who] = np.where(on, t["value"][at], following[who])
            kept[at] = last[who]
        return {"mask": t["mask"], "raw_advantage": kept, "returns": kept + t["value"]}

    return _scan(tokens, ["reward", "value", "mask"], {"mask": "int", "raw_advantage": "double", "returns": "double"}, walk)


@register("gae")
def gae(tokens: DataFrame, gamma: float = 1.0, lam: float = 1.0) -> DataFrame:
    """Adds the advantage whitened over the batch (on all positions)."""
    return whiten(gae_raw(tokens, gamma, lam), "raw_advantage", "mask", "advantage")


def discounted_returns(tokens: DataFrame, gamma: float = 1.0) -> DataFrame:
    """(uid, traj, pos, mask, returns): discounted sums from the end, restarted where the mask is 0."""

    def walk(t: dict[str, np.ndarray], steps: list, n: int) -> dict[str, np.ndarray]:
        running, out = np.zeros(n), np.empty(len(t["mask"]))
        for who, at in steps:
            out[at] = t["reward"][at] + gamma * running[who]
            running[who] = out[at] * t["mask"][at]
        return {"mask": t["mask"], "returns": out}

    return _scan(tokens, ["reward", "mask"], {"mask": "int", "returns": "double"}, walk)


@register("reinforce_plus_plus")
def reinforce_pp(tokens: DataFrame, gamma: float = 1.0) -> DataFrame:
    out = whiten(discounted_returns(tokens, gamma), "returns", "mask", "advantage")
    return out.withColumn("advantage", F.col("advantage") * F.col("mask"))


@register("remax")
def remax(tokens: DataFrame, baseline: str = "baseline") -> DataFrame:
    """Masked rewards to come, less the greedy rollout's score on masked tokens."""
    ahead = Window.partitionBy("uid", "traj").orderBy("pos").rowsBetween(0, Window.unboundedFollowing)
    back = tokens.withColumn("returns", F.sum(F.col("reward") * F.col("mask")).over(ahead))
    return back.withColumn("advantage", F.col("returns") - F.col(baseline) * F.col("mask"))


def greedy_baseline(sampled: DataFrame, greedy: DataFrame, uid: str = "uid") -> DataFrame:
    """The score of each prompt's greedy rollout on its sampled rows."""
    return sampled.join(greedy.groupBy(uid).agg(F.sum("reward").alias("baseline")), uid)


@register("optimal_token_baseline")
def token_baseline(tokens: DataFrame, by: list[str], compact: bool = False, ratio: str | None = None) -> DataFrame:
    """Rewards to come less a baseline for each (group, position), weighted by the gathered
    variance of the policy: w = 1 - 2 pi + sum(pi^2), times the squared ratio if given.

    A lone trajectory has no baseline, nor has the single longest of a group from the
    length of the second longest on.  ``compact`` counts positions over masked tokens:
    the others, whatever they hold, have advantage and baseline 0 and belong to no position."""
    path = Window.partitionBy("uid", "traj").orderBy("pos")
    m, inside = F.col("mask"), F.col("mask") > 0
    own = (lambda x: F.when(inside, x).otherwise(0.0)) if compact else (lambda x: x)
    at = F.when(inside, F.count_if(inside).over(path.rowsBetween(Window.unboundedPreceding, 0)) - 1) if compact else F.col("pos")
    t = tokens.withColumn("at", at)
    weight = 1 - 2 * F.exp("old_lp") + F.col("sum_pi_squared")
    if ratio:
        weight = weight * F.col(ratio) ** 2
    t = t.withColumns({
        "_g": F.sum(own(F.col("reward") * m)).over(path.rowsBetween(0, Window.unboundedFollowing)),
        "_w": F.sum(own(weight * m)).over(path.rowsBetween(Window.unboundedPreceding, 0)),
        "_len": F.sum("mask").over(Window.partitionBy("uid", "traj")),
    })
    counted = t.where(inside) if compact else t
    sizes = counted.groupBy(*by, "traj").agg(F.max("_len").alias("_len"))
    ranked = sizes.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_len"))))
    top = ranked.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), F.max(F.when(F.col("_k") == 1, F.col("_len"))).alias("_first"), F.max(F.when(F.col("_k") == 2, F.col("_len"))).alias("_second"))
    base = counted.groupBy(*by, "at").agg((F.sum(F.col("_g") * F.col("_w") * m) / (F.sum(F.col("_w") * m) + 1e-8)).alias("_b"))
    how = "left" if compact else "inner"
    joined = t.join(base, [*by, "at"], how).join(top, by, how)
    tail = (F.col("_len") == F.col("_first")) & (F.col("_first") > F.col("_second")) & (F.col("at") >= F.col("_second"))
    b = own(F.when((F.col("_n") < 2) | tail, 0.0).otherwise(F.col("_b")))
    out = joined.withColumns({"returns": F.col("_g"), "baseline": b, "advantage": own((F.col("_g") - b) * m)})
    return out.drop("_g", "_w", "_len", "_n", "_first", "_second", "_b", *([] if "at" in tokens.columns else ["at"]))


@register("tir_optimal_token_baseline")
def turns_token_baseline(tokens: DataFrame, by: list[str], ratio: str | None = None) -> DataFrame:
    """The token baseline of trajectories of several turns: positions count masked tokens."""
    return token_baseline(tokens, by, True, ratio)


def final_session_advantage(rows: DataFrame, score: str = "score") -> DataFrame:
    """Sessions of several trajectories: the last one is scored against its prompt's other
    sessions, and all of the session's rows take its advantage."""
    last = rows.groupBy("uid", "session_id").agg(F.max_by(score, "idx").alias("score"))
    return rows.join(grpo(last, ["uid"]).select("uid", "session_id", "advantage"), ["uid", "session_id"])


def kl_in_reward(tokens: DataFrame, beta: float, kl: Column) -> DataFrame:
    """token reward less beta times the divergence inside the mask."""
    return tokens.withColumn("kl", kl).withColumn("reward", F.col("reward") - beta * F.col("kl") * F.col("mask"))


def current_kl(tokens: DataFrame, kl: Column) -> DataFrame:
    """Mean over trajectories of their masked mean divergence."""
    from .masked import masked_mean

    each = tokens.groupBy("uid", "traj").agg(masked_mean(kl, F.col("mask")).alias("kl"))
    return each.agg(F.avg("kl").alias("current_kl"))


def adaptive_beta(steps: DataFrame, beta: float, target: float, horizon: float, step: str = "step", kl: str = "kl", n: str = "n") -> DataFrame:
    """The coefficient after each step of an adaptive controller (one row per step)."""
    rows = steps.agg(F.array_sort(F.collect_list(F.struct(F.col(step).cast("bigint").alias("s"), F.col(kl).cast("double").alias("k"), F.col(n).cast("double").alias("n")))).alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten()
            k, n = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("k", "n"))
            yield pa.RecordBatch.from_arrays([flat.field("s"), pa.array(beta * np.cumprod(1 + np.clip(k / target - 1, -0.2, 0.2) * n / horizon))], names=["step", "beta"])

    return rows.mapInArrow(run, "step bigint, beta double")


def resample_weights(rows: DataFrame, score: str, mode: str = "pow", power: float = 2.0) -> DataFrame:
    """Preference weights: |score|^power, or 1 for the batch's extremes and 0 (or a share of
    0.4) for the others; plus a small term, and normalised."""
    s = F.col(score)
    ends = rows.agg(F.max(score).alias("_hi"), F.min(score).alias("_lo"))
    joined = rows.crossJoin(F.broadcast(ends))  # one row
    extreme = (s == F.col("_hi")) | (s == F.col("_lo"))
    weight = {"pow": F.abs(s) ** power, "max_min": F.when(extreme, 1.0).otherwise(0.0), "max_random": F.when(s == F.col("_hi"), 1.0).otherwise(0.4)}[mode] + 1e-8
    return joined.withColumn("weight", weight).drop("_hi", "_lo")


def resample(rows: DataFrame, n: int, seed: str, key: str, weight: str = "weight") -> DataFrame:
    """n draws with replacement in proportion to weights: draw i falls at a fixed
    pseudo-random point of the weights summed in the order of ``key``.

    Weights are summed inside ranges of the key, then over ranges.  A draw finds its range,
    then the last row there that begins at or before its point: every draw has one row, and
    no task holds all rows.  Rows without weight
    are never drawn."""
    dealt = with_ranges(rows.where(F.col(weight) > 0), [key])
    ordered = Window.orderBy("_range")
    sums = dealt.groupBy("_range").agg(F.sum(weight).alias("_sum"))  # a row per range
    sums = sums.withColumns({"_before": F.coalesce(F.sum("_sum").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)), "_total": F.sum("_sum").over(ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    sums = sums.withColumn("_after", F.lead("_before", 1, float("inf")).over(ordered)).drop("_sum")
    unit = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("draw").cast("string"))), 1, 8), 16, 10).cast("double") / float(1 << 32)
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw")).withColumn("_u", unit)
    point = F.col("_u") * F.col("_total")
    draws = draws.join(F.broadcast(sums), (point >= F.col("_before")) & (point < F.col("_after")))
    inside = Window.partitionBy("_range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    begins = dealt.select("_range", F.coalesce(F.sum(weight).over(inside), F.lit(0.0)).alias("_at"), F.lit(None).cast("bigint").alias("draw"), F.struct(*rows.columns).alias("_row"), F.col(key).alias("_key"))
    points = draws.select("_range", (point - F.col("_before")).alias("_at"), "draw")
    # at the same place rows come before draws
    sweep = Window.partitionBy("_range").orderBy("_at", F.col("draw").asc_nulls_first(), "_key").rowsBetween(Window.unboundedPreceding, 0)
    hit = begins.unionByName(points, allowMissingColumns=True).withColumn("_row", F.last("_row", ignorenulls=True).over(sweep))
    return hit.where("draw IS NOT NULL").select("draw", "_row.*")
