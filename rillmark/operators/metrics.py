"""Roll-ups: evaluation, validation, training metrics, aggregation of metrics by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def offline_eval(scored: DataFrame, source: str, prompt: str, score: str) -> DataFrame:
    """Mean over a prompt's responses, then over a source's prompts."""
    each = scored.groupBy(source, prompt).agg(F.avg(score).alias("s"))
    return each.groupBy(source).agg(F.avg("s").alias("test_score"), F.count(F.lit(1)).alias("prompts"))


def best_of_k(sorted_values: Column, k: int, worst: bool = False) -> Column:
    """The expected best (worst) of k draws with replacement, in closed form.  A worst of k is
    the best of the negated values."""
    n = F.size(sorted_values).cast("double")
    values = F.reverse(sorted_values) if worst else sorted_values
    weighted = F.transform(values, lambda v, i: v * (F.pow((i + 1) / n, F.lit(k)) - F.pow(i / n, F.lit(k))))
    return F.aggregate(weighted, F.lit(0.0), lambda a, v: a + v)


def best_of_k_std(sorted_values: Column, k: int, worst: bool = False) -> Column:
    """The deviation of the best (worst) of k draws with replacement, in closed form."""
    from .arrays import let

    n = F.size(sorted_values).cast("double")
    weight = (lambda i: F.pow(1 - i / n, F.lit(k)) - F.pow(1 - (i + 1) / n, F.lit(k))) if worst else (lambda i: F.pow((i + 1) / n, F.lit(k)) - F.pow(i / n, F.lit(k)))
    mean = F.aggregate(F.transform(sorted_values, lambda v, i: v * weight(i)), F.lit(0.0), lambda a, v: a + v)
    spread = lambda p: F.aggregate(F.transform(p["x"], lambda v, i: F.pow(v - p["m"], F.lit(2)) * weight(i)), F.lit(0.0), lambda a, v: a + v)
    return F.sqrt(let(F.struct(sorted_values.alias("x"), mean.alias("m")), spread))


def bootstrap(samples: DataFrame, by: list[str], value: str, order: str, k: int, reducers: dict[str, Callable[[np.ndarray], float]], draws: int = 1000, seed: int = 42) -> DataFrame:
    """(by, reducer, mean, std) of any functions of k values drawn with replacement, so many
    times; the draws are those of a seeded generator, so that reruns agree.  For groups of a few
    values, a prompt's responses: one is held by a task.  ``resampled`` takes groups of any size."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        held = rows.sort_values(order)[value].to_numpy(dtype=float)
        drawn = held[np.random.RandomState(seed).choice(len(held), size=(draws, k), replace=True)]
        found = {name: np.array([f(x) for x in drawn], dtype=float) for name, f in reducers.items()}
        return pd.DataFrame([(*(rows[c].iloc[0] for c in by), name, x.mean(), x.std()) for name, x in found.items()], columns=[*by, "reducer", "mean", "std"])

    kinds = dict(samples.dtypes)
    return samples.select(*by, value, order).groupBy(*by).applyInPandas(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in by), "reducer string, mean double, std double"]))


def resampled(samples: DataFrame, by: list[str], value: str, order: list[str], k: int, reducers: dict[str, Callable[[Column], Column]], draws: int = 1000, seed: int = 42) -> DataFrame:
    """(by, reducer, mean, std) of any functions of k values drawn with replacement, so many times.

    A reducer takes the array of the values of a draw.  The place that value j of draw i of a group takes
    is a hash of (seed, group, i, j), so any engine can repeat it, and values come by a join
    on (group, place): no task holds a group.  ``order`` is a total order within a group, and its
    first column a number or a text."""
    from .batch import hash_key, with_row_index

    keyed = samples.select(F.struct(*by).alias("_by"), *(F.col(c).alias(f"_o{i}") for i, c in enumerate(order)), F.col(value).alias("_value"))
    keyed = keyed.withColumn("_name", F.concat_ws("\0", *(F.coalesce(F.col(f"_by.{c}").cast("string"), F.lit("")) for c in by)))
    # numbered over all rows by the group first, and from each group's first row on
    numbered = with_row_index(keyed, ["_name", *(f"_o{i}" for i in range(len(order)))], "_at")
    groups = numbered.groupBy("_by", "_name").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    each = groups.select("_by", "_first", "_n", "_name", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("_draw")).select("*", F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("_j"))
    place = F.shiftright(F.shiftright(hash_key(str(seed), F.col("_name"), F.col("_draw"), F.col("_j")), 28) * F.col("_n"), 32)
    drawn = each.select("_by", "_draw", "_j", (F.col("_first") + place).alias("_at")).join(numbered.select("_at", "_value"), "_at")
    held = drawn.groupBy("_by", "_draw").agg(F.transform(F.array_sort(F.collect_list(F.struct("_j", "_value"))), lambda x: x["_value"]).alias("_values"))  # k of them
    found = held.select("_by", F.explode(F.array(*(F.struct(F.lit(n).alias("reducer"), f(F.col("_values")).cast("double").alias("x")) for n, f in reducers.items()))).alias("m"))
    out = found.groupBy("_by", "m.reducer").agg(F.avg("m.x").alias("mean"), F.stddev_pop("m.x").alias("std"))
    return out.select("_by.*", "reducer", "mean", "std")


def vote_chances(counts: np.ndarray, k: int) -> np.ndarray:
    """For votes that ``counts`` of the samples cast, the chance of each to win among k draws with
    replacement: to be cast most often and, of those cast as often, to be seen first.

    Given how often each is cast, all orders are equally likely, so of t + 1 votes that tie each is
    first with a chance of 1 / (t + 1), the integral of y^t over [0, 1].  Cast counts are those of
    independent Poisson variables given their sum: for a winning count c, a programme over votes
    multiplies polynomials whose coefficients are the chances to be cast less than c times, and y times
    that of exactly c, at the nodes of a quadrature that is exact for the ties possible.  Votes
    cast by as many samples share their work."""
    n = counts.sum()
    sizes, of, times = np.unique(counts, return_inverse=True, return_counts=True)
    log = np.cumsum(np.log(np.maximum(np.arange(k + 1), 1)))  # of factorials
    chance = lambda mean: np.exp(np.arange(k + 1) * np.log(mean) - mean - log)
    each = np.array([chance(k * s / n) for s in sizes])
    out = np.zeros(len(sizes))
    for c in range(1, k + 1):
        width = k - c + 1
        node, weight = np.polynomial.legendre.leggauss(k // c // 2 + 1)
        y, weight = (node + 1) / 2, weight / 2

        def times_(a: np.ndarray, b: np.ndarray, width: int = width) -> np.ndarray:
            full = np.zeros_like(a)
            for j in range(width):
                full[:, j:] += a[:, : width - j] * b[:, j : j + 1]
            return full

        one = np.zeros((len(y), width))
        one[:, 0] = 1

        def power(base: np.ndarray, by: int, one: np.ndarray = one, times_: Callable = times_) -> np.ndarray:
            out = one
            while by:
                out = times_(out, base) if by & 1 else out
                base, by = times_(base, base), by >> 1
            return out

        factor = []
        for p in each:
            f = np.zeros((len(y), width))
            f[:, : min(c, width)] = p[: min(c, width)]
            if c < width:
                f[:, c] = y * p[c]
            factor.append(f)
        whole = [power(f, t) for f, t in zip(factor, times, strict=True)]
        before, after = [one], [one]
        for f in whole[:-1]:
            before.append(times_(before[-1], f))
        for f in whole[:0:-1]:
            after.append(times_(after[-1], f))
        for i, f in enumerate(factor):
            rest = times_(times_(before[i], after[len(sizes) - 1 - i]), power(f, int(times[i]) - 1))
            out[i] += each[i][c] * (weight @ rest[:, width - 1])
    return (out / chance(k)[k])[of]


def majority_of(samples: DataFrame, group: list[str], vote: str, value: str, ks: list[int]) -> DataFrame:
    """(group, k, mean, std) of the value of the majority vote of k of a group's samples, drawn with
    replacement: the value of the first one drawn that cast it.  Exact, by ``vote_chances``; rows without
    a value are left out, a null is a vote.  An array of a group's votes is held at a time."""
    votes = samples.where(F.col(value).isNotNull()).groupBy(*group, vote).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var"))
    held = votes.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("n", "mean", "var"))).alias("votes"))

    @F.pandas_udf("array<struct<k int, mean double, std double>>")
    def expected(votes: pd.Series) -> pd.Series:
        out = []
        chances = cache(lambda counts, k: vote_chances(np.array(counts), k))  # of a batch; many groups are cast alike
        for row in votes:
            n, mean, var = (np.array([v[c] for v in row], float) for c in ("n", "mean", "var"))
            told = []
            for k in ks:
                p = chances(tuple(n), k)
                m = float(p @ mean)
                told.append({"k": k, "mean": m, "std": float(np.sqrt(p @ (var + (mean - m) ** 2)))})
            out.append(told)
        return pd.Series(out)

    return held.select(*group, F.inline(expected("votes")))


def validation(samples: DataFrame, source: str, uid: str, value: str, ks: list[int]) -> DataFrame:
    """(source, metric, value): mean and population deviation over a prompt's responses,
    expected best and worst of k, each averaged over prompts."""
    each = samples.groupBy(source, uid).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.array_sort(F.collect_list(F.col(value).cast("double"))).alias("_v"))
    columns = {"mean": F.col("mean"), "std": F.col("std")}
    for k in ks:
        columns |= {f"best@{k}": best_of_k(F.col("_v"), k), f"worst@{k}": best_of_k(F.col("_v"), k, worst=True)}
    rows = each.select(source, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), c.alias("value")) for m, c in columns.items()))).alias("m"))
    return rows.groupBy(source, F.col("m.metric").alias("metric")).agg(F.avg("m.value").alias("value"))


def majority(samples: DataFrame, group: list[str], vote: str, value: str, order: str) -> DataFrame:
    """The first value of the most frequent vote (of equals, the first seen)."""
    votes = samples.groupBy(*group, vote).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("value"))
    return votes.withColumn("_k", F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("n"), "first"))).where("_k = 1").select(*group, F.col(vote).alias("vote"), "value", "n")


def section(name: Column, core: str, n_max: int) -> Column:
    """val-core for mean, maj and best at n of the core variable, else val-aux."""
    return F.when(name.rlike(f"^{core}/(mean|maj|best)@{n_max}(/|$)"), "val-core").otherwise("val-aux")


def training_metrics(tokens: DataFrame) -> DataFrame:
    """One row: scores of trajectories with tokens, advantages, values and returns inside the
    mask, lengths, aborted share, explained variance."""
    on = F.col("mask") > 0
    seq = tokens.groupBy("traj").agg(F.sum("reward").alias("score"), F.sum("mask").alias("n"))
    live = F.when(F.col("n") > 0, F.col("score"))
    s = seq.agg(F.avg(live).alias("score_mean"), F.max(live).alias("score_max"), F.min(live).alias("score_min"), F.avg("n").alias("length_mean"), F.max("n").alias("length_max"), F.min("n").alias("length_min"), F.avg((F.col("n") == 0).cast("double")).alias("aborted_ratio"))
    r, v = F.when(on, F.col("reward")), F.when(on, F.col("value"))
    t = tokens.agg(F.avg(r).alias("returns_mean"), F.avg(F.when(on, F.col("advantage"))).alias("advantage_mean"), F.max(F.when(on, F.col("advantage"))).alias("advantage_max"), F.avg(v).alias("value_mean"), (1 - F.var_samp(r - v) / (F.var_samp(r) + 1e-5)).alias("explained_variance"))
    return s.crossJoin(F.broadcast(t))  # one row each


def timing(sections: DataFrame, tokens: DataFrame, name: str, seconds: str, response: str = "response_tokens", every: str = "all_tokens") -> DataFrame:
    """Milliseconds per token of each section: generation over response tokens, others over all."""
    n = F.when(F.col(name) == "gen", F.col(response)).otherwise(F.col(every))
    return sections.crossJoin(F.broadcast(tokens)).select(name, F.when(n > 0, F.col(seconds) * 1000 / n).otherwise(0.0).alias("ms_per_token"))  # one row


def throughput(tokens: Column, seconds: Column, devices: int) -> Column:
    return tokens / (seconds * devices)


def routed_load(routed: DataFrame, experts: int, row: str, pos: str, layer: str, expert: str, valid: Column) -> DataFrame:
    """(layer, expert, n, violation): how often valid tokens but each row's last were routed,
    experts without tokens included, and n * experts / total - 1."""
    last = F.max(F.when(valid, F.col(pos))).over(Window.partitionBy(row))
    counted = routed.withColumn("_last", last).where(valid & (F.col(pos) < F.col("_last")))
    counts = counted.groupBy(layer, expert).agg(F.count(F.lit(1)).alias("n"))
    grid = routed.select(layer).distinct().withColumn(expert, F.explode(F.sequence(F.lit(0), F.lit(experts - 1))))
    full = grid.join(counts, [layer, expert], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.withColumn("violation", F.try_divide(F.col("n") * experts, F.sum("n").over(Window.partitionBy(layer))) - 1)


def interval_sums(counts: DataFrame, step: str, keys: list[str], n: str, every: int) -> DataFrame:
    """Sums of each interval of steps."""
    return counts.groupBy(F.floor(F.col(step) / every).cast("bigint").alias("interval"), *keys).agg(F.sum(n).alias("n"))


def speculative(df: DataFrame, drafts: str, accepted: str, verified: str, padding: Column) -> DataFrame:
    """Mean accepted per draft and 1 + accepted per verification; zero denominators give 0."""
    a, d, v = F.sum(F.when(~padding, F.col(accepted))), F.sum(F.when(~padding, F.col(drafts))), F.sum(F.when(~padding, F.col(verified)))
    return df.agg(F.when(d > 0, a / d).otherwise(0.0).alias("accept_rate"), F.when(v > 0, 1 + a / v).otherwise(0.0).alias("accept_length"))


def probability_gap(tokens: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: the difference of two policies' probabilities inside the mask, and their correlation."""
    on = F.col("mask") > 0
    p, q = F.when(on, F.exp(a)), F.when(on, F.exp(b))
    return tokens.agg(F.max(F.abs(p - q)).alias("max"), F.avg(F.abs(p - q)).alias("mean"), F.stddev_samp(F.abs(p - q)).alias("std"), F.corr(p, q).alias("pearson"))


def reduced(name: Column, value: Column) -> Column:
    """Aggregate by name: 'max' anywhere takes the maximum, else 'min' the minimum, else mean."""
    return F.when(F.first(name).contains("max"), F.max(value)).when(F.first(name).contains("min"), F.min(value)).otherwise(F.avg(value))


def across_ranks(df: DataFrame, keys: list[str], rank: str, step: str, value: str, how: str) -> DataFrame:
    """Sum and mean take the mean over ranks of each step first; min and max all values."""
    if how in ("min", "max"):
        return df.groupBy(*keys).agg(getattr(F, how)(value).alias("value"))
    each = df.groupBy(*keys, step).agg(F.avg(value).alias("v"))
    return each.groupBy(*keys).agg((F.sum if how == "sum" else F.avg)("v").alias("value"))


def step_rule(name: Column, explicit: dict[str, str] | None = None, weighted: bool = True) -> Column:
    """How a metric is aggregated over steps, by its name; the first rule that fits counts."""
    out = F.when(F.lit(False), "")
    for key, rule in (explicit or {}).items():
        out = out.when(name == key, rule)
    out = out.when(name.rlike(r"(^|/)lr(/|$)"), "last").when(name.contains("timing"), "sum").when(name.contains("max"), "max").when(name.contains("min"), "min")
    return out.when(name.contains("sum") | name.contains("total"), "sum").otherwise("weighted" if weighted else "avg")


def aggregate_steps(metrics: DataFrame, explicit: dict[str, str] | None = None) -> DataFrame:
    """(name, rule, value) over (step, name, value, sample_count)."""
    v, w = F.col("value"), F.col("sample_count")
    agg = metrics.withColumn("rule", step_rule(F.col("name"), explicit)).groupBy("name", "rule").agg(
        F.sum(v).alias("sum"), F.max(v).alias("max"), F.min(v).alias("min"), F.avg(v).alias("avg"), F.max_by(v, F.col("step")).alias("last"), F.try_divide(F.sum(v * w), F.sum(w)).alias("weighted")
    )
    value = F.col("avg")
    for rule in ("sum", "max", "min", "last", "weighted"):
        value = F.when(F.col("rule") == rule, F.col(rule)).otherwise(value)
    return agg.select("name", "rule", value.alias("value"))


def staleness(rows: DataFrame, lo: str, hi: str, step: str) -> DataFrame:
    """One row: spans of versions, and how far behind the step the newest and oldest were."""
    span, lag, worst = F.col(hi) - F.col(lo) + 1, F.col(step) - 1 - F.col(hi), F.col(step) - 1 - F.col(lo)
    return rows.agg(F.avg(span).alias("span_mean"), F.max(span).alias("span_max"), F.avg(lag).alias("staleness_mean"), F.max(lag).alias("staleness_max"), F.max(worst).alias("staleness_worst"))


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """(by, n, percentiles): exact percentiles of each group, between two values as far as the share says.

    Equal values are counted first, and what is left is dealt in ranges of (by, value) whose counts
    give every value its ranks; a group of any size meets in no task.  Nulls don't count."""
    from .batch import with_ranges

    counted = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    dealt = with_ranges(counted, [*by, value])
    sums = dealt.groupBy("_range").agg(F.sum("_c").alias("_sum"))  # a row per range
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    inside = Window.partitionBy("_range").orderBy(*by, value).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.join(F.broadcast(before), "_range").withColumn("_at", F.col("_before") + F.coalesce(F.sum("_c").over(inside), F.lit(0)))
    key = F.struct(*by, F.lit(0).alias("_")).alias("_by")
    placed = placed.select(key, F.col(value).cast("double").alias("_v"), "_at", "_c")
    groups = placed.groupBy(F.col("_by").alias("_g")).agg(F.min("_at").alias("_first"), F.sum("_c").alias("n"))
    rank = [(F.col("n") - 1) * float(p) for p in shares]
    held = placed.join(groups, F.col("_by").eqNullSafe(F.col("_g"))).select("_by", "_v", "_c", "n", (F.col("_at") - F.col("_first")).alias("_at"))
    has = lambda r: (F.col("_at") <= r) & (r < F.col("_at") + F.col("_c"))
    ends = [F.max(F.when(has(f(r)), F.col("_v"))) for r in rank for f in (F.floor, F.ceil)]
    some = held.groupBy("_by", "n").agg(F.array(*ends).alias("_e"))
    told = F.array(*(F.col("_e")[2 * i] + (F.col("_e")[2 * i + 1] - F.col("_e")[2 * i]) * (r - F.floor(r)) for i, r in enumerate(rank)))
    return some.select(*(F.col(f"_by.{c}").alias(c) for c in by), "n", told.alias("percentiles"))


def latency(rows: DataFrame, value: str) -> DataFrame:
    p = percentiles(rows, [], value, [0.5, 0.95, 0.99])
    plain = rows.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"))
    both = plain.join(p, F.lit(True), "left")  # one row each
    return both.select("mean", "max", "min", *(F.col("percentiles")[k].alias(n) for k, n in enumerate(("p50", "p95", "p99"))))


def sample_batch(rows: DataFrame, seconds: str, calls: str, start: str, end: str) -> DataFrame:
    """One row about the samples of a batch: their processing times, what tools took of them, how many were
    generated under more than one version of the model (``start`` to ``end``), over how many at most, and
    how many versions ended any.  A null time of tools is a sample that called none."""
    span = F.abs(F.col(end) - F.col(start))
    plain = rows.agg(
        F.max(calls).alias("tool_max"), F.min(calls).alias("tool_min"), F.avg(calls).alias("tool_mean"), F.count_if(span > 0).alias("partial"), F.avg((span > 0).cast("double")).alias("partial_ratio"),
        F.max(span).alias("partial_span"), F.count_distinct(end).alias("versions"),
    )
    return latency(rows, seconds).join(plain, F.lit(True))  # one row each


def summarise(rows: DataFrame, by: list[str], measures: dict[str, Column], cube: bool = False, exact: dict[str, tuple[str, float]] | None = None) -> DataFrame:
    """Measures over everything and by one column, or by the cube of several; ``level`` names
    the columns that a row is about.  ``exact`` names percentiles: a column and a share."""
    level = F.concat_ws("+", *(F.when(F.grouping(c) == 0, F.lit(c)) for c in by))
    grouped = rows.cube(*by) if cube else rows.rollup(*by)
    out = grouped.agg(*(m.alias(n) for n, m in measures.items()), level.alias("level"))
    levels = [[c for i, c in enumerate(by) if k >> i & 1] for k in range(1 << len(by))] if cube else [by[:k] for k in range(len(by) + 1)]
    for name, (value, share) in (exact or {}).items():
        each = [percentiles(rows, some, value, [share]).select(F.lit("+".join(some)).alias("_level"), *((F.col(c) if c in some else F.lit(None)).alias(f"_{c}") for c in by), F.col("percentiles")[0].alias(name)) for some in levels]
        told = each[0]
        for more in each[1:]:
            told = told.unionByName(more)
        same = F.col("level") == F.col("_level")
        for c in by:
            same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
        out = out.join(told, same, "left").drop("_level", *(f"_{c}" for c in by))
    return out


def pattern_by(rows: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Each key's values in order as one string, and whether they are uniform."""
    out = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value].cast("string")), "/").alias("pattern"), F.count_distinct(value).alias("_n"))
    return out.select(key, "pattern", F.when(F.col("_n") == 1, "uniform").otherwise("mixed").alias("kind"))


def gate(summary: DataFrame, limits: dict[str, tuple[float | None, float | None]]) -> None:
    """Raise where a measure of a one-row summary lies outside its limits."""
    row = summary.first()
    bad = {k: row[k] for k, (lo, hi) in limits.items() if row[k] is None or (lo is not None and row[k] < lo) or (hi is not None and row[k] > hi)}
    if bad:
        raise ValueError(f"outside limits: {bad}")


def response_info(rows: DataFrame, mask: str, attention: str) -> DataFrame:
    """Adds prompt and response lengths, from the masks of a response and of the whole."""
    ones = lambda c: F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.withColumn("response_length", ones(mask)).withColumn("prompt_length", ones(attention) - F.col("response_length"))


def layout_measures(mode: Column, ok: Column, strict: Column, area: Column, padding: Column) -> dict[str, Column]:
    """Measures of layouts: how many of each mode (invalid where there is none), shares of crops
    that succeeded and were strict, mean area of crops and mean padding."""
    crop = mode == "crop"
    return {
        "n_crop": F.count_if(crop), "n_pad": F.count_if(mode == "pad"), "n_invalid": F.count_if(mode.isNull()), "crop_rate": F.try_divide(F.count_if(crop & ok), F.count_if(crop)),
        "strict_rate": F.try_divide(F.count_if(crop & strict), F.count_if(crop)), "crop_area": F.avg(F.when(crop, area)), "padding": F.avg(F.when(mode == "pad", padding)),
    }


def attempt_measures(attempts: Column, valid: Column, tokens: Column, seconds: Column, area: Column) -> dict[str, Column]:
    """Measures of actions with retries: valid at first and at last, attempts, tokens and seconds
    spent, mean area of valid boxes."""
    return {
        "first_rate": F.avg((valid & (attempts == 1)).cast("double")), "valid_rate": F.avg(valid.cast("double")), "attempts": F.sum(attempts), "tokens": F.sum(tokens), "seconds": F.sum(seconds),
        "area": F.avg(F.when(valid, area)),
    }


def label_line(text: Column) -> Column:
    """What a line 'Label: ...' says."""
    return F.regexp_extract(text, r"(?m)^Label:\s*(.*)$", 1)


def differing_tokens(tokens: DataFrame, a: str, b: str) -> DataFrame:
    """(traj, n): tokens inside the mask at which two columns differ."""
    return tokens.groupBy("traj").agg(F.count_if((F.col("mask") > 0) & ~F.col(a).eqNullSafe(F.col(b))).alias("n"))


def reward_stats(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(key, mean, std, max, min) of each reward key; the deviation is the population's."""
    each = F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias("v")) for k in keys))
    return scores.select(F.inline(each)).groupBy("key").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max("v").alias("max"), F.min("v").alias("min"))


def outcome_rates(outcomes: DataFrame, by: str, outcome: str = "outcome") -> DataFrame:
    """Win, tie and loss rates of scored pairs, overall (null) and by a column."""
    scored = F.count_if(F.col(outcome) != "unscored")
    rate = lambda k: F.try_divide(F.count_if(F.col(outcome) == k), scored)
    return outcomes.rollup(by).agg(scored.alias("scored"), *(rate(k).alias(f"{k}_rate") for k in ("win", "tie", "loss")))


def stability(pairs: DataFrame) -> DataFrame:
    """One row over pairs judged in both orders: stable and unstable ones, and how often the
    first position won."""
    return pairs.agg(F.count_if("stable").alias("stable"), F.count_if(~F.col("stable")).alias("unstable"))


def zero_filled(counts: DataFrame, name: str, names: list[str], n: str = "n") -> DataFrame:
    """Counts of all names, those that don't occur with 0."""
    full = counts.sparkSession.createDataFrame([(x,) for x in names], f"{name} string")
    return full.join(counts, name, "left").withColumn(n, F.coalesce(n, F.lit(0)))


def top_overlap(student: Column, teacher: Column, k: int) -> Column:
    """The share of the teacher's k most likely ids among the student's."""

    def top(x: Column) -> Column:
        ranked = F.array_sort(F.transform(x, lambda v, i: F.struct((-v).alias("v"), i.alias("i"))))
        return F.transform(F.slice(ranked, 1, k), lambda r: r["i"])

    return F.size(F.array_intersect(top(student), top(teacher))) / F.lit(float(k))


def top_mass(logits: Column, k: int) -> Column:
    """The probability of the k most likely ids."""
    from .arrays import let, lse

    def of(p: Column) -> Column:
        return F.aggregate(p["x"], F.lit(0.0), lambda a, v: a + F.exp(v - p["total"]))

    return let(F.struct(F.slice(F.sort_array(logits, asc=False), 1, k).alias("x"), lse(logits).alias("total")), of)


def variance_proxies(tokens: DataFrame, gradient_norm: float | None = None) -> DataFrame:
    """One row: signal, power and noise of the gradient, from each trajectory's mean advantage
    and its summed score norm 1 - 2 pi + sum(pi^2)."""
    from .masked import inside, masked_mean

    m = F.col("mask")
    w = 1 - 2 * F.exp("old_lp") + F.col("sum_pi_squared")
    seq = tokens.groupBy("traj").agg(masked_mean(F.col("advantage"), m).alias("a"), F.sum(inside(w, m)).alias("w"))
    a2 = F.col("a") * F.col("a")
    power = F.avg(a2 * F.greatest("w", F.lit(0.0)))
    signal = F.lit(0.0 if gradient_norm is None else gradient_norm**2)
    noise = F.lit(0.0) if gradient_norm is None else F.when(F.count(F.lit(1)) > 1, F.greatest((power - signal) / (F.count(F.lit(1)) - 1), F.lit(0.0))).otherwise(0.0)
    return seq.agg(signal.alias("signal"), power.alias("power"), noise.alias("noise"), F.avg(a2).alias("expected_a_squared"), F.avg("w").alias("expected_w"))


def async_rule(name: Column, explicit: dict[str, str] | None = None) -> Column:
    """The rule of the asynchronous aggregator: told rules first, then by the name's parts."""
    out = F.when(F.lit(False), "")
    for key, rule in (explicit or {}).items():
        out = out.when(name == key, rule)
    has = lambda *words: F.lower(name).rlike("|".join(words))
    out = out.when(has("timing_s/"), "sum").when(has("mean", "avg", "average"), "avg").when(has("max"), "max").when(has("min"), "min")
    return out.when(has("sum", "total"), "sum").otherwise("avg")


# Metrics of the asynchronous trainer with a rule of their own.
ASYNC_RULES = {
    "perf/time_per_step": "sum", "timing_s/agent_loop/tool_calls/min": "min", "timing_s/agent_loop/tool_calls/mean": "avg", "timing_s/agent_loop/tool_calls/max": "max",
    "fully_async/count/total_generated_samples": "last", "fully_async/count/stale_samples_processed": "last", "fully_async/count/stale_trajectory_processed": "last",
    "fully_async/count/current_param_version": "last", "fully_async/count/dropped_stale_samples": "last", "training/global_step": "last", "dynamic_resource/mq_size": "last",
    "dynamic_resource/train_compute_time_s": "sum", "dynamic_resource/train_allocated_time_s": "sum",
}


def asynchronous(rows: DataFrame, devices: int, hybrid: int = 0, standalone: int = 0, rollout_use: float | None = None) -> DataFrame:
    """(name, value): the metrics (step, name, value) of several steps as one, each by its rule, and
    what isn't the same rule of its parts: throughput from the sums of tokens and seconds, the spread of
    lengths from its ends, the share of a step spent waiting, and how well devices were used, those
    that switch between both tasks (``hybrid``) by the share of time that they spent on either.

    ``step`` orders a metric's values; rows without a value don't count."""
    value = F.col("value")
    rule = async_rule(F.col("name"), ASYNC_RULES)
    each = rows.where(value.isNotNull()).groupBy("name").agg(*(f("value").alias(n) for n, f in (("sum", F.sum), ("avg", F.avg), ("max", F.max), ("min", F.min))), F.max_by("value", "step").alias("last"))
    each = each.select("name", F.coalesce(*(F.when(rule == k, F.col(k)) for k in ("sum", "avg", "max", "min", "last"))).cast("double").alias("value"))
    keys = {
        "spread": "global_seqlen/minmax_diff", "most": "global_seqlen/max", "least": "global_seqlen/min", "speed": "perf/throughput", "tokens": "perf/total_num_tokens", "seconds": "perf/time_per_step", "gen": "timing_s/gen",
        "step": "timing_s/step", "wait": "timing_s/wait_for_enough_samples", "busy": "dynamic_resource/train_compute_time_s", "given": "dynamic_resource/train_allocated_time_s",
    }
    one = each.agg(*(F.max(F.when(F.col("name") == key, value)).alias(k) for k, key in keys.items()))  # a number for each
    c = {k: F.col(k) for k in keys}
    use = F.when(c["given"] > 0, c["busy"] / c["given"])
    out = {
        keys["spread"]: F.when(c["spread"].isNotNull(), c["most"] - c["least"]), keys["speed"]: F.when(c["speed"].isNotNull(), c["tokens"] / (c["seconds"] * devices)),
        "fully_async/trainer/idle_ratio": c["gen"] / c["step"], "dynamic_resource/train_resource_utilization": use,
    }
    if rollout_use is not None and hybrid + standalone > 0:
        known = use.isNotNull() & (c["step"] > 0)
        x = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(c["wait"], F.lit(0.0)) / c["step"]))
        out["dynamic_resource/rollout_resource_utilization"] = F.when(known, F.lit(float(rollout_use)))
        out["dynamic_resource/resource_utilization"] = F.when(known, ((1 - x) * hybrid * use + (x * hybrid + standalone) * rollout_use) / (hybrid + standalone))
    made = one.select(F.explode(F.array(*(F.struct(F.lit(n).alias("name"), v.alias("value")) for n, v in out.items()))).alias("m")).select("m.name", "m.value").where(value.isNotNull())
    return each.join(F.broadcast(made.select("name")), "name", "left_anti").unionByName(made)
