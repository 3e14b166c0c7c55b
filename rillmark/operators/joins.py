"""Keyed overwrites, latest-wins, first-wins, lookups, paired runs and coverage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batch import among_first, hash_key


class KeyError_(ValueError):
    """A key check failed; the message has a few of the keys."""


def require_none(df: DataFrame, message: str, show: int = 5) -> None:
    bad = df.limit(show).collect()
    if bad:
        raise KeyError_(f"{message}: {[tuple(r) for r in bad]}")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def upsert(base: DataFrame, fresh: DataFrame, keys: list[str], fields: list[str], check: bool = True) -> DataFrame:
    """Overwrite ``fields`` of base rows that ``fresh`` has; ``replaced`` says which.  With
    ``check``, keys must be unique on both sides and every fresh key known."""
    if check:
        require_none(duplicate_keys(base, keys), "base keys repeat")
        require_none(duplicate_keys(fresh, keys), "override keys repeat")
        require_none(fresh.join(base, keys, "left_anti").select(*keys), "unknown override keys")
    told = fresh.select(*keys, F.struct(*fields).alias("_new"))
    out = base.join(told, keys, "left").withColumn("replaced", F.col("_new").isNotNull())
    for c in fields:
        out = out.withColumn(c, F.when(F.col("replaced"), F.col(f"_new.{c}")).otherwise(F.col(c)))
    return out.select(*base.columns, "replaced")


def latest(df: DataFrame, keys: list[str], saved: str, order: str, valid: Column | None = None) -> DataFrame:
    """Adds ``state``: 'rejected' if invalid, 'kept' for the newest valid row of a key (the
    first of equals), else 'superseded'."""
    valid = F.lit(True) if valid is None else valid
    place = F.row_number().over(Window.partitionBy(*keys, "_valid").orderBy(F.desc(saved), order))
    out = df.withColumn("_valid", F.coalesce(valid, F.lit(False))).withColumn("_k", place)
    return out.withColumn("state", F.when(~F.col("_valid"), "rejected").when(F.col("_k") == 1, "kept").otherwise("superseded")).drop("_valid", "_k")


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key and ``duplicates``, how many more there were."""
    w = Window.partitionBy(*keys)
    out = df.withColumns({"_k": F.row_number().over(w.orderBy(*order)), "duplicates": F.count(F.lit(1)).over(w) - 1})
    return out.where("_k = 1").drop("_k")


def without_conflicts(df: DataFrame, key: str, payload: str) -> DataFrame:
    """Rows of keys that have one payload; rows of the others are all dropped."""
    good = df.groupBy(key).agg(F.count_distinct(F.sha2(F.col(payload), 256)).alias("_n")).where("_n = 1").select(key)
    return df.join(good, key, "left_semi")


def lookup(df: DataFrame, table: DataFrame, key: str, check: bool = True) -> DataFrame:
    """Inner lookup; a missing key or one with two values is an error."""
    if check:
        require_none(duplicate_keys(table.distinct(), [key]), "lookup keys conflict")
        require_none(df.join(table, key, "left_anti").select(key), "lookup keys missing")
    return df.join(table.distinct(), key)


def expand(df: DataFrame, name: str, values: list) -> DataFrame:
    """Each row with each value."""
    return df.withColumn(name, F.explode(F.array(*map(F.lit, values))))


def coverage(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side): keys that only one side has."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").withColumn("side", F.lit("left")).unionByName(y.join(x, keys, "left_anti").withColumn("side", F.lit("right")))


def leakage(df: DataFrame, content: str, split: str) -> DataFrame:
    """Contents that stand in more than one split."""
    return df.groupBy(content).agg(F.count_distinct(split).alias("splits"), F.count(F.lit(1)).alias("rows")).where("splits > 1")


def paired_runs(runs: DataFrame, task: str, run: str, label: str, reference: str) -> DataFrame:
    """(task, run, outcome) of each other run against the reference: the lower label wins,
    unscored if either has none."""
    base = runs.where(F.col(run) == reference).select(task, F.col(label).alias("_ref"))
    x, r = F.col(label), F.col("_ref")
    outcome = F.when(x.isNull() | r.isNull(), "unscored").when(x < r, "win").when(x > r, "loss").otherwise("tie")
    return runs.where(F.col(run) != reference).join(base, task).select(task, run, outcome.alias("outcome"))


def both_orders(judged: DataFrame, task: str, order: str, outcome: str) -> DataFrame:
    """(task, first, second, stable): a pair judged in both presentation orders."""
    two = judged.groupBy(task).agg(F.max(F.when(F.col(order) == 0, F.col(outcome))).alias("first"), F.max(F.when(F.col(order) == 1, F.col(outcome))).alias("second"))
    return two.withColumn("stable", F.coalesce(F.col("first") == F.col("second"), F.lit(False)))


def merge_shards(shards: list[DataFrame], key: list[str], expected: int | None = None) -> DataFrame:
    out = shards[0]
    for s in shards[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    require_none(duplicate_keys(out, key), "keys repeat across shards")
    if expected is not None and (n := out.count()) != expected:
        raise KeyError_(f"{n} rows where {expected} are expected")
    return out


def merge_faults(base: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """(fault, n): how many keys stand against overwriting rows of ``base`` by ``fresh``."""
    faults = {"repeated in base": duplicate_keys(base, keys), "repeated in overrides": duplicate_keys(fresh, keys), "unknown": fresh.join(base, keys, "left_anti").select(*keys).distinct()}
    out = None
    for name, rows in faults.items():
        one = rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fault"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def manifest_results(manifest: DataFrame, results: DataFrame, key: str, value: str) -> DataFrame:
    """Every entry of a manifest with its newest result (by ``order``), or missing."""
    newest = results.groupBy(key).agg(F.max_by(value, "order").alias(value))
    return manifest.join(newest, key, "left").withColumn("state", F.when(F.col(value).isNull(), "missing").otherwise("done"))


def inconsistent(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Keys whose rows disagree in any of the fields, and on how many values."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*fields)).alias("values")).where("values > 1")


def task_status(tasks: DataFrame, generated: DataFrame, judged: DataFrame, key: str) -> DataFrame:
    """Every task with what was generated and judged of it."""
    g, j = generated.select(key, F.lit(1).alias("_g")).distinct(), judged.select(key, F.lit(1).alias("_j")).distinct()
    status = F.when(F.col("_j").isNotNull(), "judged").when(F.col("_g").isNotNull(), "generated").otherwise("pending")
    return tasks.join(g, key, "left").join(j, key, "left").withColumn("status", status).drop("_g", "_j")


def seeded_holdout(groups: DataFrame, key: str, seed: str, share: float) -> DataFrame:
    """Adds ``split``: floor(n * share) groups, one at least, in a seeded order validate."""
    n = groups.count()
    held = among_first(groups, [hash_key(seed, F.col(key))], max(1, int(n * share)))
    return groups.withColumn("split", F.when(held, "validation").otherwise("train"))
