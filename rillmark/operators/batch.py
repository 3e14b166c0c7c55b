"""Batch algebra on DataFrames with an explicit row index (``row_idx``).

Rows of a batch are positional in the data model, so every operator that depends on
position takes and keeps the index column.  Checks that the model makes eagerly are
functions named ``require_*``, which run an aggregate and raise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

IDX = "row_idx"


class BatchError(ValueError):
    pass


def _field(rows: str, name: str) -> Column:
    """One field of an array of structs, as an array."""
    return F.transform(rows, lambda x: x[name])


#: Ranges at most, and keys looked at for each of their bounds.
MOST_RANGES, PER_RANGE = 1024, 32


def with_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """``_range`` numbers ranges of the order of ``order``, of about equally many rows: one a shuffle
    partition.

    Bounds are whole keys, so texts that begin alike and constant first columns part as well; only rows
    alike in all of ``order`` stay together.  They are taken from the keys with the smallest
    hashes, so every evaluation finds the same ones."""
    width = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), MOST_RANGES)
    key = F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order)))
    cuts: list[Column] = []
    if width > 1:
        names = [f"_{i}" for i in range(len(order))]
        sample = df.select(key.alias("k")).select("k.*").orderBy(F.xxhash64(*names), *names).limit(PER_RANGE * width)
        seen = sample.distinct().orderBy(*names).collect()  # at most PER_RANGE * width keys
        kinds = dict(sample.dtypes)
        bounds = [seen[len(seen) * k // width] for k in range(1, width)] if len(seen) >= width else seen[1:]
        cuts = [F.struct(*(F.lit(r[n]).cast(kinds[n]).alias(n) for n in names)) for r in bounds]

    def place(low: int, high: int) -> Column:
        """How many of cuts[low:high] are at most the key, by halving."""
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key < cuts[middle], place(low, middle)).otherwise(place(middle + 1, high))

    return df.withColumn("_range", place(0, len(cuts)))


#: Rows whose keys the driver may hold while it looks for a place in their order.
FEW = 100_000


def hash_key(seed: str, *columns: Column) -> Column:
    """The first 60 bits of an md5, which order as its hexadecimal text does."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), *(c.cast("string") for c in columns))), 1, 15), 16, 10).cast("bigint")


def among_first(df: DataFrame, keys: list[Column], n: int) -> Column:
    """A condition that holds for the first ``n`` rows of ``df`` in the order of numeric ``keys``
    (a total order).

    The n-th row's keys are looked for instead of sorting: percentiles of a key and counts
    between them narrow the rows in question until the driver can hold their keys, and
    the condition compares with what it finds.  Keys are kept meanwhile, no rows are
    gathered or moved."""
    if n <= 0:
        return F.lit(False)
    names = [f"_k{i}" for i in range(len(keys))]
    held = rows = df.select(*(k.alias(name) for k, name in zip(keys, names, strict=True))).persist()
    try:
        last = _nth(rows, names, n)
    finally:
        held.unpersist()
    if last is None:
        return F.lit(True)
    out = F.lit(True)
    for key, value in reversed(list(zip(keys, last, strict=True))):
        out = (key < F.lit(value)) | ((key == F.lit(value)) & out)
    return out


def _nth(rows: DataFrame, names: list[str], n: int) -> tuple | None:
    """The n-th row in the order of its columns; none if there are no more than n."""
    at, size = 0, rows.count()
    if n >= size:
        return None
    while size > FEW and at < len(names):
        key = F.col(names[at])
        cuts = sorted(set(rows.agg(F.percentile_approx(key, [k / 64 for k in range(65)], 10_000)).first()[0]))
        if len(cuts) == 1:
            at += 1
            continue
        # even places lie between cuts, odd ones on them
        place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < key)) * 2 + F.array_contains(F.array(*map(F.lit, cuts)), key).cast("int")
        counts = sorted((r[0], r[1]) for r in rows.groupBy(place.alias("p")).count().collect())  # a row for each place
        for p, size in counts:
            if n <= size:
                break
            n -= size
        k = p // 2
        rows = rows.where(key == F.lit(cuts[k])) if p % 2 else rows.where((key > F.lit(cuts[k - 1])) & (key < F.lit(cuts[k])) if 0 < k < len(cuts) else key < F.lit(cuts[0]) if not k else key > F.lit(cuts[-1]))
    return sorted(tuple(r) for r in rows.collect())[n - 1]


def with_row_index(df: DataFrame, order: list[str], name: str = IDX) -> DataFrame:
    """Number rows from 0 in the order of ``order`` (which must be total).

    Deals ranges of the order columns, numbers inside each range, and moves each range on by the
    counts before it, so no task holds all rows."""
    dealt = with_ranges(df, order)
    counts = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = dealt.withColumn(name, F.row_number().over(Window.partitionBy("_range").orderBy(*order)) - 1)
    return inside.join(F.broadcast(before), "_range").withColumn(name, (F.col(name) + F.col("_before")).cast("bigint")).drop("_range", "_before")


def from_columns(spark, columns: dict[str, list], schema: str | None = None) -> DataFrame:
    """A batch from columns of equal length; its rows are numbered as they stand."""
    if len({len(v) for v in columns.values()}) > 1:
        raise BatchError(f"columns differ in length: { {k: len(v) for k, v in columns.items()} }")
    rows = [(k, *r) for k, r in enumerate(zip(*columns.values(), strict=True))]
    return spark.createDataFrame(rows, f"{IDX} bigint, {schema}" if schema else [IDX, *columns])


def to_columns(df: DataFrame, most: int = 100_000) -> dict[str, list]:
    """The columns of a small batch, in row order; more rows than ``most`` are an error."""
    rows = df.orderBy(IDX).limit(most + 1).collect()
    if len(rows) > most:
        raise BatchError(f"more than {most} rows")
    return {c: [r[c] for r in rows] for c in df.columns if c != IDX}


def require_columns(df: DataFrame, names: list[str]) -> None:
    missing = [c for c in names if c not in df.columns]
    if missing:
        raise BatchError(f"no such columns: {missing}")


def select(df: DataFrame, names: list[str] | None = None) -> DataFrame:
    """Named columns; None keeps all."""
    if names is None:
        return df
    require_columns(df, names)
    return df.select(*names)


def pop(df: DataFrame, names: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the named columns, what is left); a missing name is an error."""
    require_columns(df, names)
    keys = [IDX] if IDX in df.columns and IDX not in names else []
    return df.select(*keys, *names), df.drop(*names)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise BatchError("as many new names as old ones are needed")
    require_columns(df, old)
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def union_conflicts(a: DataFrame, b: DataFrame, key: str = IDX) -> DataFrame:
    """(column, conflicts): rows of shared columns that differ; NaN equals NaN, null equals null."""
    shared = [c for c in a.columns if c in b.columns and c != key]
    joined = a.select(key, *(F.col(c).alias(f"a_{c}") for c in shared)).join(b.select(key, *(F.col(c).alias(f"b_{c}") for c in shared)), key, "full")
    sums = joined.agg(*(F.count(F.when(~F.col(f"a_{c}").eqNullSafe(F.col(f"b_{c}")), 1)).alias(c) for c in shared))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("conflicts")) for c in shared))))


def union(a: DataFrame, b: DataFrame, key: str = IDX, check: bool = True) -> DataFrame:
    """Columns of both batches, row by row; shared columns must hold equal values."""
    if check and any(c in b.columns for c in a.columns if c != key):
        bad = union_conflicts(a, b, key).where("conflicts > 0").collect()  # a row per column
        if bad:
            raise BatchError(f"columns differ: {[r['column'] for r in bad]}")
    return a.join(b.select(key, *(c for c in b.columns if c not in a.columns)), key)


def union_meta(a: dict, b: dict) -> dict:
    """Merge table-level values; a key with two values is an error."""
    for k in a.keys() & b.keys():
        if a[k] != b[k] and not (a[k] != a[k] and b[k] != b[k]):
            raise BatchError(f"meta {k!r}: {a[k]!r} and {b[k]!r}")
    return {**a, **b}


def prefixed(values: dict, prefix: str) -> dict:
    """Keys with a prefix, but for those that have it."""
    return {k if k.startswith(prefix) else prefix + k: v for k, v in values.items()}


def appended(target: dict[str, list], values: dict, prefix: str = "") -> dict[str, list]:
    """Append scalars (or extend by lists) to lists by key."""
    for k, v in values.items():
        name = k if k.startswith(prefix) else prefix + k
        target.setdefault(name, []).extend(v if isinstance(v, list) else [v])
    return target


def pivot_records(records: list[dict]) -> dict[str, list]:
    """Rows as columns; the first row sets the keys, an unknown later key is an error."""
    out: dict[str, list] = {k: [] for k in (records[0] if records else {})}
    for r in records:
        for k, v in r.items():
            if k not in out:
                raise KeyError(k)
            out[k].append(v)
    return out


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal schemas and equal rows, each as often."""
    return a.dtypes == b.dtypes and a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def row_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(side, rows, ...): rows that ``a`` or ``b`` has more often than the other, and how many more; columns
    meet by name and must be the same.  Nulls equal nulls, and rows are moved once."""
    if sorted(a.dtypes) != sorted(b.dtypes):
        raise BatchError(f"columns differ: {sorted(set(a.dtypes) ^ set(b.dtypes))}")
    both = a.withColumn("_n", F.lit(1)).unionByName(b.withColumn("_n", F.lit(-1)))
    left = both.groupBy(*a.columns).agg(F.sum("_n").alias("_n")).where("_n <> 0")
    return left.select(F.when(F.col("_n") > 0, "a").otherwise("b").alias("side"), F.abs("_n").alias("rows"), *a.columns)


def column_report(df: DataFrame) -> DataFrame:
    """(column, type, non_null, distinct) of each column."""
    sums = df.agg(*(F.count(c).alias(f"n_{c}") for c in df.columns), *(F.count_distinct(c).alias(f"d_{c}") for c in df.columns))
    return sums.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col(f"n_{c}").alias("non_null"), F.col(f"d_{c}").alias("distinct")) for c, t in df.dtypes))))


def slice_rows(df: DataFrame, start: int | None = None, stop: int | None = None, step: int = 1, idx: str = IDX) -> DataFrame:
    start = start or 0
    kept = df.where((F.col(idx) >= start) & ((F.col(idx) - start) % step == 0))
    return kept if stop is None else kept.where(F.col(idx) < stop)


def take_rows(df: DataFrame, positions: list[int] | DataFrame, idx: str = IDX) -> DataFrame:
    """Rows at positions, in their order and as often as they are named; the new position
    is ``new_idx``.  Positions may be a DataFrame (new_idx, row_idx)."""
    if isinstance(positions, list):
        positions = df.sparkSession.createDataFrame(list(enumerate(positions)), f"new_idx bigint, {idx} bigint")
    return positions.join(df, idx)


def reorder(df: DataFrame, permutation: DataFrame, idx: str = IDX) -> DataFrame:
    return take_rows(df, permutation, idx).drop(idx).withColumnRenamed("new_idx", idx)


def concat(parts: list[DataFrame], idx: str = IDX) -> DataFrame:
    """All rows of the parts, renumbered one part after the other."""
    out, base = None, 0
    for p in parts:
        moved = p.withColumn(idx, (F.col(idx) + F.lit(base)).cast("bigint"))
        out = moved if out is None else out.unionByName(moved)
        base += p.count()
    return out


def repeat(df: DataFrame, n: int, interleave: bool = True, rows: int | None = None, idx: str = IDX) -> DataFrame:
    """Each row n times: a a b b (interleaved) or a b a b; renumbered."""
    copies = df.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    if interleave:
        new = F.col(idx) * n + F.col("_copy")
    else:
        new = F.col("_copy") * F.lit(df.count() if rows is None else rows) + F.col(idx)
    return copies.withColumn(idx, new.cast("bigint")).drop("_copy")


def repeat_each(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says; ``copy`` numbers its copies."""
    return df.withColumn("_n", times.cast("int")).where("_n > 0").withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("_n") - 1))).drop("_n")


def chunk(df: DataFrame, k: int, rows: int, idx: str = IDX, rest: bool = False) -> DataFrame:
    """Contiguous equal chunks (``chunk`` from 0); rows must divide.  With ``rest`` they needn't:
    behind the k chunks of rows // k, what is left goes on in chunks of that size, the last shorter."""
    if rows % k and (not rest or rows < k):
        raise BatchError(f"{rows} rows don't divide into {k} chunks")
    return df.withColumn("chunk", F.floor(F.col(idx) / F.lit(rows // k)).cast("int"))


def split(df: DataFrame, size: int, idx: str = IDX) -> DataFrame:
    """Contiguous pieces of ``size`` rows, the last shorter (``piece`` from 0)."""
    return df.withColumn("piece", F.floor(F.col(idx) / F.lit(size)).cast("int"))


def split_even(df: DataFrame, k: int, rows: int, idx: str = IDX) -> DataFrame:
    """Equal contiguous splits; what doesn't divide is dropped at the end."""
    kept = rows - rows % k
    return chunk(df.where(F.col(idx) < kept), k, kept, idx) if kept else df.where("false").withColumn("chunk", F.lit(0))


def unfold_columns(df: DataFrame, columns: list[str], n: int, idx: str = IDX) -> DataFrame:
    """Cut array columns into n equal parts, each a row; other columns repeat."""
    width = {c: F.floor(F.size(c) / F.lit(n)).cast("int") for c in columns}
    rows = df.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for c in columns:
        rows = rows.withColumn(c, F.slice(F.col(c), F.col("part") * width[c] + 1, width[c]))
    return rows.withColumn(idx, (F.col(idx) * n + F.col("part")).cast("bigint"))


def fold(df: DataFrame, k: int, columns: list[str], idx: str = IDX) -> DataFrame:
    """k consecutive rows as one, its columns arrays in row order."""
    groups = df.withColumn("_group", F.floor(F.col(idx) / F.lit(k)))
    rows = groups.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct(idx, *columns))).alias("_rows"))
    return rows.select(F.col("_group").cast("bigint").alias(idx), *(_field("_rows", c).alias(c) for c in columns))


def unfold(df: DataFrame, k: int, columns: list[str], idx: str = IDX) -> DataFrame:
    rows = df.select(F.col(idx).alias("_group"), F.posexplode(F.arrays_zip(*columns)).alias("_k", "_row"))
    return rows.select((F.col("_group") * k + F.col("_k")).cast("bigint").alias(idx), *(F.col(f"_row.{c}").alias(c) for c in columns))


def pad_to_multiple(df: DataFrame, multiple: int, rows: int, idx: str = IDX) -> DataFrame:
    """Repeat rows from the start until the count divides; repeats have ``is_pad``."""
    pad = -rows % multiple
    base = df.withColumn("is_pad", F.lit(False))
    if not pad or not rows:
        return base
    rounds = -(-pad // rows)
    extra = df.withColumn("_round", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1)))).withColumn("_at", F.col("_round") * rows + F.col(idx)).where(F.col("_at") < pad)
    extra = extra.withColumn(idx, (F.col("_at") + rows).cast("bigint")).drop("_round", "_at").withColumn("is_pad", F.lit(True))
    return base.unionByName(extra)


def unpad(df: DataFrame, rows: int, pad: int, idx: str = IDX) -> DataFrame:
    return df.where(F.col(idx) < rows - pad)


def pad_rows(df: DataFrame, n: int, rows: int, last: bool = False, idx: str = IDX) -> DataFrame:
    """Append n copies of the first or last row."""
    at = rows - 1 if last else 0
    if n <= 0:
        return df
    extra = df.where(F.col(idx) == at).withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn(idx, (F.lit(rows) + F.col("_k")).cast("bigint")).drop("_k")
    return df.unionByName(extra)


def required_multiple(*sizes: int) -> int:
    import math

    return math.lcm(*sizes)


def multiple_with(size: Column, fixed: int) -> Column:
    """The least common multiple of a column of positive numbers and a fixed one."""
    common = F.array_max(F.filter(F.array(*(F.lit(d).cast("bigint") for d in range(1, fixed + 1) if fixed % d == 0)), lambda d: size % d == 0))
    return (size * F.lit(fixed) / common).cast("bigint")


def pad_minimal(df: DataFrame, multiple: int, rows: int, mask: str, idx: str = IDX) -> DataFrame:
    """Append rows of one masked token, marked ``is_padding``, up to the multiple."""
    base = df.withColumn("is_padding", F.lit(False))
    pad = -rows % multiple
    if not pad:
        return base
    blank = df.sparkSession.range(pad).select((F.col("id") + rows).alias(idx))
    for f in df.schema.fields:
        if f.name != idx:
            blank = blank.withColumn(f.name, F.array(F.lit(0)).cast(f.dataType) if f.name == mask else F.lit(None).cast(f.dataType))
    return base.unionByName(blank.withColumn("is_padding", F.lit(True)))


def seeded_order(df: DataFrame, seed: str, key: str = IDX) -> Column:
    """A fixed pseudo-random order by md5 of seed and key, the same on any engine."""
    return F.md5(F.concat_ws(":", F.lit(seed), F.col(key).cast("string")))


def mini_batches(df: DataFrame, size: int, epochs: int, seed: str, rows: int, idx: str = IDX, rest: bool = False) -> DataFrame:
    """(epoch, batch, ...): each epoch shuffled by its own seed and cut into equal batches; rows must
    divide, or with ``rest`` the last batch of an epoch is shorter."""
    if rows % size and not rest:
        raise BatchError(f"{rows} rows don't divide into batches of {size}")
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("epoch").cast("string"), F.col(idx).cast("string")))
    # ranges of the hash are about equal; each is numbered in itself and moved on by those before it
    dealt = each.withColumn("_key", key).withColumn("_range", F.floor(F.conv(F.substring("_key", 1, 8), 16, 10).cast("double") * (width / 2**32)))
    before = Window.partitionBy("epoch").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    moved = dealt.groupBy("epoch", "_range").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = dealt.withColumn("_place", F.row_number().over(Window.partitionBy("epoch", "_range").orderBy("_key", idx)) - 1)
    numbered = inside.join(moved, ["epoch", "_range"]).withColumn("batch", F.floor((F.col("_place") + F.col("_before")) / F.lit(size)).cast("int"))
    return numbered.drop("_key", "_range", "_place", "_before")


def subsample(df: DataFrame, most: int, seed: str | None = None, idx: str = IDX) -> DataFrame:
    """The first rows, or with a seed a sample without replacement; no rows are sorted or gathered."""
    order = [F.col(idx)] if seed is None else [hash_key(seed, F.col(idx)), F.col(idx)]
    return df.where(among_first(df, order, most))


def sampler(df: DataFrame, seed: str | None = None, start: int = 0, idx: str = IDX) -> DataFrame:
    """(place, ...): rows in the order in which they are drawn, in turn or shuffled by a seed,
    from a place on (to go on after a restart)."""
    if seed is None:
        return df.withColumn("place", F.col(idx)).where(F.col("place") >= start)
    placed = with_row_index(df.withColumn("_order", seeded_order(df, seed, idx)), ["_order", idx], "place").drop("_order")
    return placed.where(F.col("place") >= start)


def stride(df: DataFrame, rank: int, k: int, idx: str = IDX) -> DataFrame:
    return df.where(F.col(idx) % k == rank)


def collate(df: DataFrame, batch: str, columns: list[str], idx: str = IDX) -> DataFrame:
    """Rows of a batch as arrays in row order, ragged arrays staying ragged."""
    rows = df.groupBy(batch).agg(F.array_sort(F.collect_list(F.struct(idx, *columns))).alias("_rows"))
    return rows.select(batch, *(_field("_rows", c).alias(c) for c in columns))


def complete_groups(df: DataFrame, keys: list[str], member: str, members: int) -> DataFrame:
    """Rows of groups that have exactly ``members`` distinct members."""
    full = df.groupBy(*keys).agg(F.count_distinct(member).alias("_n")).where(F.col("_n") == members).select(*keys)
    return df.join(full, keys, "left_semi")


def oldest(df: DataFrame, step: str, key: str, n: int) -> DataFrame:
    return df.orderBy(step, key).limit(n)


def search(df: DataFrame, text: str | None = None, fields: list[str] | None = None, sort: str | None = None, descending: bool = True) -> DataFrame:
    """Rows with a substring in any of the fields, sorted by one column."""
    fields = fields or [c for c, t in df.dtypes if t == "string"]
    if text:
        hit = F.lit(False)
        for c in fields:
            hit = hit | F.coalesce(F.col(c).contains(text), F.lit(False))
        df = df.where(hit)
    return df.orderBy(F.desc(sort) if descending else F.asc(sort)) if sort else df
