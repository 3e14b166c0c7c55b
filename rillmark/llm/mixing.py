"""Mixing sources to target weights (operator 9) by cube-method balanced sampling.

A source's target over its size says how often its documents are to be taken: the whole
part for all of them, the rest as an inclusion probability.  The cube method settles the
rest: a flight phase walks the probabilities of three open documents along the vector
that changes neither the document total nor the word total until one becomes 0 or 1.
Documents are dealt to chunks of bounded size, each chunk leaves at most two open, the
open ones of several chunks fly again, and the last two of a source land by rounding to
the nearest total.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .common import bounded_batches, durable, whole_row

#: Documents that fly together, on average.
CHUNK_ROWS = 4096
#: Up to so many sources their targets are sent to all tasks.
BROADCAST_SOURCES = 10_000
_EDGE = 1e-9


def targets(sources: DataFrame, weights: tuple[int, ...], most: float) -> DataFrame:
    """``target`` words to take of each source (source, size, ...): weights repeat over the
    sources by code point (null last) and share the total; no target exceeds ``most`` times
    its source, and what is above is shared again by weight.

    A share x of each unit of weight is wanted of which ``least(most * size, x * weight)`` add
    up to the total.  With sources in order of most * size / weight, those before some place
    are full, and x is what the first that isn't and the rest agree on: the largest that fits.  One row a source
    is sorted; rows of documents aren't touched."""
    place = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")).cast("double")
    full = sources.withColumn("_weight", weight).withColumn("_full", most * F.col("size"))
    tighter = Window.orderBy(F.col("_full") / F.col("_weight"), F.col("source").isNull(), "source")
    before = tighter.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = F.sum("size").over(every) - F.coalesce(F.sum("_full").over(before), F.lit(0.0))
    share = left / (F.sum("_weight").over(every) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    tried = full.withColumn("_share", share)
    agreed = tried.where(F.col("_share") <= F.col("_full") / F.col("_weight")).agg(F.max("_share").alias("_unit"))
    # without words in any source nothing is agreed on, and nothing is wanted
    return full.crossJoin(F.broadcast(agreed)).withColumn("target", F.least("_full", F.coalesce("_unit", F.lit(0.0)) * F.col("_weight"))).drop("_weight", "_full", "_unit")  # one row


def fly(p: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Settle all but at most two of the probabilities, keeping sum(p) and sum(p * size)."""
    p = p.astype(float)
    value, weight = p.tolist(), size.astype(float).tolist()
    draws = iter(rng.random(len(value) + 4).tolist())
    active: list[int] = []
    for k in [*np.flatnonzero((p > _EDGE) & (p < 1 - _EDGE)).tolist(), None]:
        if k is not None:
            active.append(k)
        # two alike in size can settle between themselves
        while len(active) == 3 or (k is None and len(active) == 2 and weight[active[0]] == weight[active[1]]):
            if len(active) == 2:
                move = [1.0, -1.0]
            else:
                a, b, c = (weight[i] for i in active)
                move = [c - b, a - c, b - a] if not a == b == c else [1.0, -1.0, 0.0]
            up = down = math.inf
            for i, m in zip(active, move, strict=True):
                if m:
                    to_one, to_zero = (1 - value[i]) / abs(m), value[i] / abs(m)
                    up, down = min(up, to_one if m > 0 else to_zero), min(down, to_zero if m > 0 else to_one)
            step = up if next(draws) * (up + down) < down else -down
            for i, m in zip(active, move, strict=True):
                value[i] += step * m
                if value[i] < _EDGE or value[i] > 1 - _EDGE:
                    value[i] = float(round(value[i]))
            active = [i for i in active if _EDGE < value[i] < 1 - _EDGE]
    return np.array(value)


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the last open probabilities so that the word total stays nearest."""
    out, open_ = p.copy(), np.flatnonzero((p > _EDGE) & (p < 1 - _EDGE))
    want = float((p[open_] * size[open_]).sum())
    best = min(range(1 << len(open_)), key=lambda m: (abs(sum(float(size[i]) for k, i in enumerate(open_) if m >> k & 1) - want), m))
    for k, i in enumerate(open_):
        out[i] = best >> k & 1
    return out


def with_word_counts(docs: DataFrame, text_col: str, size_col: str, columns: list[str]) -> DataFrame:
    """``columns`` and the number of words of each text; a null text has none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = kernel.buffers(batch.column(batch.num_columns - 1))
            n = np.zeros(len(offsets) - 1, np.int64)
            for i, j in kernel.slices(offsets, 2 * kernel.SLICE_BYTES):
                n[i:j] = kernel.word_spans(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[2]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(n)], names=[*columns, size_col])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"`{size_col}` long"])
    return bounded_batches(docs).select(*columns, F.col(text_col).alias("_text")).mapInArrow(kernel.lean(count), schema)


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: float = 3.0, seed: int = 7, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(doc_id, source, text_hash, size, source_size, target, copies, taken) of every row.

    ``copies`` is how often the mix takes the document (0 to ``most``) and ``taken`` its
    words.  Draws come from hashes of source and chunk, so that reruns agree.  Null texts
    have size 0, a null source is a source of its own, repeated rows are taken one by one,
    an empty table gives no rows."""
    counted = with_word_counts(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(text_col).alias("text_hash"), F.col(text_col).alias("text")), "text", "size", ["doc_id", "source", "text_hash"])
    # rows alike in everything are counted here and numbered, so that they part by number
    sized = durable(counted.groupBy("doc_id", "source", "text_hash", "size").agg(F.count(F.lit(1)).alias("_alike")))
    totals = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("_alike")).alias("size"), F.sum("_alike").alias("_n"))
    rate = F.coalesce(F.try_divide("target", F.col("size").cast("double")), F.lit(0.0))
    whole = F.floor(rate + _EDGE)
    plan = durable(targets(totals, weights, most)).select(
        F.col("source").alias("_source"), F.col("size").alias("source_size"), F.col("target").cast("double").alias("target"), whole.cast("int").alias("_whole"),
        F.greatest(rate - whole, F.lit(0.0)).alias("_p"), F.greatest(F.ceil(F.col("_n") / CHUNK_ROWS), F.lit(1)).cast("long").alias("_chunks"),
    )
    about = plan.agg(F.count(F.lit(1)).alias("n"), F.max("_chunks").alias("most")).first()
    planned = F.broadcast(plan) if about["n"] <= BROADCAST_SOURCES else plan
    state = sized.join(planned, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    state = state.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_alike")))).drop("_alike")
    state = state.withColumn("_chunk", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size", "text_hash", "_copy"), F.col("_chunks")))
    columns, schema = state.columns, state.schema
    chunks = about["most"] or 1

    def settle(last: bool):
        def run(table: pa.Table) -> pa.Table:
            table = table.sort_by([("doc_id", "ascending"), ("size", "ascending"), ("text_hash", "ascending"), ("_copy", "ascending")])
            p, size = table.column("_p").to_numpy(), table.column("size").to_numpy()
            stamp = [seed, int(table.column("_chunk")[0].as_py()), *(table.column("source")[0].as_py() or "\0").encode()]
            p = fly(p, size, np.random.default_rng(stamp))
            if last:
                p = land(p, size)
            return table.set_column(columns.index("_p"), "_p", pa.array(p))

        return run

    settled = None
    while True:
        flown = state.groupBy("source", "_chunk").applyInArrow(settle(chunks == 1), schema)
        if chunks == 1:
            settled = flown if settled is None else settled.unionByName(flown)
            break
        flown = durable(flown)
        is_open = (F.col("_p") > _EDGE) & (F.col("_p") < 1 - _EDGE)
        done = flown.where(~is_open)
        settled = done if settled is None else settled.unionByName(done)
        chunks = -(-chunks // (CHUNK_ROWS // 4))
        state = flown.where(is_open).withColumn("_chunks", F.ceil(F.col("_chunks") / (CHUNK_ROWS // 4))).withColumn("_chunk", F.pmod("_chunk", "_chunks")).select(*columns)
    copies = (F.col("_whole") + F.round("_p")).cast("int")
    return settled.select("doc_id", "source", "text_hash", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def take(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of the mix: each row of ``docs`` as often as the mix takes it."""
    mixed = mix(docs, id_col=id_col, text_col=text_col, **options)
    # rows alike in id and text share what they are taken
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit(""))  # noqa: E731  a null's own
    keys = ["_id", "_hash", "_source"]
    share = mixed.groupBy(name("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), name("source").alias("_source")).agg(F.sum("copies").alias("_copies")).where("_copies > 0")
    keyed = docs.select(whole_row(docs).alias("_row"), name(id_col).alias("_id"), F.xxhash64(text_col).alias("_hash"), name(options.get("source_col", "source")).alias("_source"))
    numbered = keyed.join(share, keys).withColumn("_k", F.row_number().over(Window.partitionBy(*keys).orderBy(*keys)))
    return numbered.where("_k = 1").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))).select("_row.*")
