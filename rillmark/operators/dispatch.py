"""Rows for ranks and back: who computes on what, and what is taken of it."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batch import BatchError, concat, pad_to_multiple
from .registry import DISPATCH


@dataclass(frozen=True)
class Mode:
    scatter: Callable[[DataFrame, int], DataFrame]
    gather: Callable[[DataFrame, list[int]], DataFrame]


def mode(name: str, scatter: Callable[[DataFrame, int], DataFrame], gather: Callable[[DataFrame, list[int]], DataFrame]) -> Mode:
    """Register a pair of scatter(rows, ranks) and gather(rows, collecting ranks)."""
    return DISPATCH.register(name)(Mode(scatter, gather))


def _of_ranks(rows: DataFrame, ranks: list[int]) -> DataFrame:
    return rows.where(F.col("rank").isin(*ranks))


def to_all(rows: DataFrame, ranks: int) -> DataFrame:
    """Every rank gets every row."""
    return rows.withColumn("rank", F.explode(F.sequence(F.lit(0), F.lit(ranks - 1))))


def chunks(rows: DataFrame, ranks: int, idx: str = "row_idx") -> DataFrame:
    """Contiguous equal chunks; rows repeat from the start until they divide, as ``is_pad``."""
    n = rows.count()
    padded = pad_to_multiple(rows, ranks, n, idx)
    size = -(-n // ranks) if n else 1
    return padded.withColumn("rank", F.floor(F.col(idx) / F.lit(size)).cast("int"))


def join(rows: DataFrame, ranks: list[int]) -> DataFrame:
    """What the collecting ranks give, without the repeats."""
    return _of_ranks(rows, ranks).where("NOT is_pad").drop("is_pad")


mode("one_to_all", to_all, _of_ranks)
mode("all_to_all", lambda rows, ranks: rows, _of_ranks)
mode("chunks", chunks, join)


def compute(rows: DataFrame, name: str, ranks: int, work: Callable[[DataFrame], DataFrame], collect: list[int] | None = None) -> DataFrame:
    """Scatter, work on each rank's rows, gather from the collecting ranks (all unless told)."""
    m = DISPATCH.get(name)
    return m.gather(work(m.scatter(rows, ranks)), list(range(ranks)) if collect is None else collect)


def on_ranks(rows: DataFrame, ranks: int, work: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType, idx: str = "row_idx") -> DataFrame:
    """What ``work(rank, batches)`` makes of each rank's rows, in their order: a rank is a partition, so
    one task holds its rows and no others, and the partitions of the result are the ranks'.

    ``rows`` have a ``rank``, as ``scatter`` gives it; a rank outside 0..ranks-1 is an error."""
    known = F.when(F.col("rank").between(0, ranks - 1), F.col("rank")).otherwise(F.raise_error(F.lit("a rank that isn't there")).cast("int"))
    dealt = rows.withColumn("rank", known.cast("int")).repartitionById(ranks, F.col("rank")).sortWithinPartitions("rank", idx)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(TaskContext.get().partitionId(), batches)

    return dealt.mapInArrow(run, schema)


def all_gather(parts: list[DataFrame], idx: str = "row_idx") -> DataFrame:
    """All ranks' rows, one rank after the other, renumbered."""
    if not parts:
        raise BatchError("no ranks")
    return concat(parts, idx)


def ceildiv(a: Column, b: Column) -> Column:
    return -F.floor(-a / b)


def roundup(a: Column, b: Column) -> Column:
    return ceildiv(a, b) * b
