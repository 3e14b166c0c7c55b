"""Balanced partitions of sequences by length.

One batch is a few thousand sequences, so a batch is balanced inside one task: many
batches are many groups."""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def workload(n: int) -> int:
    return 24576 * n + n * n


class _Partial:
    """Parts of some items as (sum, items, indices), largest first.  Of two, the one with the
    wider spread is merged first; of equal ones that whose largest part is larger."""

    def __init__(self, parts: list[list[int]], sizes: list[int]):
        self.parts = sorted(((sum(sizes[i] for i in p), len(p), p) for p in parts), reverse=True)
        self.rank = (self.parts[0][0] - self.parts[-1][0], self.parts[0])

    def __lt__(self, other: _Partial) -> bool:
        return self.rank > other.rank


def differencing(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """k partitions of indices by largest differencing: the two partial solutions with the
    widest spread are merged, the largest part of one with the smallest of the other.
    Parts come in falling order of their sums.
    ``equal`` starts from k-tuples, so that parts have equal counts."""
    if equal and len(sizes) % k:
        raise ValueError("equal parts need a multiple of k")
    order = sorted(range(len(sizes)), key=lambda i: (sizes[i], i))
    starts = [[[i] for i in order[s : s + k]] for s in range(0, len(order), k)] if equal else [[[i], *([] for _ in range(k - 1))] for i in order]
    heap: list[_Partial] = [_Partial(s, sizes) for s in starts]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        heapq.heappush(heap, _Partial([x[2] + y[2] for x, y in zip(a.parts, reversed(b.parts), strict=True)], sizes))
    return [sorted(p) for _, _, p in heap[0].parts] if heap else [[] for _ in range(k)]


def greedy(sizes: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Each next item to the part with the smallest sum, the first of equals."""
    bias = sum(sizes) + 1 if equal else 0
    sums, parts = [0] * k, [[] for _ in range(k)]
    for i, n in enumerate(sizes):
        p = min(range(k), key=sums.__getitem__)
        parts[p].append(i)
        sums[p] += n + bias
    return parts


def runs(uids: list) -> list[list[int]]:
    """Indices of consecutive equal ids."""
    out: list[list[int]] = []
    for i, u in enumerate(uids):
        if i and uids[i - 1] == u:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def by_groups(sizes: list[int], uids: list, k: int) -> list[list[int]]:
    """Balanced parts that keep runs of one id together, as many runs in each."""
    units = runs(uids)
    parts = differencing([sum(sizes[i] for i in u) for u in units], k, equal=True)
    return [[i for u in p for i in units[u]] for p in parts]


def micro_batches(sizes: list[int], most: int, least: int = 1, multiple: int = 1) -> list[list[int]]:
    """As few micro-batches as the token limit allows, the heavy ones in the middle."""
    k = max(min(len(sizes), -(-sum(sizes) // most)), least)
    k = min(-(-k // multiple) * multiple, len(sizes))
    parts = differencing([workload(n) for n in sizes], k)
    parts.sort(key=lambda p: (sum(workload(sizes[i]) for i in p), p[0] if p else 0), reverse=True)
    return parts[::2][::-1] + parts[1::2]


def ranks(sizes: list[int], k: int, mini_batch: int | None = None, uids: list | None = None) -> list[list[int]]:
    """Equal parts of a batch for k ranks by workload.  Inside a part light sequences stand at
    both ends.  With ``mini_batch`` each mini-batch is balanced on its own; with ``uids`` runs
    of one id stay together, as they stand."""
    if uids is not None:
        return by_groups(sizes, uids, k)
    load = [workload(n) for n in sizes]
    parts: list[list[int]] = [[] for _ in range(k)]
    step = mini_batch or len(sizes)
    for start in range(0, len(sizes) // step * step if step else 0, step):
        for p, found in zip(parts, differencing(load[start : start + step], k, equal=True), strict=True):
            p += [start + i for i in found]
    out = []
    for p in parts:
        p.sort(key=lambda i: (load[i], i))
        out.append(p[::2] + p[1::2][::-1])
    return out


def restored(order: Column) -> Column:
    """``restore`` of one part, as an array."""
    return F.transform(F.array_sort(F.transform(order, lambda i, at: F.struct(i.alias("i"), at.alias("at")))), lambda x: x["at"])


def restore(parts: list[list[int]]) -> list[int]:
    """Where each original index went in the concatenated parts."""
    flat = [i for p in parts for i in p]
    out = [0] * len(flat)
    for at, i in enumerate(flat):
        out[i] = at
    return out


def partition(df: DataFrame, batch: str, idx: str, size: str, split: Callable[[list[int]], list[list[int]]]) -> DataFrame:
    """Adds ``part`` and ``place`` of each row, balancing every batch on its own."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(idx).reset_index(drop=True)
        for p, members in enumerate(split(pdf[size].tolist())):
            pdf.loc[members, "part"], pdf.loc[members, "place"] = p, range(len(members))
        return pdf.astype({"part": "int32", "place": "int32"})

    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return df.groupBy(batch).applyInPandas(run, f"{columns}, part int, place int")


def greedy_sums(sizes, k: int):
    """The sums of k greedy parts of an array column, as a fold."""
    zero = F.array_repeat(F.lit(0).cast("bigint"), k)

    def put(sums, n):
        p = F.array_position(sums, F.array_min(sums)).cast("int")
        return F.transform(sums, lambda s, i: F.when(i == p - 1, s + n).otherwise(s))

    return F.aggregate(sizes, zero, put)


def balance_stats(df: DataFrame, part: str, size: str) -> DataFrame:
    sums = df.groupBy(part).agg(F.sum(size).alias("s"))
    return sums.agg(F.min("s").alias("min"), F.max("s").alias("max"), F.avg("s").alias("mean"))
