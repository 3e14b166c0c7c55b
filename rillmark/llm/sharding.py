"""Sharding (operator 3): best-fit decreasing of indivisible groups into even shards.

Groups of equal texts stay together; a group is an item, its size the bytes of all its
rows.  Best-fit decreasing needs only how many items have each size, so the driver packs
the histogram of sizes: largest first, into the shard with the tightest remaining capacity
that holds the item, found in a balanced tree; and searches the smallest capacity for
which the shards suffice.  Executors number the groups of each size and look them up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import durable, number_within, text_or_empty

#: Groups with this share of all rows find their rows by broadcast; so at most as many do.
HOT_GROUPS = 1024


class RoomTree:
    """A size-balanced binary tree of (remaining capacity, shard), kept balanced by
    rebuilding a subtree whose one side outgrows the other."""

    def __init__(self, keys: list[tuple[int, int]]):
        self.root = self._build(sorted(keys))

    @staticmethod
    def _build(keys):
        if not keys:
            return None
        m = len(keys) // 2
        return [keys[m], RoomTree._build(keys[:m]), RoomTree._build(keys[m + 1 :]), len(keys)]

    @staticmethod
    def _keys(node):
        return [] if node is None else [*RoomTree._keys(node[1]), node[0], *RoomTree._keys(node[2])]

    def _sized(self, node):
        left, right = (x[3] if x else 0 for x in node[1:3])
        node[3] = left + right + 1
        return node if max(left, right) <= 2 * min(left, right) + 1 else self._build(self._keys(node))

    def _insert(self, node, key):
        if node is None:
            return [key, None, None, 1]
        side = 1 if key < node[0] else 2
        node[side] = self._insert(node[side], key)
        return self._sized(node)

    def _remove(self, node, key):
        if key == node[0]:
            return self._build([*self._keys(node[1]), *self._keys(node[2])])
        side = 1 if key < node[0] else 2
        node[side] = self._remove(node[side], key)
        return self._sized(node)

    def tightest(self, size: int) -> tuple[int, int] | None:
        node, best = self.root, None
        while node:
            if node[0][0] >= size:
                node, best = node[1], node[0]
            else:
                node = node[2]
        return best

    def use(self, key: tuple[int, int], size: int) -> None:
        self.root = self._insert(self._remove(self.root, key), (key[0] - size, key[1]))


def best_fit(counts: dict[int, int], shards: int) -> list[tuple[int, int, int, int]]:
    """Best-fit decreasing of ``counts[size]`` items of each size into ``shards`` shards, under
    about the smallest capacity that suffices (to a millionth): rows (size, first rank,
    ranks, shard).

    Items of one size enter one shard while it holds them, as it only becomes tighter, so
    they go in one step and the work follows the number of sizes."""
    order = sorted(counts, reverse=True)

    def attempt(capacity: int) -> list[tuple[int, int, int, int]] | None:
        tree, out = RoomTree([(capacity, s) for s in range(shards)]), []
        for size in order:
            rank, left = 0, counts[size]
            while left:
                key = tree.tightest(size)
                if key is None:
                    return None
                n = min(left, key[0] // size)
                out.append((size, rank, n, key[1]))
                tree.use(key, n * size)
                rank, left = rank + n, left - n
        return out

    low = max([-(-sum(s * n for s, n in counts.items()) // shards), *counts, 0])
    high, found = low, attempt(low)
    step = max(1, low // 1024)
    while found is None:
        low, high, step = high + 1, high + step, step * 2
        found = attempt(high)
    while high - low > low >> 20:  # best fit isn't monotone; this ends at a capacity that suffices beside one that doesn't
        middle = (low + high) // 2
        if (better := attempt(middle)) is None:
            low = middle + 1
        else:
            high, found = middle, better
    return found


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law
    ``bytes``: shards of near equal bytes.

    A null text counts as empty; equal texts share a shard; ids may be null or repeat; groups
    of equal size may be dealt either way; an empty table gives no rows; other columns are
    ignored."""
    text = text_or_empty(text_col)
    digest = durable(
        docs.select(
            F.col(id_col).alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("_key")
        )
    )
    keys = ["_key", "size", "text_crc32"]
    groups = durable(digest.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("bytes", F.col("_n") * F.col("size")))
    # D different sizes sum up to D * D / 2 bytes at least, so there are at most the root of twice the input
    sizes = groups.groupBy("bytes").agg(F.count(F.lit(1)).alias("n")).toArrow()
    plan = np.array(sorted(best_fit(dict(zip(sizes.column("bytes").to_pylist(), sizes.column("n").to_pylist(), strict=True)), shards)), dtype=np.int64).reshape(-1, 4)
    # the plan's rows of a size follow each other: the row of rank r of a size is the last that begins at or before it
    first = np.searchsorted(plan[:, 0], plan[:, 0])
    starts = np.cumsum(plan[:, 2]) - plan[:, 2]
    base = starts[first] if len(plan) else starts

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.searchsorted(plan[:, 0], batch.column("bytes").to_numpy())
            at = np.searchsorted(starts, base[at] + batch.column("_rank").to_numpy(), side="right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "_n")), pa.array(plan[at, 3].astype(np.int32))], names=[*keys, "_n", "shard"])

    ranked = number_within(groups, ["bytes"], keys, "_rank")
    placed = durable(ranked.select(*keys, "_n", "bytes", "_rank").mapInArrow(kernel.lean(place), "_key long, size long, text_crc32 long, _n long, shard int"))
    hot = F.col("_n") * HOT_GROUPS >= digest.count()
    few = F.broadcast(placed.where(hot).drop("_n"))  # at most HOT_GROUPS rows
    put = digest.join(few, keys).unionByName(digest.join(few, keys, "left_anti").join(placed.where(~hot).drop("_n"), keys))
    return number_within(durable(put), ["shard"], ["doc_id", "text_crc32"], "slot").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
