"""Best-fit packing (operator 1) of token pieces into sequences of a fixed capacity.

Best-fit decreasing needs only how many pieces have each length, and lengths are whole
numbers up to the capacity.  So the driver packs the histogram: for each length, longest
first, a segment tree over remaining capacities finds the tightest open sequences in
logarithmic time, and all sequences alike are filled in one step.  The plan it writes (for
each length, which ranks go to which sequences at which offset) has a size bounded by the
capacity alone, and gives the very sequences that packing piece by piece would give, up
to the order of pieces of one length.  Executors then only number pieces of each length
and look their number up.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, tokens
from .common import bounded_batches, durable, number_within


class CapacityTree:
    """Segment tree over remaining capacities 0..n; says the smallest one in use from a bound on."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.used = bytearray(2 * self.size)

    def mark(self, capacity: int, used: bool) -> None:
        i = self.size + capacity
        self.used[i] = used
        while i > 1:
            i //= 2
            self.used[i] = self.used[2 * i] | self.used[2 * i + 1]

    def tightest(self, least: int) -> int | None:
        i = self.size + least
        if self.used[i]:
            return least
        while i > 1:
            if i % 2 == 0 and self.used[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.used[2 * i] else 2 * i + 1
                return i - self.size
            i //= 2
        return None


def pack_histogram(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing of ``counts[length]`` pieces of each length.

    Returns rows (length, first rank, ranks, first sequence, offset), where rank first+i
    goes to sequence first+i, and the number of sequences."""
    tree, open_ = CapacityTree(capacity), {}
    plan: list[tuple[int, int, int, int, int]] = []
    sequences = 0

    def put(room: int, first: int, n: int) -> None:
        if n and room:
            if not open_.setdefault(room, []):
                tree.mark(room, True)
            open_[room].append((first, n))

    def fill(length: int, rank: int, left: int, room: int, first: int, n: int) -> int:
        """Fill sequences first..first+n-1, which have ``room``; returns pieces placed."""
        each = room // length
        full = min(n, left // each)
        for k in range(each if full else 0):
            plan.append((length, rank + k * full, full, first, capacity - room + k * length))
        put(room - each * length, first, full)
        placed = full * each
        if full < n and placed < left:
            rest = left - placed
            for k in range(rest):
                plan.append((length, rank + placed + k, 1, first + full, capacity - room + k * length))
            put(room - rest * length, first + full, 1)
            placed, full = left, full + 1
        put(room, first + full, n - full)
        return placed

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                n = -(-left // (capacity // length))
                done = fill(length, rank, left, capacity, sequences, n)
                sequences += n
            else:
                first, n = open_[room].pop()
                if not open_[room]:
                    tree.mark(room, False)
                done = fill(length, rank, left, room, first, n)
            rank, left = rank + done, left - done
    return plan, sequences


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each text's ids and an end, cut so that
    only the first piece of a text longer than the capacity may be shorter."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tokens.PreTokenDictionary(tokenizer)  # for this task only: workers are used again for other things
        end = np.array([end_id], np.uint32)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for k, ids in held.id_rows(batch.column(1)):
                whole = np.concatenate((ids, end)).astype("<u4")
                first = len(whole) % capacity or capacity
                cuts = [0, *range(first, len(whole) + 1, capacity)] if len(whole) > capacity else [0, len(whole)]
                for p in range(len(cuts) - 1):
                    row.append(k)
                    piece.append(p)
                    start.append(cuts[p])
                    length.append(cuts[p + 1] - cuts[p])
                    crc.append(zlib.crc32(whole[cuts[p] : cuts[p + 1]]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    kind = dict(docs.dtypes)[id_col]
    return bounded_batches(docs).select(id_col, text_col).mapInArrow(kernel.lean(cut), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def best_fit_pack(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null text is empty (its piece is the end id alone); ids may be null or repeat, each
    row is packed; an empty table gives no rows; other columns are ignored."""
    cut = durable(pieces(docs, tokenizer, capacity, end_id, id_col, text_col))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most one row per length
    plan, _ = pack_histogram(counts, capacity)
    rows = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scale = np.int64(1) << 48
        heads = rows[:, 0] * scale + rows[:, 1]
        for batch in batches:
            rank = batch.column("_rank").to_numpy()
            at = np.searchsorted(heads, batch.column("length").to_numpy() * scale + rank, side="right") - 1
            out = batch.drop_columns(["_rank"])
            yield out.append_column("sequence_id", pa.array(rows[at, 3] + rank - rows[at, 1])).append_column("offset", pa.array(rows[at, 4]))

    numbered = number_within(cut, ["length"], ["doc_id", "piece", "ids_crc32", "start"], "_rank").select(*cut.columns, "_rank")
    kind = dict(cut.dtypes)["doc_id"]
    return numbered.mapInArrow(kernel.lean(place), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
