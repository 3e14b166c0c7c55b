"""Blocks: rows packed a few megabytes at a time, kept durably, and asked about in one round.

Operators whose statistics span the corpus work on blocks.  A block is some rows as one
compressed Arrow stream, so passes over the text read a compact table and a block is the
same in every pass.  In a round, each block asks about its distinct keys (``ask`` yields
payloads by part), each part sees what all blocks ask about its keys and answers each of
them (``resolve``), and each block meets its answers (``apply``).  What travels is arrays
of hashes per (block, part), already distinct within the block, so a key that is frequent
everywhere costs each part one entry per block.  Beyond a number of messages they travel in
bundles over two hops.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import groupby
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .common import bounded_batches, durable

#: Text bytes of a block.  With more data, larger blocks keep (blocks x parts) low.
BLOCK_BYTES = 8 << 20


def to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def from_bytes(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(data)).read_all()


def pack(
    docs: DataFrame, text_col: str, order_col: str | None, survey: Callable[[pa.Table], bytes] | None = None, most: int = BLOCK_BYTES, encode: Callable[[pa.Table], tuple[bytes, bytes]] | None = None
) -> DataFrame:
    """(block, n, data, survey): all columns of ``docs`` in blocks, rows of a block in
    ascending order of ``order_col`` (nulls last).  ``survey`` may note something small
    about each block while its text is at hand; ``encode`` keeps something else of it than
    its rows, and notes what it says second."""
    docs = bounded_batches(docs)
    text_at, names = docs.columns.index(text_col), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, count = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []
        size = 0

        def out() -> pa.RecordBatch:
            nonlocal held, size, count
            rows = pa.Table.from_batches(held).rename_columns(names)
            if order_col:
                rows = rows.sort_by([(order_col, "ascending")])
            rows = rows.combine_chunks()
            block, held, size, count = (part << 32) + count, [], 0, count + 1
            kept, noted = encode(rows) if encode else (to_bytes(rows.to_batches()[0]), survey(rows) if survey else b"")
            return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([len(rows)], pa.int64()), pa.array([kept], pa.binary()), pa.array([noted], pa.binary())], names=["block", "n", "data", "survey"])

        for batch in batches:
            if not batch.num_rows:
                continue
            _, offsets = kernel.buffers(batch.column(text_at))
            for i, j in kernel.slices(offsets, most // 4):
                held.append(batch.slice(i, j - i))
                size += int(offsets[j] - offsets[i])
                if size >= most:
                    yield out()
        if held:
            yield out()

    return durable(docs.mapInArrow(kernel.lean(run), "block long, n long, data binary, survey binary"))


#: Notes that are added up at once.
FAN_IN = 32


def fold(packed: DataFrame, add: Callable[[list[bytes]], bytes]) -> tuple[bytes | None, int]:
    """The surveys of all blocks added up by ``add``, and how many blocks there are.  They are
    added in a tree: each task adds its own, then one task those of at most ``FAN_IN`` others,
    until one note is left for the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        blocks = 0
        for batch in batches:
            for k in range(batch.num_rows):
                held.append(batch.column(0)[k].as_py())
                blocks += batch.column(1)[k].as_py()
                if len(held) == FAN_IN:
                    held = [add(held)]
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([add(held)], pa.binary()), pa.array([blocks], pa.int64())], names=["survey", "blocks"])

    step = lambda df: df.mapInArrow(kernel.lean(run), "survey binary, blocks long")
    notes, left = step(packed.select("survey", F.lit(1).cast("long"))), packed.rdd.getNumPartitions()
    while left > 1:
        left = -(-left // FAN_IN)
        notes = step(notes.repartition(left))
    found = notes.collect()  # one row
    return (found[0]["survey"], found[0]["blocks"]) if found else (None, 0)


def to_items(items: list[tuple[int, bytes]]) -> bytes:
    """Numbered payloads as one."""
    return b"".join(int(k).to_bytes(8, "little", signed=True) + len(p).to_bytes(8, "little") + p for k, p in items)


def items_of(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        n = int.from_bytes(data[at + 8 : at + 16], "little")
        yield int.from_bytes(data[at : at + 8], "little", signed=True), data[at + 16 : at + 16 + n]
        at += 16 + n


def _rows(columns: dict[str, list]) -> pa.Table:
    return pa.table({k: pa.array(v, pa.binary() if k == "payload" else pa.int64()) for k, v in columns.items()})


def each_block(packed: DataFrame, run: Callable[[int, pa.Table], Iterator[tuple[int, bytes]]], decode: Callable = from_bytes, width: int = 0) -> DataFrame:
    """(part, block, payload): what ``run(block, rows)`` yields as (part, payload), by ascending
    part.  With ``width``, the payloads of so many consecutive parts travel as one."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                block = batch.column(0)[k].as_py()
                rows = decode(batch.column(1)[k].as_py())
                told = run(block, rows)
                if width:
                    told = ((b, to_items(list(some))) for b, some in groupby(told, lambda x: x[0] // width))
                for part, payload in told:
                    yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([block], pa.int64()), pa.array([payload], pa.binary())], names=["part", "block", "payload"])
                del rows, told
                kernel.give_back()

    return packed.select("block", "data").mapInArrow(kernel.lean(go), "part long, block long, payload binary")


def resolve(asked: DataFrame, run: Callable[[int, list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(part, block, payload): what ``run(part, [(block, payload)])`` yields as (block, answer)."""

    def go(table: pa.Table) -> pa.Table:
        kernel.give_back()
        part = table.column("part")[0].as_py()
        rows = sorted(zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True), key=lambda x: x[0])
        answers = list(run(part, rows))
        return _rows({"part": [part] * len(answers), "block": [b for b, _ in answers], "payload": [p for _, p in answers]})

    return asked.groupBy("part").applyInArrow(go, "part long, block long, payload binary")


#: Messages between blocks and parts from which on an exchange takes two hops either way.
DIRECT_MESSAGES = 1 << 27


def exchange(
    packed: DataFrame, ask: Callable[[int, pa.Table], Iterator[tuple[int, bytes]]], run: Callable[[int, list[tuple[int, bytes]]], Iterator[tuple[int, bytes]]], parts: int, n_blocks: int, decode: Callable = from_bytes
) -> DataFrame:
    """(part, block, payload): what each part answers to what the blocks ask of it, for ``meet``.

    Each block has a message for nearly each part, so their number grows with the square of
    the data.  Where they would be too many, they go by way of (bundle of consecutive parts,
    group of blocks), about the square root of either: a block sends one message a bundle,
    that meeting point sends one a part, and answers come back the same way."""
    if parts * n_blocks <= DIRECT_MESSAGES:
        return resolve(each_block(packed, ask, decode), run)
    width, groups = isqrt(max(parts - 1, 0)) + 1, isqrt(max(n_blocks - 1, 0)) + 1
    asked = each_block(packed, ask, decode, width).withColumn("g", F.pmod(F.xxhash64("block"), F.lit(groups)))

    def scatter(table: pa.Table) -> pa.Table:
        by_part: dict[int, list] = {}
        for block, payload in zip(table.column("block").to_pylist(), table.column("payload").to_pylist(), strict=True):
            for part, p in items_of(payload):
                by_part.setdefault(part, []).append((block, p))
        return _rows({"part": list(by_part), "g": [table.column("g")[0].as_py()] * len(by_part), "payload": [to_items(x) for x in by_part.values()]})

    def answer(table: pa.Table) -> pa.Table:
        kernel.give_back()
        part, group, rows = table.column("part")[0].as_py(), {}, []
        for g, payload in zip(table.column("g").to_pylist(), table.column("payload").to_pylist(), strict=True):
            for block, p in items_of(payload):
                group[block] = g
                rows.append((block, p))
        by_group: dict[int, list] = {}
        for block, p in run(part, sorted(rows, key=lambda x: x[0])):
            by_group.setdefault(group.get(block, -1), []).append((block, p))
        return _rows({"part": [part] * len(by_group), "bundle": [part // width] * len(by_group), "g": list(by_group), "payload": [to_items(x) for x in by_group.values()]})

    def gather(table: pa.Table) -> pa.Table:
        by_block: dict[int, list] = {}
        for part, payload in zip(table.column("part").to_pylist(), table.column("payload").to_pylist(), strict=True):
            for block, p in items_of(payload):
                by_block.setdefault(block, []).append((part, p))
        bundle = table.column("bundle")[0].as_py()
        return _rows({"part": [-1 - bundle] * len(by_block), "block": list(by_block), "payload": [to_items(x) for x in by_block.values()]})

    spread = asked.withColumnRenamed("part", "bundle").groupBy("bundle", "g").applyInArrow(scatter, "part long, g long, payload binary")
    answered = durable(spread.groupBy("part").applyInArrow(answer, "part long, bundle long, g long, payload binary"))
    # what a part says to no block in particular stays as it is
    notes = answered.where("g < 0").select("part", F.lit(-1).cast("long").alias("block"), F.expr("substring(payload, 17)").alias("payload"))
    return answered.where("g >= 0").groupBy("bundle", "g").applyInArrow(gather, "part long, block long, payload binary").unionByName(notes)


def meet(packed: DataFrame, answers: DataFrame, run: Callable[[pa.Table, dict[int, bytes]], pa.Table], schema: str, decode: Callable = from_bytes) -> DataFrame:
    """What ``run(rows, {part: answer})`` makes of each block and its answers."""

    def go(left: pa.Table, right: pa.Table) -> pa.Table:
        told: dict[int, bytes] = {}
        for part, payload in zip(right.column("part").to_pylist(), right.column("payload").to_pylist(), strict=True):
            told |= dict(items_of(payload)) if part < 0 else {part: payload}
        out = run(decode(left.column("data")[0].as_py()), told)
        del told
        kernel.give_back()
        return out

    return packed.select("block", "data").groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(go, schema)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending 64-bit keys as differences of as few whole bytes as hold them."""
    if not len(keys):
        return b"\0"
    gaps = np.diff(keys, prepend=np.uint64(0))
    width = max(1, -(-int(gaps.max()).bit_length() // 8))
    return bytes([width]) + np.ascontiguousarray(gaps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]).tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    if data[0] == 0:
        return np.zeros(0, np.uint64)
    return np.cumsum(narrow(data[1:], data[0]), dtype=np.uint64)


def narrow(data: bytes, width: int) -> np.ndarray:
    """Little-endian whole numbers of ``width`` bytes as 64-bit ones."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8), np.uint8)
    out[:, :width] = raw
    return out.reshape(-1).view("<u8")


def widths(values: np.ndarray) -> bytes:
    """Whole numbers in the smallest unsigned type that holds them, and its size first."""
    most = int(values.max()) if len(values) else 0
    size = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4 if most < 1 << 32 else 8
    return bytes([size]) + values.astype(f"<u{size}").tobytes()


def unwidths(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype(np.int64)


def join_parts(parts: list[bytes]) -> bytes:
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def split_parts(data: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(data):
        n = int.from_bytes(data[at : at + 8], "little")
        out.append(data[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def squeeze(data: bytes) -> bytes:
    return zlib.compress(data, 1)


def unsqueeze(data: bytes) -> bytes:
    return zlib.decompress(data)
