"""Source divergence audit (operator 12): how a language's sources differ in their terms.

Terms are runs of letters (A-Z, a-z and everything beyond ASCII), A-Z in lower case.  A task
encodes the terms of some rows as integers, counts them per (lang, source) and per row, and
hands Spark one row per (lang, source, term); Spark adds these up and keeps the terms that
enough documents of their language hold.

The kept terms of a language, sorted, are its dictionary.  It is dealt in ranges of the UTF-8
order and cut into chunks of ``CHUNK`` terms, so no task needs all of it.  For a chunk and two
tiles of ``TILE`` sources, ids are found by binary search in the chunk's sorted terms and a dense
matrix holds every source's counts; ids ascend as the terms do, so the smallest id is the right
one among ties.  Shares are whole numbers made by long division in three steps, so 64 bits hold
every step up to 9 * 10**15 counted terms.  Sums of differences are added up over chunks; of the
most over-used terms a chunk proposes ``most`` per source, and Spark ranks the proposals.

The pairs of a language's sources are asked for in full, so work and result grow with the square
of their number, in tiles.  A null text, lang or source is the empty one.  A language without
kept terms gives its pairs with 0; one with a single source gives no pairs.  Repeated rows count
as often as they stand.  An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernel
from .common import bounded_batches, durable, text_or_empty

#: Text bytes whose terms are encoded at once.
READ = 1 << 21
#: Terms of a chunk, and sources of a tile.
CHUNK, TILE = 1024, 256
#: Bytes of the table of groups up to which it is broadcast; beyond, it is joined by a shuffle.
BROADCAST_BYTES = 8 << 20
#: Shares are in units of 1 / SHARE.
SHARE = 1_000_000_000
SMOOTH = 5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Bytes that are part of no term; all bytes of characters beyond ASCII are part of one.
_OUTSIDE = np.ones(256, bool)
_OUTSIDE[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False


def _encoded(b: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct terms, row, code, occurrences of the code in the row), from lower-cased bytes."""
    starts, ends, n = kernel.word_spans(b, offsets, _OUTSIDE)
    places = np.concatenate(([0], np.cumsum(ends - starts)))
    terms = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(places), pa.py_buffer(b[~_OUTSIDE[b]])]).dictionary_encode()
    width = max(len(terms.dictionary), 1)
    cell, count = np.unique(np.repeat(np.arange(len(n)), n) * width + terms.indices.to_numpy(), return_counts=True)
    return terms.dictionary, cell // width, cell % width, count


def _parts(b: np.ndarray) -> Iterator[np.ndarray]:
    """A long text in parts of about ``READ`` bytes that cut no term."""
    s = 0
    while s < len(b):
        e = s + READ
        if e < len(b):
            cut = np.flatnonzero(_OUTSIDE[b[s:e]])
            while not len(cut) and e < len(b):
                cut, e = np.flatnonzero(_OUTSIDE[b[e : e + READ]]) + (e - s), e + READ
            e = s + int(cut[-1]) + 1 if len(cut) else len(b)
        yield b[s:e]
        s = e


def term_counts(column: pa.Array) -> Iterator[tuple[int, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, distinct terms, row from there, code, occurrences) of slices of the rows."""
    data, offsets = kernel.buffers(column)
    for i, j in kernel.slices(offsets, READ):
        b, offs = _LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        if len(b) <= READ:
            yield i, *_encoded(b, offs)
        else:  # one row
            found = [_encoded(x, np.array([0, len(x)])) for x in _parts(b)]
            terms = pa.concat_arrays([x[0].take(pa.array(x[2])) for x in found]).dictionary_encode()
            count = np.zeros(len(terms.dictionary), np.int64)
            np.add.at(count, terms.indices.to_numpy(), np.concatenate([x[3] for x in found]))
            yield i, terms.dictionary, np.zeros(len(count), np.int64), np.arange(len(count)), count


def counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): occurrences, and documents that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: dict[tuple[str, str], int] = {}
            group = np.array([names.setdefault(x, len(names)) for x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], np.int64)
            lang, source = (pa.array([x[k] for x in names], pa.string()) for k in (0, 1))
            for first, terms, row, code, count in term_counts(batch.column(2)):
                width = max(len(terms), 1)
                cell, place = np.unique(group[row + first] * width + code, return_inverse=True)
                n = np.zeros(len(cell), np.int64)
                np.add.at(n, place, count)
                at = pa.array(cell // width)
                yield pa.RecordBatch.from_arrays(
                    [lang.take(at), source.take(at), terms.take(pa.array(cell % width)).cast(pa.string()), pa.array(n), pa.array(np.bincount(place, minlength=len(cell)).astype(np.int64))],
                    names=["lang", "source", "term", "n", "docs"],
                )

    told = bounded_batches(docs).mapInArrow(kernel.lean(run), "lang string, source string, term string, n long, docs long")
    return told.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def kept_terms(counted: DataFrame, least: int) -> DataFrame:
    """(lang, source, term, n, total, first): counts of terms in at least ``least`` documents of the
    language, the language's own, and whether it is the term's first row."""
    over = Window.partitionBy("lang", "term")
    kept = counted.withColumns({"held": F.sum("docs").over(over), "total": F.sum("n").over(over), "first": F.row_number().over(over.orderBy("source")) == 1})
    return kept.where(F.col("held") >= least).select("lang", "source", "term", "n", "total", "first")


def groups_of(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, size, lang_size, terms, tile, tiles): every occurring group, how many kept
    terms it and its language hold in all, and how many different ones the language has."""
    size = kept.groupBy("lang", "source").agg(F.sum("n").alias("size"))
    terms = kept.where("first").groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    own = docs.select("lang", "source").distinct().join(size, ["lang", "source"], "left").join(terms, "lang", "left").fillna(0, ["size", "terms"])
    lang = Window.partitionBy("lang")
    tile = ((F.row_number().over(lang.orderBy("source")) - 1) / TILE).cast("int")
    return own.withColumns({"lang_size": F.sum("size").over(lang), "tile": tile, "tiles": F.ceil(F.count(F.lit(1)).over(lang) / TILE).cast("int")})


def in_order(kept: DataFrame) -> DataFrame:
    """``kept`` dealt in ranges of (lang, term), with the number of the range and the place of the term
    among those of its language in the range."""
    from pyspark import TaskContext

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen, last = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            code, first = batch.column(0).dictionary_encode().indices.to_numpy(), batch.column(5).to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero(code[1:] != code[:-1]) + 1
            place = np.empty(len(code), np.int64)
            for s, e in zip([0, *cuts], [*cuts, len(code)], strict=True):
                lang = batch.column(0)[int(s)].as_py()
                seen, last = (seen if lang == last else 0), lang
                place[s:e] = seen + np.cumsum(first[s:e]) - 1
                seen = int(place[e - 1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(code), number, np.int32)), pa.array(place)], names=[*batch.schema.names, "range", "place"])

    ordered = kept.repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    return bounded_batches(ordered).mapInArrow(kernel.lean(run), "lang string, source string, term string, n long, total long, first boolean, range int, place long")


def in_chunks(ordered: DataFrame) -> DataFrame:
    """A chunk for each row of ``in_order``, which must be durable: ``CHUNK`` terms of a language in
    UTF-8 order, however they were dealt."""
    before = Window.partitionBy("lang").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ordered.where("first").groupBy("lang", "range").agg(F.count(F.lit(1)).alias("n"))
    ranges = ranges.select("lang", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return ordered.join(ranges, ["lang", "range"]).withColumn("chunk", F.floor((F.col("place") + F.col("before")) / CHUNK)).drop("range", "place", "before")


def shares(count: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SHARE * (count + SMOOTH) / whole), exactly; no count is larger than its whole."""
    rest = count + SMOOTH
    out, unit = rest // whole, SHARE
    rest = rest % whole
    out = out * unit + 1
    for _ in range(3):
        rest, unit = rest * 1000, unit // 1000
        out += rest // whole * unit
        rest = rest % whole
    return out


def _ids(column: pa.ChunkedArray, kept: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(the sorted distinct strings, the id of each row's), in UTF-8 order."""
    coded = column.combine_chunks().cast(pa.large_binary())
    coded = (coded if isinstance(coded, pa.Array) else coded.chunk(0)).dictionary_encode()
    own = np.array(coded.dictionary.to_pylist(), object)
    kept = np.sort(own) if kept is None else kept
    return kept, np.searchsorted(kept, own)[coded.indices.to_numpy()] if len(own) else np.zeros(0, np.int64)


def compare(most: int):
    """What a chunk's counts and the sources of one or two tiles say: sums of differences of pairs
    (the smaller name is ``source``), and each source's ``most`` most over-used terms."""

    def run(rows: pa.Table, sources: pa.Table) -> pa.Table:
        names, place = _ids(sources.column("source"))
        number = lambda c: sources.column(c).to_numpy()[np.argsort(place)]
        size, tile = number("size"), number("tile")
        lang, lang_size, terms, n_terms = (sources.column(c)[0].as_py() for c in ("lang", "lang_size", "terms", "n_terms"))
        kept, term = _ids(rows.column("term"))
        _, source = _ids(rows.column("source"), names)
        count = np.zeros((len(names), len(kept)), np.int64)
        count[source, term] = rows.column("n").to_numpy()
        total = np.zeros(len(kept), np.int64)
        total[term] = rows.column("total").to_numpy()
        whole = np.maximum(size + SMOOTH * terms, 1)
        share = shares(count, whole[:, None])
        absent, missing = shares(np.zeros_like(size), whole), n_terms - len(kept)
        columns: list[list] = [[], [], [], []]
        for a in range(len(names)):
            b = np.arange(a + 1, len(names))
            b = b[(tile[b] != tile[a]) | (tile.min() == tile.max())]
            value = np.abs(share[b] - share[a]).sum(axis=1) + missing * np.abs(absent[b] - absent[a])
            for c, x in zip(columns, ([names[a]] * len(b), ["pair"] * len(b), names[b].tolist(), value.tolist()), strict=True):
                c += x
        if len(kept) and tile.min() == tile.max():
            over = share - shares(total, np.int64(lang_size + SMOOTH * terms))
            for a in range(len(names)):
                at = np.flatnonzero((count[a] > 0) & (over[a] > 0))
                at = at[np.lexsort((at, -over[a][at]))[:most]]
                for c, x in zip(columns, ([names[a]] * len(at), ["term"] * len(at), kept[at].tolist(), over[a][at].tolist()), strict=True):
                    c += x
        text = [pa.array(x, pa.binary() if k != 1 else pa.string()).cast(pa.string()) for k, x in enumerate(columns[:3])]
        return pa.table({"lang": pa.array([lang] * len(columns[0]), pa.string()), "source": text[0], "part": text[1], "item": text[2], "value": pa.array(columns[3], pa.int64())})

    return run


def audit(docs: DataFrame, least: int = 30, most: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows compare a source with each other one
    of its language, ``term`` rows are its ``most`` most over-used terms."""
    docs = docs.select(*(text_or_empty(F.col(f"`{c}`")).alias(name) for c, name in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    kept = in_chunks(durable(in_order(kept_terms(counts(docs), least))))
    groups = durable(groups_of(docs, kept))
    held = groups.agg(F.sum(F.octet_length("lang") + F.octet_length("source") + 64)).first()[0] or 0
    near = F.broadcast(groups) if held <= BROADCAST_BYTES else groups
    chunks = kept.where("first").groupBy("lang", "chunk").agg(F.count(F.lit(1)).alias("n_terms"))
    # a language without terms has one empty chunk
    chunks = groups.select("lang").distinct().join(chunks, "lang", "left").fillna({"chunk": -1, "n_terms": 0})
    other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
    pairs = lambda df: df.withColumn("other", other).withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    rows = pairs(kept.join(near.select("lang", "source", "tile", "tiles"), ["lang", "source"])).select("lang", "chunk", "low", "high", "source", "term", "n", "total")
    sources = pairs(chunks.join(near, "lang")).select("lang", "chunk", "low", "high", "source", "size", "lang_size", "terms", "tile", "n_terms")
    key = ["lang", "chunk", "low", "high"]
    told = durable(rows.groupBy(*key).cogroup(sources.groupBy(*key)).applyInArrow(compare(most), "lang string, source string, part string, item string, value long"))
    summed = told.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item"))))
    summed = summed.withColumn("both", both).select("lang", "both.source", "part", "both.item", "value")
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda df: df.withColumn("rank", F.row_number().over(order))
    return ranked(summed).unionByName(ranked(told.where("part = 'term'")).where(F.col("rank") <= most))
