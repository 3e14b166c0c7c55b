"""Substring deduplication (operator 7): prefix-partitioned suffix trees over words.

Every run of ``width`` words is the beginning of a suffix.  Suffixes are split by
prefixes of variable length: a first word that begins few enough runs is a prefix of its
own, more frequent ones are split by the first two words, then three, and what is still
too frequent by the whole run.  Frequencies are counted over all blocks in hashed tables,
whose size follows the size of the texts (an overcount only splits further), so a group
never has more than a bounded share of a part's memory, and parts are dealt the groups by
hash.  A part holds the subtrees of its prefixes cut at depth ``width``: its suffixes in
order, those alike down to that depth under one node.  A node with leaves in two documents
is a repeat (a longer maximal repeat is a chain of such nodes), and every leaf but those of
the smallest document is told so.  Suffixes travel as 64-bit fingerprints of their run,
once for each block with the block's smallest document, never as text.  A part is chosen
by other hashes than the fingerprint, so two different runs are only taken for each other
if they share both: among n runs in parts of 2**17 that is expected n/2**48 times, 0.06 at
100 TB of text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, kernel

#: Suffixes of a part; it sorts them in some 60 bytes each.
PART_SUFFIXES = 1 << 17
#: A prefix that begins more runs than this is made longer.
GROUP_SUFFIXES = PART_SUFFIXES // 8
#: Least and most buckets of the table of prefixes of one length.
BUCKET_BITS = 10, 20
_DEPTHS = 3
_LAST = np.iinfo(np.int64).max
_U = np.uint64


class _Suffixes:
    """The runs of a block's rows, in order: fingerprints, and what ``prefixes`` makes of their
    prefixes and another hash of the whole.  Worked out a slice of the text at a time."""

    def __init__(self, column: pa.ChunkedArray, width: int, prefixes):
        self.data, self.offsets = kernel.buffers(column)
        prints, made, counts = [np.zeros(0, _U)], [], [np.zeros(0, np.int64)]
        for i, j in kernel.slices(self.offsets):
            hashes, n = kernel.word_hashes(self.data[self.offsets[i] : self.offsets[j]], self.offsets[i : j + 1] - self.offsets[i], lower=False)
            at = kernel.run_starts(n, width)
            counts.append(n)
            if not len(at):
                continue
            prints.append(kernel.mix64(kernel.rolling(hashes, width)[at]))
            with np.errstate(over="ignore"):
                other = kernel.mix64(hashes + _U(0x632BE59BD9B4E019))
            made.append(prefixes([kernel.mix64(kernel.rolling(other, d + 1)[at]) for d in (*range(min(_DEPTHS, width)), width - 1)]))
        self.prints, self.counts, self.made = np.concatenate(prints), np.concatenate(counts), made
        self.runs = kernel.run_rows(self.counts, width)

    def rows(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.runs), dtype=np.int32), self.runs)


def _tables(bits: int, depths: int):
    """For ``_Suffixes``: how many runs each bucket of prefixes begins, by prefix length."""

    def count(prefixes: list[np.ndarray]) -> np.ndarray:
        return np.stack([np.bincount((p >> _U(64 - bits)).astype(np.int64), minlength=1 << bits) for p in prefixes[:depths]])

    return count


def _add(notes: list[bytes]) -> bytes:
    return blocks.squeeze(np.sum([np.frombuffer(blocks.unsqueeze(x), "<i8") for x in notes], axis=0).astype("<i8").tobytes())


def _survey(text_col: str, width: int, bits: int):
    def run(rows: pa.Table) -> bytes:
        depths = min(_DEPTHS, width)
        s = _Suffixes(rows.column(text_col), width, _tables(bits, depths))
        return blocks.squeeze(np.sum(s.made, axis=0, dtype="<i8").tobytes() if s.made else bytes(depths * 8 << bits))

    return run


def _owners(heavy: np.ndarray, bits: int, parts: int):
    """For ``_Suffixes``: the part of each run, by the hash of its shortest light prefix."""

    def own(prefixes: list[np.ndarray]) -> np.ndarray:
        chosen = prefixes[-1]  # the whole run
        for d in range(len(prefixes) - 2, -1, -1):
            chosen = np.where(heavy[d][(prefixes[d] >> _U(64 - bits)).astype(np.int64)], chosen, prefixes[d])
        # the high bits chose the bucket, so that the part needs others
        return (((kernel.mix64(chosen) >> _U(32)) * _U(parts)) >> _U(32)).astype(np.int32)

    return own


def _nodes(prints: np.ndarray, owner: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, head): leaves in an order that has those of one node together, the first of
    them as they came first, and where nodes begin in it.  Leaves of different parts are
    different whatever their fingerprints."""
    order = np.argsort(prints, kind="stable")
    same = np.diff(prints[order]) == 0
    if owner is not None and (other := same & (np.diff(owner[order]) != 0)).any():
        order = np.lexsort((owner, prints))
        same, other = np.diff(prints[order]) == 0, np.diff(owner[order]) != 0
        same &= ~other
    return order, np.concatenate((np.ones(min(len(prints), 1), bool), ~same))


def _asked(s: _Suffixes, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """(order, head, [(part, its nodes' first leaves, ascending)])."""
    order, head = _nodes(s.prints, owner)
    first = np.sort(order[head])
    first = first[np.argsort(owner[first], kind="stable")]
    cuts = np.flatnonzero(np.diff(owner[first])) + 1
    return order, head, [(int(owner[x[0]]), x) for x in np.split(first, cuts) if len(x)]


def _ids(rows: pa.Table, id_col: str) -> np.ndarray:
    return pc.fill_null(rows.column(id_col).combine_chunks().cast(pa.int64()), _LAST).to_numpy(zero_copy_only=False)


def _repeats(_: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """The subtrees of one part: tell each block which of its nodes began in a smaller document."""
    prints, least, sizes = [], [], []
    for _block, payload in asked:
        keys, places, ids = blocks.split_parts(payload)
        prints.append(np.frombuffer(keys, "<u8"))
        with np.errstate(over="ignore"):
            documents = np.cumsum(np.frombuffer(blocks.unsqueeze(ids), "<i8"))
        least.append(documents[np.cumsum(blocks.unwidths(blocks.unsqueeze(places)))])
        sizes.append(len(prints[-1]))
    doc = np.concatenate(least)
    order, head = _nodes(np.concatenate(prints))
    smallest = np.minimum.reduceat(doc[order], np.flatnonzero(head))
    later = np.empty(len(doc), dtype=bool)
    later[order] = smallest[np.cumsum(head) - 1] < doc[order]
    for (block, _payload), bits in zip(asked, np.split(later, np.cumsum(sizes)[:-1]), strict=True):
        if bits.any():
            yield block, blocks.squeeze(np.packbits(bits).tobytes())


def remove_repeats(docs: DataFrame, width: int = 13, id_col: str = "doc_id", text_col: str = "text", digest: bool = False, count_cols: tuple[str, str] = ("n_words", "n_removed")) -> DataFrame:
    """Remove each word covered by a run of ``width`` words that also starts in a document
    with a smaller id; runs are judged on the input.

    With ``digest``: (doc_id, n_words, n_removed, kept_sha256).  Else: the columns of
    ``docs``, the text of touched documents being their kept words joined by one space
    and that of others unchanged, and the counts as ``count_cols`` (which replace columns
    of these names).  Null texts have no words and stay null; a null id is larger than all
    others; rows with one id are one document, which repeats nothing of itself."""
    if not digest:
        docs = docs.drop(*count_cols)
    else:
        docs = docs.select(id_col, text_col)
    kinds = docs.schema
    text_bytes = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    least, most = BUCKET_BITS
    bits = min(max(least, (4 * text_bytes // (5 * GROUP_SUFFIXES)).bit_length()), most)  # some four buckets for each group of runs
    packed = blocks.pack(docs, text_col, id_col, _survey(text_col, width, bits))
    note, n_blocks = blocks.fold(packed, _add)
    counts = np.frombuffer(blocks.unsqueeze(note), "<i8").reshape(-1, 1 << bits) if note else np.zeros((min(_DEPTHS, width), 1 << bits), np.int64)
    parts = max(1, -(-int(counts[0].sum()) // PART_SUFFIXES))
    own = _owners(counts > GROUP_SUFFIXES, bits, parts)

    def leaves(rows: pa.Table) -> tuple[_Suffixes, np.ndarray, np.ndarray]:
        s = _Suffixes(rows.column(text_col), width, own)
        owner = np.concatenate(s.made) if s.made else np.zeros(0, np.int32)
        return s, owner, _ids(rows, id_col)

    def ask(_: int, rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        s, owner, ids = leaves(rows)
        row = s.rows()
        for part, at in _asked(s, owner)[2]:
            mine, place = np.unique(row[at], return_inverse=True)
            with np.errstate(over="ignore"):
                gaps = np.diff(ids[mine], prepend=0).astype("<i8").tobytes()
            yield part, blocks.join_parts([s.prints[at].astype("<u8").tobytes(), blocks.squeeze(blocks.widths(np.diff(place, prepend=0))), blocks.squeeze(gaps)])

    def cut(rows: pa.Table, told: dict[int, bytes]) -> pa.Table:
        s, owner, ids = leaves(rows)
        order, head, asked = _asked(s, owner)
        begins = np.flatnonzero(head)
        node = np.empty(len(order), np.int32)
        node[order] = np.cumsum(head) - 1
        del owner, head
        everywhere = np.zeros(len(begins), dtype=bool)
        for part, at in asked:
            if (bits := told.get(part)) is not None:
                everywhere[node[at[np.unpackbits(np.frombuffer(blocks.unsqueeze(bits), np.uint8), count=len(at)).astype(bool)]]] = True
        # inside the block a run is gone where a smaller document has it
        row = s.rows()
        smallest = ids[row[order[begins]]]
        gone = everywhere[node] | (ids[row] > smallest[node])
        del order, begins, node, row, asked
        starts = kernel.run_starts(s.counts, width)[gone]
        total = int(s.counts.sum())
        edge = np.zeros(total + 1, np.int64)
        edge[starts] += 1
        edge[starts + width] -= 1
        covered = np.cumsum(edge[:-1]) > 0
        ends = np.cumsum(s.counts)
        removed = np.add.reduceat(np.append(covered, False).astype(np.int64), np.minimum(ends - s.counts, total)) if len(ends) else ends
        removed = np.where(s.counts > 0, removed, 0)
        del edge, starts, gone

        def kept(k: int) -> bytes:
            words = s.data[s.offsets[k] : s.offsets[k + 1]].tobytes().split()
            if removed[k]:
                words = [w for w, c in zip(words, covered[ends[k] - s.counts[k] : ends[k]].tolist(), strict=True) if not c]
            return b" ".join(words)

        n_words, n_removed = pa.array(s.counts.astype(np.int64)), pa.array(removed.astype(np.int64))
        if digest:
            sums = pa.array([hashlib.sha256(kept(k)).hexdigest() for k in range(len(ends))], pa.string())
            return pa.table({"doc_id": rows.column(id_col), "n_words": n_words, "n_removed": n_removed, "kept_sha256": sums})
        old = rows.column(text_col).combine_chunks()
        touched = np.flatnonzero(removed)
        new = pa.array([kept(k).decode() for k in touched.tolist()], old.type)
        mask = np.zeros(len(ends), dtype=bool)
        mask[touched] = True
        out = rows.set_column(rows.column_names.index(text_col), text_col, pc.replace_with_mask(old, pa.array(mask), new))
        return out.append_column(count_cols[0], n_words).append_column(count_cols[1], n_removed)

    answers = blocks.exchange(packed, ask, _repeats, parts, n_blocks)
    if digest:
        schema = f"doc_id {dict(docs.dtypes)[id_col]}, n_words long, n_removed long, kept_sha256 string"
    else:
        from pyspark.sql import types as T

        schema = T.StructType([*kinds.fields, *(T.StructField(c, T.LongType()) for c in count_cols)])
    return blocks.meet(packed, answers, cut, schema)
