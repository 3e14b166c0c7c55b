"""Token counts (operator 8): pieces per distinct pre-token, summed per document.

Each block of rows is cut into pre-tokens and kept as (document, pre-token) frequencies
and the texts of its distinct pre-tokens; no ids are written out, and texts are let go of.
Each distinct pre-token of the corpus belongs to one part by its hash.  The blocks ask the
parts about their pre-tokens, a part has the tokenizer count the pieces of each distinct
one once, and the answers are joined to the block's frequencies and summed.  So the
tokenizer's work follows the corpus's vocabulary and not its length.

A text that holds the string of an added token isn't the sum of its pre-tokens; such texts
go to the tokenizer whole where they lie.  Nulls and empty texts count 0 bytes and 0
tokens; a null id stays null; repeated rows give repeated results; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import blocks, kernel, tokens

#: Pre-tokens that blocks ask of one part.
PART_PRETOKENS = 1 << 18
_U = np.uint64


def _frequencies(rows: pa.Table, held: tokens.PreTokenDictionary) -> tuple[bytes, bytes]:
    """A block as its rows (id, bytes, whole count where special, distinct pre-tokens), their
    codes and frequencies, and the texts of the codes by falling frequency; and how many these are."""
    data, offsets = kernel.buffers(rows.column(1))
    n = len(offsets) - 1
    special, whole = held.special_rows(data, offsets), np.zeros(n, np.int64)
    for i in special:
        whole[i] = len(held.tokenizer.encode(data[offsets[i] : offsets[i + 1]].tobytes().decode(), add_special_tokens=False).ids)
    sums = np.ones(n, bool)
    sums[special] = False
    keys, begins, lengths, row, code, count, base = [np.zeros(0, _U)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [], [], [], 0
    for i, j in kernel.slices(offsets):
        r, codes, distinct, begin, length = held.distinct(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        pair, times = np.unique(r * max(len(distinct), 1) + codes, return_counts=True)
        row.append((pair // max(len(distinct), 1) + i).astype(np.int32))
        code.append((pair % max(len(distinct), 1) + base).astype(np.int32))
        count.append(times.astype(np.int32))
        keys.append(distinct)
        begins.append(begin + offsets[i])
        lengths.append(length)
        base += len(distinct)
    key, begin, length = np.concatenate(keys), np.concatenate(begins), np.concatenate(lengths)
    row, code, count = (np.concatenate(x) if x else np.zeros(0, np.int32) for x in (row, code, count))
    _, first, same = np.unique(key, return_index=True, return_inverse=True)
    often = np.bincount(same[code], minlength=len(first))
    by = np.argsort(-often, kind="stable")
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    code = rank[same[code]]
    order = np.lexsort((code, row))
    row, code, count = row[order], code[order], count[order]
    keep = sums[row]
    row, code, count = row[keep], code[keep], count[keep]
    steps = np.diff(code, prepend=0)
    head = np.concatenate((np.ones(min(len(row), 1), bool), row[1:] != row[:-1]))
    steps[head] = code[head]  # codes rise within a row
    texts = [data[b : b + m].tobytes() for b, m in zip(begin[first[by]].tolist(), length[first[by]].tolist(), strict=True)]
    ids = rows.column(0).combine_chunks() if rows.column(0).num_chunks != 1 else rows.column(0).chunk(0)
    own = pa.RecordBatch.from_arrays([ids, pa.array(np.diff(offsets)), pa.array(whole), pa.array(np.bincount(row, minlength=n).astype(np.int64))], names=["doc_id", "n_bytes", "whole", "distinct"])
    rest = [blocks.widths(steps), blocks.widths(count), blocks.widths(np.array([len(t) for t in texts], np.int64)), b"".join(texts)]
    data = [blocks.to_bytes(own), blocks.to_bytes(pa.RecordBatch.from_arrays([pa.array([x], pa.large_binary()) for x in rest], names=["code", "count", "length", "text"]))]
    return blocks.join_parts(data), len(texts).to_bytes(8, "little")


def _decoded(data: bytes):
    own, rest = (blocks.from_bytes(x) for x in blocks.split_parts(data))
    code, count, length, text = (rest.column(k)[0].as_py() for k in range(4))
    return own, blocks.unwidths(code), blocks.unwidths(count), blocks.unwidths(length), np.frombuffer(text, np.uint8)


def _dealt(length: np.ndarray, text: np.ndarray, parts: int) -> list[tuple[int, np.ndarray]]:
    """(part, codes of its pre-tokens, ascending) of a block's distinct pre-tokens."""
    owner = ((kernel.hash_spans(text, length) >> _U(32)) * _U(parts) >> _U(32)).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    cuts = np.flatnonzero(np.diff(owner[order])) + 1
    return [(int(owner[x[0]]), x) for x in np.split(order, cuts) if len(x)]


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row."""
    kind = dict(docs.dtypes)[id_col]

    held: dict[str, tokens.PreTokenDictionary] = {}  # each task fills its own copy

    def dictionary() -> tokens.PreTokenDictionary:
        if tokenizer not in held:
            held[tokenizer] = tokens.PreTokenDictionary(tokenizer)
        return held[tokenizer]

    packed = blocks.pack(docs.select(id_col, text_col), text_col, None, encode=lambda rows: _frequencies(rows, dictionary()))
    spelled, n_blocks = blocks.fold(packed, lambda notes: sum(int.from_bytes(x, "little") for x in notes).to_bytes(8, "little"))
    parts = max(1, -(-int.from_bytes(spelled or b"", "little") // PART_PRETOKENS))

    def ask(_: int, block) -> Iterator[tuple[int, bytes]]:
        _, _, _, length, text = block
        ends = np.cumsum(length)
        for part, codes in _dealt(length, text, parts):
            own = b"".join(text[ends[c] - length[c] : ends[c]].tobytes() for c in codes.tolist())
            yield part, blocks.squeeze(blocks.join_parts([blocks.widths(length[codes]), own]))

    def count(_: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
        place: dict[bytes, int] = {}
        wanted = []
        for _, payload in asked:
            length, text = blocks.split_parts(blocks.unsqueeze(payload))
            ends = np.cumsum(blocks.unwidths(length)).tolist()
            wanted.append(np.array([place.setdefault(text[a:b], len(place)) for a, b in zip([0, *ends[:-1]], ends, strict=True)], np.int64))
        pieces = dictionary().pieces(list(place))
        for (block, _), at in zip(asked, wanted, strict=True):
            yield block, blocks.squeeze(blocks.widths(pieces[at]))

    def total(block, told: dict[int, bytes]) -> pa.Table:
        own, code, times, length, text = block
        pieces = np.zeros(len(length), np.int64)
        for part, codes in _dealt(length, text, parts):
            pieces[codes] = blocks.unwidths(blocks.unsqueeze(told[part]))
        distinct = own.column("distinct").to_numpy()
        row = np.repeat(np.arange(len(own)), distinct)
        # codes rise within a row, and each row's first stands whole
        ends = np.cumsum(distinct)
        codes = np.cumsum(code)
        before = np.where(ends > distinct, codes[np.maximum(ends - distinct - 1, 0)], 0) if len(code) else np.zeros(len(own), np.int64)
        n = own.column("whole").to_numpy() + np.bincount(row, times * pieces[codes - before[row]], len(own)).astype(np.int64)
        return pa.table({"doc_id": own.column("doc_id"), "n_bytes": own.column("n_bytes"), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    answers = blocks.exchange(packed, ask, count, parts, n_blocks, _decoded)
    return blocks.meet(packed, answers, total, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean", _decoded)

