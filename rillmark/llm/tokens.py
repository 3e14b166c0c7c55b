"""Byte-level BPE token ids and counts through a dictionary of pre-tokens.

A text is cut into pre-tokens by one vectorised pass over its bytes; each distinct
pre-token is given to the tokenizer once per task (a bounded cache holds what it
said), and what it said is joined back to the occurrences.  The cut follows the
pattern of byte-level BPE: contractions, then runs of letters, numbers or other
characters with at most one space before, then white space.  Which class a
character above ASCII belongs to is asked of the tokenizer's own pre-tokenizer,
so no Unicode table has to agree with it.  Texts that hold the string of an added
token go to the tokenizer whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import pyarrow as pa

from . import kernel

#: Distinct pre-tokens that a task remembers; beyond it the memory starts anew.
CACHE_ENTRIES = 1 << 19
_LETTER, _NUMBER, _WHITE, _OTHER, _UNSEEN = 1, 2, 3, 4, 0


def _rank_engine(spec: dict):
    """Ids of one pre-token by merge ranks, or None if the file's ids are not ranks.

    Where every merge i of the file makes the token whose id is the i-th after the
    single bytes, lowest-rank-first merging gives the ids that the library gives, at
    a fifth of its time for single pre-tokens."""
    import tiktoken

    model = spec["model"]
    vocab, merges = model["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    plain = not (model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges") or model.get("dropout") or spec.get("normalizer"))
    if not plain or any(vocab.get(a + b) != 256 + i for i, (a, b) in enumerate(merges)):
        return None
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(printable)]
    letter = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}
    merged = len(merges) + 256
    ranks = {bytes(letter[c] for c in t): i for t, i in vocab.items() if i < merged and all(c in letter for c in t)}
    if len(ranks) != merged:
        return None
    return tiktoken.Encoding("ranks", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class PreTokenDictionary:
    """Token ids of pre-tokens for one ``tokenizers`` file, filled on demand."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.specials = [t["content"] for t in json.loads(self.tokenizer.to_str()).get("added_tokens", [])]
        self._cut = ByteLevel(add_prefix_space=False, use_regex=True)
        self._class = np.zeros(0x110000, dtype=np.uint8)
        self._class[:128] = _OTHER
        self._class[[9, 10, 11, 12, 13, 32]] = _WHITE
        self._class[48:58] = _NUMBER
        self._class[65:91] = self._class[97:123] = _LETTER
        for c in [*range(9), *range(14, 32), 127]:  # control characters: ask as well
            self._class[c] = _UNSEEN
        self._ask(np.flatnonzero(self._class[:128] == _UNSEEN))
        self._engine = _rank_engine(json.loads(self.tokenizer.to_str()))
        self._forget()

    def _forget(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.sizes = np.zeros(0, np.int64)
        self.begins = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _ask(self, points: np.ndarray) -> None:
        for p in points.tolist():
            c = chr(p)
            joins = [len(self._cut.pre_tokenize_str(x + c)) == 1 for x in ("a", "1", "!")]
            self._class[p] = _LETTER if joins[0] else _NUMBER if joins[1] else _OTHER if joins[2] else _WHITE

    def classes(self, data: np.ndarray) -> np.ndarray:
        """The class of each byte's character."""
        out = self._class[data]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            b = np.concatenate((data, np.zeros(3, np.uint8))).astype(np.uint32)
            b0, b1, b2, b3 = (b[lead + k] for k in range(4))
            two, three = b0 < 0xE0, (b0 >= 0xE0) & (b0 < 0xF0)
            point = np.where(
                two, ((b0 & 31) << 6) | (b1 & 63),
                np.where(three, ((b0 & 15) << 12) | ((b1 & 63) << 6) | (b2 & 63),
                         ((b0 & 7) << 18) | ((b1 & 63) << 12) | ((b2 & 63) << 6) | (b3 & 63)),
            )
            if (unseen := np.unique(point[self._class[point] == _UNSEEN])).size:
                self._ask(unseen)
            kind = self._class[point]
            out[lead] = out[lead + 1] = kind
            more = ~two
            out[lead[more] + 2] = kind[more]
            more &= ~three
            out[lead[more] + 3] = kind[more]
        return out

    def starts(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where pre-tokens start; together they tile the bytes."""
        n = len(data)
        if not n:
            return np.zeros(0, np.int64)
        kind = self.classes(data)
        row = np.zeros(n + 4, dtype=bool)
        row[offsets] = True
        start = np.ones(n, dtype=bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= row[:n]
        # the last white character before a word stands alone, or leads the word if it is a space
        at = np.flatnonzero(start & (kind != _WHITE) & ~row[:n])
        at = at[kind[at - 1] == _WHITE]
        last = at - 1
        for _ in range(2):
            last = last - ((data[last] & 0xC0) == 0x80)
        start[last] = True
        start[at[data[last] == 32]] = False
        # contractions
        quote = np.flatnonzero(start & (data == 39))
        if len(quote):
            b = np.concatenate((data, np.zeros(3, np.uint8)))
            b1, b2 = b[quote + 1], b[quote + 2]
            here = ~row[quote + 1]
            one = here & np.isin(b1, np.frombuffer(b"stmd", np.uint8))
            two = here & ~row[quote + 2] & (((b1 == 114) | (b1 == 118)) & (b2 == 101) | (b1 == 108) & (b2 == 108))
            for hit, size in ((quote[one], 2), (quote[two], 3)):
                start[hit + 1] = False
                rest = hit + size
                rest = rest[rest < n]
                start[rest[kind[rest] == _LETTER]] = True
        return np.flatnonzero(start)

    def lookup(self, data: np.ndarray, begins: np.ndarray, lengths: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places in the cache of distinct pre-tokens, of which unknown ones are asked once."""
        at = np.searchsorted(self.keys, keys)
        known = self.keys[np.minimum(at, len(self.keys) - 1)] == keys if len(self.keys) else np.zeros(len(keys), bool)
        if not known.all():
            if len(self.keys) + int((~known).sum()) > CACHE_ENTRIES:
                self._forget()
                known[:] = False
            new = np.flatnonzero(~known)
            raw = data.tobytes()
            texts = [raw[b : b + n].decode() for b, n in zip(begins[new].tolist(), lengths[new].tolist(), strict=True)]
            if self._engine is not None:
                ids = [self._engine(x) for x in texts]
            else:
                ids = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.uint32, int(sizes.sum()))
            all_keys = np.concatenate((self.keys, keys[new]))
            order = np.argsort(all_keys)
            self.begins = np.concatenate((self.begins, len(self.ids) + np.cumsum(sizes) - sizes))[order]
            self.sizes = np.concatenate((self.sizes, sizes))[order]
            self.ids = np.concatenate((self.ids, flat))
            self.keys = all_keys[order]
            at = np.searchsorted(self.keys, keys)
        return at

    def _cut_rows(self, data: np.ndarray, offsets: np.ndarray):
        """(row of each pre-token, its code, cache place of each code) of some rows."""
        row, codes, distinct, begins, lengths = self.distinct(data, offsets)
        return row, codes, self.lookup(data, begins, lengths, distinct)

    def distinct(self, data: np.ndarray, offsets: np.ndarray):
        """(row of each pre-token, its code; hash, place and length of the pre-token of each code)."""
        import pandas as pd

        starts = self.starts(data, offsets)
        lengths = np.diff(np.append(starts, len(data)))
        codes, distinct = pd.factorize(kernel.hash_spans(data, lengths))
        first = kernel.first_of(codes, len(distinct))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
        return row, codes, distinct, starts[first], lengths[first]

    def pieces(self, texts: list[bytes]) -> np.ndarray:
        """Into how many pieces each of these pre-tokens is cut."""
        if self._engine is not None:
            return np.fromiter((len(self._engine(x.decode())) for x in texts), np.int64, len(texts))
        return np.fromiter((len(e.ids) for e in self.tokenizer.encode_batch_fast([x.decode() for x in texts], add_special_tokens=False)), np.int64, len(texts))

    def id_rows(self, column: pa.Array):
        """Yield (row, ids as uint32) of each text, in order."""
        data, offsets = kernel.buffers(column)
        special = set(self.special_rows(data, offsets))
        for i, j in kernel.slices(offsets):
            row, codes, places = self._cut_rows(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            sizes = self.sizes[places][codes]
            ends = np.cumsum(sizes)
            begin = np.repeat(self.begins[places][codes] - (ends - sizes), sizes)
            flat = self.ids[begin + np.arange(len(begin))]
            cuts = np.concatenate(([0], np.cumsum(np.bincount(row, sizes, j - i).astype(np.int64))))
            for k in range(i, j):
                if k in special:
                    text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                    yield k, np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)
                else:
                    yield k, flat[cuts[k - i] : cuts[k - i + 1]]

    def special_rows(self, data: np.ndarray, offsets: np.ndarray) -> list[int]:
        raw, rows = data.tobytes(), set()
        for s in (x.encode() for x in self.specials if x):
            at = raw.find(s)
            while at >= 0:
                i = int(np.searchsorted(offsets, at, side="right")) - 1
                if at + len(s) <= offsets[i + 1]:
                    rows.add(i)
                at = raw.find(s, at + 1)
        return sorted(rows)


