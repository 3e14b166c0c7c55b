"""LM scoring (operator 2): a smoothed bigram model as a weighted backoff automaton.

Training counts words and word pairs (inside a text, an end token last).  The model is
absolute discounting, interpolated: with c counts, t(h) distinct followers of h and the
discount d = n1 / (n1 + 2 n2) from the pairs seen once and twice,

    P(w)   = (c(w) + 1) / (N + V + 1)
    P(w|h) = (max(c(hw) - d, 0) + d t(h) P(w)) / c(h)        where c(h) > 0

As an automaton: every counted word is a state, every counted pair an arc whose weight is
log10 P(w|h), and each state has a failure arc of weight log10(d t(h) / c(h)) to the root,
whose arcs weigh log10 P(w).  A text is read once from left to right; reading w leads to
w's state, whichever arc was taken.

The model grows with the corpus and is held by no single process.  Each block of texts
asks for the counts of its words and pairs, and builds the part of the automaton that its
own texts can walk.  Words and pairs go to parts by the hash of the word (of the first
word of a pair), so that a part also knows t(h); the pairs of very frequent words are
spread by both words, and their t(h), of at most 16384 words, are added up on the driver.
Followers travel as 48 bits of their hash under the whole hash of the first word: of n
different followers of one word, n*n/2**49 pairs are taken for each other on average (0.2
at ten million), each a count too high.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks, kernel
from .common import durable

END = np.uint64(0x9AE16A3B2F90404F)
#: Pairs of a part.
PART_PAIRS = 1 << 18
#: A word that begins more pairs than a quarter of a part has its pairs spread, if it has this
#: share of all tokens; so at most as many words are.
HOT_SHARE = 1 << 14
_U = np.uint64
_LOW48 = _U((1 << 48) - 1)


class BackoffAutomaton:
    """States 0..n-1 with failure arcs to a root; symbols 0..m-1, of which the first n are
    also the states that reading them leads to."""

    def __init__(self, root: np.ndarray, failure: np.ndarray, arc_keys: np.ndarray, arc_weights: np.ndarray):
        self.root, self.failure = root, failure
        order = np.argsort(arc_keys)
        self.keys, self.weights = arc_keys[order], arc_weights[order]

    def walk(self, symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Log-probability of each symbol of a stream; at ``first`` the state is the root,
        and so it is after a symbol without a state."""
        m, n = len(self.root), len(self.failure)
        state = np.concatenate(([n], symbols[:-1]))
        state = np.where(first, n, state)
        out = self.root[symbols]
        inside = np.flatnonzero(state < n)
        key = state[inside] * m + symbols[inside]
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            out[inside[hit]] = self.weights[at[hit]]
        else:
            hit = np.zeros(len(key), bool)
        out[inside[~hit]] += self.failure[state[inside[~hit]]]
        return out


class _Stream:
    """The tokens of a block: distinct words (codes), pairs, and which texts train."""

    def __init__(self, rows: pa.Table, text_col: str, trains: np.ndarray):
        import pandas as pd

        data, offsets = kernel.buffers(rows.column(text_col))
        hashes, counts = kernel.word_hashes(data, offsets, lower=True)
        self.n = counts + 1
        self.tokens = np.insert(hashes, np.cumsum(counts), END)
        self.begin = np.cumsum(self.n) - self.n
        codes, words = pd.factorize(self.tokens)
        order = np.argsort(words)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        self.words, self.codes = words[order], rank[codes]
        self.trains = np.repeat(trains, self.n)
        self.first = np.zeros(len(self.tokens), bool)
        self.first[self.begin] = True

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.codes[self.trains], minlength=len(self.words))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct pairs (first code * words + second code, ascending) and their training counts."""
        m = len(self.words)
        at = np.flatnonzero(~self.first)
        key = self.codes[at - 1] * m + self.codes[at]
        order = np.argsort(key)
        ordered = key[order]
        head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(key) else np.zeros(0, np.int64)
        count = np.add.reduceat(self.trains[at][order].astype(np.int64), head) if len(head) else head
        return ordered[head], count


def _trains(rows: pa.Table, id_col: str, held_out: tuple[int, int]) -> np.ndarray:
    ids = rows.column(id_col).to_pylist()
    return np.array([zlib.crc32(str("" if i is None else i).encode()) % held_out[0] != held_out[1] for i in ids], bool)


def _survey(text_col: str, id_col: str, held_out: tuple[int, int]):
    """The block's tokens and frequent words, by count."""

    def run(rows: pa.Table) -> bytes:
        s = _Stream(rows, text_col, _trains(rows, id_col, held_out))
        n = np.bincount(s.codes, minlength=len(s.words))
        top = np.flatnonzero(n * HOT_SHARE >= len(s.tokens))
        return np.concatenate((np.array([len(s.tokens)], _U), s.words[top], n[top].astype(_U))).tobytes()

    return run


class _Routes:
    def __init__(self, hot: np.ndarray, parts: int):
        self.hot, self.parts = np.sort(hot), parts

    def of_words(self, words: np.ndarray) -> np.ndarray:
        """Parts are ranges of the hash, so that sorted words are sorted by part."""
        return ((words >> _U(32)) * _U(self.parts) >> _U(32)).astype(np.int64)

    def is_hot(self, words: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(words), bool)
        return self.hot[self.places(words)] == words

    def places(self, words: np.ndarray) -> np.ndarray:
        return np.minimum(np.searchsorted(self.hot, words), len(self.hot) - 1)


def _layout(s: _Stream, routes: _Routes):
    """What a block asks, by part: (part, words asked, pairs under them, pairs of hot words).

    The last two are indices into the block's distinct pairs; a part's plain pairs stand in
    the order of its words."""
    pair, count = s.pairs()
    m = len(s.words)
    head, tail = pair // max(m, 1), pair % max(m, 1)
    word_part = routes.of_words(s.words)
    hot = routes.is_hot(s.words)[head]
    plain = np.flatnonzero(~hot)
    spread = np.flatnonzero(hot)
    spread_part = routes.of_words(kernel.combine([s.words[head[spread]], s.words[tail[spread]]]))
    spread = spread[np.argsort(spread_part, kind="stable")]
    spread_part = np.sort(spread_part)
    ids = np.arange(routes.parts + 1)
    w, p, h = np.searchsorted(word_part, ids), np.searchsorted(word_part[head[plain]], ids), np.searchsorted(spread_part, ids)
    for part in np.flatnonzero((np.diff(w) > 0) | (np.diff(h) > 0)).tolist():
        words, of_plain, of_hot = slice(w[part], w[part + 1]), plain[p[part] : p[part + 1]], spread[h[part] : h[part + 1]]
        yield part, words, of_plain, of_hot, head, tail, count


def _hot_heads(routes: _Routes, words: np.ndarray, head: np.ndarray) -> tuple[bytes, bytes]:
    """The frequent words that head a part's pairs, as places in their list, and how many pairs each."""
    first = np.flatnonzero(np.concatenate((np.ones(min(len(head), 1), bool), head[1:] != head[:-1])))
    runs = np.diff(np.append(first, len(head)))
    return (routes.places(words[head[first]]) if len(first) else first).astype("<u2").tobytes(), blocks.widths(runs)


def _low48(words: np.ndarray) -> bytes:
    return np.ascontiguousarray((words & _LOW48).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _totals(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, first of each key in that order, total of each key)."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    head = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return order, head, np.add.reduceat(counts[order], head) if len(head) else head


def _news(total: np.ndarray, local: np.ndarray) -> bytes:
    """Totals that differ from what the block counted itself."""
    more = total != local
    return blocks.squeeze(blocks.join_parts([np.packbits(more).tobytes(), blocks.widths(total[more])]))


def _told(local: np.ndarray, news: bytes) -> np.ndarray:
    bits, values = blocks.split_parts(blocks.unsqueeze(news))
    out = local.copy()
    out[np.unpackbits(np.frombuffer(bits, np.uint8), count=len(local)).astype(bool)] = blocks.unwidths(values)
    return out


def _count(hot: np.ndarray, part: int, asked: list[tuple[int, bytes]]) -> Iterator[tuple[int, bytes]]:
    """Totals of a part's words and pairs, to each block that asked; to block -1 what the
    whole model needs: tokens, words, pairs seen once and twice, followers of hot words."""
    got = []
    for _, payload in asked:
        keys, n, runs, tails, pn, hot_heads, hot_runs, hot_tails, hn = blocks.split_parts(payload)
        heads = np.repeat(hot[np.frombuffer(hot_heads, "<u2")], blocks.unwidths(hot_runs))
        got.append((blocks.unpack_sorted(keys), blocks.unwidths(n), blocks.unwidths(runs), blocks.narrow(tails, 6), blocks.unwidths(pn), heads, blocks.narrow(hot_tails, 6), blocks.unwidths(hn)))
    join = lambda k: np.concatenate([g[k] for g in got])
    words, n = join(0), join(1)
    order, head, total = _totals(words, n)
    distinct = words[order][head]
    heads = np.concatenate([np.repeat(g[0], g[2]) for g in got])
    pair_order, pair_head, pair_total = _totals(kernel.combine([heads, join(3)]), join(4))
    followed = heads[pair_order][pair_head][pair_total > 0]
    followers = np.bincount(np.searchsorted(distinct, followed), minlength=len(distinct)) if len(distinct) else np.zeros(0, np.int64)
    hot_order, hot_head, hot_total = _totals(kernel.combine([join(5), join(6)]), join(7))
    hot_followed, hot_n = np.unique(join(5)[hot_order][hot_head][hot_total > 0], return_counts=True)
    seen = np.concatenate((pair_total, hot_total))
    yield -1, blocks.join_parts([
        np.array([n.sum(), (total > 0).sum(), (seen == 1).sum(), (seen == 2).sum()], "<i8").tobytes(), hot_followed.astype("<u8").tobytes(), hot_n.astype("<i8").tobytes(),
    ])

    def spread(order, head, values):
        out = np.empty(len(order), np.int64)
        out[order] = np.repeat(values, np.diff(np.append(head, len(order))))
        return out

    columns = [(spread(order, head, total), 0), (spread(order, head, followers), 0), (spread(pair_order, pair_head, pair_total), 3), (spread(hot_order, hot_head, hot_total), 5)]
    at = [0, 0, 0, 0]
    for (block, _), g in zip(asked, got, strict=True):
        own = []
        for k, (values, source) in enumerate(columns):
            own.append(values[at[k] : at[k] + len(g[source])])
            at[k] += len(g[source])
        yield block, blocks.join_parts([_news(own[0], g[1]), blocks.squeeze(blocks.widths(own[1])), _news(own[2], g[4]), _news(own[3], g[7])])


def score(docs: DataFrame, held_out: tuple[int, int] = (7, 2), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row.

    Rows whose crc32(id as text) mod held_out[0] is held_out[1] don't train; a null id is
    the empty text there.  Null and empty texts are an end token alone.  Repeated rows
    count as often as they stand.  Other columns are ignored."""
    docs = docs.select(id_col, text_col)
    packed = blocks.pack(docs, text_col, None, _survey(text_col, id_col, held_out))
    noted = durable(packed.select("survey").mapInArrow(kernel.lean(_spell), "word long, n long"))
    of_all = noted.where(F.col("word").isNull()).agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("blocks")).first()
    tokens, parts = of_all["tokens"] or 0, max(1, -(-(of_all["tokens"] or 0) // PART_PAIRS))
    hot = noted.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")).where((F.col("n") * HOT_SHARE > tokens) & (F.col("n") * 4 > PART_PAIRS))
    hot_words = np.array([r["word"] for r in hot.collect()], np.int64).view(_U)  # fewer than HOT_SHARE rows
    routes = _Routes(hot_words, parts)

    def ask(block: int, rows: pa.Table) -> Iterator[tuple[int, bytes]]:
        s = _Stream(rows, text_col, _trains(rows, id_col, held_out))
        n = s.word_counts()
        for part, words, plain, spread, head, tail, count in _layout(s, routes):
            runs = np.bincount(head[plain] - words.start, minlength=words.stop - words.start)
            yield part, blocks.join_parts([
                blocks.pack_sorted(s.words[words]), blocks.widths(n[words]), blocks.widths(runs), _low48(s.words[tail[plain]]), blocks.widths(count[plain]),
                *_hot_heads(routes, s.words, head[spread]), _low48(s.words[tail[spread]]), blocks.widths(count[spread]),
            ])

    answers = durable(blocks.exchange(packed, ask, partial(_count, routes.hot), parts, of_all["blocks"]))
    notes = answers.where("block = -1").select("payload").mapInArrow(kernel.lean(_sum_notes), "word long, n array<long>").groupBy("word").agg(
        *(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(4))
    )
    found = {r["word"]: [r[f"n{k}"] for k in range(4)] for r in notes.collect()}  # one row, and one of each hot word
    total, distinct, once, twice = found.pop(None, [0, 0, 0, 0])
    discount = once / (once + 2 * twice) if once else 0.5
    discount = min(max(discount, 0.01), 0.99)
    hot_ids = np.array(sorted(found), np.int64).view(_U)
    hot_n = np.array([found[w][0] for w in sorted(found)], np.int64)

    def walk(rows: pa.Table, told: dict[int, bytes]) -> pa.Table:
        trains = _trains(rows, id_col, held_out)
        s = _Stream(rows, text_col, trains)
        c = s.word_counts()
        t = np.zeros(len(c), np.int64)
        pair_count = arc_pair = None
        pair, _ = s.pairs()
        for part, words, plain, spread, _head, _tail, count in _layout(s, routes):
            if pair_count is None:
                pair_count, arc_pair = count.copy(), pair
            news, followers, pair_news, hot_news = blocks.split_parts(told[part])
            c[words] = _told(c[words], news)
            t[words] = blocks.unwidths(blocks.unsqueeze(followers))
            pair_count[plain] = _told(count[plain], pair_news)
            pair_count[spread] = _told(count[spread], hot_news)
        hot = np.flatnonzero(routes.is_hot(s.words))
        if len(hot) and len(hot_ids):
            at = np.minimum(np.searchsorted(hot_ids, s.words[hot]), len(hot_ids) - 1)
            t[hot] = np.where(hot_ids[at] == s.words[hot], hot_n[at], 0)
        m = len(c)
        plain_p = (c + 1) / (total + distinct + 1)
        # states are the counted words that something follows; codes are dealt anew so that they come first
        is_state = (c > 0) & (t > 0)
        new = np.empty(m, np.int64)
        order = np.argsort(~is_state, kind="stable")
        new[order] = np.arange(m)
        states = int(is_state.sum())
        failure = np.log10(discount * t[order[:states]] / c[order[:states]]) if states else np.zeros(0)
        keys, weights = np.zeros(0, np.int64), np.zeros(0)
        if pair_count is not None and len(arc_pair):
            h, w = arc_pair // m, arc_pair % m
            arc = np.flatnonzero((pair_count > 0) & is_state[h])
            h, w = h[arc], w[arc]
            keys = new[h] * m + new[w]
            weights = np.log10((np.maximum(pair_count[arc] - discount, 0) + discount * t[h] * plain_p[w]) / c[h])
        model = BackoffAutomaton(np.log10(plain_p[order]), failure, keys, weights)
        each = model.walk(new[s.codes], s.first)
        base = np.log10(plain_p)[s.codes]
        return pa.table({
            "doc_id": rows.column(id_col), "held_out": pa.array(~trains), "n_tokens": pa.array(s.n), "n_known": pa.array(np.add.reduceat((c > 0)[s.codes].astype(np.int64), s.begin)),
            "train_tokens": pa.array(np.full(len(rows), total, np.int64)), "base_score": pa.array(np.add.reduceat(base, s.begin)), "score": pa.array(np.add.reduceat(each, s.begin)),
        })

    schema = f"doc_id {dict(docs.dtypes)[id_col]}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return blocks.meet(packed, answers.where("block >= 0"), walk, schema)


def _spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Survey rows as (word, n); the block's tokens under a null word."""
    for batch in batches:
        for x in batch.column(0).to_pylist():
            v = np.frombuffer(x, "<u8").view("<i8")
            k = (len(v) - 1) // 2
            yield pa.RecordBatch.from_arrays([pa.array([None, *v[1 : 1 + k].tolist()], pa.int64()), pa.array([int(v[0]), *v[1 + k :].tolist()], pa.int64())], names=["word", "n"])


def _sum_notes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.column(0).to_pylist():
            sums, words, n = blocks.split_parts(x)
            words, n = np.frombuffer(words, "<i8").tolist(), np.frombuffer(n, "<i8").tolist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([None, *words], pa.int64()), pa.array([np.frombuffer(sums, "<i8").tolist(), *([k, 0, 0, 0] for k in n)], pa.list_(pa.int64()))], names=["word", "n"]
            )
