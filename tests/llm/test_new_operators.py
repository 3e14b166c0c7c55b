"""Centroid clustering, source divergence and language identification against plain readings."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pyarrow as pa
import pytest

from rillmark.llm import clusters, divergence, kernel, language, queries


def plain_clusters(rows, k, rounds, d, scale=256):
    kept = [(i, [floor(Fraction(x) * scale) for x in v]) for i, v in rows if v is not None and len(v) == d and all(x is not None and isfinite(x) for x in v)]
    by = sorted(range(len(kept)), key=lambda r: ((0, hashlib.sha256(f"2:{kept[r][0]}".encode()).hexdigest()) if kept[r][0] is not None else (1, ""), kept[r][1]))
    c = [kept[r][1] for r in by[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, y, strict=True)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        label = [near(x)[1] for _, x in kept]
        for j in range(len(c)):
            own = [x for (_, x), at in zip(kept, label, strict=True) if at == j]
            if own:
                c = [*c[:j], [sum(s) // len(own) for s in zip(*own, strict=True)], *c[j + 1 :]]
    told = [near(x) for _, x in kept]
    inertia = [sum(s for s, at in told if at == j) for j in range(len(c))]
    long = lambda x: x if x < 1 << 63 else None
    return sorted((repr((i, j, long(s), long(inertia[j]), long(sum(inertia)), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest())) for (i, _), (s, j) in zip(kept, told, strict=True)))


def clustered(spark, rows, k, rounds, d):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    return sorted(repr(tuple(r)) for r in clusters.cluster(df, k, rounds, d).collect())


def test_clusters_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, (rng.integers(-3, 4, 4) / 256).tolist()) for i in range(120)]  # ties everywhere
    rows += [(7, rows[7][1]), (7, [0.5] * 4), (None, [0.25] * 4), (None, None), (500, None), (501, []), (502, [1.0] * 3), (503, [1.0, None, 1.0, 1.0])]
    rows += [(504, [float("nan")] * 4), (505, [float("inf"), 0.0, 0.0, 0.0]), (506, [0.0] * 4), (507, [-0.0] * 4), (508, [-1e-9] * 4)]
    got = clustered(spark, rows, 9, 3, 4)
    assert got == plain_clusters(rows, 9, 3, 4) and len(got) == 126
    large = [*rows, (600, [1e9, 2.0, -3.0, 0.0]), (601, [1e300, 1.0, 1.0, 1.0]), (602, [3e5, -3e5, 1.0, 0.5])]
    assert clustered(spark, large, 200, 2, 4) == plain_clusters(large, 200, 2, 4)  # each starts a centroid
    assert clustered(spark, large, 5, 2, 4) == plain_clusters(large, 5, 2, 4)
    assert clustered(spark, [(1, None)], 5, 2, 4) == []


def test_clusters_query(spark, sf_dir):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").limit(150).collect()]
    assert clustered(spark, rows, 12, 5, 64) == plain_clusters(rows, 12, 5, 64)


@pytest.mark.parametrize("size", [2, 50, 3000, 1 << 25])
def test_screen_never_loses_the_nearest(size):
    rng = np.random.default_rng(size)
    c = rng.integers(-size, size, (60, 64))
    c[30:40] = c[:10]
    c[40:50] = c[:10] + rng.integers(-1, 2, (10, 64))
    x = np.concatenate([c[:20], (c[:30] + c[30:]) // 2, rng.integers(-size, size, (50, 64))])
    apart = ((x.astype(object)[:, None] - c.astype(object)[None]) ** 2).sum(axis=2)
    low, high = clusters.bounds(x, c)
    exact = apart - (x.astype(object) ** 2).sum(axis=1)[:, None]
    assert (low <= exact).all() and (exact <= high).all()
    label, told = clusters.nearest(x, c)
    assert label.tolist() == [min(range(60), key=row.__getitem__) for row in apart] and told.tolist() == apart.min(axis=1).tolist()
    assert clusters.screen(x[50:], c, np.zeros(60, bool)).sum() < 50 * 60 / 4  # and it shortlists


TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_audit(rows, least, most):
    held, own, groups = Counter(), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source, words = lang or "", source or "", TERM.findall((text or "").translate(LOWER))
        groups.add((lang, source))
        held.update((lang, w) for w in set(words))
        own[lang, source].update(words)
    kept = defaultdict(list)
    for (lang, w), n in held.items():
        if n >= least:
            kept[lang].append(w)
    out = []
    for lang, source in groups:
        terms = sorted(kept[lang], key=str.encode)
        others = sorted((s for x, s in groups if x == lang), key=str.encode)
        total = Counter()
        for s in others:
            total.update(own[lang, s])

        def share(count, terms=terms):
            n = sum(count[w] for w in terms) + 5 * len(terms)
            return [1 + 10**9 * (count[w] + 5) // n for w in terms]

        p, q = share(own[lang, source]), share(total)
        pairs = [(s, sum(abs(a - b) for a, b in zip(p, share(own[lang, s]), strict=True))) for s in others if s != source]
        over = [(w, a - b) for w, a, b in zip(terms, p, q, strict=True) if own[lang, source][w] and a > b]
        for part, items in (("pair", pairs), ("term", over)):
            items = sorted(items, key=lambda x: (-x[1], x[0].encode()))
            out += [(lang, source, part, item, v, r + 1) for r, (item, v) in enumerate(items) if part == "pair" or r < most]
    return sorted(out)


def audited(df, **options):
    return sorted(tuple(r) for r in divergence.audit(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize(("chunk", "tile", "broadcast"), [(4096, 256, 1 << 20), (3, 2, 0), (1, 1, 0)])
def test_audit_of_odd_rows(spark, odd_docs, monkeypatch, chunk, tile, broadcast):
    monkeypatch.setattr(divergence, "CHUNK", chunk)
    monkeypatch.setattr(divergence, "TILE", tile)
    monkeypatch.setattr(divergence, "BROADCAST_BYTES", broadcast)
    more = spark.createDataFrame([("A b, bé B;É " * k, "en" if k % 3 else None, f"s{k % 5}é") for k in range(20)], "text string, lang string, source string")
    df = odd_docs.unionByName(more, allowMissingColumns=True)
    rows = [(r["text"], r["lang"], r["source"]) for r in df.collect()]
    for least, most in ((1, 3), (2, 50), (1000, 50)):
        assert audited(df, least=least, most=most) == plain_audit(rows, least, most)


def test_audit_of_no_rows(no_docs):
    assert audited(no_docs) == []


def test_audit_of_whole_table(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["text"], r["lang"], r["source"]) for r in df.collect()]
    got = sorted(tuple(r[c] for c in ("lang", "source", "part", "item", "value", "rank")) for r in queries.op12_source_divergence(spark, sf_dir).collect())
    assert got == plain_audit(rows, 30, 50) and {r[2] for r in got} == {"pair", "term"}


def test_terms_of_long_texts(monkeypatch):
    texts = ["Aa bé " * 9 + "x" * 40 + " end", None, "", "z" * 100, "1 2", "日本 " * 12]
    want = [Counter(TERM.findall((t or "").translate(LOWER))) for t in texts]
    for read in (1 << 20, 16, 7):
        monkeypatch.setattr(divergence, "READ", read)
        got = [Counter() for _ in texts]
        for first, terms, row, code, count in divergence.term_counts(pa.array(texts)):
            for r, c, n in zip(row.tolist(), code.tolist(), count.tolist(), strict=True):
                assert terms[c].as_py() not in got[first + r]  # a document's terms come once
                got[first + r][terms[c].as_py()] = n
        assert got == want


def test_shares_are_exact():
    rng = np.random.default_rng(1)
    for top in (10, 10**6, 10**12, 9 * 10**15):
        whole = rng.integers(5, top, 200)
        count = (rng.random(200) * (whole - 5)).astype(np.int64)
        assert divergence.shares(count, whole).tolist() == [1 + 10**9 * (c + 5) // w for c, w in zip(count.tolist(), whole.tolist(), strict=True)]


def plain_trigrams(text):
    """(before, letter, after) of each letter in lower case, 0 for what is no letter."""
    low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in text or ""]
    low = [x if c.isalpha() else 0 for x, c in zip(low, text or "", strict=True)]
    return [(a, b, c) for a, b, c in zip([0, *low], low, [*low[1:], 0], strict=False) if b]


TEXTS = ["Hello, World", None, "", "12 3", "Été İx 日本語 \U0001f600a\U00010400b", "a", "one" * 30, "ß" * 33 + " " * 9 + "q"]


@pytest.mark.parametrize("read", [1 << 19, 64, 9])
def test_letters_with_their_neighbours(monkeypatch, read):
    monkeypatch.setattr(language, "READ", read)
    got = defaultdict(list)
    for row, around in language.symbols(pa.array(TEXTS)):
        gram, code = language.distinct(around)
        assert (np.diff(gram.astype(object)) > 0).all()
        for r, g, key in zip(row.tolist(), around.T.tolist(), gram[code].tolist(), strict=True):
            got[r].append(tuple(g))
            assert key == (g[0] << 42) + (g[1] << 21) + g[2]
    assert [got[k] for k in range(len(TEXTS))] == [plain_trigrams(t) for t in TEXTS]


def test_bad_bytes_are_no_error():
    column = pa.Array.from_buffers(pa.string(), 2, [None, pa.py_buffer(np.array([0, 4, 9], np.int32)), pa.py_buffer(b"\xff\xc3ab\xf7\xbf\xbf\xbfz")])
    assert sum(len(row) for row, _ in language.symbols(column)) >= 2


def test_bound_vectors():
    """A letter's vector is rotated by its place; products of rotations are nearly orthogonal."""
    grams = np.array([(97 << 42) + (98 << 21) + 99, (98 << 42) + (97 << 21) + 99, (97 << 21)], np.uint64)
    v = language.bind(grams, 13).astype(int)
    a, b, c, end = language.letter_vectors(np.array([97, 98, 99, 0]), 13).astype(int)
    assert (v[0] == a * np.roll(b, 1) * np.roll(c, 2)).all() and (v[2] == end * np.roll(a, 1) * np.roll(end, 2)).all()
    assert set(np.unique(v)) == {-1, 1} and abs(v[0] @ v[1]) < 6 * language.SIZE**0.5


def plain_prediction(rows, seed=13):
    """Vectors of texts, built one n-gram after the other, and their cosines."""
    vector = lambda t: sum(language.bind(np.array([(a << 42) + (b << 21) + c], np.uint64), seed)[0].astype(np.int64) for a, b, c in plain_trigrams(t))
    sums = defaultdict(int)
    for i, text, lang in rows:
        if zlib.crc32(str("" if i is None else i).encode()) % 4 != 2 and lang is not None and plain_trigrams(text):
            sums[lang] = sums[lang] + vector(text)
    out = []
    for i, text, _ in rows:
        held = zlib.crc32(str("" if i is None else i).encode()) % 4 == 2
        if not plain_trigrams(text) or not sums:
            out.append((i, held, "und", 0.0))
            continue
        own = vector(text)
        cosine = {x: float(own @ p / np.sqrt(float(own @ own) * float(p @ p))) for x, p in sums.items()}
        best = min(cosine, key=lambda x: (-cosine[x], x.encode()))
        out.append((i, held, best, max(cosine[best], 0) / (sum(max(x, 0) for x in cosine.values()) or 1)))
    return out


def test_predictions_are_those_of_cosines_of_whole_vectors(spark, odd_docs, monkeypatch):
    more = [(50 + k, t, x, "s", 1, "z") for k, (t, x) in enumerate([("the dog and the cat", "en"), ("der Hund und die Katze", "de"), ("ein Text", ""), ("xq zz", None), ("12", "en"), ("le chien et le chat", "fr")] * 3)]
    df = odd_docs.unionByName(spark.createDataFrame(more, odd_docs.schema)).repartition(3)
    monkeypatch.setattr(language, "HELD", 8)
    model = language.train(df)
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in df.collect()]
    want = plain_prediction(rows)
    got = language.identify(df, model).select("doc_id", language.in_fold("doc_id", (4, 2)).alias("held_out"), "lang_pred", "score", "n_words").collect()
    key = lambda r: (str(r[0]), r[1], r[2], round(r[3], 5))
    assert sorted(map(key, got)) == sorted(map(key, want)) and len({r[2] for r in want}) > 4
    again = language.identify(df.coalesce(1), language.train(df.coalesce(1))).collect()
    assert sorted((str(r["doc_id"]), r["score"]) for r in again) == sorted((str(r[0]), r[3]) for r in got)


def test_nothing_learned_and_no_rows(odd_docs, no_docs):
    model = language.train(no_docs)
    assert model.languages == [] and {(r["lang_pred"], r["score"]) for r in language.identify(odd_docs, model).collect()} == {("und", 0.0)}
    assert language.identify(no_docs, language.train(odd_docs)).count() == 0
    assert language.identify(odd_docs, language.train(odd_docs.where("lang = 'fr'"))).where("lang_pred = 'fr' AND score = 1").count() > 0


def test_held_out_accuracy(spark, sf_dir):
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    held = [r for r in queries.op13_language_id(spark, sf_dir).collect() if r["held_out"] and lang[r["doc_id"]]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.99 * len(held) > 30


def test_spans_of_letters():
    data = np.frombuffer(b"ab 1cd|ef", np.uint8)
    starts, ends, n = kernel.word_spans(data, np.array([0, 5, 9]), divergence._OUTSIDE)
    assert (starts.tolist(), ends.tolist(), n.tolist()) == ([0, 4, 5, 7], [2, 5, 6, 9], [2, 2])
