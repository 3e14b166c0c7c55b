"""Whole rows of the quality, sharding and mixing queries against plain versions."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rillmark.llm import kernel, mixing, quality, queries, sharding

SPACE = b" \t\n\x0b\x0c\r"


def mix(x):
    m = (1 << 64) - 1
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & m
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & m
    return x ^ (x >> 31)


def word_hash(word):
    return int(kernel.hash_spans(np.frombuffer(word, np.uint8), np.array([len(word)]))[0])


def plain_features(text):
    """Byte n-grams, words and runs of one word, one after the other."""
    b, out = (text or "").encode(), set()
    for order in quality.ORDERS:
        for k in range(len(b) - order + 1):
            out.add(mix(int.from_bytes(b[k : k + order], "big") + (order << 56)) % quality.COLUMNS)
    words = [w for w in b.translate(bytes.maketrans(SPACE, b" " * 6)).split(b" ") if w]
    out.update(word_hash(w) % quality.COLUMNS for w in words)
    for n in quality.REPEATS:
        if any(len(set(words[k : k + n])) == 1 for k in range(len(words) - n + 1)):
            out.add(mix(n) % quality.COLUMNS)
    return out


TEXTS = ["", None, "a", "buy buy buy buy now", "été  日本\n日本", "x " * 40, " \t", "one two one two"]


def test_features_of_a_plain_reading(spark, sf_dir, monkeypatch):
    texts = TEXTS + [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").limit(25).collect()]
    for most in (kernel.SLICE_BYTES, 64):
        monkeypatch.setattr(kernel, "SLICE_BYTES", most)
        got = defaultdict(list)
        for i, _, row, feature in quality.indicators(pa.array(texts)):
            for r, f in zip(row.tolist(), feature.tolist(), strict=True):
                got[i + r].append(f)
        assert all(len(set(x)) == len(x) for x in got.values())
        assert [set(got[k]) for k in range(len(texts))] == [plain_features(t) for t in texts]


def test_log_count_ratios_of_a_plain_count():
    rows, label = [np.array([1, 5]), np.array([5]), np.array([2]), np.array([1, 2])], np.array([1, 1, 0, 0])
    got = quality.log_count_ratios(rows, label)
    n = quality.COLUMNS
    p, q = {1: 1, 5: 2}, {2: 2, 1: 1}
    for f in (0, 1, 2, 5, n - 1):
        assert np.isclose(got[f], math.log((p.get(f, 0) + 1) / (n + 3)) - math.log((q.get(f, 0) + 1) / (n + 3)))


def test_quality_query_row_by_row(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), held_out=(5, 0))
    want = []
    for r in docs.collect():
        f = plain_features(r["text"])
        margin = model.bias + sum(model.weights[k] for k in f) / math.sqrt(max(len(f), 1))
        score = 1 / (1 + math.exp(-min(max(model.slope * margin + model.shift, -30), 30)))
        want.append((r["doc_id"], zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0, round(score, 6), int(score >= 0.3)))
    got = [(r["doc_id"], r["held_out"], round(r["score"], 6), r["predicted"]) for r in queries.op6_quality_classifier(spark, sf_dir).collect()]
    assert sorted(got) == sorted(want)


def plain_fit(sizes, capacity, shards):
    """Best-fit decreasing, one item after the other."""
    room, out = [capacity] * shards, []
    for size in sorted(sizes, reverse=True):
        fits = [(r, s) for s, r in enumerate(room) if r >= size]
        if not fits:
            return None
        s = min(fits)[1]
        room[s] -= size
        out.append((size, s))
    return Counter(out)


def test_sharding_query_as_a_whole(spark, sf_dir):
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op3_sharding(spark, sf_dir).collect()
    text = dict(docs)
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == sorted((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in docs)
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)
    groups = Counter(t for _, t in docs)
    shard = {}
    for r in rows:
        assert shard.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
    sizes = {t: n * (len(t.encode()) + 1) for t, n in groups.items()}
    capacity = max(sum(sizes[t] for t in sizes if shard[t] == s) for s in range(8))
    plan = Counter()
    for size, _, n, s in sharding.best_fit(dict(Counter(sizes.values())), 8):
        plan[size, s] += n
    assert Counter((sizes[t], shard[t]) for t in sizes) == plan
    # what stands in each shard is what one item after the other gives at that capacity
    loads = lambda c: sorted(sum(size * n for (size, s), n in c.items() if s == k) for k in range(8))
    assert loads(plain_fit(list(sizes.values()), capacity, 8)) == loads(plan)
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def plain_targets(size, weights, most):
    """Shares by weight; what is above a source's limit is dealt out again until none is."""
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    full: dict = {}
    while True:
        rest = [s for s in order if s not in full]
        left, unit = sum(size.values()) - sum(full.values()), sum(weight[s] for s in rest)
        share = {s: left * weight[s] / unit for s in rest}
        over = [s for s in rest if share[s] > most * size[s]]
        if not over:
            return full | share
        full |= {s: most * size[s] for s in over}


@pytest.mark.parametrize("rows", [None, [(1, "a b c", "x"), (2, None, "x"), (3, "w " * 50, None), (3, "w " * 50, None), (4, "p q", "y"), (None, "n n", "y")]])
def test_mixing_query_as_a_whole(spark, sf_dir, rows):
    """Targets by sharing again and again; each source flies and lands in one chunk here."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet") if rows is None else spark.createDataFrame(rows, "doc_id long, text string, source string")
    docs = [(r["doc_id"], len([w for w in (r["text"] or "").encode().translate(bytes.maketrans(SPACE, b" " * 6)).split(b" ") if w]), r["source"]) for r in df.collect()]
    size = Counter()
    for _, n, s in docs:
        size[s] += n
    target = plain_targets(size, (1, 2, 3), 3.0)
    got = mixing.mix(df).collect() if rows else queries.op9_mixing(spark, sf_dir).collect()
    if rows is None:
        source = {i: s for i, _, s in docs}
        assert sorted((r["doc_id"], r["size"], r["source_size"], round(r["target"], 4)) for r in got) == sorted((i, n, size[s], round(target[s], 4)) for i, n, s in docs)
    taken = defaultdict(int)
    for r in got:
        s = source[r["doc_id"]] if rows is None else r["source"]
        rate = target[s] / size[s] if size[s] else 0
        assert r["taken"] in {r["size"] * math.floor(rate + 1e-9), r["size"] * math.ceil(rate - 1e-9)} and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in size:  # what is left over is at most what two open documents make
        largest = sorted((n for _, n, x in docs if x == s), reverse=True)[:2]
        assert abs(taken[s] - target[s]) <= sum(largest) / 2 + 1e-6
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted((str(r["doc_id"]), r["taken"]) for r in again) == sorted((str(r["doc_id"]), r["taken"]) for r in got)
