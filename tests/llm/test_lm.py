import re
import zlib
from collections import Counter, defaultdict
from math import isclose, log10

import pytest

from rillmark.llm import lm, queries

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    docs = []
    for i, t in rows:
        trains = zlib.crc32(str("" if i is None else i).encode()) % 7 != 2
        docs.append((i, trains, [*WORDS.findall((t or "").translate(LOWER)), None]))
    c, pairs = Counter(), Counter()
    for _, trains, words in docs:
        if trains:
            c.update(words)
            pairs.update(zip(words, words[1:], strict=False))
    followers = Counter(h for h, _ in pairs)
    n, v = sum(c.values()), len(c)
    once, twice = sum(x == 1 for x in pairs.values()), sum(x == 2 for x in pairs.values())
    d = min(max(once / (once + 2 * twice) if once else 0.5, 0.01), 0.99)
    p1 = lambda w: (c[w] + 1) / (n + v + 1)
    out = defaultdict(list)
    for i, trains, words in docs:
        total, h = 0.0, None
        for k, w in enumerate(words):
            p = p1(w)
            if k and followers[h]:
                p = (max(pairs[h, w] - d, 0) + d * followers[h] * p) / c[h]
            total, h = total + log10(p), w
        out[i].append((not trains, len(words), sum(c[w] > 0 for w in words), n, sum(log10(p1(w)) for w in words), total))
    return out


def same(df, want):
    got = defaultdict(list)
    for r in df.collect():
        got[r["doc_id"]].append(tuple(r)[1:])
    assert got.keys() == want.keys()
    for i in want:
        for a, b in zip(sorted(got[i]), sorted(want[i]), strict=True):
            assert a[:4] == b[:4] and isclose(a[4], b[4], rel_tol=1e-9) and isclose(a[5], b[5], rel_tol=1e-9), (i, a, b)


@pytest.mark.parametrize(("small", "hops"), [(False, 1), (True, 1), (True, 2)])
def test_against_brute_force(spark, sf_dir, monkeypatch, small, hops):
    if small:
        monkeypatch.setattr(lm, "PART_PAIRS", 5000)
        pack = lm.blocks.pack
        monkeypatch.setattr(lm.blocks, "pack", lambda *a: pack(*a, most=50_000))
    if hops == 2:
        monkeypatch.setattr(lm.blocks, "DIRECT_MESSAGES", 0)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute(docs)
    same(queries.op2_lm_scoring(spark, sf_dir), want)
    held = [r[0] for r in want.values() if r[0][0]]
    assert sum(r[5] for r in held) > sum(r[4] for r in held)


def test_odd_documents(odd_docs, no_docs):
    same(lm.score(odd_docs), brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()]))
    assert lm.score(no_docs).collect() == []


def test_probabilities_sum_to_one():
    import numpy as np

    # one state h=0 with c(h)=3, followers {1: 2, 2: 1}; the unknown word has code 3
    c, n, v, d, t = np.array([3, 2, 1, 0]), 6, 3, 0.5, 2
    p1 = (c + 1) / (n + v + 1)
    arcs = np.log10((np.array([2, 1]) - d + d * t * p1[[1, 2]]) / 3)
    model = lm.BackoffAutomaton(np.log10(p1), np.log10(np.array([d * t / 3])), np.array([1, 2]), arcs)
    assert isclose(p1.sum(), 1.0)
    follow = [10 ** model.walk(np.array([0, w]), np.array([True, False]))[1] for w in range(4)]
    assert isclose(sum(follow), 1.0)
