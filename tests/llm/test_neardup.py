import random
import re

import pytest
from pyspark.sql import functions as F

from rillmark.llm import neardup, queries

WORDS = re.compile("[^\x20\x09-\x0d]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, width):
    sets = []
    for i, t in rows:
        w = WORDS.findall((t or "").translate(LOWER))
        sets.append((i, {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()))
    parent = list(range(len(sets)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for x in range(len(sets)):
        for y in range(x):
            (i, a), (j, b) = sets[x], sets[y]
            if i is not None and j is not None and a and b and min(len(a), len(b)) * 100 >= 80 * max(len(a), len(b)) and 100 * len(a & b) >= 80 * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, _) in enumerate(sets):
        if i is not None:
            least[root(x)] = min(least.get(root(x), i), i)
    return sorted(((i, len(s), None if i is None else least[root(x)], i is None or least[root(x)] == i) for x, (i, s) in enumerate(sets)), key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_against_brute_force(spark, sf):
    docs = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").collect()]
    want = brute(docs, 4)
    assert not all(r[3] for r in want)
    assert as_rows(queries.op4_minhash_near_dedup(spark, f"/root/testdata/{sf}")) == want


def test_odd_documents(odd_docs, no_docs):
    for width in (4, 5):
        assert as_rows(neardup.near_duplicates(odd_docs, width=width).drop("text_hash")) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], width)
    assert neardup.near_duplicates(no_docs).collect() == []


def test_chains_and_groups(spark):
    """A chain whose ends are unlike, and a group whose smallest member is not its centre."""
    words = [f"w{k}" for k in range(400)]
    rows = [(100 - s, " ".join(words[s * 8 : s * 8 + 120])) for s in range(20)]
    base = [f"v{k}" for k in range(200)]
    for g in range(12):
        cut = list(base)
        for k in range(4):
            cut[(g * 16 + k * 4) % 200] = f"x{g}{k}"
        rows.append((200 + g, " ".join(cut)))
    got = as_rows(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).drop("text_hash"))
    assert got == brute(rows, 4)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 102), (101, 102)], "a long, b long")
    got = {r["cls"]: r["label"] for r in neardup.components(links).collect()}
    assert all(got.get(k, 0) == 0 for k in range(41)) and got[101] == got[102] == 100


def test_components_against_union_find(spark):
    """Zigzags, where a class is led to two that lead no further, and random links."""
    rng = random.Random(5)
    cases = [[(10, 1), (10, 3), (11, 3), (11, 0)], [(20 + k // 2, (k + 1) // 2) for k in range(14)]]
    for n in (6, 12, 24):
        links = [(a, b) for a, b in ((rng.randrange(n), rng.randrange(n)) for _ in range(n)) if a != b]
        cases.append(links)
    for links in cases:
        least = {k: k for pair in links for k in pair}
        for _ in least:
            for a, b in links:
                least[a] = least[b] = min(least[a], least[b])
        got = [(r["cls"], r["label"]) for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()]
        assert len(got) == len(dict(got)) and {k: dict(got).get(k, k) for k in least} == least


@pytest.mark.parametrize(("salt", "near"), [(1 << 16, 1 << 20), (5, 0)])
def test_tiles_find_links_across_components(spark, monkeypatch, salt, near):
    """Copies around one original, of which some are alike only to each other; with centres salted, and
    candidates' ids joined by a shuffle."""
    monkeypatch.setattr(neardup, "TILE_ROWS", 4)
    monkeypatch.setattr(neardup, "SALT_ROWS", salt)
    monkeypatch.setattr(neardup, "NEAR_IDS", near)
    base = [f"v{k}" for k in range(160)]
    rows = [(1, " ".join(base))]
    for g in range(24):
        cut = list(base)
        for k in range(3 + g % 5):
            cut[(g // 3 * 29 + k * 17) % 160] = f"x{g // 3}{k}"
        rows.append((2 + g, " ".join(cut + [f"tail{g}"])))
    got = as_rows(neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=4).drop("text_hash"))
    assert got == brute(rows, 4) and len({r[2] for r in got}) > 1


def test_classes_that_share_a_name_are_told_apart(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(neardup, "CLASS_BITS", 4)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert as_rows(neardup.near_duplicates(docs, width=4).drop("text_hash")) == brute(rows, 4)


def test_one_of_each_keeps_clashing_columns(spark):
    rows = [(1, "a b c d e f", 9, 9, 9, 9), (2, "a b c d e f", 8, 8, 8, 8), (1, "a b c d e f", 9, 9, 9, 9), (None, "a b c d e f", 7, 7, 7, 7)]
    kept = neardup.keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string, _id long, _hash long, _k int, _row int"))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[0], rows[3]], key=str)


def test_few_ends_are_told_by_one_join(spark, monkeypatch):
    """The plan is small where links are few, and components are the same by either way."""
    pairs = [(a, b) for a in range(1, 60) for b in (a // 2, a % 7) if a != b] + [(k, 100) for k in range(101, 140)]
    links = spark.createDataFrame(pairs, "a long, b long")
    edges = links.selectExpr("a AS u", "b AS v")
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("v").alias("n"))
    few = neardup._told_least(edges, least, len(pairs))
    plan = few._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join ") == 1 and "Union" not in plan
    rows, labels = sorted(map(tuple, few.collect())), sorted(map(tuple, neardup.components(links).collect()))
    monkeypatch.setattr(neardup, "FEW_ENDS", 0)
    assert rows == sorted(map(tuple, neardup._told_least(edges, least, len(pairs)).collect()))
    assert labels == sorted(map(tuple, neardup.components(links).collect()))
    assert dict(labels) == {k: 0 for k in range(1, 60)} | {k: 100 for k in range(101, 140)}
