import re
from collections import Counter

import pyarrow as pa
import pytest

import corpus_pipeline
from rillmark.llm import packing, quality
from rillmark.llm.common import tokenizer_path

WORDS = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """The input and what each stage returns at the smallest size."""
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), {}
    folder = tmp_path_factory.mktemp("pipeline")
    out["input"] = docs
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"{folder}/{name}")
    return out


def test_stages_return_documents(kept):
    columns = kept["input"].dtypes
    for name in ("quality", "near_dedup", "substring_dedup", "mix"):
        assert kept[name].dtypes == columns
    n = {k: v.count() for k, v in kept.items()}
    assert n["input"] > n["quality"] > n["near_dedup"] == n["substring_dedup"]


def test_stages_against_brute_force(spark, kept):
    """What the first three stages keep, by the model on each text, union of all similar
    pairs, and all runs of fifty words."""
    docs = {r["doc_id"]: r["text"] for r in kept["input"].collect()}
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.train(kept["input"], labels)
    good = {i for i, s in zip(docs, model.scores(pa.array(list(docs.values()))), strict=True) if s >= 0.3}
    assert {r["doc_id"] for r in kept["quality"].collect()} == good
    words = {i: WORDS.findall("".join(c.lower() if c.isascii() else c for c in docs[i])) for i in good}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in words.items()}
    least = {i: i for i in good}

    def root(i):
        while least[i] != i:
            i = least[i]
        return i

    for a in sorted(good):
        for b in sorted(good):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                least[y] = x
    stays = {i for i in good if root(i) == i}
    assert {r["doc_id"] for r in kept["near_dedup"].collect()} == stays
    first, texts = {}, {}
    for i in sorted(stays):
        w = WORDS.findall(docs[i])
        gone = {k + j for k in range(len(w) - 49) if first.setdefault(tuple(w[k : k + 50]), i) < i for j in range(50)}
        texts[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else docs[i]
    assert {r["doc_id"]: r["text"] for r in kept["substring_dedup"].collect()} == texts


def test_no_near_copies_stay(kept):
    def sets(df):
        out = {}
        for r in df.collect():
            w = WORDS.findall(r["text"].lower())
            out[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}
        return out

    stays, before = sets(kept["near_dedup"]), sets(kept["quality"])
    like = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    ids = sorted(stays)
    assert not any(like(stays[a], stays[b]) for k, a in enumerate(ids) for b in ids[:k])
    for i in before.keys() - stays.keys():
        assert any(like(before[i], s) for j, s in before.items() if j < i)


def test_no_long_passage_repeats(kept):
    seen = {}
    for r in kept["substring_dedup"].orderBy("doc_id").collect():
        w = WORDS.findall(r["text"])
        assert r["n_chars"] == len(r["text"])
        for k in range(len(w) - 49):
            assert seen.setdefault(tuple(w[k : k + 50]), r["doc_id"]) == r["doc_id"]


def test_mix_and_pack(kept):
    copies = Counter(r["doc_id"] for r in kept["mix"].select("doc_id").collect())
    assert max(copies.values()) <= 3
    pieces = kept["pack"].collect()
    assert sum(r["piece"] == 0 for r in pieces) == sum(copies.values())
    spans = {}
    for r in pieces:
        spans.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for s in spans.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 1024


def test_run_gives_the_last_stage(spark, kept):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() == kept["pack"].count()


def test_odd_documents(spark, odd_docs, no_docs, tmp_path):
    labels = spark.createDataFrame([(1, 1, 0), (7, 1, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for start in (odd_docs, no_docs):
        docs = start
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            docs = stage(spark, docs, str(tmp_path))
            if name != "pack":
                assert docs.dtypes == start.dtypes
            folder = f"{tmp_path}/{start is odd_docs}-{k}"
            docs.write.parquet(folder)
            docs = spark.read.parquet(folder)
        if start is odd_docs:
            assert packing.best_fit_pack(odd_docs, tokenizer_path("byte_bpe_50k.json")).count() >= docs.count() > 0
        else:
            assert docs.count() == 0
