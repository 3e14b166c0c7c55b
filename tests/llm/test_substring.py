import hashlib
import re

import numpy as np
import pytest

from rillmark.llm import queries, substring

WORDS = re.compile("[^\x20\x09-\x0d]+")


def brute(rows, width=13):
    docs = [(i, WORDS.findall(t or "")) for i, t in rows]
    least = {}
    for i, words in docs:
        for k in range(len(words) - width + 1):
            w = tuple(words[k : k + width])
            j = float("inf") if i is None else i
            least[w] = min(least.get(w, j), j)
    out = []
    for i, words in docs:
        gone = set()
        for k in range(len(words) - width + 1):
            if least[tuple(words[k : k + width])] < (float("inf") if i is None else i):
                gone.update(range(k, k + width))
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        out.append((i, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize(("small", "hops"), [(False, 1), (True, 1), (True, 2)])
def test_against_brute_force(spark, sf_dir, monkeypatch, small, hops):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    if small:  # many blocks and parts
        monkeypatch.setattr(substring, "PART_SUFFIXES", 2000)
        monkeypatch.setattr(substring, "GROUP_SUFFIXES", 20)
        pack = substring.blocks.pack
        monkeypatch.setattr(substring.blocks, "pack", lambda *a: pack(*a, most=30_000))
    if hops == 2:
        monkeypatch.setattr(substring.blocks, "DIRECT_MESSAGES", 0)
    want = brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert any(r[2] for r in want)
    assert as_rows(queries.op7_substring_dedup(spark, sf_dir)) == want


def test_odd_documents(odd_docs, no_docs):
    want = brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()])
    assert as_rows(substring.remove_repeats(odd_docs, digest=True)) == want
    kept = substring.remove_repeats(odd_docs)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars", "n_words", "n_removed"]
    texts = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert texts[1].startswith("The cat") and texts[2] == "" and texts[3] == "and more words follow here" and texts[6] == "   \n\t " and texts[4] is None
    assert texts[10] == "prefix words"
    assert substring.remove_repeats(no_docs, digest=True).collect() == []


def test_runs_of_different_parts_stay_apart():
    prints, owner = np.array([5, 5, 5, 9, 5], np.uint64), np.array([1, 2, 1, 1, 2], np.int32)
    order, head = substring._nodes(prints, owner)
    node = np.empty(5, int)
    node[order] = np.cumsum(head) - 1
    assert node[0] == node[2] != node[1] == node[4] and len(set(node)) == 3


def test_rolling_hash_names_runs():
    from rillmark.llm import kernel

    words = kernel.mix64(np.arange(200_000, dtype=np.uint64))
    words[70_000:70_100] = words[1000:1100]
    prints, row, at = kernel.windows(words, np.array([100_000, 3, 99_997]), 13)
    assert len(prints) == 100_000 - 12 + 99_997 - 12 and (np.diff(row) >= 0).all()
    where = {int(a): int(p) for a, p in zip(at, prints, strict=True)}
    assert where[1000] == where[70_000] and where[1087] == where[70_087] and where[1088] != where[70_088]
    assert len(set(prints.tolist())) == len(prints) - 88
