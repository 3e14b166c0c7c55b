import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rillmark.llm import ann, mixing, packing, quality, queries, sharding, spotsigs, token_counts, tokens
from rillmark.llm.common import tokenizer_path

WORDS = re.compile("[^\x20\x09-\x0d]+")
BPE = tokenizer_path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE)


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]


def test_ids_are_the_librarys(library):
    rng = np.random.default_rng(1)
    letters = "ab'srtvelmd  \n\t1 é!😀日½　-'"
    texts = ["", " ", "it's we're I'LL 'tis ''s 's", "<|endoftext|> x <|endoftext|>", "a\x85b\x00\x7f", "'s't 'llama end 's"]
    texts += ["".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(0, 40))) for _ in range(2000)]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    held = tokens.PreTokenDictionary(BPE)
    assert [x.tolist() for _, x in held.id_rows(pa.array(texts))] == want
    tokens.CACHE_ENTRIES, kept = 50, tokens.CACHE_ENTRIES
    try:
        assert [x.tolist() for _, x in held.id_rows(pa.array(texts))] == want
    finally:
        tokens.CACHE_ENTRIES = kept


def test_token_counts(spark, sf_dir, docs, library, odd_docs, no_docs, monkeypatch):
    got = {r["doc_id"]: tuple(r)[1:] for r in queries.op8_token_counts(spark, sf_dir).collect()}
    for i, t, _ in docs:
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert got[i] == (len(t.encode()), n, n > 1024)
    monkeypatch.setattr(token_counts, "PART_PRETOKENS", 1000)
    pack = token_counts.blocks.pack
    monkeypatch.setattr(token_counts.blocks, "pack", lambda *a, **b: pack(*a, **b, most=40_000))
    for hops in (1, 2):  # many blocks and parts
        if hops == 2:
            monkeypatch.setattr(token_counts.blocks, "DIRECT_MESSAGES", 0)
        assert {r["doc_id"]: tuple(r)[1:] for r in queries.op8_token_counts(spark, sf_dir).collect()} == got
    odd = token_counts.token_counts(odd_docs, BPE).collect()
    assert Counter((r["doc_id"], r["n_tokens"]) for r in odd) == Counter((r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert len(odd) == odd_docs.count() and {r["doc_id"]: r["n_tokens"] for r in odd}[4] == 0
    assert token_counts.token_counts(no_docs, BPE).collect() == []


def check_packing(rows, texts, library, capacity):
    by_seq = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
        by_doc[r["doc_id"]].append(r)
    for spans in by_seq.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= capacity
    total = 0
    for i, t in texts:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        total += len(ids)
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["piece"]):
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]])
            assert len(ids) <= capacity or r["piece"] == 0 or r["length"] == capacity
            at += r["length"]
        assert at == len(ids)
    return len(by_seq), -(-total // capacity)


def test_packing(spark, sf_dir, docs, library, odd_docs, no_docs):
    got, bound = check_packing(queries.op1_best_fit_packing(spark, sf_dir).collect(), [(i, t) for i, t, _ in docs], library, 1024)
    assert got <= 1.02 * bound + 1
    unique = odd_docs.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    check_packing(packing.best_fit_pack(unique, BPE).collect(), [(r["doc_id"], r["text"]) for r in unique.collect()], library, 1024)
    assert packing.best_fit_pack(odd_docs, BPE).where("piece = 0").count() == odd_docs.count()
    assert packing.best_fit_pack(no_docs, BPE).collect() == []


@pytest.mark.parametrize("seed", range(5))
def test_histogram_packs_as_one_by_one(seed):
    rng = np.random.default_rng(seed)
    lengths = sorted(rng.integers(1, 101, 400).tolist(), reverse=True)
    rooms = []
    for n in lengths:  # best fit decreasing, piece by piece
        fits = [k for k, r in enumerate(rooms) if r >= n]
        k = min(fits, key=lambda k: rooms[k]) if fits else len(rooms)
        if k == len(rooms):
            rooms.append(100)
        rooms[k] -= n
    plan, sequences = packing.pack_histogram(dict(Counter(lengths)), 100)
    used = Counter()
    for length, _rank, n, first, _offset in plan:
        for s in range(first, first + n):
            used[s] += length
    assert sequences == len(rooms) and sorted(100 - v for v in used.values()) == sorted(rooms)
    assert Counter({length: sum(n for x, _, n, _, _ in plan if x == length) for length in set(lengths)}) == Counter(lengths)


def test_capacity_tree():
    tree = packing.CapacityTree(10)
    for c in (3, 7):
        tree.mark(c, True)
    assert [tree.tightest(k) for k in range(11)] == [3, 3, 3, 3, 7, 7, 7, 7, None, None, None]


def test_sharding(spark, sf_dir, docs, odd_docs, no_docs):
    for rows, texts in ((queries.op3_sharding(spark, sf_dir).collect(), {i: t for i, t, _ in docs}), (sharding.shard(odd_docs).collect(), None)):
        slots, load, where = defaultdict(list), Counter(), defaultdict(set)
        for r in rows:
            assert r["law"] == "bytes" and 0 <= r["shard"] < 8 and r["grown_shard"] is None
            slots[r["shard"]].append(r["slot"])
            load[r["shard"]] += r["size"]
            where[r["text_crc32"], r["size"]].add(r["shard"])
            if texts:
                t = (texts[r["doc_id"]] or "").encode()
                assert (r["size"], r["text_crc32"]) == (len(t) + 1, zlib.crc32(t))
        assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and all(len(v) == 1 for v in where.values())
        if texts:
            assert max(load.values()) < 1.02 * min(load.values())
    assert sharding.shard(no_docs).collect() == []


def test_best_fit_holds_capacity():
    sizes = np.random.default_rng(3).integers(1, 1000, 500).tolist()
    load = Counter()
    plan = sharding.best_fit(dict(Counter(sizes)), 8)
    for size, _rank, n, s in plan:
        load[s] += size * n
    assert max(load.values()) <= 1.001 * sum(sizes) / 8 + 1
    capacity = max(load.values())
    rooms, want = [capacity] * 8, Counter()
    for size in sorted(sizes, reverse=True):  # best fit decreasing, item by item, under the same capacity
        k = min((k for k in range(8) if rooms[k] >= size), key=lambda k: (rooms[k], k))
        rooms[k] -= size
        want[k, size] += 1
    got = Counter()
    for size, _rank, n, s in plan:
        got[s, size] += n
    by_shard = lambda c: sorted(sorted((size, n) for (s, size), n in c.items() if s == k) for k in range(8))
    assert by_shard(got) == by_shard(want)
    ranks = defaultdict(list)
    for size, rank, n, _ in plan:
        ranks[size] += range(rank, rank + n)
    assert all(sorted(r) == list(range(Counter(sizes)[size])) for size, r in ranks.items())


def test_mixing(spark, sf_dir, docs, odd_docs, no_docs):
    rows = queries.op9_mixing(spark, sf_dir).collect()
    size = {i: len(WORDS.findall(t or "")) for i, t, _ in docs}
    source = {i: s for i, _, s in docs}
    taken, goal, most = Counter(), {}, Counter()
    for r in rows:
        s = source[r["doc_id"]]
        assert r["size"] == size[r["doc_id"]] and r["taken"] in (0, r["size"], 2 * r["size"], 3 * r["size"])
        taken[s] += r["taken"]
        goal[s] = r["target"]
        most[s] = max(most[s], r["size"])
        assert r["target"] <= 3 * r["source_size"] + 1e-6
    assert abs(sum(goal.values()) - sum(size.values())) < 1e-3 * sum(size.values())
    assert all(abs(taken[s] - goal[s]) <= most[s] for s in goal)
    assert sorted(rows) == sorted(queries.op9_mixing(spark, sf_dir).collect())
    assert mixing.mix(odd_docs).count() == odd_docs.count() and mixing.mix(no_docs).collect() == []


def test_mixing_alike_rows_and_clashing_columns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 16)
    docs = spark.createDataFrame([(None, "a", "w w w w", 1, 2)] * 300 + [(k, "b", "w " * 6, 3, 4) for k in range(100)], "doc_id long, source string, text string, _id int, _copies int")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 400 and {r["size"] for r in rows} == {4, 6}
    for s in "ab":
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 6
    taken = mixing.take(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in rows)
    assert {tuple(r)[3:] for r in taken.collect()} == {(1, 2), (3, 4)}


def test_chunks_land_together(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 16)
    docs = spark.createDataFrame([(k, "a", "w " * (1 + k * 7 % 50)) for k in range(400)] + [(k, "b", "w " * 30) for k in range(400, 500)], "doc_id long, source string, text string")
    rows = mixing.mix(docs).collect()
    assert len(rows) == 500
    for s in "ab":
        own = [r for r in rows if r["source"] == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 50


def test_targets_are_shared_again(spark):
    of = lambda rows: {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size long"), (1, 2, 3), 3.0).collect()}
    goal = of([("b", 10), ("a", 1000), (None, 990)])
    assert of([]) == {} and of([("a", 0), ("b", 0)]) == {"a": 0, "b": 0}
    sizes = np.random.default_rng(8).integers(0, 400, 200).tolist()
    sizes[50] = 90_000
    names = [f"s{k:03}" for k in range(200)]
    shares = of(list(zip(names, sizes, strict=True)))
    want, left, free = {}, float(sum(sizes)), set(range(200))
    while True:  # share again until none is above
        unit = left / sum(1 + k % 3 for k in free)
        over = [k for k in free if unit * (1 + k % 3) > 3 * sizes[k]]
        if not over:
            break
        want |= {k: 3.0 * sizes[k] for k in over}
        left -= sum(3.0 * sizes[k] for k in over)
        free -= set(over)
    want |= {k: unit * (1 + k % 3) for k in free}
    assert all(abs(shares[n] - want[k]) < 1e-6 for k, n in enumerate(names))
    assert goal["b"] == 30 and abs(goal["a"] + goal[None] - 1970) < 1e-9 and abs(goal[None] / goal["a"] - 3) < 1e-9


def test_flight_keeps_totals():
    rng = np.random.default_rng(2)
    p, size = np.full(300, 0.37), rng.integers(1, 900, 300)
    out = mixing.fly(p, size, rng)
    assert ((out > 1e-9) & (out < 1 - 1e-9)).sum() <= 2
    assert abs(out.sum() - p.sum()) < 1e-6 and abs((out * size).sum() - (p * size).sum()) < 1e-3


def test_nearest(spark, sf_dir):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = table.select("vec_id", "embedding").collect()
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    got = defaultdict(list)
    for r in queries.op5_nearest_neighbours(spark, "/root/testdata/sf0.1").collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert set(got) == {int(i) for i in ids if i % 50 == 0}
    for q in got:
        k = int(np.flatnonzero(ids == q)[0])
        cos = unit @ unit[k]
        cos[k] = -9
        best = set(ids[np.argsort(-cos)[:5]].tolist())
        answer = sorted(got[q])
        assert [a[0] for a in answer] == [1, 2, 3, 4, 5]
        assert all(abs(s - cos[np.flatnonzero(ids == v)[0]]) < 1e-12 for _, v, s in answer)
        hit, total = hit + len(best & {v for _, v, _ in answer}), total + 5
    assert hit / total >= 0.9


def test_nearest_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (50, [1.0, 0.0]), (None, [1.0, 1.0]), (7, [1.0, 2.0, 3.0]), (1, [1.0, 0.1]), (100, [3.0, 2.0, 1.0]), (50, [0.0, 1.0])]
    got = ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()
    # rows that share an id are rows of their own; other dimensions meet among themselves
    want = [(0, 1, 50), (0, 2, 1), (0, 3, 1), (0, 4, 50), (50, 1, 0), (50, 1, 1), (50, 2, 1), (50, 2, 1), (50, 3, 0), (50, 3, 1), (50, 4, 50), (50, 4, 50), (100, 1, 7)]
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == want
    assert ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>").where("false")).collect() == []


def test_probe_retrieves_the_whole_ball():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    codes = ann.learn(x)
    codes.reach = 2
    words = codes.of(x)
    index = ann.MultiIndex(codes, words)
    apart = np.bitwise_count(words[:40, None] ^ words[None])
    found = index.probe(words[:40])
    assert (found == (apart.min(axis=2) <= 2)).all() and (found >= (apart.sum(axis=2) <= codes.radius)).all() and not found.all()
    codes.limit = 60
    query, row, held = index.candidates(words[:40], 7)
    assert (held >= found.sum(axis=1)).all() and (np.bincount(query, minlength=40) >= 7).all()


def test_blocks_of_the_index_find_what_one_finds(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = rng.standard_normal((700, 8))
    table = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    monkeypatch.setattr(ann, "BLOCK_BYTES", 8000)
    got = ann.nearest(table, every=5).collect()
    hit = 0
    for q in range(0, 700, 5):
        cos = unit @ unit[q]
        cos[q] = -9
        hit += len({r["vec_id"] for r in got if r["query_id"] == q} & set(np.argsort(-cos)[:5].tolist()))
    assert len(got) == 700 and hit / 700 >= 0.9


def test_quality(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    rows = queries.op6_quality_classifier(spark, sf).collect()
    label = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect()}
    assert len(rows) == 1000 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    held = [(label[r["doc_id"]], r["predicted"]) for r in rows if r["held_out"] and r["doc_id"] in label]
    assert sum(a == b for a, b in held) / len(held) > 0.95
    labels = spark.createDataFrame([(1, 1), (9, 0), (5, 1), (None, 0), (7, None)], "doc_id long, quality int")
    model = quality.train(odd_docs, labels)
    assert quality.classify(odd_docs, model).count() == odd_docs.count()
    assert quality.classify(no_docs, quality.train(no_docs, labels)).collect() == []


def test_hinge_loss_model_is_the_least():
    """Against projected gradient steps on the same dual problem."""
    rng = np.random.default_rng(7)
    label = rng.integers(0, 2, 40)
    rows = [np.unique(np.append(rng.integers(0, 60, 12), 70 + y)) if rng.random() < 0.7 else np.unique(rng.integers(0, 60, 12)) for y in label]
    scale = np.zeros(quality.COLUMNS)
    scale[:100] = rng.normal(0, 1, 100)
    w, bias = quality.dual_coordinate_descent(rows, scale, label, 1.0, 5000, 0)
    x = np.zeros((40, 101))
    for k, r in enumerate(rows):
        x[k, r], x[k, 100] = scale[r] / np.sqrt(len(r)), 1
    y = np.where(label == 1, 1.0, -1.0)
    upper = np.where(label == 1, 40 / (2 * (label == 1).sum()), 40 / (2 * (label == 0).sum()))
    gram = (y[:, None] * x) @ (y[:, None] * x).T
    alpha, step = np.zeros(40), 1 / np.linalg.eigvalsh(gram).max()
    for _ in range(100_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, upper)
    want = (alpha * y) @ x
    assert np.abs(w[:100] - want[:100]).max() < 0.02 and abs(bias - want[100]) < 0.02


def test_features_travel_whole():
    for feature in (np.array([], np.int64), np.array([0, 5, quality.COLUMNS - 1]), np.arange(0, quality.COLUMNS, 3)):
        assert quality._from_bytes(quality._to_bytes(feature)).tolist() == feature.tolist() and len(quality._to_bytes(feature)) <= 1 + quality.COLUMNS // 8


def test_hinge_loss_model_separates():
    rng = np.random.default_rng(0)
    rows = [np.unique(np.append(rng.integers(10, 200, 20), y)) for y in (0, 1) * 50]
    label = np.array([0, 1] * 50)
    w, bias = quality.dual_coordinate_descent(rows, np.ones(quality.COLUMNS), label, 1.0, 50, 0)
    assert all((w[r].sum() / np.sqrt(len(r)) + bias > 0) == y for r, y in zip(rows, label, strict=True))


def test_fingerprints(spark, sf_dir, docs, odd_docs, no_docs):
    import hashlib

    got = {r["doc_id"]: r for r in queries.op10_spotsigs_fingerprints(spark, sf_dir).collect()}
    order = sorted(docs, key=lambda d: -d[0])
    prints = {}
    for k, (i, t, _) in enumerate(order):
        following = order[(k + 1) % len(order)]
        half = len(t) // 2
        edited = t[: len(t) - half] + following[1][:half]
        r = got[i]
        assert r["n_chars"] == len(t) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = (set(re.findall("........", x)) for x in (r["fingerprint"], r["edited_fingerprint"], got[following[0]]["fingerprint"]))
        near = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        assert abs(r["near_edited"] - near(a, b)) < 1e-12 and abs(r["near_next"] - near(a, c)) < 1e-12
        assert prints.setdefault(t, r["fingerprint"]) == r["fingerprint"]
    assert len(set(prints.values())) > 0.95 * len(prints)
    assert spotsigs.compare_with_edited(odd_docs).count() == odd_docs.count()
    assert spotsigs.compare_with_edited(no_docs).collect() == []
    one = spotsigs.compare_with_edited(odd_docs.where("doc_id = 7")).first()
    assert one["near_next"] == 1.0


def extracted(text):
    """(anchor and content word, second content word) chains of a text, read word by word."""
    words = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    anchors, out, k = set(spotsigs.ANCHORS), [], 0
    while k < len(words):
        j = k
        while j < len(words) and words[j] in anchors:
            j += 1
        if j == k:
            out.append(words[k])
        elif j < len(words):
            out.append(f"{words[k]}^{words[j]}")
        else:
            out += words[k:]
        k = j + 1
    if out and "^" not in out[0]:
        out[0] = "^" + out[0]
    last = {tuple(out[-2:])} if len(out) > 1 and "^" not in out[-2] + out[-1] else set()
    return last | {(t, (out[k + 1] if k + 1 < len(out) else t).split("^")[-1]) for k, t in enumerate(out) if "^" in t}


def test_the_end_of_a_text_is_signed(spark):
    """A list's last half shows in its fingerprint; texts of one word or none have no more than that."""
    texts = ["alpha beta gamma delta", "alpha beta gamma omega", "alpha", " , ", "alpha beta of gamma", "alpha beta gamma of"]
    rows = spotsigs.fingerprints(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")).collect()
    got = [set(r["signatures"]) for r in sorted(rows, key=lambda r: r["doc_id"])]
    assert [len(s) for s in got] == [2, 2, 1, 0, 2, 2]
    assert len(got[0] & got[1]) == 1 and len(got[0] & got[5]) == 1


def test_signatures_against_a_reading_word_by_word(spark, docs):
    chains = {t: extracted(t) for _, t, _ in docs}
    flat = sorted({c for s in chains.values() for c in s})
    names = {(r[0], r[1]): r[2] for r in spark.createDataFrame(flat, "a string, b string").selectExpr("a", "b", "hash(a, b)").collect()}
    rows = spotsigs.fingerprints(spark.createDataFrame([(t,) for t in chains], "text string").selectExpr("0 AS doc_id", "text"), text_col="text")
    got = Counter(tuple(r["signatures"]) for r in rows.collect())
    assert got == Counter(tuple(sorted({names[c] for c in s})) for s in chains.values())


def test_fingerprints_of_frequent_ids(spark, monkeypatch):
    """Null ids, one id on a third of all rows, and rows alike, over many ranges."""
    import hashlib

    monkeypatch.setattr(spotsigs, "RANGE_BYTES", 300)
    rows = [(k, f"the cat {k} sat on a mat {k * 7}") for k in range(60)] + [(None, f"la casa {k} es de mi {k}") for k in range(30)] + [(33, f"der hund {k} ist im haus {k}") for k in range(40)] + [(61, "the same dog of mine")] * 5
    got = spotsigs.compare_with_edited(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    hashed = spark.createDataFrame([(t,) for _, t in rows], "text string").distinct().selectExpr("text", "shiftrightunsigned(xxhash64(text), 1)").collect()
    h = {r[0]: r[1] for r in hashed}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), -h[r[1]]))
    want = Counter()
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        half = len(t) // 2
        want[i, hashlib.sha256((t[: len(t) - half] + after[:half]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in got) == want


def test_similar_pairs(spark, sf_dir):
    prints = spotsigs.fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet")).cache()
    sets = {r["fingerprint"]: set(r["signatures"]) for r in prints.collect() if r["signatures"]}
    name = {r[0]: r[1] for r in prints.selectExpr("xxhash64(fingerprint)", "fingerprint").collect()}
    want = {frozenset((a, b)) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    got = [frozenset((name[r["a"]], name[r["b"]])) for r in spotsigs.similar_pairs(prints).collect()]
    assert want and set(got) == want and len(got) == len(set(got))
