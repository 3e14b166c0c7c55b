"""Token masks, ranks as partitions, votes and draws against plain readings."""

import sys
from collections import Counter
from itertools import product
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rillmark.functions import chat as H
from rillmark.operators import dispatch as D
from rillmark.operators import metrics as M
from rillmark.plans.q_text import byte_tokenizer

TALKS = [
    [("user", "Hello  there\n"), ("assistant", "Hi! été 日本 😀"), ("user", "ok"), ("assistant", "")],
    [("system", "Be brief."), ("user", "<|im_end|> x"), ("assistant", "y" * 300), ("tool", "{}"), ("assistant", None)],
    [("assistant", "first")], [], None, [("user", None)],
]


def plain(talk, template=None):
    """Each message with the system prompt in front of it, which is cut off again behind the first."""
    template, tok = template or H.Template(), H.tokenizer(byte_tokenizer())
    encode = lambda text: tok.encode(text, add_special_tokens=False).ids
    system = "" if template.system is None else template.before.format(role="system") + template.system + template.after
    ids, mask = [], []
    for k, (role, text) in enumerate(talk or []):
        one = template.before.format(role=role) + (text or "") + template.after
        own = encode(one) if role == "system" else encode(system) + encode(one)
        if k and role != "system":
            own = own[len(encode(system)) :]
        ids += own
        head = len(encode(template.before.format(role="assistant")))
        learned = len(encode(one)) - head if role == "assistant" else 0
        mask += [0] * (len(own) - learned) + [1] * learned
    return ids, mask


def talks(spark):
    rows = [(k, None if t is None else [{"role": r, "text": x} for r, x in t]) for k, t in enumerate(TALKS)]
    return spark.createDataFrame(rows, "id long, m array<struct<role string, text string>>").repartition(2)


@pytest.mark.parametrize("template", [None, H.Template(system=None), H.Template("[{role}] ", "\n")])
def test_masks_are_those_of_single_messages(spark, template):
    got = {r["id"]: r for r in H.loss_mask(talks(spark), "m", byte_tokenizer(), 10_000, pad="none", template=template).collect()}
    for k, talk in enumerate(TALKS):
        ids, mask = plain(talk, template)
        assert (got[k]["input_ids"], got[k]["loss_mask"]) == (ids, mask)
        assert got[k]["attention_mask"] == [1] * len(ids) and got[k]["position_ids"] == list(range(len(ids)))


def test_padding_and_truncation(spark):
    ids, mask = plain(TALKS[1])
    n = len(ids)
    one = talks(spark).where("id = 1")
    row = lambda **o: H.loss_mask(one, "m", byte_tokenizer(), **o).first()
    r = row(length=n + 3, pad_id=9)
    assert r["input_ids"] == [*ids, 9, 9, 9] and r["loss_mask"] == [*mask, 0, 0, 0] and r["attention_mask"] == [1] * n + [0] * 3 and r["position_ids"] == [*range(n), 0, 0, 0]
    r = row(length=7, truncation="left")
    assert r["input_ids"] == ids[-7:] and r["loss_mask"] == mask[-7:] and r["position_ids"] == list(range(n - 7, n))
    r = row(length=7, truncation="right")
    assert r["input_ids"] == ids[:7] and r["attention_mask"] == [1] * 7
    assert row(length=7, truncation="left", pad="none")["input_ids"] == ids[:7]
    with pytest.raises(Exception, match=f"a conversation of {n} tokens"):
        row(length=7)
    with pytest.raises(ValueError):
        row(length=7, pad="left")
    empty = H.loss_mask(talks(spark).where("id = 4"), "m", byte_tokenizer(), 2).first()
    assert empty["input_ids"] == [0, 0] and empty["attention_mask"] == [0, 0]


def test_prompts_within_a_number_of_tokens(spark):
    def size(talk):
        text = "".join(t for t, _ in H.Template().rendered([{"role": r, "text": x} for r, x in talk])) + "<|im_start|>assistant\n"
        return len(H.tokenizer(byte_tokenizer()).encode(text).ids)

    sizes = {k: size(t) for k, t in enumerate(TALKS) if t is not None}
    for most in (0, *sorted(sizes.values()), 10_000):
        assert {r["id"] for r in H.within_tokens(talks(spark), "m", byte_tokenizer(), most).collect()} == {k for k, n in sizes.items() if n <= most}
    bad = H.Template("{nothing}")
    assert H.within_tokens(talks(spark), "m", byte_tokenizer(), 10_000, bad).count() == 0


def test_nothing_here_needs_the_corpus_operators():
    import subprocess

    code = "import rillmark.functions.chat, rillmark.operators.dispatch, sys; sys.exit('rillmark.llm' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], check=False, timeout=120).returncode == 0


def test_a_rank_is_a_partition(spark):
    rows = spark.range(23).select(F.col("id").alias("row_idx"), (F.col("id") * 10).alias("x")).repartition(3)
    scattered = D.chunks(rows, 5)

    def work(rank, batches):
        for b in batches:
            yield b.append_column("task", pa.array([rank] * b.num_rows, pa.int32()))

    schema = "row_idx long, x long, is_pad boolean, rank int, task int"
    done = D.on_ranks(scattered.select("row_idx", "x", "is_pad", "rank"), 5, work, schema)
    assert done.rdd.getNumPartitions() == 5
    told = done.withColumn("partition", F.spark_partition_id()).collect()
    assert [r["row_idx"] for r in told] == list(range(25)) and all(r["rank"] == r["task"] == r["partition"] == r["row_idx"] // 5 for r in told)
    assert sorted(r["x"] for r in D.join(done, [0, 1, 2, 3, 4]).collect()) == [10 * k for k in range(23)]
    assert D.on_ranks(rows.limit(0).withColumn("rank", F.lit(0)), 3, lambda rank, batches: batches, "row_idx long, x long, rank int").count() == 0
    with pytest.raises(Exception, match="isn't there"):
        D.on_ranks(rows.withColumn("rank", F.lit(7)), 5, lambda rank, batches: batches, "row_idx long, x long, rank int").count()


@pytest.mark.parametrize("counts", [[1], [2, 1], [1, 1, 1], [3, 2, 1], [2, 2, 2]])
def test_chances_to_win_a_vote(counts):
    items = [v for v, c in enumerate(counts) for _ in range(c)]
    for k in range(1, 6):
        won = Counter()
        for drawn in product(items, repeat=k):
            c = Counter(drawn)
            won[next(x for x in drawn if c[x] == max(c.values()))] += 1
        assert np.allclose(M.vote_chances(np.array(counts, float), k), [won[v] / len(items) ** k for v in range(len(counts))])


def test_chances_of_many_draws_sum_to_one():
    for counts, k in (([500, 300, 200], 256), ([1] * 64, 64), (list(range(1, 12)), 33)):
        p = M.vote_chances(np.array(counts, float), k)
        assert abs(p.sum() - 1) < 1e-9 and (np.diff(p[np.argsort(counts, kind="stable")]) > -1e-9).all()


def test_majority_of_draws_by_enumeration(spark):
    rows = [("p", "a", 1.0), ("p", "a", 2.0), ("p", "b", 5.0), ("p", None, 7.0), ("p", None, 9.0), ("q", "z", 4.0), ("p", "a", None), (None, "a", 3.0), (None, "b", 8.0)]
    got = {(r["g"], r["k"]): (r["mean"], r["std"]) for r in M.majority_of(spark.createDataFrame(rows, "g string, vote string, v double"), ["g"], "vote", "v", [1, 2, 3, 4]).collect()}
    assert len(got) == 12
    for (g, k), (mean, std) in got.items():
        held = [(vote, v) for x, vote, v in rows if x == g and v is not None]
        values = []
        for drawn in product(held, repeat=k):
            c = Counter(vote for vote, _ in drawn)
            values.append(next(v for vote, v in drawn if c[vote] == max(c.values())))
        assert np.isclose(mean, np.mean(values)) and np.isclose(std, np.std(values))


def test_draws_hold_no_group_in_python(spark):
    rows = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id").alias("o"), F.col("id").cast("double").alias("v")).unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS g, 1L AS o, 4D AS v"))
    df = M.resampled(rows, ["g"], "v", ["o"], 3, {"mean": lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y) / 3, "size": F.size}, draws=400)
    got = {(r["g"], r["reducer"]): (r["mean"], r["std"]) for r in df.collect()}
    assert "Python" not in df._jdf.queryExecution().toString() and got[None, "mean"] == (4.0, 0.0)
    for g in (0, 1):
        assert got[g, "size"] == (3.0, 0.0) and abs(got[g, "mean"][0] - (249 + g)) < 25 and 60 < got[g, "mean"][1] < 110


def test_little_text_at_once(monkeypatch):
    """A batch of 3 MB of text is tokenized in turns, rows in order, and so are tokens told as text."""
    talk = lambda n: [{"role": "user", "text": "ab " * n}, {"role": "assistant", "text": None}]
    rows = [None, [], *(talk(k * 997 % 20_000) for k in range(100)), talk(400_000), None]
    batch = pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))), pa.array(range(len(rows)))], names=["m", "id"])
    assert H.text_sizes(batch.column(0)).tolist() == [sum(64 + len(m["text"] or "") for m in r or []) for r in rows]
    assert H.text_sizes(batch.slice(100).column(0)).tolist() == H.text_sizes(batch.column(0)).tolist()[100:]
    seen = []
    encode, decode = H.masked_tokens, H.tokenizer(byte_tokenizer()).decode_batch
    monkeypatch.setattr(H, "masked_tokens", lambda c, *o: seen.append([sum(len(m["text"] or "") for m in x) for x in c]) or encode(c, *o))
    held = SimpleNamespace(columns=["m", "id"], schema=T.StructType(), mapInArrow=lambda run, schema: run)
    told = pa.Table.from_batches(H.loss_mask(held, "m", byte_tokenizer(), 1 << 20, pad="none")(iter([batch])))
    assert told.column("id").to_pylist() == list(range(len(rows))) and len(seen) > 10
    assert all(sum(x) <= H.AT_ONCE or len(x) == 1 for x in seen)
    texts = ["".join(t for t, _ in H.Template().rendered(r or [])) for r in rows]
    seen.clear()
    monkeypatch.setattr(H, "tokenizer", lambda path: SimpleNamespace(decode_batch=lambda ids, **o: seen.append([len(i) for i in ids]) or decode(ids, **o)))
    held.columns = told.column_names
    out = pa.Table.from_batches(H.learned_text(held, byte_tokenizer())(iter(told.combine_chunks().to_batches())))
    assert out.column("whole").to_pylist() == texts and out.column("id").to_pylist() == list(range(len(rows)))
    assert len(seen) > 4 and all(sum(x) <= H.AT_ONCE or len(x) == 1 for x in seen)
