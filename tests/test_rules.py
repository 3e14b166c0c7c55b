"""Rules that no table shows: errors, registries, balancing, streams, files."""

import math

import pytest
from pyspark.sql import functions as F

from rillmark.functions import equality as E
from rillmark.functions import graders as G
from rillmark.functions import parsers as T
from rillmark.functions import prompts as Q
from rillmark.operators import advantage as A
from rillmark.operators import arrays as R
from rillmark.operators import balance as P
from rillmark.operators import batch as B
from rillmark.operators import joins as J
from rillmark.operators import losses as L
from rillmark.operators import metrics as M
from rillmark.operators import offpolicy as O
from rillmark.operators import registry as X
from rillmark.plans import catalog
from rillmark.sources import files
from rillmark.streaming import queues as S


def test_registries_refuse_another_function():
    with pytest.raises(ValueError):
        A.register("grpo")(lambda traj, by: traj)
    assert A.register("grpo")(A.grpo) is A.grpo and A.estimator("gae") is A.gae
    with pytest.raises(ValueError):
        A.estimator("GAE")
    for name, f in (("mine", lambda lp, old, adv: lp),):
        assert L.register(name)(f) is f and L.loss(name) is f


def test_thresholds():
    assert O.parse_band("0.5_2") == O.Band(0.5, 2.0) and O.parse_band(2.0) == O.Band(None, 2.0)
    for bad in ("2_1", "-1", "1_2_3"):
        with pytest.raises(ValueError):
            O.parse_band(bad)
    with pytest.raises(TypeError):
        O.parse_band(True)


def test_lone_trajectory_of_pass_at_k_fails(spark):
    with pytest.raises(Exception, match="two trajectories"):
        A.pass_at_k(spark.createDataFrame([("a", 1, 2.0)], "uid string, traj int, score double"), ["uid"]).collect()


def test_resample_over_ranges(spark, sf_dir):
    """Every draw has one row, found by brute force; the query draws from all trajectories."""
    import bisect
    import hashlib
    import itertools

    weights = [(k * 37 % 101) % 9 / 4 for k in range(300)]  # some have none
    rows = spark.createDataFrame([(k, float(w)) for k, w in enumerate(weights)], "k int, weight double")
    ends = list(itertools.accumulate(weights))
    want = {d: bisect.bisect_right(ends, int(hashlib.md5(f"s:{d}".encode()).hexdigest()[:8], 16) / 2**32 * ends[-1]) for d in range(200)}
    got = [(r["draw"], r["k"]) for r in A.resample(rows, 200, "s", "k").collect()]
    assert len(got) == 200 and dict(got) == want
    ties = A.resample(spark.createDataFrame([(1, 1.0), (1, 1.0), (2, 1.0)], "k int, weight double"), 50, "s", "k")
    assert sorted(r["draw"] for r in ties.collect()) == list(range(50))
    drawn = [r["traj"] for r in catalog.queries()["preference_resample"](spark, sf_dir).collect()]
    assert len(drawn) == 100 and max(drawn) >= 200


def test_crop_report_counts_every_part(spark, sf_dir, tmp_path):
    whole = catalog.queries()["crop_ratio_report"]
    parts = spark.read.parquet(f"{sf_dir}/part.parquet")
    assert sum(r["n"] for r in whole(spark, sf_dir).collect()) == parts.count()
    spark.createDataFrame([(1,), (2,), (41,)], "p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert {r["severity"]: r["n"] for r in whole(spark, str(tmp_path)).collect()} == {"negligible": 2, "small": 0, "noticeable": 0, "large": 0, "severe": 1}


def test_turns_token_baseline_gives_all_positions(spark):
    """Masked places, and a trajectory that is all masked, stay with 0 and change no other's values."""
    nan = float("nan")
    rows = [("u", 1, 0, 1, 1.0, -0.5, 0.4), ("u", 1, 1, 0, nan, nan, nan), ("u", 1, 2, 1, 2.0, -0.2, 0.6), ("u", 2, 0, 0, 9.0, nan, 0.1), ("u", 2, 1, 1, 4.0, -0.3, 0.5), ("u", 3, 0, 0, 5.0, -0.1, 0.9)]
    df = spark.createDataFrame(rows, "uid string, traj int, pos int, mask int, reward double, old_lp double, sum_pi_squared double")
    out = {(r["traj"], r["pos"]): r for r in A.estimator("tir_optimal_token_baseline")(df, ["uid"]).collect()}
    assert len(out) == len(rows)
    w1, w2 = (1 - 2 * math.exp(lp) + s for lp, s in ((-0.5, 0.4), (-0.3, 0.5)))
    b = (3.0 * w1 + 4.0 * w2) / (w1 + w2 + 1e-8)
    want = {(1, 0): 3.0 - b, (1, 1): 0.0, (1, 2): 2.0, (2, 0): 0.0, (2, 1): 4.0 - b, (3, 0): 0.0}
    assert all(abs(out[k]["advantage"] - v) < 1e-9 for k, v in want.items()) and out[1, 1]["returns"] == 2.0 and out[3, 0]["returns"] == 0.0


def test_masked_garbage_changes_nothing(spark):
    mask = [0, 0, 1, 1, 1, 0, 0, 1, 1, 0, 0]
    rows = [("u", t, k, m, 0.1 * k if m else 0.0, 0.2 * k if m else junk) for t, junk in ((1, 5.0), (2, -3.0)) for k, m in enumerate(mask)]
    out = A.gae_raw(spark.createDataFrame(rows, "uid string, traj int, pos int, mask int, reward double, value double"), 0.9, 0.8).where("mask > 0").collect()
    one, two = ({r["pos"]: round(r["raw_advantage"], 9) for r in out if r["traj"] == t} for t in (1, 2))
    assert one == two and len(one) == 5


def test_batch_checks(spark):
    df = spark.createDataFrame([(0, "a", float("nan")), (1, "b", 2.0)], "row_idx bigint, name string, x double")
    with pytest.raises(B.BatchError):
        B.pop(df, ["absent"])
    with pytest.raises(B.BatchError):
        B.chunk(df, 3, 2)
    assert B.union(df, df.select("row_idx", "x")).count() == 2
    with pytest.raises(B.BatchError):
        B.union(df, df.withColumn("x", F.lit(1.0)))
    with pytest.raises(B.BatchError):
        B.union_meta({"a": 1}, {"a": 2})
    assert B.union_meta({"a": float("nan")}, {"a": float("nan"), "b": 1})["b"] == 1
    with pytest.raises(KeyError):
        B.pivot_records([{"a": 1}, {"b": 2}])
    assert B.prefixed({"a": 1, "p/b": 2}, "p/") == {"p/a": 1, "p/b": 2} and B.appended({"a": [1]}, {"a": 2, "b": [3, 4]}) == {"a": [1, 2], "b": [3, 4]}
    assert B.pad_minimal(df.withColumn("mask", F.array(F.lit(1))), 4, 2, "mask").where("is_padding").count() == 2
    assert B.same_rows(df, df) and B.required_multiple(4, 6) == 12
    assert B.unpad(B.pad_to_multiple(df, 5, 2), 5, 3).count() == 2


def test_truncation_error(spark):
    with pytest.raises(Exception, match="longer than 2"):
        spark.range(1).select(R.pad_or_truncate(F.array(F.lit(1), F.lit(2), F.lit(3)), 2, F.lit(0))).collect()


def test_key_checks(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    with pytest.raises(J.KeyError_):
        J.upsert(base, spark.createDataFrame([(3, "c")], "k int, v string"), ["k"], ["v"])
    with pytest.raises(J.KeyError_):
        J.upsert(base, spark.createDataFrame([(1, "c"), (1, "d")], "k int, v string"), ["k"], ["v"])
    with pytest.raises(J.KeyError_):
        J.merge_shards([base, base], ["k"])
    assert J.merge_shards([base, spark.createDataFrame([(3, "c")], "k int, v string")], ["k"], 3).count() == 3


def test_balancing():
    import random

    rng = random.Random(0)
    sizes = [rng.randint(1, 4000) for _ in range(64)]
    for equal in (False, True):
        parts = P.differencing(sizes, 8, equal)
        assert sorted(i for p in parts for i in p) == list(range(64))
        assert not equal or all(len(p) == 8 for p in parts)
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) < 0.05 * max(sums)
    parts = P.by_groups(sizes, [i // 4 for i in range(64)], 4)
    assert all(len(p) == 16 and {i // 4 for i in p if i // 4 * 4 in p} for p in parts)
    micro = P.micro_batches(sizes, 9000)
    assert sorted(i for p in micro for i in p) == list(range(64))
    flat = [i for p in micro for i in p]
    assert [flat[at] for at in P.restore(micro)] == list(range(64))
    assert P.greedy([5, 1, 1, 1], 2) == [[0], [1, 2, 3]] and P.greedy([5, 1, 1, 1], 2, equal=True) == [[0, 3], [1, 2]]


def test_math_forms():
    assert G.math_form("x = \\dfrac12") == "\\frac{1}{2}" and G.math_form("0.5") == "\\frac{1}{2}" and G.math_form("\\sqrt3 + 1") == "\\sqrt{3}+1"
    assert G.boxed_in("a \\boxed{1} b \\boxed{x^{2}} c") == "x^{2}" and G.boxed_in("\\boxed{1") is None and G.boxed_in("none") is None
    assert G.boxed_in("\\fbox{1}") is None and G.boxed_in("\\boxed 5$ and \\boxed{3}") == "5" and G.strict_box("\\boxed 5 \\boxed{x^{2}}") == "x^{2}"


@pytest.mark.parametrize(
    ("given", "truth", "same"),
    [
        ("50%", "0.5", True), ("[1, 2]", "[1,2.0]", True), ("(1, 2]", "[1,2]", False), ("\\frac{1}{2}", "0.5", True), ("Interval(1, 2)", "[1,2]", True), ("Point(1, 2)", "(1,2)", True),
        ("\\sqrt{16}", "4", True), ("2^{10}", "1024", True), ("[[1,2],[3,4]]", "\\begin{pmatrix}1&2\\\\3&4\\end{pmatrix}", True), ("x+1", "1+x", True), ("1, 2, 3", "1,2,3.0", True),
        ("$5", "5", True), ("101_2", "101", True), ("", "1", False), ("__import__('os')", "1", False), ("9**9**9**9", "1", False), ("1/0", "1", False),
    ],
)
def test_same_value(given, truth, same):
    assert E.same_value(given, truth) is same


def test_competition_answers():
    assert E.competition_score("We get x = 5 cm", "5") == (True, True, "5 cm") and E.competition_score("the area is 2\\pi", "6.28")[0]
    assert E.competition_score("Answer: 2/4", "1/2") == (True, False, "2/4") and not E.same_exactly("2/4", "1/2") and E.same_exactly("7 3/4", "7.75")
    assert E.stated("no digits here") == "no digits here" and not E.same_exactly("3.5", "4") and E.same_exactly("1,000 cm", "1000")
    assert E.stated("Answer is 3. So the ANSWER: we get x = \\boxed{7}. Really") == "7" and E.stated("12 is the answer") == "12"
    assert E.competition_score(None, "1") == (False, False, "None") and not E.competition_score("nan_1", "inf_1")[0]


EQUAL = [
    ("(x+1)^2", "x^2+2x+1"), ("\\frac{x}{x y}", "1/y"), ("x/(x y)", "\\frac1y"), ("a^2-b^2", "(a-b)(a+b)"), ("\\frac{x^2-1}{x-1}", "x+1"), ("\\sqrt{12}", "2\\sqrt3"), ("\\frac{1}{\\sqrt{2}}", "\\frac{\\sqrt{2}}{2}"),
    ("\\sqrt{2}\\sqrt{3}", "\\sqrt{6}"), ("\\sqrt[3]{16}", "2\\sqrt[3]{2}"), ("\\frac{1}{1+\\sqrt2}", "\\sqrt2-1"), ("8^{2/3}", "4"), ("2^{x+1}", "2\\cdot 2^x"), ("\\sin(x+1)", "\\sin(1+x)"), ("\\sqrt{4x}", "2\\sqrt{x}"),
    ("2^{100}", "1267650600228229401496703205376"), ("5!", "120"), ("x_1+x_2", "x_{2}+x_{1}"), ("\\pi r^2", "r^2\\pi"), ("(x+1, 2]", "(1+x, 4/2]"), ("\\{1, x+x\\}", "\\{1,2x\\}"), ("y=2x+1", "y=1+2x"),
    ("\\begin{pmatrix}1&x+1\\\\2&3\\end{pmatrix}", "\\begin{pmatrix} 1 & 1+x \\\\ 2 & 3\\end{pmatrix}"), ("[[1,x],[3,4]]", "\\begin{bmatrix}1&x\\\\3&4\\end{bmatrix}"), ("Matrix([[1, 2]])", "[[1,2]]"),
    ("Interval.Ropen(0, x)", "[0,x)"), ("(-\\infty, 3)", "(-\\infty,3.0)"), ("[5]", "5"), ("1,2", "(1,2)"), ("((1,2),(3,4))", "((1,2.0),(3,4))"), ("1e3", "1000"), ("1,000,000", "1000000"), ("0.33333", "1/3"), ("\\left(1,2\\right)", "(1,2)"),
    ("|-3|", "3"), ("\\sqrt{x}^2", "x"), ("-\\frac{3}{4}", "\\frac{-3}{4}"), ("\\text{Even}", "\\text{ even}"), ("90^\\circ", "90"), ("1/(1/x)", "x"), ("\\sqrt{\\frac{x}{y}}", "\\sqrt{xy}/y"),
]
UNEQUAL = [
    ("x+1", "x+2"), ("\\sqrt{x^2}", "x"), ("x y", "x+y"), ("(1,2)", "[1,2]"), ("(1,2)", "(2,1)"), ("(1,2)", "(1,2,3)"), ("[0,1)", "[0,1]"), ("\\begin{pmatrix}1&2\\end{pmatrix}", "\\begin{pmatrix}1\\\\2\\end{pmatrix}"),
    ("x", "y"), ("2x", "x^2"), ("0.3", "1/3"), ("(x+1)^{9999}", "x"), ("9^{9^{9}}", "1"), ("(" * 5000 + "1", "1"), ("1/0", "1/0+1"), ("nan_1", "inf_1"), ("inf", "1"), ("nan", "1"), ("even", "odd"), ("x=1", "x=2"), ("\\sin x", "\\cos x"),
    ("\\frac{", "1"), ("\\sqrt[0]{2}", "1"), ("1_", "1"), ("x" * 2000, "y"), ("^", "1"), ("\\", "1"), ("2 3", "6"), ("600!", "1"), ("1e999", "1"), ("(a+b+c+d+e+f+g)^{12}", "1"),
]


@pytest.mark.parametrize(("same", "cases"), [(True, EQUAL), (False, UNEQUAL)])
def test_values(same, cases):
    for given, truth in cases:
        assert E.same_value(given, truth) is same, (given, truth)
        assert E.same_value(truth, given) is same, (truth, given)
        E.competition_score(given, truth)


@pytest.mark.parametrize(("given", "truth", "same"), [("x+1", "1+x", True), ("4/8", "1/2", False), ("0.5", "1/2", True), ("0.33333", "1/3", False), ("5.0", "5", True), ("\\sqrt{25}", "5", False), ("3 million dollars", "3000000 dollars", True), ("3 million", "3000000", False), ("12 meters", "12", True), ("parameter", "para", False), ("1 and 2", "1, 2", True), ("(1,2)", "1,2", False)])
def test_exact_values(given, truth, same):
    assert E.same_exactly(given, truth) is same


def test_gate_and_unknown_mode(spark):
    with pytest.raises(ValueError):
        M.gate(spark.createDataFrame([(0.4,)], "rate double"), {"rate": (0.5, None)})
    with pytest.raises(ValueError):
        L.aggregate(spark.createDataFrame([(1, 1)], "traj int, mask int"), F.col("mask"), "mean")


def test_unknown_status_and_source_fail(spark):
    with pytest.raises(Exception, match="unknown status"):
        S.latest_status(spark.createDataFrame([(1, "lost", 1)], "uid int, status string, seq int")).collect()
    with pytest.raises(Exception, match="no grader"):
        spark.range(1).select(G.dispatch(F.lit("x"), F.lit("y"), F.lit("z"))).collect()


def test_files(spark, tmp_path):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    files.write_table(a, f"{tmp_path}/a.parquet")
    a.write.json(f"{tmp_path}/b.jsonl")
    both = files.read_files(spark, [f"{tmp_path}/a.parquet", f"{tmp_path}/b.jsonl"], "k int, v string")
    assert both.count() == 4 and both.where("file_order = 1").count() == 2
    with pytest.raises(ValueError):
        files.read_files(spark, ["x.csv"])
    files.write_dump(a.withColumn("step", F.col("k") * 10), f"{tmp_path}/dump")
    dump = files.read_dump(spark, f"{tmp_path}/dump", mask=("y",)).collect()
    assert [r["step"] for r in dump] == [10, 20] and dump[1]["v"] == "<mask>"
    files.write_metrics(spark.createDataFrame([(1, "a", 0.5), (1, "b", 1.0)], "step int, name string, value double"), f"{tmp_path}/m")
    assert spark.read.json(f"{tmp_path}/m").first()["data"]["b"] == 1.0


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(k % 3, k, "finished" if k % 2 else "pending") for k in range(30)], "uid bigint, seq bigint, status string")
    for k in range(2):
        rows.where(F.col("seq") % 2 == k).withColumn("partition_id", F.lit("train")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("uid bigint, seq bigint, status string, partition_id string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for name, df in (("status", S.stream_status(stream.drop("partition_id"))), ("queue", S.stream_queue(stream.select("partition_id", "seq"), 8))):
        q = df.writeStream.outputMode("update").format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").start()
        q.processAllAvailable()
        q.stop()
    want = {r["uid"]: r["status"] for r in S.latest_status(rows).collect()}
    got = {r["uid"]: r["status"] for r in spark.sql("SELECT uid, max_by(status, n) AS status FROM status GROUP BY uid").collect()}
    assert got == want
    last = spark.sql("SELECT * FROM queue ORDER BY dropped DESC").first()
    assert (last["size"], last["dropped"]) == (8, 22)


def test_every_query_without_sql_runs(spark, sf_dir):
    for name in set(catalog.queries()) - set(catalog.oracle_sql()):
        assert catalog.queries()[name](spark, sf_dir).count()


def test_decisions():
    assert S.refill_credits(3, 1, 90, 100) == 7 and S.refill_credits(30, 1, 95, 100) == 5
    assert S.must_pause(10, 6, 8, 1, 1) and not S.must_pause(10, 5, 8, 1, 1)


def test_first_rows_without_sorting(spark, monkeypatch):
    """The first n by several keys, found by narrowing: ties, one value only, more than there are."""
    import random

    monkeypatch.setattr(B, "FEW", 5)
    rng = random.Random(3)
    rows = [(rng.choice([0.5, 1.0, rng.random()]), rng.randrange(4), k) for k in range(900)] + [(0.5, 9, 1000 + k) for k in range(50)]
    df = spark.createDataFrame(rows, "a double, b int, c int").cache()
    for n in (0, 1, 7, 200, 500, 949, 950, 2000):
        got = df.where(B.among_first(df, [F.col("a"), F.col("b"), F.col("c")], n)).collect()
        assert sorted(map(tuple, got)) == sorted(rows)[:n], n
    down = df.where(B.among_first(df, [-F.col("a"), F.col("c")], 40)).collect()
    assert sorted(map(tuple, down)) == sorted(sorted(rows, key=lambda r: (-r[0], r[2]))[:40])


def test_rows_are_numbered_by_text(spark):
    rows = [(f"{chr(97 + k * 7 % 26)}{k:03}é",) for k in range(400)] + [(None,), ("",)]
    df = spark.createDataFrame(rows, "t string")
    got = {r["t"]: r["row_idx"] for r in B.with_row_index(df, ["t"]).collect()}
    want = sorted(got, key=lambda t: (t is not None, (t or "").encode()))
    assert [got[t] for t in want] == list(range(402))


def test_differencing_as_defined():
    """Against merging lists of states, the widest and then the largest first."""
    import random

    def defined(sizes, k, equal):
        order = sorted((n, i) for i, n in enumerate(sizes))
        groups = [order[s : s + k] for s in range(0, len(order), k)] if equal else [[x] for x in order]
        states = [sorted([(n, 1, [(i, n)]) for n, i in g] + [(0, 0, [])] * (k - len(g)), reverse=True) for g in groups]
        while len(states) > 1:
            states.sort(key=lambda s: (s[0][0] - s[-1][0], s[0]), reverse=True)
            a, b = states.pop(0), states.pop(0)
            states.append(sorted(((x[0] + y[0], x[1] + y[1], x[2] + y[2]) for x, y in zip(a, reversed(b), strict=True)), reverse=True))
        return [sorted(i for i, _ in p) for _, _, p in states[0]]

    rng = random.Random(1)
    for n, k in ((24, 4), (12, 3), (40, 8)):
        for top in (3, 50):  # many equal sizes, and few
            sizes = [rng.randint(1, top) for _ in range(n)]
            assert P.differencing(sizes, k) == defined(sizes, k, False) and P.differencing(sizes, k, True) == defined(sizes, k, True)
    parts = P.ranks([5, 1, 4, 2, 3, 6, 8, 7], 2)
    assert sorted(i for p in parts for i in p) == list(range(8)) and all(len(p) == 4 for p in parts)
    by_mini = P.ranks([5, 1, 4, 2, 3, 6, 8, 7], 2, mini_batch=4)
    assert all(sum(i < 4 for i in p) == 2 for p in by_mini)


def test_registries_and_custom_functions(spark, tmp_path):
    r = X.Registry("thing")
    assert r.register("a", "b")(len) is len and r.get("b") is len
    with pytest.raises(ValueError):
        r.register("a")(max)
    with pytest.raises(ValueError):
        r.get("A")
    (tmp_path / "judge.py").write_text("def judge(source, text, truth, weight=1.0):\n    return weight * (text == truth)\n")
    score = X.reward_function(str(tmp_path / "judge.py"), "judge", weight=2.0)
    rows = spark.createDataFrame([("s", "a", "a"), ("s", "a", "b")], "s string, t string, g string")
    assert [x[0] for x in rows.select(score(F.col("s"), F.col("t"), F.col("g"))).collect()] == [2.0, 0.0]
    with pytest.raises(ValueError):
        X.load(str(tmp_path / "judge.py"), "absent")
    with pytest.raises(TypeError):
        X.dataset(dict)
    with pytest.raises(TypeError):
        X.tool(lambda x: x)
    from rillmark.plans.q_flow import unit_price

    spec = X.schema(unit_price)["function"]
    assert spec["parameters"]["required"] == ["total", "count"] and spec["parameters"]["properties"]["count"] == {"type": "integer", "description": "how many there are"}


def test_bootstrap_draws(spark):
    import numpy as np

    values = [3.0, 1.0, 4.0, 1.5, 9.0]
    rows = spark.createDataFrame([("u", k, v) for k, v in enumerate(values)], "u string, k int, v double")
    got = {r["reducer"]: r for r in M.bootstrap(rows, ["u"], "v", "k", 3, {"max": np.max}).collect()}["max"]
    np.random.seed(42)
    drawn = np.array(values)[np.random.choice(5, size=(1000, 3), replace=True)].max(axis=1)
    assert (got["mean"], got["std"]) == (drawn.mean(), drawn.std())
    closed = rows.groupBy().agg(F.array_sort(F.collect_list("v")).alias("v")).select(M.best_of_k(F.col("v"), 3), M.best_of_k_std(F.col("v"), 3)).first()
    assert abs(closed[0] - drawn.mean()) < 0.3 and abs(closed[1] - drawn.std()) < 0.3


def test_group_split_by_hash(spark):
    import hashlib

    keys = [f"k{k}" for k in range(200)]
    got = {r["k"]: r["s"] for r in spark.createDataFrame([(k,) for k in keys], "k string").select("k", Q.group_split(F.col("k"), "7", {"a": 0.5, "b": 0.5}).alias("s")).collect()}
    unit = {k: int.from_bytes(hashlib.blake2b(f"7\0{k}".encode(), digest_size=8).digest(), "big") / 2**64 for k in keys}
    assert got == {k: "a" if u < 0.5 else "b" for k, u in unit.items()} and len(set(got.values())) == 2


def test_conflicts_of_both_kinds(spark, sf_dir):
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    kept = catalog.queries()["conflict_rejection"](spark, sf_dir).count()
    assert 0 < kept < lines.count()


def test_more_errors(spark, tmp_path):
    rows = spark.range(10).withColumnRenamed("id", "row_idx")
    for wrong in (lambda: S.refill(rows, 10, 0, 9, 8, 1), lambda: S.trigger_steps(rows, 10, 3), lambda: S.sampling_state(rows, 1, 1, 1, "both"), lambda: B.from_columns(spark, {"a": [1], "b": []}), lambda: B.to_columns(rows, 3)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(Exception, match="run elsewhere"):
        spark.range(1).select(G.dispatch(F.lit("apps"), F.lit("y"), F.lit("z"))).collect()
    with pytest.raises(Exception, match="exactly one"):
        spark.range(1).select(Q.media_descriptors(F.array(F.lit("a"), F.lit("b")), 1, 2)).collect()
    rows.withColumn("step", F.lit(1)).write.json(f"{tmp_path}/dump")
    with pytest.raises(ValueError, match="nothing"):
        files.replay(spark, f"{tmp_path}/dump", 2)


def _one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return row.select(column.alias("x")).first()["x"]


def test_texts_that_repeat_names_or_hold_large_numbers(spark):
    """A name given again takes the last value in its first place; numbers have any length."""
    big = "1" + "0" * 40
    cases = [
        (T.function_calls, "<tool_call><function=f><parameter=a>1</parameter><parameter=b>2</parameter><parameter=a>3</parameter></function></tool_call>"),
        (T.keyed_calls, "<tool_call>f<arg_key>a</arg_key><arg_value>1</arg_value><arg_key>b</arg_key><arg_value>2</arg_value><arg_key>a</arg_key><arg_value>3</arg_value></tool_call>"),
        (T.seed_calls, "<seed:tool_call><function=f><parameter=a>1</parameter><parameter=b>2</parameter><parameter=a>3</parameter></function></seed:tool_call>"),
        (T.invoke_calls, '<invoke name="f"><parameter name="a">1</parameter><parameter name="b">2</parameter><parameter name="a">3</parameter></invoke>'),
        (T.brace_calls, "<|tool_call>call:f{a:1, b:2, a:3}<tool_call|>"),
        (T.marked_invocations, f'<{T._MARK}tool_calls><{T._MARK}invoke name="f">' + "".join(f'<{T._MARK}parameter name="{k}" string="false">{v}</{T._MARK}parameter>' for k, v in (("a", 1), ("b", 2), ("a", 3))) + f"</{T._MARK}invoke></{T._MARK}tool_calls>"),
    ]
    for dialect, text in cases:
        (call,) = _one(spark, dialect(F.col("t")), t=text)
        assert call["name"] == "f" and list(call["arguments"].items()) == [("a", "3"), ("b", "2")]
    (call,) = _one(spark, T.brace_calls(F.col("t")), t=f"<|tool_call>call:f{{a:{big}, b:-007, c:+5, d:-0, e:1e3, f:x}}<tool_call|>")
    assert call["arguments"] == {"a": big, "b": "-7", "c": "5", "d": "0", "e": "1000.0", "f": '"x"'}
    assert _one(spark, T.crop_action(F.col("t")), t=f'<crop>{{"cx": {big}, "cy": 1, "area": 5}}</crop>') is None
    assert _one(spark, T.percent_action(F.col("t")), t=f'{{"cx_pct": {big}, "cy_pct": 1, "area_pct": 5}}') is None


def test_truths_that_cannot_be_read(spark):
    good = '<tool_call>{"name": "f", "parameters": {"a": 1}}</tool_call>'
    score = lambda t, u: _one(spark, G.tool_call_score(F.col("t"), F.col("u")), t=t, u=u)
    assert score(good, good) == 3.0 and score(good, None) is None and score(good, "<tool_call>{</tool_call>") is None and score(good, '<tool_call>{"name": "f"}</tool_call>') is None
    assert score(None, good) == -3.0 and score("<tool_call>{</tool_call>", good) == -3.0 and score(good, "no calls") == 0.0
    for pair in (("nan_1", "1"), ("inf_1", "1"), ("1e999", "1"), ("_", "_1")):
        assert _one(spark, G.numeric_score(F.col("t"), F.col("u")), t=pair[0], u=pair[1]) == 0.0
    kind = next(iter(G.GRADERS["competition"]))
    assert _one(spark, G.dispatch(F.lit(kind), F.col("t"), F.col("u"), F.array(F.lit(True))), t="Answer: nan_1", u="2") == 0.0


def test_metrics_given_twice(spark, tmp_path):
    rows = [(1, "a", 1.0), (1, "a", 3.0), (1, "b", None), (2, "a", float("nan")), (2, "a", 5.0), (2, None, 1.0)]
    files.write_metrics(spark.createDataFrame(rows, "step long, name string, value double"), f"{tmp_path}/m")
    got = {r["step"]: r["data"] for r in spark.read.schema("step long, data map<string, string>").json(f"{tmp_path}/m").collect()}
    assert got[1]["a"] == "3.0" and got[2]["a"] == "NaN" and set(got) == {1, 2}
