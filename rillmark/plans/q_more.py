"""Queries: filters, comparison reports, distillation, padding, order."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import graders as G
from ..functions import prompts as Q
from ..operators import balance as P
from ..operators import batch as B
from ..operators import joins as J
from ..operators import metrics as M
from ..sources import files
from .base import TOKENS_SQL, query, r6, s6, table, tokens

_T = f"WITH {TOKENS_SQL}"


@query("SELECT item_id FROM benchmark WHERE len(list_filter(regexp_split_to_array(text, '\\s+'), lambda t: t <> '')) <= 60")
def overlong_prompt_filter(spark, sf):
    n = F.size(F.filter(F.split("text", r"\s+"), lambda t: t != ""))
    return Q.drop_overlong(table(spark, sf, "benchmark"), n, 60).select("item_id")


@query("SELECT doc_id, text AS prompt, lang AS chosen, source AS rejected FROM documents")
def preference_scan(spark, sf):
    d = files.read_files(spark, [f"{sf}/documents.parquet"])
    return d.select("doc_id", F.col("text").alias("prompt"), F.col("lang").alias("chosen"), F.col("source").alias("rejected"))


@query("SELECT p_partkey FROM part WHERE length(nullif(p_type, 'PROMO')) > 0")
def empty_label_filter(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", F.nullif("p_type", F.lit("PROMO")).alias("label"))
    return Q.labelled(p, "label").select("p_partkey")


@query(f"{_T} SELECT traj, count(*) FILTER (WHERE mask > 0 AND old_lp IS DISTINCT FROM ref_lp) AS n FROM tok GROUP BY traj")
def token_diff_count(spark, sf):
    return M.differing_tokens(tokens(spark, sf), "old_lp", "ref_lp")


@query(f"SELECT key, {s6('avg(v)')} AS mean, {s6('stddev_pop(v)')} AS std, {s6('max(v)')} AS max, {s6('min(v)')} AS min FROM (SELECT unnest(['quality', 'toxic']) AS key, unnest([quality, toxic])::DOUBLE AS v FROM labels) GROUP BY key")
def reward_key_stats(spark, sf):
    m = M.reward_stats(table(spark, sf, "labels"), ["quality", "toxic"])
    return m.select("key", *(r6(c).alias(c) for c in ("mean", "std", "max", "min")))


_PAIRS = """WITH r AS (SELECT l_orderkey AS task, l_linestatus AS run, min(l_linenumber) AS label FROM lineitem GROUP BY ALL), b AS (SELECT task, label FROM r WHERE run = 'F'),
o AS (SELECT r.task % 4 AS ratio, CASE WHEN r.label < b.label THEN 'win' WHEN r.label > b.label THEN 'loss' ELSE 'tie' END AS outcome FROM r JOIN b USING (task) WHERE r.run <> 'F')"""


@query(f"""{_PAIRS} SELECT ratio, count(*) AS scored, {s6("avg(CASE WHEN outcome = 'win' THEN 1.0 ELSE 0 END)")} AS win_rate, {s6("avg(CASE WHEN outcome = 'tie' THEN 1.0 ELSE 0 END)")} AS tie_rate, {s6("avg(CASE WHEN outcome = 'loss' THEN 1.0 ELSE 0 END)")} AS loss_rate FROM o GROUP BY GROUPING SETS ((), (ratio))""")
def policy_comparison(spark, sf):
    r = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("task"), F.col("l_linestatus").alias("run")).agg(F.min("l_linenumber").alias("label"))
    o = J.paired_runs(r, "task", "run", "label", "F").withColumn("ratio", F.col("task") % 4)
    return M.outcome_rates(o, "ratio").select("ratio", "scored", *(r6(f"{k}_rate").alias(f"{k}_rate") for k in ("win", "tie", "loss")))


@query("""WITH p AS (SELECT o_custkey, coalesce(max(CASE WHEN o_orderkey % 2 = 0 THEN o_orderstatus END) = max(CASE WHEN o_orderkey % 2 = 1 THEN o_orderstatus END), false) AS stable FROM orders GROUP BY 1)
SELECT count(*) FILTER (WHERE stable) AS stable, count(*) FILTER (WHERE NOT stable) AS unstable FROM p""")
def judgment_stability(spark, sf):
    j = table(spark, sf, "orders").select(F.col("o_custkey").alias("task"), (F.col("o_orderkey") % 2).alias("o"), F.col("o_orderstatus").alias("p"))
    return M.stability(J.both_orders(j, "task", "o", "p"))


@query("""WITH c AS (SELECT CASE WHEN p_size / 400.0 <= 0.005 THEN 'negligible' WHEN p_size / 400.0 <= 0.02 THEN 'small' WHEN p_size / 400.0 <= 0.05 THEN 'noticeable' WHEN p_size / 400.0 <= 0.10 THEN 'large' ELSE 'severe' END AS severity FROM part)
SELECT severity, coalesce(n, 0) AS n FROM (SELECT unnest(['negligible', 'small', 'noticeable', 'large', 'severe']) AS severity) LEFT JOIN (SELECT severity, count(*) AS n FROM c GROUP BY 1) USING (severity)""")
def crop_ratio_report(spark, sf):
    c = table(spark, sf, "part").groupBy(Q.severity(F.col("p_size") / 400.0).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return M.zero_filled(c, "severity", ["negligible", "small", "noticeable", "large", "severe"])


@query("""WITH x AS (SELECT vec_id, unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings), k AS (SELECT vec_id, i, row_number() OVER (PARTITION BY vec_id ORDER BY v DESC, i) AS a, row_number() OVER (PARTITION BY vec_id ORDER BY abs(v) DESC, i) AS b FROM x)
SELECT vec_id, count(*) FILTER (WHERE a <= 8 AND b <= 8) / 8.0::DOUBLE AS overlap FROM k GROUP BY vec_id""")
def distillation_overlap(spark, sf):
    z = F.transform("embedding", lambda v: v.cast("double"))
    return table(spark, sf, "embeddings").select("vec_id", M.top_overlap(z, F.transform(z, F.abs), 8).alias("overlap"))


@query(f"""WITH x AS (SELECT vec_id, list_reverse_sort(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 5)) AS z FROM embeddings)
SELECT vec_id, {s6('list_sum(list_transform(z[1:8], lambda v: exp(v))) / list_sum(list_transform(z, lambda v: exp(v)))')} AS mass FROM x""")
def distillation_mass(spark, sf):
    z = F.transform("embedding", lambda v: v.cast("double") * 5)
    return table(spark, sf, "embeddings").select("vec_id", r6(M.top_mass(z, 8)).alias("mass"))


@query(f"SELECT event_type, {s6('sum(value) / (count(*) * 8)')} AS tokens_per_second FROM events GROUP BY event_type")
def throughput(spark, sf):
    e = table(spark, sf, "events").groupBy("event_type").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("s"))
    return e.select("event_type", r6(M.throughput(F.col("v"), F.col("s"), 8)).alias("tokens_per_second"))


@query("WITH n AS (SELECT count(*) AS n FROM benchmark) SELECT item_id AS row_idx, false AS is_padding FROM benchmark UNION ALL SELECT n + k, true FROM n, range(64) r(k) WHERE k < (64 - n % 64) % 64")
def minimal_padding(spark, sf):
    b = table(spark, sf, "benchmark").select(F.col("item_id").alias("row_idx"), F.array(F.lit(1)).alias("mask"))
    return B.pad_minimal(b, 64, b.count(), "mask").select("row_idx", "is_padding")


@query("SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) - 1 < floor((SELECT count(*) FROM documents) * 0.75) THEN 'train' ELSE 'test' END AS split FROM documents")
def percent_split(spark, sf):
    d = B.with_row_index(table(spark, sf, "documents").select("doc_id"), ["doc_id"])
    return Q.percent_split(d, 0.75, d.count()).select("doc_id", "split")


@query("SELECT o_orderkey AS k, o_totalprice AS a, NULL::DOUBLE AS b FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders WHERE o_orderstatus <> 'F'")
def result_merge(spark, sf):
    o = table(spark, sf, "orders")
    x = o.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("a"))
    y = o.where("o_orderstatus <> 'F'").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("b"))
    return J.merge_shards([x, y], ["k"])


@query("""WITH t AS (SELECT p_partkey, 'so \\boxed{' || p_size || '} ' || repeat('x', CAST(p_retailprice AS INT) % 120) AS text, CAST(p_size % 30 AS VARCHAR) AS truth FROM part)
SELECT p_partkey, CASE WHEN regexp_extract(right(text, 100), '\\\\boxed\\{([^}]*)\\}', 1) = truth THEN 1.0::DOUBLE ELSE -1.0 END AS score FROM t""")
def grade_strict_box(spark, sf):
    text = F.concat(F.lit("so \\boxed{"), F.col("p_size").cast("string"), F.lit("} "), F.repeat(F.lit("x"), F.rint("p_retailprice").cast("int") % 120))
    return table(spark, sf, "part").select("p_partkey", G.strict_box_score(text, (F.col("p_size") % 30).cast("string")).alias("score"))


@query("""WITH d AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_idx, n_chars FROM documents), b AS (SELECT row_idx // 50 AS batch, row_idx, n_chars FROM d)
SELECT batch, count(*) AS rows, 5 AS parts, 0 AS first, count(*) - 1 AS last, sum((row_idx % 50 + 1) * n_chars)::BIGINT AS restored FROM b GROUP BY batch""")
def balanced_and_restored(spark, sf):
    """Rows in the order of balanced parts, and put back where they came from."""
    d = B.with_row_index(table(spark, sf, "documents").select("doc_id", "n_chars"), ["doc_id"]).withColumn("batch", F.floor(F.col("row_idx") / 50))
    moved = P.partition(d.select("batch", "row_idx", "n_chars"), "batch", "row_idx", "n_chars", lambda s: P.differencing(s, 5))
    before = Window.partitionBy("batch").orderBy("part", "place")
    lists = moved.withColumn("at", F.row_number().over(before) - 1).groupBy("batch").agg(
        F.count_distinct("part").alias("parts"), F.min("at").alias("first"), F.max("at").alias("last"), F.array_sort(F.collect_list(F.struct("at", (F.col("row_idx") % 50).alias("i"), "n_chars"))).alias("_moved")
    )
    back = P.restored(F.transform("_moved", lambda x: x["i"]))
    again = F.transform(back, lambda at: F.get(F.col("_moved"), at)["n_chars"])
    weighed = F.aggregate(F.transform(again, lambda n, k: n * (k + 1)), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return lists.select("batch", F.size("_moved").cast("bigint").alias("rows"), "parts", "first", "last", weighed.alias("restored"))


@query("""WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_idx, CAST(round(o_totalprice) AS BIGINT) AS size FROM orders), b AS (SELECT row_idx // 64 AS batch, row_idx, size, count(*) OVER (PARTITION BY row_idx // 64) AS n FROM o)
SELECT batch, count(*) AS rows, sum(size)::BIGINT AS total, CASE WHEN any_value(n) = 64 THEN 4 ELSE 1 END AS parts, CASE WHEN any_value(n) = 64 THEN 16 ELSE any_value(n) END AS most, CASE WHEN any_value(n) = 64 THEN 1 END AS owners FROM b GROUP BY batch""")
def group_balanced_partitions(spark, sf):
    o = B.with_row_index(table(spark, sf, "orders").select("o_orderkey", F.round("o_totalprice").cast("bigint").alias("size")), ["o_orderkey"])
    o = o.withColumn("batch", F.floor(F.col("row_idx") / 64))
    parts = P.partition(o.select("batch", "row_idx", "size"), "batch", "row_idx", "size", lambda s: P.by_groups(s, [i // 4 for i in range(len(s))], 4) if len(s) == 64 else [list(range(len(s)))])
    # a run of four rows lies in one part
    runs = parts.groupBy("batch", F.floor(F.col("row_idx") / 4).alias("run")).agg(F.count_distinct("part").alias("owners")).groupBy("batch").agg(F.max("owners").alias("owners"))
    sums = parts.groupBy("batch", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("s")).groupBy("batch").agg(F.sum("n").alias("rows"), F.sum("s").alias("total"), F.count(F.lit(1)).alias("parts"), F.max("n").alias("most"))
    return sums.join(runs, "batch").withColumn("owners", F.when(F.col("parts") == 4, F.col("owners")))


@query(f"""{_T}, s AS (SELECT traj, sum(advantage * mask) / (sum(mask) + 1e-8) AS a, sum((1 - 2 * exp(old_lp) + sum_pi_squared) * mask) AS w FROM tok GROUP BY traj)
SELECT {s6('avg(a * a * greatest(w, 0))')} AS power, {s6('greatest((avg(a * a * greatest(w, 0)) - 0.25) / (count(*) - 1), 0)')} AS noise, {s6('avg(a * a)')} AS expected_a_squared, {s6('avg(w)')} AS expected_w FROM s""")
def variance_proxies(spark, sf):
    m = M.variance_proxies(tokens(spark, sf), 0.5).drop("signal")
    return m.select(*(r6(c).alias(c) for c in m.columns))


@query(f"""WITH e AS (SELECT event_id, event_type <> 'view' AS named, user_id % 5 AS u, event_id % 4 AS v, event_id % 6 = 0 AS extra FROM events),
p AS (SELECT *, CASE WHEN named AND u = v AND NOT extra THEN 3.0 WHEN NOT named THEN -3.0 ELSE -3 + 6 * (1 + CASE WHEN extra THEN 0.5 ELSE 1 END + CASE WHEN u = v THEN 1 ELSE 0 END) / 3.0 END AS score FROM e)
SELECT event_id, {s6('score')} AS score FROM p""")
def tool_call_score(spark, sf):
    def call(name, v, more):
        return F.concat(F.lit('<tool_call>\n{"name": "'), name, F.lit('", "parameters": {"u": '), v.cast("string"), more, F.lit("}}\n</tool_call>"))

    given = F.when(F.col("event_type") == "view", "other").otherwise(F.col("event_type"))
    extra = F.when(F.col("event_id") % 6 == 0, ', "w": 1').otherwise("")
    text, truth = call(given, F.col("event_id") % 4, extra), call(F.col("event_type"), F.col("user_id") % 5, F.lit(""))
    return table(spark, sf, "events").select("event_id", r6(G.tool_call_score(text, truth)).alias("score"))
