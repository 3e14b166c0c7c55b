"""Queries: evaluation, validation, training metrics, aggregation, streaming rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..streaming import queues as S
from .base import TOKENS_SQL, query, r6, s6, table, tokens

_T = f"WITH {TOKENS_SQL}"


def events(spark, sf):
    return table(spark, sf, "events")


@query(f"WITH p AS (SELECT o_orderpriority AS src, o_custkey, avg(o_totalprice / 1000) AS s FROM orders GROUP BY ALL) SELECT src, {s6('avg(s)')} AS test_score, count(*) AS prompts FROM p GROUP BY src")
def offline_eval(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("src"), "o_custkey", (F.col("o_totalprice") / 1000).alias("s"))
    return M.offline_eval(o, "src", "o_custkey", "s").select("src", r6("test_score").alias("test_score"), "prompts")


_V = "WITH v AS (SELECT o_orderstatus AS src, o_custkey AS uid, o_totalprice / 1000 AS x, row_number() OVER w AS i, count(*) OVER (PARTITION BY o_orderstatus, o_custkey) AS n FROM orders WINDOW w AS (PARTITION BY o_orderstatus, o_custkey ORDER BY o_totalprice)), e AS (SELECT src, uid, avg(x) AS mean, stddev_pop(x) AS std, "
_V += ", ".join(f"sum(x * (pow(i / n, {k}) - pow((i - 1) / n, {k}))) AS b{k}, sum(x * (pow((n - i + 1) / n, {k}) - pow((n - i) / n, {k}))) AS w{k}" for k in (2, 4)) + " FROM v GROUP BY ALL) "
_V += " UNION ALL ".join(f"SELECT src, '{m}' AS metric, {s6(f'avg({c})')} AS value FROM e GROUP BY src" for m, c in (("mean", "mean"), ("std", "std"), ("best@2", "b2"), ("worst@2", "w2"), ("best@4", "b4"), ("worst@4", "w4")))


@query(_V)
def validation_metrics(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("src"), F.col("o_custkey").alias("uid"), (F.col("o_totalprice") / 1000).alias("x"))
    return M.validation(o, "src", "uid", "x", [2, 4]).select("src", "metric", r6("value").alias("value"))


@query("""WITH v AS (SELECT o_custkey, o_orderpriority AS vote, count(*) AS n, min(o_orderkey) AS f, arg_min(o_totalprice, o_orderkey) AS value FROM orders GROUP BY ALL)
SELECT o_custkey, vote, value, n FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, f) AS k FROM v) WHERE k = 1""")
def majority_vote(spark, sf):
    return M.majority(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", "o_totalprice", "o_orderkey")


@query("""WITH n AS (SELECT DISTINCT CASE o_orderstatus WHEN 'F' THEN 'acc' WHEN 'O' THEN 'accuracy' ELSE 'reward' END || '/' || ['mean', 'best', 'maj', 'std'][o_custkey % 4 + 1] || '@' || (o_orderkey % 3 + 3) || CASE WHEN o_custkey % 5 = 0 THEN '/mean' ELSE '' END AS name FROM orders)
SELECT name, CASE WHEN regexp_matches(name, '^acc/(mean|maj|best)@4(/|$)') THEN 'val-core' ELSE 'val-aux' END AS section FROM n""")
def validation_sections(spark, sf):
    o = table(spark, sf, "orders")
    core = F.when(F.col("o_orderstatus") == "F", "acc").when(F.col("o_orderstatus") == "O", "accuracy").otherwise("reward")
    kind = F.element_at(F.array(*map(F.lit, ("mean", "best", "maj", "std"))), (F.col("o_custkey") % 4 + 1).cast("int"))
    name = F.concat(core, F.lit("/"), kind, F.lit("@"), (F.col("o_orderkey") % 3 + 3).cast("string"), F.when(F.col("o_custkey") % 5 == 0, "/mean").otherwise(""))
    return o.select(name.alias("name")).distinct().select("name", M.section(F.col("name"), "acc", 4).alias("section"))


@query(f"""{_T}, s AS (SELECT traj, sum(reward) AS score, sum(mask) AS n FROM tok GROUP BY traj), t AS (SELECT avg(reward) AS rm, avg(advantage) AS am, max(advantage) AS ax, avg(value) AS vm, 1 - var_samp(reward - value) / (var_samp(reward) + 1e-5) AS ev FROM tok WHERE mask > 0)
SELECT {s6('avg(CASE WHEN n > 0 THEN score END)')} AS score_mean, {s6('max(CASE WHEN n > 0 THEN score END)')} AS score_max, {s6('min(CASE WHEN n > 0 THEN score END)')} AS score_min, {s6('avg(n)')} AS length_mean, max(n)::BIGINT AS length_max, min(n)::BIGINT AS length_min,
{s6('avg(CASE WHEN n = 0 THEN 1.0 ELSE 0 END)')} AS aborted_ratio, {s6('any_value(rm)')} AS returns_mean, {s6('any_value(am)')} AS advantage_mean, {s6('any_value(ax)')} AS advantage_max, {s6('any_value(vm)')} AS value_mean, {s6('any_value(ev)')} AS explained_variance FROM s, t""")
def training_metrics(spark, sf):
    m = M.training_metrics(tokens(spark, sf))
    return m.select(*(F.col(c) if c in ("length_max", "length_min") else r6(c).alias(c) for c in m.columns))


@query(f"SELECT event_type AS name, {s6('CASE WHEN count(*) > 0 THEN sum(value) * 1000 / (SELECT CASE WHEN event_type = ' + chr(39) + 'view' + chr(39) + ' THEN 500 ELSE 900 END) ELSE 0 END')} AS ms_per_token FROM events GROUP BY event_type")
def timing_per_token(spark, sf):
    sections = events(spark, sf).groupBy(F.when(F.col("event_type") == "view", "gen").otherwise(F.col("event_type")).alias("name")).agg(F.sum("value").alias("s"))
    out = M.timing(sections, spark.createDataFrame([(500, 900)], "response_tokens int, all_tokens int"), "name", "s")
    return out.select(F.when(F.col("name") == "gen", "view").otherwise(F.col("name")).alias("name"), r6("ms_per_token").alias("ms_per_token"))


@query("""WITH r AS (SELECT vec_id // 10 AS row, vec_id % 10 AS pos, CAST(vec_id % 3 AS INT) AS layer, label AS expert, vec_id % 7 <> 0 AS ok FROM embeddings), k AS (SELECT *, max(CASE WHEN ok THEN pos END) OVER (PARTITION BY row) AS top FROM r),
g AS (SELECT l AS layer, e AS expert FROM (SELECT unnest([0, 1, 2]) AS l), (SELECT unnest(range(12)) AS e)), c AS (SELECT layer, expert, count(*) AS n FROM k WHERE ok AND pos < top GROUP BY ALL), f AS (SELECT g.layer, CAST(g.expert AS INT) AS expert, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (layer, expert))
SELECT layer, expert, n, round(n * 12 / sum(n) OVER (PARTITION BY layer) - 1, 6) + 0.0 AS violation FROM f""")
def moe_load_balance(spark, sf):
    e = table(spark, sf, "embeddings").select(F.floor(F.col("vec_id") / 10).alias("row"), (F.col("vec_id") % 10).alias("pos"), (F.col("vec_id") % 3).cast("int").alias("layer"), F.col("label").alias("expert"), (F.col("vec_id") % 7 != 0).alias("ok"))
    return M.routed_load(e, 12, "row", "pos", "layer", "expert", F.col("ok")).select("layer", "expert", "n", r6("violation").alias("violation"))


@query("SELECT user_id // 4 AS interval, event_type, count(*) AS n FROM events GROUP BY ALL")
def moe_interval_sums(spark, sf):
    e = events(spark, sf).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return M.interval_sums(e, "user_id", ["event_type"], "n", 4)


@query(f"SELECT {s6('sum(l_quantity) / sum(l_linenumber)')} AS accept_rate, {s6('1 + sum(l_quantity) / sum(l_suppkey)')} AS accept_length FROM lineitem WHERE l_returnflag <> 'A'")
def spec_decode(spark, sf):
    m = M.speculative(table(spark, sf, "lineitem"), "l_linenumber", "l_quantity", "l_suppkey", F.col("l_returnflag") == "A")
    return m.select(r6("accept_rate").alias("accept_rate"), r6("accept_length").alias("accept_length"))


@query(f"{_T} SELECT {s6('max(abs(exp(lp) - exp(rollout_lp)))')} AS max, {s6('avg(abs(exp(lp) - exp(rollout_lp)))')} AS mean, {s6('stddev_samp(abs(exp(lp) - exp(rollout_lp)))')} AS std, {s6('corr(exp(lp), exp(rollout_lp))')} AS pearson FROM tok WHERE mask > 0")
def debug_metrics(spark, sf):
    m = M.probability_gap(tokens(spark, sf), F.col("lp"), F.col("rollout_lp"))
    return m.select(*(r6(c).alias(c) for c in m.columns))


_NAMES = "(SELECT user_id AS step, CASE event_type WHEN 'view' THEN 'loss/max' WHEN 'click' THEN 'minibatch/x' WHEN 'error' THEN 'timing/gen' WHEN 'signup' THEN 'actor/lr' ELSE 'actor/total' END AS name, avg(value) AS value, count(*) AS sample_count FROM events GROUP BY ALL)"


def named(spark, sf):
    name = F.create_map(*map(F.lit, ("view", "loss/max", "click", "minibatch/x", "error", "timing/gen", "signup", "actor/lr")))[F.col("event_type")]
    return events(spark, sf).groupBy(F.col("user_id").alias("step"), F.coalesce(name, F.lit("actor/total")).alias("name")).agg(F.avg("value").alias("value"), F.count(F.lit(1)).cast("double").alias("sample_count"))


@query(f"SELECT name, {s6('CASE WHEN contains(name, ' + chr(39) + 'max' + chr(39) + ') THEN max(value) WHEN contains(name, ' + chr(39) + 'min' + chr(39) + ') THEN min(value) ELSE avg(value) END')} AS value FROM {_NAMES} GROUP BY name")
def reduce_metrics(spark, sf):
    return named(spark, sf).groupBy("name").agg(r6(M.reduced(F.col("name"), F.col("value"))).alias("value"))


@query(f"""SELECT name, round(CASE name WHEN 'loss/max' THEN max(value) WHEN 'minibatch/x' THEN min(value) WHEN 'timing/gen' THEN sum(value) WHEN 'actor/lr' THEN arg_max(value, step) ELSE sum(value) END, 6) + 0.0 AS value FROM {_NAMES} GROUP BY name""")
def step_aggregator(spark, sf):
    return M.aggregate_steps(named(spark, sf)).select("name", r6("value").alias("value"))


@query(f"WITH d AS (SELECT event_type, user_id % 3 AS step, avg(value) AS v FROM events GROUP BY ALL) SELECT event_type, {s6('sum(v)')} AS value FROM d GROUP BY event_type")
def metric_across_ranks(spark, sf):
    e = events(spark, sf).withColumn("step", F.col("user_id") % 3)
    return M.across_ranks(e, ["event_type"], "user_id", "step", "value", "sum").select("event_type", r6("value").alias("value"))


@query(f"SELECT {s6('avg(l_suppkey - l_linenumber + 1)')} AS span_mean, max(l_suppkey - l_linenumber + 1) AS span_max, {s6('avg(l_partkey - 1 - l_suppkey)')} AS staleness_mean, max(l_partkey - 1 - l_suppkey) AS staleness_max, max(l_partkey - 1 - l_linenumber) AS staleness_worst FROM lineitem")
def staleness_metrics(spark, sf):
    m = M.staleness(table(spark, sf, "lineitem"), "l_linenumber", "l_suppkey", "l_partkey")
    return m.select(r6("span_mean").alias("span_mean"), "span_max", r6("staleness_mean").alias("staleness_mean"), "staleness_max", "staleness_worst")


@query(f"SELECT {s6('avg(value)')} AS mean, {s6('max(value)')} AS max, {s6('min(value)')} AS min, {s6('quantile_cont(value, 0.5)')} AS p50, {s6('quantile_cont(value, 0.95)')} AS p95, {s6('quantile_cont(value, 0.99)')} AS p99 FROM events")
def latency_stats(spark, sf):
    m = M.latency(events(spark, sf), "value")
    return m.select(*(r6(c).alias(c) for c in m.columns))


@query(f"""WITH e AS (SELECT value AS s, CASE WHEN event_type = 'click' THEN value / 3 END AS c, user_id % 7 AS a, user_id % 7 + CASE WHEN event_id % 4 = 0 THEN event_id % 3 ELSE 0 END AS b FROM events)
SELECT {s6('avg(s)')} AS mean, {s6('max(s)')} AS max, {s6('min(s)')} AS min, {s6('quantile_cont(s, 0.5)')} AS p50, {s6('quantile_cont(s, 0.95)')} AS p95, {s6('quantile_cont(s, 0.99)')} AS p99, {s6('max(c)')} AS tool_max, {s6('min(c)')} AS tool_min, {s6('avg(c)')} AS tool_mean,
count(*) FILTER (WHERE b > a) AS partial, {s6('avg(CASE WHEN b > a THEN 1.0 ELSE 0 END)')} AS partial_ratio, max(b - a) AS partial_span, count(DISTINCT b) AS versions FROM e""")
def sample_batch_stats(spark, sf):
    e, start = events(spark, sf), F.col("user_id") % 7
    rows = e.select("value", F.when(F.col("event_type") == "click", F.col("value") / 3).alias("calls"), start.alias("a"), (start + F.when(F.col("event_id") % 4 == 0, F.col("event_id") % 3).otherwise(0)).alias("b"))
    m = M.sample_batch(rows, "value", "calls", "a", "b")
    return m.select(*(r6(c).alias(c) for c in m.columns if c not in ("partial", "partial_span", "versions")), "partial", "partial_span", "versions")


@query(f"SELECT CASE WHEN grouping(o_orderpriority) = 0 THEN o_orderpriority END AS o_orderpriority, count(*) AS n, {s6('avg(CASE WHEN o_orderstatus = ' + chr(39) + 'F' + chr(39) + ' THEN 1.0 ELSE 0 END)')} AS valid_rate, {s6('quantile_cont(o_totalprice, 0.5)')} AS p50 FROM orders GROUP BY GROUPING SETS ((), (o_orderpriority))")
def summary_by_ratio(spark, sf):
    m = {"n": F.count(F.lit(1)), "valid_rate": r6(F.avg((F.col("o_orderstatus") == "F").cast("double")))}
    s = M.summarise(table(spark, sf, "orders"), ["o_orderpriority"], m, exact={"p50": ("o_totalprice", 0.5)})
    return s.select("o_orderpriority", "n", "valid_rate", r6("p50").alias("p50"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_totalprice) AS top FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def summary_cube(spark, sf):
    m = {"n": F.count(F.lit(1)), "top": F.max("o_totalprice")}
    return M.summarise(table(spark, sf, "orders"), ["o_orderstatus", "o_orderpriority"], m, cube=True).drop("level")


@query("SELECT conv_id, string_agg(role, '/' ORDER BY turn) AS pattern, CASE WHEN count(DISTINCT role) = 1 THEN 'uniform' ELSE 'mixed' END AS kind FROM conversations GROUP BY conv_id")
def mode_patterns(spark, sf):
    return M.pattern_by(table(spark, sf, "conversations"), "conv_id", "turn", "role")


_STATUS = "CASE event_type WHEN 'view' THEN 'pending' WHEN 'signup' THEN 'pending' WHEN 'click' THEN 'running' WHEN 'purchase' THEN 'finished' ELSE 'failure' END"


def tags(spark, sf):
    return events(spark, sf).selectExpr("user_id AS uid", "event_id AS seq", f"{_STATUS} AS status", "value")


@query("SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 50")
def queue_drop_oldest(spark, sf):
    return S.bounded_queue(events(spark, sf), ["ts", "event_id"], 50)[0].select("event_id")


@query("SELECT count(*) AS produced, least(count(*), 50) AS size, greatest(count(*) - 50, 0) AS dropped FROM events")
def queue_counters(spark, sf):
    return S.queue_statistics(events(spark, sf), 50).select("produced", F.col("size").cast("bigint").alias("size"), F.col("dropped").cast("bigint").alias("dropped"))


@query(f"SELECT user_id AS uid, arg_max({_STATUS}, event_id) AS status, max(event_id) AS seq FROM events GROUP BY user_id")
def replay_status(spark, sf):
    return S.latest_status(tags(spark, sf))


@query("SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1 AND min(l_tax) = max(l_tax)")
def zero_variance_groups(spark, sf):
    return S.zero_variance(table(spark, sf, "lineitem"), "l_orderkey", "l_tax")


@query("SELECT user_id, count(*) AS n FROM events WHERE NOT (500 - event_id + 1 > 300) GROUP BY user_id")
def stale_eviction(spark, sf):
    return S.evict(events(spark, sf), 500, "event_id", 300)[0].groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS evicted, {s6('avg(501 - event_id)')} AS age_mean, max(501 - event_id) AS age_max, min(501 - event_id) AS age_min FROM events WHERE 501 - event_id > 300")
def eviction_metrics(spark, sf):
    m = S.eviction_metrics(S.evict(events(spark, sf), 500, "event_id", 300)[1], 500, "event_id")
    return m.select("evicted", r6("age_mean").alias("age_mean"), "age_max", "age_min")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10)")
def replay_batch(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return S.materialise(S.select_batch(c, 10, "c_acctbal", "o_custkey"), table(spark, sf, "orders"), "o_custkey").select("o_orderkey")


@query(f"WITH p AS (SELECT user_id AS uid, arg_max({_STATUS}, event_id) AS status, max(event_id) AS birth FROM events GROUP BY 1) SELECT uid, CASE WHEN status IN ('pending', 'running') THEN 'pending' ELSE status END AS status, CASE WHEN status IN ('pending', 'running') THEN 7 ELSE birth END AS birth FROM p")
def in_flight_reissue(spark, sf):
    p = S.latest_status(tags(spark, sf)).withColumnRenamed("seq", "birth")
    return S.reissue(p, tags(spark, sf), 7)[0].select("uid", "status", "birth")


@query("SELECT conv_id, turn, last_value(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS n FROM conversations")
def trajectory_emit(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id", "turn", F.length("text").cast("bigint").alias("n"))
    return S.final_reward(c, ["conv_id"], "turn", "n")


@query("SELECT event_id, CAST(sum(CASE event_type WHEN 'click' THEN 1 WHEN 'purchase' THEN -1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS in_flight FROM events")
def staleness_load(spark, sf):
    e = S.running_load(events(spark, sf), ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "purchase", ["user_id"])
    return e.select("event_id", "in_flight")


@query(f"SELECT epoch(time_bucket(INTERVAL '1 day', ts))::BIGINT AS start, event_type, count(*) AS n, {s6('sum(value)')} AS total FROM events GROUP BY ALL")
def window_tumbling(spark, sf):
    w = S.tumbling(events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"])
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n", r6("total").alias("total"))


@query("SELECT (epoch(time_bucket(INTERVAL '6 hours', ts))::BIGINT - k * 21600) AS start, event_type, count(*) AS n FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY ALL")
def window_sliding(spark, sf):
    w = S.sliding(events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "12 hours", "6 hours", ["event_type"])
    return w.select(F.unix_timestamp("start").alias("start"), "event_type", "n")


@query("""WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL '6 hours' THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS n, floor(epoch(min(ts)))::BIGINT AS start FROM s GROUP BY user_id, k""")
def window_session(spark, sf):
    w = S.sessions(events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["user_id"])
    return w.select("user_id", "n", F.unix_timestamp("start").alias("start"))
