"""Queries: group statistics, advantages, returns, KL control."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import advantage as A
from ..operators import losses as L
from ..operators import masked as M
from .base import TOKENS_SQL, TRAJ_SQL, query, r6, r8, s6, s8, table, tokens, trajectories

_T = f"WITH {TOKENS_SQL}"
_S = f"{_T}, {TRAJ_SQL}"
_BY = ["uid", "prio"]
_STATS = f"""{_S}, g AS MATERIALIZED (SELECT *, count(*) OVER w AS n, CASE WHEN count(*) OVER w = 1 THEN 0 ELSE avg(score) OVER w END AS m,
  CASE WHEN count(*) OVER w = 1 THEN 1 ELSE stddev_samp(score) OVER w END AS sd FROM traj WINDOW w AS (PARTITION BY uid, prio))"""


def _out(df, *extra):
    return df.select("traj", r6("advantage").alias("advantage"), *extra)


@query(f"{_STATS} SELECT traj, {s6('(score - m) / (sd + 1e-6)')} AS advantage FROM g")
def grpo(spark, sf):
    return _out(A.grpo(trajectories(spark, sf), _BY))


@query(f"{_STATS} SELECT traj, {s6('score - m')} AS advantage FROM g")
def grpo_centred(spark, sf):
    return _out(A.grpo(trajectories(spark, sf), _BY, scale=False))


@query(f"{_STATS} SELECT traj, CAST(n AS BIGINT) AS n, {s6('m')} AS mean, {s6('sd')} AS std FROM g")
def group_mean_std(spark, sf):
    return M.group_stats(trajectories(spark, sf), _BY, "score").select("traj", F.col("g_n").alias("n"), r6("g_mean").alias("mean"), r6("g_std").alias("std"))


@query(f"{_STATS} SELECT traj, {s6('CASE WHEN n > 1 THEN n * (score - m) / (n - 1) ELSE score END')} AS advantage FROM g")
def rloo(spark, sf):
    return _out(A.rloo(trajectories(spark, sf), _BY))


@query(f"{_STATS} SELECT traj, {s6('CASE WHEN n > 1 THEN n * (score - m) / (n - 1) ELSE 0 END')} AS advantage FROM g")
def rloo_vectorized(spark, sf):
    return _out(A.rloo_zero(trajectories(spark, sf), _BY))


@query(f"""{_S} SELECT traj, {s6('score - CASE WHEN count(*) OVER w > 1 THEN coalesce(sum(length * score) OVER w / nullif(sum(length) OVER w, 0), 0) ELSE 0 END')} AS advantage
FROM traj WINDOW w AS (PARTITION BY uid, prio)""")
def opo(spark, sf):
    return _out(A.opo(trajectories(spark, sf), _BY))


@query(f"{_STATS} SELECT traj, {s6('(SELECT count(*) / greatest(count(*) FILTER (WHERE score <> 0), 1) FROM traj) * (score - m)')} AS advantage FROM g")
def gpg(spark, sf):
    return _out(A.gpg(trajectories(spark, sf), _BY))


@query(f"""{_S}, big AS (SELECT * FROM traj WHERE uid IN (SELECT uid FROM traj GROUP BY uid HAVING count(*) > 1)),
k AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY score DESC, traj) AS k, lead(score) OVER (PARTITION BY uid ORDER BY score DESC, traj) AS nxt, stddev_samp(score) OVER (PARTITION BY uid) AS sd FROM big)
SELECT traj, {s6('CASE WHEN k = 1 THEN (score - nxt) / (sd + 1e-6) ELSE 0 END')} AS advantage FROM k""")
def grpo_passk(spark, sf):
    t = trajectories(spark, sf)
    big = t.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("uid")
    return _out(A.pass_at_k(t.join(big, "uid", "left_semi"), ["uid"]))


@query(f"""{_STATS} SELECT tok.traj, tok.pos, {s6('(score - m) / (sd + 1e-6) * mask')} AS advantage FROM tok JOIN g USING (traj)""")
def grpo_tokens(spark, sf):
    t = tokens(spark, sf)
    return A.broadcast_scalar(t, A.grpo(A.trajectories(t, keep=("prio",)), _BY)).select("traj", "pos", r6("advantage").alias("advantage"))


def _whiten_sql(source: str, value: str) -> str:
    return f"""mu AS MATERIALIZED (SELECT sum(CASE WHEN mask > 0 THEN {value} ELSE 0 END) / (sum(mask) + 1e-8) AS m, CAST(sum(mask) AS DOUBLE) AS n FROM {source}),
    va AS MATERIALIZED (SELECT any_value(m) AS m, sum(CASE WHEN mask > 0 THEN ({value} - m) * ({value} - m) ELSE 0 END) / (any_value(n) + 1e-8) * any_value(n) / (any_value(n) - 1) AS v FROM {source}, mu)"""


@query(f"{_T}, {_whiten_sql('tok', 'value')} SELECT traj, pos, {s6('(value - m) / sqrt(v + 1e-8)')} AS whitened FROM tok, va")
def masked_whiten(spark, sf):
    return M.whiten(tokens(spark, sf), "value", "mask", "whitened").select("traj", "pos", r6("whitened").alias("whitened"))


@query(f"{_T} SELECT {s6('sum(value * mask)')} AS total, {s6('sum(value * mask) / (sum(mask) + 1e-8)')} AS mean, {s6('sum(value * mask) / sum(mask)')} AS plain_mean FROM tok")
def masked_sum_mean(spark, sf):
    v, m = F.col("value"), F.col("mask")
    return tokens(spark, sf).agg(r6(M.masked_sum(v, m)).alias("total"), r6(M.masked_mean(v, m)).alias("mean"), r6(M.plain_masked_mean(v, m)).alias("plain_mean"))


@query(f"{_T}, {_whiten_sql('tok', 'value')} SELECT {s6('m')} AS mean, {s6('v')} AS variance FROM va")
def masked_var(spark, sf):
    return M.whitening(tokens(spark, sf), "value", "mask").select(r6("_mean").alias("mean"), r6("_var").alias("variance"))


@query(f"{_T} SELECT {s6('avg(reward)')} AS mean, {s6('max(reward)')} AS max, {s6('min(reward)')} AS min, {s6('stddev_samp(reward)')} AS std FROM tok")
def distributed_stats(spark, sf):
    return M.spread_stats(tokens(spark, sf), "reward").select(*(r6(c).alias(c) for c in ("mean", "max", "min", "std")))


@query(f"{_STATS}, ti AS MATERIALIZED (SELECT tok.traj, tok.pos, tok.mask, (score - m) * mask AS a FROM tok JOIN g USING (traj)), {_whiten_sql('ti', 'a')} SELECT traj, pos, {s6('(a - m) / sqrt(v + 1e-8) * mask')} AS advantage FROM ti, va")
def reinforce_pp_baseline(spark, sf):
    return A.reinforce_pp_baseline(tokens(spark, sf), _BY).select("traj", "pos", r6("advantage").alias("advantage"))


@query(f"""{_T}, sc AS (SELECT uid, traj, sum(reward) AS a, sum(value) AS b FROM tok GROUP BY ALL),
n AS (SELECT traj, CASE WHEN count(*) OVER w = 1 THEN a / (1 + 1e-6) ELSE (a - avg(a) OVER w) / (stddev_samp(a) OVER w + 1e-6) END AS na, CASE WHEN count(*) OVER w = 1 THEN b / (1 + 1e-6) ELSE (b - avg(b) OVER w) / (stddev_samp(b) OVER w + 1e-6) END AS nb FROM sc WINDOW w AS (PARTITION BY uid)),
ti AS MATERIALIZED (SELECT tok.traj, tok.pos, tok.mask, (na + 0.5 * nb) * mask AS x FROM tok JOIN n USING (traj)), {_whiten_sql('ti', 'x')}
SELECT traj, pos, round((x - m) / sqrt(v + 1e-8) * mask, 5) + 0.0 AS advantage FROM ti, va""")
def gdpo(spark, sf):
    t = tokens(spark, sf)
    scores = t.groupBy("uid", "traj").agg(F.sum("reward").alias("a"), F.sum("value").alias("b"))
    return A.gdpo(scores, t, ["uid"], {"a": 1.0, "b": 0.5}).select("traj", "pos", (F.round("advantage", 5) + F.lit(0.0)).alias("advantage"))


_GAE_CTE = f"""WITH RECURSIVE {TOKENS_SQL}, t AS (SELECT *, max(pos) OVER (PARTITION BY traj) AS top FROM tok),
rec AS (
  SELECT traj, pos, mask, value, CASE WHEN mask > 0 THEN value ELSE 0 END AS nv, CASE WHEN mask > 0 THEN reward - value ELSE 0 END AS la FROM t WHERE pos = top
  UNION ALL
  SELECT t.traj, t.pos, t.mask, t.value, CASE WHEN t.mask > 0 THEN t.value ELSE rec.nv END, CASE WHEN t.mask > 0 THEN t.reward + 0.99123457 * rec.nv - t.value + 0.99123457 * 0.95123457 * rec.la ELSE rec.la END
  FROM rec JOIN t ON t.traj = rec.traj AND t.pos = rec.pos - 1)"""


@query(f"{_GAE_CTE} SELECT traj, pos, {s8('la')} AS raw_advantage, {s8('la + value')} AS returns FROM rec")
def gae_returns(spark, sf):
    return A.gae_raw(tokens(spark, sf), 0.99123457, 0.95123457).select("traj", "pos", r8("raw_advantage").alias("raw_advantage"), r8("returns").alias("returns"))


@query(f"{_GAE_CTE}, {_whiten_sql('rec', 'la')} SELECT traj, pos, {s6('(la - m) / sqrt(v + 1e-8)')} AS advantage FROM rec, va")
def gae(spark, sf):
    return A.gae(tokens(spark, sf), 0.99123457, 0.95123457).select("traj", "pos", r6("advantage").alias("advantage"))


_RPP = f"""WITH RECURSIVE {TOKENS_SQL}, t AS (SELECT *, max(pos) OVER (PARTITION BY traj) AS top FROM tok),
rec AS (SELECT traj, pos, mask, reward AS ret FROM t WHERE pos = top UNION ALL
  SELECT t.traj, t.pos, t.mask, t.reward + 0.9 * rec.ret * rec.mask FROM rec JOIN t ON t.traj = rec.traj AND t.pos = rec.pos - 1)"""


@query(f"{_RPP}, {_whiten_sql('rec', 'ret')} SELECT traj, pos, {s6('ret')} AS returns, {s6('(ret - m) / sqrt(v + 1e-8) * mask')} AS advantage FROM rec, va")
def reinforce_pp(spark, sf):
    return A.reinforce_pp(tokens(spark, sf), 0.9).select("traj", "pos", r6("returns").alias("returns"), r6("advantage").alias("advantage"))


@query(f"""{_T}, b AS (SELECT traj, sum(value) AS baseline FROM tok GROUP BY traj)
SELECT traj, pos, {s8('sum(reward * mask) OVER (PARTITION BY traj ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)')} AS returns,
{s8('sum(reward * mask) OVER (PARTITION BY traj ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - baseline * mask')} AS advantage FROM tok JOIN b USING (traj)""")
def remax(spark, sf):
    t = tokens(spark, sf)
    with_base = t.join(t.groupBy("traj").agg(F.sum("value").alias("baseline")), "traj")
    return A.remax(with_base).select("traj", "pos", r8("returns").alias("returns"), r8("advantage").alias("advantage"))


@query(f"""{_T}, g AS (SELECT traj, any_value(uid) AS uid, sum(reward) AS s, min(traj) OVER (PARTITION BY any_value(uid)) AS lo FROM tok GROUP BY traj),
b AS (SELECT uid, s AS baseline FROM g WHERE traj = lo) SELECT g.traj, {s6('baseline')} AS baseline FROM g JOIN b USING (uid) WHERE g.traj <> lo""")
def remax_baseline_rollout(spark, sf):
    t = tokens(spark, sf)
    first = t.groupBy("uid").agg(F.min("traj").alias("traj"))
    greedy = t.join(first, ["uid", "traj"], "left_semi")
    sampled = t.select("uid", "traj").distinct().join(first, ["uid", "traj"], "left_anti")
    return A.greedy_baseline(sampled, greedy).select("traj", r6("baseline").alias("baseline"))


def _otb_sql(position: str, source: str) -> str:
    return f"""{_T}, p AS (SELECT *, {position} AS apos FROM tok{source}),
w AS (SELECT *, sum(reward * mask) OVER (PARTITION BY traj ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS g,
  sum((1 - 2 * exp(old_lp) + sum_pi_squared) * mask) OVER (PARTITION BY traj ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw, sum(mask) OVER (PARTITION BY traj) AS len FROM p),
sz AS (SELECT uid, traj, max(len) AS len FROM w GROUP BY ALL), tp AS (SELECT uid, count(*) AS n, max(len) AS l1, max(len) FILTER (WHERE k = 2) AS l2 FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY len DESC) AS k FROM sz) GROUP BY uid),
b AS (SELECT uid, apos, sum(g * cw * mask) / (sum(cw * mask) + 1e-8) AS b FROM w GROUP BY uid, apos)
SELECT w.traj, w.pos, round((g - CASE WHEN n < 2 OR (len = l1 AND l1 > l2 AND w.apos >= l2) THEN 0 ELSE b END) * mask, 5) + 0.0 AS advantage FROM w JOIN b USING (uid, apos) JOIN tp USING (uid)"""


@query(_otb_sql("pos", ""))
def optimal_token_baseline(spark, sf):
    return A.token_baseline(tokens(spark, sf), ["uid"]).select("traj", "pos", (F.round("advantage", 5) + F.lit(0.0)).alias("advantage"))


@query(f"""{_T} SELECT t.traj, t.pos, coalesce(a.advantage, 0.0) AS advantage
FROM tok t LEFT JOIN ({_otb_sql("row_number() OVER (PARTITION BY traj ORDER BY pos) - 1", " WHERE mask > 0")}) a ON t.traj = a.traj AND t.pos = a.pos""")
def multi_turn_token_baseline(spark, sf):
    found = A.estimator("tir_optimal_token_baseline")(tokens(spark, sf), ["uid"])
    return found.select("traj", "pos", (F.round("advantage", 5) + F.lit(0.0)).alias("advantage"))


@query(f"""{_S}, s AS (SELECT *, traj % 4 AS session_id FROM traj), f AS (SELECT uid, session_id, arg_max(score, traj) AS score FROM s GROUP BY ALL),
a AS (SELECT uid, session_id, CASE WHEN count(*) OVER w = 1 THEN score / (1 + 1e-6) ELSE (score - avg(score) OVER w) / (stddev_samp(score) OVER w + 1e-6) END AS adv FROM f WINDOW w AS (PARTITION BY uid))
SELECT traj, {s6('adv')} AS advantage FROM s JOIN a USING (uid, session_id)""")
def multi_trajectory_advantage(spark, sf):
    rows = trajectories(spark, sf).withColumn("session_id", F.col("traj") % 4).withColumn("idx", F.col("traj"))
    return A.final_session_advantage(rows).select("traj", r6("advantage").alias("advantage"))


@query(f"{_T} SELECT traj, pos, {s6('reward - 0.05 * (old_lp - ref_lp) * mask')} AS reward FROM tok")
def kl_in_reward(spark, sf):
    t = tokens(spark, sf)
    return A.kl_in_reward(t, 0.05, L.kl_penalty(F.col("old_lp"), F.col("ref_lp"), "k1")).select("traj", "pos", r6("reward").alias("reward"))


@query(f"{_T}, k AS (SELECT traj, sum((exp(ref_lp - old_lp) - (ref_lp - old_lp) - 1) * mask) / (sum(mask) + 1e-8) AS k FROM tok GROUP BY traj) SELECT {s6('avg(k)')} AS current_kl FROM k")
def current_kl(spark, sf):
    return A.current_kl(tokens(spark, sf), L.kl_penalty(F.col("old_lp"), F.col("ref_lp"), "k3")).select(r6("current_kl").alias("current_kl"))


@query("""WITH RECURSIVE s AS (SELECT CAST(label AS BIGINT) AS step, avg(embedding[1]) AS kl, count(*) AS n FROM embeddings GROUP BY label),
rec AS (SELECT CAST(-1 AS BIGINT) AS step, 0.2::DOUBLE AS beta UNION ALL
SELECT s.step, rec.beta * (1 + greatest(least(s.kl / 0.1 - 1, 0.2), -0.2) * s.n / 1000.0) FROM rec JOIN s ON s.step = rec.step + 1)
SELECT step, round(beta, 6) + 0.0 AS beta FROM rec WHERE step >= 0""")
def adaptive_kl_controller(spark, sf):
    steps = table(spark, sf, "embeddings").groupBy(F.col("label").cast("bigint").alias("step")).agg(F.avg(F.col("embedding")[0]).alias("kl"), F.count(F.lit(1)).alias("n"))
    return A.adaptive_beta(steps, 0.2, 0.1, 1000.0).select("step", r6("beta").alias("beta"))


@query(f"{_S} SELECT traj, {s6('score * score + 1e-8')} AS weight FROM traj")
def preference_weights(spark, sf):
    return A.resample_weights(trajectories(spark, sf), "score").select("traj", r6("weight").alias("weight"))


@query(f"""{_S}, sp AS (SELECT traj, sum(score * score + 1e-8) OVER (ORDER BY traj) AS hi, sum(score * score + 1e-8) OVER () AS total, score * score + 1e-8 AS w FROM traj),
d AS (SELECT range AS draw, CAST(('0x' || substr(md5('7:' || range), 1, 8)) AS BIGINT) / 4294967296.0 AS u FROM range(100))
SELECT draw, traj FROM d JOIN sp ON u * total >= hi - w AND u * total < hi""")
def preference_resample(spark, sf):
    weighted = A.resample_weights(trajectories(spark, sf), "score")
    return A.resample(weighted, 100, "7", "traj").select("draw", "traj")


@query("""SELECT l.label, CAST(row_number() OVER (ORDER BY l.label) - 1 AS INT) AS dense, n FROM (SELECT label * 10 AS label, count(*) AS n FROM embeddings GROUP BY label) l""")
def dense_group_labels(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("label") * 10).alias("label"))
    return M.dense_labels(e, "label", "dense").groupBy("label", "dense").agg(F.count(F.lit(1)).alias("n"))
