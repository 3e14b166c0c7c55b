"""Queries: importance weights, rejection, diagnostics, losses, divergences, logits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays as R
from ..operators import losses as L
from ..operators import offpolicy as O
from .base import TOKENS_SQL, query, r6, s6, table, tokens

_T = f"WITH {TOKENS_SQL}"
_LR = "(old_lp - rollout_lp)"


def _cols():
    return F.col("lp"), F.col("old_lp"), F.col("advantage"), F.col("mask")


def _lr():
    return F.col("old_lp") - F.col("rollout_lp")


@query(f"{_T} SELECT traj, pos, {s6(f'least(exp({_LR}) * mask, 1.02)')} AS weight FROM tok")
def is_weights_token(spark, sf):
    return O.importance_weights(tokens(spark, sf), _lr(), "token", 1.02).select("traj", "pos", r6("weight").alias("weight"))


@query(f"""{_T}, w AS (SELECT traj, pos, exp(greatest(least(sum({_LR} * mask) OVER (PARTITION BY traj), 20), -20)) * mask AS w FROM tok)
SELECT traj, pos, {s6('CASE WHEN w >= 0.9 AND w <= 1.1 THEN w ELSE 0 END')} AS weight FROM w""")
def is_weights_sequence_band(spark, sf):
    return O.importance_weights(tokens(spark, sf), _lr(), "sequence", "0.9_1.1").select("traj", "pos", r6("weight").alias("weight"))


@query(f"""{_T}, w AS (SELECT traj, pos, mask, least(exp({_LR}) * mask, 1.02) AS w FROM tok), a AS (SELECT sum(w * mask) / (sum(mask) + 1e-8) AS m FROM w) SELECT traj, pos, {s6('w / greatest(m, 1e-8)')} AS weight FROM w, a""")
def is_weights_normalised(spark, sf):
    return O.importance_weights(tokens(spark, sf), _lr(), "token", 1.02, normalise=True).select("traj", "pos", r6("weight").alias("weight"))


@query(f"""{_T} SELECT traj, pos, CASE WHEN {_LR} BETWEEN ln(1 / 1.03) AND ln(1.03) AND sum((exp({_LR}) - 1 - {_LR}) * mask) OVER (PARTITION BY traj) / (sum(mask) OVER (PARTITION BY traj) + 1e-8) <= 0.0004
AND max(CASE WHEN mask > 0 THEN 0.5 * {_LR} * {_LR} END) OVER (PARTITION BY traj) <= 0.001 THEN mask ELSE 0 END AS new_mask FROM tok""")
def rejection_mask(spark, sf):
    return O.rejection_mask(tokens(spark, sf), _lr(), {"token_k1": 1.03, "seq_mean_k3": 0.0004, "seq_max_k2": 0.001}).select("traj", "pos", "new_mask")


@query(f"""{_T}, w AS (SELECT exp({_LR}) AS r, least(exp({_LR}), 1.02) AS w FROM tok WHERE mask > 0) SELECT {s6('avg(w)')} AS mean, {s6('max(r)')} AS max, {s6('min(r)')} AS min, {s6('stddev_samp(w)')} AS std,
{s6('avg(w) * avg(w) / avg(w * w)')} AS ess, {s6('avg(CASE WHEN r > 1.02 THEN 1.0 ELSE 0 END)')} AS fraction_high, {s6('avg(CASE WHEN r < 0.98 THEN 1.0 ELSE 0 END)')} AS fraction_low FROM w""")
def is_metrics(spark, sf):
    m = O.weight_metrics(O.importance_weights(tokens(spark, sf), _lr(), "token", 1.02), 1.02, 0.98)
    return m.select(*(r6(c).alias(c) for c in m.columns))


@query(f"""{_T}, w AS (SELECT traj, mask, {_LR} AS v, CASE WHEN {_LR} BETWEEN ln(1 / 1.03) AND ln(1.03) THEN mask ELSE 0 END AS nm FROM tok), q AS (SELECT traj, max(CASE WHEN mask > 0 AND nm = 0 THEN 1 ELSE 0 END) AS hit FROM w GROUP BY traj)
SELECT {s6('avg(v) FILTER (WHERE mask > 0)')} AS mean, {s6('max(v) FILTER (WHERE mask > 0)')} AS max, {s6('min(v) FILTER (WHERE mask > 0)')} AS min, {s6('stddev_samp(v) FILTER (WHERE mask > 0)')} AS std,
{s6('count(*) FILTER (WHERE mask > 0 AND nm = 0) / sum(mask)')} AS masked_fraction, (SELECT {s6('avg(hit)')} FROM q) AS seq_masked_fraction FROM w""")
def rs_metrics(spark, sf):
    m = O.rejection_metrics(O.rejection_mask(tokens(spark, sf), _lr(), {"token_k1": 1.03}), _lr())
    return m.select(*(r6(c).alias(c) for c in m.columns))


@query(f"""{_T}, s AS (SELECT traj, sum(old_lp * mask) / (sum(mask) + 1e-8) AS t, sum(rollout_lp * mask) / (sum(mask) + 1e-8) AS r, sum({_LR} * mask) AS s, sum(mask) AS n, sum(exp(2 * {_LR}) * mask) AS rho2,
sum((exp({_LR}) - {_LR} - 1) * mask) AS k3, sum(-{_LR} * mask) AS k1 FROM tok GROUP BY traj HAVING sum(mask) > 0)
SELECT {s6('avg(exp(-t))')} AS training_ppl, {s6('avg(exp(-r))')} AS rollout_ppl, {s6('avg(r - t)')} AS log_ppl_diff, {s6('avg(abs(r - t))')} AS log_ppl_abs_diff, {s6('max(r - t)')} AS log_ppl_diff_max, {s6('min(r - t)')} AS log_ppl_diff_min,
{s6('avg(exp(r - t))')} AS ppl_ratio, {s6('sum(k1) / sum(n)')} AS kl, {s6('sum(k3) / sum(n)')} AS k3_kl, {s6('sum(rho2) / sum(n) - 1')} AS chi2_token, {s6('avg(exp(greatest(least(2 * s, 20), -20))) - 1')} AS chi2_seq FROM s""")
def offpolicy_diagnostics(spark, sf):
    m = O.diagnostics(tokens(spark, sf), F.col("old_lp"), F.col("rollout_lp"))
    return m.select(*(r6(c).alias(c) for c in m.columns))


@query(f"{_T} SELECT traj, pos, {s6(f'least(exp({_LR}) * mask, 1.02)')} AS weight, CASE WHEN 0.5 * {_LR} * {_LR} <= 0.0002 THEN mask ELSE 0 END AS mask FROM tok")
def combined_correction(spark, sf):
    return O.correct(tokens(spark, sf), _lr(), "token", 1.02, {"token_k2": 0.0002}).select("traj", "pos", r6("weight").alias("weight"), "mask")


@query(f"{_T} SELECT traj, pos, {s6('rollout_lp')} AS old_lp FROM tok")
def bypass_mode(spark, sf):
    return O.bypass(tokens(spark, sf)).select("traj", "pos", r6("old_lp").alias("old_lp"))


_R = "exp(lp - old_lp)"
_VANILLA = f"greatest(-advantage * {_R}, -advantage * greatest(least({_R}, 1.02), 0.98))"
_DUAL = f"CASE WHEN advantage < 0 THEN least({_VANILLA}, -advantage * 3) ELSE {_VANILLA} END"


def _loss(name: str, sql: str, build):
    def run(spark, sf):
        return tokens(spark, sf).select("traj", "pos", r6(build(*_cols())).alias("loss"))

    run.__name__ = name
    query(f"{_T} SELECT traj, pos, {s6(sql)} AS loss FROM tok")(run)


_loss("loss_ppo_dual_clip", _DUAL, lambda lp, old, adv, m: L.dual_clip(lp, old, adv, 0.02, 0.02))
_loss("loss_dppo_tv", f"CASE WHEN CASE WHEN advantage > 0 THEN exp(lp) - exp(old_lp) <= 0.01 ELSE exp(lp) - exp(old_lp) >= -0.01 END THEN -advantage * least({_R}, 20) ELSE 0 END", lambda lp, old, adv, m: L.dppo_tv(lp, old, adv, 0.01))
_KLB = "exp(old_lp) * (old_lp - lp) + (1 - exp(old_lp)) * ln((1 - exp(old_lp) + 1e-8) / (1 - exp(lp) + 1e-8))"
_loss("loss_dppo_kl", f"CASE WHEN {_KLB} > 0.01 AND CASE WHEN advantage > 0 THEN exp(lp) > exp(old_lp) ELSE exp(lp) < exp(old_lp) END THEN 0 ELSE -advantage * least({_R}, 20) END", lambda lp, old, adv, m: L.dppo_kl(lp, old, adv, 0.01))
_SEQ = "exp(least(sum((lp - old_lp) * mask) OVER (PARTITION BY traj) / greatest(sum(mask) OVER (PARTITION BY traj), 1), 10))"
_loss("loss_gspo", f"greatest(-advantage * {_SEQ}, -advantage * greatest(least({_SEQ}, 1 + 4e-4), 1 - 3e-4))", lambda lp, old, adv, m: L.gspo(lp, old, adv, m))
_loss("loss_sapo", f"-advantage / (1 + exp(-(CASE WHEN advantage > 0 THEN 1.0 ELSE 1.05 END) * ({_R} - 1))) * 4 / CASE WHEN advantage > 0 THEN 1.0 ELSE 1.05 END", lambda lp, old, adv, m: L.sapo(lp, old, adv))
_loss("loss_gpg", "-lp * advantage", lambda lp, old, adv, m: L.gpg(lp, old, adv))
_loss("loss_cispo", f"-greatest(least({_R}, 1.02), -9) * advantage * lp", lambda lp, old, adv, m: L.cispo(lp, old, adv, 10.0, 0.02))
_loss("loss_reinforce", f"-advantage * lp * {_R}", lambda lp, old, adv, m: L.reinforce(lp, old, adv, L.ratio(lp, old)))
_loss("loss_value_clipped", "0.5 * greatest((value - reward) * (value - reward), (greatest(least(value, old_lp + 0.5 + 0.5), old_lp + 0.5 - 0.5) - reward) * (greatest(least(value, old_lp + 0.5 + 0.5), old_lp + 0.5 - 0.5) - reward))", lambda lp, old, adv, m: L.value_loss(F.col("value"), F.col("reward"), old + 0.5))
for _kind, _sql in {"k1": "lp - ref_lp", "abs": "abs(lp - ref_lp)", "k2": "0.5 * (lp - ref_lp) * (lp - ref_lp)", "k3": "exp(ref_lp - lp) - (ref_lp - lp) - 1"}.items():
    _loss(f"kl_penalty_{_kind}", _sql, lambda lp, old, adv, m, k=_kind: L.kl_penalty(lp, F.col("ref_lp"), k))


@query(f"{_T} SELECT {s6(f'avg(CASE WHEN -advantage * greatest(least({_R}, 1.02), 0.98) > -advantage * {_R} THEN 1.0 ELSE 0 END) FILTER (WHERE mask > 0)')} AS clip_fraction, {s6('avg(old_lp - lp) FILTER (WHERE mask > 0)')} AS kl FROM tok")
def loss_clip_fraction(spark, sf):
    lp, old, adv, m = _cols()
    hit = F.when(m > 0, L.is_clipped(lp, old, adv, 0.02, 0.02).cast("double"))
    return tokens(spark, sf).agg(r6(F.avg(hit)).alias("clip_fraction"), r6(F.avg(F.when(m > 0, old - lp))).alias("kl"))


@L.register("halved")
def _halved(lp, old, adv):
    """A user's own loss."""
    return -adv * lp / 2


@query(f"{_T} SELECT 'gpg' AS name, traj, pos, {s6('-lp * advantage')} AS loss FROM tok UNION ALL SELECT 'halved', traj, pos, {s6('-lp * advantage / 2')} FROM tok UNION ALL SELECT 'vanilla', traj, pos, {s6(_DUAL.replace('1.02', '1.2').replace('0.98', '0.8'))} FROM tok")
def loss_by_name(spark, sf):
    """Losses by their registered names, one of them a user's."""
    lp, old, adv, _ = _cols()
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), r6(L.loss(n)(lp, old, adv)).alias("loss")) for n in ("gpg", "halved", "vanilla")))).alias("x")
    return tokens(spark, sf).select("traj", "pos", each).select("x.name", "traj", "pos", "x.loss")


_SEQS = f"{_T}, s AS (SELECT traj, sum(value * mask) AS s, sum(mask) AS n FROM tok GROUP BY traj HAVING sum(mask) > 0)"
_AGG = {
    "token-mean": f"{_T} SELECT {s6('sum(value * mask) / sum(mask)')} AS loss FROM tok", "token-sum": f"{_T} SELECT {s6('sum(value * mask)')} AS loss FROM tok",
    "seq-mean-token-sum": f"{_SEQS} SELECT {s6('avg(s)')} AS loss FROM s", "seq-mean-token-sum-norm": f"{_SEQS} SELECT {s6('sum(s) / count(*) / 7.0')} AS loss FROM s",
    "seq-mean-token-mean": f"{_SEQS} SELECT {s6('avg(s / (n + 1e-8))')} AS loss FROM s",
}
for _mode, _sql in _AGG.items():

    def _agg(spark, sf, mode=_mode):
        return L.aggregate(tokens(spark, sf), F.col("value"), mode, 7.0).select(r6("loss").alias("loss"))

    _agg.__name__ = "loss_agg_" + _mode.replace("-", "_")
    query(_sql)(_agg)


@query(f"""{_T}, k AS (SELECT traj, advantage, mask, CASE WHEN advantage > 0 THEN 1.0 ELSE -1.0 END AS sg, lp - old_lp AS d FROM tok),
s AS (SELECT traj, sum(least(sg * d, sg * greatest(least(d, 0.01), -0.01)) * sg * mask) / (sum(mask) + 1e-8) AS lg, sum(advantage * mask) / (sum(mask) + 1e-8) AS a FROM k GROUP BY traj) SELECT traj, {s6('-a * exp(lg)')} AS loss FROM s""")
def loss_geo_mean(spark, sf):
    return L.geo_mean_terms(tokens(spark, sf), F.col("lp"), F.col("old_lp"), 0.01, 0.01).select("traj", r6("loss").alias("loss"))


_COV = f"""{_T}, mu AS (SELECT avg(advantage) AS a, avg(lp) AS l, count(*) AS n FROM tok WHERE mask > 0), c AS (SELECT tok.*, (advantage - a) * (lp - l) AS cov, n, -advantage * greatest(least({_R}, 1.2), 0.8) > -advantage * {_R} AS clipped FROM tok, mu)"""


@query(f"""{_COV}, k AS (SELECT *, row_number() OVER (ORDER BY cov DESC, traj, pos) AS k FROM c WHERE mask > 0)
SELECT c.traj, c.pos, {s6(f'-c.advantage * exp(c.lp - c.old_lp) + CASE WHEN k.k <= greatest(floor(c.n * 0.01), 1) THEN abs(c.lp - c.old_lp) ELSE 0 END')} AS loss FROM c LEFT JOIN k ON c.traj = k.traj AND c.pos = k.pos""")
def loss_kl_cov(spark, sf):
    return L.kl_cov(tokens(spark, sf), F.col("lp"), F.col("old_lp"), share=0.01).select("traj", "pos", r6("loss").alias("loss"))


@query(f"""{_COV}, k AS (SELECT traj, pos, row_number() OVER (ORDER BY md5('cov:' || traj || ':' || pos), traj, pos) AS k FROM c WHERE mask > 0 AND cov > 0.001 AND cov < 0.5 AND NOT clipped)
SELECT c.traj, c.pos, {s6(f'CASE WHEN k.k <= greatest(floor(c.n * 0.01), 1) THEN 0 ELSE greatest(-c.advantage * exp(c.lp - c.old_lp), -c.advantage * greatest(least(exp(c.lp - c.old_lp), 1.2), 0.8)) END')} AS loss FROM c LEFT JOIN k ON c.traj = k.traj AND c.pos = k.pos""")
def loss_clip_cov(spark, sf):
    return L.clip_cov(tokens(spark, sf), F.col("lp"), F.col("old_lp"), 0.001, 0.5, 0.01).select("traj", "pos", r6("loss").alias("loss"))


_LOGITS = "WITH x AS (SELECT vec_id, label, list_transform(embedding, lambda v: CAST(v AS DOUBLE) * 5) AS z FROM embeddings), e AS (SELECT vec_id, label, z, ln(list_sum(list_transform(z, lambda v: exp(v)))) AS lse FROM x)"


def _logits(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda v: v.cast("double") * 5).alias("z"))


@query(f"{_LOGITS} SELECT vec_id, {s6('z[label + 1] - lse')} AS log_prob FROM e")
def logits_log_prob(spark, sf):
    return _logits(spark, sf).select("vec_id", r6(R.log_prob(F.col("z"), F.col("label"))).alias("log_prob"))


@query(f"{_LOGITS} SELECT vec_id, {s6('lse - list_sum(list_transform(z, lambda v: exp(v - lse) * v))')} AS entropy FROM e")
def logits_entropy(spark, sf):
    return _logits(spark, sf).select("vec_id", r6(R.entropy(F.col("z"))).alias("entropy"))


@query(f"{_LOGITS} SELECT vec_id, {s6('list_sum(list_transform(z, lambda v: exp(2 * (v - lse))))')} AS sum_pi_squared FROM e")
def logits_sum_pi_squared(spark, sf):
    return _logits(spark, sf).select("vec_id", r6(R.sum_pi_squared(F.col("z"))).alias("sum_pi_squared"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda v: greatest(least(CAST(v AS DOUBLE) / 0.7, 0.2), -0.2))), 5) + 0.0 AS clipped FROM embeddings")
def logits_temperature_clip(spark, sf):
    z = F.transform("embedding", lambda v: R.clip(v.cast("double") / 0.7, -0.2, 0.2))
    return table(spark, sf, "embeddings").select("vec_id", (F.round(F.aggregate(z, F.lit(0.0), lambda a, v: a + v), 5) + F.lit(0.0)).alias("clipped"))


@query(f"{_T} SELECT {s6('avg(abs(lp - ref_lp)) FILTER (WHERE mask > 0)')} AS mean_abs, {s6('min(lp - ref_lp) FILTER (WHERE mask > 0)')} AS low, {s6('max(lp - ref_lp) FILTER (WHERE mask > 0)')} AS high FROM tok")
def distillation_metrics(spark, sf):
    d = F.when(F.col("mask") > 0, L.kl_penalty(F.col("lp"), F.col("ref_lp"), "kl"))
    return tokens(spark, sf).agg(r6(F.avg(F.abs(d))).alias("mean_abs"), r6(F.min(d)).alias("low"), r6(F.max(d)).alias("high"))
