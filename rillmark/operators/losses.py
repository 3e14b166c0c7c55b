"""Policy, value and divergence losses as token columns, and their aggregation.

A loss builder takes Columns and gives a Column; nothing has a gradient here, so
straight-through and stop-gradient variants have the values of their plain forms."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .batch import among_first, hash_key
from .masked import inside
from .offpolicy import clamp
from .registry import DISTILLATION

def _path():
    return Window.partitionBy("traj")

_REGISTRY: dict[str, Callable[..., Column]] = {}


def register(name: str) -> Callable:
    def put(f: Callable[..., Column]) -> Callable[..., Column]:
        if _REGISTRY.setdefault(name, f) is not f:
            raise ValueError(f"{name} is registered with another function")
        return f

    return put


def loss(name: str) -> Callable[..., Column]:
    if name not in _REGISTRY:
        raise ValueError(f"unknown loss {name!r}; known: {sorted(_REGISTRY)}")
    return _REGISTRY[name]


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def ratio(lp: Column, old: Column) -> Column:
    return F.exp(clamp(lp - old))


@register("vanilla")
def dual_clip(lp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> Column:
    """The larger of the plain and clipped loss; for negative advantages at most -dual * A."""
    r = ratio(lp, old)
    larger = F.greatest(-adv * r, -adv * clip(r, 1 - low, 1 + high))
    return F.when(adv < 0, F.least(larger, -adv * dual)).otherwise(larger)


def is_clipped(lp: Column, old: Column, adv: Column, low: float = 0.2, high: float = 0.2) -> Column:
    r = ratio(lp, old)
    return -adv * clip(r, 1 - low, 1 + high) > -adv * r


@register("dppo_tv")
def dppo_tv(lp: Column, old: Column, adv: Column, bound: float = 0.2, top: float = 20.0) -> Column:
    """Tokens whose probability moved farther than the bound on the advantage's side drop out."""
    moved = F.exp(lp) - F.exp(old)
    keep = F.when(adv > 0, moved <= bound).otherwise(moved >= -bound)
    return F.when(keep, -adv * F.least(ratio(lp, old), F.lit(top))).otherwise(0.0)


@register("dppo_kl")
def dppo_kl(lp: Column, old: Column, adv: Column, bound: float = 0.05, top: float = 20.0) -> Column:
    """As dppo_tv by the divergence of (token, any other token)."""
    p, q = F.exp(old), F.exp(lp)
    small = 1e-8
    kl = p * (old - lp) + (1 - p) * F.log((1 - p + small) / (1 - q + small))
    beyond = (kl > bound) & F.when(adv > 0, q > p).otherwise(q < p)
    return F.when(beyond, 0.0).otherwise(-adv * F.least(ratio(lp, old), F.lit(top)))


@register("gspo")
def gspo(lp: Column, old: Column, adv: Column, mask: Column, low: float = 3e-4, high: float = 4e-4) -> Column:
    """Clipped by the trajectory's mean log-ratio."""
    mean = F.sum(inside(lp - old, mask)).over(_path()) / F.greatest(F.sum(mask).over(_path()), F.lit(1))
    r = F.exp(F.least(mean, F.lit(10.0)))
    return F.greatest(-adv * r, -adv * clip(r, 1 - low, 1 + high))


@register("sapo")
def sapo(lp: Column, old: Column, adv: Column, tau_pos: float = 1.0, tau_neg: float = 1.05) -> Column:
    """A soft gate around a ratio of one."""
    tau = F.when(adv > 0, tau_pos).otherwise(tau_neg)
    gate = 1 / (1 + F.exp(-tau * (ratio(lp, old) - 1))) * 4 / tau
    return -gate * adv


@register("gpg")
def gpg(lp: Column, old: Column, adv: Column) -> Column:
    return -lp * adv


@register("cispo")
def cispo(lp: Column, old: Column, adv: Column, low: float = 10.0, high: float = 0.2) -> Column:
    return -clip(ratio(lp, old), 1 - low, 1 + high) * adv * lp


@register("reinforce")
def reinforce(lp: Column, old: Column, adv: Column, weight: Column | None = None) -> Column:
    return -adv * lp if weight is None else -adv * lp * weight


def value_loss(v: Column, returns: Column, old: Column, bound: float = 0.5) -> Column:
    near = F.greatest(F.least(v, old + bound), old - bound)
    return 0.5 * F.greatest((v - returns) ** 2, (near - returns) ** 2)


def kl_penalty(lp: Column, ref: Column, kind: str) -> Column:
    """k1, abs, k2 or k3 of a token (a trailing + has the same value)."""
    d = lp - ref
    kind = {"kl": "k1", "mse": "k2", "low_var_kl": "k3"}.get(kind.removesuffix("+"), kind.removesuffix("+"))
    if kind == "k1":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "k2":
        return 0.5 * d * d
    if kind == "k3":
        x = clamp(ref - lp)
        return clip(F.exp(x) - x - 1, -10.0, 10.0)
    raise NotImplementedError(kind)


def geo_mean_terms(tokens: DataFrame, lp: Column, old: Column, low: float = 0.4, high: float = 0.4) -> DataFrame:
    """(traj, loss): the geometric mean of clipped ratios of each trajectory times its mean
    advantage; averaged plainly over trajectories by the caller."""
    sign = F.when(F.col("advantage") > 0, 1.0).otherwise(-1.0)
    d = clamp(lp - old)
    bounded = clip(d, -low, high)
    kept = F.least(sign * d, sign * bounded) * sign
    n = F.sum("mask") + 1e-8
    seq = tokens.groupBy("traj").agg((F.sum(inside(kept, F.col("mask"))) / n).alias("_log"), (F.sum(inside(F.col("advantage"), F.col("mask"))) / n).alias("_adv"))
    return seq.select("traj", (-F.col("_adv") * F.exp("_log")).alias("loss"))


def covariance(tokens: DataFrame, lp: Column) -> DataFrame:
    """Adds ``cov``: of advantage and log-probability around their masked means."""
    m = F.col("mask")
    means = tokens.agg(F.avg(F.when(m > 0, F.col("advantage"))).alias("_a"), F.avg(F.when(m > 0, lp)).alias("_l"))
    return tokens.crossJoin(F.broadcast(means)).withColumn("cov", (F.col("advantage") - F.col("_a")) * (lp - F.col("_l"))).drop("_a", "_l")  # one row


def ranked_share(tokens: DataFrame, eligible: Column, order: list[Column], share: float, out: str, counted: Column | None = None) -> DataFrame:
    """Marks (``out``) the first max(1, floor(share * counted tokens)) eligible rows in the order
    of numeric columns, by comparing with the last of them."""
    n = tokens.agg(F.greatest(F.floor(F.count_if(counted if counted is not None else eligible) * share), F.lit(1))).first()[0] or 1
    return tokens.withColumn(out, F.coalesce(eligible & among_first(tokens.where(eligible), order, int(n)), F.lit(False)))


def clip_cov(tokens: DataFrame, lp: Column, old: Column, low: float = 1.0, high: float = 5.0, share: float = 2e-4, seed: str = "cov") -> DataFrame:
    """Adds ``loss``: clipped, and zero on a seeded choice of tokens whose covariance lies
    between the bounds and that aren't clipped already."""
    adv, m = F.col("advantage"), F.col("mask")
    r = ratio(lp, old)
    with_cov = covariance(tokens, lp)
    free = (m > 0) & (F.col("cov") > low) & (F.col("cov") < high) & ~is_clipped(lp, old, adv)
    order = [hash_key(seed, F.col("traj"), F.col("pos")), F.col("traj"), F.col("pos")]
    marked = ranked_share(with_cov, free, order, share, "dropped", m > 0)
    return marked.withColumn("loss", F.when(F.col("dropped"), 0.0).otherwise(F.greatest(-adv * r, -adv * clip(r, 0.8, 1.2))))


def kl_cov(tokens: DataFrame, lp: Column, old: Column, share: float = 2e-4, coef: float = 1.0) -> DataFrame:
    """Adds ``loss``: plain, plus the log-probability's move on the tokens of largest covariance."""
    adv, d = F.col("advantage"), lp - old
    marked = ranked_share(covariance(tokens, lp), F.col("mask") > 0, [-F.col("cov"), F.col("traj"), F.col("pos")], share, "held")
    plain = -adv * F.exp(d)
    return marked.withColumn("loss", F.when(F.col("held"), plain + coef * F.abs(d)).otherwise(plain))


def aggregate(tokens: DataFrame, value: Column, mode: str, horizon: float | None = None) -> DataFrame:
    """One row ``loss``.  Trajectories without a masked token don't count."""
    m = F.col("mask")
    if mode == "token-mean":
        return tokens.agg((F.sum(inside(value, m)) / F.sum(m)).alias("loss"))
    if mode == "token-sum":
        return tokens.agg(F.sum(inside(value, m)).alias("loss"))
    seq = tokens.groupBy("traj").agg(F.sum(inside(value, m)).alias("s"), F.sum(m).alias("n")).where("n > 0")
    if mode == "seq-mean-token-sum":
        return seq.agg(F.avg("s").alias("loss"))
    if mode == "seq-mean-token-sum-norm":
        return seq.agg((F.sum("s") / F.count(F.lit(1)) / F.lit(horizon)).alias("loss"))
    if mode == "seq-mean-token-mean":
        return seq.agg(F.avg(F.col("s") / (F.col("n") + 1e-8)).alias("loss"))
    raise ValueError(f"unknown aggregation {mode!r}")


def entropy_loss(tokens: DataFrame, entropy: Column, mode: str = "token-mean", horizon: float | None = None) -> DataFrame:
    return aggregate(tokens, entropy, mode, horizon)


def forward_topk(student: Column, teacher: Column, k: int) -> Column:
    """struct<loss, student_mass, teacher_mass, overlap> of two arrays of logits: the divergence
    from the teacher over its k likeliest ids (not below 0), the probability that either
    gives them, and how many of them are among the student's k."""
    from .arrays import let, lse

    def top(x: Column) -> Column:
        return F.transform(F.slice(F.array_sort(F.transform(x, lambda v, i: F.struct((-v).alias("v"), i.alias("i")))), 1, k), lambda r: r["i"])

    def of(p: Column) -> Column:
        pairs = F.transform(p["ids"], lambda i: F.struct((F.get(p["s"], i) - p["s_lse"]).alias("s"), (F.get(p["t"], i) - p["t_lse"]).alias("t")))
        add = lambda f: F.aggregate(pairs, F.lit(0.0), lambda a, x: a + f(x))
        return F.struct(
            F.greatest(add(lambda x: F.exp(x["t"]) * (x["t"] - x["s"])), F.lit(0.0)).alias("loss"), add(lambda x: F.exp(x["s"])).alias("student_mass"), add(lambda x: F.exp(x["t"])).alias("teacher_mass"),
            F.size(F.array_intersect(p["ids"], p["own"])).alias("overlap"),
        )

    return let(F.struct(student.alias("s"), teacher.alias("t"), lse(student).alias("s_lse"), lse(teacher).alias("t_lse"), top(teacher).alias("ids"), top(student).alias("own")), of)


for _name in ("kl", "k1", "abs", "mse", "k2", "low_var_kl", "k3"):
    DISTILLATION.register(_name)(partial(kl_penalty, kind=_name))
DISTILLATION.register("forward_kl_topk")(forward_topk)


def distillation(tokens: DataFrame, loss: Column, mode: str, most: float | None = None, policy_gradient: tuple[Column, Column] | None = None) -> DataFrame:
    """One row (loss, low, high): a token loss, capped at ``most``, aggregated; with
    (log-probability, old one) its negative is the advantage of a clipped policy loss.
    ``low`` and ``high`` are its range inside the mask."""
    capped = F.least(loss, F.lit(most)) if most is not None else loss
    value = capped if policy_gradient is None else dual_clip(*policy_gradient, -capped)
    inner = F.when(F.col("mask") > 0, capped)
    return aggregate(tokens, value, mode).crossJoin(F.broadcast(tokens.agg(F.min(inner).alias("low"), F.max(inner).alias("high"))))  # one row each
