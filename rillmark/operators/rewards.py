"""Reward managers: scores of responses as rewards of trajectories and tokens.

A manager takes rows of responses and a score Column (a number, or a struct with a field
``score`` and others) and gives ``reward`` and what else the score says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.graders import overlong_penalty
from .arrays import at_last_valid
from .registry import REWARD_MANAGERS


def last_output(rows: DataFrame, session: list[str], order: str) -> DataFrame:
    """Only the last output of a session is scored."""
    return rows.withColumn("_k", F.row_number().over(Window.partitionBy(*session).orderBy(F.desc(order)))).where("_k = 1").drop("_k")


@REWARD_MANAGERS.register("naive")
def naive(rows: DataFrame, score: Column) -> DataFrame:
    """The score is the reward; a plain number is kept as ``acc``, a struct's fields as they are."""
    scored = rows.withColumn("_score", score)
    if dict(scored.dtypes)["_score"].startswith("struct"):
        return scored.select(*rows.columns, F.col("_score.score").cast("double").alias("reward"), "_score.*")
    return scored.withColumns({"reward": F.col("_score").cast("double"), "acc": F.col("_score").cast("double")}).drop("_score")


@REWARD_MANAGERS.register("dapo")
def penalised(rows: DataFrame, score: Column, length: Column, longest: int, buffer: int, factor: float = 1.0) -> DataFrame:
    """As naive, less a penalty for responses that reach into the buffer before the longest
    allowed length; says the penalty and whether there is one."""
    if not 0 < buffer <= longest:
        raise ValueError("the buffer must be positive and fit the longest length")
    out = naive(rows, score).withColumn("overlong_reward", overlong_penalty(length, longest, buffer, factor))
    return out.withColumns({"overlong": F.col("overlong_reward") < 0, "reward": F.col("reward") + F.col("overlong_reward")})


@REWARD_MANAGERS.register("gdpo")
def components(rows: DataFrame, **scores: Column) -> DataFrame:
    """Several named scores; the reward is their sum unless one is named score."""
    total = scores.get("score")
    if total is None:
        total = sum(scores.values(), F.lit(0.0))
    return rows.withColumns({**{k: c.cast("double") for k, c in scores.items() if k != "score"}, "reward": total.cast("double")})


def token_rewards(rows: DataFrame, mask: str, reward: str = "reward") -> DataFrame:
    """Adds ``rm_scores``: the reward on the last valid token, 0 elsewhere."""
    return rows.withColumn("rm_scores", at_last_valid(F.col(reward), F.col(mask)))


def extract(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Token rewards and the extra columns that are named."""
    return rows.select("rm_scores", *keys)


def round_robin(rows: DataFrame, workers: int, idx: str = "row_idx") -> DataFrame:
    """Adds ``worker``: which remote worker scores a row, in turn."""
    return rows.withColumn("worker", (F.col(idx) % workers).cast("int"))
