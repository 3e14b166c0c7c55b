"""All queries of the reference operators and their SQL twins."""

from __future__ import annotations

from . import q_advantage, q_batch, q_flow, q_metrics, q_more, q_offpolicy, q_rewards, q_stream, q_text  # noqa: F401  (they register)
from .base import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
