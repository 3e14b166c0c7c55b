"""Ragged per-token arrays: padding, truncation, masks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def pad_or_truncate(c: Column, length: int, pad: Column, left_pad: bool = True, truncation: str = "error") -> Column:
    """An array of exactly ``length``: padded left or right, or cut left (the end stays),
    right, in the middle (both ends stay), or an error."""
    n, half = F.size(c), length // 2
    fill = F.array_repeat(pad, length - n)
    longer = {
        "left": F.slice(c, F.greatest(n - length + 1, F.lit(1)), F.lit(length)),
        "right": F.slice(c, 1, length),
        "middle": F.concat(F.slice(c, F.lit(1), F.lit(half)), F.slice(c, F.greatest(n - (length - half) + 1, F.lit(1)), F.lit(length - half))),
        "error": F.raise_error(F.concat(F.lit(f"longer than {length}: "), n.cast("string"))),
    }[truncation]
    return F.when(n <= length, F.concat(fill, c) if left_pad else F.concat(c, fill)).otherwise(longer)


def pad_right(c: Column, length: Column, pad: Column) -> Column:
    return F.concat(c, F.array_repeat(pad, F.greatest(length - F.size(c), F.lit(0))))


def remove_left_padding(ids: Column, mask: Column) -> Column:
    """The last sum(mask) tokens."""
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.when(n > 0, F.slice(ids, -n, n)).otherwise(F.slice(ids, 1, 0))


def mask_to_eos(ids: Column, eos: Column) -> Column:
    """1 up to and with the first end token, then 0; all 1 without one."""
    at = F.array_position(ids, eos)
    return F.transform(ids, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def mask_tail(mask: Column, n: Column) -> Column:
    return F.slice(mask, F.greatest(F.size(mask) - n + 1, F.lit(1)), n)


def mask_of_length(n: Column, width: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.when(i < n, 1).otherwise(0))


def at_last_valid(reward: Column, mask: Column) -> Column:
    """A scalar placed at index sum(mask) - 1, zero elsewhere."""
    n = F.aggregate(mask, F.lit(0), lambda a, x: a + x.cast("int"))
    return F.transform(mask, lambda _, i: F.when(i == n - 1, reward).otherwise(F.lit(0.0)))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, also where it stands inside a lambda
    (which would work out an expression of the row again for every element)."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def lse(x: Column) -> Column:
    """log(sum(exp(x))), safe for large values; two passes."""

    def of(p: Column) -> Column:
        return p["top"] + F.log(F.aggregate(p["x"], F.lit(0.0), lambda a, v: a + F.exp(v - p["top"])))

    return let(F.struct(x.alias("x"), F.array_max(x).alias("top")), of)


def log_prob(logits: Column, label: Column) -> Column:
    return F.element_at(logits, label + 1) - lse(logits)


def entropy(logits: Column) -> Column:
    def of(p: Column) -> Column:
        return p["total"] - F.aggregate(p["x"], F.lit(0.0), lambda a, v: a + F.exp(v - p["total"]) * v)

    return let(F.struct(logits.alias("x"), lse(logits).alias("total")), of)


def sum_pi_squared(logits: Column) -> Column:
    def of(p: Column) -> Column:
        return F.aggregate(p["x"], F.lit(0.0), lambda a, v: a + F.exp(2 * (v - p["total"])))

    return let(F.struct(logits.alias("x"), lse(logits).alias("total")), of)


def clip(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.least(x, F.lit(high)), F.lit(low))


def workload(n: Column) -> Column:
    """Cost of a sequence: a linear part and a quadratic one."""
    return F.lit(24576) * n + n * n
