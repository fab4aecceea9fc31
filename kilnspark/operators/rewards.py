"""Tiered rewards and their statistics."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from kilnspark.functions import text as T
from kilnspark.operators.filters import is_refusal


def tiered_reward(answer: Column, compiled: Column, message: Column, tested: Column | None = None, soft: float = 0.3, failed: float = 0.5) -> Column:
    """Reward of an answer: a refusal or no module 0, compiled 1 (or by its test), a hard message 0, a soft one ``soft``, else 0.

    ``tested`` is true, false or null for a compiled answer whose test passed,
    failed, or could not be run.
    """
    code = T.code_of(answer, bare=True)
    low = F.lower(message)
    ok = F.lit(1.0) if tested is None else F.when(tested == F.lit(False), failed).otherwise(1.0)
    return (
        F.when(answer.isNull() | is_refusal(answer), 0.0)
        .when(~(code.contains("module") & code.contains("endmodule")), 0.0)
        .when(compiled, ok)
        .when(T.contains_any(low, T.HARD_MARKERS), 0.0)
        .when(T.contains_any(low, T.SOFT_MARKERS), soft)
        .otherwise(0.0)
    )


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    """Cost at prices a million tokens; prices are the caller's."""
    return F.coalesce(tokens_in, F.lit(0)) / 1e6 * price_in + F.coalesce(tokens_out, F.lit(0)) / 1e6 * price_out


def extrapolated(cost: Column, seen: Column, total: int) -> Column:
    return F.when(seen > 0, cost * (F.lit(float(total)) / seen)).otherwise(0.0)
