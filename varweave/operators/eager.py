"""Aggregates over joins by eager aggregation, and the heavy keys of a table.

Both inputs are reduced to one compact state per join key before they meet, so no task ever holds the rows of a key:
map-side partial aggregation folds a hot key to one state per task, and the join moves states only.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    by: list[str],
    left_sums: dict[str, Column | str] | None = None,
    right_sums: dict[str, Column | str] | None = None,
    how: str = "inner",
    count_as: str = "n_pairs",
) -> DataFrame:
    """``left JOIN right USING (on) GROUP BY by`` without joining rows.

    ``by`` names columns of ``left``. Result: ``by``, ``count_as`` (joined rows) and each named sum over the joined rows: a
    left sum is multiplied by the right count of its key, a right sum by the left count. ``how`` is ``inner`` or
    ``left``; under ``left`` an unmatched left row counts once, with nothing for the right sums. Null join keys match
    nothing. A sum over no value is null, as in SQL. Other columns of either input, of any name, are ignored. Empty
    inputs give no rows.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    left_sums, right_sums = left_sums or {}, right_sums or {}
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    keys = list(dict.fromkeys([*on, *by]))
    lhs = left.groupBy(*[F.col(k).alias(f"__k_{k}") for k in keys]).agg(
        F.count(F.lit(1)).alias("__ln"), *[F.sum(as_col(c)).alias(f"__l_{a}") for a, c in left_sums.items()]
    )
    rhs = right.groupBy(*[F.col(k).alias(f"__r_{k}") for k in on]).agg(
        F.count(F.lit(1)).alias("__rn"), *[F.sum(as_col(c)).alias(f"__s_{a}") for a, c in right_sums.items()]
    )
    cond = [F.col(f"__k_{k}") == F.col(f"__r_{k}") for k in on]
    met = lhs.join(rhs, cond, how)
    rn = F.coalesce(F.col("__rn"), F.lit(1)) if how == "left" else F.col("__rn")
    return met.groupBy(*[F.col(f"__k_{k}").alias(k) for k in by]).agg(
        F.sum(F.col("__ln") * rn).alias(count_as),
        *[F.sum(F.col(f"__l_{a}") * rn).alias(a) for a in left_sums],
        *[F.sum(F.col(f"__s_{a}") * F.col("__ln")).alias(a) for a in right_sums],
    )


def heavy_keys(states: DataFrame, keys: list[str], total: int, share: float, count_col: str = "n_pairs") -> DataFrame:
    """Keys whose state counts more than ``share`` of ``total`` rows; a null in any key is never heavy.

    ``share`` is taken as the decimal it is written as, so the comparison is exact in integers.
    """
    part = Fraction(str(share))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return states.filter(known & (F.col(count_col) * part.denominator > F.lit(total) * part.numerator)).select(*keys)
