"""Aggregates of a join by key, from per-key states instead of joined rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvidex.frames import cut


def eager_join_totals(left: DataFrame, right: DataFrame, key: str, left_sums: dict[str, str], right_sums: dict[str, str]) -> DataFrame:
    """Per key, what a join of left and right would give, without joining rows.

    Both sides are reduced to one state a key first (map-side, so a key that holds most rows costs each
    task one state), the states are joined, and the aggregates of the join follow algebraically: its rows
    are the product of both counts, the sum of a left column is its own sum times the right count.

    Columns: key, left_rows, right_rows, join_rows, the own sums by name, and join_<name> for each sum over
    the joined rows. left_sums and right_sums map a new name to a column. Keys of either side come out
    (0 for the side without the key); rows with a null key do not. Sums over no non-null value are 0.
    """

    def states(df: DataFrame, rows: str, sums: dict[str, str]) -> DataFrame:
        return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias(rows), *[F.sum(F.col(c).cast("long")).alias(n) for n, c in sums.items()])

    names = ["left_rows", "right_rows", *left_sums, *right_sums]
    joined = states(left, "left_rows", left_sums).join(states(right, "right_rows", right_sums), key, "full")
    joined = joined.select(key, *[F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in names])
    return joined.select(
        "*",
        (F.col("left_rows") * F.col("right_rows")).alias("join_rows"),
        *[(F.col(n) * F.col("right_rows")).alias(f"join_{n}") for n in left_sums],
        *[(F.col(n) * F.col("left_rows")).alias(f"join_{n}") for n in right_sums],
    )


def heavy_keys(totals: DataFrame, key: str, amount: str, per_mille: int) -> DataFrame:
    """Keys with at least per_mille / 1000 of the sum of amount over all keys; none if that sum is 0."""
    totals = cut(totals.select(key, amount))
    whole = totals.agg(F.sum(amount)).first()[0] or 0
    return totals.where((F.col(amount) > 0) & (F.col(amount) * 1000 >= whole * per_mille)).select(key)
