"""Equi-joins of many rows with one row for each key, where a key may hold a third of the rows.

Keys with more rows than ``HEAVY`` are few: at most the number of rows over
``HEAVY``, which grows with the rows so that the list never exceeds ``MOST_HEAVY``.
Their rows are dealt into ``splits`` by the other columns, and the one row that
they look for is repeated for each split. All other keys have one split.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

HEAVY = 100_000
MOST_HEAVY = 1000


def _looked(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """A join on equal keys (nulls, too) that keeps the keys of the left side only."""
    own = {k: f"{k}__of_right" for k in keys}
    same = F.lit(True)
    for k, name in own.items():
        same = same & F.col(k).eqNullSafe(F.col(name))
    return left.join(right.withColumnsRenamed(own), same, how).drop(*own.values())


def heavy_keys(weights: DataFrame, keys: Sequence[str], rows: int, heavy: int = HEAVY) -> DataFrame:
    """The keys of ``weights`` (keys and ``rows``) that hold too many of ``rows`` rows for one task."""
    return weights.where(F.col("rows") > max(heavy, rows // MOST_HEAVY)).select(*keys)


def spread_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    weights: DataFrame,
    rows: int,
    how: str = "inner",
    heavy: int = HEAVY,
) -> DataFrame:
    """``left`` with the columns of ``right``, which has one row for each key; null keys equal each other.

    ``weights``: keys and ``rows``, how many rows of ``left`` each key has; ``rows``: all of them.
    """
    if rows <= heavy:
        return _looked(left, right, keys, how)
    hot = heavy_keys(weights, keys, rows, heavy).withColumn("is_heavy", F.lit(True))  # at most MOST_HEAVY rows
    splits = max(2, -(-rows // heavy))
    other = [c for c in left.columns if c not in keys] or list(keys)
    split = F.when(F.col("is_heavy"), F.pmod(F.xxhash64(*other), F.lit(splits))).otherwise(F.lit(0).cast("long"))
    dealt = _looked(left, F.broadcast(hot), keys, "left").withColumn("split", split).drop("is_heavy")
    last = F.when(F.col("is_heavy"), F.lit(splits - 1)).otherwise(F.lit(0)).cast("long")
    copies = _looked(right, F.broadcast(hot), keys, "left").withColumn("split", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return _looked(dealt, copies.drop("is_heavy"), [*keys, "split"], how).drop("split")
