"""Counts, extremes and means of many columns in one scan."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import melt


@dataclass(frozen=True)
class ColumnRange:
    count: int  # non-null values
    nulls: int
    low: float | None
    high: float | None
    mean: float | None

    @property
    def varies(self) -> bool:
        return self.count > 0 and self.low != self.high

    @property
    def centre(self) -> float:
        """A shift near the mean; a constant is shifted to exactly 0."""
        return (self.mean if self.varies else self.low) or 0.0


EMPTY = ColumnRange(0, 0, None, None, None)


def column_ranges(df: DataFrame, exprs: Mapping[str, Column]) -> dict[str, ColumnRange]:
    """Five numbers per column reach the driver."""
    if not exprs:
        return {}
    rows = (
        melt(df, exprs)
        .groupBy("column_name")
        .agg(
            F.count("value").alias("n"),
            F.count(F.lit(1)).alias("rows"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.avg("value").alias("mean"),
        )
        .collect()
    )
    found = {r["column_name"]: ColumnRange(r["n"], r["rows"] - r["n"], r["low"], r["high"], r["mean"]) for r in rows}
    return {name: found.get(name, EMPTY) for name in exprs}
