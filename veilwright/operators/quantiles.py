"""Exact quantiles (linear interpolation) of many columns at any size.

Below ``small_rows`` the built-in ``percentile`` is used; it keeps every distinct
value of a column in one task. Above, the wanted order statistics are found by
narrowing: each pass counts the values of the current bracket in equal buckets
(map-side partial aggregation, nothing else is shuffled) and keeps the bucket
holding the wanted rank, until its lowest and highest value coincide. A bracket of
few rows counts every value by itself, which settles it.

A bracket whose ends differ by more than a factor of e^16 is cut by the logarithms
of its values, a narrower one by the values. Logarithms of doubles span less than
3,000, so one pass brings any bracket below that factor, and six more settle every
bit of it: seven passes at most, whatever the data. NaN and infinities are missing
values.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import finite, melt
from .ranges import ColumnRange, column_ranges

SMALL_ROWS = 250_000
BUCKETS = 8192
FEW_ROWS = 20_000
ABOVE_SMALLEST = 746.0  # added to a logarithm, makes that of the smallest positive double positive
WIDE = 16.0  # logarithms that a bracket may span and still be cut by its values


@dataclass
class _Bracket:
    column: str
    prob: int
    rank: int  # wanted rank inside [low, high], 0-based
    rows: int  # values inside [low, high]
    low: float
    high: float
    lower: float | None = None
    upper: float | None = None

    @property
    def wide(self) -> bool:
        return _magnitude(self.high) - _magnitude(self.low) > WIDE

    @property
    def open(self) -> bool:
        return self.lower is None or self.upper is None


def _magnitude(x: float) -> float:
    """Grows with x over all doubles, by about the same for every factor between them."""
    return math.copysign(math.log(abs(x)) + ABOVE_SMALLEST, x) if x else 0.0


def magnitude_column(x: Column) -> Column:
    # LN is monotonic by its specification, so buckets cut by it are ranges of values.
    return F.when(x != 0.0, F.signum(x) * (F.log(F.abs(x)) + F.lit(ABOVE_SMALLEST))).otherwise(F.lit(0.0))


def exact_quantiles(
    df: DataFrame,
    exprs: Mapping[str, Column],
    probs: Sequence[float],
    small_rows: int = SMALL_ROWS,
    ranges: Mapping[str, ColumnRange] | None = None,
    few_rows: int = FEW_ROWS,
) -> dict[str, list[float | None]]:
    """``{column: [quantile, ...]}``; NULL values are skipped, no values give None."""
    exprs = {c: finite(e.cast("double")) for c, e in exprs.items()}
    if not ranges or not all(math.isfinite(r.low) and math.isfinite(r.high) for r in ranges.values() if r.count):
        ranges = column_ranges(df, exprs)
    ranges = {c: r for c, r in ranges.items() if c in exprs and r.count}
    result: dict[str, list[float | None]] = {name: [None] * len(probs) for name in exprs}
    if not ranges:
        return result
    if max(r.count for r in ranges.values()) <= small_rows:
        levels = F.array(*[F.lit(float(p)) for p in probs])
        long = melt(df, exprs).where(F.col("value").isNotNull())
        for r in long.groupBy("column_name").agg(F.percentile("value", levels).alias("q")).collect():
            result[r["column_name"]] = list(r["q"])
        return result

    brackets, weights = [], {}
    for name, r in ranges.items():
        for i, p in enumerate(probs):
            place = (r.count - 1) * p
            rank = math.floor(place)
            weights[name, i] = place - rank
            brackets.append(_Bracket(name, i, rank, r.count, r.low, r.high))
    _narrow(df, exprs, brackets, few_rows)
    for b in brackets:
        w = weights[b.column, b.prob]
        result[b.column][b.prob] = b.lower + (b.upper - b.lower) * w if w else b.lower
    return result


def _narrow(df: DataFrame, exprs: Mapping[str, Column], brackets: list[_Bracket], few_rows: int) -> int:
    """Settle the brackets; the number of passes that took."""
    passes = 0
    spark = df.sparkSession
    for b in brackets:
        if b.low == b.high:
            b.lower = b.upper = b.low
        elif b.rank == b.rows - 1:
            b.lower = b.upper = b.high
    while pending := [b for b in brackets if b.open]:
        passes += 1
        # Ranks of one column in the same range share one count of its buckets.
        ranges: dict[tuple, int] = {}
        for b in pending:
            ranges.setdefault((b.column, b.low, b.high, b.rows), len(ranges))
        wanted_ranks = spark.createDataFrame(
            [(ranges[b.column, b.low, b.high, b.rows], i, b.rank) for i, b in enumerate(pending)],
            "range_id int, target int, rank long",
        )
        # One row per range, which finds its bounds in literal arrays. A join with
        # a table of bounds takes more than twice as long, and bounds written
        # into one expression per range outgrow what the JVM compiles.
        pairs = [part for (name, *_), i in ranges.items() for part in (F.lit(i), exprs[name])]
        scales = [1.0 if math.isfinite(high - low) else 0.5 for _, low, high, _ in ranges]

        def of_range(values: Sequence) -> Column:
            return F.array(*[F.lit(v) for v in values])[F.col("range_id")]

        wide = [b.wide for b in {(b.column, b.low, b.high, b.rows): b for b in pending}.values()]

        value, scale, low = F.col("value"), F.col("scale"), F.col("low")
        by_value = (value * scale - low * scale) / (F.col("high") * scale - low * scale)
        # The bounds' logarithms are numbers of the range, so a value needs one logarithm.
        start = of_range([_magnitude(low) for _, low, _, _ in ranges])
        reach = of_range([_magnitude(high) - _magnitude(low) or 1.0 for _, low, high, _ in ranges])
        by_magnitude = (magnitude_column(value) - start) / reach
        place = F.when(F.col("wide"), by_magnitude).otherwise(by_value)
        part = F.least(F.floor(place * BUCKETS).cast("double"), F.lit(float(BUCKETS - 1)))
        buckets = (
            df.select(F.stack(F.lit(len(ranges)), *pairs).alias("range_id", "value"))
            .withColumn("low", of_range([low for _, low, _, _ in ranges]))
            .withColumn("high", of_range([high for _, _, high, _ in ranges]))
            .where(value.between(F.col("low"), F.col("high")))
            # Halving keeps the width finite for extreme ranges.
            .withColumn("scale", of_range(scales))
            .withColumn("wide", of_range(wide))
            .withColumn("few", of_range([rows <= few_rows for _, _, _, rows in ranges]))
            .withColumn("bucket", F.when(F.col("few"), value).otherwise(part))
            .groupBy("range_id", "bucket")
            .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("low"), F.max("value").alias("high"))
        )
        by_bucket = Window.partitionBy("range_id").orderBy("bucket")  # at most FEW_ROWS rows
        until = F.sum("n").over(by_bucket.rowsBetween(Window.unboundedPreceding, 0))
        found = (
            buckets.withColumn("until", until)
            .withColumn("before", F.col("until") - F.col("n"))
            .withColumn("next_low", F.lead("low").over(by_bucket))
            .join(F.broadcast(wanted_ranks), "range_id")
            .where((F.col("before") <= F.col("rank")) & (F.col("rank") < F.col("until")))
            .collect()
        )
        for r in found:
            b = pending[r["target"]]
            last_of_bucket = b.rank == r["until"] - 1
            if r["low"] == r["high"] and not last_of_bucket:
                b.lower = b.upper = r["low"]
            elif last_of_bucket:
                # A kept bracket always holds rank + 1 too, so there is a next bucket.
                b.lower, b.upper = r["high"], r["next_low"]
            else:
                b.rank, b.rows, b.low, b.high = b.rank - r["before"], r["n"], r["low"], r["high"]
    return passes
