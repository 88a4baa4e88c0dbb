"""Skewness, kurtosis and outlier share of the numeric columns."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_number, column_frame, numeric_columns
from .quantiles import SMALL_ROWS, exact_quantiles
from .ranges import column_ranges

IQR_FACTOR = 1.5  # fixed value


def profile_shape(
    df: DataFrame, columns: Sequence[str] | None = None, small_rows: int = SMALL_ROWS
) -> DataFrame:
    """Population skewness and excess kurtosis; share of values outside 1.5 IQR.

    Zeros for a column that is not numeric, is constant, or has fewer than two
    values.
    """
    columns = list(columns or df.columns)
    numeric = {c: as_number(df, c) for c in columns if c in numeric_columns(df)}
    names = column_frame(df, columns)
    if not numeric:
        return names.select("*", *[F.lit(0.0).alias(c) for c in ("skewness", "kurtosis", "outlier_ratio")])

    # Ranges, then quartiles, then one scan for powers of the deviations and the values outside.
    ranges = column_ranges(df, numeric)
    quartiles = exact_quantiles(df, numeric, (0.25, 0.75), small_rows, ranges)
    parts = []
    for name, value in numeric.items():
        r, (q1, q3) = ranges[name], quartiles[name]
        if not r.varies:
            continue
        scale = max(r.high / 2 - r.mean / 2, r.mean / 2 - r.low / 2) * 2  # halves stay finite
        scale = scale if math.isfinite(scale) and scale > 0 else 1.0
        reach = IQR_FACTOR * (q3 - q1)
        outside = (value < F.lit(q1 - reach)) | (value > F.lit(q3 + reach))
        parts += [F.lit(name), F.lit(r.count), (value - F.lit(r.mean)) / F.lit(scale), outside.cast("double")]
    if not parts:
        return names.select("*", *[F.lit(0.0).alias(c) for c in ("skewness", "kurtosis", "outlier_ratio")])
    long = df.select(F.stack(F.lit(len(parts) // 4), *parts).alias("column_name", "n", "d", "outside"))
    d, raw = F.col("d"), [F.col(f"m{i}") for i in range(5)]
    # The mean is rounded, so the powers are moved to the mean of the deviations.
    moved = (
        raw[2] - raw[1] * raw[1],
        raw[3] - 3 * raw[1] * raw[2] + 2 * raw[1] * raw[1] * raw[1],
        raw[4] - 4 * raw[1] * raw[3] + 6 * raw[1] * raw[1] * raw[2] - 3 * raw[1] * raw[1] * raw[1] * raw[1],
    )
    moments = (
        long.groupBy("column_name")
        .agg(
            F.max("n").alias("n"),
            F.avg(d).alias("m1"),
            F.avg(d * d).alias("m2"),
            F.avg(d * d * d).alias("m3"),
            F.avg(d * d * (d * d)).alias("m4"),
            F.avg("outside").alias("outlier_ratio"),
        )
        .select("column_name", "n", "outlier_ratio", *[m.alias(f"c{i}") for i, m in enumerate(moved, 2)])
        .withColumn("skewness", F.when(F.col("c2") > 0, F.col("c3") / F.pow("c2", F.lit(1.5))))
        .withColumn("kurtosis", F.when(F.col("c2") > 0, F.col("c4") / (F.col("c2") * F.col("c2")) - 3))
    )
    return names.join(moments, "column_name", "left").select(
        "column_position",
        "column_name",
        *[
            F.when(F.col("n") >= 2, F.coalesce(F.col(c), F.lit(0.0))).otherwise(F.lit(0.0)).alias(c)
            for c in ("skewness", "kurtosis", "outlier_ratio")
        ],
    )
