"""Moments, order statistics and correlations of the columns of many datasets, in passes over all of them.

What is known of a (dataset, column) is a row of a table, not a number on the
driver, so thousands of datasets cost as many passes as one. Quantiles of columns
that fit into a task come from ``percentile``; those of larger ones are found by
narrowing a bracket around the wanted rank, at most seven passes for all together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .quantiles import BUCKETS, FEW_ROWS, SMALL_ROWS, WIDE, magnitude_column
from .spread import spread_join

IQR_FACTOR = 1.5  # fixed value
MOST_SENT = 100_000  # rows of a table of brackets that every task may get


def moments(long: DataFrame, ids: Sequence[str]) -> DataFrame:
    """n, low, high, skewness and kurtosis of each column; ``long``: ids, column_name and value without nulls."""
    return stage(
        long.groupBy(*ids, "column_name").agg(
            F.count("value").alias("n"),
            F.min("value").alias("low"),
            F.max("value").alias("high"),
            F.skewness("value").alias("skewness"),
            F.kurtosis("value").alias("kurtosis"),
        ),
        "moments",
    )


def _attached(long: DataFrame, known: DataFrame, keys: Sequence[str], ranges: DataFrame) -> DataFrame:
    """The rows of ``long`` with those of ``known`` for their column."""
    if known.count() <= MOST_SENT:
        return long.join(F.broadcast(known), list(keys))
    weights = ranges.select(*keys, F.col("n").alias("rows"))
    return spread_join(long, known, keys, weights, weights.agg(F.sum("rows")).first()[0])


def grouped_quantiles(
    long: DataFrame, ids: Sequence[str], ranges: DataFrame, probs: Sequence[float], small_rows: int = SMALL_ROWS
) -> DataFrame:
    """ids, column_name and ``quantiles``, an array in the order of ``probs`` (linear interpolation).

    ``ranges``: ids, column_name, n, low and high of each column, as ``moments`` leaves them.
    """
    keys = [*ids, "column_name"]
    large = ranges.where(F.col("n") > small_rows)
    levels = F.array(*[F.lit(float(p)) for p in probs])
    if large.limit(1).isEmpty():
        return long.groupBy(*keys).agg(F.percentile("value", levels).alias("quantiles"))
    small = ranges.where(F.col("n") <= small_rows).select(*keys)
    direct = _attached(long, small, keys, ranges).groupBy(*keys).agg(F.percentile("value", levels).alias("quantiles"))
    settled = _narrowed(long, keys, large, probs, ranges)
    between = F.when(F.col("weight") == 0, F.col("lower")).otherwise(F.col("lower") + (F.col("upper") - F.col("lower")) * F.col("weight"))
    found = settled.groupBy(*keys).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("prob", between.alias("q")))), lambda x: x["q"]).alias("quantiles")
    )
    return direct.unionByName(found)


def _narrowed(long: DataFrame, keys: list[str], large: DataFrame, probs: Sequence[float], ranges: DataFrame) -> DataFrame:
    """A row for each wanted rank with the values (``lower``, ``upper``) of it and the next one."""
    place = (F.col("n") - 1) * F.col("p")
    every = large.select(
        *keys, "n", "low", "high", F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob", "p")
    )
    brackets = every.select(
        *keys, "prob", F.floor(place).alias("rank"), (place - F.floor(place)).alias("weight"), F.col("n").alias("rows"), "low", "high"
    )
    alone = F.when(F.col("low") == F.col("high"), F.col("low")).when(F.col("rank") == F.col("rows") - 1, F.col("high"))
    brackets = stage(brackets.withColumn("lower", alone).withColumn("upper", alone), "brackets")
    columns = brackets.columns
    while not (pending := brackets.where("lower IS NULL")).limit(1).isEmpty():
        bounds = [F.col("low").alias("from_low"), F.col("high").alias("from_high")]
        wanted = pending.select(*keys, "rows", *bounds).distinct()
        buckets = (
            _attached(long, wanted, keys, ranges)
            .where(F.col("value").between(F.col("from_low"), F.col("from_high")))
            .withColumn("bucket", _bucket(F.col("value"), F.col("from_low"), F.col("from_high"), F.col("rows")))
            .groupBy(*keys, "from_low", "from_high", "bucket")
            .agg(F.count(F.lit(1)).alias("held"), F.min("value").alias("b_low"), F.max("value").alias("b_high"))
        )
        in_range = Window.partitionBy(*keys, "from_low", "from_high").orderBy("bucket")  # at most FEW_ROWS rows
        counted = buckets.select(
            "*",
            F.sum("held").over(in_range.rowsBetween(Window.unboundedPreceding, 0)).alias("until"),
            F.lead("b_low").over(in_range).alias("next_low"),
        )
        open_ = pending.select(*keys, "prob", "rank", "weight", *bounds)
        hit = counted.join(open_, [*keys, "from_low", "from_high"]).where(
            (F.col("until") - F.col("held") <= F.col("rank")) & (F.col("rank") < F.col("until"))
        )
        last = F.col("rank") == F.col("until") - 1
        one = F.col("b_low") == F.col("b_high")
        narrowed = hit.select(
            *keys, "prob", (F.col("rank") - F.col("until") + F.col("held")).alias("rank"), "weight", F.col("held").alias("rows"),
            F.col("b_low").alias("low"), F.col("b_high").alias("high"),
            F.when(last, F.col("b_high")).when(one, F.col("b_low")).alias("lower"),
            F.when(last, F.col("next_low")).when(one, F.col("b_low")).alias("upper"),
        )
        brackets = stage(narrowed.unionByName(brackets.where("lower IS NOT NULL")).select(*columns), "brackets")
    return brackets


def _bucket(value: Column, low: Column, high: Column, rows: Column) -> Column:
    """One of ``BUCKETS`` parts of [low, high], or the value itself in a bracket of few rows."""
    scale = F.when(F.abs(high / 2 - low / 2) < 1e300, F.lit(1.0)).otherwise(F.lit(0.5))  # else the width may be infinite
    by_value = (value * scale - low * scale) / (high * scale - low * scale)
    start, end = magnitude_column(low), magnitude_column(high)
    by_magnitude = (magnitude_column(value) - start) / (end - start)
    part = F.when(end - start > WIDE, by_magnitude).otherwise(by_value)
    part = F.least(F.floor(part * BUCKETS).cast("double"), F.lit(float(BUCKETS - 1)))
    return F.when(rows <= FEW_ROWS, value).otherwise(part)


def grouped_shape(long: DataFrame, ids: Sequence[str], small_rows: int = SMALL_ROWS) -> DataFrame:
    """ids, column_name, skewness, kurtosis and outlier_ratio, as ``profile_shape`` has them for one dataset."""
    keys = [*ids, "column_name"]
    ranges = moments(long, ids)
    quartiles = stage(grouped_quantiles(long, ids, ranges, (0.25, 0.75), small_rows), "quartiles")
    q1, q3 = F.col("quantiles")[0], F.col("quantiles")[1]
    reach = F.lit(IQR_FACTOR) * (q3 - q1)
    fences = quartiles.select(*keys, (q1 - reach).alias("least"), (q3 + reach).alias("most"))
    outside = (F.col("value") < F.col("least")) | (F.col("value") > F.col("most"))
    outliers = _attached(long, fences, keys, ranges).groupBy(*keys).agg(F.avg(outside.cast("double")).alias("outlier_ratio"))
    usual = ("skewness", "kurtosis", "outlier_ratio")
    return ranges.join(outliers, keys, "left").select(
        *keys, *[F.when(F.col("n") >= 2, F.coalesce(F.nanvl(F.col(c), F.lit(0.0)), F.lit(0.0))).otherwise(F.lit(0.0)).alias(c) for c in usual]
    )


def pair_rows(df: DataFrame, values: dict[str, Column], ids: Sequence[Column]) -> DataFrame | None:
    """ids, column_a, column_b, x and y for every pair of columns of a row."""
    names = list(values)
    pairs = [
        F.struct(F.lit(a).alias("column_a"), F.lit(b).alias("column_b"), values[a].alias("x"), values[b].alias("y"))
        for i, a in enumerate(names)
        for b in names[i + 1 :]
    ]
    return df.select(*ids, F.inline(F.array(*pairs))) if pairs else None


def grouped_association(pairs: DataFrame, ids: Sequence[str]) -> DataFrame:
    """ids, column_name and association: mean |r| with the other numeric columns of the dataset."""
    r = pairs.groupBy(*ids, "column_a", "column_b").agg(F.corr("x", "y").alias("r"))
    r = r.withColumn("r", F.when(~F.isnan("r"), F.abs("r")))
    both = F.array(F.col("column_a"), F.col("column_b"))
    return r.select(*ids, F.explode(both).alias("column_name"), "r").groupBy(*ids, "column_name").agg(
        F.coalesce(F.avg("r"), F.lit(0.0)).alias("association")
    )
