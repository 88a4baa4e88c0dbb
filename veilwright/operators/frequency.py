"""Value frequencies of every column, reduced to a count spectrum.

All frequency features depend on the value counts alone, not on the values. The
spectrum keeps, per column, how many distinct values occur exactly ``cnt``
times: a column of n rows has at most sqrt(2n) different counts, so everything
after the value grouping is small, whatever the cardinality.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import FRACTIONAL, INTEGRAL, as_number, column_frame, data_type, is_numeric, melt, ref
from ..functions.text import as_text, group_token


def value_counts(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> list[DataFrame]:
    """Counts per (column, value), one table per value type, nulls dropped.

    Values group in their own type; only text longer than 64 bytes is replaced
    by its digest, so that whole documents are not shuffled to be counted.
    """
    families: dict[str, dict[str, Column]] = {"whole": {}, "real": {}, "text": {}}
    for name in columns:
        dtype = data_type(df, name)
        if isinstance(dtype, INTEGRAL + (T.BooleanType,)):
            families["whole"][name] = ref(name).cast("bigint")
        elif isinstance(dtype, FRACTIONAL):
            families["real"][name] = as_number(df, name, infinite=True)
        else:
            families["text"][name] = group_token(as_text(df, name))
    return [
        melt(df, exprs, [ref(c) for c in ids])
        .where(F.col("value").isNotNull())
        .groupBy(*ids, "column_name", "value")
        .agg(F.count(F.lit(1)).alias("cnt"))
        for exprs in families.values()
        if exprs
    ]


def look_up(df: DataFrame, key: Column, known: DataFrame, apart: Column, found: str) -> DataFrame:
    """``df`` with ``found``: whether ``key`` is in ``known`` (one column, no repeats).

    One left join on a shuffled key. Rows that are ``apart`` (nulls, or values
    that many rows hold) need no lookup; a key of their own keeps them from meeting
    in one task.
    """
    listed = known.toDF("known_value")
    own = F.concat(F.lit("\u0000"), F.monotonically_increasing_id().cast("string"))
    keyed = df.withColumn("look_up_key", F.when(F.coalesce(apart, F.lit(True)), own).otherwise(key))
    joined = keyed.join(listed, F.col("look_up_key") == F.col("known_value"), "left")
    return joined.withColumn(found, F.col("known_value").isNotNull()).drop("look_up_key", "known_value")


def count_spectrum(df: DataFrame, columns: Sequence[str], ids: Sequence[str] = ()) -> DataFrame:
    """(column_name, cnt, distinct_values): how many values occur ``cnt`` times."""
    parts = [
        counts.groupBy(*ids, "column_name", "cnt").agg(F.count(F.lit(1)).alias("distinct_values"))
        for counts in value_counts(df, columns, ids)
    ]
    return reduce(DataFrame.unionByName, parts)


def frequency_features(spectrum: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Features per column with at least one non-null value."""
    keys = [*ids, "column_name"]
    whole = Window.partitionBy(*keys)
    descending = whole.orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    share = F.col("cnt") / F.col("n")
    many = F.col("distinct_values")
    in_top5 = F.greatest(F.lit(0), F.least(many, F.lit(5) - F.coalesce(F.col("values_before"), F.lit(0))))
    return (
        spectrum.withColumn("n", F.sum(F.col("cnt") * many).over(whole))
        .withColumn("values_before", F.sum(many).over(descending))
        .groupBy(*keys)
        .agg(
            F.max("n").alias("non_null"),
            F.sum(many).alias("distinct_count"),
            F.max(share).alias("top1_freq"),
            F.sum(share * in_top5).alias("top5_share"),
            (-F.sum(many * share * F.log2(share + F.lit(1e-10)))).alias("entropy"),
            (F.lit(1.0) - F.sum(many * share * share)).alias("gini"),
            F.sum(many * share * share).alias("square_share"),
        )
        .withColumn("distinct_ratio", F.col("distinct_count") / F.col("non_null"))
        .withColumn("top5_freq", F.when(F.col("distinct_count") < 5, F.lit(1.0)).otherwise(F.col("top5_share")))
        .withColumn(
            "norm_entropy",
            F.when(F.col("distinct_count") > 1, F.col("entropy") / F.log2(F.col("distinct_count").cast("double")))
            .otherwise(F.lit(0.0)),
        )
        # Population spread of the relative frequencies, whose mean is 1/distinct.
        .withColumn(
            "frequency_spread",
            F.sqrt(
                F.greatest(
                    F.lit(0.0),
                    F.col("square_share") / F.col("distinct_count")
                    - F.pow(F.lit(1.0) / F.col("distinct_count"), F.lit(2.0)),
                )
            ),
        )
        .drop("top5_share", "square_share")
    )


FREQUENCY_FEATURES = ("distinct_ratio", "top1_freq", "top5_freq", "entropy", "norm_entropy", "gini")


def profile_frequency(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column; an all-null column gets zeros."""
    columns = list(columns or df.columns)
    numeric = [
        c for c in columns if is_numeric(data_type(df, c)) or isinstance(data_type(df, c), T.BooleanType)
    ]
    found = frequency_features(count_spectrum(df, columns))
    return (
        column_frame(df, columns)
        .join(found, "column_name", "left")
        .select(
            "column_position",
            "column_name",
            F.coalesce("non_null", F.lit(0)).alias("non_null"),
            F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
            *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in FREQUENCY_FEATURES],
            F.coalesce("frequency_spread", F.lit(0.0)).alias("frequency_spread"),
            (F.col("column_name").isin(numeric) & F.col("non_null").isNotNull()).alias("is_numeric"),
        )
    )
