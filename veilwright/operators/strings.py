"""Length, content-pattern and token features of every column's text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as tx
from ..functions.columns import column_frame, melt

STRING_FEATURES = (
    "avg_length",
    "std_length",
    "numeric_ratio",
    "special_char_ratio",
    "email_ratio",
    "phone_ratio",
    "ssn_ratio",
    "credit_card_ratio",
    "token_count",
    "pattern_ratio",
)


SHORT_BYTES = 64


def _sums(texts: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Whole-number sums of (column_name, value, weight), which add up in any order.

    Each pattern fixes the lengths it can match (plus one for a final line
    break) or a character it needs; testing that first spares most regex runs.
    """
    value, size, weight = F.col("value"), F.col("size"), F.col("weight")

    def hits(pattern: str, possible: Column | None = None) -> Column:
        test = tx.matches(value, pattern)
        return F.sum(F.when(test if possible is None else possible & test, weight).otherwise(F.lit(0)))

    wide = size.cast("decimal(20,0)")
    return (
        texts.withColumn("size", F.length("value"))
        .groupBy(*ids, "column_name")
        .agg(
            F.sum(weight).alias("n"),
            F.sum(size * weight).alias("characters"),
            F.sum(wide * wide * weight).cast("decimal(38,0)").alias("squares"),
            F.sum(F.size(F.split(value, "(?U)" + tx.TOKEN_BREAK, -1)) * weight).alias("tokens"),
            hits(tx.DIGITS).alias("numeric_ratio"),
            hits(tx.SPECIAL_CHAR).alias("special_char_ratio"),
            hits(tx.EMAIL, value.contains("@")).alias("email_ratio"),
            hits(tx.PHONE, size.between(10, 21)).alias("phone_ratio"),
            hits(tx.SSN, size.between(11, 12)).alias("ssn_ratio"),
            hits(tx.CREDIT_CARD, size.between(16, 20)).alias("credit_card_ratio"),
            hits(tx.ALPHANUMERIC, size >= 8).alias("pattern_ratio"),
        )
    )


RATIOS = (
    "numeric_ratio", "special_char_ratio", "email_ratio", "phone_ratio", "ssn_ratio", "credit_card_ratio", "pattern_ratio",
)


def string_features(long_text: DataFrame, ids: Sequence[str] = ()) -> DataFrame:
    """Features per column of a (column_name, value) text table.

    Values of up to 64 bytes are counted first, so patterns run once for each
    distinct value; longer texts are looked at where they are and never shuffled.
    """
    keys = [*ids, "column_name"]
    short = F.octet_length("value") <= SHORT_BYTES
    counted = long_text.where(short).groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("weight"))
    rest = long_text.where(~short).select(*keys, "value", F.lit(1).cast("long").alias("weight"))
    parts = _sums(counted, ids).unionByName(_sums(rest, ids))
    sums = parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("n", "characters", "squares", "tokens", *RATIOS)])
    n, exact = F.col("n"), F.col("n").cast("decimal(20,0)")
    apart = exact * F.col("squares").cast("decimal(38,0)") - F.col("characters").cast("decimal(19,0)") * F.col("characters").cast("decimal(19,0)")
    variance = F.try_divide(F.try_divide(apart.cast("double"), n), n - 1)
    return sums.select(
        *keys,
        (F.col("characters") / n).alias("avg_length"),
        F.sqrt(variance).alias("std_length"),
        (F.col("tokens") / n).alias("token_count"),
        *[(F.col(c) / n).alias(c) for c in RATIOS],
    )


def profile_strings(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column; an all-null column gets zeros."""
    columns = list(columns or df.columns)
    long_text = melt(df, {c: tx.as_text(df, c) for c in columns}).where(F.col("value").isNotNull())
    return (
        column_frame(df, columns)
        .join(string_features(long_text), "column_name", "left")
        .select(
            "column_position",
            "column_name",
            *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in STRING_FEATURES],
        )
    )
