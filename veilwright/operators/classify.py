"""Composite risk scores and risk tiers per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import names as nm
from .association import profile_association
from .compression import profile_compression
from .frequency import profile_frequency
from .strings import profile_strings

# Labels and column names of the classification table.
TIER_1 = "Tier 1 (Highest Risk)"
TIER_2 = "Tier 2 (Medium/High Risk)"
TIER_3 = "Tier 3 (Low Risk)"
NAME_COLUMN = "Column Name"
TIER_COLUMN = "Risk Tier"
TIER_COLUMN_LONG = "Risk Tier Classification"

# Score weights per feature, and the thresholds of the tiers.
IDENTIFIER_WEIGHTS = {
    "distinct_ratio": 0.4, "norm_entropy": 0.3, "not_top1": 0.15,
    "numeric_ratio": 0.1, "pii_ratio": 0.05, "identifier_keyword": 0.1,
}
HIGH_RISK_WEIGHTS = {
    "high_risk_keyword": 0.3, "association": 0.25, "identifier_keyword": 0.2,
    "norm_entropy": 0.15, "special_char_ratio": 0.1,
}
LOW_RISK_WEIGHTS = {
    "low_risk_keyword": 0.3, "association": 0.25, "quasi_keyword": 0.2,
    "norm_entropy": 0.15, "gini": 0.1,
}
QUASI_WEIGHTS = {
    "distinct_ratio": 0.25, "norm_entropy": 0.15, "not_top1": 0.15,
    "association": 0.15, "pattern_score": 0.15, "quasi_keyword": 0.15,
}
IDENTIFIER_MIN, HIGH_RISK_MIN, QUASI_MIN, LOW_RISK_MIN = 0.5, 0.45, 0.35, 0.35

SCORES = (
    "identifier_score",
    "high_risk_sensitive_score",
    "low_risk_sensitive_score",
    "quasi_identifier_score",
    "non_identifying_score",
)


def _weighted(weights: dict[str, float]) -> Column:
    terms = [F.lit(weight) * F.col(feature) for feature, weight in weights.items()]
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def name_scores(df: DataFrame, columns: Sequence[str], normalize_keywords: bool = False) -> DataFrame:
    """Keyword scores per column name: plan-time work on the names alone."""
    vocabularies = (nm.IDENTIFIER_KEYWORDS, nm.HIGH_RISK_KEYWORDS, nm.LOW_RISK_KEYWORDS, nm.QUASI_KEYWORDS)
    rows = [(c, *[nm.keyword_score(c, words, normalize_keywords) for words in vocabularies]) for c in columns]
    return df.sparkSession.createDataFrame(
        rows,
        "column_name string, identifier_keyword double, high_risk_keyword double, "
        "low_risk_keyword double, quasi_keyword double",
    )


def scored(features: DataFrame) -> DataFrame:
    """Adds the five composite scores to a table with one row of features per column."""
    return (
        features.withColumn("not_top1", F.lit(1.0) - F.col("top1_freq"))
        .withColumn("pii_ratio", F.greatest("email_ratio", "phone_ratio", "ssn_ratio", "credit_card_ratio"))
        .withColumn("pattern_score", F.col("pattern_ratio") * (F.lit(1.0) - F.col("compression_ratio")))
        .withColumn("identifier_score", _weighted(IDENTIFIER_WEIGHTS))
        .withColumn("high_risk_sensitive_score", _weighted(HIGH_RISK_WEIGHTS))
        .withColumn("low_risk_sensitive_score", _weighted(LOW_RISK_WEIGHTS))
        .withColumn("quasi_identifier_score", _weighted(QUASI_WEIGHTS))
        .withColumn(
            "non_identifying_score",
            F.lit(0.4) * (F.lit(1.0) - F.greatest("identifier_score", "quasi_identifier_score"))
            + F.lit(0.3) * (F.lit(1.0) - F.greatest("high_risk_sensitive_score", "low_risk_sensitive_score"))
            + F.lit(0.3) * F.col("top1_freq"),
        )
    )


def tier() -> Column:
    """The tier of the winning score, if it reaches that score's threshold."""
    best = F.greatest(*SCORES)

    def wins(score: str, threshold: float) -> Column:
        return (F.col(score) == best) & (best >= threshold)

    return (
        F.when(wins("identifier_score", IDENTIFIER_MIN) | wins("high_risk_sensitive_score", HIGH_RISK_MIN), TIER_1)
        .when(wins("quasi_identifier_score", QUASI_MIN) | wins("low_risk_sensitive_score", LOW_RISK_MIN), TIER_2)
        .otherwise(TIER_3)
    )


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, normalize_keywords: bool = False) -> DataFrame:
    """Every feature the scores use, one row per column.

    The compression ratio only enters through ``pattern_ratio * (1 - ratio)``,
    so columns whose pattern ratio is 0 are not compressed (their ratio reads 1).
    """
    columns = list(columns or df.columns)
    spark = df.sparkSession
    # Both profiles are used twice; a table of one row per column is cheap to hold.
    strings = _held(profile_strings(df, columns))
    frequency = _held(profile_frequency(df, columns))
    patterned = [r["column_name"] for r in strings.where("pattern_ratio > 0").select("column_name").collect()]
    if patterned:
        packed = profile_compression(df, patterned).select("column_name", "compression_ratio")
    else:
        packed = spark.createDataFrame([], "column_name string, compression_ratio double")
    association = profile_association(df.select(*[f"`{c}`" for c in columns]), frequency)
    return (
        frequency.join(strings.drop("column_position"), "column_name")
        .join(association.drop("column_position"), "column_name")
        .join(packed, "column_name", "left")
        .join(name_scores(df, columns, normalize_keywords), "column_name")
        .withColumn("compression_ratio", F.coalesce("compression_ratio", F.lit(1.0)))
    )


def _held(small: DataFrame) -> DataFrame:
    """A table of one row per column as a local relation, computed once."""
    return small.sparkSession.createDataFrame(small.collect(), small.schema)


def column_scores(df: DataFrame, columns: Sequence[str] | None = None, normalize_keywords: bool = False) -> DataFrame:
    return scored(profile_columns(df, columns, normalize_keywords)).withColumn("risk_tier", tier())


def classify_columns(df: DataFrame, columns: Sequence[str] | None = None, normalize_keywords: bool = False) -> DataFrame:
    """The classification table: column name and risk tier, in column order."""
    return (
        column_scores(df, columns, normalize_keywords)
        .orderBy("column_position")
        .select(F.col("column_name").alias(NAME_COLUMN), F.col("risk_tier").alias(TIER_COLUMN))
    )


def with_long_tier_name(classification: DataFrame) -> DataFrame:
    """The second accepted spelling of the tier column."""
    return classification.withColumnRenamed(TIER_COLUMN, TIER_COLUMN_LONG)


def tier_column(classification: DataFrame) -> str:
    for name in (TIER_COLUMN_LONG, TIER_COLUMN):
        if name in classification.columns:
            return name
    raise ValueError(f"a classification needs a column {TIER_COLUMN!r} or {TIER_COLUMN_LONG!r}")


def tier_distribution(classification: DataFrame) -> DataFrame:
    """Columns per tier and their share in percent."""
    tiers = classification.groupBy(F.col(f"`{tier_column(classification)}`").alias("risk_tier")).agg(
        F.count(F.lit(1)).alias("column_count")
    )
    total = F.sum("column_count").over(Window.partitionBy())  # one row per tier
    return tiers.select(
        "risk_tier", "column_count", (F.lit(100.0) * F.col("column_count") / total).alias("percent")
    )


def validate_classification(classification: DataFrame, df: DataFrame) -> DataFrame:
    """Names present on one side only. The classification is valid if none is 'missing'."""
    spark = df.sparkSession
    data = spark.createDataFrame([(c,) for c in df.columns], "column_name string")
    listed = classification.select(F.col(f"`{NAME_COLUMN}`").alias("column_name")).distinct()
    missing = data.join(listed, "column_name", "left_anti").withColumn("problem", F.lit("missing"))
    extra = listed.join(data, "column_name", "left_anti").withColumn("problem", F.lit("extra"))
    return missing.unionByName(extra)


def classification_is_valid(classification: DataFrame, df: DataFrame) -> bool:
    return validate_classification(classification, df).where("problem = 'missing'").isEmpty()
