"""Column rewrites that depend on the column's distribution.

Each operator first asks Spark for a handful of statistics per column (all
columns in one job), then rewrites with plain expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.columns import as_number, data_type, is_numeric, melt, ref
from ..functions.numbers import keyed_uniform, laplace
from ..functions.text import group_token, redact_words, spaced_words
from .frequency import look_up
from .ordered import check_row_key, with_position
from .privacy import OTHER, value_ranges, with_interval_labels
from ..session import stage

SUPPRESSED = "SUPPRESSED"  # fixed value
FREQUENT_IN_MEMORY = 10_000  # values of 64 bytes at most: longer ones are named by a digest
HEAVY = 1000


# --- noise -----------------------------------------------------------------


def laplace_column(
    df: DataFrame, name: str, row_key: str, secret: str, sensitivity: float = 1.0, epsilon: float = 1.0
) -> Column:
    """``abs(x + Laplace(0, sensitivity / epsilon))``; nulls stay null. A null row key raises."""
    noise = laplace(keyed_uniform(secret, name, present_key(row_key)), sensitivity / epsilon)
    return F.abs(as_number(df, name, infinite=True) + noise)


def present_key(row_key: str) -> Column:
    """The row key, which noise needs in every row: without one, the value itself would be lost."""
    key = ref(row_key)
    return F.coalesce(key.cast("string"), F.raise_error(F.lit(f"row key {row_key!r} is null in a row that gets noise")).cast("string"))


def laplace_noise(
    df: DataFrame, columns: Sequence[str], row_key: str, secret: str, sensitivity: float = 1.0, epsilon: float = 1.0
) -> DataFrame:
    """Noise on the numeric columns among ``columns``; others pass unchanged."""
    wanted = [c for c in columns if is_numeric(data_type(df, c))]
    return df.withColumns({c: laplace_column(df, c, row_key, secret, sensitivity, epsilon) for c in wanted})


def non_negative(df: DataFrame) -> DataFrame:
    """Absolute value of every numeric column."""
    return df.withColumns({f.name: F.abs(ref(f.name)) for f in df.schema.fields if is_numeric(f.dataType)})


# --- text ------------------------------------------------------------------


def with_redacted_words(df: DataFrame, keep_ratios: Mapping[str, float]) -> DataFrame:
    """Redact each column, read as text, with its own share of words to keep."""
    original = df.columns
    words = {c: f"redact_words_{i}" for i, c in enumerate(keep_ratios)}
    split = df.withColumns({w: spaced_words(ref(c).cast("string")) for c, w in words.items()})
    redacted = split.withColumns({c: redact_words(F.col(words[c]), ratio) for c, ratio in keep_ratios.items()})
    return redacted.select(*[ref(c) for c in original])


def redact_text(df: DataFrame, columns: Sequence[str], keep_ratio: float = 0.5) -> DataFrame:
    """Word redaction of the string columns among ``columns``."""
    wanted = {c: keep_ratio for c in columns if isinstance(data_type(df, c), T.StringType)}
    return with_redacted_words(df, wanted) if wanted else df


# --- bins ------------------------------------------------------------------


def generalize_numeric(df: DataFrame, columns: Sequence[str], bins: int = 5) -> DataFrame:
    """Equal-width interval labels; constant or empty columns stay as they are."""
    numeric = [c for c in columns if is_numeric(data_type(df, c))]
    ranges = value_ranges(df, numeric)
    varying = {c: (r, bins) for c in numeric if (r := ranges[c]).varies}
    return with_interval_labels(df, varying) if varying else df


# --- categories ------------------------------------------------------------


TIE_CHARACTERS = 16


def top_tokens(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, list[str]]:
    """The ``limit`` most frequent values per column, as ``group_token`` names them.

    Ties go by the first 16 characters, then by the token, which is the value itself
    unless it is longer than 64 bytes. No longer text is shuffled.
    """
    if not columns:
        return {}
    by_count = Window.partitionBy("column_name").orderBy(F.desc("cnt"), F.asc("start"), F.asc("token"))
    start = F.substring(F.col("value"), 1, TIE_CHARACTERS)
    # Each task keeps its own top rows before the window's shuffle, so a column
    # with many values does not meet in one task.
    rows = (
        melt(df, {c: ref(c) for c in columns})
        .where(F.col("value").isNotNull())
        .select("column_name", start.alias("start"), group_token(F.col("value")).alias("token"))
        .groupBy("column_name", "start", "token")
        .agg(F.count(F.lit(1)).alias("cnt"))
        .withColumn("place", F.row_number().over(by_count))
        .where(F.col("place") <= limit)
        .collect()
    )
    found: dict[str, list[str]] = {c: [] for c in columns}
    for r in sorted(rows, key=lambda r: r["place"]):
        found[r["column_name"]].append(r["token"])
    return found


def top_values(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, list[str]]:
    """``top_tokens`` as values: long texts are fetched at the end, one for each token that won."""
    found = top_tokens(df, columns, limit)
    long = {c: [t for t in tokens if t.startswith("sha256:")] for c, tokens in found.items()}
    parts = [
        df.where(group_token(ref(c)).isin(tokens)).groupBy(group_token(ref(c)).alias("token")).agg(F.first(ref(c)).alias("value"))
        for c, tokens in long.items()
        if tokens
    ]
    text = {r["token"]: r["value"] for part in parts for r in part.collect()}  # ``limit`` texts a column
    return {c: [text.get(t, t) for t in tokens] for c, tokens in found.items()}


def top_category_columns(df: DataFrame, columns: Sequence[str], max_categories: int = 10) -> dict[str, Column]:
    texts = [c for c in columns if isinstance(data_type(df, c), T.StringType)]
    result = {}
    for name, tokens in top_tokens(df, texts, max_categories + 1).items():
        if len(tokens) > max_categories:
            stays = group_token(ref(name)).isin(tokens[: max_categories - 1])
            result[name] = F.when(stays, ref(name)).otherwise(F.lit(OTHER))
    return result


def generalize_categorical(df: DataFrame, columns: Sequence[str], max_categories: int = 10) -> DataFrame:
    """Keep the most frequent ``max_categories - 1`` values; the rest and nulls become 'Other'."""
    return df.withColumns(top_category_columns(df, columns, max_categories))


def suppress_rare(df: DataFrame, name: str, min_frequency: float = 0.05) -> DataFrame:
    """Values rarer than ``min_frequency`` become 'SUPPRESSED'; nulls stay."""
    if not isinstance(data_type(df, name), T.StringType):
        return df
    token = group_token(ref(name))
    counts = df.select(token.alias("kept_value")).where("kept_value is not null").groupBy("kept_value").agg(
        F.count(F.lit(1)).alias("cnt")
    )
    counts = stage(counts, "counts")
    total = counts.agg(F.sum("cnt").alias("n")).first()["n"]
    if not total:
        return df
    frequent = counts.where(F.col("cnt") / F.lit(float(total)) >= min_frequency).select("kept_value")
    # At most 1 / min_frequency values can be that frequent.
    if min_frequency > 0 and 1 / min_frequency <= FREQUENT_IN_MEMORY:
        keep = [r["kept_value"] for r in frequent.collect()]
        stays = token.isin(keep) if keep else F.lit(False)
        return df.withColumn(
            name, F.when(ref(name).isNull() | stays, ref(name)).otherwise(F.lit(SUPPRESSED))
        )
    # Fewer than HEAVY values can hold that share of the rows each; they need no lookup.
    heavy = [r["kept_value"] for r in counts.where(F.col("cnt") > total / HEAVY).collect()]
    stay = {r["kept_value"] for r in frequent.where(F.col("kept_value").isin(heavy)).collect()} if heavy else set()
    direct = ref(name).isNull() | (token.isin(heavy) if heavy else F.lit(False))
    looked_up = look_up(df, token, frequent, direct, "kept_row")
    stays = ref(name).isNull() | F.col("kept_row") | (token.isin(sorted(stay)) if stay else F.lit(False))
    return looked_up.withColumn(name, F.when(stays, ref(name)).otherwise(F.lit(SUPPRESSED))).drop("kept_row")


# --- microaggregation ------------------------------------------------------


def cluster_means(df: DataFrame, name: str, row_key: str, k: int, align: str = "value") -> DataFrame:
    """(row_key, mean): values sorted, cut into runs of k, each run's mean.

    ``align="value"`` gives every row the mean of the run its own value is in.
    ``align="file_order"`` hands the runs out in row-key order instead.
    """
    rows = df.select(ref(row_key).alias("row_key"), as_number(df, name).alias("value")).where("value is not null")
    ranked = with_position(rows, [F.col("value"), F.col("row_key")]).withColumn(
        "cluster", F.floor(F.col("position") / F.lit(k))
    )
    if align == "value":
        mean = F.avg("value").over(Window.partitionBy("cluster"))  # k rows per partition key
        return ranked.select("row_key", mean.alias("mean"))
    if align != "file_order":
        raise ValueError("align must be 'value' or 'file_order'")
    means = ranked.groupBy("cluster").agg(F.avg("value").alias("mean"))
    in_order = with_position(rows.select("row_key"), [F.col("row_key")])
    return (
        in_order.withColumn("cluster", F.floor(F.col("position") / F.lit(k)))
        .join(means, "cluster")
        .select("row_key", "mean")
    )


def microaggregate(
    df: DataFrame, columns: Sequence[str], row_key: str, k: int = 5, align: str = "value", checked: bool = True
) -> DataFrame:
    """Replace numeric values by their cluster means; fewer than k values stay unchanged.

    Only (key, value) pairs are sorted. The joins back all use the row key, so
    the table itself is shuffled once, whatever the number of columns. A repeated
    or null key raises; ``checked=False`` if the caller has made sure.
    """
    numeric = [c for c in columns if is_numeric(data_type(df, c))]
    counts = value_ranges(df, numeric)
    todo = [c for c in numeric if counts[c].count >= k]
    original = df.columns
    if todo and checked:
        check_row_key(df, row_key)
    for i, name in enumerate(todo):
        means = cluster_means(df, name, row_key, k, align).select(
            F.col("row_key").alias(f"micro_key_{i}"), F.col("mean").alias(f"micro_mean_{i}")
        )
        df = df.join(means, ref(row_key) == F.col(f"micro_key_{i}"), "left")
    replaced: Mapping[str, int] = {name: i for i, name in enumerate(todo)}
    return df.select(
        *[F.col(f"micro_mean_{replaced[c]}").alias(c) if c in replaced else ref(c) for c in original]
    )


# --- documented custom rules -------------------------------------------------


def rule_hash(df: DataFrame, name: str, salt: str) -> DataFrame:
    """Salted SHA-256 of the value."""
    return df.withColumn(name, F.sha2(F.concat(F.lit(salt), ref(name).cast("string")), 256))


def rule_generalize_5(df: DataFrame, name: str) -> DataFrame:
    """The five-wide interval the value falls into, as ``lo-hi``."""
    low = F.floor(ref(name) / F.lit(5)) * 5
    label = F.concat(low.cast("string"), F.lit("-"), (low + 4).cast("string"))
    return df.withColumn(name, label)


def rule_noise_10pct(df: DataFrame, name: str, row_key: str, secret: str) -> DataFrame:
    """The value changed by up to 10 percent either way."""
    swing = keyed_uniform(secret, name, present_key(row_key)) * F.lit(2.0) - F.lit(1.0)
    return df.withColumn(name, as_number(df, name) * (F.lit(1.0) + F.lit(0.1) * swing))
