"""Profiles, scores and tiers of many datasets at once."""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import as_number, finite, melt, numeric_columns
from ..functions.text import as_text
from ..session import stage
from .classify import NAME_COLUMN, TIER_COLUMN, name_scores, scored, tier
from .compression import CHUNK_BYTES
from .frequency import FREQUENCY_FEATURES, count_spectrum, frequency_features
from .grouped import grouped_association, grouped_shape, pair_rows
from .quantiles import SMALL_ROWS
from .strings import STRING_FEATURES, string_features

IDS = ["dataset"]
SHAPE_FEATURES = ("skewness", "kurtosis", "outlier_ratio")


def _union(parts: Sequence[DataFrame | None]) -> DataFrame | None:
    parts = [p for p in parts if p is not None]
    return reduce(DataFrame.unionByName, parts) if parts else None


def batch_profile(datasets: Mapping[str, DataFrame], small_rows: int = SMALL_ROWS) -> DataFrame:
    """Features per (dataset, column) of differently shaped tables.

    The tables meet in long form, so one grouping for each family of features serves
    all of them.
    """
    return _profile({name: df.withColumn("dataset", F.lit(name)) for name, df in datasets.items()}, small_rows)


def directory_profile(df: DataFrame, small_rows: int = SMALL_ROWS) -> DataFrame:
    """The same for one scan over files of one schema, told apart by ``dataset``."""
    return _profile({"": df}, small_rows)


def _profile(tables: Mapping[str, DataFrame], small_rows: int) -> DataFrame:
    spectra, texts, numbers, pairs, kinds, packed = [], [], [], [], [], []
    dataset = F.col("dataset")
    for name, df in tables.items():
        columns = [c for c in df.columns if c != "dataset"]
        spectra.append(count_spectrum(df, columns, IDS))
        text = melt(df, {c: as_text(df, c) for c in columns}, [dataset])
        texts.append(text.where(F.col("value").isNotNull()))
        plain = [c for c in numeric_columns(df) if c != "dataset"]
        related = [c for c in numeric_columns(df, booleans=True) if c != "dataset"]
        if plain:
            values = {c: finite(as_number(df, c).cast("double")) for c in plain}
            numbers.append(melt(df, values, [dataset]).where(F.col("value").isNotNull()))
        pairs.append(pair_rows(df, {c: as_number(df, c) for c in related}, [dataset]))
        kinds += [(name, c, c in related) for c in columns]
    spark = df.sparkSession
    keys = [*IDS, "column_name"]
    frequency = frequency_features(_union(spectra), IDS)
    strings = stage(string_features(_union(texts), IDS), "strings")
    # Only columns with a pattern are compressed: the ratio counts for nothing in the others.
    patterned = [r[0] for r in strings.where("pattern_ratio > 0").select("column_name").distinct().collect()]
    for df in tables.values():
        own = [c for c in df.columns if c in patterned and c != "dataset"]
        if own:
            packed.append(_compressed(df, own))
    profile = frequency.join(strings, keys)
    nothing = "dataset string, column_name string, "
    shapes = _union(numbers)
    shapes = grouped_shape(shapes, IDS, small_rows) if shapes is not None else spark.createDataFrame([], nothing + ", ".join(f"{c} double" for c in SHAPE_FEATURES))
    related = _union(pairs)
    related = grouped_association(related, IDS) if related is not None else spark.createDataFrame([], nothing + "association double")
    ratios = _union(packed)
    ratios = ratios if ratios is not None else spark.createDataFrame([], nothing + "compression_ratio double")
    kind = spark.createDataFrame(kinds, "of string, column_name string, is_numeric boolean")  # one row per table and column
    if len(tables) > 1:
        profile = profile.join(F.broadcast(kind.withColumnRenamed("of", "dataset")), keys)
    else:
        profile = profile.join(F.broadcast(kind.drop("of")), "column_name")
    association = (
        F.when(F.col("non_null") < 2, F.lit(0.0))
        .when(F.col("is_numeric"), F.coalesce("association", F.lit(0.0)))
        .otherwise(F.col("frequency_spread"))
    )
    return profile.join(shapes, keys, "left").join(related, keys, "left").join(ratios, keys, "left").select(
        "dataset",
        "column_name",
        "non_null",
        "distinct_count",
        *FREQUENCY_FEATURES,
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in (*STRING_FEATURES, *SHAPE_FEATURES)],
        association.alias("association"),
        F.coalesce("compression_ratio", F.lit(1.0)).alias("compression_ratio"),
    )


def _compressed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """gzip bytes over raw bytes by dataset and column, in chunks of 1 MiB per task, dataset and column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str, str], list[bytes]] = {}
        size: dict[tuple[str, str], int] = {}
        done: list[tuple[str, str, int, int]] = []

        def flush(key: tuple[str, str]) -> None:
            data = b" ".join(held.pop(key))
            size.pop(key)
            if data:
                done.append((*key, len(data), len(gzip.compress(data))))

        def rows() -> pa.RecordBatch:
            names = ("dataset", "column_name", "raw_bytes", "packed_bytes")
            out = pa.RecordBatch.from_pylist([dict(zip(names, d)) for d in done], schema)
            done.clear()
            return out

        schema = pa.schema([("dataset", pa.string()), ("column_name", pa.string()), ("raw_bytes", pa.int64()), ("packed_bytes", pa.int64())])
        for batch in batches:
            datasets = batch.column(0).to_pylist()
            for i, name in enumerate(columns):
                for dataset, text in zip(datasets, batch.column(i + 1).to_pylist()):
                    if text is not None:
                        key = (dataset, name)
                        held.setdefault(key, []).append(text.encode("utf-8", "surrogatepass"))
                        size[key] = size.get(key, 0) + len(held[key][-1]) + 1
                        if size[key] >= CHUNK_BYTES:
                            flush(key)
            # Rows of a dataset come together; one that is not in this batch is over.
            for key in [k for k in held if k[0] not in set(datasets)]:
                flush(key)
            yield rows()
        for key in list(held):
            flush(key)
        yield rows()

    texts = df.select("dataset", *[as_text(df, c).alias(f"t{i}") for i, c in enumerate(columns)])
    sums = texts.mapInArrow(run, "dataset string, column_name string, raw_bytes long, packed_bytes long")
    return sums.groupBy("dataset", "column_name").agg((F.sum("packed_bytes") / F.sum("raw_bytes")).alias("compression_ratio"))


def batch_scores(profile: DataFrame, normalize_keywords: bool = False) -> DataFrame:
    """A profile with the five composite scores and the tier of each (dataset, column)."""
    names = [r[0] for r in profile.select("column_name").distinct().collect()]  # column names, not datasets
    hints = name_scores(profile, names, normalize_keywords)
    return scored(profile.join(F.broadcast(hints), "column_name")).withColumn("risk_tier", tier())


def batch_classify(datasets: Mapping[str, DataFrame] | DataFrame, normalize_keywords: bool = False) -> DataFrame:
    """The classification of many datasets: dataset, column name and risk tier.

    ``datasets``: tables by name, or one scan with a column ``dataset``.
    """
    profile = directory_profile(datasets) if isinstance(datasets, DataFrame) else batch_profile(datasets)
    scores = batch_scores(stage(profile, "profiles"), normalize_keywords)
    return scores.select("dataset", F.col("column_name").alias(NAME_COLUMN), F.col("risk_tier").alias(TIER_COLUMN))
