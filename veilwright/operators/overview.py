"""Dataset overview, previews and before/after samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import as_number, data_type, is_numeric, melt, ref
from ..functions.text import as_text


def _is_present(df: DataFrame, name: str) -> Column:
    value = as_number(df, name, infinite=True) if is_numeric(data_type(df, name)) else ref(name)
    return value.isNotNull()


def column_info(df: DataFrame) -> DataFrame:
    """(column_position, column_name, data_type, non_null, nulls), all columns in one scan."""
    types = [(i, name, dtype) for i, (name, dtype) in enumerate(df.dtypes)]
    schema = df.sparkSession.createDataFrame(types, "column_position int, column_name string, data_type string")
    present = {c: F.when(_is_present(df, c), 1).otherwise(0) for c in df.columns}
    counts = melt(df, present).groupBy("column_name").agg(
        F.sum("value").alias("non_null"), (F.count("value") - F.sum("value")).alias("nulls")
    )
    return schema.join(counts, "column_name", "left").select(
        "column_position",
        "column_name",
        "data_type",
        F.coalesce("non_null", F.lit(0)).alias("non_null"),
        F.coalesce("nulls", F.lit(0)).alias("nulls"),
    )


def dataset_overview(df: DataFrame) -> DataFrame:
    """One row: rows, columns and nulls of the whole table."""
    return column_info(df).agg(
        F.max(F.col("non_null") + F.col("nulls")).alias("total_rows"),
        F.count(F.lit(1)).alias("total_columns"),
        F.sum("nulls").alias("null_values"),
    )


def preview(df: DataFrame, row_key: str, rows: int = 10) -> DataFrame:
    """The first rows in row-key order (a top-k, not a sort of the table)."""
    return df.orderBy(ref(row_key)).limit(rows)


def first_values(df: DataFrame, columns: Sequence[str], row_key: str, values: int = 2) -> DataFrame:
    """The first non-null values of each column in row-key order, as text."""
    in_order = Window.partitionBy("column_name").orderBy("row_key")
    return (
        melt(df, {c: as_text(df, c) for c in columns}, [ref(row_key).alias("row_key")])
        .where(F.col("value").isNotNull())
        .withColumn("place", F.row_number().over(in_order))
        .where(F.col("place") <= values)
        .select("column_name", "place", "value")
    )


def before_after_sample(
    original: DataFrame, anonymized: DataFrame, row_key: str, columns: int = 5, values: int = 2
) -> DataFrame:
    """Leading values of the first columns in both tables, side by side."""
    names = [c for c in original.columns[:columns] if c in anonymized.columns]
    before = first_values(original, names, row_key, values).withColumnRenamed("value", "original")
    after = first_values(anonymized, names, row_key, values).withColumnRenamed("value", "anonymized")
    return before.join(after, ["column_name", "place"], "full_outer")
