"""Schema helpers and the row-to-long reshaping every profile starts from."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, functions as F, types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType, T.DecimalType)


def ref(name: str) -> Column:
    """Column reference that is safe for names with dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def data_type(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_numeric(dtype: T.DataType) -> bool:
    return isinstance(dtype, INTEGRAL + FRACTIONAL)


def numeric_columns(df: DataFrame, booleans: bool = False) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if is_numeric(f.dataType) or (booleans and isinstance(f.dataType, T.BooleanType))
    ]


def finite(value: Column) -> Column:
    """NaN and infinities as NULL, -0.0 as 0.0."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value + F.lit(0.0))


def as_number(df: DataFrame, name: str, infinite: bool = False) -> Column:
    """The column as a double for statistics: NaN and infinities become NULL, -0.0 becomes 0.0.

    ``infinite`` keeps infinities, where values are only told apart or changed.
    """
    dtype = data_type(df, name)
    if isinstance(dtype, T.BooleanType):
        return ref(name).cast("int").cast("double")
    value = ref(name).cast("double")
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        value = F.when(~F.isnan(value), value + F.lit(0.0)) if infinite else finite(value)
    return value


def nan_to_null(df: DataFrame) -> DataFrame:
    """Spark groups NaN as a value; the statistics here treat it as missing."""
    fixed = {
        f.name: F.when(~F.isnan(ref(f.name)), ref(f.name))
        for f in df.schema.fields
        if isinstance(f.dataType, (T.FloatType, T.DoubleType))
    }
    return df.withColumns(fixed) if fixed else df


def melt(
    df: DataFrame,
    columns: Mapping[str, Column],
    ids: Iterable[Column] = (),
    variable: str = "column_name",
    value: str = "value",
) -> DataFrame:
    """One row per (row, column). A projection and an Expand: no shuffle."""
    ids = list(ids)
    wide = df.select(*ids, *[expr.alias(name) for name, expr in columns.items()])
    id_names = wide.columns[: len(ids)]
    return wide.unpivot([ref(c) for c in id_names], [ref(c) for c in columns], variable, value)


def column_frame(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """The column names with their position as a table (as many rows as columns)."""
    rows = [(i, name) for i, name in enumerate(names)]
    return df.sparkSession.createDataFrame(rows, "column_position int, column_name string")
