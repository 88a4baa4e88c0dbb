"""Work that depends on a total order of the rows, without one big task.

``with_position`` numbers rows globally. ``monotonic`` decides whether a column
only rises or only falls in row order, from one summary row per partition.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import as_number, column_frame, data_type, is_numeric, melt, ref
from ..functions.text import as_text, parse_number
from ..session import stage

LOCAL_BITS = 33  # monotonically_increasing_id(): partition above, row below


def _offsets(ids: DataFrame) -> DataFrame:
    """Rows before each partition. One row per partition: small by construction."""
    sizes = ids.groupBy(F.shiftright("row_tag", LOCAL_BITS).alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    before = F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return sizes.select("part", F.coalesce(before, F.lit(0)).alias("rows_before"))


def _number(tagged: DataFrame, position: str) -> DataFrame:
    staged = stage(tagged, "ranked")
    offsets = _offsets(staged.select("row_tag"))
    local = F.col("row_tag").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    return (
        staged.withColumn("part", F.shiftright("row_tag", LOCAL_BITS))
        .join(F.broadcast(offsets), "part")  # one row per partition
        .withColumn(position, F.col("rows_before") + local)
        .drop("part", "row_tag", "rows_before")
    )


def with_position(df: DataFrame, order: Sequence[Column], position: str = "position") -> DataFrame:
    """0-based global rank by ``order``, which must be a total order.

    Range-partitioned and sorted within partitions; the (partition, local row)
    tags are written once, so that a lost executor cannot change them between
    counting the partitions and numbering the rows.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return _number(ranged.withColumn("row_tag", F.monotonically_increasing_id()), position)


def check_row_key(df: DataFrame, row_key: str) -> None:
    """Raise unless every row has a key of its own. One grouping by the key; three numbers reach the driver."""
    counts = df.groupBy(ref(row_key).alias("row_key")).agg(F.count(F.lit(1)).alias("rows"))
    nulls, repeated, rows = counts.agg(
        F.sum(F.when(F.col("row_key").isNull(), F.col("rows"))),
        F.count_if((F.col("rows") > 1) & F.col("row_key").isNotNull()),
        F.sum(F.when((F.col("rows") > 1) & F.col("row_key").isNotNull(), F.col("rows"))),
    ).first()
    if nulls or repeated:
        raise ValueError(f"row key {row_key!r}: {nulls or 0} null keys, {repeated or 0} keys shared by {rows or 0} rows")


#: The column in which a reader leaves the place of each row, in an order that sorts as the rows do.
PLACE = "__place__"


class NoFileOrder(ValueError):
    """The rows of a table have no order of their own."""


def with_file_position(df: DataFrame, position: str = "position", scan_order: bool = False) -> DataFrame:
    """0-based row number by file path, place in the file and row.

    For tables read directly from Parquet or other files, and for CSV read with
    ``place=True``. How Spark packs files into tasks does not matter. Other tables
    raise, or with ``scan_order`` are numbered as their source delivers the rows.
    """
    if PLACE in df.columns:
        return with_position(df, [F.col(PLACE)], position).drop(PLACE)
    try:
        if not df.inputFiles() or "_metadata" in df.columns:
            raise NoFileOrder("the table is not read from files")
        placed = df.select(
            "*",
            F.col("_metadata.file_path").alias("file_place"),
            F.col("_metadata.file_block_start").alias("block_place"),
        )
    except (AnalysisException, NoFileOrder) as error:
        if scan_order:
            return with_scan_position(df, position)
        raise NoFileOrder(
            "only tables read directly from files have an order (CSV: with place=True); scan_order=True takes the order of the scan"
        ) from error
    placed = placed.withColumn("row_place", F.monotonically_increasing_id())
    return with_position(placed, [F.col("file_place"), F.col("block_place"), F.col("row_place")], position).drop(
        "file_place", "block_place", "row_place"
    )


def with_scan_position(df: DataFrame, position: str = "position") -> DataFrame:
    """0-based row number in the order the source delivers its rows."""
    return _number(df.withColumn("row_tag", F.monotonically_increasing_id()), position)


def _numeric_view(df: DataFrame, name: str) -> Column:
    dtype = data_type(df, name)
    if is_numeric(dtype):
        return as_number(df, name)
    return parse_number(as_text(df, name))


SUMMARY = (
    "part int, column_name string, n long, first_value double, last_value double, "
    "rises boolean, falls boolean"
)


def _summaries(columns: Sequence[str]):
    """Fold a partition's rows (already in order) into one row per column."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [0] * len(columns)
        first: list[float | None] = [None] * len(columns)
        last: list[float | None] = [None] * len(columns)
        rises, falls = [True] * len(columns), [True] * len(columns)
        for batch in batches:
            for i in range(len(columns)):
                values = batch.column(i).drop_null().to_numpy(zero_copy_only=False)
                if not len(values):
                    continue
                steps = np.diff(values) if last[i] is None else np.diff(values, prepend=last[i])
                rises[i] = rises[i] and bool((steps >= 0).all())
                falls[i] = falls[i] and bool((steps <= 0).all())
                first[i] = float(values[0]) if first[i] is None else first[i]
                last[i] = float(values[-1])
                n[i] += len(values)
        part = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([part] * len(columns), pa.int32()),
                "column_name": pa.array(list(columns)),
                "n": pa.array(n, pa.int64()),
                "first_value": pa.array(first, pa.float64()),
                "last_value": pa.array(last, pa.float64()),
                "rises": pa.array(rises),
                "falls": pa.array(falls),
            }
        )

    return fold


PRUNE_BUCKETS = 512
PRUNE_ROWS = 1_000_000


def _may_be_monotonic(df: DataFrame, row_key: str, columns: Sequence[str]) -> list[str]:
    """Columns not ruled out by their ranges in consecutive row-key buckets.

    A rising column has, in each bucket, no value below the bucket before. One
    scan with map-side aggregation drops nearly every column before any sort.
    """
    key = ref(row_key).cast("double")
    low, high = df.agg(F.min(key), F.max(key)).first()
    if low is None or low == high:
        return list(columns)
    bucket = F.floor((key - F.lit(low)) / F.lit(high - low) * PRUNE_BUCKETS).alias("bucket")
    by_bucket = Window.partitionBy("column_name").orderBy("bucket")
    verdict = (
        melt(df, {c: _numeric_view(df, c) for c in columns}, [bucket])
        .where(F.col("value").isNotNull())
        .groupBy("column_name", "bucket")
        .agg(F.min("value").alias("low"), F.max("value").alias("high"))
        .withColumn("rise", F.coalesce(F.col("low") >= F.lag("high").over(by_bucket), F.lit(True)))
        .withColumn("fall", F.coalesce(F.col("high") <= F.lag("low").over(by_bucket), F.lit(True)))
        .groupBy("column_name")
        .agg((F.bool_and("rise") | F.bool_and("fall")).alias("possible"))
        .where("possible")
    )
    left = {r["column_name"] for r in verdict.collect()}
    return [c for c in columns if c in left]


def profile_monotonic(
    df: DataFrame, row_key: str, columns: Sequence[str] | None = None, prune_rows: int = PRUNE_ROWS
) -> DataFrame:
    """Share of numeric values if they only rise or only fall in ``row_key`` order, else 0."""
    columns = list(columns or df.columns)
    totals = melt(df, {c: F.when(ref(c).isNotNull(), F.lit(1)) for c in columns}).groupBy("column_name").agg(
        F.count("value").alias("non_null")
    )
    names = column_frame(df, columns).join(totals, "column_name", "left")
    candidates = columns
    if is_numeric(data_type(df, row_key)) and df.count() > prune_rows:
        candidates = _may_be_monotonic(df, row_key, columns)
    if not candidates:
        return names.select("column_position", "column_name", F.lit(0.0).alias("monotonic_ratio"))

    ranged = (
        df.select(ref(row_key).alias("row_key"), *[_numeric_view(df, c).alias(f"v{i}") for i, c in enumerate(candidates)])
        .repartitionByRange("row_key")
        .sortWithinPartitions("row_key")
        .drop("row_key")
    )
    parts = ranged.mapInArrow(_summaries(candidates), SUMMARY).where("n > 0")
    in_order = Window.partitionBy("column_name").orderBy("part")  # one row per partition and column
    gap = F.col("first_value") - F.lag("last_value").over(in_order)
    folded = (
        parts.withColumn("gap", F.coalesce(gap, F.lit(0.0)))
        .groupBy("column_name")
        .agg(
            F.sum("n").alias("n"),
            F.bool_and(F.col("rises") & (F.col("gap") >= 0)).alias("rises"),
            F.bool_and(F.col("falls") & (F.col("gap") <= 0)).alias("falls"),
        )
    )
    steady = (F.col("n") >= 2) & (F.col("rises") | F.col("falls"))
    return names.join(folded, "column_name", "left").select(
        "column_position",
        "column_name",
        F.when(steady, F.col("n") / F.col("non_null")).otherwise(F.lit(0.0)).alias("monotonic_ratio"),
    )
