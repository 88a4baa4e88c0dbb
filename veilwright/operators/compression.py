"""How well each column's text compresses."""

from __future__ import annotations

import gzip
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.columns import column_frame, ref
from ..functions.text import as_text
from .ordered import with_position

CHUNK_BYTES = 1 << 20
RUN_ROWS = 10_000


def _compressed_chunks(columns: Sequence[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: list[list[bytes]] = [[] for _ in columns]
        size = [0] * len(columns)
        raw, packed = [0] * len(columns), [0] * len(columns)

        def flush(i: int) -> None:
            data = b" ".join(pending[i])
            if data:
                raw[i] += len(data)
                packed[i] += len(gzip.compress(data))
            pending[i], size[i] = [], 0

        for batch in batches:
            for i in range(len(columns)):
                texts = batch.column(i).drop_null()
                if len(texts):
                    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts)
                    pending[i].append(pc.binary_join(whole, " ")[0].as_py().encode("utf-8"))
                    size[i] += len(pending[i][-1]) + 1
                    if size[i] >= CHUNK_BYTES:
                        flush(i)
        for i in range(len(columns)):
            flush(i)
        yield pa.RecordBatch.from_pydict(
            {
                "column_name": pa.array(list(columns)),
                "raw_bytes": pa.array(raw, pa.int64()),
                "packed_bytes": pa.array(packed, pa.int64()),
            }
        )

    return run


def _gzipped(rows: pa.Table) -> pa.Table:
    """One chunk of one column, its values in row-key order."""
    ordered = rows.sort_by([("row_key", "ascending"), ("size", "ascending"), ("value", "ascending")])
    data = b" ".join(v.encode("utf-8", "surrogatepass") for v in ordered["value"].to_pylist())
    packed = len(gzip.compress(data)) if data else 0
    return pa.table({"column_no": rows["column_no"].slice(0, 1), "raw_bytes": pa.array([len(data)], pa.int64()), "packed_bytes": pa.array([packed], pa.int64())})


def compression_by_key(df: DataFrame, row_key: str, columns: Sequence[str], chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """column_no, raw_bytes and packed_bytes, the same however the rows are spread over tasks.

    Values go in row-key order; a chunk ends where the bytes before a value pass a
    multiple of ``chunk_bytes``. The bytes before a row are added up over ranges of
    keys of equal rank, then inside each, so no column meets in one task.
    """
    size = [F.coalesce(F.octet_length(as_text(df, c)) + 1, F.lit(0)).cast("long").alias(f"s{i}") for i, c in enumerate(columns)]
    text = [as_text(df, c).alias(f"t{i}") for i, c in enumerate(columns)]
    ranked = with_position(df.select(ref(row_key).alias("row_key"), *text, *size), [F.col("row_key"), *[F.col(f"t{i}") for i in range(len(columns))]])
    ranked = ranked.withColumn("run", F.floor(F.col("position") / RUN_ROWS))
    runs = ranked.groupBy("run").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(columns))])
    before = Window.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)  # one row for RUN_ROWS rows
    starts = runs.select("run", *[F.coalesce(F.sum(f"s{i}").over(before), F.lit(0)).alias(f"b{i}") for i in range(len(columns))])
    inside = Window.partitionBy("run").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    cells = [
        F.struct(
            F.lit(i).alias("column_no"),
            F.floor((F.col(f"b{i}") + F.coalesce(F.sum(f"s{i}").over(inside), F.lit(0))) / chunk_bytes).alias("chunk"),
            F.col("position").alias("row_key"),
            F.col(f"s{i}").alias("size"),
            F.col(f"t{i}").alias("value"),
        )
        for i in range(len(columns))
    ]
    long = ranked.join(starts, "run").select(F.array(*cells).alias("cells")).select(F.inline("cells")).where("value IS NOT NULL")
    packed = long.groupBy("column_no", "chunk").applyInArrow(_gzipped, "column_no int, raw_bytes long, packed_bytes long")
    return packed.groupBy("column_no").agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("packed_bytes").alias("packed_bytes"))


def profile_compression(df: DataFrame, columns: Sequence[str] | None = None, row_key: str | None = None) -> DataFrame:
    """gzip bytes over raw bytes of the space-joined values; 1 without any bytes.

    Every value is compressed, in chunks of at least 1 MiB: the compressor's window
    is 32 KiB, so longer chunks would not change the ratio noticeably, and a table in
    one chunk gives exactly the whole-column ratio. With ``row_key`` the chunks are
    cut in its order and do not depend on the tasks; else they are each task's.
    """
    columns = list(columns or df.columns)
    if row_key is not None:
        totals = compression_by_key(df, row_key, columns)
        names = F.array(*[F.lit(c) for c in columns])
        return _with_ratio(column_frame(df, columns), totals.withColumn("column_name", names[F.col("column_no")]).drop("column_no"))
    texts = df.select(*[as_text(df, c).alias(f"t{i}") for i, c in enumerate(columns)])
    totals = (
        texts.mapInArrow(_compressed_chunks(columns), "column_name string, raw_bytes long, packed_bytes long")
        .groupBy("column_name")
        .agg(F.sum("raw_bytes").alias("raw_bytes"), F.sum("packed_bytes").alias("packed_bytes"))
    )
    return _with_ratio(column_frame(df, columns), totals)


def _with_ratio(names: DataFrame, totals: DataFrame) -> DataFrame:
    ratio = F.when(F.col("raw_bytes") > 0, F.col("packed_bytes") / F.col("raw_bytes")).otherwise(F.lit(1.0))
    return names.join(totals, "column_name", "left").select(
        "column_position", "column_name", ratio.alias("compression_ratio"), F.coalesce("raw_bytes", F.lit(0)).alias("raw_bytes")
    )
