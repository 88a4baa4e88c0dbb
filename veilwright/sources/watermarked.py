"""CSV files that carry a watermark line before their header."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import ref
from ..operators.watermark import (
    PREFIX,
    detect_watermark,
    says_anonymized,
    validate_watermark,
    watermark_line,
)
from .records import file_heads, read_records
from .tables import CSV_OPTIONS, NA_TOKENS, typed

SIDECAR = "_watermark"


def write_watermarked(df: DataFrame, path: str, watermark: Mapping[str, Any]) -> None:
    """Text part files, each starting with the watermark line and the header.

    The JSON is also kept beside them in ``_watermark``, which readers skip. Any
    failure raises: a file without its mark must not pass for a marked one.
    """
    spark = df.sparkSession
    plain_line = F.to_csv(F.struct(*[ref(c) for c in df.columns]), CSV_OPTIONS)
    names = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in ',"\n') else c for c in df.columns)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    lead = F.array(F.lit(watermark_line(watermark)), F.lit(names))
    lines = df.select(plain_line.alias("line"), local.alias("local")).select(
        F.explode(F.when(F.col("local") == 0, F.concat(lead, F.array("line"))).otherwise(F.array("line"))).alias("value")
    )
    # A file cut by a limit of records would start without its mark.
    lines.write.option("maxRecordsPerFile", 0).text(path)
    if spark.read.text(path).isEmpty():
        empty = spark.createDataFrame([(watermark_line(watermark),), (names,)], "value string")
        empty.coalesce(1).write.mode("append").text(path)
    _write_sidecar(spark, path, watermark)


def _write_sidecar(spark: SparkSession, path: str, watermark: Mapping[str, Any]) -> None:
    note = spark.createDataFrame([(json.dumps(watermark),)], "value string")
    note.coalesce(1).write.text(f"{path.rstrip('/')}/{SIDECAR}")


def write_marked_parquet(df: DataFrame, path: str, watermark: Mapping[str, Any]) -> None:
    """Parquet with the mark beside its files, where ``refuse_marked`` finds it."""
    df.write.parquet(path)
    _write_sidecar(df.sparkSession, path, watermark)


def _sidecar(spark: SparkSession, path: str) -> DataFrame | None:
    """The mark beside the files of a folder, as a table like ``watermarks``."""
    try:
        note = spark.read.text(f"{path.rstrip('/')}/{SIDECAR}")
    except AnalysisException:
        return None
    lines = note.select(F.lit(path).alias("file"), F.concat(F.lit(PREFIX + " "), "value").alias("line"))
    return validate_watermark(detect_watermark(lines))


def watermarks(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, watermark, is_watermarked, reason, is_valid) per file under ``path``.

    Only first lines are read, whatever the size of a file; ``line`` is null if it is no mark.
    """
    heads = file_heads(spark, path, PREFIX, header=False, recursive=True)
    return validate_watermark(detect_watermark(heads.select("file", F.col("mark").alias("line"))))


def read_watermarked(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
    multiline: bool = True,
    place: bool = False,
) -> DataFrame:
    """The data rows of watermarked (or plain) CSV files with a header each.

    Each file loses its first line if that is a mark, and the record after as its
    header: by place, so that data rows that look like either stay. All else is as in
    ``read_csv``.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = schema.fieldNames() if schema is not None else None
    return typed(read_records(spark, path, names, PREFIX, True, multiline, place), schema, na_tokens)


class AlreadyAnonymized(ValueError):
    """The input carries a watermark."""


def _marked(found: DataFrame) -> list:
    return found.where(F.col("is_watermarked") & says_anonymized(F.col("watermark"))).limit(1).collect()


def refuse_marked(spark: SparkSession, path: str, force: bool = False, lines: bool = True) -> None:
    """Raise if any file under ``path``, or the folder itself, is marked as anonymized, unless ``force``.

    A mark counts if its ``anonymized`` field says so, whatever other fields it has.
    """
    beside = _sidecar(spark, path)
    marked = _marked(beside) if beside is not None else []
    if not marked and lines:
        marked = _marked(watermarks(spark, path))
    if marked and not force:
        raise AlreadyAnonymized(f"{marked[0]['file']} is already anonymized: {marked[0]['watermark']}")
