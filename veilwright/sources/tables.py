"""Plain scans and sinks: Parquet, and CSV with a header."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import nan_to_null, ref
from ..functions.text import parse_number
from .records import PLACE, read_records

# Cell texts that mean "missing" in a CSV file.
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE_TOKENS = ("True", "TRUE", "true")
FALSE_TOKENS = ("False", "FALSE", "false")
# Quotes double inside quotes, and blanks at the ends of a value are kept.
CSV_OPTIONS = {
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": "false",
    "ignoreTrailingWhiteSpace": "false",
}


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return nan_to_null(spark.read.parquet(path))


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    na_tokens: Sequence[str] = NA_TOKENS,
    multiline: bool = True,
    place: bool = False,
) -> DataFrame:
    """CSV with a header in every file. Without ``schema``, one pass over the files finds the types.

    Line breaks inside quotes are part of the cell; large files are read by several
    tasks all the same (``multiline=False`` spares the pass that looks for such
    breaks). Files may order their columns differently; files with other columns, a
    row with surplus cells and a cell that is not of its declared type raise. Missing
    cells at a row's end are nulls. ``place`` keeps each row's place in its file, for
    ``align_by_position``.
    """
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    names = schema.fieldNames() if schema is not None else None
    return typed(read_records(spark, path, names, "", False, multiline, place), schema, na_tokens)


def typed(texts: DataFrame, schema: T.StructType | None, na_tokens: Sequence[str] = NA_TOKENS) -> DataFrame:
    """All-text columns with the missing markers removed and types applied.

    Inferred types are boolean, bigint, double or string: dates stay text.
    """
    place = [PLACE] if PLACE in texts.columns else []
    present = texts.select(
        *[F.when(~ref(c).isin(list(na_tokens)), ref(c)).alias(c) for c in texts.columns if c != PLACE], *place
    )
    schema = schema or infer_types(present.drop(PLACE))
    return nan_to_null(present.select(*[_convert(f).alias(f.name) for f in schema.fields], *place))


def _is_whole(text: Column) -> Column:
    return text.rlike(r"^\s*[+-]?\d+\s*$") & F.trim(text).try_cast("bigint").isNotNull()


def infer_types(texts: DataFrame) -> T.StructType:
    tests = {
        "boolean": lambda c: c.isin([*TRUE_TOKENS, *FALSE_TOKENS]),
        "bigint": _is_whole,
        "double": lambda c: parse_number(c).isNotNull(),
    }
    found = texts.agg(
        *[F.count(ref(c)).alias(f"{i}_present") for i, c in enumerate(texts.columns)],
        *[
            F.bool_and(F.when(ref(c).isNotNull(), test(ref(c)))).alias(f"{i}_{name}")
            for i, c in enumerate(texts.columns)
            for name, test in tests.items()
        ],
    ).first()
    kinds = {"boolean": T.BooleanType(), "bigint": T.LongType(), "double": T.DoubleType()}
    fields = []
    for i, c in enumerate(texts.columns):
        kind = next((name for name in tests if found[f"{i}_present"] and found[f"{i}_{name}"]), None)
        fields.append(T.StructField(c, kinds.get(kind, T.StringType())))
    return T.StructType(fields)


def _convert(field: T.StructField) -> Column:
    text = ref(field.name)
    if isinstance(field.dataType, T.StringType):
        return text
    if isinstance(field.dataType, T.BooleanType):
        message = F.concat(F.lit(f"not a boolean in column {field.name}: "), text)
        known = F.when(text.isNull(), F.lit(None)).when(text.isin(list(TRUE_TOKENS)), True)
        return known.when(text.isin(list(FALSE_TOKENS)), False).otherwise(F.raise_error(message)).cast("boolean")
    return F.trim(text).cast(field.dataType)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header line in every part file."""
    df.write.options(header=True, **CSV_OPTIONS).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.parquet(path)


def scan_directory(spark: SparkSession, path: str, fmt: str = "parquet", **options: str) -> DataFrame:
    """All files of one schema in one scan, with ``dataset`` naming each row's file.

    The name is the path below the scanned folder, so that equal file names in
    two folders stay apart.
    """
    files = spark.read.options(**options).format(fmt).load(path)
    folder = path.rstrip("/").rsplit("/", 1)[-1]
    below = F.regexp_replace(F.col("_metadata.file_path"), rf"^.*?/\Q{folder}\E/", "")
    return nan_to_null(files.select("*", below.alias("dataset")))


def input_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, size) of every file under ``path``; nothing of them is read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return listed.select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")


def dataset_name(path: str, file: str) -> str:
    """A file's path below the scanned folder."""
    folder = path.rstrip("/").rsplit("/", 1)[-1]
    return file.split(f"/{folder}/", 1)[-1]
