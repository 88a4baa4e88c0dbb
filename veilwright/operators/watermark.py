"""Provenance watermarks: create, detect, validate, compare.

A watermark is one JSON object. Detection, validation and comparison work on
tables of watermarks, so that a lake of files is checked in one job.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from .overview import column_info

# The line prefix and the fields of the format.
PREFIX = "# ANONYMIZATION_WATERMARK:"
REQUIRED_FIELDS = ("anonymized", "anonymization_timestamp", "anonymization_params", "version")
VERSION = "1.0"
TOOL = "veilwright"

# The reasons a validation reports.
NOT_AN_OBJECT = "Watermark must be a dictionary"
MISSING = "Missing required field: "
NOT_ANONYMIZED = "Watermark indicates data is not anonymized"
VALID = "Watermark is valid"

FIELDS = "map<string,string>"


def extract_dataset_info(df: DataFrame) -> dict[str, Any]:
    """Shape, columns, types and null count, for embedding in a watermark."""
    info = column_info(df).collect()
    rows = max((r["non_null"] + r["nulls"] for r in info), default=0)
    return {
        "original_shape": [rows, len(info)],
        "columns": df.columns,
        "data_types": dict(df.dtypes),
        "null_count": sum(r["nulls"] for r in info),
    }


def make_watermark(
    params: Mapping[str, Any],
    quality: Mapping[str, Any] | None = None,
    info: Mapping[str, Any] | None = None,
    timestamp: str | None = None,
) -> dict[str, Any]:
    """The watermark of one run. Only scalar metrics belong in ``quality``."""
    return {
        "anonymized": True,
        "anonymization_timestamp": timestamp or datetime.now(timezone.utc).replace(tzinfo=None).isoformat(),
        "anonymization_params": dict(params),
        "quality_metrics": dict(quality or {}),
        "dataset_info": dict(info or {}),
        "version": VERSION,
        "tool": TOOL,
    }


def watermark_line(watermark: Mapping[str, Any]) -> str:
    """One line, so that reading the first line finds all of it."""
    return f"{PREFIX} {json.dumps(watermark)}"


def watermark_json(
    params: Column, timestamp: Column, anonymized: Column | None = None, quality: Column | None = None,
    info: Column | None = None, version: Column | None = None,
) -> Column:
    """The watermark as a JSON column; a NULL part is left out of the object."""
    empty = F.from_json(F.lit("{}"), FIELDS)
    return F.to_json(
        F.struct(
            (F.lit(True) if anonymized is None else anonymized).alias("anonymized"),
            timestamp.alias("anonymization_timestamp"),
            params.alias("anonymization_params"),
            (empty if quality is None else quality).alias("quality_metrics"),
            (empty if info is None else info).alias("dataset_info"),
            (F.lit(VERSION) if version is None else version).alias("version"),
            F.lit(TOOL).alias("tool"),
        )
    )


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is worked out once, however often ``then`` names it."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _parsed(text: Column) -> Column:
    """A text as VARIANT; null if it is not strict JSON.

    The parser ignores what follows a value, so it gets the text as the first of two
    elements, and the second must come out, too.
    """
    seal = F.sha2(text, 256)
    both = F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), seal, F.lit('"]')))

    def first(pair: Column) -> Column:
        return F.when(F.try_variant_get(pair, "$[1]", "string") == seal, F.try_variant_get(pair, "$[0]", "variant"))

    return _let(both, first)


def _kind(value: Column) -> Column:
    """VOID, BOOLEAN, STRING, a number's type, ARRAY<..> or OBJECT<..>."""
    return F.schema_of_variant(value)


def detect_watermark(lines: DataFrame) -> DataFrame:
    """Adds ``watermark`` (its JSON, NULL if absent or broken) and ``is_watermarked``.

    Any JSON value but ``null`` is a mark; whether it is a good one, validation says.
    """
    body = F.trim(F.regexp_replace(F.substr(F.col("line"), F.lit(len(PREFIX) + 1)), r"^\s+|\s+$", ""))
    is_json = F.coalesce(_kind(_parsed(body)) != "VOID", F.lit(False))
    whole = F.when(F.col("line").startswith(PREFIX) & is_json, body)
    return lines.withColumn("watermark", whole).withColumn("is_watermarked", F.col("watermark").isNotNull())


def _says(mark: Column) -> Column:
    def truth(flag: Column) -> Column:
        kind, text = _kind(flag), F.to_json(flag)
        number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
        return (
            F.when(kind == "VOID", False)
            .when(number, F.try_variant_get(flag, "$", "double") != 0)
            .otherwise(~text.isin("false", '""', "{}", "[]"))
        )

    return F.coalesce(_let(F.try_variant_get(mark, "$.anonymized", "variant"), truth), F.lit(False))


def says_anonymized(watermark: Column) -> Column:
    """Whether a watermark's ``anonymized`` field is there and not empty, zero, false or null."""
    return _let(_parsed(watermark), _says)


def validate_watermark(df: DataFrame, column: str = "watermark") -> DataFrame:
    """Adds ``is_valid`` and ``reason``."""

    def told(mark: Column) -> Column:
        reason = F.when(F.coalesce(~_kind(mark).startswith("OBJECT"), F.lit(True)), NOT_AN_OBJECT)
        for name in REQUIRED_FIELDS:
            reason = reason.when(F.try_variant_get(mark, f"$.{name}", "variant").isNull(), MISSING + name)
        return reason.when(~_says(mark), NOT_ANONYMIZED).otherwise(VALID)

    return df.withColumn("reason", _let(_parsed(F.col(column)), told)).withColumn("is_valid", F.col("reason") == VALID)


RUN = "anonymization_timestamp string, anonymization_params map<string,string>"


def _elapsed(start: Column, end: Column) -> Column:
    """``[-]D days, H:MM:SS[.ffffff]``, days rounded down, or 'Unknown'."""
    micros = F.unix_micros(F.try_to_timestamp(end)) - F.unix_micros(F.try_to_timestamp(start))
    days = F.floor(micros / F.lit(86_400_000_000))
    rest = micros - days * 86_400_000_000
    seconds = F.floor(rest / F.lit(1_000_000))
    fraction = rest - seconds * 1_000_000

    def two(value: Column) -> Column:
        return F.lpad(value.cast("string"), 2, "0")

    prefix = F.when(days == 0, F.lit("")).otherwise(
        F.concat(days.cast("string"), F.when(F.abs(days) == 1, F.lit(" day, ")).otherwise(F.lit(" days, ")))
    )
    clock = F.concat_ws(
        ":",
        F.floor(seconds / 3600).cast("string"),
        two(F.floor((seconds % 3600) / 60)),
        two(seconds % 60),
    )
    micro_text = F.when(fraction == 0, F.lit("")).otherwise(
        F.concat(F.lit("."), F.lpad(fraction.cast("string"), 6, "0"))
    )
    return F.coalesce(F.concat(prefix, clock, micro_text), F.lit("Unknown"))


def compare_watermarks(pairs: DataFrame, original: str = "original", new: str = "new") -> DataFrame:
    """Adds ``same_anonymization``, ``timestamp_difference`` and ``parameter_changes``."""
    no_params = F.from_json(F.lit("{}"), FIELDS)

    def parsed(side: str) -> list[Column]:
        run = F.col(f"{side}_run")
        return [
            run["anonymization_timestamp"].alias(f"{side}_time"),
            F.coalesce(run["anonymization_params"], no_params).alias(f"{side}_params"),
        ]

    pairs = pairs.withColumn("old_run", F.from_json(F.col(original), RUN)).withColumn(
        "new_run", F.from_json(F.col(new), RUN)
    )
    ids = [c for c in pairs.columns if c not in ("old_run", "new_run")]
    pairs = pairs.select(*[F.col(f"`{c}`") for c in ids], *parsed("old"), *parsed("new"))
    zipped = F.map_zip_with(
        "old_params", "new_params", lambda _, old, new: F.struct(old.alias("original"), new.alias("new"))
    )
    differing = F.filter(
        F.map_entries(zipped), lambda e: ~e["value"]["original"].eqNullSafe(e["value"]["new"])
    )
    changes = F.transform(
        differing,
        lambda e: F.struct(
            e["key"].alias("parameter"), e["value"]["original"].alias("original"), e["value"]["new"].alias("new")
        ),
    )
    return (
        pairs.withColumn("parameter_changes", changes)
        .withColumn(
            "same_anonymization",
            F.array_sort(F.map_entries("old_params")) == F.array_sort(F.map_entries("new_params")),
        )
        .withColumn("timestamp_difference", _elapsed(F.col("old_time"), F.col("new_time")))
        .drop("old_params", "new_params", "old_time", "new_time")
    )


def parameter_changes(compared: DataFrame, *ids: str) -> DataFrame:
    """One row per changed parameter: (ids..., parameter, original, new)."""
    return compared.select(*ids, F.inline("parameter_changes"))
