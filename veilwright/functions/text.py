"""Text forms, text patterns and text redaction as native expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from .columns import FRACTIONAL, data_type, ref

# The patterns define what counts as each kind of content.
DIGITS = r"^\d+$"
SPECIAL_CHAR = r"[^a-zA-Z0-9\s]"
EMAIL = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE = r"^\+?1?\-?\.?\(?[0-9]{3}\)?\-?\.?[0-9]{3}\-?\.?[0-9]{4}$"
SSN = r"^\d{3}-\d{2}-\d{4}$"
CREDIT_CARD = r"^\d{4}[- ]?\d{4}[- ]?\d{4}[- ]?\d{4}$"
ALPHANUMERIC = r"^[A-Za-z0-9]{8,}$"
TOKEN_BREAK = r"[\s@_]"

# Unicode classes, and `$` only before a final "\n": the pattern dialect the
# definitions above are written in.
DIALECT = "(?dU)"

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
WORD_GAP = r"[\s\x1c-\x1f]+"


def matches(value: Column, pattern: str) -> Column:
    return value.rlike(DIALECT + pattern)


def double_to_text(value: Column) -> Column:
    """Shortest text of a double, positional for 1e-4 <= |x| < 1e16."""
    java = value.cast("string")
    size = F.abs(value)

    def plain(scale: int) -> Column:
        text = value.cast(f"decimal(38,{scale})").cast("string")
        trimmed = F.regexp_replace(text, r"0+$", "")
        return F.when(trimmed.endswith("."), F.concat(trimmed, F.lit("0"))).otherwise(trimmed)

    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1).cast("int")
    scientific = F.concat(
        mantissa,
        F.lit("e"),
        F.when(exponent < 0, F.lit("-")).otherwise(F.lit("+")),
        F.when(F.abs(exponent) < 10, F.lit("0")).otherwise(F.lit("")),
        F.abs(exponent).cast("string"),
    )
    return (
        F.when((size >= 1e7) & (size < 1e16), plain(10))
        .when((size >= 1e-4) & (size < 1e-3), plain(21))
        .when(java.contains("E"), scientific)
        .otherwise(java)
    )


def as_text(df: DataFrame, name: str) -> Column:
    """The text a value is profiled as."""
    dtype = data_type(df, name)
    if isinstance(dtype, T.StringType):
        return ref(name)
    if isinstance(dtype, T.BooleanType):
        return F.when(ref(name), F.lit("True")).when(~ref(name), F.lit("False"))
    if isinstance(dtype, FRACTIONAL):
        number = ref(name).cast("double")
        return double_to_text(F.when(~F.isnan(number), number + F.lit(0.0)))
    return ref(name).cast("string")


def parse_number(text: Column) -> Column:
    """A double where the whole text is a number, else NULL."""
    return F.when(text.rlike(NUMBER), F.trim(text).try_cast("double"))


def group_token(text: Column) -> Column:
    """A short stand-in for grouping: long texts shuffle as their SHA-256."""
    return F.when(F.octet_length(text) > 64, F.concat(F.lit("sha256:"), F.sha2(text, 256))).otherwise(text)


REDACTED = "REDACTED"


def spaced_words(text: Column) -> Column:
    """The words of a text with exactly one space between them."""
    return F.trim(F.regexp_replace(text, "(?U)" + WORD_GAP, " "))


def redact_words(words: Column, keep_ratio: float) -> Column:
    """Keep the leading share of ``spaced_words``; every other word becomes a marker.

    ``words`` is read several times: pass a column, not a long expression.
    """
    total = F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit(""))) + 1
    kept = F.greatest(F.lit(1), F.floor(total.cast("double") * F.lit(float(keep_ratio))).cast("int"))
    # The SQL function takes the number of words from a column.
    leading = F.call_function("substring_index", words, F.lit(" "), kept)
    redacted = F.concat(leading, F.repeat(F.lit(" " + REDACTED), (total - kept).cast("int")))
    return F.when(total > 1, redacted).when(words.isNotNull(), F.lit(REDACTED))
