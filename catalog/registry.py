"""Registered queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, because float sums depend on the order of partitions."""
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`"), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, T.DoubleType)
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


# --- SQL building blocks -------------------------------------------------------


def r(expr: str, digits: int = DIGITS) -> str:
    """The SQL counterpart of ``rounded``."""
    return f"round(CAST({expr} AS DOUBLE), {digits}) + 0"


def long_sql(table_name: str, columns: Iterable[str], cast: str = "VARCHAR", ids: str = "") -> str:
    """UNION ALL of (column_name, v)."""
    prefix = f"{ids}, " if ids else ""
    return " UNION ALL ".join(
        f"SELECT {prefix}'{c}' AS column_name, CAST({c} AS {cast}) AS v FROM {table_name}" for c in columns
    )


def uniform_sql(secret: str, purpose: str, key: str) -> str:
    digest = f"sha256('{secret}|{purpose}|' || CAST({key} AS VARCHAR))"
    return f"((('0x' || substr({digest}, 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def laplace_sql(secret: str, purpose: str, key: str, scale: float) -> str:
    u = f"({uniform_sql(secret, purpose, key)} - 0.5::DOUBLE)"
    return f"((-{scale})::DOUBLE * sign({u}) * ln(1::DOUBLE - 2::DOUBLE * abs({u})))"


def words_sql(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '[\\s\\p{{Z}}\\x{{85}}\\x{{1c}}-\\x{{1f}}]+'), lambda w: w <> '')"


def redact_sql(text: str, ratio: float) -> str:
    w = words_sql(text)
    kept = f"greatest(1, CAST(floor(len({w})::DOUBLE * {ratio}::DOUBLE) AS INTEGER))"
    return (
        f"CASE WHEN {text} IS NULL THEN NULL WHEN len({w}) <= 1 THEN 'REDACTED' ELSE "
        f"array_to_string(list_concat({w}[1:{kept}], "
        f"list_transform(range(len({w}) - {kept}), lambda i: 'REDACTED')), ' ') END"
    )


def right_bin_sql(rows: str) -> str:
    """Adds ``i``, the 1-based bin of x in (e[i-1], e[i]], to rows with x, lo, hi and b.

    A first guess is compared with the exact edges around it.
    """
    guess = "least(greatest(CAST(ceil((x - lo) / ((hi - lo) / b)) AS BIGINT), 1), b)"
    return (
        "SELECT *, CASE WHEN g > 1 AND x <= e0 THEN g - 1 WHEN g < b AND x > e1 THEN g + 1 ELSE g END AS i "
        f"FROM (SELECT *, {edge_sql('(g - 1)')} AS e0, {edge_sql('g')} AS e1 "
        f"FROM (SELECT *, {guess} AS g FROM ({rows})))"
    )


def edge_sql(i: str) -> str:
    return f"(CASE WHEN {i} >= b THEN hi ELSE {i}::DOUBLE * ((hi - lo) / b) + lo END)"


INTERVAL_LABEL = f"printf('%.1f', {edge_sql('(i - 1)')}) || '-' || printf('%.1f', {edge_sql('i')})"
