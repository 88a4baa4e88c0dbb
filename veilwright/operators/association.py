"""Second moments of column pairs, and the association score built on them."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_number, numeric_columns
from .ranges import ColumnRange, column_ranges

# Above this many aggregate expressions the generated aggregation method grows
# past what the JVM compiles, and per-batch matrix products are faster (measured).
MAX_AGGREGATES = 24
# A variance this small relative to the mean square is rounding noise.
CONSTANT_RATIO = 1e-13

PAIR_SCHEMA = "i int, j int, n long, si double, sj double, sii double, sjj double, sij double"


def pair_sums(
    df: DataFrame,
    exprs: Mapping[str, Column],
    ranges: Mapping[str, ColumnRange] | None = None,
    max_aggregates: int = MAX_AGGREGATES,
) -> DataFrame:
    """Shifted sums of every column pair i <= j over rows where both are present.

    One scan, no row shuffle. ``ranges`` tells the shift of each column that
    keeps the sums well conditioned, and whether it has nulls; another scan finds
    them when they are not given.
    """
    names = list(exprs)
    ranges = ranges or column_ranges(df, exprs)
    shifted = df.select(*[(exprs[c] - F.lit(float(ranges[c].centre))).alias(f"x{i}") for i, c in enumerate(names)])
    nulls = [ranges[c].nulls > 0 for c in names]
    d = len(names)
    with_nulls = sum(1 for i in range(d) for j in range(i, d) if nulls[i] or nulls[j])
    if 3 * d + d * (d + 1) // 2 + 5 * with_nulls <= max_aggregates:
        return _pairs_by_expression(shifted, nulls)
    return _pairs_by_matrix(shifted, d)


def _pairs_by_expression(shifted: DataFrame, nulls: Sequence[bool]) -> DataFrame:
    d = len(nulls)
    x = [F.col(f"x{i}") for i in range(d)]
    aggs: dict[str, Column] = {}
    for i in range(d):
        aggs[f"n_{i}"] = F.count(x[i])
        aggs[f"s_{i}"] = F.sum(x[i])
        aggs[f"q_{i}"] = F.sum(x[i] * x[i])
    for i in range(d):
        for j in range(i + 1, d):
            aggs[f"p_{i}_{j}"] = F.sum(x[i] * x[j])
            if nulls[i] or nulls[j]:
                both = x[i].isNotNull() & x[j].isNotNull()
                aggs[f"n_{i}_{j}"] = F.count(F.when(both, 1))
                for k in (i, j):
                    aggs[f"s_{i}_{j}_{k}"] = F.sum(F.when(both, x[k]))
                    aggs[f"q_{i}_{j}_{k}"] = F.sum(F.when(both, x[k] * x[k]))
    sums = shifted.agg(*[expr.alias(name) for name, expr in aggs.items()])

    def entry(i: int, j: int) -> Column:
        apart = i != j and (nulls[i] or nulls[j])
        n = f"n_{i}_{j}" if apart else f"n_{i}"
        s = [f"s_{i}_{j}_{k}" if apart else f"s_{k}" for k in (i, j)]
        q = [f"q_{i}_{j}_{k}" if apart else f"q_{k}" for k in (i, j)]
        p = f"q_{i}" if i == j else f"p_{i}_{j}"
        values = [F.coalesce(F.col(c), F.lit(0.0)) for c in (*s, *q, p)]
        return F.struct(
            F.lit(i).alias("i"),
            F.lit(j).alias("j"),
            F.col(n).alias("n"),
            *[v.alias(a) for v, a in zip(values, ("si", "sj", "sii", "sjj", "sij"))],
        )

    entries = F.array(*[entry(i, j) for i in range(d) for j in range(i, d)])
    return sums.select(F.inline(entries))


def _pairs_by_matrix(shifted: DataFrame, d: int) -> DataFrame:
    upper_i, upper_j = np.triu_indices(d)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((d, d))
        s, q, p = np.zeros((d, d)), np.zeros((d, d)), np.zeros((d, d))
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            present = ~np.isnan(x)
            if present.all():
                n += len(x)
                s += x.sum(axis=0)[:, None]
                q += (x * x).sum(axis=0)[:, None]
            else:
                mask = present.astype(float)
                x = np.where(present, x, 0.0)
                n += mask.T @ mask
                s += x.T @ mask  # s[i, j]: sum of x_i where x_j is present
                q += (x * x).T @ mask
            p += x.T @ x
        a, b = upper_i, upper_j
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(a.astype(np.int32)),
                pa.array(b.astype(np.int32)),
                pa.array(np.rint(n[a, b]).astype(np.int64)),
                pa.array(s[a, b]),
                pa.array(s[b, a]),
                pa.array(q[a, b]),
                pa.array(q[b, a]),
                pa.array(p[a, b]),
            ],
            names=["i", "j", "n", "si", "sj", "sii", "sjj", "sij"],
        )

    sums = [F.sum(c).alias(c) for c in ("n", "si", "sj", "sii", "sjj", "sij")]
    return shifted.mapInArrow(partial, PAIR_SCHEMA).groupBy("i", "j").agg(*sums)


def with_correlation(pairs: DataFrame) -> DataFrame:
    """Adds Pearson's r; NULL where a side is constant or fewer than two pairs."""
    n = F.col("n").cast("double")

    def spread(sums: str, squares: str) -> Column:
        var = F.col(squares) - F.col(sums) * F.col(sums) / n
        return F.when(var > F.lit(CONSTANT_RATIO) * F.col(squares), var)

    scale = F.sqrt(spread("si", "sii")) * F.sqrt(spread("sj", "sjj"))
    cross = F.col("sij") - F.col("si") * F.col("sj") / n
    return pairs.withColumn("r", F.when(F.col("n") >= 2, F.try_divide(cross, scale)))


def correlations(df: DataFrame, columns: Sequence[str], max_aggregates: int = MAX_AGGREGATES) -> DataFrame:
    """(column_a, column_b, r) for every ordered pair of different columns."""
    names = list(columns)
    labels = F.array(*[F.lit(c) for c in names])
    pairs = with_correlation(pair_sums(df, {c: as_number(df, c) for c in names}, max_aggregates=max_aggregates)).where("i < j")
    both_ways = F.array(F.struct("i", "j", "r"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "r"))
    return pairs.select(F.inline(both_ways)).select(
        labels[F.col("i")].alias("column_a"), labels[F.col("j")].alias("column_b"), "r"
    )


def numeric_association(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column_name, association): mean |r| with the other numeric columns.

    ``avg`` skips the NULL correlations; a column without any gets 0.
    """
    if len(columns) < 2:
        rows = [(c, 0.0) for c in columns]
        return df.sparkSession.createDataFrame(rows, "column_name string, association double")
    return (
        correlations(df, columns)
        .groupBy(F.col("column_a").alias("column_name"))
        .agg(F.coalesce(F.avg(F.abs("r")), F.lit(0.0)).alias("association"))
    )


def profile_association(df: DataFrame, frequency: DataFrame) -> DataFrame:
    """Association score of every column.

    Numeric: mean absolute correlation. Other: spread of the relative value
    frequencies, which ``frequency`` (a frequency profile) already holds. Fewer
    than two values give 0.
    """
    numeric = numeric_columns(df, booleans=True)
    scored = numeric_association(df, numeric)
    return frequency.join(scored, "column_name", "left").select(
        "column_position",
        "column_name",
        F.when(F.col("non_null") < 2, F.lit(0.0))
        .when(F.col("column_name").isin(numeric), F.coalesce("association", F.lit(0.0)))
        .otherwise(F.col("frequency_spread"))
        .alias("association"),
    )
