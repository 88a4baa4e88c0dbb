"""Utility and privacy metrics of an anonymized table against its original.

The tables meet in three places only: one equi-join on the row key that adds up
moments and cross-products, one grouping by (column, value) for distributions
and distinct counts, and d x d matrices on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions.columns import as_number, melt, numeric_columns, ref
from ..functions.numbers import left_closed_bin
from .association import CONSTANT_RATIO, correlations, pair_sums
from .pca import principal_axes
from .privacy import value_ranges
from .ordered import check_row_key
from .quantiles import SMALL_ROWS, exact_quantiles
from .ranges import ColumnRange, column_ranges


def common_numeric(original: DataFrame, anonymized: DataFrame, row_key: str | None = None) -> list[str]:
    """Columns numeric in both tables, in the original's order, without the key."""
    both = set(numeric_columns(anonymized))
    return [c for c in numeric_columns(original) if c in both and c != row_key]


def fill_median(df: DataFrame, columns: Sequence[str], small_rows: int = SMALL_ROWS) -> DataFrame:
    """Nulls of the numeric columns replaced by the column's exact median."""
    medians = exact_quantiles(df, {c: as_number(df, c) for c in columns}, (0.5,), small_rows)
    return df.withColumns(
        {
            c: F.coalesce(as_number(df, c), F.lit(medians[c][0])) if medians[c][0] is not None else as_number(df, c)
            for c in columns
        }
    )


@dataclass
class _Side:
    """The compared columns of one table, without nulls, and their ranges."""

    df: DataFrame
    ranges: dict[str, ColumnRange]


def _side(df: DataFrame, columns: Sequence[str], row_key: str, small_rows: int) -> _Side:
    """Medians are looked up only for the columns that have nulls."""
    plain = df.select(ref(row_key), *[as_number(df, c).alias(c) for c in columns])
    ranges = column_ranges(plain, {c: ref(c) for c in columns})
    gaps = {c: r for c, r in ranges.items() if r.nulls and r.count}
    medians = exact_quantiles(plain, {c: ref(c) for c in gaps}, (0.5,), small_rows, gaps) if gaps else {}
    filled = plain.withColumns({c: F.coalesce(ref(c), F.lit(m[0])) for c, m in medians.items()}) if gaps else plain
    complete = {c: replace(r, count=r.count + r.nulls, nulls=0) if c in gaps else r for c, r in ranges.items()}
    return _Side(filled, complete)


class Comparison:
    """One original/anonymized pair; each group of statistics is computed once, when asked for.

    Only d-vectors and d x d matrices live here. Moments cover the rows whose
    key is in both tables.
    """

    def __init__(
        self,
        original: DataFrame,
        anonymized: DataFrame,
        row_key: str,
        columns: Sequence[str] | None = None,
        small_rows: int = SMALL_ROWS,
    ):
        self.columns = list(columns or common_numeric(original, anonymized, row_key))
        if not self.columns:
            raise ValueError("the tables share no numeric columns")
        for df in (original, anonymized):
            check_row_key(df, row_key)  # a repeated key would multiply the rows of the join
        self.row_key = row_key
        self.small_rows = small_rows
        self.sides = [_side(df, self.columns, row_key, small_rows) for df in (original, anonymized)]
        self.original, self.anonymized = (s.df for s in self.sides)
        self.spark = original.sparkSession

    @cached_property
    def moments(self) -> Moments:
        return _joint_moments(self.sides[0], self.sides[1], self.columns, self.row_key)

    @cached_property
    def distribution(self) -> dict[str, Row]:
        rows = distribution_distance(self.original, self.anonymized, self.columns).collect()
        return {r["column_name"]: r for r in rows}

    @cached_property
    def quartiles(self) -> np.ndarray:
        found = exact_quantiles(
            self.original,
            {c: ref(c) for c in self.columns},
            (0.25, 0.5, 0.75),
            self.small_rows,
            self.sides[0].ranges,
        )
        return np.array([found[c] for c in self.columns], dtype=float)

    @cached_property
    def axes(self) -> Axes:
        """Principal axes of both tables after robust scaling fitted on the original."""
        spread = self.quartiles[:, 2] - self.quartiles[:, 0]
        spread = np.where(spread == 0, 1.0, spread)
        scaled = [[self.moments.block(a, b) / np.outer(spread, spread) for b in (0, 1)] for a in (0, 1)]
        values, vectors = zip(principal_axes(scaled[0][0]), principal_axes(scaled[1][1]))
        return Axes(spread, values, vectors, scaled[0][1])


@dataclass
class Moments:
    n: int
    means: np.ndarray  # 2 x d
    covariance: np.ndarray  # 2d x 2d, sample; the original's columns first
    mse: np.ndarray

    def block(self, left: int, right: int) -> np.ndarray:
        d = len(self.mse)
        return self.covariance[left * d : (left + 1) * d, right * d : (right + 1) * d]

    def variances(self, side: int) -> np.ndarray:
        return np.diag(self.block(side, side))


@dataclass
class Axes:
    spread: np.ndarray
    values: tuple[np.ndarray, np.ndarray]
    vectors: tuple[np.ndarray, np.ndarray]
    cross: np.ndarray

    def ratios(self, side: int) -> np.ndarray:
        total = self.values[side].sum()
        return self.values[side] / total if total > 0 else np.zeros_like(self.values[side])

    def score_correlation(self, i: int) -> float:
        """Correlation of the i-th component's scores, without computing any score."""
        a, b = self.vectors[0][:, i], self.vectors[1][:, i]
        size = self.values[0][i] * self.values[1][i]
        floor = 1e-24 * self.values[0][0] * self.values[1][0]
        return float(a @ self.cross @ b / np.sqrt(size)) if size > floor else 0.0


def _joint_moments(left: _Side, right: _Side, columns: Sequence[str], row_key: str) -> Moments:
    """All first and second moments of both tables in one pass over one join."""
    d = len(columns)
    ranges = {f"{p}{i}": side.ranges[c] for p, side in (("o", left), ("a", right)) for i, c in enumerate(columns)}
    tables = [
        side.df.select(ref(row_key).alias("row_key"), *[ref(c).alias(f"{p}{i}") for i, c in enumerate(columns)])
        for p, side in (("o", left), ("a", right))
    ]
    joined = tables[0].join(tables[1], "row_key")
    n = 0
    first = np.zeros(2 * d)
    second = np.zeros((2 * d, 2 * d))
    for r in pair_sums(joined, {c: F.col(c) for c in ranges}, ranges).collect():
        n = r["n"]
        first[r["i"]], first[r["j"]] = r["si"], r["sj"]
        second[r["i"], r["j"]] = second[r["j"], r["i"]] = r["sij"]
    shift = np.array([r.centre for r in ranges.values()])
    rows = max(n, 1)
    mean_of_shifted = first / rows
    scatter = second - np.outer(first, first) / rows
    noise = np.diag(scatter) <= CONSTANT_RATIO * np.diag(second)
    scatter[noise, :] = 0.0
    scatter[:, noise] = 0.0
    # E[(o - a)^2] from the shifted moments of o and a.
    gap = shift[:d] - shift[d:]
    drift = mean_of_shifted[:d] - mean_of_shifted[d:]
    squares = np.diag(second) / rows
    cross = np.diag(second[:d, d:]) / rows
    mse = np.maximum(squares[:d] + squares[d:] - 2 * cross + gap**2 + 2 * gap * drift, 0.0)
    return Moments(n, (shift + mean_of_shifted).reshape(2, d), scatter / max(n - 1, 1), mse)


# --- distributions -----------------------------------------------------------

PREFIX_SCHEMA = (
    "part int, column_name string, rows_original long, rows_anonymized long, "
    "distinct_original long, distinct_anonymized long, highest double, lowest double"
)


def _prefix_summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per column of a sorted partition: its counts, and the extremes of the running CDF difference."""
    part = TaskContext.get().partitionId()
    state: dict[str, list] = {}
    for batch in batches:
        names = batch.column("column_name").to_numpy(zero_copy_only=False)
        values = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("o", "a", "all_o", "all_a")]
        cuts = np.flatnonzero(names[1:] != names[:-1]) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(names)]):
            if lo == hi:
                continue
            o, a, all_o, all_a = (v[lo:hi] for v in values)
            s = state.setdefault(names[lo], [0, 0, 0, 0, -np.inf, np.inf])
            step = (s[0] + np.cumsum(o)) / all_o[0] - (s[1] + np.cumsum(a)) / all_a[0]
            s[0] += int(o.sum())
            s[1] += int(a.sum())
            s[2] += int((o > 0).sum())
            s[3] += int((a > 0).sum())
            s[4] = max(s[4], float(step.max()))
            s[5] = min(s[5], float(step.min()))
    rows = [[part] * len(state), list(state), *map(list, zip(*state.values()))]
    if state:
        types = [pa.int32(), pa.string(), *[pa.int64()] * 4, *[pa.float64()] * 2]
        names = [f.split()[0] for f in PREFIX_SCHEMA.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows, types)], names=names)


def distribution_distance(original: DataFrame, anonymized: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Two-sample KS statistic and distinct counts per column.

    Values are counted once per (column, value). The distinct values are then
    range-sorted; every partition is summed up in one row per column, and those
    rows are added up in order, so no task sees more than its own range.
    """
    sides = [
        melt(table, {c: as_number(table, c) for c in columns}).where(F.col("value").isNotNull()).select(
            "column_name", "value", F.lit(o).alias("o"), F.lit(1 - o).alias("a")
        )
        for table, o in ((original, 1), (anonymized, 0))
    ]
    counts = sides[0].unionByName(sides[1]).groupBy("column_name", "value").agg(F.sum("o").alias("o"), F.sum("a").alias("a"))
    totals = counts.groupBy("column_name").agg(F.sum("o").alias("all_o"), F.sum("a").alias("all_a"))
    ordered = (
        counts.join(F.broadcast(totals), "column_name")  # one row per column
        .where((F.col("all_o") > 0) & (F.col("all_a") > 0))
        .repartitionByRange("column_name", "value")
        .sortWithinPartitions("column_name", "value")
        .select("column_name", "o", "a", "all_o", "all_a")
    )
    parts = ordered.mapInArrow(_prefix_summaries, PREFIX_SCHEMA)
    before = Window.partitionBy("column_name").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("rows_original").over(before), F.lit(0)) / F.col("all_o") - F.coalesce(
        F.sum("rows_anonymized").over(before), F.lit(0)
    ) / F.col("all_a")
    whole = Window.partitionBy("column_name")
    return (
        parts.withColumn("all_o", F.sum("rows_original").over(whole))
        .withColumn("all_a", F.sum("rows_anonymized").over(whole))
        .withColumn("offset", offset)
        .groupBy("column_name")
        .agg(
            F.max(
                F.greatest(F.abs(F.col("offset") + F.col("highest")), F.abs(F.col("offset") + F.col("lowest")))
            ).alias("ks_statistic"),
            *[
                F.sum(c).alias(c)
                for c in ("rows_original", "rows_anonymized", "distinct_original", "distinct_anonymized")
            ],
        )
    )


def ks_statistic(original: DataFrame, anonymized: DataFrame, columns: Sequence[str]) -> DataFrame:
    return distribution_distance(original, anonymized, columns).select("column_name", "ks_statistic")


# --- metrics -----------------------------------------------------------------


def safe_correlation(x: np.ndarray, y: np.ndarray) -> float:
    """Pearson's r over the finite pairs; 0 with fewer than two or a constant side."""
    x, y = np.asarray(x, float).ravel(), np.asarray(y, float).ravel()
    usable = np.isfinite(x) & np.isfinite(y)
    x, y = x[usable], y[usable]
    if len(x) < 2 or x.std() == 0 or y.std() == 0:
        return 0.0
    return float(np.clip(np.mean((x - x.mean()) / x.std() * ((y - y.mean()) / y.std())), -1.0, 1.0))


def _correlation_matrix(covariance: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.diag(covariance))
    scale = np.where(scale > 0, scale, np.nan)
    return covariance / np.outer(scale, scale)


def normalized_errors(comparison: Comparison) -> np.ndarray:
    """Mean squared error over the original's sample variance (raw if that is 0)."""
    variance = comparison.moments.variances(0)
    return comparison.moments.mse / np.where(variance > 0, variance, 1.0)


def statistical_values(comparison: Comparison) -> dict[str, float]:
    m = comparison.moments
    apart = ~np.eye(len(comparison.columns), dtype=bool)
    matrices = [_correlation_matrix(m.block(s, s))[apart] for s in (0, 1)]
    errors = normalized_errors(comparison)
    ks = [comparison.distribution[c]["ks_statistic"] if c in comparison.distribution else 1.0 for c in comparison.columns]
    return {
        "mean_correlation": safe_correlation(m.means[0], m.means[1]),
        "std_correlation": safe_correlation(np.sqrt(m.variances(0)), np.sqrt(m.variances(1))),
        "correlation_preservation": safe_correlation(*matrices),
        "mean_mse": float(errors.mean()),
        "max_mse": float(errors.max()),
        "mean_ks_statistic": float(np.mean(ks)),
    }


def privacy_values(comparison: Comparison) -> dict[str, float]:
    found = [comparison.distribution[c] for c in comparison.columns if c in comparison.distribution]
    before = np.mean([r["distinct_original"] / r["rows_original"] for r in found]) if found else 0.0
    after = np.mean([r["distinct_anonymized"] / r["rows_anonymized"] for r in found]) if found else 0.0
    totals = [comparison.moments.variances(s).sum() for s in (0, 1)]
    return {
        "uniqueness_reduction": float(np.clip(1 - after / before, 0, 1)) if before > 0 else 0.0,
        "variance_preservation": float(np.clip(totals[1] / totals[0], 0, 2)) if totals[0] > 0 else 1.0,
    }


COMPARED_COMPONENTS = 5  # fixed value
RETENTION_AT = (2, 5, 10)  # fixed values


def pca_values(comparison: Comparison) -> dict[str, list[float]]:
    axes = comparison.axes
    shown = min(COMPARED_COMPONENTS, len(comparison.columns))
    return {
        "original_explained_variance": axes.ratios(0).tolist(),
        "anonymized_explained_variance": axes.ratios(1).tolist(),
        "original_variance": np.cumsum(axes.ratios(0)).tolist(),
        "anonymized_variance": np.cumsum(axes.ratios(1)).tolist(),
        "component_correlation": [axes.score_correlation(i) for i in range(shown)],
    }


def _one_row(comparison: Comparison, values: dict[str, float]) -> DataFrame:
    schema = ", ".join(f"{name} double" for name in values)
    return comparison.spark.createDataFrame([tuple(values.values())], schema)


def quality_stats(comparison: Comparison) -> DataFrame:
    return _one_row(comparison, statistical_values(comparison))


def privacy_metrics(comparison: Comparison) -> DataFrame:
    return _one_row(comparison, privacy_values(comparison))


def pca_metrics(comparison: Comparison) -> DataFrame:
    """One row per component: variance ratios, their running sums, score correlation."""
    v = pca_values(comparison)
    correlation = v["component_correlation"] + [None] * len(comparison.columns)
    rows = [
        (
            i + 1,
            v["original_explained_variance"][i],
            v["anonymized_explained_variance"][i],
            v["original_variance"][i],
            v["anonymized_variance"][i],
            correlation[i],
        )
        for i in range(len(comparison.columns))
    ]
    return comparison.spark.createDataFrame(
        rows,
        "component int, original_ratio double, anonymized_ratio double, "
        "original_cumulative double, anonymized_cumulative double, component_correlation double",
    )


def variance_retention(comparison: Comparison) -> DataFrame:
    """Cumulative variance at 2, 5 and 10 components, in percent, and what is retained of it."""
    return pca_metrics(comparison).where(F.col("component").isin(list(RETENTION_AT))).select(
        "component",
        (F.col("original_cumulative") * 100).alias("original_percent"),
        (F.col("anonymized_cumulative") * 100).alias("anonymized_percent"),
        F.when(F.col("original_cumulative") > 0, F.col("anonymized_cumulative") / F.col("original_cumulative") * 100)
        .otherwise(F.lit(0.0))
        .alias("retention_percent"),
    )


def nmse_by_column(comparison: Comparison) -> DataFrame:
    rows = list(zip(range(len(comparison.columns)), comparison.columns, normalized_errors(comparison).tolist()))
    return comparison.spark.createDataFrame(rows, "column_position int, column_name string, normalized_mse double")


def all_metrics(comparison: Comparison) -> DataFrame:
    """The one-row table the scores are computed from."""
    correlation = pca_values(comparison)["component_correlation"]
    return _one_row(
        comparison,
        {
            **statistical_values(comparison),
            **privacy_values(comparison),
            "mean_component_correlation": float(np.mean(correlation)),
        },
    )


# Labels, and the lowest utility and privacy score of each.
VERDICTS = (
    ("EXCELLENT - Strong privacy with high utility", 80, 70),
    ("GOOD - Balanced privacy-utility tradeoff", 70, 60),
    ("FAIR - Acceptable with room for improvement", 50, 50),
    ("POOR - Significant utility loss or weak privacy", 30, None),
)
LOWEST_VERDICT = "VERY POOR - Consider re-evaluating anonymization approach"


def _clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def quality_scores(metrics: DataFrame) -> DataFrame:
    """Adds utility and privacy scores (0-100) and the overall assessment."""
    quarter = F.lit(25.0)
    utility = (
        F.greatest(F.lit(0.0), F.col("mean_component_correlation") * quarter)
        + F.greatest(F.lit(0.0), F.col("correlation_preservation") * quarter)
        + F.greatest(F.lit(0.0), (F.lit(1.0) - F.col("mean_ks_statistic")) * quarter)
        + F.least(quarter, F.col("variance_preservation") * F.lit(12.5))
    )
    privacy = F.col("uniqueness_reduction") * 50.0 + (F.lit(1.0) - F.abs("correlation_preservation")) * 50.0
    with_scores = metrics.withColumn("utility_score", _clamp(utility, 0, 100)).withColumn(
        "privacy_score", _clamp(privacy, 0, 100)
    )
    assessment = F.lit(LOWEST_VERDICT)
    for label, least_utility, least_privacy in reversed(VERDICTS):
        reached = F.col("utility_score") >= least_utility
        if least_privacy is not None:
            reached = reached & (F.col("privacy_score") >= least_privacy)
        assessment = F.when(reached, F.lit(label)).otherwise(assessment)
    return with_scores.withColumn("assessment", assessment)


def quality_verdict(metrics: DataFrame) -> DataFrame:
    """Adds the coarser dashboard verdict."""
    preserved = F.col("correlation_preservation")
    return metrics.withColumn(
        "verdict",
        F.when((preserved > 0.8) & (F.col("uniqueness_reduction") > 0.3), "EXCELLENT")
        .when(preserved > 0.6, "GOOD")
        .otherwise("FAIR"),
    )


# --- chart data ----------------------------------------------------------------

HISTOGRAM_BINS = 20  # fixed value


def histogram_20(df: DataFrame, columns: Sequence[str], bins: int = HISTOGRAM_BINS) -> DataFrame:
    """Density per equal-width bin over each column's own range; every bin is listed."""
    ranges = value_ranges(df, columns)
    spans, indices = {}, {}
    for name in columns:
        r = ranges[name]
        if r.count:
            low, high = (r.low, r.high) if r.low != r.high else (r.low - 0.5, r.high + 0.5)
            spans[name] = (low, high, r.count)
            indices[name] = left_closed_bin(as_number(df, name), low, high, bins)
    counted = melt(df, indices, variable="column_name", value="bin").where("bin is not null").groupBy(
        "column_name", "bin"
    ).agg(F.count(F.lit(1)).alias("rows_in_bin"))
    grid = [
        (name, b, low + b * (high - low) / bins, high if b == bins - 1 else low + (b + 1) * (high - low) / bins, n)
        for name, (low, high, n) in spans.items()
        for b in range(bins)
    ]
    edges = df.sparkSession.createDataFrame(
        grid, "column_name string, bin long, lower_edge double, upper_edge double, n long"
    )
    rows = F.coalesce(F.col("rows_in_bin"), F.lit(0))
    return edges.join(counted, ["column_name", "bin"], "left").select(
        "column_name",
        "bin",
        "lower_edge",
        "upper_edge",
        rows.alias("rows_in_bin"),
        (rows / (F.col("n") * (F.col("upper_edge") - F.col("lower_edge")))).alias("density"),
    )


def corr_diff(original: DataFrame, anonymized: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Absolute difference of the two correlation matrices, long form, without the diagonal."""
    before = correlations(original, columns).withColumnRenamed("r", "r_original")
    after = correlations(anonymized, columns).withColumnRenamed("r", "r_anonymized")
    return before.join(after, ["column_a", "column_b"]).select(
        "column_a", "column_b", F.abs(F.col("r_original") - F.col("r_anonymized")).alias("difference")
    )


SAMPLE_POINTS = 1000  # fixed value


def pc_sample(comparison: Comparison, points: int = SAMPLE_POINTS, secret: str = "sample") -> DataFrame:
    """First two component scores of the same random rows in both tables.

    The rows with the lowest keyed hashes are chosen from the key column alone;
    only they are looked up in the tables.
    """
    key = ref(comparison.row_key)
    order = F.sha2(F.concat(F.lit(f"{secret}|"), key.cast("string")), 256)
    chosen = (
        comparison.original.select(key.alias("row_key"), order.alias("draw")).orderBy("draw", "row_key").limit(points)
    ).select("row_key")
    axes = comparison.axes
    sides = []
    for s, (label, table) in enumerate((("original", comparison.original), ("anonymized", comparison.anonymized))):
        # Both tables are scaled with the original's median and spread, then
        # centred on their own mean: the median cancels out.
        centre = comparison.moments.means[s]
        scaled = [
            (ref(c) - F.lit(float(centre[j]))) / F.lit(float(axes.spread[j])) for j, c in enumerate(comparison.columns)
        ]
        scores = [
            sum((x * F.lit(float(axes.vectors[s][j, k])) for j, x in enumerate(scaled)), F.lit(0.0)).alias(
                f"{label}_pc{k + 1}"
            )
            for k in range(min(2, len(comparison.columns)))
        ]
        sides.append(
            table.withColumnRenamed(comparison.row_key, "row_key")
            .join(F.broadcast(chosen), "row_key", "left_semi")  # at most `points` rows
            .select("row_key", *scores)
        )
    return sides[0].join(sides[1], "row_key")
