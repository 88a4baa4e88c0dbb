"""PCA reconstruction with Laplace noise on the component scores.

Spark aggregates means and cross-products; only the d x d correlation matrix is
decomposed on the driver. Transform, noise and inverse are linear, so each output
column is one expression over the standardized inputs and the noise draws.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_number, data_type, is_numeric, ref
from ..functions.numbers import keyed_uniform, laplace
from .association import pair_sums
from .ranges import column_ranges

PCA_SENSITIVITY = 2.0  # fixed value
MAX_EXPRESSION_COLUMNS = 8  # beyond, a matrix product per batch is faster (measured)


@dataclass
class PcaModel:
    columns: list[str]
    means: np.ndarray
    scales: np.ndarray
    components: np.ndarray  # one column per kept component
    explained: np.ndarray  # variance ratio of every component

    @property
    def kept(self) -> int:
        return self.components.shape[1]


def oriented(vectors: np.ndarray) -> np.ndarray:
    """Eigenvectors (as columns) with their largest entry positive.

    Entries within rounding of the largest count as equal; the first one decides.
    """
    size = np.abs(vectors)
    top = np.argmax(size >= size.max(axis=0) * (1 - 1e-9), axis=0)
    signs = np.sign(vectors[top, np.arange(vectors.shape[1])])
    return vectors * np.where(signs == 0, 1.0, signs)


def principal_axes(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in descending order with their oriented eigenvectors."""
    values, vectors = np.linalg.eigh(matrix)
    order = np.argsort(values)[::-1]
    return np.maximum(values[order], 0.0), oriented(vectors[:, order])


def kept_components(ratios: np.ndarray, threshold: float) -> int:
    """The fewest components whose cumulative ratio exceeds the threshold."""
    if threshold >= 1.0:
        return len(ratios)
    return min(len(ratios), int(np.searchsorted(np.cumsum(ratios), threshold, side="right")) + 1)


def fit_pca(df: DataFrame, columns: Sequence[str], threshold: float = 0.85) -> PcaModel | None:
    """PCA of the standardized columns, nulls filled with the mean.

    Constant columns are left out; fewer than two remaining columns give None.
    """
    numeric = [c for c in columns if c in df.columns and is_numeric(data_type(df, c))]
    if len(numeric) < 2:
        return None
    ranges = column_ranges(df, {c: as_number(df, c) for c in numeric})
    varying = [c for c in numeric if ranges[c].varies]
    if len(varying) < 2:
        return None
    means = np.array([ranges[c].mean for c in varying])
    filled = {c: F.coalesce(as_number(df, c), F.lit(float(m))) for c, m in zip(varying, means)}
    # Filling with the mean keeps the mean, so the same ranges serve as shifts.
    complete = {c: replace(ranges[c], nulls=0) for c in varying}
    d = len(varying)
    covariance = np.zeros((d, d))
    for r in pair_sums(df, filled, complete).collect():
        cov = r["sij"] / r["n"] - (r["si"] / r["n"]) * (r["sj"] / r["n"])
        covariance[r["i"], r["j"]] = covariance[r["j"], r["i"]] = cov
    scales = np.sqrt(np.diag(covariance))
    values, vectors = principal_axes(covariance / np.outer(scales, scales))
    ratios = values / values.sum()
    return PcaModel(varying, means, scales, vectors[:, : kept_components(ratios, threshold)], ratios)


def reconstruct(
    df: DataFrame,
    model: PcaModel,
    row_key: str,
    secret: str,
    epsilon: float = 1.0,
    max_expression_columns: int = MAX_EXPRESSION_COLUMNS,
) -> DataFrame:
    """Replace the model's columns by ``abs`` of their noisy reconstruction."""
    scale = PCA_SENSITIVITY / epsilon
    d = len(model.columns)
    z = {
        f"pca_z_{i}": F.coalesce(
            (as_number(df, c) - F.lit(float(model.means[i]))) / F.lit(float(model.scales[i])), F.lit(0.0)
        )
        for i, c in enumerate(model.columns)
    }
    noise = {
        f"pca_noise_{c}": laplace(keyed_uniform(secret, f"pca:{c}", ref(row_key)), scale) for c in range(model.kept)
    }
    if scale == 0:
        noise = {name: F.lit(0.0) for name in noise}
    wide = df.withColumns({**z, **noise})
    projection = model.components @ model.components.T
    if d <= max_expression_columns:
        values = {}
        for j, c in enumerate(model.columns):
            terms = [F.col(f"pca_z_{i}") * F.lit(float(projection[j, i])) for i in range(d)]
            terms += [F.col(f"pca_noise_{k}") * F.lit(float(model.components[j, k])) for k in range(model.kept)]
            total = _sum(terms)
            values[c] = F.abs(total * F.lit(float(model.scales[j])) + F.lit(float(model.means[j])))
        return wide.withColumns(values).drop(*z, *noise)

    inputs = [*z, *noise]
    weights = np.vstack([projection, model.components.T])  # inputs x columns
    scales, means = model.scales, model.means
    schema = ", ".join(f"c{j} double" for j in range(d))

    @F.pandas_udf(schema)
    def rebuild(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = np.abs(batch.to_numpy() @ weights * scales + means)
            yield pd.DataFrame(out, columns=[f"c{j}" for j in range(d)])

    rebuilt = wide.withColumn("pca_out", rebuild(F.struct(*inputs)))
    return rebuilt.withColumns({c: F.col(f"pca_out.c{j}") for j, c in enumerate(model.columns)}).drop(
        *inputs, "pca_out"
    )


def _sum(terms: Sequence[Column]) -> Column:
    total = terms[0]
    for term in terms[1:]:
        total = total + term
    return total


def pca_anonymize(
    df: DataFrame, columns: Sequence[str], row_key: str, secret: str, epsilon: float = 1.0, threshold: float = 0.85
) -> DataFrame:
    """Fit and reconstruct; unchanged when fewer than two varying numeric columns."""
    model = fit_pca(df, columns, threshold)
    return df if model is None else reconstruct(df, model, row_key, secret, epsilon)
