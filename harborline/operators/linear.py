"""A linear model from sufficient statistics: one aggregate over the rows, however many they are."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Features one model takes: means and covariances of that many are aggregated and solved on the driver.
MOST_FEATURES = 64


@dataclass(frozen=True)
class LinearModel:
    features: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float
    rows: int

    def predict(self) -> Column:
        """The prediction of a row; null where a feature is null."""
        out = F.lit(self.intercept)
        for c, w in zip(self.features, self.weights):
            out = out + F.col(c).cast("double") * F.lit(w)
        return out


def _known(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows whose columns are all finite numbers."""
    for c in columns:
        v = F.col(c).cast("double")
        df = df.filter(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return df


def fit_linear(df: DataFrame, features: Sequence[str], target: str, penalty: float = 0.0) -> LinearModel:
    """Least squares with `penalty` on the squared weights, from means and covariances that every task aggregates and merges.

    Rows with a null or non-finite value take no part. Features without variance, or that others explain wholly, share
    the least weights that fit. Without rows all weights are 0.
    """
    names = list(features)
    if not 0 < len(names) <= MOST_FEATURES:
        raise ValueError(f"a linear model takes 1 to {MOST_FEATURES} features")
    x = [F.col(c).cast("double") for c in [*names, target]]
    pairs = [(i, j) for i in range(len(x)) for j in range(i, len(x))]
    row = _known(df, [*names, target]).agg(F.count(F.lit(1)), *[F.avg(c) for c in x], *[F.covar_pop(x[i], x[j]) for i, j in pairs]).first()
    n, means = row[0], [m or 0.0 for m in row[1 : 1 + len(x)]]
    both = np.zeros((len(x), len(x)))
    for (i, j), v in zip(pairs, row[1 + len(x) :]):
        both[i, j] = both[j, i] = v or 0.0
    gram, toward = both[:-1, :-1], both[:-1, -1]
    scale = np.sqrt(np.diag(gram))
    scale[scale == 0] = 1.0
    # Features of very different size are brought to one size before the system is solved.
    system = gram / np.outer(scale, scale) + np.diag(penalty / max(n, 1) / scale**2)
    weights = np.linalg.lstsq(system, toward / scale, rcond=None)[0] / scale
    return LinearModel(tuple(names), tuple(float(w) for w in weights), float(means[-1] - weights @ np.array(means[:-1])), n)


def linear_report(df: DataFrame, model: LinearModel, target: str) -> DataFrame:
    """One row: rows scored, r2, mean absolute and root mean squared error of the model on rows with known values."""
    y = F.col(target).cast("double")
    known = _known(df, [*model.features, target]).select(y.alias("y"), model.predict().alias("p"))
    off = F.col("y") - F.col("p")
    return known.agg(
        F.count(F.lit(1)).alias("rows"), (1 - F.sum(off * off) / (F.var_pop("y") * F.count("y"))).alias("r2"), F.avg(F.abs(off)).alias("mae"), F.sqrt(F.avg(off * off)).alias("rmse")
    )
