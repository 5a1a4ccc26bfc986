"""Weights of many small books at once: Spark gathers each book's covariance (a bounded short array) and a vectorised
function solves it. No optimiser state leaves a row."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


MOST_MEMBERS = 500


def inverse_volatility(members: DataFrame, by: Sequence[str] = ("portfolio",)) -> DataFrame:
    """Weights proportional to 1 / volatility; equal weights where a member has no volatility."""
    vol = members.groupBy(*by, "symbol").agg(F.stddev_samp("ret").alias("vol"))
    whole = Window.partitionBy(*by)
    usable = F.count(F.when(F.col("vol") > 0, 1)).over(whole) == F.count(F.lit(1)).over(whole)
    raw = F.when(usable, 1 / F.nullif(F.col("vol"), F.lit(0.0))).otherwise(1.0)
    return vol.withColumn("_raw", raw).withColumn("weight", F.col("_raw") / F.sum("_raw").over(whole)).drop("_raw")


# The solvers below work on many books of one size at once: `cov` is (books, n, n) or one (n, n) matrix. A book whose
# optimality gap is still open after the last round gets NaN and so no weights, never an unfinished answer.

def _batch(cov: np.ndarray, *vectors: np.ndarray) -> tuple[np.ndarray, ...]:
    if cov.ndim == 3:
        return (cov, *vectors)
    return (cov[None], *[np.asarray(v, dtype=float)[None] for v in vectors])


def _answer(cov: np.ndarray, w: np.ndarray, solved: np.ndarray) -> np.ndarray:
    w = np.where(solved[:, None], w, np.nan)
    return w if cov.ndim == 3 else w[0]


def pair_descent(cov: np.ndarray, tilt: np.ndarray, low: float, high: float, rounds: int = 20_000) -> np.ndarray:
    """argmin w'Cw - tilt'w with sum 1 and bounds: each book moves weight between its most violating pair, an exact step a round."""
    c, tilt_ = _batch(cov, tilt)
    books, n = tilt_.shape
    row = np.arange(books)
    w = np.full((books, n), 1.0 / n)
    gradient = 2 * (c @ w[:, :, None])[:, :, 0] - tilt_
    solved = np.zeros(books, bool)
    for _ in range(rounds):
        up = np.where(w < high - 1e-15, gradient, np.inf).argmin(axis=1)
        down = np.where(w > low + 1e-15, gradient, -np.inf).argmax(axis=1)
        stuck = ~(w < high - 1e-15).any(axis=1) | ~(w > low + 1e-15).any(axis=1)
        gain = gradient[row, down] - gradient[row, up]
        solved = stuck | (gain <= 1e-14 * (1 + np.abs(gradient).max(axis=1)))
        if solved.all():
            break
        bend = 2 * (c[row, up, up] + c[row, down, down] - 2 * c[row, up, down])
        room = np.minimum(high - w[row, up], w[row, down] - low)
        step = np.where(solved, 0.0, np.where(bend > 0, np.minimum(room, gain / np.where(bend > 0, bend, 1.0)), room))
        w[row, up] += step
        w[row, down] -= step
        gradient += 2 * step[:, None] * (c[row, :, up] - c[row, :, down])
    return _answer(cov, w, solved)


def best_ratio(cov: np.ndarray, excess: np.ndarray, rounds: int = 20_000) -> np.ndarray:
    """Long-only maximum of mean excess over volatility. Up to scale it solves min y'Cy / 2 - excess'y over y >= 0; without
    any positive excess it is the single best ratio."""
    c, mean = _batch(cov, excess)
    n = mean.shape[1]
    variance = np.diagonal(c, axis1=1, axis2=2)
    y = np.zeros(mean.shape)
    solved = np.zeros(len(y), bool)
    for _ in range(rounds):
        before = y.copy()
        for i in range(n):
            y[:, i] = np.maximum(0.0, y[:, i] + (mean[:, i] - (c[:, i] * y).sum(axis=1)) / variance[:, i])
        solved = np.abs(y - before).max(axis=1) <= 1e-14 * (1 + y.max(axis=1))
        if solved.all():
            break
    vertex = np.eye(n)[(mean / np.sqrt(variance)).argmax(axis=1)]
    none = mean.max(axis=1) <= 0
    total = y.sum(axis=1, keepdims=True)
    return _answer(cov, np.where(none[:, None], vertex, y / np.where(total > 0, total, 1.0)), solved | none)


def level_contributions(cov: np.ndarray, low: float, high: float, halvings: int = 120, sweeps: int = 2_000) -> np.ndarray:
    """Equal risk contributions within bounds.

    Given a common contribution b, every weight solves w_i (Cw)_i = b, a quadratic in w_i, or sits on a bound; sweeps over
    the members settle that. The total weight rises with b, so b is found by halving an interval on a log scale."""
    (c,) = _batch(cov)
    books, n = c.shape[:2]
    variance = np.diagonal(c, axis1=1, axis2=2)
    w = np.full((books, n), 1.0 / n)
    # at the upper end all weights are at their upper bound, at the lower end all but the bound is gone
    top = np.log(np.abs(c).sum(axis=2).max(axis=1) * high * max(high, 1.0 / n) * n + 1e-300)
    bottom = top - 80.0
    settled = np.zeros(books, bool)
    for _ in range(halvings):
        middle = (bottom + top) / 2
        level = np.exp(middle)
        for _ in range(sweeps):
            before = w.copy()
            for i in range(n):
                pull = (c[:, i] * w).sum(axis=1) - variance[:, i] * w[:, i]
                w[:, i] = np.clip((np.sqrt(pull ** 2 + 4 * variance[:, i] * level) - pull) / (2 * variance[:, i]), low, high)
            settled = np.abs(w - before).max(axis=1) <= 1e-15
            if settled.all():
                break
        over = w.sum(axis=1) > 1
        top, bottom = np.where(over, middle, top), np.where(over, bottom, middle)
    return _answer(cov, w, np.abs(w.sum(axis=1) - 1) <= 1e-9)


def _usable(flat, low: float, high: float) -> bool:
    if flat is None or any(v is None for v in flat):
        return False
    side = int(round(len(flat) ** 0.5))
    return side > 0 and side * side == len(flat) and side * low <= 1 <= side * high and not np.isnan(np.asarray(flat, dtype=float)).any()


def _solved_by_size(solver, low: float, high: float, flat: pd.Series, *vectors: pd.Series) -> pd.Series:
    """solver(cov, *vectors) over all books of one size together; null for a book without a usable matrix or an answer."""
    out: list = [None] * len(flat)
    sizes: dict[int, list[int]] = {}
    for k, cells in enumerate(flat):
        if _usable(cells, low, high) and all(v.iloc[k] is not None for v in vectors):
            sizes.setdefault(int(round(len(cells) ** 0.5)), []).append(k)
    for side, places in sizes.items():
        cov = np.array([np.asarray(flat.iloc[k], dtype=float).reshape(side, side) for k in places])
        own = [np.array([np.asarray(v.iloc[k], dtype=float) for k in places]) for v in vectors]
        for k, w in zip(places, solver(cov, *own)):
            out[k] = None if np.isnan(w).any() else w
    return pd.Series(out, dtype=object)


def equal_risk_column(cov: Column, low: float, high: float) -> Column:
    @F.pandas_udf("array<double>")
    def solve(flat: pd.Series) -> pd.Series:
        return _solved_by_size(lambda c: level_contributions(c, low, high), low, high, flat)
    return solve(cov)


def minimum_variance_column(cov: Column, low: float = 0.0, high: float = 1.0) -> Column:
    @F.pandas_udf("array<double>")
    def solve(flat: pd.Series) -> pd.Series:
        return _solved_by_size(lambda c: pair_descent(c, np.zeros(c.shape[:2]), low, high), low, high, flat)
    return solve(cov)


def frontier_column(cov: Column, mu: Column, tilt: Column) -> Column:
    @F.pandas_udf("array<double>")
    def solve(flat: pd.Series, means: pd.Series, tilts: pd.Series) -> pd.Series:
        return _solved_by_size(lambda c, m, t: pair_descent(c, t[:, None] * m, 0.0, 1.0), 0.0, 1.0, flat, means, tilts)
    return solve(cov, mu, tilt)


def tangency_column(cov: Column, mu: Column, risk_free: Column) -> Column:
    @F.pandas_udf("array<double>")
    def solve(flat: pd.Series, means: pd.Series, rates: pd.Series) -> pd.Series:
        return _solved_by_size(lambda c, m, r: best_ratio(c, m - r[:, None]), 0.0, 1.0, flat, means, rates)
    return solve(cov, mu, risk_free)


def gathered(covariance: DataFrame, by: Sequence[str] = ("portfolio",)) -> DataFrame:
    """One row per book: `symbols` in order and the flat covariance matrix. A book of more than MOST_MEMBERS is an error: its
    matrix does not belong in one row."""
    sizes = covariance.groupBy(*by, "i").agg(F.count(F.lit(1)).alias("_n")).groupBy(*by).agg(F.count(F.lit(1)).alias("_members"))
    fits = F.when(F.col("_members") > MOST_MEMBERS, F.raise_error(F.lit(f"a book has more than {MOST_MEMBERS} members"))).otherwise(F.lit(True))
    small = covariance.join(sizes.where(fits.cast("boolean")).select(*by), list(by), "left_semi")
    cells = small.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("i", "j", "cov"))).alias("_cells"))
    return cells.select(*by, F.array_distinct(F.transform("_cells", lambda c: c["i"])).alias("symbols"),
                        F.transform("_cells", lambda c: c["cov"]).alias("cov"))


def spread_out(books: DataFrame, by: Sequence[str], weights: str = "weights", symbols: str = "symbols") -> DataFrame:
    """One row per member; a book without a solution falls back to equal weights."""
    equal = F.transform(F.col(symbols), lambda _: 1.0 / F.size(symbols))
    pairs = F.arrays_zip(F.col(symbols).alias("symbol"), F.coalesce(F.col(weights), equal).alias("weight"))
    return books.select(*by, F.col(weights).isNotNull().alias("solved"), F.inline(pairs))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, v: acc + v)


def quadratic(weights: Column, cov: Column) -> Column:
    """w'Cw of a flat covariance array."""
    size = F.size(weights)
    rows = F.transform(F.sequence(F.lit(0), size - 1), lambda i: F.get(weights, i) * dot(weights, F.slice(cov, i * size + 1, size)))
    return F.aggregate(rows, F.lit(0.0), lambda acc, v: acc + v)


def weight_statistics(books: DataFrame, by: Sequence[str], weights: str, cov: str = "cov", mu: str = "mu", risk_free: str = "rf") -> DataFrame:
    """Volatility, mean, Sharpe, effective number of names, largest weight and names above 1%."""
    w = F.col(weights)
    sigma, mean = F.sqrt(quadratic(w, F.col(cov))), dot(w, F.col(mu))
    return books.where(w.isNotNull()).select(
        *by, (sigma * 100).alias("volatility_pct"), (mean * 100).alias("mean_return_pct"), ((mean - F.col(risk_free)) / sigma).alias("sharpe"),
        (1 / dot(w, w)).alias("effective_names"), (F.array_max(w) * 100).alias("largest_weight_pct"),
        F.size(F.filter(w, lambda v: v > 0.01)).alias("names_above_1pct"))
