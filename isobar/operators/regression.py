"""Least squares with one categorical factor and cluster-robust errors.

All that a fit needs are sums of products per (cluster, factor level). One grouped
aggregate over the facts makes that table; coefficients, residual sums and the
cluster scores are arithmetic on it, and the driver only solves a k x k system.
A factor with many levels is absorbed: sums are centred within levels, still on that table,
and its levels never reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, functions as F

from isobar.functions.tails import normal_two_sided
from isobar.operators.moments import gram
from isobar.operators.ordered import present

_Z95 = 1.959963984540054
#: A factor with more levels is absorbed, so that its levels are no terms of the model.
LISTED_LEVELS = 1000


@dataclass(frozen=True)
class Fit:
    """A fitted model; all arrays have one entry per term.

    An absorbed factor has no terms and there is no intercept; ``effects`` then holds
    (factor, effect), one row per level.
    """

    outcome: str
    x: tuple[str, ...]
    factor: str | None
    levels: tuple
    terms: tuple[str, ...]
    coef: np.ndarray
    covariance: np.ndarray
    n: int
    clusters: int
    r_squared: float
    adj_r_squared: float
    effects: DataFrame | None = None

    def rows(self) -> list[tuple]:
        out = []
        for i, term in enumerate(self.terms):
            b, se = float(self.coef[i]), float(np.sqrt(max(self.covariance[i, i], 0.0)))
            p = normal_two_sided(b / se) if se > 0 else None
            out.append((term, b, se, p, b - _Z95 * se, b + _Z95 * se))
        return out

    def table(self, spark: SparkSession) -> DataFrame:
        """term, coef, std_err, p_value, ci_low, ci_high: one row per term."""
        schema = "term string, coef double, std_err double, p_value double, ci_low double, ci_high double"
        return spark.createDataFrame(self.rows(), schema).coalesce(1)

    def predict(self, df: DataFrame, name: str = "fitted") -> DataFrame:
        """Append the fitted value; null where an absorbed factor has a new level or none."""
        by_term = dict(zip(self.terms, map(float, self.coef)))
        if self.effects is not None:
            # Renamed, so that no column of df clashes in the join.
            effects = self.effects.toDF("__level", "__effect")
            out = F.col("__effect")
            for c in self.x:
                out = out + F.lit(by_term[c]) * F.col(c)
            joined = df.join(effects, F.col(self.factor) == F.col("__level"), "left")
            return joined.withColumn(name, out).drop("__level", "__effect")
        out = F.lit(by_term["Intercept"])
        for c in self.x:
            out = out + F.lit(by_term[c]) * F.col(c)
        for level in self.levels[1:]:
            out = out + F.when(F.col(self.factor) == F.lit(level), by_term[_level(self.factor, level)]).otherwise(0.0)
        return df.withColumn(name, out)


def _level(factor: str, level) -> str:
    return f"C({factor})[T.{level}]"


@dataclass(frozen=True)
class Cells:
    """Sums of products per (cluster, factor level) of ``cols`` about ``origin``.

    One scan of the facts makes this table; any model on a subset of its columns,
    with or without the factor, is arithmetic on it.
    """

    df: DataFrame
    x: tuple[str, ...]
    y: str
    origin: tuple[float, ...]
    cluster: str
    factor: str | None


def _q(i: int, j: int) -> str:
    return f"q{min(i, j)}_{max(i, j)}"


def build_cells(
    df: DataFrame, y: str, x: Sequence[str], cluster: str, factor: str | None = None, weight: str | None = None
) -> Cells:
    """Fold complete rows into sums per cluster and factor level.

    ``weight`` counts how many observations a row stands for. Values are taken
    relative to the columns' means, which keeps the products well scaled (a year near
    2000 squared would not be) whatever the order of rows.
    """
    cols = [*x, y]
    k = len(cols)
    keys = [cluster] + ([factor] if factor else [])
    rows = present(df, [*cols, *keys]).select(
        *keys,
        *[F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate(cols)],
        (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"),
    )
    one = rows.agg(*[F.avg(f"v{i}") for i in range(k)]).first()
    if one[0] is None:
        raise ValueError("no complete rows to fit")
    origin = tuple(float(v) for v in one)
    w = F.col("w")
    d = [F.col(f"v{i}") - F.lit(o) for i, o in enumerate(origin)]
    sums = [F.sum(w).alias("n"), *[F.sum(w * d[i]).alias(f"s{i}") for i in range(k)]]
    sums += [F.sum(w * d[i] * d[j]).alias(_q(i, j)) for i in range(k) for j in range(i, k)]
    return Cells(rows.groupBy(*keys).agg(*sums), tuple(x), y, origin, cluster, factor)


def fit_clustered(
    df: DataFrame,
    y: str,
    x: Sequence[str],
    cluster: str,
    factor: str | None = None,
    weight: str | None = None,
) -> Fit:
    """OLS of ``y`` on ``x`` (and treatment-coded ``factor``), errors clustered."""
    return fit_nested(df, y, {"m": (tuple(x), factor)}, cluster, weight)["m"]


def fit_nested(
    df: DataFrame,
    y: str,
    specs: dict[str, tuple[Sequence[str], str | None]],
    cluster: str,
    weight: str | None = None,
) -> dict[str, Fit]:
    """Several models, each (regressors, factor or None), from one scan.

    All are fitted on the rows that are complete for every listed column, so their
    R-squared values compare like with like.
    """
    x = list(dict.fromkeys(c for regressors, _ in specs.values() for c in regressors))
    factors = {f for _, f in specs.values() if f}
    if len(factors) > 1:
        raise ValueError("models fitted together share one factor")
    cells = build_cells(df, y, x, cluster, next(iter(factors), None), weight)
    kept = cells.df.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return {label: _solve(cells, kept, tuple(xs), f) for label, (xs, f) in specs.items()}
    finally:
        kept.unpersist()


def _solve(cells: Cells, kept: DataFrame, x: tuple[str, ...], factor: str | None) -> Fit:
    nx = len(x)
    at_col = [cells.x.index(c) for c in x] + [len(cells.x)]
    k = nx + 1
    names = ["n", *[f"s{i}" for i in at_col], *{_q(i, j) for i in at_col for j in at_col}]
    grouped = kept.groupBy(factor) if factor else kept.groupBy()
    by_level = grouped.agg(*[F.sum(c).alias(c) for c in names])
    blocks = by_level.limit(LISTED_LEVELS + 1).collect()
    if len(blocks) > LISTED_LEVELS:
        return _absorb(cells, kept, x, factor)
    blocks = sorted(blocks, key=lambda r: r[0])
    levels = tuple(r[0] for r in blocks) if factor else ()
    dummies = levels[1:]
    p = 1 + len(dummies) + nx
    first_x = 1 + len(dummies)
    xtx, xty, yty, total, sum_y = np.zeros((p, p)), np.zeros(p), 0.0, 0.0, 0.0
    for at, r in enumerate(blocks):
        on = [0] + ([at] if factor and at > 0 else [])
        s = np.array([r[f"s{i}"] for i in at_col])
        q = np.array([[r[_q(i, j)] for j in at_col] for i in at_col])
        for a in on:
            for b in on:
                xtx[a, b] += r["n"]
            xtx[a, first_x:] += s[:nx]
            xtx[first_x:, a] += s[:nx]
            xty[a] += s[nx]
        xtx[first_x:, first_x:] += q[:nx, :nx]
        xty[first_x:] += q[:nx, nx]
        yty += q[nx, nx]
        total += r["n"]
        sum_y += s[nx]
    bread = np.linalg.inv(xtx)
    beta = bread @ xty
    rss = float(yty - 2 * beta @ xty + beta @ xtx @ beta)
    tss = float(yty - sum_y * sum_y / total)

    scores = _cluster_scores(kept, cells.cluster, factor, levels, beta, at_col)
    terms = [f"e{i}" for i in range(p)]
    # The cluster count rides along as the product of a column of ones.
    products = gram(scores.withColumn("one", F.lit(1.0)), [*terms, "one"])
    clusters, meat = int(round(products[p, p])), products[:p, :p]
    scale = clusters / max(clusters - 1, 1) * (total - 1) / (total - p)
    cov = scale * bread @ meat @ bread

    # Undo the shift of origin: only the intercept moves.
    shift = np.array([cells.origin[i] for i in at_col])
    back = np.eye(p)
    back[0, first_x:] = -shift[:nx]
    coef = back @ beta
    coef[0] += shift[nx]
    r2 = 1.0 - rss / tss if tss > 0 else float("nan")
    return Fit(
        outcome=cells.y,
        x=x,
        factor=factor,
        levels=levels,
        terms=("Intercept", *[_level(factor, v) for v in dummies], *x),
        coef=coef,
        covariance=back @ cov @ back.T,
        n=int(round(total)),
        clusters=clusters,
        r_squared=r2,
        adj_r_squared=1.0 - (1.0 - r2) * (total - 1) / (total - p),
    )


def _absorb(cells: Cells, kept: DataFrame, x: tuple[str, ...], factor: str) -> Fit:
    """The same model with the factor's levels eliminated instead of listed.

    Slopes and their clustered errors equal those of the model with a dummy per level: each
    column is centred within its level. Only sums over all levels come to the driver.
    """
    at_col = [cells.x.index(c) for c in x] + [len(cells.x)]
    pairs = sorted({(min(i, j), max(i, j)) for i in at_col for j in at_col})
    y = at_col[-1]
    levels = kept.groupBy(factor).agg(
        *[F.sum(c).alias(c) for c in ("n", *[f"s{i}" for i in at_col], *[_q(*ij) for ij in pairs])]
    )
    within = [F.sum(F.col(_q(i, j)) - F.col(f"s{i}") * F.col(f"s{j}") / F.col("n")).alias(_q(i, j)) for i, j in pairs]
    whole = [F.sum(c).alias(f"all_{c}") for c in ("n", f"s{y}", _q(y, y))]
    r = levels.agg(*within, *whole, F.count("*").alias("levels"), *[F.sum(_q(i, i)).alias(f"raw{i}") for i in at_col]).first()
    w = np.array([[r[_q(i, j)] for j in at_col] for i in at_col])
    for c, i, left in zip(x, at_col, np.diag(w)):
        if left <= 1e-10 * r[f"raw{i}"]:
            raise ValueError(f"{c} does not vary within the levels of {factor}")
    bread = np.linalg.inv(w[:-1, :-1])
    beta = bread @ w[:-1, -1]
    rss = float(w[-1, -1] - beta @ w[:-1, -1])
    total = r["all_n"]
    tss = float(r[f"all_q{y}_{y}"] - r[f"all_s{y}"] ** 2 / total)

    # Products of a cell about the means of its level, then of the residual with each column.
    means = levels.select(F.col(factor).alias("__level"), *[(F.col(f"s{i}") / F.col("n")).alias(f"m{i}") for i in at_col])
    cell = kept.join(means, F.col(factor) == F.col("__level"))

    def centred(i: int, j: int):
        a, b = F.col(f"m{i}"), F.col(f"m{j}")
        return F.col(_q(i, j)) - a * F.col(f"s{j}") - b * F.col(f"s{i}") + F.col("n") * a * b

    scores = []
    for k, i in enumerate(at_col[:-1]):
        e = centred(i, y)
        for j, b in zip(at_col[:-1], beta):
            e = e - F.lit(float(b)) * centred(i, j)
        scores.append(F.sum(e).alias(f"e{k}"))
    nx = len(x)
    by_cluster = cell.groupBy(cells.cluster).agg(*scores).withColumn("one", F.lit(1.0))
    products = gram(by_cluster, [*[f"e{k}" for k in range(nx)], "one"])
    clusters, meat = int(round(products[nx, nx])), products[:nx, :nx]
    p = nx + r["levels"]
    scale = clusters / max(clusters - 1, 1) * (total - 1) / (total - p) if total > p else float("nan")

    effect = F.col(f"m{y}") + F.lit(cells.origin[y])
    for i, b in zip(at_col[:-1], beta):
        effect = effect - F.lit(float(b)) * (F.col(f"m{i}") + F.lit(cells.origin[i]))
    r2 = 1.0 - rss / tss if tss > 0 else float("nan")
    return Fit(
        outcome=cells.y,
        x=x,
        factor=factor,
        levels=(),
        terms=x,
        coef=beta,
        covariance=scale * bread @ meat @ bread,
        n=int(round(total)),
        clusters=clusters,
        r_squared=r2,
        adj_r_squared=1.0 - (1.0 - r2) * (total - 1) / (total - p) if total > p else float("nan"),
        effects=means.select(F.col("__level").alias(factor), effect.alias("effect")),
    )


def _cluster_scores(
    cells: DataFrame, cluster: str, factor: str | None, levels: tuple, beta: np.ndarray, at_col: list[int]
) -> DataFrame:
    """Per cluster the sum of x times residual for every term, e0..e(p-1)."""
    *xs, y = at_col
    dummies = levels[1:]
    first_x = 1 + len(dummies)
    base = F.lit(float(beta[0]))
    if dummies:
        shift = F.lit(0.0)
        for i, level in enumerate(dummies):
            shift = F.when(F.col(factor) == F.lit(level), float(beta[1 + i])).otherwise(shift)
        base = base + shift
    slopes = [float(b) for b in beta[first_x:]]
    plain = F.col(f"s{y}") - F.col("n") * base
    for j, b in zip(xs, slopes):
        plain = plain - F.lit(b) * F.col(f"s{j}")
    moments = []
    for i in xs:
        e = F.col(_q(i, y)) - base * F.col(f"s{i}")
        for j, b in zip(xs, slopes):
            e = e - F.lit(b) * F.col(_q(i, j))
        moments.append(e)
    parts = cells.select(
        cluster, *([factor] if factor else []), plain.alias("plain"), *[m.alias(f"m{i}") for i, m in enumerate(moments)]
    )
    aggs = [F.sum("plain").alias("e0")]
    for i, level in enumerate(dummies):
        aggs.append(F.sum(F.when(F.col(factor) == F.lit(level), F.col("plain")).otherwise(0.0)).alias(f"e{1 + i}"))
    aggs += [F.sum(f"m{i}").alias(f"e{first_x + i}") for i in range(len(xs))]
    return parts.groupBy(cluster).agg(*aggs)


def comparison(spark: SparkSession, fits: dict[str, Fit], term: str) -> DataFrame:
    """R-squared, adjusted R-squared and one shared coefficient per model."""
    rows = []
    for label, fit in fits.items():
        _, b, _, p, _, _ = next(r for r in fit.rows() if r[0] == term)
        rows.append((label, fit.r_squared, fit.adj_r_squared, b, p))
    schema = "Model string, R_squared double, Adj_R_squared double, coef double, p_value double"
    return spark.createDataFrame(rows, schema).coalesce(1)
