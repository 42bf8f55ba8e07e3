"""Pairwise-complete moments of many columns in one pass.

A dozen columns make 66 pairs and each needs six moments. As SQL aggregates that is
hundreds of expressions, past what generated code handles well; as four small matrix
products per Arrow batch it is one pass. A task counts from the first value that it meets in a
column; batches, and then tasks, are joined by the distance of their means, so that a
large common offset costs no digits and no extra pass finds an origin. Each task sends one row per pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

_PARTS = ("n", "ox", "oy", "mx", "my", "cxx", "cyy", "cxy")


def _batch_moments(table: np.ndarray) -> np.ndarray:
    """(n, mean, squares, products) as k x k: entry (i, j) is about column i where j is set too.

    Missing values are NaN.
    """
    there = ~np.isnan(table)
    mask = there.astype("float64")
    rows = np.maximum(mask.sum(0), 1)
    middle = np.where(there, table, 0.0).sum(0) / rows
    x = np.where(there, table - middle, 0.0)
    n = mask.T @ mask
    sx, sxx, sxy = x.T @ mask, (x * x).T @ mask, x.T @ x
    m = sx / np.maximum(n, 1)
    return np.stack([n, middle[:, None] + m, sxx - sx * m, sxy - sx * m.T])


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Moments of two sets of rows together."""
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    gap = b[1] - a[1]
    mean = np.where(a[0] > 0, a[1] + gap * share, b[1])
    weight = a[0] * share
    return np.stack([n, mean, a[2] + b[2] + gap * gap * weight, a[3] + b[3] + gap * gap.T * weight])


def pair_moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(i, j, n, cxx, cyy, cxy) for i <= j: centred sums over rows where both are set."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    k = len(columns)
    pick = np.triu_indices(k)

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, origin = np.zeros((4, k, k)), np.full(k, np.nan)
        for batch in batches:
            table = np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype("float64")
            there = ~np.isnan(table)
            first = np.where(there.any(0), table[there.argmax(0), np.arange(k)], np.nan) if len(table) else origin
            origin = np.where(np.isnan(origin), first, origin)
            total = _joined(total, _batch_moments(table - origin))
        n, mean, square, product = total
        values = [n[pick], origin[pick[0]], origin[pick[1]], mean[pick], mean.T[pick], square[pick], square.T[pick], product[pick]]
        index = [pa.array(i.astype("int32")) for i in pick]
        yield pa.RecordBatch.from_arrays([*index, *map(pa.array, values)], names=["i", "j", *_PARTS])

    schema = "i int, j int, " + ", ".join(f"{s} double" for s in _PARTS)
    # One row per pair and task; those of a pair are joined about one task's origin.
    same = Window.partitionBy("i", "j")
    parts = numbers.mapInArrow(moments, schema).filter("n > 0")
    gap = {f"g{c}": (F.col(f"o{c}") - F.min(f"o{c}").over(same)) + F.col(f"m{c}") for c in "xy"}
    about = parts.withColumns(gap)
    n, gx, gy = F.col("n"), F.col("gx"), F.col("gy")
    total = F.sum(n)
    joined = about.groupBy("i", "j").agg(
        total.alias("n"),
        (F.sum(F.col("cxx") + n * gx * gx) - F.sum(n * gx) * F.sum(n * gx) / total).alias("cxx"),
        (F.sum(F.col("cyy") + n * gy * gy) - F.sum(n * gy) * F.sum(n * gy) / total).alias("cyy"),
        (F.sum(F.col("cxy") + n * gx * gy) - F.sum(n * gx) * F.sum(n * gy) / total).alias("cxy"),
    )
    every = F.array(*[F.struct(F.lit(int(i)).alias("i"), F.lit(int(j)).alias("j")) for i, j in zip(*pick)])
    pairs = df.sparkSession.range(1).select(F.explode(every).alias("p")).select("p.i", "p.j")
    return pairs.join(joined, ["i", "j"], "left").fillna(0.0, ["n"])


def corr_of_moments() -> Column:
    """Pearson r; null where a column is constant."""
    varied = (F.col("cxx") > 0) & (F.col("cyy") > 0)
    return F.when(varied, F.try_divide(F.col("cxy"), F.sqrt(F.col("cxx")) * F.sqrt(F.col("cyy"))))


def gram(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The columns' cross-product matrix over their complete rows, k x k on the driver."""
    numbers = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    k = len(columns)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for batch in batches:
            x = np.nan_to_num(np.column_stack([c.to_numpy(zero_copy_only=False) for c in batch.columns]).astype("float64"))
            total += x.T @ x
        i, j = np.indices((k, k))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "s"])

    out = np.zeros((k, k))
    for row in numbers.mapInArrow(products, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[row.i, row.j] = row.s
    return out
