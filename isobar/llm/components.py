"""Connected components, and pair work inside buckets of any size."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from isobar.llm.common import stored

_PLAIN_ROUNDS = 3


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); a root names its component.

    Each round every node joins the least of its neighbours and itself; the graph is then
    contracted, so the edges shrink. The first rounds take the least number, which settles
    the stars that pair work leaves; later rounds draw a new random order each, under
    which a constant share of the nodes of any graph goes per round. Nothing meets in one
    task: a hub's edges are folded before they are shuffled.
    """
    links = stored(edges.select("a", "b").where("a != b").distinct(), "links")
    placed = None
    turn = 0
    while not links.isEmpty():
        order = F.col("node") if turn < _PLAIN_ROUNDS else F.xxhash64(F.col("node"), F.lit(turn))
        both = links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a"))
        other = F.col("other") if turn < _PLAIN_ROUNDS else F.xxhash64(F.col("other"), F.lit(turn))
        least = both.groupBy("node").agg(F.min(F.struct(other.alias("o"), F.col("other").alias("to"))).alias("low"))
        own = F.struct(order.alias("o"), F.col("node").alias("to"))
        step = stored(least.select("node", F.least("low", own)["to"].alias("root")), "step")
        if placed is None:
            placed = step
        else:
            moved = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
            placed = stored(placed.join(moved, "root", "left").select("node", F.coalesce("next", "root").alias("root")), "placed")
        a = step.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        b = step.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        near = links.join(a, "a").join(b, "b").where("ra != rb")
        links = stored(near.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "links")
        turn += 1
    if placed is None:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return placed


def in_blocks(rows: DataFrame, keys: list[str], spread: Column, block: int, most: int = 32) -> DataFrame:
    """``rows`` with (own, i, j): pair tasks that together compare every two rows of a key.

    A key with more than ``block`` rows is cut into blocks by the hash ``spread``; a task
    (i, j), i <= j, gets blocks i and j of its key, and ``own`` tells a row's block. Keys
    with one row have no pair and are left out. Very large keys get blocks larger than
    ``block``, so that a row goes to ``most`` tasks, and beyond 2^16 rows a block to more.
    """
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    parts = F.greatest(F.least(F.ceil(F.col("n") / block), F.lit(most)), F.ceil(F.col("n") / 65_536)).cast("int")
    placed = rows.join(sizes.select(*keys, parts.alias("parts")), keys)
    placed = placed.withColumn("own", F.pmod(spread, F.col("parts")).cast("int"))
    mates = F.sequence(F.lit(0), F.col("parts") - 1)
    dealt = placed.withColumn("mate", F.explode(mates))
    return dealt.select(
        *[c for c in dealt.columns if c not in ("parts", "mate")],
        F.least("own", "mate").alias("i"), F.greatest("own", "mate").alias("j"),
    )


class Forest:
    """Union-find over 0..n-1 that takes links in arrays and keeps the least as root."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def link(self, a: np.ndarray, b: np.ndarray) -> None:
        """Join a[k] with b[k] for all k; only links between different trees cost."""
        step, at = 256, 0
        while at < len(a):
            ra, rb = self.up[a[at : at + step]], self.up[b[at : at + step]]
            apart = ra != rb
            if apart.any():
                self._join(np.unique(np.stack([ra[apart], rb[apart]], axis=1), axis=0).tolist())
            at += step
            step *= 2

    def _join(self, pairs: Iterable[list[int]]) -> None:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for x, y in pairs:
            x, y = root(x), root(y)
            if x != y:
                up[max(x, y)] = min(x, y)
        moved = np.arange(len(self.up))
        for x in up:
            moved[x] = root(x)
        self.up = moved[self.up]
