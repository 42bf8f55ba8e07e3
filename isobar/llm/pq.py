"""Embedding near-duplicates by product quantisation over inverted lists.

Vectors of unit length go to the list of their nearest coarse centroid, of their label; the
residual is coded in subspaces. A vector also probes the other lists whose border it is
near enough to for a partner to lie beyond. In a list, table lookups give the distance
between the query and a coded vector; the code's own error, which is stored, bounds the
true distance from below, so the filter loses no pair. What remains is reranked by exact
cosine in double precision. The rows of the lists, with their codes, are packed to blocks that
tasks read in pairs, so disk holds a vector a few times, however many lists it probes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from isobar.llm.common import arrow_schema, small_batches, stored
from isobar.llm.components import Forest, components

#: Both quantisers are fitted on about so many vectors, drawn by a hash of their content.
SAMPLE_VECTORS = 20_000
SUBSPACE, CODEWORDS = 8, 64
#: Rows and bytes of vectors in a block, and blocks that a task holds while it meets others.
BLOCK, BLOCK_BYTES, PART_BLOCKS = 2_048, 1 << 20, 64
_ROUNDS = 8


def _k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(_ROUNDS):
        near = _nearest(x, centers)[0]
        for c in range(len(centers)):
            own = x[near == c]
            if len(own):
                centers[c] = own.mean(0)
    return centers


def _nearest(x: np.ndarray, centers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    square = (x * x).sum(1)[:, None] - 2 * x @ centers.T + (centers * centers).sum(1)
    return square.argmin(1), square


class Quantiser:
    """Coarse centroids and residual codebooks, fitted on a bounded sample."""

    def __init__(self, sample: np.ndarray, lists: int):
        self.dim = sample.shape[1]
        self.coarse = _k_means(sample, lists, 0)
        rest = sample - self.coarse[_nearest(sample, self.coarse)[0]]
        self.cuts = list(range(0, self.dim, SUBSPACE))
        self.books = [_k_means(rest[:, c : c + SUBSPACE], CODEWORDS, 1 + c) for c in self.cuts]

    def home(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return _nearest(x, self.coarse)

    def reaches(self, x: np.ndarray, home: np.ndarray, other: int, margin: float) -> np.ndarray:
        """Where the list ``other`` is a later one whose border lies within ``margin`` of the vector."""
        near, far = self.coarse[home], self.coarse[other]
        apart = np.sqrt(np.maximum(((far - near) ** 2).sum(1), 1e-30))
        gap = (((x - far) ** 2).sum(1) - ((x - near) ** 2).sum(1)) / (2 * apart)
        return (other > home) & (gap <= margin)

    def encode(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of residuals and the distance between each residual and its code."""
        codes = np.stack([_nearest(rest[:, c : c + SUBSPACE], b)[0] for c, b in zip(self.cuts, self.books)], axis=1)
        shown = np.concatenate([b[codes[:, m]] for m, b in enumerate(self.books)], axis=1)
        return codes, np.sqrt(((rest - shown) ** 2).sum(1))

    def distances(self, rest: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances (queries x codes) from one lookup table per query."""
        total = np.zeros((len(rest), len(codes)), np.float32)
        for m, (c, book) in enumerate(zip(self.cuts, self.books)):
            table = _nearest(rest[:, c : c + SUBSPACE], book)[1].astype(np.float32)
            total += table[:, codes[:, m]]
        return np.sqrt(np.maximum(total, 0))


def _unit(flat: np.ndarray) -> np.ndarray:
    return flat / np.sqrt((flat * flat).sum(1))[:, None]


def _vectors(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def _classes(rows: DataFrame) -> DataFrame:
    """Equal valid vectors of a label as one class (k1, k2, label, v, n, low)."""
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.exists("v", lambda x: x != 0)
    valid = rows.where(F.col("label").isNotNull() & F.col("v").isNotNull()).where(finite & some)
    return valid.groupBy("k1", "k2").agg(
        F.first("label").alias("label"), F.first("v").alias("v"),
        F.count(F.lit(1)).alias("n"), F.min("id").alias("low"),
    )


class _Rows:
    """Rows of a block in order of their lists, as a task reads them."""

    def __init__(self, own: Quantiser, packed: dict, kind: type):
        self.lists, self.node, self.n = (np.frombuffer(packed[c], t) for c, t in (("lists", np.int32), ("node", np.int64), ("n", np.int64)))
        self.v = np.frombuffer(packed["v"], kind).reshape(-1, own.dim).astype(np.float64)
        self.codes, self.error = np.frombuffer(packed["codes"], np.uint8).reshape(len(self.node), -1), np.frombuffer(packed["error"])
        self.unit, self.norm = _unit(self.v), np.sqrt((self.v * self.v).sum(1))

    def segments(self) -> Iterator[tuple[int, int, int]]:
        """(list, begin, end) of its lists."""
        at = [0, *(np.flatnonzero(np.diff(self.lists)) + 1).tolist(), len(self.lists)]
        return ((int(self.lists[lo]), lo, hi) for lo, hi in zip(at, at[1:]))


def _pair_task(own: Quantiser, left: _Rows, right: _Rows | None, limit: float, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, linked copies, root rows) over the rows of two blocks, or the pairs inside one.

    A pair in two lists is looked for from the earlier list into the later one.
    """
    sides = [left] if right is None else [left, right]
    starts, n = [0, len(left.node)], sum(len(side.node) for side in sides)
    found, forest, reach = np.zeros(n, np.int64), Forest(n), math.sqrt(max(2 - 2 * limit, 0))
    for i, j in [(0, 0)] if right is None else [(0, 1), (1, 0)]:
        ask, into = sides[i], sides[j]
        for number, lo, hi in into.segments():
            asked = np.flatnonzero(own.reaches(ask.unit, ask.lists, number, margin) | ((ask.lists == number) & (i <= j)))
            for at in range(0, len(asked), 256):
                q = asked[at : at + 256]
                near = own.distances(ask.unit[q] - own.coarse[number], into.codes[lo:hi]) <= reach + into.error[lo:hi] + 1e-3
                if right is None:  # rows of one list meet once
                    near &= (ask.lists[q] != number)[:, None] | (q[:, None] < np.arange(lo, hi))
                a, b = np.nonzero(near)
                for k in range(0, len(a), 1 << 15):
                    x, y = q[a[k : k + (1 << 15)]], lo + b[k : k + (1 << 15)]
                    cosine = (ask.v[x] * into.v[y]).sum(1) / (ask.norm[x] * into.norm[y])
                    ok = cosine >= limit
                    x, y = x[ok], y[ok]
                    np.add.at(found, x + starts[i], into.n[y])
                    np.add.at(found, y + starts[j], ask.n[x])
                    forest.link(x + starts[i], y + starts[j])
    hit = np.flatnonzero(found)
    return hit, found[hit], forest.up[hit]


def links(classes: DataFrame, limit: float, margin: float, total: int) -> DataFrame:
    """(node, extra, root): for classes with links, linked copies and a local root.

    ``classes`` has node (a unique long), label, v, n. One row per node and task.
    """
    spark = classes.sparkSession
    sizes = classes.select(F.size("v").alias("d")).distinct().collect()
    out = None
    for (dim,) in sorted(sizes):
        part = classes.where(F.size("v") == dim)
        found = _links_of_dim(part, dim, limit, margin, total)
        out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "node bigint, extra bigint, root bigint")
    return out


def _links_of_dim(classes: DataFrame, dim: int, limit: float, margin: float, total: int) -> DataFrame:
    rate = min(1.0, SAMPLE_VECTORS / max(total, 1))
    drawn = classes.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) < rate * (1 << 30)).select("v").toArrow()["v"].combine_chunks()
    if not len(drawn):  # fewer vectors than one draw
        drawn = classes.select("v").limit(1).toArrow()["v"].combine_chunks()
    lists = int(min(max(2 ** round(math.log2(math.sqrt(max(total, 1)) / 8)), 1), 4096))
    quantiser = Quantiser(_unit(_vectors(drawn, dim)), lists)
    single = classes.schema["v"].dataType.elementType.typeName() == "float"
    kind, size = (np.float32 if single else np.float64), int(min(max(BLOCK_BYTES // (8 * dim), 16), BLOCK))
    placed_schema = "label string, list int, node bigint, n bigint, v binary, codes binary, error double"
    placed_want = arrow_schema(placed_schema)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                v = _vectors(part.column(3), dim)
                unit = _unit(v)
                home = quantiser.home(unit)[0]
                codes, error = quantiser.encode(unit - quantiser.coarse[home])
                packed = [pa.array([r.tobytes() for r in c], pa.binary()) for c in (v.astype(kind), codes.astype(np.uint8))]
                cols = [part.column(1), pa.array(home.astype(np.int32)), part.column(0), part.column(2), *packed, pa.array(error)]
                yield pa.RecordBatch.from_arrays(cols, schema=placed_want)

    held = F.col("v") if single else F.col("v").cast("array<double>").alias("v")
    source = classes.select("node", F.col("label").cast("string").alias("label"), "n", held)
    salt = F.pmod(F.xxhash64("node"), F.lit(-(-total // (1 << 20)) or 1))
    placed = source.mapInArrow(place, placed_schema).repartition("label", "list", salt).sortWithinPartitions("label", "list")
    names = ["lists", "node", "n", "v", "codes", "error"]
    block_schema = "label string, b bigint, " + ", ".join(f"{c} binary" for c in names)
    block_want = arrow_schema(block_schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a label, up to ``size`` of them, as one row; a list's rows stand together."""
        held, rows, label = [], 0, None
        number = TaskContext.get().partitionId() << 32

        def done() -> pa.RecordBatch:
            nonlocal number
            table = pa.Table.from_batches(held)
            numbers = [np.asarray(table[c]).tobytes() for c in ("list", "node", "n")]
            texts = [b"".join(table[c].to_pylist()) for c in ("v", "codes")]
            number += 1
            found = [label, number, *numbers, *texts, np.asarray(table["error"]).tobytes()]
            return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(found, block_want)], schema=block_want)

        for batch in batches:
            labels, at = batch.column(0).to_pylist(), 0
            while at < len(labels):
                if held and (labels[at] != label or rows == size):
                    yield done()
                    held, rows = [], 0
                label, end = labels[at], at
                while end < len(labels) and labels[end] == label and rows + end - at < size:
                    end += 1
                held.append(batch.slice(at, end - at))
                rows, at = rows + end - at, end
        if held:
            yield done()

    schema = "node bigint, extra bigint, root bigint"
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pair in range(batch.num_rows):
                row = {c: batch.column(k)[pair].as_py() for k, c in enumerate(batch.schema.names)}
                left = _Rows(quantiser, row, kind)
                right = None if row["b"] == row["b2"] else _Rows(quantiser, {c: row[f"{c}2"] for c in names}, kind)
                hit, extra, root = _pair_task(quantiser, left, right, limit, margin)
                node = left.node if right is None else np.concatenate([left.node, right.node])
                yield pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(extra), pa.array(node[root])], schema=want)

    spark = classes.sparkSession
    blocks = stored(placed.mapInArrow(pack, block_schema), "blocks")
    # Every task pairs one part of the blocks with another, so no vector is written per pair of blocks.
    count = blocks.count()
    wide = max(math.isqrt(4 * spark.sparkContext.defaultParallelism), -(-count // PART_BLOCKS))
    spread = blocks.repartition(max(1, min(wide, count)))
    other = spread.select(*[F.col(c).alias(f"{c}2") for c in blocks.columns])
    pairs = spread.hint("shuffle_replicate_nl").join(other.hint("shuffle_replicate_nl"), (F.col("label") == F.col("label2")) & (F.col("b") <= F.col("b2")))
    with small_batches(spark, 4):
        return stored(pairs.select("b", *names, "b2", *[f"{c}2" for c in names]).mapInArrow(run, schema), "found")


def near_duplicates(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
    limit: float = 0.98, margin: float | None = None,
) -> DataFrame:
    """(id, n_links, component_id, kept) per row of ``vectors``.

    Rows of one label link at a cosine of ``limit`` or more. Null or zero vectors, those
    with null or non-finite components, and rows without a label link with nothing. Equal
    vectors are one class with a count, so copies are linked and counted without making
    pairs. ``margin`` is how far from a list's border a vector probes beyond it; by
    default the greatest linked length, which loses no pair; a smaller one probes less and
    may. ``component_id`` is the least id reachable, ``kept`` tells whether it is
    the row's own. Vectors of unequal length never link. Repeated rows count as vectors.
    """
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).alias("label"))
    rows = rows.withColumns({"k1": F.xxhash64("label", "v"), "k2": F.xxhash64("v", F.lit("k2"), "label")})
    numbered = _classes(rows).withColumn("node", F.monotonically_increasing_id())
    classes = stored(numbered, "classes")
    total = classes.count()
    if margin is None:
        margin = math.sqrt(max(2 - 2 * limit, 0)) + 1e-6  # rounding
    found = links(classes, limit, margin, total)
    extra = found.groupBy("node").agg(F.sum("extra").alias("extra"))
    placed = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    homes = classes.select("k1", "k2", "node", "n", "low").join(placed, "node", "left").join(extra, "node", "left")
    homes = homes.withColumn("root", F.coalesce("root", "node"))
    least = homes.groupBy("root").agg(F.min("low").alias("component_id"))
    known = homes.join(least, "root").select("k1", "k2", (F.col("n") - 1 + F.coalesce("extra", F.lit(0))).alias("n_links"), "component_id")
    usable = rows.select("id", "k1", "k2")
    joined = usable.join(known, ["k1", "k2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return joined.select(
        F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"),
    )
