"""Codes of vectors under codebooks fitted per part, with a trie over the distinct parts.

Vectors become integers floor(4096 x) and are cut into equal parts. The distinct parts of a
position, with their counts, are kept sorted, so each batch of them is a trie whose levels are
the dimensions. A depth-first walk carries the squared distances from the path so far to all
entries of the codebook: rows with a common prefix share them, and only the leaves take the
nearest entry and add their weighted components. A round is one pass over the distinct
parts; the driver sees only the sums of the entries.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from isobar.llm.common import arrow_schema, stored
from isobar.operators.joins import sized_join

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Components from here on have no place on the integer grid; they count as non-finite.
LARGEST = 2.0**50
#: Distances held at once while leaves are finished, in array elements.
_LEAF_CELLS = 1 << 20
#: Subtrees that the walk goes down together.
_WIDTH = 1 << 12


def _exact(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same integers in a type that holds all squared distances: doubles, longs or Python's."""
    most = int(np.abs(rows).max()) + int(np.abs(book).max())
    bound = rows.shape[1] * most * most
    kind = np.float64 if bound < 1 << 50 else np.int64 if bound < 1 << 62 else object
    return rows.astype(kind), book.astype(kind)


def _square_distances(rows: np.ndarray, book: np.ndarray) -> np.ndarray:
    if rows.dtype == np.float64:
        return (rows * rows).sum(1)[:, None] - 2 * (rows @ book.T) + (book * book).sum(1)
    gap = rows[:, None] - book[None]
    return (gap * gap).sum(2)


def walk(rows: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest entry, squared distance) of rows that are distinct and in order.

    The rows are the leaves of a trie. The walk goes down bundles of neighbouring subtrees
    of one depth, first bundles first: each node adds its component to the distances of
    the prefix, which all rows below share; a node with one row is a leaf and is finished.
    """
    n, m = rows.shape
    best, far = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n or not m:
        return best, far
    differ = rows[1:] != rows[:-1]
    shared = np.concatenate([[-1], differ.argmax(1)])
    rows, book = _exact(rows, book)
    far = far.astype(object if rows.dtype == object else np.int64)
    step = max(1, _LEAF_CELLS // (len(book) * (1 if rows.dtype == np.float64 else m)))

    def leaves(at: np.ndarray, depth: int, sums: np.ndarray) -> None:
        for lo in range(0, len(at), step):
            own = at[lo : lo + step]
            total = sums[lo : lo + step]
            if depth < m:
                total = total + _square_distances(rows[own, depth:], book[:, depth:])
            best[own] = near = total.argmin(1)
            far[own] = total[np.arange(len(own)), near]

    stack = [(np.arange(n), np.zeros(n, np.int64), 0, np.zeros((1, len(book)), rows.dtype))]
    while stack:
        at, node, depth, sums = stack.pop()
        new = shared[at] <= depth
        start = np.flatnonzero(new)
        gap = rows[at[start], depth][:, None] - book[None, :, depth]
        below = sums[node[start]] + gap * gap
        single = np.diff(np.append(start, len(at))) == 1
        leaves(at[start[single]], depth + 1, below[single])
        child = np.cumsum(new) - 1
        deeper = ~single[child]
        at, child, below = at[deeper], (np.cumsum(~single) - 1)[child[deeper]], below[~single]
        for lo in range((len(below) - 1) // _WIDTH * _WIDTH, -1, -_WIDTH) if len(below) else ():
            own = slice(*np.searchsorted(child, [lo, lo + _WIDTH]))
            stack.append((at[own], child[own] - lo, depth + 1, below[lo : lo + _WIDTH]))
    return best, far


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return np.asarray(flat, np.int64).reshape(len(column), width)


def _distinct(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows in order, and for every row the number of its equal."""
    if not rows.shape[1]:
        return rows[:1], np.zeros(len(rows), np.int64)
    order = np.lexsort(rows.T[::-1])
    placed = rows[order]
    new = np.concatenate([[True], (placed[1:] != placed[:-1]).any(1)])
    back = np.empty(len(rows), np.int64)
    back[order] = np.cumsum(new) - 1
    return placed[new], back


class Codebooks:
    """Entries per vector length and part: ``books[d][p]`` is (entries x width) of integers."""

    def __init__(self, books: dict[int, list[np.ndarray]]):
        self.books = books

    def digest(self, d: int) -> str:
        """Hex SHA-256 of all components by part, entry and place, joined by commas."""
        flat = (str(int(x)) for book in self.books[d] for entry in book for x in entry)
        return hashlib.sha256(",".join(flat).encode()).hexdigest()

    def moved(self, sums: dict[tuple, tuple[int, int]]) -> Codebooks:
        """Entries at the floored means of their parts; unused ones stay."""
        out = {}
        for d, parts in self.books.items():
            out[d] = []
            for p, book in enumerate(parts):
                new = book.copy()
                for e in range(len(book)):
                    for j in range(book.shape[1]):
                        if (d, p, e, j) in sums:
                            total, count = sums[d, p, e, j]
                            new[e, j] = total // count
                out[d].append(new)
        return Codebooks(out)


def integers(vectors: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """(id, label, d, v): valid vectors on the integer grid, padded to whole parts.

    ``d`` is the length before padding.
    """
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).alias("id"), F.col(label_col).alias("label"), v.alias("x"))
    fine = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST))
    rows = rows.where(F.col("x").isNotNull()).where(fine)
    grid = F.transform("x", lambda x: F.floor(x * SCALE))
    gap = F.pmod(-F.size("x"), F.lit(PARTS))
    padded = F.concat(grid, F.array_repeat(F.lit(0).cast("bigint"), gap))
    return rows.select("id", "label", F.size("x").alias("d"), padded.alias("v"))


def distinct_parts(rows: DataFrame) -> DataFrame:
    """(d, p, part, n) in order within each file, so that batches are tries."""
    width = (F.size("v") / PARTS).cast("int")
    cut = F.array(*[F.slice("v", F.lit(p) * width + 1, width) for p in range(PARTS)])
    each = rows.select("d", F.posexplode(cut).alias("p", "part"))
    counted = each.groupBy("d", "p", "part").agg(F.count(F.lit(1)).alias("n"))
    return stored(counted.sortWithinPartitions("d", "p", "part"), "parts")


def first_entries(rows: DataFrame) -> Codebooks:
    """The parts of the vectors with the least ids, per length; equal ids in order of content."""
    order = Window.partitionBy("d").orderBy(F.col("id").asc_nulls_last(), "v")
    least = rows.select("d", "id", "v").withColumn("r", F.row_number().over(order)).where(F.col("r") <= ENTRIES)
    found: dict[int, list] = {}
    for d, _, v in sorted(least.select("d", "r", "v").collect()):
        found.setdefault(d, []).append(v)
    books = {}
    for d, vs in found.items():
        grid = np.array(vs, np.int64).reshape(len(vs), PARTS, -1)
        books[d] = [grid[:, p] for p in range(PARTS)]
    return Codebooks(books)


def part_sums(parts: DataFrame, codebooks: Codebooks) -> dict[tuple, tuple[int, int]]:
    """(length, part, entry, place) -> (sum, count) over the parts nearest to each entry."""
    books = codebooks.books
    schema = "d int, p int, e int, j int, total decimal(38,0), n bigint"
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        for batch in batches:
            d, p, n = (np.asarray(batch.column(c)) for c in ("d", "p", "n"))
            cuts = np.flatnonzero((d[1:] != d[:-1]) | (p[1:] != p[:-1])) + 1
            for lo, hi in zip(np.append(0, cuts), np.append(cuts, len(d))):
                if lo == hi:
                    continue
                book = books[int(d[lo])][int(p[lo])]
                rows = _matrix(batch.column("part").slice(lo, hi - lo), book.shape[1])
                near, _ = walk(rows, book)
                most = int(np.abs(rows).max(initial=0))
                weight = n[lo:hi]
                if most * int(weight.sum()) >= 1 << 62:
                    rows, weight = rows.astype(object), weight.astype(object)
                order = np.argsort(near, kind="stable")
                used, first = np.unique(near[order], return_index=True)
                sums = np.add.reduceat((rows * weight[:, None])[order], first, axis=0) if book.shape[1] else np.zeros((len(used), 0))
                counts = np.add.reduceat(weight[order], first)
                for e, total, count in zip(used.tolist(), sums.tolist(), counts.tolist()):
                    at = held.setdefault((int(d[lo]), int(p[lo]), e), [[0] * book.shape[1], 0])
                    at[0] = [a + b for a, b in zip(at[0], total)]
                    at[1] += count
        out = [(*key, j, Decimal(s), n) for key, (sums, n) in held.items() for j, s in enumerate(sums)]
        for lo in range(0, len(out), 10_000):
            cols = zip(*out[lo : lo + 10_000])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, want.types)], schema=want)

    folded = parts.mapInArrow(run, schema).groupBy("d", "p", "e", "j").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    return {(r.d, r.p, r.e, r.j): (int(r.total), r.n) for r in folded.collect()}


def fit(rows: DataFrame, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks after ``rounds`` of assigning all distinct parts and moving the entries."""
    codebooks = first_entries(rows)
    if codebooks.books:
        parts = distinct_parts(rows)
        for _ in range(rounds):
            codebooks = codebooks.moved(part_sums(parts, codebooks))
    return codebooks


def encode(rows: DataFrame, codebooks: Codebooks) -> DataFrame:
    """(id, label, d, code, error) of every row of ``integers``.

    The distinct parts of a batch are walked as in a round. An error that passes 63 bits
    is null.
    """
    books = codebooks.books
    schema = StructType([*rows.select("id", "label", "d").schema.fields, StructField("code", StringType()), StructField("error", LongType())])
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = np.asarray(batch.column("d"))
            for d in np.unique(sizes).tolist():
                own = batch.take(pa.array(np.flatnonzero(sizes == d)))
                width = books[d][0].shape[1]
                grid = _matrix(own.column("v"), width * PARTS)
                codes, total = np.empty((len(grid), PARTS), np.uint8), np.zeros(len(grid), object)
                for p, book in enumerate(books[d]):
                    rows_p, back = _distinct(grid[:, p * width : (p + 1) * width])
                    near, far = walk(rows_p, book)
                    codes[:, p] = near[back]
                    total = total + far[back].astype(object)
                error = [int(x) if x < 1 << 63 else None for x in total]
                cols = [*(own.column(c) for c in ("id", "label", "d")), pa.array([row.tobytes().hex() for row in codes]), pa.array(error, pa.int64())]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, want.types)], schema=want)

    return rows.mapInArrow(run, schema)


def compress(
    vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS
) -> DataFrame:
    """(id, code, error, label_error, codebooks_sha256) per valid row of ``vectors``.

    Rows whose vector is null, or has null, non-finite or (from 2^50) too large components,
    have no row. Each length of vectors has its own codebooks, which the driver and every
    task hold (8 x 16 parts a length); lengths that 8 does not divide are padded with zeros.
    Repeated rows and ids count each. With fewer than 16 vectors a codebook has as
    many entries; equal entries are resolved to the first. ``label_error`` sums the errors
    of equal labels, nulls together. Other columns are ignored. No row gives no row.
    """
    rows = integers(vectors, id_col, vector_col, label_col)
    codebooks = fit(rows, rounds)
    coded = stored(encode(rows, codebooks), "codes")
    same = F.coalesce(F.concat(F.lit("="), F.col("label").cast("string")), F.lit("null"))
    coded = coded.withColumn("same", same)
    sums = coded.groupBy("same").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("s"))
    label_error = sums.select("same", F.col("s").try_cast("bigint").alias("label_error"))
    joined = sized_join(coded, label_error, "same")
    digest = F.lit(None).cast("string")
    for d in codebooks.books:
        digest = F.when(F.col("d") == d, codebooks.digest(d)).otherwise(digest)
    return joined.select(F.col("id").alias(id_col), "code", "error", "label_error", digest.alias("codebooks_sha256"))
