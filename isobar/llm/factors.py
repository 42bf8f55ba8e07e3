"""Repeated passages by relative Lempel-Ziv parsing against reference blocks.

Every window of ``window`` words is known by the least hash of the seeds (a few words) in it:
its anchor. Equal windows have equal anchors, so a run of windows of one anchor has to be
compared with runs of the same anchor only. Runs whose anchor several documents have are
gathered by anchor into reference blocks; equal runs are one. A block is indexed by the
order of all its suffixes, and every run is parsed greedily into the longest factors that an
earlier document's runs hold. A factor of a whole window or more is a repeated span; a repeated window
that no factor holds must straddle the border of two factors, so those are looked up there.
Anchors with more text than a block are dealt window by window instead.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

from isobar.llm.common import arrow_schema, stored, text_slices
from isobar.llm.words import byte_kinds, cut_words, hashes, mixed
from isobar.operators.joins import sized_join

WINDOW, SEED = 50, 10
#: Words of runs that are indexed together; an anchor with more is dealt window by window.
BLOCK_WORDS = 1 << 20
#: Bytes of text that are hashed together in a task.
SLICE_BYTES = 8 << 20
#: Runs that a task remembers in order not to send their texts again.
_REMEMBERED = 100_000
_KINDS = byte_kinds(b" \t\n\x0b\x0c\r")


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every ``width`` consecutive ones."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def _anchored(texts: pa.Array, window: int, seed: int) -> tuple:
    """(rows, starts, counts, anchors) of the runs of windows with one anchor."""
    cut = cut_words(texts, _KINDS, lower=False)
    if len(cut.row) < window:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    code, vocabulary = cut.coded()
    spelt = hashes(vocabulary)[code]
    n = len(code) - seed + 1
    h = np.zeros(n, np.uint64)
    for j in range(seed):
        h = mixed(h, spelt[j : j + n])
    anchor = _least(mixed(h, np.uint64(seed)), window - seed + 1)
    inside = np.flatnonzero(cut.row[: len(anchor)] == cut.row[window - 1 :])
    own, home = anchor[inside], cut.row[inside]
    new = np.ones(len(inside), bool)
    new[1:] = (own[1:] != own[:-1]) | (home[1:] != home[:-1])
    first = np.flatnonzero(new)
    begin = np.searchsorted(cut.row, home[first])
    return home[first], inside[first] - begin, np.diff(np.append(first, len(inside))), own[first].view(np.int64)


def _order(id_col: str) -> Column:
    """Ids in order; rows without one come last."""
    return F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"))


def anchors(rows: DataFrame, window: int, seed: int) -> DataFrame:
    """(id, h1, h2, anchor, start, count): the runs of windows of every text."""
    schema = StructType([
        *rows.select("id", "h1", "h2").schema.fields, StructField("anchor", LongType()),
        StructField("start", IntegerType()), StructField("count", IntegerType()),
    ])
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 3, SLICE_BYTES):
            row, start, count, anchor = _anchored(batch.column("t"), window, seed)
            take = pa.array(row)
            cols = [*(batch.column(c).take(take) for c in ("id", "h1", "h2")), pa.array(anchor), pa.array(start), pa.array(count)]
            yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, want.types)], schema=want)

    return stored(rows.mapInArrow(run, schema), "runs")


def shared_runs(runs: DataFrame) -> DataFrame:
    """(h1, h2, wanted): of every text, the runs whose anchor two documents have."""
    order = _order("id")
    known = runs.groupBy("anchor").agg(F.min(order).alias("lo"), F.max(order).alias("hi")).where("lo < hi").select("anchor")
    joined = sized_join(runs, stored(known, "anchors"), "anchor", "inner")
    return joined.groupBy("h1", "h2").agg(F.collect_set(F.struct("start", "count", "anchor")).alias("wanted"))


def segments(rows: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """One row per wanted run (id, h1, h2, start, size, seg), with its anchor and ``words`` where
    the task has not sent that run before for the same or a smaller id."""
    schema = StructType([
        *rows.select("id", "h1", "h2").schema.fields, StructField("start", IntegerType()), StructField("size", IntegerType()),
        StructField("seg", BinaryType()), StructField("anchor", LongType()), StructField("words", StringType()),
    ])
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: dict[bytes, tuple] = {}
        for whole in batches:
            for batch in text_slices([whole], 3):
                out, row = [], []
                texts = batch.column("t").cast(pa.binary()).to_pylist()
                for at, (id_, text, runs) in enumerate(zip(batch.column("id").to_pylist(), texts, batch.column("wanted").to_pylist())):
                    words = text.split()
                    for r in runs:
                        size = r["count"] + window - 1
                        own = b" ".join(words[r["start"] : r["start"] + size])
                        seg = xxhash.xxh3_128_digest(own)
                        before, key = sent.get(seg), (id_ is None, id_)
                        new = before is None or key[0] < before[0] or (key[0] == before[0] and not key[0] and key[1] < before[1])
                        if new:
                            if len(sent) >= _REMEMBERED:
                                sent.clear()
                            sent[seg] = key
                        out.append((r["start"], size, seg, r["anchor"], own.decode() if new else None))
                        row.append(at)
                if out:
                    take = pa.array(row, pa.int64())
                    cols = [*(batch.column(c).take(take) for c in ("id", "h1", "h2"))]
                    cols += [pa.array(c, t) for c, t in zip(zip(*out), want.types[3:])]
                    yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, want.types)], schema=want)

    found = rows.join(wanted, ["h1", "h2"]).select("id", "h1", "h2", "t", "wanted")
    return stored(found.mapInArrow(run, schema), "segments")


class Index:
    """The suffixes of a block's runs in order, over word numbers.

    ``levels[k]`` ranks the 2^k words from each place, so that equal ranks are equal words.
    A run ends in a number of its own, so nothing matches across runs.
    """

    def __init__(self, code: np.ndarray, window: int):
        self.levels = [np.unique(code, return_inverse=True)[1].astype(np.int64)]
        while 1 << (len(self.levels) - 1) < window:
            rank, step = self.levels[-1], 1 << (len(self.levels) - 1)
            ahead = np.zeros(len(rank), np.int64)
            ahead[: max(len(rank) - step, 0)] = rank[step:] + 1
            self.levels.append(np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1].astype(np.int64))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes a[k] and b[k] begin with together (at least that many, from a window on)."""
        size = np.zeros(len(a), np.int64)
        last = len(self.levels[0]) - 1
        for k in range(len(self.levels) - 1, -1, -1):
            rank = self.levels[k]
            x, y = np.minimum(a + size, last), np.minimum(b + size, last)
            size += np.where(rank[x] == rank[y], 1 << k, 0)
        return size

    def reach(self, own: np.ndarray) -> np.ndarray:
        """From every place, the longest match with a run of smaller ``own``.

        In the order of suffixes that is the nearest smaller one before or after; pointers
        jump over what is not smaller.
        """
        order = np.argsort(self.levels[-1], kind="stable")
        best = np.zeros(len(own), np.int64)
        for places in (order, order[::-1]):
            value = own[places]
            near = np.arange(len(places)) - 1
            open_ = np.flatnonzero(near >= 0)
            while len(open_):
                open_ = open_[value[near[open_]] >= value[open_]]
                near[open_] = near[near[open_]]
                open_ = open_[near[open_] >= 0]
            has = np.flatnonzero(near >= 0)
            a, b = places[has], places[near[has]]
            best[a] = np.maximum(best[a], self.common(a, b))
        return best


def parse(reach: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Greedy factors (run, start, length) of all runs, side by side; an unmatched word is one."""
    out, run, at = [], np.arange(len(begin)), begin.copy()
    while len(run):
        size = np.maximum(reach[at], 1)
        out.append((run, at, size))
        at = at + size
        more = at < end[run]
        run, at = run[more], at[more]
    run, start, size = (np.concatenate(c) for c in zip(*out))
    order = np.lexsort((start, run))
    return run[order], start[order], size[order]


def repeated(runs: list[list[bytes]], own: np.ndarray, window: int) -> list[list[int]]:
    """Of each run, [from, to, ...] of its words in windows that a run of smaller ``own`` has."""
    sizes = np.array([len(r) for r in runs])
    words = pa.array([w for r in runs for w in (*r, b"")], pa.binary()).dictionary_encode()
    code = words.indices.to_numpy().astype(np.int64)
    end = np.cumsum(sizes + 1) - 1
    begin = end - sizes
    code[end] = len(words.dictionary) + np.arange(len(runs))
    of = np.repeat(np.arange(len(runs)), sizes + 1)
    reach = Index(code, window).reach(own[of])
    reach[end] = 0
    run, start, size = parse(reach, begin, end)
    long = size >= window
    lo, hi = [start[long]], [start[long] + size[long]]
    # Windows over the border of two factors: the second one must reach their end.
    next_to = np.flatnonzero(run[1:] == run[:-1])
    border = start[next_to + 1]
    first = np.maximum(start[next_to], border - window + 1)
    count = np.maximum(np.minimum(border - 1, border + size[next_to + 1] - window) - first + 1, 0)
    at = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    at = at[reach[at] >= window]
    lo.append(at)
    hi.append(at + window)
    edge = np.zeros(len(code) + 1, np.int64)
    np.add.at(edge, np.concatenate(lo), 1)
    np.add.at(edge, np.concatenate(hi), -1)
    cover = np.cumsum(edge)[:-1] > 0
    turn = np.flatnonzero(np.diff(np.concatenate([[False], cover])))
    spans: list[list[int]] = [[] for _ in runs]
    for k in turn.tolist():
        spans[of[k]].append(k - int(begin[of[k]]))
    return spans


def judge(sent: DataFrame, window: int, block_words: int) -> DataFrame:
    """(seg, first, spans) of every distinct run: its least id, and its words in windows
    that a document with a smaller id than that has."""
    size = F.size(F.split("words", " "))
    totals = sent.select("anchor", size.alias("n")).groupBy("anchor").agg(F.sum("n").alias("n"))
    large = stored(totals.where(F.col("n") > block_words).select("anchor", F.lit(True).alias("large")), "large")
    marked = sized_join(sent.select("anchor", "seg", "id", "words"), large, "anchor")
    return _by_block(marked.where("large IS NULL"), window, block_words).union(_by_window(marked.where("large"), window))


def _by_block(sent: DataFrame, window: int, block_words: int) -> DataFrame:
    schema = StructType([StructField("seg", BinaryType()), StructField("id", sent.schema["id"].dataType), StructField("spans", ArrayType(IntegerType()))])
    want = arrow_schema(schema)
    by = ["anchor", "none", "id", "seg"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: list[list[bytes]] = []
        own: list[int] = []
        keys: list[tuple] = []
        held, anchor, last, seen, size = 0, None, None, set(), 0

        def done() -> pa.RecordBatch:
            spans = repeated(runs, np.array(own), window)
            cols = zip(*[(*key, s) for key, s in zip(keys, spans)])
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, want.types)], schema=want)
            runs.clear(), own.clear(), keys.clear()
            return out

        for batch in batches:
            cols = [batch.column(c).to_pylist() for c in ("anchor", "id", "seg")] + [batch.column("words").cast(pa.binary()).to_pylist()]
            for a, id_, seg, words in zip(*cols):
                if a != anchor:
                    if held > block_words:
                        yield done()
                        held = 0
                    anchor, last, seen, size = a, None, set(), 0
                if seg in seen:
                    continue
                seen.add(seg)
                if last != (id_,):
                    last, size = (id_,), size + 1
                runs.append(words.split(b" "))
                own.append(size)
                keys.append((seg, id_))
                held += len(runs[-1])
        if runs:
            yield done()

    placed = sent.withColumn("none", F.col("id").isNull()).repartition("anchor").sortWithinPartitions(*by)
    found = placed.select("anchor", "id", "seg", "words").mapInArrow(run, schema)
    return found.select("seg", _order("id").alias("first"), "spans")


def _by_window(sent: DataFrame, window: int) -> DataFrame:
    """The same for anchors of any size: the least id of every window, by its digest."""
    schema = StructType([StructField("seg", BinaryType()), StructField("at", IntegerType()), StructField("win", BinaryType())])
    want = arrow_schema(schema)
    first = sent.groupBy("seg").agg(F.min(_order("id")).alias("first"))
    texts = sent.groupBy("seg").agg(F.max("words").alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for seg, text in zip(batch.column("seg").to_pylist(), batch.column("words").cast(pa.binary()).to_pylist()):
                words = text.split(b" ")
                n = len(words) - window + 1
                for lo in range(0, n, 10_000):
                    at = range(lo, min(lo + 10_000, n))
                    wins = [xxhash.xxh3_128_digest(b" ".join(words[k : k + window])) for k in at]
                    yield pa.RecordBatch.from_arrays([pa.array([seg] * len(at), pa.binary()), pa.array(at, pa.int32()), pa.array(wins, pa.binary())], schema=want)

    wins = texts.mapInArrow(run, schema)
    each = stored(sized_join(wins, stored(first, "firsts"), "seg"), "windows")
    least = each.groupBy("win").agg(F.min("first").alias("least"))
    late = sized_join(each, stored(least, "least"), "win").where("least < first")
    spans = F.flatten(F.transform(F.array_sort(F.collect_list("at")), lambda k: F.array(k, k + window)))
    hits = late.groupBy("seg").agg(spans.alias("spans"))
    none = F.array().cast("array<int>")
    return first.join(hits, "seg", "left").select("seg", "first", F.coalesce("spans", none).alias("spans"))


def without_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, seed: int = SEED, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """(id, n_words, n_removed, spans, kept) per row of ``docs``.

    Words are split at blanks, tabs and line ends. A word goes where a window of ``window``
    words over it also starts in a document with a smaller id; rows with equal ids are one
    document in this, and rows without an id come after all others. ``spans`` lists
    [from, to, ...] of the removed words, ``kept`` is the others joined by one blank. Null and empty
    texts have no words; an empty table gives no row. Other columns are ignored.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), t.alias("t"))
    rows = rows.withColumns({"h1": F.xxhash64(F.col("id").isNull(), "id", "t"), "h2": F.xxhash64("t", F.lit(1), "id", F.col("id").isNull())})
    rows = rows.select("id", "h1", "h2", "t")
    runs = anchors(rows, window, seed)
    found = segments(rows, shared_runs(runs), window)
    judged = stored(judge(found.where("words IS NOT NULL").select("anchor", "seg", "id", "words"), window, block_words), "judged")
    met = sized_join(found.select("id", "h1", "h2", "start", "size", "seg"), judged, "seg", "inner")
    whole = F.array(F.lit(0), F.col("size"))
    own = F.when(_order("id") > F.col("first"), whole).otherwise(F.col("spans"))
    met = met.withColumn("own", own).where(F.size("own") > 0)
    moved = F.struct("start", "own")
    spans = met.groupBy("h1", "h2").agg(F.collect_set(moved).alias("spans"))
    return _cut(rows.join(spans, ["h1", "h2"], "left").select("id", "t", "spans")).withColumnRenamed("id", id_col)


def _cut(rows: DataFrame) -> DataFrame:
    schema = StructType([
        rows.schema["id"], StructField("n_words", LongType()), StructField("n_removed", LongType()),
        StructField("spans", ArrayType(IntegerType())), StructField("kept", StringType()),
    ])
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in text_slices([whole], 1):
                out = []
                for text, found in zip(batch.column("t").cast(pa.binary()).to_pylist(), batch.column("spans").to_pylist()):
                    words = text.split()
                    pairs = sorted((f["start"] + a, f["start"] + b) for f in found or () for a, b in zip(f["own"][::2], f["own"][1::2]))
                    spans: list[int] = []
                    for a, b in pairs:
                        if spans and a <= spans[-1]:
                            spans[-1] = max(spans[-1], b)
                        else:
                            spans += [a, b]
                    kept, at = [], 0
                    for a, b in zip(spans[::2], spans[1::2]):
                        kept += words[at:a]
                        at = b
                    kept += words[at:]
                    out.append((len(words), len(words) - len(kept), spans, b" ".join(kept).decode()))
                cols = [batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*out), want.types[1:]))]
                yield pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(cols, want.types)], schema=want)

    return rows.mapInArrow(run, schema)
