"""Collocations of two and more words from count streams in prefix and suffix order.

Phrases are counted length by length; a phrase is counted only where both phrases that it
extends may be frequent, which a bit filter of bounded size tells (a wrong yes costs a count, never a
result). The frequent phrases of all lengths then form one stream. Sorted by their words, the
beginnings of a phrase stand right before it and its extensions right after it; sorted by
their words read backwards, so do its endings. One walk over each order with a stack as deep as
the longest phrase therefore finds the counts of all first parts, all rests and the best
extensions, without a hash table. What a partition needs from its neighbours is a few rows,
carried over its edges.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from isobar.llm.common import arrow_schema, small_batches, stored, text_slices
from isobar.llm.words import byte_kinds, cut_words, hashes, mixed
from isobar.operators.joins import sized_join
from isobar.session import settle

LONGEST, LEAST, SHARE, TOP = 4, 30, 80, 2000
SCORE_SCALE = 2_000_000
#: Bytes of text that are counted together in a task.
SLICE_BYTES = 2 << 20
#: The bit filter has about 16 bits a phrase, and at most so many.
FILTER_BITS = 27
#: First round of the best of a language: so many parts.
_PARTS = 64

_KINDS = byte_kinds(b" \t", b".,;:!?\n\x0b\x0c\r")


class BitFilter:
    """Bits of phrases (lang, words) that are frequent; others may share them."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def holds(self, h: np.ndarray) -> np.ndarray:
        at = h >> np.uint64(64 - self.bits)
        return (self.words[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1) != 0


def _phrase_hashes(langs: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    h = langs
    for word in words:
        h = mixed(h, word)
    return h


def _counted(batch: pa.RecordBatch, size: int, known: BitFilter | None) -> tuple:
    """(langs, phrases, counts) of the phrases of ``size`` words that may be frequent.

    For single words also ('', number of all words) of every language.
    """
    cut = cut_words(batch.column("t"), _KINDS, lower=True)
    if not len(cut.row):
        return [], [], []
    code, vocabulary = cut.coded()
    coded = batch.column("lang").dictionary_encode()
    names = coded.dictionary
    lang = coded.indices.to_numpy().astype(np.int64)[cut.row]
    windows = len(code) - size + 1
    ok = cut.piece[: max(windows, 0)] == cut.piece[size - 1 :]
    if known is not None and windows > 0:
        spelt, n = hashes(vocabulary)[code], windows + 1
        may = known.holds(_phrase_hashes(hashes(names.cast(pa.binary()))[lang[:n]], [spelt[j : j + n] for j in range(size - 1)]))
        ok &= may[:-1] & may[1:]
    starts = np.flatnonzero(ok)
    span = len(vocabulary)
    key, bound = lang[starts] * span + code[starts], len(names) * span
    for j in range(1, size):
        if bound * span >= 1 << 62:
            key = np.unique(key, return_inverse=True)[1]
            bound = len(starts)
        key, bound = key * span + code[starts + j], bound * span
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    at = starts[first]
    columns = [vocabulary.take(pa.array(code[at + j])) for j in range(size)]
    phrases = (columns[0] if size == 1 else pc.binary_join_element_wise(*columns, b" ")).cast(pa.string())
    langs = names.take(pa.array(lang[at]))
    if size == 1:
        total = np.bincount(lang, minlength=len(names))
        langs, counts = pa.concat_arrays([langs, names]), np.concatenate([counts, total])
        phrases = pa.concat_arrays([phrases, pa.array([""] * len(names))])
    return langs, phrases, counts


def count_phrases(texts: DataFrame, size: int, known: BitFilter | None, least: int) -> DataFrame:
    """(lang, phrase, f) with f >= ``least``; for single words also ('', all words) per language."""
    schema = "lang string, phrase string, f bigint"
    want = arrow_schema(schema)
    shared = texts.sparkSession.sparkContext.broadcast(known) if known is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_slices(batches, 1, SLICE_BYTES):
            langs, phrases, counts = _counted(batch, size, shared.value if shared is not None else None)
            if len(langs):
                yield pa.RecordBatch.from_arrays([langs, phrases, pa.array(counts, pa.int64())], schema=want)

    counted = texts.mapInArrow(run, schema).groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
    with small_batches(texts.sparkSession):
        return stored(counted.where((F.col("f") >= least) | (F.col("phrase") == "")), f"phrases{size}")


def bit_filter(frequent: DataFrame) -> BitFilter:
    """The filter of all rows of ``frequent``; at most 2^FILTER_BITS bits reach the driver."""
    bits = min(max((frequent.count() * 16).bit_length(), 10), FILTER_BITS)
    schema = "at int, mask bigint"
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # All phrases of a table have the same number of words.
            split = pc.list_flatten(pc.split_pattern(batch.column("phrase").cast(pa.string()), " "))
            each = hashes(split.cast(pa.binary())).reshape(batch.num_rows, -1)
            h = _phrase_hashes(hashes(batch.column("lang").cast(pa.binary())), list(each.T))
            at = h >> np.uint64(64 - bits)
            mask = np.uint64(1) << (at & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int32)), pa.array(mask.view(np.int64))], schema=want)

    rows = frequent.where("phrase != ''").mapInArrow(run, schema).groupBy("at").agg(F.bit_or("mask").alias("mask")).toArrow()
    words = np.zeros(max(1 << bits >> 6, 1), np.uint64)
    words[np.asarray(rows["at"])] = np.asarray(rows["mask"]).view(np.uint64)
    return BitFilter(words, bits)


_STREAM = "lang string, words array<string>, f bigint, firsts array<bigint>, rests array<bigint>, longer bigint"


class _Open:
    """A phrase whose extensions may still come."""

    __slots__ = ("row", "f", "longer")

    def __init__(self, row: tuple, f: int | None, longer: int = 0):
        self.row, self.f, self.longer = row, f, longer


def _starts_with(row: tuple, other: tuple) -> bool:
    return row[0] == other[0] and row[1][: len(other[1])] == other[1]


class Walk:
    """One pass over rows (lang, words, f, ...) in order; ``stack`` holds the beginnings of the last row.

    ``carried`` are the rows before the first one that it extends.
    """

    def __init__(self, carried: list[_Open] | None = None):
        self.stack = list(carried or [])
        self.first: tuple | None = None

    def take(self, row: tuple) -> tuple[list[_Open], list[int | None]]:
        """The phrases closed by ``row``, and the counts of its beginnings by length."""
        closed = []
        if self.first is None:
            self.first = row
            if not self.stack:  # edges are not known yet: stand-ins for the beginnings
                self.stack = [_Open((row[0], row[1][:k]), None) for k in range(1, len(row[1]))]
        while self.stack and not _starts_with(row, self.stack[-1].row):
            closed.append(self.stack.pop())
        counts = [o.f for o in self.stack]
        if self.stack:
            above = self.stack[-1]
            above.longer = max(above.longer, row[2])
        self.stack.append(_Open(row, row[2]))
        return closed, counts


def _edges(rows: DataFrame) -> dict[int, tuple[list[tuple], dict]]:
    """By partition: the beginnings of its first row that stand before it, with their counts,
    and what later partitions hold as extensions of the phrases open at its end."""
    schema = "pid int, kind string, lang string, words array<string>, f bigint, longer bigint"
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, pid, outside = Walk(), None, []
        for batch in batches:
            for at, *row in zip(*(c.to_pylist() for c in batch.columns)):
                pid = at
                closed, _ = walk.take((row[0], row[1], row[2]))
                outside += [o for o in closed if o.f is None]
        if pid is None:
            return
        out = [(pid, "first", *walk.first)[:5] + (0,)]
        out += [(pid, "above", *o.row[:2], 0, o.longer) for o in [*outside, *walk.stack] if o.f is None]
        out += [(pid, "open", *o.row[:2], o.f, 0) for o in walk.stack if o.f is not None]
        cols = zip(*out)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, want.types)], schema=want)

    found: dict[int, list] = {}
    for r in rows.select("pid", "lang", "words", "f").mapInArrow(run, schema).collect():
        found.setdefault(r.pid, []).append(r)
    order = sorted(found)
    edges: dict[int, tuple[list[tuple], dict]] = {}
    carried: list[tuple] = []
    for pid in order:
        first = next(r for r in found[pid] if r.kind == "first")
        carried = [c for c in carried if len(c[1]) < len(first.words) and _starts_with((first.lang, first.words), c)]
        edges[pid] = (carried, {})
        opened = sorted(((r.lang, r.words, r.f) for r in found[pid] if r.kind == "open"), key=lambda c: len(c[1]))
        last = opened[-1]
        carried = [c for c in carried if _starts_with(last, c)] + opened
    later: dict[tuple, int] = {}
    for pid in reversed(order):
        edges[pid] = (edges[pid][0], later)
        first = next(r for r in found[pid] if r.kind == "first")
        beyond = {k: n for k, n in later.items() if _starts_with((first.lang, first.words), (k[0], list(k[1])))}
        for r in found[pid]:
            if r.kind == "above":
                key = (r.lang, tuple(r.words))
                beyond[key] = max(beyond.get(key, 0), r.longer)
        later = beyond
    return edges


def _in_order(rows: DataFrame) -> DataFrame:
    """``rows`` in ranges by (lang, words), sorted within, with the number of the range."""
    placed = rows.repartitionByRange("lang", "words").sortWithinPartitions("lang", "words")
    return settle(placed.withColumn("pid", F.spark_partition_id()))


def with_beginnings(rows: DataFrame, into: str) -> DataFrame:
    """``rows`` (a stream of all frequent phrases) with the counts of each one's beginnings in
    column ``into`` and the greatest count of a one-word extension in ``longer``."""
    placed = _in_order(rows)
    edges = _edges(placed)
    names = ["lang", "words", "f", "firsts", "rests", "longer"]
    slot = names.index(into)
    want = arrow_schema(_STREAM)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk, later = None, {}
        out: list[tuple] = []

        def done(closed: list[_Open], more: dict) -> None:
            for o in closed:
                if len(o.row) > 3:
                    longer = max(o.row[5], o.longer, more.get((o.row[0], tuple(o.row[1])), 0))
                    out.append((*o.row[:5], longer))

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), want.types)], schema=want)
            out.clear()
            return made

        for batch in batches:
            for at, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if walk is None:
                    carried, later = edges[at]
                    walk = Walk([_Open(c, c[2]) for c in carried])
                closed, counts = walk.take(tuple(row))
                own = list(row)
                own[slot] = counts
                walk.stack[-1].row = tuple(own)
                done(closed, {})
            if len(out) > 10_000:
                yield batch_of()
        if walk is not None:
            done(walk.stack, later)
        if out:
            yield batch_of()

    return placed.select("pid", *names).mapInArrow(run, _STREAM)


def scored(stream: DataFrame, share: int) -> DataFrame:
    """(lang, phrase, a, l, r, score) of the phrases that no extension stands for.

    An occurrence inside a longer phrase is one inside the one-word extension that
    leads there, which is at least as frequent; so extensions by one word decide.
    """
    schema = "lang string, phrase string, a bigint, l bigint, r bigint, score bigint"
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for lang, words, a, firsts, rests, longer in zip(*(c.to_pylist() for c in batch.columns)):
                n = len(words)
                if n < 2 or 100 * longer >= share * a:
                    continue
                cuts = [(SCORE_SCALE * a // (firsts[k - 1] + rests[n - k - 1]), k) for k in range(1, n)]
                score, k = min(cuts)
                out.append((lang, " ".join(words), a, firsts[k - 1], rests[n - k - 1], score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), want.types)], schema=want)

    return stream.mapInArrow(run, schema)


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang",
    longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language.

    Null texts are empty; a null language is ``und`` and falls together with a language
    of that name. Repeated rows count each. Texts without words, and languages without a
    phrase of ``least`` occurrences, give no row; so does an empty table. Equal scores and
    counts are ordered by the bytes of the phrase. Other columns are ignored.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    known, stream, totals = None, None, None
    for size in range(1, longest + 1):
        counted = count_phrases(texts, size, known, least)
        if size == 1:
            totals = counted.where("phrase = ''").select("lang", F.col("f").alias("n"))
            counted = counted.where((F.col("phrase") != "") & (F.col("f") >= least))
        stream = counted if stream is None else stream.union(counted)
        if size < longest:
            if counted.isEmpty():
                break
            known = bit_filter(counted)
    none = F.array().cast("array<bigint>")
    rows = stream.select("lang", F.split("phrase", " ").alias("words"), "f", none.alias("firsts"), none.alias("rests"), F.lit(0).cast("bigint").alias("longer"))
    ahead = with_beginnings(rows, "firsts")
    back = with_beginnings(ahead.withColumn("words", F.reverse("words")), "rests")
    found = scored(back.withColumn("words", F.reverse("words")), share)
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(_PARTS))
    first = found.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best)))
    few = first.where(F.col("rank") <= top).drop("part", "rank")
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint"))
    out = sized_join(ranked.where(F.col("rank") <= top), totals, "lang", "inner")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
