"""Language ID by prediction with partial matching.

Each language has a context tree over bytes up to ``order``. A byte's code length is that
of its longest seen context; a byte not seen there pays the escape of that context (as
many as distinct followers, method C) and is coded one order lower, at last as one of 256.
The trees are counted once and then frozen, so that the code length of a text is a sum of
table entries. The language with the shortest code wins.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StructType

from isobar.llm.common import arrow_schema, text_slices

ORDER = 3
#: Training characters per language, at most about so many; the model is a fit on this sample.
SAMPLE_CHARS = 2_000_000
#: Texts are sampled in pieces of so many characters, fewer where the sample is small.
PIECE_CHARS = 1_000
_START = b"\n"
_LETTER = regex.compile(r"\p{L}")
_MIX = np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """Row numbers of distinct 64-bit keys by open addressing, for whole arrays at once."""

    def __init__(self, keys: np.ndarray):
        bits = max(int(2 * len(keys)).bit_length(), 4)
        self.shift, self.mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self.slots = np.full(1 << bits, -1, np.int32)
        self.keys = keys
        left = np.arange(len(keys), dtype=np.int32)
        at = self._home(keys)
        while len(left):
            free = self.slots[at] < 0
            self.slots[at[free]] = left[free]
            lost = self.slots[at] != left
            left, at = left[lost], (at[lost] + np.uint64(1)) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys * _MIX) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), -1, np.int32)
        at = self._home(keys)
        row = self.slots[at]
        open_ = np.flatnonzero((row >= 0) & (self.keys[row] != keys))
        while len(open_):
            at[open_] = (at[open_] + np.uint64(1)) & self.mask
            row[open_] = self.slots[at[open_]]
            r = row[open_]
            open_ = open_[(r >= 0) & (self.keys[r] != keys[open_])]
        return row


def _packed(data: np.ndarray, places: np.ndarray, length: int) -> np.ndarray:
    """The ``length`` bytes that end at each place, as one number."""
    key = np.zeros(len(places), np.uint64)
    for back in range(length - 1, -1, -1):
        key = key << np.uint64(8) | data[places - back]
    return key


def _laid_out(texts: list[bytes], order: int, before: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes with start contexts (or the ``order`` bytes ``before``) between; the places of the texts' bytes; sizes."""
    before = [_START * order] * len(texts) if before is None else before
    data = np.frombuffer(b"".join(b + t for b, t in zip(before, texts)), np.uint8).astype(np.uint64)
    sizes = np.array([len(t) for t in texts], np.int64)
    places = np.arange(sizes.sum()) + order * np.repeat(np.arange(1, len(texts) + 1), sizes)
    return data, places, sizes


@dataclass
class Model:
    """Frozen code lengths (bits) by n-gram and language."""

    langs: list[str]
    order: int
    grams: list[KeyTable]  # by length - 1
    costs: list[np.ndarray]  # bits of a gram's last byte after the rest
    contexts: list[KeyTable]  # by length, of contexts that have followers
    escapes: list[np.ndarray]

    @classmethod
    def fit(cls, langs: list[str], order: int, counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
        """``counts``: per gram length the distinct keys and their counts by language."""
        grams, costs, contexts, escapes = [], [], [], []
        for length, (keys, n) in enumerate(counts, 1):
            prefix = keys >> np.uint64(8)
            own, where = np.unique(prefix, return_inverse=True)
            total, kinds = np.zeros((len(own), len(langs))), np.zeros((len(own), len(langs)))
            np.add.at(total, where, n)
            np.add.at(kinds, where, n > 0)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                seen = -np.log2(n / (total + kinds)[where])
            if length == 1:
                lower = np.full(n.shape, 8.0)
            else:
                lower = costs[-1][grams[-1].find(keys & np.uint64((1 << 8 * (length - 1)) - 1))]
            grams.append(KeyTable(keys))
            costs.append(np.where(n > 0, seen, escape[where] + lower).astype(np.float32))
            contexts.append(KeyTable(own))
            escapes.append(escape.astype(np.float32))
        return cls(langs, order, grams, costs, contexts, escapes)

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Code length of every text in every language."""
        out = np.zeros((len(texts), len(self.langs)))
        data, places, sizes = _laid_out(texts, self.order)
        if not len(places):
            return out
        cost = np.zeros((len(places), len(self.langs)), np.float32)
        left = np.arange(len(places))
        for length in range(self.order + 1, 0, -1):
            key = _packed(data, places[left], length)
            row = self.grams[length - 1].find(key)
            hit = row >= 0
            if length == self.order + 1:
                cost[hit] = self.costs[length - 1][row[hit]]
            else:
                cost[left[hit]] += self.costs[length - 1][row[hit]]
            left, key = left[~hit], key[~hit]
            if not len(left):
                break
            context = self.contexts[length - 1].find(key >> np.uint64(8))
            known = context >= 0
            cost[left[known]] += self.escapes[length - 1][context[known]]
        cost[left] += 8.0
        full = np.flatnonzero(sizes)
        starts = np.concatenate([[0], np.cumsum(sizes)])[full]
        out[full] = np.add.reduceat(cost, starts, axis=0, dtype=np.float64)
        return out


def train(docs: DataFrame, lang_col: str, text_col: str, order: int = ORDER, sample_chars: int = SAMPLE_CHARS) -> Model:
    """Count the trees on a bounded sample of labelled rows.

    Rows with a null language or text teach nothing, and equal texts of a language teach
    once. Of a language with more than ``sample_chars`` characters in distinct texts, pieces
    of texts are taken by a hash of text and place, at the rate that gives about that many;
    a piece is counted after the bytes before it. The counts by gram come to the driver;
    the sample bounds their number.
    """
    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null and text is not null")
    rows = rows.withColumns({"h": F.xxhash64("text"), "n": F.length("text")})
    distinct = rows.groupBy("lang", "h").agg(F.max("n").cast("bigint").alias("n"))
    sizes = {r["lang"]: r["n"] for r in distinct.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    # A language whose texts are all empty has taught nothing.
    langs = sorted(lang for lang, n in sizes.items() if n)
    rate = F.lit(1.0)
    for lang in langs:
        rate = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_chars / max(sizes[lang], 1)))).otherwise(rate)
    piece = max(min(PIECE_CHARS, sample_chars // 100), 1)
    places = F.sequence(F.lit(0), F.floor((F.col("n") - 1) / piece).cast("int"))
    drawn = rows.where("n > 0").withColumn("rate", rate * (1 << 30)).select(
        "lang", "text", "h", F.filter(places, lambda i: F.pmod(F.xxhash64("h", i), F.lit(1 << 30)) < F.col("rate")).alias("at")
    )
    cut_schema = "lang string, h bigint, at int, before binary, piece binary"
    cut_want = arrow_schema(cut_schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1):
            out = []
            for lang, text, h, at in zip(*(c.to_pylist() for c in part.columns)):
                for i in at:
                    since = i * piece
                    before = _START * order + text[max(since - order, 0) : since].encode()
                    out.append((lang, h, i, before[len(before) - order :], text[since : since + piece].encode()))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), cut_want)], schema=cut_want)

    pieces = drawn.where(F.size("at") > 0).mapInArrow(cut, cut_schema)
    taken = pieces.dropDuplicates(["lang", "h", "at"]).select("lang", "piece", "before")
    schema = "lang string, length int, gram bigint, n bigint"
    want = arrow_schema(schema)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1, 4 << 20):
            by_lang: dict[str, tuple[list[bytes], list[bytes]]] = {}
            for lang, text, ahead in zip(*(c.to_pylist() for c in part.columns)):
                own = by_lang.setdefault(lang, ([], []))
                own[0].append(text)
                own[1].append(ahead)
            for lang, (texts, before) in by_lang.items():
                data, places, _ = _laid_out(texts, order, before)
                for length in range(1, order + 2):
                    key, n = np.unique(_packed(data, places, length), return_counts=True)
                    cols = [pa.array([lang] * len(key), pa.string()), pa.array([length] * len(key), pa.int32()), pa.array(key.astype(np.int64)), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(cols, schema=want)

    summed = taken.mapInArrow(count, schema).groupBy("lang", "length", "gram").agg(F.sum("n").alias("n")).toArrow()
    lang = np.array([langs.index(x) for x in summed["lang"].to_pylist()], np.int64)
    length, gram, n = (summed[c].to_numpy() for c in ("length", "gram", "n"))
    counts = []
    for k in range(1, order + 2):
        at = length == k
        keys, where = np.unique(gram[at].astype(np.uint64), return_inverse=True)
        table = np.zeros((len(keys), len(langs)))
        np.add.at(table, (where, lang[at]), n[at])
        counts.append((keys, table))
    return Model.fit(langs, order, counts)


def predict(docs: DataFrame, model: Model, id_col: str, text_col: str, carry: dict[str, Column] | None = None) -> DataFrame:
    """(id, carried columns, lang_pred, score) per row of ``docs``.

    ``score`` is the language's posterior when all are equally likely at first. A text
    that is null or has no letter is ``und`` with score 0, and so is every text where the
    model knows no language. Equal code lengths: the first name wins. Whole texts count;
    repeated rows and null ids stay; other columns are not read.
    """
    rows = docs.select(F.col(text_col).alias("text"), F.col(id_col).alias(id_col), *[c.alias(n) for n, c in (carry or {}).items()])
    fields = [f for f in rows.schema.fields if f.name != "text"] if "text" != id_col else rows.schema.fields[1:]
    schema = StructType([*fields, *StructType.fromDDL("lang_pred string, score double").fields])
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 0):
            texts = part.column(0).to_pylist()
            has = [bool(t) and _LETTER.search(t) is not None and bool(model.langs) for t in texts]
            lang, score = ["und"] * len(texts), [0.0] * len(texts)
            if any(has):
                bits = model.bits([t.encode() for t, h in zip(texts, has) if h])
                best = bits.argmin(1)
                weight = np.exp2(bits.min(1, keepdims=True) - bits)
                sure = 1.0 / weight.sum(1)
                for i, b, s in zip(np.flatnonzero(has).tolist(), best.tolist(), sure.tolist()):
                    lang[i], score[i] = model.langs[b], s
            yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(lang), pa.array(score)], schema=want)

    return rows.mapInArrow(run, schema)
