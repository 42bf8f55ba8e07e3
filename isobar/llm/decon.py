"""Benchmark decontamination as a prefix-filtered join of word windows.

A window is ten consecutive words of a benchmark item (a shorter item is one window). Its
five-word shingles are put in order of rarity; a text that holds the window holds its
rarest shingle, so only that necessary prefix is looked up. A hit fixes where the window
would start; starts outside the text are bounded away, and the words in between are
compared one by one. A benchmark up to a checked size is an index that every task holds;
beyond, shingles of the texts and the windows' rarest ones meet in a shuffle join, so its
size never has to fit at once, on the driver or in a task.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from isobar.llm.common import arrow_schema, stored, text_slices, with_id, worker_store
from isobar.operators.joins import hot_shares, salted_join, sized_join

WINDOW, SHINGLE = 10, 5
#: Largest benchmark, in words and bytes, that is one broadcast index of some 60 MB.
BLOCK_WORDS, BLOCK_BYTES = 1_000_000, 16 << 20
_SEGMENT = 2_000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FILTER_BITS = 20

#: Bytes of words stay, A-Z lower-cased; every other ASCII byte ends a word.
_WORD_BYTES = bytes(
    c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256)
)


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_WORD_BYTES).split() if text else []


def _segments(benchmark: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Items cut into overlapping runs of words that hold the same windows."""
    schema = "item string, words array<binary>, n int, size bigint"
    want = arrow_schema(schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                words = words_of(text)
                rows = [words[a : a + _SEGMENT + WINDOW - 1] for a in range(0, max(len(words) - WINDOW + 1, min(len(words), 1)), _SEGMENT)]
                if rows:
                    yield pa.RecordBatch.from_pylist([{"item": item, "words": r, "n": len(r), "size": sum(map(len, r))} for r in rows], schema=want)

    return benchmark.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(cut, schema)


def _codes(ids: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit code of the run of ``k`` ids at each start; equal runs have equal codes."""
    code = ids[starts].astype(np.uint64)
    for j in range(1, k):
        code = (code ^ (code >> np.uint64(29))) * _MIX + ids[starts + j].astype(np.uint64)
    return (code ^ (code >> np.uint64(32))) * _MIX


class WindowIndex:
    """Windows of a benchmark under their rarest shingles."""

    def __init__(self, segments: list[tuple[str | None, list[bytes]]]):
        self.vocab: dict[bytes, int] = {}
        windows: dict[tuple[int, ...], set] = {}
        for item, words in segments:
            ids = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]
            size = min(WINDOW, len(ids))
            for a in range(len(ids) - size + 1):
                windows.setdefault(tuple(ids[a : a + size]), set()).add(item)
        self.items = [sorted(x for x in s if x is not None) for s in windows.values()]
        self.groups = []
        by_size: dict[int, list[int]] = {}
        keys = list(windows)
        for w, key in enumerate(keys):
            by_size.setdefault(len(key), []).append(w)
        parts: dict[int, list] = {}
        for size, members in by_size.items():
            k = min(SHINGLE, size)
            table = np.array([keys[w] for w in members], dtype=np.int64)
            rows = np.arange(len(table)) * size
            codes = np.stack([_codes(table.ravel(), rows + j, k) for j in range(size - k + 1)], axis=1)
            parts.setdefault(k, []).append((size, np.array(members), table, codes))
        for k, found in sorted(parts.items()):
            seen, count = np.unique(np.concatenate([c.ravel() for *_, c in found]), return_counts=True)
            for size, members, table, codes in found:
                rarity = count[np.searchsorted(seen, codes)].astype(np.uint64)
                # The rarest shingle; among equals the least code, which neighbouring windows share.
                least = np.where(rarity == rarity.min(1, keepdims=True), codes, np.uint64(2**64 - 1)).argmin(1)
                code = codes[np.arange(len(codes)), least]
                order = np.argsort(code, kind="stable")
                prefix, first = np.unique(code[order], return_index=True)
                maybe = np.zeros(1 << _FILTER_BITS, bool)
                maybe[prefix >> np.uint64(64 - _FILTER_BITS)] = True
                ends = np.append(first[1:], len(order))
                self.groups.append((k, size, members[order], table[order], least[order], prefix, first, ends, maybe))

    def matches(self, ids: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """(starts, windows, size) of every occurrence in ``ids``; 0 stands for other words."""
        known = np.concatenate([[0], np.cumsum(ids != 0)])
        coded: dict[int, tuple] = {}
        for k, size, members, table, offsets, prefix, first, ends, maybe in self.groups:
            if len(ids) < size:
                continue
            if k not in coded:
                whole = np.flatnonzero(known[k:] - known[:-k] == k)
                coded[k] = whole, _codes(ids, whole, k)
            whole, code = coded[k]
            near = np.flatnonzero(maybe[code >> np.uint64(64 - _FILTER_BITS)])
            at = np.searchsorted(prefix, code[near])
            at[at == len(prefix)] = 0
            same = prefix[at] == code[near]
            place, at = whole[near[same]], at[same]
            for lo in range(0, len(at), 1 << 14):  # bounded candidate blocks
                a, p = at[lo : lo + (1 << 14)], place[lo : lo + (1 << 14)]
                n = ends[a] - first[a]
                row = np.repeat(first[a] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                start = np.repeat(p, n) - offsets[row]
                fits = (start >= 0) & (start + size <= len(ids))
                start, row = start[fits], row[fits]
                for j in range(size):
                    ok = ids[start + j] == table[row, j]
                    start, row = start[ok], row[ok]
                if len(start):
                    yield start, members[row], size


def _hits(texts: list[str | None], index: WindowIndex) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: its number of words, hit spans of words, and items that occur."""
    get = index.vocab.get
    ids, starts, sizes = [], [], []
    for text in texts:
        words = words_of(text)
        starts.append(len(ids))
        sizes.append(len(words))
        ids += [get(w, 0) for w in words]
        ids.append(0)  # no window reaches over the end of a text
    ids, starts = np.array(ids, np.int32), np.array(starts)
    out = [(n, [], set()) for n in sizes]
    cover = np.zeros(len(ids) + 1, np.int32)
    for at, windows, size in index.matches(ids):
        np.add.at(cover, at, 1)
        np.add.at(cover, at + size, -1)
        doc = np.searchsorted(starts, at, "right") - 1
        pairs = np.unique(np.stack([doc, windows], axis=1), axis=0)
        for d, w in pairs.tolist():
            out[d][2].update(index.items[w])
    edge = np.diff(np.concatenate([[0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]]))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(starts, begin, "right") - 1
    for d, a, b in zip(doc.tolist(), begin.tolist(), end.tolist()):
        out[d][1].append((a - int(starts[d]), b - int(starts[d])))
    return out


def _joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _row_digest(text: str | None) -> str:
    return hashlib.md5((text or "").encode()).hexdigest()


def _hashes(words: list[bytes]) -> np.ndarray:
    """A 64-bit hash of each word; equal words are hashed once."""
    of = {w: xxhash.xxh64_intdigest(w) for w in set(words)}
    return np.array([of[w] for w in words], np.uint64)


def _windows(segments: DataFrame) -> DataFrame:
    """(wid, item, size, words, codes) of every window; ``codes`` are those of its shingles."""
    schema = "wid string, item string, size int, words array<binary>, codes array<bigint>"
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                size = min(WINDOW, len(words))
                k = min(SHINGLE, size)
                codes = _codes(_hashes(words), np.arange(len(words) - k + 1), k).view(np.int64)
                rows = []
                for a in range(len(words) - size + 1):
                    own = words[a : a + size]
                    wid = hashlib.md5(b" ".join(own)).hexdigest()
                    rows.append({"wid": wid, "item": item, "size": size, "words": own, "codes": codes[a : a + size - k + 1].tolist()})
                yield pa.RecordBatch.from_pylist(rows, schema=want)

    return segments.select("item", "words").mapInArrow(run, schema)


def _prefixes(wins: DataFrame) -> DataFrame:
    """(code, at, wid, size, words): every window under its rarest shingle, ties to the least code."""
    each = wins.select("wid", F.posexplode("codes").alias("at", "code"))
    rarity = each.groupBy("code").agg(F.count(F.lit(1)).alias("n"))
    ranked = sized_join(each, rarity, "code", "inner").groupBy("wid").agg(F.min(F.struct("n", "code", "at")).alias("p"))
    return ranked.join(wins.select("wid", "size", "words"), "wid").select("p.code", "p.at", "wid", "size", "words")


def _code_filter(prefix: DataFrame) -> tuple[np.ndarray, int]:
    """Bits of the codes' leading digits, 2^27 at most: when full it prunes less."""
    bits = int(np.clip(np.ceil(np.log2(8 * max(prefix.count(), 1))), _FILTER_BITS, 27))
    place = F.shiftrightunsigned("code", 64 - bits)
    cells = prefix.select(F.shiftright(place, 6).alias("cell"), (place % 64).cast("int").alias("bit"))
    found = cells.groupBy("cell").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("word")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[found["cell"].to_numpy()] = found["word"].to_numpy().view(np.uint64)
    return words, bits


def _find_dealt(rows: DataFrame, segments: DataFrame) -> DataFrame:
    """The join for a benchmark of any size: shingles of texts and windows meet in a shuffle.

    Texts send only the shingles that pass a bit filter of the prefixes, each with the words
    around it, so a window is verified where they meet. Equal texts send them once.
    """
    spark = rows.sparkSession
    windows = stored(_windows(segments), "windows")
    prefix = stored(_prefixes(windows.drop("item").dropDuplicates(["wid"])), "prefixes")
    owners = windows.where("item is not null").select("wid", "item").distinct()
    lengths = sorted(r[0] for r in prefix.select(F.least("size", F.lit(SHINGLE))).distinct().collect())
    sent = spark.sparkContext.broadcast(_code_filter(prefix))

    counted_as = with_id(rows.schema["id"].dataType, "n_words bigint, digest string")
    counted_want = arrow_schema(counted_as)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1):
            texts = part.column(1).to_pylist()
            cols = [pa.array([len(words_of(t)) for t in texts], pa.int64()), pa.array([_row_digest(t) for t in texts])]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], schema=counted_want)

    near_as = "digest string, code bigint, place bigint, lead int, run array<binary>"
    near_want = arrow_schema(near_as)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maybe, bits = sent.value
        for part in text_slices(batches, 0):
            for text in part.column(0).to_pylist():
                words = words_of(text)
                ids = _hashes(words)
                for k in lengths:
                    if len(words) < k:
                        break
                    codes = _codes(ids, np.arange(len(words) - k + 1), k)
                    at = codes >> np.uint64(64 - bits)
                    hit = np.flatnonzero(maybe[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1))
                    for lo in range(0, len(hit), 4096):
                        some = hit[lo : lo + 4096]
                        lead = np.minimum(some, WINDOW - 1)
                        runs = [words[p - b : p + WINDOW] for p, b in zip(some.tolist(), lead.tolist())]
                        cols = [[_row_digest(text)] * len(some), codes[some].view(np.int64), some, lead, runs]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, near_want)], schema=near_want)

    counted = stored(rows.mapInArrow(count, counted_as), "counted")
    sought = stored(rows.select("text").mapInArrow(near, near_as).distinct(), "near")
    met = salted_join(sought, prefix, "code", hot_shares(sought, "code"), "inner").where("lead >= at")
    same = F.slice("run", F.greatest(F.col("lead") - F.col("at") + 1, F.lit(1)), F.col("size")) == F.col("words")
    begin = F.col("place") - F.col("at")
    found = stored(met.where(same).select("digest", "wid", begin.cast("int").alias("start"), (begin + F.col("size")).cast("int").alias("end")).distinct(), "found")

    spans_as = "digest string, spans array<struct<start:int,end:int>>"
    spans_want = arrow_schema(spans_as)

    def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for digest, spans in zip(*(c.to_pylist() for c in batch.columns)):
                whole = [{"start": a, "end": b} for a, b in _joined([(x["start"], x["end"]) for x in spans])]
                yield pa.RecordBatch.from_pylist([{"digest": digest, "spans": whole}], schema=spans_want)

    spans = found.groupBy("digest").agg(F.collect_set(F.struct("start", "end")).alias("spans")).mapInArrow(join_spans, spans_as)
    held = stored(found.select("digest", "wid").distinct(), "held")
    named = salted_join(held, owners, "wid", hot_shares(held, "wid"), "inner")
    items = named.groupBy("digest").agg(F.array_sort(F.collect_set("item")).alias("items"))
    hits = spans.join(items, "digest", "left")
    whole = salted_join(counted, hits, "digest", hot_shares(counted, "digest"), "left")
    none = "cast(array() as {})".format
    return whole.select(
        "id", "n_words", F.coalesce("spans", F.expr(none("array<struct<start:int,end:int>>"))).alias("spans"),
        F.coalesce("items", F.expr(none("array<string>"))).alias("items"),
    )


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, n_words, spans, items) per row of ``docs``: hit word spans and occurring items.

    Null texts have no words; null and empty items hold no window. Rows with a null or
    repeated id stay rows of their own. An item with a null id hits words but is not named
    among ``items``; items that share an id count once. Extra columns are not read. A
    benchmark beyond ``BLOCK_WORDS`` words or ``BLOCK_BYTES`` is joined by a shuffle.
    """
    segments = _segments(benchmark, item_col, item_text_col)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    total = segments.agg(F.sum("n").alias("n"), F.sum("size").alias("size")).first()
    if (total["n"] or 0) > BLOCK_WORDS or (total["size"] or 0) > BLOCK_BYTES:
        return _find_dealt(rows, segments).withColumnRenamed("id", id_col)
    schema = with_id(docs.schema[id_col].dataType, "n_words bigint, spans array<struct<start:int,end:int>>, items array<string>")
    want = arrow_schema(schema)
    key = uuid.uuid4().hex
    sent = docs.sparkSession.sparkContext.broadcast([(r["item"], [bytes(w) for w in r["words"]]) for r in segments.collect()])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store = worker_store()
        if store.get("decon key") != key:
            store["decon index"], store["decon key"] = WindowIndex(sent.value), key
        for part in text_slices(batches, 1):
            found = _hits(part.column(1).to_pylist(), store["decon index"])
            hits = [
                pa.array([n for n, _, _ in found], pa.int64()),
                pa.array([[{"start": a, "end": b} for a, b in s] for _, s, _ in found], want.field("spans").type),
                pa.array([sorted(i) for _, _, i in found], want.field("items").type),
            ]
            yield pa.RecordBatch.from_arrays([part.column(0), *hits], schema=want)

    return rows.mapInArrow(scan, schema).withColumnRenamed("id", id_col)


def hit_words() -> Column:
    return F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
