"""Byte-level BPE by a rank queue under a hierarchical bitmap.

A pre-token's bytes form a linked list. Every adjacent pair that is a token waits in the
bucket of its rank, which holds list positions; a three-level bitmap over the ranks finds
the next rank by find-first-set. Entries whose pair has changed are skipped. One pre-token
of n bytes takes O(n) queue steps, however long it is; pre-tokens not met before share one
queue, a slice of texts at a time.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterator
from itertools import chain, islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType, StructType

from isobar.llm.common import arrow_schema, text_slices, with_id, worker_store

#: What one worker remembers between slices, each of two caches: pieces of at most so many
#: characters, and so many characters in all. Longer pieces are encoded anew; speed only.
CACHE_PIECE, CACHE_CHARS = 64, 4_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class RankQueue:
    """Buckets of positions by rank, with a bitmap of 64-way levels over them."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[int]] = {}
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0

    def push(self, rank: int, at: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(at)
            return
        self.buckets[rank] = [at]
        a = rank >> 6
        if not self.low[a]:
            self.mid[rank >> 12] |= 1 << (a & 63)
            self.top |= 1 << (rank >> 12)
        self.low[a] |= 1 << (rank & 63)

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank with its positions, ascending."""
        top = self.top
        if not top:
            return None
        b = (top & -top).bit_length() - 1
        mid = self.mid[b]
        a = b << 6 | (mid & -mid).bit_length() - 1
        low = self.low[a]
        rank = a << 6 | (low & -low).bit_length() - 1
        self.low[a] = low = low & (low - 1)
        if not low:
            self.mid[b] = mid = mid & (mid - 1)
            if not mid:
                self.top = top & (top - 1)
        bucket = self.buckets.pop(rank)
        bucket.sort()
        return rank, bucket


def merge_all(pieces: list[bytes], ranks: dict[bytes, int], pairs: list[int | None]) -> list[list[int]]:
    """Token ids of each piece: lowest rank first, leftmost among equals.

    The pieces lie one after another in one linked list that no pair crosses, and share
    one queue. ``pairs`` has the rank of every two bytes, if any.
    """
    data = b"".join(pieces)
    n = len(data)
    edge = bytearray(n + 1)  # where a piece begins, or the end
    at = 0
    for piece in pieces:
        edge[at] = 1
        at += len(piece)
    edge[n] = 1
    get = ranks.get
    after = list(range(1, n + 1))  # start of the next part
    before = list(range(-1, n - 1))
    waits = [None if e else pairs[x << 8 | y] for x, y, e in zip(data, data[1:], edge[1:])]  # rank of the pair that starts here
    waits.append(None)
    queue = RankQueue(max(ranks.values(), default=0))
    push, buckets = queue.push, queue.buckets
    for i, rank in enumerate(waits):
        if rank is not None:
            push(rank, i)
    while popped := queue.pop():
        rank, bucket = popped
        for k, i in enumerate(bucket):
            if waits[i] != rank:
                continue  # stale: the pair has changed since
            gone = after[i]
            end = after[gone]
            waits[gone] = None
            after[i] = end
            least = rank
            if edge[end]:
                waits[i] = None
                if end < n:
                    before[end] = i
            else:
                before[end] = i
                waits[i] = r = get(data[i : after[end]])
                if r is not None:
                    if r in buckets:
                        buckets[r].append(i)
                    else:
                        push(r, i)
                    if r < least:
                        least = r
            if not edge[i]:
                p = before[i]
                waits[p] = r = get(data[p:end])
                if r is not None:
                    if r in buckets:
                        buckets[r].append(p)
                    else:
                        push(r, p)
                    if r < least:
                        least = r
            if least < rank:  # an earlier pair has come up: take it in turn
                for j in bucket[k + 1 :]:
                    if waits[j] == rank:
                        push(rank, j)
                break
    out, i = [], 0
    for piece in pieces:
        end, ids = i + len(piece), []
        while i < end:
            ids.append(ranks[data[i : after[i]]])
            i = after[i]
        out.append(ids)
    return out


class Codec:
    """Encoder and decoder for one rank file and split pattern; no special tokens."""

    #: A space between two non-spaces always starts a pre-token, so text is cut there first.
    _CUT = regex.compile(r"(?<=\P{White_Space}) (?=\P{White_Space})")
    _ODD = regex.compile(r" \p{White_Space}|\p{White_Space} |^\p{White_Space}|\p{White_Space}$")

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.text_of = [str(i) for i in range(len(self.bytes_of))]
        self.pairs = [ranks.get(bytes((x, y))) for x in range(256) for y in range(256)]
        # White space is Unicode's property in every engine that shares these files.
        for short, full in ((r"[^\s", r"[^\p{White_Space}"), (r"\s", r"\p{White_Space}"), (r"\S", r"\P{White_Space}")):
            pattern = pattern.replace(short, full)
        self.split = regex.compile(pattern).findall
        self.pre_tokens: dict[str, list[int]] = {}
        self.chunks: dict[str, list[int]] = {}
        self.held = [0, 0]  # characters in each of the two

    def _pieces(self, text: str) -> list[str]:
        if not text:
            return []
        first, *rest = text.split(" ") if self._ODD.search(text) is None else self._CUT.split(text)
        return [first, *[" " + c for c in rest]]

    def _learn(self, missing: set[str]) -> None:
        """Ids of the chunks in ``missing``, whose new pre-tokens are merged together."""
        known, ranks = self.pre_tokens, self.ranks
        split = {chunk: self.split(chunk) for chunk in missing}
        new = []
        for piece in set(chain.from_iterable(split.values())).difference(known):
            data = piece.encode()
            whole = ranks.get(data)
            if whole is None:
                new.append((piece, data))
            else:
                known[piece] = [whole]
        if new:
            for (piece, _), ids in zip(new, merge_all([d for _, d in new], ranks, self.pairs)):
                known[piece] = ids
        for chunk, parts in split.items():
            self.chunks[chunk] = known[parts[0]] if len(parts) == 1 else list(chain.from_iterable([known[p] for p in parts]))

    @staticmethod
    def _trim(cache: dict[str, list[int]], before: int, held: int) -> int:
        """Forget long pieces and those beyond the bound; the characters held now.

        ``before`` pieces of ``held`` characters were kept by the last call. Pieces seen
        first stay, among them the frequent ones.
        """
        for piece in list(islice(cache, before, None)):
            if len(piece) > CACHE_PIECE or held + len(piece) > CACHE_CHARS:
                del cache[piece]
            else:
                held += len(piece)
        return held

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text. The texts are held together: give bounded slices."""
        cut = [self._pieces(t or "") for t in texts]
        sizes = len(self.pre_tokens), len(self.chunks)
        if missing := set(chain.from_iterable(cut)).difference(self.chunks):
            self._learn(missing)
        get = self.chunks.__getitem__
        out = [list(chain.from_iterable(map(get, pieces))) for pieces in cut]
        self.held = [self._trim(c, n, h) for c, n, h in zip((self.pre_tokens, self.chunks), sizes, self.held)]
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def digests(self, ids: list[int]) -> tuple[int, str, str]:
        joined = ",".join(map(self.text_of.__getitem__, ids)).encode()
        return len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(self.decode(ids)).hexdigest()


def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process; the rank file is read where the task runs."""
    store, key = worker_store(), f"bpe {path} {pattern}"
    if key not in store:
        store[key] = Codec(read_ranks(path), pattern)
    return store[key]


def _mapped(df: DataFrame, schema: StructType, rows: Callable[[Codec, list], list[tuple]], path: str, pattern: str) -> DataFrame:
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in batches:
            cols = list(zip(*rows(own, part.column(1).to_pylist())))
            arrays = [part.column(0), *(pa.array(c, f.type) for c, f in zip(cols, list(want)[1:]))]
            yield pa.RecordBatch.from_arrays(arrays, schema=want)

    def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return run(text_slices((b for b in batches if b.num_rows), 1, 4 << 20))

    return df.mapInArrow(sliced, schema)


def _texts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataType]:
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), df.schema[id_col].dataType


def encode(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """(id, n_tokens, ids array<int>, decoded_sha256), one row per input row.

    ``decoded_sha256`` is the digest of the bytes that the ids decode to. Null and empty
    texts have no ids. Whole texts are encoded, repeated rows and null ids stay, extra
    columns are not read.
    """
    rows, kind = _texts(df, id_col, text_col)

    def work(own: Codec, texts: list[str | None]) -> list[tuple]:
        return [(len(ids), ids, hashlib.sha256(own.decode(ids)).hexdigest()) for ids in own.encode_all(texts)]

    return _mapped(rows, with_id(kind, "n_tokens bigint, ids array<int>, decoded_sha256 string"), work, path, pattern).withColumnRenamed("id", id_col)


def decode(df: DataFrame, id_col: str, ids_col: str, path: str, pattern: str) -> DataFrame:
    """(id, decoded binary) of ids made by ``encode``; null ids give empty bytes."""
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    schema = with_id(df.schema[id_col].dataType, "decoded binary")
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern)
        for part in batches:
            back = [own.decode(ids or []) for ids in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(back, pa.binary())], schema=want)

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def round_trip(df: DataFrame, id_col: str, text_col: str, path: str, pattern: str) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests of ``encode`` and ``decode`` in one pass."""
    rows, kind = _texts(df, id_col, text_col)
    schema = with_id(kind, "n_tokens bigint, ids_sha256 string, decoded_sha256 string")
    return _mapped(rows, schema, lambda own, texts: [own.digests(ids) for ids in own.encode_all(texts)], path, pattern).withColumnRenamed("id", id_col)
