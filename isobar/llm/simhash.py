"""SimHash near-duplicates by bit-sliced comparison.

Fingerprints come from word shingles. By the pigeonhole principle two fingerprints within
the radius agree in some choice of bit fields; those fields are the bucket keys. Inside a
bucket the fingerprints stand vertically: word p of a block holds bit p of 64 of them. A
query's differences are added plane by plane into carry-save counters, 64 distances at a
time, and a block is left as soon as all of its distances exceed the radius.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from isobar.llm.common import arrow_schema, stored, text_slices, with_id
from isobar.llm.components import Forest, components, in_blocks

SEED = 42
BITS = 64
BLOCK = 2_048
#: Mean rows of a bucket that the choice of keys aims at.
MEAN_BUCKET = 16

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))


def fingerprint(text: str | None, shingle: int, seed: int = SEED) -> int:
    """The 64-bit fingerprint of one text; 0 for no words.

    Words are runs without space and \\t\\n\\v\\f\\r; fewer words than a shingle give one
    shingle. A bit is set if more than half of the shingles' hashes have it, with repeats.
    """
    if not text:
        return 0
    words = text.encode().translate(_LOWER).split()
    if not words:
        return 0
    hash_of = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash_of(b" ".join(words), seed)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[: len(words) - shingle] + 1])
    hashes = np.array([hash_of(line[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist())], np.uint64)
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(id, fp bigint) per row; null texts have no words."""
    schema = with_id(docs.schema[id_col].dataType, "fp bigint")
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1, 4 << 20):
            fps = np.array([fingerprint(t, shingle) for t in part.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fps.view(np.int64))], schema=want)

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, schema)


def field_masks(radius: int, n: int) -> list[int]:
    """Masks of which two fingerprints within ``radius`` agree on at least one.

    The bits are cut into radius + k fields; within the radius, k of them agree. k grows
    with the number of rows until the mean bucket is small.
    """
    for k in range(1, 5):
        cuts = [BITS * f // (radius + k) for f in range(radius + k + 1)]
        masks = [sum((1 << cuts[f + 1]) - (1 << cuts[f]) for f in some) for some in combinations(range(radius + k), k)]
        if n <= MEAN_BUCKET << min(m.bit_count() for m in masks):
            break
    return masks


def planes(fps: np.ndarray) -> np.ndarray:
    """(blocks, 64): word p of a block holds bit p of its 64 fingerprints."""
    blocks = -(-len(fps) // 64)
    whole = np.zeros(blocks * 64, np.uint64)
    whole[: len(fps)] = fps
    bits = np.unpackbits(whole.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")  # row: fingerprint
    slices = np.packbits(bits.reshape(blocks, 64, 64).transpose(0, 2, 1), axis=2, bitorder="little")
    return np.ascontiguousarray(slices).view(np.uint64).reshape(blocks, 64)


def within(queries: np.ndarray, blocks: np.ndarray, used: np.ndarray, radius: int) -> np.ndarray:
    """For each (query, block) the lanes, among ``used``, at distance ``radius`` or less.

    Carry-save: one bit of every counter per word, least significant first.
    """
    out = np.zeros(len(queries), np.uint64)
    levels = radius.bit_length()
    live = np.arange(len(queries))
    counters = [np.zeros(len(queries), np.uint64) for _ in range(levels)]
    over = ~used
    ones = np.uint64(2**64 - 1)
    limit = [bool(radius >> k & 1) for k in range(levels)]
    for p in range(BITS):
        carry = blocks[:, p] ^ ((queries >> np.uint64(p) & np.uint64(1)) * ones)
        for k in range(levels):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if p % 8 == 7:
            # counter > radius, from the highest bit down
            more, same = np.zeros_like(over), np.full_like(over, ones)
            for k in reversed(range(levels)):
                if limit[k]:
                    same &= counters[k]
                else:
                    more |= same & counters[k]
                    same &= ~counters[k]
            over |= more
            stay = np.flatnonzero(over != ones)
            if len(stay) < len(over):
                live, queries, blocks, over = live[stay], queries[stay], blocks[stay], over[stay]
                counters = [c[stay] for c in counters]
            if not len(live):
                return out
    out[live] = ~over
    return out


def bucket_links(fps: np.ndarray, group: np.ndarray, side: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (row, root row) that keep the components of the pairs within the radius.

    Rows of a group stand together. ``side`` is 0 or 1 for the blocks of a pair task and 2
    where a task has one block; sides 0 and 0 or 1 and 1 are other tasks' work.
    """
    n = len(fps)
    forest = Forest(n)
    begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    size = np.diff(np.append(begin, n))
    words = -(-size // 64)
    word_of = np.concatenate([[0], np.cumsum(words)])
    # lay the rows out so that every group starts a new word
    place = np.arange(n) - np.repeat(begin, size) + 64 * np.repeat(word_of[:-1], size)
    spread, lane, sides = np.zeros(64 * word_of[-1], np.uint64), np.full(64 * word_of[-1], -1), np.zeros(64 * word_of[-1], np.uint8)
    spread[place], lane[place], sides[place] = fps, np.arange(n), side
    sliced = planes(spread)
    bit = np.uint64(1) << np.arange(64, dtype=np.uint64)
    taken = {s: ((sides.reshape(-1, 64) != s) & (lane.reshape(-1, 64) >= 0)) @ bit for s in (0, 1, 3)}
    mine = np.repeat(np.arange(len(begin)), size)
    per_row = words[mine]
    at, total = 0, np.concatenate([[0], np.cumsum(per_row)])
    while at < n:
        upto = max(int(np.searchsorted(total, total[at] + (1 << 17), "right")) - 1, at + 1)
        rows = np.repeat(np.arange(at, upto), per_row[at:upto])
        block = np.arange(len(rows)) - np.repeat(total[at:upto] - total[at], per_row[at:upto]) + word_of[mine[rows]]
        used = np.where(side[rows] == 2, taken[3][block], np.where(side[rows] == 0, taken[0][block], taken[1][block]))
        lanes = within(fps[rows], sliced[block], used, radius)
        some = np.flatnonzero(lanes)
        for lo in range(0, len(some), 1 << 14):
            part = some[lo : lo + (1 << 14)]
            hit, which = np.nonzero(lanes[part][:, None] & bit)
            forest.link(rows[part][hit], lane[64 * block[part][hit] + which])
        at = upto
    tied = np.flatnonzero(forest.up != np.arange(n))
    return tied, forest.up[tied]


def links(fps: DataFrame, radius: int, n: int) -> DataFrame:
    """(a, b): links among the distinct fingerprints ``fp`` that keep all components."""
    masks = field_masks(radius, n)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in signed])).alias("m", "key"))
    dealt = in_blocks(keyed, ["m", "key"], F.xxhash64("fp"), BLOCK)
    tasks = dealt.repartition("m", "key", "i", "j").sortWithinPartitions("m", "key", "i", "j")
    schema = "a bigint, b bigint"
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None

        def compared(cols: dict[str, np.ndarray], change: np.ndarray) -> pa.RecordBatch:
            group = np.cumsum(change)
            side = np.where(cols["i"] == cols["j"], 2, (cols["own"] != cols["i"]).astype(np.int64))
            a, b = bucket_links(cols["fp"].view(np.uint64), group, side.astype(np.uint8), radius)
            return pa.RecordBatch.from_arrays([pa.array(cols["fp"][a]), pa.array(cols["fp"][b])], schema=want)

        def changes(cols: dict[str, np.ndarray]) -> np.ndarray:
            new = np.zeros(len(cols["fp"]), bool)
            for name in ("m", "key", "i", "j"):
                new[1:] |= cols[name][1:] != cols[name][:-1]
            return new

        for batch in batches:
            cols = {name: np.asarray(batch.column(name)) for name in ("fp", "m", "key", "own", "i", "j")}
            if kept is not None:
                cols = {name: np.concatenate([kept[name], c]) for name, c in cols.items()}
            change = changes(cols)
            last = np.flatnonzero(change)
            whole = int(last[-1]) if len(last) else 0
            if whole:
                yield compared({k: c[:whole] for k, c in cols.items()}, change[:whole])
            kept = {k: c[whole:] for k, c in cols.items()}
        if kept is not None and len(kept["fp"]):
            yield compared(kept, changes(kept))

    return tasks.mapInArrow(run, schema).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, radius: int = 4) -> DataFrame:
    """(id, fp, component_id) per row of ``docs``; fp is the fingerprint as a bigint.

    Texts are linked when their fingerprints differ in ``radius`` bits or fewer; texts
    without words have fingerprint 0 and are linked like any other. ``component_id`` is
    the least id reachable, null only where no reachable row has an id. Equal fingerprints
    stand for one node, so copies cost nothing in pair work. Repeated rows stay; extra
    columns are not read.
    """
    prints = stored(fingerprints(docs, id_col, text_col, shingle), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("id").alias("low")), "nodes")
    placed = components(links(nodes.select("fp"), radius, nodes.count()))
    homes = nodes.join(placed.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = homes.groupBy("root").agg(F.min("low").alias("component_id"))
    of_fp = homes.select("fp", "root").join(least, "root").select("fp", "component_id")
    return prints.join(of_fp, "fp").select(F.col("id").alias(id_col), "fp", "component_id")
