"""Vector codes, collocations and repeated passages against plain code on small tables."""

import collections
import hashlib
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isobar.llm import codes, factors, phrases
from isobar.llm.words import byte_kinds, cut_words, hashes

from .conftest import ROWS


@pytest.fixture
def many_tasks(spark):
    """Eight shuffle partitions even for a few rows."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


# Words


@pytest.mark.parametrize("texts", [[], [""], ["", "", ""], ["ab", "cd"], [" a\tB. c..D ", "", "é　x\x1cy,😀", "e"], ["a" * 1000, " "]])
def test_cut_words(texts):
    cut = cut_words(pa.array(texts, pa.string()), byte_kinds(b" \t", b".,"), lower=True)
    want, piece = [], 0
    for row, text in enumerate(texts):
        for part in re.split("[.,]", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
            piece += 1
            want += [(w, row, piece) for w in re.findall(r"[^ \t]+", part)]
    assert [(w.decode(), r) for w, r in zip(cut.words.to_pylist(), cut.row)] == [w[:2] for w in want]
    same = [(a == b) for a, b in zip(cut.piece[1:], cut.piece)]
    assert same == [a[2] == b[2] for a, b in zip(want[1:], want)]


def test_word_hashes_depend_on_the_word_alone():
    words = [b"", b"a", b"b", b"ab", b"ba", b"a\x00", b"\x00a", b"abc" * 50]
    whole = hashes(pa.array(words, pa.binary()))
    assert len(set(whole.tolist())) == len(words)
    assert whole[3:].tolist() == hashes(pa.array(words, pa.binary()).slice(3)).tolist()


# Vector codes


def plain_codes(rows, rounds=6):
    """{id: (code, error)} and the codebooks' digest for vectors of one length."""
    kept = [(i, [math.floor(4096 * x) for x in v]) for i, _, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    d = len(kept[0][1])
    width = -(-d // 8)
    kept = [(i, v + [0] * (width * 8 - d)) for i, v in kept]
    first = [v for _, v in sorted(kept)[:16]]
    books = [[v[p * width : (p + 1) * width] for v in first] for p in range(8)]

    def near(p, part):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(books[p]))

    for _ in range(rounds):
        for p in range(8):
            groups = collections.defaultdict(list)
            for _, v in kept:
                part = v[p * width : (p + 1) * width]
                groups[near(p, part)[1]].append(part)
            for e, parts in groups.items():
                books[p][e] = [sum(c) // len(parts) for c in zip(*parts)]
    out = []
    for i, v in kept:
        found = [near(p, v[p * width : (p + 1) * width]) for p in range(8)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(far for far, _ in found)))
    digest = hashlib.sha256(",".join(str(x) for b in books for entry in b for x in entry).encode()).hexdigest()
    return out, digest


@pytest.mark.parametrize("n, k, m, spread", [(1, 1, 1, 5), (50, 16, 3, 2), (400, 7, 8, 50), (300, 16, 2, 3), (40, 16, 4, 1 << 40)])
def test_walk_finds_the_first_nearest_entry(n, k, m, spread):
    rng = np.random.default_rng(n)
    rows = np.unique(rng.integers(-spread, spread, (n, m)), axis=0)
    book = rng.integers(-spread, spread, (k, m))
    near, far = codes.walk(rows, book)
    for row, e, f in zip(rows.tolist(), near.tolist(), far.tolist()):
        assert (f, e) == min((sum((a - b) ** 2 for a, b in zip(row, entry)), i) for i, entry in enumerate(book.tolist()))


@pytest.mark.parametrize("d, n", [(16, 200), (11, 60), (8, 9), (3, 30)])
def test_codes_equal_plain_rounds(spark, d, n):
    rng = random.Random(d)
    rows = [(i // 2, rng.choice([None, 1, 2]), [rng.choice([rng.gauss(0, 1), 0.25, -0.5]) for _ in range(d)]) for i in range(n)]
    rows += rows[:5] + [(900, 1, None), (901, 1, [float("nan")] * d), (902, 1, [None] + [0.0] * (d - 1)), (903, 2, [float("inf")] * d)]
    table = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(4)
    table = table.withColumns({"id": F.lit("x"), "code": F.lit(1), "same": F.lit(2)})
    got = codes.compress(table).collect()
    want, digest = plain_codes(rows)
    assert sorted((r.vec_id, r.code, r.error) for r in got) == sorted(want)
    assert {r.codebooks_sha256 for r in got} == {digest}
    by_label = collections.Counter()
    for (_, label, v), (_, _, error) in zip([r for r in rows if r[2] and all(x is not None and math.isfinite(x) for x in r[2])], want):
        by_label[label] += error
    assert {r.label_error for r in got} == set(by_label.values())


def test_codes_of_odd_tables(spark):
    schema = "vec_id bigint, label int, embedding array<double>"
    assert codes.compress(spark.createDataFrame([], schema)).collect() == []
    assert codes.compress(spark.createDataFrame([(1, 1, None)], schema)).collect() == []
    mixed = [(None, None, [0.5] * 8), (1, 1, [0.5] * 8), (2, 1, [1.0] * 16), (3, 1, []), (4, 2, [1e9] * 8), (5, 2, [1e300] * 8)]
    got = {r.vec_id: r for r in codes.compress(spark.createDataFrame(mixed, schema)).collect()}
    assert set(got) == {None, 1, 2, 3, 4}
    assert all(r.error == 0 for r in got.values()) and len({r.codebooks_sha256 for r in got.values()}) == 3
    assert got[None].code == got[1].code and got[3].code == "00" * 8


# Collocations


def plain_phrases(docs, longest=4, least=30, share=80, top=2000):
    count, total = collections.Counter(), collections.Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = tuple(re.findall(r"[^\x20\x09]+", piece))
            total[lang] += len(words)
            for n in range(1, longest + 1):
                count.update((lang, words[k : k + n]) for k in range(len(words) - n + 1))
    cand = {k: a for k, a in count.items() if len(k[1]) > 1 and a >= least}
    gone = set()
    for (lang, words), a in cand.items():
        for n in range(2, len(words)):
            for k in range(len(words) - n + 1):
                part = (lang, words[k : k + n])
                if 100 * a >= share * cand[part]:
                    gone.add(part)
    out = collections.defaultdict(list)
    for (lang, words), a in cand.items():
        if (lang, words) in gone:
            continue
        cuts = []
        for k in range(1, len(words)):
            left, right = count[lang, words[:k]], count[lang, words[k:]]
            cuts.append((2_000_000 * a // (left + right), k, left, right))
        score, _, left, right = min(cuts)
        out[lang].append((-score, -a, " ".join(words).encode(), left, right))
    return sorted(
        (lang, rank, phrase.decode(), -a, left, right, total[lang], -score)
        for lang, found in out.items()
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1)
    )


@pytest.mark.parametrize("least, top", [(2, 2000), (5, 2000), (3, 7)])
def test_collocations_equal_plain_counts(many_tasks, least, top):
    rng = random.Random(least)
    words = ["a", "b", "C", "c", "a\x01", "ab", "é", "😀", "　"]
    docs = []
    for k in range(60):
        text = " ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\t", "\n"]) for _ in range(rng.randrange(40)))
        docs.append((rng.choice(["x", "y", None, "und"]), text))
    docs += [("z", None), ("z", ""), ("z", " . "), (None, "a b c a b c " * 50)] + docs[:5]
    table = many_tasks.createDataFrame(docs, "lang string, text string").withColumns({"phrase": F.lit(1), "n": F.lit(2), "t": F.lit("q")})
    got = phrases.collocations(table.repartition(5), least=least, top=top).collect()
    assert sorted(tuple(r) for r in got) == plain_phrases(docs, least=least, top=top)


def test_edges_carry_beginnings_over_partitions(many_tasks):
    """One word begins everything, so its extensions lie in many partitions."""
    rows = [("x", ["a"], 1000)] + [("x", ["a", f"b{k:02d}"], 100 + k) for k in range(40)] + [("x", ["a", "b07", f"c{k}"], 50 + k) for k in range(30)]
    stream = many_tasks.createDataFrame([(*r, [], [], 0) for r in rows], phrases._STREAM)
    got = {tuple(r.words): r for r in phrases.with_beginnings(stream, "firsts").collect()}
    assert len(got) == len(rows)
    assert got["a",].longer == 139 and got["a", "b07"].longer == 79 and got["a", "b08"].longer == 0
    assert got["a", "b07", "c29"].firsts == [1000, 107] and got["a", "b39"].firsts == [1000]


def test_collocations_of_no_rows(spark, none, odd):
    assert phrases.collocations(none).collect() == []
    assert phrases.collocations(none.union(spark.createDataFrame([(1, "a b", None, None, 3)], none.schema))).collect() == []
    got = phrases.collocations(odd).collect()
    assert [(r.lang, r.phrase, r.a, r.l, r.r) for r in got] == [("und", "word word word word", 29_997, 30_000, 29_998)]


# Repeated passages


def plain_repeats(docs, window):
    least = {}
    cut = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in docs]
    order = {i: (i is None, i or 0) for i, _ in docs}
    for i, words in cut:
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            least[key] = min(least.get(key, order[i]), order[i])
    out = []
    for i, words in cut:
        gone = set()
        for k in range(len(words) - window + 1):
            if least[tuple(words[k : k + window])] < order[i]:
                gone.update(range(k, k + window))
        out.append((i, len(words), len(gone), " ".join(w for k, w in enumerate(words) if k not in gone)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window, seed, block", [(5, 2, 1 << 20), (5, 2, 200), (5, 1, 1), (6, 6, 1 << 20), (50, 10, 1 << 20), (50, 10, 300)])
def test_repeats_equal_plain_windows(spark, window, seed, block):
    rng = random.Random(window)
    fresh = [f"w{k}" for k in range(3 if window < 10 else 2000)]
    shared = [[rng.choice(fresh) for _ in range(rng.randrange(window, 4 * window))] for _ in range(6)]
    docs = []
    for k in range(70):
        words = []
        for _ in range(rng.randrange(5)):
            part = list(rng.choice(shared)) if rng.random() < 0.6 else [rng.choice(fresh) for _ in range(rng.randrange(2 * window))]
            if rng.random() < 0.4 and part:
                part[rng.randrange(len(part))] = "edit"
            words += part[rng.randrange(window) :]
        docs.append((rng.choice([k, k, k // 2, None]), rng.choice([" ", "\n", " \t"]).join(words)))
    docs += docs[:6] + [(1000, None), (1001, ""), (1002, "one"), (1003, "same " * 400), (1004, "same " * 333), (1004, "same " * 333)]
    table = spark.createDataFrame(docs, "doc_id bigint, text string").withColumns({"id": F.lit(1), "t": F.lit("x"), "spans": F.lit(2)})
    got = factors.without_repeats(table.repartition(5), window=window, seed=seed, block_words=block).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=repr) == plain_repeats(docs, window)


def test_repeats_of_odd_tables(none, odd):
    assert factors.without_repeats(none).collect() == []
    got = sorted(((r.doc_id, r.n_words, r.n_removed) for r in factors.without_repeats(odd).collect()), key=repr)
    want = [(i, len(re.findall(r"[^\x20\x09-\x0D]+", t or "")), 0) for i, t in ROWS]
    assert got == sorted(want, key=repr)


def test_ids_of_text_are_ordered_as_text(spark):
    text = " ".join(f"w{k}" for k in range(60))
    table = spark.createDataFrame([("b", text), ("a", text + " end"), (None, text)], "doc_id string, text string")
    got = {r.doc_id: r.kept for r in factors.without_repeats(table).collect()}
    assert got == {"a": text + " end", "b": "", None: ""}


def test_factors_and_their_borders():
    """A window over two factors is found though neither factor holds it."""
    a, b = [b"a%d" % k for k in range(8)], [b"b%d" % k for k in range(8)]
    runs = [a + b[:1], a[5:] + b, a + b]
    reach_all = factors.repeated(runs, np.array([0, 1, 2]), 6)
    assert reach_all == [[], [], [0, 16]]
    assert factors.repeated(runs, np.array([0, 0, 0]), 6) == [[], [], []]
    assert factors.repeated([a + b[:1], a[5:] + b, a[4:] + b[:4] + a], np.array([0, 1, 2]), 6) == [[], [], [1, 16]]
