"""Operators on small fixtures: odd rows, empty tables, hot groups, and brute force."""

import random
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq_file
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from isobar.llm import bpe, chat, decon, langid, mixing, pii, pq, simhash, urls, weak
from isobar.llm.catalogue import BPE_RANKS
from isobar.llm.components import Forest, components
from isobar.session import shared_root

from .conftest import ROWS

PATH, PATTERN = public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN


def test_quality_rows(odd, none):
    assert weak.classify(odd).count() == len(ROWS)
    assert weak.classify(none).count() == 0


def test_score_rows(odd, none):
    got = mixing.score(odd, F.lit(True)).collect()
    assert len(got) == len(ROWS) and all(r.n_tokens == r.n_known for r in got)
    assert {r.n_tokens for r in got if r.doc_id in (2, 3, 4)} == {1}
    untaught = mixing.score(odd, F.lit(False)).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and np.isfinite(r.score) for r in untaught)
    assert mixing.score(none, F.lit(True)).count() == 0


def test_score_of_long_tokens():
    size = 1 << mixing.SLOT_BITS
    blank = mixing.Speller(np.zeros((len(mixing.ORDERS), size), np.float32), np.zeros((len(mixing.ORDERS), size), np.float32))
    scorer = mixing.Scorer(blank, np.array([10.0, 5.0]), np.array([4.0, 2.0]))
    words = [b"a" * n for n in (99, 999, 99_999)]
    digits = np.array([100, 1_000, 100_000]) * 8 * np.log10(2)  # with the end of the word, a bit costs a bit
    assert np.allclose(-scorer.log10_new(words), digits[:, None] - np.log10(0.03), rtol=1e-6)
    listed = scorer.log10([*words, mixing.END], np.array([[2.0, 0.0]] * 4))
    assert np.isfinite(listed).all() and (listed > -10).all()
    assert (scorer.log10_new([mixing.END]) < 0).all()
    scorer.learn(words, np.array([[2.0, 0.0], [1.0, 0.0], [3.0, 1.0]]))
    assert 0.5 <= scorer.known < 1


def test_tokens_of_columns():
    texts = ["  Hello WORLD\x0b x\x1cy É é  z\x85q ", None, "", "a b A\tb\n\r c", "\x00 A\x00b", "ÀB  "]
    plain = ["xx YY", "  Hello WORLD q ", "a  b", "C d"] * 9
    for column in (pa.array(texts), pa.array(texts).slice(2, 3), pa.array(plain).slice(2), pa.array(plain).slice(1, 5)):
        sizes, codes, words = mixing.coded_tokens(column)
        found, ends = [words[int(i)].as_py() for i in codes], np.cumsum(sizes)
        assert [found[e - n : e] for e, n in zip(ends, sizes)] == [mixing.tokens(t) for t in column.to_pylist()]


def test_kinds_are_means_over_all_texts(spark, monkeypatch):
    monkeypatch.setattr(mixing, "KINDS", 1)
    monkeypatch.setattr(mixing, "START_TEXTS", 3, raising=False)
    texts = [f"text {n} of {'many zebras' if n % 7 else 'some quick foxes ' * 3} {n * n}" for n in range(400)]
    docs = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = sum(mixing._shape(t).astype(np.float64) for t in texts)
    for layout in (docs.repartition(3), docs.repartition(7)):
        (centre,) = mixing.fit_kinds(layout, "t", len(texts))
        assert np.allclose(centre, whole / np.linalg.norm(whole), atol=1e-4)


def test_mixer_learns_from_every_word(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN_WORDS", 100)
    words = [f"word{n * 7919 % 1000}x{n}".encode() for n in range(350)]
    rows = spark.createDataFrame([(w, 1 + len(w) % 3, len(w) % 2) for w in words] + [(mixing.END, 9, 0)], "word binary, k0 bigint, k1 bigint")
    rows = rows.withColumn("n", F.col("k0") + F.col("k1"))
    speller = mixing._spelling_counts(rows, 2)
    plain = mixing.Speller(speller.ones, speller.seen)
    mixing._learn_weights(rows.repartition(5), speller, 2, 351)
    dealt = rows.where(F.length("word") > 1).select("word", "k0", "k1", F.pmod(F.xxhash64("word"), F.lit(4)).alias("run"), F.xxhash64("word", F.lit(1)).alias("at"))
    runs, total = {}, 0
    for r in sorted(dealt.collect(), key=lambda r: (r.run, r.at)):
        runs.setdefault(r.run, []).append(r)
    for own in runs.values():
        one = mixing.Speller(plain.ones, plain.seen)
        one.learn([bytes(r.word) for r in own], np.array([int(r.k1 > r.k0) for r in own]), limit=7168)
        total = total + len(own) * one.weights.astype(np.float64)
    assert np.allclose(speller.weights, total / len(words), atol=1e-6) and not np.allclose(speller.weights, plain.weights)


def test_contexts_are_counted_over_all_tokens(spark):
    """Every distinct word was counted once, in the kind with most of it."""
    words = {b"maps": (3, 0), b"map": (1, 2), b"tea": (0, 5), b"rare": (1, 0)}
    rows = [(w, sum(c), *c) for w, c in words.items()] + [(mixing.END, 4, 2, 2)]
    speller = mixing._spelling_counts(spark.createDataFrame(rows, "word binary, n bigint, k0 bigint, k1 bigint").repartition(3), 2)
    ones, seen = (np.zeros((len(mixing.ORDERS), 1 << mixing.SLOT_BITS)) for _ in range(2))
    tokens = [(w, k) for w, c in words.items() for k in (0, 1) for _ in range(c[k])]
    for pieces in mixing._cut([w for w, _ in tokens], 1 << 16):
        slots, bits, _ = mixing.bit_slots(pieces, np.array([k for _, k in tokens]))
        for o in range(len(mixing.ORDERS)):
            np.add.at(ones[o], slots[o], bits)
            np.add.at(seen[o], slots[o], 1)
    assert len(tokens) == 12 and (speller.ones == ones).all() and (speller.seen == seen).all()


def test_mixer_works_left_out_predictions_out_once(monkeypatch):
    words = [f"w{n * 7919 % 1000}x{n % 50}".encode() for n in range(400)]
    kind = np.arange(400) % 2
    ones, seen = (np.zeros((len(mixing.ORDERS), 1 << mixing.SLOT_BITS), np.float32) for _ in range(2))
    pieces = list(mixing._cut(words, 300))
    for piece in pieces:
        slots, bits, _ = mixing.bit_slots(piece, kind)
        for o in range(len(mixing.ORDERS)):
            np.add.at(ones[o], slots[o], bits)
            np.add.at(seen[o], slots[o], 1)
    plain = mixing.Speller(ones, seen).weights.astype(np.float64)
    for piece in pieces:
        slots, bits, _ = mixing.bit_slots(piece, kind)
        n1, n = (np.stack([t[o][slots[o]] for o in range(len(mixing.ORDERS))]).astype(np.float64) for t in (ones, seen))
        x = np.log((n1 - bits + 0.2) / (n - n1 - (1 - bits) + 0.2))
        gate = np.where(n > 1, np.arange(len(mixing.ORDERS))[:, None], 0).max(0)
        step = (bits - 1 / (1 + np.exp(-(plain[gate].T * x).sum(0)))) * np.clip(x, -8, 8)
        for g in np.unique(gate):
            plain[g] += 0.02 * step[:, gate == g].mean(1) * min(1.0, (gate == g).sum() / 64)
    speller, log, calls = mixing.Speller(ones, seen), np.log, []
    monkeypatch.setattr(np, "log", lambda *a, **k: calls.append(1) or log(*a, **k))
    speller.learn(words, kind, limit=300)
    assert np.allclose(speller.weights, plain, atol=1e-5) and np.abs(plain - 0.25).max() > 1e-3
    assert len(calls) < len(pieces)


def test_bpe_rows(odd, none):
    ids = bpe.encode(odd, "doc_id", "text", PATH, PATTERN)
    back = bpe.decode(ids, "doc_id", "ids", PATH, PATTERN).collect()
    assert sorted((r.doc_id or 0, bytes(r.decoded).decode()) for r in back) == sorted((d or 0, t or "") for d, t in ROWS)
    assert bpe.encode(none, "doc_id", "text", PATH, PATTERN).count() == 0


def test_bpe_memory_is_bounded_by_characters(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_CHARS", 2_000)
    own = bpe.Codec(bpe.read_ranks(PATH), PATTERN)
    rng = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyzäöß"
    for size in (8, 40, 5_000, 8):
        texts = [" ".join("".join(rng.choices(letters, k=size)) for _ in range(60)) for _ in range(3)]
        assert [own.decode(ids).decode() for ids in own.encode_all(texts)] == texts
        assert own.encode_all(texts) == own.encode_all(texts)
        for cache, held in zip((own.pre_tokens, own.chunks), own.held):
            assert sum(map(len, cache)) == held <= 2_000 and max(map(len, cache), default=0) <= bpe.CACHE_PIECE


def test_bpe_merges_like_a_plain_scan():
    ranks = bpe.read_ranks(PATH)
    pairs = [ranks.get(bytes((x, y))) for x in range(256) for y in range(256)]

    def plain(piece):
        if piece in ranks:
            return [ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            best = min(((ranks.get(a + b, 1 << 30), i) for i, (a, b) in enumerate(zip(parts, parts[1:]))))
            if best[0] == 1 << 30:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return [ranks[p] for p in parts]

    rng = random.Random(3)
    pieces = [p for p in ("".join(rng.choice("aaabthersié") for _ in range(rng.randrange(1, 40))).encode() for _ in range(400)) if p not in ranks]
    assert bpe.merge_all(pieces, ranks, pairs) == [plain(p) for p in pieces]


def test_pii_rows(odd, none):
    assert pii.find(odd).count() == len(ROWS)
    assert pii.find(none).count() == 0


def test_pii_finds_keys_by_votes_and_masks(spark):
    text = 'é token = "%s" mail a.b@c.de_x@y.z now +1 (017) 555-7713, 1.2.3.400, 4111 1111 1111 1111, 1.2.3.4'
    docs = spark.createDataFrame([(i, text % f"{i:02d}ab3c{'0f1e2d' * 5}99ff") for i in range(20)] + [(99, "ABCDEFGH12345678 nothing")], "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    assert [(s.start, s.end) for s in got[0].secret] == [(11, 51)] and got[99].secret == []
    assert [s.m for s in got[0].email] == ["a.b@c.de", "_x@y.z"] and [s.m for s in got[0].ip] == ["1.2.3.4"]
    masked = docs.select("doc_id", pii.masked(F.col("text"), pii.spans(F.col("text"), pii.learn(docs))).alias("t"))
    shown = {r.doc_id: r.t for r in masked.collect()}
    assert shown[0].startswith('é token = "<secret>" mail <email><email> now <phone>, 1.2.3.400, <card>, <ip>') and shown[99] == "ABCDEFGH12345678 nothing"


PLANTED = {
    "local_phone": ["phone: (415) 555-2671 now", "call 030 1234 5678 today", "Tel: 020 7946 0958.", "mobile = 415-555-2671"],
    "grouped_id": ["IBAN: DE89 3704 0044 0532 0130 00 ok", "SSN: 219-09-9999.", "account GB29 NWBK 6016 1331 9268 19 x", "iban ES91 2100 0418 4502 0005 1332"],
    "ipv6": ["host 2001:db8:85a3:0:0:8a2e:370:7334 up", "from fe80::1ff:fe23:4567:890a to", "server: 2001:db8::ff00:42:8329 x", "address 2001:0db8:0:0:0:0:0:1"],
    "spelled_email": ["mail: ana (at) example (dot) org", "write joe.b [at] mail [dot] com", "contact me@", "e-mail bob at example dot com"],
    "name": ["Dear Mrs. Maria Lopez,", "signed Dr. Thomas Brown", "contact Mr. John Smith now", "patient Ms Anna Schmidt"],
}
HARMLESS = [
    "the 100 200 3000 and 2024-01-15 12:30:45, versions 1.22.333 and pages 120-125-1300 of 90 000 000",
    "at: x; look at the dot on the map; std::vector, a::b, 10:20:30 and 1:2:3",
    "James is here, Maria too; Don said so, Sir. The bc12-de34-ff56 part 1234-5678 is 12-12-1212",
]


def test_pii_finds_looser_kinds_by_votes(spark):
    texts = [t for kind in PLANTED.values() for t in kind] * 5 + HARMLESS * 5
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in pii.find(docs).collect()}
    planted = [(kind, t) for kind, all_ in PLANTED.items() for t in all_]
    for i, (kind, t) in enumerate(planted):
        assert len(got[i][kind]) == (0 if t.endswith("me@") else 1), (kind, t)
    assert all(not got[i][kind] for i in range(len(planted) * 5, len(texts)) for kind in pii.ADDED)
    card = "+1 415-555-2671, 4111 1111 1111 1111, 1.2.3.4, +44 (0) 20 7946 0958"
    one = pii.find(spark.createDataFrame([(1, f"phone {card}")], "doc_id bigint, text string")).first()
    assert len(one.phone) == 2 and len(one.card) == 1 and not one.local_phone and not one.grouped_id


def test_pii_masks_like_a_plain_walk(spark):
    rng = random.Random(5)
    bits = ["a.b@c.de", "+1 415 555 2671", "4111 1111 1111 1111", "1.2.3.4", "é😀x" * 900, "Mr. John Smith", " ", "_x@y.z", "\n", f"key='{'0f1e2d3c' * 5}'", "+4111 1111 1111 1111"]
    rows = [(i, "".join(rng.choice(bits) + rng.choice([" ", "", ", "]) for _ in range(rng.randrange(0, 60)))) for i in range(60)] + [(60, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    weights = pii.learn(docs)
    by = pii.spans(F.col("text"), weights)
    got = docs.select("text", pii.masked(F.col("text"), by).alias("t"), *[c.alias(k) for k, c in by.items()]).collect()
    for r in got:
        at, out = 0, []
        for a, b, tag in sorted((s.start, s.end, f"<{k}>") for k in by for s in r[k] or []):
            if a >= at:
                out += [r.text[at:a], tag]
            at = max(at, b)
        assert r.t == (None if r.text is None else "".join(out) + r.text[at:])
        assert all(r.text[s.start : s.end] == s.m for k in pii.KINDS for s in r[k] or [])


def test_pii_time_grows_with_the_spans_of_one_text(spark):
    def seconds(n):
        text = " ".join(f"user{i}@mail{i}.org" for i in range(n))
        docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
        shown = docs.select(pii.masked(F.col("text"), pii.spans(F.col("text"), {})).alias("t"))
        start = time.monotonic()
        assert shown.first().t == " ".join(["<email>"] * n)
        return time.monotonic() - start

    seconds(1_000)
    small, large = (min(seconds(n) for _ in range(2)) for n in (16_000, 32_000))
    assert large <= 2.5 * small, (small, large)


def test_urls(spark):
    rules = spark.createDataFrame([("org/", "allow"), ("Example.org/es/", "block"), ("com/de/", "block"), ("com/de/", "allow"), (None, "block"), ("/x", "block"), ("a.com/", "maybe")], "rule string, verdict string")
    given = ["http://a.EXAMPLE.org/es/1", "https://example.org/en", "x://org", "http://b.com/de/?q", "http://xcom/de/", None, "", "nothing", "http://" + "a." * 5000 + "org/"]
    pages = spark.createDataFrame([(i, u, "r") for i, u in enumerate(given)] + [(0, given[0], "r"), (None, given[1], "r")], "page_id bigint, url string, rule string")
    got = urls.judge(pages, rules, "page_id").collect()
    assert len(got) == len(given) + 2
    by = {r.page_id: (r.rule, r.verdict) for r in got}
    assert by[0] == ("Example.org/es/", "block") and by[None] == ("org/", "allow") and by[3] == ("com/de/", "block") and by[8] == ("org/", "allow")
    assert all(by[i] == (None, "allow") for i in (2, 4, 5, 6, 7))
    assert urls.judge(pages, rules.limit(0), "page_id").count() == len(given) + 2
    assert urls.judge(pages.limit(0), rules, "page_id").count() == 0
    many = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit(".net/p")).alias("rule"), F.lit("block").alias("verdict"))
    hit = urls.judge(spark.range(10_000).select("id", F.concat(F.lit("http://s.h"), "id", F.lit(".net/p/1")).alias("url")), many, "id")
    assert hit.where("verdict = 'block'").count() == 5000 == hit.where("verdict = 'block' and id < 5000").count()


def test_decontamination_rows(spark, odd, none, monkeypatch):
    items = [(10, ROWS[0][1]), (11, "A"), (12, ""), (13, None), (None, "cat sat on"), (10, "sat on the mat")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    want = {1: (14, ["10", "11"]), None: (14, ["10", "11"]), 2: (0, []), 3: (0, []), 5: (1, ["11"]), 7: (0, []), 8: (0, [])}
    for words in (1_000_000, 5):  # one index, and the shuffle join
        monkeypatch.setattr(decon, "BLOCK_WORDS", words)
        got = decon.find(odd, bench).select("doc_id", decon.hit_words().alias("n"), "items").collect()
        assert len(got) == len(ROWS)
        assert [(r.doc_id, r.n, r.items) for r in got if r.doc_id in want and (r.n, r.items) != want[r.doc_id]] == []
        assert decon.find(none, bench).count() == 0
    assert decon.find(odd, bench.limit(0)).where(decon.hit_words() > 0).count() == 0


def test_decontamination_by_shuffle_equals_a_plain_scan(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(12)]  # few words, so windows repeat and shingles tie

    def run(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    items = [(i, run(rng.choice((1, 3, 4, 5, 9, 10, 11, 40)))) for i in range(60)]
    hot = run(30)
    items += [(100 + i, hot) for i in range(20)]
    texts = [(i, run(rng.choice((0, 2, 9, 10, 50, 300)))) for i in range(40)]
    texts += [(100 + i, run(5) + rng.choice(items)[1] + run(5)) for i in range(40)]
    texts += [(200 + i, run(i % 7) + hot) for i in range(60)] + [(300, hot)] * 30

    def plain(words):
        hit, found = set(), set()
        for item, own in items:
            size = min(10, len(own))
            for a in range(len(own) - size + 1):
                for at in range(len(words) - size + 1):
                    if words[at : at + size] == own[a : a + size]:
                        hit.update(range(at, at + size))
                        found.add(str(item))
        return len(words), len(hit), tuple(sorted(found))

    docs = spark.createDataFrame([(i, " ".join(w).upper()) for i, w in texts], "doc_id bigint, text string").repartition(5)
    bench = spark.createDataFrame([(i, ", ".join(w)) for i, w in items], "item_id bigint, text string")
    want = sorted((i, *plain(w)) for i, w in texts)
    for bound in ("BLOCK_WORDS", "BLOCK_BYTES"):
        with monkeypatch.context() as patch:
            patch.setattr(decon, bound, 10)
            got = decon.find(docs, bench).select("doc_id", "n_words", decon.hit_words().alias("n_hit"), "items", "spans").collect()
        assert sorted((r.doc_id, r.n_words, r.n_hit, tuple(r.items)) for r in got) == want
        assert all(r.spans == sorted(r.spans) and all(a.end < b.start for a, b in zip(r.spans, r.spans[1:])) for r in got)


def test_language_rows(spark, odd, none):
    model = langid.train(spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze"), (None, "x"), ("en", None)], "lang string, text string"), "lang", "text")
    got = langid.predict(odd, model, "doc_id", "text").collect()
    assert len(got) == len(ROWS) and {r.lang_pred for r in got if r.doc_id in (2, 3, 4)} == {"und"}
    assert {r.lang_pred for r in got if r.doc_id in (1, None)} == {"en"} and all(0 <= r.score <= 1 for r in got)
    assert langid.predict(none, model, "doc_id", "text").count() == 0
    blank = langid.train(none, "lang", "text")
    assert {r.lang_pred for r in langid.predict(odd, blank, "doc_id", "text").collect()} == {"und"}


def test_language_sample_reaches_long_and_copied_texts(spark):
    rng = random.Random(3)
    letters = {f"l{k}": chr(0x430 + 3 * k) + chr(0x431 + 3 * k) + " " for k in range(8)}
    texts = [(lang, "".join(rng.choices(a, k=20_000))) for lang, a in letters.items()]  # one long text each
    table = spark.createDataFrame(texts, "lang string, text string")
    model = langid.train(table, "lang", "text", sample_chars=2_000)
    for lang, a in letters.items():
        assert model.langs[int(model.bits([(a * 9).encode()]).argmin())] == lang
    copied = langid.train(table.union(table.where("lang = 'l0'")), "lang", "text", sample_chars=2_000)
    whole = langid.train(table, "lang", "text", sample_chars=10**6)
    assert all(np.array_equal(a, b) for a, b in zip(copied.costs, model.costs))
    data, places, _ = langid._laid_out([texts[0][1].encode()], langid.ORDER)
    for k in range(1, langid.ORDER + 2):  # all pieces together are the text
        assert set(langid._packed(data, places, k).tolist()) <= set(whole.grams[k - 1].keys.tolist())
    assert model.bits([texts[0][1].encode()])[0, 0] < 1.1 * whole.bits([texts[0][1].encode()])[0, 0]


def test_code_lengths_against_plain_ppm():
    texts = {"a": [b"abracadabra", b"banana"], "b": [b"xyzzy abra"]}
    order, counts = 2, []
    for k in range(1, order + 2):
        found = {}
        for j, ts in enumerate(texts.values()):
            data, places, _ = langid._laid_out(ts, order)
            for key in langid._packed(data, places, k).tolist():
                found.setdefault(key, [0, 0])[j] += 1
        counts.append((np.array(sorted(found), np.uint64), np.array([found[x] for x in sorted(found)], float)))
    model = langid.Model.fit(list(texts), order, counts)

    def plain(j, text):
        data = b"\n" * order + text
        total = 0.0
        for at in range(order, len(data)):
            for k in range(order, -1, -1):
                context = data[at - k : at]
                follow = {}
                for t in list(texts.values())[j]:
                    padded = b"\n" * order + t
                    for p in range(order, len(padded)):
                        if padded[p - k : p] == context:
                            follow[padded[p]] = follow.get(padded[p], 0) + 1
                if follow:
                    n, d = sum(follow.values()), len(follow)
                    if data[at] in follow:
                        total -= np.log2(follow[data[at]] / (n + d))
                        break
                    total -= np.log2(d / (n + d))
            else:
                total += 8
        return total

    probe = [b"abra", b"", b"xyz\xff", b"banana bab"]
    assert np.allclose(model.bits(probe), [[plain(j, t) for j in (0, 1)] for t in probe], atol=1e-3)


def test_chat_folds_events(spark):
    log = [
        (1, 0, 1, 0, "message", "user", "Hi"),
        (1, 1, 1, 1, "message", "assistant", "He"),
        (1, 1, 1, 3, "delta", None, "lo"),
        (1, 1, 1, 2, "delta", None, "l"),
        (1, 2, 1, 4, "delta", "assistant", "draft"),
        (1, 2, 1, 5, "regenerate", None, None),
        (1, 2, 1, 6, "delta", None, r"a<b\c </turn>"),
        (1, 0, 1, 7, "edit", None, "Hey"),
        (None, 0, 1, 0, None, None, None),
    ]
    events = spark.createDataFrame(log, "conv_id bigint, msg bigint, part bigint, seq bigint, op string, role string, text string")
    messages = chat.fold(events)
    assert sorted((r.conv_id or 0, r.msg, r.role, r.text) for r in messages.collect()) == [
        (0, 0, "", ""), (1, 0, "user", "Hey"), (1, 1, "assistant", "Hello"), (1, 2, "assistant", r"a<b\c </turn>"),
    ]
    back = {r.conv_id: r for r in chat.read_back(chat.render(messages)).collect()}
    assert back[1].n_turns == 3 and back[1].loss_chars == 18 and back[None].n_turns == 1
    assert chat.read_back(chat.render(chat.fold(events.limit(0)))).count() == 0


def test_components_of_paths_and_hubs(spark):
    path = [(i, i + 1) for i in range(0, 300)]
    hub = [(1000, i) for i in range(1001, 3000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(path + hub + [(5, 5)], "a bigint, b bigint")).collect()}
    assert len({got[i] for i in range(301)}) == 1 and len({got[i] for i in range(1000, 3000)}) == 1 and got[0] != got[1000]


def test_forest():
    f = Forest(6)
    f.link(np.array([4, 5, 1]), np.array([5, 3, 2]))
    assert f.up.tolist() == [0, 1, 1, 3, 3, 3]


@pytest.mark.parametrize("radius", [0, 3, 4])
def test_bit_sliced_links(spark, radius, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 64)  # so that hot buckets are cut
    rng = random.Random(radius)
    seeds = [rng.getrandbits(64) for _ in range(30)]
    fps = sorted({s ^ sum(1 << rng.randrange(64) for _ in range(rng.randrange(7))) & (2**64 - 1) for s in seeds for _ in range(40)} | {0, 2**64 - 1})
    rows = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint")
    edges = [(r.a & (2**64 - 1), r.b & (2**64 - 1)) for r in simhash.links(rows, radius, len(fps)).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in edges)

    def roots(pairs):
        up = {f: f for f in fps}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = root(a), root(b)
            up[max(a, b)] = min(a, b)
        return {f: root(f) for f in fps}

    assert roots(edges) == roots((a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= radius)


def test_simhash_rows(odd, none):
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == len(ROWS) and {r.component_id for r in got if r.doc_id in (1, None)} == {1}
    assert {(r.fp, r.component_id) for r in got if r.doc_id in (2, 3, 4)} == {(0, 2)}
    assert simhash.near_duplicates(none).count() == 0


def brute_links(vectors):
    n, degree, up = len(vectors), [0] * len(vectors), list(range(len(vectors)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ok = [v is not None and label is not None and None not in v and np.isfinite(v).all() and np.any(np.array(v) != 0) for _, v, label in vectors]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and vectors[i][2] == vectors[j][2] and len(vectors[i][1]) == len(vectors[j][1]):
                a, b = np.array(vectors[i][1], np.float32).astype(float), np.array(vectors[j][1], np.float32).astype(float)
                if a @ b / np.sqrt(a @ a) / np.sqrt(b @ b) >= 0.98:
                    degree[i], degree[j] = degree[i] + 1, degree[j] + 1
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
    return degree, [root(i) for i in range(n)]


@pytest.mark.parametrize("block", [1024, 40])
def test_embeddings_with_hot_groups(spark, block, monkeypatch):
    monkeypatch.setattr(pq, "BLOCK", block)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(20, 16))
    rows = []
    for i in range(500):
        v = base[0 if i % 3 == 0 else rng.integers(20)] + (0 if i % 6 == 0 else rng.normal(size=16) * 0.05 * rng.random())
        rows.append((i, [float(x) for x in v], int(i % 2)))
    rows += [(500, None, 0), (501, [0.0] * 16, 0), (502, [float("nan")] * 16, 0), (503, [None] + [1.0] * 15, 0), (504, rows[0][1], None), (505, [1.0, 2.0], 0)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("n_links", F.lit("x"))
    got = {r.vec_id: r for r in pq.near_duplicates(table).collect()}
    degree, home = brute_links([(i, v, label) for i, v, label in rows])
    assert [(got[i].n_links, got[i].component_id) for i in range(len(rows))] == list(zip(degree, home))
    assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
    assert pq.near_duplicates(table.limit(0)).count() == 0


def test_embedding_recall_on_noisy_copies(spark):
    data = pq_file.read_table("/root/testdata/sf0.1/embeddings.parquet").to_pandas()
    rng = np.random.default_rng(1)
    v = np.stack(data.embedding.to_numpy()).astype(float)
    v /= np.sqrt((v * v).sum(1))[:, None]
    v, label = np.concatenate([v, v, v]), np.concatenate([data.label.to_numpy()] * 3)
    length = np.concatenate([np.zeros(len(data)), 0.2 * rng.random(len(data)), np.full(len(data), 0.19)])
    noise = rng.normal(size=v.shape)
    v = (v + length[:, None] * noise / np.sqrt((noise * noise).sum(1))[:, None]).astype(np.float32)
    table = spark.createDataFrame([(i, x.tolist(), int(y)) for i, (x, y) in enumerate(zip(v, label))], "vec_id bigint, embedding array<float>, label int")
    got = pq.near_duplicates(table).toPandas().set_index("vec_id").n_links
    u = v.astype(float)
    u /= np.sqrt((u * u).sum(1))[:, None]
    want = np.zeros(len(u), int)
    for y in np.unique(label):
        at = np.flatnonzero(label == y)
        want[at] = (u[at] @ u[at].T >= 0.98).sum(1) - 1
    found = got.reindex(range(len(u))).to_numpy()
    assert want.sum() > 5000 and (found <= want).all() and found.sum() / want.sum() >= 0.99


def test_embedding_probes_are_not_written(spark):
    """A vector was written, as doubles, once for each list that it probes and again for each pair of blocks."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=(4000, 64)).astype(np.float32)
    v[:50] = v[50:100] * 2 + 0.01
    table = spark.createDataFrame([(i, x.tolist(), i % 2) for i, x in enumerate(v)], "vec_id bigint, embedding array<float>, label int")
    root = Path(shared_root(spark).removeprefix("file:"))
    before = {p.name for p in root.iterdir()}
    got = {r.vec_id: r.n_links for r in pq.near_duplicates(table).collect()}
    assert all(got[i] == got[i + 50] == 1 for i in range(50)) and sum(got.values()) == 100
    written = sum(f.stat().st_size for p in root.iterdir() if p.name not in before for f in p.rglob("*.parquet"))
    assert written < 4 * v.nbytes


def test_embedding_links_along_few_directions(spark):
    rng = np.random.default_rng(2)
    angle, label = rng.random(1200) * 2 * np.pi, rng.integers(2, size=1200)
    rows = [(i, [float(np.cos(a)), float(np.sin(a))] + [0.0] * 62, int(y)) for i, (a, y) in enumerate(zip(angle, label))]
    rows.append((1200, [1.0] * 1024, 0))  # a stray longer vector
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(4)
    got = {r.vec_id: r.n_links for r in pq.near_duplicates(table).collect()}
    cosine = np.cos(angle[:, None] - angle[None])
    want = ((cosine >= 0.98) & (label[:, None] == label[None])).sum(1) - 1
    assert [got[i] for i in range(1200)] == want.tolist() and got[1200] == 0


def test_stages_take_odd_rows(spark, odd, none):
    table = odd.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1)})
    sf = "/root/testdata/sf0.001"
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, sf)
        assert out.columns == table.columns and out.count() > 0, name
        empty = stage(spark, none, sf)
        assert empty.columns == none.columns and empty.count() == 0, name
    kept = corpus_pipeline.simhash_dedup(spark, table, sf).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept if r.doc_id in (None, 1, 2, 3, 4)) == [1, 2]
    assert corpus_pipeline.language_id(spark, table, sf).where("doc_id in (2, 3, 4)").count() == 0
    assert corpus_pipeline.byte_bpe(spark, none, sf).count() == 0


def test_stages_take_odd_column_names(spark, odd):
    table = odd.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.lit(1), "a.b": F.lit(1), "my col": F.lit(2), "a-b": F.lit(3), "x`y": F.lit(4)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, "/root/testdata/sf0.001")
        assert out.columns == table.columns, name
        assert {(r["a.b"], r["my col"], r["a-b"], r["x`y"]) for r in out.collect()} == {(1, 2, 3, 4)}, name
    assert corpus_pipeline.byte_bpe(spark, table, "/root/testdata/sf0.001").count() == len(ROWS)


def test_language_without_text_is_not_learned(spark):
    english = "The cat sat on the mat and looked at the dog for a while, and the dog looked at the cat."
    rows = [(1, english, "en"), (2, english + " Again.", "en"), (3, "", "xx"), (4, "", "xx"), (5, None, "yy")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.train(docs, "lang", "text")
    asked = spark.createDataFrame([(1, "Привет мир"), (2, "the dog sat")], "doc_id bigint, text string")
    assert {r.lang_pred for r in langid.predict(asked, model, "doc_id", "text").collect()} == {"en"}
