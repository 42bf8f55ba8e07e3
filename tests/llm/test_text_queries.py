"""Registered text queries against their SQL twins or against brute force."""

import collections
import hashlib
import math
import os
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash

import __spark_entry__ as driver
from isobar.llm import bpe, pii, weak
from isobar.llm.catalogue import BPE_RANKS, QUERIES
from tools.check_queries import duck, same

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def docs():
    return duckdb.connect().execute(f"SELECT doc_id, text, lang FROM '{SF}/documents.parquet'").fetchall()


def rows(spark, name):
    return {r.doc_id: r for r in QUERIES[name].run(spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_matches_sql(spark, name):
    assert same(QUERIES[name].run(spark, SF).toPandas(), duck(SF).execute(QUERIES[name].sql).df()) is None


def test_all_are_registered():
    names = driver.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)) and "pipeline" in names


def test_scores(spark, docs):
    got = rows(spark, "op2_lm_score")
    words = {d: (t or "").encode().lower().split() + [b"\n"] for d, t, _ in docs}
    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in words}
    count = collections.Counter(w for d, ws in words.items() if not held[d] for w in ws)
    n, v = sum(count.values()), len(count)
    for d, ws in words.items():
        r = got[d]
        want = sum(math.log10((count[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[d], len(ws), sum(count[w] > 0 for w in ws), n)
        assert r.base_score == pytest.approx(want, rel=1e-9) and r.score < 0
    out = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in out) > 1.02 * sum(r.base_score for r in out)


def test_byte_bpe(spark, docs):
    ranks = bpe.read_ranks(public_tokenizers.path(BPE_RANKS))
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = rows(spark, "op3_byte_bpe")
    for d, t, _ in docs:
        ids = known.encode_ordinary(t or "")
        assert got[d].n_tokens == len(ids)
        assert got[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    def digits(m):
        return re.sub("[^0-9]", "", m)

    kinds = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
        "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [f"{k}:{m.start()}:{m.end()}" for k, (p, ok) in kinds.items() for m in re.finditer(p, text) if ok(m[0])]


def test_pii(spark, docs):
    for d, r in rows(spark, "op4_pii").items():
        want = base_spans(next(t for i, t, _ in docs if i == d) or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert r.spans.split(",")[: len(want)] == (want or [""])[: len(want)]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(w.startswith(k) for w in want) for k in ("email", "ip", "card", "phone"))


def test_language(spark, docs):
    got = rows(spark, "op7_language_id")
    out = [(d, lang) for d, _, lang in docs if got[d].held_out and lang]
    assert all(got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, _, _ in docs)
    assert np.mean([got[d].lang_pred == lang for d, lang in out]) > 0.97


def fingerprint(text):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + 4]) for i in range(max(len(words) - 3, 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def reach(ids, linked):
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


def test_simhash(spark, docs):
    got = rows(spark, "op9_simhash")
    prints = {d: fingerprint(t) for d, t, _ in docs}
    ids = sorted(prints)
    homes = reach(ids, ((a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4))
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{prints[d]:016x}", homes[d]) for d in ids}


def occurring(words, items):
    """Whether any window of ten item words (or a whole shorter item) is in ``words``."""
    held = {n: {tuple(words[a : a + n]) for a in range(len(words) - n + 1)} for n in range(1, 11)}
    return any(tuple(own[a : a + n]) in held[n] for own in items if (n := min(10, len(own))) for a in range(len(own) - n + 1))


def test_pipeline_equals_its_stages_in_plain_code(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    kept = {r.doc_id: r.text for r in given if r.text and regex.search(r"\p{L}", r.text)}
    assert len(kept) == sum(bool(r.text and regex.search(r"\p{L}", r.text)) for r in given)
    prints = {d: fingerprint(t) for d, t in kept.items()}
    ids = sorted(kept)
    homes = reach(ids, ((a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 4))
    kept = {d: t for d, t in kept.items() if homes[d] == d}

    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))

    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {d: t for d, t in kept.items() if not occurring(words(t), items)}
    assert 0 < len(clean) < len(kept) < len(given)

    # The base spans by plain patterns; the learned kinds by the operator, which has tests of its own.
    table = spark.createDataFrame(list(clean.items()), "doc_id bigint, text string")
    added = {r.doc_id: [(s.start, s.end, f"<{k}>") for k in pii.ADDED for s in r[k] or []] for r in pii.find(table).collect()}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(public_tokenizers.path(BPE_RANKS)), special_tokens={})
    want = {}
    for d, text in clean.items():
        base = [(int(a), int(b), f"<{k}>") for k, a, b in (x.split(":") for x in base_spans(text))]
        at, out = 0, []
        for a, b, tag in sorted(base + added[d]):
            if a >= at:
                out += [text[at:a], tag]
            at = max(at, b)
        text = "".join(out) + text[at:]
        want[d] = known.encode_ordinary(text), hashlib.sha256(text.encode()).hexdigest()

    out = driver.queries()["pipeline"](spark, SF).collect()
    assert len(out) == len(want) and all(r.n_tokens == len(r.ids) for r in out)
    assert {r.doc_id: (r.ids, r.decoded_sha256) for r in out} == want


def test_quality_equals_plain_steps(spark, docs):
    """EM text by text, without patterns or arrays, and a scorer that keeps its weights by name."""
    texts = {d: t or "" for d, t, _ in docs}
    measured = {d: weak.measures(t) for d, t in texts.items()}
    said = {d: weak.votes(m) for d, m in measured.items()}
    labellers = range(len(weak.LABELLERS))
    good, bad, prior = [0.998] * len(labellers), [0.15] * len(labellers), 0.85
    post = {}

    def within(x, low, high):
        return min(max(x, low), high)

    for _ in range(100):
        for d, vote in said.items():
            odds = math.log(prior / (1 - prior))
            for k in labellers:
                if vote[k] != weak.NONE:
                    up = vote[k] == weak.GOOD
                    odds += math.log((good[k] if up else 1 - good[k]) / (1 - bad[k] if up else bad[k]))
            post[d] = 1 / (1 + math.exp(-odds))
        prior = within((sum(post.values()) + 1) / (len(post) + 2), 0.05, 0.99)
        for k in labellers:
            heard = [d for d in said if said[d][k] != weak.NONE]
            mass = sum(post[d] for d in heard)
            right = sum(post[d] for d in heard if said[d][k] == weak.GOOD)
            caught = sum(1 - post[d] for d in heard if said[d][k] == weak.BAD)
            good[k] = within((right + 10) / (mass + 10), 0.995, 0.9995)
            bad[k] = within((caught + 4) / (len(heard) - mass + 10), 0.02, 0.999)

    def named(text, m):
        counts = collections.Counter(zlib.crc32(w.encode()) % weak.FEATURES for w in text.lower().split())
        norm = max(math.sqrt(sum(math.log1p(n) ** 2 for n in counts.values())), 1e-9)
        shapes = [*m[:7], math.log1p(m[7]) / 10, *m[8:], *map(math.sqrt, m[:4])]
        return {**{h: math.log1p(counts[h]) / norm for h in sorted(counts)}, **{weak.FEATURES + j: x for j, x in enumerate(shapes)}}

    rows_by_text = {texts[d]: (named(texts[d], measured[d]), post[d]) for d in texts}
    lessons = sorted(rows_by_text.values(), key=lambda r: (list(r[0]), list(r[0].values())))
    weight, steps = collections.defaultdict(float), collections.defaultdict(lambda: 1e-6)

    def judged(x):
        return 1 / (1 + math.exp(-within(sum(weight[h] * v for h, v in x.items()), -30, 30)))

    order = np.random.default_rng(0).permutation(len(lessons))
    for _ in range(6):
        for i in order:
            x = {**lessons[i][0], "always": 1.0}
            miss = judged(x) - lessons[i][1]
            for h, v in x.items():
                steps[h] += (miss * v) ** 2
                weight[h] -= 0.5 * miss * v / math.sqrt(steps[h])

    got = rows(spark, "op1_quality")
    assert set(got) == set(texts)
    for d, r in got.items():
        score = judged({**named(texts[d], measured[d]), "always": 1.0})
        assert r.votes == ",".join(map(str, said[d]))
        assert r.weak == pytest.approx(post[d], rel=1e-6, abs=1e-9) and r.score == pytest.approx(score, rel=1e-6, abs=1e-9)
        if abs(mean := (post[d] + score) / 2 - 0.5) > 1e-6:
            assert r.keep == (mean > 0)


def test_quality_agrees_with_labels(spark):
    got = {r.doc_id: r for r in QUERIES["op1_quality"].run(spark, "/root/testdata/sf0.01").collect()}
    labels = duckdb.connect().execute("SELECT doc_id, quality FROM '/root/testdata/sf0.01/labels.parquet' WHERE toxic = 0").fetchall()
    assert np.mean([got[d].keep for d, q in labels if q == 1]) > 0.95
    assert np.mean([got[d].keep for d, q in labels if q == 0]) < 0.2
