"""Quality classifier from weak labels.

Heuristic labellers vote good, bad or nothing on a text. Expectation-maximisation over the
counts of vote patterns estimates every labeller's accuracy without any labels; the
posterior of a pattern then labels texts, and a linear scorer over hashed word and shape
features is fitted to the posteriors of a bounded sample.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from isobar.llm.common import arrow_schema, text_slices, with_id

GOOD, BAD, NONE = 1, 0, -1
LABELLERS = ("symbols", "capitals", "tables", "repeats", "word_length", "function_words", "insults", "length")
#: Texts that the scorer is fitted on, at most about so many.
SAMPLE_TEXTS = 8_000
FEATURES = 1 << 14
_SHAPES = 16  # dense features behind the hashed ones

#: Frequent function words and plain insults.
FUNCTION_WORDS = frozenset(
    "the of and to in a is that for it was on are as with his they at be this from have or by une un le la les des et en du que est dans "
    "pour qui sur au der die das und ist ein eine nicht von mit sich auf für den dem zu im el los las y de por con para una del al se lo".split()
)
INSULTS = frozenset("idiot idiots moron morons scum stupid imbecile loser losers vermin filth trash pathetic worthless disgusting clown bastard bastards bitch whore slut retard retarded".split())

_SYMBOL = re.compile(r"[^\w\s.,;:!?'\"()\-]|_")
_UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_LETTERS = re.compile(r"[^\W\d_]+")


def measures(text: str) -> list[float]:
    """Shape of a text: shares of symbols, capitals, bars, digits, repeats and so on."""
    words = text.split()
    n, chars = max(len(words), 1), max(len(text), 1)
    bare = [m.lower() for m in _LETTERS.findall(text)]
    letters = sum(map(len, bare))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        len(_SYMBOL.findall(text)) / chars,
        len(_UPPER.findall(text)) / max(letters, 1),
        sum(w == "|" for w in words) / n,
        1 - len(set(lines)) / max(len(lines), 1),
        letters / max(len(bare), 1),
        sum(w in FUNCTION_WORDS for w in bare) / max(len(bare), 1),
        sum(w in INSULTS for w in bare) / max(len(bare), 1),
        float(len(words)),
        text.count("!") / n,
        sum(c.isdigit() for c in text) / chars,
        1 - len(set(words)) / n,
        letters / chars,
    ]


def votes(m: list[float]) -> list[int]:
    """One vote per labeller; -1 where it has no say."""

    def cut(x: float, bad: float, good: float) -> int:
        """Bad beyond ``bad``, good within ``good``."""
        if bad > good:
            return BAD if x > bad else GOOD if x < good else NONE
        return BAD if x < bad else GOOD if x > good else NONE

    return [
        cut(m[0], 0.05, 0.01),
        cut(m[1], 0.4, 0.12),
        cut(m[2], 0.1, 0.005) if m[2] or m[7] >= 20 else NONE,
        BAD if m[10] > 0.9 and m[7] <= 5_000 else cut(m[3], 0.3, 0.1) if m[7] >= 20 else NONE,
        BAD if m[4] > 14 or m[4] < 2 else GOOD if 3 <= m[4] <= 9 else NONE,
        cut(m[5], 0.02, 0.08),
        BAD if m[6] > 0 else GOOD if m[7] else NONE,
        BAD if m[7] < 5 else GOOD if 50 <= m[7] <= 20_000 else NONE,
    ]


def features(text: str, m: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(places, values): hashed words as log counts, and the measures."""
    words = text.lower().split()
    at, n = np.unique(np.fromiter((zlib.crc32(w.encode()) & (FEATURES - 1) for w in words), np.int64, len(words)), return_counts=True)
    value = np.log1p(n)
    value /= max(np.sqrt((value * value).sum()), 1e-9)
    dense = np.array([*m[:7], np.log1p(m[7]) / 10, *m[8:], *(np.sqrt(x) for x in m[:4])], np.float64)
    return np.concatenate([at, FEATURES + np.arange(len(dense))]), np.concatenate([value, dense])


def estimate(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray, float]:
    """(posteriors of good by pattern, accuracies by labeller as [bad, good], prior).

    Labellers are independent given the class; a labeller that says nothing has no weight.
    A fault that one labeller knows of is rare among bad texts and rarer among good ones, so
    accuracies start, and stay, much higher on good texts than on bad ones: the labellers'
    thresholds are set for at most one false alarm in 200, and EM is held to that.
    """
    said = patterns != NONE
    rate, prior = np.tile([0.15, 0.998], (patterns.shape[1], 1)), 0.85
    post = np.full(len(patterns), prior)
    for _ in range(rounds):
        good = np.where(patterns == GOOD, rate[:, 1], 1 - rate[:, 1])
        bad = np.where(patterns == BAD, rate[:, 0], 1 - rate[:, 0])
        odds = (np.log(np.where(said, good, 1.0)) - np.log(np.where(said, bad, 1.0))).sum(1) + np.log(prior / (1 - prior))
        post = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        w1, w0 = post * counts, (1 - post) * counts
        prior = float(np.clip((w1.sum() + 1) / (counts.sum() + 2), 0.05, 0.99))
        for k in range(patterns.shape[1]):
            s = said[:, k]
            rate[k, 1] = np.clip(((w1 * s * (patterns[:, k] == GOOD)).sum() + 10) / ((w1 * s).sum() + 10), 0.995, 0.9995)
            rate[k, 0] = np.clip(((w0 * s * (patterns[:, k] == BAD)).sum() + 4) / ((w0 * s).sum() + 10), 0.02, 0.999)
    return post, rate, prior


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], target: np.ndarray, passes: int = 6, rate: float = 0.5) -> np.ndarray:
    """Logistic weights (last: intercept) by adaptive gradient steps in a fixed order."""
    w = np.zeros(FEATURES + _SHAPES + 1)
    seen = np.full(len(w), 1e-6)
    order = np.random.default_rng(0).permutation(len(rows))
    for _ in range(passes):
        for i in order:
            at, value = rows[i]
            at, value = np.append(at, len(w) - 1), np.append(value, 1.0)
            miss = 1 / (1 + np.exp(-np.clip(w[at] @ value, -30, 30))) - target[i]
            step = miss * value
            seen[at] += step * step
            w[at] -= rate * step / np.sqrt(seen[at])
    return w


def _vote_patterns(docs: DataFrame, text_col: str) -> DataFrame:
    schema = "pattern string, n bigint"
    want = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, int] = {}
        for batch in batches:
            for text in batch.column(0).to_pylist():
                key = ",".join(map(str, votes(measures(text or ""))))
                found[key] = found.get(key, 0) + 1
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], schema=want)

    return docs.select(F.col(text_col)).mapInArrow(run, schema).groupBy("pattern").agg(F.sum("n").alias("n"))


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(id, votes, weak, score, keep) per row of ``docs``.

    ``weak`` is the posterior of good by the labellers alone, ``score`` that of the hashed
    linear scorer, and a text is kept when the mean of both reaches ``threshold``. Votes
    of all texts are counted; 3^8 patterns at most come to the driver. Null texts are
    empty and get the labellers' verdict on an empty text. Null ids and repeated rows
    stay; extra columns are not read.
    """
    counted = _vote_patterns(docs, text_col).orderBy("pattern").collect()
    patterns = np.array([[int(x) for x in r["pattern"].split(",")] for r in counted]).reshape(len(counted), len(LABELLERS))
    number = np.array([r["n"] for r in counted], np.float64)
    post, rates, prior = estimate(patterns, number)
    weak = {tuple(p): float(x) for p, x in zip(patterns.tolist(), post)}
    rate = min(1.0, SAMPLE_TEXTS / max(float(number.sum()), 1))
    text = F.coalesce(F.col(text_col), F.lit(""))
    drawn = docs.select(text.alias("t")).where(F.pmod(F.xxhash64("t"), F.lit(1 << 30)) < rate * (1 << 30)).distinct()
    schema = "at array<bigint>, value array<double>, target double"
    want = arrow_schema(schema)

    def examples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 0):
            out = []
            for t in part.column(0).to_pylist():
                m = measures(t)
                at, value = features(t, m)
                out.append((at, value, weak[tuple(votes(m))]))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), want)], schema=want)

    sample = sorted(((r["at"], r["value"], r["target"]) for r in drawn.mapInArrow(examples, schema).collect()), key=lambda r: (r[0], r[1]))
    weights = fit_linear([(np.array(a, np.int64), np.array(v)) for a, v, _ in sample], np.array([y for *_, y in sample]))
    out_schema = with_id(docs.schema[id_col].dataType, "votes array<int>, weak double, score double, keep boolean")
    out_want = arrow_schema(out_schema)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, 1):
            rows = []
            for t in part.column(1).to_pylist():
                m = measures(t or "")
                vote = votes(m)
                at, value = features(t or "", m)
                score = float(1 / (1 + np.exp(-np.clip(weights[at] @ value + weights[-1], -30, 30))))
                sure = weak[tuple(vote)]
                rows.append((vote, sure, score, (sure + score) / 2 >= threshold))
            cols = [pa.array(c, f.type) for c, f in zip(zip(*rows), list(out_want)[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], schema=out_want)

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(judge, out_schema).withColumnRenamed("id", id_col)
