"""Personal data by weak supervision, in DataFrame functions only.

Fixed patterns give the base spans, which always stay. Looser candidates of six kinds (keys
and other secrets, phone numbers without ``+``, grouped ids, IPv6, spelled-out e-mails, names
after a title or a given name) are voted on by labellers: shapes (regex), words before the span
(gazetteer), marks around it (context) and a make-up test of its characters. For each kind
expectation-maximisation over the counts of vote patterns estimates how reliable each
labeller is; the posteriors train a logistic span classifier over the votes and the span's
length, which decides about candidates. Of the kinds other than keys a candidate also needs
two votes, of phones and ids three, since their shape and make-up agree too easily: where all
candidates of a kind are harmless, a number of a likely form alone never adds a span.

Patterns are written so that Java's matcher takes time linear in the text: runs are
possessive and start where a run starts, or where the last match ended. Positions are running
sums by doubling, and texts are cut by blocks, so a text with many spans takes time n log n.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone")
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[ -]?[0-9])++",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
#: What a text must hold before its pattern is tried.
_NEEDS = {
    "email": lambda t: F.contains(t, F.lit("@")),
    "ip": lambda t: t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
    "card": lambda t: t.rlike(r"[0-9](?:[ -]?[0-9]){12}"),
    "phone": lambda t: F.contains(t, F.lit("+")),
}


@dataclass(frozen=True)
class Candidate:
    """A kind of looser candidates and its labellers, all regular expressions.

    ``need`` is what a text must hold, ``keep`` what a match must hold, each of them.
    """

    need: str
    pattern: str
    keep: tuple[str, ...]
    shape: str
    words: str
    mix: str
    least_votes: int = 2
    digit_share: float = 0.0  # of the characters, for the make-up test


#: Titles and common given names of the gazetteer.
TITLES = "Mr|Mrs|Ms|Miss|Dr|Prof|Sir|Herr|Frau|Monsieur|Madame|Don|Señor|Señora"
GIVEN_NAMES = (
    "James|Mary|John|Patricia|Robert|Jennifer|Michael|Linda|William|Elizabeth|David|Barbara|Richard|Susan|Joseph|Jessica|"
    "Thomas|Sarah|Charles|Karen|Daniel|Lisa|Matthew|Nancy|Anthony|Anna|Peter|Paul|Maria|José|Juan|Carlos|Ana|Carmen|Pedro|"
    "Hans|Klaus|Jürgen|Wolfgang|Ursula|Monika|Pierre|Jean|Marie|Jacques|Nathalie|Isabelle|Mohammed|Ahmed|Fatima|Ali|Alice|Bob"
)
_TLD = "com|org|net|edu|gov|io|info|de|fr|es|uk|co|eu|us"
CANDIDATES = {
    "secret": Candidate(
        need="(?<![A-Za-z0-9])[A-Za-z0-9]{16}",
        pattern=r"(?<![A-Za-z0-9])[A-Za-z0-9]{16,}+",
        keep=("[0-9]", "[A-Za-z]"),
        shape=r"(?i)^(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{64}|(?:sk|pk|ghp)[A-Za-z0-9]{16,})$",
        words=r"(?i)\b(?:token|key|secret|password|passwd|pwd|credential|bearer|apikey|api_key|auth)\b",
        mix=r"[0-9]",
        least_votes=0,
        digit_share=0.25,
    ),
    "local_phone": Candidate(
        need="[0-9]{3,4}[ .-][0-9]{3}",
        pattern=r"(?<![0-9A-Za-z+.-])(?<![0-9+][ ()-])(?<!\+[0-9() .-]{1,20})\(?[0-9]{2,5}+\)?[ .-]{1,2}+[0-9]{3,4}+[ .-][0-9]{3,5}+(?![ .-]?[0-9])(?![A-Za-z])",
        keep=(),
        shape=r"^(?:\(0?[0-9]{2,4}\) ?|0?[0-9]{2,4}([ .-]))[0-9]{3,4}[ .-][0-9]{4}$",
        words=r"(?i)\b(?:phone|telephone|tel|mobile|cell|call|fax|whatsapp|sms|telefon|handy|téléphone|teléfono)\b",
        mix=r"^\(?(?:0[1-9]|[2-9][0-9]{2}\)?[ .-]{1,2}[2-9])",
        least_votes=3,
    ),
    "grouped_id": Candidate(
        need="[A-Z]{2}[0-9]{2}[ -]?[A-Z0-9]{4}|[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}|[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4,12}-",
        pattern=r"(?<![A-Za-z0-9-])(?:[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){3,7}+(?:[ -]?[A-Z0-9]{1,3}+)?|[0-9]{3}[ -][0-9]{2}[ -][0-9]{4}|[0-9A-Fa-f]{4,8}+(?:-[0-9A-Fa-f]{4,12}+){3,4}+)(?![A-Za-z0-9-])",
        keep=("[0-9]",),
        shape=r"^(?:[A-Z]{2}[0-9]{2}(?:[ -]?[A-Z0-9]{4}){3,7}(?:[ -]?[A-Z0-9]{1,3})?|(?!000|666|9)[0-9]{3}-[0-9]{2}-[0-9]{4})$",
        words=r"(?i)\b(?:iban|ssn|social security|passport|account|konto|licen[cs]e|tax|insurance|national id|identity|id)\b",
        mix=r"^(?=(?:[^0-9]*+[0-9]){8})",
        least_votes=3,
    ),
    "ipv6": Candidate(
        need=":[0-9A-Fa-f]{0,4}:",
        pattern=r"(?<![0-9A-Za-z:.])[0-9A-Fa-f]{1,4}+(?:(?::{1,2}[0-9A-Fa-f]{1,4}+){2,7}+(?:::)?|(?::[0-9A-Fa-f]{1,4}+)?::)(?![0-9A-Za-z:])",
        keep=("[0-9]",),
        shape=r"^(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[^:]*(?::[^:]+)*::)[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){0,6}(?:::)?)$",
        words=r"(?i)\b(?:ip|ipv6|address|host|server|client|from|peer|remote|addr)\b",
        mix=r"(?:[0-9A-Fa-f]*[A-Fa-f][0-9A-Fa-f]*:.*[0-9]{2}|[0-9A-Fa-f]{3,4}:)",
    ),
    "spelled_email": Candidate(
        need=r"(?i)(?:\bat\b|@).{1,64}?(?:\bdot\b|[\[(]\.[\])])",
        pattern=rf"(?i)(?:(?<!{_LOCAL})|\G){_LOCAL}++ ?(?:[\[({{<] ?at ?[\])}}>]|[\[(]@[\])]| at ) ?[A-Za-z0-9-]++(?: ?(?:[\[({{<] ?dot ?[\])}}>]|[\[(]\.[\])]| dot ) ?[A-Za-z0-9-]++)++",
        keep=(),
        shape=rf"(?i)(?:[\])}}> ])(?:{_TLD})$",
        words=r"(?i)\b(?:e-?mail|mail|contact|write|reach|send|address|kontakt|correo|courriel)\b",
        mix=r"[\[({<]",
    ),
    "name": Candidate(
        need=rf"(?<![\p{{L}}0-9])(?=\p{{Lu}})(?:{TITLES}|{GIVEN_NAMES})(?:\.| )",
        pattern=rf"(?<![\p{{L}}0-9])(?=\p{{Lu}})(?:(?:{TITLES})\.? (?:\p{{Lu}}\p{{Ll}}++ )?|(?:{GIVEN_NAMES}) (?:\p{{Lu}}\. )?)\p{{Lu}}\p{{Ll}}++(?![\p{{L}}0-9])",
        keep=(),
        shape=rf"^(?:{TITLES})\b",
        words=r"(?i)\b(?:name|contact|signed|dear|by|regards|patient|customer|employee|attn|sincerely|from)\b",
        mix=rf"\b(?:{GIVEN_NAMES})\b",
    ),
}
ADDED = tuple(CANDIDATES)
VOTES = ("shape", "gazetteer", "context", "mix")
_SPANS = "array<struct<start:int,end:int,m:string>>"
_FOUND = "array<struct<start:int,end:int," + ",".join(f"{v}:boolean" for v in VOTES) + ",size:int>>"
_BEFORE = 24  # characters before a candidate that labellers see
_BLOCK = 4096  # characters of a block when texts are cut


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running sums (or maxima) of whole numbers, none below zero, by doubling: n log n."""
    steps = F.filter(F.array(*[F.lit(1 << k) for k in range(31)]), lambda w: w < F.size(values))

    def double(acc: Column, width: Column) -> Column:
        moved = F.slice(F.concat(F.array_repeat(F.lit(0), width), acc), 1, F.size(acc))
        return F.zip_with(acc, moved, join)

    return F.aggregate(steps, values, double)


def _parts(text: Column, pattern: str) -> Column:
    """(gap before, match, gap after) of each leftmost non-overlapping match."""
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)

    def cut(both: Column) -> Column:
        return F.transform(
            both["found"],
            lambda m, i: F.struct(F.get(both["gaps"], i).alias("gap"), m.alias("m"), F.get(both["gaps"], i + 1).alias("after")),
        )

    return _let(F.struct(gaps.alias("gaps"), found.alias("found")), cut)


def _placed(parts: Column, shown: Callable[[Column, Column], Column]) -> Column:
    """``shown`` of each part and its end in code points."""

    def with_ends(steps: Column) -> Column:
        lengths = F.transform(steps, lambda s: F.length(s["gap"]) + F.length(s["m"]))
        return F.zip_with(steps, _let(lengths, lambda x: _running(x, lambda a, b: a + b)), shown)

    return _let(parts, with_ends)


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches with code-point bounds."""

    def span(s: Column, end: Column) -> Column:
        return F.struct((end - F.length(s["m"])).alias("start"), end.alias("end"), s["m"].alias("m"))

    return _placed(_parts(text, pattern), span)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(m: Column) -> Column:
    each = F.transform(F.split(F.reverse(_digits(m)), ""), lambda c, i: F.when(i % 2 == 0, F.try_to_number(c, F.lit("9")).cast("int")).otherwise(
        F.element_at(F.array(*[F.lit(x) for x in (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)]), F.try_to_number(c, F.lit("9")).cast("int") + 1)
    ))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, m: Column) -> Column:
    n = F.length(_digits(m))
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.when(n.between(13, 19), _luhn(m)).otherwise(F.lit(False))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def _spans_of(text: Column, kind: str) -> Column:
    found = F.when(_NEEDS[kind](text), _matches(text, PATTERNS[kind])).otherwise(F.array().cast(_SPANS))
    return F.filter(found, lambda s: _valid(kind, s["m"]))


def _candidates(text: Column, kind: str) -> Column:
    """Candidates of a kind with their votes and length class."""
    c = CANDIDATES[kind]

    def voted(s: Column, end: Column) -> Column:
        before, n = F.substring(s["gap"], -_BEFORE, _BEFORE), F.length(s["m"])
        kept = F.lit(True)
        for k in c.keep:
            kept = kept & s["m"].rlike(k)
        return F.when(
            kept,
            F.struct(
                (end - n).alias("start"), end.alias("end"),
                s["m"].rlike(c.shape).alias("shape"),
                before.rlike(c.words).alias("gazetteer"),
                (before.rlike("[\"'=:]\\s*$") | F.substring(s["after"], 1, 1).isin('"', "'")).alias("context"),
                (s["m"].rlike(c.mix) & (F.length(_digits(s["m"])) >= n * c.digit_share)).alias("mix"),
                F.when(n < 24, 0).when(n < 48, 1).otherwise(2).alias("size"),
            ),
        )

    found = F.filter(_placed(_parts(text, c.pattern), voted), lambda s: s.isNotNull())
    return F.when(text.rlike(c.need), found).otherwise(F.array().cast(_FOUND))


def estimate(counts: dict[tuple[bool, ...], int], rounds: int = 60) -> tuple[dict[tuple[bool, ...], float], list[tuple[float, float]]]:
    """Posterior of each vote pattern and (sensitivity, specificity) of each labeller."""
    total = sum(counts.values())
    width = len(next(iter(counts)))
    rates, prior = [(0.8, 0.8)] * width, 0.5
    post: dict[tuple[bool, ...], float] = {}
    for _ in range(rounds):
        for p in counts:
            yes, no = prior, 1 - prior
            for v, (sens, spec) in zip(p, rates):
                yes *= sens if v else 1 - sens
                no *= 1 - spec if v else spec
            post[p] = yes / (yes + no)
        mass = sum(post[p] * n for p, n in counts.items())
        prior = min(max((mass + 1) / (total + 2), 0.01), 0.99)
        rates = [
            (
                (sum(post[p] * n for p, n in counts.items() if p[k]) + 4) / (mass + 5),
                (sum((1 - post[p]) * n for p, n in counts.items() if not p[k]) + 4) / (total - mass + 5),
            )
            for k in range(width)
        ]
    return post, rates


def _logistic(rows: list[tuple[tuple[float, ...], float, float]], rounds: int = 400) -> list[float]:
    """Weights (last: intercept) for (features, weight, target) by gradient descent."""
    total = sum(w for _, w, _ in rows)
    weights = [0.0] * (len(rows[0][0]) + 1)
    for _ in range(rounds):
        slope = [1e-4 * w for w in weights]
        for x, w, y in rows:
            z = sum(a * b for a, b in zip(weights, (*x, 1.0)))
            miss = (1 / (1 + math.exp(-max(min(z, 30), -30))) - y) * w / total
            for k, v in enumerate((*x, 1.0)):
                slope[k] += miss * v
        weights = [w - 2.0 * g for w, g in zip(weights, slope)]
    return weights


def learn(docs: DataFrame, text_col: str = "text") -> dict[str, list[float]]:
    """Weights of the span classifier of each kind that has candidates in ``docs``.

    Only counts by kind, votes and length class, 288 at most, come to the driver.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    every = [F.transform(_candidates(text, kind), _kept_votes(kind)) for kind in ADDED]
    found = docs.select(F.explode(F.concat(*every)).alias("c"))
    rows = found.groupBy(*[F.col(f"c.{v}").alias(v) for v in ("kind", *VOTES, "size")]).count().collect()
    weights = {}
    for kind in ADDED:
        own = sorted((tuple(bool(r[v]) for v in VOTES), r["size"], r["count"]) for r in rows if r["kind"] == kind)
        if not own:
            continue
        counts: dict[tuple[bool, ...], int] = {}
        for votes, _, n in own:
            counts[votes] = counts.get(votes, 0) + n
        post, _ = estimate(counts)
        weights[kind] = _logistic([((*map(float, votes), float(size)), float(n), post[votes]) for votes, size, n in own])
    return weights


def _kept_votes(kind: str) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(kind).alias("kind"), *[s[v].alias(v) for v in VOTES], s["size"].alias("size"))


def accepted(kind: str, weights: list[float]) -> list[tuple[tuple[bool, ...], int]]:
    """Votes and length classes that the classifier takes for personal data."""
    return [
        (votes, size)
        for votes in product((False, True), repeat=len(VOTES))
        for size in range(3)
        if sum(votes) >= CANDIDATES[kind].least_votes
        and sum(w * x for w, x in zip(weights, (*map(float, votes), float(size), 1.0))) > 0
    ]


def spans(text: Column, weights: dict[str, list[float]]) -> dict[str, Column]:
    """Arrays of (start, end, ...) by kind; the kinds in their fixed order, then the added ones."""
    out = {kind: _spans_of(text, kind) for kind in KINDS}
    for kind in ADDED:
        codes = [sum(v << k for k, v in enumerate((*votes, size))) for votes, size in accepted(kind, weights[kind])] if kind in weights else []
        if not codes:
            out[kind] = F.array().cast(_FOUND)
            continue
        out[kind] = F.filter(_candidates(text, kind), _has_code(codes))
    return out


def _has_code(codes: list[int]) -> Callable[[Column], Column]:
    def test(s: Column) -> Column:
        code = F.lit(0)
        for k, v in enumerate((*VOTES, "size")):
            code = code + s[v].cast("int") * (1 << k)
        return code.isin(*codes)

    return test


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, email, ip, card, phone, secret, ...): spans by kind per row of ``docs``.

    Bounds are code points, the end exclusive. Null texts are empty and hold nothing; null
    ids and repeated rows stay; extra columns are not read. A kind without candidates is not
    learnt and adds no spans.
    """
    weights = learn(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), *[s.alias(kind) for kind, s in spans(text, weights).items()])


def masked(text: Column, found: dict[str, Column]) -> Column:
    """The text with every span replaced by its kind in angle brackets; overlaps by the first."""

    def tag(kind: str):
        return lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(f"<{kind}>").alias("tag"))

    every = F.array_sort(F.concat(*[F.transform(s, tag(kind)) for kind, s in found.items()]))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_BLOCK}}}+"), 0)

    def cut(blocks: Column, start: Column, end: Column) -> Column:
        """Code points from ``start`` to ``end``, from the blocks that hold them."""
        first = F.floor(start / _BLOCK).cast("int")
        held = F.transform(F.sequence(first, F.floor((end - 1) / _BLOCK).cast("int")), lambda b: F.get(blocks, b))
        return F.when(end > start, F.substr(F.array_join(held, ""), start - first * _BLOCK + 1, end - start)).otherwise("")

    def join(given: Column) -> Column:
        tagged, blocks, reach = given["spans"], given["blocks"], given["reach"]

        def part(s: Column, i: Column) -> Column:
            at = F.when(i > 0, F.get(reach, i - 1)).otherwise(0)
            return F.when(s["start"] >= at, F.concat(cut(blocks, at, s["start"]), s["tag"])).otherwise("")

        last = F.get(reach, F.size(reach) - 1)
        return F.concat(F.array_join(F.transform(tagged, part), ""), cut(blocks, last, F.length(text)))

    def with_reach(tagged: Column) -> Column:
        reach = _let(F.transform(tagged, lambda s: s["end"]), lambda x: _running(x, lambda a, b: F.greatest(a, b)))
        given = F.struct(tagged.alias("spans"), blocks.alias("blocks"), reach.alias("reach"))
        return F.when(F.size(tagged) == 0, text).otherwise(_let(given, join))

    return _let(every, with_reach)


def as_text(kinds: tuple[str, ...]) -> Column:
    """Spans of column arrays as ``kind:start:end``, joined by commas."""

    def show(kind: str):
        return lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string"))

    shown = [F.transform(F.col(kind), show(kind)) for kind in kinds]
    return F.array_join(F.concat(*shown), ",")
