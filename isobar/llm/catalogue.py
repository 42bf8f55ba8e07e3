"""The registered queries of the text operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from isobar.llm import bpe, chat, codes, decon, factors, langid, mixing, phrases, pii, pq, simhash, urls, weak
from isobar.llm.common import crc_of, table
from isobar.session import prepare

Run = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class TextQuery:
    run: Run
    sql: str | None = None


QUERIES: dict[str, TextQuery] = {}

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def query(name: str, sql: str | None = None) -> Callable[[Run], Run]:
    def add(fn: Run) -> Run:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(prepare(spark), sf_dir)

        run.__doc__ = fn.__doc__
        QUERIES[name] = TextQuery(run, sql)
        return fn

    return add


@query("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by weak labels; no given label is read."""
    found = weak.classify(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.array_join(F.col("votes").cast("array<string>"), ",").alias("votes"), "weak", "score", "keep")


@query("op2_lm_score")
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document scored; learnt where crc32(doc_id) mod 10 is not 0."""
    scored = mixing.score(table(spark, sf_dir, "documents"), crc_of(F.col("doc_id")) % 10 != 0)
    return scored.select(
        "doc_id", (~F.col("learnt")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte"
    )


#: Fixed values of the byte-level BPE query.
BPE_RANKS = "byte_bpe_multi_50k.tiktoken"


@query("op3_byte_bpe")
def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    return bpe.round_trip(docs, "doc_id", "text", public_tokenizers.path(BPE_RANKS), public_tokenizers.PATTERN)


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_DECON_SQL = f"""
WITH bench AS (
  SELECT item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS size, list_slice(w, a, a + least(len(w), 10) - 1) AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS a FROM bench WHERE len(w) > 0)),
docs AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') AS w FROM documents),
sizes AS (SELECT DISTINCT size FROM windows),
runs AS (
  SELECT doc_id, size, a, list_slice(w, a, a + size - 1) AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS a FROM docs, sizes WHERE len(w) >= size)),
found AS (SELECT r.doc_id, r.a, r.size, w.item_id FROM runs r JOIN windows w ON r.win = w.win),
spots AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(a, a + size)) AS p FROM found) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n, sha256(string_agg(item, ',' ORDER BY item)) AS digest
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(s.n, 0) AS n_hit, coalesce(m.n, 0) AS n_items,
       coalesce(m.digest, sha256('')) AS items_sha256, coalesce(s.n, 0) > 0 AS contaminated
FROM docs d LEFT JOIN spots s USING (doc_id) LEFT JOIN named m USING (doc_id)
"""


@query("op6_decontaminate", _DECON_SQL)
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside an occurrence of a benchmark window."""
    found = decon.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = decon.hit_words()
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"),
    )


@query("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document; learnt where crc32(doc_id) mod 4 is not 2."""
    docs = table(spark, sf_dir, "documents")
    held_out = crc_of(F.col("doc_id")) % 4 == 2
    model = langid.train(docs.where(~held_out), "lang", "text")
    return langid.predict(docs, model, "doc_id", "text", {"held_out": held_out}).select("doc_id", "held_out", "lang_pred", "score")


@query("op4_pii")
def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and those that the learned classifier adds."""
    found = pii.find(table(spark, sf_dir, "documents"))
    counts = [F.size(kind).cast("bigint").alias(f"n_{kind}") for kind in pii.KINDS]
    base, every = pii.as_text(pii.KINDS), pii.as_text((*pii.KINDS, *pii.ADDED))
    return found.select("doc_id", *counts, F.sha2(base.cast("binary"), 256).alias("base_sha256"), every.alias("spans"))


#: Fixed values of the url query.
URL_RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]

_URL_SQL = """
WITH cut AS (
  SELECT page_id,
         CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS rest
  FROM pages),
parts AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), '{upper}', '{lower}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut),
rules(rule, host, path, verdict) AS (VALUES
  ('org/', 'org', '/', 'allow'), ('example.org/es/', 'example.org', '/es/', 'block'),
  ('example.org/en/1', 'example.org', '/en/1', 'block'), ('com/fr/', 'com', '/fr/', 'allow'),
  ('com/de/', 'com', '/de/', 'block')),
best AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.verdict, length(r.rule)) AS verdict
  FROM parts p LEFT JOIN rules r
    ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path)
  GROUP BY p.page_id, p.host, p.path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM best
""".format(upper=_UPPER, lower=_LOWER)


@query("op5_url_filter", _URL_SQL)
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url judged by the listed rules; a url that fits none is allowed."""
    values = ", ".join(f"('{rule}', '{verdict}')" for rule, verdict in URL_RULES)
    rules = spark.sql(f"SELECT * FROM VALUES {values} AS rules(rule, verdict)")
    return urls.judge(table(spark, sf_dir, "pages"), rules, "page_id")


#: The extra conversation whose texts say the template's own control strings.
_TRICKY = r"\### Assistant: </turn> ok"

_CHAT_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')),
shown AS (
  SELECT *, 17 + length(text) + length(regexp_replace(text, '[^\\<]', '', 'g'))
              + length(role) + length(regexp_replace(role, '[^\\<>\n]', '', 'g')) AS chars
  FROM turns)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM shown GROUP BY conv_id
"""


@query("op8_chat_format", _CHAT_SQL)
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation folded, rendered and read back, with one that quotes the template."""
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_TRICKY).alias("text"),
    )
    events = chat.as_events(given.unionByName(extra))
    return chat.read_back(chat.render(chat.fold(events)))


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=4, radius=4)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


_PQ_SQL = """
WITH RECURSIVE valid AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM valid a JOIN valid b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
degree AS (SELECT a, count(*) AS n FROM links GROUP BY a),
least AS (SELECT a, min(b) AS low FROM reach GROUP BY a)
SELECT vec_id, coalesce(d.n, 0) AS n_links, low AS component_id, vec_id = low AS kept
FROM embeddings JOIN least ON least.a = vec_id LEFT JOIN degree d ON d.a = vec_id
"""


@query("op10_embedding_pq", _PQ_SQL)
def op10_embedding_pq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings of a label at cosine 0.98."""
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"), limit=0.98)


def _codes_sql(rounds: int) -> str:
    """The six rounds spelt out: b<r> holds the entries, a<r> every distinct part's nearest one."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT p, part, n, min({{'far': far, 'e': e}}) AS best FROM (
    SELECT t.p, t.part, t.n, b.e,
           CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(t.part, b.entry)]) AS BIGINT) AS far
    FROM parts t JOIN b{r} b ON b.p = t.p) GROUP BY p, part, n)""")
        if r < rounds:
            steps.append(f"""b{r + 1} AS MATERIALIZED (
  SELECT p, e, coalesce(moved, entry) AS entry FROM b{r} LEFT JOIN (
    SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY j) AS moved FROM (
      SELECT p, best.e AS e, j, CAST(sum(n * part[j]) AS BIGINT) AS s, CAST(sum(n) AS BIGINT) AS c
      FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(part)) FROM parts) + 1)) AS j) GROUP BY p, best.e, j) GROUP BY p, e) USING (p, e))""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, label, [CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len([x for x in embedding if x IS NULL OR isnan(x) OR isinf(x)]) = 0),
cuts AS MATERIALIZED (
  SELECT k, p, list_slice(v, p * len(v) // 8 + 1, (p + 1) * len(v) // 8) AS part FROM kept, (SELECT unnest(range(8)) AS p)),
parts AS MATERIALIZED (SELECT p, part, count(*) AS n FROM cuts GROUP BY p, part),
b0 AS MATERIALIZED (
  SELECT p, r - 1 AS e, part AS entry FROM cuts JOIN (SELECT k, row_number() OVER (ORDER BY vec_id, v) AS r FROM kept) USING (k) WHERE r <= 16),
{", ".join(steps)},
coded AS MATERIALIZED (
  SELECT k, string_agg(printf('%02x', best.e), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error
  FROM cuts JOIN a{rounds} USING (p, part) GROUP BY k),
books AS (
  SELECT sha256(string_agg(array_to_string([CAST(x AS VARCHAR) for x in entry], ','), ',' ORDER BY p, e)) AS digest FROM b{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256
FROM kept JOIN coded USING (k), books
"""


@query("op11_vector_codes", _codes_sql(codes.ROUNDS))
def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all embeddings under codebooks fitted to all of them."""
    return codes.compress(table(spark, sf_dir, "embeddings"))


_PHRASES_SQL = f"""
WITH docs AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\\x0A-\\x0D]')) AS piece FROM docs),
split AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
grams AS (
  SELECT lang, list_slice(w, a, a + size - 1) AS g FROM (
    SELECT lang, w, size, unnest(range(1, len(w) - size + 2)) AS a FROM split, (SELECT unnest(range(1, 5)) AS size) WHERE len(w) >= size)),
f AS MATERIALIZED (SELECT lang, g, count(*) AS c FROM grams GROUP BY lang, g),
totals AS (SELECT lang, CAST(sum(c) AS BIGINT) AS n FROM f WHERE len(g) = 1 GROUP BY lang),
cand AS MATERIALIZED (SELECT lang, g, c AS a FROM f WHERE len(g) > 1 AND c >= 30),
cuts AS (SELECT lang, g, a, unnest(range(1, len(g))) AS k FROM cand),
priced AS (
  SELECT c.lang, c.g, c.a, c.k, l.c AS l, r.c AS r, (CAST(2000000 AS HUGEINT) * c.a) // (l.c + r.c) AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.g = list_slice(c.g, 1, c.k)
  JOIN f r ON r.lang = c.lang AND r.g = list_slice(c.g, c.k + 1, len(c.g))),
best AS (SELECT lang, g, a, min({{'score': score, 'k': k, 'l': l, 'r': r}}) AS b FROM priced GROUP BY lang, g, a),
inner_parts AS (
  SELECT lang, list_slice(g, i, i + size - 1) AS g, max(a) AS most FROM (
    SELECT lang, g, a, size, unnest(range(1, len(g) - size + 2)) AS i FROM (SELECT lang, g, a, unnest(range(2, len(g))) AS size FROM cand))
  GROUP BY ALL),
kept AS (
  SELECT b.lang, array_to_string(b.g, ' ') AS phrase, b.a, b.b.l AS l, b.b.r AS r, CAST(b.b.score AS BIGINT) AS score
  FROM best b LEFT JOIN inner_parts i USING (lang, g) WHERE i.most IS NULL OR 100 * i.most < 80 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
JOIN totals USING (lang) WHERE rank <= 2000
"""


@query("op12_collocations", _PHRASES_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of every language."""
    return phrases.collocations(table(spark, sf_dir, "documents"))


_REPEATS_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT k, doc_id, w, unnest(range(1, len(w) - 48)) AS a FROM docs WHERE len(w) >= 50),
wins AS MATERIALIZED (SELECT k, doc_id, a, array_to_string(list_slice(w, a, a + 49), ' ') AS win FROM starts),
least AS (SELECT win, min(doc_id) AS low FROM wins GROUP BY win HAVING min(doc_id) < max(doc_id)),
hits AS (SELECT k, unnest(range(a, a + 50)) AS p FROM wins JOIN least USING (win) WHERE low < doc_id),
gone AS (SELECT DISTINCT k, p FROM hits),
words AS (SELECT k, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM docs),
kept AS (
  SELECT k, string_agg(word, ' ' ORDER BY p) AS text, count(*) AS n FROM words LEFT JOIN (SELECT *, 1 AS mark FROM gone) USING (k, p) WHERE mark IS NULL GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (k)
"""


@query("op13_repeated_passages", _REPEATS_SQL)
def op13_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that a smaller doc_id has."""
    found = factors.without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
