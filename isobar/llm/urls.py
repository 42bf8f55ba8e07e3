"""URL filter: a blocked Bloom filter lets possible hits through to an exact join.

Rules (host, path prefix, verdict) are listed under the canonical key ``host + path``. A
url's possible keys have the shapes (labels, path length) that rules have; those that
pass the filter are joined with the rules, which removes false positives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from isobar.llm.common import lower_ascii

WORDS = 8  # 64-bit words in a block, one bit set in each (2^3, see _passes)
KEYS_PER_BLOCK = 24
MAX_BLOCKS = 1 << 16  # 4 MB; beyond it more false positives reach the join, none are lost


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column, blocks: Column) -> Column:
    return F.pmod(F.xxhash64(key), blocks)


def _bit(key: Column, word: int) -> Column:
    spread = F.xxhash64(key, F.lit("bits"))
    return F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(spread, 6 * word).bitwiseAND(F.lit(63)).cast("int"))


def bloom(keys: DataFrame) -> DataFrame:
    """One row (words): the filter over column ``key``, block after block, at most 4 MB."""
    n = min(max(-(-keys.count() // KEYS_PER_BLOCK), 1), MAX_BLOCKS)
    block = _block(F.col("key"), F.lit(n)).alias("block")
    marked = keys.groupBy(block).agg(*[F.bit_or(_bit(F.col("key"), w)).alias(f"w{w}") for w in range(WORDS)])
    # Blocks without a key are zeros, so that a block's place is its number.
    every = keys.sparkSession.range(n).withColumnRenamed("id", "block").join(marked, "block", "left")
    words = F.array(*[F.coalesce(f"w{w}", F.lit(0).cast("long")) for w in range(WORDS)])
    placed = every.agg(F.array_sort(F.collect_list(F.struct("block", words.alias("words")))).alias("rows"))
    return placed.select(F.flatten(F.transform("rows", lambda r: r["words"])).alias("words"))


def _passes(key: Column, words: Column) -> Column:
    at = (_block(key, F.shiftright(F.size(words), 3).cast("long")) * WORDS).cast("int")
    hit = F.lit(True)
    for w in range(WORDS):
        bit = _bit(key, w)
        hit = hit & (F.element_at(words, at + w + 1).bitwiseAND(bit) == bit)
    return hit


def parse_rules(rules: DataFrame) -> DataFrame:
    """(rule, verdict) to (key, rule, verdict, labels, chars); equal rules: block wins.

    A rule is ``host/path``; the host is lower-cased. Rules that are null, have no host or
    a verdict other than allow and block are left out.
    """
    host = lower_ascii(F.substring_index("rule", "/", 1))
    path = F.expr("substr(rule, length(substring_index(rule, '/', 1)) + 1)")
    cut = rules.where("verdict in ('allow', 'block')").select("rule", "verdict", host.alias("host"), path.alias("path")).where("host != ''")
    keyed = cut.select(
        F.concat("host", "path").alias("key"), "rule", "verdict",
        F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("chars"),
    )
    return keyed.groupBy("key", "labels", "chars").agg(F.max(F.struct("verdict", "rule")).alias("top")).select(
        "key", "labels", "chars", "top.rule", "top.verdict"
    )


def judge(pages: DataFrame, rules: DataFrame, id_col: str, url_col: str = "url", default: str = "allow") -> DataFrame:
    """(id, host, path, rule, verdict), one row per row of ``pages``.

    The longest fitting rule decides, by all its characters and then by its host's; a url
    that fits no listed rule gets ``default``. Null urls and urls without "://" have an
    empty host and path and fit nothing. Equal urls are judged once; repeated rows and
    null ids stay. Extra columns are not read.
    """
    listed = parse_rules(rules)
    shapes = listed.agg(F.collect_set(F.struct("labels", "chars")).alias("shapes")).scalar()
    words = bloom(listed.select("key")).scalar()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"))
    urls = rows.where("url is not null").select("url").distinct()
    split = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")).where("host != ''")
    split = split.withColumns({"labels": F.size(F.split("host", r"\.")), "shapes": shapes})
    fits = F.filter("shapes", lambda s: (s["labels"] <= F.col("labels")) & (s["chars"] <= F.length("path")))
    keys = F.transform(fits, lambda s: F.concat(
        F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]),
        F.call_function("substring", F.col("path"), F.lit(1), s["chars"]),
    ))
    keyed = split.select("url", F.explode(keys).alias("key")).withColumn("words", words)
    keyed = keyed.where(_passes(F.col("key"), F.col("words"))).drop("words")
    found = keyed.join(listed, "key").groupBy("url").agg(
        F.max(F.struct(F.length("key").alias("n"), (-F.col("chars")).alias("host_first"), "rule", "verdict")).alias("top")
    )
    judged = rows.join(found, "url", "left")
    return judged.select(
        F.col("id").alias(id_col), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"),
        F.col("top.rule").alias("rule"), F.coalesce("top.verdict", F.lit(default)).alias("verdict"),
    )
