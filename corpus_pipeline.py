"""A corpus pipeline of five stages over ``documents``.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's ``docs``. All but the last return the columns that they
were given.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from isobar.llm import bpe, decon, langid, pii, simhash
from isobar.llm.common import crc_of, fresh, quoted, stored, table


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows; those without letters or text go.

    A null text goes, a null lang teaches nothing, a null doc_id counts as the empty text
    when the teaching rows are chosen. Repeated rows are judged alike and all stay or go.
    """
    teach = docs.where(crc_of(F.col("doc_id")) % 4 != 2)
    model = langid.train(teach, "lang", "text")
    kept = {f"c{k}": F.col(quoted(n)) for k, n in enumerate(docs.columns)}
    found = langid.predict(docs.withColumn(mark := fresh(docs, "row"), F.lit(0)), model, mark, "text", kept)
    return found.where("lang_pred != 'und'").select(*[F.col(f"c{k}").alias(n) for k, n in enumerate(docs.columns)])


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the group's least doc_id.

    One row stays for each group, whatever repeats in it: of the rows that share the
    least doc_id, the one whose text hashes least; so a doc_id that repeats stays once in
    each group where it is the least. Null and empty texts are one group. Rows without a
    doc_id stay only where their group has no id at all, then one of them.
    """
    # Least doc_id first, rows without one last.
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("h"))
    found = simhash.near_duplicates(docs.select(key.alias("key"), "text"), "key", "text", shingle=4, radius=4)
    heads = found.where(F.col("key").eqNullSafe(F.col("component_id"))).select("key").distinct()
    given = docs.withColumn(mark := fresh(docs, "key"), key)
    one = given.join(heads, given[mark].eqNullSafe(heads["key"]), "left_semi")
    return one.dropDuplicates([mark]).select(*map(quoted, docs.columns))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of any benchmark item.

    Null and empty texts hold none and stay. Repeated rows and doc_ids, null or not, are
    judged one by one.
    """
    whole = F.struct(*map(quoted, docs.columns))
    found = decon.find(docs.select(whole.alias("row"), F.col("text").alias("words")), table(spark, sf_dir, "benchmark"), "row", "words")
    return found.where(decon.hit_words() == 0).select("row.*")


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text replaced by its kind; n_chars follows.

    A null text stays null, with n_chars null; an empty one stays empty. Repeated rows and
    doc_ids, null or not, all stay. Without a column n_chars none is made.
    """
    weights = pii.learn(docs)
    text = F.when(F.col("text").isNotNull(), pii.masked(F.col("text"), pii.spans(F.col("text"), weights)))
    done = docs.withColumn("text", text)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(*map(quoted, docs.columns))


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of what they decode to.

    Null and empty texts have no ids. Repeated rows and doc_ids, null or not, all stay.
    """
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode(docs, "doc_id", "text", ranks, public_tokenizers.PATTERN)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontaminate", decontaminate),
    ("mask_pii", mask_pii),
    ("byte_bpe", byte_bpe),
]

#: SQL can express neither the language model nor the hashes and learned spans.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = stored(docs, f"pipeline-{name}")
    return docs
