"""A corpus pipeline: language, quality, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes as Parquet and reads again as the next stage's documents.  All stages but
the last return the columns of ``documents``, and further ones whatever their
names.  Rows without an id are judged like all others; an empty table passes
every stage; texts are judged whole, however long they are.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellac.llm import chunk_bpe, decontaminate, jaccard_join, langid, quality
from shellac.llm.common import bounded_batches, dropped, read_table, written
from shellac.llm.queries import BYTE_FILE, QUALITY_LEAST, good_labels

#: A language is rejected below this probability; "und" always is.
LANGUAGE_LEAST = 0.25


def free(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is known; the network learns from their labels.

    Each row is judged by its text alone, so repeated rows fare alike.  Texts that
    are null, empty or without letters go; a null label is not learned from.
    """
    bounded_batches(spark)
    found = free(docs, "_found")
    judged = docs.withColumn(found, langid.language(langid.train(docs), F.col("text")))
    return judged.filter((F.col(found)["lang_pred"] != langid.UNKNOWN) & (F.col(found)["score"] >= LANGUAGE_LEAST)).drop(found)


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents that are probably of quality and not toxic.

    Each row is judged by its text, lang, source and n_chars, so repeated rows
    fare alike.  A null text is judged as an empty one, a null value of metadata
    as a value of its own; a threshold that is met exactly keeps the row.
    """
    bounded_batches(spark)
    model = quality.train(docs, good_labels(spark, sf_dir))
    found = free(docs, "_found")
    judged = docs.withColumn(found, quality.judged(model, F.col("text"), [F.col("lang"), F.col("source")], [F.col("n_chars")]))
    return judged.filter(F.col(found)["quality"] >= QUALITY_LEAST).drop(found)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the least id of each group of near duplicates (five-word shingles, 0.8).

    Rows that repeat an id are one document: of those the first by their
    contents stays.  Rows without an id stay, and so do texts without words (null,
    blank), which are like no other.
    """
    bounded_batches(spark)
    groups = jaccard_join.join(docs, size=5, percent=80)
    own, n, row = free(docs, "_id"), free(docs, "_n"), free(docs, "_row")
    first = written(groups.filter("doc_id = component_id").groupBy(F.col("doc_id").alias(own)).agg(F.count("*").alias(n)), "survivors")
    once = docs.join(first.filter(F.col(n) == 1).select(own), F.col("doc_id") == F.col(own), "left_semi")
    kept = once.unionByName(docs.filter("doc_id is null"))
    repeated = first.filter(F.col(n) > 1)
    if repeated.limit(1).count():
        others = [c for c in docs.columns if c != "doc_id"]
        again = docs.join(repeated.select(own), F.col("doc_id") == F.col(own), "left_semi")
        least = again.groupBy("doc_id").agg(F.min(F.struct(*(F.col(f"`{c}`") for c in others))).alias(row))
        kept = kept.unionByName(least.select("doc_id", *(F.col(row)[c].alias(c) for c in others)).select(*(F.col(f"`{c}`") for c in docs.columns)))
    return kept


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which a twentieth or more stands in the benchmark.

    Every row of such a text goes, those without an id too.  A null or wordless
    text stays; items without words hit nothing.
    """
    bounded_batches(spark)
    found = decontaminate.find_windows(docs, read_table(spark, sf_dir, "benchmark"))
    key = free(docs, "_key")
    hit = found.filter(decontaminate.contaminated(F.col("n_words"), F.col("n_hit"))).select(F.col("row_key").alias(key)).distinct()
    return docs.join(written(hit, "contaminated"), decontaminate.row_key(F.col("doc_id"), F.col("text")) == F.col(key), "left_anti")


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, with a digest of the text decoded from them.

    One row for each row; a null text counts as empty and has no ids.
    """
    bounded_batches(spark)
    path = public_tokenizers.path(BYTE_FILE)
    return chunk_bpe.decode(chunk_bpe.encode(docs, path), path).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language_id", language_id),
    ("quality_classifier", quality_classifier),
    ("near_duplicates", near_duplicates),
    ("benchmark_passages", benchmark_passages),
    ("bpe_tokens", bpe_tokens),
]

#: Trained models and tokenizers can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written and read again, and deleted once the next stage has been written."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, written(stage(spark, docs, sf_dir), name)
        dropped(before)
    return docs
