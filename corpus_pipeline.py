"""From raw documents to packed training sequences, in five stages that each work on all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.llm import decontaminate, jaccard, language, line_dedup, packing
from reviewlens.llm.common import small, table, text_key
from reviewlens.storage import materialize

LEAST_LANGUAGE_SHARE = 0.4


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: texts without a letter go, and those in which no language has a mean marginal of
    ``LEAST_LANGUAGE_SHARE``. Null and empty texts have no letter."""
    model = language.fit(language.learners(docs))
    found = docs.withColumn("__language", language.language_of(model, docs, F.col("text")))
    kept = (F.col("__language.lang") != language.UND) & (F.col("__language.score") >= LEAST_LANGUAGE_SHARE)
    return found.where(kept).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that came before, with n_chars counted anew; a document of which nothing but white space is
    left goes, one that had no such line stays as it is."""
    cut = line_dedup.cut_lines(docs, line_dedup.removed_lines(docs))
    left = cut.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    chars = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return left.select(*[chars.alias("n_chars") if c == "n_chars" else F.col(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of documents with similar shingle sets the one with the least doc_id (then the least hash of the text);
    of rows that repeat both, one. Documents without words all stay."""
    names, labels = jaccard.similar_sets(docs)
    named = names.where("node IS NOT NULL").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = named.groupBy("component", "doc_id", "k").count()
    rows = materialize(rows.withColumn("own", F.struct("doc_id", "k")), "grouped")
    first = rows.groupBy("component").agg(F.min("own").alias("first"))
    judged = rows.join(first, "component").where("own != first OR count > 1")
    judged = materialize(judged.select("doc_id", "k", (F.col("own") != F.col("first")).alias("gone")), "judged")
    key = lambda x: docs.doc_id.eqNullSafe(x.__id) & (F.xxhash64(docs.text) == x.__k)
    gone = small(materialize(judged.where("gone").select(F.col("doc_id").alias("__id"), F.col("k").alias("__k")), "gone"))
    twice = small(materialize(judged.where("NOT gone").select(F.col("doc_id").alias("__id"), F.col("k").alias("__k")), "twice"))
    kept = docs.join(gone, key(gone), "left_anti")
    repeated = kept.join(twice, key(twice), "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.join(twice, key(twice), "left_anti").union(repeated)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated by items of the benchmark."""
    found = decontaminate.touched_texts(docs, table(spark, sf_dir, "benchmark")).where("contaminated")
    keys = found.select("k1", "k2").toDF("__k1", "__k2")
    keys = small(materialize(keys, "contaminated"))
    k1, k2 = text_key(F.col("text").cast("string"))
    return docs.join(keys, (k1 == keys["__k1"]) & (k2 == keys["__k2"]), "left_anti")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents with their sequence and place in it."""
    return packing.pack_documents(docs)


STAGES = [
    ("language", known_language),
    ("line_dedup", without_repeated_lines),
    ("near_duplicates", one_of_each_group),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: The language model and the tokenizer can't be said in SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
