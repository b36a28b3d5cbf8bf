"""From raw documents to packed training sequences.

Five stages, each over everything that its predecessor kept. All but the last return the columns of documents; other
columns, of any name, pass through. Null texts count as empty, and an empty table passes through every stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from medlink.llm import mixing, ngram_join, packing, quality_mil, quality_rules
from medlink.llm.common import shared_dir, short_batches, stored, table

#: Shares of the languages' tokens after mixing; documents are thinned out, none is repeated.
TARGETS = {"en": 0.6, "de": 0.15, "fr": 0.15, "es": 0.1}


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the attention classifier scores below 0.7."""
    short_batches(spark)
    model = quality_mil.train(docs, table(spark, sf_dir, "labels"))
    scored = docs.select(F.struct("*").alias("row"), quality_mil.quality(model, F.col("text")).alias("q"))
    return scored.where("q.score >= 0.7").select("row.*")


def quality_rules_vote(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the base rules, or that the rules' votes make likelier bad than good."""
    short_batches(spark)
    stated = docs.select(F.struct("*").alias("row"), quality_rules.stats(F.col("text")).alias("stats"))
    model = quality_rules.fit(stated)
    judged = quality_rules.with_posterior(stated, model)
    return judged.where(~quality_rules.base_failed(F.col("stats")) & (F.col("posterior") >= 0.5)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the least id; of wholly repeated rows, one.

    Rows are told apart by id and text, so rows that share an id are judged each for itself. Rows with a null id belong to
    no group and stay.
    """
    short_batches(spark)
    kept = ngram_join.representatives(docs).withColumnRenamed("doc_id", "kept_id").withColumnRenamed("mark", "kept_mark")
    mark = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), mark.alias("mark"), F.struct("*").alias("row"))
    chosen = keyed.join(kept, (keyed["id"] == kept["kept_id"]) & (keyed["mark"] == kept["kept_mark"]), "left_semi")
    return chosen.dropDuplicates(["id", "mark"]).unionByName(keyed.where("id is null")).select("row.*")


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Thin out documents of domains with too much, by rates of at most 1, until the expected shares of the tokens kept are the targets."""
    short_batches(spark)
    labelled = mixing.labelled_languages(docs, table(spark, sf_dir, "labels"))
    model = mixing.train(docs, labelled, list(TARGETS))
    member = mixing.membership(model, F.col("text")).alias("m")
    members = stored(docs.select(member).select("m.*"), "members")
    steps = mixing.fit_rates(members, list(TARGETS.values()), largest=1.0).steps
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id"), member).select("row", "doc_id", "m.*")
    return mixing.with_rates(rows, steps, largest=1.0).where("copies > 0").select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    short_batches(spark)
    return packing.pack_documents(docs)


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules_vote),
    ("n-gram Jaccard join", near_duplicates),
    ("mixing sources to target weights", mixing_weights),
    ("best-fit packing", best_fit_packing),
]

#: Learned models and tokenizers have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet into the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{number}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
