"""A training-data pipeline over documents: toxicity, line dedup, near-duplicate join, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm import toxicity
from voxtab.llm.jaccard import jaccard_components
from voxtab.llm.linededup import without_repeated_lines
from voxtab.llm.packing import pack_documents
from voxtab.llm.queries import toxicity_model
from voxtab.llm.substring import repeated_passages, without_passages
from voxtab.plans.lineage import materialize


def _with_length(docs: DataFrame, columns: list[str]) -> DataFrame:
    """n_chars follows the text."""
    return docs.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint"))).select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the rows whose toxicity score is below 0.5; the model learns as in op10.

    Null and empty texts get the model's score of no words and are not toxic;
    repeated rows and null doc_ids are scored like any other. Without labels the
    model is neutral and every row stays. An empty table stays empty.
    """
    return toxicity.score_rows(docs, toxicity_model(spark, sf_dir)).where("toxicity_score < 0.5").drop("toxicity_score")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeated runs of lines; every row stays, those of null text or null doc_id unchanged.

    Rows of one doc_id with different texts are documents of their own; rows that
    agree in both are one document and get the same cuts.
    """
    return _with_length(without_repeated_lines(docs), docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row of the least doc_id of each group of near-duplicates (five-word shingles, 0.8 or more).

    Rows of one doc_id with different texts are documents of their own, of which
    each stays that is no near-duplicate; of rows that agree in doc_id and text one
    stays. Rows without words stay, but for such repeats; rows with a null doc_id
    all stay.
    """
    found = jaccard_components(docs, n=5, percent=80).where("leads and doc_id is not null")
    kept = materialize(found.groupBy(F.col("doc_id").alias("_doc"), F.col("version").alias("_version")).agg(F.count("*").alias("_rows")))
    mine = (F.col("doc_id") == F.col("_doc")) & (F.hash("text") == F.col("_version"))
    once = docs.join(kept.where("_rows = 1"), mine, "left_semi")
    repeated = docs.join(kept.where("_rows > 1"), mine, "left_semi").withColumn("_version", F.hash("text")).dropDuplicates(["doc_id", "_version"])
    return once.unionByName(repeated.drop("_version")).unionByName(docs.where("doc_id is null")).select(*docs.columns)


def dedup_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 50 words or more that came before; every row stays.

    Null texts and rows with a null doc_id stay as they are; of rows of one doc_id,
    each is cut by what its own text repeats.
    """
    return _with_length(without_passages(docs, materialize(repeated_passages(docs))), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of at most 4096 tokens; a null or empty text is the end token alone."""
    return pack_documents(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", dedup_lines), ("n-gram Jaccard join", dedup_documents), ("substring dedup", dedup_passages), ("packing", pack)]

#: SQL has neither the trained model, the alignment nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
