"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxtab.llm import langid, oracles, quality, toxicity
from voxtab.llm.jaccard import jaccard_components
from voxtab.llm.licenses import license_labels
from voxtab.llm.linededup import without_repeated_lines
from voxtab.llm.merkle import manifest
from voxtab.llm.neighbours import nearest
from voxtab.llm.packing import pack_documents
from voxtab.llm.pieces import encode_nbest
from voxtab.llm.repair import damaged, repair
from voxtab.llm.substring import repeated_passages
from voxtab.llm.warc import archive_round_trip
from voxtab.plans.lineage import materialize


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"))


def _id_crc(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.fit(docs.where(_id_crc(4) != 2))
    return langid.identify(docs, model).withColumn("held_out", F.coalesce(_id_crc(4) == 2, F.lit(False)))


def toxicity_model(spark: SparkSession, sf_dir: str) -> toxicity.Model:
    """Learned from the labels whose id's CRC-32 is no multiple of 5."""
    return toxicity.fit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels").where(_id_crc(5) != 0))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(_table(spark, sf_dir, "documents"), toxicity_model(spark, sf_dir))
    return scored.withColumn("held_out", F.coalesce(_id_crc(5) == 0, F.lit(False))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), n=4, percent=85)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_table(spark, sf_dir, "documents"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.length("text").alias("chars_left"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_table(spark, sf_dir, "pages"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    # Of rows that repeat a doc_id, all are judged in the stratum of the least language.
    strata = docs.where("doc_id is not null").groupBy("doc_id").agg(F.coalesce(F.min("lang"), F.lit("und")).alias("stratum"))
    counted = quality.text_counts(docs)
    known = counted.where("doc_id is not null").join(strata, "doc_id")
    counted = materialize(known.unionByName(counted.where("doc_id is null").withColumn("stratum", F.lit("und"))))
    labels = _table(spark, sf_dir, "labels").where("quality is not null and doc_id is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    cutoffs = quality.choose_cutoffs(counted.where(~quality.base_failed()).join(labels, "doc_id"))
    return quality.judge(counted, cutoffs)


def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_nbest(_table(spark, sf_dir, "documents"), n_best=3, with_ids=False).drop("ids")  # decoded_md5 is of the text that the ids decode to


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(_table(spark, sf_dir, "documents"), tampered=_id_crc(2) == 0)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(_table(spark, sf_dir, "conversations")))


def op13_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_labels(_table(spark, sf_dir, "documents"))


QUERIES = {"op11_merkle_manifest": op11_merkle_manifest, "op12_conversation_repair": op12_conversation_repair, "op13_license_scan": op13_license_scan, "op3_sentencepiece": op3_sentencepiece, "op7_quality_rules": op7_quality_rules, "op9_nearest_neighbours": op9_nearest_neighbours, "op5_line_dedup": op5_line_dedup, "op6_warc": op6_warc, "op1_substring_dedup": op1_substring_dedup, "op8_ngram_jaccard": op8_ngram_jaccard, "op2_packing": op2_packing, "op4_language_id": op4_language_id, "op10_toxicity": op10_toxicity}

ORACLE_SQL: dict[str, str] = {
    "op11_merkle_manifest": oracles.MERKLE,
    "op12_conversation_repair": oracles.REPAIR,
    "op13_license_scan": oracles.LICENSES,
    "op5_line_dedup": """
        WITH l AS (SELECT doc_id, g AS ln, line, trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS t
                   FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS g FROM documents WHERE text IS NOT NULL)),
        s AS (SELECT doc_id, ln, row_number() OVER d AS pos, t AS t0, lead(t, 1) OVER d AS t1, lead(t, 2) OVER d AS t2, lead(ln, 2) OVER d AS stop FROM l WHERE t <> '' WINDOW d AS (PARTITION BY doc_id ORDER BY ln)),
        w AS (SELECT doc_id, ln, stop, row_number() OVER (PARTITION BY t0, t1, t2 ORDER BY doc_id, pos) AS nth FROM s WHERE t2 IS NOT NULL
              UNION ALL SELECT doc_id, ln, ln, row_number() OVER (PARTITION BY t0 ORDER BY doc_id, pos) FROM s WHERE length(t0) >= 40),
        k AS (SELECT l.doc_id, l.ln, l.line, w.doc_id IS NOT NULL AS cut FROM l LEFT JOIN (SELECT DISTINCT doc_id, unnest(range(ln, stop + 1)) AS ln FROM w WHERE nth > 1) w USING (doc_id, ln))
        SELECT doc_id, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (cut) AS INTEGER) AS n_removed,
               CAST(length(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT cut), '')) AS INTEGER) AS chars_left,
               md5(coalesce(string_agg(line, chr(10) ORDER BY ln) FILTER (NOT cut), '')) AS text_md5
        FROM k GROUP BY 1
        UNION ALL SELECT doc_id, 0, 0, NULL, NULL FROM documents WHERE text IS NULL
    """,
    "op6_warc": """
        WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        k AS (SELECT payload_digest, max(page_id) AS top FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS DISTINCT FROM page_id AND top IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN top IS DISTINCT FROM page_id THEN top END AS refers_to, payload_digest AS declared_digest,
               CAST(CASE WHEN (top IS DISTINCT FROM page_id AND top IS NOT NULL) OR payload_bytes = 0 THEN 1 ELSE ceil(payload_bytes / 1048576.0) END AS INTEGER) AS chunks
        FROM p LEFT JOIN k USING (payload_digest)
    """,
}
