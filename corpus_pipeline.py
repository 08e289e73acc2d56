"""A corpus pipeline of five stages over `documents`.

Each stage takes what the stage before it kept, as Parquet, and all but the last return the columns
of documents. A row with a null doc_id is judged as any other: where a stage needs an identity, a hash of
its text is taken, above all ids, so that of a group of copies a row with an id stays before one without.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewell.llm import decontaminate, language_id, ngram_join, packing, secrets_scan
from framewell.llm.common import free_name, identity, table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps texts of a language that the labelled ones teach; texts without letters and ambiguous ones go."""
    found = language_id.identify(docs, language_id.train_fold(docs))
    return found.where("lang_pred <> 'und' and not ambiguous").select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of linked documents. Of rows with the same doc_id and text, or without a doc_id and with the same text, one stays."""
    key, digest = free_name(docs.columns, "_key"), free_name(docs.columns, "_digest")
    joined = ngram_join.ngram_join(docs.select(identity().alias("doc_id"), "text"))
    first = joined.where("doc_id = component_id").select(F.col("doc_id").alias(key)).distinct()
    rows = docs.withColumn(key, identity()).withColumn(digest, F.xxhash64("text"))
    kept = rows.join(first, key, "left_semi")
    # mostly none: only rows that repeat another meet in a shuffle with their texts, one for each task
    twice = written(rows.groupBy(key, digest).agg(F.count("*").alias("n")).where("n > 1").select(key, digest), "repeated")
    if not twice.isEmpty():
        kept = kept.join(twice, [key, digest], "left_anti").unionByName(kept.join(twice, [key, digest], "left_semi").dropDuplicates([key, digest]))
    return kept.select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that contain no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps all documents, their secrets replaced."""
    return secrets_scan.redact(docs, secrets_scan.train(secrets_scan.labelled_findings(spark)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, bucket, bucket_len, batch_id, slot, padding)."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

#: The learned and hashed stages have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
