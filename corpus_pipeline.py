"""From raw documents to token ids: filter, deduplicate, redact, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; between stages the rows are written as
Parquet and read again, so that a lost executor costs a stage's tasks and never the stages before.
All stages but the last return the columns of ``docs``.

Cases: every stage states those of its operator (nulls, empty and very long texts, repeated rows,
empty tables, further columns); further columns of the documents are carried through to the mix.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phrasewright.llm import piece_encoding, quality_rules, secret_scans, similar_texts, source_mixing
from phrasewright.llm._common import delete, documents, ensure_checkpoint_dir


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised quality rules reject go."""
    return quality_rules.keep_good(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of copies and near copies (five-word shingles, similarity 0.8) the smallest doc_id stays."""
    return similar_texts.keep_one(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets, and the linked parts of credentials, are cut out of the texts."""
    return secret_scans.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source gives its target of words: rows leave, stay or are repeated."""
    return source_mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids of the best segmentation, n_pieces, and the scores of the four best."""
    rows = piece_encoding.encode(docs, ["doc_id", "source"], piece_encoding.Vocabulary.load(), paths=False)
    return rows.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_pieces"), "scores")


STAGES = [
    ("quality rules", good_documents),
    ("SimHash near-dedup", one_of_each_group),
    ("secret scans", without_secrets),
    ("mixing sources", mixed),
    ("piece encoding", encoded),
]

#: Model fitting, components and the lattice search have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage has cut and the rows of the stage before are deleted once its own
    rows are written."""
    ensure_checkpoint_dir(spark)
    sc = spark.sparkContext
    base = sc.getCheckpointDir()
    folder = f"{base}/stages-{uuid.uuid4()}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        sc.setCheckpointDir(f"{folder}/work-{k}")
        try:
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        finally:
            sc.setCheckpointDir(base)
        docs = spark.read.parquet(f"{folder}/{k}")
        delete(spark, f"{folder}/work-{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
