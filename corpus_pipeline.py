"""The corpus pipeline: documents -> quality filter -> near-duplicate removal -> decontamination -> SentencePiece ids.

Each stage takes what the stage before kept (columns of ``documents``) and its decisions take effect; the last returns token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loglake.llm import decontaminate, minhash, pieces, quality
from loglake.llm.shared import stored, table

#: Keys of rows to drop are broadcast up to an eighth of this count (as many times the 8 bytes of an id), beyond it joined by shuffle.
BROADCAST_IDS = 2_000_000
#: Per cent of two documents' shingles that link them as near duplicates (the 85 of op8 is its own).
SIMILAR = 80


def row_key():
    """What tells a row: its id (null or not) and its text. Rows that share an id are not taken for each other."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.unhex(F.md5("text")).alias("text_key"))


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """``docs`` without the rows whose keys (one column) are given."""
    gone = stored(rows.toDF("_gone").distinct(), "gone")
    if gone.count() <= BROADCAST_IDS // 8:
        gone = F.broadcast(gone)
    return docs.join(gone, row_key() == F.col("_gone"), "left_anti")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that the classifier accepts; null and empty texts are scored like any, an empty table stays empty."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).filter("predicted = 1").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group (null ids come last); of rows with the same id and text one.

    A row is told by its id and text: another text under the id of a copy stays.
    """
    found = stored(minhash.near_duplicates(docs.select(row_key().alias("_row"), "text"), "_row", num=SIMILAR), "near")
    left = without(docs, found.filter("not kept").select("_row"))
    if found.groupBy("_row").count().filter("count > 1").limit(1).count():
        left = left.dropDuplicates(["doc_id", "text"])
    return left


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item; null and empty texts hold none, and a namesake of a dropped row stays."""
    found = decontaminate.find_leaks(docs.select(row_key().alias("_row"), "text"), table(spark, sf_dir, "benchmark"), id_col="_row")
    return without(docs, found.select("_row"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, with the best segmentations; null and empty texts have none."""
    return pieces.encode_documents(docs, pieces.Vocabulary.load())


STAGES = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: A fitted classifier and a segmentation search are beyond SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is stored for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stored(docs, f"stage-{name}")
    return docs
