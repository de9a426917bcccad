"""From documents to packed training sequences: five stages, each written and read again before the next.

Every stage works on all that its predecessor kept; all but the last return the columns of documents. n_chars follows the text.

Documents are told apart by id; rows that share an id, or have none, by id and text, so that none is cut or dropped for another
text, and rows equal in both are one document, of which near_dedup keeps one row. Null and empty texts fail the first stage's rule
of least length. Of equal texts the one with the smallest id stays (of those that share an id, one that their hashes choose). Texts of any length are read whole, empty tables give no
rows, and extra columns of any name go along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.llm import scratch
from loomwright.llm.line_dedup import WORD, dedup_lines
from loomwright.llm.near_dedup import near_duplicates
from loomwright.llm.packing import pack
from loomwright.llm.quality_rules import filter_documents
from loomwright.llm.substring_dedup import dedup_substrings


def _with_text(df: DataFrame, columns: list[str], text, of: str) -> DataFrame:
    """The columns of documents held in the struct `of`, with another text."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[new.get(c, F.col(of)[c]).alias(c) for c in columns])


def _keyed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, text, doc), doc being the whole row, and the same with one row a key.

    A key is the id, or a hash of id and text where several rows have the id or there is none. No texts move to find that out.
    """
    shared = docs.groupBy(F.col("doc_id").alias("shared_id")).count().where("count > 1 or shared_id is null").select("shared_id")
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), docs["text"].alias("text"))
    if shared.isEmpty():
        rows = rows.select(F.col("doc.doc_id").cast("long").alias("key"), "text", "doc")
        return rows, rows
    rows = rows.join(shared.withColumn("hit", F.lit(True)), F.col("doc.doc_id").eqNullSafe(F.col("shared_id")), "left")
    key = F.when(F.col("hit"), F.xxhash64("doc.doc_id", "text")).otherwise(F.col("doc.doc_id").cast("long"))
    rows = scratch.settle(rows.select(key.alias("key"), "text", "doc"), "keyed")
    return rows, rows.dropDuplicates(["key"])


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a rule of policy v1 go."""
    return filter_documents(docs, "v1")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go, and documents of which no line is left."""
    cut = dedup_lines(docs).where((F.col("n_removed") == 0) | F.col("kept_text").rlike(WORD))
    return _with_text(cut, docs.columns, F.col("kept_text"), "doc")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: shingles of five words, similarity 0.8."""
    _, rows = _keyed(docs)
    kept = near_duplicates(rows, "key", "text").where("kept").select(F.col("doc_id").alias("kept_key"))
    return rows.join(kept, F.col("key") == F.col("kept_key"), "left_semi").select(*[F.col("doc")[c].alias(c) for c in docs.columns])


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in later copies of runs of twenty words go, and documents of which no word is left; those that lose none stay as they are."""
    whole, rows = _keyed(docs)
    cut = dedup_substrings(rows, "key", "text").where("n_removed > 0").select(F.col("doc_id").alias("cut_key"), "kept_text")
    whole = whole.join(cut, F.col("key") == F.col("cut_key"), "left").where("cut_key is null or kept_text <> ''")
    return _with_text(whole, docs.columns, F.when(F.col("cut_key").isNotNull(), F.col("kept_text")).otherwise(F.col("text")), "doc")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 1024 tokens, every window mixed in proportion to the sources."""
    return pack(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("packing", packing),
]

#: The stages cannot be told in SQL at a bearable cost; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    begun = scratch.mark()
    for name, stage in STAGES[:-1]:
        docs = scratch.settle(stage(spark, docs, sf_dir), name)
        scratch.clear(spark, begun, last=False)  # what the stage has gathered, and its predecessor's table
    return STAGES[-1][1](spark, docs, sf_dir)
