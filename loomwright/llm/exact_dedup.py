"""Exact dedup by skew-safe combining, in DataFrame operations only.

A text whose digest no other row has needs no comparison, and isn't moved while the digests of the others can be sent around. The rest combine in three stages that compare full content each time:
copies meet locally, within the part of the input that holds them; the local winners of SALTS groups of parts meet; and the
winners of the salts meet globally. A group that holds a third of all rows so costs the last stage at most SALTS rows. What a
group has found goes back the same way, over the salts to the parts, so no task sees a row of every part. Ids of the members
travel in lists, each bounded by one input part, and are laid out again at the end.

Null and empty texts are equal; runs of white space count as one space, so texts may match that are not identical. Texts of any
length are compared whole. Repeated rows are members of a group like any others: a row is returned for each, and rows of the id
that stays all stay. Rows without an id are copies of any row with one; a group without ids keeps all its rows. An empty table
gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.llm.scratch import settle

SPACES = "[\\x20\\x09-\\x0D]+"
SALTS = 64
#: Digests of texts that occur twice that are sent to every executor; 64 bytes each. Where there are more, they are joined by shuffle.
MOST_SENT = 500_000


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row; the least id of equal texts stays."""
    text = F.regexp_replace(F.coalesce(docs[text_col].cast("string"), F.lit("")), SPACES, " ")
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), text.alias("norm"), F.spark_partition_id().alias("part")).withColumn("digest", F.sha2("norm", 256))
    counts = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("doc_id"))
    single = counts.where("n = 1").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "digest")
    # Read back, and joined by another spelling of the digest: then neither side's layout ties a hot digest's rows to one task.
    shared = settle(counts.where("n > 1").select(F.reverse("digest").alias("key")), "shared-digests")

    def combined(some: DataFrame) -> DataFrame:
        """Copies of each part as one row; the tasks that read them put them together before anything moves."""
        per = some.groupBy("key", "digest", "norm", "part")
        return per.agg(F.min("doc_id").alias("least"), F.count("*").alias("n"), F.collect_list(F.struct("doc_id")).alias("rows"))

    rows = rows.withColumn("key", F.reverse("digest"))
    if shared.count() <= MOST_SENT:  # texts that occur once stay where they are read
        local = combined(rows.join(F.broadcast(shared), "key", "left_semi")).drop("key")
    else:
        local = combined(rows).join(shared.hint("merge"), "key", "left_semi").drop("key")
    local = settle(local.withColumn("salt", F.pmod("part", F.lit(SALTS))).drop("part"), "local")
    salted = settle(local.groupBy("digest", "norm", "salt").agg(F.min("least").alias("least"), F.sum("n").alias("n")), "salted")
    whole = salted.groupBy("digest", "norm").agg(F.min("least").alias("keep_id"), F.sum("n").alias("group_size"))
    back = salted.select("digest", "norm", "salt").join(whole, ["digest", "norm"])
    members = local.join(back, ["digest", "norm", "salt"]).select(F.inline("rows"), "keep_id", "group_size", "digest")
    return single.unionByName(members).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def op7_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = r"""
WITH t AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents
)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM t WINDOW w AS (PARTITION BY norm)
"""
