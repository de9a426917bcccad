"""An inverted index of trigrams, so that a search reads the lists of its terms and not all texts.

Three tables in a folder: `documents`, numbered rows in shards; `postings`, for each trigram and segment (a run of at most SEGMENT
documents that one task has read, named by the first one's number) the ascending places of the documents that hold it; `grams`, each
trigram and in how many documents it is. The last two are laid out in buckets by the trigram's hash and sorted by it, so a lookup
reads a few row groups.

Lists are made where the documents are read and shuffled once, to their buckets. A list is bounded by its segment however common its
trigram is. A query takes the rarest trigrams of each term, intersects their lists segment by segment, shortest first, and the
documents left (all that can match, and few others) are searched as by a scan: the answer is the scan's own. Texts are never
shuffled: numbers of candidates are sent to all tasks, and if a query's rarest trigram is in more than MOST_SENT documents, all of
them are searched.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomwright.operators import search as S

SEGMENT, BUCKETS = 1 << 16, 64
#: Trigrams of a term that are looked up, the rarest.
PER_TERM = 3
#: A segment ends before SEGMENT documents once its lists have so many places, which bounds a task's memory.
MOST_PLACES = 1 << 22
#: Candidates whose numbers go to all tasks; beyond them a scan moves less than a join of the texts.
MOST_SENT = 50_000
POSTINGS = "gram string, segment long, places array<int>, n int, bucket int"
GRAMS = "gram string, n long, bucket int"
#: Ascending places are stored as their differences.
GAPS = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.enable.dictionary#places.list.element": "false"}
_SHARD_BITS = 33  # of monotonically_increasing_id


def grams_of(text: str) -> np.ndarray:
    """Distinct trigrams, three code points of 21 bits each; the last one or two characters stand in one that is filled up."""
    c = np.frombuffer((text + "\0\0").encode("utf-32-le"), np.uint32).astype(np.uint64)
    return np.unique(c[:-2] << np.uint64(42) | c[1:-1] << np.uint64(21) | c[2:])


def _strings(grams: np.ndarray) -> list[str]:
    codes = np.stack([grams >> np.uint64(42), grams >> np.uint64(21), grams], axis=1) & np.uint64((1 << 21) - 1)
    all_ = codes.astype("<u4").tobytes().decode("utf-32-le")
    return [all_[i : i + 3] for i in range(0, len(all_), 3)]


def _lists(docs: DataFrame) -> DataFrame:
    """(gram, segment, places, n) from (doc, text), without a shuffle; numbers ascend in what a task reads of a shard."""
    longest, most = SEGMENT, MOST_PLACES

    def whole(first: int, grams: list[np.ndarray], places: list[int]) -> pa.RecordBatch:
        g, p = np.concatenate(grams), np.repeat(np.array(places, np.int32), [len(x) for x in grams])
        order = np.argsort(g, kind="stable")  # places of a trigram stay ascending
        g = g[order]
        starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
        ends = np.r_[starts, len(g)].astype(np.int32)
        held = pa.ListArray.from_arrays(pa.array(ends), pa.array(p[order]))
        return pa.record_batch([pa.array(_strings(g[starts])), pa.array(np.full(len(starts), first)), held, pa.array(np.diff(ends))], names=["gram", "segment", "places", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, last, held, grams, places = 0, 0, 0, [], []
        for batch in batches:
            for doc, text in zip(batch.column("doc").to_pylist(), batch.column("text")):
                found = grams_of(text.as_py())
                if grams and (doc <= last or doc - first >= longest or held + len(found) > most):
                    yield whole(first, grams, places)
                    held, grams, places = 0, [], []
                if not grams:
                    first = doc
                grams.append(found)
                places.append(doc - first)
                last, held = doc, held + len(found)
        if grams:
            yield whole(first, grams, places)

    return docs.select("doc", "text").mapInArrow(run, "gram string, segment long, places array<int>, n int")


def _term_grams(term: str) -> list[str]:
    return list(dict.fromkeys(term[i : i + 3] for i in range(len(term) - 2)))


def _bucket(gram: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(buckets)).cast("int")


@dataclass
class Index:
    documents: DataFrame
    postings: DataFrame
    grams: DataFrame
    buckets: int


def write_index(docs: DataFrame, folder: str, buckets: int = BUCKETS) -> Index:
    """docs: title, text and any other columns but doc and shard. One shuffle, of the trigrams; texts stay where they are read."""
    spark = docs.sparkSession
    numbered = docs.withColumn("doc", F.monotonically_increasing_id()).withColumn("shard", F.shiftright("doc", _SHARD_BITS).cast("int"))
    numbered.write.partitionBy("shard").option("compression", "zstd").parquet(f"{folder}/documents")
    # Read back: numbers must not change if a task runs again.
    held = spark.read.schema(numbered.schema).parquet(f"{folder}/documents")
    both = F.concat(F.lower(F.coalesce("title", F.lit(""))), F.lit("\0"), F.lower(F.coalesce("text", F.lit(""))))
    lists = _lists(held.select("doc", both.alias("text"))).withColumn("bucket", _bucket(F.col("gram"), buckets))
    dealt = lists.repartition("bucket", F.expr(f"segment div {64 * SEGMENT}")).sortWithinPartitions("bucket", "gram", "segment")
    dealt.write.partitionBy("bucket").options(**GAPS).parquet(f"{folder}/postings")
    totals = spark.read.schema(POSTINGS).parquet(f"{folder}/postings").groupBy("bucket", "gram").agg(F.sum("n").alias("n"))
    totals.repartition("bucket").sortWithinPartitions("bucket", "gram").write.partitionBy("bucket").parquet(f"{folder}/grams")
    return open_index(spark, folder, numbered.schema, buckets)


def open_index(spark: SparkSession, folder: str, documents: StructType | str, buckets: int = BUCKETS) -> Index:
    """documents: the schema of the indexed rows, with doc and shard."""
    schemas = {"documents": documents, "postings": POSTINGS, "grams": GRAMS}
    return Index(*[spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in schemas.items()], buckets)


def _of_grams(df: DataFrame, grams: list[str], buckets: int) -> DataFrame:
    """The rows of some trigrams; the buckets are values in the plan, so the others' folders are not listed."""
    spark = df.sparkSession
    at = spark.createDataFrame([(g,) for g in grams], "gram string").select(_bucket(F.col("gram"), buckets).alias("b")).distinct()
    return df.where(F.col("bucket").isin([r.b for r in at.collect()]) & F.col("gram").isin(grams))


def _lookup(index: Index, query: str) -> tuple[DataFrame, int, int]:
    """Lists of trigrams by segment and part of the query, how many parts there are, and how many documents may have all at most."""
    terms = list(dict.fromkeys(query.lower().split()))
    long_ = {t: _term_grams(t) for t in terms if len(_term_grams(t))}
    if long_:
        wanted = list(dict.fromkeys(g for gs in long_.values() for g in gs))
        n = {r.gram: r.n for r in _of_grams(index.grams, wanted, index.buckets).collect()}  # as many as the query has
        if any(g not in n for g in wanted):
            return index.postings, 0, 0
        picked = list(dict.fromkeys(g for gs in long_.values() for g in sorted(gs, key=lambda g: (n[g], g))[:PER_TERM]))
        return _of_grams(index.postings, picked, index.buckets).withColumn("part", F.col("gram")), len(picked), min(n[g] for g in picked)
    if terms:  # of one or two characters: in any of the trigrams that hold them
        parts = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(F.col("gram"), t))
        n = index.grams.withColumn("part", F.explode(parts)).groupBy("part").agg(F.sum("n").alias("n")).collect()  # as many as the query has
        lists = index.postings.withColumn("part", F.explode(parts))
        lists = lists.groupBy("segment", "part").agg(F.array_distinct(F.flatten(F.collect_list("places"))).alias("places")).withColumn("n", F.size("places"))
        return lists, len(terms), min(r.n for r in n) if len(n) == len(terms) else 0
    return index.postings, 0, 0


def _of_lists(index: Index, lists: DataFrame, groups: int, most: int) -> DataFrame:
    if not most:
        return index.documents.select("doc", "shard").where(F.lit(False))
    per = lists.groupBy("segment").agg(F.sort_array(F.collect_list(F.struct("n", "part", "places"))).alias("lists")).where(F.size("lists") == groups)
    common = F.aggregate(F.slice("lists", 2, groups), F.get("lists", F.lit(0))["places"], lambda have, x: F.array_intersect(have, x["places"]))
    found = per.select("segment", F.explode(common).alias("place")).select((F.col("segment") + F.col("place")).alias("doc"))
    return found.withColumn("shard", F.shiftright("doc", _SHARD_BITS).cast("int"))


def candidates(index: Index, query: str) -> DataFrame:
    """(doc, shard) of all documents that may have every term in title or text."""
    return _of_lists(index, *_lookup(index, query))


def _likely(index: Index, query: str) -> DataFrame:
    """The documents to search: the candidates, or all if these may be too many to be sent. Shards without a candidate are not read."""
    lists, groups, most = _lookup(index, query)
    if most > MOST_SENT:
        return index.documents
    return index.documents.join(F.broadcast(_of_lists(index, lists, groups, most)), ["shard", "doc"], "left_semi")


def hits(index: Index, query: str, by: str = "slug") -> DataFrame:
    """As search.hits over the indexed documents."""
    return S.hits(_likely(index, query), query, by)


def search(index: Index, query: str, limit: int | None = S.SHOWN, by: str = "slug", collation: str | None = "UNICODE") -> DataFrame:
    """As search.search over the indexed documents."""
    return S.search(_likely(index, query), query, limit, by, collation)
