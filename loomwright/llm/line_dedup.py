"""Line dedup by a suffix array over sequences of line ids, built by distributed prefix doubling.

A document is its sequence of lines that hold a word; the suffixes are the places where such a line begins. A round sorts the
suffixes by their first 1, 2, 4 .. lines: a suffix's rank is the number of suffixes before its group, and the next round orders
a group by the ranks that stand as many lines further on; a suffix alone in its group has its final rank. Ranks come from sums
within ranges of the sorted order and the totals of the ranges (a number a range reaches the driver), so no group, however
large, is sorted or numbered in one task.

The neighbours in this order whose longest common prefix has h lines or more form the intervals of depth h. With d the last power
of two up to h, two suffixes share h lines exactly if the ranks of d lines agree at their first line and h - d lines later, so
the intervals of every depth are cut from the ranks of the rounds. In each interval the first place (smaller id, or earlier in
the document) is the copy that stays, and the runs of h lines at the others are later copies.

A later copy is deleted if it has at least `min_lines` lines or `min_words` words. What that deletes is the same for the maximal
runs and for all runs within them, since whatever is deleted in a later copy of more than min_lines lines is in later copies of
min_lines lines: each place of it but the last min_lines - 1 begins one. So the order is needed to min_lines lines and intervals
of depths 1 to min_lines; suffix_array() itself goes on until no group has two places, if no depth is given (log2(longest run)
rounds, over the documents alone that still share something). Runs of fewer than four lines with fewer than ten words stay, such
as one-line salutations.

Null and empty texts have no lines. Lines without a word are never deleted and never part of a run. Texts of any length are
read whole. Documents are told apart by id and text: unequal rows of one id are documents of their own (in the order of a hash
of their texts), and rows equal in both count as one document, so neither is cut for the other. A null id counts as the least.
Empty tables give no rows. Extra columns of any name stay as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from loomwright.llm import blocks as B
from loomwright.llm.scratch import settle

MIN_LINES = 4
MIN_WORDS = 10
WORD = "[^\\x20\\x09-\\x0D]"
PLACE_COLUMNS = ("doc_id", "print", "i", "rank", "run", "run_words")
_LEAST = -(1 << 63)
#: Suffixes that one range of the sorted order holds, about.
RANGE_ROWS = 20_000


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n")


def _document(docs: DataFrame, id_col: str, text_col: str) -> tuple[Column, Column]:
    """A document's key: its id, and the hash of its text."""
    return F.coalesce(docs[id_col].cast("long"), F.lit(_LEAST)).alias("doc_id"), F.xxhash64(docs[text_col].cast("string")).alias("print")


def _place() -> Column:
    return F.struct("doc_id", "print", "i")


def _numbered(groups: DataFrame, keys: list[str], parts: int) -> DataFrame:
    """Adds `to`: a group's rank and the number of rows in the groups of that rank that come before it in the order of the keys.

    groups: rank, the keys after it, n. Range by range; what a range's first rank has in earlier ranges is added to it.
    """
    ordered = groups.repartitionByRange(parts, "rank", *keys).sortWithinPartitions("rank", *keys)
    schema = S.StructType([*ordered.schema.fields, S.StructField("part", S.IntegerType()), S.StructField("within", S.LongType())])

    def count(batches):
        part, last, held = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rank, n = batch.column("rank").to_numpy(), batch.column("n").to_numpy()
            before = np.cumsum(n) - n
            fresh = np.append(rank[0] != last, rank[1:] != rank[:-1])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(n)), 0))
            within = before - np.where(fresh[first], before[first], -held)
            last, held = rank[-1], int(within[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part), pa.int32()), pa.array(within, pa.int64())], names=[*batch.schema.names, "part", "within"])

    counted = settle(ordered.mapInArrow(count, schema), "numbered")
    ends = counted.groupBy("part").agg(F.min("rank").alias("lo"), F.max(F.struct("rank", (F.col("within") + F.col("n")).alias("upto"))).alias("hi")).collect()
    carried, rank, upto = [], None, 0
    for r in sorted(ends, key=lambda r: r.part):
        carry = upto if r.lo == rank else 0
        if carry:
            carried.append((r.part, r.lo, carry))
        rank, upto = r.hi["rank"], r.hi["upto"] + (carry if r.hi["rank"] == r.lo else 0)
    to = F.col("rank") + F.col("within")
    if carried:  # at most one row a range
        more = groups.sparkSession.createDataFrame(carried, "part int, lo long, carry long")
        counted = counted.join(F.broadcast(more), "part", "left")
        to = to + F.when(F.col("rank") == F.col("lo"), F.col("carry")).otherwise(0)
    return counted.select("rank", *keys, "first", "shared", to.alias("to"))


def _groups(rows: DataFrame, keys: list[str]) -> DataFrame:
    found = rows.groupBy("rank", *keys).agg(F.count("*").alias("n"), F.min(_place()).alias("first"), F.max(_place()).alias("last"))
    return found.select("rank", *keys, "n", "first", (F.col("first") != F.col("last")).alias("shared"))


def suffix_array(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int | None = None) -> DataFrame:
    """(doc_id, print, i, rank, run, run_words) for each line that occurs at two places.

    rank orders the suffixes by their first `depth` lines (equal ones share it), or wholly. run is the depth of the deepest
    interval in which the place is a later copy, 0 if there is none, and run_words the words of these lines; intervals of all
    depths up to `depth` are looked at, or of 1, 2, 4 .. lines where none is given.
    """
    most = B.bucket_count(docs)
    held = F.transform(F.filter(_lines(docs[text_col]), lambda x: x.rlike(WORD)), lambda x: F.struct(F.unhex(F.md5(x)).alias("name"), F.regexp_count(x, F.lit(WORD + "+")).cast("long").alias("words")))
    lines = docs.select(*_document(docs, id_col, text_col), F.posexplode(held).alias("i", "line"))
    lines = settle(lines.select("doc_id", "print", "i", "line.name", "line.words", F.lit(0).cast("long").alias("rank")), "lines")
    names = _numbered(_groups(lines, ["name"]).where("shared"), ["name"], most).select("name", "first", "to")
    later = _place() != F.col("first")
    rows = lines.join(names, "name").select(
        "doc_id", "print", "i", F.col("to").alias("rank"), "words", F.lit(True).alias("active"), F.lit(False).alias("ended"),
        F.when(later, 1).otherwise(0).alias("run"), F.when(later, F.col("words")).otherwise(0).alias("run_words"), F.col("words").alias("own"),
    )
    rows, d, done = settle(rows, "suffixes"), 1, []
    document = Window.partitionBy("doc_id", "print")
    while (depth is None or d < depth) and (n_active := rows.where("active").count()):
        parts = min(most, 1 + n_active // RANGE_ROWS)  # later rounds are small
        between = range(d + 1, min(2 * d - 1, depth) + 1) if depth else ()
        doubled = depth is None or 2 * d <= depth

        def ahead(column: str, by: int):
            return F.first(column).over(document.orderBy("i").rangeBetween(by, by))

        seen = {f"then_{h}": ahead("rank", h - d) for h in between} | {f"words_{h}": F.sum("own").over(document.orderBy("i").rangeBetween(0, h - 1)) for h in between}
        pairs = rows.select("*", ahead("rank", d).alias("then"), ahead("words", d).alias("then_words"), *[c.alias(k) for k, c in seen.items()], F.max("active").over(document).alias("alive"))
        pairs = settle(pairs.where("alive").drop("alive"), "pairs")
        for h in between:  # two overlapping ranks are the rank of what they cover
            known = pairs.where(F.col("active") & F.col(f"then_{h}").isNotNull())
            groups = _groups(known, [f"then_{h}"]).where("shared").select(F.col("rank").alias("g_rank"), F.col(f"then_{h}").alias("g_then"), "first")
            here = known.join(groups, (F.col("rank") == F.col("g_rank")) & (F.col(f"then_{h}") == F.col("g_then"))).where(_place() != F.col("first"))
            done.append(here.select("doc_id", "print", "i", F.lit(None).cast("long").alias("rank"), F.lit(h).alias("run"), F.col(f"words_{h}").alias("run_words")))
        if not doubled:
            break
        alone = F.col("then").isNull()  # what follows occurs nowhere else: a group of one, ordered by its place
        keys = {"then": F.col("then"), "x": F.when(alone, F.col("doc_id")), "y": F.when(alone, F.col("print")), "z": F.when(alone, F.col("i"))}
        open_ = pairs.where("active").withColumns(keys).drop("ended")
        groups = _numbered(_groups(open_, list(keys)), list(keys), parts)
        groups = groups.select(F.col("rank").alias("g_rank"), *[F.col(k).alias(f"g_{k}") for k in keys], "first", "shared", "to")
        same = F.col("rank") == F.col("g_rank")
        for k in keys:
            same = same & F.col(k).eqNullSafe(F.col(f"g_{k}"))
        later, words = F.col("shared") & (_place() != F.col("first")), F.col("words") + F.col("then_words")
        moved = open_.join(groups, same).select(
            "doc_id", "print", "i", F.col("to").alias("rank"), F.when(F.col("shared"), words).otherwise(F.col("words")).alias("words"), F.col("shared").alias("active"), (~F.col("shared")).alias("ended"),
            F.when(later, 2 * d).otherwise(F.col("run")).alias("run"), F.when(later, words).otherwise(F.col("run_words")).alias("run_words"), "own",
        )
        still = pairs.where("not active").withColumn("ended", F.lit(False)).select(*moved.columns)
        rows, d = settle(moved.unionByName(still), "suffixes"), 2 * d
        done.append(rows.where("ended").select(*PLACE_COLUMNS))
    done.append(rows.where("active").select(*PLACE_COLUMNS))
    out = done[0]
    for table in done[1:]:
        out = out.unionByName(table)
    if not depth:
        return out
    out = out.groupBy("doc_id", "print", "i").agg(F.max("rank").alias("rank"), F.max(F.struct("run", "run_words")).alias("deepest"))
    return out.select("doc_id", "print", "i", "rank", "deepest.run", "deepest.run_words")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_lines: int = MIN_LINES, min_words: int = MIN_WORDS) -> DataFrame:
    """`doc`, the whole row as a struct, and n_lines, n_removed, n_runs (maximal deleted runs), longest (lines of the longest of
    these), kept_text."""
    later = suffix_array(docs, id_col, text_col, min_lines).where((F.col("run") >= min_lines) | ((F.col("run") > 0) & (F.col("run_words") >= min_words)))
    per = later.groupBy("doc_id", "print").agg(F.collect_list(F.struct("i", F.col("run").alias("n"))).alias("runs"))
    whole = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), *_document(docs, id_col, text_col), docs[text_col].cast("string").alias("t"))
    df = whole.join(per, ["doc_id", "print"], "left").withColumn("l", _lines(F.col("t")))
    places = F.filter(F.sequence(F.lit(0), F.size("l") - 1), lambda j: F.get("l", j).rlike(WORD))
    gone = F.array_sort(F.array_distinct(F.flatten(F.transform("runs", lambda r: F.sequence(r["i"], r["i"] + r["n"] - 1)))))
    df = df.withColumn("places", places).withColumn("gone", F.coalesce(gone, F.array().cast("array<int>")))
    df = df.withColumns({"first": F.array_except("gone", F.transform("gone", lambda k: k + 1)), "last": F.array_except("gone", F.transform("gone", lambda k: k - 1))})
    stay = F.array_except(F.sequence(F.lit(0), F.size("l") - 1), F.transform("gone", lambda k: F.get("places", k)))
    kept = F.when(F.size("gone") == 0, F.col("t")).otherwise(F.array_join(F.transform(stay, lambda j: F.get("l", j)), "\n"))
    told = F.struct(
        F.size("places").cast("long").alias("n_lines"),
        F.size("gone").cast("long").alias("n_removed"),
        F.size("first").cast("long").alias("n_runs"),
        F.coalesce(F.array_max(F.zip_with("first", "last", lambda a, b: b - a + 1)), F.lit(0)).cast("long").alias("longest"),
        kept.alias("kept_text"),
    )
    # A generator's output: a filter on it is not moved below, where it would compute all of it anew.
    return df.select("doc", F.inline(F.array(told)))


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    df = dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return df.select(F.col("doc.doc_id").alias("doc_id"), "n_lines", "n_removed", "n_runs", "longest", F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS j FROM documents
), w AS (
  SELECT doc_id, line, j, row_number() OVER (PARTITION BY doc_id ORDER BY j) AS i, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n
  FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), g AS (
  SELECT doc_id, i, n, n + lead(n) OVER d AS n2, n + lead(n) OVER d + lead(n, 2) OVER d AS n3, line AS a, lead(line) OVER d AS b, lead(line, 2) OVER d AS c, lead(line, 3) OVER d AS e FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)
), f AS (
  SELECT doc_id, i, 1 AS k FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY doc_id, i) AS r FROM g) WHERE r > 1 AND n >= 10
  UNION ALL SELECT doc_id, i, 2 FROM (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY doc_id, i) AS r FROM g WHERE b IS NOT NULL) WHERE r > 1 AND n2 >= 10
  UNION ALL SELECT doc_id, i, 3 FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, i) AS r FROM g WHERE c IS NOT NULL) WHERE r > 1 AND n3 >= 10
  UNION ALL SELECT doc_id, i, 4 FROM (SELECT *, row_number() OVER (PARTITION BY a, b, c, e ORDER BY doc_id, i) AS r FROM g WHERE e IS NOT NULL) WHERE r > 1
), x AS (
  SELECT DISTINCT doc_id, i + d AS i FROM f, (VALUES (0), (1), (2), (3)) AS v(d) WHERE d < k
), s AS (
  SELECT l.doc_id, l.j, l.line, w.i, x.i IS NOT NULL AS gone
  FROM l LEFT JOIN w ON l.doc_id = w.doc_id AND l.j = w.j LEFT JOIN x ON w.doc_id = x.doc_id AND w.i = x.i
), t AS (
  SELECT doc_id, count(i) AS n_lines, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(line, chr(10) ORDER BY j) FILTER (NOT gone), '') AS kept
  FROM s GROUP BY doc_id
), r AS (
  SELECT doc_id, count(*) AS n_runs, max(n)::BIGINT AS longest
  FROM (SELECT doc_id, i - r AS run, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS r FROM x) GROUP BY ALL) GROUP BY doc_id
)
SELECT t.doc_id, n_lines, n_removed, coalesce(n_runs, 0) AS n_runs, coalesce(longest, 0) AS longest, sha256(kept) AS kept_sha256 FROM t LEFT JOIN r ON t.doc_id = r.doc_id
"""
