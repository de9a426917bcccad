"""Quality rules as a bitmask ledger, in DataFrame operations only.

measure() evaluates each text once and ledger() stores its measurements and one bit for each rule it fails. A policy is a
versioned mask: apply_policy() keeps the rows that fail none of its rules, and ablations() tells from the ledger alone, by
bitwise aggregation, what each rule of a policy drops by itself and what the policy would keep without it.

Null and empty texts have no words and fail the rule of least length. Very long texts are measured whole. Repeated rows are
measured each. Extra columns of any name stay as they are in filter_documents().
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = "[\\x20\\x09-\\x0D]+"
TRIM = " \t\n\x0b\f\r"
SYMBOLS = "[#*$%&|<>]"
#: A window's number takes this many low bits of its packed fingerprint; longer texts, and the rare text in which packed
#: fingerprints of different windows are equal, are compared by the windows' words.
PLACE_BITS = 20

#: Each rule's bit is its place here. A rule is an SQL condition under which a text fails, over the measurements.
RULES = {
    "too_short": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "2 * n_dup_lines > n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
}
BASE = ("too_short", "repeated_words")
POLICIES = {
    "base": BASE,
    "v1": tuple(RULES),
}


def mask_of(policy: str | tuple[str, ...]) -> int:
    return sum(1 << list(RULES).index(r) for r in (POLICIES[policy] if isinstance(policy, str) else policy))


def _covered(places: Column) -> Column:
    """Words that three-word windows at these ascending places cover."""
    gaps = F.zip_with(F.slice(places, F.lit(2), F.size(places) - 1), F.slice(places, F.lit(1), F.size(places) - 1), lambda b, a: F.least(b - a, F.lit(3).cast("long")))
    return F.when(F.size(places) > 0, F.aggregate(gaps, F.lit(3).cast("long"), lambda total, gap: total + gap)).otherwise(F.lit(0).cast("long"))


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`doc`, the whole row as a struct, and the measurements."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    df = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("doc"), text.alias("t"))
    trimmed = F.btrim(F.col("t"), F.lit(TRIM))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACES))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    df = df.select("doc", words.alias("w"), lines.alias("l"), F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    df = df.select(
        "doc", "w", "n_symbols",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.size("l").cast("long").alias("n_lines"),
        (F.size("l") - F.size(F.array_distinct("l"))).cast("long").alias("n_dup_lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    place = (1 << PLACE_BITS) - 1
    windows = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))

    def print_of(i: Column) -> Column:
        return F.xxhash64(F.get("h", i), F.get("h", i + 1), F.get("h", i + 2)).bitwiseAND(F.lit(~place)).bitwiseOR(i.cast("long"))

    df = df.withColumn("p", F.sort_array(F.transform(windows, print_of)))

    def high(j: Column) -> Column:
        return F.shiftright(F.get("p", j), PLACE_BITS)

    def low(j: Column) -> Column:
        return F.get("p", j).bitwiseAND(F.lit(place)).cast("int")

    inner = F.when(F.size("p") > 1, F.sequence(F.lit(1), F.size("p") - 1)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("twins", F.filter(inner, lambda j: high(j) == high(j - 1)))  # places in p whose print is that of the one before

    def differs(j: Column) -> Column:
        a, b = low(j), low(j - 1)
        return F.get("w", a).__ne__(F.get("w", b)) | F.get("w", a + 1).__ne__(F.get("w", b + 1)) | F.get("w", a + 2).__ne__(F.get("w", b + 2))

    df = df.withColumn("clash", (F.size("p") > F.lit(place)) | F.exists("twins", differs))
    fast = F.array_sort(F.array_distinct(F.flatten(F.transform("twins", lambda j: F.array(low(j - 1), low(j)))))).cast("array<long>")
    df = df.withColumn("places", F.when(~F.col("clash"), fast))
    by_words = F.array_sort(F.transform(windows, lambda i: F.struct(F.array(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("g"), i.cast("long").alias("i"))))
    df = df.withColumn("s", F.when(F.col("clash"), by_words))
    all_s = F.sequence(F.lit(0), F.size("s") - 1)
    twin = F.filter(all_s, lambda j: (F.get("s", j)["g"] == F.get("s", j - 1)["g"]) | (F.get("s", j)["g"] == F.get("s", j + 1)["g"]))
    df = df.withColumn("places", F.when(F.col("clash"), F.array_sort(F.transform(twin, lambda j: F.get("s", j)["i"]))).otherwise(F.col("places")))
    return df.select("doc", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", _covered(F.col("places")).alias("n_repeat_words"))


def _judged(docs: DataFrame, text_col: str) -> DataFrame:
    bits = [F.when(F.expr(rule), F.lit(1 << i)).otherwise(F.lit(0)) for i, rule in enumerate(RULES.values())]
    failed = bits[0]
    for b in bits[1:]:
        failed = failed.bitwiseOR(b)
    judged = measure(docs, text_col).withColumn("failed", failed.cast("long"))
    # A generator's output: a filter on it is not moved below the measurements, where each use would compute them anew.
    return judged.select("doc", F.inline(F.array(F.struct(*MEASURES, "failed"))))


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, measurements and `failed`, the bits of all rules that the text fails."""
    return _judged(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), "text").select("doc.doc_id", *MEASURES, "failed")


def apply_policy(entries: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """The ledger with `kept` under a policy."""
    return entries.withColumn("kept", F.col("failed").bitwiseAND(F.lit(mask_of(policy))) == 0)


def ablations(entries: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """For each rule of a policy: rows that fail it, that fail it alone, and that the policy keeps without it."""
    mask = mask_of(policy)
    names = [r for r in RULES if mask_of((r,)) & mask]
    bad = F.col("failed").bitwiseAND(F.lit(mask))
    sums = [f(F.lit(mask_of((r,)))).cast("long").alias(f"{r}_{k}") for r in names for k, f in (("failed", lambda m: F.sum(F.when(bad.bitwiseAND(m) != 0, 1).otherwise(0))), ("alone", lambda m: F.sum(F.when(bad == m, 1).otherwise(0))), ("kept", lambda m: F.sum(F.when(bad.bitwiseAND(F.bitwise_not(m)) == 0, 1).otherwise(0))))]
    one = entries.agg(*sums)
    rows = F.array(*[F.struct(F.lit(r).alias("rule"), F.col(f"{r}_failed").alias("n_failed"), F.col(f"{r}_alone").alias("n_alone"), F.col(f"{r}_kept").alias("n_kept_without")) for r in names])
    return one.select(F.inline(rows))


def filter_documents(docs: DataFrame, policy: str | tuple[str, ...] = "v1", text_col: str = "text") -> DataFrame:
    """The rows of docs that a policy keeps, with all their columns."""
    return apply_policy(_judged(docs, text_col), policy).where("kept").select("doc.*")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    entries = apply_policy(ledger(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    base = F.col("failed").bitwiseAND(F.lit(mask_of("base"))) != 0
    return entries.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "n_lines", "failed")


OP10_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), g AS (
  SELECT doc_id, unnest(range(1, len(w) - 1)) AS i, w FROM t WHERE len(w) >= 3
), k AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM g
), r AS (
  SELECT doc_id, count(DISTINCT i + d) AS n_repeat_words FROM k, (VALUES (0), (1), (2)) AS v(d) WHERE c > 1 GROUP BY doc_id
), m AS (
  SELECT t.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM t LEFT JOIN r USING (doc_id)
), f AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT + 4 * (10 * n_symbols > n_words)::INT
    + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (word_chars < 2 * n_words OR word_chars > 15 * n_words)::INT)::BIGINT AS failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept, n_lines, failed FROM f
"""
