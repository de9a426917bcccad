"""Fill-in-middle transformation by a two-pass streaming matcher in constant memory.

A text is a run of units, the matches of a pattern from left to right (code points unless said otherwise). The first pass over
the matches counts them; a hash of the document's id then gives the two ranks between which the middle lies, and the second pass
moves one lazy iterator of matches to the smaller rank and on to the larger one. Neither pass stores units: what a text needs
beside itself and its output is one match at a time.

The hash decides over the form too: plain texts stay as they are, psm gives prefix, suffix and middle, spm suffix, prefix and
middle, each after its mark. A text that holds a mark stays plain, so restore() can rebuild each text from its output and form
alone. Ranks and forms depend on seed and id, not on how the table is laid out, and there is no shuffle.

Null and empty texts are plain, with no units. Texts of any length are matched whole. Rows without an id are cut as an empty id
would be. Repeated rows give equal outputs. Bytes that are no UTF-8 count as one code point each and come back as they were. An
empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CODE_POINT = "(?s:.)"
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
MARKS = (PREFIX, SUFFIX, MIDDLE)
#: Of 100 texts, those that stay plain, and of 100 others, those in the order suffix, prefix, middle.
PLAIN, SPM = 10, 20
SEED = "1"
SCHEMA = "doc_id long, n long, form string, prefix_units long, middle_units long, output binary"


def count_units(unit: re.Pattern, text: str) -> int:
    last = deque(enumerate(unit.finditer(text), 1), maxlen=1)
    return last[0][0] if last else 0


def _end_of(units: Iterator[re.Match], more: int, at: int) -> int:
    """Where the match that comes `more` matches later ends; at, if more is 0."""
    return next(islice(units, more - 1, None)).end() if more else at


def bounds(unit: re.Pattern, text: str, low: int, high: int) -> tuple[int, int]:
    """Ends of the first `low` and of the first `high` units, low being no larger and both at most the number of units."""
    units = unit.finditer(text)
    first = _end_of(units, low, 0)
    return first, _end_of(units, high - low, first)


def rearranged(text: str, form: str, first: int, second: int) -> str:
    parts = {"psm": (PREFIX, text[:first], SUFFIX, text[second:]), "spm": (SUFFIX, text[second:], PREFIX, text[:first])}[form]
    return "".join((*parts, MIDDLE, text[first:second]))


def _draws(id_: Column, seed: str) -> list[Column]:
    """Four numbers below 2 ** 32 that follow from seed and id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("long").alias(f"h{k + 1}") for k in range(4)]


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = CODE_POINT, seed: str = SEED, plain: int = PLAIN, spm: int = SPM) -> DataFrame:
    """doc_id, n (units of the text), form, prefix_units and middle_units (null if plain), and the output text."""
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").cast("binary").alias("text"), *_draws(docs[id_col], seed))
    matcher = re.compile(unit)

    def one(id_, data, h1, h2, h3, h4):
        text = (data or b"").decode("utf-8", "surrogateescape")
        n = count_units(matcher, text)
        if not n or h3 % 100 >= 100 - plain or any(m in text for m in MARKS):
            return id_, n, "plain", None, None, data or b""
        low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
        form = "spm" if h4 % 100 < spm else "psm"
        return id_, n, form, low, high - low, rearranged(text, form, *bounds(matcher, text, low, high)).encode("utf-8", "surrogateescape")

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):  # outputs leave in small batches
                part = batch.slice(lo, 64)
                out = [one(*row) for row in zip(*[c.to_pylist() for c in part.columns], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=_NAMES)

    return rows.mapInArrow(run, SCHEMA).withColumn("output", F.col("output").cast("string"))


_NAMES = [f.split()[0] for f in SCHEMA.split(", ")]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]


def restore(form: Column, output: Column) -> Column:
    """The text, from an output and its form."""
    def between(start: str, end: str) -> Column:
        return F.substring_index(F.substring_index(output, end, 1), start, -1)

    middle = F.substring_index(output, MIDDLE, -1)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op11_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    done = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restore(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


OP11_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, ''))::BIGINT AS n, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents
), h AS (
  SELECT *, ('0x' || s[1:8])::BIGINT % (n + 1) AS a, ('0x' || s[9:16])::BIGINT % (n + 1) AS b, ('0x' || s[17:24])::BIGINT % 100 AS c, ('0x' || s[25:32])::BIGINT % 100 AS e FROM d
), f AS (
  SELECT *, least(a, b) AS lo, greatest(a, b) AS hi,
         CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR c >= 90 THEN 'plain' WHEN e < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), o AS (
  SELECT *, substring(t, 1, lo) AS p, substring(t, lo + 1, hi - lo) AS m, substring(t, hi + 1) AS q FROM f
)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || q || '<M>' || m ELSE '<S>' || q || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM o
"""
