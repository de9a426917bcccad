"""References found by the engine beside a plain version that goes over one text."""

import random
import re

from pyspark.sql import functions as F

from loomwright.operators import links

# The shapes of references, in order of priority.
_WORDS = r"[A-Za-z][A-Za-z0-9'’\-]*(?:\s+[A-Za-z][A-Za-z0-9'’\-]*){0,6}"
_NUMBERS = r"[\d,\s\-–—]+"
SHAPES = (
    ("book", re.compile(rf"(?:(?P<label>{_WORDS})\s+)?\(?(?:see\s+)?Book\s*(?P<book>II|I|2|1)\s*[,:]?\s*(?:starting\s+on\s+)?pages?\s+(?P<pages>{_NUMBERS})\)?", re.I)),
    ("bold", re.compile(rf"\x04(?P<label>[^\x04\x05]*?)\x05(?:['’]s?)?\s*\(?\s*(?:see\s+)?pages?\s+(?P<pages>{_NUMBERS})\)", re.I)),
    ("title", re.compile(rf"(?P<label>{_WORDS})\s+\((?:see\s+)?pages?\s+(?P<pages>{_NUMBERS})\)")),
    ("paren", re.compile(rf"\((?:see\s+)?pages?\s+(?P<pages>{_NUMBERS})\)", re.I)),
    ("bare", re.compile(rf"(?<![\w/])(?:see\s+)?pages?\s+(?P<pages>{_NUMBERS})(?![\w/])", re.I)),
)
#: In previews all but the bold ones, with titles in any case.
PREVIEW_SHAPES = tuple((n, re.compile(p.pattern, re.I)) for n, p in SHAPES if n != "bold")


_PLAIN = str.maketrans("", "", "\x04\x05\x06\x07")


def references(text: str | None, shapes=SHAPES) -> list[dict]:
    """References in a text: each rule takes what the ones before it left, so none overlaps another. `shown` is a bold label with its
    switches and possessive."""
    out, work = [], text or ""
    for rule, pattern in shapes:
        for m in pattern.finditer(work):
            g = m.groupdict()
            label = (g.get("label") or "").translate(_PLAIN).strip(" (") or None
            if rule == "bold" and (not label or len(label) < 2):
                continue
            after = work[m.end("label") + 1 : m.end()].partition("(")[0] if rule == "bold" else ""
            shown = f"\x04{g['label'].rstrip(' (')}\x05{re.match(r'(?:[\'’]s?)?', after)[0]}" if rule == "bold" else None
            book = {"i": "book1", "1": "book1", "ii": "book2", "2": "book2"}.get((g.get("book") or "").lower())
            out.append({"rule": rule, "start": m.start(), "stop": m.end(), "label": label, "book": book, "pages": g["pages"].strip(" ,-–—"), "shown": shown})
            work = work[: m.start()] + "\0" * (m.end() - m.start()) + work[m.end() :]
    return sorted(out, key=lambda r: r["start"])


PIECES = [
    "the old mill", "Gordin's Delve", "Book II", "Book 1,", "starting on", "see", "(see", "pages 4, 5", "page 12", "(page 3)", "(pages 3-5)", "\x04Old Wolves\x05", "\x04x\x05", "\x04Stone (\x05", "'s", "’", "(page 9)", "a/page 3/b", "page", ")", ",", ".",
    "été", "PAGE 7", "(See Page 8)", "page ٣", "one two three four five six seven eight nine (page 44)", "\n", "-",
]


def test_references_against_a_plain_version(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice(PIECES) + rng.choice([" ", " ", " ", "", "\u00a0"]) for _ in range(rng.choice((1, 2, 4, 8, 20)))) for _ in range(1500)] + ["", "no reference"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", links.find_references("t").alias("a"), links.find_preview_references("t").alias("b")).collect()
    wrong = [(r.t, [x.asDict() for x in r.a], references(r.t)) for r in rows if [x.asDict() for x in r.a] != references(r.t)]
    assert not wrong, (len(wrong), wrong[0])
    wrong = [(r.t, [x.asDict() for x in r.b], references(r.t, PREVIEW_SHAPES)) for r in rows if [x.asDict() for x in r.b] != references(r.t, PREVIEW_SHAPES)]
    assert not wrong, (len(wrong), wrong[0])
    assert {x.rule for r in rows for x in r.a} == {"book", "bold", "title", "paren", "bare"}
    assert "Python" not in spark.createDataFrame([("page 1",)], "t string").select(links.find_references("t"))._jdf.queryExecution().executedPlan().toString().replace("PythonRDD", "")
    assert spark.createDataFrame([(None,)], "t string").select(F.size(links.find_references("t")).alias("n")).first().n == 0


def test_keys_of_labels_are_not_broadcast(spark):
    """A label becomes many keys, so the size of the file that it comes from says little about them."""
    labels = spark.range(2000).select(F.col("id").alias("label_id"), F.concat(F.lit("The Old Mill of House "), F.col("id").cast("string"), F.lit(" hall")).alias("label"))
    unique = spark.range(2000).select(F.concat(F.lit("old mill of house "), F.col("id").cast("string")).alias("norm"), F.concat(F.lit("a"), F.col("id").cast("string")).alias("slug"), F.lit("x").alias("id"))
    got = links.resolve_unique(labels, unique)
    assert {(r.label_id, r.slug, r.id) for r in got.collect()} == {(i, f"a{i}", "x") for i in range(2000)}
    asked = labels.select(F.col("label_id").alias("link_id"), F.lit(1).alias("page"), F.lit("s").alias("dst_slug"), "label")
    by_slug = unique.select(F.lit("s").alias("slug"), "norm", "id")
    both = links.fragments(asked, by_slug.withColumn("page", F.lit(1)), by_slug)
    for df in (got, both):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
