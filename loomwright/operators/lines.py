"""Lines of documents as rows, and window operators over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions import rich as R
from loomwright.functions import rules as L
from loomwright.functions import text as T


def explode_lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, line) for every line; a narrow operation, no shuffle."""
    return docs.select(key, F.posexplode(F.split(F.coalesce(text, F.lit("")), "\n")).alias("pos", "line"))


def islands(df: DataFrame, key: list[str], order: str, kind: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of rows of one kind within each key."""
    w = Window.partitionBy(*key).orderBy(order)
    df = df.withColumn("kind_", kind)
    df = df.withColumn("new_", F.when(F.col("kind_").eqNullSafe(F.lag("kind_").over(w)), 0).otherwise(1))
    return df.withColumn(name, F.sum("new_").over(w)).drop("kind_", "new_")


def excerpt(lines: DataFrame, key: str = "doc_id", least_words: int = 50, least_chars: int = 40) -> DataFrame:
    """The paragraphs that first bring a document to least_words, the crossing one included; without any its first line.

    Paragraphs are unmarked lines outside info boxes with least_chars characters at least that are no entry, tags, hit points or
    dice header.
    """
    w = Window.partitionBy(key).orderBy("pos")
    box = F.last(F.when(F.col("line") == "\x02BOX", True).when(F.col("line") == "\x02ENDBOX", False), ignorenulls=True).over(w)
    clean = F.trim(R.plain("line"))
    other = F.col("clean").rlike(T.ENTRY) | T.tag_line("clean") | F.col("clean").rlike(T.HIT_POINTS) | F.col("clean").rlike(rf"(?i)^{T.DICE}\s+.+$")
    df = lines.withColumn("in_box", F.coalesce(box, F.lit(False))).withColumn("clean", clean)
    good = df.where(~F.col("in_box") & ~F.col("line").startswith("\x02") & (F.length("clean") >= least_chars) & ~other)
    n = F.size(T.words("clean"))
    good = good.withColumn("before", F.sum(n).over(w) - n).where(F.col("before") < least_words)
    body = good.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "clean"))).alias("p")).select(key, F.array_join(F.transform("p", lambda x: x["clean"]), "\n\n").alias("body"))
    first = lines.groupBy(key).agg(F.min_by("line", "pos").alias("first_line"))
    return first.join(body, key, "left").select(key, F.coalesce("body", R.strip_marker("first_line")).alias("excerpt"))


def next_heading(headings: DataFrame, key: str = "doc_id", levels: int = 6) -> DataFrame:
    """(key, pos, level, end): the place of the next heading of the same or a higher level (a smaller number); one pass over each
    document, no pairs."""
    ahead = Window.partitionBy(key).orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    at = [F.first(F.when(F.col("level") == n, F.col("pos")), ignorenulls=True).over(ahead) for n in range(1, levels + 1)]
    end = F.when(F.col("level") == 1, at[0])
    for n in range(2, levels + 1):
        end = end.when(F.col("level") == n, F.least(*at[:n]))
    return headings.select(key, "pos", "level", end.alias("end"))


def merge_tables(tables: DataFrame, key: str, order: str) -> DataFrame:
    """Joins a dice table to the one before it if the dice are the same and it goes on where that ended; adds `merged`."""
    w = Window.partitionBy(key).orderBy(order)
    goes_on = (F.lag("dice").over(w) == F.col("dice")) & (F.col("lo") == F.lag("hi").over(w) + 1)
    return tables.withColumn("new_", F.when(goes_on, 0).otherwise(1)).withColumn("merged", F.sum("new_").over(w)).drop("new_")


def carry_forward(df: DataFrame, key: str, order: str, value: Column, name: str) -> DataFrame:
    """The last value that isn't null, up to each row."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def toc_prose(s: Column | str) -> Column:
    """The first body paragraph after a chapter's table of contents."""
    line = F.trim(F.col(s) if isinstance(s, str) else s)
    n = F.size(F.filter(T.words(line), lambda w: w.rlike(r"^\p{Ll}")))
    openings = "|".join(L.CHAPTER_OPENINGS)
    return (F.length(line) >= 70) | ((F.length(line) >= 48) & ((n >= 2) | ((n >= 1) & line.rlike("[.!?]$")))) | ((F.length(line) >= 35) & line.rlike(f"(?i)^({openings})"))


def toc_garbage(s: Column | str) -> Column:
    """Scraps of glued columns around a table of contents."""
    line = F.trim(F.col(s) if isinstance(s, str) else s)
    w = T.words(line)
    soup = (F.size(F.filter(w, lambda x: x.rlike(r"^\p{Ll}"))) >= 2) & ~line.rlike("[.!?:]$")
    return (line == "") | (soup & ((F.size(w) >= 5) | (F.length(line) > 42))) | F.lower(line).isin(*L.LONE_SHARDS)


def toc_peel(lines: DataFrame, key: str = "doc_id", title: Column | None = None) -> DataFrame:
    """The lines with `part`: toc for a label of a leading table of contents, body for the text after it, null for scraps.

    There is one if a document has five lines or more, the first prose line is the fourth or later, no marked line and no long line
    of no known kind stands before it, and at least three labels do. Else all lines are body.
    """
    title = F.lit("") if title is None else title
    w = Window.partitionBy(key)
    line = F.trim("line")
    df = lines.withColumn("title_", F.coalesce(title, F.lit("")))
    df = df.withColumn("prose_", F.min(F.when(toc_prose("line"), F.col("pos"))).over(w)).withColumn("n_", F.count("*").over(w)).withColumn("first_", F.min("pos").over(w))
    df = df.withColumn("mark_", F.min(F.when(F.col("line").startswith("\x02"), F.col("pos"))).over(w)).withColumn("garbage_", toc_garbage("line"))
    early = F.col("pos") < F.col("prose_")
    own = (line != "") & (F.lower(T.normalize_text("line")) != F.lower(T.normalize_text("title_"))) & ~R.running_header(line, "title_", True) & ~F.col("garbage_")
    label = T.heading(line) | ((F.length(line) <= 40) & line.rlike(r"^\p{Lu}") & ~line.rlike("[.;,]$"))
    df = df.withColumn("label_", early & own & label).withColumn("odd_", early & own & ~label & (F.length(line) > 55))
    df = df.withColumn("body_", F.min(F.when(~early & ~F.col("garbage_"), F.col("pos"))).over(w))
    found = (F.col("n_") >= 5) & (F.col("prose_") - F.col("first_") >= 3) & F.coalesce(F.col("mark_") > F.col("prose_"), F.lit(True))
    found = found & (F.sum(F.col("label_").cast("int")).over(w) >= 3) & ~F.coalesce(F.max("odd_").over(w), F.lit(False)) & F.col("body_").isNotNull()
    part = F.when(~F.coalesce(found, F.lit(False)), "body").when(F.col("label_"), "toc").when(F.col("pos") >= F.col("body_"), "body")
    return df.withColumn("part", part).drop("title_", "prose_", "n_", "first_", "mark_", "garbage_", "label_", "odd_", "body_")


def classify(line: Column | str) -> Column:
    """The block kind of a line: the first class that claims it."""
    c = F.col(line) if isinstance(line, str) else line
    return (
        F.when(F.trim(c) == "", "blank").when(c.rlike("^[•\\-–] "), "bullet").when(T.roll_header(c), "dice").when(c.rlike(T.ENTRY), "entry").when(T.tag_line(c), "tags")
        .when(c.rlike(T.HIT_POINTS), "stats").when(T.value_header(c), "values").when(T.all_caps_label(c), "label").when(T.heading(c), "heading").otherwise("text")
    )


def blocks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, block, kind, lines): runs of lines of one kind as nested blocks."""
    df = islands(lines.withColumn("kind", classify("line")), [key], "pos", F.col("kind"), "block")
    return df.groupBy(key, "block", "kind").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]).alias("lines"))
