"""Cross-references: extraction by prioritised patterns, and resolution through keyed lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions import rich as R
from loomwright.functions import text as T
from loomwright.operators import wrap as W

# The shapes of references, in order of priority: name, pattern, whether case counts, and which group is the label, the book and the pages.
_WORDS = r"[A-Za-z][A-Za-z0-9'’\-]*(?:\s+[A-Za-z][A-Za-z0-9'’\-]*){0,6}"
_NUMBERS = r"[\d,\s\-–—]+"
SHAPES = (
    ("book", rf"(?:({_WORDS})\s+)?\(?(?:see\s+)?Book\s*(II|I|2|1)\s*[,:]?\s*(?:starting\s+on\s+)?pages?\s+({_NUMBERS})\)?", False, (1, 2, 3)),
    ("bold", rf"\x04([^\x04\x05]*?)\x05(?:['’]s?)?\s*\(?\s*(?:see\s+)?pages?\s+({_NUMBERS})\)", False, (1, None, 2)),
    ("title", rf"({_WORDS})\s+\((?:see\s+)?pages?\s+({_NUMBERS})\)", True, (1, None, 2)),
    ("paren", rf"\((?:see\s+)?pages?\s+({_NUMBERS})\)", False, (None, None, 1)),
    ("bare", rf"(?<![\w/])(?:see\s+)?pages?\s+({_NUMBERS})(?![\w/])", False, (None, None, 1)),
)
#: In previews all but the bold ones, with titles in any case.
PREVIEW_SHAPES = tuple((n, p, False, groups) for n, p, _, groups in SHAPES if n != "bold")
#: For sides that grow with the links or the sections. Their sizes are guessed from those of compressed files, before each row becomes
#: a dozen keys, and a side guessed too small would be broadcast through the driver.
NOT_BROADCAST = "merge"
FOUND = "array<struct<rule:string,start:int,stop:int,label:string,book:string,pages:string,shown:string>>"


def _taken(rule: str, pattern: str, case_counts: bool, groups: tuple, work: Column) -> Column:
    """struct(found, left): a rule's references in a text, and the text with these blanked out at their places."""
    shape = F.lit(("(?U)" if case_counts else "(?iU)") + pattern)
    of = lambda k: F.regexp_extract_all(work, shape, F.lit(k))
    label, book, pages = (of(k) if k else F.transform(of(0), lambda x: F.lit("")) for k in groups)
    whole = F.arrays_zip(of(0).alias("all"), label.alias("label"), book.alias("book"), pages.alias("pages"), F.split(work, ("(?U)" if case_counts else "(?iU)") + pattern, -1).alias("before"))

    def one(x: Column) -> Column:
        said = F.btrim(R.plain(x["label"]), F.lit(" ("))
        shown = F.concat(F.lit("\x04"), F.rtrim(x["label"], F.lit(" (")), F.lit("\x05"), F.regexp_extract(x["all"], "(?U)^\x04[^\x04\x05]*\x05((?:['’]s?)?)", 1))
        lower = F.lower(x["book"])
        return F.struct(
            x["before"].alias("before"), F.coalesce(x["all"], F.lit("")).alias("all"), F.when(said != "", said).alias("label"), F.when(lower.isin("i", "1"), "book1").when(lower.isin("ii", "2"), "book2").alias("book"),
            F.btrim(x["pages"], F.lit(" ,-–—")).alias("pages"), F.when(F.lit(rule == "bold"), shown).alias("shown"), (x["all"].isNotNull() & ((F.length(said) >= 2) if rule == "bold" else F.lit(True))).alias("taken"),
        )

    def step(have: Column, x: Column) -> Column:
        start = have["at"] + F.length(x["before"])
        stop = start + F.length(x["all"])
        told = F.array(F.struct(F.lit(rule).alias("rule"), start.alias("start"), stop.alias("stop"), x["label"].alias("label"), x["book"].alias("book"), x["pages"].alias("pages"), x["shown"].alias("shown")))
        blank = F.when(x["taken"], F.repeat(F.lit("\0"), F.length(x["all"]))).otherwise(x["all"])
        return F.struct(F.concat(have["found"], F.when(x["taken"], told).otherwise(F.array().cast(FOUND))).alias("found"), F.concat(have["left"], x["before"], blank).alias("left"), stop.alias("at"))

    begin = F.struct(F.array().cast(FOUND).alias("found"), F.lit("").alias("left"), F.lit(0).alias("at"))
    return F.aggregate(F.transform(whole, one), begin, step)


def references(text: Column, shapes=SHAPES) -> Column:
    """References in a text, by place: each rule takes what the ones before it left, so none overlaps another. `shown` is a bold label
    with its switches and possessive. Texts without "page" have none and are not looked at further."""

    def of(have: Column, left: tuple) -> Column:
        if not left:
            return have["found"]
        return T.bound(_taken(*left[0], have["left"]), lambda now: of(F.struct(F.concat(have["found"], now["found"]).alias("found"), now["left"].alias("left")), left[1:]))

    begin = F.struct(F.array().cast(FOUND).alias("found"), text.alias("left"))
    found = F.array_sort(of(begin, tuple(shapes)), lambda a, b: a["start"] - b["start"])
    return F.when(text.rlike("(?i)page"), found).otherwise(F.array().cast(FOUND))


def find_references(text: Column | str) -> Column:
    return references(F.col(text) if isinstance(text, str) else text)


def find_preview_references(text: Column | str) -> Column:
    return references(F.col(text) if isinstance(text, str) else text, PREVIEW_SHAPES)


def extract(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, rule, label, book, page, page_pos): a row for each page that a reference names."""
    some = df.where(F.col(text).rlike("(?i)page"))
    rows = some.select(key, F.posexplode(find_references(text)).alias("pos", "r"))
    return rows.select(key, "pos", "r.rule", "r.label", "r.book", F.posexplode(T.page_numbers("r.pages")).alias("page_pos", "page"))


def resolve(links: DataFrame, page_lookup: DataFrame, title_index: DataFrame, by_page: DataFrame, by_slug: DataFrame) -> DataFrame:
    """Adds dst_slug and fragment. A label that is a title goes before the page; sections by key order, and by (page, article) before (article).

    links: (link_id, label, page); by_page: (page, norm, slug, id); by_slug: (slug, norm, id). Lookups of pages and titles may be
    broadcast, keys of labels and sections never are.
    """
    df = links.withColumn("title_key", F.lower("label"))
    df = df.join(title_index.select("title_key", F.col("slug").alias("by_title")), "title_key", "left")
    df = df.join(page_lookup.select("page", F.col("slug").alias("by_page_slug")), "page", "left")
    df = df.withColumn("dst_slug", F.coalesce("by_title", "by_page_slug"))
    best = fragments(df.where("dst_slug is not null and by_title is null"), by_page, by_slug)
    return df.join(best.hint(NOT_BROADCAST), "link_id", "left").drop("title_key", "by_title", "by_page_slug")


def fragments(links: DataFrame, by_page: DataFrame, by_slug: DataFrame) -> DataFrame:
    """(link_id, fragment): the section that a label names in its article; links: (link_id, page, dst_slug, label).

    Keys in their order, each as it is and without spaces; a section on the very page goes before one of the article.
    """
    # Dealt anew: a small file is read by few tasks, and the keys of a label cost much more than reading it.
    keys = links.where("label is not null").repartition("link_id").select("link_id", "page", "dst_slug", F.posexplode(T.match_keys("label")).alias("k", "norm"))
    keys = keys.select("link_id", "page", "dst_slug", "k", F.explode(F.array(F.struct(F.lit(0).alias("c"), "norm"), F.struct(F.lit(2).alias("c"), F.replace("norm", F.lit(" "), F.lit("")).alias("norm")))).alias("p")).select("link_id", "page", "dst_slug", "k", "p.c", "p.norm")
    keys = keys.hint(NOT_BROADCAST)
    one = keys.join(by_page.select("page", "norm", F.col("slug").alias("dst_slug"), "id"), ["page", "norm", "dst_slug"]).select("link_id", (F.col("k") * 4 + F.col("c")).alias("o"), "id")
    two = keys.join(by_slug.select(F.col("slug").alias("dst_slug"), "norm", "id"), ["dst_slug", "norm"]).select("link_id", (F.col("k") * 4 + F.col("c") + 1).alias("o"), "id")
    return one.unionByName(two).groupBy("link_id").agg(F.min_by("id", "o").alias("fragment"))


def resolve_unique(labels: DataFrame, unique: DataFrame) -> DataFrame:
    """(label_id, slug, id) by a section name that one article alone has: whole keys first, then shorter and shorter beginnings of two words at least."""
    keys = labels.repartition("label_id").select("label_id", F.posexplode(T.match_keys("label")).alias("k", "norm"))
    w = F.split("norm", " ")
    heads = F.when(F.size(w) > 2, F.transform(F.sequence(F.size(w) - 1, F.lit(2), F.lit(-1)), lambda n: F.array_join(F.slice(w, F.lit(1), n), " "))).otherwise(F.array().cast("array<string>"))
    # One row for a key and each of its beginnings, so that keys are made once.
    each = F.concat(F.array(F.struct(F.col("k").alias("o"), "norm")), F.transform(heads, lambda x, j: F.struct((1000 + F.col("k") * 100 + j).alias("o"), x.alias("norm"))))
    tries = keys.select("label_id", F.inline(each))
    return tries.hint(NOT_BROADCAST).join(unique, "norm").groupBy("label_id").agg(F.min_by(F.struct("slug", "id"), "o").alias("s")).select("label_id", "s.slug", "s.id")


def _loud(c, share: int):
    """Whether at least this share (per cent) of a text's letters is upper case."""
    letters, upper = F.length(F.regexp_replace(c, r"[^\p{L}]", "")), F.length(F.regexp_replace(c, r"[^\p{Lu}]", ""))
    return (letters > 0) & (upper * 100 >= letters * share)


def title_facts(title):
    """What scoring needs of a title: its key, the key without spaces, and whether it is in capitals, as a label and as a name."""
    key = T.section_key(title)
    return F.struct(key.alias("key"), F.replace(key, F.lit(" "), F.lit("")).alias("close"), _loud(title, 75).alias("loud"), _loud(title, 60).alias("loud_name"))


def score_facts(a, b):
    """How well a table-of-contents label fits a section name, from their facts; null below 40 and for a label in capitals with a
    name that is not."""
    one, two = a["key"], b["key"]
    padded = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    first = (
        F.when(one == two, 100)
        .when(two.startswith(one) & (F.length(one) >= 3), 80 + F.least(F.length(one), F.lit(20)))
        .when(one.startswith(two) & (F.length(two) >= 4), 55 + F.least(F.length(two), F.lit(15)))
        .when((F.length(one) >= 6) & F.contains(padded(two), padded(one)), 45)
        .when(a["close"] == b["close"], 95)
        .when(b["close"].startswith(a["close"]) & (F.length(a["close"]) >= 4), 70)
        .otherwise(0)
    )
    score = first + F.when(a["loud"] & b["loud_name"] & (first > 0), 10).otherwise(0)
    return F.when((F.length(one) >= 2) & (two != "") & ~(a["loud"] & ~b["loud_name"]) & (score >= 40), score)


def title_score(label, name):
    """The score of two titles as written."""
    return score_facts(title_facts(label), title_facts(name))


def score_titles(labels: DataFrame, names: DataFrame) -> DataFrame:
    """(slug, label_pos, section_pos, score) of the pairs that score; labels: (slug, label_pos, label), names: (slug, section_pos, name).

    Only pairs meet that share the first three letters, or the label's first word, without which none scores.
    """
    key = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("value"))
    one = labels.select("slug", "label_pos", F.explode(F.array(title_facts(F.col("label")))).alias("a"))
    two = names.select("slug", "section_pos", F.explode(F.array(title_facts(F.col("name")))).alias("b"))
    start = lambda c: F.substring(c, 1, 3)
    one = one.withColumn("key", F.explode(F.array(key("start", start(F.col("a.close"))), key("word", F.substring_index("a.key", " ", 1)))))
    starts = F.array(key("start", start(F.col("b.close"))), key("start", F.substring("b.close", 1, 2)))
    two = two.withColumn("key", F.explode(F.array_distinct(F.concat(starts, F.transform(F.split("b.key", " "), lambda w: key("word", w))))))
    pairs = one.join(two, ["slug", "key"]).withColumn("score", score_facts(F.col("a"), F.col("b"))).where("score is not null")
    return pairs.select("slug", "label_pos", "section_pos", "score").distinct()


def assign_titles(scores: DataFrame) -> DataFrame:
    """Greedy in the order of labels: each takes its best section that is still free, of equal ones the first; scores: (slug,
    label_pos, section_pos, score)."""

    def step(state: dict, row: dict) -> list[dict]:
        if row["label_pos"] == state["label"] or row["section_pos"] in state["used"]:
            return []
        state["label"] = row["label_pos"]
        state["used"].add(row["section_pos"])
        return [row]

    df = scores.select("slug", "label_pos", "section_pos", "score")
    return W.fold(df, "slug", lambda row: {"label": None, "used": set()}, step, lambda state: [], df.schema, ("label_pos", F.desc("score"), "section_pos"))


def longest_first(titles: DataFrame, key: str) -> DataFrame:
    """A book's titles numbered from the longest."""
    w = Window.partitionBy(key).orderBy(F.length("title").desc(), "ord")
    return titles.withColumn("rank", F.row_number().over(w))
