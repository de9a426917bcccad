"""Tables of contents, articles, page lookups, sections and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions import text as T


def articles_from_toc(toc: DataFrame, last_page: int | None = None, book: str | None = None) -> DataFrame:
    """(ord, title, slug, start_page, end_page, kind) of first-level entries; ends are taken before contents and index go.

    book: a column that tells books apart; without one the table is one book's contents, some hundred rows that one task orders.
    """
    top = toc.where((F.col("level") == 1) & (F.col("page") >= 1)).withColumn("title", F.trim("title"))
    w = (Window.partitionBy(book) if book else Window.partitionBy(F.lit(0))).orderBy("ord")
    df = top.withColumn("end_page", F.coalesce(F.lead("page").over(w) - 1, F.lit(last_page)))
    df = df.where(~F.lower("title").isin("contents", "index"))
    kind = F.when(F.lower("title").contains("maps"), "maps").otherwise("article")
    return df.select(*([book] if book else []), "ord", "title", T.slug("title").alias("slug"), F.col("page").alias("start_page"), "end_page", kind.alias("kind"))


def pages_of(articles: DataFrame) -> DataFrame:
    """A row per page of each article; none for an empty range."""
    return articles.where("end_page >= start_page").withColumn("page", F.explode(F.sequence("start_page", "end_page")))


def page_lookup(articles: DataFrame) -> DataFrame:
    """(page, slug, title): of articles that share a page, the last by (start_page, ord)."""
    return pages_of(articles).groupBy("page").agg(F.max_by(F.struct("slug", "title"), F.struct("start_page", "ord")).alias("a")).select("page", "a.slug", "a.title")


def card_pairs(df: DataFrame, start: str, end: str) -> DataFrame:
    """Pages two by two, the last pair cut at the end."""
    pairs = df.where(F.col(end) >= F.col(start)).withColumn("first_page", F.explode(F.sequence(F.col(start), F.col(end), F.lit(2).cast("long"))))
    return pairs.withColumn("last_page", F.least(F.col("first_page") + 1, F.col(end)))


def nearest_title(pages: DataFrame, titles: DataFrame) -> DataFrame:
    """Each page's title: on the very page, else the first within a page, else null. Each title goes to the three pages that it can
    name, so pages and titles meet by equal keys."""
    near = titles.select(F.explode(F.array(F.struct((F.col("page") - 1).alias("page"), F.lit(1).alias("off")), F.struct("page", F.lit(0).alias("off")), F.struct((F.col("page") + 1).alias("page"), F.lit(1).alias("off")))).alias("n"), F.col("page").alias("t_page"), "title")
    best = near.groupBy(F.col("n.page").alias("page")).agg(F.min_by("title", F.struct("n.off", "t_page")).alias("title"))
    return pages.select("page").distinct().join(best, "page", "left")


def expand_hubs(hubs: DataFrame, children: DataFrame) -> DataFrame:
    """One row for a hub and one for each child, after it; hubs: (hub, ord, title), children: (hub, child_ord, title)."""
    top = hubs.select("hub", "ord", F.lit(0).alias("child_ord"), "title", F.lit("hub").alias("kind"))
    kids = children.join(hubs.select("hub", "ord"), "hub").select("hub", "ord", "child_ord", "title", F.lit("child").alias("kind"))
    return top.unionByName(kids)


def _first_free(rows: Column) -> Column:
    """The rows (order, base, row) with `id`: the base, or the base and the first number from 2 on that no row before it has made it."""
    start = F.struct(F.array().cast("array<string>").alias("taken"))

    def step(have: Column, x: Column) -> Column:
        numbers = F.sequence(F.lit(2), F.size(have["taken"]) + 2)
        free = F.filter(numbers, lambda i: ~F.array_contains(have["taken"], F.concat_ws("-", x["base"], i.cast("string"))))
        own = F.when(F.array_contains(have["taken"], x["base"]), F.concat_ws("-", x["base"], F.get(free, F.lit(0)).cast("string"))).otherwise(x["base"])
        return F.struct(F.concat(have["taken"], F.array(own)).alias("taken"))

    ids = F.aggregate(rows, start, step, lambda have: have["taken"])
    return F.zip_with(rows, ids, lambda x, i: F.struct(x["row"].alias("row"), i.alias("id")))


def unique_anchors(sections: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """`id`: the name's slug, with -2, -3 .. for later ones of a key.

    Where a literal name already is what a number would make (Foo, Foo, Foo 2), the number goes on, in the order of the rows. Names can
    only meet within a family, the names of a key that are equal but for numbers at their ends; only families in which they do are
    gone through row by row, all others are numbered by a window.
    """
    columns = sections.columns
    base = F.when(T.slug(name) == "", "section").otherwise(T.slug(name))
    df = sections.select(F.struct(*columns).alias("row"), F.col(key).alias("key"), F.col(order).alias("order"), base.alias("base"))
    df = df.withColumn("family", F.regexp_replace("base", "(-[0-9]+)+$", ""))
    df = df.withColumn("n", F.row_number().over(Window.partitionBy("key", "family", "base").orderBy("order")))
    own = F.when(F.col("n") == 1, F.col("base")).otherwise(F.concat_ws("-", "base", F.col("n").cast("string")))
    names = Window.partitionBy("key", "family", "id")
    df = df.withColumn("id", own).withColumn("shared", F.count("*").over(names))
    df = df.withColumn("meets", F.max("shared").over(Window.partitionBy("key", "family")) > 1)
    plain = df.where("not meets").select("row", "id")
    lists = df.where("meets").groupBy("key", "family").agg(F.sort_array(F.collect_list(F.struct("order", "base", "row"))).alias("rows"))
    folded = lists.select(F.inline(_first_free(F.col("rows"))))
    return plain.unionByName(folded).select("row.*", "id")


def sections_by_page(sections: DataFrame, articles: DataFrame) -> DataFrame:
    """(page, norm, slug, id): the last section of a name over the pages of its article; sections: (slug, pos, id, norm)."""
    on = pages_of(articles).select("slug", "page", F.col("ord").alias("a_ord")).join(sections, "slug")
    return on.groupBy("page", "norm").agg(F.max_by(F.struct("slug", "id"), F.struct("a_ord", "pos")).alias("s")).select("page", "norm", "s.slug", "s.id")


def unique_sections(sections: DataFrame) -> DataFrame:
    """(norm, slug, id) of names of several words that one article alone has; the id is the last one's."""
    many = sections.where(F.contains("norm", F.lit(" "))).groupBy("norm")
    return many.agg(F.countDistinct("slug").alias("n"), F.max("slug").alias("slug"), F.max_by("id", "pos").alias("id")).where("n = 1").drop("n")


def title_index(articles: DataFrame) -> DataFrame:
    """(title_key, slug): lower-case titles, and titles without a leading "the"; the first article to claim a key has it."""
    low = F.lower("title")
    own = articles.select(low.alias("title_key"), "slug", (F.col("ord") * 2).alias("o"))
    alias = articles.where(low.startswith("the ")).select(F.substring(low, 5, 1 << 20).alias("title_key"), "slug", (F.col("ord") * 2 + 1).alias("o"))
    return own.unionByName(alias).groupBy("title_key").agg(F.min_by("slug", "o").alias("slug"))


def dominant(df: DataFrame, key: list[str], kind: Column, weight: Column, order: Column) -> DataFrame:
    """The kind with the greatest total weight in each key; of equal ones the one seen first."""
    per = df.groupBy(*key, kind.alias("kind")).agg(F.sum(weight).alias("w"), F.min(order).alias("o"))
    return per.groupBy(*key).agg(F.max_by("kind", F.struct("w", -F.col("o"), "kind")).alias("kind"))
