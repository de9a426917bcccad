"""Search documents, ranked conjunctive search, previews and page maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions import text as T

TEXT_CHARS, EXCERPT_CHARS, SHOWN = 80_000, 280, 40


def search_documents(pages: DataFrame, slug: str, title: str, html: str, chars: int | None = TEXT_CHARS) -> DataFrame:
    """(slug, title, excerpt, text), the text cut to the size that the index allows, or whole without chars."""
    body = T.html_to_text(html)
    df = pages.select(F.col(slug).alias("slug"), F.col(title).alias("title"), body.alias("body"))
    text = F.concat_ws(" ", "title", "body")
    return df.select("slug", "title", F.substring("body", 1, EXCERPT_CHARS).alias("excerpt"), (F.substring(text, 1, chars) if chars else text).alias("text"))


def hits(docs: DataFrame, query: str, by: str = "slug") -> DataFrame:
    """Documents with all terms in the title or all in the text, in no order."""
    terms = [t for t in query.lower().split() if t]
    if not terms:
        return docs.where(F.lit(False)).select(by, "title", F.lit(0).alias("rank"), F.lit("").alias("where"), F.lit("").alias("snippet"))
    title, text = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    df = docs.withColumn("in_title", T.has_terms(title, terms)).withColumn("in_text", T.has_terms(text, terms)).where("in_title or in_text")
    rank = F.when(F.col("in_title") & (title == " ".join(terms)), -1).when(F.col("in_title"), 0).otherwise(1)
    where = F.when(F.col("in_title") & F.col("in_text"), "title + text").when(F.col("in_title"), "title").otherwise("text")
    hit = F.when(F.col("in_text"), T.snippet("text", terms)).otherwise(T.html_escape(F.coalesce("excerpt", "title")))
    return df.select(by, "title", rank.alias("rank"), where.alias("where"), hit.alias("snippet"))


def search(docs: DataFrame, query: str, limit: int | None = SHOWN, by: str = "slug", collation: str | None = "UNICODE") -> DataFrame:
    """Hits in order: exact titles, then titles, then texts; by title within a rank.

    Top-k of a filter: Spark keeps `limit` rows per task and merges those, so no full sort takes place.
    """
    df = hits(docs, query, by).orderBy("rank", F.collate("title", collation) if collation else "title", by)
    return df.limit(limit) if limit else df


def count_hits(docs: DataFrame, query: str) -> DataFrame:
    terms = query.lower().split()
    title, text = F.lower(F.coalesce("title", F.lit(""))), F.lower(F.coalesce("text", F.lit("")))
    return docs.where(T.has_terms(title, terms) | T.has_terms(text, terms)).agg(F.count("*").alias("n_hits"))


def filter_navigation(nav: DataFrame, sections: DataFrame, hits: DataFrame, query: str) -> DataFrame:
    """(slug, pos, shown): entries and sections; a section shows with its entry or by its own text, an entry also by a section's."""
    terms = query.lower().split()
    found = hits.select("slug").distinct().withColumn("hit", F.lit(True))
    parent = nav.join(found, "slug", "left").select("slug", (F.coalesce("hit", F.lit(False)) | T.has_terms(F.lower("title"), terms)).alias("own"))
    sub = sections.join(parent, "slug").withColumn("sub", T.has_terms(F.lower("name"), terms))
    by_sub = sub.groupBy("slug").agg(F.bool_or("sub").alias("any_sub"))
    top = parent.join(by_sub, "slug", "left").select("slug", F.lit(0).alias("pos"), (F.col("own") | F.coalesce("any_sub", F.lit(False))).alias("shown"))
    return top.unionByName(sub.select("slug", "pos", (F.col("own") | F.col("sub")).alias("shown")))


def page_map(lookup: DataFrame, sections: DataFrame) -> DataFrame:
    """(page, slug, title, sections): names of an article's sections to ids, the last of a name."""
    last = sections.groupBy("slug", "norm").agg(F.max_by("id", "pos").alias("id"))
    per = last.groupBy("slug").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("norm", "id")))).alias("sections"))
    return lookup.join(per, "slug", "left").select("page", "slug", "title", F.coalesce("sections", F.create_map().cast("map<string,string>")).alias("sections"))


def previews(articles: DataFrame, sections: DataFrame) -> DataFrame:
    """(slug, title, excerpt, sections map of (name, html, kind)); sections: (slug, pos, id, name, html, kind)."""
    last = sections.groupBy("slug", "id").agg(F.max_by(F.struct("name", F.coalesce("html", F.lit("")).alias("html"), "kind"), "pos").alias("s"))
    per = last.groupBy("slug").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("id", "s")))).alias("sections"))
    return articles.join(per, "slug", "left")


def resolve_preview(requests: DataFrame, previews_: DataFrame) -> DataFrame:
    """The best there is for (slug, fragment): a card's html, the section's html, the page's html, the excerpt."""
    df = requests.join(previews_, "slug", "left")
    section = F.try_element_at("sections", "fragment")["html"]
    card = F.when(F.col("kind") == "arcana", F.col("html"))
    none = lambda c: F.when(c != "", c)
    return df.select("request_id", "slug", F.coalesce(none(card), none(section), none(F.col("html")), F.col("excerpt")).alias("body"))


def top_titles(docs: DataFrame, key: str, k: int) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.length("title").desc(), "slug")
    return docs.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k)
