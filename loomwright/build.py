"""A wiki from a book's extracted pages: articles, lines, blocks, links, previews, search index and pages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import lines, model, pages, parse, publish, rewrite, search, wrap
from loomwright.sources import sites, tables


@dataclass
class Book:
    """toc: (ord, level, title, page), pages: (page, width, height), spans, shapes, icons: as operators.pages takes them."""

    name: str
    toc: DataFrame
    pages: DataFrame
    spans: DataFrame
    shapes: DataFrame
    icons: DataFrame
    last_page: int


@dataclass
class Wiki:
    articles: DataFrame
    lines: DataFrame
    blocks: DataFrame
    sections: DataFrame
    rendered: DataFrame
    html: DataFrame
    previews: DataFrame
    search: DataFrame
    page_map: DataFrame


def linked(blocks: DataFrame, lookups: rewrite.Lookups, book: str) -> DataFrame:
    """The blocks with links in their texts, as HTML."""
    prose = F.when(F.col("kind").isin("paragraph", "move"), F.col("text")).otherwise(F.lit(""))
    texts = blocks.select(F.struct("slug", "pos").alias("block"), "slug", F.posexplode(F.concat(F.array(prose), F.transform("items", lambda x: x["text"]))).alias("i", "text"))
    texts = texts.select("block", "i", F.struct("block", "i").alias("text_id"), "text", "slug", F.lit(book).alias("book")).where("text <> ''")
    done = rewrite.rewrite(texts.select("text_id", "text", "slug", "book"), lookups)
    per = done.groupBy(F.col("text_id.block").alias("block")).agg(F.map_from_entries(F.collect_list(F.struct("text_id.i", "html"))).alias("said"))
    df = blocks.withColumn("block", F.struct("slug", "pos")).join(per, "block", "left")
    said = lambda i, else_: F.coalesce(F.try_element_at("said", i), else_)
    text = F.when(F.col("kind").isin("paragraph", "move"), said(F.lit(0), F.lit(""))).otherwise(F.col("text"))
    items = F.transform("items", lambda x, i: F.struct(x["label"].alias("label"), said(i + 1, F.lit("")).alias("text"), x["level"].alias("level")))
    return df.withColumn("text", text).withColumn("items", items).drop("block", "said")


def build(book: Book, work: str) -> Wiki:
    """The tables of a wiki. Each step is written as Parquet in the folder `work`, which all executors share, and read back, so that
    no step is computed twice and plans stay small."""

    def step(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{work}/{name}")
        return df.sparkSession.read.schema(df.schema).parquet(f"{work}/{name}")

    articles = step(model.articles_from_toc(book.toc, book.last_page), "articles")
    own = model.pages_of(articles).select("slug", "title", "page", (F.col("page") == F.col("start_page")).alias("first"))
    rows = pages.page_rows(book.pages.join(own, "page"), book.spans, book.shapes, book.icons)
    merged = step(wrap.merge_wrapped(pages.article_lines(step(rows, "pages")), "slug").join(articles.select("slug", "title"), "slug"), "lines")
    blocks = step(parse.parse(merged, wrapped=False), "blocks")
    sections = step(parse.sections(blocks), "sections")
    lookup = step(model.page_lookup(articles), "page_lookup")
    by_slug = sections.groupBy("slug", "norm").agg(F.max_by("id", "pos").alias("id"))
    lookups = rewrite.Lookups(
        lookup.withColumn("book", F.lit(book.name)), step(model.title_index(articles), "titles"), step(model.sections_by_page(sections, articles), "sections_by_page"), step(by_slug, "sections_by_slug"),
        step(model.unique_sections(sections), "unique_sections"),
    )
    rendered = step(publish.render(step(linked(blocks, lookups, book.name), "linked"), ready=True), "rendered")
    html = step(publish.article_html(rendered), "html")
    shown = step(publish.section_html(rendered, sections), "section_html")
    excerpts = step(lines.excerpt(merged, "slug"), "excerpts")
    base = articles.join(excerpts, "slug", "left").select("ord", "slug", "title", "kind", "excerpt")
    previews = search.previews(base.select("slug", "title", "excerpt", F.lit(book.name).alias("book")), shown.join(sections.select("slug", "id", "pos"), ["slug", "id"]))
    names = sections.groupBy("slug").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]), " ").alias("names"))
    text = base.join(html, "slug").join(names, "slug", "left")
    whole = F.concat("title", F.lit("\n"), F.coalesce("names", F.lit("")), F.lit("\n"), T.html_to_text("html"))
    documents = text.select("slug", "title", F.lit(book.name).alias("book"), F.substring(F.coalesce("excerpt", F.lit("")), 1, search.EXCERPT_CHARS).alias("excerpt"), F.substring(F.trim(whole), 1, search.TEXT_CHARS).alias("text"))
    page_map = search.page_map(lookup, sections).withColumn("book", F.lit(book.name))
    return Wiki(articles, merged, blocks, sections, rendered, html, step(previews, "previews"), step(documents, "search"), step(page_map, "page_map"))


def write(wiki: Wiki, folder: str, static: str | None = None) -> dict[str, int]:
    """The site in a folder that the driver and all executors share; numbers of what was written."""
    tables.reset_output(folder)
    n_static = tables.copy_static(static, folder) if static else 0
    navigation = publish.nav(wiki.articles, wiki.sections.select("slug", "pos", "id", "name"))
    whole, pages_written = tables.counted(publish.pages_with_nav(wiki.articles.join(wiki.html, "slug"), navigation), "pages")
    sites.write_pages(whole, f"{folder}/pages")
    sites.write_previews_script(wiki.previews, wiki.page_map, f"{folder}/js/previews-data.js")
    index_bytes = sites.write_search_script(wiki.search, f"{folder}/js/search-index.js")
    row = navigation.first()
    shell = publish.page_shell(F.lit("Wiki"), F.lit("\0"), F.lit(row["nav"].replace('href="', 'href="pages/') if row else ""), "")
    before, after = wiki.articles.sparkSession.range(1).select(shell.alias("html")).first().html.split("\0")
    cards = publish.index_cards(wiki.articles, wiki.previews).select("ord", F.lit("").alias("key"), F.col("card").alias("row"))
    start, end = before + '<h2>Topics</h2><div class="index-grid">', "</div>" + after
    sites.write_ordered(cards.sparkSession, [start, sites.Rows(cards, ("ord",), sites.as_is, between=""), end], f"{folder}/index.html")
    return {"pages": pages_written.get["n"], "sections": wiki.sections.count(), "static": n_static, "index_kb": index_bytes // 1024}
