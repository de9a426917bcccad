"""Texts with their references as links: where each leads is found by joins, then every text is put together from its pieces."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import rich as R
from loomwright.functions import text as T
from loomwright.operators import links as K
from loomwright.sources.steps import settle



@dataclass
class Lookups:
    """pages: (book, page, slug, title); titles: (title_key, slug); by_page: (page, norm, slug, id); by_slug: (slug, norm, id);
    unique: (norm, slug, id)."""

    pages: DataFrame
    titles: DataFrame
    by_page: DataFrame
    by_slug: DataFrame
    unique: DataFrame


def anchor(slug: Column, fragment: Column, shown: Column, here: Column, prefix: str = "") -> Column:
    """A link to an article or a section of it; to a section of the article it stands in by the fragment alone."""
    has = fragment.isNotNull() & (fragment != "")
    to = F.concat(F.when(here & has, F.lit("")).otherwise(F.concat(F.lit(prefix), slug, F.lit(".html"))), F.when(has, F.concat(F.lit("#"), fragment)).otherwise(F.lit("")))
    data = F.when(has, F.concat(F.lit(' data-fragment="'), T.html_escape(fragment), F.lit('"'))).otherwise(F.lit(""))
    return F.concat(F.lit('<a class="wiki-link" href="'), to, F.lit('" data-slug="'), T.html_escape(slug), F.lit('"'), data, F.lit(">"), shown, F.lit("</a>"))


def split_label(label: Column, title: Column) -> Column:
    """struct(prefix, label): of the words before a page number those that are the article's title, or that are left without
    connectors in front; the rest goes before the link."""
    low = F.lower(label)
    article = F.lower(F.coalesce(title, F.lit("")))
    short = F.regexp_replace(article, "^the ", "")

    def ends(c: Column) -> Column:
        return (c != "") & low.endswith(F.concat(F.lit(" "), c))

    cut = F.when((low == article) | (low == short), 0).when(ends(article), F.length(article)).when(ends(short), F.length(short)).otherwise(0)
    first = F.when(cut > 0, F.rtrim(F.substring(label, F.lit(1), F.length(label) - cut))).otherwise(F.lit(""))
    rest = F.when(cut > 0, F.substring(label, F.length(label) - cut + 1, cut)).otherwise(label)
    clean = T.strip_label_noise(rest)
    w, n = T.words(rest), F.size(T.words(clean))
    tail = F.array_join(F.slice(w, F.greatest(F.size(w) - n + 1, F.lit(1)), F.greatest(n, F.lit(1))), " ")
    peel = (clean != "") & (T.section_key(clean) != T.section_key(rest)) & (n > 0) & (n <= F.size(w)) & (T.section_key(tail) == T.section_key(clean))
    head = F.array_join(F.slice(w, F.lit(1), F.greatest(F.size(w) - n, F.lit(0))), " ")
    return F.struct(F.trim(F.concat_ws(" ", first, F.when(peel, head).otherwise(F.lit("")))).alias("prefix"), F.when(peel, tail).otherwise(rest).alias("label"))


def with_dice(s: Column) -> Column:
    """Escaped text with its dice expressions as buttons."""
    pattern = T.ANY_DICE
    found = F.regexp_extract_all(s, F.lit(pattern), F.lit(1))
    between = F.split(s, pattern, -1)
    joined = F.array_join(F.zip_with(between, F.concat(F.transform(found, R.dice_button), F.array(F.lit(""))), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(s.rlike(pattern), joined).otherwise(s)


def _assemble(texts: DataFrame, key: str, text: str, pieces: DataFrame, plain, finish) -> DataFrame:
    """(key, html): every text with its pieces (key, start, stop, html) in place; what lies between goes through plain()."""
    per = pieces.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("start", "stop", "html"))).alias("p"))
    df = texts.join(per, key, "left").withColumn("p", F.coalesce("p", F.array().cast("array<struct<start:int,stop:int,html:string>>")))
    t = F.coalesce(F.col(text), F.lit(""))
    begins = F.concat(F.array(F.lit(0)), F.transform("p", lambda x: x["stop"]))
    ends = F.concat(F.transform("p", lambda x: x["start"]), F.array(F.length(t)))
    between = F.zip_with(begins, ends, lambda a, b: plain(F.substring(t, a + 1, b - a)))
    html = F.array_join(F.zip_with(between, F.concat(F.transform("p", lambda x: x["html"]), F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")
    return df.select(key, finish(html).alias("html"))


def rewrite(texts: DataFrame, lookups: Lookups, key: str = "text_id", text: str = "text", slug: str = "slug", book: str = "book") -> DataFrame:
    """(key, html): escaped texts with links, dice buttons and formatting; texts: (key, text, slug, book), the last two of the
    article that a text stands in.

    A reference to another book goes by that book's pages. A bold label that is a title leads to that article, whatever the page
    says. Of several pages the first has the label, the others stand in brackets after it. A link to its own article is plain
    text, or leads to the section alone; a label that no section of the target has goes to the one article that has such a section.
    """
    # Dealt anew: a small file is read by few tasks, and finding references costs much more than reading it.
    some = texts.where(F.col(text).rlike("(?i)page")).repartition(key).select(key, F.col(slug).alias("here"), F.col(book).alias("own_book"), F.posexplode(K.find_references(text)).alias("pos", "r"))
    refs = some.select(key, "pos", "here", F.coalesce("r.book", "own_book").alias("book"), "r.rule", "r.start", "r.stop", "r.label", "r.shown", T.page_numbers("r.pages").alias("nums")).withColumn("page", F.get("nums", F.lit(0)))
    refs = refs.join(lookups.pages.select("book", "page", F.col("slug").alias("page_slug"), F.col("title").alias("page_title")), ["book", "page"], "left")
    refs = refs.join(lookups.titles.select(F.col("title_key"), F.col("slug").alias("title_slug")), (F.col("rule") == "bold") & (F.lower("label") == F.col("title_key")), "left").drop("title_key")
    both = split_label(F.col("label"), F.col("page_title"))
    said = F.when(F.col("rule") == "title", both).otherwise(F.struct(F.lit("").alias("prefix"), F.col("label").alias("label")))
    # A generator's output is computed once and not put into each expression that uses it.
    refs = refs.select(key, "pos", "here", "book", "rule", "start", "stop", "shown", "nums", "page", "page_slug", "page_title", "title_slug", F.inline(F.array(said))).withColumn("link_id", F.struct(F.col(key).alias("k"), "pos"))
    refs = settle(refs, "references")  # read by each of the lookups below
    targets = refs.where("label is not null and title_slug is null and page_slug is not null")
    found = K.fragments(targets.select("link_id", "page", F.col("page_slug").alias("dst_slug"), "label"), lookups.by_page, lookups.by_slug)
    refs = settle(refs.join(found, "link_id", "left"), "references")
    lost = refs.where("rule <> 'bold' and label is not null and page_slug is not null and fragment is null")
    other = K.resolve_unique(lost.select(F.col("link_id").alias("label_id"), "label"), lookups.unique)
    refs = refs.join(other.select(F.col("label_id").alias("link_id"), F.col("slug").alias("else_slug"), F.col("id").alias("else_id")), "link_id", "left")
    here = F.col("page_slug").eqNullSafe(F.col("here"))
    label = T.html_escape("label")
    elsewhere = F.col("else_slug").isNotNull() & (F.col("else_slug") != F.col("page_slug"))
    number = F.concat(F.lit("p. "), F.col("page").cast("string"))
    first = (
        F.when(F.col("page").isNull(), F.coalesce(label, F.lit("")))
        .when(F.col("page_slug").isNull(), T.html_escape(F.coalesce("label", number)))
        .when(elsewhere, anchor(F.col("else_slug"), F.col("else_id"), label, F.col("else_slug").eqNullSafe(F.col("here"))))
        .when(here & F.col("fragment").isNull(), F.coalesce(label, F.lit("")))
        .otherwise(anchor(F.col("page_slug"), F.col("fragment"), F.coalesce(label, T.html_escape("page_title")), here))
    )
    to = F.coalesce("title_slug", "page_slug")
    shown = T.html_escape("shown")
    own = to.eqNullSafe(F.col("here"))
    bold = F.when(to.isNull(), F.concat(shown, F.lit(" "), number)).when(own & F.col("fragment").isNull(), shown).otherwise(anchor(to, F.when(F.col("title_slug").isNull(), F.col("fragment")), shown, own))
    refs = refs.select(key, "link_id", "start", "stop", "rule", "label", "prefix", "nums", "book", "here", F.explode(F.array(F.when(F.col("rule") == "bold", bold).otherwise(first))).alias("first"))
    more = refs.where("rule <> 'bold' and size(nums) > 1").select("link_id", "book", "here", F.posexplode(F.slice("nums", F.lit(2), F.size("nums"))).alias("n", "page"))
    more = more.join(lookups.pages.select("book", "page", "slug", "title"), ["book", "page"], "left")
    html = F.when(F.col("slug").isNull(), F.concat(F.lit("p. "), F.col("page").cast("string"))).when(F.col("slug").eqNullSafe(F.col("here")), F.lit("")).otherwise(anchor(F.col("slug"), F.lit(None).cast("string"), T.html_escape("title"), F.lit(False)))
    more = more.groupBy("link_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("n", html.alias("html")))), lambda x: x["html"]), " · ").alias("rest"))
    refs = refs.join(more, "link_id", "left")
    rest = F.coalesce("rest", F.lit(""))
    whole = F.when(F.col("label").isNull() & F.col("rest").isNotNull(), F.concat("first", F.lit(" · "), rest)).when(rest != "", F.concat("first", F.lit(" ("), rest, F.lit(")"))).otherwise(F.col("first"))
    whole = F.when(F.col("prefix") != "", F.concat(T.html_escape("prefix"), F.lit(" "), whole)).otherwise(whole)
    pieces = refs.select(key, "start", "stop", whole.alias("html"))
    return _assemble(texts, key, text, pieces, lambda s: with_dice(T.html_escape(s)), R.to_html)


def link_previews(texts: DataFrame, pages: DataFrame, sections: DataFrame, key: str = "text_id", text: str = "text", book: str = "book") -> DataFrame:
    """(key, html): previews with links, as the reader's side makes them; pages: (book, page, slug, title), sections: (slug, norm, id).

    Every number of a page list leads somewhere, a section is looked up by the label and with or without its last s alone, and
    links to the article itself are links too.
    """
    texts = texts.withColumn(text, T.html_escape(F.when(F.coalesce(F.col(text), F.lit("")) == "", F.lit("No summary available.")).otherwise(F.col(text))))
    some = texts.where(F.col(text).rlike("(?i)page")).select(key, F.col(book).alias("own_book"), F.posexplode(K.find_preview_references(text)).alias("pos", "r"))
    nums = F.transform(F.regexp_extract_all("r.pages", F.lit(r"(\d+)"), F.lit(1)), lambda n: n.cast("int"))
    refs = some.select(key, F.struct(F.col(key).alias("k"), "pos").alias("link_id"), F.coalesce("r.book", "own_book").alias("book"), "r.start", "r.stop", "r.label", nums.alias("nums"))
    each = refs.select("link_id", "book", "label", F.posexplode("nums").alias("n", "page")).withColumn("label", F.when(F.col("n") == 0, F.col("label")))
    each = each.join(pages.select("book", "page", "slug", "title"), ["book", "page"], "left")
    base = T.section_key("label")
    other = F.when(base.endswith("s") & (F.length(base) > 3), F.substring(base, F.lit(1), F.length(base) - 1)).otherwise(F.concat(base, F.lit("s")))
    for name, norm in (("one", base), ("two", other)):
        each = each.withColumn("norm", norm).join(sections.select("slug", "norm", F.col("id").alias(name)), ["slug", "norm"], "left").drop("norm")
    shown = F.coalesce("label", T.html_escape("title"), F.concat(F.lit("page "), F.col("page").cast("string")))
    html = F.when(F.col("slug").isNull(), F.coalesce("label", F.concat(F.lit("page "), F.col("page").cast("string")))).otherwise(anchor(F.col("slug"), F.coalesce("one", "two"), shown, F.lit(False)))
    joined = each.groupBy("link_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", html.alias("html")))), lambda x: x["html"]).alias("h"))
    refs = refs.join(joined, "link_id")
    rest = F.array_join(F.slice("h", F.lit(2), F.size("h")), " · ")
    whole = F.when(F.col("label").isNull(), F.array_join("h", " · ")).when(F.size("h") > 1, F.concat(F.get("h", F.lit(0)), F.lit(" ("), rest, F.lit(")"))).otherwise(F.get("h", F.lit(0)))
    return _assemble(texts, key, text, refs.select(key, "start", "stop", whole.alias("html")), lambda s: s, lambda s: s)
