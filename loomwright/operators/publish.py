"""What is published: rendered blocks, navigation, hubs, maps, page shells, the index, and the data that the reader's side loads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from loomwright.functions import rich as R
from loomwright.functions import text as T
from loomwright.sources.steps import settle

# Colours of map pins.
PIN_COLORS = ("#e2534a", "#e08a3c", "#e6c34a", "#5aa85a", "#4a90d9", "#9b6dc4")


def _join(items: Column, one, between: str = "") -> Column:
    return F.array_join(F.transform(items, one), between)


def _tag(name: str, inner: Column, attributes: Column | str = "") -> Column:
    given = F.lit(attributes) if isinstance(attributes, str) else attributes
    return F.concat(F.lit("<" + name), given, F.lit(">"), inner, F.lit(f"</{name}>"))


def icon_image(path: Column, prefix: str = "../") -> Column:
    src = F.concat(F.lit(f'<img class="book-icon" src="{prefix}images/'), T.html_escape(F.regexp_replace(path, "^/+", "")), F.lit('" alt="" width="18" height="18" loading="lazy">'))
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("")).otherwise(src)


def roll_table(dice: Column, label: Column, entries: Column, anchor: Column, ready: bool = False) -> Column:
    """entries: array of (label, text)."""
    rows = _join(entries, lambda e: F.concat(F.lit('<tr><th scope="row">'), T.html_escape(e["label"]), F.lit("</th><td>"), e["text"] if ready else T.html_escape(e["text"]), F.lit("</td></tr>")))
    id_ = F.when(anchor != "", F.concat(F.lit(' id="'), T.html_escape(anchor), F.lit('"'))).otherwise(F.lit(""))
    head = F.concat(F.lit('<div class="roll-table-head">'), R.dice_button(dice), F.lit(' <span class="roll-label">'), T.html_escape(label), F.lit("</span></div>"))
    return _tag("div", F.concat(head, F.lit("<table><tbody>"), rows, F.lit("</tbody></table>")), F.concat(F.lit(' class="roll-table"'), id_))


def value_table(title: Column, rows: Column, notes: Column, ready: bool = False) -> Column:
    """rows: array of (item, value); notes: array of texts."""
    body = _join(rows, lambda r: F.concat(F.lit("<tr><td>"), r["item"] if ready else T.html_escape(r["item"]), F.lit('</td><td class="val">'), T.html_escape(r["value"]), F.lit("</td></tr>")))
    below = _join(notes, lambda n: F.concat(F.lit('<div class="value-note">'), n if ready else T.html_escape(n), F.lit("</div>")))
    return F.concat(F.lit('<div class="value-table"><div class="value-table-head">'), T.html_escape(title), F.lit("</div><table><tbody>"), body, F.lit("</tbody></table>"), below, F.lit("</div>"))


def check_list(items: Column, base: Column, ready: bool = False) -> Column:
    def one(x: Column, i: Column) -> Column:
        cid = T.html_escape(F.concat(base, F.lit("-"), i.cast("string")))
        return F.concat(F.lit('<li class="check-item"><label for="'), cid, F.lit('"><input type="checkbox" class="wiki-check" id="'), cid, F.lit('" data-check-id="'), cid, F.lit('"> <span>'), x if ready else T.html_escape(x), F.lit("</span></label></li>"))

    rows = F.array_join(F.transform(items, one), "")
    return F.when(F.size(items) > 0, F.concat(F.lit('<ul class="check-list" data-check-list="'), T.html_escape(base), F.lit('">'), rows, F.lit("</ul>"))).otherwise(F.lit(""))


def mark_track(n: Column, base: Column, label: Column) -> Column:
    def step(i: Column) -> Column:
        cid = T.html_escape(F.concat(base, F.lit("-"), (i - 1).cast("string")))
        number = i.cast("string")
        return F.concat(F.lit('<label class="track-step" for="'), cid, F.lit('" title="Mark '), number, F.lit('"><input type="checkbox" class="wiki-check" id="'), cid, F.lit('" data-check-id="'), cid, F.lit('" aria-label="Mark '), number, F.lit('"></label>'))

    steps = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), step), "")
    whole = F.concat(F.lit('<div class="arcana-track" data-check-list="'), T.html_escape(base), F.lit('"><span class="track-label">'), T.html_escape(label), F.lit('</span><span class="track-steps">'), steps, F.lit("</span></div>"))
    return F.when(n > 0, whole).otherwise(F.lit(""))


def block_html(inner: Column, ready: bool = False) -> Column:
    """The HTML of a typed block (kind, level, anchor, name, text, items) around that of the blocks in it. ready: texts are HTML."""
    plain = (lambda c: c) if ready else T.html_escape
    kind, name, text, anchor, items = (F.col(c) for c in ("kind", "name", "text", "anchor", "items"))
    id_ = F.when(anchor != "", F.concat(F.lit(' id="'), T.html_escape(anchor), F.lit('"'))).otherwise(F.lit(""))
    of = lambda label: F.filter(items, lambda x: x["label"] == label)
    texts = lambda a: F.transform(a, lambda x: x["text"])
    rich = (lambda c: c) if ready else (lambda c: R.to_html(T.html_escape(c)))
    listed = lambda cls: F.concat(F.lit(f'<ul class="{cls}">'), _join(items, lambda x: F.concat(F.lit("<li>"), rich(x["text"]), F.lit("</li>"))), F.lit("</ul>"))
    level = F.col("level").cast("string")
    heading = F.concat(F.lit("<h"), level, id_, F.lit(">"), F.when(text != "", F.concat(R.dice_button(text), F.lit(" "))).otherwise(F.lit("")), T.html_escape(name), F.lit("</h"), level, F.lit(">"))
    priced = F.transform(of("row"), lambda x: F.struct(F.substring_index(x["text"], "\x03", 1).alias("item"), F.substring_index(x["text"], "\x03", -1).alias("value")))
    lines = lambda label, tag, cls: _join(texts(of(label)), lambda x: F.concat(F.lit(f'<{tag} class="{cls}">'), rich(x), F.lit(f"</{tag}>")))
    moves = F.when(F.size(of("moves")) > 0, F.concat(F.lit('<ul class="stat-moves">'), _join(texts(of("moves")), lambda x: F.concat(F.lit("<li>"), rich(x), F.lit("</li>"))), F.lit("</ul>"))).otherwise(F.lit(""))
    stats = F.when(F.size(of("stats")) > 0, F.concat(F.lit('<p class="stat-stats">'), rich(F.array_join(texts(of("stats")), " · ")), F.lit("</p>"))).otherwise(F.lit(""))
    stat = F.concat(F.lit('<h3 class="stat-name">'), T.html_escape(name), F.lit("</h3>"), lines("tags", "p", "stat-tags"), stats, moves, lines("notes", "p", "stat-note"), inner, check_list(texts(of("checks")), anchor, ready))
    each = _join(items, lambda x: F.concat(F.lit('<p class="'), x["label"], F.lit('">'), rich(x["text"]), F.lit("</p>")))
    numbered = _join(items, lambda e: F.concat(F.lit('<tr><th scope="row">'), T.html_escape(e["label"]), F.lit("</th><td>"), plain(e["text"]), F.lit("</td></tr>")))
    card = lambda cls, body: F.concat(F.lit(f'<div class="{cls}"'), id_, F.lit(">"), body, F.lit("</div>"))
    titled = F.concat(F.lit("<h3>"), T.html_escape(name), F.lit("</h3>"))
    return (
        F.when(kind == "rule", F.lit("<hr>")).when(kind.isin("heading", "table_heading"), heading).when(kind == "paragraph", _tag("p", rich(text))).when(kind == "infobox", card("infobox", inner))
        .when(kind == "price_table", value_table(name, priced, texts(of("note")), ready)).when(kind == "roll_table", roll_table(text, name, items, anchor, ready)).when(kind == "stat", card("stat-block", stat))
        .when(kind == "checks", check_list(texts(items), anchor, ready)).when(kind.isin("bullets", "list"), listed("bullets")).when(kind == "questions", listed("questions")).when(kind == "ellipsis", listed("ellipsis"))
        .when(kind == "numbered", F.concat(F.lit('<div class="roll-table bare-numbered"><table><tbody>'), numbered, F.lit("</tbody></table></div>")))
        .when(kind == "move", card("move-block", F.concat(F.lit('<h3 class="move-name">'), T.html_escape(name), F.lit("</h3>"), F.when(text != "", _tag("p", rich(text), ' class="move-trigger"')).otherwise(F.lit("")), inner)))
        .when(kind == "improvement", card("steading-improvement", F.concat(F.when(name != "", titled).otherwise(F.lit("")), each))).when(kind == "artifact", card("discovery-block", F.concat(titled, each)))
        .when(kind == "hazard", card("hazard-block", F.concat(titled, each))).when(kind.isin("front", "back"), card("arcana-face", each)).otherwise(card("arcana-card", inner))
    )


def render(blocks: DataFrame, key: str = "slug", depth: int = 4, ready: bool = False) -> DataFrame:
    """The blocks with `html`, each around the ones in it; blocks stand in one another `depth` deep at most (a table in a move in a box
    in an article is three)."""
    rows = settle(blocks, "blocks").withColumn("deep", F.lit(0))  # read once for each level
    layers, above = [], rows.where("parent is null").select(key, F.col("pos").alias("parent"))
    layers.append(rows.where("parent is null"))
    for n in range(1, depth):
        layer = rows.where("parent is not null").join(above, [key, "parent"], "left_semi").withColumn("deep", F.lit(n))
        layers.append(layer)
        above = layer.select(key, F.col("pos").alias("parent"))
    out, inner = None, None
    for layer in reversed(layers):
        held = layer.drop("deep")
        held = held.withColumn("inner", F.lit("")) if inner is None else held.join(inner, [key, "pos"], "left").withColumn("inner", F.coalesce("inner", F.lit("")))
        done = held.withColumn("html", block_html(F.col("inner"), ready)).drop("inner")
        out = done if out is None else out.unionByName(done.select(*out.columns))
        inner = done.where("parent is not null").groupBy(key, F.col("parent").alias("pos")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "html"))), lambda x: x["html"]), "").alias("inner"))
    return out


def article_html(rendered: DataFrame, key: str = "slug") -> DataFrame:
    """(key, html): articles from their rendered blocks."""
    return rendered.where("parent is null").groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "html"))), lambda x: x["html"]), "\n").alias("html"))


def nav(articles: DataFrame, sections: DataFrame) -> DataFrame:
    """One row: the navigation of a book, the same on every page but for the current entry's mark; articles: (ord, slug, title, kind),
    sections: (slug, pos, id, name). A book's contents fit a task; it is computed once and not for each page."""
    sub = sections.groupBy("slug").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "id", "name"))), lambda s: F.struct(s["id"].alias("id"), s["name"].alias("name"))).alias("subs"))
    df = articles.join(sub, "slug", "left")
    has = F.size(F.coalesce("subs", F.array().cast("array<struct<id:string,name:string>>"))) > 0
    classes = F.concat_ws(" ", F.when(F.col("kind") == "arcana", "nav-arcana").when(F.col("kind") == "arcana-hub", "nav-hub"), F.when(has, "has-sections"))
    cls = F.when(classes != "", F.concat(F.lit(' class="'), classes, F.lit('"'))).otherwise(F.lit(""))
    slug = T.html_escape("slug")
    below = F.when(has, F.concat(F.lit('<ul class="nav-sections">'), _join(F.col("subs"), lambda s: F.concat(F.lit('<li class="nav-section"><a href="'), slug, F.lit(".html#"), T.html_escape(s["id"]), F.lit('">'), T.html_escape(s["name"]), F.lit("</a></li>"))), F.lit("</ul>"))).otherwise(F.lit(""))
    item = F.concat(F.lit("<li"), cls, F.lit('><a href="'), slug, F.lit('.html">'), T.html_escape("title"), F.lit("</a>"), below, F.lit("</li>"))
    return df.select("ord", item.alias("item")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ord", "item"))), lambda x: x["item"]), "\n").alias("nav"))


def hub_html(title: Column, children: Column) -> Column:
    """children: array of (title, slug) in order."""
    kind = F.when(F.lower(title).contains("minor"), "Minor").otherwise("Major")
    items = _join(children, lambda c: F.concat(F.lit('<li><a class="wiki-link" href="'), T.html_escape(c["slug"]), F.lit('.html" data-slug="'), T.html_escape(c["slug"]), F.lit('">'), T.html_escape(c["title"]), F.lit("</a></li>")))
    return F.concat(F.lit("<p>Individual "), F.lower(kind), F.lit(' arcana, each on a page of its own.</p><div class="arcana-index"><h2>All '), kind, F.lit(" Arcana</h2><ol>"), items, F.lit("</ol></div>"))


def maps_html(maps: DataFrame) -> DataFrame:
    """One row: the spreads of the book by page, then the campaign maps in their order; maps: (ord, file, label, page, hq). A book's maps fit a task."""
    src = T.html_escape(F.concat(F.lit("../images/"), "file"))
    full = F.when(F.col("hq"), F.concat(F.lit(' data-full="'), src, F.lit('"'))).otherwise(F.lit(""))
    name = T.html_escape(F.substring_index("file", "/", -1))
    one = F.concat(F.lit('<div class="map-canvas" data-map="'), name, F.lit('"'), full, F.lit('><img src="'), src, F.lit('" alt="'), T.html_escape("label"), F.lit('" loading="lazy" draggable="false"></div>'))
    order = F.struct(F.col("hq"), F.when(~F.col("hq"), F.col("page")).alias("page"), F.col("ord"), one.alias("html"))
    swatches = "".join(f'<button type="button" class="map-color" data-color="{c}"></button>' for c in PIN_COLORS)
    strip = F.array_join(F.transform(F.sort_array(F.collect_list(order)), lambda x: x["html"]), "")
    return maps.agg(F.count("*").alias("n"), strip.alias("strip")).select(F.when(F.col("n") > 0, F.concat(F.lit(f'<div class="map-tools">{swatches}</div><div class="maps-strip">'), "strip", F.lit("</div>"))).otherwise(F.lit("")).alias("html"))


def index_cards(articles: DataFrame, previews: DataFrame) -> DataFrame:
    """(ord, slug, card): a card for every article but single arcana, with its excerpt if there is one."""
    df = articles.where(~F.col("kind").eqNullSafe("arcana")).join(previews.select("slug", "excerpt"), "slug", "left")
    card = F.concat(F.lit('<a class="index-card" href="pages/'), "slug", F.lit('.html"><p class="card-title">'), T.html_escape("title"), F.lit('</p><p class="card-excerpt">'), T.html_escape(F.coalesce("excerpt", F.lit(""))), F.lit("</p></a>"))
    return df.select("ord", "slug", card.alias("card"))


def page_shell(title: Column, body: Column, nav_html: Column, prefix: str = "../") -> Column:
    head = F.concat(F.lit('<!DOCTYPE html>\n<html lang="en">\n<head><meta charset="utf-8"><title>'), T.html_escape(title), F.lit(f'</title><link rel="stylesheet" href="{prefix}css/wiki.css"></head>\n<body>\n<nav class="toc"><ul id="nav-list">\n'))
    return F.concat(head, nav_html, F.lit('\n</ul></nav>\n<main class="content">'), body, F.lit(f'</main>\n<script src="{prefix}js/wiki.js"></script>\n</body>\n</html>\n'))


def pages_with_nav(articles: DataFrame, navigation: DataFrame) -> DataFrame:
    """(slug, html): whole pages; the navigation, one string, is in the plan once and not in the data of every page."""
    row = navigation.first()
    return articles.select("slug", page_shell(F.col("title"), F.col("html"), F.lit(row["nav"] if row else "")).alias("html"))


def section_html(blocks: DataFrame, sections: DataFrame, key: str = "slug") -> DataFrame:
    """(key, id, name, html, kind): what a preview of a section shows: a block by itself, or a heading with all up to the next heading
    of its level or higher. Sections of less than eight characters of text, and anchors without a block, have no html.

    blocks: (key, pos, parent, kind, level, anchor, name, html).
    """
    top = blocks.where("parent is null")
    alone = blocks.where("anchor <> '' and kind in ('stat', 'roll_table', 'price_table')").select(key, F.col("anchor").alias("id"), "html", F.regexp_replace("kind", "_", "-").alias("kind"))
    is_head = F.col("kind").isin("heading", "table_heading")
    so_far = Window.partitionBy(key).orderBy("pos")
    # The last heading of a level or a higher one holds a block if it is of that very level.
    over = [F.last(F.when(is_head & (F.col("level") <= n), F.struct("level", "anchor")), ignorenulls=True).over(so_far) for n in range(1, 5)]
    seen = top.select(key, "pos", "html", *[x.alias(f"over{n}") for n, x in enumerate(over, 1)])
    owners = F.filter(F.array(*[F.when(F.col(f"over{n}.level") == n, F.col(f"over{n}.anchor")) for n in range(1, 5)]), lambda a: F.coalesce(a != "", F.lit(False)))
    held = seen.select(key, "pos", "html", F.explode(owners).alias("id"))
    chunk = held.groupBy(key, "id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "html"))), lambda x: x["html"]), "\n").alias("html"))
    shown = chunk.where(F.length(F.trim(F.regexp_replace("html", "<[^>]+>", " "))) >= 8).withColumn("kind", F.lit("section"))
    both = alone.unionByName(shown.join(alone.select(key, "id"), [key, "id"], "left_anti"))
    out = sections.join(both, [key, "id"], "left")
    return out.select(key, "id", "name", F.coalesce("html", F.lit("")).alias("html"), F.coalesce("kind", F.lit("section")).alias("kind"))


@F.pandas_udf(S.MapType(S.StringType(), S.StringType()))
def blocks_by_id(html):
    """Of raw HTML, each div with an id and one of the block classes, up to its own end."""
    import re

    def of(page: str | None) -> dict[str, str]:
        out: dict[str, str] = {}
        tags = [(m.start(), m.end(), not m[0].startswith("</"), m[0]) for m in re.finditer(r"(?i)</div\s*>|<div\b[^>]*>", page or "")]
        for i, (begin, _, opens, tag) in enumerate(tags):
            m = re.match(r'<div\s+class="(?:stat-block|roll-table|value-table)"\s+id="([^"]+)"', tag) if opens else None
            depth = 0
            for _, end, opening, _ in tags[i:] if m else ():
                depth += 1 if opening else -1
                if depth == 0:
                    out[m[1]] = page[begin:end]
                    break
        return out

    return html.map(of)


def number_articles(articles: DataFrame, key: str) -> DataFrame:
    """Articles of a book in the order of their first page, those of one page in the order given."""
    return articles.withColumn("number", F.row_number().over(Window.partitionBy(key).orderBy("start_page", "ord")))
