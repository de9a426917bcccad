"""Queries over marked lines and blocks, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import rich as R
from loomwright.operators import blocks as B
from loomwright.operators import lines as L
from loomwright.plans.text_queries import LINES_SQL
from loomwright.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


_MARKER_SQL = "CASE WHEN pos % 7 = 2 THEN 'BOX' WHEN pos % 7 = 5 THEN 'ENDBOX' WHEN length(line) < 25 THEN 'HR' WHEN length(line) % 3 = 0 THEN 'C' END"


def _lines(spark, sf_dir):
    df = L.explode_lines(table(spark, sf_dir, "documents")).withColumnRenamed("doc_id", "slug")
    n = F.length("line")
    return df.withColumn("marker", F.when(F.col("pos") % 7 == 2, "BOX").when(F.col("pos") % 7 == 5, "ENDBOX").when(n < 25, "HR").when(n % 3 == 0, "C"))


@query(f"WITH {LINES_SQL}, m AS (SELECT doc_id AS slug, pos, {_MARKER_SQL} AS marker FROM l) SELECT slug, pos::INT AS pos, sum(CASE marker WHEN 'BOX' THEN 1 WHEN 'ENDBOX' THEN -1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY pos) > 0 AS in_box FROM m")
def in_box(spark, sf_dir):
    return B.in_box(_lines(spark, sf_dir)).select("slug", "pos", "in_box")


@query(f"WITH {LINES_SQL}, m AS (SELECT doc_id AS slug, pos, {_MARKER_SQL} AS marker FROM l), b AS (SELECT *, lag(marker) OVER (PARTITION BY slug ORDER BY pos) AS p FROM m) SELECT slug, pos::INT AS pos FROM b WHERE NOT (marker IS NOT DISTINCT FROM 'HR' AND p IS NOT DISTINCT FROM 'HR')")
def rules_once(spark, sf_dir):
    return B.drop_repeated_rules(_lines(spark, sf_dir)).select("slug", "pos")


@query(f"WITH {LINES_SQL}, m AS (SELECT doc_id AS slug, pos, {_MARKER_SQL} AS marker FROM l) SELECT slug, pos::INT AS pos, slug || '-' || row_number() OVER (PARTITION BY slug ORDER BY pos) AS check_id FROM m WHERE marker = 'C'")
def check_ids(spark, sf_dir):
    return B.check_ids(_lines(spark, sf_dir)).where("check_id is not null").select("slug", "pos", "check_id")


@query(f"WITH {LINES_SQL} SELECT doc_id AS slug, arg_min(line, pos) FILTER (length(line) >= 50 AND NOT starts_with(lower(line), 'when you')) AS line FROM l GROUP BY doc_id")
def first_qualifying_line(spark, sf_dir):
    return B.first_line(_lines(spark, sf_dir), "slug", (F.length("line") >= 50) & ~F.lower("line").startswith("when you"))


@query(f"WITH {LINES_SQL}, m AS (SELECT doc_id AS slug, pos, {_MARKER_SQL} AS marker FROM l) SELECT slug, pos::INT AS pos, sum(CASE WHEN marker = 'HR' THEN 1 ELSE 0 END) OVER (PARTITION BY slug ORDER BY pos)::BIGINT AS part FROM m")
def divider_groups(spark, sf_dir):
    return B.groups_by_divider(_lines(spark, sf_dir), F.coalesce(F.col("marker") == "HR", F.lit(False))).select("slug", "pos", "part")


@query("""
WITH n AS (SELECT o_custkey AS nav, o_orderkey AS pos, o_orderkey % 5 = 0 AS is_label, o_orderkey % 3 = 0 AS shown FROM orders),
g AS (SELECT *, sum(is_label::INT) OVER (PARTITION BY nav ORDER BY pos) AS part FROM n)
SELECT nav, pos, is_label, CASE WHEN is_label THEN max((NOT is_label AND shown)::INT) OVER (PARTITION BY nav, part) = 1 ELSE shown END AS shown FROM g
""")
def nav_labels(spark, sf_dir):
    k = F.col("o_orderkey")
    return B.visible_labels(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("nav"), k.alias("pos"), (k % 5 == 0).alias("is_label"), (k % 3 == 0).alias("shown")))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity + 2 >= 10 AND l_quantity + 2 < 30 AND l_extendedprice / 1000 + 0.5 >= 5 AND l_extendedprice / 1000 + 0.5 < 40")
def words_in_rectangle(spark, sf_dir):
    y = F.col("l_extendedprice") / 1000
    w = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x0"), (F.col("l_quantity") + 4).alias("x1"), y.alias("y0"), (y + 1).alias("y1"))
    return B.words_in(w, 10, 30, 5, 40).select("l_orderkey", "l_linenumber")


@query("""
SELECT p_partkey, CASE p_partkey % 6 WHEN 4 THEN false WHEN 2 THEN length(split_part(p_name, ' ', 1)) >= 6 OR NOT contains(p_name, ' ') WHEN 5 THEN length(split_part(p_name, ' ', -1)) >= 6 OR NOT contains(p_name, ' ') ELSE true END AS header FROM part
""")
def running_headers(spark, sf_dir):
    k = F.col("p_partkey") % 6
    line = F.when(k == 0, F.concat("p_name", F.lit(" "), "p_name")).when(k == 1, F.concat(F.upper("p_name"), F.lit(" 12"))).when(k == 2, F.substring_index("p_name", " ", 1)).when(k == 3, "Contents").when(k == 5, F.substring_index("p_name", " ", -1)).otherwise("something else here")
    return table(spark, sf_dir, "part").select("p_partkey", R.running_header(line, "p_name", True).alias("header"))


@query("SELECT p_partkey, 'A ' || p_name AS title FROM part")
def title_collapse(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", R.collapse_title(F.concat(F.lit("A "), "p_name", F.lit("  "), "p_name")).alias("title"))


@query("SELECT p_partkey, '<strong>' || p_name || '</strong> <em>' || p_brand || ' ' || p_type || '</em>' AS html FROM part")
def rich_to_html(spark, sf_dir):
    s = F.concat(F.lit("\x04"), "p_name", F.lit("\x05 \x06"), "p_brand", F.lit("\x07 \x06"), "p_type", F.lit("\x07"))
    return table(spark, sf_dir, "part").select("p_partkey", R.to_html(s).alias("html"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'book1' WHEN 1 THEN 'book2' END AS book FROM part")
def book_tokens(spark, sf_dir):
    k = F.col("p_partkey") % 3
    return table(spark, sf_dir, "part").select("p_partkey", R.book_of(F.when(k == 0, " I").when(k == 1, "2").otherwise("x")).alias("book"))


@query("SELECT page_id, regexp_extract('a/' || replace(url, '.html', '_') || '/p' || page_id || '.html#x', '([^/#]+)\\.html', 1) AS slug FROM pages")
def slug_of_path(spark, sf_dir):
    path = F.concat(F.lit("a/"), F.replace("url", F.lit(".html"), F.lit("_")), F.lit("/p"), F.col("page_id").cast("string"), F.lit(".html#x"))
    return table(spark, sf_dir, "pages").select("page_id", R.slug_of_path(path).alias("slug"))


def _small(spark, sf_dir, *lines: str):
    """A small document for each part, its name in place of {n}."""
    d = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("slug"), "p_name", F.posexplode(F.array(*[F.lit(x) for x in lines])).alias("pos", "line"))
    return d.select("slug", "pos", F.replace("line", F.lit("{n}"), F.col("p_name")).alias("line"))


def _joined(c, *fields):
    return F.array_join(F.transform(c, lambda x: F.concat_ws("=", *[x[f].cast("string") for f in fields])), "; ")


@query("SELECT p_partkey AS slug, unnest([1, 5]) AS pos, unnest(['1d6', 'd4']) AS dice, unnest([p_name, '']) AS label, unnest(['1=3=a bird of ill will; 4=4=' || p_name, '1=1=end']) AS entries FROM part")
def dice_table_blocks(spark, sf_dir):
    df = B.dice_tables(_small(spark, sf_dir, "intro", "1d6 {n}", "1-3 a bird", "of ill will", "4 {n}", "d4", "1 end"))
    return df.select("slug", "pos", "dice", "label", _joined(F.col("entries"), "lo", "hi", "body").alias("entries"))


@query("SELECT p_partkey AS slug, 'goods value' AS header, p_name || '=1; Cart, fine=free' AS rows FROM part UNION ALL SELECT p_partkey, 'Services Value', 'Guide=2' FROM part")
def price_blocks(spark, sf_dir):
    df = B.price_tables(_small(spark, sf_dir, "before 3", "goods value", "{n} 1", "Cart, fine free", "no price here", "Services Value", "Guide 2"))
    return df.select("slug", "header", _joined(F.col("rows"), "item", "value").alias("rows"))


@query("SELECT p_partkey AS slug, 'LAST STAND' AS name, 'When you fall ' || p_name AS body FROM part UNION ALL SELECT p_partkey, 'NEXT ONE', 'When it ends' FROM part")
def move_blocks(spark, sf_dir):
    return B.moves(_small(spark, sf_dir, "before", "LAST STAND", "When you fall", "{n}", "NEXT ONE", "When it ends")).select("slug", "name", "body")


@query("SELECT p_partkey AS slug, 'Requires all of the following:' AS header, p_name || '; a mill' AS items FROM part UNION ALL SELECT p_partkey, 'And either of these', 'stone' FROM part")
def improvement_blocks(spark, sf_dir):
    df = B.improvements(_small(spark, sf_dir, "Requires all of the following:", "{n}", "a mill", "Terrain", "And either of these", "stone", "Henceforth", "x"))
    return df.select("slug", "header", F.array_join("items", "; ").alias("items"))


@query("SELECT p_partkey AS slug, unnest([0, 1, 2, 3, 4])::INT AS pos, unnest([true, false, false, false, false]) AS is_stat_block FROM part")
def stat_headings(spark, sf_dir):
    return B.stat_headings(_small(spark, sf_dir, "Crag Wolf", "Horde, small, stealthy", "HP 4", "Far Field", "the {n} goes on here for long")).select("slug", "pos", "is_stat_block")
