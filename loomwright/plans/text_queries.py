"""Queries over single texts and lines, each beside its oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.functions import text as T
from loomwright.operators import lines as L
from loomwright.operators import parse, publish, wrap
from loomwright.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

LINES_SQL = "l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS pos FROM documents)"
TITLE_SQL = "regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')"
TEXT_SQL = (
    "trim(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace("
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<script[^>]*>.*?</script>', ' ', 'gis'), '<style[^>]*>.*?</style>', ' ', 'gis'), '<br\\s*/?>', chr(10), 'gi'), "
    "'</(p|div|li|tr|h[1-6]|section|article)>', chr(10), 'gi'), '<[^>]+>', ' ', 'g'), "
    "'&middot;', '·'), '&quot;', '\"'), '&copy;', '©'), '&amp;', '&'), '[ \\t]+', ' ', 'g'), '\\n\\s*\\n+', chr(10), 'g'), ' +', ' ', 'g'), ' ' || chr(10) || chr(9))"
)
WORDS_SQL = "list_filter(string_split_regex({0}, '\\s+'), lambda x: x <> '')"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _lines(spark, sf_dir):
    return L.explode_lines(table(spark, sf_dir, "documents"))


@query(f"SELECT page_id, {TEXT_SQL} AS body FROM pages")
def html_to_search_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_to_text("html").alias("body"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(replace(replace(lower(p_name), '''', ''), '`', ''), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')) AS slug FROM part")
def slug(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.slug("p_name").alias("slug"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower('The ' || p_name || '''s' ), '[\"'']', '', 'g')[5:], '[^a-z0-9]+', ' ', 'g')) AS section_key FROM part")
def section_key(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.section_key(F.concat(F.lit("The "), "p_name", F.lit("'s"))).alias("section_key"))


@query("SELECT doc_id, regexp_replace(regexp_replace(translate(text, '‘’“”ä', '''''\"\"•'), '[ \\t]+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS normal FROM documents")
def normalize_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.normalize_text("text").alias("normal"))


@query(f"""
WITH {LINES_SQL}, w AS (SELECT doc_id, pos, {WORDS_SQL.format("line")} AS w FROM l),
e AS (SELECT doc_id, pos, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
c AS (SELECT *, CASE WHEN lower(x) = lag(lower(x)) OVER (PARTITION BY doc_id, pos ORDER BY i) THEN 0 ELSE 1 END AS c FROM e),
r AS (SELECT *, sum(c) OVER (PARTITION BY doc_id, pos ORDER BY i) AS r FROM c),
n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, pos, r ORDER BY i) AS n FROM r),
j AS (SELECT doc_id, pos, string_agg(x, ' ' ORDER BY i) AS line FROM n WHERE n % 2 = 1 GROUP BY doc_id, pos)
SELECT l.doc_id, l.pos::INT AS pos, coalesce(j.line, '') AS line FROM l LEFT JOIN j USING (doc_id, pos)
""")
def undouble_lines(spark, sf_dir):
    return _lines(spark, sf_dir).select("doc_id", "pos", T.undouble("line").alias("line"))


@query(f"""
WITH {LINES_SQL}, d AS (SELECT doc_id, pos, {WORDS_SQL.format("CASE WHEN pos % 3 = 0 THEN line || ' ' || line ELSE line END")} AS w FROM l)
SELECT doc_id, pos::INT AS pos, len(w) >= 2 AND len(w) % 2 = 0 AND len(list_filter(range(1, len(w) + 1, 2), lambda i: lower(w[i]) <> lower(w[i + 1]))) = 0 AS doubled FROM d
""")
def pairwise_doubled(spark, sf_dir):
    odd = F.when(F.col("pos") % 3 == 0, F.concat("line", F.lit(" "), "line")).otherwise(F.col("line"))
    return _lines(spark, sf_dir).select("doc_id", "pos", T.pairwise_doubled(odd).alias("doubled"))


@query("""
WITH t AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN upper(p_name) ELSE p_name END AS s FROM part)
SELECT p_partkey, length(s) <= 55 AND length(regexp_replace(s, '[^\\p{L}]', '', 'g')) >= 3 AND length(regexp_replace(s, '[^\\p{Lu}]', '', 'g')) * 100 >= length(regexp_replace(s, '[^\\p{L}]', '', 'g')) * 85 AS caps FROM t
""")
def all_caps_labels(spark, sf_dir):
    s = F.when(F.col("p_size") % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", T.all_caps_label(s).alias("caps"))


@query("""
WITH t AS (SELECT p_partkey, concat(p_size % 20 + 1, CASE WHEN p_size % 3 = 0 THEN '-' || (p_size % 20 + 3) ELSE '' END, ' ', p_name) AS s FROM part)
SELECT p_partkey, regexp_extract(s, '^(\\d{1,2})(?:\\s*[-–—]\\s*(\\d{1,2}))?\\s+(.+)$', 1) AS lo, regexp_extract(s, '^(\\d{1,2})(?:\\s*[-–—]\\s*(\\d{1,2}))?\\s+(.+)$', 2) AS hi,
  regexp_extract(s, '^(\\d{1,2})(?:\\s*[-–—]\\s*(\\d{1,2}))?\\s+(.+)$', 3) AS body FROM t
""")
def numbered_entries(spark, sf_dir):
    size = F.col("p_size")
    s = F.concat((size % 20 + 1).cast("string"), F.when(size % 3 == 0, F.concat(F.lit("-"), (size % 20 + 3).cast("string"))).otherwise(""), F.lit(" "), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", *[F.regexp_extract(s, T.ENTRY, i).alias(n) for i, n in ((1, "lo"), (2, "hi"), (3, "body"))])


@query("""
WITH t AS (SELECT p_partkey, concat(CASE WHEN p_size % 5 = 0 THEN 'Horde, ' ELSE '' END, p_brand, ', ', CASE WHEN p_size % 2 = 0 THEN 'small' ELSE 'odd' END, ', ', CASE WHEN p_size % 3 = 0 THEN 'very stealthy' ELSE 'plain' END) AS s, p_size, p_name FROM part)
SELECT p_partkey, p_size % 5 = 0 OR ((p_size % 2 = 0)::INT + (p_size % 3 = 0)::INT >= 2) AS tags FROM t
""")
def tag_lines(spark, sf_dir):
    size = F.col("p_size")
    s = F.concat(F.when(size % 5 == 0, "Horde, ").otherwise(""), "p_brand", F.lit(", "), F.when(size % 2 == 0, "small").otherwise("odd"), F.lit(", "), F.when(size % 3 == 0, "very stealthy").otherwise("plain"))
    return table(spark, sf_dir, "part").select("p_partkey", T.tag_line(s).alias("tags"))


@query("SELECT p_partkey, p_name AS item, p_size::VARCHAR AS value FROM part")
def price_rows(spark, sf_dir):
    row = T.value_row(F.concat("p_name", F.lit(" "), F.col("p_size").cast("string")))
    return table(spark, sf_dir, "part").withColumn("r", row).select("p_partkey", "r.item", "r.value")


@query("SELECT p_partkey, array_to_string(list_transform(CASE p_size WHEN 7 THEN [7, 10] WHEN 4 THEN [4, 7] ELSE [p_size, p_size + 3, 7] END, lambda x: x::VARCHAR), ',') AS pages FROM part")
def page_num_list(spark, sf_dir):
    size = F.col("p_size")
    spec = F.concat(size.cast("string"), F.lit("-"), (size + 3).cast("string"), F.lit(", 7; x"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(T.page_numbers(spec).cast("array<string>"), ",").alias("pages"))


@query("SELECT p_partkey, p_name AS label FROM part")
def strip_label_noise(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.strip_label_noise(F.concat(F.lit("or maybe even the "), "p_name", F.lit(" ,-"))).alias("label"))


@query("""
WITH t AS (SELECT p_partkey, lower(regexp_extract(p_name, '(\\S+)$', 1)) || CASE p_size % 6 WHEN 0 THEN 'ves' WHEN 1 THEN 'ies' WHEN 2 THEN 'ches' WHEN 3 THEN 'oes' WHEN 4 THEN 'kes' ELSE 'd' END AS w FROM part)
SELECT p_partkey, CASE WHEN w LIKE '%ves' AND length(w) > 4 THEN w[:-4] || 'f' WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y'
  WHEN regexp_matches(w, '(s|sh|ch|x|z)es$') OR w LIKE '%oes' THEN w[:-3] WHEN w LIKE '%es' THEN w[:-2] WHEN w LIKE '%s' AND w NOT LIKE '%ss' THEN w[:-2] END AS one FROM t
""")
def singularize(spark, sf_dir):
    size = F.col("p_size") % 6
    end = F.when(size == 0, "ves").when(size == 1, "ies").when(size == 2, "ches").when(size == 3, "oes").when(size == 4, "kes").otherwise("d")
    return table(spark, sf_dir, "part").select("p_partkey", T.singular(F.concat(F.element_at(F.split("p_name", " "), -1), end)).alias("one"))


@query("""
WITH t AS (SELECT p_partkey, concat(p_size % 120, 'd', p_size, CASE WHEN p_size % 3 = 0 THEN ' + 3' WHEN p_size % 3 = 1 THEN '-1' ELSE '' END) AS e, p_size % 120 AS n, p_size AS s, CASE WHEN p_size % 3 = 0 THEN 3 WHEN p_size % 3 = 1 THEN -1 ELSE 0 END AS m FROM part)
SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 99 AND s > 0 THEN n END AS n, CASE WHEN n BETWEEN 1 AND 99 AND s > 0 THEN s END AS sides, CASE WHEN n BETWEEN 1 AND 99 AND s > 0 THEN m END AS mod FROM t
""")
def dice_parse(spark, sf_dir):
    from loomwright.operators import dice

    size = F.col("p_size")
    e = F.concat((size % 120).cast("string"), F.lit("d"), size.cast("string"), F.when(size % 3 == 0, " + 3").when(size % 3 == 1, "-1").otherwise(""))
    return dice.parse(table(spark, sf_dir, "part").withColumn("e", e), "e").select("p_partkey", "n", "sides", "mod")


@query("SELECT p_partkey, (p_size % 9 + 1) + 3 AS least, (p_size % 9 + 1) * p_size + 3 AS most, (p_size % 9 + 1) * (p_size + 1) / 2.0 + 3.0 AS mean FROM part")
def dice_statistics(spark, sf_dir):
    from loomwright.operators import dice

    e = F.concat((F.col("p_size") % 9 + 1).cast("string"), F.lit("d"), F.col("p_size").cast("string"), F.lit("+3"))
    return dice.statistics(table(spark, sf_dir, "part").withColumn("e", e), "e").select("p_partkey", "least", "most", F.col("mean").cast("double").alias("mean"))


@query("SELECT p_partkey, p_size % 9 + 1 AS n_parts, true AS valid FROM part")
def dice_rolls(spark, sf_dir):
    """Rolls, and whether their parts are faces of the die and the total is theirs."""
    from loomwright.operators import dice

    e = F.concat((F.col("p_size") % 9 + 1).cast("string"), F.lit("d6-1"))
    df = dice.roll(table(spark, sf_dir, "part").withColumn("e", e), "e", 7)
    faces = F.forall("parts", lambda x: x.between(1, 6)) & (F.col("total") == F.aggregate("parts", F.lit(-1), lambda a, x: a + x))
    return df.select("p_partkey", F.size("parts").alias("n_parts"), faces.alias("valid"))


@query("SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;') AS escaped FROM pages")
def html_escape(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.html_escape("html").alias("escaped"))


@query("SELECT doc_id, CASE WHEN length(text) > 320 THEN regexp_replace(left(text, 319), ' [^ ]*$', '') || '…' ELSE text END AS excerpt FROM documents")
def excerpt_cut(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.excerpt("text").alias("excerpt"))


def _marked(df):
    """Documents' lines with boxes, entries, hit points, dice headers and tags among them."""
    p, line = F.col("pos"), F.col("line")
    said = (
        F.when(p % 11 == 3, "\x02BOX").when(p % 11 == 5, "\x02ENDBOX").when(p % 7 == 6, F.concat(F.lit("3 "), line)).when(p % 13 == 8, F.concat(F.lit("HP 5 "), line))
        .when(p % 17 == 2, F.concat(F.lit("1d6 "), line)).when(p % 19 == 1, F.concat(F.lit("Horde, small, "), F.substring_index(line, " ", 8))).when(p % 19 == 4, F.concat(F.lit("\x04"), line, F.lit("\x05"))).otherwise(line)
    )
    return df.withColumn("line", said)


_MARKED_SQL = """CASE WHEN pos % 11 = 3 THEN chr(2) || 'BOX' WHEN pos % 11 = 5 THEN chr(2) || 'ENDBOX' WHEN pos % 7 = 6 THEN '3 ' || line WHEN pos % 13 = 8 THEN 'HP 5 ' || line
  WHEN pos % 17 = 2 THEN '1d6 ' || line WHEN pos % 19 = 1 THEN 'Horde, small, ' || array_to_string(string_split(line, ' ')[1:8], ' ') WHEN pos % 19 = 4 THEN chr(4) || line || chr(5) ELSE line END"""


@query(f"""
WITH {LINES_SQL}, m AS (SELECT doc_id, pos, {_MARKED_SQL} AS line FROM l),
b AS (SELECT *, coalesce(last_value(CASE line WHEN chr(2) || 'BOX' THEN true WHEN chr(2) || 'ENDBOX' THEN false END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), false) AS boxed, trim(regexp_replace(line, '[\\x04-\\x07]', '', 'g')) AS clean FROM m),
g AS (SELECT *, len({WORDS_SQL.format("clean")}) AS n FROM b WHERE NOT boxed AND NOT starts_with(line, chr(2)) AND length(clean) >= 40 AND NOT regexp_matches(clean, '^\\d{{1,2}}(\\s*[-–—]\\s*\\d{{1,2}})?\\s+.+$')
  AND NOT regexp_matches(clean, '(?i)\\bHP\\s*\\d+') AND NOT regexp_matches(clean, '(?i)^\\d{{0,2}}d(4|6|8|10|12|20)\\s+.+$') AND NOT (starts_with(clean, 'Horde, small, ') AND length(clean) <= 160)),
r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY pos) - n AS before FROM g),
k AS (SELECT doc_id, string_agg(clean, chr(10) || chr(10) ORDER BY pos) AS body FROM r WHERE before < 50 GROUP BY doc_id)
SELECT f.doc_id, coalesce(k.body, regexp_replace(regexp_replace(f.line, '^\\x02[A-Z0-9]+ ?', ''), '[\\x04-\\x07]', '', 'g')) AS excerpt FROM (SELECT doc_id, line FROM m WHERE pos = 0) f LEFT JOIN k USING (doc_id)
""")
def excerpt_50_words(spark, sf_dir):
    return L.excerpt(_marked(_lines(spark, sf_dir)))


_SMALL = "list_filter({w}, lambda x: regexp_matches(x, '^\\p{{Ll}}'))"
_PAIRED = "(len({w}) >= 2 AND len({w}) % 2 = 0 AND len(list_filter(range(1, len({w}) + 1, 2), lambda i: lower(({w})[i]) <> lower(({w})[i + 1]))) = 0)"
_ROLL = "(regexp_matches({x}, '(?i)^\\d{{0,2}}d(4|6|8|10|12|20)(\\s+[^().;:]*)?$') OR regexp_matches({x}, '(?i)^.{{1,40}}\\s\\d{{0,2}}d(4|6|8|10|12|20)$'))"
#: x is a line, w the list of its words.
_HEADING = (
    "(length({x}) BETWEEN 1 AND 55 AND regexp_matches({x}, '^[\\p{{Lu}}\\p{{Nd}}]') AND len({w}) <= 8 AND NOT " + _PAIRED + " AND NOT regexp_matches({x}, '[.,;][\"''”’]*$') AND NOT regexp_matches({x}, '^\\d{{1,2}}(\\s*[-–—]\\s*\\d{{1,2}})?\\s+.+$') "
    "AND NOT regexp_matches({x}, '(?i)\\bHP\\s*\\d+') AND NOT " + _ROLL + " AND NOT regexp_matches({x}, '(?i)^.+\\s+(\\d{{1,2}}|\\+\\d{{1,2}}|free)(\\s+\\([^)]*\\))?\\s*$') AND NOT regexp_matches({x}, '^[\\d\\s,;:.)\\]]+$') AND NOT regexp_matches({x}, '(?i)\\bpages?\\s+\\d') "
    "AND len(list_filter({w}, lambda x: regexp_matches(x, '^\\p{{Ll}}') AND NOT list_contains(['a', 'an', 'the', 'and', 'or', 'of', 'to', 'in', 'for', 'from', 'vs', 'vs.', 'on', 'with', 'by', 'as', 'at'], trim(lower(x), '.,;:')))) < 3)"
)


def _with_labels(spark, sf_dir):
    """Documents with up to five labels before their first line; every fourth one's first label is a mark."""
    d = F.col("doc_id")
    labels = F.transform(F.slice(F.array(*[F.lit(i) for i in range(1, 6)]), F.lit(1), (d % 6).cast("int")), lambda i: F.when((d % 4 == 3) & (i == 1), F.lit("\x02H2 Mark")).when(i == 3, F.lit("ALL CAPITALS")).otherwise(F.concat(F.lit("Label number "), i.cast("string"))))
    docs = table(spark, sf_dir, "documents").withColumn("text", F.array_join(F.concat(labels, F.array(F.coalesce("text", F.lit("")))), "\n"))
    return L.explode_lines(docs)


_LABELS_SQL = """v AS (SELECT doc_id, array_to_string(list_append(list_transform(range(1, doc_id % 6 + 1), lambda i: CASE WHEN doc_id % 4 = 3 AND i = 1 THEN chr(2) || 'H2 Mark' WHEN i = 3 THEN 'ALL CAPITALS' ELSE 'Label number ' || i END), coalesce(text, '')), chr(10)) AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM v)"""


@query(f"""
WITH {_LABELS_SQL}, t AS (SELECT *, trim(line) AS x, {WORDS_SQL.format("trim(line)")} AS w FROM l), s AS (SELECT *, len({_SMALL.format(w="w")}) AS small, len(w) AS n_w FROM t),
f AS (SELECT *, length(x) >= 70 OR (length(x) >= 48 AND (small >= 2 OR (small >= 1 AND regexp_matches(x, '[.!?]$')))) OR (length(x) >= 35 AND regexp_matches(x, '(?i)^(There are|Maybe you|When you|Thanks to|Most events)')) AS prose,
  x = '' OR (small >= 2 AND NOT regexp_matches(x, '[.!?:]$') AND (n_w >= 5 OR length(x) > 42)) OR list_contains(['up', 'plan', 'door', 'moves', 'fly', 'change'], lower(x)) AS scrap,
  {_HEADING.format(x="x", w="w")} OR (length(x) <= 40 AND regexp_matches(x, '^\\p{{Lu}}') AND NOT regexp_matches(x, '[.;,]$')) AS label,
  x = '' OR {_PAIRED.format(w="w")} OR (n_w >= 2 AND n_w % 2 = 0 AND list_transform(w, lambda y: lower(y))[1:n_w // 2] = list_transform(w, lambda y: lower(y))[n_w // 2 + 1:n_w]) OR lower(x) IN ('contents', 'index') AS running FROM s),
p AS (SELECT *, min(CASE WHEN prose THEN pos END) OVER d AS fp, count(*) OVER d AS n, min(CASE WHEN starts_with(line, chr(2)) THEN pos END) OVER d AS mark FROM f WINDOW d AS (PARTITION BY doc_id)),
q AS (SELECT *, coalesce(pos < fp, false) AND NOT running AND NOT scrap AND label AS lab, coalesce(pos < fp, false) AND NOT running AND NOT scrap AND NOT label AND length(x) > 55 AS odd, CASE WHEN pos >= fp AND NOT scrap THEN pos END AS b FROM p),
r AS (SELECT *, n >= 5 AND fp >= 3 AND coalesce(mark > fp, true) AND sum(lab::INT) OVER d >= 3 AND NOT max(odd::INT) OVER d = 1 AND min(b) OVER d IS NOT NULL AS found, min(b) OVER d AS body FROM q WINDOW d AS (PARTITION BY doc_id))
SELECT doc_id, pos::INT AS pos, CASE WHEN NOT coalesce(found, false) THEN 'body' WHEN lab THEN 'toc' WHEN pos >= body THEN 'body' END AS part FROM r
""")
def toc_peel(spark, sf_dir):
    return L.toc_peel(_with_labels(spark, sf_dir)).select("doc_id", "pos", "part")


_LEVEL = "CASE WHEN length(line) < 30 THEN 1 WHEN length(line) < 60 THEN 2 ELSE 3 END"


@query(f"""
WITH {LINES_SQL}, h AS (SELECT doc_id, pos, {_LEVEL} AS level FROM l)
SELECT a.doc_id, a.pos::INT AS pos, a.level, min(b.pos)::INT AS "end" FROM h a LEFT JOIN h b ON a.doc_id = b.doc_id AND b.pos > a.pos AND b.level <= a.level GROUP BY ALL
""")
def next_heading(spark, sf_dir):
    level = F.when(F.length("line") < 30, 1).when(F.length("line") < 60, 2).otherwise(3)
    return L.next_heading(_lines(spark, sf_dir).select("doc_id", "pos", level.alias("level")), levels=3)


@query(f"""
WITH {LINES_SQL}, k AS (SELECT *, {_LEVEL} AS kind FROM l), c AS (SELECT *, CASE WHEN kind = lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) THEN 0 ELSE 1 END AS c FROM k),
r AS (SELECT *, sum(c) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM c)
SELECT doc_id, run::BIGINT AS run, kind, count(*) AS n_lines, string_agg(line, '|' ORDER BY pos) AS body FROM r GROUP BY ALL
""")
def block_runs(spark, sf_dir):
    kind = F.when(F.length("line") < 30, 1).when(F.length("line") < 60, 2).otherwise(3)
    df = L.islands(_lines(spark, sf_dir).withColumn("kind", kind), ["doc_id"], "pos", F.col("kind"))
    g = df.groupBy("doc_id", "run", "kind").agg(F.count("*").alias("n_lines"), F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("p"))
    return g.select("doc_id", "run", "kind", "n_lines", F.array_join(F.transform("p", lambda x: x["line"]), "|").alias("body"))


@query("""
WITH t AS (SELECT p_partkey, p_partkey // 10 AS dice, (p_partkey % 10) * 2 + 1 AS lo, (p_partkey % 10) * 2 + 2 + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS hi, p_brand FROM part),
c AS (SELECT *, CASE WHEN lag(dice) OVER w = dice AND lo = lag(hi) OVER w + 1 THEN 0 ELSE 1 END AS c FROM t WINDOW w AS (ORDER BY p_partkey))
SELECT p_partkey, dice, lo, hi, c AS starts FROM c
""")
def roll_table_merge(spark, sf_dir):
    size, key = F.col("p_size"), F.col("p_partkey")
    lo = key % 10 * 2 + 1
    t = table(spark, sf_dir, "part").select("p_partkey", F.floor(key / 10).alias("dice"), lo.alias("lo"), (lo + 1 + F.when(size % 3 == 0, 1).otherwise(0)).alias("hi"))
    from pyspark.sql.window import Window

    m = L.merge_tables(t, "dice", "p_partkey")
    first = F.row_number().over(Window.partitionBy("dice", "merged").orderBy("p_partkey"))
    return m.select("p_partkey", "dice", "lo", "hi", F.when(first == 1, 1).otherwise(0).alias("starts"))


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn) AS face FROM conversations")
def face_fill(spark, sf_dir):
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return L.carry_forward(df, "conv_id", "turn", F.when(F.col("role") == "user", F.col("text")), "face").select("conv_id", "turn", "face")


@query()
def wrap_merge(spark, sf_dir):
    return wrap.merge_wrapped(_lines(spark, sf_dir))


@query()
def parsed_documents(spark, sf_dir):
    df = _lines(spark, sf_dir).withColumnRenamed("doc_id", "slug").withColumn("title", F.lit(""))
    return parse.parse(df).select("slug", "pos", "kind", "name", F.size("items").alias("n_items"))


@query()
def rendered_documents(spark, sf_dir):
    df = _lines(spark, sf_dir).withColumnRenamed("doc_id", "slug").withColumn("title", F.lit(""))
    return publish.article_html(publish.render(parse.parse(df)))


@query(f"WITH {LINES_SQL}, w AS (SELECT doc_id, pos, line, {WORDS_SQL.format('line')} AS w FROM l) SELECT doc_id, pos::INT AS pos, line FROM w WHERE {_HEADING.format(x='line', w='w')}")
def heading_lines(spark, sf_dir):
    return _lines(spark, sf_dir).where(T.heading("line")).select("doc_id", "pos", "line")
