"""Classes, seams and shapes of lines of the tables, each beside its oracle SQL, and parts of pages as HTML."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions import rich as R
from loomwright.functions import rules
from loomwright.functions import text as T
from loomwright.operators import lines as L
from loomwright.operators import publish, wrap
from loomwright.plans.text_queries import LINES_SQL, WORDS_SQL
from loomwright.sources import tables
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


_DIE = r"\d{0,2}d(?:4|6|8|10|12|20)"
_SMALL = "len(list_filter(w, lambda x: regexp_matches(x, '^\\p{Ll}')))"
_OPENINGS = ", ".join(f"'{x.lower()}'" for x in rules.CHAPTER_OPENINGS)
_SHARDS = ", ".join(f"'{x}'" for x in rules.LONE_SHARDS)
_FORWARD = f"regexp_extract(line, '(?i)^{_DIE}\\s+(.+)$', 1)"
_ENTRY = "regexp_matches(line, '^\\d{1,2}(\\s*[-–—]\\s*\\d{1,2})?\\s+.+$')"
_ROLL = f"""({_FORWARD} <> '' AND length({_FORWARD}) <= 48 AND NOT regexp_matches({_FORWARD}, '[()]|(?i:\\bvalue\\b)') AND length(regexp_replace({_FORWARD}, '[^,]', '', 'g')) < 2 AND NOT regexp_matches({_FORWARD}, '[.;:]$')
  OR regexp_matches(line, '(?i)^{_DIE}$') OR regexp_matches(line, '(?i)^.{{1,40}}?\\s+{_DIE}$') AND NOT {_ENTRY})"""


@query(f"""
WITH {LINES_SQL}, w AS (SELECT doc_id, pos, trim(line) AS line, {WORDS_SQL.format("line")} AS w FROM l)
SELECT doc_id, pos::INT AS pos, {_ROLL} AS dice_header, {_ENTRY} AS entry, regexp_matches(line, '(?i)\\bHP\\s*\\d+') AS hit_points,
  length(line) >= 70 OR length(line) >= 48 AND ({_SMALL} >= 2 OR {_SMALL} >= 1 AND regexp_matches(line, '[.!?]$')) OR length(line) >= 35 AND len(list_filter([{_OPENINGS}], lambda x: starts_with(lower(line), x))) > 0 AS toc_prose,
  line = '' OR {_SMALL} >= 2 AND NOT regexp_matches(line, '[.!?:]$') AND (len(w) >= 5 OR length(line) > 42) OR lower(line) IN ({_SHARDS}) AS toc_scrap,
  CASE WHEN regexp_matches(line, '^[lLoO□☐○●•·\\s]{{2,}}$') AND length(regexp_replace(line, '\\s', '', 'g')) BETWEEN 2 AND 12 THEN length(regexp_replace(line, '\\s', '', 'g')) ELSE 0 END::INT AS marks
FROM w
""")
def line_classes(spark, sf_dir):
    """Every line of the documents under the line rules that SQL can tell."""
    lines = L.explode_lines(table(spark, sf_dir, "documents"))
    line = F.col("line")
    return lines.select(
        "doc_id", "pos", T.roll_header(line).alias("dice_header"), T.strip(line).rlike(T.U + T.ENTRY).alias("entry"), line.rlike(T.U + T.HIT_POINTS).alias("hit_points"), L.toc_prose(line).alias("toc_prose"),
        L.toc_garbage(line).alias("toc_scrap"), R.mark_track(line).alias("marks"),
    )


_PART_LINES = """p AS (SELECT p_partkey, p_name, p_size, CASE p_size % 6 WHEN 0 THEN p_size || ' ' || p_name WHEN 1 THEN p_name || ' ' || p_size WHEN 2 THEN (p_partkey % 3) || 'd' || p_size || ' ' || p_name
  WHEN 3 THEN 'HP ' || p_size || '; ' || p_name WHEN 4 THEN p_name || ' d' || p_size ELSE upper(p_name) || ' ' || p_brand END AS line FROM part)"""


@query(f"""
WITH {_PART_LINES}
SELECT p_partkey, line, {_ROLL} AS dice_header, {_ENTRY} AS entry, starts_with(line, 'HP') AS hit_points,
  length(regexp_replace(line, '[^A-Z]', '', 'g')) * 100 >= length(regexp_replace(line, '[^A-Za-z]', '', 'g')) * 85 AS caps,
  CASE WHEN p_size % 6 = 1 THEN p_name END AS item, CASE WHEN p_size % 6 = 1 THEN p_size::VARCHAR END AS price
FROM p
""")
def part_line_classes(spark, sf_dir):
    """Lines put together from what the parts say: entries, prices, dice, hit points and capitals."""
    name, size, key = F.col("p_name"), F.col("p_size"), F.col("p_partkey")
    kinds = [F.concat_ws(" ", size, name), F.concat_ws(" ", name, size), F.concat(key % 3, F.lit("d"), size, F.lit(" "), name), F.concat(F.lit("HP "), size, F.lit("; "), name), F.concat(name, F.lit(" d"), size), F.concat_ws(" ", F.upper(name), "p_brand")]
    line = F.get(F.array(*kinds), (size % 6).cast("int"))
    df = table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
    row = T.value_row("line")
    return df.select("p_partkey", "line", T.roll_header("line").alias("dice_header"), F.col("line").rlike(T.U + T.ENTRY).alias("entry"), F.col("line").rlike(T.U + T.HIT_POINTS).alias("hit_points"), T.all_caps_label("line").alias("caps"), row["item"].alias("item"), row["value"].alias("price"))


@query(f"""
WITH {LINES_SQL}, b AS (SELECT doc_id, pos, line, lag(line) OVER (PARTITION BY doc_id ORDER BY pos) AS was FROM l)
SELECT doc_id, pos::INT AS pos, CASE WHEN regexp_matches(was, '[–—]$') THEN was || line WHEN regexp_matches(was, '-$') AND NOT regexp_matches(was, '--$') THEN CASE WHEN regexp_matches(line, '^\\p{{Ll}}') THEN regexp_replace(was, '-$', '') || line ELSE was || line END
  ELSE was || ' ' || line END AS glued FROM b WHERE was IS NOT NULL
""")
def glued_lines(spark, sf_dir):
    """Each line of the documents put to the one before it."""
    lines = L.explode_lines(table(spark, sf_dir, "documents"))
    was = F.lag("line").over(Window.partitionBy("doc_id").orderBy("pos"))
    return lines.withColumn("was", was).where("was is not null").select("doc_id", "pos", wrap.glued(F.col("was"), F.col("line")).alias("glued"))


@query()
def join_verdicts(spark, sf_dir):
    """Whether each line of the documents goes on with the one before it, and the rule that says so. Tests hold the rules against plain values."""
    return wrap.verdicts(L.explode_lines(table(spark, sf_dir, "documents")))


@query("""
SELECT conv_id, turn, role AS prefix, role || ' ' || text AS plain, 2::INT AS n_runs, '<strong>' || role || '</strong> ' || text AS html, 'B' AS mark FROM conversations WHERE text <> ''
""")
def styled_turns(spark, sf_dir):
    """Turns with their roles in bold under a mark: the bold beginning, the plain text, the runs of one style, HTML and the mark."""
    df = table(spark, sf_dir, "conversations").where("text <> ''").withColumn("line", F.concat(F.lit("\x04"), "role", F.lit("\x05 "), "text"))
    marked = F.concat(F.lit("\x02B "), "line")
    return df.select("conv_id", "turn", R.split_bold("line")["prefix"].alias("prefix"), R.strip_marker(marked).alias("plain"), F.size(R.runs("line")).alias("n_runs"), R.to_html("line").alias("html"), R.marker(marked).alias("mark"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 3 = 2 THEN 'Map ' || p_size ELSE 'Map ' || p_size || ' — ' || p_name END AS label, p_size % 3 = 0 AS shown FROM part
""")
def map_names(spark, sf_dir):
    """Labels of map files named after the parts, and which are large sheets."""
    ends = F.array(F.concat(F.lit(" - "), "p_name", F.lit(" - 11 x 14.jpg")), F.concat(F.lit(" - "), "p_name", F.lit(" - A4.png")), F.lit(".jpeg"))
    name = F.concat(F.lit("Map "), "p_size", F.get(ends, (F.col("p_size") % 3).cast("int")))
    return table(spark, sf_dir, "part").select("p_partkey", tables.map_label(name).alias("label"), tables.is_shown_map(name).alias("shown"))


def _escaped(s: str) -> str:
    return f"replace(replace(replace(replace(replace({s}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"


_BUTTON = """'<button type="button" class="dice-roll" data-dice="1d6" title="Click to roll 1d6">1d6</button>'"""
_ROWS = "'<tr><th scope=\"row\">1</th><td>' || {0} || '</td></tr><tr><th scope=\"row\">2-6</th><td>a &lt;b&gt;</td></tr>'".format(_escaped("p_name"))


def rendered_parts(spark, sf_dir):
    """Tables, check lists and tracks as HTML."""
    name = F.col("p_name")
    entry = lambda a, b: F.struct(a.alias("label"), b.alias("text"))
    rows = F.array(F.struct(name.alias("item"), F.lit("2").alias("value")), F.struct(F.lit("x & y").alias("item"), F.lit("—").alias("value")))
    return table(spark, sf_dir, "part").select(
        "p_partkey",
        publish.roll_table(F.lit("1d6"), name, F.array(entry(F.lit("1"), name), entry(F.lit("2-6"), F.lit("a <b>"))), F.when(F.col("p_partkey") % 2 == 0, T.slug(name)).otherwise("")).alias("rolls"),
        publish.value_table(F.lit("Goods Value"), rows, F.array(F.lit("* old"))).alias("prices"),
        publish.check_list(F.when(F.col("p_partkey") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array(name, F.lit("b"))), F.lit("req-1")).alias("checks"),
        publish.mark_track((F.col("p_partkey") % 3).cast("int"), F.lit("marks"), F.lit("Progress marks")).alias("track"),
        publish.icon_image(F.when(F.col("p_partkey") % 2 == 0, F.lit("/icons/beast.svg"))).alias("icon"),
    )


def _checked(cid: str, said: str) -> str:
    return f"'<li class=\"check-item\"><label for=\"{cid}\"><input type=\"checkbox\" class=\"wiki-check\" id=\"{cid}\" data-check-id=\"{cid}\"> <span>' || {said} || '</span></label></li>'"


def _step(i: int) -> str:
    return f'<label class="track-step" for="marks-{i}" title="Mark {i + 1}"><input type="checkbox" class="wiki-check" id="marks-{i}" data-check-id="marks-{i}" aria-label="Mark {i + 1}"></label>'


QUERIES["rendered_parts"] = rendered_parts
ORACLE_SQL["rendered_parts"] = f"""
SELECT p_partkey,
  '<div class="roll-table"' || CASE WHEN p_partkey % 2 = 0 THEN ' id="' || replace(p_name, ' ', '-') || '"' ELSE '' END || '><div class="roll-table-head">' || {_BUTTON} || ' <span class="roll-label">' || {_escaped("p_name")} || '</span></div><table><tbody>' || {_ROWS} || '</tbody></table></div>' AS rolls,
  '<div class="value-table"><div class="value-table-head">Goods Value</div><table><tbody><tr><td>' || {_escaped("p_name")} || '</td><td class="val">2</td></tr><tr><td>x &amp; y</td><td class="val">—</td></tr></tbody></table><div class="value-note">* old</div></div>' AS prices,
  CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '<ul class="check-list" data-check-list="req-1">' || {_checked("req-1-0", _escaped("p_name"))} || {_checked("req-1-1", "'b'")} || '</ul>' END AS checks,
  CASE p_partkey % 3 WHEN 0 THEN '' ELSE '<div class="arcana-track" data-check-list="marks"><span class="track-label">Progress marks</span><span class="track-steps">{_step(0)}' || CASE WHEN p_partkey % 3 = 2 THEN '{_step(1)}' ELSE '' END || '</span></div>' END AS track,
  CASE WHEN p_partkey % 2 = 0 THEN '<img class="book-icon" src="../images/icons/beast.svg" alt="" width="18" height="18" loading="lazy">' ELSE '' END AS icon
FROM part
"""
