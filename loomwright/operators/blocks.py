"""Window operators over marked lines, and the blocks they make up. lines: (slug, pos, line)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomwright.functions import rich as R
from loomwright.functions import text as T


def _so_far(key: str) -> Window:
    return Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def in_box(lines: DataFrame, key: str = "slug") -> DataFrame:
    """Adds in_box: between a line marked BOX and its ENDBOX."""
    step = F.when(F.col("marker") == "BOX", 1).when(F.col("marker") == "ENDBOX", -1).otherwise(0)
    return lines.withColumn("in_box", F.sum(step).over(_so_far(key)) > 0)


def drop_repeated_rules(lines: DataFrame, key: str = "slug") -> DataFrame:
    """Of rules that follow one another the first."""
    before = F.lag("marker").over(Window.partitionBy(key).orderBy("pos"))
    return lines.withColumn("before_", before).where("not (marker <=> 'HR' and before_ <=> 'HR')").drop("before_")


def check_ids(lines: DataFrame, key: str = "slug") -> DataFrame:
    """Adds check_id to lines marked C: the page's key and a running number."""
    n = F.sum(F.when(F.col("marker") == "C", 1).otherwise(0)).over(_so_far(key))
    return lines.withColumn("check_id", F.when(F.col("marker") == "C", F.concat_ws("-", F.col(key).cast("string"), n.cast("string"))))


def first_line(lines: DataFrame, key: str, wanted: Column) -> DataFrame:
    return lines.groupBy(key).agg(F.min_by("line", F.when(wanted, F.col("pos"))).alias("line"))


def groups_by_divider(lines: DataFrame, divider: Column, key: str = "slug") -> DataFrame:
    """Adds `part`: how many dividers stand at or before a line."""
    return lines.withColumn("part", F.sum(F.when(divider, 1).otherwise(0)).over(_so_far(key)))


def visible_labels(nav: DataFrame, key: str = "nav") -> DataFrame:
    """A label shows if an entry before the next label does; nav: (nav, pos, is_label, shown)."""
    df = groups_by_divider(nav, F.col("is_label"), key)
    some = F.max(F.when(~F.col("is_label"), F.col("shown")).otherwise(F.lit(False))).over(Window.partitionBy(key, "part"))
    return df.withColumn("shown", F.when(F.col("is_label"), some).otherwise(F.col("shown"))).drop("part")


def words_in(words: DataFrame, x0: float, x1: float, y0: float, y1: float) -> DataFrame:
    """Words whose centre lies in a rectangle; words: (.., x0, y0, x1, y1, text)."""
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    return words.where((cx >= x0) & (cx < x1) & (cy >= y0) & (cy < y1))


def mark_rows(spans: DataFrame, key: list[str]) -> DataFrame:
    """Per line the number of dingbats, and whether it is a row of marks: two at least and no text."""
    g = spans.groupBy(*key).agg(F.sum(F.regexp_count("text", F.lit("[◇◆○●□☐]"))).cast("long").alias("n_marks"), F.max(F.regexp_replace("text", "[◇◆○●□☐\\s]", "") != "").alias("has_text"))
    return g.select(*key, "n_marks", ((F.col("n_marks") >= 2) & ~F.col("has_text")).alias("is_marks"))


def stat_headings(lines: DataFrame, key: str = "slug") -> DataFrame:
    """Headings that begin a stat block: hit points or damage in the next five lines, or a tag line in the next three."""
    w = Window.partitionBy(key).orderBy("pos")
    ahead = lambda n: F.lead("line", n).over(w)
    stats = [F.coalesce(ahead(i).rlike(T.HIT_POINTS) | ahead(i).rlike(r"(?i)^\s*(damage|instinct)\b"), F.lit(False)) for i in range(1, 6)]
    tags = [F.coalesce(T.tag_line(ahead(i)), F.lit(False)) for i in range(1, 4)]
    flag = stats[0]
    for x in stats[1:] + tags:
        flag = flag | x
    return lines.withColumn("is_stat_block", T.heading("line") & ~T.tag_line("line") & flag)


def dice_tables(lines: DataFrame, key: str = "slug") -> DataFrame:
    """(slug, pos, dice, label, entries) of dice headers and the entries after them; lines that are none go on with the entry before."""
    df = groups_by_divider(lines, T.roll_header("line"), key).where("part > 0")
    df = df.withColumn("is_head", T.roll_header("line"))
    df = df.withColumn("entry", F.sum(F.when(F.col("line").rlike(T.ENTRY), 1).otherwise(0)).over(Window.partitionBy(key, "part").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)))
    entries = df.where("not is_head and entry > 0").groupBy(key, "part", "entry").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), " ").alias("text"))
    part = lambda i: F.regexp_extract("text", T.ENTRY, i)
    lo = part(1).cast("int")
    rows = entries.select(key, "part", "entry", F.struct(lo.alias("lo"), F.coalesce(F.try_to_number(part(2), F.lit("99")).cast("int"), lo).alias("hi"), part(3).alias("body")).alias("e"))
    rows = rows.groupBy(key, "part").agg(F.transform(F.sort_array(F.collect_list(F.struct("entry", "e"))), lambda x: x["e"]).alias("entries"))
    head = df.where("is_head").select(key, "part", "pos", F.regexp_extract("line", rf"(?i)({T.DICE})", 1).alias("dice"), F.trim(F.regexp_replace("line", rf"(?i){T.DICE}", "")).alias("label"))
    return head.join(rows, [key, "part"], "left").select(key, "pos", "dice", "label", F.coalesce("entries", F.array().cast("array<struct<lo:int,hi:int,body:string>>")).alias("entries"))


def price_tables(lines: DataFrame, key: str = "slug") -> DataFrame:
    """(slug, part, header, rows): price rows under each price header."""
    df = groups_by_divider(lines, T.value_header("line"), key).where("part > 0").withColumn("row", T.value_row("line"))
    g = df.groupBy(key, "part").agg(F.min_by("line", "pos").alias("header"), F.sort_array(F.collect_list(F.when(F.col("row").isNotNull(), F.struct("pos", "row")))).alias("r"))
    return g.select(key, "part", "header", F.transform("r", lambda x: x["row"]).alias("rows"))


def moves(lines: DataFrame, key: str = "slug") -> DataFrame:
    """(slug, part, name, body): a name in capitals whose next line begins with "When ", up to the next such name."""
    starts = T.all_caps_label("line") & F.coalesce(F.lead("line").over(Window.partitionBy(key).orderBy("pos")).startswith("When "), F.lit(False))
    df = groups_by_divider(lines.withColumn("starts", starts), F.col("starts"), key).where("part > 0")
    body = F.sort_array(F.collect_list(F.when(~F.col("starts"), F.struct("pos", "line"))))
    return df.groupBy(key, "part").agg(F.min_by("line", "pos").alias("name"), F.array_join(F.transform(body, lambda x: x["line"]), " ").alias("body"))


def improvements(lines: DataFrame, key: str = "slug") -> DataFrame:
    """(slug, part, header, items): what each requirement header asks for, at most thirty items as the books have them."""
    df = groups_by_divider(lines, R.requirement_header("line") | F.trim("line").rlike(R.REQUIREMENT_END), key).where("part > 0")
    is_item = R.requirement_item("line")
    g = df.groupBy(key, "part").agg(F.min_by("line", "pos").alias("header"), F.sort_array(F.collect_list(F.when(is_item, F.struct("pos", R.strip_marker("line").alias("item"))))).alias("x"))
    return g.where(R.requirement_header("header")).select(key, "part", "header", F.slice(F.transform("x", lambda x: x["item"]), 1, 30).alias("items"))
