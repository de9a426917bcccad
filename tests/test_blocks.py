from pyspark.sql import functions as F

from loomwright.functions import rich as R
from loomwright.operators import blocks as B
from loomwright.operators import parse
from loomwright.operators import publish as P


def frame(spark, *lines):
    return spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "slug string, pos int, line string")


def test_running_headers(spark):
    rows = [("The Dread Riv", "The Dread River", True), ("The Dread River is the eastern border of the World's End", "The Dread River", False), ("Greenvale", "The village of Greenvale", True), ("x x", "y", True), ("", "y", True), ("Index", "y", True), ("plain text", "y", False)]
    df = spark.createDataFrame(rows, "line string, title string, want boolean")
    assert all(r.got == r.want for r in df.select("want", R.running_header("line", "title", True).alias("got")).collect())


def test_formatting(spark):
    df = spark.createDataFrame([("\x04Name\x05 rest \x06it\x07",)], "s string")
    r = df.select(R.to_html("s").alias("html"), R.plain("s").alias("plain"), R.bold_prefix("s").alias("bold"), R.runs("s").alias("runs")).first()
    assert r.html == "<strong>Name</strong> rest <em>it</em>" and r.plain == "Name rest it" and r.bold == "Name"
    assert [(x.text, x.bold, x.italic) for x in r.runs] == [("Name", True, False), (" rest ", False, False), ("it", False, True)]


def test_titles_and_moves(spark):
    df = spark.createDataFrame([("A folktale folktale", "\x04STRIKE OUT\x05 \x06(small)\x07 When you strike")], "a string, b string")
    r = df.select(R.collapse_title("a").alias("a"), R.named_move("b").alias("b")).first()
    assert r.a == "A folktale" and (r.b.name, r.b.tags, r.b.trigger) == ("STRIKE OUT", "small", "When you strike")


def test_dice_tables(spark):
    df = frame(spark, "intro", "1d6 omens", "1-3 a bird", "of ill will", "4 smoke", "d4", "1 end")
    got = B.dice_tables(df).orderBy("pos").collect()
    assert [(r.dice, r.label, [(e.lo, e.hi, e.body) for e in r.entries]) for r in got] == [("1d6", "omens", [(1, 3, "a bird of ill will"), (4, 4, "smoke")]), ("d4", "", [(1, 1, "end")])]


def test_price_tables_and_moves(spark):
    got = B.price_tables(frame(spark, "goods value", "Rope 1", "Cart, fine free", "no price here")).first()
    assert got.header == "goods value" and [(r.item, r.value) for r in got.rows] == [("Rope", "1"), ("Cart, fine", "free")]
    assert [(r.name, r.body) for r in B.moves(frame(spark, "LAST STAND", "When you fall", "roll", "NEXT ONE", "When it ends")).orderBy("part").collect()] == [("LAST STAND", "When you fall roll"), ("NEXT ONE", "When it ends")]


def test_improvements(spark):
    got = B.improvements(frame(spark, "Requires all of the following:", "a mill", "Terrain", "And either of these", "stone", "Henceforth", "x")).orderBy("part").collect()
    assert [(r.header, r["items"]) for r in got] == [("Requires all of the following:", ["a mill"]), ("And either of these", ["stone"])]


def test_stat_blocks_look_ahead(spark):
    df = B.stat_headings(frame(spark, "Crag Wolf", "Horde, small, stealthy", "HP 4", "Far Field", "plain words go on here for long"))
    assert [r.is_stat_block for r in df.orderBy("pos").collect()] == [True, False, False, False, False]


def test_rows_of_marks(spark):
    df = spark.createDataFrame([(1, "◇ ◇"), (1, "◇"), (2, "◇ text")], "line int, text string")
    assert {r["line"]: (r.n_marks, r.is_marks) for r in B.mark_rows(df, ["line"]).collect()} == {1: (3, True), 2: (1, False)}


def test_rendering_escapes_and_nests(spark):
    rows = frame(spark, "\x02H2 A <b>", "\x02BOX", "\x02H4 Size", "small & old", "\x02ENDBOX", "\x02B one \x04two\x05", "\x02VT goods", "\x02VR Rope\x032").withColumn("title", F.lit("T"))
    done = P.render(parse.parse(rows))
    html = P.article_html(done).first().html
    assert html == '<h2 id="a-b">A &lt;b&gt;</h2>\n<div class="infobox"><h4>Size</h4><p>small &amp; old</p></div>\n<ul class="bullets"><li>one <strong>two</strong></li></ul>\n<div class="value-table"><div class="value-table-head">Goods Value</div><table><tbody><tr><td>Rope</td><td class="val">2</td></tr></tbody></table></div>'
    page = spark.createDataFrame([('<p>x</p><div class="stat-block" id="wolf"><div>in</div></div><div class="other" id="no"></div>',)], "html string")
    assert page.select(P.blocks_by_id("html").alias("m")).first().m == {"wolf": '<div class="stat-block" id="wolf"><div>in</div></div>'}


def test_stat_parts():
    got = parse.stat_parts(["Threat (old)", "HP 4; Armor 1", "Damage d6,", "messy", "d4 (reach)", "Instinct: to hunt", "• howl", "run away", "A wolf of the north that has seen many winters and many hunters come.", "• an option", "Questions:", "• why?", "When it dies, mark it", "\x02C dead", ("1d4", "tasks", [("1", "eat", 0)])])
    assert got == {
        "tags": ["Threat (old)"], "stats": ["HP 4; Armor 1", "Damage d6, messy d4 (reach)", "Instinct: to hunt"], "moves": ["howl", "run away"],
        "notes": ["A wolf of the north that has seen many winters and many hunters come.", "• an option", "Questions", "• why?", "When it dies, mark it"], "checks": ["dead"], "tables": [("1d4", "tasks", [("1", "eat", 0)])],
    }


def test_parser_always_moves_on():
    import random

    rng = random.Random(1)
    lines = ["\x02HR", "\x02H3 Wolf", "\x02C x", "\x02VA y", "\x02VR a\x031", "\x02ENDBOX", "\x02BOX", "\x02ZZ ?", "Horde, small", "HP 4", "1d6 x", "1 a", "2 b", "goods value", "Rope 1", "•", "• a", "steading improvement", "Requires both:", "GOLD", "When you go", "text", "", "d6", "theme"]
    for _ in range(400):
        given = [rng.choice(lines) for _ in range(rng.randint(0, 14))]
        parse.flat(parse.Parser(given, "T").run())


def test_more_requirements_than_a_block_has():
    anchors = parse.Anchors()
    assert parse.improvement(["Requires all of the following:", *["a thing"] * 31], 0, anchors) is None and not anchors.sections
    block, end = parse.improvement(["Requires all of the following:", *["a thing"] * 30], 0, anchors)
    assert end == 31 and len(block.items) == 31 and anchors.sections[0][0] == "steading-improvement"
