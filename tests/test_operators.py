from pyspark.sql import functions as F

from loomwright.functions import rich as R
from loomwright.functions import rules as L
from loomwright.functions import text as T
from loomwright.operators import dice, layout, lines, links, model, search, wrap
from loomwright.streaming import state


def test_cluster_is_anchored_at_the_first_y(spark):
    df = spark.createDataFrame([(1, i, 0.0, y) for i, y in enumerate((100.0, 104.4, 108.8))], "page int, ord long, x double, y double")
    assert [r.line_y for r in layout.cluster_lines(df, ["page"]).orderBy("ord").collect()] == [100.0, 100.0, 108.8]


def test_half_even_dedupe(spark):
    df = spark.createDataFrame([(1, 1, 2.5, "a"), (1, 2, 2.0, "a"), (1, 3, 3.5, "a"), (1, 4, 2.5, "b")], "page int, ord int, x double, text string")
    assert [r.ord for r in layout.dedupe_rounded(df, ["page"], ["x"], ["text"], "ord").orderBy("ord").collect()] == [1, 3, 4]


def test_assemble(spark):
    df = spark.createDataFrame([(1, 1, 0.0, 5.0, "case"), (1, 2, 5.5, 9.0, "s"), (1, 3, 12.0, 15.0, "with"), (1, 4, 17.0, 18.0, ".")], "row int, ord int, x double, x1 double, text string")
    assert layout.assemble(df, ["row"]).first()["line"] == "cases with."


def test_rules_apart_and_icons(spark):
    df = spark.createDataFrame([(1, i, y) for i, y in enumerate((10.0, 12.0, 16.0, 14.9))], "page int, ord int, y double")
    assert sorted(r.ord for r in layout.rules_apart(df, ["page"]).collect()) == [0, 2]
    pairs = spark.createDataFrame([(1, 1, 1), (1, 2, 1), (1, 2, 2)], "page int, line int, icon int")
    assert sorted((r.line, r.icon) for r in layout.icons_to_lines(pairs, ["page"]).collect()) == [(1, 1), (2, 2)]


def test_toc_ends_before_index_and_shared_pages(spark):
    toc = spark.createDataFrame([(1, 1, "Contents", 1), (2, 1, " A ", 3), (3, 2, "sub", 4), (4, 1, "B", 7), (5, 1, "C", 7), (6, 1, "Index", 9)], "ord int, level int, title string, page int")
    a = model.articles_from_toc(toc, 20)
    assert [(r.title, r.start_page, r.end_page) for r in a.orderBy("ord").collect()] == [("A", 3, 6), ("B", 7, 6), ("C", 7, 8)]
    assert [(r.page, r.slug) for r in model.page_lookup(a).orderBy("page").collect()] == [(3, "a"), (4, "a"), (5, "a"), (6, "a"), (7, "c"), (8, "c")]


def test_anchor_collisions(spark):
    df = spark.createDataFrame([("k", 1, "Foo"), ("k", 2, "Foo"), ("k", 3, "Foo 2"), ("j", 1, "Foo"), ("j", 2, "!"), ("j", 3, "Foo")], "key string, pos int, name string")
    got = {(r.key, r.pos): r.id for r in model.unique_anchors(df, "key", "pos", "name").collect()}
    assert got == {("k", 1): "foo", ("k", 2): "foo-2", ("k", 3): "foo-2-2", ("j", 1): "foo", ("j", 2): "section", ("j", 3): "foo-2"}


def test_unique_sections(spark):
    df = spark.createDataFrame([("a", 1, "i1", "old mill"), ("a", 2, "i2", "old mill"), ("b", 3, "i3", "new mill"), ("a", 4, "i4", "new mill"), ("a", 5, "i5", "mill")], "slug string, pos int, id string, norm string")
    assert [(r.norm, r.slug, r.id) for r in model.unique_sections(df).collect()] == [("old mill", "a", "i2")]


def test_resolution_prefers_titles_and_falls_back_to_prefixes(spark):
    page_lookup = spark.createDataFrame([(5, "zoo", "Zoo")], "page int, slug string, title string")
    titles = spark.createDataFrame([("ruined tower", "tower")], "title_key string, slug string")
    by_page = spark.createDataFrame([(5, "wolf", "zoo", "wolf-id")], "page int, norm string, slug string, id string")
    by_slug = spark.createDataFrame([("zoo", "bears", "bears-id")], "slug string, norm string, id string")
    asked = spark.createDataFrame([(1, "Ruined Tower", 5), (2, "or wolves", 5), (3, "the bear", 5), (4, "nothing", 9)], "link_id int, label string, page int")
    got = {r.link_id: (r.dst_slug, r.fragment) for r in links.resolve(asked, page_lookup, titles, by_page, by_slug).collect()}
    assert got == {1: ("tower", None), 2: ("zoo", "wolf-id"), 3: ("zoo", "bears-id"), 4: (None, None)}
    unique = spark.createDataFrame([("runes around", "r", "runes")], "norm string, slug string, id string")
    labels = spark.createDataFrame([(1, "Runes around a ruined hall")], "label_id int, label string")
    assert links.resolve_unique(labels, unique).first().id == "runes"


def test_title_scores(spark):
    rows = [("The flow", "The flow of play", 84), ("trade", "trade with harrows", 85), ("DEATH'S DOOR", "Death s Door", None), ("DEATHS DOOR", "DEATH S DOOR", 105), ("x", "y", None), ("TRADE &", "Trade with Harrow", None), ("old mill pond", "old mill", 63), ("the mill", "by the old mill road", None), ("millpond", "by the millpond road", 45), ("ab", "ab", 100)]
    df = spark.createDataFrame(rows, "a string, b string, want int")
    for r in df.select("a", "b", links.title_score(F.col("a"), F.col("b")).alias("s"), "want").collect():
        assert r.s == r.want, r
    labels = df.select(F.lit("s").alias("slug"), F.col("a").alias("label_pos"), F.col("a").alias("label")).distinct()
    names = df.select(F.lit("s").alias("slug"), F.col("b").alias("section_pos"), F.col("b").alias("name")).distinct()
    every = labels.join(names, "slug").select("label_pos", "section_pos", links.title_score(F.col("label"), F.col("name")).alias("score")).where("score is not null")
    assert sorted(map(tuple, links.score_titles(labels, names).select("label_pos", "section_pos", "score").collect())) == sorted(map(tuple, every.collect()))
    scores = spark.createDataFrame([("s", 1, 1, 80), ("s", 1, 2, 80), ("s", 2, 1, 100), ("s", 2, 2, 55)], "slug string, label_pos int, section_pos int, score int")
    assert sorted((r.label_pos, r.section_pos) for r in links.assign_titles(scores).collect()) == [(1, 1), (2, 2)]


def test_wrapped_lines():
    assert wrap.merged(["crys-", "tal", "came—", "when", "it ended.", "A thing (page", "436), especially"]) == ["crystal came—when it ended.", "A thing (page 436), especially"]
    assert len({name for name, _, _ in wrap.RULES}) == len(wrap.RULES)


def test_wrapped_lines_of_many_documents(spark):
    rows = [(d, i, x) for d in range(7) for i, x in enumerate(["a long line that", f"goes on {d}", "", "Short"] * 3)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, line string").repartition(5)
    got = {}
    for r in wrap.merge_wrapped(df).orderBy("doc_id", "pos").collect():
        got.setdefault(r.doc_id, []).append(r.line)
    assert got == {d: wrap.merged(["a long line that", f"goes on {d}", "", "Short"] * 3) for d in range(7)}
    assert wrap.merge_wrapped(df.where("false")).count() == 0


SAMPLES = [
    "", "a", "The Mill", "the the old old", "a b a b", "HP 4", "Horde, small", "goods value", "Weapons & Armor Value", "Rope 2", "Room 3 for a night", "free", "+2", "1d6 omens", "d8", "omens 1d6", "3-5 a bird", "• item", "ALL CAPITALS",
    "It ends.", "Contents", "Questions:", "Requires both:", "And then, all of these", "Henceforth it is", "magical, hand", "◇ close", "+1 damage", "see pages 4-5", "Value 3)", "a line that is far too long to be a heading of any kind in a book, so it is prose",
    "When you strike, roll", "Steading improvement", "Also, it goes on", "up", "If you want of play and", "l l l", "123", "Title of a Thing by the River", "Nine words are too many for a heading here now", "Élan Vital", "ça va", "2 Things", "Threat (old)",
]


def test_rules_are_those_of_the_columns(spark):
    df = spark.createDataFrame([(x,) for x in SAMPLES], "s string")
    s = F.col("s")
    pairs = {
        "heading": (T.heading(s), L.heading), "tags": (T.tag_line(s), L.tag_line), "roll": (T.roll_header(s), L.roll_header), "price": (T.value_header(s), L.value_header), "caps": (T.all_caps_label(s), L.caps_label),
        "doubled": (T.pairwise_doubled(s), L.doubled), "undoubled": (T.undouble(s), L.undouble), "head": (R.running_header(s, F.lit("The Mill"), True), lambda x: L.running_header(x, "The Mill", True)), "pure": (T.pure_tags(s), L.pure_tags),
        "requires": (R.requirement_header(s), L.require_header), "item": (R.requirement_item(s), L.require_item), "benefit": (R.benefit_continues(s), L.benefit_continues), "prose": (lines.toc_prose(s), L.toc_prose), "scrap": (lines.toc_garbage(s), L.toc_garbage),
        "marks": (R.mark_track(s), L.mark_track), "key": (T.section_key(s), L.section_key), "slug": (T.slug(s, "section"), lambda x: L.slug(x, "section")), "normal": (T.normalize_text(s), L.normal),
        "row": (F.concat_ws("=", T.value_row(s)["item"], T.value_row(s)["value"]), lambda x: "=".join(L.value_row(x) or ())),
    }
    for row in df.select("s", *[c.alias(n) for n, (c, _) in pairs.items()]).collect():
        for name, (_, rule) in pairs.items():
            assert row[name] == rule(row.s), (name, row.s, row[name])


def test_split_dice_tables(spark):
    def merged(rows):
        return [r.merged for r in lines.merge_tables(spark.createDataFrame(rows, "k int, o int, dice string, lo int, hi int"), "k", "o").orderBy("o").collect()]

    assert merged([(1, 1, "d12", 1, 7), (1, 2, "d12", 8, 12)]) == [1, 1]
    assert merged([(1, 1, "d12", 1, 7), (1, 2, "d12", 9, 12)]) == [1, 2]


def test_search_ranks_and_counts(spark):
    docs = spark.createDataFrame([("1", "the cat", "", "x"), ("2", "The big cat", "", "x"), ("3", "dog", "e", "a cat and the dog"), ("4", "the", "e", "cat")], "slug string, title string, excerpt string, text string")
    got = search.search(docs, "The CAT").collect()
    assert [(r.slug, r.rank, r.where) for r in got] == [("1", -1, "title"), ("2", 0, "title"), ("3", 1, "text")]
    by_title = spark.createDataFrame([("1", "Zoe cat", "", ""), ("2", "élan cat", "", ""), ("3", "abel cat", "", "")], "slug string, title string, excerpt string, text string")
    assert [r.slug for r in search.search(by_title, "cat").collect()] == ["3", "2", "1"]
    assert search.search(docs, "  ").count() == 0 and search.count_hits(docs, "the cat").first().n_hits == 3


def test_last_matching_row_wins(spark):
    totals = spark.createDataFrame([(1, 1, 5), (2, 1, 99)], "roll_id int, table_id int, total int")
    ranges = spark.createDataFrame([(1, 1, 5, 6), (1, 2, 4, 5)], "table_id int, pos int, lo int, hi int")
    assert {r.roll_id: r.row_pos for r in dice.look_up(totals, ranges).collect()} == {1: 2, 2: None}


def test_unchecking_crosses_pages(spark):
    e = spark.createDataFrame([(1, "a", "req-1", True), (2, "b", "req-1", True), (3, "b", "req-1", False), (4, "a", "req-2", True)], state.EVENT)
    s = state.check_state(e)
    assert [(r.page, r.check_id) for r in s.collect()] == [("a", "req-2")]
    asked = spark.createDataFrame([("z", "req-2"), ("a", "req-1")], "page string, check_id string")
    assert {r.check_id: r.checked for r in state.is_checked(asked, s).collect()} == {"req-2": True, "req-1": False}


def test_check_stream(spark, tmp_path):
    rows = [(1, "a", "r", True), (2, "b", "r", True), (3, "b", "r", False)]
    spark.createDataFrame(rows, state.EVENT).coalesce(1).write.json(str(tmp_path / "in"))
    stream = state.check_stream(spark.readStream.schema(state.EVENT).json(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("checks").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.seq: r.n_pages for r in spark.table("checks").collect()} == {1: 1, 2: 2, 3: 0}


def test_pins(spark):
    e = spark.createDataFrame([(1, "m", 1, "add", -1.0, 0.5, "x"), (2, "m", 1, "label", None, None, "y"), (3, "m", 2, "add", 0.1, 0.1, "z"), (4, "m", 2, "delete", None, None, None)], "seq int, map_id string, pin int, op string, x double, y double, label string")
    assert [tuple(r) for r in state.pins(e).collect()] == [("m", 1, 0.0, 0.5, "y")]
