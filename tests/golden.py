"""Samples of the rules: each is applied to sample lines, filled with the names of `part`. The SQL beside it holds what each sample must
give, worked out from the rule by hand and not by code; {n} in a sample is the row's name, {U} the name in capitals."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import rich as R
from loomwright.functions import rules as L
from loomwright.functions import text as T
from loomwright.operators import cards, pages, parse, rewrite, unlock
from loomwright.operators import lines as N
from loomwright.operators import wrap as W
from loomwright.sources import tables
from loomwright.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _sql(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool | int):
        return str(value).lower()
    return "'" + value.replace("'", "''") + "'"


def _filled(column: Column) -> Column:
    return F.replace(F.replace(column, F.lit("{n}"), F.col("p_name")), F.lit("{U}"), F.upper("p_name"))


def _samples(spark, sf_dir: str, texts: list[str]) -> DataFrame:
    """part with `line`, the sample of each row."""
    line = F.get(F.array(*[F.lit(x) for x in texts]), (F.col("p_partkey") % len(texts)).cast("int"))
    return table(spark, sf_dir, "part").withColumn("line", _filled(line))


def golden(name: str, rule: Callable[[str], Column], samples: dict[str, object]) -> None:
    """Registers the rule over the samples and what they give: a flag, a number or a text."""
    texts, wanted = list(samples), list(samples.values())
    words = isinstance(next(w for w in wanted if w is not None), str)
    got = f"[{', '.join(map(_sql, wanted))}][p_partkey % {len(texts)} + 1]"
    if words:
        got = f"replace(replace({got}, '{{n}}', p_name), '{{U}}', upper(p_name))"

    def run(spark, sf_dir):
        return _samples(spark, sf_dir, texts).select("p_partkey", rule("line").alias("result"))

    QUERIES[name] = run
    ORACLE_SQL[name] = f"SELECT p_partkey, {got} AS result FROM part"


def _python(rule: Callable, kind: str):
    """A rule that is a function of one text as a column function, made when it is first asked for: there is a session then."""
    return lambda s: F.pandas_udf(lambda texts: texts.map(rule), kind)(s)


golden("dice_headers", T.roll_header, {
    "1d6 {n}": True, "d12": True, "2d8 a, b, c": False, "1d6 see (page 2)": False, "1d6 goods value": False, "1d6 it ends.": False, "{n} 1d12": True, "3 {n} d6": False, "{n}": False,
    "1d7 {n}": False, "D20 {n}": True, "1d6 a label that goes on and on and on until it is far too long": False,
})
golden("price_headers", T.value_header, {"goods value": True, "Weapons & Armor Value": True, "food and lodging value": True, "{n} value": False, "value": False, "services": False, "Lodging VALUE": True})
golden("hit_point_lines", lambda s: F.col(s).rlike(T.HIT_POINTS), {"HP 6; Armor 1": True, "{n}, hp12": True, "{n} CHP 3": False, "HP: 3": False, "HP": False})
golden("lone_values", lambda s: F.col(s).rlike(T.LONE_VALUE), {"3": True, "12": True, "+2": True, "Free": True, "123": False, "{n}": False, "3 ": False})
golden("price_row_shapes", lambda s: F.to_json(T.value_row(s)), {
    "{n} 3": '{"item":"{n}","value":"3"}', "{n} free (old)": '{"item":"{n} (old)","value":"free"}', "Room 2 for a night": '{"item":"Room for a night","value":"2"}', "When {n} 3": None,
    "{n}, 4": None, "goods value": None, "{n} +1": '{"item":"{n}","value":"+1"}', "{n}": None,
})
golden("requirement_lines", lambda s: F.when(R.requirement_header(s), "header").when(R.requirement_end(s), "end").when(R.requirement_item(s), "item").otherwise("none"), {
    "Requires all of the following:": "header", "And then, all of the following:": "header", "And either of these": "header", "requires a key": "item", "Henceforth, it holds.": "end",
    "When you meet all the requirements, stop": "end", "{n}": "item", "Terrain": "none", "HP 3": "none", "Horde, small": "none", "{U}": "none", "1d6 {n}": "none", "steading improvement": "none",
})
golden("benefit_lines", R.benefit_continues, {
    "Also, {n}": True, "You can {n}": True, "{n}": False, "{U}": False, "steading improvement": False, "Requires both": False, "1d6 {n}": False,
    "A line that is long enough to be prose and no heading of its own, {n}": True, "Every {n}": True,
})
golden("toc_prose_lines", N.toc_prose, {
    "{n}": False, "This chapter is about {n} and more things": True, "This chapter": False, "A line of more than seventy characters is prose in any case, {n} and so on, on": True,
    "Fifty letters with two small words in it, so prose {n}": True, "ALL CAPITALS OVER FORTY EIGHT LETTERS IN ONE ROW, SO NOT": False,
})
golden("toc_scraps", N.toc_garbage, {"": True, "up": True, "Fly": True, "If you want of play and": True, "{n}": False, "If you want of play.": False, "The Flow of Play": False})
golden("pure_tag_lines", T.pure_tags, {
    "magical": True, "fragile, immobile": True, ", close, thrown,": True, "◇ hand, magical": True, "slow (◇)": False, "hand, Value 4": True, "+1 damage, 1 piercing": True, "{n}, magical": False, "": False,
    "reach 2": True, "magical?": True, "two hands": False,
})
golden("item_tag_lines", _python(L.item_tags, "boolean"), {
    "\x06hand, {n}\x07": True, "\x06When you strike\x07": False, "magical": True, "{n}": False, "\x02B magical": False, "\x06close\x07, far from here it goes on": False, "◇ \x06odd, two words\x07": True,
    "\x06The {n}\x07": False, "": False,
})
golden("mark_tracks", R.mark_track, {"l l l": 3, "□□□□□": 5, "o": 0, "{n}": 0, "l l l l l l l l l l l l l": 0, "● ●": 2})
golden("page_numbers_at_foot", lambda s: R.page_furniture(s, F.lit(590.0) - (F.col("p_partkey") % 2) * 100, F.lit(612.0)), {"12": True, "7": False, "{n}": False, "1234": False})
golden("lines_glued", _python(lambda s: W.glue(*s.split("/")), "string"), {
    "crys-/tal {n}": "crystal {n}", "Anglo-/Saxon": "Anglo-Saxon", "came—/when {n}": "came—when {n}", "{n}/goes on": "{n} goes on", "a --/b": "a -- b", "\x04crys-\x05/\x04tal\x05 {n}": "\x04crystal\x05 {n}",
    "\x04crys-\x05/tal": "\x04crys\x05tal", "\x04\x06a-\x07\x05/\x04\x06b\x07\x05": "\x04\x06ab\x07\x05",
})
golden("bold_beginnings", lambda s: F.to_json(R.split_bold(s)), {"\x04{n}\x05 rest": '{"prefix":"{n}","text":"{n} rest"}', "{n}": '{"prefix":"","text":"{n}"}', "a \x04b\x05": '{"prefix":"","text":"a \\u0004b\\u0005"}'})
golden("marked_lines_stripped", R.strip_marker, {"\x02H3 {n}": "{n}", "\x02B \x04{n}\x05": "{n}", "{n} \x06x\x07": "{n} x", "\x02HR": ""})
golden("style_runs", lambda s: F.to_json(R.runs(s)), {
    "\x04{n}\x05 and \x06so\x07": '[{"text":"{n}","bold":true,"italic":false},{"text":" and ","bold":false,"italic":false},{"text":"so","bold":false,"italic":true}]',
    "{n}": '[{"text":"{n}","bold":false,"italic":false}]', "\x04\x06{n}\x07\x05": '[{"text":"{n}","bold":true,"italic":true}]',
})
golden("leading_tags", _python(lambda s: "|".join(cards.tags_and_prose(s)), "string"), {
    "\x06magical, warm\x07 A ring.": "magical, warm|A ring.", "◇ hand, +1 damage, some {n}": "hand, +1 damage|some {n}", "some {n}": "|some {n}", "fragile": "fragile|", "\x06close\x07": "close|",
})
golden("description_tags", _python(lambda s: "|".join(cards.tags_and_description(s)), "string"), {"◇ \x06magical\x07 {n}": "magical|{n}", "\x06not tags at all\x07 {n}": "|\x06not tags at all\x07 {n}", "{n}": "|{n}"})
golden("named_moves", lambda s: F.to_json(R.named_move(s)), {
    "\x04{U}\x05 When you strike": '{"name":"{U}","tags":"","trigger":"When you strike"}', "\x04{U}\x05 \x06(small)\x07 When": '{"name":"{U}","tags":"small","trigger":"When"}', "\x04{n}\x05 x": None, "{U}": None,
    "\x04{U}\x05 \x06magical\x07": '{"name":"{U}","tags":"magical","trigger":""}',
})
golden("card_lines_without_labels", cards.strip_running, {"{n} front 12": "{n}", "Back 3": "", "\x02H3 {n} back": "{n}", "frontier {n}": "frontier {n}"})
golden("card_titles", lambda s: cards.card_title(*[F.filter(F.split(F.substring_index(s, "|", k), "/"), lambda x: x != "") for k in (1, -1)]), {
    "A ring/magical|The Ring of {n}/When you wear it": "The Ring of {n}", "A carved bone/fragile/It hums|": "A carved bone", "|magical/When you": "Minor Arcanum", "|The Eye/of Storms/You have it": "The Eye of Storms",
    "Lost|12/front": "Lost", "|The Wind's Own Breath:/magical": "The Wind's Own",
})
golden("page_titles", lambda s: cards.page_title(F.split(s, "/"), F.lit(540)), {
    "Appendix/Staff of the/Glass Eye/When you hold it": "Staff of the Glass Eye", "front/magical/Dream stone/A leather": "Dream stone", "12/,": "Arcana (p. 540)", "bent lance": "Bent Lance",
    "Singing Jaw/of Brand/This thing": "Singing Jaw of Brand",
})
golden("tag_words", _python(unlock.tag_token, "boolean"), {"magical,": True, "+1": True, "piercing": True, "1d4": False, "{n}": False})
golden("unlock_lines", _python(lambda s: "intro" if unlock.unlock_intro(s) else "divider" if unlock.unlock_divider(s) else "item" if unlock.unlock_item(s) else "none", "string"), {
    "To unlock {n}, do this": "intro", "It is there, but a secret": "intro", "or…": "divider", "And then": "divider", "Either of these": "divider", "… a {n}": "item", "Spend a night in it": "item", "{n}": "none", "When you go": "none",
})
golden("names_and_tags", _python(lambda s: "|".join(unlock.name_tags_and_prose(s)), "string"), {
    "An old case, fragile": "An old case|fragile|", "magical, warm": "|magical, warm|", "A dormitory magical In a ruin of {n}": "A dormitory|magical|In a ruin of {n}", "A key to {n} it is": "A key to {n} it is||", "It is far. magical": "It is far. magical||",
})
golden("powers_and_tags", _python(lambda s: "|".join(unlock.power_and_tags(s)), "string"), {"The Lullaby magical, area, near": "The Lullaby|magical, area, near", ", warm": "|warm", "Ring of Ash": "Ring of Ash|", "Bolt 2 piercing": "Bolt|2, piercing"})
golden("power_titles", _python(lambda x: unlock.is_power_title(x, "The Miller's Lullaby"), "boolean"), {"Miller's Lullaby": True, "The Millers Lullaby magical, area": True, "A Lullaby": False, "{n}": False})
golden("power_places", _python(lambda s: unlock.power_index(s.split("/"), "Ash Ring"), "int"), {"A key/To unlock it, go/Ash Ring/When you go": 2, "x y z/The Ash/Ring/When you go": 1, "A key/Ash/When you go": 1, "A key/a long line of words that is no title of it/When you go": 2, "{n}": None})
golden("lone_bullets", _python(lambda s: "/".join(unlock.orphan_bullets(s.split("/"))), "string"), {
    "•/Consume {n}": "• Consume {n}", "•/HP 4": "HP 4", "a thing and/• {n}": "a thing and {n}", "• one (of/{n})": "• one (of {n})", "{n}/two": "{n}/two", "•": "",
})
golden("block_paragraphs", _python(lambda s: "|".join(unlock.paragraphs(s.replace("/", "\n"))), "string"), {
    "A line that/goes on./When you go, {n}": "A line that goes on.|When you go, {n}", "ASH RING When you go, {n}": "ASH RING|When you go, {n}", "front/12/Appendix A": "", "It ends./{n}": "It ends. {n}",
})
golden("match_key_lists", lambda s: F.array_join(T.match_keys(s), "|"), {
    "or the wolves": "wolves|or the wolves|wolf|or the wolf", "Bear": "bear|bears", "": "", "the old mill": "old mill|old mills|mill", "crag drake": "crag drake|crag drakes|crag|drake",
})


def _pairs(kind: str):
    return lambda s: W.join_decision(F.substring_index(s, "/", 1), F.substring_index(s, "/", -1))[kind]


#: One pair of lines for each rule of the join table: the rule that decides, and what it says.
JOINS = {
    "\x06hand, magical\x07/\x06close, warm\x07": ("item tags", True), "magical/In a ruin of {n}": ("item tags", False), "{n}/\x02HR": ("marked", False), "\x02H2 {n}/goes on": ("marked", False),
    "\x02B an item that/goes on with {n}": ("small beginning", True), "{n}/": ("nothing", False), "{n} and/Requires all of these": ("requirement", False), "• howl at the moon/Misshapen brutes of {n}": ("flavour after a bullet", False),
    "Instinct: to eat/Huge things": ("flavour after an instinct", False), "Olan, Rhys,/Tomas, Una": ("list of names", True), "see it (page/436), and {n}": ("page list goes on", True),
    "see it (pages 4/, 5) for {n}": ("page list goes on", True), "the river (page 4)/Spirits of the wild (page 5)": ("entries with pages", False), "{n}/Index": ("running head", False),
    "en route to/Harrow": ("dangling connector", True), "it is over there, where they/Short Title": ("heading or block", False), "it is there/3 {n}": ("heading or block", False),
    "it is there/When you strike at the thing that is there, now": ("mechanical opening", False), "it is there/For a place and a name, choose or have it rolled now:": ("introduction", False),
    "it is there/here is a long list of goods value": ("price header", False), "it came—/then it went": ("dash, hyphen or page", True), "a crys-/tal of {n}": ("dash, hyphen or page", True), "on the road (page 4)/it goes": ("dash, hyphen or page", True),
    "It ends./it begins": ("sentence end", False), "it (so)/goes on": ("closing bracket", True), "it (so)/Goes on from there to where it is and on, and then more": ("closing bracket", False),
    "{n}/goes on": ("small beginning", True), "it is, here,/Goes on from there to where it is and on and then more": ("small beginning", True),
    "there are so few/Guards who are stationed there at night, and {n}": ("continuing word", True), "they saw a thing that was the Karst/Peaks (page 236). The petals are edible.": ("split name", True),
    "Short Title/Goes on from there to where it is and on and then more": ("none", False),
}
golden("join_rules", _pairs("rule"), {k: rule for k, (rule, _) in JOINS.items()})
golden("join_verdicts", _pairs("joins"), {k: joins for k, (_, joins) in JOINS.items()})


def documents(name: str, templates: list[list[str]], run: Callable[[DataFrame], DataFrame], wanted: list[list[str]], title: str = "Town") -> None:
    """Registers an operator over small documents, one for each row of part; each gives the texts wanted, in order."""
    every = ", ".join("[" + ", ".join(map(_sql, w)) + "]" for w in wanted)

    def query(spark, sf_dir):
        part = table(spark, sf_dir, "part")
        held = F.get(F.array(*[F.array(*[F.lit(x) for x in t]) for t in templates]), (F.col("p_partkey") % len(templates)).cast("int"))
        rows = part.select(F.col("p_partkey").alias("slug"), "p_name", F.posexplode(held).alias("pos", "line"))
        return run(rows.select("slug", "pos", _filled(F.col("line")).alias("line"), F.lit(title).alias("title")))

    QUERIES[name] = query
    filled = "replace(replace(x, '{n}', p_name), '{U}', upper(p_name))"
    ORACLE_SQL[name] = f"WITH w AS (SELECT p_partkey, p_name, [{every}][p_partkey % {len(templates)} + 1] AS w FROM part), x AS (SELECT p_partkey, p_name, unnest(w) AS x, generate_subscripts(w, 1)::INT - 1 AS pos FROM w) SELECT p_partkey AS slug, pos, {filled} AS result FROM x"


def _told(blocks: DataFrame) -> DataFrame:
    """Blocks as short texts: depth, kind, name, text and items."""
    items = F.array_join(F.transform("items", lambda x: F.concat_ws("=", F.when(x["label"] != "", x["label"]), x["text"])), "; ")
    text = F.concat_ws("|", F.concat("kind", F.when(F.col("level") > 0, F.col("level").cast("string")).otherwise("")), F.when(F.col("parent").isNotNull(), F.concat(F.lit("in "), F.col("parent").cast("string"))), F.when(F.col("anchor") != "", F.concat(F.lit("#"), "anchor")), F.when(F.col("name") != "", F.col("name")), F.when(F.col("text") != "", F.col("text")), F.when(items != "", items))
    return blocks.select("slug", "pos", text.alias("result"))


documents("merged_lines", [["en route to", "Harrow's Delve", "a crys-", "tal {n}.", "Short Title", "• howl at the", "moon", "Misshapen brutes", "\x04bo-\x05", "\x04ld\x05 words"], ["{n}"], ["\x02H2 {n}", "goes on", "see (page", "4) for it—", "then"]],
    lambda df: W.merge_wrapped(df, "slug").withColumnRenamed("line", "result"),
    [["en route to Harrow's Delve a crystal {n}.", "Short Title", "• howl at the moon", "Misshapen brutes \x04bold\x05 words"], ["{n}"], ["\x02H2 {n}", "goes on see (page 4) for it—then"]])
PROSE = "The mill stands by the river and has done so for as long as anyone can tell."
documents("blocks_of_marked_lines", [
    ["\x02H2 Town", "\x02H2 Dangers:", "\x02HR", "\x02HR", "\x02ICON icons/beast.svg", "\x02H3 Crag Wolf", "Horde, small, stealthy", "HP 4; Armor 1", "Damage d6 (close,", "messy)", "Instinct: to hunt", "Howl at {n}",
     "\x02B run", "\x02C it is dead", "1d4 tasks", "1 eat", "2-4 sleep", "\x02HR", PROSE],
    ["\x02BOX", "\x02H4 Size", "{n}", "\x02ENDBOX", "\x02VT goods", "\x02VR {n}\x033", "\x02VF * old", "\x02VR Lamp\x03", "\x02VA and oil", "\x02TH {n}", "\x02B one", "\x02B2 two", "\x02Q why?", "\x02Q how?", "\x02E or not",
     "\x02C first", "\x02C second", "\x02ZZ odd words that are kept as they are, in a paragraph, {n}"],
    ["\x02H2 Moves", "ASK AROUND", "When you ask around,", "roll +CHA:", "\x02B on a 10+", "\x02B on a 7-9", "\x02H3 Iron Ring", "\x06hand, magical\x07", "A plain ring. It", "hums.", "Something useful: it is {n}", "\x02ICON icons/flora.svg",
     "\x02H3 Vines", "They grow.", "\x02B they grip", "\x02H3 Plain"],
    ["\x02TH steading improvement", "\x02C \x04{U}\x05 A sturdy thing", "Requires both:", "\x02C stone", "\x02C wood", "When you mark all the requirements, it holds.", "\x02H2 After"],
], lambda df: _told(parse.parse(df)), [
    ["heading2|#dangers|Dangers", "stat|#crag-wolf|Crag Wolf|icon=icons/beast.svg; tags=Horde, small, stealthy; stats=HP 4; Armor 1; stats=Damage d6 (close, messy); stats=Instinct: to hunt; moves=Howl at {n}; moves=run; checks=it is dead",
     "roll_table|in 1|tasks|1d4|1=eat; 2-4=sleep", "paragraph|" + PROSE],
    ["infobox", "heading4|in 0|Size", "paragraph|in 0|{n}", "price_table|Goods Value|row={n}\x033; note=* old; row=Lamp and oil\x03", "table_heading3|#{s}|{n}", "bullets|one; two", "questions|why?; how?", "ellipsis|or not", "checks|#{k}-1|first; second",
     "paragraph|odd words that are kept as they are, in a paragraph, {n}"],
    ["heading2|#moves|Moves", "move|#ask-around|ASK AROUND|When you ask around, roll +CHA:", "bullets|in 1|on a 10+; on a 7-9", "artifact|#iron-ring|Iron Ring|tags=hand, magical; A plain ring. It hums.; note=Something useful: it is {n}",
     "hazard|#vines|Vines|icon=icons/flora.svg; They grow.; bullet=they grip", "heading3|#plain|Plain"],
    ["improvement|#{s}|{U}|kind=Steading improvement; blurb=A sturdy thing; requires=Requires both:; check=stone; check=wood; benefit=When you mark all the requirements, it holds.", "heading2|#after|After"],
])
documents("blocks_of_plain_lines", [
    ["Terrain", "goods value", "{n} 2", "with a hook", "Axe 1", "4", "a thing of bronze", "weapons and armor value", "a bow", "1", "Themes", "1d6 omens", "1-3 a bird of", "ill will", "4 smoke", "1d6", "5-6 nothing"],
    ["STRONG WALLS", "Requires all of the following:", "stone", "Henceforth, walls hold.", "• one", "• two and", "a half", "1 first", "2 second and", "third.", PROSE],
    ["theme", "1d4", "1 war", "2 peace", "Crag Wolf, old", "Horde, small", "HP 4", "Bite", "steading improvement", "Always"],
], lambda df: _told(parse.parse(df, wrapped=False)), [
    ["heading2|#terrain|Terrain", "price_table|goods value|row={n} with a hook\x032; row=Axe\x031; row=a thing of bronze\x034", "price_table|weapons and armor value|row=a bow\x031", "heading2|#themes|Themes",
     "roll_table|#omens|omens|1d6|1-3=a bird of ill will; 4=smoke; 5-6=nothing"],
    ["improvement|#strong-walls|STRONG WALLS|requires=Requires all of the following:; check=stone; benefit=Henceforth, walls hold.", "list|one; two and a half", "numbered|1=first; 2=second and third.", "paragraph|" + PROSE],
    ["roll_table|#theme|theme|1d4|1=war; 2=peace", "stat|#crag-wolf|Crag Wolf|tags=old, Horde, small; stats=HP 4; notes=Bite; notes=steading improvement; notes=Always"],
])
for _name in ("blocks_of_marked_lines", "blocks_of_plain_lines"):
    ORACLE_SQL[_name] = ORACLE_SQL[_name].replace("replace(replace(x, '{n}', p_name), '{U}', upper(p_name))", "replace(replace(replace(replace(x, '{n}', p_name), '{U}', upper(p_name)), '{s}', replace(p_name, ' ', '-')), '{k}', p_partkey::VARCHAR)")
ORACLE_SQL["blocks_of_plain_lines"] = ORACLE_SQL["blocks_of_plain_lines"].replace("|goods value|", "|Goods Value|").replace("|weapons and armor value|", "|Weapons And Armor Value|")


def _card(kind: str):
    return lambda df: _told(cards.cards(df.withColumn("arcana_type", F.lit(kind))))


documents("minor_cards", [
    ["\x02H3 Runes around", "\x02H3 a ruined hall", "\x06magical, immobile\x07 They glow.", "You can learn from them, but you must:", "\x02C Spend a night in {n}", "Or:", "\x02C Read them", "aloud", "\x02H3 Town", "\x06magical\x07",
     "When you speak the runes, roll:", "\x02B on a 10+", "\x02B on a 7-9", "\x02MARK 3", "\x04{U}\x05 \x06(close)\x07 When you strike, it burns.", "front 12"],
], _card("minor"), [
    ["minor_card|#town|Town",
     "front|in 0|discovery=Runes around a ruined hall; tags=magical, immobile; prose=They glow.; unlock=You can learn from them, but you must:; check=Spend a night in {n}; requires=Or:; check=Read them aloud",
     "back|in 0|Town|tags=magical; move=When you speak the runes, roll:; pick=on a 10+; pick=on a 7-9; uses=3; name={U}; name-tags=close; move=When you strike, it burns."],
])
documents("major_cards", [
    ["\x02FACE front", "\x02H2 Town", "\x06magical\x07 A staff of {n}.", "\x02H2 Moves", "When you hold it, roll:", "\x02B on a 10+", "\x02MARK 5", "\x02FACE back", "\x02H2 Mysteries of Town", "\x04{U}\x05 When you break it, it ends.",
     "\x02H2 Consequences", "\x02C It is lost", "\x02C You are lost"],
], _card("major"), [
    ["major_card|#town|Town", "front|in 0|Town|tags=magical; prose=A staff of {n}.; move=When you hold it, roll:; pick=on a 10+; marks=5",
     "back|in 0|name={U}; move=When you break it, it ends.; consequence=It is lost; consequence=You are lost"],
])


def _span(x: float, y: float, text: str, font: str = "Body", size: float = 9.0, x1: float | None = None) -> tuple:
    return (float(x), float(y), float(x1 if x1 is not None else x + 4 * len(text)), text, font, float(size))


#: A page: running head, info box, headings by font, a table that the right column goes on with, bullets, an entry, a page number.
SPANS = (
    _span(30, 20, "The Town"), _span(30, 100, "Chapter", "Avara", 18), _span(30, 120, "Dangers", "Avara", 12), _span(40, 140, "Wolf", "Avara", 9.5), _span(40, 160, "plain words"), _span(88, 160, "joined", "Body-Bold"),
    _span(40, 172, "go on here."), _span(45, 200, "Brennan", "Body-Bold"), _span(73.5, 200, ", a bandit"), _span(45, 212, "leader"), _span(30, 240, "goods", "IMFellType", 12), _span(30, 255, "Rope"), _span(150, 255, "2"),
    _span(38, 267, "very long"), _span(30, 590, "12"), _span(220, 100, "Size", "Body-Bold"), _span(220, 112, "small village"), _span(220, 260, "Lamp"), _span(340, 260, "1"), _span(220, 274, "* if any"),
    _span(230, 300, "why not?"), _span(230, 312, "because"), _span(230, 340, "done"), _span(220, 370, "lll", "ITC Dingbats"), _span(220, 400, "1d6 omens", "IMFellType", 12), _span(220, 430, "Town Town square square"),
)
SHAPES = (("info_box", 210, 90, 380, 200), ("spiral", 215, 301, 221, 307), ("tail", 222, 301, 225, 306), ("checkbox", 215, 341, 221, 347), ("hrule", 220, 360, 380, 361), ("hrule", 30, 361, 180, 362))
LINES = [
    "\x02BOX", "\x02H4 Size", "small village", "\x02HR", "\x02ENDBOX", "\x02ICON icons/beast.svg", "\x02H2 Dangers", "\x02H3 Wolf", "plain words \x04joined\x05", "go on here.", "\x02B \x04Brennan\x05, a bandit leader", "\x02VT goods",
    "\x02VR Rope very long\x032", "\x02VR Lamp\x031", "\x02VF * if any", "\x02Q why not? because", "\x02C done", "\x02MARK 3", "1d6 omens",
]


def article_lines(spark, sf_dir):
    """One article of one page for each nation."""
    nation = table(spark, sf_dir, "nation")
    page = F.col("n_nationkey").cast("int").alias("page")
    spans = nation.select(page, F.posexplode(F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(s, ("x", "y", "x1", "text", "font", "size"), strict=True)]) for s in SPANS])).alias("ord", "s"))
    spans = spans.select("page", F.col("ord").cast("long").alias("ord"), "s.*")
    spans = spans.unionByName(spans.withColumn("ord", F.col("ord") + 100))  # all printed twice
    shapes = nation.select(page, F.posexplode(F.array(*[F.struct(F.lit(s[0]).alias("kind"), *[F.lit(float(v)).alias(n) for v, n in zip(s[1:], ("x0", "y0", "x1", "y1"), strict=True)]) for s in SHAPES])).alias("ord", "s"))
    shapes = shapes.select("page", F.col("ord").cast("long").alias("ord"), "s.*")
    icons = nation.select(page, F.lit(1).cast("long").alias("ord"), F.lit(20.0).alias("x0"), F.lit(140.0).alias("y0"), F.lit(34.0).alias("x1"), F.lit(154.0).alias("y1"), F.lit("icons/beast.svg").alias("name"))
    sheets = nation.select(page, F.col("n_name").alias("slug"), F.lit("The Town").alias("title"), F.lit(396.0).alias("width"), F.lit(612.0).alias("height"), F.lit(True).alias("first"))
    return pages.article_lines(pages.page_rows(sheets, spans, shapes, icons)).select("slug", "pos", "line")


QUERIES["article_lines"] = article_lines
ORACLE_SQL["article_lines"] = f"WITH w AS (SELECT n_name, [{', '.join(map(_sql, LINES))}] AS w FROM nation) SELECT n_name AS slug, generate_subscripts(w, 1)::INT - 1 AS pos, unnest(w) AS line FROM w"


golden("map_labels", lambda s: tables.map_label(F.col(s)), {
    "Map 1 - Green Vale - 11 x 14.jpg": "Map 1 — Green Vale", "Map 2 - {n} - A4.png": "Map 2 — {n}", "Map 3.jpg": "Map 3", "Map 4 - {n} - 8.5 x 11.jpeg": "Map 4 — {n}", "Map 5 - a-b.jpg": "Map 5 — a-b",
})
golden("maps_shown", lambda s: tables.is_shown_map(F.col(s)), {"Map 1 - {n} - 11 x 14.jpg": True, "Map 2 - {n} - A4.jpg": False, "Map 3 - The Vicinity - 11 x 14.jpg": False, "Map 4 - World - 11 X 14.png": False})
golden("glyph_kinds", lambda s: pages.glyph_kind(*[F.get(F.split(s, " "), F.lit(i)).cast("double") for i in range(3)], F.get(F.split(s, " "), F.lit(3)), F.get(F.split(s, " "), F.lit(4)) == "y"), {
    "5.4 5.7 16 c n": "spiral", "6 6 4 l n": "diamond", "6.6 6.6 1 qu n": "diamond", "7 7 1 re n": "diamond", "5 5 1 re n": None, "6 6 8 l n": "checkbox", "4 3 7 c n": "tail", "120 0.5 1 l n": "hrule",
    "30 0.5 1 l n": None, "150 100 4 re y": "info_box", "150 100 4 re n": None, "6 6 12 l n": None,
})
golden("icon_sizes", lambda s: pages.is_icon(*[F.get(F.split(s, " "), F.lit(i)).cast("double") for i in range(2)], F.get(F.split(s, " "), F.lit(2)).try_cast("int")), {"12 12 7": True, "9 12 7": False, "24 24 7": True, "12 25 7": False, "12 12 0": False, "12 12 x": False})


def labels_split(spark, sf_dir):
    """What of a label becomes the link."""
    texts = ["snow on the meadows of the {n}", "The {n}", "or the {n}", "maybe even a {n}", "{n}", "something else"]
    both = rewrite.split_label(F.col("line"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("The "), F.initcap("p_name"))).otherwise(F.lit("Other")))
    return _samples(spark, sf_dir, texts).select("p_partkey", both["prefix"].alias("prefix"), both["label"].alias("label"))


QUERIES["labels_split"] = labels_split
ORACLE_SQL["labels_split"] = """
SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'snow on the meadows of' WHEN 2 THEN 'or' WHEN 3 THEN 'maybe even a' ELSE '' END AS prefix,
  CASE p_partkey % 6 WHEN 0 THEN 'the ' || p_name WHEN 1 THEN 'The ' || p_name WHEN 2 THEN 'the ' || p_name WHEN 5 THEN 'something else' ELSE p_name END AS label
FROM part
"""
