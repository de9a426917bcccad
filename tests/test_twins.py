"""The rules over columns beside the same rules over plain values, on lines with signs, digits and spaces of all kinds."""

import random

import pytest
from pyspark.sql import functions as F

from loomwright.functions import rich as R
from loomwright.functions import rules as L
from loomwright.functions import text as T
from loomwright.operators import wrap

WORDS = [
    "The", "the", "a", "An", "stealthy", "horde,", "magical", "close,", "HP", "hp4", "4", "٣", "12-14", "1d6", "d٨", "d8", "Value", "value", "goods", "free", "+2", "(page", "pages", "12)", "(see", "3,", "Requires", "all", "And", "then", "Henceforth",
    "When", "you", "contents", "CAPS", "ÉTÉ", "été", "•", "◇", "–", "x", "x", "y.", "z;", "w:", "“q”", "This", "chapter", "plan", "up", "steading", "improvement", "terrain", "Also,", "gains", "weight", "3", "damage", "l", "o", "○",
]
SPACES = [" ", " ", " ", " ", " ", "\u00a0", "\u2003", "  ", "\t"]


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(12)
    return ["".join(rng.choice(["", "", "", " ", "\u00a0"]) + rng.choice(WORDS) + rng.choice(SPACES) for _ in range(rng.choice((1, 1, 2, 3, 4, 6, 12)))).removesuffix(" ") for _ in range(6000)] + ["", " ", "\u00a0"]


TWINS = {
    "heading": (T.heading, L.heading), "pure_tags": (T.pure_tags, L.pure_tags), "item_tags": (wrap.item_tags, L.item_tags), "tag_line": (T.tag_line, L.tag_line), "roll_header": (T.roll_header, L.roll_header),
    "value_header": (T.value_header, L.value_header), "caps": (T.all_caps_label, L.caps_label), "section_key": (T.section_key, L.section_key), "requirement_header": (R.requirement_header, L.require_header),
    "requirement_end": (R.requirement_end, L.require_end), "requirement_item": (R.requirement_item, L.require_item), "benefit_continues": (R.benefit_continues, L.benefit_continues), "mark_track": (R.mark_track, L.mark_track),
    "slug": (T.slug, L.slug), "running_header": (lambda c: R.running_header(c, F.lit("The Mill")), lambda s: L.running_header(s, "The Mill")), "undouble": (T.undouble, L.undouble), "doubled": (T.pairwise_doubled, L.doubled),
    "value_row": (T.value_row, L.value_row),
}


def test_no_line_is_judged_differently(spark, lines):
    df = spark.createDataFrame([(x,) for x in lines], "line string").select("line", *[f(F.col("line")).alias(k) for k, (f, _) in TWINS.items()])
    wrong: dict[str, list] = {}
    for r in df.collect():
        for k, (_, plain) in TWINS.items():
            want = plain(r.line)
            if (tuple(r[k]) if k == "value_row" and r[k] else r[k]) != want:
                wrong.setdefault(k, []).append((r.line, r[k], want))
    assert not wrong, {k: (len(v), v[:3]) for k, v in wrong.items()}


def test_a_name_after_a_no_break_space_loses_its_article(spark):
    row = spark.createDataFrame([("\u00a0The Stealthy HP 4\u2003",)], "s string").select(T.section_key("s").alias("k")).first()
    assert row.k == "stealthy hp 4"
