"""Text with inline formatting, structural lines of cards and blocks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions import text as T

# Control characters that switch bold and italic on and off, and marker tags at the start of a line.
BOLD_ON, BOLD_OFF, ITALIC_ON, ITALIC_OFF = "\x04", "\x05", "\x06", "\x07"
MARKER = "^\\x02[A-Z0-9]+ ?"
REQUIREMENT = r"(?i)^(Requires?\s+(all\b|both\b|either\b|one\b|any\b|\d+\b|getting\b|the\s+following\b)|And then,?\s*(?:all |each )?of (?:the following|these)\b|And (?:either|one|any) of (?:the following|these)\b)"
REQUIREMENT_END = r"(?i)^(When you (?:mark|meet) all the requirements\b|Henceforth\b)"
SECTION_NAMES = ("terrain", "questions", "hooks", "places", "dangers", "discoveries", "impressions", "lore", "names", "people", "secrets", "size", "population", "prosperity", "defenses", "resources")


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def plain(s: Column | str) -> Column:
    return F.translate(_col(s), BOLD_ON + BOLD_OFF + ITALIC_ON + ITALIC_OFF, "")


def strip_marker(s: Column | str) -> Column:
    return plain(F.regexp_replace(_col(s), MARKER, ""))


def marker(s: Column | str) -> Column:
    """The tag at the start of a line, or null."""
    tag = F.regexp_extract(_col(s), "^\\x02([A-Z0-9]+)", 1)
    return F.when(tag != "", tag)


def to_html(s: Column | str) -> Column:
    """Formatting as tags; a run that a wrap has split is one run."""
    out = reduce(lambda c, p: F.replace(c, F.lit(p[0]), F.lit(p[1])), ((BOLD_ON, "<strong>"), (BOLD_OFF, "</strong>"), (ITALIC_ON, "<em>"), (ITALIC_OFF, "</em>")), _col(s))
    for off, on in (("</em></strong>", "<strong><em>"), ("</strong>", "<strong>"), ("</em>", "<em>")):
        out = F.regexp_replace(out, T.U + rf"\s*{off}\s+{on}\s*", " ")
    return out


def bold_prefix(s: Column | str) -> Column:
    """The bold run at the start of a line, or the empty string."""
    return plain(F.regexp_extract(_col(s), "^\\x04([^\\x04\\x05]*)\\x05", 1))


def runs(s: Column | str) -> Column:
    """Pieces of one style, as structs of text, bold and italic."""
    pieces = F.filter(F.regexp_extract_all(_col(s), F.lit("([\\x04-\\x07]?[^\\x04-\\x07]*)"), F.lit(1)), lambda x: x != "")
    start = F.struct(F.array().cast("array<struct<text:string,bold:boolean,italic:boolean>>").alias("out"), F.lit(False).alias("bold"), F.lit(False).alias("italic"))

    def step(acc: Column, x: Column) -> Column:
        c = F.substring(x, 1, 1)
        bold = F.when(c == BOLD_ON, True).when(c == BOLD_OFF, False).otherwise(acc["bold"])
        italic = F.when(c == ITALIC_ON, True).when(c == ITALIC_OFF, False).otherwise(acc["italic"])
        text = plain(x)
        out = F.when(text == "", acc["out"]).otherwise(F.concat(acc["out"], F.array(F.struct(text.alias("text"), bold.alias("bold"), italic.alias("italic")))))
        return F.struct(out.alias("out"), bold.alias("bold"), italic.alias("italic"))

    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def collapse_title(s: Column | str) -> Column:
    """Without the repeat of a phrase at the end; the shortest such phrase goes."""
    w = T.words(s)
    n = F.size(w)
    k = F.get(F.filter(F.when(n >= 2, F.sequence(F.lit(1), (n / 2).cast("int"))), lambda k: F.slice(w, n - k + 1, k) == F.slice(w, n - 2 * k + 1, k)), F.lit(0))
    return F.array_join(F.when(k.isNotNull(), F.slice(w, F.lit(1), n - k)).otherwise(w), " ")


def running_header(line: Column | str, title: Column | str, near_top: Column | bool = False) -> Column:
    """A page's running head: empty, doubled, or the article's title in some form."""
    t = T.strip(_col(line))
    w = F.transform(T.words(t), lambda x: F.lower(x))
    # Of few lines is the first word the second or the one halfway; the others are not looked at word by word.
    may = T.bound(T.words(t), lambda x: (F.size(x) % 2 == 0) & F.lower(F.get(x, F.lit(0))).isin(F.lower(F.get(x, F.lit(1))), F.lower(F.get(x, (F.size(x) / 2).cast("int")))))
    half = (F.size(w) / 2).cast("int")
    doubled = (F.size(w) >= 2) & (F.size(w) % 2 == 0) & (F.slice(w, F.lit(1), F.greatest(half, F.lit(1))) == F.slice(w, half + 1, F.greatest(half, F.lit(1))))
    squeeze = lambda c: F.regexp_replace(F.lower(c), "[^a-z0-9]+", "")
    at, lt, lc = squeeze(_col(title)), squeeze(t), squeeze(T.undouble(t))
    same = (at != "") & ((lt == at) | (lc == at) | (lt == F.concat(at, at)) | (lc == F.concat(at, at)))
    top = (F.lit(near_top) if isinstance(near_top, bool) else near_top) & (at != "") & (F.length(lc) >= 6)
    part = at.startswith(lc) | (lc.startswith(at) & (F.length(lc) <= F.length(at) + 6)) | at.endswith(lc)
    return (t == "") | (F.coalesce(may, F.lit(False)) & (T.pairwise_doubled(t) | doubled)) | same | (top & part) | F.lower(t).isin("contents", "index")


def requirement_header(s: Column | str) -> Column:
    return T.strip(_col(s)).rlike(T.U + REQUIREMENT)


def requirement_item(s: Column | str) -> Column:
    line = T.strip(strip_marker(s))
    other = line.rlike(T.U + REQUIREMENT) | line.rlike(T.U + REQUIREMENT_END) | F.lower(line).isin("steading improvement", *SECTION_NAMES) | line.rlike(T.U + rf"(?i)^{T.DICE}(\s+.+)?$") | line.rlike(T.U + T.HIT_POINTS)
    return (line != "") & ~other & ~T.tag_line(line) & ~(T.all_caps_label(line) & (F.size(T.words(line)) <= 4)) & (F.length(line) < 220)


def named_move(s: Column | str) -> Column:
    """struct(name, tags, trigger) of a line that begins with a bold name in capitals, or null."""
    name = T.strip(bold_prefix(s))
    rest = F.regexp_replace(_col(s), "^\\x04[^\\x04\\x05]*\\x05", "")
    italic = T.strip(plain(F.regexp_extract(rest, "^\\s*\\x06([^\\x06\\x07]*)\\x07\\s*", 1)))
    tagged = (italic != "") & (F.contains(italic, F.lit("(")) | T.pure_tags(italic))
    trigger = T.strip(F.when(tagged, F.regexp_replace(rest, "^\\s*\\x06[^\\x06\\x07]*\\x07\\s*", "")).otherwise(rest))
    tags = F.when(tagged, F.regexp_replace(italic, "^[ ()]+|[ ()]+$", "")).otherwise("")
    return F.when((name != "") & T.all_caps_label(name), F.struct(name.alias("name"), tags.alias("tags"), trigger.alias("trigger")))


def book_of(token: Column | str) -> Column:
    t = F.lower(T.strip(_col(token)))
    return F.when(t.isin("i", "1"), "book1").when(t.isin("ii", "2"), "book2")


def slug_of_path(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"([^/#]+)\.html", 1)


def dice_button(expression: Column | str) -> Column:
    """A button that rolls a (normalised) expression and shows it as written."""
    e = F.regexp_replace(F.regexp_replace(F.lower(_col(expression)), "[–—]", "-"), r"\s*([+\-])\s*", "$1")
    shown = T.html_escape(expression)
    return F.concat(F.lit('<button type="button" class="dice-roll" data-dice="'), T.html_escape(e), F.lit('" title="Click to roll '), shown, F.lit('">'), shown, F.lit("</button>"))


def benefit_continues(s: Column | str) -> Column:
    """Prose that goes on with what a met requirement brings."""
    line = T.strip(_col(s))
    other = (line == "") | line.rlike(T.U + REQUIREMENT) | T.all_caps_label(line) | (F.lower(line) == "steading improvement") | line.rlike(T.U + rf"(?i)^{T.DICE}(\s+.+)?$")
    opens = line.rlike(T.U + r"(?i)^(When you|Henceforth|Also,|\w+ gains\b|Every |The steading|You can |You may |This |These )")
    return ~other & (opens | ((F.length(line) > 50) & ~(T.heading(line) & (F.size(T.words(line)) <= 5))))


def requirement_end(s: Column | str) -> Column:
    return T.strip(_col(s)).rlike(T.U + REQUIREMENT_END)


def mark_track(s: Column | str) -> Column:
    """How many marks a row of signs has, if it has two to twelve and nothing else."""
    line = T.strip(_col(s))
    n = F.regexp_count(line, F.lit("[lLoO□☐○●•·]"))
    return F.when(line.rlike(T.U + r"^[lLoO□☐○●•·\s]{2,}$") & n.between(2, 12), n).otherwise(0)


def page_furniture(s: Column | str, y: Column, page_height: Column) -> Column:
    """A page number at the foot of a page."""
    return _col(s).rlike(T.U + r"^\d{1,3}$") & (y > page_height - 40)


def split_bold(s: Column | str) -> Column:
    """struct(prefix, text): the bold beginning of a line, and the line with that beginning in plain letters."""
    prefix = bold_prefix(s)
    rest = F.regexp_replace(_col(s), "^\\x04[^\\x04\\x05]*\\x05", "")
    return F.struct(prefix.alias("prefix"), F.concat(prefix, rest).alias("text"))


def roll_text(expression: Column, parts: Column, mod: Column, total: Column) -> Column:
    """What a roll shows: the expression, its parts if there are several or something is added, and the total."""
    sign = F.when(mod > 0, F.concat(F.lit(" + "), mod.cast("string"))).when(mod < 0, F.concat(F.lit(" − "), F.abs(mod).cast("string"))).otherwise(F.lit(""))
    detail = F.when((F.size(parts) > 1) | (mod != 0), F.concat(F.lit(" ("), F.array_join(parts.cast("array<string>"), " + "), sign, F.lit(")"))).otherwise(F.lit(""))
    return F.concat(expression, detail, F.lit(" → "), total.cast("string"))
