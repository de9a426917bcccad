"""Cards of arcana: their titles, faces, unlocking steps, moves and consequences, and the articles that a hub expands to."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S
from pyspark.sql.window import Window

from loomwright.functions import rich as R
from loomwright.functions import rules as L
from loomwright.functions import text as T
from loomwright.operators import blocks as K
from loomwright.operators import parse as P
from loomwright.operators import wrap as W

# What never is a title, what ends one, and where the halves of a page part.
TITLE_TAGS = r"^(,?\s*)?(magical|fragile|immobile|terrifying|crude|slow|beautiful|warm|close|reach|awkward|indestructible|large|cumbersome)\b"
NO_TITLE = r"^(starts at|souls\b|lost memories|daylight|vitality|hold\b|max\b|uses\b|pouch of|when |if you|you can|your |mark |spend |roll |on a |the spell|alas,)"
TITLE_ENDS = (
    r"\s+(Heat|Strain|Disturbance|Breath|Preparation|Charges?|Ken|Sway|Authority|Loyalty|Charge|Ire|Readiness|Vitality|Daylight|Souls)\s*:?\s*$", r"\s+You have\b.*$", r"\s+As long as\b.*$",
    r"\s*,\s*(?:far|close|near|hand|reach|magical|forceful|loud|reload|ignores|warm|fragile|crude).*$", r"\s+raspy voice\b.*$",
)
PAGE_SKIP = r"^(appendix|index|front|back|\d+$|,|magical|fragile|immobile|terrifying|crude|slow|beautiful|warm|close|reach|awkward|indestructible|implanted|large)\b"
PAGE_TAGS = r"^[\s,_]*(?:magical|fragile|immobile|terrifying|crude|slow|beautiful|warm|close|reach|awkward|indestructible|implanted|large|armor|damage)[\s,_\d+]*$"
BODY_STARTS = ("when ", "a leather", "this ", "about ", "at the ")
TAG_WORD = (
    r"^(magical|fragile|immobile|beautiful|terrifying|close|reach|near|far|hand|worn|warm|crude|slow|applied|thrown|messy|forceful|area|dangerous|loud|ap|reload|cumbersome|"
    r"awkward|indestructible|implanted|large|two-handed)\b[\s,]*"
)
TAG_MEASURE = r"^\+?\d+\s*(?:damage|piercing|armor|uses)\b[\s,]*"
LABELS = ("front", "back")
SPLIT_BAND, HEAD, FOOT = (270.0, 340.0), 45.0, 25.0
NO_NAME = "Minor Arcanum"


def strip_running(s: Column | str) -> Column:
    """A card's line without the words front and back and their page numbers."""
    line = R.strip_marker(s)
    for name in LABELS:
        line = F.regexp_replace(line, rf"(?i)\b{name}\s*\d*\b", "")
    return F.trim(F.regexp_replace(line, r"\s+", " "))


def tags_and_prose(text: str) -> tuple[str, str]:
    """The tags that a line begins with (italic words, measures, known words), and the prose after them with its switches."""
    rest, tags = re.sub(r"^[◇\s,]+", "", text), []
    while rest:
        italic = re.match(f"{R.ITALIC_ON}([^{R.ITALIC_ON}{R.ITALIC_OFF}]*){R.ITALIC_OFF}[\\s,]*", rest)
        measure, word = re.match(TAG_MEASURE, rest), L.matches(TAG_WORD, rest)
        m = italic or measure or word
        if not m:
            break
        tags.append(L.plain(m[1]).strip(" ,") if italic else m[0].strip(" ,") if measure else m[1])
        rest = rest[m.end() :]
    return ", ".join(x for x in tags if x), rest.strip()


def tags_and_description(text: str) -> tuple[str, str]:
    """Leading italic words that are tags and nothing else, and the description."""
    rest = re.sub(r"^[◇\s]+", "", text)
    m = re.match(f"{R.ITALIC_ON}([^{R.ITALIC_ON}{R.ITALIC_OFF}]*){R.ITALIC_OFF}\\s*", rest)
    if m and L.pure_tags(L.plain(m[1])):
        return L.plain(m[1]).strip(" ,"), rest[m.end() :].strip()
    return "", rest.strip()


def named_move(text: str) -> tuple[str, str, str] | None:
    """(name, tags, trigger) of a line that begins with a bold name in capitals."""
    m = re.match(f"{R.BOLD_ON}([^{R.BOLD_ON}{R.BOLD_OFF}]*){R.BOLD_OFF}", text)
    name = L.plain(m[1]).strip() if m else ""
    if not name or not L.caps_label(name):
        return None
    rest, tags = text[m.end() :], ""
    t = re.match(f"\\s*{R.ITALIC_ON}([^{R.ITALIC_ON}{R.ITALIC_OFF}]*){R.ITALIC_OFF}\\s*", rest)
    if t and ("(" in (said := L.plain(t[1]).strip()) or L.pure_tags(said)):
        tags, rest = said.strip(" ()"), rest[t.end() :]
    return name, tags, rest.strip()


def collapsed(s: str) -> str:
    """A title without the repeat of its last words."""
    w = s.split()
    for k in range(1, len(w) // 2 + 1):
        if w[-k:] == w[-2 * k : -k]:
            return " ".join(w[:-k])
    return " ".join(w)


def _is(s: Column, pattern: str) -> Column:
    return s.rlike("(?iU)" + pattern)


def _grown(parts: Column, goes_on, least: int) -> Column:
    """The first parts as one text: as many as it takes to have `least` letters and an end, three at most.

    parts: an array of structs with `line`; goes_on(part, text so far) tells that the next part belongs to it.
    """
    said = [F.array_join(F.transform(F.slice(parts, 1, k), lambda x: x["line"]), " ") for k in (1, 2, 3)]
    ended = [(F.length(text) >= least) & ~goes_on(F.get(parts, F.lit(k)), text) for k, text in enumerate(said[:2])]
    return F.when(F.size(parts) == 0, F.lit("")).when(ended[0], said[0]).when(ended[1], said[1]).otherwise(said[2])


def _stretch(lines: Column, part, stop) -> Column:
    """Places of the parts from the first one up to the next line that stops."""
    at = F.when(F.size(lines) > 0, F.sequence(F.lit(0), F.size(lines) - 1)).otherwise(F.array().cast("array<int>"))
    first = F.array_min(F.filter(at, lambda i: part(F.get(lines, i))))
    last = F.coalesce(F.array_min(F.filter(at, lambda i: (i > first) & stop(F.get(lines, i)))), F.size(lines))
    return F.filter(at, lambda i: (i >= first) & (i < last) & part(F.get(lines, i)))


def _bare_end(line: Column) -> Column:
    return T.strip(F.regexp_replace(line, ",+$", ""))


def side_title(side: Column) -> Column:
    """The title at the head of a card's side: up to three of its first five lines, tags and rules text left out, or nothing."""
    stop = lambda x: (x == "") | _is(x, TITLE_TAGS) | _is(x, NO_TITLE)
    label = lambda x: F.lower(x).isin(*LABELS) | _is(x, r"^\d+$")
    places = _stretch(F.slice(side, 1, 5), lambda x: ~stop(x) & ~label(x), stop)

    def of(i: Column) -> Column:
        line, after = F.get(side, i), F.coalesce(F.get(side, i + 1), F.lit(""))
        follows = after.rlike(r"^\p{javaUpperCase}") & ~_is(after, NO_TITLE) & ~_is(after, TITLE_TAGS) & ~_is(after, "^when ")
        return F.struct(_bare_end(line).alias("line"), (line.rlike("(?:[,-]|['’]s)$") | (F.size(T.words(line)) <= 2)).alias("open"), follows.alias("follows"))

    title = T.bound(F.transform(places, of), lambda parts: _grown(parts, lambda x, said: x["open"] | ((F.length(said) < 28) & x["follows"]), 6))
    title = F.btrim(T.undouble(title), F.lit(" ,"))
    for end in TITLE_ENDS:
        title = F.regexp_replace(title, "(?iU)" + end, "")
    title = F.btrim(title, F.lit(" ,:;"))
    return F.when((F.length(title) < 3) | _is(title, NO_TITLE), F.lit("")).otherwise(title)


def card_title(left: Column, right: Column) -> Column:
    """The power on the back, else the discovery on the front."""
    told = [F.when(t != "", t) for t in (side_title(right), side_title(left))]
    return F.coalesce(*told, F.lit(NO_NAME))


def _title_case(s: Column) -> Column:
    words = F.regexp_extract_all(s, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.lower(F.substring(w, 2, 1 << 30)))), "")


def page_title(lines: Column, page: Column) -> Column:
    """A major card's title from its page's first lines: four candidates, three of them at most."""
    clean = F.transform(lines, lambda x: F.regexp_replace(T.undouble(T.strip(x)), r"(?U)\s+", " "))
    clean = F.filter(clean, lambda x: (x != "") & ~F.contains(F.lower(x), F.lit("appendix")))
    stop = lambda x: _is(x, PAGE_SKIP) | _is(x, PAGE_TAGS)
    candidates = lambda kept: F.transform(F.slice(_stretch(kept, lambda x: ~stop(x), stop), 1, 4), lambda i: _bare_end(F.get(kept, i)))

    def parts_of(found: Column) -> Column:
        def of(line: Column, i: Column) -> Column:
            after = F.coalesce(F.get(found, i + 1), F.lit(""))
            body = _is(after, "^(?:when|when you)$") | _is(after, "^(?:" + "|".join(BODY_STARTS) + ")")
            goes_on = ~body & (line.rlike("[,-]$") | ((after != "") & (after.rlike(r"^\p{javaLowerCase}") | (F.size(T.words(after)) <= 2))))
            return F.struct(line.alias("line"), goes_on.alias("goes_on"))

        return F.transform(found, of)

    parts = T.bound(T.bound(clean, candidates), parts_of)
    title = T.bound(parts, lambda p: T.undouble(F.btrim(_grown(p, lambda x, said: x["goes_on"], 8), F.lit(" ,"))))

    def told(t: Column) -> Column:
        return F.when(t == "", F.concat(F.lit("Arcana (p. "), page, F.lit(")"))).when(t == F.lower(t), _title_case(t)).otherwise(t)

    return T.bound(title, told)


def middle_of(words: DataFrame, pages: DataFrame) -> DataFrame:
    """(page, middle): where the upper card ends, above the first label front or back in the middle band, else half the height."""
    w = words.where(F.lower("text").isin(*LABELS) & (F.col("y") > SPLIT_BAND[0]) & (F.col("y") < SPLIT_BAND[1])).groupBy("page").agg(F.min_by("y", "ord").alias("at"))
    return pages.join(w, "page", "left").select("page", F.coalesce(F.col("at") - 2, F.col("height") * 0.5).alias("middle"))


def halves(pages: DataFrame, middles: DataFrame) -> DataFrame:
    """Each page as two cards, with the band (top, bottom) of each; pages: (page, height, ..)."""
    both = pages.join(middles, "page").withColumn("half", F.explode(F.array(F.lit("top"), F.lit("bottom"))))
    upper = F.col("half") == "top"
    return both.withColumn("top", F.when(upper, F.lit(HEAD)).otherwise(F.col("middle"))).withColumn("bottom", F.when(upper, F.col("middle")).otherwise(F.col("height") - FOOT)).drop("middle")


def side_lines(words: DataFrame, cards: DataFrame) -> DataFrame:
    """(card, side, lines): the lines of each card's left and right side. words: (page, ord, x0, y0, x1, y1, text), cards: (card, page, width, top, bottom).

    Words belong where their centre lies, lines are words of one half point of height; labels, page numbers and appendix heads go.
    """
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    w = words.join(cards, "page").where((cy >= F.col("top")) & (cy < F.col("bottom")) & (cx >= 0) & (cx < F.col("width")))
    w = w.withColumn("side", F.when(cx < F.col("width") * 0.5, "left").otherwise("right"))
    line = T.undouble(T.normalize_text(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("x0", "ord", "text"))), lambda x: x["text"]), " ")))
    lines = w.groupBy("card", "side", (F.bround(F.col("y0") * 2) / 2).alias("y")).agg(line.alias("line"))
    good = lines.where((F.col("line") != "") & ~F.lower("line").isin(*LABELS) & ~F.col("line").rlike(r"^\d{1,3}$") & ~F.lower("line").contains("appendix"))
    return good.groupBy("card", "side").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "line"))), lambda x: x["line"]).alias("lines"))


@F.pandas_udf(S.StringType())
def title_of_sides(left, right):
    none = lambda x: [] if x is None else list(x)
    import pandas as pd

    return pd.Series([card_title(none(a), none(b)) for a, b in zip(left, right, strict=True)])


@F.pandas_udf(S.StringType())
def title_of_page(lines, page):
    import pandas as pd

    return pd.Series([page_title([] if x is None else list(x), int(p)) for x, p in zip(lines, page, strict=True)])


def child_slugs(children: DataFrame, hub: str = "hub", order: str = "child_ord", prefix: str = "prefix", title: str = "title") -> DataFrame:
    """Adds `slug`: the prefix and the title's slug, with -2, -3 .. for later children of a hub, past names that have such an end."""
    from loomwright.operators import model

    named = children.withColumn("name_", F.concat_ws("-", prefix, T.slug(title)))
    return model.unique_anchors(named, hub, order, "name_").withColumnRenamed("id", "slug").drop("name_")


def with_page_fallback(cards: DataFrame) -> DataFrame:
    """Cards without a title of their own are named by page and half."""
    none = F.coalesce(F.col("title"), F.lit("")).isin("", NO_NAME)
    return cards.withColumn("title", F.when(none, F.format_string(NO_NAME + " (p. %d %s)", F.col("page").cast("int"), "half")).otherwise(F.col("title")))


class Face:
    """One face of a card: a cursor over its lines that puts a card's pieces into items."""

    STARTS = r"^(When you|When |During this battle|If )\b"

    def __init__(self, lines: list[str], power: str, anchors: P.Anchors):
        self.lines, self.power, self.anchors = lines, L.section_key(power), anchors
        self.at = 0
        self.items: list[tuple[str, str, int]] = []

    def said(self, k: int = 0) -> str:
        j = self.at + k
        return L.bare(self.lines[j]).strip() if j < len(self.lines) else ""

    @property
    def more(self) -> bool:
        return self.at < len(self.lines)

    @property
    def raw(self) -> str:
        return self.lines[self.at]

    @property
    def kind(self) -> str:
        return L.marker(self.raw)

    @property
    def furniture(self) -> bool:
        return not self.said() or self.kind == "TH" or self.said().lower() in LABELS

    def is_power(self) -> bool:
        return self.kind in ("H2", "H3") and L.section_key(collapsed(self.said())) == self.power

    def add(self, kind: str, text: str, level: int = 0) -> None:
        self.items.append((kind, text, level))

    def move(self, trigger: str, starts: str, ends) -> None:
        """A trigger with the lines that go on with it, and its options, up to the next move, heading or row of marks."""
        body, picks = [trigger], []
        while self.more and not ends(self) and self.kind not in ("H2", "H3", "H4", "FACE", "TH", "MARK"):
            said, listed = self.said(), self.kind in ("B", "B2")
            if said and said.lower() not in LABELS:
                if L.matches(starts, said) and not listed:
                    break
                (picks if listed or picks else body).append(L.content(self.raw))
            self.at += 1
        self.add("move", " ".join(body))
        for x in picks:
            self.add("pick", x, 1)

    def name(self, found: tuple[str, str, str]) -> None:
        name, tags, _ = found
        self.anchors.add(name.title() if name.isupper() else name)
        self.add("name", name)
        if tags:
            self.add("name-tags", tags)


def minor_card(lines: list[str], title: str) -> P.Block:
    """A minor card: the discovery in front with what unlocks it, the power behind."""
    power = title.strip() or NO_NAME
    anchors = P.Anchors()
    lines = [x for x in lines if x.startswith("\x02") or re.sub(r"\s+", " ", re.sub(r"(?i)\b(front|back)\s*\d*\b", "", L.bare(x))).strip()]
    heads = [i for i, x in enumerate(lines) if L.marker(x) == "H3"]
    named = [i for i in heads if i and L.section_key(collapsed(L.bare(lines[i]))) == L.section_key(power)]
    cut = named[0] if named else heads[1] if len(heads) > 1 else len(lines)
    front = Face(lines[:cut], power, anchors)
    while front.more and front.kind != "H3":
        front.at += 1
    name = []
    while front.more and front.kind == "H3":
        name.append(front.said())
        front.at += 1
    name_ = collapsed(" ".join(name))
    if name_:
        anchors.add(name_)
        front.add("discovery", name_)
    prose: list[str] = []
    steps: list[tuple[str, str]] = []
    tags = ""
    group = ""
    while front.more:
        said, content = front.said(), L.content(front.raw)
        if not said or front.kind == "TH":
            pass
        elif front.kind in ("C", "E"):
            steps.append((group, re.sub(r"^[\s….]+", "", content)))
            group = ""
        elif steps and len(said) <= 24 and L.matches(r"^(or|and(?: then)?|either)\b", said):
            group = said.rstrip(":.") + ":"
        elif steps:
            steps[-1] = steps[-1][0], f"{steps[-1][1]} {content}"
        elif not prose and not tags:
            tags, rest = tags_and_prose(content)
            prose += [rest] if rest else []
        else:
            prose.append(content)
        front.at += 1
    intro = ""
    if steps and prose:
        last = L.plain(prose[-1])
        if L.matches(r"(you (?:can|either|must|need)|following|:|…|\.\.\.)\s*$", last) or "you " in last.lower():
            intro = prose.pop()
    if tags:
        front.add("tags", tags)
    for x in prose:
        front.add("prose", x)
    if intro:
        front.add("unlock", intro)
    for header, step in steps:
        if header:
            front.add("requires", header)
        front.add("check", step, 1)

    back = Face(lines[cut:], power, anchors)
    while back.more and (back.is_power() or back.furniture):
        found = back.is_power()
        back.at += 1
        if found:
            break
    first = True
    while back.more:
        said, content = back.said(), L.content(back.raw)
        found = named_move(content)
        if back.furniture:
            back.at += 1
        elif back.kind == "MARK":
            back.add("uses", said or "0")
            back.at += 1
        elif "◇" in said and re.match(r"[A-Za-z][\w\s]{0,18}:\s*◇", said):
            back.add("track", content)
            back.at += 1
        elif found and not found[0].lower().startswith("when"):
            back.name(found)
            back.at += 1
            if found[2]:
                back.move(found[2], Face.STARTS, lambda f: False)
        elif L.matches(Face.STARTS, said):
            back.at += 1
            back.move(content, Face.STARTS, lambda f: False)
        else:
            tagged, rest = tags_and_prose(content) if first else ("", content)
            first = False
            back.add("tags" if tagged and not rest else "prose", tagged if tagged and not rest else content)
            back.at += 1
    faces = [P.Block("front", items=front.items)] + ([P.Block("back", name=power, items=back.items)] if back.items else [])
    return P.Block("minor_card", name=power, anchor=anchors.add(power), inner=faces)


def major_card(lines: list[str], title: str) -> P.Block:
    """A major card: both faces with their moves and marks, consequences at the end."""
    power = title.strip() or "Major Arcanum"
    anchors = P.Anchors()
    held: dict[str, list[str]] = {"front": [], "back": []}
    side = "front"
    for x in lines:
        if L.marker(x) == "FACE":
            side = L.content(x).strip() or side
            held.setdefault(side, [])
        else:
            held[side].append(x)
    starts = r"^(When you|During this battle)\b"
    faces: list[P.Block] = []
    for side in ("front", "back"):
        face = Face(held[side], power, anchors)
        described, consequences = side == "back", False
        ends: list[str] = []
        while face.more:
            said, content = face.said(), L.content(face.raw)
            found = named_move(content)
            if face.furniture or face.is_power() or face.kind == "H2" and said.lower() == "moves" or face.kind in ("H2", "H3") and L.matches(r"^Mysteries of\b", said):
                face.at += 1
            elif face.kind == "H2" and L.matches(r"^Consequences\b", said):
                consequences = True
                face.at += 1
            elif consequences:
                ends += [content] if face.kind == "C" else []
                face.at += 1
            elif face.kind == "MARK":
                face.add("marks", said or "0")
                face.at += 1
            elif found:
                face.name(found)
                face.at += 1
                if found[2] and L.matches(r"^(When you|During)\b", L.plain(found[2])):
                    face.move(found[2], starts, lambda f: f.kind == "C" or named_move(L.content(f.raw)) is not None)
                elif found[2]:
                    face.add("prose", found[2])
            elif L.matches(starts, said):
                face.at += 1
                face.move(content, starts, lambda f: f.kind == "C" or named_move(L.content(f.raw)) is not None)
            elif not described:
                tags, rest = tags_and_description(content)
                described = True
                if tags:
                    face.add("tags", tags)
                if rest:
                    face.add("prose", rest)
                face.at += 1
            else:
                face.add("prose", content)
                face.at += 1
        for x in ends:
            face.add("consequence", x, 1)
        if side == "front" or face.items:
            faces.append(P.Block(side, name=power if side == "front" else "", items=face.items))
    return P.Block("major_card", name=power, anchor=anchors.add(power), inner=faces)


def cards(lines: DataFrame, key: str = "slug") -> DataFrame:
    """(key, pos, parent, kind, ..): the pieces of each card; lines: (key, pos, line, title, arcana_type), a card's lines at a time."""

    def end(state: dict) -> list[dict]:
        held = W.merged(state["lines"])
        if state["kind"] == "minor":
            cut = [re.sub(r"(?i)\s*\b(front|back)\b\s*\d*\s*$", "", re.sub(r"(?i)\s*\bfront\b\s*\d*\s*\bback\b\s*$", "", x)) for x in held]
            block = minor_card([x for x in cut if L.bare(x).strip()], state["title"])
        else:
            block = major_card(held, state["title"])
        return [{key: state["key"], **row} for row in P.flat([block])]

    def step(state: dict, row: dict) -> list[dict]:
        state["lines"].append(row["line"] or "")
        return []

    kind = lines.schema[key].dataType.simpleString()
    return W.fold(lines, key, lambda row: {"key": row[key], "title": row["title"] or "", "kind": row["arcana_type"], "lines": []}, step, end, f"{key} {kind}, {P.BLOCK}")


def card_excerpt(lines: DataFrame, key: str = "slug") -> DataFrame:
    """(key, excerpt): a card's first unmarked line of fifty characters that is no trigger, else its first line; cut at 320."""
    clean = F.trim(R.plain("line"))
    wanted = ~F.col("line").startswith("\x02") & (F.length(clean) >= 50) & ~F.lower(clean).startswith("when you")
    best = K.first_line(lines.withColumn("line", F.when(F.col("line").startswith("\x02"), F.col("line")).otherwise(clean)), key, wanted)
    first = lines.groupBy(key).agg(F.min_by("line", "pos").alias("first_line"))
    return first.join(best, key).select(key, T.excerpt(F.coalesce("line", R.strip_marker("first_line"))).alias("excerpt"))


def faces_of(pages: DataFrame) -> DataFrame:
    """Adds `face` to a major card's pages: the first is the front, the others are the back; pages: (card, page)."""
    first = F.min("page").over(Window.partitionBy("card"))
    return pages.withColumn("face", F.when(F.col("page") == first, "front").otherwise("back"))
