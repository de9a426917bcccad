"""From positioned text, drawn shapes and icons of a page to marked lines in reading order.

A page is one row with arrays of its spans, shapes and icons; an article's pages are folded in order, since a price table or a
sentence may go on in the next column or page. What is found on a page: info box, columns, visual lines with their bullets,
diamonds and icons, rules, headings by font, tables by the place of their values.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.functions import rich as R
from loomwright.functions import rules as L
from loomwright.functions import text as T
from loomwright.operators import wrap as W

# Distances in points, and the names of an info box's first rows.
GUTTER, NARROW, WIDE = 198.0, 350.0, 450.0
SAME_LINE, WORD_GAP, RULES_APART = 4.5, 1.0, 5.0
BOX_ROWS = ("Size", "Population", "Prosperity")
BANDS = {"checkbox": 5.5, "spiral": 6.0, "diamond": 4.0}
BULLET_REACH, ICON_BAND, ICON_LEFT, ICON_RIGHT, TAIL_REACH = 25.0, 11.0, 42.0, 6.0, 5.0
VALUE_FROM, INDENT, ENTRY_INDENT, ENTRY_GAP, NO_GAP, WRAP_GAP, FOOT, HEAD = 100.0, 7.0, (12.0, 30.0), 15.0, 900.0, 13.5, 40.0, 100.0
VALUE_TOKEN = r"^(\+?\d{1,2}|free)$"

PAGE = (
    "slug string, pos int, title string, width double, height double, first boolean, top double, bottom double, single boolean, "
    "spans array<struct<ord:bigint,x:double,y:double,x1:double,text:string,font:string,size:double>>, "
    "shapes array<struct<ord:bigint,kind:string,x0:double,y0:double,x1:double,y1:double>>, icons array<struct<ord:bigint,x0:double,y0:double,x1:double,y1:double,name:string>>"
)


def gutter(width: Column, single: Column | bool = False) -> Column:
    """Where the second column begins: half the width, a fixed place on pages of the usual width, nowhere on cards of one column."""
    alone = F.lit(single) if isinstance(single, bool) else single
    return F.when(alone, width + 1).when((width > NARROW) & (width < WIDE), F.lit(GUTTER)).otherwise(width * 0.5)


def glyph_kind(width: Column, height: Column, n_items: Column, first_op: Column, first_page: Column | bool = False) -> Column:
    """What a drawn shape is, by its size and the number of its path items."""
    small = width.between(4, 8) & height.between(4, 8)
    square = (n_items == 1) & (F.abs(width - height) <= 1) & ((first_op == "qu") | width.between(5.5, 7.5))
    opening = F.lit(first_page) if isinstance(first_page, bool) else first_page
    return (
        F.when(small, F.when(n_items >= 15, "spiral").when((n_items == 4) | square, "diamond").when(n_items.between(7, 10), "checkbox"))
        .when((width <= 4.5) & (height <= 6.5) & n_items.between(5, 9), "tail")
        .when((width >= 40) & (height <= 1.5) & (n_items <= 3), "hrule")
        .when(opening & width.between(110, 320) & (height >= 90), "info_box")
    )


def is_icon(width: Column, height: Column, xref: Column) -> Column:
    return width.between(10, 24) & height.between(10, 24) & F.coalesce(xref != 0, F.lit(False))


def icon_name(xrefs: DataFrame, names: DataFrame) -> DataFrame:
    """The picture of each icon reference, a default one for those that the table (xref, name) has not."""
    return xrefs.join(names, "xref", "left").withColumn("path", F.concat(F.lit("icons/"), F.coalesce("name", F.lit("default")), F.lit(".svg"))).drop("name")


def page_rows(pages: DataFrame, spans: DataFrame, shapes: DataFrame, icons: DataFrame) -> DataFrame:
    """The rows that article_lines() takes. pages: (slug, page, title, width, height, first), spans and shapes: by page, icons: by page
    with their picture's path as name. Spans printed twice at a place and shapes drawn twice count once, the first."""

    def once(df: DataFrame, same: list[Column]) -> DataFrame:
        kept = df.withColumn("same_", F.struct("page", *[c.alias(f"c{i}") for i, c in enumerate(same)])).groupBy("same_").agg(F.min_by(F.struct(*df.columns), "ord").alias("row"))
        return kept.select("row.*")

    spans = spans.withColumn("text", F.replace("text", F.lit("\t"), F.lit(" "))).where(F.trim("text") != "")
    spans = once(spans, [F.bround("x"), F.bround("y"), F.trim("text")])
    shapes = once(shapes.where("kind is not null"), [F.bround("x0"), F.bround("y0"), F.col("kind")])
    gather = lambda df, columns, name: df.groupBy("page").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
    out = pages.join(gather(spans, ["ord", "x", "y", "x1", "text", "font", "size"], "spans"), "page")
    out = out.join(gather(shapes, ["ord", "kind", "x0", "y0", "x1", "y1"], "shapes"), "page", "left").join(gather(icons, ["ord", "x0", "y0", "x1", "y1", "name"], "icons"), "page", "left")
    none = lambda c, name: F.coalesce(c, F.array().cast(dict(out.dtypes)[name]))
    given = set(pages.columns)
    extra = {"top": F.lit(None).cast("double"), "bottom": F.lit(None).cast("double"), "single": F.lit(False)}
    return out.select("slug", F.col("page").cast("int").alias("pos"), "title", "width", "height", "first", *[F.col(c) if c in given else v.alias(c) for c, v in extra.items()], "spans", none(F.col("shapes"), "shapes").alias("shapes"), none(F.col("icons"), "icons").alias("icons"))


@dataclass
class Record:
    """A visual line, a horizontal rule or a row of marks."""

    y: float
    kind: str = "line"
    x: float = 0.0
    text: str = ""
    font: str = ""
    size: float = 0.0
    bullet: str = ""
    value: str = ""
    value_x: float = 0.0
    bold_lead: bool = False
    all_bold: bool = False
    bold_prefix: str = ""
    icon: str = ""
    marks: int = 0


def _bold(font: str) -> bool:
    return "Bold" in font and not font.startswith("Avara") and "FellType" not in font


def _dingbat(font: str) -> bool:
    return "Dingbat" in font or "Wingdings" in font


def styled(spans: list[dict], diamonds: list[dict]) -> str:
    """The text of a line's spans with switches, spaces where there are gaps, and diamonds where they stand."""
    pieces = [(s["x"], s["x1"], s["text"], _bold(s["font"]), "Italic" in s["font"]) for s in spans]
    placed: list[tuple] = []
    rest = sorted(diamonds, key=lambda d: d["x0"])
    for piece in pieces:
        while rest and rest[0]["x0"] < piece[0] - 1:
            d = rest.pop(0)
            placed.append((d["x0"], d["x1"], "◇ ", False, False))
        placed.append(piece)
    placed += [(d["x0"], d["x1"], "◇", False, False) for d in rest]
    runs: list[list] = []
    end = None
    for x, x1, text, bold, italic in placed:
        if end is not None and x - end > WORD_GAP and not runs[-1][0].endswith(" ") and not text.startswith(" "):
            text = " " + text
        if runs and runs[-1][1:] == [bold, italic]:
            runs[-1][0] += text
        else:
            runs.append([text, bold, italic])
        end = x1

    def dressed(text: str, bold: bool, italic: bool) -> str:
        inside = text.strip()
        if not inside or not (bold or italic):
            return text
        if italic:
            inside = R.ITALIC_ON + inside + R.ITALIC_OFF
        if bold:
            inside = R.BOLD_ON + inside + R.BOLD_OFF
        return text.replace(text.strip(), inside, 1)

    line = "".join(dressed(*r) for r in runs)
    for pattern, to in ((r"◇\s+(?=◇)", "◇"), (r"\( ◇", "(◇"), (r"([A-Za-z0-9])◇", r"\1 ◇"), (r"◇([A-Za-z0-9])", r"◇ \1"), (r"\s+([,;:.?!])", r"\1"), (r"\s+", " ")):
        line = re.sub(pattern, to, line)
    return L.normal(line)


def clusters(spans: list[dict]) -> list[list[dict]]:
    """Spans by visual line: one joins a line whose first span is near enough in height."""
    out: list[list[dict]] = []
    for s in sorted(spans, key=lambda s: (s["y"], s["x"])):
        if out and abs(s["y"] - out[-1][0]["y"]) <= SAME_LINE:
            out[-1].append(s)
        else:
            out.append([s])
    return [sorted(line, key=lambda s: s["x"]) for line in out]


def records(spans: list[dict], shapes: list[dict], icons: list[dict], lo: float, hi: float) -> list[Record]:
    """The visual lines of a region with their bullets, diamonds and icons, and its rules, from the top down."""
    near = [s for s in shapes if lo - 6 <= s["x0"] <= hi]
    of = lambda kind: [s for s in near if s["kind"] == kind]
    free = [i for i in icons if lo - 6 <= i["x0"] <= hi]
    out: list[Record] = []
    for line in clusters(spans):
        top = min(s["y"] for s in line)
        middle = top + max(s["size"] for s in line) / 2
        words = [s for s in line if not _dingbat(s["font"])]
        signs = [s for s in line if _dingbat(s["font"])]
        if not words:
            marks = sum(len(s["text"].strip()) for s in signs)
            if marks >= 2:
                out.append(Record(top, "marks", marks=marks))
            continue
        x = words[0]["x"]
        level = lambda s, band: abs((s["y0"] + s["y1"]) / 2 - middle) <= band  # noqa: E731, B023
        before = lambda s: s["x0"] < x and x - s["x0"] <= BULLET_REACH  # noqa: E731, B023
        lead = [s for s in signs if s["text"].strip() and s["x"] < x]
        bullet = ("stat" if "ITC" in lead[-1]["font"] else "check") if lead else ""
        if not bullet and any(level(s, BANDS["checkbox"]) and before(s) for s in of("checkbox")):
            bullet = "check"
        if not bullet and (spiral := next((s for s in of("spiral") if level(s, BANDS["spiral"]) and before(s)), None)):
            tail = any(abs(t["x0"] - spiral["x1"]) <= TAIL_REACH and abs(t["y0"] - spiral["y0"]) <= TAIL_REACH for t in of("tail"))
            bullet = "question" if tail else "item"
        icon = next((i for i in free if abs((i["y0"] + i["y1"]) / 2 - middle) <= ICON_BAND and i["x0"] <= x + ICON_RIGHT and x - i["x0"] <= ICON_LEFT), None)
        if icon:
            free.remove(icon)  # the next line does not have it too
        text = styled(words, [d for d in of("diamond") if level(d, BANDS["diamond"])])
        if not L.plain(text).strip():
            continue
        weight: dict[tuple[str, int], int] = {}
        for s in words:
            weight[s["font"], round(s["size"])] = weight.get((s["font"], round(s["size"])), 0) + len(s["text"])
        font, size = max(weight, key=weight.get)
        last = words[-1]
        priced = len(words) > 1 and last["size"] <= 9.5 and bool(L.matches(VALUE_TOKEN, last["text"].strip()))
        prefix = []
        for s in words:
            if not _bold(s["font"]):
                break
            prefix.append(s["text"])
        said = re.sub(r"\s+", " ", L.normal(" ".join(prefix))).strip()
        out.append(
            Record(
                top, x=x, text=text, font=font, size=size, bullet=bullet, value=last["text"].strip() if priced else "", value_x=last["x"] if priced else 0.0,
                bold_lead="Bold" in words[0]["font"], all_bold=all("Bold" in s["font"] for s in words), bold_prefix=said if said and L.plain(text).startswith(said) else "", icon=icon["name"] if icon else "",
            )
        )
    out += [Record(s["y0"], "rule") for s in of("hrule")]
    return sorted(out, key=lambda r: (r.y, r.kind != "rule"))


@dataclass
class Table:
    title: str
    rows: list[list[str]] = field(default_factory=list)
    notes: list[str] = field(default_factory=list)
    begun: bool = False  # its title is out
    resumed: bool = False


@dataclass
class Article:
    """What goes on from column to column and page to page."""

    title: str = ""
    table: Table | None = None
    last: str = ""


class Region:
    """Turns a column's records into marked lines. Each record goes to the readers in order until one takes it."""

    def __init__(self, article: Article, given: list[Record], x0: float, height: float, boxed: bool, rules: list[float]):
        self.article, self.given, self.x0, self.height, self.boxed, self.rules = article, given, x0, height, boxed, rules
        self.out: list[str] = []
        self.table = None if boxed else article.table
        self.in_entry = False
        self.above: float | None = None

    def close(self, keep: bool = False) -> None:
        t, self.table = self.table, None
        if t is None:
            return
        if t.rows and not t.begun:
            self.out.append("\x02VT " + t.title)
            t.begun = True
        elif not t.rows and not t.begun and not keep:
            self.out.append("\x02TH " + t.title)
        if t.rows:
            self.out += [f"\x02VR {item}\x03{value}" for item, value in t.rows] + ["\x02VF " + note for note in t.notes]
        self.article.table = Table(t.title, begun=t.begun, resumed=True) if keep else None

    def run(self) -> list[str]:
        for self.i, r in enumerate(self.given):
            gap = r.y - self.above if self.above is not None else NO_GAP + 99
            if r.kind == "rule":
                self.rule(r)
                continue
            self.above = r.y
            if r.kind == "marks":
                self.close()
                self.out.append(f"\x02MARK {r.marks}")
                continue
            if r.icon:
                at = len(self.out) - 1 if self.out and L.marker(self.out[-1]) in ("H2", "H3") else len(self.out)
                self.out.insert(at, "\x02ICON " + r.icon)
            text = self.cleaned(r)
            if text is None:
                continue
            self.gap, self.before = gap, L.plain(self.article.last)
            self.article.last = L.plain(text)
            for reader in (self.heading, self.table_title, self.table_line, self.bulleted, self.entry, self.label, self.goes_on):
                if reader(r, text, L.plain(text)):
                    break
            else:
                self.in_entry = False
                self.out.append(text)
        self.close(keep=True)
        return self.out

    def rule(self, r: Record) -> None:
        if any(abs(r.y - y) < RULES_APART for y in self.rules):
            return
        self.rules.append(r.y)
        self.close()
        if self.out[-1:] != ["\x02HR"]:
            self.out.append("\x02HR")
        self.above = r.y

    def cleaned(self, r: Record) -> str | None:
        """The text without page numbers and running headers, doubled words once."""
        if L.page_furniture(r.text, r.y, self.height) or L.running_header(L.plain(r.text), self.article.title, r.y < HEAD):
            return None
        if not L.doubled(L.plain(r.text)):
            return r.text
        once = L.undouble(L.plain(r.text))
        return None if L.running_header(once, self.article.title, True) else once

    def heading(self, r: Record, text: str, said: str) -> bool:
        if not r.font.startswith("Avara"):
            return False
        self.close()
        self.article.last, self.in_entry = "", False
        if r.size < 16 and not said.isdigit():
            self.out.append(("\x02H2 " if r.size >= 11 else "\x02H3 ") + said)
        return True

    def table_title(self, r: Record, text: str, said: str) -> bool:
        if "FellType" not in r.font or r.size < 10.5:
            return False
        self.close()
        self.article.last, self.in_entry = "", False
        title = re.sub(r"(?i)\s*value\s*$", "", said.strip(" .")).strip(" .")
        if L.matches(rf"^{T.DICE}\b", title):
            self.out.append(title)
        else:
            self.table, self.article.table = Table(title or "value"), None
        return True

    def far_value(self, r: Record) -> bool:
        return bool(r.value) and r.value_x - self.x0 > VALUE_FROM

    def table_line(self, r: Record, text: str, said: str) -> bool:
        t = self.table
        if t is None:
            return False
        indent = r.x - self.x0
        if self.far_value(r):
            item = said[: said.rfind(r.value)].strip() if said.endswith(r.value) else said
            item = said if item.endswith("(") else item
            if t.rows and t.rows[-1][1] == "" and indent >= INDENT and not item.startswith(("...", "…")):
                t.rows[-1] = [f"{t.rows[-1][0]} {item}", r.value]
            else:
                t.rows.append([item, r.value])
            return True
        if said.startswith("*"):
            t.notes.append(said)
            return True
        wrapped = (indent >= INDENT or said[:1].islower() or said[:1] in ("(", "◇")) and not r.bullet
        after = self.given[self.i + 1] if self.i + 1 < len(self.given) else None
        if wrapped and t.rows:
            t.rows[-1][0] += " " + said
        elif wrapped and t.resumed:
            self.out.append("\x02VA " + said)
        elif t.rows and not r.bullet and after and self.far_value(after):
            t.rows.append([said, ""])
        else:
            self.close()
            return False
        return True

    def bulleted(self, r: Record, text: str, said: str) -> bool:
        dots = re.match(r"(\.\.\.|…)", said)
        cut = re.sub(f"^[{R.BOLD_ON}{R.ITALIC_ON}]*(\\.\\.\\.|…)\\s*", "", text)
        if r.bullet == "check":
            self.out.append("\x02C " + text)
        elif r.bullet == "stat":
            self.out.append("• " + text)
        elif r.bullet and dots:
            self.out.append("\x02E " + cut)
        elif r.bullet == "question":
            self.out.append("\x02Q " + text)
        elif r.bullet:
            self.out.append(("\x02B2 " if self.in_entry and not self.boxed else "\x02B ") + text)
        elif re.match(r"(\.\.\.|…)\s*\S", said):
            self.out.append("\x02E " + cut)
        else:
            return False
        return True

    def entry(self, r: Record, text: str, said: str) -> bool:
        """A bold beginning on a hanging indent, apart from the line above; at a column's head, if a sentence ended before."""
        apart = ENTRY_GAP < self.gap < NO_GAP or self.gap >= NO_GAP and (not self.before or self.before[-1] in '.!?):;"')
        if self.boxed or not r.bold_prefix or not ENTRY_INDENT[0] <= r.x - self.x0 <= ENTRY_INDENT[1] or not apart:
            return False
        self.out.append("\x02B " + text)
        self.in_entry = True
        return True

    def label(self, r: Record, text: str, said: str) -> bool:
        if not (self.boxed and r.all_bold and len(said) <= 40):
            return False
        self.out.append("\x02H4 " + said)
        return True

    def goes_on(self, r: Record, text: str, said: str) -> bool:
        listed = bool(self.out) and (L.marker(self.out[-1]) in ("B", "B2", "Q", "E", "C") or self.out[-1].startswith("• "))
        if not listed or self.gap > WRAP_GAP or r.bold_lead or L.matches(W.REQUIREMENT_START, said):
            return False
        body, tail = L.split_tail(self.out[-1])
        head, rest = L.split_head(text)
        if body.endswith("-") and not body.endswith("--") and rest[:1].islower():
            self.out[-1] = body[:-1] + L.seam(tail, head) + rest
        elif body.endswith(("–", "—")):
            self.out[-1] = body + L.seam(tail, head) + rest
        else:
            self.out[-1] += " " + text
        return True


def page_lines(page: dict, article: Article) -> list[str]:
    """The marked lines of one page: its info box, then the left and the right column."""
    top = float("-inf") if page["top"] is None else page["top"]
    bottom = float("inf") if page["bottom"] is None else page["bottom"]
    inside = lambda y: top <= y < bottom
    middle = lambda s: (s["y0"] + s["y1"]) / 2
    spans = [s for s in page["spans"] if inside(s["y"])]
    shapes = [s for s in page["shapes"] if inside(middle(s))]
    icons = [s for s in page["icons"] if inside(middle(s))]
    out: list[str] = []
    rules: list[float] = []
    box = next((s for s in shapes if s["kind"] == "info_box"), None) if page["first"] else None
    if box:
        held = [s for s in spans if box["x0"] - 2 <= s["x"] <= box["x1"] + 2 and box["y0"] - 2 <= s["y"] <= box["y1"] + 2]
        if any(s["text"].strip().startswith(BOX_ROWS) for s in held):
            spans = [s for s in spans if not any(s is h for h in held)]
            inner = Region(article, records(held, shapes, icons, box["x0"] - 2, box["x1"] + 2), box["x0"], page["height"], True, rules).run()
            out += ["\x02BOX", *inner, "\x02ENDBOX"] if inner else []
    width = page["width"]
    middle_x = width + 1 if page["single"] else GUTTER if NARROW < width < WIDE else width * 0.5
    for lo, hi, column in ((0.0, middle_x, [s for s in spans if s["x"] < middle_x]), (middle_x, width, [s for s in spans if s["x"] >= middle_x])):
        if column:
            carried = article.table
            out += Region(article, records(column, shapes, icons, lo, hi), min(s["x"] for s in column), page["height"], False, rules).run()
            if carried is not None and article.table is carried:
                article.table = None
    return [x for i, x in enumerate(out) if not (i and x == out[i - 1] == "\x02HR")]


def article_lines(pages: DataFrame) -> DataFrame:
    """(slug, pos, line, title): marked lines of each article over its pages, as page_rows() gives them; wrapped lines are not joined yet."""

    def step(state: dict, row: dict) -> list[dict]:
        lines = page_lines(row, state["article"])
        begin = state["n"]
        state["n"] += len(lines)
        return [{"slug": row["slug"], "pos": begin + i, "line": x, "title": row["title"]} for i, x in enumerate(lines)]

    return W.fold(pages, "slug", lambda row: {"article": Article(row["title"] or ""), "n": 0}, step, lambda state: [], "slug string, pos int, line string, title string")
