"""From marked lines to typed blocks: headings, lists, price and dice tables, stat blocks, moves, cards of artifacts and improvements.

The parser walks over one article's lines with a cursor. A marked line is dispatched by its marker, a plain one goes to the first
reader that takes it; each reader moves the cursor on, so every pass makes progress. Blocks are rows, rendered elsewhere.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from loomwright.functions import rich as R
from loomwright.functions import rules as L
from loomwright.functions import text as T
from loomwright.operators import wrap as W

# Headings that never name a creature, headings of any article, and words of goods in price tables.
NOT_CREATURES = (
    "dangers", "discoveries", "hooks", "lore", "questions", "impressions", "origins", "nests", "sites", "terrain", "themes", "names", "wasps", "activities", "resources",
    "defenses", "places", "secrets", "moves", "people", "living conditions", "folks from elsewhere", "shoddy construction", "the delves", "chance encounters",
    "commonly available", "special items", "trade & barter", "trade and barter",
)
KNOWN_HEADINGS = (
    "Themes", "Hooks", "Lore", "Questions", "Names", "Dangers", "Discoveries", "Origins", "Nests", "Impressions", "Always", "Spring", "Summer", "Autumn", "Winter", "Sites",
    "Terrain", "Activities", "Resources", "Defenses", "Places",
)
GOODS = r"\d|free|\+|armor|weapon|tool|cart|mirror|lock|silver|apartment|house|killing|guide|crew|prospector|servant|bodyguard|engineer|assassin"
LEADS = r"^(damage|instinct|threat)\b"
STAT_STARTS = ("damage", "special quality", "special qualities", "instinct", "armor")
DAMAGE_GOES_ON = ("maw ", "1 piercing", "piercing)", "advantage)", "messy,")
NARRATIVE = ("a ", "an ", "the ", "she ", "he ", "they ", "then ")
BENEFIT_START = r"^(When you (?:mark|meet) all the requirements\b|Henceforth\b)"
MOST_ITEMS = 30

BLOCK = "pos int, parent int, kind string, level int, anchor string, name string, text string, items array<struct<label:string,text:string,level:int>>"


@dataclass
class Block:
    kind: str
    name: str = ""
    text: str = ""
    anchor: str = ""
    level: int = 0
    items: list[tuple[str, str, int]] = field(default_factory=list)
    inner: list[Block] = field(default_factory=list)


class Anchors:
    """Ids of a page's sections, each once."""

    def __init__(self):
        self.taken: set[str] = set()
        self.sections: list[tuple[str, str, str]] = []  # id, name, key
        self.lists = 0

    def add(self, name: str) -> str:
        base, n = L.slug(name, "section"), 1
        while (one := base if n == 1 else f"{base}-{n}") in self.taken:
            n += 1
        self.taken.add(one)
        self.sections.append((one, name, L.section_key(name)))
        return one

    def check_list(self, name: str) -> str:
        self.lists += 1
        return f"{L.slug(name or 'req', 'section')}-{self.lists}"


def stat_parts(lines: list[str]) -> dict[str, list]:
    """A stat block's lines by what they are: tags, stats, moves, notes, checks and dice tables (header, entries)."""
    out: dict[str, list] = {"tags": [], "stats": [], "moves": [], "notes": [], "checks": [], "tables": []}
    instinct = questions = False
    for line in lines:
        if isinstance(line, tuple):
            out["tables"].append(line)
            continue
        if L.marker(line) == "C":
            out["checks"].append(L.content(line).strip())
            continue
        line = L.plain(line)
        low, stats, moves, notes = line.lower().strip(), out["stats"], out["moves"], out["notes"]
        damage = bool(stats) and stats[-1].lower().startswith("damage")
        bullet = line.startswith(("•", "·"))
        if re.fullmatch(r"questions\s*:?", low):
            questions = True
            notes.append("Questions")
        elif not out["tags"] and (re.match(r"threat\b", low) or L.tag_line(line)):
            out["tags"].append(line)
        elif out["tags"] and stats and L.tag_line(line) and not low.startswith(("damage", "hp", "instinct")):
            notes.append(line)
        elif re.match(r"d\d+", low) and stats:
            stats[-1] += " " + line
        elif L.hit_points(line) or low.startswith(STAT_STARTS):
            instinct = instinct or low.startswith("instinct")
            stats.append(line)
        elif bullet:
            item = line.lstrip("•· ").strip()
            (notes if questions or notes and instinct and moves else moves).append("• " + item if questions or notes and instinct and moves else item)
        elif low.startswith("when "):
            notes.append(line)
        elif damage and (line[:1].islower() or low.startswith(DAMAGE_GOES_ON) or stats[-1].endswith((",", "("))):
            stats[-1] += " " + line
        elif instinct and line[:1].isupper() and (len(line) > 55 or notes or low.startswith(NARRATIVE)):
            notes.append(line)
        elif instinct and len(line) < 100:
            moves.append(line.strip())
        elif moves and not L.heading(line) and line[:1].islower():
            moves[-1] += " " + line
        else:
            notes.append(line)
    out["moves"] = [m for m in out["moves"] if m.strip()]
    out["notes"] = [n for n in out["notes"] if not L.tag_line(n) and not L.hit_points(n)]
    return out


class Parser:
    def __init__(self, lines: list[str], title: str = "", page: str = "", anchors: Anchors | None = None, rich: bool | None = None):
        self.lines, self.title, self.page = list(lines), title, page
        self.anchors = anchors or Anchors()
        self.rich = any(x.startswith("\x02") for x in lines) if rich is None else rich
        self.at = 0
        self.out: list[Block] = []
        self.icon = ""
        self.creatures: set[int] = set()

    # -- cursor

    def peek(self, k: int = 0) -> str:
        j = self.at + k
        return self.lines[j] if 0 <= j < len(self.lines) else ""

    @property
    def more(self) -> bool:
        return self.at < len(self.lines)

    def take(self) -> str:
        self.at += 1
        return self.lines[self.at - 1]

    def take_while(self, wanted: Callable[[str], bool]) -> list[str]:
        begin = self.at
        while self.more and wanted(self.peek()):
            self.at += 1
        return self.lines[begin : self.at]

    def take_icon(self) -> str:
        icon, self.icon = self.icon, ""
        return icon

    def add(self, kind: str, **given) -> Block:
        self.out.append(Block(kind, **given))
        return self.out[-1]

    def run(self) -> list[Block]:
        while self.more:
            line = self.peek()
            if line.startswith("\x02"):
                reader = self.MARKED.get(L.marker(line))
                if reader:
                    reader(self)
                else:
                    self.lines[self.at] = L.bare(line)
                continue
            if L.sentence(line) and self.at not in self.creatures and not L.require_header(line):
                self.add("paragraph", text=self.take())
                continue
            for reader in self.PLAIN:
                if reader(self, L.plain(line)):
                    break
        return self.out

    def title_again(self, s: str) -> bool:
        return L.running_header(s, self.title, True) or L.normal(s).lower() == L.normal(self.title).lower()

    # -- marked lines

    def rule(self):
        self.take()
        last = self.out[-1].kind if self.out else ""
        if last not in ("heading", "table_heading", "stat", "rule"):
            self.add("rule")
            self.icon = ""

    def icon_line(self):
        self.icon = L.content(self.take()).strip() or self.icon
        self.take_while(lambda x: L.marker(x) == "ICON")

    def box(self):
        self.take()
        inner = self.take_while(lambda x: L.marker(x) != "ENDBOX")
        self.at += 1
        self.add("infobox", inner=Parser(inner, self.title, self.page, self.anchors).run())

    def skip(self):
        self.take()

    def second_heading(self):
        name = L.content(self.take()).strip()
        if self.title_again(name):
            self.icon = ""
            return
        name = name.rstrip(":")
        self.add("heading", name=name, level=2, anchor=self.anchors.add(name), text=self.take_icon())

    def table_heading(self):
        name = L.content(self.take()).strip()
        if name.lower() == "steading improvement":
            self.icon = ""
            self.steading()
            return
        self.add("table_heading", name=name, level=3, anchor=self.anchors.add(name), text=self.take_icon())

    def fourth_heading(self):
        self.icon = ""
        self.add("heading", name=L.content(self.take()).strip(), level=4)

    def creature_ahead(self) -> bool:
        """Hit points, damage, an instinct or a threat in the next five lines, or a tag line in the next three."""
        for k in range(1, 6):
            line = self.peek(k)
            if L.marker(line) == "H3":
                continue
            if not line or line.startswith("\x02"):
                return False
            c = L.bare(line)
            if not c.startswith("• ") and (L.hit_points(c) or L.matches(LEADS, c) or k <= 3 and L.tag_line(c)):
                return True
        return False

    def third_heading(self):
        name = L.content(self.peek()).strip()
        after = self.peek(1)
        if self.creature_ahead():
            self.creatures.add(self.at)
            self.lines[self.at] = name
        elif after and not after.startswith("\x02") and (L.item_tags(after) or L.pure_tags(L.bare(after))):
            self.artifact(name)
        elif self.icon:
            self.hazard(name.rstrip(":"))
        else:
            self.take()
            name = name.rstrip(":")
            self.add("heading", name=name, level=3, anchor=self.anchors.add(name))

    def artifact(self, name: str):
        """A heading, its tag lines, and prose put into paragraphs; notes ("Something useful: ..") are paragraphs of their own."""
        icon = self.take_icon()
        self.take()
        tags = []
        while self.more and not self.peek().startswith("\x02") and (L.item_tags(self.peek()) or L.pure_tags(L.bare(self.peek()))):
            if tag := re.sub(r"^[,\s]+", "", L.bare(self.take()).strip()).strip().rstrip(","):
                tags.append(tag)
        paragraphs: list[tuple[str, str]] = []
        for line in self.take_while(lambda x: not x.startswith("\x02")):
            text = line.strip()
            said = L.plain(text)
            if not said:
                continue
            note = bool(L.matches(r"^(Something (?:interesting|useful)\b|When you\b)", said))
            before = L.plain(paragraphs[-1][1]).rstrip() if paragraphs else ""
            if not paragraphs or note or before.endswith((".", "!", "?")) and said[0].isupper():
                paragraphs.append(("note" if note else "", text))
            else:
                kind, so_far = paragraphs[-1]
                body, tail = L.split_tail(so_far.rstrip())
                head, rest = L.split_head(text)
                wrapped = body.endswith("-") and rest[:1].islower()
                paragraphs[-1] = kind, body[:-1] + L.seam(tail, head) + rest if wrapped else f"{so_far} {text}"
        name = name.rstrip(":")
        items = [("icon", icon, 0)] if icon else []
        items += [("tags", ", ".join(tags), 0)] if tags else []
        self.add("artifact", name=name, anchor=self.anchors.add(name), items=items + [(kind, text, 0) for kind, text in paragraphs])

    def hazard(self, name: str):
        """A heading with an icon and the prose and bullets up to the next rule, heading, table or dice header."""
        icon = self.take_icon()
        self.take()

        def inside(x: str) -> bool:
            return (not x.startswith("\x02") or L.marker(x) in ("B", "B2", "Q", "E", "C")) and not L.roll_header(L.bare(x))

        items = [("icon", icon, 0)]
        for x in self.take_while(inside):
            items.append(("bullet" if L.marker(x) in ("B", "B2", "Q", "E") else "", L.content(x).strip(), 0))
        self.add("hazard", name=name, anchor=self.anchors.add(name), items=items)

    def price_append(self):
        text = L.content(self.take()).strip()
        last = self.out[-1] if self.out else None
        if last and last.kind == "price_table" and any(k == "row" for k, *_ in last.items):
            i = max(i for i, x in enumerate(last.items) if x[0] == "row")
            item, _, value = last.items[i][1].partition("\x03")
            last.items[i] = ("row", f"{item} {text}\x03{value}", 0)
        elif text:
            self.add("paragraph", text=text)

    def price_rows(self):
        title = L.content(self.take()).strip() if L.marker(self.peek()) == "VT" else None
        rows = []
        for x in self.take_while(lambda x: L.marker(x) in ("VR", "VF")):
            if L.marker(x) == "VR":
                item, _, value = L.content(x).partition("\x03")
                rows.append(("row", f"{item.strip()}\x03{value.strip()}", 0))
            else:
                rows.append(("note", L.content(x).strip(), 0))
        last = self.out[-1] if self.out else None
        if title is None and last and last.kind == "price_table" and any(k == "row" for k, *_ in rows):
            last.items += rows
            return
        name = re.sub(r"\s+", " ", title or "Value").strip()
        self.add("price_table", name=(name if name.lower().endswith("value") else name + " value").title(), items=rows)

    def bullets_marked(self):
        rows = self.take_while(lambda x: L.marker(x) in ("B", "B2"))
        self.add("bullets", items=[("", L.content(x).strip(), 2 if L.marker(x) == "B2" else 1) for x in rows])

    def run_of_one(self):
        kind = L.marker(self.peek())
        rows = self.take_while(lambda x: L.marker(x) == kind)
        self.add({"Q": "questions", "E": "ellipsis"}[kind], items=[("", L.content(x).strip(), 1) for x in rows])

    def checks(self):
        rows = self.take_while(lambda x: L.marker(x) == "C")
        self.add("checks", anchor=self.anchors.check_list(self.page or "chk"), items=[("", L.content(x).strip(), 1) for x in rows])

    def steading(self):
        """A block of requirements told by check boxes and plain lines, up to the next other marker."""
        plain = ["steading improvement"]
        for x in self.take_while(lambda x: not x.startswith("\x02") or L.marker(x) == "C"):
            said = L.content(x)
            m = re.match(f"{R.BOLD_ON}([^{R.BOLD_ON}{R.BOLD_OFF}]*){R.BOLD_OFF}", said)
            if L.marker(x) == "C" and m and L.caps_label(L.plain(m[1])):
                plain += [L.plain(m[1]), *([rest] if (rest := L.plain(said[m.end() :]).strip()) else [])]
            else:
                plain.append(L.plain(said).strip())
        found = improvement(plain, 0, self.anchors)
        if found:
            block, end = found
            self.out.append(block)
            self.out += [Block("paragraph", text=x) for x in plain[end:] if x.strip()]
        else:
            self.add("improvement", items=[("", x, 0) for x in plain[1:] if x.strip()])

    # -- plain lines

    def improvement_block(self, line: str) -> bool:
        found = improvement(self.lines, self.at, self.anchors)
        if found:
            block, self.at = found
            self.out.append(block)
        elif line.strip().lower() == "steading improvement":
            self.take()
        else:
            return False
        return True

    def price_block(self, line: str) -> bool:
        """Rows of items and values under a price header; a value may stand before its item, after it, or be missing."""
        if not L.value_header(line):
            return False
        self.take()
        if self.peek() in ("&", "and"):
            self.take()
        rows: list[tuple[str, str]] = []
        held: str | None = None

        def wrapped(item: str, stop: Callable[[str], bool]) -> str:
            while self.more and W.decide(item, self.peek())[0] and not stop(self.peek()):
                item += " " + self.take()
            return item

        while self.more:
            x = self.peek()
            after = self.peek(1)
            priced = L.value_row(x)
            if x.startswith("\x02") or L.value_header(x) or L.matches(L.FORWARD_ROLL, x) or L.dice_alone(x) or L.tag_line(x) or L.hit_points(x):
                break
            if L.heading(x) and not priced and not L.lone_value(x) and len(x) < 40 and not L.matches(GOODS, x) and x[0].isupper() and len(x.split()) <= 4:
                break
            if value := L.lone_value(x):
                held = value
                self.take()
            elif priced:
                self.take()
                rows.append((wrapped(priced[0], lambda y: bool(L.value_row(y) or L.lone_value(y)) or L.value_header(y)), priced[1]))
                held = None
            elif held and not L.heading(x):
                self.take()
                rows.append((wrapped(x, lambda y: bool(L.matches(T.VALUE_ROW, y) or L.lone_value(y))), held))
                held = None
            elif after and L.lone_value(after) and not x.startswith("When "):
                self.take()
                rows.append((x, L.lone_value(self.take())))
            elif rows and not L.heading(x) and not x.startswith("When ") and after and (L.value_row(after) or L.value_header(after) or L.lone_value(after)):
                rows.append((self.take(), "—"))
            elif rows and W.decide(rows[-1][0], x)[0]:
                rows[-1] = (f"{rows[-1][0]} {self.take()}", rows[-1][1])
            else:
                break
        name = re.sub(r"\s*&\s*", " & ", re.sub(r"\s+", " ", line.strip()))
        if rows:
            self.add("price_table", name=name.title(), items=[("row", f"{a}\x03{b}", 0) for a, b in rows])
        else:
            self.add("heading", name=name, level=2)
        return True

    def dice_entries(self, stop: Callable[[str], bool], through: bool = True) -> list[tuple[str, str, int]]:
        """Numbered rows, lines that are none going on with the row above; rules and icons between them are decoration (with through)."""
        out: list[list[str]] = []
        while self.more:
            x = self.peek()
            if through and L.marker(x) in ("HR", "ICON"):
                j = self.at + 1
                while j < len(self.lines) and L.marker(self.lines[j]) in ("HR", "ICON"):
                    j += 1
                if out and (j >= len(self.lines) or not L.entry(L.plain(self.lines[j])) and (self.lines[j].startswith("\x02") or stop(L.plain(self.lines[j])))):
                    break
                self.at = j
                continue
            line = L.plain(x)
            if x.startswith("\x02"):
                break
            if e := L.entry(line):
                out.append(list(e))
            elif not out or stop(line):
                break
            else:
                body = out[-1][1]
                soft = body.endswith("-") and not body.endswith(("–", "—", "--"))
                out[-1][1] = body[:-1] + line if soft else body + line if body.endswith(("–", "—")) else f"{body} {line}"
            self.take()
        return [(a, b, 0) for a, b in out]

    def dice_block(self, line: str) -> bool:
        after = L.plain(self.peek(1))
        forward, backward = L.matches(L.FORWARD_ROLL, line), L.reverse_roll(line)
        used = 1
        if forward:
            dice, label = forward[1], forward[2].strip()
        elif backward and not L.entry(line):
            label, dice = backward[1].strip(), backward[2]
        elif len(line) <= 40 and not L.entry(line) and L.dice_alone(after):
            label, dice, used = line, after, 2
        elif L.dice_alone(line):
            dice, label = line, "result"
            if after and len(after) < 40 and not after[:1].isdigit():
                label, used = after, 2
        else:
            return False
        self.at += used
        entries = self.dice_entries(lambda x: L.roll_header(x) or L.heading(x) or L.tag_line(x) or L.value_header(x) or x.endswith(":") and x[:1].isupper() and len(x) < 60)
        last = self.out[-1] if self.out else None
        if entries and last and last.kind == "roll_table" and last.text.lower() == dice.lower() and last.items:
            if int(entries[0][0].split("-")[0]) == int(last.items[-1][0].split("-")[-1]) + 1:  # the other column's half of one table
                last.items += entries
                return True
        if re.search("[()]", label) and len(label) < 12:
            label = "result"
        if entries:
            self.add("roll_table", name=label, text=dice, anchor=self.anchors.add(label or dice), items=entries)
        else:
            self.add("heading", name=label, text=dice, level=2)
        return True

    def begins_creature(self, line: str) -> bool:
        if self.at in self.creatures:
            return True
        if len(line) > 48 or line.endswith(".") or line.lower() in NOT_CREATURES or L.value_header(line) or L.matches(T.VALUE_ROW, line):
            return False
        one, two = L.plain(self.peek(1)), L.plain(self.peek(2))
        return L.tag_line(one) and (L.hit_points(one) or L.hit_points(two) or two.lower().startswith("damage")) or L.hit_points(one) and not L.heading(one)

    def stat_block(self, line: str) -> bool:
        if not self.begins_creature(line):
            return False
        name, before = line, []
        if m := re.match(r"^(.+?),\s*([a-z][\w\-]*(?:\s*,\s*[a-z][\w\-]*)*)$", name):
            name, before = m[1].strip(), [x.strip() for x in m[2].split(",")]
        icon = self.take_icon()
        self.take()
        told: list = []
        while self.more:
            x = self.peek()
            kind, said = L.marker(x), L.content(x).strip()
            if kind == "HR":
                j = self.at + 1
                while j < len(self.lines) and L.marker(self.lines[j]) == "HR":
                    j += 1
                if j >= len(self.lines) or not L.entry(L.plain(self.lines[j])):
                    break
                self.at = j
                continue
            if kind == "C":
                told.append(self.take())
                continue
            if kind in ("B", "B2", "Q", "E"):
                told.append("• " + said)
                self.take()
                continue
            if kind == "H3":
                after = L.plain(self.peek(1))
                leads = L.tag_line(after) or L.hit_points(after) or bool(L.matches(LEADS, after))
                if said.lower().startswith("questions"):
                    told.append(said.rstrip(":") + ":")
                elif len(said.split()) <= 4 and leads:
                    before.append(said)  # a kind, before the tags
                else:
                    break
                self.take()
                continue
            if kind or x.startswith("\x02"):
                break
            said = L.plain(x)
            if before and (L.tag_line(said) or L.hit_points(said) or L.matches(LEADS, said)):
                if L.tag_line(said):
                    said = ", ".join([*before, said])
                else:
                    told.append(", ".join(before))
                before = []
            roll = L.matches(L.FORWARD_ROLL, said)
            if roll or L.dice_alone(said):
                self.take()
                dice, label = (roll[1], roll[2].strip()) if roll else (said, "result")
                self.take_while(lambda y: L.marker(y) == "HR")
                if entries := self.dice_entries(lambda y: L.roll_header(y) or L.heading(y), False):
                    told.append((dice, label, entries))
                continue
            told.append("• " + said.lstrip("•· ").strip() if said.startswith(("•", "·")) else said)
            self.take()
        if before:
            told.insert(0, ", ".join(before))
        parts = stat_parts(told)
        items = [("icon", icon, 0)] if icon else []
        for kind in ("tags", "stats", "moves", "notes", "checks"):
            items += [(kind, x, 0) for x in parts[kind]]
        inner = [Block("roll_table", name=label, text=dice, items=entries) for dice, label, entries in parts["tables"]]
        self.add("stat", name=name, anchor=self.anchors.add(name), items=items, inner=inner)
        return True

    def begins_move(self, k: int = 0) -> bool:
        x, after = self.peek(k), self.peek(k + 1)
        return not x.startswith("\x02") and L.caps_label(L.plain(x)) and bool(after) and L.bare(after).lstrip().startswith("When ")

    def move_block(self, line: str) -> bool:
        if not self.rich or not self.begins_move():
            return False
        name = line.strip()
        anchor = self.anchors.add(name)
        self.take()
        inside: list[str] = []
        while self.more and not self.begins_move() and L.marker(self.peek()) not in ("H2", "H3", "H4", "TH", "VT", "BOX"):
            inside.append(self.take())
        k = 0
        while k < len(inside) and not inside[k].startswith("\x02") and not L.plain(inside[k]).startswith(("•", "·")):
            k += 1
        trigger = " ".join(x.strip() for x in inside[:k] if x.strip())
        self.add("move", name=name, anchor=anchor, text=trigger, inner=Parser(inside[k:], self.title, self.page, self.anchors, any(x.startswith("\x02") for x in inside[k:])).run())
        return True

    def heading_line(self, line: str) -> bool:
        if not L.heading(line):
            return False
        if self.rich and not L.caps_label(line):
            self.add("paragraph", text=self.take())
            return True
        if not (len(line) < 45 or line.endswith(":") or line in KNOWN_HEADINGS):
            return False
        self.take()
        name = L.undouble(line)
        if not self.title_again(line) and L.normal(name).lower() != L.normal(self.title).lower():
            name = name.rstrip(":")
            self.add("heading", name=name, level=2 if len(name) < 40 else 3, anchor=self.anchors.add(name))
        return True

    def bullet_lines(self, line: str) -> bool:
        if not line.startswith(("•", "·")):
            return False
        items: list[str] = []
        while self.more and L.plain(self.peek()).lstrip().startswith(("•", "·")):
            items.append(L.plain(self.take()).lstrip().lstrip("•· ").strip())
            while self.more and not L.plain(self.peek()).lstrip().startswith(("•", "·")) and W.decide(items[-1], self.peek())[0]:
                items[-1] += " " + L.plain(self.take())
        self.add("list", items=[("", x, 1) for x in items if x])
        return True

    def numbered_lines(self, line: str) -> bool:
        if not L.entry(line) or not L.entry(L.plain(self.peek(1))):
            return False
        items: list[tuple[str, str, int]] = []
        while self.more and (e := L.entry(L.plain(self.peek()))):
            self.take()
            number, body = e
            while self.more and not L.entry(L.plain(self.peek())) and W.decide(body, self.peek())[0]:
                body += " " + L.plain(self.take())
            items.append((number, body, 0))
        self.add("numbered", items=items)
        return True

    def paragraph(self, line: str) -> bool:
        self.add("paragraph", text=self.take())
        return True

    MARKED = {
        "HR": rule, "ICON": icon_line, "BOX": box, "ENDBOX": skip, "H2": second_heading, "TH": table_heading, "H4": fourth_heading, "H3": third_heading, "VA": price_append,
        "VT": price_rows, "VR": price_rows, "VF": price_rows, "B": bullets_marked, "B2": bullets_marked, "Q": run_of_one, "E": run_of_one, "C": checks,
    }
    PLAIN = (improvement_block, price_block, dice_block, stat_block, move_block, heading_line, bullet_lines, numbered_lines, paragraph)


def improvement(lines: list[str], start: int, anchors: Anchors) -> tuple[Block, int] | None:
    """A block of requirements: an optional name in capitals and a line about it, groups of a header and what it asks for, then what
    it brings. (block, next place), or None if there is none here; an anchor is only taken by a block that is one."""
    get = lambda k: lines[k] if k < len(lines) else ""
    asks = lambda k: bool(L.require_header(get(k)) and L.matches(r"^Requires?\b", get(k).strip()))
    j = start
    told = get(j).strip().lower() == "steading improvement"
    if not (told or asks(j) or L.caps_label(get(j).strip()) and any(asks(start + k) for k in range(1, 5))):
        return None
    j += told
    name: list[str] = []
    while len(name) < 4 and L.caps_label(get(j)) and not L.require_header(get(j)):
        name.append(get(j).strip())
        j += 1
    items: list[tuple[str, str, int]] = [("kind", "Steading improvement", 0)] if told else []
    if get(j) and not (L.require_header(get(j)) or L.require_end(get(j)) or L.caps_label(get(j))) and len(get(j)) < 160 and any(asks(j + k) for k in range(3)):
        items.append(("blurb", get(j).strip(), 0))
        j += 1
    if not asks(j):
        return None
    asked = 0
    while L.require_header(get(j)):
        header = get(j).strip().rstrip(":")
        items.append(("requires", header if header.endswith("?") else header + ":", 0))
        j += 1
        group = 0
        while j < len(lines) and L.require_item(get(j)):
            items.append(("check", L.bare(get(j)).strip(), 1))
            group += 1
            j += 1
        if group > MOST_ITEMS:
            return None
        asked += group
    if not asked:
        return None

    def brings(k: int) -> bool:
        return bool(L.matches(BENEFIT_START, get(k)) or L.benefit_continues(get(k)) and L.matches(r"^(Also,|\w+ gains\b|Every )", get(k)))

    def section(x: str) -> bool:
        return L.heading(x) and len(x.split()) <= 4 and len(x) < 40 and not L.matches(r"^(When |Henceforth|Also|\w+ gains\b|Every |The steading)", x)

    while j < len(lines) and brings(j):
        items.append(("benefit", get(j), 0))
        j += 1
        while j < len(lines) and L.benefit_continues(get(j)) and not section(get(j).strip()):
            items.append(("benefit", get(j), 0))
            j += 1
    whole = " ".join(name)
    return Block("improvement", name=whole, anchor=anchors.add(whole or "Steading improvement"), items=items), j


def flat(blocks: list[Block], parent: int | None = None, out: list[dict] | None = None) -> list[dict]:
    """Blocks as rows, each after the one that holds it."""
    out = [] if out is None else out
    for b in blocks:
        pos = len(out)
        out.append({"pos": pos, "parent": parent, "kind": b.kind, "level": b.level, "anchor": b.anchor, "name": b.name, "text": b.text, "items": [{"label": x, "text": y, "level": z} for x, y, z in b.items]})
        flat(b.inner, pos, out)
    return out


def parse(lines: DataFrame, key: str = "slug", title: str = "title", wrapped: bool = True) -> DataFrame:
    """(key, pos, parent, kind, level, anchor, name, text, items): the blocks of each article; lines: (key, pos, line, title).

    An article's lines are held together, since a reader may look ahead to its end; wrapped lines are put together first.
    """

    def end(state: dict) -> list[dict]:
        held = W.merged(state["lines"]) if wrapped else state["lines"]
        return [{key: state["key"], **row} for row in flat(Parser(held, state["title"], str(state["key"])).run())]

    def step(state: dict, row: dict) -> list[dict]:
        state["lines"].append(row["line"] or "")
        return []

    kind = lines.schema[key].dataType.simpleString()
    return W.fold(lines, key, lambda row: {"key": row[key], "title": row[title] or "", "lines": []}, step, end, f"{key} {kind}, {BLOCK}")


def sections(blocks: DataFrame, key: str = "slug") -> DataFrame:
    """(key, pos, id, name, norm): what links can point at."""
    return blocks.where("anchor <> '' and kind <> 'checks'").select(key, "pos", blocks.anchor.alias("id"), "name", T.section_key("name").alias("norm"))
