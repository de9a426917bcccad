"""The line rules of functions.text and functions.rich as plain functions, for folds that see one line after another.

A line may begin with a marker (a control character and a tag, see functions.rich) and hold switches for bold and italic.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import lru_cache

from loomwright.functions import rich as R
from loomwright.functions import text as T

# Openings and names that tell kinds of lines apart.
FORWARD_ROLL = rf"^({T.DICE})\s+(.+)$"
REVERSE_ROLL = rf"^(.{{1,40}}?)\s+({T.DICE})$"
CHAPTER_OPENINGS = (
    "This chapter", "There are", "Player characters", "Sites are", "Maybe you", "A threat is", "Discoveries are", "NPCs are", "The homefront",
    "The basic moves", "When you", "Introductions are", "Most events", "Use this procedure", "Thanks to", "The following works",
)
LONE_SHARDS = ("up", "plan", "door", "moves", "fly", "change")
#: The home place, whatever its name, gains something.
PLACE_GAINS = r"^\w+ gains\b"
BENEFIT_OPENINGS = ("When you", "Henceforth", "Also,", "Every ", "The steading", "You can ", "You may ", "This ", "These ")
ITALIC_PROSE = r"(When |Whenever |The |If |Pick |For |See |Consider |Most |Some )"
TRACK = rf"^[A-Za-z][A-Za-z\s]{{0,20}}:\s*.*\b(nil|{r'\d*d\d+'})\b"

_SWITCHES = R.BOLD_ON + R.BOLD_OFF + R.ITALIC_ON + R.ITALIC_OFF
_DROP = str.maketrans("", "", _SWITCHES)
_NORMAL = str.maketrans(T.SMALLER_QUOTES | T.DINGBATS | dict.fromkeys("­﻿​‌", ""))


def _anchored(p: str) -> bool:
    """Whether a pattern begins with ^ and has no alternative outside brackets."""
    bare_ = re.sub(r"\\.|\[\^?\]?(?:\\.|[^\]\\])*\]", "", p)
    depth = 0
    for c in bare_:
        depth += (c == "(") - (c == ")")
        if c == "|" and depth == 0:
            return False
    return p.startswith("^")


@lru_cache(500)
def finder(p: str, ignore_case: bool) -> Callable[[str], re.Match | None]:
    """A pattern's search; of one that only the beginning can match, that alone is looked at, not each place of a long line."""
    pattern = re.compile(p.removeprefix("(?i)") if ignore_case else p, re.I if ignore_case else 0)
    return pattern.match if _anchored(p.removeprefix("(?i)")) else pattern.search


def matches(p: str, s: str) -> re.Match | None:
    """A search that ignores case; patterns may carry their own flag."""
    return finder(p, True)(s)


def exactly(p: str, s: str) -> re.Match | None:
    return finder(p, False)(s)


def plain(s: str) -> str:
    # Few lines hold a switch, and looking for one costs a small part of a translation.
    return s.translate(_DROP) if "\x04" in s or "\x05" in s or "\x06" in s or "\x07" in s else s


def sentence(s: str) -> bool:
    """A long line without switches that begins with a letter other than d and ends in a full stop: nothing that is told by a mark, a
    number, a die, an item's tags, a price or shortness. Most lines are such, and rules need not look for these there."""
    return len(s) > 90 and s[-1] == "." and s[0] not in "dD" and s[0].isalpha() and plain(s) is s


def content(s: str) -> str:
    """Without the marker; switches stay."""
    return re.sub(R.MARKER, "", s) if s.startswith("\x02") else s


def bare(s: str) -> str:
    """Without marker and switches."""
    return plain(content(s))


def marker(s: str) -> str:
    """The tag of a marked line, or the empty string."""
    m = re.match("\x02([A-Z0-9]+)", s)
    return m[1] if m else ""


def normal(s: str) -> str:
    return re.sub("[ \t]+", " ", s.translate(_NORMAL)).strip()


def lower_words(s: str) -> int:
    """How many words begin with a lower-case letter."""
    return sum(w[0].islower() for w in s.split())


def upper_share(s: str) -> float:
    letters = [c for c in s if c.isalpha()]
    return sum(c.isupper() for c in letters) / len(letters) if letters else 0.0


def undouble(s: str) -> str:
    out: list[str] = []
    held = None
    for w in s.split():
        if held == w.lower():
            held = None
        else:
            out.append(w)
            held = w.lower()
    return " ".join(out)


def doubled(s: str) -> bool:
    w = s.lower().split()
    return len(w) > 1 and len(w) % 2 == 0 and w[::2] == w[1::2]


def running_header(line: str, title: str, near_top: bool = False) -> bool:
    t = line.strip()
    if not t or len(t) <= 8 and t.lower() in ("contents", "index"):
        return True
    w = t.split()
    if len(w) % 2 == 0 and w[0].lower() in (w[1].lower(), w[len(w) // 2].lower()):
        w = t.lower().split()
        if w[::2] == w[1::2] or w[: len(w) // 2] == w[len(w) // 2 :]:
            return True
    squeeze = lambda x: re.sub("[^a-z0-9]+", "", x.lower())
    whole = squeeze(title)
    if not whole:
        return False
    mine, once = squeeze(t), squeeze(undouble(t))
    if mine in (whole, whole * 2) or once in (whole, whole * 2):
        return True
    return near_top and len(once) >= 6 and (whole.startswith(once) or whole.endswith(once) or once.startswith(whole) and len(once) <= len(whole) + 6)


def dice_alone(s: str) -> bool:
    return bool(matches(rf"^{T.DICE}$", s))


def roll_header(s: str) -> bool:
    line = s.strip()
    if dice_alone(line):
        return True
    if m := matches(FORWARD_ROLL, line):
        label = m[2]
        return len(label) <= 48 and not re.search("[()]", label) and not matches(r"\bvalue\b", label) and label.count(",") < 2 and not label.endswith((".", ";", ":"))
    return bool(reverse_roll(line)) and not exactly(T.ENTRY, line)


def reverse_roll(s: str) -> re.Match | None:
    return matches(REVERSE_ROLL, s) if s.endswith(("4", "6", "8", "0", "2", "\n")) else None


def value_header(s: str) -> bool:
    if s.strip()[-5:].lower() != "value":  # so with most lines
        return False
    t = re.sub(r"\s+", " ", s.strip().lower().replace("&", " "))
    return t.endswith(" value") and (t[:-6].strip() in T.VALUE_HEADS or bool(matches(T.VALUE_HEADER, s.strip())))


def value_row(s: str) -> tuple[str, str] | None:
    """(item, value) of a price line."""
    line = s.strip()
    if not line or value_header(line) or line.lower().startswith(("on a ", "when ", "pick ", "roll ", "if the ")):
        return None
    if m := matches(T.VALUE_TAIL, line):
        words = f"{m[1].strip()} {(m[3] + m[4]).strip()}".strip()
        return re.sub(r"(?i)\s*trade opportunities\s*$", "", words).strip(), m[2]
    if (m := matches(T.VALUE_ROW, line)) and not m[1].strip().endswith((",", "(", "/")):
        return f"{m[1].strip()} {m[3]}" if m[3] else m[1].strip(), m[2]
    return None


def lone_value(s: str) -> str | None:
    m = matches(T.LONE_VALUE, s)
    return m[1] if m else None


def entry(s: str) -> tuple[str, str] | None:
    """(number or range, body) of a numbered line."""
    m = exactly(T.ENTRY, s)
    return (m[1] + (f"-{m[2]}" if m[2] else ""), m[3].strip()) if m else None


def hit_points(s: str) -> bool:
    return ("HP" in s or "hp" in s or "Hp" in s or "hP" in s) and bool(matches(T.HIT_POINTS, s))


def caps_label(s: str) -> bool:
    return len(s) <= 55 and sum(c.isalpha() for c in s) >= 3 and upper_share(s) >= 0.85


def tag_line(s: str) -> bool:
    if len(s) > 160:
        return False
    parts = [p.strip().lower() for p in re.split("[,;]", s) if p.strip()]
    if not parts or hit_points(s) or s.lower().startswith("damage"):
        return False
    return parts[0].split()[0] in T.ORG_TAGS or sum(any(w in T.TAG_WORDS for w in p.split()) for p in parts) >= 2


def heading(s: str) -> bool:
    if not s or len(s) > 55 or not (s[0].isupper() or s[0].isdigit()) or len(s.split()) > 8:
        return False
    if s.rstrip("\"'”’").endswith((".", ",", ";")) or s.startswith(("•", "-", "–")) or doubled(s):
        return False
    if entry(s) or hit_points(s) or roll_header(s) or value_header(s) or matches(T.VALUE_ROW, s) or lone_value(s):
        return False
    if matches(r"^Values?\s*\d+\s*\)?\.?$", s.strip()) or exactly(r"^[\d\s,;:.)\]]+$", s.strip()) or matches(r"\bpages?\s+\d", s) or matches(T.PAGES, s):
        return False
    return sum(w[0].islower() and w.lower().strip(".,;:") not in T.SMALL_WORDS for w in s.split()) < 3


def require_header(s: str) -> bool:
    return bool(matches(R.REQUIREMENT, s.strip()))


def require_end(s: str) -> bool:
    return bool(matches(R.REQUIREMENT_END, s.strip()))


def require_item(s: str) -> bool:
    line = bare(s).strip()
    if not line or len(line) >= 220 or line.lower() in (*R.SECTION_NAMES, "steading improvement"):
        return False
    if require_header(line) or require_end(line) or dice_alone(line) or matches(FORWARD_ROLL, line) or hit_points(line) or tag_line(line):
        return False
    return not (caps_label(line) and len(line.split()) <= 4)


def benefit_continues(s: str) -> bool:
    """Prose that goes on with what a met requirement brings."""
    line = s.strip()
    if not line or require_header(line) or caps_label(line) or line.lower() == "steading improvement" or dice_alone(line) or matches(FORWARD_ROLL, line):
        return False
    return line.lower().startswith(tuple(x.lower() for x in BENEFIT_OPENINGS)) or bool(matches(PLACE_GAINS, line)) or len(line) > 50 and not (heading(line) and len(line.split()) <= 5)


def toc_prose(s: str) -> bool:
    """The first body paragraph after a chapter's table of contents."""
    line = s.strip()
    n = lower_words(line)
    if len(line) >= 70 or len(line) >= 48 and (n >= 2 or n >= 1 and line.endswith((".", "!", "?"))):
        return True
    return len(line) >= 35 and line.lower().startswith(tuple(x.lower() for x in CHAPTER_OPENINGS))


def toc_garbage(s: str) -> bool:
    """Scraps of glued columns around a table of contents."""
    line = s.strip()
    soup = lower_words(line) >= 2 and not line.endswith((".", "!", "?", ":"))
    return not line or soup and (len(line.split()) >= 5 or len(line) > 42) or line.lower() in LONE_SHARDS


def _item_text(s: str) -> str:
    return re.sub(r"^[◇\s,]+", "", s.strip().lstrip(",").strip()).strip()


def pure_tags(s: str) -> bool:
    line = _item_text(s)
    if not line or len(line) > 90:
        return False
    parts = [p.strip().lower().rstrip("?") for p in re.split("[,;]", line.replace("◇", "")) if p.strip()]
    known = lambda p: p in T.ITEM_TAGS or exactly(r"^values?\s*\d+$", p) or exactly(T.ITEM_MEASURE, p) or re.sub(r"[\d+\s]", "", p) in T.ITEM_TAGS
    return bool(parts) and all(known(p) for p in parts)


def item_tags(s: str) -> bool:
    """An item's tag line: mostly italic and in short parts, or known tags alone."""
    if not s or s.startswith("\x02"):
        return False
    line = _item_text(plain(s))
    if not line or len(line) > 160:
        return False
    italic = sum(len(x) for x in re.findall(f"{R.ITALIC_ON}([^{R.ITALIC_OFF}]*){R.ITALIC_OFF}", s))
    if not italic:
        return pure_tags(line) and bool(re.sub("[\x02-\x07]", "", s).strip())
    shown = re.sub("[\x02-\x07]", "", s).strip()
    if not shown:
        return False
    size = max(1, len(re.sub(r"[◇\s,]+", " ", shown).strip()))
    if italic < max(3, size // 2):
        return pure_tags(line)
    words = line.replace("◇", "").strip(" ,")
    parts = [p.strip() for p in re.split("[,;]", words) if p.strip()]
    if matches("^" + ITALIC_PROSE, words) or not parts or words.endswith((".", "!", "…")) and len(words) > 48:
        return False
    return all(len(p) <= 40 and len(p.split()) <= 5 for p in parts) or pure_tags(line)


def page_furniture(s: str, y: float, page_height: float) -> bool:
    """A page number at the foot of a page."""
    return s.isdigit() and len(s) <= 3 and y > page_height - 40


def track_line(s: str) -> bool:
    """A label and steps that name dice, or nil."""
    return bool(matches(TRACK, s.strip()))


def mark_track(s: str) -> int:
    """How many marks a row of signs has, if it has two to twelve and nothing else."""
    n = len(re.findall("[lLoO□☐○●•·]", s))
    return n if re.fullmatch(r"[lLoO□☐○●•·\s]{2,}", s.strip()) and 2 <= n <= 12 else 0


def follower_name(s: str) -> bool:
    line = s.strip()
    return 0 < len(line) <= 50 and len(line.split()) <= 6 and line[0].isupper() and not line.endswith(".") and not line.lower().startswith("when you") and not hit_points(line) and not tag_line(line)


def section_key(s: str) -> str:
    t = re.sub("[\"'“”‘’]", "", s.strip().lower())
    return re.sub("[^a-z0-9]+", " ", re.sub(r"^(a|an|the)\s+", "", t)).strip()


def slug(s: str, empty: str = "") -> str:
    return re.sub("[^a-z0-9]+", "-", re.sub("['`]", "", s.lower())).strip("-") or empty


def split_tail(s: str) -> tuple[str, str]:
    """A text and the switches at its end."""
    body = s.rstrip(_SWITCHES)
    return body, s[len(body) :]


def split_head(s: str) -> tuple[str, str]:
    """The switches at a text's beginning, and the rest."""
    rest = s.lstrip(_SWITCHES)
    return s[: len(s) - len(rest)], rest


def seam(tail: str, head: str) -> str:
    """Switches where two texts meet; a style that ends and begins again there goes on."""
    pairs = (R.BOLD_OFF + R.BOLD_ON, R.ITALIC_OFF + R.ITALIC_ON)
    while tail and head and tail[-1] + head[0] in pairs:
        tail, head = tail[:-1], head[1:]
    return tail + head
