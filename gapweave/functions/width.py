"""How many columns a line takes, by the rules of three formatters and of a terminal.

Cells come from the Unicode data that Python ships (East Asian width, categories), not from tables of our own.
"""
from __future__ import annotations

import functools
import re
import unicodedata

#: The rulers; columns and tab where nothing is configured.
RULERS = ("prettier", "biome", "oxfmt")
COLUMNS, TAB = 80, 2
#: A keycap; pictographs with their modifiers and tags, joined by zero-width joiners.
_PICTURE = "[\U0001f000-\U0001faff☀-➿⬀-⯿⌚⌛⏩-⏺▪▫▶◀◻-◾←-⇿⌀-⏿⤴⤵〰〽㊗㊙©®‼⁉™ℹ]"
_PART = f"{_PICTURE}[️\U0001f3fb-\U0001f3ff]?(?:[\U000e0020-\U000e007e]*\U000e007f)?"
SEQUENCE = re.compile(f"[#*0-9]️?⃣|{_PART}(?:‍{_PART})*")


@functools.lru_cache(maxsize=4096)
def cells(c: str, ruler: str) -> int:
    """Of one character by itself; "terminal" is a ruler here too."""
    if " " <= c <= "~":
        return 1
    kind = unicodedata.category(c)
    if kind == "Cc":
        return 1 if ruler in ("oxfmt",) else 0
    if ruler == "prettier":  # only the common combining marks and variation selectors take no cell
        if "̀" <= c <= "ͯ" or "︀" <= c <= "️":
            return 0
    elif kind in ("Mn", "Me", "Cf") or "ᅠ" <= c <= "ᇿ":
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


def _sequenced(text: str, ruler: str) -> int:
    if text.isascii() and text.isprintable():
        return len(text)
    total, at = 0, 0
    while at < len(text):
        m = SEQUENCE.match(text, at)
        if m and m.end() - at > 1:
            total, at = total + 2, m.end()
        else:
            total, at = total + cells(text[at], ruler), at + 1
    return total


def measure(line: str, ruler: str = "prettier", tab: int = TAB) -> int:
    """Columns of a line.  The first ruler counts tabs only where they indent, the second knows no sequences, the third counts every tab."""
    if ruler == "biome":
        return sum(tab if c == "\t" else cells(c, ruler) for c in line)
    if ruler == "oxfmt":
        return tab * line.count("\t") + sum(_sequenced(p, ruler) for p in line.split("\t"))
    rest = line.lstrip(" \t")
    indent = sum(tab if c == "\t" else 1 for c in line[: len(line) - len(rest)])
    return indent + sum(_sequenced(p, ruler) for p in rest.split("\t"))


def terminal_columns(text: str) -> int:
    return sum(cells(c, "terminal") for c in text)
