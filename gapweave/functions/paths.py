"""Paths as text: resolving, relating, taking apart, showing and quoting them.  Plain column expressions throughout."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Escapes of single bytes; characters that make a path be quoted, and those a shell takes as they are.
ESCAPES = {0x07: "\\a", 0x08: "\\b", 0x09: "\\t", 0x0A: "\\n", 0x0B: "\\v", 0x0C: "\\f", 0x0D: "\\r", 0x22: '\\"', 0x5C: "\\\\"}
ODD = r'[\x00-\x1F\x7F-\x{9F}"\\\x{2028}\x{2029}]'
SHELL_PLAIN = r"^[A-Za-z0-9_@%+:,./-]+$"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def segments(path) -> Column:
    """The names of a path without empty ones and `.`; each `..` takes one away."""
    up = lambda acc: F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))
    step = lambda acc, x: F.when(x.isin("", "."), acc).when(x == "..", up(acc)).otherwise(F.concat(acc, F.array(x)))
    return F.aggregate(F.split(_col(path), "/", -1), F.array().cast("array<string>"), step)


def resolved(base, path) -> Column:
    """An absolute path: `path` itself if it is one, else below `base`."""
    whole = F.when(F.startswith(_col(path), F.lit("/")), _col(path)).otherwise(F.concat(_col(base), F.lit("/"), _col(path)))
    return F.concat(F.lit("/"), F.array_join(segments(whole), "/"))


def relative(start, path) -> Column:
    """The way from one absolute path to another; empty if they are the same."""
    a, b = segments(start), segments(path)
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, F.lit(False))  # from 1; 0 if all agree
    common = F.when(first > 0, first - 1).otherwise(F.size(same)).cast("int")
    up = F.array_repeat(F.lit(".."), F.size(a) - common)
    return F.array_join(F.concat(up, F.slice(b, common + 1, F.greatest(F.size(b) - common, F.lit(0)))), "/")


def directory(path) -> Column:
    p = _col(path)
    trimmed = F.regexp_replace(p, "/+$", "")
    head = F.regexp_replace(F.regexp_extract(trimmed, "^(.*)/[^/]*$", 1), "/+$", "")
    return F.when(~F.contains(trimmed, F.lit("/")), F.when(F.startswith(p, F.lit("/")), "/").otherwise(".")).when(head == "", "/").otherwise(head)


def name(path) -> Column:
    return F.regexp_extract(F.regexp_replace(_col(path), "/+$", ""), "([^/]*)$", 1)


def extension(path) -> Column:
    """From the last dot of the name on; empty without one, or if the name starts with its only one."""
    n = name(path)
    return F.when(n == "..", "").otherwise(F.regexp_extract(n, r"^.+(\.[^.]*)$", 1))


def quoted(text) -> Column:
    """In quotes, byte by byte: printable ASCII as it is, the rest as escapes or octal."""
    escapes = F.create_map(*[F.lit(x) for k, v in ESCAPES.items() for x in (f"{k:02X}", v)])
    code = lambda h: F.conv(h, 16, 10).cast("int")
    octal = lambda h: F.concat(F.lit("\\"), F.lpad(F.conv(h, 16, 8), 3, "0"))
    one = lambda h: F.coalesce(F.try_element_at(escapes, h), F.when(code(h).between(0x20, 0x7E), F.char(code(h))).otherwise(octal(h)))
    pairs = F.regexp_extract_all(F.hex(F.encode(_col(text), "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.concat(F.lit('"'), F.array_join(F.transform(pairs, one), ""), F.lit('"'))


def shown(path) -> Column:
    """Quoted if it holds control characters, quotes or backslashes; else as it is."""
    return F.when(_col(path).rlike(ODD), quoted(path)).otherwise(_col(path))


def shell_word(text) -> Column:
    t = _col(text)
    return F.when(t.rlike(SHELL_PLAIN), t).otherwise(F.concat(F.lit("'"), F.replace(t, F.lit("'"), F.lit("'\\''")), F.lit("'")))


def counted(n, noun: str) -> Column:
    """`1 file`, `2 files`."""
    return F.concat(_col(n).cast("string"), F.lit(f" {noun}"), F.when(_col(n) == 1, "").otherwise("s"))


def listed(names) -> Column:
    """`a`, `a and b`, `a, b and c` of an array."""
    n = _col(names)
    return F.when(F.size(n) < 2, F.array_join(n, "")).otherwise(F.concat(F.array_join(F.slice(n, F.lit(1), F.size(n) - 1), ", "), F.lit(" and "), F.element_at(n, -1)))
