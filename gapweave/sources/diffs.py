"""Unified diffs with full context as changed lines of each file, apart from what only moves braces.

sections() cuts a diff's lines into files with one window; changed() reads each file's section in an Arrow pass and gives rows
path, line, kind (line | deleted_after).  Lines are compared without the braces that may go, and a body that was joined to its header counts as unchanged.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.syntax import JS_SPACE

#: How far two sides may differ and still be aligned; numbers that a hunk's header can hold.
MOST_EDITS = 2000
MOST_NUMBER = 2**32
HUNK = r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@"
_WS = f"[{re.escape(JS_SPACE)}]*"
_W = "[A-Za-z0-9_]"
_LEAD = re.compile(rf"^({_WS})\}}{_WS}")
_OPEN = rf"(\)|(?<!{_W})(?:else|do)){_WS}\{{{_WS}"
_OPEN_LAST = re.compile(rf"{_OPEN}(?=$|//|/\*)")
_OPEN_ANY = re.compile(_OPEN)
_CLOSE = re.compile(rf"{_WS}\}}{_WS}(?=$|else(?!{_W})|while(?!{_W})|//|/\*|\}})")
_TEXTS = re.compile(r"""(/\*.*?\*/)|//|/\*|(["'`])((?:\\.|(?!\2)[^\\])*\\?)(\2|$)""", re.S)
_OPENS = re.compile(rf"(?:\)|(?<!{_W})(?:else|do))$")


def hunk_header(line) -> Column:
    """before, first, after of a hunk's header (1 where a count is absent); null if it isn't one that can be."""
    c = F.col(line) if isinstance(line, str) else line
    number = lambda i: F.regexp_extract(c, HUNK, i).try_cast("long")
    given = lambda i: F.regexp_extract(c, HUNK, i) != ""
    fits = F.lit(True)
    for i in (1, 2, 3, 4):
        fits = fits & (~given(i) | F.coalesce(number(i) < MOST_NUMBER, F.lit(False)))
    after = F.when(given(4), number(4)).otherwise(1)
    good = c.rlike(HUNK) & fits & ((number(3) > 0) | (given(4) & (number(4) == 0)))
    return F.when(good, F.struct(F.when(given(2), number(2)).otherwise(1).alias("before"), number(3).alias("first"), after.alias("after")))


def sections(lines: DataFrame, key: str) -> DataFrame:
    """key, section (from 1), rows array<string>: the lines (key, ord, value) of each file's part of a diff, in order."""
    w = Window.partitionBy(key).orderBy("ord")
    heads = lines.withColumn("_head", F.startswith("value", F.lit("diff --git ")))
    last = F.last(F.when(F.col("_head"), F.col("value")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    new = F.col("_head") & ~F.coalesce(last == F.col("value"), F.lit(False))  # a head that repeats belongs to the same file
    cut = heads.withColumn("section", F.sum(new.cast("int")).over(w)).filter("section > 0")
    return cut.groupBy(key, "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "value"))), lambda x: x["value"]).alias("rows"))


# -- lines without braces ---------------------------------------------------------------------------


def _split(line: str) -> tuple[str, str]:
    """Code with its texts emptied; and the texts (of strings and comments)."""
    code, text, at = [], [], 0
    for m in _TEXTS.finditer(line):
        code.append(line[at : m.start()])
        if m[1]:
            code.append(" ")
            text.append(m[1] + "\0")
        elif m[2]:
            code.append(m[2] + m[4])
            text.append(m[3] + "\0")
        else:  # a comment to the end of the line
            return "".join(code) + m[0], "".join(text) + line[m.end() :]
        at = m.end()
    return "".join(code) + line[at:], "".join(text)


def _bare(code: str) -> str:
    code = _LEAD.sub(r"\1", code)
    code = (_OPEN_ANY if code.rstrip(JS_SPACE).endswith("}") else _OPEN_LAST).sub(r"\1 ", code)
    return _CLOSE.sub(" ", code).rstrip(JS_SPACE)


def only_braces(line: str) -> bool:
    kept = line.strip(JS_SPACE + "{}")
    return not kept and ("{" in line or "}" in line)


def line_key(line: str) -> str:
    """Equal for lines that differ in braces alone."""
    if only_braces(line):
        return line
    code, text = _split(line.removesuffix("\r"))
    return f"{_bare(code)}\0{text}"


class Part:
    """A line as a part of a joined one."""

    def __init__(self, line: str):
        code, text = _split(line.removesuffix("\r"))
        bare = _bare(code)
        self.indent = code[: len(code) - len(code.lstrip(JS_SPACE))]
        self.code = re.sub(f"[{re.escape(JS_SPACE)}]+", " ", bare.strip(JS_SPACE))
        self.text, self.opens = text, bool(_OPENS.search(bare))


# -- alignment --------------------------------------------------------------------------------------


def _shortest(a: list, b: list) -> list[tuple[int, int]] | None:
    """Pairs of a shortest edit script, greedily by diagonals; None beyond MOST_EDITS edits."""
    n, m = len(a), len(b)
    if abs(n - m) > MOST_EDITS:
        return None
    if not set(a) & set(b):
        return [] if n + m <= MOST_EDITS else None
    far, history = {1: 0}, []
    for d in range(MOST_EDITS + 1):
        history.append(dict(far) if d else {})
        done = False
        for k in range(-d, d + 1, 2):
            x = far[k + 1] if k == -d or k != d and far[k - 1] < far[k + 1] else far[k - 1] + 1
            while x < n and x - k < m and a[x] == b[x - k]:
                x += 1
            far[k] = x
            if x >= n and x - k >= m:
                done = True
                break
        if done:
            break
    else:
        return None
    pairs, x, y = [], n, m
    for step in range(d, -1, -1):
        k, old = x - y, history[step]
        if step:
            down = k == -step or k != step and old[k - 1] < old[k + 1]
            px = old[k + 1] if down else old[k - 1]
            py = px - (k + 1 if down else k - 1)
            sx, sy = (px, py + 1) if down else (px + 1, py)
        else:
            px = py = sx = sy = 0
        while x > sx and y > sy:
            x, y = x - 1, y - 1
            pairs.append((x, y))
        x, y = px, py
    return pairs[::-1]


def aligned(before: list[str], after: list[str]) -> list[tuple[int, int]] | None:
    """Pairs of lines that are the same but for braces: those at either end, and a shortest edit script between."""
    a, b = [line_key(x) for x in before], [line_key(x) for x in after]
    head = 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(len(a), len(b)) - head and a[-1 - tail] == b[-1 - tail]:
        tail += 1
    middle = _shortest(a[head : len(a) - tail], b[head : len(b) - tail])
    if middle is None:
        return None
    ends = [(len(a) - tail + i, len(b) - tail + i) for i in range(tail)]
    return [(i, i) for i in range(head)] + [(x + head, y + head) for x, y in middle] + ends


def _grouped(before: list[str], lo: int, hi: int, after: list[str]) -> list[tuple[int, int, str]]:
    """Lines lo to hi as groups: first, last, and the line of `after` that joins them, or the line itself."""
    targets: dict[tuple[str, str, str], str] = {}
    longest = 0
    for line in after:
        p = Part(line)
        targets[p.indent, p.code, p.text] = line
        longest = max(longest, len(p.code))
    parts = [Part(x) for x in before[lo:hi]]
    out, i = [], 0
    while i < len(parts):
        p, last, found = parts[i], i, None
        if p.opens and (p.indent, p.code, p.text) not in targets:
            code, text, j = p.code, p.text, i + 1
            while j < len(parts) and len(code) < longest:
                q = parts[j]
                if q.code or q.text:
                    code += f" {q.code}" if q.code else ""
                    text += q.text
                    found = targets.get((p.indent, code, text))
                    if found is not None:
                        last = j
                        break
                    if not q.opens:
                        break
                j += 1
        out.append((lo + i, lo + last, before[lo + i] if found is None else found))
        i = last + 1
    return out


def _braces(line: str) -> int:
    return line.count("{") + line.count("}")


def _judge(before: list[str], after: list[str], numbers: list[int], at: int, lines: set[int], deleted: set[int]) -> bool:
    """Add what changed between two sides; False if they can't be aligned.  at: the line that stands before them."""
    anchors = aligned(before, after)
    if anchors is None:
        return False
    pairs: list[tuple[int, int, str, int]] = []  # first and last line before, what they are together, line after
    x = y = 0
    for ax, ay in [*anchors, (len(before), len(after))]:
        groups = _grouped(before, x, ax, after[y:ay]) if x < ax and y < ay else []
        if len(groups) < ax - x:
            pairs += [(groups[i][0], groups[i][1], groups[i][2], y + j) for i, j in aligned([g[2] for g in groups], after[y:ay]) or []]
        pairs.append((ax, ax, before[ax] if ax < len(before) else "", ay))
        x, y = ax + 1, ay + 1
    x = y = 0
    for first, last, text, py in pairs:
        if x < first:
            deleted.add(at)
        for y in range(y, py):
            at = numbers[y]
            lines.add(at)
        if first == len(before):
            break
        now, at = after[py], numbers[py]
        if text != now and _braces(now) >= _braces(text):
            lines.add(at)
        x, y = last + 1, py + 1
    return True


def section_changes(rows: list[str]) -> tuple[list[int], list[int]]:
    """Changed lines, and lines after which something was deleted, of one file's section."""
    whole: tuple[list[str], list[str], list[int]] = ([], [], [])
    blocks: list[tuple[list[str], list[str], list[int], int]] = []
    line = left = right = 0
    inside = False
    for row in rows:
        m = re.match(HUNK, row)
        if m:
            counts = [int(m[i]) if m[i] else 1 for i in (2, 4)]
            if max(*counts, int(m[1]), int(m[3])) < MOST_NUMBER and (int(m[3]) > 0 or m[4] and counts[1] == 0):
                (left, right), inside = counts, False
                line = int(m[3]) - (right != 0)
                continue
        if not left and not right:
            continue
        sign, text = row[:1], row[1:]
        if sign == " ":
            left, right, line, inside = left - 1, right - 1, line + 1, False
            whole[0].append(text)
            whole[1].append(text)
            whole[2].append(line)
        elif sign in ("-", "+"):
            if not inside:
                blocks.append(([], [], [], line))
                inside = True
            if sign == "+":
                right, line = right - 1, line + 1
                for side in (whole, blocks[-1]):
                    side[1].append(text)
                    side[2].append(line)
            else:
                left -= 1
                if not only_braces(text):
                    whole[0].append(text)
                    blocks[-1][0].append(text)
    lines: set[int] = set()
    deleted: set[int] = set()
    if not _judge(*whole, (whole[2][0] if whole[2] else 1) - 1, lines, deleted):
        for before, after, numbers, at in blocks:
            same = len(before) == len(whole[0]) and len(after) == len(whole[1])
            if same or not _judge(before, after, numbers, at, lines, deleted):
                deleted.update([at] if before else [])
                lines.update(numbers)
    return sorted(lines), sorted(x for x in deleted if x not in lines and x + 1 not in lines)


def changed(parts: DataFrame, key: str = "path", rows: str = "rows") -> DataFrame:
    """key, line, kind of each changed line; parts: key and rows, a section each."""
    schema = f"{key} {parts.schema[key].dataType.simpleString()}, line int, kind string"

    def go(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for f in frames:
            keys, lines, kinds = [], [], []
            for k, section in zip(f.column(0).to_pylist(), f.column(1).to_pylist(), strict=True):
                for kind, found in zip(("line", "deleted_after"), section_changes(section or []), strict=True):
                    keys += [k] * len(found)
                    lines += found
                    kinds += [kind] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(keys, f.column(0).type), pa.array(lines, pa.int32()), pa.array(kinds, pa.string())], names=[key, "line", "kind"])

    return parts.select(key, rows).mapInArrow(go, schema)
