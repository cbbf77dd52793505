"""Braces around a single statement: which may go, the edits that remove them, and where text lies before and after.

Removal repeats on the edited text until nothing is left to remove.  Offsets are characters.
"""
from __future__ import annotations

from bisect import bisect_left, bisect_right

from .syntax import JS_SPACE, NO_JSX, Source, Unreadable
from .width import measure

#: Statements that stand without braces; first characters that would go on with the statement before them.
ALONE = {"expression", "return", "throw", "break", "continue", "if", "for", "while", "do"}
GOES_ON = "([`+-/.<;"


def _word(c: str) -> bool:
    return c.isascii() and (c.isalnum() or c == "_")


def _in_name(c: str) -> bool:
    return c in ("\\", "$", "‌", "‍") or ("_" + c).isidentifier()


class Remover:
    """The braces of one reading of a text, and the edits that take some of them away."""

    def __init__(self, s: Source, columns: int, tab: int, ruler: str):
        self.s, self.text, self.limits = s, s.src, (columns, tab, ruler)
        self.gone: set[int] = set()

    # places
    def line(self, offset: int) -> int:
        return self.s.line(offset)

    def bounds(self, line: int) -> tuple[int, int]:
        """Where a line starts and where its line feed is."""
        return self.s.starts[line - 1], (self.s.starts[line] - 1 if line < len(self.s.starts) else len(self.text))

    def is_blank(self, line: int) -> bool:
        return not self.s.lines[line - 1].strip(JS_SPACE)

    def leads(self, offset: int) -> bool:
        return not self.text[self.bounds(self.line(offset))[0] : offset].strip(JS_SPACE)

    def below(self, line: int) -> int:
        while line < len(self.s.lines) and self.is_blank(line + 1):
            line += 1
        return line

    def above(self, line: int) -> int:
        while line > 1 and self.is_blank(line - 1):
            line -= 1
        return line

    def after(self, brace: int) -> int:
        """Offset of the token behind a closing brace, or the end."""
        k = self.s.m[brace] + 1
        return self.s.t.start[k] if k < self.s.n else len(self.text)

    # edits: (from, to, text)
    def opening(self, at: int) -> tuple[int, int, str]:
        line = self.line(at)
        a, b = self.bounds(line)
        last = self.below(line)
        if self.s.lines[line - 1].strip(JS_SPACE) == "{":
            return a, self.bounds(last + 1)[0] if last < len(self.s.lines) else len(self.text), ""
        if self.text[at + 1 : b].strip(JS_SPACE):
            return at, at + 1 + (self.text[at + 1] == " "), ""
        bare = self.text[a:at].rstrip(JS_SPACE.replace("\r", "").replace("\n", ""))
        end = at + 1 if last == line else self.bounds(last)[1] - self.s.lines[last - 1].endswith("\r")
        return a + len(bare), end, ""

    def closing(self, at: int) -> tuple[int, int, str]:
        line = self.line(at)
        _, b = self.bounds(line)
        if self.s.lines[line - 1].strip(JS_SPACE) == "}":
            return self.bounds(self.above(line))[0], min(b + 1, len(self.text)), ""
        if self.text[at + 1 : at + 2] == " " and self.text[at + 2 : at + 3] and _word(self.text[at + 2]):
            return at, at + 2, ""
        return at - (at > 0 and self.text[at - 1] == " "), at + 1, ""

    def blanks_before(self, at: int) -> list[tuple[int, int, str]]:
        """Blank lines above a closing brace that leads a line of more than itself."""
        line = self.line(at)
        first = self.above(line)
        if first == line or not self.leads(at) or self.s.lines[line - 1].strip(JS_SPACE) == "}":
            return []
        return [(self.bounds(first)[0], self.bounds(line)[0], "")]

    # what holds braces
    def stays_open(self, s: dict) -> bool:
        """An `if` without `else` ends the statement, so that an `else` behind it would be taken for its own."""
        while True:
            tail = s.get("tail")
            if tail == "open":
                return True
            if isinstance(tail, int):  # a block
                if tail not in self.gone:
                    return False
                tail = self.s.held[tail][0][0]
            if tail is None:
                return False
            s = tail

    def hold(self, brace: int) -> str | None:
        """Why a block keeps its braces: the first of eight reasons, or None."""
        s, text = self.s, self.text
        a, z = s.t.start[brace], s.t.end[s.m[brace]]
        own, count = s.held[a]
        if count != 1:
            return "count"
        if not own or own[0]["tag"] not in ALONE:
            return "statement"
        inner = own[0]
        after = self.after(brace)
        if text[inner["end"] - 1] != ";":
            apart = any(c in "\r\n" for c in text[z:after])
            if not apart and text[after : after + 1] == "}":
                if self.leads(z - 1):
                    return "closer"
            elif after < len(text) and not (apart and text[after] not in GOES_ON):
                return "continues"
        marks = s.t.comments[bisect_left(s.c_start, a + 1) : bisect_left(s.c_start, z)]
        if any(x < inner["start"] or y > inner["end"] for x, y in marks):
            return "comment"
        k = bisect_left(s.c_start, z)
        if k < len(s.c_start) and not text[z : s.c_start[k]].strip(JS_SPACE) and self.line(s.c_start[k]) == self.line(z - 1) and self.leads(z - 1):
            return "closing"
        if text.startswith("else", after) and not _word(text[after + 4 : after + 5] or " ") and self.stays_open(inner):
            return "else"
        for x, y, _ in (self.opening(a), self.closing(z - 1)):
            if x > 0 and y < len(text) and _in_name(text[x - 1]) and _in_name(text[y]):
                return "fuse"
        return None

    def reason(self, brace: int, why: str, at) -> str:
        """In words; `at` gives the line in the file of an offset."""
        s, text = self.s, self.text
        a, z = s.t.start[brace], s.t.end[s.m[brace]]
        own, count = s.held[a]
        if why == "count":
            return "the body holds %d statements" % count if count else "the body is empty"
        if why == "statement":
            return f"the body is {self.named(own[0]) if own else 'an empty statement'}, and only an expression, `return`, `throw`, `break`, `continue`, `if` or loop stands without braces"
        after = self.after(brace)
        if why == "continues":
            line = self.line(after)
            place = "the same line" if line == self.line(z - 1) else f"line {at(after)}"
            head = text[own[0]["start"] : own[0]["end"]].split("\n")[0].strip(JS_SPACE)
            return f"`{head}` has no semicolon, so without braces it could continue onto `{text[after : self.bounds(line)[1]].strip(JS_SPACE)}` on {place}"
        if why == "closer":
            return f"the closing brace on line {at(z - 1)} shares its line with the `}}` after it, which would be left behind without it"
        if why == "comment":
            first = next(x for x, y in s.t.comments[bisect_left(s.c_start, a + 1) :] if x < own[0]["start"] or y > own[0]["end"])
            return f"a comment on line {at(first)} sits inside the braces but outside the statement"
        if why == "closing":
            return f"a comment after the closing brace on line {at(s.c_start[bisect_left(s.c_start, z)])} would move onto the next line without it"
        if why == "else":
            return f"without braces, the `else` on line {at(after)} would attach to the `if` inside them"
        return "removing the braces would run two words together"

    def named(self, own: dict) -> str:
        """What a statement is called."""
        text = self.text[own["start"] : own["end"]]
        if own["tag"] == "label":
            return "a labeled statement"
        if text.startswith("{"):
            return "a nested block"
        n = 0
        while n < len(text) and text[n].isascii() and (text[n].isalnum() or text[n] in "_$"):
            n += 1
        return f"a `{text[:n]}` statement" if n else "a class declaration" if "class" in text.split("{")[0] else "a statement"

    # all of them
    def run(self, eligible: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int, str]], list[int]]:
        """Edits in order, and the offsets of the braces that they remove.  eligible: brace token, header and owner, inner ones first."""
        edits: list[tuple[int, int, str]] = []
        opened: dict[int, int] = {}
        for brace, _, _ in eligible:
            a, z = self.s.t.start[brace], self.s.t.end[self.s.m[brace]]
            if self.hold(brace) is None:
                self.gone.add(a)
                opened[a] = len(edits)
                edits += [self.opening(a), self.closing(z - 1), *self.blanks_before(z - 1)]
        order = sorted(range(len(edits)), key=lambda i: edits[i][0])
        ends = [edits[i][1] for i in order]
        for brace, header, _ in sorted(eligible, key=lambda e: -self.s.t.start[e[0]]):
            a = self.s.t.start[brace]
            joined = self.join(a, header) if a in self.gone else None
            if joined is None:
                continue
            plain, edits[opened[a]] = edits[opened[a]], joined
            last = self.s.held[a][0][0]["end"] - 1
            line = self.one_line(edits, order[bisect_right(ends, self.bounds(self.line(max(joined[0] - 1, 0)))[0]) :], self.bounds(self.line(max(joined[0] - 1, 0)))[0], self.bounds(self.line(last))[1])
            if line is None or measure(line, self.limits[2], self.limits[1]) > self.limits[0]:
                edits[opened[a]] = plain
        return sorted(edits), sorted(self.gone)

    def join(self, a: int, header: int) -> tuple[int, int, str] | None:
        """The edit that puts a body behind its header, if nothing between them has to stay."""
        inner = self.s.held[a][0][0]["start"]
        line = self.line(a)
        if self.line(inner) == line or self.text[a + 1 : self.bounds(line)[1]].strip(JS_SPACE):
            return None
        cut = len(self.text[:a].rstrip(JS_SPACE))
        k = bisect_left(self.s.c_start, cut) - 1
        if k >= 0 and self.s.t.comments[k][1] == cut and not self.text.startswith("/*", self.s.c_start[k]):
            return None
        return (cut, inner, " ") if self.line(header) == self.line(cut) else None

    def one_line(self, edits, order, lo: int, hi: int) -> str | None:
        """The text from lo to hi as edited; None if it isn't a single line, but for white space at its end."""
        parts, at = [], lo
        for i in order:
            x, y, new = edits[i]
            if x >= hi:
                break
            parts.append(self.text[at:x])
            if x >= at:
                parts.append(new)
            at = min(hi, max(at, y))
        whole = "".join(parts) + self.text[at:hi]
        first, *rest = whole.split("\n")
        return None if "".join(rest).strip(JS_SPACE) else first.rstrip(JS_SPACE)


class Moved:
    """Offsets through edits, which are in order and apart."""

    def __init__(self, edits: list[tuple[int, int, str]]):
        self.edits, self.placed, shift = edits, [], 0
        for a, b, new in edits:
            self.placed.append(a + shift)
            shift += len(new) - (b - a)
        self.starts = [a for a, _, _ in edits]

    def back(self, offset: int) -> int:
        k = bisect_right(self.placed, offset) - 1
        if k < 0:
            return offset
        a, b, new = self.edits[k]
        kept = self.placed[k] + len(new)
        return a if offset < kept else b + offset - kept

    def forward(self, offset: int) -> int:
        k = bisect_left(self.starts, offset) - 1
        if k < 0:
            return offset
        a, b, new = self.edits[k]
        return self.placed[k] + len(new) + max(0, offset - b)


def applied(text: str, edits: list[tuple[int, int, str]]) -> str:
    """text with the edits made; a line feed at its end that it didn't have is dropped again."""
    out, at = [], 0
    for a, b, new in edits:
        if a >= at:
            out += [text[at:a], new]
        at = max(at, b)
    done = "".join(out) + text[at:]
    if not text.endswith("\n") and done.endswith("\n"):
        done = done[:-1].removesuffix("\r")
    return done


class Changes:
    """Changed lines, and lines after which something was deleted; without them everything counts as changed."""

    def __init__(self, lines, deleted):
        self.lines, self.deleted = sorted(set(lines)), sorted(set(deleted))

    def touch(self, first: int, last: int) -> bool:
        k, j = bisect_left(self.lines, first), bisect_left(self.deleted, first)
        return k < len(self.lines) and self.lines[k] <= last or j < len(self.deleted) and self.deleted[j] < last

    def moved(self, old: Source, moved: Moved, new: Source) -> Changes:
        """The same in the edited text."""
        end = lambda line: old.starts[line] if line < len(old.starts) else len(old.src)

        def before(offset: int) -> int:
            line = new.line(min(offset, len(new.src)))
            return line - (new.starts[line - 1] == offset)

        lines: set[int] = set()
        deleted = {before(moved.forward(end(x))) for x in self.deleted}
        for x in self.lines:
            if 1 <= x <= len(old.starts):
                a, b = moved.forward(old.starts[x - 1]), moved.forward(end(x))
                if a == b:
                    deleted.add(before(a))
                else:
                    lines.update(range(new.line(a), new.line(max(min(b, len(new.src)) - 1, 0)) + 1))
        return Changes(lines, deleted)


def _in_reach(s: Source, changes: Changes, remove, read) -> list[tuple[int, int, int]]:
    """Blocks that changed lines reach: touched themselves, or part of a touched pair of statements, or of a short body that removal makes."""
    preview: list = []

    def whole():
        if not preview:
            edits, gone = remove(s, s.eligible)
            new = read(applied(s.src, edits))
            preview.append((Moved(edits), edits, gone, {x["start"] for x in new.stmts if x["compact"]}))
        return preview[0]

    def compact(x: dict) -> bool:
        if x["compact"]:
            return True
        moved, edits, _, starts = whole()
        lo = max(0, s.starts[x["start_line"] - 1] - 1)
        return any(a < x["end"] and b >= lo for a, b, _ in edits) and moved.forward(x["start"]) in starts

    owners: set[int] = set()
    blocks: set[int] = set()
    lists: dict[int, list[dict]] = {}
    for x in s.stmts:
        lists.setdefault(x["list_id"], []).append(x)
    for own in lists.values():
        for prev, nxt in zip(own, own[1:]):
            if not changes.touch(prev["start_line"], nxt["end_line"]):
                continue
            if not (own[0]["list_kind"] == "Block" and 2 <= len(own) <= 3 and all(map(compact, own))):
                owners.update((s.anchor(prev), s.anchor(nxt)))
                continue
            owners.update(map(s.anchor, own))
            if not all(x["compact"] for x in own):
                blocks.update(x for x in whole()[2] if own[0]["start"] <= x < own[-1]["end"])
            break
    start = s.t.start
    return [e for e in s.eligible if changes.touch(s.line(start[e[0]]), s.line(s.t.end[s.m[e[0]]] - 1)) or s.head(e[2]) in owners or start[e[0]] in blocks]


def settled(text: str, extension: str, marker: str, columns: int, tab: int, ruler: str, remove: bool = True, changes: Changes | None = None) -> tuple[Source, list[int], list[Moved], Changes | None]:
    """The reading of the text without the braces that may go (and that changed lines reach, if given), where each of them was in `text`, the way
    back, and the changed lines of the new text."""
    read = lambda t: Source(t, extension not in NO_JSX, marker, columns, tab, ruler)
    take = lambda s, eligible: Remover(s, columns, tab, ruler).run(eligible)
    s = read(text)
    found: list[int] = []
    backs: list[Moved] = []
    while remove:
        edits, starts = take(s, s.eligible if changes is None else _in_reach(s, changes, take, read))
        if not edits:
            break
        try:
            again = read(applied(s.src, edits))
        except (Unreadable, IndexError):  # what can't be read again is left as it was
            break
        found += [through(backs, x) for x in starts]
        backs.append(Moved(edits))
        changes = changes and changes.moved(s, backs[-1], again)
        s = again
    return s, found, backs, changes


def through(backs: list[Moved], offset: int) -> int:
    for m in reversed(backs):
        offset = m.back(offset)
    return offset


def explained(text: str, extension: str, marker: str, columns: int, tab: int, ruler: str, remove: bool = True) -> dict:
    """blocks: for each pair of braces that an if, else or loop controls its lines (open, close, owner, first and last of a single statement) and what becomes
    of it: removed (after how many rounds), covered by a directive, not meant by the rule, kept or free to go, and why.  off: lines of regions that are off."""
    read = lambda t: Source(t, extension not in NO_JSX, marker, columns, tab, ruler)
    first = s = read(text)
    rounds: list[tuple[Moved, set[int]]] = []
    while remove:
        edits, gone = Remover(s, columns, tab, ruler).run(s.eligible)
        if not edits:
            break
        rounds.append((Moved(edits), set(gone)))
        s = read(applied(s.src, edits))
    at = lambda offset: first.line(through([m for m, _ in rounds], offset))
    last = Remover(s, columns, tab, ruler)
    left = {s.t.start[e[0]]: e[0] for e in s.eligible}
    blocks = []
    for brace, _, owner in first.controlled:
        a, z = first.t.start[brace], first.t.end[first.m[brace]]
        own, count = first.held[a]
        one = own[0] if count == 1 and own else None
        state, why, offset = None, None, a
        for n, (moved, gone) in enumerate(rounds):
            if offset in gone:
                state, why = "removed", str(n)
                break
            offset = moved.forward(offset)
        if state is None:
            if offset not in left:
                state = "directive"
            else:
                hold = last.hold(left[offset])
                state = "free" if hold is None else "inapplicable" if hold == "count" else "kept"
                why = hold and last.reason(left[offset], hold, at)
        blocks.append({"open": first.line(a), "close": first.line(z - 1), "owner": first.line(owner), "first": one and first.line(one["start"]), "last": one and first.line(one["end"] - 1), "state": state, "why": why})
    return {"blocks": blocks, "off": [{"first": first.line(a), "last": first.line(max(b - 1, a))} for a, b in first.regions]}
