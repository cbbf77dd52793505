"""TypeScript and JavaScript text as tokens, statement lists and facts about statements; no tree is built.

`analyse(text, extension)` gives {"error", "stmts", "lists"}.  Brackets are matched once; statements are split by their first
word and by where a line may end, and function bodies inside expressions are found by what stands before their brace.  Names
are followed by scope, but types aren't told from values, and JSX with type arguments isn't understood.
Empty text: one empty Module list.  Text that doesn't balance, or a carriage return without line feed: error, no statements.
"""
from __future__ import annotations

import re
import sys
import threading
from bisect import bisect_right
from collections.abc import Callable

from .width import COLUMNS, TAB, measure

EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
NO_JSX = ("ts", "mts", "cts")
#: Levels of nesting beyond which a file counts as unreadable; the time for names read grows with levels times tokens.
DEEPEST = 1500
#: White space of the language; words that make a comment a linter's directive; what marks a clause that falls through.
JS_SPACE = "\t\n\v\f\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LINT_WORDS = ("eslint-disable-next-line", "eslint-disable-line", "eslint-disable", "eslint-enable", "eslint-env", "eslint", "exported", "global", "globals")
FALLS = ("falls through", "fall through", "fallsthrough", "fallthrough")
KEYWORDS = set(
    "if else for while do switch case default try catch finally return throw break continue const let var function class new typeof instanceof in of void delete await yield this super null true false import export extends async static debugger with as satisfies".split()
)
#: Words after which an operand is expected, so that a slash starts a pattern and a line doesn't end the statement.
BEFORE_OPERAND = set("return typeof instanceof in of new delete void throw case do else await yield extends as satisfies default".split())
HOLDS_LINE = BEFORE_OPERAND - {"return", "throw", "yield", "do", "else", "default"}
JUMPS = {"return": "Return", "throw": "Throw", "break": "Break", "continue": "Continue"}
ASSIGN = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "&&=", "||=", "??=", "&=", "|=", "^=", "<<="}
PIECE = re.compile(
    r"(?P<space>[\s﻿]+)|(?P<line>//[^\n\r  ]*)|(?P<block>/\*[\s\S]*?\*/)|(?P<id>#?[^\W\d][\w$]*|#?\$[\w$]*)"
    r"|(?P<num>\.?\d(?:[eE][+-]?\d|[\w.])*)|(?P<str>\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*')"
    r"|(?P<p>\?\.(?!\d)|=>|\.\.\.|\*\*=?|&&=?|\|\|=?|\?\?=?|===?|!==?|<<=?|<=|\+\+|--|[-+*/%&|^]=|[-+*/%&|^~!<>=?:;,.@(){}\[\]#\\])"
)
PATTERN = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[\w$]*")


class Unreadable(ValueError):
    pass


class Tokens:
    def __init__(self, text: str, jsx: bool):
        self.src, self.jsx, self.at, self.depth = text, jsx, 0, 0
        self.kind, self.start, self.end, self.word = [], [], [], []
        self.comments: list[tuple[int, int]] = []
        if text.startswith("#!"):
            self.at = len(text.split("\n", 1)[0])
            self.comments.append((0, self.at))
        self.run(False)
        self.match = self.matched()

    def add(self, kind: str, start: int, end: int, word: str | None = None) -> None:
        self.kind.append(kind)
        self.start.append(start)
        self.end.append(end)
        self.word.append(self.src[start:end] if word is None else word)

    def operand_before(self) -> bool:
        if not self.kind:
            return False
        k, w = self.kind[-1], self.word[-1]
        return w in (")", "]", "}", "$}") if k == "p" else not (k == "id" and w in BEFORE_OPERAND)

    def run(self, inside: bool) -> None:
        """Tokens up to the end, or (inside) up to the brace that closes what the caller opened."""
        self.depth += 1
        if self.depth > DEEPEST:
            raise Unreadable("nested too deeply")
        src, open_braces = self.src, 0
        while self.at < len(src):
            a, c = self.at, src[self.at]
            if c == "`":
                self.template()
                continue
            if c == "/" and src[a + 1 : a + 2] not in ("/", "*") and not self.operand_before():
                found = PATTERN.match(src, a)
                if found:
                    self.at = found.end()
                    self.add("re", a, self.at)
                    continue
            if c == "<" and self.jsx and not self.operand_before() and re.match(r"<(?:>|[A-Za-z_$](?![\w$]*(?:,|\s+extends\b)))", src[a:]):
                self.markup()
                continue
            if c == "}" and inside and not open_braces:
                self.depth -= 1
                return
            found = PIECE.match(src, a)
            if not found:
                raise Unreadable(f"unexpected character at {a}")
            self.at, what = found.end(), found.lastgroup
            if re.search(r"\r(?!\n)", found.group()):
                raise Unreadable("carriage return without line feed")
            if what in ("line", "block"):
                self.comments.append((a, self.at))
            elif what != "space":
                self.add(what, a, self.at)
                open_braces += (c == "{") - (c == "}")
        if inside:
            raise Unreadable("unexpected end")
        self.depth -= 1

    def template(self) -> None:
        src, a, first = self.src, self.at, True
        i = a + 1
        while i < len(src):
            if src[i] == "\\":
                i += 2
            elif src[i] == "`":
                self.at = i + 1
                self.add("tpl" if first else "p", a, i + 1, None if first else "$}")
                return
            elif src.startswith("${", i):
                if not first:
                    self.add("p", a, a + 1, "$}")
                self.add("p", a if first else i, i + 2, "${")
                self.at, first = i + 2, False
                self.run(True)
                a = self.at
                i = a + 1
            else:
                i += 1
        raise Unreadable("unterminated template")

    def held(self) -> None:
        """A braced expression within markup."""
        self.add("p", self.at, self.at + 1)
        self.at += 1
        self.run(True)
        self.add("p", self.at, self.at + 1)
        self.at += 1

    def markup(self) -> None:
        src, depth, a = self.src, 0, self.at
        while self.at < len(src):
            closing, slash = src.startswith("</", self.at), False
            self.at += 1 + closing
            while self.at < len(src) and src[self.at] != ">":
                c = src[self.at]
                if c in "\"'":
                    self.at = src.find(c, self.at + 1) + 1 or len(src)
                elif c == "{":
                    self.add("jsx", a, self.at)
                    self.held()
                    a = self.at
                else:
                    self.at += 1
                slash = c == "/"
            self.at += 1
            depth += -1 if closing else 0 if slash else 1
            if depth <= 0:
                self.add("jsx", a, self.at)
                return
            while self.at < len(src) and src[self.at] != "<":
                if src[self.at] == "{":
                    self.add("jsx", a, self.at)
                    self.held()
                    a = self.at
                else:
                    self.at += 1
        raise Unreadable("unterminated element")

    def matched(self) -> list[int]:
        pairs, stack, out = {")": "(", "]": "[", "}": "{", "$}": "${"}, [], [-1] * len(self.kind)
        for i, (k, w) in enumerate(zip(self.kind, self.word)):
            if k != "p":
                continue
            if w in ("(", "[", "{", "${"):
                stack.append(i)
            elif w in pairs:
                if not stack or self.word[stack[-1]] != pairs[w]:
                    raise Unreadable(f"unexpected {w} at {self.start[i]}")
                out[stack[-1]] = i
                out[i] = stack.pop()
        if stack:
            raise Unreadable("unexpected end")
        return out


class Places:
    """Lines and columns of offsets."""

    def __init__(self, text: str):
        self.src, self.starts = text, [0] + [i + 1 for i, c in enumerate(text) if c == "\n"]

    def line(self, offset: int) -> int:
        return bisect_right(self.starts, offset)

    def column(self, offset: int) -> int:
        return len(self.src[self.starts[self.line(offset) - 1] : offset].encode("utf-16-le", "surrogatepass")) // 2 + 1


class Source(Places):
    def __init__(self, text: str, jsx: bool, marker: str, columns: int = COLUMNS, tab: int = TAB, ruler: str = "prettier"):
        self.src, self.t, self.marker, self.columns, self.depth = text, Tokens(text, jsx), marker, columns, 0
        self.tab, self.ruler, self.empty = tab, ruler, 0
        #: Blocks that an if, else or loop controls: token of the brace, offsets of header and owner; inner ones first.
        self.eligible: list[tuple[int, int, int]] = []
        #: All of them, also those that directives cover; and the regions that are off.
        self.controlled: list[tuple[int, int, int]] = []
        self.regions: list[tuple[int, int]] = []
        #: By offset of its brace: statements of a block, and how many there are with empty ones.
        self.held: dict[int, tuple[list[dict], int]] = {}
        #: Offsets of alternates and labelled statements, by owner: an ignored owner passes that on to them.
        self.heirs: dict[int, list[int]] = {}
        #: By offset of a label: the statement behind it.
        self.labels: dict[int, int] = {}
        #: By offset of an if that is an alternate: the if above it.
        self.above: dict[int, int] = {}
        self.n, self.m = len(self.t.kind), self.t.match
        Places.__init__(self, text)
        self.lines = text.split("\n")
        self.c_start = [a for a, _ in self.t.comments]
        self.lists: list[dict] = []
        self.stmts: list[dict] = []
        self.bodies: set[int] = set()
        self.operations: list[tuple[int, str]] = []
        self.body(0, self.n, "Module", None, 0, len(text))
        self.freeze()

    def w(self, i: int) -> str:
        """The word at token i; quoted text can't be taken for one."""
        return self.t.word[i] if 0 <= i < self.n and self.t.kind[i] in ("id", "p") else ""

    def breaks(self, i: int) -> bool:
        """A line ends between token i - 1 and token i."""
        return "\n" in self.src[self.t.end[i - 1] : self.t.start[i]]

    # lists
    def body(self, i: int, j: int, kind: str, brace: int | None, start: int, limit: int, items=None) -> list[dict]:
        """Record the list of the statements from token i to j, and all lists within it."""
        self.depth += 1
        if self.depth > DEEPEST:
            raise Unreadable("nested too deeply")
        number = len(self.lists)
        self.lists.append({})
        own = items(i, j) if items else self.sequence(i, j)
        if brace is not None:
            self.held[self.t.start[brace]] = (own, len(own) + self.empty)
        self.attach(own, start, limit)
        for at, s in enumerate(own):
            s |= {"list_id": number, "idx": at, "list_kind": kind}
        self.stmts += own
        first_line, close_line = self.line(start), self.line(max(limit - 1, 0))
        open_line = first_line
        if brace is not None:  # comments that share the opening line belong to it
            for a, b in self.t.comments[bisect_right(self.c_start, start) :]:
                if self.line(a) != first_line or a >= limit:
                    break
                open_line = self.line(b - 1)
        self.lists[number] = {"list_id": number, "braced": brace is not None, "open_line": open_line, "start": start, "limit": limit, "first_line": next((x for x in own[0]["tops"] if x > open_line), own[0]["line"]) if own else None, "last_line": own[-1]["bottom_line"] if own else None, "close_line": close_line, "start_line": first_line, "own": own}
        self.depth -= 1
        return own

    def block(self, i: int, function: bool = False) -> list[dict]:
        if function:
            self.bodies.add(i)
        return self.body(i + 1, self.m[i], "Block", i, self.t.start[i], self.t.end[self.m[i]])

    def sequence(self, i: int, j: int, stop: tuple[str, ...] = ()) -> list[dict]:
        out, empty = [], 0
        while i < j and not (self.w(i) in stop and self.w(i + 1) != "."):
            s = self.statement(i, j)
            if s["end"] <= i:
                raise Unreadable(f"no statement at {self.t.start[i]}")
            if self.w(i) != ";":
                out.append(self.finished(s, i))
            else:
                empty += 1
            i = s["end"]
        self.empty = empty
        return out

    def control(self, brace: int, header: int, owner: int) -> None:
        if self.w(brace) == "{":
            self.eligible.append((brace, self.t.start[header], self.t.start[owner]))
            self.controlled.append(self.eligible[-1])

    def head(self, owner: int) -> int:
        """Where the chain of ifs that an owner belongs to starts."""
        while owner in self.above:
            owner = self.above[owner]
        return owner

    def anchor(self, s: dict) -> int:
        """Where a statement starts, behind its labels."""
        at = s["start"]
        while at in self.labels:
            at = self.labels[at]
        return at

    def tail(self, body: int, s: dict):
        """How a statement ends: with the block at an offset, or with that statement."""
        return self.t.start[body] if self.w(body) == "{" else s

    def cases(self, i: int, j: int) -> list[dict]:
        out = []
        while i < j:
            colon, open_questions = i + 1, 0
            while colon < j and not (self.w(colon) == ":" and not open_questions):
                open_questions += (self.w(colon) == "?") - (self.w(colon) == ":")
                colon = self.m[colon] + 1 if self.w(colon) in ("(", "[", "{", "${") else colon + 1
            e = colon + 1
            while e < j and self.w(e) not in ("case", "default"):
                e = self.m[e] + 1 if self.w(e) in ("(", "[", "{", "${") else e + 1
            limit = self.t.end[e - 1]
            held = self.body(colon + 1, e, "Block", None, self.t.start[min(colon, self.n - 1)], limit)
            out.append(self.finished({"end": e, "kind": "Case", "case_body": bool(held)}, i))
            i = e
        return out

    # statements
    def statement(self, i: int, j: int) -> dict:
        w, nxt, m = self.w(i), self.w(i + 1), self.m
        if w == "{":
            return {"end": m[i] + 1, "kind": "Other", "held": self.block(i)}
        if w == ";":
            return {"end": i + 1, "kind": "Other"}
        if w == "if" and nxt == "(":
            self.inner(i + 2, m[i + 1])
            then = self.statement(m[i + 1] + 1, j)
            e = then["end"]
            arms = [(i, m[i + 1] + 1, then)]
            if self.w(e) == "else" and e < j:
                other = self.statement(e + 1, j)
                more = other.get("arms") if other["kind"] == "If" else None
                self.control(m[i + 1] + 1, i, i)
                self.control(e + 1, e, i)
                self.heirs.setdefault(self.t.start[i], []).append(self.t.start[e + 1])
                if other["kind"] == "If":
                    self.above[self.t.start[e + 1]] = self.t.start[i]
                return {"end": other["end"], "kind": "If", "tag": "if", "tail": self.tail(e + 1, other), "arms": arms + ([(e, *more[0][1:]), *more[1:]] if more else [(e, e + 1, other)])}
            held = then.get("held")
            one = held is None or len(held) == 1
            jump = (held[0]["kind"] if held else then["kind"]) if one else None
            self.control(m[i + 1] + 1, i, i)
            return {"end": e, "kind": "If", "tag": "if", "tail": "open", "guard": one, "jump": jump if jump in JUMPS.values() else None, "arms": arms}
        if w in ("for", "while") and (nxt == "(" or nxt == "await"):
            p = i + 1 if nxt == "(" else i + 2
            self.inner(p + 1, m[p])
            then = self.statement(m[p] + 1, j)
            self.control(m[p] + 1, i, i)
            return {"end": then["end"], "kind": "Loop", "tag": w, "tail": self.tail(m[p] + 1, then), "arms": [(i, m[p] + 1, then)]}
        if w == "with" and nxt == "(":
            then = self.statement(m[i + 1] + 1, j)
            return {"end": then["end"], "kind": "Other", "tag": "with", "tail": self.tail(m[i + 1] + 1, then)}
        if w == "do":
            e = self.statement(i + 1, j)["end"]
            self.control(i + 1, i, i)
            if self.w(e) == "while":
                self.inner(e + 2, m[e + 1])
                e = m[e + 1] + 1
            return {"end": e + (self.w(e) == ";"), "kind": "Loop", "tag": "do"}
        if w == "switch" and nxt == "(":
            self.inner(i + 2, m[i + 1])
            b = m[i + 1] + 1
            self.body(b + 1, m[b], "Switch", None, self.t.end[m[i + 1]] - 1, self.t.end[m[b]], self.cases)
            return {"end": m[b] + 1, "kind": "Switch"}
        if w == "try" and nxt == "{":
            self.block(i + 1)
            e, last = m[i + 1] + 1, (0, 0)
            while self.w(e) in ("catch", "finally") and e < j:
                b = m[e + 1] + 1 if self.w(e + 1) == "(" else e + 1
                self.block(b)
                last, e = (b, m[b]) if self.w(e) == "finally" else last, m[b] + 1
            return {"end": e, "kind": "Try", "finally_ops": [x for k, x in self.operations if last[0] < k < last[1]]}
        if w == "@":
            e = i + 2
            while self.w(e) in (".", "("):
                e = m[e] + 1 if self.w(e) == "(" else e + 2
            return self.statement(e, j) | {"kind": "Other"}
        if w == "export":
            return self.exported(i, j)
        if w == "import" and nxt not in ("(", "."):
            e = self.expression_end(i, j)
            return {"end": e, "kind": "Import" if self.t.kind[i + 1] == "str" or "from" in (self.w(k) for k in range(i, e)) else "Other"}
        if w == "async" and nxt == "function":
            return self.function(i, i + 1, j)
        if w == "function":
            return self.function(i, i, j)
        if w in ("const", "let", "var"):
            if w == "const" and nxt == "enum":
                return self.braced(i, j)
            e = self.expression_end(i, j)
            self.inner(i, e)
            return {"end": e, "kind": "Declaration", "is_let": w == "let", "names": self.declared(i + 1, e)}
        if w in ("class", "interface", "enum", "namespace", "module") and self.t.kind[min(i + 1, self.n - 1)] in ("id", "str") or w == "abstract" and nxt == "class" or w == "class":
            return self.braced(i, j)
        if w == "declare" and i + 1 < j and self.t.kind[i + 1] == "id" and not self.breaks(i + 1):
            return self.statement(i + 1, j)
        if w == "type" and i + 2 < j and self.t.kind[i + 1] == "id" and self.w(i + 2) in ("=", "<"):
            return {"end": self.expression_end(i, j), "kind": "Other"}
        if self.t.kind[i] == "id" and nxt == ":" and w not in KEYWORDS:
            then = self.statement(i + 2, j)
            self.heirs.setdefault(self.t.start[i], []).append(self.t.start[i + 2])
            self.labels[self.t.start[i]] = self.t.start[i + 2]
            return {"end": then["end"], "kind": "Other", "tag": "label", "tail": self.tail(i + 2, then)}
        e = self.expression_end(i, j)
        self.inner(i, e)
        names = [] if w in JUMPS else self.assigned(i, e)
        operation = self.operation(i, e, names)
        self.operations += [(i, operation)] if operation else []
        return {"end": e, "kind": JUMPS.get(w, "Other"), "tag": w if w in JUMPS else "debugger" if w == "debugger" else "expression", "names": names, "operation": operation}

    def exported(self, i: int, j: int) -> dict:
        nxt = self.w(i + 1)
        if nxt in ("*", "{") or nxt == "type" and self.w(i + 2) in ("*", "{"):
            e = self.expression_end(i, j)
            return {"end": e, "kind": "Import" if "from" in (self.w(k) for k in range(i, e)) else "Other"}
        if nxt == "default":
            s = self.statement(i + 2, j)
            return s | {"kind": "Function" if s["kind"] == "Function" else "Other"}
        return self.statement(i + 1, j) if nxt not in ("=", "as") else {"end": self.expression_end(i, j), "kind": "Other"}

    def function(self, i: int, at: int, j: int) -> dict:
        p = at
        while p < j and self.w(p) != "(":
            p += 1
        if p >= j:
            raise Unreadable("function without parameters")
        self.inner(p + 1, self.m[p])
        e = self.m[p] + 1
        if self.w(e) == ":":
            e = self.type_end(e + 1, j)
        if self.w(e) == "{" and e < j:
            self.block(e, True)
            return {"end": self.m[e] + 1, "kind": "Function", "root": e, "params": (p + 1, self.m[p])}
        return {"end": self.expression_end(i, j), "kind": "Other"}  # a signature

    def braced(self, i: int, j: int) -> dict:
        e = i
        while e < j and self.w(e) != "{":
            e = self.m[e] + 1 if self.w(e) in ("(", "[") else e + 1
        if e >= j:
            return {"end": self.expression_end(i, j), "kind": "Other"}
        if "class" in (self.w(i), self.w(i + 1)):
            self.inner(i, self.m[e])
        return {"end": self.m[e] + 1, "kind": "Other"}

    def expression_end(self, i: int, j: int) -> int:
        """Past the semicolon, or where a line end closes the statement."""
        t, k = self.t, i
        while k < j:
            w = self.w(k)
            if w == ";":
                return k + 1
            if k > i and self.breaks(k) and not self.goes_on(k):
                return k
            k = self.m[k] + 1 if w in ("(", "[", "{", "${") and t.kind[k] == "p" else k + 1
        return j

    def goes_on(self, k: int) -> bool:
        before, after = self.w(k - 1), self.w(k)
        ends = self.t.kind[k - 1] != "p" or before in (")", "]", "}", "$}", "++", "--")
        if before in JUMPS or not ends:
            return before not in JUMPS
        if self.t.kind[k - 1] == "id" and before in HOLDS_LINE:
            return True
        if self.t.kind[k] == "id":
            return after in ("instanceof", "in", "of", "as", "satisfies", "extends", "from")
        if self.t.kind[k] == "tpl":
            return True
        return self.t.kind[k] == "p" and after not in ("{", "}", "++", "--", "!", "~", "@", "#")

    def type_end(self, i: int, j: int) -> int:
        while i < j:
            w = self.w(i)
            if w in ("|", "&") or self.t.kind[i] == "id" and w in ("typeof", "keyof", "readonly", "unique", "asserts", "infer", "new", "abstract"):
                i += 1
                continue
            if w == "(":
                i = self.m[i] + 1
                if self.w(i) == "=>":
                    i += 1
                    continue
            elif w in ("{", "[", "${"):
                i = self.m[i] + 1
            elif self.t.kind[i] in ("id", "str", "num", "tpl"):
                i += 1
            else:
                return i
            while i < j:
                if self.w(i) == "<":
                    open_angles = 0
                    while i < j:
                        open_angles += (self.w(i) == "<") - (self.w(i) == ">")
                        i = self.m[i] + 1 if self.w(i) in ("(", "[", "{") else i + 1
                        if not open_angles:
                            break
                elif self.w(i) == "[" and not self.breaks(i):
                    i = self.m[i] + 1
                elif self.w(i) == ".":
                    i += 2
                else:
                    break
            if self.w(i) in ("|", "&") or self.w(i) in ("is", "extends"):
                i += 1
                continue
            return i
        return i

    def inner(self, i: int, j: int) -> None:
        """Record the function bodies within an expression or a class."""
        k = i
        while k < j:
            w, before = self.w(k), self.w(k - 1) if k > i else ""
            if w == "{" and before in (")", "=>", "static"):
                self.block(k, True)
                k = self.m[k] + 1
                continue
            if w == ")" and self.w(k + 1) == ":":
                e = self.type_end(k + 2, j)
                if e < j and self.w(e) == "{":
                    self.block(e, True)
                    k = self.m[e] + 1
                    continue
            k += 1

    # names
    def parts(self, i: int, j: int):
        """Spans between commas of the same depth."""
        a = k = i
        while k < j:
            if self.w(k) == ",":
                yield a, k
                a = k + 1
            k = self.m[k] + 1 if self.w(k) in ("(", "[", "{", "${") else k + 1
        if a < j:
            yield a, j

    def pattern(self, i: int, j: int) -> list[str]:
        while i < j and self.w(i) in ("...", "public", "private", "protected", "readonly") and i + 1 < j:
            i += 1
        if i >= j:
            return []
        if self.w(i) in ("{", "["):
            out = []
            for a, b in self.parts(i + 1, self.m[i]):
                keyed = self.w(i) == "{" and next((k for k in range(a, b) if self.w(k) == ":" and (k == a + 1 or self.w(k - 1) == "]")), None)
                out += self.pattern(keyed + 1 if keyed else a, b)
            return out
        return [self.t.word[i]] if self.t.kind[i] == "id" else []

    def declared(self, i: int, j: int) -> list[str]:
        return [n for a, b in self.parts(i, j) for n in self.pattern(a, b)]

    def path(self, i: int, j: int) -> tuple[str, int]:
        """The member path that starts at token i, as a.b[k], and where it ends."""
        out = self.t.word[i]
        k = i + 1
        while k < j:
            if self.w(k) in (".", "?.") and k + 1 < j and self.t.kind[k + 1] == "id":
                out += "." + self.t.word[k + 1]
                k += 2
            elif self.w(k) == "!" and self.w(k + 1) in (".", "[", "="):
                k += 1
            elif self.w(k) == "[" and not self.breaks(k):
                out += self.src[self.t.start[k] : self.t.end[self.m[k]]]
                k = self.m[k] + 1
            else:
                break
        return out, k

    def assigned(self, i: int, e: int) -> list[str]:
        if self.w(i) in ("[", "{") and self.w(self.m[i] + 1) == "=":
            return self.pattern(i, e)
        if self.w(i) == "(" and (self.m[i] == i + 2 or self.w(i + 2) in ("as", "satisfies")):  # a path whose base is asserted
            rest, k = self.path(self.m[i], e)
            name = self.t.word[i + 1] + rest[1:]
            return [name] if self.t.kind[i + 1] == "id" and self.w(k) in ASSIGN else []
        if self.t.kind[i] != "id" or self.w(i) in KEYWORDS - {"this", "super"}:
            return []
        name, k = self.path(i, e)
        return [name] if self.w(k) in ASSIGN else []

    def operation(self, i: int, e: int, names: list[str]) -> str | None:
        """What a plain statement does: a call of a path, or an assignment to one."""
        i += self.w(i) == "await"
        if self.t.kind[i] != "id" or self.w(i) in KEYWORDS - {"this", "super"}:
            return None
        name, k = self.path(i, e)
        if self.w(k) == "(" and self.m[k] + 1 >= e - (self.w(e - 1) == ";"):
            return f"call:{name}"
        return f"assign:{name}" if names == [name] else None

    def arrow_end(self, k: int, j: int) -> int:
        if self.w(k) == "{":
            return self.m[k] + 1
        while k < j and self.w(k) not in (",", ";", ")", "]", "}", "$}"):
            k = self.m[k] + 1 if self.w(k) in ("(", "[", "{", "${") else k + 1
        return k

    def scopes(self, i: int, j: int) -> list[tuple[int, int, set[str]]]:
        """Names declared within a statement and the tokens they cover."""
        out, stack = [], []
        for k in range(i, j):
            w = self.w(k)
            if w == "{":
                stack.append(k)
            elif w == "}" and stack:
                stack.pop()
            elif self.t.kind[k] == "id" and self.w(k - 1) not in (".", "?."):
                a, b = (stack[-1], self.m[stack[-1]]) if stack else (i, j)
                if w in ("const", "let", "var") and k > i:
                    out.append((a, b, set(self.declared(k + 1, min(self.expression_end(k, b), b)))))
                elif w in ("function", "class") and k > i and k + 1 < j and self.t.kind[k + 1] == "id" and stack:
                    out.append((a, b, {self.t.word[k + 1]}))
                elif w == "catch" and self.w(k + 1) == "(":
                    body = self.m[k + 1] + 1
                    out.append((k, self.m[body], set(self.pattern(k + 2, self.m[k + 1]))))
        return out

    def reads(self, i: int, j: int, root: int | None, params: tuple[int, int] | None) -> list[str]:
        """Free names and member paths in order of appearance; functions within the statement aren't entered, but for `root`."""
        hidden = self.scopes(i, j)
        if params:
            hidden.append((i, j, set(self.declared(*params))))
        out: dict[str, None] = {}
        k = i
        while k < j:
            w, kind = self.w(k), self.t.kind[k]
            if w == "(" and kind == "p":
                a = self.m[k] + 1
                if self.w(a) == ":":
                    e = self.type_end(a + 1, j)
                    a = e if self.w(e) == "=>" or e in self.bodies else a
                if self.w(a) == "=>" and a < j:
                    k = self.arrow_end(a + 1, j)
                    continue
                if a in self.bodies and a != root:
                    k = self.m[a] + 1
                    continue
            if kind == "id" and self.w(k + 1) == "=>":
                k = self.arrow_end(k + 2, j)
                continue
            if kind == "jsx":
                for name in re.findall(r"<\s*([A-Za-z_$][\w$]*(?:\.[\w$]+)*)(?![\w$:-])", self.t.word[k]):
                    base = name.split(".")[0]
                    if ("." in name or not "a" <= name[0] <= "z") and not any(a <= k < b and base in names for a, b, names in hidden):
                        marks = [x.start() for x in re.finditer(r"\.", name)] + [len(name)]
                        out.update(dict.fromkeys(name[:x] for x in marks))
            key = self.w(k + 1) == ":" and self.w(k - 1) in ("{", ",")
            if kind == "id" and (w not in KEYWORDS or w in ("this", "super")) and self.w(k - 1) not in (".", "?.") and not key:
                if not any(a <= k < b and w in names for a, b, names in hidden):
                    whole, _ = self.path(k, j)
                    marks = [x.start() for x in re.finditer(r"[.\[]", whole)] + [len(whole)]
                    for x in marks[: 1 if w not in ("this", "super") else 2] + marks[1:]:
                        out.setdefault(whole[:x])
            k += 1
        return list(out)

    # facts and comments
    def arm(self, i: int, body: int, s: dict) -> str | None:
        """The header at token i and its body without braces as one line; None if it can't be one."""
        head = self.src[self.t.start[i] : self.t.start[body]]
        if "held" in s or "\n" in head.rstrip() or head.count("\n") > 1 or "//" in head or "/*" in head:
            return None
        a, b = self.t.start[body], self.t.end[s["end"] - 1]
        one = self.src[a:b] if self.line(a) == self.line(b - 1) else self.arm(*s["arms"][0]) if len(s.get("arms") or ()) == 1 else None
        return None if one is None else head.rstrip() + ("" if self.w(body) == ";" else " ") + one

    def falls(self, a: int, b: int) -> bool:
        """A comment says that a clause falls through; a linter's directive doesn't."""
        value = self.src[a + 2 : b - 2 if self.src.startswith("/*", a) else b]
        words = value.strip(JS_SPACE).split(maxsplit=1)
        if words and words[0] in LINT_WORDS:
            return False
        folded = "".join(" " if c in JS_SPACE else "s" if c == "\u017f" else c.lower() if c.isascii() else c for c in value)
        return any(x in folded for x in FALLS)

    def directive(self, a: int, b: int) -> str | None:
        lead = r"/\*[\s*]*" if self.src.startswith("/*", a) else r"//\s*"
        found = re.match(rf"{lead}{re.escape(self.marker)}-(ignore|off|on)(?![-\w$])", self.src[a:b])
        return found[1] if found else None

    def ignored(self, start: int) -> bool:
        """A comment right above, or above comments right above, says so."""
        top = start
        for a, b in reversed(self.t.comments[: bisect_right(self.c_start, start - 1)]):
            between = self.src[b:top]
            if between.strip(JS_SPACE) or between.count("\n") != 1 or self.src[self.starts[self.line(a) - 1] : a].strip(JS_SPACE):
                return False
            if self.directive(a, b) == "ignore":
                return True
            top = a
        return False

    def spare(self) -> None:
        """Blocks whose owner is to be ignored, or that are themselves, keep their braces."""
        if not any(self.directive(a, b) == "ignore" for a, b in self.t.comments):
            return
        out: set[int] = set()
        for start in sorted({x[2] for x in self.eligible} | set(self.heirs)):
            if start in out or self.ignored(start):
                out.add(start)
                out.update(self.heirs.get(start, ()))
        self.eligible = [x for x in self.eligible if x[2] not in out and self.t.start[x[0]] not in out and not self.ignored(self.t.start[x[0]])]

    def freeze(self) -> None:
        """Statements between an off and its on, counted within the innermost braces, are left alone, as are lists that start there."""
        self.spare()
        marks = [(a, d) for a, b in self.t.comments if (d := self.directive(a, b)) in ("off", "on")]
        if not marks:
            return
        spans = sorted((y["start"], y["limit"]) for y in self.lists if y["braced"])
        regions, opened = [], {}
        for a, d in marks:
            home = max((x for x in spans if x[0] <= a < x[1]), default=(0, len(self.src)))
            if d == "off":
                first, depth = opened.get(home, (a, 0))
                opened[home] = (first, depth + 1)
            elif home in opened:
                first, depth = opened.pop(home)
                if depth > 1:
                    opened[home] = (first, depth - 1)
                else:
                    regions.append((first, a))
        regions += [(first, home[1]) for home, (first, _) in opened.items()]
        self.regions = regions
        held = lambda x: any(a <= x < b for a, b in regions)
        self.eligible = [x for x in self.eligible if not held(self.t.start[x[0]]) and not held(self.t.end[self.m[x[0]]] - 1)]
        gone = {y["list_id"] for y in self.lists[1:] if held(y["start"])}
        self.lists = [y for y in self.lists if y["list_id"] not in gone]
        self.stmts = [s for s in self.stmts if s["list_id"] not in gone]
        for s in self.stmts:  # lists hold the same dicts
            s["frozen"] = s["frozen"] or held(s["start"])

    def finished(self, s: dict, i: int) -> dict:
        e = s["end"]
        a, b = self.t.start[i], self.t.end[e - 1]
        compact = self.line(a) == self.line(b - 1)
        joined, widest = False, None
        if not compact and s.get("arms"):
            texts = [self.arm(*x) for x in s["arms"]]
            prefix = self.src[self.starts[self.line(a) - 1] : a]
            indent = prefix[: len(prefix) - len(prefix.lstrip(JS_SPACE))]
            if None not in texts:
                widest = max(measure((indent if n else prefix) + x, self.ruler, self.tab) for n, x in enumerate(texts))
                joined = widest <= self.columns
        return {
            "kind": s["kind"], "start": a, "end": b, "compact": compact or joined, "multiline": not compact and not joined, "guard": bool(s.get("guard")), "jump": s.get("jump"),
            "case_body": bool(s.get("case_body")), "names": s.get("names") or [], "is_let": bool(s.get("is_let")), "reads": self.reads(i, e, s.get("root"), s.get("params")),
            "operation": s.get("operation"), "finally_ops": s.get("finally_ops") or [], "tag": s.get("tag", ""), "tail": s.get("tail"),
            "joined_columns": widest, "joined_arms": len(s["arms"]) if widest is not None else None,
            "word": s.get("tag") if s["kind"] == "Loop" else s["kind"].lower() if s["kind"] in ("If", "Return", "Switch", "Try", "Function") else None,
        }

    def blank_lines(self, after: int, before: int) -> list[int]:
        return [n for n in range(after + 1, before) if not self.lines[n - 1].strip(JS_SPACE)]

    def edges(self, y: dict, touch: Callable[[int, int], bool]) -> list[tuple[int, bool]]:
        """Blank lines right inside the braces of a list, but for those beside a statement to be ignored or in a region that is off; and whether they are at its start."""
        if not y["braced"] or y["open_line"] == y["close_line"] or y["start_line"] == y["close_line"]:
            return []
        inside = self.t.comments[bisect_right(self.c_start, y["start"]) : bisect_right(self.c_start, y["limit"] - 1)]
        later = [c for c in inside if self.line(c[0]) > y["open_line"]]
        own = y["own"]
        first = min(own[0]["start_line"] if own else y["close_line"], self.line(later[0][0]) if later else y["close_line"])
        last = max(own[-1]["end_line"] if own else y["open_line"], self.line(later[-1][1] - 1) if later else y["open_line"])
        out: dict[int, bool] = {}
        for a, b, at_start, edge in ((y["open_line"], first, True, own[:1]), (last, y["close_line"], False, own[-1:])):
            if touch(a, b) and not any(s["frozen"] for s in edge):
                for n in self.blank_lines(a, b):
                    if not any(x <= self.starts[n - 1] < z for x, z in self.regions):
                        out.setdefault(n, at_start)
        return list(out.items())

    def attach(self, own: list[dict], opener: int, limit: int) -> None:
        """Lines of each statement with the comments that belong to it."""
        before, marks, above = opener, self.t.comments, None
        for n, s in enumerate(own):
            first, last = self.line(s["start"]), self.line(s["end"] - 1)
            at = bisect_right(self.c_start, s["start"] - 1)
            lead = marks[min(bisect_right(self.c_start, before - 1), at) : at]
            lead = [c for c in lead if c[0] >= before]
            tops = [self.line(a) for a, _ in lead] + [first]
            ends = [self.line(b - 1) for _, b in lead]
            detached = any(not self.lines[n - 1].strip(JS_SPACE) for e, t in zip(ends, tops[1:]) for n in range(e + 1, t))
            end = s["end"]
            for a, b in marks[bisect_right(self.c_start, s["end"] - 1) :]:
                if a >= limit or self.line(a) != last:
                    break
                end = max(end, b)
            if s["case_body"] and n + 1 < len(own):  # a comment that says so belongs to the clause that falls through
                at = bisect_right(self.c_start, end - 1)
                between = [c for c in marks[at : at + 2] if c[0] < own[n + 1]["start"]]
                if len(between) == 1 and self.line(between[0][0]) == self.line(end - 1) + 1 and self.line(between[0][1] - 1) + 1 == self.line(own[n + 1]["start"]):
                    end = between[0][1] if self.falls(*between[0]) else end
            frozen = bool(lead) and not detached and any(self.directive(a, b) == "ignore" for a, b in lead) and first - ends[-1] <= 1
            s |= {"line": first, "col": self.column(s["start"]), "start_line": first if detached else tops[0], "end_line": self.line(end - 1), "tops": tops, "bottom_line": self.line(end - 1), "detached": detached, "frozen": frozen}
            s["commented"] = tops[0] < first
            s["blank_lines"] = self.blank_lines(above, s["start_line"]) if above else []
            s["blanks"] = len(s["blank_lines"])
            before, above = end, s["end_line"]


def deeply(work: Callable[[], None]) -> None:
    """Run on a thread whose stack holds DEEPEST levels of nesting."""
    failed: list[BaseException] = []

    def go() -> None:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 16 * DEEPEST))
        try:
            work()
        except BaseException as e:  # noqa: BLE001  raised again by the caller
            failed.append(e)
        finally:
            sys.setrecursionlimit(limit)

    before = threading.stack_size(512 << 20)
    try:
        t = threading.Thread(target=go)
        t.start()
    finally:
        threading.stack_size(before)
    t.join()
    if failed:
        raise failed[0]


def analyse(text: str | None, extension: str = "ts", marker: str = "gapweave", columns: int = COLUMNS, tab: int = TAB, ruler: str = "prettier", braces: bool = False, lines: list[int] | None = None, deleted: list[int] | None = None, explain: bool = False) -> dict:
    """error (None if the text could be read), stmts and lists as dicts; with `braces`, of the text without the braces that may go.

    Then also text (without those braces and without byte order mark), braces (line and column of each in the text given), and origin (by line, the one
    it was); stmts have at_line and at_col, where they were.  With changed lines (and lines after which something was deleted) only braces in their reach go;
    stmts tell whether the gap above is touched, lists give the blank lines of touched edges, and `changed` and `deleted` are those of the new text.  With `explain` blocks tell
    what becomes of each pair of braces and why, and off holds the first and last lines of regions that are off.
    """
    from .braces import Changes, explained, settled, through  # it reads with Source

    plain = (text or "").removeprefix("\ufeff")
    got: list = []
    given = None if lines is None and deleted is None else Changes(lines or (), deleted or ())
    read = lambda: got.extend(settled(plain, extension, marker, columns, tab, ruler, braces, given))
    try:
        try:
            read()
        except RecursionError:
            got.clear()
            deeply(read)
    except (Unreadable, IndexError, RecursionError) as e:
        return {"error": str(e) or "unreadable", "stmts": [], "lists": [], "text": plain, "braces": [], "origin": [], "changed": lines, "deleted": deleted}
    s, gone, backs, now = got
    touch = now.touch if now else lambda first, last: True
    before: dict[int, int] = {}
    for x in s.stmts:
        x["touched"] = x["list_id"] in before and touch(before[x["list_id"]], x["end_line"])
        before[x["list_id"]] = x["start_line"]
    first = Places(plain) if backs else s
    for y in s.lists:
        y["edges"] = [{"line": n, "at_line": first.line(through(backs, s.starts[n - 1])), "at_start": side} for n, side in s.edges(y, touch)]
    for x in s.stmts:
        at = through(backs, x["start"])
        x |= {"at_line": first.line(at), "at_col": first.column(at)} if backs else {"at_line": x["line"], "at_col": x["col"]}
    return {
        "error": None, "stmts": s.stmts, "lists": s.lists, "text": s.src, "braces": [{"line": first.line(x), "col": first.column(x)} for x in gone],
        "origin": [first.line(through(backs, x)) for x in s.starts] if backs else [], "changed": now and now.lines, "deleted": now and now.deleted,
    } | (explained(plain, extension, marker, columns, tab, ruler, braces) if explain else {})
