"""Configuration files read as data, never run: JSON with comments, sections of editors' files, TOML, flat YAML; and their globs.

A file that holds code, or that can't be read, gives None: what it says is unknown then.
"""
from __future__ import annotations

import json
import re

#: Which file names belong to which formatter, its keys and defaults.
OXFMT = (".oxfmtrc.json", ".oxfmtrc.jsonc")
BIOME = ("biome.json", "biome.jsonc", ".biome.json", ".biome.jsonc")
PRETTIER = (".prettierrc", ".prettierrc.json", ".prettierrc.yml", ".prettierrc.yaml", ".prettierrc.json5", ".prettierrc.toml")
KEYS = {"oxfmt": ("printWidth", "tabWidth", 100, 320), "prettier": ("printWidth", "tabWidth", 80, None), "biome": ("lineWidth", "indentWidth", 80, 320)}
_JSONC = re.compile(r'"(?:[^"\\]|\\.)*"|//[^\n\r]*|/\*.*?\*/|[\s\S]', re.S)


def jsonc(text: str):
    """JSON that may have comments and a comma before a closing bracket; raises ValueError."""
    parts: list[str] = []
    for m in _JSONC.finditer(text.removeprefix("﻿")):
        part = m[0]
        if part.startswith(("//", "/*")) and len(part) > 1:
            part = " "
        if part in "}]":
            k = len(parts) - 1
            while k >= 0 and parts[k].isspace():
                k -= 1
            if k >= 0 and parts[k] == ",":
                j = k - 1
                while j >= 0 and parts[j].isspace():
                    j -= 1
                if j >= 0 and parts[j][-1:] not in ("{", "[", ","):
                    parts[k] = " "
        parts.append(part)
    return json.loads("".join(parts))


def flat_yaml(text: str):
    """Mappings by indent, lists of mappings or scalars, plain and quoted scalars; anything else raises ValueError."""
    rows = []
    for line in text.split("\n"):
        bare = re.sub(r"(^|\s)#.*$", "", line.rstrip()).rstrip()
        if bare.strip() in ("", "---"):
            continue
        if "\t" in bare[: len(bare) - len(bare.lstrip())] or re.search(r"[&*!|>{}%@`]", re.sub(r"\"[^\"]*\"|'[^']*'", "", bare)) and not re.search(r":\s*\[.*\]$", bare):
            raise ValueError("beyond flat YAML")
        rows.append((len(bare) - len(bare.lstrip()), bare.strip()))

    def scalar(x: str):
        x = x.strip()
        if x[:1] in "\"'" and x[-1:] == x[:1] and len(x) > 1:
            return x[1:-1]
        if x.startswith("[") and x.endswith("]"):
            return [scalar(y) for y in x[1:-1].split(",") if y.strip()]
        if x in ("true", "false"):
            return x == "true"
        if x in ("", "null", "~"):
            return None
        return int(x) if re.fullmatch(r"[+-]?\d+", x) else float(x) if re.fullmatch(r"[+-]?\d*\.\d+", x) else x

    def block(i: int, indent: int):
        if rows[i][1].startswith("- "):
            out: list = []
            while i < len(rows) and rows[i][0] == indent and rows[i][1].startswith("- "):
                inner = rows[i][1][2:].strip()
                if re.match(r"[\w\"'.-]+:(\s|$)", inner):
                    rows[i] = (indent + 2, inner)
                    value, i = block(i, indent + 2)
                else:
                    value, i = scalar(inner), i + 1
                out.append(value)
            return out, i
        found: dict = {}
        while i < len(rows) and rows[i][0] == indent:
            m = re.match(r"([\w.-]+|\"[^\"]*\"|'[^']*'):(?:\s+(.*))?$", rows[i][1])
            if not m:
                raise ValueError("beyond flat YAML")
            key = scalar(m[1])
            if m[2]:
                found[key], i = scalar(m[2]), i + 1
            elif i + 1 < len(rows) and (rows[i + 1][0] > indent or rows[i + 1][0] == indent and rows[i + 1][1].startswith("- ")):
                found[key], i = block(i + 1, rows[i + 1][0])
            else:
                found[key], i = None, i + 1
        return found, i

    if not rows:
        return None
    value, end = block(0, rows[0][0])
    if end != len(rows):
        raise ValueError("beyond flat YAML")
    return value


def read(name: str, text: str):
    """The data of a configuration file by its name; raises ValueError."""
    base = name.rpartition("/")[2]
    if base.endswith(".toml"):
        import tomllib

        return tomllib.loads(text)
    if base.endswith((".yml", ".yaml")):
        return flat_yaml(text)
    if base == ".prettierrc":  # JSON or YAML
        return jsonc(text) if text.lstrip().startswith("{") else flat_yaml(text)
    return jsonc(text)


def formatter_of(name: str) -> str | None:
    base = name.rpartition("/")[2]
    return "oxfmt" if base in OXFMT else "biome" if base in BIOME else "prettier" if base in PRETTIER else None


def _number(value, most: float | None) -> float | None:
    good = isinstance(value, (int, float)) and not isinstance(value, bool) and value >= 1 and value == int(value) and (most is None or value <= most)
    return float(value) if good else None


def glob(pattern: str) -> str:
    """A glob over relative paths as a regular expression: **, *, ?, classes, alternatives; without a slash it names files anywhere."""
    p = pattern.removeprefix("./")
    out, i, depth = "" if "/" in p else "(?:.*/)?", 0, 0
    while i < len(p):
        c = p[i]
        if p.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif p.startswith("**", i):
            out, i = out + ".*", i + 2
        elif c in "*?":
            out, i = out + ("[^/]*" if c == "*" else "[^/]"), i + 1
        elif c == "[" and (end := p.find("]", i + 2)) > 0:
            body = p[i + 1 : end].replace("\\", "\\\\")
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body) + "]", end + 1
        elif c == "{" and "}" in p[i:]:
            out, i, depth = out + "(?:", i + 1, depth + 1
        elif c in ",}" and depth:
            out, i, depth = out + ("|" if c == "," else ")"), i + 1, depth - (c == "}")
        elif c == "\\" and i + 1 < len(p):
            out, i = out + re.escape(p[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return f"^{out}$"


def layouts(name: str, text: str) -> list[dict] | None:
    """What a formatter's file sets, in order: {pattern, columns, tab, editorconfig}; the first without a pattern, overrides behind it.  None: unreadable.

    A file that sets the formatter off, or is of no formatter, sets nothing.
    """
    formatter = formatter_of(name)
    try:
        data = read(name, text)
    except ValueError:
        return None
    if formatter is None or data is None:
        return []
    if not isinstance(data, dict):
        return None
    width, tab, _, most = KEYS[formatter]
    own = data.get("formatter", {}) if formatter == "biome" else data
    if not isinstance(own, dict):
        return None
    if formatter == "biome" and own.get("enabled") is False:
        return []
    editor = own.get("useEditorconfig") is True if formatter == "biome" else True
    row = lambda d, patterns: [{"pattern": p, "columns": _number(d.get(width), most), "tab": _number(d.get(tab), None), "editorconfig": editor} for p in patterns]
    out = row(own, [None])
    for x in data.get("overrides") or []:
        if not isinstance(x, dict):
            return None
        files = x.get("includes", x.get("include")) if formatter == "biome" else x.get("files")
        inner = x.get("formatter" if formatter == "biome" else "options")
        if isinstance(inner, dict):
            out += row(inner, [glob(f) for f in ([files] if isinstance(files, str) else files or []) if isinstance(f, str)])
    return out


def editor_sections(text: str) -> tuple[bool, list[dict]]:
    """Whether the file is the topmost one; and its sections in order: {pattern, columns, tab}."""
    root, out, now = False, [], None
    for line in text.removeprefix("﻿").split("\n"):
        line = line.strip()
        if not line or line[0] in "#;":
            continue
        if line.startswith("[") and line.endswith("]"):
            p = line[1:-1]
            now = {"pattern": glob(p[1:] if p.startswith("/") else p if "/" in p else p), "columns": None, "tab": None}
            out.append(now)
            continue
        key, eq, value = (x.strip().lower() for x in line.partition("="))
        if not eq:
            continue
        if now is None:
            root = root or key == "root" and value == "true"
        elif key == "max_line_length":
            now["columns"] = _number(int(value), None) if value.isdigit() else now["columns"]
        elif key in ("indent_size", "tab_width") and value.isdigit():
            now["tab"] = _number(int(value), None)
    return root, out
