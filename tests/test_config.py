import pytest

from gapweave.functions import config as c
from gapweave.operators import config as op
from gapweave.plans import analysis


def test_readers():
    assert c.jsonc('﻿{ // a\n "x": [1, 2,], /* b */ "y": "// \\" no", }') == {"x": [1, 2], "y": '// " no'}
    for bad in ("{,}", "[,]", '{"a": 1,,}', "{", '"'):
        with pytest.raises(ValueError):
            c.jsonc(bad)
    assert c.flat_yaml('printWidth: 90 # wide\noverrides:\n  - files: "*.ts"\n    options:\n      printWidth: 70\n  - files: [a, b]\nx: true\ny: null\n') == {"printWidth": 90, "overrides": [{"files": "*.ts", "options": {"printWidth": 70}}, {"files": ["a", "b"]}], "x": True, "y": None}
    with pytest.raises(ValueError):
        c.flat_yaml("a: &x 1\n")
    assert c.read("p/.prettierrc.toml", "printWidth = 99\n") == {"printWidth": 99} and c.read(".prettierrc", '{"printWidth": 1}') == {"printWidth": 1}
    assert c.layouts("biome.json", '{"formatter": {"lineWidth": 500, "indentWidth": 4}}') == [{"pattern": None, "columns": None, "tab": 4.0, "editorconfig": False}]
    assert c.layouts("biome.json", '{"formatter": {"enabled": false}}') == [] and c.layouts(".prettierrc.json", "{") is None
    assert c.editor_sections("root = true\n[*]\nmax_line_length = 100\nindent_size=4\n; x\n[*.md]\nmax_line_length = off\n") == (True, [{"pattern": c.glob("*"), "columns": 100.0, "tab": 4.0}, {"pattern": c.glob("*.md"), "columns": None, "tab": None}])


def test_globs():
    import re

    hit = lambda p, x: bool(re.match(c.glob(p), x))
    assert hit("*.ts", "a/b/c.ts") and hit("a/*.ts", "a/c.ts") and not hit("a/*.ts", "a/b/c.ts") and hit("a/**/c.ts", "a/c.ts") and hit("**/x/*", "x/y") and hit("*.{ts,tsx}", "a.tsx") and not hit("*.{ts,tsx}", "a.js") and hit("[!a].ts", "b.ts") and not hit("[!a].ts", "a.ts")


def test_widths(spark):
    texts = {
        ".prettierrc": "printWidth: 90\noverrides:\n  - files: '*.test.ts'\n    options:\n      printWidth: 60\n", "a/biome.json": '{"formatter": {"lineWidth": 70}}', "a/.oxfmtrc.json": "{}", "b/.prettierrc.json": "{", "b/c/.prettierrc": "tabWidth: 8\n",
        "d/.prettierrc.json": "{}", "d/biome.json": '{"formatter": {"lineWidth": 120}}',
    }
    files = spark.createDataFrame([(x,) for x in ("x.ts", "x.test.ts", "a/y.ts", "b/z.ts", "b/c/w.ts", "d/v.ts")], "path string")
    read = op.layouts(spark.createDataFrame(list(texts.items()), "path string, text string"))
    editors = op.editor_layouts(spark.createDataFrame([("b/.editorconfig", "root = true\n[*.ts]\nmax_line_length = 55\n"), (".editorconfig", "[*]\nmax_line_length = 44\ntab_width = 3\n")], "path string, text string"))
    listed = spark.createDataFrame([("", "biome")], "dir string, formatter string")
    got = {r.path: (r.columns, r.tab, r.formatter, r.source, r.unread) for r in op.widths(files, read, editors, listed).collect()}
    assert got == {
        "x.ts": (90, 3, "prettier", ".prettierrc", []), "x.test.ts": (60, 3, "prettier", ".prettierrc", []), "a/y.ts": (70, 2, "biome", "a/biome.json", []),
        "b/z.ts": (90, 2, "prettier", ".prettierrc", ["b/.prettierrc.json"]), "b/c/w.ts": (55, 8, "prettier", "b/.editorconfig", []), "d/v.ts": (120, 2, "biome", "d/biome.json", []),
    }
    got = {r.path: (r.columns, r.source) for r in op.widths(files, read).collect()}
    assert got["d/v.ts"] == (80, "prettier default") and got["a/y.ts"] == (70, "a/biome.json")
    assert op.widths(files.limit(0), read).count() == 0 and [tuple(r)[1:5] for r in op.widths(files.limit(1), read.limit(0)).collect()] == [(80, 2, None, "fallback")]


def test_decisions_reach_the_fixed_text(spark):
    rows = [
        ("a.ts", "flat", 0, "x", None, None), ("a.ts", "flat", 1, "y", "off", None), ("a.ts", "flat", 2, "z", "on", None), ("b.ts", "biome", 0, "x", "off", False), ("b.ts", "biome", 1, "y", "on", None),
        ("c.ts", "legacy", 0, "x", None, True), ("c.ts", "legacy", 1, "y", "on", None), ("d.ts", "oxlint", 0, "x", "off", None), ("d.ts", "oxlint", 0, "y", "off", None), ("e.ts", "flat", 0, "x", "off", None), ("e.ts", "legacy", 0, "w", "unknown", None),
    ]
    found = spark.createDataFrame(rows, "path string, family string, depth int, file string, setting string, root boolean")
    made = op.decided(found)
    assert sorted((r.path, r.family, r.setting, r.files) for r in made.collect()) == [("a.ts", "flat", "on", ["z"]), ("b.ts", "biome", "off", ["x"]), ("d.ts", "oxlint", "unknown", ["x", "y"]), ("e.ts", "flat", "off", ["x"]), ("e.ts", "legacy", "unknown", ["w"])]
    kept = op.braces(made)
    assert sorted((r.path, r.enforced, r.unread) for r in kept.collect()) == [("a.ts", True, []), ("b.ts", False, []), ("d.ts", True, ["x", "y"]), ("e.ts", True, ["w"])]
    text = "if (a) {\n  bbbbbbbbbbbbbbbbbbbb();\n}\n"
    files = spark.createDataFrame([(x, text) for x in ("a.ts", "b.ts", "f.ts")], "path string, text string")
    width = spark.createDataFrame([("f.ts", 20, 2, "biome")], "path string, columns int, tab int, formatter string")
    got = {r.path: r.text for r in analysis.fixed(op.with_settings(files, width, kept)).collect()}
    assert got == {"a.ts": text, "b.ts": "if (a) bbbbbbbbbbbbbbbbbbbb();\n", "f.ts": "if (a)\n  bbbbbbbbbbbbbbbbbbbb();\n"}
