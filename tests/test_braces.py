import pytest

from gapweave.functions.syntax import analyse
from gapweave.functions.width import measure, terminal_columns
from gapweave.plans import analysis

#: Text, what is left of it; texts of our own, one for each reason to keep a brace and each way to remove one.
CASES = {
    "plain": ("if (a) {\n  b();\n}\n", "if (a) b();\n"),
    "nested": ("for (const x of y) {\n  while (x) {\n    if (z) {\n      go(x);\n    }\n  }\n}\n", "for (const x of y) while (x) if (z) go(x);\n"),
    "too wide": (f"if (a) {{\n  {'b' * 80}();\n}}\n", f"if (a)\n  {'b' * 80}();\n"),
    "two statements": ("if (a) {\n  b();\n  c();\n}\n", None),
    "empty": ("if (a) {\n}\n", None),
    "empty statement": ("if (a) {\n  b();;\n}\n", None),
    "declaration": ("if (a) {\n  let b = 1;\n}\n", None),
    "class": ("while (a) {\n  class B {}\n}\n", None),
    "comment": ("if (a) {\n  // why\n  b();\n}\n", None),
    "closing comment": ("if (a) {\n  b();\n} // done\n", None),
    "dangling else": ("if (a) {\n  if (b) c();\n} else {\n  d();\n}\n", "if (a) {\n  if (b) c();\n} else d();\n"),
    "goes on": ("if (a) {\n  b()\n}\n(c)();\n", None),
    "no semicolon": ("if (a) {\n  b()\n}\nc();\n", "if (a) b()\nc();\n"),
    "else": ("if (a) {\n  b();\n} else {\n  c();\n}\n", "if (a) b();\nelse c();\n"),
    "do": ("do {\n  b();\n} while (a);\n", "do b();\nwhile (a);\n"),
    "own line": ("if (a)\n{\n  b();\n}\n", "if (a) b();\n"),
    "wide header": (f"if (a &&\n  {'b' * 70})\n{{\n  c();\n}}\n", f"if (a &&\n  {'b' * 70})\n  c();\n"),
    "blank lines": ("if (a) {\n\n  b();\n\n}\nc();\n", "if (a) b();\nc();\n"),
    "ignored": ("// gapweave-ignore\nif (a) {\n  b();\n}\n", None),
    "off": ("// gapweave-off\nif (a) {\n  b();\n}\n// gapweave-on\nif (a) {\n  b();\n}\n", "// gapweave-off\nif (a) {\n  b();\n}\n// gapweave-on\nif (a) b();\n"),
    "one line": ("if (a) { b(); }\n", "if (a) b();\n"),
    "carriage returns": ("if (a) {\r\n  b();\r\n}\r\n", "if (a) b();\r\n"),
    "no line feed": ("if (a) {\n  b();\n}", "if (a) b();"),
}


@pytest.mark.parametrize("name", CASES)
def test_removal(name):
    text, want = CASES[name]
    got = analyse(text, braces=True)
    assert got["error"] is None and got["text"] == (text if want is None else want)
    assert analyse(got["text"], braces=True)["text"] == got["text"]
    assert len(got["braces"]) == text.count("{") - got["text"].count("{")


def test_places_before_removal():
    text = "function f(a) {\n  if (a) {\n    go();\n  }\n\n  for (const é of a) {\n    if (é) {\n      go(é);\n    }\n  }\n  done();\n}\n"
    got = analyse(text, braces=True)
    assert got["braces"] == [{"line": 2, "col": 10}, {"line": 6, "col": 22}, {"line": 7, "col": 12}]
    at = {(s["kind"], s["line"]): (s["at_line"], s["at_col"]) for s in got["stmts"]}
    assert at == {("Function", 1): (1, 1), ("If", 2): (2, 3), ("Loop", 4): (6, 3), ("Other", 5): (11, 3)}
    assert got["origin"] == [1, 2, 5, 6, 11, 12, 13]


def test_depth():
    text = "if (a) {\n" * 400 + "go();\n" + "}\n" * 400
    assert analyse(text)["error"] is None and analyse("{" * 5000 + "}" * 5000)["error"]


def test_findings_and_fixed_text(spark):
    files = spark.createDataFrame([(f"{i}.ts", t) for i, (t, _) in enumerate(CASES.values())] + [("mark.ts", "﻿if (a) {\n  b();\n}\n"), ("bad.ts", "if ("), ("none.ts", None), ("kept.ts", "if (a) {\n  b();\n}\n")], "path string, text string")
    from pyspark.sql import functions as F

    files = files.withColumn("braces", F.when(F.col("path") == "kept.ts", False))
    got = {r.path: r.text for r in analysis.fixed(files).collect()}
    packed = lambda t: [x for x in t.splitlines() if x]  # noqa: E731  blank lines have rules of their own
    for i, (text, want) in enumerate(CASES.values()):
        assert packed(got[f"{i}.ts"]) == packed(text if want is None else want)
    assert got["mark.ts"] == "﻿if (a) b();\n" and got["bad.ts"] == "if (" and got["none.ts"] == "" and got["kept.ts"] == "if (a) {\n  b();\n}\n"
    found = [(r.path, r.line, r.col, r.rule) for r in analysis.findings(files).collect() if r.rule in ("braces", "parse")]
    assert ("1.ts", 3, 12, "braces") in found and ("mark.ts", 1, 8, "braces") in found and ("bad.ts", 1, 1, "parse") in found
    assert not [f for f in found if f[0] == "kept.ts"]


def test_widths():
    """By the published behaviour of each formatter: indent, tabs, wide and joined characters."""
    rows = [("漢字", (4, 4, 4)), ("é", (1, 1, 1)), ("\U0001f44d\U0001f3fd", (2, 4, 2)), ("❤️", (2, 1, 2)), ("1️⃣", (2, 1, 2)), ("a​b", (3, 2, 2)), ("ab\tc", (3, 7, 7)), ("\t\tx", (9, 9, 9)), ("  \tx", (7, 7, 7))]
    for text, want in rows:
        assert tuple(measure(text, r, 4) for r in ("prettier", "biome", "oxfmt")) == want, repr(text)
    assert terminal_columns("a漢́") == 3


def test_reader_faults_stay_mended():
    assert analyse("const Custom = 1\nreturn <Custom-el />", "tsx")["stmts"][1]["reads"] == []
    clause = "switch (a) {\n  case 1:\n    b();\n  // %s\n  case 2:\n    c();\n}\n"
    ends = lambda say: [s["end_line"] for s in analyse(clause % say)["stmts"] if s["kind"] == "Case"][0]
    assert ends("fallſ through") == ends("Falls Through") == 4 and ends("eslint-disable-line no-fallthrough") == ends("other") == 3
