from gapweave.plans import explain

TEXT = "function f(xs) {\n  const a = g();\n\n  if (!a) return;\n  h(a);\n  if (b) {\n    k();\n  }\n  while (q) {\n    // why\n    r();\n  }\n}\na();\nb();\nc();\nd();\ne();\nj();\n"
OFF = "a();\n// gapweave-off\nif (a) {\n  b();\n}\n// gapweave-on\n"


def test_explanations(spark):
    files = spark.createDataFrame([("a.ts", TEXT), ("bad.ts", "f("), ("off.ts", OFF), ("none.ts", None)], "path string, text string")
    asked = spark.createDataFrame([("a.ts", 4), ("a.ts", 6), ("a.ts", 9), ("a.ts", 15), ("a.ts", 3), ("a.ts", 99), ("bad.ts", 1), ("off.ts", 4), ("off.ts", 3)], "path string, line int")
    got = {(r.path, r.line): (r.found, r.text) for r in explain.explained(files, asked).collect()}
    assert got["a.ts", 4] == (True, "a.ts:4\n\ngap above line 4, 1 blank line\n  2        const a = g();\n  4        if (!a) return;\nrule:      guard-join, wants no blank line\nbecause:   `a` is bound on line 2 and read by the `if` below it\noutranked: none\nresult:    --fix removes 1 blank line")
    assert "note:      decided after --fix removes the braces on line 6\n" in got["a.ts", 6][1] and got["a.ts", 6][1].endswith("braced body, lines 6 to 8\n  7        k();\nrule:      braces, a control flow body that is a single statement has no braces\nresult:    --fix removes the braces")
    assert got["a.ts", 9][1].endswith("kept by:   a comment on line 10 sits inside the braces but outside the statement\nresult:    the braces stay")
    assert got["a.ts", 15][1].count("  14       a();") == 1 and "wall, lines 14 to 19\n  19       j();\n" in got["a.ts", 15][1]
    assert got["a.ts", 3] == (False, "a.ts:3: no gap ends and no braced body starts on this line") and got["a.ts", 99] == (False, "a.ts has 19 lines, not 99")
    assert got["bad.ts", 1] == (False, "bad.ts does not parse: unexpected end")
    assert got["off.ts", 4] == (True, "off.ts:4\n\nline 4 is inside a gapweave-off region, so gapweave leaves it alone") and "a directive covers" in got["off.ts", 3][1]
    kept = {r.line: r.text for r in explain.explained(files.filter("path = 'a.ts'"), held_by="x.json enforces braces").collect()}
    assert "kept by:   x.json enforces braces\nresult:    the braces stay" in kept[6] and "note:" not in kept[6]
    assert explain.explained(files.limit(0)).count() == 0
