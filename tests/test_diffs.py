import random

from gapweave.sources import diffs


def one(removed, added):
    return diffs.section_changes(["diff --git a/a.ts b/a.ts", "@@ -1,2 +1,2 @@", f"-{removed}", f"+{added}", " y();"])


def section(before, after):
    return ["diff --git a/a.ts b/a.ts", f"@@ -1,{len(before)} +1,{len(after)} @@", *[f"-{x}" for x in before], *[f"+{x}" for x in after]]


def test_braces_alone_are_no_change():
    for a, b in [("  while (q) {", "  while (q)"), ("  } else {", "  else"), ("  if (q) { f(); }", "  if (q) f();"), ("  } else { // so", "  else // so"), ('  if (q === "}") {', '  if (q === "}")')]:
        assert one(a, b) == ([], []), a
    for a, b in [("  if (q) f();", "  if (q) { f(); }"), ('  const s = ") {";', '  const s = ") ";'), ("  const { q } = r;", "  const q = r;"), ("  f(); // }", "  f(); //"), ("  }", "  } ")]:
        assert one(a, b) == ([1], []), a


def test_joined_bodies():
    after = ["  if (q) f();", "  y();"]
    for before in (["  if (q) {", "    f();", "  }", "  y();"], ["  if (q)", "  {", "    f();", "  }", "  y();"], ["  if (q) {", "", "    f();", "  }", "  y();"]):
        assert diffs.section_changes(section(before, after)) == ([], []), before
    assert diffs.section_changes(section(["  if (q) {", "    return typeof x;", "  }"], ["  if (q) return typeofx;"])) == ([1], [])
    deep = [f"if (v{i}) {{" for i in range(9)] + ["go();"] + ["}"] * 9
    assert diffs.section_changes(section(deep, [" ".join(f"if (v{i})" for i in range(9)) + " go();"])) == ([], [])


def test_headers():
    for header in ("@@ -1,2 +0,3 @@", "@@ -1 +0 @@", "@@ -1,2 +4294967296,2 @@", "@@ -1,4294967296 +1,2 @@"):
        assert diffs.section_changes(["diff --git a b", header, " x", "+y", "+z"]) == ([], [])
    assert diffs.section_changes(["diff --git a b", "@@ -1,2 +0,0 @@", "-x", "-y"]) == ([], [0])


def test_against_plain_differences():
    """Without braces, what is kept is a longest common subsequence, and every line not kept is changed or deleted."""
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.choice("pqrstu") for _ in range(rng.randint(0, 14))]
        b = [rng.choice("pqrstu") for _ in range(rng.randint(0, 14))]
        pairs = diffs.aligned(a, b)
        assert all(a[x] == b[y] for x, y in pairs) and pairs == sorted(set(pairs)) and len({x for x, _ in pairs}) == len({y for _, y in pairs}) == len(pairs)
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        assert len(pairs) == best[-1][-1]
        lines, deleted = diffs.section_changes(section(a, b))
        assert lines == [j + 1 for j in range(len(b)) if j not in {y for _, y in pairs}]
        gaps = {max([y + 1 for x, y in pairs if x < i], default=0) for i in range(len(a)) if i not in {x for x, _ in pairs}}
        assert set(deleted) <= {g for g in gaps if g not in lines and g + 1 not in lines} | set(deleted) and all(d not in lines and d + 1 not in lines for d in deleted)


def test_beyond_the_edit_limit():
    a, b = [f"a{i}" for i in range(2500)], [f"b{i}" for i in range(2500)]
    lines, deleted = diffs.section_changes(["diff --git a b", "@@ -1,2501 +1,2501 @@", " x", *[f"-{x}" for x in a], *[f"+{x}" for x in b]])
    assert lines == list(range(2, 2502)) and deleted == []


def test_tables(spark):
    text = ["warning: x", "diff --git a/a b/a", "@@ -1 +1 @@", "-x", "+y", "diff --git a/b b/b", "diff --git a/b b/b", "@@ -1,2 +1,1 @@", " x", "-y"]
    rows = [(k, i, t) for k in ("p", "q") for i, t in enumerate(text)]
    cut = diffs.sections(spark.createDataFrame(rows, "repo string, ord int, value string"), "repo")
    got = {(r.repo, r.section): r.rows for r in cut.collect()}
    assert got == {(k, n): text[a:b] for k in "pq" for n, a, b in ((1, 1, 5), (2, 5, 10))}
    from pyspark.sql import functions as F

    found = diffs.changed(cut.select(F.concat("repo", "section").alias("path"), "rows"))
    assert sorted(map(tuple, found.collect())) == [("p1", 1, "line"), ("p2", 1, "deleted_after"), ("q1", 1, "line"), ("q2", 1, "deleted_after")]
    heads = spark.createDataFrame([("@@ -1,2 +3,4 @@ f",), ("@@ -1 +2 @@",), ("@@ -1 +0,0 @@",), ("@@ -1 +0 @@",), ("@@ -1,99999999999 +1 @@",), ("x",), (None,)], "v string")
    assert [tuple(r.h) if r.h else None for r in heads.select(diffs.hunk_header("v").alias("h")).collect()] == [(2, 3, 4), (1, 2, 1), (1, 0, 0), None, None, None, None]
    assert diffs.changed(cut.select(F.col("repo").alias("path"), "rows").limit(0)).count() == 0


SOURCE = "function f(a) {\n\n  if (a) {\n    g();\n  }\n  const b = a;\n\n  if (!b) return;\n  h();\n  k();\n  if (c) {\n    d();\n  }\n\n}\n"


def test_only_touched_parts_are_judged(spark):
    """Changed lines reach braces, gaps and edges; without any nothing is found, and without a diff everything is."""
    from gapweave.plans import analysis

    files = spark.createDataFrame([("a.ts", SOURCE), ("b.ts", SOURCE), ("c.ts", SOURCE), ("d.ts", SOURCE)], "path string, text string")
    touched = spark.createDataFrame([("a.ts", 12, "line"), ("b.ts", 8, "line"), ("d.ts", 1, "deleted_after")], "path string, line int, kind string")
    found = lambda df: sorted((r.path, r.line, r.rule) for r in analysis.findings(df).collect())
    everything = [x[1:] for x in found(files.filter("path = 'a.ts'"))]
    assert everything == [(2, "edge-blank"), (3, "braces"), (8, "guard-join"), (9, "after-guard"), (11, "braces"), (14, "edge-blank")]
    assert found(analysis.with_changes(files, touched)) == [("a.ts", 11, "braces"), ("a.ts", 14, "edge-blank"), ("b.ts", 8, "guard-join"), ("b.ts", 9, "after-guard"), ("d.ts", 2, "edge-blank")]
    got = {r.path: r.text for r in analysis.fixed(analysis.with_changes(files, touched)).collect()}
    assert got["c.ts"] == SOURCE
    assert "if (c) d();" in got["a.ts"] and "if (a) {" in got["a.ts"] and "if (!b) return;\n\n  h();" in got["b.ts"] and "if (c) {" in got["b.ts"]
