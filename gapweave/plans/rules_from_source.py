"""Every rule from source text to findings and fixed text: each part becomes a file whose shape its data choose, each beside its SQL.

The SQL holds, for each shape with and without its blank line, what must be found and what must be left; it never reads the text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import diffs
from . import analysis, explain
from .kernels import kernel

B = "\n"
WIDE = "w" * 76
#: Text before and after the blank line in question; then, for a file without and one with that line: findings (line, col, rule, message, fixable) and the text left.
SAYS = analysis.MESSAGES
JOIN = "remove the blank line between `%s` and the `%s` that reads it"
AFTER, BEFORE = "remove the blank line right after `{`", "remove the blank line right before `}`"
LOOP = "for (const x of xs) {\n  n += x;\n  t(n);\n}\n"
SHAPES: list[tuple[str, str, list, str, list, str]] = [
    ("function f() {\n  a();\n", "  b();\n}\n", [], "", [(4, 3, "short-body", SAYS["short-body"], True)], "function f() {\n  a();\n  b();\n}\n"),
    ("let n = 0;\n", LOOP, [], "", [(3, 1, "use-join", JOIN % ("n", "for"), True)], "let n = 0;\n" + LOOP),
    ("g();\nh();\nk();\nconst r = a.b;\n", "return r;\n", [], "", [(6, 1, "consume-join", JOIN % ("r", "return"), True)], "g();\nh();\nk();\nconst r = a.b;\nreturn r;\n"),
    ("const r = q();\n", "if (!r) stop();\ng();\n", [], "", [(3, 1, "guard-join", JOIN % ("r", "if"), True)], "const r = q();\nif (!r) stop();\ng();\n"),
    ("switch (k) {\n  case 1: a(); break;\n", "  case 2: b(); break;\n}\n", [(3, 3, "switch-clauses", SAYS["switch-clauses"], True)], "switch (k) {\n  case 1: a(); break;\n\n  case 2: b(); break;\n}\n", [], ""),
    ("const o = {\n  a,\n};\n", "g(o);\n", [(4, 1, "after-multiline", SAYS["after-multiline"], True)], "const o = {\n  a,\n};\n\ng(o);\n", [], ""),
    ("a();\n", "let n = 0;\n" + LOOP, [(2, 1, "let-step", SAYS["let-step"], True)], "a();\n\nlet n = 0;\n" + LOOP, [], ""),
    ("if (a) {\n", "  b();\n}\n", [(1, 8, "braces", SAYS["braces"], True)], "if (a) b();\n", [(1, 8, "braces", SAYS["braces"], True)], "if (a) b();\n"),
    ("function f() {\n", "  a();\n}\n", [], "", [(2, 1, "edge-blank", AFTER, True)], "function f() {\n  a();\n}\n"),
    ("function f() {\n  a();\n", "}\n", [], "", [(3, 1, "edge-blank", BEFORE, True)], "function f() {\n  a();\n}\n"),
    ("a();\n", "if (b) {\n  c();\n  d();\n}\n", [(2, 1, "block-spacing", SAYS["block-spacing"], False)], "", [], ""),
    ("if (a) return;\n", "if (b) throw c;\n", [], "", [(3, 1, "guard-chain", SAYS["guard-chain"], True)], "if (a) return;\nif (b) throw c;\n"),
    ("if (a) return;\n", "b();\n", [(2, 1, "after-guard", SAYS["after-guard"], True)], "if (a) return;\n\nb();\n", [], ""),
    ("// gapweave-ignore\nif (a) {\n", "  b();\n}\n", [], "", [(3, 1, "edge-blank", AFTER, True)], "// gapweave-ignore\nif (a) {\n  b();\n}\n"),
    ("// gapweave-off\nif (a) return;\nb();\n", "if (c) {\n  d();\n}\n// gapweave-on\n", [], "", [], ""),
    (f"if (a) {{\n  {WIDE}();\n}} else {{\n", "  c();\n}\n", [(1, 8, "braces", SAYS["braces"], True), (3, 8, "braces", SAYS["braces"], True)], f"if (a)\n  {WIDE}();\nelse c();\n", [(1, 8, "braces", SAYS["braces"], True), (3, 8, "braces", SAYS["braces"], True)], f"if (a)\n  {WIDE}();\nelse c();\n"),
    ("a();\nb();\nc();\n", "d();\ne();\nf();\n", [(1, 1, "wall", analysis.WALL % 6, False)], "", [], ""),
    ("f(\n", "", [(1, 1, "parse", "unexpected end", False)], "", [(1, 1, "parse", "unexpected end", False)], ""),
]
N = len(SHAPES)


def _q(text: str) -> str:
    return "'" + text.replace("'", "''").replace("\n", "'||chr(10)||'") + "'"


def _left(shape: tuple, blank: bool) -> str:
    return shape[5 if blank else 3] or shape[0] + (B if blank else "") + shape[1]


_FOUND = ", ".join(f"({i}, {str(bool(blank)).lower()}, {line}, {col}, '{rule}', {_q(message)}, {str(fix).lower()})" for i, s in enumerate(SHAPES) for blank in (0, 1) for line, col, rule, message, fix in s[4 if blank else 2])
_LEFT = ", ".join(f"({i}, {str(bool(blank)).lower()}, {_q(_left(s, bool(blank)))})" for i, s in enumerate(SHAPES) for blank in (0, 1))
PARTS = f"WITH p AS (SELECT 'p' || p_partkey || '.ts' AS path, (p_size + length(p_type)) % {N} AS shape, p_retailprice > 1200 AS b FROM part)"


def sources(t) -> DataFrame:
    """path, text of a file for each part: its shape by size and type, its blank line by price."""
    shape = F.pmod(F.col("p_size") + F.length("p_type"), F.lit(N))
    texts = F.array(*[F.array(F.lit(s[0] + s[1]), F.lit(s[0] + B + s[1])) for s in SHAPES])
    return t("part").select(F.format_string("p%d.ts", "p_partkey").alias("path"), F.get(F.get(texts, shape), (F.col("p_retailprice") > 1200).cast("int")).alias("text"))


@kernel(PARTS + f""", f AS (SELECT * FROM (VALUES {_FOUND}) v(shape, b, line, col, rule, message, fixable))
SELECT path, CAST(line AS INTEGER) AS line, CAST(col AS INTEGER) AS col, rule, message, fixable FROM p JOIN f USING (shape, b)""")
def e2_rule_findings(t) -> DataFrame:
    return analysis.findings(sources(t))


@kernel(PARTS + f", f AS (SELECT * FROM (VALUES {_LEFT}) v(shape, b, text)) SELECT path, text FROM p JOIN f USING (shape, b)")
def e2_rule_fixed(t) -> DataFrame:
    return analysis.fixed(sources(t))


# -- changed lines: files of twelve statements, of which each order's line items change some --------------------------------

STEP = "if (a) return;\nb();\n"


@kernel("""WITH o AS (SELECT DISTINCT l_orderkey AS k FROM lineitem), g AS (SELECT unnest(range(1, 7)) AS i),
c AS (SELECT DISTINCT l_orderkey AS k, 1 + CAST(l_quantity AS INTEGER) % 12 AS line FROM lineitem),
w AS (SELECT o.k, 2 * i AS line FROM o, g WHERE EXISTS (SELECT 1 FROM c WHERE c.k = o.k AND c.line BETWEEN 2 * i - 1 AND 2 * i)),
b AS (SELECT k, line FROM w UNION ALL SELECT k, 1 FROM o), e AS (SELECT k, line, lead(line, 1, 13) OVER (PARTITION BY k ORDER BY line) - 1 AS last FROM b)
SELECT 'o' || k || '.ts' AS path, CAST(line AS INTEGER) AS line, 'after-guard' AS rule FROM w
UNION ALL SELECT 'o' || k || '.ts', CAST(line AS INTEGER), 'wall' FROM e WHERE last - line >= 5 AND EXISTS (SELECT 1 FROM c WHERE c.k = e.k AND c.line BETWEEN e.line AND e.last)""")
def f10_changed_findings(t) -> DataFrame:
    items = t("lineitem").select(F.format_string("o%d.ts", "l_orderkey").alias("path"), (1 + F.pmod(F.col("l_quantity").cast("int"), F.lit(12))).alias("line"))
    files = items.select("path").distinct().withColumn("text", F.lit(STEP * 6))
    changed = items.distinct().withColumn("kind", F.lit("line"))
    found = analysis.findings(analysis.with_changes(files, changed))
    return found.select("path", "line", "rule")


@kernel("""WITH l AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS r, l_returnflag AS f, l_linestatus AS s FROM lineitem),
a AS (SELECT *, f <> 'R' AS here, sum(CASE WHEN f <> 'R' THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY r) AS line FROM l),
c AS (SELECT k, line FROM a WHERE f = 'A'),
d AS (SELECT DISTINCT k, line FROM a WHERE f = 'R')
SELECT 'o' || k AS path, CAST(line AS INTEGER) AS line, 'line' AS kind FROM c
UNION ALL SELECT 'o' || k, CAST(line AS INTEGER), 'deleted_after' FROM d WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.k = d.k AND c.line IN (d.line, d.line + 1))""")
def g15_changed_lines(t) -> DataFrame:
    """Each order is a diff: returned items were removed, accepted ones added, the rest stay; braces come and go on the way."""
    row = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag")
    rows = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    sign = lambda x: F.when(x["l_returnflag"] == "R", "-").when(x["l_returnflag"] == "A", "+").otherwise(" ")
    body = F.transform("rows", lambda x, i: F.format_string("%su%s(%d);", sign(x), F.lower(x["l_returnflag"]), i))
    n = lambda other: F.size(F.filter("rows", lambda x: x["l_returnflag"] != other))
    first = F.when(n("R") == 0, 0).otherwise(1)
    head = F.format_string("@@ -1,%d +%d,%d @@", n("A"), first, n("R"))
    parts = rows.select(F.format_string("o%d", "l_orderkey").alias("path"), F.concat(F.array(F.lit("diff --git a/x b/x"), head), body).alias("rows"))
    return diffs.changed(parts)


@kernel("""WITH s AS (SELECT s_suppkey AS k, s_acctbal > 5000 AS blank FROM supplier), g AS (SELECT *, CASE WHEN blank THEN 3 ELSE 2 END AS line FROM s)
SELECT 's' || k || '.ts' AS path, CAST(line AS INTEGER) AS line, 's' || k || '.ts:' || line || chr(10) || chr(10) || 'gap above line ' || line || CASE WHEN blank THEN ', 1 blank line' ELSE ', no blank lines' END || chr(10) || '  1        if (a) return;' || chr(10) || '  ' || line || '        b();' || chr(10)
|| 'rule:      after-guard, wants a blank line' || chr(10) || 'because:   the guard on line 1 ends in `return`, so the next statement starts a new step' || chr(10) || 'outranked: none' || chr(10) || 'result:    ' || CASE WHEN blank THEN 'already has a blank line' ELSE '--fix adds a blank line' END AS text FROM g
UNION ALL SELECT 's' || k || '.ts', 1, 's' || k || '.ts:1: no gap ends and no braced body starts on this line' FROM g
UNION ALL SELECT 's' || k || '.ts', 9, 's' || k || '.ts has ' || line || ' lines, not 9' FROM g""")
def x1_explained(t) -> DataFrame:
    blank = F.col("s_acctbal") > 5000
    files = t("supplier").select(F.format_string("s%d.ts", "s_suppkey").alias("path"), F.when(blank, "if (a) return;\n\nb();\n").otherwise("if (a) return;\nb();\n").alias("text"), F.explode(F.array(F.lit(1), F.lit(9), F.when(blank, 3).otherwise(2))).alias("line"))
    return explain.explained(files.select("path", "text").distinct(), files.select("path", "line")).select("path", "line", "text")
