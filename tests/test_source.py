from pyspark.sql import functions as F

from gapweave.functions.syntax import analyse
from gapweave.plans import analysis
from gapweave.sources import statements as st


def kinds(text, ext="ts"):
    found = analyse(text, ext)
    assert found["error"] is None, found["error"]
    return [(s["list_kind"], s["kind"]) for s in sorted(found["stmts"], key=lambda s: (s["list_id"], s["idx"]))]


def test_statements():
    assert kinds("import a from 'a'\nconst x = a\n  .b(1)\nlet y = /[/]}/.test(`${x}}`)\nx++\nreturn") == [("Module", k) for k in ("Import", "Declaration", "Declaration", "Other", "Return")]
    assert kinds("if (a) return\nelse { b() }\nfor (const x of y) f(x)\ndo { g() } while (z)\n") == [("Module", "If"), ("Module", "Loop"), ("Module", "Loop"), ("Block", "Other"), ("Block", "Other")]
    assert kinds("switch (a) { case 1: f(); break\n default: g() }") == [("Module", "Switch"), ("Switch", "Case"), ("Switch", "Case"), ("Block", "Other"), ("Block", "Break"), ("Block", "Other")]
    assert kinds("class A { static { f() } m(): Map<string, {a: 1}> { g(() => { h() }) } }") == [("Module", "Other")] + [("Block", "Other")] * 3
    assert kinds("const v = <T>(x: T): T => { return x }\ntry { a() } finally { b() }") == [("Module", "Declaration"), ("Module", "Try"), ("Block", "Return"), ("Block", "Other"), ("Block", "Other")]
    assert kinds("const v = <p a={() => { f() }}>it's {x.map((y) => { return <b>{y}</b> })}</p>", "tsx") == [("Module", "Declaration"), ("Block", "Other"), ("Block", "Return")]
    assert kinds("") == [] and analyse(None)["error"] is None


def test_unreadable():
    for text in ("f(", "}", "`a", "a\rb", "(" + "[" * 3 + ")", "@"):
        assert analyse(text)["error"] and not analyse(text)["stmts"]
    assert analyse("`a\rb`")["error"] is None
    assert analyse("{" * 5000 + "}" * 5000)["error"] == "nested too deeply"


def facts(text, at=0):
    return [s for s in analyse(text)["stmts"] if s["list_kind"] == "Module"][at]


def test_names_and_reads():
    assert facts("const {a, b: [c, d = e], ...f} = g, h = 1")["names"] == ["a", "c", "d", "f", "h"]
    assert facts("this.a.b[k] = 1")["names"] == ["this.a.b[k]"] and facts("(q as T).x = 1")["names"] == ["q.x"]
    assert facts("if (a.b) { const c = 1; c(d, { e: f }, () => g) }")["reads"] == ["a", "a.b", "d", "f"]
    assert facts("function f(a) { return a + b }")["reads"] == ["f", "b"]
    jsx = analyse("return <p><A.B c={d} />{(E) => <E />}<_f /></p>", "tsx")["stmts"][0]
    assert (jsx["kind"], jsx["reads"]) == ("Return", ["A", "A.B", "d", "_f"])
    assert (facts("if (x) throw y")["guard"], facts("if (x) throw y")["jump"], facts("if (x) { a(); b() }")["guard"]) == (True, "Throw", False)


BEFORE = """function f(xs) {

  const a = g();

  if (!a) return;
  h(a);
  let n = 0;
  for (const x of xs) {
    n += x;
  }
  h(n);
  // gapweave-ignore
  if (n) return;
  h();
  done();
}
"""
AFTER = """function f(xs) {
  const a = g();
  if (!a) return;

  h(a);

  let n = 0;
  for (const x of xs) {
    n += x;
  }

  h(n);
  // gapweave-ignore
  if (n) return;
  h();
  done();
}
"""


def test_findings_and_text(spark):
    files = spark.createDataFrame([("a.ts", BEFORE, 1), ("b.ts", AFTER, 2), ("c.ts", "f(", 3), ("d.ts", None, 4)], "path string, text string, error int")
    got = [(r.path, r.line, r.col, r.rule) for r in analysis.findings(files, braces=False).orderBy("path", "line", "rule").collect()]
    assert got == [("a.ts", 2, 1, "edge-blank"), ("a.ts", 5, 3, "guard-join"), ("a.ts", 6, 3, "after-guard"), ("a.ts", 7, 3, "let-step"), ("a.ts", 11, 3, "after-multiline"), ("c.ts", 1, 1, "parse")]
    assert {r.path: r.text for r in analysis.fixed(files, braces=False).collect()} == {"a.ts": AFTER, "b.ts": AFTER, "c.ts": "f(", "d.ts": ""}


def test_regions_and_empty_table(spark):
    text = "f();\n// gapweave-off\nif (a) return;\nb();\n// gapweave-on\nif (a) return;\nb();\n"
    files = spark.createDataFrame([("a.ts", text)], "path string, text string")
    assert [(r.line, r.rule) for r in analysis.findings(files).collect()] == [(7, "after-guard")]
    assert analysis.findings(files.limit(0)).count() == 0 and st.statements(st.parsed(files.limit(0))).count() == 0


def test_copies_are_read_once(spark, monkeypatch):
    read, parsed = [], st.parsed
    monkeypatch.setattr(st, "parsed", lambda files, *a, **k: [read.append(files.count()), parsed(files, *a, **k)][1])
    text = "if (a) return;\nb();\n"
    files = spark.createDataFrame([("a.ts", text), ("b.ts", text), ("b.ts", text), (None, text), ("c.TSX", text), ("ts", text), ("d.ts", "b();\n"), ("e.ts", "")], "path string, text string")
    found = sorted((str(r.path), r.line, r.rule) for r in analysis.findings(files).collect())
    assert found == [(x, 2, "after-guard") for x in ("None", "a.ts", "b.ts", "b.ts", "c.TSX", "ts")]
    assert read == [4]
    assert sorted((str(r.path), r.text) for r in analysis.fixed(files).collect()) == sorted((str(r.path), r.text.replace(";\nb", ";\n\nb")) for r in files.collect())


def test_contents_differ_by_settings_and_changes(spark):
    text, rows = "if (a) {\n  b();\n}\n", [("a.ts", True, None), ("b.ts", False, None), ("c.ts", None, [9]), ("d.ts", None, [])]
    files = spark.createDataFrame([(p, text, b, lines) for p, b, lines in rows], "path string, text string, braces boolean, lines array<int>")
    names, texts = st.contents(files)
    assert names.count() == texts.count() == 4 and st.contents(files.withColumn("path", F.concat(F.lit("x/"), "path")))[1].count() == 4
    assert [r.path for r in analysis.findings(files).collect()] == ["a.ts"]


def test_rules_of_repeated_parts(spark, monkeypatch):
    from gapweave.plans import rules_from_source as rules

    read, parsed = [], st.parsed
    monkeypatch.setattr(st, "parsed", lambda files, *a, **k: [read.append(files.count()), parsed(files, *a, **k)][1])
    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_partkey", "p_size", "p_type", "p_retailprice")
    more = part.withColumn("p_partkey", F.explode(F.array(*[F.col("p_partkey") + 1_000_000 * i for i in range(9)])))
    once = {(r.path, r.line, r.rule) for r in analysis.findings(rules.sources(lambda _: part)).collect()}
    got = analysis.findings(rules.sources(lambda _: more)).count()
    assert got == 9 * len(once) and read[0] == read[1] <= 2 * rules.N


def test_names_are_neither_dealt_nor_broadcast(spark, monkeypatch):
    files = spark.range(300).select(F.format_string("f%d.ts", "id").alias("path"), F.when(F.col("id") % 2 == 0, "if (a) return;\nb();\n").otherwise("b();\n").alias("text"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for out in (analysis.findings(files), analysis.fixed(files)):
            assert "BroadcastHashJoin" in plan(out) and "hashpartitioning" not in plan(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    monkeypatch.setattr(analysis, "MOST_BROADCAST", 0)
    found, text = analysis.findings(files), analysis.fixed(files)
    assert "BroadcastExchange" not in plan(found) + plan(text)
    assert found.count() == 150 and text.filter(F.col("text") == "if (a) return;\n\nb();\n").count() == 150


def test_sources_of_tied_and_odd_rows(spark):
    from gapweave.plans import from_source as fs

    ddl = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double, l_quantity double, l_discount double"
    rows = [
        (1, 2, 5, 1, 1.0, 30.0, 0.0), (1, 1, 9, 1, 1.0, 10.0, 0.0), (1, 2, 4, 7, 1.0, 10.0, 0.02),  # by part
        (2, 1, 5, 2, 1.0, 30.0, 0.1), (2, 1, 5, 1, 9.0, 10.0, 0.1), (2, 1, 5, 1, 8.0, 40.0, 0.0),  # tied on line and part
        (3, 1, None, 1, 1.0, 30.0, 0.1), (3, None, 5, 1, 1.0, 10.0, 0.1), (3, 1, 5, 1, 1.0, 10.0, None),
        (4, 1, 1 << 60, 1, 1.0, 30.0, 0.1), (4, 1, -3, 1, 1.0, 10.0, 0.1), (4, -1, 5, 1, 1.0, None, 0.0),
        (5, 1, 5, 1, 1.0, 30.0, 0.1), (5, 1, 5, 1, 1.0, 30.0, 0.1),  # equal rows
        (None, 2, 5, 1, 1.0, 30.0, 0.1), (None, 1, 5, 1, 1.0, 10.0, 0.0), (None, 1, 5, 0, 1.0, 30.0, 0.0),
    ]
    items = spark.createDataFrame(rows, ddl)
    assert [len(r.rows) for r in fs.packed(items).filter("l_orderkey = 2").collect()] == [3]
    sent = items.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*fs.ORDER))).alias("rows")).collect()
    say = lambda i, x: ("\n" if i and x.l_discount is not None and x.l_discount < 0.03 else "") + ("if (x) return;" if x.l_quantity is not None and x.l_quantity > 25 else "step();")
    wanted = {(f"o{'null' if r.l_orderkey is None else r.l_orderkey}.ts", "\n".join(say(i, x) for i, x in enumerate(r.rows))) for r in sent}
    got = fs.sources(lambda _: items)
    assert {tuple(r) for r in got.collect()} == wanted and got.count() == 6
    assert fs.sources(lambda _: items.limit(0)).count() == 0


def test_small_files_of_many_parts_are_not_broadcast(spark, monkeypatch):
    from gapweave.plans import rules_from_source as rules

    part = spark.read.parquet("/root/testdata/sf0.001/part.parquet").limit(20)
    monkeypatch.setattr(analysis, "MOST_BROADCAST", 0)  # as if there were many findings; the names' compressed files stay below Spark's own limit
    found = analysis.findings(rules.sources(lambda _: part))
    assert "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString() and found.count() > 0


def test_plan_of_findings_is_small(spark, monkeypatch):
    """The driver's memory follows the plan, whatever the input: lists of statements are read for gaps and for walls, what the pass found in one branch."""
    plans = []
    monkeypatch.setattr(analysis, "stored", lambda df: [plans.append(df._jdf.queryExecution().executedPlan().toString()), df][1])
    analysis.findings(spark.createDataFrame([("a.ts", BEFORE)], "path string, text string"))
    assert (plans[0].count("Scan ExistingRDD"), plans[0].count("inline(stmts")) == (4, 2) and plans[0].count("Window [") <= 17


def test_walls_of_all_lists_in_scope(spark):
    six = "".join(f"s{i}();\n" for i in range(6))
    text = f"import a from 'a';\n{six}\nfunction f() {{\n{six}s();\n}}\n\nfunction g() {{\n{six[:-6]}}}\n\nfunction h() {{\n\n  s();\n}}\n"
    rows = [("all.ts", None, None), ("in.ts", [3], []), ("out.ts", [1, 8, 9, 17], []), ("cut.ts", [], [6]), ("end.ts", None, [7, 16]), ("both.ts", [7], [10]), ("none.ts", [], [])]
    files = spark.createDataFrame([(p, text, x, y) for p, x, y in rows] + [("bad.ts", "f(", None, None)], "path string, text string, lines array<int>, deleted array<int>")
    found = [tuple(r) for r in analysis.findings(files).collect()]
    wall = lambda path, line, n: (path, line, 1, "wall", analysis.WALL % n, False)
    assert sorted(x for x in found if x[3] == "wall") == sorted([wall("all.ts", 2, 6), wall("all.ts", 10, 7), wall("in.ts", 2, 6), wall("cut.ts", 2, 6), wall("both.ts", 2, 6), wall("both.ts", 10, 7)])
    assert [x[1:] for x in found if x[0] == "bad.ts"] == [(1, 1, "parse", "unexpected end", False)]
    assert [x[1:] for x in found if x[0] == "all.ts" and x[3] == "edge-blank"] == [(28, 1, "edge-blank", analysis.AFTER, True)]
