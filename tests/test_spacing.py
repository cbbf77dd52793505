import random

from pyspark.sql import functions as F

from gapweave.operators import reporting, spacing
from gapweave.sources import selection, transcripts

GAPS = "path string, list_id int, rule string, want string, joined_by string, blanks int, prev struct<idx: int, kind: string, is_let: boolean, binds_read: boolean, multiline: boolean>, next struct<kind: string, detached: boolean, multiline: boolean>"


def _let_steps(gaps):
    """Walks each list from below."""
    rules = [g["rule"] for g in gaps]
    for i in range(len(gaps) - 1, -1, -1):
        g = gaps[i]
        if g["want"] == "none" and g["rule"] != "short-body" and g["let"]:
            k = i - 1
            while k >= 0 and gaps[k]["rule"] == "keep" and gaps[k]["let"] and gaps[k]["read"] and not gaps[k]["multi"] and not gaps[k]["detached"]:
                rules[k] = g["rule"]
                k -= 1
            if k >= 0 and gaps[k]["rule"] == "keep":
                rules[k] = "let-step"
    return rules


def test_let_steps_equal_a_walk(spark):
    rng = random.Random(5)
    want = {"keep": None, "guard-join": "none", "short-body": "none", "after-guard": "some"}
    rows, expect = [], {}
    for n in range(150):
        gaps = []
        for _ in range(rng.randint(1, 9)):
            rule = rng.choice(["keep", "keep", "keep", "guard-join", "short-body", "after-guard"])
            gaps.append({"rule": rule, "want": want[rule], **{k: rng.random() < p for k, p in (("let", 0.8), ("read", 0.8), ("multi", 0.1), ("detached", 0.1))}})
        expect |= {(n, i): r for i, r in enumerate(_let_steps(gaps))}
        rows += [("p", n, g["rule"], g["want"], "x" if g["want"] else None, 0, (i, "Declaration", g["let"], g["read"], g["multi"]), ("Other", g["detached"], False)) for i, g in enumerate(gaps)]
    got = spacing.let_steps(spark.createDataFrame(rows, GAPS)).collect()
    assert {(r.list_id, r.prev.idx): r.rule for r in got} == expect
    assert all(r.want == "some" for r in got if r.rule == "let-step")


def _walls(stmts, least):
    held, run = set(), []
    for i, s in [*enumerate(stmts), (len(stmts), None)]:
        if s and run and s["forced"] and s["counted"] and stmts[i - 1]["counted"]:
            run.append(i)
        else:
            held |= set(run) if len(run) >= least else set()
            run = [i]
    out, run = [], []
    for i, s in [*enumerate(stmts), (len(stmts), None)]:
        use = s and s["counted"] and i not in held
        if use and run and not s["parted"]:
            run.append(i)
        else:
            if len(run) >= least:
                out.append((run[0], len(run)))
            run = [i] if use else []
    return out


def test_walls_equal_a_walk(spark):
    rng = random.Random(6)
    rows, expect = [], set()
    for n in range(150):
        stmts = [{k: rng.random() < p for k, p in (("counted", 0.9), ("forced", 0.6), ("parted", 0.15))} for _ in range(rng.randint(1, 25))]
        expect |= {(n, a, b) for a, b in _walls(stmts, 4)}
        rows += [("p", n, i, "Block", s["counted"], s["forced"], s["parted"]) for i, s in enumerate(stmts)]
    rows += [("p", 999, i, "Switch", True, False, False) for i in range(9)]
    got = spacing.walls(spark.createDataFrame(rows, "path string, list_id int, idx int, list_kind string, counted boolean, forced boolean, parted boolean"), 4)
    assert {(r.list_id, r.idx, r["size"]) for r in got.collect()} == expect


def test_tight_blocks_edges_and_scope(spark):
    row = lambda i, rule, blanks, a, b, m: ("p", i, rule, None, None, blanks, (0, a, False, False, False), (b, False, m))
    gaps = spark.createDataFrame([row(1, "keep", 0, "Other", "Loop", True), row(2, "keep", 1, "Other", "Loop", True), row(3, "keep", 0, "If", "If", True), row(4, "keep", 0, "Other", "Loop", False)], GAPS)
    assert [r.list_id for r in spacing.tight_blocks(gaps).collect()] == [1]
    lists = spark.createDataFrame([("p", 1, True, 1, 3, 5, 7), ("p", 2, False, 1, 3, 5, 7)], "path string, list_id int, braced boolean, open_line int, first_line int, last_line int, close_line int")
    lines = spark.createDataFrame([("p", i, i in (2, 4, 6)) for i in range(1, 8)], "path string, line int, blank boolean")
    assert sorted((r.list_id, r.line) for r in spacing.blank_edges(lists, lines).collect()) == [(1, 2), (1, 6)]
    found = spark.createDataFrame([("p", 1, 3), ("p", 5, 8), ("q", 1, 9)], "path string, a int, b int")
    changed = spark.createDataFrame([("p", 3, "deleted_after"), ("p", 8, "line")], "path string, line int, kind string")
    assert [(r.path, r.a) for r in spacing.in_scope(found, changed, "a", "b").collect()] == [("p", 5)]
    assert spacing.in_scope(found, None, "a", "b").count() == 3


def test_selection(spark):
    paths = spark.createDataFrame([("src/a.ts",), ("src/gen/b.ts",), ("lib/c.tsx",), ("lib/keep.log",), ("x.log",), ("README",), ("deep/er/build/o.js",), ("build",)], "path string")
    got = {r.path: r.ignored for r in selection.ignored(paths, ["# note", "*.log", "!lib/keep.log", "/src/gen/", "build/"]).collect()}
    assert {p for p, i in got.items() if i} == {"src/gen/b.ts", "x.log", "deep/er/build/o.js"}
    assert {r.path for r in paths.filter(selection.is_source("path")).collect()} == {"src/a.ts", "src/gen/b.ts", "lib/c.tsx", "deep/er/build/o.js"}
    assert {r.path for r in paths.filter(selection.in_folder("path", ["build"])).collect()} == {"deep/er/build/o.js"}
    v = spark.range(4).select("id", selection.verdict(F.col("id") == 0, F.col("id") <= 1, F.col("id") <= 2).alias("v"))
    assert [r.v for r in v.orderBy("id").collect()] == ["opted-out", "excluded", "generated", "kept"]
    one = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    assert sorted((r.path, r.hunked) for r in selection.changed_files(one("a", "b", "b"), one("b", "c"), one("a", "c")).collect()) == [("a", True), ("c", False)]


def test_transcripts(spark):
    call = lambda i, name, path: '{"type":"assistant","message":{"content":[{"type":"tool_use","id":"%s","name":"%s","input":{"file_path":"%s"}}]}}' % (i, name, path)
    fail = '{"type":"user","message":{"content":[{"type":"tool_result","tool_use_id":"2","is_error":true}]}}'
    values = [call(1, "Write", "/a"), call(2, "Edit", "/b"), fail, call(3, "Read", "/c"), call(4, "Edit", "d"), "not json tool_use", call(1, "Write", "/e"), call(5, "MultiEdit", "/e")]
    lines = spark.createDataFrame([("log", i, v) for i, v in enumerate(values)], "log string, ord long, value string")
    assert [(r.path, r.ord) for r in transcripts.writes(lines).collect()] == [("/e", 0)]
    e = spark.createDataFrame([('{"hook_event_name":"Stop"}',), ('{"hook_event_name":"Stop","stop_hook_active":true}',), ("?",)], "value string")
    assert transcripts.events(e).count() == 1


def test_reporting(spark):
    f = spark.createDataFrame([("b", 1, 2, "wall", "m", False), ("a", 10, 1, "use-join", "n", True), ("a", 9, 1, "use-join", "n", True)], "path string, line int, col int, rule string, message string, fixable boolean")
    assert [r.row for r in reporting.plain_rows(f).collect()] == ["a:9:1: use-join: n", "a:10:1: use-join: n", "b:1:2: wall: m (by hand)"]
    assert reporting.json_rows(f).first().row == '{"path":"a","line":9,"col":1,"rule":"use-join","message":"n","fixable":true}'
    assert [(r.line, r.more) for r in reporting.leading(f, 2).collect()] == [(9, 1), (10, 1)]
    assert {r.place for r in reporting.widths(f).collect()} == {"1:2", "9:1 ", "10:1"}
    none = f.limit(0)
    assert [reporting.status(x, y).first().status for x, y in ((none, none), (f, none), (none, f))] == [0, 1, 2]
    at = spark.createDataFrame([("a:b.ts:3",), ("x.ts:4:5",), ("x.ts",)], "t string").select(reporting.location("t").alias("l")).collect()
    assert [tuple(r.l) if r.l else None for r in at] == [("a:b.ts", 3, None), ("x.ts", 4, 5), None]
