import json

from pyspark.sql import functions as F

from gapweave.operators import catalog, patterns, summary
from gapweave.plans import analysis, batch
from gapweave.streaming import hooks

TEXT = "f();\nif (a) {\n  b();\n}\ng();\nh();\nk();\nl();\nm();\nn();\n"


def line(**more):
    return json.dumps({"id": 1, "path": "a.ts", "text": TEXT, "mode": "check", "braces": None, "changedLines": None, "explain": []} | more)


def test_requests_and_responses(spark):
    asked = [line(), line(id="x", mode="fix"), line(braces="on", mode="fix"), line(mode="fix", changedLines={"lines": [], "deletedAfter": []}), "{", "[]", line(more=1), line(mode="mend"), line(text="f("), line(explain=[0]), line(changedLines={"lines": [-1], "deletedAfter": []})]
    rows = spark.createDataFrame(list(enumerate(asked)), "ord long, value string")
    got = {r.ord: r for r in batch.responses(batch.requests(rows)).collect()}
    assert sorted(got) == list(range(11))
    assert got[0].text == TEXT and [(f.line, f.rule) for f in got[0].findings] == [(1, "wall"), (2, "braces")] and got[0].id == "1"
    assert got[1].text == TEXT.replace("{\n  b();\n}", "b();") and [(f.line, f.rule) for f in got[1].findings] == [(1, "wall")] and got[1].id == '"x"'
    assert "{" in got[2].text and got[3].text == TEXT
    assert [got[i].error for i in (4, 5, 6, 7)] == ["malformed request: not JSON", "malformed request: not an object", "malformed request: unknown field `more`", "malformed request: unknown variant"]
    assert [f.rule for f in got[8].findings] == ["parse"] and got[9].error and got[10].error and got[10].id == "1"


def test_automaton_by_brute_force(spark):
    words = ["he", "she", "his", "hers", "e", "hers"]
    texts = ["ushers", "", "hishehers", "xyz", "éhé she"]
    df = spark.createDataFrame([*enumerate(texts), (9, None)], "k int, t string")
    want = sorted((i, w, a + 1) for i, t in enumerate(texts) for w in words for a in range(len(t)) if t.startswith(w, a))
    assert sorted(map(tuple, patterns.occurrences(df, "k", "t", words).collect())) == want


def test_catalog_and_repairs(spark):
    rules = catalog.catalog(spark).collect()
    assert len(rules) == 13 and {r.rule for r in rules if r.gap is None} == {"edge-blank", "braces", "block-spacing", "wall"} and {r.rule for r in rules if not r.fixable} == {"block-spacing", "wall"}
    found = spark.createDataFrame([("a b.ts", True), ("c.ts", True), ("d.ts", True), ("e.ts", False), ("f.ts", True)], "path string, fixable boolean")
    staged = spark.createDataFrame([("a b.ts", False, False), ("c.ts", True, False), ("d.ts", True, True), ("e.ts", False, False), ("f.ts", False, False), ("g.ts", False, False)], "path string, unstaged boolean, scoped boolean")
    got = [r.line for r in summary.repair_lines(found, staged, "/w x").orderBy("ord").collect()]
    assert got[0].endswith(": d.ts") and got[1].endswith(": c.ts") and got[2] == "fix and restage with: cd '/w x' && gapweave --fix -- 'a b.ts' f.ts && git --literal-pathspecs add -- 'a b.ts' f.ts"


def test_selectors(spark):
    rows = spark.createDataFrame([("r", i, x) for i, x in enumerate(["a", "a/b", "a/b/c", "d/e", "d/e/f", "dd/e"])], "k string, ord int, path string")
    assert {r.path: r.selector for r in summary.selectors(rows, "k").collect()} == {"a": "a", "a/b": "a", "a/b/c": "a", "d/e": "d/e", "d/e/f": "d/e", "dd/e": "dd/e"}


def test_events_as_a_stream(spark, tmp_path):
    """Two events arrive; each gets a reply on the files that it names or that its session wrote."""
    log = tmp_path / "s.jsonl"
    log.write_text("\n".join(json.dumps(x) for x in [{"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "1", "name": "Write", "input": {"file_path": "/w/b.ts"}}]}}]) + "\n")
    events = tmp_path / "events"
    events.mkdir()
    (events / "1.jsonl").write_text("\n".join(json.dumps(x) for x in [{"hook_event_name": "PostToolUse", "cwd": "/w", "tool_name": "Edit", "tool_input": {"file_path": "a.ts"}}, {"hook_event_name": "Stop", "transcript_path": str(log)}, {"hook_event_name": "Stop", "transcript_path": str(log), "stop_hook_active": True}]) + "\n")
    files = spark.createDataFrame([("/w/a.ts", TEXT), ("/w/b.ts", "f();\n"), ("/w/c.ts", TEXT)], "path string, text string")
    seen = []

    def handle(rows, number):
        read = lambda s, names: s.read.text(names).select(F.lit(names[0]).alias("log"), F.monotonically_increasing_id().alias("ord"), "value")
        asked = hooks.passes(rows, "/", read)
        seen.append((sorted(r.path for r in asked.collect()), [r.reason for r in hooks.replies(asked, files).collect()]))

    query = hooks.run(hooks.event_stream(spark, str(events)), str(tmp_path / "state"), handle)
    query.awaitTermination()
    assert [s[0] for s in seen] == [["/w/a.ts", "/w/b.ts"]]
    assert len(seen[0][1]) == 1 and "\n/w/a.ts\n  line 1: split these 8 statements into steps with a blank line (wall)\n" in seen[0][1][0]
    assert analysis.remaining(files.limit(0)).count() == 0
