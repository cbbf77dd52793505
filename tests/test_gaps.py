from pyspark.sql import Row

from gapweave.functions.text import is_blank, lines
from gapweave.operators import gaps

BASE = dict(path="a.ts", list_id=1, list_kind="Block", kind="Other", multiline=False, compact=True, guard=False, jump=None, case_body=False, names=[], reads=[], detached=False, frozen=False)
SCHEMA = "path string, list_id int, idx int, list_kind string, kind string, start_line int, end_line int, multiline boolean, compact boolean, guard boolean, jump string, case_body boolean, names array<string>, reads array<string>, detached boolean, frozen boolean"


def stmts(spark, *rows):
    made = [Row(**(BASE | {"idx": i, "start_line": 2 * i + 1, "end_line": 2 * i + 1} | r)) for i, r in enumerate(rows)]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in made], SCHEMA)


def rules(spark, *rows):
    return [(r.rule, r.want, r.joined_by) for r in gaps.decided(stmts(spark, *rows)).orderBy("prev.idx").collect()]


def test_ladder(spark):
    wide = [{}] * 4
    assert rules(spark, {}, {}) == [("short-body", "none", None)]
    assert rules(spark, {"guard": True}, {"guard": True}, *wide)[0] == ("guard-chain", "none", None)
    assert rules(spark, {"multiline": True, "compact": False}, {}, *wide)[0] == ("after-multiline", "some", None)
    assert rules(spark, {"kind": "Import", "multiline": True, "compact": False}, {"kind": "Import"}, *wide)[0][0] == "keep"
    assert rules(spark, {"kind": "Declaration", "names": ["x"]}, {"kind": "If", "reads": ["y", "x"]}, *wide)[0] == ("guard-join", "none", "x")
    assert rules(spark, {"names": ["x"]}, {"kind": "Return", "reads": ["x"]}, *wide)[0][0] == "consume-join"
    assert rules(spark, {"names": ["x"]}, {"kind": "Loop", "reads": ["x"]}, *wide)[0][0] == "keep"
    assert rules(spark, {"kind": "Declaration", "names": ["x"]}, {"kind": "Loop", "reads": ["x"]}, *wide)[0][0] == "use-join"
    assert rules(spark, {"guard": True, "jump": "Return", "kind": "If"}, {}, *wide)[0] == ("after-guard", "some", None)
    assert rules(spark, {"guard": True, "jump": "Return", "kind": "If"}, {"frozen": True}, *wide)[0] == ("frozen", None, None)
    assert rules(spark, {"list_kind": "Switch", "kind": "Case", "case_body": True}, {"list_kind": "Switch", "kind": "Case"}, *[{"list_kind": "Switch"}] * 3)[0][0] == "switch-clauses"


def test_edits(spark):
    text = "one\n\ntwo {\n}\nthree\r\n"
    s = stmts(spark, {"names": ["x"], "compact": False}, {"kind": "Return", "reads": ["x"], "multiline": True, "compact": False, "start_line": 3, "end_line": 4}, {"start_line": 5, "end_line": 5})
    ls = lines(spark.createDataFrame([("a.ts", text)], "path string, text string"), "path", "text").withColumn("blank", is_blank("line_text"))
    edits = gaps.line_edits(gaps.decided(s), ls)
    assert sorted((r.line, r.op, r.rule) for r in edits.collect()) == [(2, "delete", "consume-join"), (4, "insert_after", "after-multiline")]
    assert gaps.applied(ls, edits).first().text == "one\ntwo {\n}\n\nthree\r\n"
