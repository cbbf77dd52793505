"""Selection, paths, events, reports: the operators themselves over tables made of the driver's, each beside its SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as p
from ..operators import summary
from ..sources import diffs, selection
from ..sources import events as ev
from ..sources import transcripts
from .kernels import kernel


@kernel("""SELECT event_id, '/' || event_type || '/u' || user_id || '/' || event_id || '.ts' AS whole, '/' || event_type || '/u' || user_id AS folder, event_id || '.ts' AS name, '.ts' AS extension,
'../u' || user_id || '/' || event_id || '.ts' AS way, CASE WHEN value > 10 THEN '../' ELSE '' END || 'x/' || event_id AS other FROM events""")
def p21_paths(t) -> DataFrame:
    messy = F.concat(F.lit("./b/../"), "event_type", F.lit("//u"), "user_id", F.lit("/x/.././"), "event_id", F.lit(".ts"))
    e = t("events").select("event_id", "event_type", "value", p.resolved(F.lit("/"), messy).alias("whole"))
    near = F.concat(F.lit("/r/x/"), "event_id")
    base = F.when(F.col("value") > 10, "/r/y").otherwise("/r")
    return e.select("event_id", "whole", p.directory("whole").alias("folder"), p.name("whole").alias("name"), p.extension("whole").alias("extension"), p.relative(F.concat(F.lit("/"), "event_type", F.lit("/z")), "whole").alias("way"), p.relative(base, near).alias("other"))


@kernel(r"""WITH x AS (SELECT conv_id, turn, substr(text, 1, 24) || CASE WHEN turn % 3 = 0 THEN chr(10) || '"\é' WHEN turn % 3 = 1 THEN chr(7) || chr(127) ELSE '' END AS s FROM conversations),
h AS (SELECT *, hex(encode(s)) AS h FROM x),
b AS (SELECT *, list_transform(range(0, len(h) // 2), lambda i : CAST('0x' || substr(h, CAST(2 * i + 1 AS BIGINT), 2) AS INTEGER)) AS b FROM h)
SELECT conv_id, turn, CASE WHEN regexp_matches(s, '[\x00-\x1F\x7F-\x{9F}"\\\x{2028}\x{2029}]') THEN '"' || list_aggregate(list_transform(b, lambda n : CASE n WHEN 34 THEN '\"' WHEN 92 THEN '\\' WHEN 7 THEN '\a' WHEN 8 THEN '\b' WHEN 9 THEN '\t' WHEN 10 THEN '\n' WHEN 11 THEN '\v' WHEN 12 THEN '\f' WHEN 13 THEN '\r'
ELSE CASE WHEN n BETWEEN 32 AND 126 THEN chr(n) ELSE '\' || format('{:03o}', n) END END), 'string_agg', '') || '"' ELSE s END AS shown FROM b""")
def p22_shown(t) -> DataFrame:
    third = F.col("turn") % 3
    odd = F.when(third == 0, F.lit('\n"\\é')).when(third == 1, F.lit("\x07\x7f")).otherwise("")
    return t("conversations").select("conv_id", "turn", p.shown(F.concat(F.substring("text", 1, 24), odd)).alias("shown"))


@kernel(r"""SELECT p_partkey, CASE WHEN regexp_full_match(w, '[A-Za-z0-9_@%+:,./-]+') THEN w ELSE '''' || replace(w, '''', '''\''''') || '''' END AS word, p_size || CASE WHEN p_size = 1 THEN ' file' ELSE ' files' END AS files
FROM (SELECT *, CASE WHEN p_size < 20 THEN p_brand WHEN p_size < 35 THEN p_name || '''s' ELSE p_type END AS w FROM part)""")
def p25_shell_word(t) -> DataFrame:
    word = F.when(F.col("p_size") < 20, F.col("p_brand")).when(F.col("p_size") < 35, F.concat("p_name", F.lit("'s"))).otherwise(F.col("p_type"))
    return t("part").select("p_partkey", p.shell_word(word).alias("word"), p.counted("p_size", "file").alias("files"))


NAMES = ("a.ts", "b.gen.tsx", "c.min.js", "d.d.mts", "e.generated.x.ts", "regen.ts", "f.md", "min.js", "g.min.ts", "h.cjs", "noext", "i.d.ts.map")
TOPS = ("src", "dist", "lib/node_modules/z", "build.d", "migrations")
FILES = f"""WITH f AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey, l_suppkey, l_extendedprice, l_returnflag AS flag, l_linestatus AS status, l_tax,
list_extract({list(TOPS)}, 1 + CAST(l_suppkey % 5 AS INTEGER)) || '/' || l_partkey || '-' || l_linenumber || '/' || list_extract({list(NAMES)}, 1 + CAST(l_quantity AS INTEGER) % 12) AS path FROM lineitem),
c AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM f),
d AS (SELECT *, regexp_matches(name, '\\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$') AND NOT regexp_matches(name, '\\.d\\.[mc]?ts$') AS source,
regexp_matches(name, '\\.generated\\.|\\.gen\\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$|\\.min\\.(js|mjs|cjs)$') AS gen, regexp_matches(path, '(^|/)(node_modules|dist|migrations)/') AS skipped FROM c)"""


def listing(t) -> DataFrame:
    names, tops = (F.array(*[F.lit(x) for x in xs]) for xs in (NAMES, TOPS))
    path = F.concat_ws("/", F.get(tops, (F.col("l_suppkey") % 5).cast("int")), F.concat_ws("-", "l_partkey", "l_linenumber"), F.get(names, F.col("l_quantity").cast("int") % 12))
    return t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "l_returnflag", "l_linestatus", "l_tax", path.alias("path"))


@kernel(FILES + " SELECT k, n, path, CAST(CASE WHEN NOT source OR gen THEN 0 WHEN skipped THEN 1 ELSE 2 END AS INTEGER) AS candidacy FROM d")
def f4_candidacy(t) -> DataFrame:
    return listing(t).select("k", "n", "path", selection.candidacy("path").cast("int").alias("candidacy"))


@kernel(FILES + """, v AS (SELECT path, bool_or(flag = 'R' AND l_tax < 0.03) AS out, bool_or(flag = 'A' AND l_tax < 0.05) AND NOT bool_or(flag = 'R' AND l_tax < 0.03) AS kept, bool_or(status = 'F' AND l_tax > 0.06) AS marked FROM d GROUP BY path)
SELECT DISTINCT path, CASE WHEN NOT source THEN 'no-source' WHEN out THEN 'opted-out' WHEN skipped AND NOT kept THEN 'excluded' WHEN gen OR marked THEN 'generated' ELSE 'kept' END AS verdict FROM d JOIN v USING (path)""")
def s3_selected(t) -> DataFrame:
    """Listed files with attributes: opting out, keeping what folders exclude, marked as generated."""
    files = listing(t)
    value = F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") < 0.03), F.struct(F.lit(2).alias("ord"), F.lit("unset").alias("value"))).when((F.col("l_returnflag") == "A") & (F.col("l_tax") < 0.05), F.struct(F.lit(1).alias("ord"), F.lit("set").alias("value")))
    own = files.select(F.lit("r").alias("root"), "path", F.lit("gapweave").alias("name"), value.alias("v")).filter("v is not null").select("root", "path", "name", "v.ord", "v.value")
    marked = files.filter("l_linestatus = 'F' and l_tax > 0.06").select(F.lit("r").alias("root"), "path", F.lit("linguist-generated").alias("name"), F.lit(1).alias("ord"), F.lit("true").alias("value"))
    listed = files.select(F.lit("r").alias("root"), "path", F.lit(0).alias("argument")).distinct()
    return selection.selected(listed, selection.attributes(own.unionByName(marked))).select("path", "verdict")


@kernel(FILES + """, i AS (SELECT *, (regexp_matches(path, '(^|/)node_modules/') OR starts_with(path, 'dist/') OR regexp_matches(name, '\\.gen\\.') OR regexp_matches(path, '^src/[^/]*1-[0-9]/[^/]*$') AND NOT regexp_matches(name, '^[abc]\\.')) AS ignored FROM d)
SELECT k, n, path, ignored FROM i""")
def f7_ignored(t) -> DataFrame:
    rules = ["# folders", "node_modules/", "/dist", "*.gen.*", "src/*1-[0-9]/*", "!src/*/[a-c].*", "*.gen.*"]
    return selection.ignored(listing(t).select("k", "n", "path"), rules)


HEADS = ("// @generated", "/* Code generated by x. DO NOT EDIT. */", "// This file was automatically generated", "/**\n * auto-generated file\n */", "// Generated by x\n// do not modify", "// generated by hand", "const a = '// @generated'", "x();\n// do not edit", "// see @generatedness", "let s = `\n// @generated\n`")
MARKED = (True, True, True, True, True, False, False, False, False, False)


@kernel(f"SELECT p_partkey, list_extract({[str(m).lower() == 'true' for m in MARKED]}, 1 + p_size % 10) AND p_retailprice < 1500 AS generated FROM part".replace("True", "true").replace("False", "false"))
def f5_generated_header(t) -> DataFrame:
    """Headers of each kind; behind ten lines of code they don't count."""
    heads = F.array(*[F.lit(x) for x in HEADS])
    text = F.concat(F.when(F.col("p_retailprice") < 1500, "").otherwise("a();\n" * 10), F.get(heads, F.col("p_size") % 10), F.lit("\nb();\n"))
    return selection.with_generated(t("part").select("p_partkey", text.alias("text"))).select("p_partkey", "generated")


@kernel("""WITH o AS (SELECT user_id, event_id, event_type, value, '/r/' || event_type || '/f' || CAST(floor(value) AS INTEGER) AS path FROM events),
g AS (SELECT path, min(event_id) AS ord, '/r/' || event_type AS root FROM o WHERE event_type <> 'click' GROUP BY path, event_type),
h AS (SELECT path, min(event_id) AS ord, '/r' AS root FROM o WHERE event_type = 'click' GROUP BY path)
SELECT root, string_agg(path, ',' ORDER BY ord, path) AS paths FROM (SELECT * FROM g UNION ALL SELECT * FROM h) GROUP BY root""")
def a7_by_repository(t) -> DataFrame:
    e = t("events").select(F.concat(F.lit("/r/"), "event_type", F.lit("/f"), F.floor("value").cast("int")).alias("path"), F.col("event_id").alias("ord"), "event_type")
    roots = e.filter("event_type <> 'click'").select(F.concat(F.lit("/r/"), "event_type").alias("root")).distinct().unionByName(e.sparkSession.createDataFrame([("/r",)], "root string"))
    return selection.by_repository(e.select("path", "ord"), roots).select("root", F.array_join("paths", ",").alias("paths"))


@kernel("""WITH RECURSIVE s AS (SELECT p_brand AS brand, p_name AS path, p_partkey AS ord, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS r FROM part),
w AS (SELECT brand, ord, path, r, 0 AS batch, strlen(path) AS size FROM s WHERE r = 1
UNION ALL SELECT s.brand, s.ord, s.path, s.r, CASE WHEN w.size + strlen(s.path) > 400 THEN w.batch + 1 ELSE w.batch END, CASE WHEN w.size + strlen(s.path) > 400 THEN strlen(s.path) ELSE w.size + strlen(s.path) END FROM w JOIN s ON s.brand = w.brand AND s.r = w.r + 1)
SELECT brand, ord, path, CAST(batch AS INTEGER) AS batch FROM w""")
def a8_batches(t) -> DataFrame:
    return summary.batches(t("part").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("ord"), F.col("p_name").alias("path")), "brand", 400)


RUNS = """WITH f AS (SELECT l_orderkey AS k, l_suppkey AS file, count(*) FILTER (l_quantity > 25) AS n, count(*) FILTER (l_quantity > 25 AND l_tax > 0.02) AS fix, count(*) FILTER (l_quantity <= 2) AS bad FROM lineitem GROUP BY 1, 2),
r AS (SELECT k, CAST(sum(n) AS BIGINT) AS findings, CAST(sum(fix) AS BIGINT) AS fixable, count(*) FILTER (n > 0) AS files, count(*) FILTER (bad > 0) AS failed, count(*) AS checked FROM f GROUP BY k)"""


def run_findings(t) -> DataFrame:
    rows = t("lineitem").select(F.col("l_orderkey").alias("k"), F.format_string("f%05d.ts", "l_suppkey").alias("path"), "l_linenumber", "l_quantity", "l_tax")
    rule = F.when(F.col("l_quantity") > 25, F.when(F.col("l_tax") > 0.02, "after-guard").otherwise("wall")).when(F.col("l_quantity") <= 2, "parse")
    return rows.withColumn("rule", rule).filter("rule is not null").withColumn("fixable", F.col("rule") == "after-guard")


@kernel(RUNS + """, m AS (SELECT *, CASE WHEN o_orderstatus = 'F' THEN 'fix' ELSE 'check' END AS mode, CASE WHEN o_orderpriority LIKE '1%' THEN 'staged' WHEN o_orderpriority LIKE '2%' THEN 'changed' ELSE 'paths' END AS scope,
CASE WHEN o_orderpriority LIKE '4%' THEN 0 ELSE checked END AS c, CASE WHEN o_orderstatus = 'F' THEN CAST(floor(o_totalprice) AS BIGINT) % 3 ELSE 0 END AS rewritten FROM r JOIN orders ON k = o_orderkey),
x AS (SELECT *, CASE WHEN scope = 'staged' THEN 'staged file' ELSE 'file' END AS w, CASE WHEN scope = 'staged' THEN 'fixable' ELSE 'fixable with --fix' END AS wf, findings - fixable AS hand FROM m),
y AS (SELECT *, 'checked ' || c || ' ' || w || CASE WHEN c = 1 THEN '' ELSE 's' END AS checked_text, findings || ' finding' || CASE WHEN findings = 1 THEN '' ELSE 's' END AS found, CASE WHEN findings = 1 THEN '' ELSE 'all ' END AS every FROM x),
z AS (SELECT *, found || ' in ' || files || ' ' || w || CASE WHEN files = 1 THEN '' ELSE 's' END AS found_in, CASE WHEN rewritten = 0 THEN checked_text ELSE 'rewrote ' || rewritten || ' file' || CASE WHEN rewritten = 1 THEN '' ELSE 's' END END AS done FROM y),
l AS (SELECT *, CASE WHEN mode = 'check' THEN CASE WHEN findings = 0 THEN checked_text || ', no findings' WHEN hand = 0 THEN found_in || ', ' || every || wf WHEN fixable = 0 THEN found_in || ', ' || every || 'by hand' ELSE found_in || ': ' || fixable || ' ' || wf || ', ' || hand || ' by hand' END
ELSE CASE WHEN findings = 0 AND rewritten = 0 AND failed = 0 THEN done || ', nothing to fix' WHEN findings = 0 THEN done || ', no findings left' ELSE done || ', ' || found || ' left to fix by hand' END END AS line FROM z)
SELECT k, CASE WHEN c = 0 THEN CASE WHEN scope = 'paths' THEN NULL ELSE 'no ' || scope || ' files to ' || mode END ELSE line || CASE WHEN failed = 0 THEN '' ELSE ', ' || failed || ' file' || CASE WHEN failed = 1 THEN '' ELSE 's' END || ' failed' END END AS line FROM l""")
def a2_summary(t) -> DataFrame:
    """The closing line of each order as a run: its suppliers are files, its line items findings."""
    files = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.count_distinct("l_suppkey").alias("checked"))
    o = t("orders").select(F.col("o_orderkey").alias("k"), "o_orderstatus", "o_orderpriority", "o_totalprice")
    zero = {c: 0 for c in ("findings", "fixable", "files", "failed")}
    runs = files.join(o, "k").join(summary.tallied(run_findings(t), ["k"]), "k", "left").fillna(zero)
    fix = F.col("o_orderstatus") == "F"
    runs = runs.withColumn("rewritten", F.when(fix, F.floor("o_totalprice") % 3).otherwise(0)).withColumn("checked", F.when(F.startswith("o_orderpriority", F.lit("4")), 0).otherwise(F.col("checked")))
    scope = F.when(F.startswith("o_orderpriority", F.lit("1")), "staged").when(F.startswith("o_orderpriority", F.lit("2")), "changed").otherwise("paths")
    return runs.select("k", summary.summary_line(F.when(fix, "fix").otherwise("check"), scope, F.lit(False)).alias("line"))


@kernel("""SELECT o_custkey, bool_or(o_orderstatus = 'P') AS failed, count(*) AS checked, CAST(sum(CASE WHEN o_totalprice < 50000 THEN 1 ELSE 0 END) AS BIGINT) AS generated, max_by(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS kept,
coalesce(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (o_totalprice > 150000), '') AS rewritten FROM orders GROUP BY 1""")
def a3_merged(t) -> DataFrame:
    o = t("orders").select("o_custkey", F.col("o_orderkey").alias("ord"), (F.col("o_orderstatus") == "P").alias("failed"), F.lit(1).alias("checked"), (F.col("o_totalprice") < 50000).cast("int").alias("generated"), F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("kept"), F.when(F.col("o_totalprice") > 150000, F.col("o_orderkey").cast("string")).alias("rewritten"))
    return summary.merged(o, ["o_custkey"]).withColumn("rewritten", F.array_join("rewritten", ","))


@kernel("""WITH s AS (SELECT s_suppkey AS ord, s_name AS name, CASE WHEN s_acctbal < 0 THEN 'opted-out' WHEN s_acctbal < 2000 THEN 'ignored' WHEN s_acctbal < 4000 THEN 'generated' WHEN s_acctbal < 5000 THEN 'skipped' WHEN s_acctbal < 6000 THEN 'none' END AS reason FROM supplier),
g AS (SELECT reason, min(ord) AS ord, string_agg(name, ', ' ORDER BY ord, name) AS names FROM s WHERE reason IS NOT NULL GROUP BY reason)
SELECT ord, CASE reason WHEN 'opted-out' THEN 'nothing to format in ' || names || ', the attribute opts its files out' WHEN 'ignored' THEN 'nothing to format in ' || names || ', git ignores its files' WHEN 'generated' THEN 'nothing to format in ' || names || ', generated files are skipped'
WHEN 'skipped' THEN 'nothing to format in ' || names || ', its files are always skipped' ELSE 'no TypeScript or JavaScript files under ' || names END AS line FROM g""")
def a4_empty_lines(t) -> DataFrame:
    b = F.col("s_acctbal")
    reason = F.when(b < 0, "opted-out").when(b < 2000, "ignored").when(b < 4000, "generated").when(b < 5000, "skipped").when(b < 6000, "none")
    return summary.empty_lines(t("supplier").select(F.col("s_suppkey").alias("ord"), F.col("s_name").alias("name"), reason.alias("reason")))


@kernel("""SELECT event_type, string_agg(DISTINCT CAST(user_id AS VARCHAR), ', ' ORDER BY CAST(user_id AS VARCHAR)) AS line FROM events WHERE value > 20 GROUP BY event_type""")
def a5_notices(t) -> DataFrame:
    return summary.notices(t("events").filter("value > 20").select("event_type", F.col("user_id").cast("string").alias("user_id")), "event_type", "user_id")


@kernel("""WITH f AS (SELECT o_custkey AS k, l_suppkey, l_orderkey, l_linenumber, l_quantity, printf('f%05d.ts', l_suppkey) AS path, CAST(l_orderkey * 10 + l_linenumber AS BIGINT) AS line FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 25),
n AS (SELECT *, row_number() OVER w AS r, count(*) OVER (PARTITION BY k) AS total, lag(path) OVER w AS above FROM f WINDOW w AS (PARTITION BY k ORDER BY path, line)),
x AS (SELECT k, total, string_agg(CASE WHEN above IS NULL OR above <> path THEN chr(10) || path || chr(10) ELSE '' END || '  line ' || line || ': split it (wall)' || chr(10), '' ORDER BY r) AS rows FROM n WHERE r <= 12 GROUP BY k, total)
SELECT k, 'These need a hand fix in the files you changed:' || chr(10) || rows || CASE WHEN total > 12 THEN '  ... and ' || (total - 12) || ' more' || chr(10) ELSE '' END || chr(10) || 'gapweave rewrote a.ts and b.ts, so read them again before editing.' || chr(10) || 'Fix the findings above, then reply again. `gapweave explain <file>:<line>` shows why a rule applies.' AS reason FROM x""")
def o2_block_reason(t) -> DataFrame:
    o = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("k"))
    f = t("lineitem").filter("l_quantity > 25").join(o, "l_orderkey").select("k", F.format_string("f%05d.ts", "l_suppkey").alias("path"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.lit(1).alias("col"), F.lit("wall").alias("rule"), F.lit("split it").alias("message"))
    return summary.block_reason(f, F.array(F.lit("b.ts"), F.lit("a.ts")), by=["k"])


@kernel("""WITH e AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, o_custkey AS c FROM orders)
SELECT k, CASE WHEN p LIKE '5%' THEN 'input must be valid JSON' WHEN p LIKE '4%' AND s = 'F' THEN 'stop_hook_active must be a boolean' END AS error,
CASE WHEN p LIKE '5%' OR (p LIKE '4%' AND s = 'F') THEN NULL WHEN p LIKE '1%' THEN 'ignored' WHEN p LIKE '2%' THEN CASE WHEN s = 'F' THEN 'ignored' ELSE 'edit' END WHEN p LIKE '3%' AND s = 'F' THEN 'ignored' ELSE 'stop' END AS kind,
CASE WHEN p LIKE '2%' AND s <> 'F' THEN '/w/c' || c || ',' || 'a' || k || '.ts' WHEN p LIKE '3%' AND s <> 'F' OR p LIKE '4%' AND s <> 'F' THEN '/home/t/' || k || '.jsonl' END AS found FROM e""")
def s14_events(t) -> DataFrame:
    """Events of every sort: of a kind that isn't handled, edits, stops (one of them on its way already), with wrong fields, not JSON."""
    n, s = F.substring("o_orderpriority", 1, 1), F.col("o_orderstatus")
    other = F.lit('{"hook_event_name": "Other"}')
    edit = F.format_string('{"hook_event_name": "PostToolUse", "cwd": "c%d", "tool_name": "%s", "tool_input": {"file_path": "a%d.ts"}}', "o_custkey", F.when(s == "F", "Read").otherwise("Edit"), "o_orderkey")
    stop = F.format_string('{"hook_event_name": "Stop", "stop_hook_active": %s, "transcript_path": "t/x/../%d.jsonl"}', F.when(s == "F", "true").otherwise("false"), "o_orderkey")
    agent = F.format_string('{"hook_event_name": "SubagentStop", "stop_hook_active": %s, "agent_transcript_path": "/home/t/%d.jsonl"}', F.when(s == "F", "3").otherwise("null"), "o_orderkey")
    text = F.when(n == "1", other).when(n == "2", edit).when(n == "3", stop).when(n == "4", agent).otherwise('{"a": ')
    # relative folders lie below the fallback
    got = ev.events(t("orders").select(F.col("o_orderkey").alias("k"), F.when(n == "3", F.replace(text, F.lit("t/x"), F.lit("/home/t/x"))).otherwise(text).alias("value")), "/w")
    found = F.when(F.col("kind") == "edit", F.concat("cwd", F.lit(","), F.array_join("paths", ","))).when(F.col("kind") == "stop", F.col("transcript"))
    return got.select("k", "error", "kind", found.alias("found"))


@kernel("""WITH o AS (SELECT o_custkey AS log, o_orderkey AS ord, o_orderstatus AS s, o_orderpriority AS p, CAST(floor(o_totalprice) AS BIGINT) % 5 AS f FROM orders),
w AS (SELECT log, ord, CASE WHEN p LIKE '1%' THEN '/m' ELSE '/f' END || f AS path FROM o WHERE s <> 'P' AND NOT p LIKE '3%' AND NOT p LIKE '2%')
SELECT log, path, min(ord) AS ord FROM w GROUP BY log, path""")
def s13_changes(t) -> DataFrame:
    """A log of the second format for each customer: moves, deletions, relative paths and changes that failed."""
    n = F.substring("o_orderpriority", 1, 1)
    change = F.when(n == "1", F.format_string('{"type": "update", "move_path": "/m%d"}', F.floor("o_totalprice") % 5)).when(n == "2", '{"type": "delete"}').otherwise('{"type": "update"}')
    source = F.concat(F.when(n == "3", "f").otherwise("/f"), F.floor("o_totalprice") % 5)
    status = F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed")
    line = F.format_string('{"type": "event_msg", "payload": {"type": "item_completed", "item": {"type": "FileChange", "status": "%s", "changes": {"%s": %s}}}}', status, source, change)
    return ev.completed_changes(t("orders").select(F.col("o_custkey").alias("log"), F.col("o_orderkey").alias("ord"), line.alias("value")))


@kernel("""WITH o AS (SELECT o_custkey, o_orderkey AS ord, CAST(floor(o_totalprice) AS BIGINT) % 7 AS f, o_orderstatus AS s, o_orderpriority LIKE '1%' AS sub FROM orders),
b AS (SELECT ord, o_custkey, '/p/f' || f AS path FROM o WHERE s <> 'F')
SELECT '/l/s' || o_custkey || '.jsonl' AS log, path, min(ord) AS ord FROM b GROUP BY 1, 2""")
def s12_subagents(t) -> DataFrame:
    """First-format logs with sub-transcripts: what either writes and no result calls failed, counted to the session."""
    sub = F.startswith("o_orderpriority", F.lit("1"))
    log = F.concat(F.lit("/l/s"), "o_custkey", F.when(sub, "/subagents/x/a.jsonl").otherwise(".jsonl"))
    call = F.format_string('{"type": "assistant", "message": {"content": [{"type": "tool_use", "id": "i%d", "name": "Edit", "input": {"file_path": "/p/f%d"}}]}}', "o_orderkey", F.floor("o_totalprice") % 7)
    result = F.format_string('{"type": "user", "message": {"content": [{"type": "tool_result", "tool_use_id": "i%d", "is_error": %s}]}}', "o_orderkey", F.when(F.col("o_orderstatus") == "F", "true").otherwise("false"))
    lines = t("orders").select(log.alias("log"), F.col("o_orderkey").alias("ord"), F.explode(F.array(call, result)).alias("value"))
    return ev.with_subagents(transcripts.writes(lines)).select("log", "path", "ord")


@kernel(r"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents), h AS (SELECT l_orderkey AS k, l_linenumber AS n, l_partkey, l_extendedprice,
'@@ -' || l_partkey || CASE WHEN l_returnflag = 'R' THEN '' ELSE ',' || l_linenumber END || ' +' || (l_suppkey % 4) || CASE WHEN l_linestatus = 'O' THEN '' ELSE ',' || (l_suppkey % 2) END || CASE WHEN l_tax < 0.07 THEN ' @@ x' ELSE '@@' END AS s FROM lineitem)
SELECT k, n, CASE WHEN ok THEN b END AS before, CASE WHEN ok THEN f END AS first, CASE WHEN ok THEN a END AS after FROM (
SELECT k, n, regexp_matches(s, '^@@ -\d+(,\d+)? \+\d+(,\d+)? @@') AND (f > 0 OR (a = 0 AND given)) AS ok, b, f, a FROM (SELECT k, n, s, CAST(coalesce(nullif(regexp_extract(s, '-\d+,(\d+) ', 1), ''), '1') AS BIGINT) AS b, CAST(regexp_extract(s, '\+(\d+)', 1) AS BIGINT) AS f,
CAST(coalesce(nullif(regexp_extract(s, '\+\d+,(\d+)', 1), ''), '1') AS BIGINT) AS a, regexp_extract(s, '\+\d+,(\d+)', 1) <> '' AS given FROM h))""")
def c6_hunk_header(t) -> DataFrame:
    old = F.concat(F.col("l_partkey"), F.when(F.col("l_returnflag") == "R", "").otherwise(F.concat(F.lit(","), "l_linenumber")))
    new = F.concat((F.col("l_suppkey") % 4).cast("string"), F.when(F.col("l_linestatus") == "O", "").otherwise(F.concat(F.lit(","), (F.col("l_suppkey") % 2).cast("string"))))
    line = F.concat(F.lit("@@ -"), old, F.lit(" +"), new, F.when(F.col("l_tax") < 0.07, " @@ x").otherwise("@@"))
    return t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), diffs.hunk_header(line).alias("h")).select("k", "n", "h.before", "h.first", "h.after")


@kernel("""WITH l AS (SELECT user_id, event_id, event_type, CASE WHEN event_type = 'view' THEN 'diff --git ' || (CAST(floor(value) AS INTEGER) % 3) ELSE event_type END AS v FROM events),
h AS (SELECT *, last_value(CASE WHEN starts_with(v, 'diff') THEN v END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM l),
s AS (SELECT *, sum(CASE WHEN starts_with(v, 'diff') AND (above IS NULL OR above <> v) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS section FROM h)
SELECT user_id, CAST(section AS BIGINT) AS section, string_agg(v, ';' ORDER BY event_id) AS rows FROM s WHERE section > 0 GROUP BY 1, 2""")
def s17_sections(t) -> DataFrame:
    value = F.when(F.col("event_type") == "view", F.concat(F.lit("diff --git "), F.floor("value").cast("int") % 3)).otherwise(F.col("event_type"))
    cut = diffs.sections(t("events").select("user_id", F.col("event_id").alias("ord"), value.alias("value")), "user_id")
    return cut.select("user_id", F.col("section").cast("long").alias("section"), F.array_join("rows", ";").alias("rows"))


@kernel("""SELECT n_nationkey AS ord, n_name AS path, r_name AS part FROM (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) JOIN (SELECT n_nationkey AS k, row_number() OVER (ORDER BY n_nationkey) AS i, r_name FROM nation JOIN region ON n_regionkey = r_regionkey) USING (i)""")
def j6_zipped(t) -> DataFrame:
    n = t("nation").select(F.col("n_nationkey").alias("ord"), F.col("n_name").alias("path"), "n_regionkey")
    parts = n.join(t("region").select(F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("part")), "n_regionkey").select("ord", "part")
    return selection.zipped(n.select("ord", "path"), parts)


@kernel("""WITH f AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem)
SELECT l_orderkey || '/' || l_linenumber || '/' || l_suppkey AS path, l_linestatus = 'F' AS unstaged, p_name AS content FROM f JOIN part ON p_partkey = l_partkey WHERE l_returnflag <> 'R'""")
def s8_staged(t) -> DataFrame:
    mode = F.when(F.col("l_returnflag") == "R", "160000").when(F.col("l_returnflag") == "A", "100755").otherwise("100644")
    files = t("lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber", "l_suppkey").alias("path"), mode.alias("mode"), F.col("l_partkey").alias("blob"), (F.col("l_linestatus") == "F").alias("unstaged")).distinct()
    once = t("part").select(F.col("p_partkey").alias("blob"), F.col("p_name").alias("content"))
    return selection.staged(files, once.unionByName(once))
