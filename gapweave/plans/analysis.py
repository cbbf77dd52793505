"""From source text to findings and fixed text: one pass reads each distinct content, windows over (path, list_id) do the rest.

files: path, text, and maybe formatter settings by row (sources.statements).  Braces go first, then blank lines are judged on what is left; check
mode gives every finding at its place in the file, fix mode what can't be fixed at its place in the fixed text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.once import once, stored
from ..operators import gaps as g
from ..operators import spacing as sp
from ..sources import statements as st

#: What a finding of each rule says.
MESSAGES = {
    "after-multiline": "add a blank line after the multi-line statement above",
    "switch-clauses": "add a blank line between these switch clauses",
    "guard-chain": "remove the blank line between these compact guards",
    "let-step": "add a blank line above this `let`, the block below assigns or uses it",
    "after-guard": "add a blank line after the guard above, a new step starts here",
    "short-body": "remove the blank lines between these 2 or 3 compact statements",
    "block-spacing": "add a blank line above this block, or join it to the step above",
    "braces": "remove the braces around this single statement body",
}
#: Messages with places to fill.
JOIN, WALL = "remove the blank line between `%s` and the `%s` that reads it", "split these %d statements into steps with a blank line"
AFTER, BEFORE = "remove the blank line right after `{`", "remove the blank line right before `}`"
FINDING = ["path", "line", "col", "rule", "message", "fixable"]
#: Contents of a partition, unless there are too few partitions.
EACH = 500
#: Bytes of what contents have that are broadcast at most; the driver holds them several times.
MOST_BROADCAST = 16 << 20


def settled(stmts: DataFrame) -> DataFrame:
    """Decided gaps with let runs settled, and blanks, the blank lines of each gap."""
    decided = g.decided(stmts).withColumn("blanks", F.col("next.blanks"))
    below = Window.partitionBy("path", "list_id").orderBy("prev.idx").rowsBetween(1, Window.unboundedFollowing)
    anchor = F.col("prev.is_let") & F.coalesce(F.col("want") == "none", F.lit(False)) & (F.col("rule") != "short-body")
    reader = F.first(F.when(anchor, F.struct("next.reads")), ignorenulls=True).over(below)
    decided = decided.withColumn("_r", reader["reads"])
    decided = decided.withColumn("prev", F.col("prev").withField("binds_read", F.coalesce(F.arrays_overlap("prev.names", "_r"), F.lit(False)))).drop("_r")
    return sp.let_steps(decided)


def _walls(gaps: DataFrame) -> DataFrame:
    """Walls with their places: path, list_id, idx, size, last, start_line, line, col, end_line.

    They come from the gaps alone: each statement is the next of one, but the first of its list, which is the prev of the first; a list without
    gaps has a single statement and no wall.
    """
    none = F.coalesce(F.col("want") == "none", F.lit(False))
    some = F.coalesce(F.col("want") == "some", F.lit(False))
    blank, touched = F.col("blanks") > 0, F.col("next.touched")
    settles = some | (blank & (~none | F.col("next.detached")))  # what isn't touched stays as it is
    forced = none & ~F.col("next.detached") & ~F.col("next.commented") & (~blank | touched)
    parted = (F.col("rule") == "frozen") | F.when(touched, settles).otherwise(blank)
    own = {"idx": "idx", "list_kind": "list_kind", "multiline": "multiline", "kind": "kind", "start_line": "start_line", "end_line": "end_line", "at_line": "line", "at_col": "col"}
    row = lambda of, *more: F.struct(*[F.col(f"{of}.{c}").alias(to) for c, to in own.items()], *[c.cast("boolean").alias(to) for c, to in zip(more, ("forced", "parted"), strict=True)])
    below = row("next", forced, parted)
    stmts = gaps.select("path", "list_id", F.inline(F.when(F.col("prev.idx") == 0, F.array(row("prev", F.lit(None), F.lit(None)), below)).otherwise(F.array(below))))
    found = sp.walls(stmts.withColumn("counted", ~F.col("multiline") & (F.col("kind") != "Import")), first=("start_line", "line", "col"), last=("end_line",))
    return found.withColumn("last", F.col("idx") + F.col("size") - 1)


def _touched(walls: DataFrame, read: DataFrame) -> DataFrame:
    """Walls that changed lines touch, where a file has any to tell."""
    within = lambda c, to: F.coalesce(F.exists(c, lambda x: (x >= F.col("start_line")) & to(x)), F.lit(False))
    here = within("changed", lambda x: x <= F.col("end_line")) | within("deleted", lambda x: x < F.col("end_line"))
    return walls.join(read.select("path", "changed", "deleted"), "path").filter((F.col("changed").isNull() & F.col("deleted").isNull()) | here)


def with_changes(files: DataFrame, changed: DataFrame) -> DataFrame:
    """files with lines and deleted from changed (path, line, kind): only what they touch is judged; a file without any has empty ones."""
    of = lambda kind: F.coalesce(F.array_sort(F.collect_set(F.when(F.col("kind") == kind, F.col("line").cast("int")))), F.array().cast("array<int>"))
    both = changed.groupBy("path").agg(of("line").alias("lines"), of("deleted_after").alias("deleted"))
    empty = F.array().cast("array<int>")
    return files.join(both, "path", "left").withColumns({"lines": F.coalesce("lines", empty), "deleted": F.coalesce("deleted", empty)})


def _parts(files: DataFrame, marker: str, settings: dict):
    """What the pass read, once, dealt by path: every window and join behind it is on the path, so nothing is shuffled again."""
    n = min(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // EACH)))
    read = once(st.parsed(files, marker, **settings).repartition(n, "path"))
    return read, settled(st.statements(read))


def _spread(names: DataFrame, out: DataFrame) -> DataFrame:
    """names (path, content) with what out has for each content.

    out is written and weighed first: if it is small, it is broadcast and the names stay where they are; else both are dealt by content.  The
    names are never broadcast: their compressed files are a fraction of their size in the driver's memory.
    """
    out = stored(out)
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in out.dtypes if kind == "string"]
    bulk = out.agg(F.sum(sum(texts, F.lit(32 * len(out.columns))))).first()[0] or 0
    return names.join(F.broadcast(out) if bulk <= MOST_BROADCAST else out.hint("merge"), "content")


def findings(files: DataFrame, marker: str = "gapweave", **settings) -> DataFrame:
    """path, line, col, rule, message, fixable of every finding, at its place in the file; a file that can't be read gives a single `parse`.

    Rows that repeat a path each have their own findings; a null path is read as ts.
    """
    names, texts = st.contents(files)
    read, every = _parts(texts, marker, settings)
    n = lambda c: F.col(f"next.{c}")
    wrong = ((F.col("want") == "none") & (F.col("blanks") > 0) & ~n("detached")) | ((F.col("want") == "some") & (F.col("blanks") == 0) & (n("start_line") > F.col("prev.end_line")))
    tight = sp.tight() & ~F.coalesce((n("kind") == "Try") & F.array_contains(n("finally_ops"), F.col("prev.operation")), F.lit(False))  # only where no rule wants anything
    says = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    gaps = every.filter("next.touched").filter(wrong | tight).withColumn("rule", F.when(F.col("rule") == "keep", "block-spacing").otherwise(F.col("rule")))
    message = F.when(F.col("joined_by").isNotNull(), F.format_string(JOIN, "joined_by", n("word"))).otherwise(F.try_element_at(says, F.col("rule")))
    spaced = gaps.select("path", n("at_line").alias("line"), n("at_col").alias("col"), "rule", message.alias("message"), (F.col("rule") != "block-spacing").alias("fixable"))
    walls = _touched(_walls(every), read).select("path", "line", "col", F.lit("wall").alias("rule"), F.format_string(WALL, F.col("size")).alias("message"), F.lit(False).alias("fixable"))
    # what the pass itself has found: one array a file, so the plan holds a single branch for it
    one = lambda line, col, rule, message, fixable: F.struct(line.alias("line"), col.alias("col"), F.lit(rule).alias("rule"), message.alias("message"), F.lit(fixable).alias("fixable"))
    each = lambda rows, f: F.coalesce(F.transform(rows, f), F.array())
    side = each(F.flatten(F.filter(F.transform("lists", lambda x: x["edges"]), lambda x: x.isNotNull())), lambda x: one(x["at_line"], F.lit(1), "edge-blank", F.when(x["at_start"], AFTER).otherwise(BEFORE), True))
    gone = each(F.col("braces"), lambda x: one(x["line"], x["col"], "braces", F.lit(MESSAGES["braces"]), True))
    failed = F.when(F.col("error").isNotNull(), F.array(one(F.lit(1), F.lit(1), "parse", F.col("error"), False))).otherwise(F.array())
    own = read.select("path", F.inline(F.concat(side, gone, failed)))
    out = spaced.unionByName(walls).unionByName(own)
    return _spread(names, out.withColumnRenamed("path", "content")).select(*FINDING)


def fixed(files: DataFrame, marker: str = "gapweave", **settings) -> DataFrame:
    """path, text of every file with its braces and blank lines set right; a file that can't be read stays as it is."""
    names, texts = st.contents(files)
    read, gaps = _parts(texts, marker, settings)
    edits = g.gap_edits(gaps.filter("next.touched")).select("path", "line", "op").unionByName(st.edges(read).select("path", "line", F.lit("delete").alias("op")))
    mark = F.substring(F.coalesce("text", F.lit("")), 1, 1) == "\ufeff"
    marked = texts.filter(mark).select("path", F.lit(True).alias("_mark"))
    out = g.edited(read, edits).join(marked, "path", "left").select(F.col("path").alias("content"), F.when(F.col("_mark"), F.concat(F.lit("\ufeff"), "text")).otherwise(F.col("text")).alias("text"))
    return _spread(names, out).select("path", "text")


def remaining(fixed_files: DataFrame, marker: str = "gapweave", **settings) -> DataFrame:
    """Findings that fix mode leaves, at their places in the fixed text: those that can't be fixed, and failures."""
    return findings(fixed_files, marker, **settings).filter(~F.col("fixable"))
