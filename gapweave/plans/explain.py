"""Why a line is judged as it is: the gap above it, the braces that open on it, the wall that it is part of.

Everything that decided is a column already: the rule of a gap and those it outranks, what braces become, the runs of statements.  This turns it into text.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.once import once
from ..functions.text import WHITE
from ..operators import catalog
from ..operators import gaps as g
from ..operators import spacing as sp
from ..sources import statements as st
from . import analysis

LABEL = 11
WANTS = {r: "no blank line" if w == "none" else "a blank line" for r, _, w, _ in catalog.RULES if w}


def field(label: str | Column, text: Column) -> Column:
    """A labelled line; without a label it goes on under the one above."""
    head = F.lit(f"{label}:" if label else "") if isinstance(label, str) else label
    return F.concat(F.rpad(head, LABEL, " "), text)


def several(n: Column, noun: str) -> Column:
    return F.concat(F.when(n == 0, "no").otherwise(n.cast("string")), F.lit(f" {noun}"), F.when(n == 1, "").otherwise("s"))


def line_list(lines: Column) -> Column:
    texts = F.transform(lines, lambda x: x.cast("string"))
    most = F.concat(F.lit("lines "), F.array_join(F.slice(texts, F.lit(1), F.size(texts) - 1), ", "), F.lit(" and "), F.element_at(texts, -1))
    return F.when(F.size(texts) == 1, F.concat(F.lit("line "), F.get(texts, F.lit(0)))).otherwise(most)


def _excerpt(first: Column, last: Column) -> Column:
    label = F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("-"), last.cast("string")))
    code = F.regexp_replace(F.coalesce(F.get(F.col("source"), first - 1), F.lit("")), f"^[{WHITE}]+|[{WHITE}]+$", "")
    return F.concat(F.lit("  "), F.rpad(label, LABEL - 2, " "), code)


def _was(line: Column) -> Column:
    return F.coalesce(F.get(F.col("origin"), line - 1), line)


def _note(first: Column, last: Column) -> Column:
    """Lines of removed braces within; null without any."""
    gone = F.array_sort(F.array_distinct(F.transform(F.filter("braces", lambda b: (b["line"] >= first) & (b["line"] <= last)), lambda b: b["line"])))
    return F.when(F.size(gone) > 0, field("note", F.concat(F.lit("decided after --fix removes the braces on "), line_list(gone))))


def _because(rule: Column, name: Column, columns: Column) -> Column:
    p, n = (lambda c: F.col(f"prev.{c}")), (lambda c: F.col(f"next.{c}"))
    joined = p("joined_columns").isNotNull() | n("joined_columns").isNotNull()
    jump = F.when(p("jump").isNull(), "a jump").otherwise(F.concat(F.lit("`"), F.lower(p("jump")), F.lit("`")))
    return (
        F.when(rule.isin("guard-join", "consume-join", "use-join"), F.format_string("`%s` is bound on line %d and read by the `%s` below it", name, p("at_line"), n("word")))
        .when(rule == "short-body", F.format_string("the block holds %d statements, each compact", F.col("members")))
        .when((rule == "guard-chain") & joined, F.format_string("both guards fit on one line at %d columns", columns))
        .when(rule == "guard-chain", "both statements are compact guards")
        .when(rule == "after-multiline", F.format_string("the statement above spans lines %d to %d", p("at_line"), _was(p("end_line"))))
        .when(rule == "switch-clauses", "the clause above has a body")
        .when(rule == "after-guard", F.concat(F.format_string("the guard on line %d ends in ", p("at_line")), jump, F.lit(", so the next statement starts a new step")))
        .when(rule == "let-step", F.format_string("the `let` on line %d joins the block below it, so it starts its own step", n("at_line")))
    )


def _gap_sections(read: DataFrame, stmts: DataFrame, columns: int, source: str) -> DataFrame:
    """path, line, rank, ord, rows: a section for each gap, at the line of its lower statement (and at that of a comment above it)."""
    w = Window.partitionBy("path", "list_id")
    members = stmts.groupBy("path", "list_id").agg(F.count("*").cast("int").alias("members"), F.min("at_line").alias("from"), F.max_by("end_line", "idx").alias("to"), F.first("list_kind").alias("_kind"))
    gaps = analysis.settled(stmts).join(members, ["path", "list_id"]).join(read.select("path", "origin", "braces", "source"), "path")
    p, n = (lambda c: F.col(f"prev.{c}")), (lambda c: F.col(f"next.{c}"))
    name = F.coalesce("joined_by", F.get(F.filter(n("reads"), lambda x: F.array_contains(p("names"), x)), F.lit(0)))
    wants = F.create_map(*[F.lit(x) for kv in WANTS.items() for x in kv])
    rule = F.col("rule")
    ruled = ~rule.isin("frozen", "keep")
    joined = lambda s: F.when(
        s("joined_columns").isNotNull(),
        field(
            "",
            F.when(s("joined_arms") == 1, F.format_string("line %d joins to %d columns, %s", s("at_line"), s("joined_columns"), F.when(s("joined_columns") <= columns, "fits on one line").otherwise("too long for one line"))).otherwise(
                F.format_string("line %d has %d arms, the widest joins to %d columns, %s", s("at_line"), s("joined_arms"), s("joined_columns"), F.when(s("joined_columns") <= columns, "each fits on its own line").otherwise("too long for its own line"))
            ),
        ),
    )
    wide = F.when(p("joined_columns").isNotNull() | n("joined_columns").isNotNull(), field("width", F.lit(f"{columns} columns, from {source}")))
    decision = F.when(rule == "frozen", field("rule", F.lit("none, a directive covers one of the two statements"))).when(rule == "keep", field("rule", F.lit("none applies, the blank lines stay as written"))).otherwise(field("rule", F.concat(rule, F.lit(", wants "), F.try_element_at(wants, rule))))
    others = F.filter("outranked", lambda r: r != rule)
    named = lambda r: F.concat(r, F.lit(", wants "), F.try_element_at(wants, r), F.lit(": "), _because(r, name, F.lit(columns)))
    outranked = F.when(ruled & (F.size(others) == 0), F.array(field("outranked", F.lit("none")))).when(ruled, F.transform(others, lambda r, i: field(F.when(i == 0, "outranked:").otherwise(""), named(r)))).otherwise(F.array().cast("array<string>"))
    blanks, none = F.col("blanks"), F.col("want") == "none"
    result = (
        F.when(~ruled, "--fix leaves the gap alone")
        .when(n("detached"), F.format_string("the comment above line %d is set apart by a blank line, so --fix leaves the gap alone", n("at_line")))
        .when(n("start_line") <= p("end_line"), "both statements share a line, so --fix leaves the gap alone")
        .when(none & (blanks == 0), "already has no blank line")
        .when(none, F.concat(F.lit("--fix removes "), several(blanks, "blank line")))
        .when(blanks == 0, "--fix adds a blank line")
        .otherwise("already has a blank line")
    )
    tight = sp.tight_blocks(gaps).filter(~F.coalesce((n("kind") == "Try") & F.array_contains(n("finally_ops"), p("operation")), F.lit(False))).select("path", "list_id", n("idx").alias("_i"), F.lit(True).alias("tight"))
    both = gaps.withColumn("_i", n("idx")).join(tight, ["path", "list_id", "_i"], "left")
    reported = F.when(F.col("tight"), field("reported", F.lit(f"block-spacing, {analysis.MESSAGES['block-spacing']}")))
    short = (F.col("_kind") == "Block") & F.col("members").between(2, 3)
    note = _note(F.when(short, F.col("from")).otherwise(p("at_line")), _was(F.when(short, F.col("to")).otherwise(n("end_line"))))
    head = F.concat(F.format_string("gap above line %d, ", n("at_line")), several(blanks, "blank line"))
    reason = F.when(ruled, field("because", _because(rule, name, F.lit(columns))))
    rows = F.array_compact(F.concat(F.array(head, _excerpt(p("at_line"), _was(p("end_line"))), _excerpt(n("at_line"), n("at_line")), note, wide, joined(p), joined(n), decision, reason), outranked, F.array(field("result", result), reported)))
    where = F.array_distinct(F.array(n("at_line"), _was(n("start_line"))))
    return both.select("path", F.explode(where).alias("line"), F.lit(0).alias("rank"), n("line").alias("ord"), rows.alias("rows"))


def _block_sections(read: DataFrame, held: Column) -> DataFrame:
    """The same for braces, at the line where they open, or else at that of their owner."""
    rows = read.select("path", "source", F.posexplode("blocks").alias("ord", "b"))
    summary = next(s for r, _, _, s in catalog.RULES if r == "braces")
    b = lambda c: F.col(f"b.{c}")
    head = F.when(b("open") == b("close"), F.format_string("braced body on line %d", b("open"))).otherwise(F.format_string("braced body, lines %d to %d", b("open"), b("close")))
    inside = F.when(b("first").isNotNull(), _excerpt(b("first"), b("last")))
    rule = F.when(b("state") == "directive", field("rule", F.lit("braces, but a directive covers this body"))).when(b("state") == "inapplicable", field("rule", F.concat(F.lit("braces does not apply, "), b("why")))).otherwise(field("rule", F.lit(f"braces, {summary}")))
    reasons = F.when(b("state").isin("kept", "free"), F.array_compact(F.array(held, F.when(b("state") == "kept", b("why"))))).otherwise(F.array().cast("array<string>"))
    kept = F.transform(reasons, lambda r, i: field(F.when(i == 0, "kept by:").otherwise(""), r))
    result = F.when((b("state") == "removed") & (b("why") == "0"), "--fix removes the braces").when(b("state") == "removed", "--fix removes the braces once the braces inside them are gone").when(b("state").isin("kept", "free"), F.when(F.size(reasons) == 0, "--fix removes the braces").otherwise("the braces stay"))
    lines = F.array_compact(F.concat(F.array(head, inside, rule), kept, F.array(F.when(result.isNotNull(), field("result", result)))))
    opens = rows.select("path", b("open").alias("line")).distinct().withColumn("_here", F.lit(True))
    # a line on which braces open tells of those alone, another of all that its statement owns
    where = F.array_distinct(F.array(b("open"), b("owner")))
    each = rows.select("path", "ord", b("open").alias("_open"), F.explode(where).alias("line"), lines.alias("rows")).join(opens, ["path", "line"], "left")
    return each.filter((F.col("line") == F.col("_open")) | F.col("_here").isNull()).select("path", "line", F.lit(1).alias("rank"), "ord", "rows")


def _wall_sections(read: DataFrame, stmts: DataFrame, gaps: DataFrame) -> DataFrame:
    """The same for walls, at each of their lines."""
    found = analysis._walls(gaps).join(read.select("path", "origin", "braces", "source"), "path")
    tail = stmts.select("path", "list_id", F.col("idx").alias("last"), F.col("at_line").alias("tail_line"))
    found = found.join(tail, ["path", "list_id", "last"]).withColumnRenamed("line", "head_line")
    to = _was(F.col("end_line"))
    head = F.when(F.col("head_line") == to, F.format_string("wall on line %d", F.col("head_line"))).otherwise(F.format_string("wall, lines %d to %d", F.col("head_line"), to))
    rows = F.array_compact(F.array(
        head, _excerpt(F.col("head_line"), F.col("head_line")), F.when(F.col("head_line") != to, _excerpt(F.col("tail_line"), to)), _note(F.col("head_line"), to), field("rule", F.lit("wall, wants a blank line where one step ends")),
        field("because", F.format_string(f"%d single-line statements run with no blank line --fix keeps, and {sp.WALL} or more make a wall", F.col("size"))), field("result", F.lit("--fix leaves the split to you")),
    ))
    return found.select("path", F.explode(F.sequence(_was(F.col("start_line")), to)).alias("line"), F.lit(2).alias("rank"), F.col("head_line").alias("ord"), rows.alias("rows"))


def explained(files: DataFrame, asked: DataFrame | None = None, marker: str = "gapweave", columns: int = 80, source: str = "fallback", held_by: str | None = None, **settings) -> DataFrame:
    """path, line, found, text: why each asked line (path, line) is judged as it is; without `asked`, of each line that has something to tell.

    held_by: what a configuration says that keeps braces; then none are removed before gaps are judged.
    """
    read = once(st.parsed(files, marker, columns=columns, explain=True, braces=held_by is None, **settings).join(files.select("path", F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "^\\ufeff", ""), "\n", -1).alias("source")), "path"))
    stmts = st.statements(read)
    sections = _gap_sections(read, stmts, columns, source).unionByName(_block_sections(read, F.lit(held_by).cast("string"))).unionByName(_wall_sections(read, stmts, analysis.settled(stmts)))
    if asked is not None:
        sections = sections.join(asked.select("path", "line").distinct(), ["path", "line"], "left_semi")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", "ord", "rows"))), lambda x: F.concat(F.array(F.lit("")), x["rows"]))
    told = sections.groupBy("path", "line").agg(F.flatten(parts).alias("_rows"))
    shown = F.transform("_rows", lambda x: F.regexp_extract(x, r"^  (\d+)", 1))  # a line of source is shown once
    once_each = F.filter("_rows", lambda x, i: ~x.rlike(r"^  \d") | ~F.array_contains(F.slice(shown, F.lit(1), i), F.regexp_extract(x, r"^  (\d+)", 1)))
    told = told.select("path", "line", F.concat(F.format_string("%s:%d", "path", "line"), F.lit("\n"), F.array_join(once_each, "\n")).alias("told"))
    if asked is None:
        return told.select("path", "line", F.lit(True).alias("found"), F.col("told").alias("text"))
    all_lines = F.size("source") - F.when(F.element_at("source", -1) == "", 1).otherwise(0)
    out = asked.select("path", "line").distinct().join(read.select("path", "error", "off", all_lines.alias("n")), "path").join(told, ["path", "line"], "left")
    off = F.exists("off", lambda r: (F.col("line") >= r["first"]) & (F.col("line") <= r["last"]))
    text = (
        F.when(F.col("error").isNotNull(), F.concat(F.col("path"), F.lit(" does not parse: "), F.col("error")))
        .when(F.col("line") > F.col("n"), F.concat(F.col("path"), F.lit(" has "), F.col("n").cast("string"), F.when(F.col("n") == 1, " line").otherwise(" lines"), F.lit(", not "), F.col("line").cast("string")))
        .when(F.col("told").isNotNull(), F.col("told"))
        .when(off, F.format_string(f"%s:%d\n\nline %d is inside a {marker}-off region, so {marker} leaves it alone", "path", "line", "line"))
        .otherwise(F.format_string("%s:%d: no gap ends and no braced body starts on this line", "path", "line"))
    )
    return out.select("path", "line", (F.col("error").isNull() & (F.col("line") <= F.col("n")) & (F.col("told").isNotNull() | off)).alias("found"), text.alias("text"))
