"""Gaps between statements: which rule decides each, what blank lines it wants, and what that edits.

Input `stmts`: path, list_id, idx, list_kind, kind, start_line, end_line, multiline, compact, guard, jump, case_body, names
array<string>, reads array<string>, detached, frozen.  Blank lines between two statements are counted from `blank`.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import adjacent, ladder

#: Rule, whether it can be fixed, blank lines it wants (none, at least one, or no say).
RULES = (
    ("short-body", True, "none"), ("guard-chain", True, "none"), ("after-multiline", True, "some"), ("switch-clauses", True, "some"),
    ("guard-join", True, "none"), ("consume-join", True, "none"), ("use-join", True, "none"), ("after-guard", True, "some"),
)
JUMPS = ("Return", "Throw", "Break", "Continue")


def decided(stmts: DataFrame) -> DataFrame:
    """Each adjacent pair with rule, outranked, joined_by (the name that joins) and want."""
    w = Window.partitionBy("path", "list_id")
    known = stmts.withColumn("short", (F.col("list_kind") == "Block") & F.count("*").over(w).between(2, 3) & F.min(F.col("compact").cast("int")).over(w).cast("boolean"))
    pairs = adjacent(known, ["path", "list_id"], ["idx"])
    p, n = (lambda c: F.col(f"prev.{c}")), (lambda c: F.col(f"next.{c}"))
    name = F.get(F.filter(n("reads"), lambda x: F.array_contains(p("names"), x)), F.lit(0))
    read = name.isNotNull()
    rules = [
        ("short-body", p("short")),
        ("guard-chain", p("guard") & n("guard") & p("compact") & n("compact")),
        ("after-multiline", p("multiline") & ~((p("kind") == "Import") & (n("kind") == "Import"))),
        ("switch-clauses", (p("list_kind") == "Switch") & (p("kind") == "Case") & p("case_body")),
        ("guard-join", (n("kind") == "If") & read),
        ("consume-join", n("kind").isin("Return", "Switch") & read),
        ("use-join", n("kind").isin("Loop", "Try", "Function") & (p("kind") == "Declaration") & read),
        ("after-guard", p("guard") & p("jump").isNotNull() & (n("kind") != "If") & ~n("kind").isin(*JUMPS)),
    ]
    rules = [(k, F.coalesce(c, F.lit(False))) for k, c in rules]
    rule, outranked = ladder(rules)
    frozen = p("frozen") | n("frozen")
    wants = F.create_map(*[F.lit(x) for k, _, want in RULES for x in (k, want)])
    out = pairs.withColumn("rule", F.when(frozen, "frozen").otherwise(rule)).withColumn("outranked", F.when(frozen, F.array().cast("array<string>")).otherwise(outranked))
    joined = F.when(F.col("rule").isin("guard-join", "consume-join", "use-join"), name)
    return out.withColumn("joined_by", joined).withColumn("want", F.try_element_at(wants, F.col("rule")))


def line_edits(gaps: DataFrame, lines: DataFrame) -> DataFrame:
    """path, line, op (delete | insert_after), rule.  lines: path, line, blank."""
    blanks = lines.filter("blank").select(F.col("path").alias("_p"), "line")
    wide = gaps.select("path", "rule", "want", F.col("prev.end_line").alias("a"), F.col("next.start_line").alias("b"), F.col("next.detached").alias("detached"))
    between = (F.col("path") == F.col("_p")) & (F.col("line") > F.col("a")) & (F.col("line") < F.col("b"))
    delete = wide.filter("want = 'none' and not detached").join(blanks, between).select("path", "line", F.lit("delete").alias("op"), "rule")
    insert = wide.filter("want = 'some' and b > a").join(blanks, between, "left_anti").select("path", (F.col("b") - 1).alias("line"), F.lit("insert_after").alias("op"), "rule")
    return delete.unionByName(insert)


def gap_edits(gaps: DataFrame) -> DataFrame:
    """The same from gaps whose next statement lists the blank lines above it (blank_lines); no join with lines."""
    n = lambda c: F.col(f"next.{c}")
    delete = gaps.filter((F.col("want") == "none") & ~n("detached")).select("path", F.explode("next.blank_lines").alias("line"), F.lit("delete").alias("op"), "rule")
    insert = gaps.filter((F.col("want") == "some") & (F.size("next.blank_lines") == 0) & (n("start_line") > F.col("prev.end_line")))
    return delete.unionByName(insert.select("path", (n("start_line") - 1).alias("line"), F.lit("insert_after").alias("op"), "rule"))


def edited(files: DataFrame, edits: DataFrame) -> DataFrame:
    """path, text: files (path, text) with their edits (path, line, op) made; one join, and a pass over each text."""
    of = lambda op: F.collect_set(F.when(F.col("op") == op, F.col("line"))).alias(op)
    both = files.select("path", "text").join(edits.groupBy("path").agg(of("delete"), of("insert_after")), "path", "left")

    def go(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for f in frames:
            texts = []
            for text, gone, new in zip(*(f.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if not gone and not new:
                    texts.append(text)
                    continue
                cut, add = set(gone), set(new)
                texts.append("\n".join(x for i, line in enumerate(text.split("\n"), 1) for x in ([] if i in cut else [line]) + (["\r" if line.endswith("\r") else ""] if i in add else [])))
            yield pa.RecordBatch.from_arrays([f.column(0), pa.array(texts, pa.string())], names=["path", "text"])

    return both.mapInArrow(go, "path string, text string")


def applied(lines: DataFrame, edits: DataFrame) -> DataFrame:
    """path, text: lines (path, line, line_text) without the deleted ones, with the inserted ones, joined again."""
    gone = edits.filter("op = 'delete'").select("path", "line").distinct()
    new = edits.filter("op = 'insert_after'").select("path", "line").distinct()
    kept = lines.join(gone, ["path", "line"], "left_anti").select("path", "line", F.lit(0).alias("k"), "line_text")
    added = lines.join(new, ["path", "line"]).select("path", "line", F.lit(1).alias("k"), F.when(F.col("line_text").endswith("\r"), "\r").otherwise("").alias("line_text"))
    ordered = F.array_sort(F.collect_list(F.struct("line", "k", "line_text")))
    return kept.unionByName(added).groupBy("path").agg(F.array_join(F.transform(ordered, lambda x: x["line_text"]), "\n").alias("text"))
