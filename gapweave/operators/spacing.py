"""What follows from decided gaps: let-steps, walls, tight blocks, blank edges, and findings of all of them.

Input `gaps` is what gaps.decided() returns, with columns a caller adds where said.  Every plan is windows over
(path, list_id): one shuffle on that key, shared by the rules, and no list is ever collected.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Statements in a row that make a wall; kinds that are blocks; messages' rules that only report.
WALL = 6
BLOCKS = ("If", "Loop", "Try", "Switch")
REPORT_ONLY = ("block-spacing", "wall")
JOINS = ("guard-join", "consume-join", "use-join")


def _is_false(c) -> F.Column:
    return ~F.coalesce(c, F.lit(False))


def let_steps(gaps: DataFrame) -> DataFrame:
    """gaps with rules of let runs settled; needs prev.idx, prev.is_let, prev.binds_read (the block below reads what it binds), prev.detached.

    A gap that wants no blank line and follows a `let` (short bodies apart) is an anchor.  Plain gaps right above it that follow a
    one-line `let` which the block reads, and whose next isn't detached, join it; the plain gap above that run steps back.
    """
    down = Window.partitionBy("path", "list_id").orderBy("prev.idx").rowsBetween(1, Window.unboundedFollowing)
    here = Window.partitionBy("path", "list_id").orderBy("prev.idx")
    plain = F.col("rule") == "keep"
    is_let = F.coalesce(F.col("prev.is_let"), F.lit(False))
    anchor = is_let & F.coalesce(F.col("want") == "none", F.lit(False)) & (F.col("rule") != "short-body")
    may_join = plain & is_let & F.coalesce(F.col("prev.binds_read"), F.lit(False)) & _is_false(F.col("prev.multiline")) & _is_false(F.col("next.detached"))
    at = gaps.withColumn("_anchor", anchor).withColumn("_ok", may_join & ~anchor)
    at = at.withColumn("_next_anchor", F.first(F.when(F.col("_anchor"), F.struct("prev.idx", "rule", "joined_by")), ignorenulls=True).over(down))
    at = at.withColumn("_next_stop", F.first(F.when(~F.col("_ok"), F.col("prev.idx")), ignorenulls=True).over(down))
    joined = F.col("_ok") & F.col("_next_anchor").isNotNull() & (F.col("_next_stop") >= F.col("_next_anchor.idx"))
    at = at.withColumn("_joined", joined)
    at = at.withColumn("_below", F.lead(F.col("_joined") | F.col("_anchor")).over(here))
    step = plain & ~F.col("_joined") & F.coalesce(F.col("_below"), F.lit(False))
    at = at.withColumn("joined_by", F.when(F.col("_joined"), F.col("_next_anchor.joined_by")).otherwise(F.col("joined_by")))
    at = at.withColumn("want", F.when(F.col("_joined"), "none").when(step, "some").otherwise(F.col("want")))
    at = at.withColumn("rule", F.when(F.col("_joined"), F.col("_next_anchor.rule")).when(step, "let-step").otherwise(F.col("rule")))
    return at.drop("_anchor", "_ok", "_next_anchor", "_next_stop", "_joined", "_below")


def walls(stmts: DataFrame, least: int = WALL, first: Sequence[str] = (), last: Sequence[str] = ()) -> DataFrame:
    """path, list_id, idx, size: runs of at least `least` counted statements without a separator; also columns `first` of the first statement, `last` of the last.

    stmts: path, list_id, idx, list_kind, counted, forced (joined to the statement above by a rule), parted (a separator above).
    Runs that rules force together aren't walls, nor does any statement of a switch belong to one.
    """
    w = Window.partitionBy("path", "list_id").orderBy("idx")
    counted = F.coalesce(F.col("counted"), F.lit(False)) & (F.col("list_kind") != "Switch")
    before = F.coalesce(F.lag(counted).over(w), F.lit(False))
    forced = F.coalesce(F.col("forced"), F.lit(False)) & counted & before
    s = stmts.withColumn("_c", counted).withColumn("_run", F.sum((~forced).cast("int")).over(w))
    s = s.withColumn("_held", F.count("*").over(Window.partitionBy("path", "list_id", "_run")) >= least)
    s = s.withColumn("_use", F.col("_c") & ~F.col("_held"))
    starts = ~F.coalesce(F.lag("_use").over(w), F.lit(False)) | ~F.col("_use") | F.coalesce(F.col("parted"), F.lit(True))
    s = s.withColumn("_wall", F.sum(starts.cast("int")).over(w)).filter("_use")
    return s.groupBy("path", "list_id", "_wall").agg(F.min("idx").alias("idx"), F.count("*").alias("size"), *[F.min_by(c, "idx").alias(c) for c in first], *[F.max_by(c, "idx").alias(c) for c in last]).filter(F.col("size") >= least).drop("_wall")


def tight() -> F.Column:
    """Whether a gap has no blank line where a one-line statement meets a block of several lines; needs blanks (a count)."""
    p, n = (lambda c: F.col(f"prev.{c}")), (lambda c: F.col(f"next.{c}"))
    both_if = (p("kind") == "If") & (n("kind") == "If")
    return (F.col("rule") == "keep") & (F.col("blanks") == 0) & _is_false(p("multiline")) & n("multiline") & n("kind").isin(*BLOCKS) & ~both_if


def tight_blocks(gaps: DataFrame) -> DataFrame:
    """Gaps that are tight()."""
    return gaps.filter(tight())


def blank_edges(lists: DataFrame, lines: DataFrame) -> DataFrame:
    """path, list_id, line: a row for each blank line right inside a braced list.

    lists: path, list_id, braced, open_line, first_line (of its first statement), last_line (of its last), close_line, and maybe
    first_touched, last_touched (whether changed lines touch that edge); lines: path, line, blank.
    """
    touched = lambda c: F.coalesce(F.col(c), F.lit(True)) if c in lists.columns else F.lit(True)
    span = lambda a, b, c: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), touched(c).alias("touched"))
    spans = F.array(span("open_line", "first_line", "first_touched"), span("last_line", "close_line", "last_touched"))
    edges = lists.filter("braced and open_line <> close_line").select("path", "list_id", F.explode(spans).alias("e")).filter("e.touched")
    blank = lines.filter("blank").select(F.col("path").alias("_p"), "line")
    return edges.join(blank, (F.col("path") == F.col("_p")) & (F.col("line") > F.col("e.a")) & (F.col("line") < F.col("e.b"))).select("path", "list_id", "line").distinct()


def in_scope(found: DataFrame, changed: DataFrame | None, first: str, last: str) -> DataFrame:
    """Findings whose lines hold a changed one, or inside which something was deleted; all of them if changed is None.

    changed: path, line, kind (line | deleted_after).  A deletion after the last line lies outside.
    """
    if changed is None:
        return found
    c = changed.select(F.col("path").alias("_p"), F.col("line").alias("_l"), F.col("kind").alias("_k"))
    within = (F.col("_l") >= F.col(first)) & F.when(F.col("_k") == "line", F.col("_l") <= F.col(last)).otherwise(F.col("_l") < F.col(last))
    return found.join(c, (F.col("path") == F.col("_p")) & within, "left_semi")
