"""The rules as a dimension table."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Rule, whether it can be fixed, what it wants of a gap (null: nothing), what it says.
RULES = (
    ("after-multiline", True, "some", "a statement that spans several lines is followed by a blank line, unless it is a braceless body that fits on one line when joined"),
    ("switch-clauses", True, "some", "a blank line goes in between switch clauses and none is ever removed; the gap under a fall through label with an empty body is left as it is"),
    ("edge-blank", True, None, "a block has no blank line right after `{` or right before `}`"),
    ("guard-join", True, "none", "a single-line declaration or assignment is followed directly by an `if` that references what it binds, whatever the body size and with or without `else`"),
    ("consume-join", True, "none", "a single-line declaration or assignment is followed directly by a `return` or `switch` that references what it binds"),
    ("use-join", True, "none", "a single-line declaration is followed directly by a loop, `try` or function declaration that references what it binds"),
    ("guard-chain", True, "none", "consecutive compact guards (`if` with a single statement body and no `else`) have no blank line between them"),
    ("let-step", True, "some", "a `let` that joins the block below it gets a blank line above it, so it starts its own step"),
    ("after-guard", True, "some", "a compact guard that returns, throws, continues or breaks is followed by a blank line, unless the next statement is an `if` or a jump (`return`, `throw`, `break`, `continue`)"),
    ("short-body", True, "none", "a block of 2 or 3 compact statements has no blank lines, whether it is a function body, an arrow body, a method, a nested block or a switch clause body"),
    ("braces", True, None, "a control flow body that is a single statement has no braces"),
    ("block-spacing", False, None, "a multi-line block directly under a statement, when no rule decides the gap"),
    ("wall", False, None, "6 or more consecutive compact statements with no blank line, reported only where a blank line `--fix` keeps can split the run"),
)


def catalog(spark: SparkSession) -> DataFrame:
    """ord, rule, fixable, gap, summary; failures (parse, error, write) aren't rules."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(RULES)], "ord int, rule string, fixable boolean, gap string, summary string")
