"""Source files as tables: one Arrow pass over (path, text) reads each file once; everything after it is plain DataFrame work."""
from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import syntax
from ..functions.once import stored

STATEMENT = (
    "list_id int, idx int, list_kind string, kind string, line int, col int, start_line int, end_line int, multiline boolean, compact boolean, guard boolean, jump string, "
    "case_body boolean, names array<string>, is_let boolean, reads array<string>, detached boolean, commented boolean, frozen boolean, blanks int, operation string, finally_ops array<string>, at_line int, at_col int, touched boolean, word string, joined_columns int, joined_arms int, blank_lines array<int>"
)
LIST = "list_id int, braced boolean, open_line int, first_line int, last_line int, close_line int, edges array<struct<line: int, at_line: int, at_start: boolean>>"
_typed = lambda ddl: re.sub(r"(^|, (?![^<]*>))(\w+) ", r"\1\2: ", ddl)
PARSED = f"path string, error string, text string, braces array<struct<line: int, col: int>>, origin array<int>, changed array<int>, deleted array<int>, stmts array<struct<{_typed(STATEMENT)}>>, lists array<struct<{_typed(LIST)}>>"
EXPLAINED = ", blocks array<struct<open: int, close: int, owner: int, first: int, last: int, state: string, why: string>>, off array<struct<first: int, last: int>>"
ROWS = 64
#: What rows of files may say beside path and text.
SETTINGS = ("columns", "tab", "ruler", "braces", "lines", "deleted")


def contents(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(names, texts): path, content of every row of files, and files with a row for each content, whose path it is.

    A content is what decides how a file is judged: its text, its settings and changed lines, and the dialect by its path.  Copies share one, so they
    are read once; equal SHA-256 sums count as equal contents.  Both tables are written once.
    """
    extension = F.lower(F.substring_index("path", ".", -1))
    dialect = F.when(F.col("path").contains(".") & extension.isin(*syntax.EXTENSIONS), extension).otherwise("ts")
    own = [k for k in SETTINGS if k in files.columns]
    said = F.to_json(F.struct(F.col("text").isNull().alias("null"), *own))  # on a line of its own, so no text can pass for settings
    key = F.concat(F.base64(F.unhex(F.sha2(F.concat(said, F.lit("\n"), F.coalesce("text", F.lit(""))), 256))), F.lit("."), dialect)
    every = stored(files.select("path", key.alias("content"), "text", *own))
    # rows of a content are equal, so distinct() does; to pick one of each, Spark would sort every text
    return every.select("path", "content"), stored(every.drop("path").withColumnRenamed("content", "path").distinct())


def parsed(files: DataFrame, marker: str = "gapweave", columns: int = syntax.COLUMNS, tab: int = syntax.TAB, ruler: str = "prettier", braces: bool = True, explain: bool = False) -> DataFrame:
    """path, error, text, braces, origin, stmts, lists of each row of files (path, text); a null text is an empty one.

    With `braces`, text is the one without the braces that may go, stmts and lists are its own, braces are those removed and origin tells, by line, where
    it was in the file (empty if no line moved).  files may have columns, tab, ruler (formatter settings) and braces (whether they may go) by row; null ones
    fall back on the arguments, and lines and deleted (changed lines, and lines after which something was deleted; both null: all is in scope); other columns are ignored.  A path is a key: repeat it and its statements repeat.  The dialect follows the path's extension;
    an unknown one is read as ts.
    """
    fields = {k: re.findall(r"(?:^|, (?![^<]*>))(\w+) ", ddl) for k, ddl in (("stmts", STATEMENT), ("lists", LIST))}

    settings = {"columns": columns, "tab": tab, "ruler": ruler, "braces": braces}
    ddl = PARSED + (EXPLAINED if explain else "")
    schema = to_arrow_schema(StructType.fromDDL(ddl))

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                rows = []
                for row in b.slice(at, ROWS).to_pylist():
                    path = row["path"]
                    own = [default if row.get(k) is None else row[k] for k, default in settings.items()]
                    extension = (path or "").rpartition(".")[2].lower()
                    found = syntax.analyse(row["text"], extension if extension in syntax.EXTENSIONS and "." in path else "ts", marker, *own, row.get("lines"), row.get("deleted"), explain)
                    rows.append({"path": path} | {k: found[k] for k in ("error", "text", "braces", "origin", "changed", "deleted")} | ({k: found.get(k, []) for k in ("blocks", "off")} if explain else {}) | {k: [{f: s.get(f) for f in names} for s in found[k]] for k, names in fields.items()})
                yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "text", *[k for k in (*settings, "lines", "deleted") if k in files.columns]).mapInArrow(go, ddl)


def statements(read: DataFrame) -> DataFrame:
    """A row for each statement of what parsed() gives."""
    return read.select("path", F.inline("stmts"))


def lists(read: DataFrame) -> DataFrame:
    """A row for each statement list that holds a statement."""
    return read.select("path", F.inline("lists")).filter("first_line is not null")


def edges(read: DataFrame) -> DataFrame:
    """path, list_id, line, at_line, at_start: blank lines right inside braces, where they were in the file, and on which side."""
    return read.select("path", F.inline("lists")).select("path", "list_id", F.inline("edges"))
