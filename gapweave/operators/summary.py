"""What a run says at its end: tallies as a line, outcomes merged, empty selections, the first findings for a hand fix, batches of paths."""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as p
from .reporting import ORDER

#: Rules that are failures, not findings; how many findings a reply names; bytes of paths in a batch.
FAILURES = ("parse", "error", "write")
SHOWN = 12
BATCH_BYTES = 64 << 10
EMPTY = {
    "opted-out": "nothing to format in %s, the attribute opts its files out", "ignored": "nothing to format in %s, git ignores its files", "hidden": "nothing to format in %s, a .gitignore hides its files",
    "generated": "nothing to format in %s, generated files are skipped", "skipped": "nothing to format in %s, its files are always skipped", "none": "no TypeScript or JavaScript files under %s",
}


def tallied(findings: DataFrame, by: list[str] | None = None) -> DataFrame:
    """findings, fixable, files (with findings), failed (files with failures), by run if `by` says so: counts by file, then of files."""
    by = by or []
    failure = F.col("rule").isin(*FAILURES)
    count = lambda c: F.count(F.when(c, 1))
    files = findings.groupBy(*by, "path").agg(count(~failure).alias("n"), count(~failure & F.col("fixable")).alias("fix"), count(failure).alias("bad"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return files.groupBy(*by).agg(total("n").alias("findings"), total("fix").alias("fixable"), total((F.col("n") > 0).cast("int")).alias("files"), total((F.col("bad") > 0).cast("int")).alias("failed"))


def summary_line(mode: Column, scope: Column, quiet: Column) -> Column:
    """The closing line from columns checked, rewritten, findings, fixable, files, failed; null if nothing is to be said.

    mode: check | fix; scope: paths | changed | staged; quiet: something was said already (errors, generated files).
    """
    c = F.col
    by_hand = c("findings") - c("fixable")
    staged = scope == "staged"
    of = lambda n: F.when(staged, p.counted(n, "staged file")).otherwise(p.counted(n, "file"))
    fixable = F.when(staged, "fixable").otherwise("fixable with --fix")
    every = F.when(c("findings") == 1, "").otherwise("all ")
    checked = F.concat(F.lit("checked "), of("checked"))
    found = F.concat(p.counted("findings", "finding"), F.lit(" in "), of("files"))
    of_check = (
        F.when(c("findings") == 0, F.concat(checked, F.lit(", no findings")))
        .when(by_hand == 0, F.concat(found, F.lit(", "), every, fixable))
        .when(c("fixable") == 0, F.concat(found, F.lit(", "), every, F.lit("by hand")))
        .otherwise(F.concat(found, F.lit(": "), c("fixable").cast("string"), F.lit(" "), fixable, F.lit(", "), by_hand.cast("string"), F.lit(" by hand")))
    )
    done = F.when(c("rewritten") == 0, checked).otherwise(F.concat(F.lit("rewrote "), p.counted("rewritten", "file")))
    of_fix = (
        F.when((c("findings") == 0) & (c("rewritten") == 0) & (c("failed") == 0), F.concat(done, F.lit(", nothing to fix")))
        .when(c("findings") == 0, F.concat(done, F.lit(", no findings left")))
        .otherwise(F.concat(done, F.lit(", "), p.counted("findings", "finding"), F.lit(" left to fix by hand")))
    )
    line = F.when(mode == "check", of_check).otherwise(of_fix)
    line = F.when(c("failed") == 0, line).otherwise(F.concat(line, F.lit(", "), p.counted("failed", "file"), F.lit(" failed")))
    nothing = F.when(~quiet & (scope != "paths"), F.concat(F.lit("no "), scope, F.lit(" files to "), mode))
    return F.when(c("checked") == 0, nothing).otherwise(line)


def merged(outcomes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Outcomes of files (ord, failed, checked, generated, kept, rewritten) as one: any, sums, the last kept, rewritten paths in order."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c)
    rewritten = F.array_sort(F.collect_list(F.when(F.col("rewritten").isNotNull(), F.struct("ord", "rewritten"))))
    return outcomes.groupBy(*(by or [])).agg(
        F.coalesce(F.bool_or("failed"), F.lit(False)).alias("failed"), total("checked"), total("generated"),
        F.max_by("kept", F.when(F.col("kept").isNotNull(), F.col("ord"))).alias("kept"), F.transform(rewritten, lambda x: x["rewritten"]).alias("rewritten"),
    )


def empty_lines(selections: DataFrame) -> DataFrame:
    """ord, line: paths that selected nothing, by reason in the order in which reasons first appear.  selections: ord, name, reason (null: not empty)."""
    named = F.array_sort(F.collect_list(F.struct("ord", "name")))
    groups = selections.filter("reason is not null").groupBy("reason").agg(F.min("ord").alias("ord"), F.array_join(F.transform(named, lambda x: x["name"]), ", ").alias("names"))
    says = F.create_map(*[F.lit(x) for kv in EMPTY.items() for x in kv])
    return groups.select("ord", F.replace(F.try_element_at(says, "reason"), F.lit("%s"), F.col("names")).alias("line"))


def notices(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, line: the distinct values of each key, sorted, joined by commas."""
    return rows.filter(F.col(value).isNotNull()).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set(value)), ", ").alias("line"))


def json_array(findings: DataFrame) -> DataFrame:
    """One row: all findings as a JSON array, in order.  A run's findings are few; they are one text in the end."""
    rows = F.array_sort(F.collect_list(F.struct(*ORDER, "message", "fixable")))
    return findings.agg(F.to_json(rows).alias("json"))


def block_reason(findings: DataFrame, rewritten: Column, tool: str = "gapweave", by: list[str] | None = None) -> DataFrame:
    """by, reason: the first findings by file, how many more there are, what was rewritten; a row for each run with findings.

    A window that keeps SHOWN rows of each run (a top-k, so partitions send no more), and a count.
    """
    by = by or []
    w = Window.partitionBy(*by).orderBy(*ORDER)
    total = findings.groupBy(*by).agg(F.count("*").alias("_total"))
    first = findings.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= SHOWN)
    above = F.lag("path").over(w)
    first = first.withColumn("_head", F.when(above.isNull() | (above != F.col("path")), F.concat(F.lit("\n"), p.shown("path"), F.lit("\n"))).otherwise(""))
    row = F.concat("_head", F.format_string("  line %d: %s (%s)\n", "line", "message", "rule"))
    texts = first.select(*by, "_n", row.alias("_row")).groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_row"))), lambda x: x["_row"]), "").alias("_rows"))
    both = texts.join(total, by) if by else texts.crossJoin(total)  # one row each
    more = F.when(F.col("_total") > SHOWN, F.format_string("  ... and %d more\n", F.col("_total") - SHOWN)).otherwise("")
    names = F.array_sort(F.transform(rewritten, lambda x: p.shown(x)))
    again = F.when(F.size(rewritten) > 0, F.concat(F.lit(f"{tool} rewrote "), p.listed(names), F.lit(", so read "), F.when(F.size(rewritten) == 1, "it").otherwise("them"), F.lit(" again before editing.\n"))).otherwise("")
    end = F.lit(f"Fix the findings above, then reply again. `{tool} explain <file>:<line>` shows why a rule applies.")
    return both.filter("_total > 0").select(*by, F.concat(F.lit("These need a hand fix in the files you changed:\n"), "_rows", more, F.lit("\n"), again, end).alias("reason"))


def decisions(reasons: DataFrame, event: Column) -> DataFrame:
    """reasons with `json`: a stop is blocked, an edit gets the reason as context."""
    stop = F.to_json(F.struct(F.lit("block").alias("decision"), F.col("reason")))
    edit = F.to_json(F.struct(F.struct(event.alias("hookEventName"), F.col("reason").alias("additionalContext")).alias("hookSpecificOutput")))
    return reasons.withColumn("json", F.when(event == "PostToolUse", edit).otherwise(stop))


def selectors(paths: DataFrame, key: str) -> DataFrame:
    """key, ord, path, selector: the highest listed folder above each path that is itself listed, or the path."""
    depth = F.size(F.split("path", "/", -1))
    above = F.when(depth > 1, F.transform(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("path", "/", -1), F.lit(1), n), "/"))).otherwise(F.array().cast("array<string>"))
    named = paths.select(F.col(key).alias("_k"), F.col("path").alias("_a")).distinct()
    each = paths.select(key, "ord", "path", F.explode_outer(above).alias("_a0")).join(named, (F.col(key) == F.col("_k")) & (F.col("_a0") == F.col("_a")), "left")
    highest = F.min(F.when(F.col("_a") != "", F.struct(F.length("_a").alias("n"), F.col("_a").alias("a"))))
    return each.groupBy(key, "ord", "path").agg(F.coalesce(highest["a"], F.col("path")).alias("selector"))


def batches(paths: DataFrame, key: str, budget: int = BATCH_BYTES) -> DataFrame:
    """key, ord, path, batch: paths packed in order, a new batch where the next path goes beyond the budget of bytes.

    Next fit depends on all that came before, so each key (a repository) is walked in order; its rows arrive sorted and in Arrow batches, and
    only the running size is kept, so a key of any size fits.
    """
    sorted_rows = paths.select(key, "ord", "path").repartition(key).sortWithinPartitions(key, "ord")
    schema = f"{key} {paths.schema[key].dataType.simpleString()}, ord {paths.schema['ord'].dataType.simpleString()}, path string, batch int"

    def go(frames: Iterator) -> Iterator:
        import pyarrow as pa

        now, size, batch = object(), 0, 0
        for f in frames:
            out = []
            for k, text in zip(f.column(0).to_pylist(), f.column(2).to_pylist(), strict=True):
                n = len((text or "").encode())
                if k != now:
                    now, size, batch = k, 0, 0
                elif size + n > budget:
                    size, batch = 0, batch + 1
                size += n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*f.columns, pa.array(out, pa.int32())], names=[key, "ord", "path", "batch"])

    return sorted_rows.mapInArrow(go, schema)


def repair_lines(findings: DataFrame, staged: DataFrame, folder: str, flags: str = "", tool: str = "gapweave") -> DataFrame:
    """ord, line: how to mend staged files (path, unstaged, scoped: only some lines are staged) that have fixable findings; a line for each way."""
    fixable = findings.filter("fixable").select("path").distinct()
    kind = F.when(F.col("scoped"), 0).when(F.col("unstaged"), 1).otherwise(2)
    names = F.array_join(F.transform(F.array_sort(F.collect_list("path")), lambda x: p.shell_word(x)), " ")
    groups = staged.join(fixable, "path", "left_semi").groupBy(kind.alias("ord")).agg(names.alias("names"))
    by_hand = F.concat(F.lit("fix the staged lines of these by hand and restage them with git add -p, --fix would change the whole file: "), "names")
    both = F.concat(F.lit("these also have unstaged changes, fix them with --fix and restage by hand: "), "names")
    command = F.concat(F.lit("fix and restage with: cd "), p.shell_word(F.lit(folder)), F.lit(f" && {tool} --fix{flags} -- "), "names", F.lit(" && git --literal-pathspecs add -- "), "names")
    return groups.select("ord", F.when(F.col("ord") == 0, by_hand).when(F.col("ord") == 1, both).otherwise(command).alias("line"))
