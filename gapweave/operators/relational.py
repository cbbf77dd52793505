"""The relational kernels of the analysis: ordered pairs, runs, interval and hierarchy lookups, folds, counts.

Each takes DataFrames and column names, so the same plan serves statements of source files and any other table.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def adjacent(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A row for each adjacent pair: prev and next, structs of all columns; lists are partitioned by `by`."""
    w = Window.partitionBy(*by).orderBy(*order)
    every = F.struct(*df.columns)
    return df.select(*by, every.alias("prev"), F.lead(every).over(w).alias("next")).filter("next is not null")


def ladder(rules: Sequence[tuple[str, Column]], otherwise: str = "keep") -> tuple[Column, Column]:
    """The first rule that holds, and all later ones that hold too, in order."""
    first: Column = F.lit(otherwise)
    for name, holds in reversed(rules):
        first = F.when(holds, F.lit(name)).otherwise(first)
    every = F.array_compact(F.array(*[F.when(holds, F.lit(name)) for name, holds in rules]))
    return first, F.slice(every, 2, len(rules))


def runs(df: DataFrame, by: Sequence[str], order: Sequence[str], breaks: Column, least: int) -> DataFrame:
    """Gaps and islands: by, first row's order columns, size of each run of at least `least` rows; a row where `breaks` holds starts one."""
    w = Window.partitionBy(*by).orderBy(*order)
    numbered = df.withColumn("_run", F.sum(F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0)).over(w))
    return numbered.groupBy(*by, "_run").agg(*[F.min(c).alias(c) for c in order], F.count("*").alias("size")).filter(F.col("size") >= least).drop("_run")


def touched(spans: DataFrame, points: DataFrame, key: str, first: str, last: str, point: str) -> DataFrame:
    """Range semi-join: spans that hold a point of the same key.  An equi-join on the key; the range is its residual."""
    p = points.select(F.col(key).alias("_k"), F.col(point).alias("_p"))
    return spans.join(p, (F.col(key) == F.col("_k")) & F.col("_p").between(F.col(first), F.col(last)), "left_semi")


def nearest_ancestor(paths: DataFrame, holders: DataFrame, path: str, directory: str) -> DataFrame:
    """path, directory: the deepest directory above each path that is in holders; paths without one are left out."""
    parts = F.split(path, "/", -1)
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, 1, n), "/").alias("dir")))
    each = paths.select(path, F.explode(above).alias("a")).select(path, "a.depth", "a.dir")
    found = each.join(holders.select(F.col(directory).alias("dir")).distinct(), "dir")
    return found.groupBy(path).agg(F.max_by("dir", "depth").alias(directory))


def last_wins(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """by, first (least order), value of the last: a re-used key keeps its first place and its last value."""
    return df.groupBy(*by).agg(F.min(order).alias("first"), F.max_by(value, order).alias(value))


def fold(layers: DataFrame, by: Sequence[str], setting: str, rank: str, order: str) -> DataFrame:
    """Highest rank wins, ties go to the later layer."""
    return layers.groupBy(*by).agg(F.max_by(setting, F.struct(rank, order)).alias(setting))


def distinct_in_order(df: DataFrame, by: Sequence[str], value: str, order: str) -> DataFrame:
    """by, values array: distinct values by first appearance."""
    first = df.groupBy(*by, value).agg(F.min(order).alias("_o"))
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("_o", value))), lambda x: x[value]).alias("values"))


def merged(regions: DataFrame, by: Sequence[str], start: str, end: str) -> DataFrame:
    """Intervals of a key merged where they meet or overlap."""
    w = Window.partitionBy(*by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = regions.withColumn("_new", F.when(reach >= F.col(start), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    return marked.groupBy(*by, "_run").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_run")


def away_from(points: DataFrame, others: DataFrame, key: str, point: str) -> DataFrame:
    """Points n for which neither n nor n + 1 is among others."""
    both = others.select(F.col(key).alias("_k"), F.explode(F.array(F.col(point), F.col(point) - 1)).alias("_p"))
    return points.join(both, (F.col(key) == F.col("_k")) & (F.col(point) == F.col("_p")), "left_anti")


def tally(findings: DataFrame, key: str, fixable: Column) -> DataFrame:
    """One row: findings, fixable, files with any, files with one to fix by hand, and the exit status."""
    each = findings.groupBy(key).agg(F.count("*").alias("n"), F.sum(F.when(fixable, 1).otherwise(0)).alias("f"))
    return each.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("findings"),
        F.coalesce(F.sum("f"), F.lit(0)).alias("fixable"),
        F.count("*").alias("files"),
        F.coalesce(F.sum(F.when(F.col("n") > F.col("f"), 1).otherwise(0)), F.lit(0)).cast("long").alias("by_hand_files"),
        F.when(F.count("*") > 0, 1).otherwise(0).alias("status"),
    )


def first_rows(df: DataFrame, order: Sequence[str], n: int = 12) -> DataFrame:
    """The first n rows by order; a top-k, so no full sort."""
    return df.orderBy(*order).limit(n)


def padded(rows: DataFrame, by: str, label: str, width: str = "width") -> DataFrame:
    """Label padded to the widest of its group."""
    widest = F.max(F.length(label)).over(Window.partitionBy(by))
    return rows.withColumn(width, widest).withColumn(label, F.rpad(label, F.col(width), F.lit(" ")))
