"""Findings as output: rows, JSON, headings, summary, status.  findings: path, line, col, rule, message, fixable."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ORDER = ["path", "line", "col", "rule"]


def plain_rows(findings: DataFrame) -> DataFrame:
    """line: a text row for each finding, in order."""
    hand = F.when(F.col("fixable"), "").otherwise(" (by hand)")
    return findings.orderBy(*ORDER).select(F.concat(F.format_string("%s:%d:%d: %s: %s", *ORDER, "message"), hand).alias("row"))


def json_rows(findings: DataFrame) -> DataFrame:
    return findings.orderBy(*ORDER).select(F.to_json(F.struct(*ORDER, "message", "fixable")).alias("row"))


def location(text: str) -> Column:
    """path, line, col of `path:line[:col]`; null if it isn't one."""
    form = r"^(.+?):([1-9][0-9]*)(?::([1-9][0-9]*))?$"
    part = lambda i: F.regexp_extract(text, form, i)
    number = lambda i: F.when(part(i) != "", part(i).try_cast("int"))
    return F.when(F.col(text).rlike(form), F.struct(part(1).alias("path"), number(2).alias("line"), number(3).alias("col")))


def leading(findings: DataFrame, most: int = 12) -> DataFrame:
    """The first rows in order with `more`, how many are left out.  A top-k and a count; no window over the whole table."""
    total = findings.agg(F.count("*").alias("total"))
    first = findings.orderBy(*ORDER).limit(most)
    return first.join(F.broadcast(total)).withColumn("more", F.greatest(F.col("total") - most, F.lit(0))).drop("total")


def widths(findings: DataFrame) -> DataFrame:
    """findings with place (line:col padded to the widest of its file)."""
    place = F.concat_ws(":", "line", "col")
    return findings.withColumn("place", F.rpad(place, F.max(F.length(place)).over(Window.partitionBy("path")), F.lit(" ")))


def status(findings: DataFrame, failures: DataFrame) -> DataFrame:
    """One row: 2 if anything failed, else 1 if anything was found, else 0."""
    both = findings.select(F.lit(1).alias("s")).unionByName(failures.select(F.lit(2).alias("s")))
    return both.agg(F.coalesce(F.max("s"), F.lit(0)).alias("status"))
