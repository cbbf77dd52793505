"""Files that a session wrote, from its JSON Lines log: attempts less failed calls, last path of a re-used id.

Lines that can't hold a record are left out before JSON is read; lines that aren't JSON are passed over.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tools whose calls write a file, and the records' shape.
WRITERS = ("Write", "Edit", "MultiEdit")
RECORD = "type string, message struct<content: array<struct<type: string, id: string, name: string, input: struct<file_path: string>, tool_use_id: string, is_error: boolean>>>"
EVENT = "hook_event_name string, cwd string, stop_hook_active boolean, transcript_path string, agent_transcript_path string, tool_name string, tool_input struct<file_path: string, command: string>"


def log_lines(spark: SparkSession, *paths: str) -> DataFrame:
    """log, ord, value.  Lines stay in the order of their file."""
    return spark.read.text(list(paths)).select(F.col("_metadata.file_path").alias("log"), (F.col("_metadata.file_block_start") + F.monotonically_increasing_id()).alias("ord"), "value")


def writes(lines: DataFrame) -> DataFrame:
    """log, path, ord: each written path once, by first appearance.  lines: log, ord, value."""
    held = lines.filter(F.col("value").contains("tool_use") | F.col("value").contains("tool_result") | F.col("value").contains("\\u00"))
    items = held.select("log", "ord", F.from_json("value", RECORD).alias("r")).select("log", "ord", "r.type", F.posexplode("r.message.content").alias("pos", "c"))
    calls = items.filter((F.col("type") == "assistant") & (F.col("c.type") == "tool_use") & F.col("c.name").isin(*WRITERS) & F.col("c.input.file_path").startswith("/"))
    at = F.struct("ord", "pos")
    calls = calls.groupBy("log", F.col("c.id").alias("id")).agg(F.max_by("c.input.file_path", at).alias("path"), F.min(at).alias("first"))
    failed = items.filter((F.col("type") == "user") & (F.col("c.type") == "tool_result") & F.col("c.is_error")).select("log", F.col("c.tool_use_id").alias("id")).distinct()
    done = calls.join(failed, ["log", "id"], "left_anti")
    return done.groupBy("log", "path").agg(F.min("first.ord").alias("ord"))


def events(lines: DataFrame) -> DataFrame:
    """Event rows of a JSON Lines table; events sent while a stop is already being handled are left out."""
    read = lines.select(F.from_json("value", EVENT).alias("e")).select("e.*")
    return read.filter("hook_event_name is not null and not coalesce(stop_hook_active, false)")
