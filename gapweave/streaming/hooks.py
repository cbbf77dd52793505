"""Events and logs as streams: each micro-batch of a JSON Lines folder is handled by the same plans as a table.

Logs are read whole again for each event, as what a session wrote follows from all of its log (a failed call takes its write back); so no state is
kept between batches but what the stream's own checkpoint holds, and a batch that is run again gives the same rows.
"""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import summary
from ..plans import analysis
from ..sources import events as ev
from ..sources import transcripts


def event_stream(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """value: a line for each event that arrives in a folder of JSON Lines files."""
    return spark.readStream.option("maxFilesPerTrigger", most_files).text(folder)


def passes(rows: DataFrame, fallback: str, logs: Callable[[SparkSession, list[str]], DataFrame]) -> DataFrame:
    """event, path: the files that each event (a JSON text) asks to be looked at: edited ones, or all that a session's log says were written.

    logs reads named logs (log, ord, value); the names of one batch of events are few.  Events that are ignored or wrong ask for none.
    """
    got = ev.events(rows.withColumn("event", F.xxhash64("value")), fallback)
    from ..functions.paths import resolved

    edits = got.filter("kind = 'edit'").select("event", F.explode("paths").alias("p"), "cwd").select("event", resolved("cwd", "p").alias("path"))
    stops = got.filter("kind = 'stop' and transcript is not null").select("event", "transcript")
    names = [r["transcript"] for r in stops.select("transcript").distinct().collect()]
    if not names:
        return edits.distinct()
    lines = logs(rows.sparkSession, names)
    both = transcripts.writes(lines).select("log", "path").unionByName(ev.completed_changes(lines).select("log", "path"))
    asked = stops.join(both.withColumnRenamed("log", "transcript"), "transcript").select("event", "path")
    return edits.unionByName(asked).distinct()


def replies(asked: DataFrame, files: DataFrame, marker: str = "gapweave") -> DataFrame:
    """event, reason: what each event's files (path, text) still need by hand once they are fixed; none for events whose files are well."""
    own = files.join(asked.select("path").distinct(), "path", "left_semi")
    done = analysis.fixed(own, marker)
    left = analysis.remaining(done, marker)
    changed = own.select("path", F.col("text").alias("_t")).join(done, "path").filter("_t <> text").select("path")
    rewritten = asked.join(changed, "path").groupBy("event").agg(F.collect_set("path").alias("rewritten"))
    found = asked.join(left, "path").join(rewritten, "event", "left").withColumn("rewritten", F.coalesce("rewritten", F.array().cast("array<string>")))
    reasons = summary.block_reason(found, F.array().cast("array<string>"), by=["event", "rewritten"])
    return reasons.select("event", "reason", "rewritten")


def run(stream: DataFrame, folder: str, handle: Callable[[DataFrame, int], None], once: bool = True) -> StreamingQuery:
    """Give each micro-batch to `handle` (rows, number); its place in the stream is kept in `folder`."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", folder)
    return (writer.trigger(availableNow=True) if once else writer).start()
