"""Events that tools send, checked field by field, the paths that patches name, and a second kind of session log.

Rows hold one JSON text each; what is wrong with one becomes its `error`, the rest go on.
"""
from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as p

#: Events and tools that are handled, what a patch tool says when it worked, and the headers of a patch.
EVENTS = ("Stop", "SubagentStop", "PostToolUse")
EDITORS = ("Write", "Edit", "MultiEdit", "apply_patch")
APPLIED = "Success. Updated the following files:"
HEADERS = ("Add File", "Delete File", "Update File", "Move to")
PARSED = "error string, kind string, cwd string, paths array<string>, transcript string, agent boolean"


def patched_paths(command: str) -> list[str]:
    """Paths that a patch leaves changed, in order; a move takes the place of the update above it."""
    out: list[str] = []
    updating = False
    for line in command.splitlines():
        line = line.rstrip() if updating else line.strip()
        kind = next((k for k in HEADERS if line.startswith(f"*** {k}: ") and len(line) > len(k) + 6), None)
        if kind is None or "\r" in line:
            continue
        if kind == "Move to":
            if not updating:
                continue
            out.pop()
        else:
            updating = kind == "Update File"
        if kind != "Delete File":
            out.append(line[len(kind) + 6 :])
    return out


def _text(event: dict, key: str) -> str | None:
    value = event.get(key)
    if value is not None and not isinstance(value, str):
        raise ValueError(f"{key} must be a string")
    if value is not None and any("\ud800" <= c <= "\udfff" for c in value):
        raise ValueError(f"{key} holds an unpaired surrogate")
    return value


def _string(value) -> str | None:
    return value if isinstance(value, str) and not any("\ud800" <= c <= "\udfff" for c in value) else None


def _edited(event: dict) -> list[str]:
    given, tool = event.get("tool_input"), _string(event.get("tool_name"))
    if not isinstance(given, dict) or tool not in EDITORS:
        return []
    if tool != "apply_patch":
        path = _string(given.get("file_path"))
        return [] if path is None else [path]
    command, answer = _string(given.get("command")), _string(event.get("tool_response"))
    return patched_paths(command) if command is not None and answer is not None and APPLIED in answer.splitlines() else []


def parsed_event(text: str | None) -> dict:
    """kind: edit, stop, ignored or null with an error.  cwd and transcript are as given; resolved() makes them absolute."""
    none = {"error": None, "kind": None, "cwd": None, "paths": None, "transcript": None, "agent": None}
    try:
        event = json.loads(text or "", parse_constant=lambda _: (_ for _ in ()).throw(ValueError()))
    except ValueError:
        return none | {"error": "input must be valid JSON"}
    if not isinstance(event, dict):
        return none | {"error": "input must be a JSON object"}
    try:
        name = _text(event, "hook_event_name")
        if name is not None and name not in EVENTS:
            return none | {"kind": "ignored"}
        cwd = _text(event, "cwd")
        if name == "PostToolUse":
            paths = _edited(event)
            return none | ({"kind": "edit", "cwd": cwd, "paths": paths} if paths else {"kind": "ignored"})
        agent = name == "SubagentStop"
        transcript = _text(event, "agent_transcript_path" if agent else "transcript_path")
        active = event.get("stop_hook_active")
        if active is not None and not isinstance(active, bool):
            raise ValueError("stop_hook_active must be a boolean")
    except ValueError as e:
        return none | {"error": str(e)}
    return none | ({"kind": "ignored"} if active else {"kind": "stop", "cwd": cwd, "transcript": transcript, "agent": agent})


def events(rows: DataFrame, fallback: str, text: str = "value") -> DataFrame:
    """rows with error, kind, cwd, paths, transcript, agent; cwd and transcript are absolute (below `fallback`, where they aren't), paths are as given."""
    at = rows.columns.index(text)
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    names = [x.split()[0] for x in PARSED.split(", ")]
    columns = [*rows.columns, *names]

    def go(frames: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.bool_()]
        for f in frames:
            got = [parsed_event(t) for t in f.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*f.columns, *[pa.array([g[n] for g in got], k) for n, k in zip(names, kinds, strict=True)]], names=columns)

    out = rows.mapInArrow(go, f"{ddl}, {PARSED}")
    here = F.when(F.col("cwd").isNull(), F.lit(fallback)).otherwise(p.resolved(F.lit(fallback), "cwd"))
    return out.withColumn("cwd", F.when(F.col("kind").isin("edit", "stop"), here)).withColumn("transcript", F.when(F.col("transcript").isNotNull(), p.resolved(F.lit(fallback), "transcript")))


CHANGE = "type string, payload struct<type: string, item: struct<type: string, status: string, changes: map<string, struct<type: string, move_path: string>>>>"


def completed_changes(lines: DataFrame) -> DataFrame:
    """log, path, ord: absolute paths that completed file changes of the second log format leave, by first appearance.  lines: log, ord, value."""
    held = lines.filter(F.col("value").contains("item_completed") | F.col("value").contains("\\u00"))
    read = held.select("log", "ord", F.from_json("value", CHANGE).alias("r")).filter((F.col("r.type") == "event_msg") & (F.col("r.payload.type") == "item_completed"))
    done = read.filter((F.col("r.payload.item.type") == "FileChange") & (F.col("r.payload.item.status") == "completed"))
    each = done.select("log", "ord", F.posexplode("r.payload.item.changes").alias("pos", "source", "change")).filter("change is not null and not coalesce(change.type = 'delete', false)")
    path = F.coalesce("change.move_path", "source")
    return each.withColumn("path", path).filter(F.startswith("path", F.lit("/"))).groupBy("log", "path").agg(F.min(F.struct("ord", "pos")).alias("_o")).select("log", "path", F.col("_o.ord").alias("ord"))


def session_of(log) -> F.Column:
    """The log that a sub-transcript belongs to: <session>/subagents/**/x.jsonl is part of <session>.jsonl."""
    c = F.col(log) if isinstance(log, str) else log
    folder = F.regexp_extract(c, "^(.*?)/subagents/.*[.]jsonl$", 1)
    return F.when(folder != "", F.concat(folder, F.lit(".jsonl"))).otherwise(c)


def with_subagents(writes: DataFrame) -> DataFrame:
    """log, path, ord of writes (log, path, ord), those of sub-transcripts counted to their session, each path once."""
    return writes.withColumn("log", session_of("log")).groupBy("log", "path").agg(F.min("ord").alias("ord"))
