"""Requests as rows to responses as rows: the whole analysis behind one table contract."""
from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import analysis

#: The fields of a request; braces and changedLines may be null, none may be missing, no other is known.
FIELDS = ("id", "path", "text", "mode", "braces", "changedLines", "explain")
REQUEST = "ord long, id string, path string, text string, mode string, braces boolean, lines array<int>, deleted array<int>, error string"


def _request(line: str) -> dict:
    none = dict.fromkeys(("id", "path", "text", "mode", "braces", "lines", "deleted", "error"))
    try:
        r = json.loads(line)
    except ValueError:
        return none | {"error": "malformed request: not JSON"}
    if not isinstance(r, dict):
        return none | {"error": "malformed request: not an object"}
    own = none | {"id": json.dumps(r.get("id"), ensure_ascii=False)}
    numbers = lambda x: isinstance(x, list) and all(isinstance(v, int) and not isinstance(v, bool) and v >= 0 for v in x)
    c = r.get("changedLines")
    wrong = next((f"unknown field `{k}`" for k in r if k not in FIELDS), None) or next((f"missing field `{k}`" for k in FIELDS if k not in r), None)
    if not wrong and not (isinstance(r["path"], str) and isinstance(r["text"], str)):
        wrong = "path and text must be strings"
    if not wrong and (r["mode"] not in ("check", "fix") or r["braces"] not in ("on", "off", None)):
        wrong = "unknown variant"
    if not wrong and c is not None and not (isinstance(c, dict) and sorted(c) == ["deletedAfter", "lines"] and all(map(numbers, c.values()))):
        wrong = "changedLines must hold lines and deletedAfter"
    if not wrong and not (numbers(r["explain"]) and 0 not in r["explain"]):
        wrong = "explain must hold line numbers"
    if wrong:
        return own | {"error": f"malformed request: {wrong}"}
    return own | {"path": r["path"], "text": r["text"], "mode": r["mode"], "braces": None if r["braces"] is None else r["braces"] == "on"} | ({"lines": c["lines"], "deleted": c["deletedAfter"]} if c else {})


def requests(lines: DataFrame, text: str = "value") -> DataFrame:
    """lines (ord, value: one JSON object each) as requests; what is wrong with one is its error."""
    names = [x.split()[0] for x in REQUEST.split(", ")][1:]

    def go(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = [_request(x or "") for x in f[text]]
            yield pd.DataFrame({"ord": f["ord"], **{n: pd.Series([r[n] for r in rows], dtype=object) for n in names}})

    return lines.select(F.col("ord").cast("long").alias("ord"), text).mapInPandas(go, REQUEST)


def responses(asked: DataFrame, marker: str = "gapweave", **settings) -> DataFrame:
    """ord, id, text, findings array<struct>, error of each request, in one run of the plan for all of them.

    Check mode gives the text as it was and every finding; fix mode the fixed text and what is left in it that can't be fixed.
    """
    good = asked.filter("error is null")
    scoped = F.col("lines").isNotNull() | F.col("deleted").isNotNull()
    empty = F.array().cast("array<int>")
    key = F.format_string("%d/%s", "ord", "path")  # paths may repeat
    files = good.select(key.alias("path"), "text", "mode", (~F.coalesce("braces", F.lit(False))).alias("braces"), F.when(scoped, F.coalesce("lines", empty)).alias("lines"), F.when(scoped, F.coalesce("deleted", empty)).alias("deleted"))
    check, fix = files.filter("mode = 'check'"), files.filter("mode = 'fix'")
    done = analysis.fixed(fix, marker, **settings)
    found = analysis.findings(check, marker, **settings).unionByName(analysis.remaining(done.join(fix.select("path", "braces"), "path"), marker, **settings))
    row = F.struct("line", "col", "rule", "message", "fixable")
    listed = found.groupBy("path").agg(F.array_sort(F.collect_list(row)).alias("findings"))
    texts = check.select("path", "text").unionByName(done)
    out = good.select("ord", "id", key.alias("_k")).join(texts.withColumnRenamed("path", "_k"), "_k").join(listed.withColumnRenamed("path", "_k"), "_k", "left")
    none = F.array().cast(listed.schema["findings"].dataType)
    ok = out.select("ord", "id", "text", F.coalesce("findings", none).alias("findings"), F.lit(None).cast("string").alias("error"))
    bad = asked.filter("error is not null").select("ord", "id", F.lit(None).cast("string").alias("text"), none.alias("findings"), "error")
    return ok.unionByName(bad)
