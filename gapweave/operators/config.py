"""Settings of files from the configuration above them: formatter widths, and whether linters want braces.

Configurations are a small dimension beside files, but they are joined on folders, not broadcast blindly: each file's folders are exploded and met by equi-join.
"""
from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import config as c

#: Ranks of settings, and columns where no configuration says any.
RANKS = ("root-preset", "group-preset", "explicit", "unread")
FALLBACK, FALLBACK_TAB = 80, 2
LAYOUT = "dir string, file string, formatter string, ord int, pattern string, columns double, tab double, editorconfig boolean, unread boolean"
EDITOR = "dir string, file string, root boolean, ord int, pattern string, columns double, tab double"


def folders(path: str = "path") -> Column:
    """The folders above a file, nearest first; the top is empty."""
    parts = F.split(F.col(path), "/", -1)
    return F.transform(F.sequence(F.size(parts) - 1, F.lit(0), F.lit(-1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def layouts(files: DataFrame) -> DataFrame:
    """A row for each thing that a formatter's file (path, text) sets, or one that says it can't be read."""
    def go(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["text"]):
                found = c.layouts(path, text or "")
                folder = path.rpartition("/")[0]
                if found is None:
                    rows.append((folder, path, c.formatter_of(path), 0, None, None, None, False, True))
                else:
                    rows += [(folder, path, c.formatter_of(path), i, x["pattern"], x["columns"], x["tab"], x["editorconfig"], False) for i, x in enumerate(found)]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in LAYOUT.split(", ")])

    return files.select("path", "text").mapInPandas(go, LAYOUT)


def editor_layouts(files: DataFrame) -> DataFrame:
    """A row for each section of an editors' file (path, text)."""
    def go(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["text"]):
                root, found = c.editor_sections(text or "")
                rows += [(path.rpartition("/")[0], path, root, i, x["pattern"], x["columns"], x["tab"]) for i, x in enumerate(found or [{"pattern": None, "columns": None, "tab": None}])]
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in EDITOR.split(", ")])

    return files.select("path", "text").mapInPandas(go, EDITOR)


def _below(folder: str, path: str) -> Column:
    return F.when(F.col(folder) == "", F.col(path)).otherwise(F.substring(F.col(path), F.length(folder) + F.lit(2), F.length(path)))


def widths(files: DataFrame, settings: DataFrame, editors: DataFrame | None = None, listed: DataFrame | None = None) -> DataFrame:
    """path, columns, tab, formatter, source, unread of every file (path).

    The nearest folder above a file with a configuration that can be read decides; of several there, the one whose formatter alone is `listed` (dir, formatter:
    dependencies of the nearest manifest), else the smallest width.  What it leaves open the editors' sections fill (nearest file first, its last section
    first, none above a topmost file), then the formatter's default, then FALLBACK.  unread: files passed over on the way up.
    """
    above = files.select("path", F.posexplode(folders()).alias("depth", "dir"))
    met = above.join(settings, "dir").withColumn("_hit", F.col("pattern").isNull() | F.coalesce(F.expr("regexp_like(CASE WHEN dir = '' THEN path ELSE substring(path, length(dir) + 2) END, pattern)"), F.lit(False)))
    last = lambda x: F.max_by(x, F.when(F.col("_hit") & F.col(x).isNotNull(), F.col("ord")))
    by_file = met.groupBy("path", "depth", "file", "formatter").agg(last("columns").alias("own"), last("tab").alias("own_tab"), F.bool_or("unread").alias("unread"), F.bool_or("editorconfig").alias("editorconfig"))
    default = F.create_map(*[F.lit(x) for k, v in c.KEYS.items() for x in (k, float(v[2]))])
    good = by_file.filter(~F.col("unread"))
    nearest = F.min("depth").over(Window.partitionBy("path"))
    here = good.withColumn("_n", nearest).filter(F.col("depth") == F.col("_n")).drop("_n")
    if listed is not None:
        wanted = above.join(listed.select("dir", F.col("formatter").alias("_f")), "dir")
        wanted = wanted.withColumn("_n", F.min("depth").over(Window.partitionBy("path"))).filter("depth = _n").groupBy("path").agg(F.collect_set("_f").alias("_listed"))
        here = here.join(wanted, "path", "left")
    else:
        here = here.withColumn("_listed", F.lit(None).cast("array<string>"))
    in_list = F.coalesce(F.array_contains("_listed", F.col("formatter")), F.lit(False))
    only = F.sum(in_list.cast("int")).over(Window.partitionBy("path")) == 1
    # a width that a file leaves open counts as the formatter's default among rivals
    rank = F.struct((only & ~in_list).cast("int"), F.coalesce("own", F.try_element_at(default, "formatter")), "file")
    chosen = here.withColumn("_rank", rank).groupBy("path").agg(F.min_by(F.struct("file", "formatter", "own", "own_tab", "editorconfig", "depth"), "_rank").alias("c"))
    passed = by_file.filter("unread").join(chosen.select("path", F.col("c.depth").alias("_d")), "path", "left").filter("_d is null or depth <= _d").groupBy("path").agg(F.array_sort(F.collect_set("file")).alias("unread"))
    out = files.select("path").join(chosen, "path", "left").join(passed, "path", "left")
    if editors is not None:
        seen = above.join(editors, "dir").withColumn("_top", F.min(F.when(F.col("root"), F.col("depth"))).over(Window.partitionBy("path"))).filter("_top is null or depth <= _top")
        hit = F.coalesce(F.expr("regexp_like(CASE WHEN dir = '' THEN path ELSE substring(path, length(dir) + 2) END, pattern)"), F.lit(False))
        order = lambda x: F.when(hit & F.col(x).isNotNull(), F.struct(-F.col("depth"), F.col("ord")))
        filled = seen.groupBy("path").agg(F.max_by("columns", order("columns")).alias("ed"), F.max_by("tab", order("tab")).alias("ed_tab"), F.max_by("file", order("columns")).alias("ed_file"))
        out = out.join(filled, "path", "left")
    else:
        out = out.withColumns({"ed": F.lit(None).cast("double"), "ed_tab": F.lit(None).cast("double"), "ed_file": F.lit(None).cast("string")})
    reads = F.col("c").isNotNull() & F.coalesce(F.col("c.editorconfig"), F.lit(False))
    ed = lambda x: F.when(reads, F.col(x))
    columns = F.coalesce("c.own", ed("ed"), F.try_element_at(default, "c.formatter"), F.lit(float(FALLBACK)))
    source = F.when(F.col("c.own").isNotNull(), F.col("c.file")).when(ed("ed").isNotNull(), F.col("ed_file")).when(F.col("c").isNotNull(), F.concat("c.formatter", F.lit(" default"))).otherwise("fallback")
    return out.select("path", columns.cast("int").alias("columns"), F.coalesce("c.own_tab", ed("ed_tab"), F.lit(float(FALLBACK_TAB))).cast("int").alias("tab"), F.col("c.formatter").alias("formatter"), source.alias("source"), F.coalesce("unread", F.array().cast("array<string>")).alias("unread"))


# -- braces -----------------------------------------------------------------------------------------


def last_layers(layers: DataFrame, by: list[str], identity: str) -> DataFrame:
    """Layers that occur once: each identity at its last place."""
    w = Window.partitionBy(*by, identity).orderBy(F.desc("ord"))
    return layers.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def folded(layers: DataFrame, by: list[str]) -> DataFrame:
    """by, setting: of the layers (ord, setting, reach, rank, overriding) that reach a target the one of highest rank; ties go to later ones, overriding ones last.

    A layer reaches if its reach is all, or some and its setting isn't off.  rank: 0 to 3 (RANKS).
    """
    reaches = (F.col("reach") == "all") | ((F.col("reach") == "some") & (F.col("setting") != "off"))
    return layers.filter(reaches).groupBy(*by).agg(F.max_by("setting", F.struct("rank", "overriding", "ord")).alias("setting"))


def decided(found: DataFrame) -> DataFrame:
    """path, family, setting, files: a decision for each file and linter family that has one.

    found: path, family, depth (0: nearest), file, setting (on | off | unknown or null), root (boolean or null).  Flat files and biome look all the way up for one
    that isn't off, nearest first, else take the nearest with a setting (biome stops at the nearest if that says root is false); legacy ones stop at the nearest
    with a setting or root; oxlint takes the nearest folder, and two files there leave it unknown.
    """
    by = ["path", "family"]
    has = F.col("setting").isNotNull()
    strict = F.col("setting").isin("on", "unknown")
    nearest = lambda cond: F.min_by(F.struct("setting", "file", "root"), F.when(cond, F.struct("depth", "file")))
    up = found.groupBy(*by).agg(nearest(has).alias("near"), nearest(strict).alias("strict"), nearest(has | F.coalesce("root", F.lit(False))).alias("stop"), F.min("depth").alias("d"))
    first = found.join(up.select(*by, "d"), by).filter("depth = d").groupBy(*by).agg(F.count("*").alias("n"), F.array_sort(F.collect_list("file")).alias("files"), F.min_by(F.struct("setting", "file"), "file").alias("one"))
    both = up.join(first, by)
    biome_stops = (F.col("family") == "biome") & ~F.coalesce(F.col("near.root"), F.lit(True))
    pick = F.when(F.col("family") == "legacy", F.struct("stop.setting", "stop.file")).when(F.col("family") == "oxlint", F.struct("one.setting", "one.file")).when(biome_stops, F.struct("near.setting", "near.file")).otherwise(F.coalesce(F.struct("strict.setting", "strict.file"), F.struct("near.setting", "near.file")))
    pick = F.when(F.col("family").isin("legacy", "oxlint") | biome_stops | F.col("strict").isNotNull(), pick).otherwise(F.struct("near.setting", "near.file"))
    crowded = (F.col("family") == "oxlint") & (F.col("n") > 1)
    out = both.select(*by, F.when(crowded, "unknown").otherwise(pick["setting"]).alias("setting"), F.when(crowded, F.col("files")).otherwise(F.array(pick["file"])).alias("files"))
    return out.filter("setting is not null")


def braces(decisions: DataFrame, by: str = "path") -> DataFrame:
    """path, enforced, unread: braces stay if any family isn't off; files that couldn't be told are named only if none says on."""
    unknown = F.array_distinct(F.flatten(F.collect_list(F.when(F.col("setting") == "unknown", F.col("files")))))
    return decisions.groupBy(by).agg(F.bool_or(F.col("setting") != "off").alias("enforced"), F.when(F.bool_or(F.col("setting") == "on"), F.array().cast("array<string>")).otherwise(F.array_sort(unknown)).alias("unread"))


def with_settings(files: DataFrame, width: DataFrame | None = None, kept: DataFrame | None = None) -> DataFrame:
    """files with the columns that sources.statements reads: columns, tab, ruler from widths(), braces (whether they may go) from braces()."""
    out = files
    if width is not None:
        out = out.join(width.select("path", "columns", "tab", F.col("formatter").alias("ruler")), "path", "left")
    if kept is not None:
        out = out.join(kept.select("path", (~F.col("enforced")).alias("braces")), "path", "left")
    return out
