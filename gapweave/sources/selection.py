"""Which files are looked at: names, folders, attributes, ignore rules, changed and written paths.

Everything is a filter or an equi-join over a table of listed paths; ignore rules are a small dimension (MOST_RULES at most).
"""
from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as p

#: Extensions that are parsed, folders that are passed over.
EXTENSIONS = ("ts", "tsx", "mts", "cts", "js", "jsx", "mjs", "cjs")
FOLDERS = ("node_modules", "dist", "build", ".git", ".next", "out", "coverage", "migrations", "drizzle")
#: Names of generated and of declaration files; what a header's comment says of a generated file (in lower case, but for the tag).
GENERATED_NAME = r"\.generated\.|\.gen\.(ts|tsx|mts|cts|js|jsx|mjs|cjs)$|\.min\.(js|mjs|cjs)$"
DECLARATION_NAME = r"\.d\.(ts|mts|cts)$"
GENERATED_TAG = r"@generated\b"
GENERATED_MARKERS = (
    r"^code generated\b.*\bdo not edit\b",
    r"\b(?:this|the) (?:file|code|class) (?:is|was|has been) (?:auto(?:matically)?[- ]?)?generated\b",
    r"\bauto(?:matically)?[- ]?generated (?:file|code|class)\b",
    r"^(?:auto(?:matically)?[- ]?)generated\b",
)
ATTRIBUTION = r"^(?:code )?generated (?:by|from|with|using|code)\b"
EDIT_WARNING = r"\bdo not (?:edit|modify|make (?:direct )?changes)\b"
HEADER_LINES = 10
MOST_RULES = 20_000


def base_name(path: str) -> Column:
    return F.substring_index(path, "/", -1)


def extension(path: str) -> Column:
    """After the last dot of the name; empty without one."""
    return F.regexp_extract(base_name(path), r"\.([^.]*)$", 1)


def is_source(path: str) -> Column:
    return extension(path).isin(*EXTENSIONS)


def in_folder(path: str, folders) -> Column:
    """One of the folders stands above the file."""
    parts = F.split(path, "/", -1)
    return F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*[F.lit(f) for f in folders]))


def verdict(opted_out: Column, excluded: Column, generated: Column) -> Column:
    """The first that holds, in this order; else kept."""
    return F.when(opted_out, "opted-out").when(excluded, "excluded").when(generated, "generated").otherwise("kept")


def ignore_regex(pattern: str) -> tuple[str, bool, bool] | None:
    """Of a line of an ignore file: regular expression over paths, whether it negates, whether it names folders only."""
    line = pattern.rstrip("\n").rstrip("\r")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[1:] if negated else line
    folder = line.endswith("/")
    line = line.rstrip("/") if folder else line
    if not line:
        return None
    anchored = "/" in line
    line = line.lstrip("/") if line.startswith("/") else line
    out, i = "", 0
    while i < len(line):
        c = line[i]
        if line.startswith("**/", i) and (i == 0 or line[i - 1] == "/"):
            out, i = out + "(?:.*/)?", i + 3
        elif line[i:] == "**" and i and line[i - 1] == "/":
            out, i = out + ".+", i + 2
        elif c == "*":
            out, i = out + "[^/]*", i + (len(line) - i - len(line[i:].lstrip("*")))
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := line.find("]", i + 2)) > 0:
            body = line[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[").replace("&&", "&\\&")
            out, i = out + ("[^" + body[1:] if body[0] in "!^" else "[" + body) + "]", end + 1
        elif c == "\\" and i + 1 < len(line):
            out, i = out + re.escape(line[i + 1]), i + 2
        else:
            out, i = out + re.escape(c), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + "$", negated, folder


def ignored(paths: DataFrame, patterns: list[str], path: str = "path") -> DataFrame:
    """paths with `ignored`: the last rule wins; a file under an ignored folder is ignored whatever rules say of itself.

    The rules are compiled once for each worker and walked from the last, folder by folder from the top, in one Arrow pass; no plan grows with them.
    """
    rules = [r for line in patterns if (r := ignore_regex(line))]
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} ignore rules")
    names = [*paths.columns, "ignored"]
    at = names.index(path)

    def go(frames: Iterator) -> Iterator:
        import pyarrow as pa

        known = [(re.compile(expression), negated, folder) for expression, negated, folder in reversed(rules)]
        folders: dict[str, bool] = {"": False}

        def hit(name: str, is_folder: bool) -> bool:
            return next((not negated for expression, negated, folder in known if (is_folder or not folder) and expression.match(name)), False)

        def below(folder: str) -> bool:
            """Whether the folder or one above it is ignored."""
            if folder not in folders:
                if len(folders) > 100_000:  # a worker's memory, not results
                    folders.clear()
                    folders[""] = False
                folders[folder] = below(folder.rpartition("/")[0]) or hit(folder, True)
            return folders[folder]

        for f in frames:
            out = [None if x is None else below(x.rpartition("/")[0]) or hit(x, False) for x in f.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*f.columns, pa.array(out, pa.bool_())], names=names)

    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in paths.schema.fields)
    return paths.mapInArrow(go, f"{ddl}, ignored boolean")


def is_generated_name(path: str) -> Column:
    return p.name(path).rlike(GENERATED_NAME)


def is_declaration(path: str) -> Column:
    return p.name(path).rlike(DECLARATION_NAME)


def candidacy(path: str, keep_generated: bool | Column = False) -> Column:
    """0: no source file, 1: one in a folder that is passed over, 2: a candidate."""
    keep = keep_generated if isinstance(keep_generated, Column) else F.lit(keep_generated)
    skipped = is_declaration(path) | (~keep & is_generated_name(path))
    return F.when(~is_source(path) | skipped, 0).when(in_folder(path, FOLDERS), 1).otherwise(2)


#: What a header holds: a line's end, comments, quotes, patterns, words; a template's text is read apart.
_HEADER = re.compile(r"""//[^\n\r\u2028\u2029]*|/\*[\s\S]*?(?:\*/|$)|'(?:[^'\\\n]|\\[\s\S])*(?:'|(?=\n)|$)|"(?:[^"\\\n]|\\[\s\S])*(?:"|(?=\n)|$)|[\w$#]+|\+\+|--|\.\.\.|[\s\S]""")
_PATTERN = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*(?:\]|(?=\n)|$))*(?:/|(?=\n)|$)")
_OPERAND_NEXT = set("await break case continue debugger default delete do else in instanceof new return throw typeof void yield".split())


def header_comments(text: str) -> list[str]:
    """Comments that start a line within the first HEADER_LINES, line by line, without their signs."""
    head = "\n".join(x.removesuffix("\r") for x in text.split("\n", HEADER_LINES)[:HEADER_LINES])
    head = re.sub(r"^\ufeff?#![^\n\r\u2028\u2029]*", "", head)
    out: list[str] = []
    leading, operand, at, holes = True, True, 0, []
    while at < len(head):
        c = head[at]
        if c == "`" or c == "}" and holes and holes[-1] == 0:  # a template's text, up to its end or a hole
            if c == "}":
                holes.pop()
            m = re.compile(r"(?:[^`\\$]|\\[\s\S]|\$(?!\{))*(`|\$\{|$)").match(head, at + 1)
            at, leading, operand = m.end(), False, m[1] == "${"
            if operand:
                holes.append(0)
            continue
        m = (_PATTERN if c == "/" and operand and head[at + 1 : at + 2] not in ("/", "*") else _HEADER).match(head, at)
        part, at = m[0], m.end()
        if part.isspace() or part == "\ufeff":
            leading = leading or part in "\n\r\u2028\u2029"
        elif part.startswith(("//", "/*")) and not (c == "/" and operand and part[1:2] not in "/*"):
            if leading:
                body = part[2:].removesuffix("*/") if part.startswith("/*") else part[2:]
                out += [x.strip().lstrip("/*").strip() for x in body.split("\n")]
        else:
            leading = False
            if holes and part in "{}":
                holes[-1] += 1 if part == "{" else -1
            operand = part in _OPERAND_NEXT or not (part[0].isalnum() or part[0] in "_$#'\")]}" or len(part) > 1 and part[0] == "/")
    return out


def is_generated_text(text: str) -> bool:
    """The header has the tag, or one of the markers, or both names a generator and warns of edits."""
    found = header_comments(text)
    if any(re.search(GENERATED_TAG, x, re.ASCII) for x in found):
        return True
    folded = ["".join(c.lower() if c.isascii() else c for c in x) for x in found]
    any_of = lambda pattern: any(re.search(pattern, x, re.ASCII) for x in folded)
    return any(map(any_of, GENERATED_MARKERS)) or any_of(ATTRIBUTION) and any_of(EDIT_WARNING)


def with_generated(files: DataFrame, text: str = "text") -> DataFrame:
    """files with `generated`, by the header of each text; a text that can't hold a marker isn't read.  Null text: not generated."""
    may = F.lower(F.substring_index(text, "\n", HEADER_LINES)).contains("generated")
    out = F.pandas_udf(lambda s: s.map(lambda t: t is not None and is_generated_text(t)).astype(bool), "boolean")
    head = F.substring_index(F.when(may, F.col(text)), "\n", HEADER_LINES)
    return files.withColumn("generated", F.coalesce(out(head), F.lit(False)))


def attributes(rows: DataFrame) -> DataFrame:
    """root, path, attributes (a map) of long rows root, path, ord, name, value; the last value of a name stands."""
    last = rows.groupBy("root", "path", "name").agg(F.max_by("value", "ord").alias("value"))
    return last.groupBy("root", "path").agg(F.map_from_entries(F.collect_list(F.struct("name", "value"))).alias("attributes"))


def is_set(value: Column) -> Column:
    return F.coalesce(value.isin("true", "set"), F.lit(False))


def opts_out(value: Column) -> Column:
    return F.coalesce(value.isin("unset", "false"), F.lit(False))


def selected(listing: DataFrame, values: DataFrame, tool: str = "gapweave", keep_generated: bool = False) -> DataFrame:
    """listing (root, path, argument, and maybe ignored, generated, nested) with `verdict` of every listed path: no-source, nested, ignored, opted-out, excluded, generated or kept.

    nested: the path lies in a repository of its own.  values: what attributes() gives.  One equi-join on (root, path).
    """
    def flag(c):
        return F.coalesce(F.col(c), F.lit(False)) if c in listing.columns else F.lit(False)

    joined = listing.join(values, ["root", "path"], "left")
    of = lambda name: F.try_element_at("attributes", F.lit(name))
    at = candidacy("path", True)
    generated = F.lit(not keep_generated) & (flag("generated") | is_generated_name("path") | is_set(of("linguist-generated")))
    judged = verdict(opts_out(of(tool)), (at == 1) & ~is_set(of(tool)), generated)
    out = F.when(at == 0, "no-source").when(flag("nested"), "nested").when(flag("ignored"), "ignored").otherwise(judged)
    return joined.withColumn("verdict", out).drop("attributes")


def empty_reasons(judged: DataFrame) -> DataFrame:
    """argument, ord, reason of each argument of which nothing is kept: the first of opted-out, ignored, generated, skipped that any of its files has, else none."""
    has = lambda v: F.coalesce(F.bool_or(F.col("verdict") == v), F.lit(False))
    found = judged.groupBy("argument").agg(F.min("ord").alias("ord"), has("kept").alias("kept"), F.when(has("opted-out"), "opted-out").when(has("ignored"), "ignored").when(has("generated"), "generated").when(has("excluded"), "skipped").otherwise("none").alias("reason"))
    return found.filter(~F.col("kept")).drop("kept")


def within(root, path) -> Column:
    """The path is the root or lies below it."""
    r, x = p._col(root), p._col(path)
    return (x == r) | F.startswith(x, F.concat(F.regexp_replace(r, "/$", ""), F.lit("/")))


def by_repository(written: DataFrame, roots: DataFrame) -> DataFrame:
    """root, paths: written paths (path, ord) by the deepest root above each, in order; paths in no repository are left out."""
    depth = F.size(F.split("path", "/", -1))
    above = written.withColumn("root", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(depth - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("path", "/", -1), F.lit(1), n), "/"))))
    deepest = above.join(roots.select("root"), "root").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"), F.min("ord").alias("ord"))
    return deepest.groupBy("root").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "path"))), lambda x: x["path"]).alias("paths"))


def zipped(files: DataFrame, sections: DataFrame) -> DataFrame:
    """files and sections (ord each) by position; if one side is longer the query fails, as neither can be told then."""
    both = files.withColumn("_f", F.lit(1)).join(sections.withColumn("_s", F.lit(1)), "ord", "full_outer")
    whole = F.assert_true(F.col("_f").isNotNull() & F.col("_s").isNotNull(), F.lit("files and sections differ in number"))
    return both.filter(whole.isNull()).drop("_f", "_s")


def staged(files: DataFrame, blobs: DataFrame) -> DataFrame:
    """path, unstaged, content of staged regular files (path, mode, blob, unstaged); each blob is read once, links and submodules are left out."""
    once = blobs.dropDuplicates(["blob"])
    return files.filter(F.col("mode").isin("100644", "100755")).join(once, "blob").select("path", "unstaged", "content")


def changed_files(diff: DataFrame, untracked: DataFrame, written: DataFrame | None = None) -> DataFrame:
    """path, hunked (has a diff to read): changed and untracked paths once each; only written ones, if given."""
    new = untracked.select("path").distinct()
    both = diff.select("path").distinct().join(new, "path", "left_anti").withColumn("hunked", F.lit(True)).unionByName(new.withColumn("hunked", F.lit(False)))
    return both if written is None else both.join(written.select("path"), "path", "left_semi")
