"""Files of folders and repositories as tables: listings, changed and staged names, contents, the index.

Names are listed on the driver (a listing is small beside what it lists) by asking git, or by walking a folder with its ignore files; contents are read
by the executors.  Nothing here writes, and nothing of a repository's configuration is run: hooks, filters and external diffs stay off.
"""
from __future__ import annotations

import os
import struct
import subprocess
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .selection import ignore_regex

#: The tree without files, against which a repository without commits is compared; a tool's folder that is never walked.
EMPTY_TREE = "4b825dc642cb6eb9a060e54bf8d69288fbee4904"
NEVER = (".git",)
LISTING = "root string, path string, tracked boolean, ord int"


def _git(root: str, *words: str, given: bytes | None = None) -> bytes:
    quiet = ["-c", "core.fsmonitor=false", "-c", "diff.external=", "-c", "core.hooksPath=/dev/null"]
    env = os.environ | {"GIT_OPTIONAL_LOCKS": "0", "LC_ALL": "C"}
    return subprocess.run(["git", *quiet, *words], cwd=root, env=env, input=given, capture_output=True, check=True).stdout


def _names(out: bytes) -> list[str]:
    return [x.decode("utf-8", "surrogateescape") for x in out.split(b"\0") if x]


def _valid(name: str) -> bool:
    return not any("\udc80" <= c <= "\udcff" for c in name)


def repository_files(spark: SparkSession, root: str) -> DataFrame:
    """root, path, tracked, ord: tracked files, then others that no rule ignores; names that aren't UTF-8 are left out."""
    tracked = _names(_git(root, "ls-files", "-z", "--cached", "--", "."))
    known = set(tracked)
    others = [x for x in _names(_git(root, "ls-files", "-z", "--others", "--exclude-standard", "--", ".")) if x not in known]
    rows = [(root, x, x in known, i) for i, x in enumerate(dict.fromkeys(sorted(known) + others)) if _valid(x)]
    return spark.createDataFrame(rows, LISTING)


def folder_files(spark: SparkSession, root: str, ignore_names: tuple[str, ...] = (".gitignore",)) -> DataFrame:
    """The same of a plain folder: walked from the top, without links to folders; each folder's ignore file counts below it, the nearest rule last."""
    rows: list[tuple] = []

    def read(folder: str) -> list:
        import re

        out = []
        for name in ignore_names:
            try:
                with open(os.path.join(folder, name), encoding="utf-8") as f:
                    out += [(re.compile(r[0]), r[1], r[2]) for line in f if (r := ignore_regex(line))]
            except (OSError, UnicodeDecodeError):
                continue
        return out

    def ignored(path: str, is_folder: bool, layers: list[tuple[str, list]]) -> bool:
        for base, rules in reversed(layers):
            below = path[len(base) :]
            for expression, negated, folders in reversed(rules):
                if (is_folder or not folders) and expression.match(below):
                    return not negated
        return False

    def walk(folder: str, prefix: str, layers: list[tuple[str, list]]) -> None:
        layers = [*layers, (prefix, read(folder))]
        for e in sorted(os.scandir(folder), key=lambda e: os.fsencode(e.name)):
            path = prefix + e.name
            if e.is_dir(follow_symlinks=False):
                if e.name not in NEVER and not ignored(path, True, layers):
                    walk(e.path, path + "/", layers)
            elif e.is_file() and _valid(path) and not ignored(path, False, layers):
                rows.append((root, path, False, len(rows)))

    walk(root, "", [])
    return spark.createDataFrame(rows, LISTING)


def changed_names(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """Paths that differ from the last commit (from nothing, if there is none yet), and untracked ones."""
    try:
        _git(root, "rev-parse", "--verify", "-q", "HEAD")
        base = "HEAD"
    except subprocess.CalledProcessError:
        base = EMPTY_TREE
    differ = _names(_git(root, "diff", "--name-only", "--no-renames", "--no-ext-diff", "--no-textconv", "--diff-filter=d", "-z", base, "--"))
    new = _names(_git(root, "ls-files", "-z", "--others", "--exclude-standard"))
    table = lambda names: spark.createDataFrame([(x,) for x in names if _valid(x)], "path string")
    return table(differ), table(new)


def diff_lines(spark: SparkSession, root: str, paths: list[str], base: str = "HEAD") -> DataFrame:
    """key, ord, value: the lines of a full-context diff of the paths."""
    out = _git(root, "diff", "--unified=999999999", "--no-renames", "--no-ext-diff", "--no-textconv", "--no-color", base, "--", *paths).decode("utf-8", "replace")
    return spark.createDataFrame([(root, i, x) for i, x in enumerate(out.split("\n"))], "key string, ord int, value string")


def staged_names(spark: SparkSession, root: str) -> DataFrame:
    """path, mode, blob, unstaged of what the index holds beyond the last commit; unstaged: the working file differs from it."""
    fields = _git(root, "diff-index", "--cached", "--no-renames", "--diff-filter=d", "-z", "HEAD").split(b"\0")
    dirty = set(_names(_git(root, "diff", "--name-only", "--no-ext-diff", "-z")))
    rows = []
    for head, name in zip(fields[0::2], fields[1::2]):
        _, mode, _, blob, _ = head.decode().lstrip(":").split(" ")
        path = name.decode("utf-8", "surrogateescape")
        if _valid(path):
            rows.append((path, mode, blob, path in dirty))
    return spark.createDataFrame(rows, "path string, mode string, blob string, unstaged boolean")


def blobs(names: DataFrame, root: str) -> DataFrame:
    """blob, content: each blob once, read in batches by whoever holds the rows (the repository is on a shared path)."""
    def go(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for f in frames:
            ids = f.column(0).to_pylist()
            out = _git(root, "cat-file", "--batch", given="".join(f"{x}\n" for x in ids).encode())
            at, content = 0, []
            for _ in ids:
                end = out.index(b"\n", at)
                words = out[at:end].split(b" ")
                size = int(words[2]) if len(words) == 3 and words[2].isdigit() else None
                content.append(None if size is None else out[end + 1 : end + 1 + size])
                at = end + 1 + (0 if size is None else size + 1)
            yield pa.RecordBatch.from_arrays([f.column(0), pa.array(content, pa.binary())], names=["blob", "content"])

    return names.select("blob").distinct().mapInArrow(go, "blob string, content binary")


def decoded(files: DataFrame, content: str = "content") -> DataFrame:
    """files with text and read_error: content as UTF-8, or what is wrong with it; a null content couldn't be read."""
    good = F.is_valid_utf8(F.col(content).cast("string"))
    return files.withColumns({
        "text": F.when(good, F.col(content).cast("string")),
        "read_error": F.when(F.col(content).isNull(), "cannot be read").when(~good, "not valid UTF-8"),
    }).drop(content)


def texts(spark: SparkSession, root: str, listing: DataFrame) -> DataFrame:
    """path, text, read_error of listed files; read where the rows are, whatever their names (Spark's own file source skips some)."""
    folder = root.rstrip("/")

    def go(frames: Iterator) -> Iterator:
        import pyarrow as pa

        for f in frames:
            for i in range(0, f.num_rows, 64):
                names = f.column(0).slice(i, 64)
                content = []
                for x in names.to_pylist():
                    try:
                        with open(f"{folder}/{x}", "rb") as file:
                            content.append(file.read())
                    except OSError:
                        content.append(None)
                yield pa.RecordBatch.from_arrays([names, pa.array(content, pa.binary())], names=["path", "content"])

    return decoded(listing.select("path").mapInArrow(go, "path string, content binary"))


def buffer(spark: SparkSession, path: str, text: str) -> DataFrame:
    """A single text under a name."""
    return spark.createDataFrame([(path, text)], "path string, text string")


def index_entries(data: bytes) -> list[tuple[str, int, str, bool]]:
    """path, mode, blob, skipped of each entry of an index file of version 2 to 4."""
    if data[:4] != b"DIRC":
        raise ValueError("not an index")
    version, count = struct.unpack(">II", data[4:12])
    if version not in (2, 3, 4):
        raise ValueError(f"index version {version}")
    out, at, last = [], 12, b""
    for _ in range(count):
        start = at
        mode = struct.unpack(">I", data[at + 24 : at + 28])[0]
        blob = data[at + 40 : at + 60].hex()
        flags = struct.unpack(">H", data[at + 60 : at + 62])[0]
        at += 62
        skipped = False
        if flags & 0x4000:
            skipped = bool(struct.unpack(">H", data[at : at + 2])[0] & 0x4000)
            at += 2
        if version == 4:  # a name drops so many bytes of the one before it
            drop = data[at] & 0x7F
            while data[at] & 0x80:
                at += 1
                drop = ((drop + 1) << 7) | (data[at] & 0x7F)
            end = data.index(b"\0", at + 1)
            name, at = last[: len(last) - drop] + data[at + 1 : end], end + 1
        else:
            end = data.index(b"\0", at)
            name = data[at:end]
            at = start + ((end - start) // 8 + 1) * 8
        last = name
        out.append((name.decode("utf-8", "surrogateescape"), mode, blob, skipped))
    return out


def index_table(files: DataFrame) -> DataFrame:
    """root, path, mode, blob, skipped of index files (root, content)."""
    def go(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            for root, content in zip(f["root"], f["content"]):
                rows = [(root, *e) for e in index_entries(bytes(content)) if _valid(e[0])]
                yield pd.DataFrame(rows, columns=["root", "path", "mode", "blob", "skipped"])

    return files.select("root", "content").mapInPandas(go, "root string, path string, mode int, blob string, skipped boolean")


def written_back(fixed: DataFrame, root: str) -> DataFrame:
    """Write text over each file (path, before, text) whose content is still `before`; path, outcome (written | unchanged | stale | an error).

    A file is replaced by renaming a new one over it, so a lost executor leaves either; running again writes the same.  Give it to an action
    once: a table of outcomes is the only way to see what was done.
    """
    folder = root.rstrip("/")

    def one(path: str, before: str, text: str) -> str:
        if before == text:
            return "unchanged"
        name = os.path.realpath(f"{folder}/{path}")
        try:
            with open(name, "rb") as f:
                now = f.read()
            if now == text.encode():
                return "written"
            if now != before.encode():
                return "stale"
            new = f"{name}.{os.getpid()}.tmp"
            with open(new, "xb") as f:
                f.write(text.encode())
            os.chmod(new, os.stat(name).st_mode & 0o7777)
            os.replace(new, name)
            return "written"
        except OSError as e:
            return e.strerror or "failed"

    def go(frames: Iterator) -> Iterator:
        import pandas as pd

        for f in frames:
            yield pd.DataFrame({"path": f["path"], "outcome": [one(*r) for r in zip(f["path"], f["before"], f["text"])]})

    return fixed.select("path", "before", "text").mapInPandas(go, "path string, outcome string")
