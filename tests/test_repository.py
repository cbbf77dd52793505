import os
import subprocess

import pytest
from pyspark.sql import functions as F

from gapweave.plans import analysis
from gapweave.sources import diffs, repository, selection


def git(root, *words):
    subprocess.run(["git", "-c", "user.name=x", "-c", "user.email=x@x", "-c", "init.defaultBranch=main", *words], cwd=root, check=True, capture_output=True)


def put(root, path, text):
    full = os.path.join(root, path)
    os.makedirs(os.path.dirname(full), exist_ok=True)
    with open(full, "wb") as f:
        f.write(text.encode() if isinstance(text, str) else text)


SOURCE = "if (a) {\n  b();\n}\nc();\n"


@pytest.fixture()
def root(tmp_path):
    r = str(tmp_path / "r")
    os.makedirs(r)
    git(r, "init", "-q")
    for path, text in {"a.ts": SOURCE, "_draft.ts": SOURCE, ".hid/b.ts": "x();\n", "dist/c.ts": SOURCE, "bad.ts": b"\xff\xfe", ".gitignore": "*.log\nskip/\n!keep.log\n", "x.log": "", "keep.log": "", "skip/d.ts": "", "sub/.gitignore": "*.md\n", "sub/e.md": "", "sub/f.ts": ""}.items():
        put(r, path, text)
    return r


LISTED = [".gitignore", ".hid/b.ts", "_draft.ts", "a.ts", "bad.ts", "dist/c.ts", "keep.log", "sub/.gitignore", "sub/f.ts"]


def names(df):
    return sorted(r.path for r in df.collect())


def test_listings_agree(spark, root):
    assert names(repository.repository_files(spark, root)) == LISTED == names(repository.folder_files(spark, root))
    changed, new = repository.changed_names(spark, root)  # no commit yet
    assert names(changed) == [] and names(new) == LISTED
    git(root, "add", "-A")
    assert names(repository.changed_names(spark, root)[0]) == LISTED


def test_contents_and_index(spark, root):
    listing = repository.repository_files(spark, root)
    read = {r.path: (r.text, r.read_error) for r in repository.texts(spark, root, listing.unionByName(listing.limit(0)).union(spark.createDataFrame([(root, "gone.ts", False, 99)], listing.schema))).collect()}
    assert read["a.ts"] == (SOURCE, None) and read["bad.ts"] == (None, "not valid UTF-8") and read["gone.ts"] == (None, "cannot be read") and read["_draft.ts"][0] == SOURCE
    git(root, "add", "-A")
    git(root, "commit", "-qm", "x")
    put(root, "a.ts", SOURCE + "d();\n")
    put(root, "new.ts", "n();\n")
    git(root, "add", "a.ts", "new.ts")
    put(root, "a.ts", SOURCE)
    staged = repository.staged_names(spark, root)
    assert sorted((r.path, r.mode, r.unstaged) for r in staged.collect()) == [("a.ts", "100644", True), ("new.ts", "100644", False)]
    both = selection.staged(staged, repository.blobs(staged, root))
    assert {r.path: bytes(r.content).decode() for r in both.collect()} == {"a.ts": SOURCE + "d();\n", "new.ts": "n();\n"}
    for version in ("2", "4"):
        git(root, "update-index", "--index-version", version)
        with open(f"{root}/.git/index", "rb") as f:
            rows = repository.index_table(spark.createDataFrame([(root, bytearray(f.read()))], "root string, content binary")).collect()
        assert sorted(r.path for r in rows) == sorted([*LISTED, "new.ts"]) and {r.blob for r in rows if r.path == "new.ts"} == {r.blob for r in staged.collect() if r.path == "new.ts"}


def test_changed_lines_to_written_files(spark, root):
    """From a repository's diff to its files: only what was changed is mended."""
    git(root, "add", "-A")
    git(root, "commit", "-qm", "x")
    put(root, "a.ts", "if (a) {\n  b();\n}\nc();\nif (d) {\n  e();\n}\n")
    changed, new = repository.changed_names(spark, root)
    assert names(changed) == ["a.ts"] and names(new) == []
    parts = diffs.sections(repository.diff_lines(spark, root, ["a.ts"]), "key")
    lines = diffs.changed(parts.select(F.lit("a.ts").alias("path"), "rows"))
    assert sorted((r.line, r.kind) for r in lines.collect()) == [(5, "line"), (6, "line"), (7, "line")]
    files = repository.texts(spark, root, changed)
    fixed = analysis.fixed(analysis.with_changes(files.select("path", "text"), lines))
    both = files.select("path", F.col("text").alias("before")).join(fixed, "path")
    assert [tuple(r) for r in repository.written_back(both, root).collect()] == [("a.ts", "written")]
    with open(f"{root}/a.ts") as f:
        assert f.read() == "if (a) {\n  b();\n}\nc();\nif (d) e();\n"
    rows = spark.createDataFrame([("a.ts", "old", "new"), ("none.ts", "a", "b"), ("_draft.ts", SOURCE, SOURCE)], "path string, before string, text string")
    assert {r.path: r.outcome for r in repository.written_back(rows, root).collect()} == {"a.ts": "stale", "none.ts": "No such file or directory", "_draft.ts": "unchanged"}


def test_single_buffer(spark):
    assert [tuple(r) for r in analysis.fixed(repository.buffer(spark, "x.ts", "if (a) {\n  b();\n}\n")).collect()] == [("x.ts", "if (a) b();\n")]
