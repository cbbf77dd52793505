"""What the operators of this package share: sessions, tables, columns, checkpoints."""
from __future__ import annotations

import ctypes
import gc
import os
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    lean(spark)
    return table(spark, sf_dir, "documents").select(*(columns or ("doc_id", "text")))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set, as in tests."""
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir isn't set; a cluster needs a shared folder there")
    folder = os.path.join(tempfile.gettempdir(), "gapweave-checkpoints")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def materialised(df: DataFrame, name: str) -> DataFrame:
    """df written as a table to the shared folder and read again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/gapweave/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hash64(*columns) -> F.Column:
    return F.xxhash64(*columns)


def pieces(n: int, each: int, least: int = 1) -> int:
    """Number of partitions so that each gets about `each` of n things."""
    return max(least, -(-n // each))


def longs(df: DataFrame) -> np.ndarray:
    """The longs of df's only column, sorted, on the driver.  Each task sends one array: rows would take some hundred bytes each there."""

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        own = [b.column(0).to_numpy(zero_copy_only=False) for b in batches]
        if own:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate(own).astype(np.int64).tobytes()], pa.binary())], names=["longs"])

    got = [np.frombuffer(r["longs"], np.int64) for r in df.mapInArrow(go, "longs binary").collect()]
    return np.sort(np.concatenate(got)) if got else np.zeros(0, np.int64)


#: Of text in a slice that a worker holds at once, unless a single text is longer.
CHUNK_BYTES = 4 << 20


def lean(spark: SparkSession, rows: int = 1024) -> None:
    """Arrow batches of at most so many rows and bytes, in this session: long texts would make the usual ones large."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.execution.arrow.maxBytesPerBatch", 2 * CHUNK_BYTES)):
        try:
            now = int(re.sub(r"\D+$", "", spark.conf.get(name)))
        except Exception:  # noqa: BLE001  a version without that setting
            continue
        if not 0 < now <= most:
            spark.conf.set(name, str(most))


def chunks(batches: Iterator, text: int, rows: int = 1024, size: int = CHUNK_BYTES) -> Iterator:
    """Slices of Arrow batches: at most `rows` rows whose texts (column `text`) hold about `size` bytes; a longer text is a slice of
    its own.  At the end the worker gives memory back."""
    import pyarrow.compute as pc

    try:
        for b in batches:
            ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < b.num_rows:
                fit = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
                end = min(max(fit, at + 1), at + rows, b.num_rows)
                yield b.slice(at, end - at)
                at = end
    finally:
        give_back()


def give_back() -> None:
    """Free memory that allocators hold on to; a worker lives on after its task."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


_kept: dict[str, object] = {}


def kept(name: str, make: Callable[[], object]):
    """What a worker keeps of one operator from task to task (a vocabulary, a cache); the next operator's takes its place."""
    if name not in _kept:
        _kept.clear()
        gc.collect()
        _kept[name] = make()
        give_back()
    return _kept[name]
