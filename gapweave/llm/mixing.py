"""Mixing sources to target weights by hash thresholds.

Each source gets a target number of words.  All its documents are taken floor(target / total)
times; the rest is filled by documents whose hash lies under a threshold.  Thresholds come from
histograms: words are summed by source and hash bucket, the bucket in which the budget ends is found,
and only that bucket is split further, until it holds one document.  What is then still missing is filled
the same way by documents no larger than the gap (nested budgets), until less than CLOSE of the target is missing or
nothing left out fits, so documents stay whole and the words taken miss the target by little.  Rows are filtered by threshold; they are never sorted.

Hashes are of doc_id and text: reruns agree whatever the partitions, and equal rows are taken alike.
Null text and empty text have size 0; null is a source of its own, after the others; an empty table
gives no rows; other columns pass through mix() and are ignored by plan().
"""
from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, documents, materialised

WEIGHTS = (5, 2, 1)
MOST = 3
BITS, LEVELS = 12, 5
#: A source is filled once it misses its target by less than this share, or no document left out is small enough.
CLOSE = 1 / 1000
#: Sources are a dimension of the mix: their totals, not their documents, come to the driver.
MOST_SOURCES = 100_000


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(key: str = "doc_id", text: str = "text") -> Column:
    return F.shiftrightunsigned(F.xxhash64(F.col(key), F.col(text)), 64 - BITS * LEVELS)


def source_key(source: str = "source") -> Column:
    return F.when(F.col(source).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(source).cast("string")))


def targets(totals: dict[str | None, int], weights=WEIGHTS, most: int = MOST) -> dict[str | None, Fraction]:
    """Shares of all words by weight, stopped at `most` times a source's words, the excess shared anew."""
    order = sorted(totals, key=lambda s: (s is None, s or ""))
    weight = {s: Fraction(weights[i % len(weights)]) for i, s in enumerate(order)}
    out: dict[str | None, Fraction] = {}
    left, open_ = Fraction(sum(totals.values())), list(order)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if unit * weight[s] > most * totals[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = Fraction(most * totals[s])
            left -= out[s]
        open_ = [s for s in open_ if s not in out]
    return out


def _threshold(rows: DataFrame, budgets: dict[str, int], caps: dict[str, int], taken: dict[str, list]) -> dict[str, tuple[int, int]]:
    """By source: the bound under which rows no larger than the cap, and not yet taken, fit the budget, and their words."""
    spark = rows.sparkSession
    state = {s: (0, b) for s, b in budgets.items() if b > 0}
    done: dict[str, tuple[int, int]] = {}
    for level in range(LEVELS):
        if not state:
            break
        shift = BITS * (LEVELS - 1 - level)
        at = spark.createDataFrame(
            [(s, lo, left, caps[s], [(c, b) for c, b in taken[s]]) for s, (lo, left) in state.items()],
            "key string, lo long, left_over long, cap long, taken array<struct<cap: long, bound: long>>",
        )
        free = ~F.exists("taken", lambda t: (F.col("size") <= t.cap) & (F.col("u") < t.bound))
        inside = F.lit(True) if level == 0 else F.shiftright("u", shift + BITS) == F.shiftright("lo", shift + BITS)
        sums = (
            rows.join(F.broadcast(at), "key")  # a row for each source, MOST_SOURCES at most
            .filter((F.col("size") > 0) & (F.col("size") <= F.col("cap")) & inside & free)
            .groupBy("key", "left_over", F.shiftright("u", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"), F.count("*").alias("n"))
        )
        w = Window.partitionBy("key").orderBy("bucket")
        upto = sums.withColumn("upto", F.sum("words").over(w))
        found = upto.filter(F.col("upto") > F.col("left_over")).groupBy("key", "left_over").agg(F.min(F.struct("bucket", "upto", "words", "n")).alias("b"))
        over = {r["key"]: r for r in found.collect()}
        for s, (lo, left) in list(state.items()):
            if s not in over:  # all of them fit
                done[s] = ((lo >> (shift + BITS)) + 1 << (shift + BITS) if level else 1 << (BITS * LEVELS), left)
                state.pop(s)
                continue
            b = over[s]["b"]
            state[s] = (b["bucket"] << shift, left - (b["upto"] - b["words"]))
            if b["n"] == 1 or level == LEVELS - 1:
                done[s] = state.pop(s)
    return done


def plan(rows: DataFrame, weights=WEIGHTS, most: int = MOST, close: float = CLOSE) -> DataFrame:
    """rows: key, source, u, size.  A row for each source: totals, target, whole copies, thresholds."""
    totals = rows.groupBy("key", "source").agg(F.sum("size").alias("words")).limit(MOST_SOURCES + 1).collect()
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources; they are a dimension of the mix and are planned on the driver")
    size = {r["key"]: r["words"] for r in totals}
    name = {r["key"]: r["source"] for r in totals}
    goal = {f"s{s}" if s is not None else "n": t for s, t in targets({name[k]: size[k] for k in size}, weights, most).items()}
    copies = {k: int(goal[k] / size[k]) if size[k] else 0 for k in size}
    gap = {k: int(goal[k] - copies[k] * size[k]) for k in size}
    taken: dict[str, list] = {k: [] for k in size}
    n = 0
    while want := {k: g for k, g in gap.items() if g > close * goal[k]}:
        caps = {k: g if n else 1 << 62 for k, g in want.items()}
        for k, (bound, left) in _threshold(rows, want, caps, taken).items():
            taken[k].append((caps[k], bound))
            gap[k] = left if left < want[k] or not n else 0  # nothing fits any more
        n += 1
    return rows.sparkSession.createDataFrame(
        [(k, size[k], float(goal[k]), copies[k], taken[k]) for k in size],
        "key string, source_size long, target double, whole int, thresholds array<struct<cap: long, bound: long>>",
    )


def sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", source_key().alias("key"), hash_of().alias("u"), size_of().alias("size"))


def _copies() -> Column:
    under = F.exists("thresholds", lambda t: (F.col("size") <= t.cap) & (F.col("u") < t.bound))
    return F.col("whole") + F.when((F.col("size") > 0) & under, 1).otherwise(0)


def counted(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every document."""
    rows = materialised(sized(docs), "mix")
    return rows.join(F.broadcast(plan(rows, weights, most)), "key").select("doc_id", "source", "size", "source_size", "target", _copies().alias("copies"))


def mix(docs: DataFrame, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs."""
    keep = docs.columns
    chosen = plan(materialised(sized(docs), "mix"), weights, most)
    packed = docs.select(F.struct(*keep).alias("row"), source_key().alias("key"), hash_of().alias("u"), size_of().alias("size"))
    times = F.array_repeat(F.lit(1), _copies().cast("int"))
    return packed.join(F.broadcast(chosen), "key").withColumn("n", F.explode(times)).select("row.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = counted(documents(spark, sf_dir, "doc_id", "text", "source"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))
