"""Exact top-k search by inner product: a ball tree per shard, branch and bound.

Vectors are whole numbers, floor(scale * x).  Rows go to the region of their nearest pivot (at most MOST_PIVOTS rows, those of smallest hash: a bounded
sample that only decides where rows lie, never what is found) and regions are cut into shards of about SHARD_ROWS by hash.  Each shard's tree is built
once and written to the shared folder.  A node bounds every score below it by q . centre + |q| * radius; a search visits the child of higher bound first
and skips nodes whose bound lies under the kth score so far.

Shards are searched in waves: for each query first the shard of highest bound, then the next NEXT ones, then the rest.  Between waves the kth score of each
query over all shards is shared, and only shards whose bound reaches it are asked at all; queries travel to trees, in blocks of about BLOCK_QUERIES, so a
task holds one tree and one block, whatever the tables' sizes.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id; shorter vectors
count as padded with 0.  Ties go to the smaller id; rows that repeat an id are candidates of their own, but never of a query with
that id, and a repeated query is asked once.  Scores beyond 64 bits stop at the limit.  An empty table gives no rows.
"""
from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialised, pieces, table

SHARD_ROWS, BLOCK_QUERIES, LEAF_ROWS = 8192, 2048, 128
MOST_PIVOTS, NEXT, BLOCK_SHARDS = 512, 4, 1024
LOWEST, HIGHEST = -(2**63), 2**63 - 1
SCHEMA = "query_id long, vec_id long, score long"


class BallTree:
    """Over rows x (whole numbers as float64) with ids; leaves list their rows by id."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.x, self.ids = x, ids
        self.nodes: list[tuple[np.ndarray, float, tuple]] = []
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> int:
        own = self.x[rows]
        centre = own.mean(0)
        radius = float(np.sqrt(((own - centre) ** 2).sum(1).max()))
        me = len(self.nodes)
        self.nodes.append((centre, radius, ()))
        if len(rows) <= LEAF_ROWS or radius == 0:
            order = rows[np.argsort(self.ids[rows], kind="stable")]
            self.nodes[me] = (centre, radius, ("leaf", order))
            return me
        far = own[((own - centre) ** 2).sum(1).argmax()]
        other = own[((own - far) ** 2).sum(1).argmax()]
        side = own @ (other - far)
        order = np.argsort(side, kind="stable")
        half = len(rows) // 2
        left, right = self._build(rows[order[:half]]), self._build(rows[order[half:]])
        self.nodes[me] = (centre, radius, ("split", left, right))
        return me


class Search:
    """The k best of each query so far; `floor`: scores that the k best reach for certain."""

    def __init__(self, q: np.ndarray, query_ids: np.ndarray, floor: np.ndarray, k: int):
        self.q, self.query_ids, self.k = q, query_ids, k
        self.norm = np.sqrt((q * q).sum(1))
        self.floor = floor.astype(float)
        self.score = np.full((len(q), k), LOWEST, np.int64)
        self.id = np.full((len(q), k), HIGHEST, np.int64)
        self.found = np.zeros((len(q), k), bool)

    def least(self, rows: np.ndarray) -> np.ndarray:
        own = np.where(self.found[rows, -1], self.score[rows, -1].astype(float), -np.inf)
        return np.maximum(own, self.floor[rows])

    def bound(self, node, rows: np.ndarray) -> np.ndarray:
        centre, radius, _ = node
        reach = self.norm[rows]
        dot = self.q[rows] @ centre
        slack = 1e-9 * reach * (np.sqrt((centre**2).sum()) + radius) + 1e-3
        return dot + reach * radius + slack

    def visit(self, tree: BallTree, at: int, rows: np.ndarray) -> None:
        rows = rows[self.bound(tree.nodes[at], rows) >= self.least(rows)]
        if not len(rows):
            return
        kind = tree.nodes[at][2]
        if kind[0] == "leaf":
            for a in range(0, len(kind[1]), 4096):
                self.scan(tree, kind[1][a : a + 4096], rows)
            return
        _, left, right = kind
        first = self.bound(tree.nodes[left], rows) >= self.bound(tree.nodes[right], rows)
        self.visit(tree, left, rows[first])
        self.visit(tree, right, rows[~first])
        self.visit(tree, right, rows[first])
        self.visit(tree, left, rows[~first])

    def scan(self, tree: BallTree, leaf: np.ndarray, rows: np.ndarray) -> None:
        q, x = self.q[rows], tree.x[leaf]
        if np.abs(q).max(initial=0) * np.abs(x).max(initial=0) * x.shape[1] < 2**53:
            score = (q @ x.T).astype(np.int64)
        else:  # exact in whole numbers
            big = [[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in x] for u in q]
            score = np.array([[min(max(s, LOWEST), HIGHEST) for s in r] for r in big], np.int64).reshape(len(q), len(x))
        ids = tree.ids[leaf]
        own = self.query_ids[rows][:, None] == ids[None, :]
        order = np.argsort(np.where(own, HIGHEST, ~score), axis=1, kind="stable")[:, : self.k]  # ~s falls as s grows
        score, usable, ids = np.take_along_axis(score, order, 1), ~np.take_along_axis(own, order, 1), ids[order]
        score = np.concatenate([self.score[rows], score], 1)
        ids = np.concatenate([self.id[rows], ids], 1)
        found = np.concatenate([self.found[rows], usable], 1)
        order = np.lexsort((ids, ~score, ~found), axis=1)[:, : self.k]
        self.score[rows], self.id[rows], self.found[rows] = (np.take_along_axis(v, order, 1) for v in (score, ids, found))


def _small(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the narrowest type that holds them."""
    most = np.abs(x).max(initial=0)
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.float64)


def _build(width: int):
    def go(key, f):
        import pandas as pd

        x = np.stack(f["v"].to_numpy()).reshape(len(f), width)
        tree = BallTree(x, f["vec_id"].to_numpy(np.int64))
        centre, radius, _ = tree.nodes[tree.root]
        tree.x = _small(tree.x)
        return pd.DataFrame({"shard": [int(key[0])], "centre": [centre], "radius": [radius], "tree": [pickle.dumps(tree, 5)]})

    return go


def _vectors(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), width)


def _searched(width: int, k: int):
    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                tree = pickle.loads(b.column("tree")[i].as_py())  # what _build wrote
                tree.x = tree.x.astype(float)
                asked = b.column("asked")[i].values
                ids = asked.field("query_id").to_numpy(zero_copy_only=False)
                s = Search(_vectors(asked.field("q"), width), ids, asked.field("floor").to_numpy(zero_copy_only=False), k)
                s.visit(tree, tree.root, np.arange(len(ids)))
                row, col = np.nonzero(s.found)
                yield pa.RecordBatch.from_arrays([pa.array(s.query_ids[row], pa.int64()), pa.array(s.id[row, col], pa.int64()), pa.array(s.score[row, col], pa.int64())], names=["query_id", "vec_id", "score"])

    return go


def _bounds(queries: DataFrame, balls: DataFrame, width: int, best: bool) -> DataFrame:
    """query_id, q, floor, shard, bound: for each query the shard of highest bound of each block of shards, or all that reach its floor.

    queries: query_id, q, floor; balls: shard, centre, radius.  Shards are some ten thousandth of the rows; they are met in blocks, by an equi-join.
    """
    n = pieces(balls.count(), BLOCK_SHARDS)
    packed = balls.withColumn("part", (F.col("shard") % n).cast("int")).groupBy("part").agg(F.collect_list(F.struct("shard", "centre", "radius")).alias("balls"))
    asked = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(1 << 20)) % pieces(queries.count(), BLOCK_QUERIES))
    grouped = asked.groupBy("part", "block").agg(F.collect_list(F.struct("query_id", "q", "floor")).alias("asked"))

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for i in range(b.num_rows):
                them, asked = b.column("balls")[i].values, b.column("asked")[i].values
                centre, q = _vectors(them.field("centre"), width), _vectors(asked.field("q"), width)
                radius, shard = them.field("radius").to_numpy(zero_copy_only=False), them.field("shard").to_numpy(zero_copy_only=False)
                norm = np.sqrt((q * q).sum(1))[:, None]
                bound = q @ centre.T + norm * radius + 1e-9 * norm * (np.sqrt((centre * centre).sum(1)) + radius) + 1e-3
                if best:
                    row, col = np.arange(len(q)), bound.argmax(1)
                else:
                    row, col = np.nonzero(bound >= asked.field("floor").to_numpy(zero_copy_only=False)[:, None])
                pick = asked.take(pa.array(row))
                yield pa.RecordBatch.from_arrays([pick.field("query_id"), pick.field("q"), pick.field("floor"), pa.array(shard[col], pa.int32()), pa.array(bound[row, col])], names=["query_id", "q", "floor", "shard", "bound"])

    return grouped.join(packed, "part").mapInArrow(go, "query_id long, q array<double>, floor double, shard int, bound double")


def whole_numbers(df: DataFrame, scale: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """vec_id, v array<double> of whole numbers; without rows that take no part."""
    good = F.col(vector).isNotNull() & F.col(key).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    kept = df.filter(good).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("e"))
    return kept.select("vec_id", F.transform("e", lambda x: _floor(x.cast("double") * scale)).alias("v"))


def _floor(x):
    """Floor as a double, whatever its size."""
    return F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x)


def _sharded(vectors: DataFrame, n: int) -> DataFrame:
    """vectors with their shard: regions around pivots, cut by hash."""
    shards = pieces(n, SHARD_ROWS)
    spark = vectors.sparkSession
    if shards == 1:
        return vectors.withColumn("shard", F.lit(0))
    pivots = np.stack([r["v"] for r in vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(min(MOST_PIVOTS, shards)).collect()])
    sent = spark.sparkContext.broadcast(pivots)  # MOST_PIVOTS rows at most

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            p = sent.value
            x = _vectors(b.column(1), p.shape[1])
            near = ((p * p).sum(1) - 2 * (x @ p.T)).argmin(1)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(near, pa.int32())], names=["vec_id", "v", "region"])

    placed = materialised(vectors.select("vec_id", "v").mapInArrow(go, "vec_id long, v array<double>, region int"), "regions")
    start, cut = 0, []
    for r in placed.groupBy("region").count().orderBy("region").collect():  # MOST_PIVOTS at most
        parts = pieces(r["count"], SHARD_ROWS)
        cut.append((r["region"], start, parts))
        start += parts
    regions = F.broadcast(spark.createDataFrame(cut, "region int, start int, parts int"))
    shard = F.col("start") + F.pmod(F.xxhash64("vec_id", "v"), "parts")
    return placed.join(regions, "region").select("vec_id", "v", shard.cast("int").alias("shard"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """vectors: vec_id, v; queries: query_id, v.  query_id, rank, vec_id, score: the k highest of each query."""
    lean(vectors.sparkSession)
    sizes = vectors.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    asked_sizes = queries.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("width")).first()
    width = max(sizes["width"] or 0, asked_sizes["width"] or 0, 1)
    padded = lambda c: F.concat(c, F.array_repeat(F.lit(0.0), F.lit(width) - F.size(c)))
    dealt = _sharded(vectors.select("vec_id", padded("v").alias("v")), sizes["n"])
    trees = materialised(dealt.groupBy("shard").applyInPandas(_build(width), "shard int, centre array<double>, radius double, tree binary"), "trees")
    balls = trees.select("shard", "centre", "radius")
    start = queries.select("query_id", padded("v").alias("q"), F.lit(float("-inf")).alias("floor"))
    blocks = pieces(asked_sizes["n"], BLOCK_QUERIES)

    def wave(pairs: DataFrame, name: str) -> DataFrame:
        block = F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(blocks)).cast("int")
        grouped = pairs.withColumn("block", block).groupBy("shard", "block").agg(F.collect_list(F.struct("query_id", "q", "floor")).alias("asked"))
        found = grouped.join(trees.select("shard", "tree"), "shard").select("asked", "tree").mapInArrow(_searched(width, k), SCHEMA)
        return materialised(found, name)

    def ranked(found: DataFrame) -> DataFrame:
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)

    def floors(found: DataFrame) -> DataFrame:
        return ranked(found).groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).cast("double").alias("now"))

    lowest = F.lit(float("-inf"))
    home = _bounds(start, balls, width, True).groupBy("query_id", "q", "floor").agg(F.max_by("shard", "bound").alias("shard"))
    home = materialised(home, "home")
    found = wave(home, "first")
    known = start.drop("floor").join(floors(found), "query_id", "left").select("query_id", "q", F.coalesce("now", lowest).alias("floor"))
    rest = _bounds(known, balls, width, False).join(home.select("query_id", "q", "shard"), ["query_id", "q", "shard"], "left_anti")
    nth = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("bound"), "shard"))
    rest = materialised(rest.withColumn("nth", nth), "rest")
    found = found.unionByName(wave(rest.filter(F.col("nth") <= NEXT), "second"))
    last = rest.filter(F.col("nth") > NEXT).join(floors(found), "query_id", "left").withColumn("floor", F.coalesce("now", lowest)).filter("bound >= floor")
    found = found.unionByName(wave(last, "third"))
    return ranked(found).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = whole_numbers(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), 256)
    queries = vectors.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "v").dropDuplicates(["query_id", "v"])
    return top_k(vectors, queries, 5)


ORACLE = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE) FOR x IN embedding] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""
