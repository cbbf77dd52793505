"""Exact n-gram Jaccard join by sizes: subsets of small sets, inverted lists of large ones.

A document's set holds the hashes of its distinct W-word shingles.  Equal sets are one class.  Two classes link if
PERCENT * |union| <= 100 * |intersection|; for sizes s and t that fixes the overlap they need.

* Small sets (up to a boundary): for each partner size, every subset as large as the needed overlap is enumerated.  Two
  small sets link exactly if they share one, so all that share a subset hang on one of them; no pair is ever listed.
* Large sets (and small ones near the boundary): inverted lists of the tokens that a linked pair must share one of, the
  first s - ceil(s * PERCENT / 100) + 1 in a common order, which has frequent tokens last.  Rows of a list pair up if sizes and
  parity bitmaps (a lower bound of the difference) allow; long lists do so in blocks, each of which returns a forest of its pairs.
  So a frequent token alone connects nothing, however long its list.  That gives candidate groups.  Each is verified on its sets, in blocks of at most BLOCK x BLOCK classes, so no task gets an unbounded group; a block returns a forest of its
  links, not all pairs.  In groups of more than WIDE blocks, members that link with the first class are connected by that, and only the others meet the group.
* The boundary is where the summed cost of subsets and lists, from the histogram of sizes, is least.

Hashes have 64 bits; equality of shingles is equality of hashes.  Null text and text without words give the empty set,
which links with nothing; fewer than W words are one shingle.  Repeated rows are one class; a null doc_id
takes part but names no component while another id is there.  An empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, chunks, documents, kept, lean, longs, materialised, pieces
from .components import components

WORDS, PERCENT = 3, 90
#: Lists longer than HEAVY make their token a frequent one; at most MOST_HEAVY are told to the tasks (8 bytes each).
HEAVY, MOST_HEAVY = 32, 1_000_000
#: Rows of longer lists pair up in blocks of so many.
LONG_LIST, LIST_BLOCK = 128, 2048
#: Classes of a block; groups of more than WIDE blocks go by their first class.
BLOCK, WIDE = 512, 16
LARGEST_SMALL = 36
SIG = 4
#: Sets of at least BIG_FROM shingles have a second bitmap of BIG longs, which only pairs that pass the first fetch.
BIG_FROM, BIG = 500, 64
CACHE_WORDS = 100_000
ROWS = 1024
#: Ids, and rows of pairs of blocks, that are broadcast at most; the driver holds them several times.
MOST_BROADCAST, MOST_MEET = 1_000_000, 100_000


def needed(s: int, t: int, percent: int = PERCENT) -> int:
    """Least overlap of linked sets of these sizes."""
    return -(-percent * (s + t) // (100 + percent))


def partners(s: int, percent: int = PERCENT) -> range:
    return range(-(-percent * s // 100), 100 * s // percent + 1)


def subset_count(s: int, most: int, percent: int = PERCENT) -> int:
    return sum(math.comb(s, needed(s, t, percent)) for t in partners(s, percent) if t <= most)


def prefix_length(s: int, percent: int = PERCENT) -> int:
    return s - -(-percent * s // 100) + 1


# -- sets -----------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Shingler:
    """Sorted arrays of shingle hashes of texts; words are hashed once and kept up to CACHE_WORDS."""

    def __init__(self, words: int):
        self.words = words
        self.cache: dict[bytes, int] = {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        import xxhash

        split = [(t or "").encode("utf-8", "replace").lower().split() for t in texts]  # of bytes: ASCII only
        if len(self.cache) > CACHE_WORDS:
            self.cache = {}
        cache = self.cache
        for w in {w for ws in split for w in ws}.difference(cache):
            cache[w] = xxhash.xxh3_64_intdigest(w)
        sizes = [len(ws) for ws in split]
        flat = np.fromiter((cache[w] for ws in split for w in ws), np.uint64, sum(sizes))
        out, at = [], 0
        for n in sizes:
            h = flat[at : at + n]
            at += n
            k = min(self.words, n)
            if not k:
                out.append(np.zeros(0, np.int64))
                continue
            x = np.full(n - k + 1, 0x9E3779B97F4A7C15 * k & (2**64 - 1), np.uint64)
            for i in range(k):
                x = _mix(x + h[i : n - k + 1 + i])
            x = x.view(np.int64)
            x.sort()
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        return out


def shingler(words: int) -> Shingler:
    return kept(f"shingles-{words}", lambda: Shingler(words))


def _prefix(s: np.ndarray, heavy: np.ndarray, percent: int) -> np.ndarray:
    """The first tokens in the common order: by hash, frequent ones last."""
    k = prefix_length(len(s), percent)
    if not len(heavy):
        return s[:k]
    last = heavy[np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)] == s
    return np.concatenate([s[~last], s[last]])[:k]


def _parity(s: np.ndarray, longs: int = SIG) -> np.ndarray:
    bits = np.bincount((s.view(np.uint64) >> np.uint64(20)).astype(np.int64) & (64 * longs - 1), minlength=64 * longs) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _set_id(s: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63


def _tokens(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """token: of the hash-order prefix of every document."""

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        none = np.zeros(0, np.int64)
        for part in chunks(batches, 0, ROWS):
            sets = shingler(words).sets(part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_prefix(s, none, percent) for s in sets] or [none]))], names=["token"])

    return docs.select("text").mapInArrow(go, "token long")


def _signatures(docs: DataFrame, heavy: np.ndarray, words: int, percent: int) -> DataFrame:
    """doc_id, t (hash of the text), c (class), n, prefix and bitmaps of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)  # MOST_HEAVY longs at most

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in chunks(batches, 1, ROWS):
            sets = shingler(words).sets(part.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(2),
                    pa.array([_set_id(s) for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([_prefix(s, sent.value, percent) for s in sets], pa.list_(pa.int64())),
                    pa.array([_parity(s) for s in sets], pa.list_(pa.int64())),
                    pa.array([_parity(s, BIG) if len(s) >= BIG_FROM else None for s in sets], pa.list_(pa.int64())),
                ],
                names=["doc_id", "t", "c", "n", "prefix", "sig", "big"],
            )

    return docs.mapInArrow(go, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, t long, c long, n long, prefix array<long>, sig array<long>, big array<long>")


def _heavy(docs: DataFrame, words: int, percent: int) -> np.ndarray:
    counts = materialised(_tokens(docs, words, percent).groupBy("token").count().filter(F.col("count") > HEAVY), "heavy")
    n, least = counts.count(), HEAVY
    while n > MOST_HEAVY:  # the order may be any; fewer tokens only make it less good
        least *= 2
        n = counts.filter(F.col("count") > least).count()
    return longs(counts.filter(F.col("count") > least).select("token"))


# -- small sets -----------------------------------------------------------------------------------


def boundary(histogram: dict[int, int], percent: int = PERCENT) -> int:
    """Up to which size subsets cost less than lists.  A list's row counts ROW_COST of a subset's: it is paired and verified."""
    row_cost = 4.0
    best, at = None, 0
    for b in range(0, LARGEST_SMALL + 1):
        cost = sum(n * subset_count(s, b, percent) for s, n in histogram.items() if 0 < s <= b)
        cost += row_cost * sum(n * prefix_length(s, percent) for s, n in histogram.items() if s > b or 100 * s >= percent * (b + 1))
        if best is None or cost < best:
            best, at = cost, b
    return at


def _small_edges(docs: DataFrame, wanted: DataFrame, most: int, words: int, percent: int) -> DataFrame:
    """wanted: the classes of at most `most` shingles.  a, b: classes that share a subset."""

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import xxhash

        for part in chunks(batches, 0, ROWS):
            c_out, key_out, low_out = [], [], []
            for s in shingler(words).sets(part.column(0).to_pylist()):
                c = _set_id(s)
                for t in partners(len(s), percent) if len(s) <= most else ():
                    if 0 < t <= most:
                        lo, hi = min(t, len(s)), max(t, len(s))
                        for sub in combinations(s, needed(lo, hi, percent)):
                            key_out.append(xxhash.xxh3_64_intdigest(np.array(sub, np.int64).tobytes(), lo * 64 + hi) - 2**63)
                            c_out.append(c)
                            low_out.append(c if len(s) == lo else None)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (key_out, c_out, low_out)], names=["key", "c", "low"])

    keyed = _texts_of(docs, wanted).mapInArrow(go, "key long, c long, low long")
    # All of a key link with one of the lower size, if there is any.
    heads = keyed.groupBy("key").agg(F.min("low").alias("a"), F.count("*").alias("k")).filter("k > 1 and a is not null").select("key", "a")
    return keyed.join(heads, "key").select("a", F.col("c").alias("b")).filter("a <> b").distinct()


# -- large sets -----------------------------------------------------------------------------------


def _candidates(classes: DataFrame, percent: int) -> DataFrame:
    """classes: c, n, prefix, sig.  a, b: edges that connect all classes which may link."""
    rows = classes.select("c", "n", F.explode("prefix").alias("token"))
    lists = rows.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1")
    shared = materialised(rows.join(lists, "token"), "lists")
    long = shared.filter(F.col("k") > LONG_LIST).select(F.col("token").alias("root"), F.col("c").alias("node"), F.ceil(F.col("k") / LIST_BLOCK).cast("int").alias("blocks"))
    sigs = classes.select("c", *[F.get("sig", F.lit(i)).alias(f"s{i}") for i in range(SIG)])
    short = shared.filter(F.col("k") <= LONG_LIST).select("token", "c", F.col("n").cast("int").alias("n")).join(sigs, "c")
    x, y = short.alias("x"), short.alias("y")
    differ = sum((F.bit_count(F.col(f"x.s{i}").bitwiseXOR(F.col(f"y.s{i}"))) for i in range(SIG)), F.lit(0))
    # the difference of linked sets is at most (100 - percent) / (100 + percent) of the sum of their sizes
    may = (F.col("x.c") < F.col("y.c")) & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n"))
    may = may & ((100 + percent) * differ <= (100 - percent) * (F.col("x.n") + F.col("y.n")))
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & may).select(F.col("x.c").alias("a"), F.col("y.c").alias("b")).distinct()
    big = classes.filter("big is not null")
    left = big.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("big").alias("ba"))
    right = big.select(F.col("c").alias("b"), F.col("n").alias("nb"), F.col("big").alias("bb"))
    bits = F.aggregate(F.zip_with("ba", "bb", lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda acc, v: acc + v)
    near = F.coalesce((100 + percent) * bits <= (100 - percent) * (F.col("na") + F.col("nb")), F.lit(True))
    pairs = pairs.join(left, "a", "left").join(right, "b", "left").filter(near).select("a", "b")
    return _long_pairs(long, classes, percent).union(pairs).distinct()


def forest(n: np.ndarray, sig: np.ndarray, big: list, first: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Pairs that connect all which sizes and bitmaps allow to link; only those on either side of `first`, or all if it is 0.

    n: sizes; sig: a row of SIG longs each; big: BIG longs each, or None.
    """
    m, label, out = len(n), np.arange(len(n)), []
    sig, big = sig.view(np.uint64), [x if x is None else x.view(np.uint64) for x in big]  # counting bits of signed numbers drops the sign
    for i in range(first or m):
        lo = first or i + 1
        may = np.flatnonzero((label[lo:] != label[i]) & (100 * np.minimum(n[i], n[lo:]) >= percent * np.maximum(n[i], n[lo:]))) + lo
        most = (100 - percent) * (n[i] + n[may])
        may = may[(100 + percent) * np.bitwise_count(sig[i] ^ sig[may]).sum(1, dtype=np.int64) <= most]
        for j in may.tolist():
            if label[j] == label[i]:
                continue
            if big[i] is not None and big[j] is not None and (100 + percent) * int(np.bitwise_count(big[i] ^ big[j]).sum()) > (100 - percent) * (n[i] + n[j]):
                continue
            out.append((i, j))
            label[label == label[j]] = label[i]
    return out


def _long_pairs(long: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """long: root (token), node (class), blocks of each row of a long list.  a, b: forests of the pairs that may link, block by block."""
    spark = long.sparkSession
    meet = materialised(_meeting(long.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))), "long")
    data = meet.join(classes.select(F.col("c").alias("node"), "n", "sig", "big"), "node")
    n_bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces(meet.count(), 2 * LIST_BLOCK))

    def go(f):
        import pandas as pd

        a_out, b_out = [], []
        for (_, i, j), g in f.groupby(["root", "i", "j"], sort=False):
            g = g.sort_values(["side", "node"])
            first, node = 0 if i == j else int((g["side"] == 0).sum()), g["node"].to_numpy(np.int64)
            if len(node) > 1 and (i == j or 0 < first < len(node)):
                big = [None if x is None else np.asarray(x, np.int64) for x in g["big"]]
                for x, y in forest(g["n"].to_numpy(np.int64), np.stack([np.asarray(x, np.int64) for x in g["sig"]]), big, first, percent):
                    a_out.append(node[x])
                    b_out.append(node[y])
        return pd.DataFrame({"a": pd.Series(a_out, dtype="int64"), "b": pd.Series(b_out, dtype="int64")})

    binned = data.withColumn("bin", F.pmod(F.xxhash64("root", "i", "j"), F.lit(n_bins)).cast("int"))
    return binned.groupBy("bin").applyInPandas(go, "a long, b long").filter("a <> b")


def links_of(sets: list[np.ndarray], first: int, percent: int = PERCENT) -> list[tuple[int, int]]:
    """A forest of the links between members; only pairs on either side of `first`, or all if it is 0."""
    m = len(sets)
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(m), size)
    _, token, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[token] > 1
    _, token = np.unique(token[shared], return_inverse=True)
    owner = owner[shared]
    order = np.argsort(token, kind="stable")
    token, owner = token[order], owner[order]
    overlap = np.zeros((m, m), np.float32)
    width = max(256, min(8192, (1 << 22) // m))
    for lo in range(0, int(token[-1]) + 1 if len(token) else 0, width):
        a, b = np.searchsorted(token, [lo, lo + width])
        dense = np.zeros((m, width), np.float32)
        dense[owner[a:b], token[a:b] - lo] = 1.0
        overlap += dense @ dense.T
    over = np.rint(overlap).astype(np.int64)
    linked = np.triu(100 * over >= percent * (size[:, None] + size[None, :] - over), 1)
    if first:
        linked[:first, :first] = False
        linked[first:, first:] = False
    root = list(range(m))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(linked), strict=True):
        p, q = find(int(i)), find(int(j))
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((int(i), int(j)))
    return out


def _hung(placed: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """root, node, linked: whether each member of a group links with its root.  Members meet the root block by block, so no key is hot."""
    roots = placed.filter("node = root")
    heads = sets_of(roots.select("node")).select(F.col("c").alias("root"), F.col("set").alias("of_root"))
    of_root = roots.select("root", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("own")).join(heads, "root")
    members = placed.filter("node <> root").select("root", "node", "own")
    own = members.join(sets_of(members.select("node")).withColumnRenamed("c", "node"), "node")
    over = F.size(F.array_intersect("set", "of_root"))
    return own.join(of_root, ["root", "own"]).select("root", "node", (100 * over >= percent * (F.size("set") + F.size("of_root") - over)).alias("linked"))


def _meeting(members: DataFrame) -> DataFrame:
    """root, node, own, blocks: each member beside every block of its group, each pair of blocks once; side tells the two apart."""
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least("own", o).alias("i"), F.greatest("own", o).alias("j")))
    each = members.withColumn("meet", F.explode(meets))
    return each.select("root", "node", F.lit(0).alias("part"), "meet.i", "meet.j", (F.col("own") != F.col("meet.i")).cast("int").alias("side"))


def _verified(groups: DataFrame, sets_of: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """groups: node, root.  sets_of: c, set of the classes named by node.  a, b: links, connecting what linked pairs within a group connect.

    Groups of up to WIDE blocks are verified block by block.  In larger ones, members that link with their group's root are connected by that alone; only the
    others meet each other and those, block by block.  So a group of near copies of its root, of whatever size, costs its members a few times, not the square.
    """
    spark = groups.sparkSession
    count = lambda df, name: df.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    placed = materialised(groups.join(count(groups, "blocks"), "root").withColumn("own", block("blocks")), "placed")
    large = placed.filter(F.col("blocks") > WIDE)
    meet = _meeting(placed.filter(F.col("blocks") <= WIDE))
    star = placed.select("root", "node", F.lit(True).alias("linked")).limit(0)
    if large.limit(1).count():
        star = materialised(_hung(large, sets_of, percent), "star")
        lone = star.filter(~F.col("linked")).select("root", "node")
        rest = lone.join(count(lone, "blocks"), "root").withColumn("own", block("blocks"))
        near = star.filter("linked").select("root", "node").unionByName(large.filter("node = root").select("root", "node")).distinct()
        sizes = count(lone, "lone").join(count(near, "near"), "root")
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        left = lone.join(sizes, "root").select("root", "node", F.lit(1).alias("part"), block("lone").alias("i"), every("near").alias("j"), F.lit(0).alias("side"))
        right = near.join(sizes, "root").select("root", "node", F.lit(1).alias("part"), every("lone").alias("i"), block("near").alias("j"), F.lit(1).alias("side"))
        meet = meet.unionByName(_meeting(rest)).unionByName(left).unionByName(right)
    meet = materialised(meet, "meet")
    n = meet.count()
    data = sets_of(meet.select("node").distinct()).withColumnRenamed("c", "node").join(F.broadcast(meet) if n <= MOST_MEET else meet, "node")
    n_bins = max(int(spark.conf.get("spark.sql.shuffle.partitions")), pieces(n, 500))

    def go(f):
        import pandas as pd

        a_out, b_out = [], []
        for (_, part, i, j), g in f.groupby(["root", "part", "i", "j"], sort=False):
            g = g.sort_values(["side", "node"])
            within = part == 0 and i == j
            first, node = 0 if within else int((g["side"] == 0).sum()), g["node"].tolist()
            if len(node) > 1 and (within or 0 < first < len(node)):
                for x, y in links_of([np.asarray(s, np.int64) for s in g["set"]], first, percent):
                    a_out.append(node[x])
                    b_out.append(node[y])
        return pd.DataFrame({"a": pd.Series(a_out, dtype="int64"), "b": pd.Series(b_out, dtype="int64")})

    binned = data.withColumn("bin", F.pmod(F.xxhash64("root", "part", "i", "j"), F.lit(n_bins)).cast("int"))
    found = binned.groupBy("bin").applyInPandas(go, "a long, b long").filter("a <> b")
    return star.filter("linked").select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(found)


def _texts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """text of one document of each class in wanted (and of whatever shares its doc_id)."""
    ids = materialised(wanted.select(F.col("doc_id").alias("_id")).distinct(), "wanted")
    few = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    return docs.join(few, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi").select("text")


def _sets_of(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """c, set of the classes in wanted (c, n, doc_id), and maybe of others."""

    def go(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for part in chunks(batches, 0, ROWS):
            sets = shingler(words).sets(part.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([_set_id(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], names=["c", "set"])

    return _texts_of(docs, wanted).mapInArrow(go, "c long, set array<long>")


def linked_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, t (hash of the text), n_shingles, class_id, component_id, root (names a component for certain) for every row of docs."""
    lean(docs.sparkSession)
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("t"))
    sigs = materialised(_signatures(docs, _heavy(docs, words, percent), words, percent), "sets")
    every = materialised(sigs.filter("n > 0").groupBy("c", "n").agg(F.min("doc_id").alias("doc_id")), "classes")
    histogram = {r["n"]: r["k"] for r in every.groupBy("n").agg(F.count("*").alias("k")).filter(F.col("n") <= 2 * LARGEST_SMALL).collect()}
    b = boundary(histogram, percent)
    chosen = materialised(sigs.filter((F.col("n") > 0) & (100 * F.col("n") >= percent * (b + 1))).select("c", "n", "prefix", "sig", "big").dropDuplicates(["c"]), "large")
    groups = components(_candidates(chosen, percent))
    grouped = materialised(groups, "groups")
    sets_of = lambda nodes: _sets_of(docs, every.join(nodes.select(F.col("node").alias("c")), "c", "left_semi"), words)
    edges = _verified(grouped, sets_of, percent).union(_small_edges(docs, every.filter(F.col("n") <= b), b, words, percent))
    roots = components(edges)
    least = every.select("c", F.col("doc_id").alias("first")).join(roots.withColumnRenamed("node", "c"), "c", "left")
    of_root = least.filter("root is not null").groupBy("root").agg(F.min("first").alias("component_id"))
    named = least.join(of_root, "root", "left").select("c", "first", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("root", "c").alias("root"))
    out = sigs.select("doc_id", "t", "n", "c").join(named, "c", "left")
    alone = F.col("n") == 0
    return out.select(
        "doc_id",
        "t",
        F.when(~alone, F.col("root")).alias("root"),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first")).alias("class_id"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of docs without all but one (smallest doc_id, then text hash) of each component; documents without words stay."""
    rows = materialised(linked_components(docs, words, percent).select("doc_id", "t", "root"), "verdicts")
    first = rows.filter("root is not null").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "t")).alias("keep"), F.count("*").alias("k")).filter("k > 1")
    member = rows.join(first, "root")
    differs = ~(F.col("doc_id").eqNullSafe(F.col("keep.doc_id")) & F.col("t").eqNullSafe(F.col("keep.t")))
    drop = materialised(member.filter(differs).select(F.col("doc_id").alias("_d"), F.col("t").alias("_t")).distinct(), "drop")
    again = member.filter(~differs).groupBy("root").count().filter("count > 1").limit(1).count() > 0
    few = F.broadcast(drop) if drop.count() <= MOST_BROADCAST else drop
    kept = docs.join(few, F.col("doc_id").eqNullSafe(F.col("_d")) & F.xxhash64("text").eqNullSafe(F.col("_t")), "left_anti")
    if not again:
        return kept
    worded = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)  # rows that repeat both id and text
    return kept.filter(worded).dropDuplicates(["doc_id", "text"]).union(kept.filter(~worded))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id", "class_id")
