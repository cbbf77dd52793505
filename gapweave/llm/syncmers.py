"""Document fingerprints from closed syncmers, with DataFrame functions only.

A text is a sequence of tokens: runs of at most TOKEN_CHARS characters that aren't ASCII white
space.  A k-mer is K tokens; its inner substrings are the S-token runs within it.  It is a closed
syncmer if the smallest hash of these lies at its first or last place.  Whether a k-mer is one depends on
its own tokens alone, so an edit elsewhere never moves an anchor.  The fingerprint holds every
distinct anchor with its first place, so it grows with the text.  An anchor of both fingerprints matches where its distance
(place in one less place in the other) is that of a neighbour among the common anchors, or the median, give or take DRIFT
tokens; so matches follow any number of insertions, cuts and moved passages.  The likeness is the Dice coefficient of matches.

Null text counts as empty.  Without tokens the fingerprint is empty; with fewer than K it is one anchor
of all.  Two empty fingerprints have likeness 1, an empty one and another 0.  Rows of one doc_id are
ordered by their text's hash; null ids come first; an id of very many rows is split by that hash.  An empty table gives no rows; other columns are ignored.
"""
from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents

K, S = 5, 2
TOKEN_CHARS = 16
DRIFT = 16
#: An anchor is one long: 39 bits of hash, one of side (0; set while two fingerprints are compared) and 24 of place.
PLACE_BITS = 24
PLACES, SIDE = (1 << PLACE_BITS) - 1, 1 << PLACE_BITS
HEAD = -(1 << (PLACE_BITS + 1))
NONE = 2**63 - 1
#: Rows of a range of ids; ids are dealt by at most MOST_RANGES ranges, each of which is sorted and may spill.
RANGE_ROWS, MOST_RANGES = 1000, 40_000
LOWEST = -(2**63)


def _all_after(array: str, first: int) -> Column:
    return F.slice(array, first, F.greatest(F.size(array), F.lit(1)))


def anchored(df: DataFrame, text: str, out: str) -> DataFrame:
    """df with `out`: array<long>, all anchors of the text, by hash.  Places from 2 ** 24 on, in texts of that many tokens, count as the last.

    What isn't an anchor is NONE until the end, so arrays hold no nulls and are sorted as plain longs.
    """
    keep = df.columns
    inner = K - S  # the last place of an inner substring
    tokens = F.regexp_extract_all(text, F.lit(rf"[^\x20\x09-\x0D]{{1,{TOKEN_CHARS}}}"), F.lit(0))
    df = df.select(*keep, F.transform(tokens, lambda x: F.xxhash64(x)).alias("_h"))
    df = df.select(*keep, "_h", F.zip_with("_h", _all_after("_h", 2), lambda a, b: F.xxhash64(a, b)).alias("_g"))  # the last one isn't used
    at = lambda i: F.get(F.col("_g"), i)
    packed = lambda h, i: h.bitwiseAND(F.lit(HEAD)).bitwiseOR(F.least(i, F.lit(PLACES)).cast("long"))
    closed = lambda x, i: F.least(x, at(i + inner)) <= F.least(*[at(i + j) for j in range(1, inner)])
    kmer = lambda x, i: F.xxhash64(x, *[at(i + j) for j in range(S, inner, S)], at(i + inner))  # noqa: E731  substrings that cover all its tokens
    starts = F.slice("_g", 1, F.greatest(F.size("_g") - (K - 1), F.lit(0)))
    found = F.transform(starts, lambda x, i: F.when(closed(x, i), packed(kmer(x, i), i)).otherwise(F.lit(NONE)))
    short = F.when(F.size("_h") > 0, F.array(packed(F.xxhash64("_h"), F.lit(0)))).otherwise(F.array().cast("array<bigint>"))
    df = df.select(*keep, F.sort_array(F.when(F.size("_h") >= K, found).otherwise(short)).alias("_a"))
    before = lambda i: F.get(F.col("_a"), i - 1)
    first = F.filter("_a", lambda x, i: (x != NONE) & ((i == 0) | (x.bitwiseXOR(before(i)).bitwiseAND(F.lit(HEAD)) != 0)))
    return df.select(*keep, first.alias(out))


def fingerprint(anchors: str) -> Column:
    """The anchors as decimal numbers, joined by commas."""
    return F.array_join(F.col(anchors).cast("array<string>"), ",")


def with_likeness(df: DataFrame, a: str, b: str, out: str) -> DataFrame:
    keep = df.columns
    # a common anchor's two lie side by side once both lists are sorted together
    both = F.sort_array(F.concat(a, F.transform(b, lambda x: x.bitwiseOR(F.lit(SIDE)))))
    df = df.select(*keep, (F.size(a) + F.size(b)).alias("_n"), both.alias("_b"))
    place = lambda x: x.bitwiseAND(F.lit(PLACES))
    pair = lambda x, y: F.coalesce(F.when(x.bitwiseXOR(y).bitwiseAND(F.lit(HEAD)) == 0, F.shiftleft(place(x), PLACE_BITS + 1).bitwiseOR(place(y) - place(x) + F.lit(PLACES))), F.lit(NONE))
    # by place: how far each common anchor has moved
    df = df.select(*keep, "_n", F.sort_array(F.zip_with("_b", _all_after("_b", 2), pair)).alias("_p"))
    df = df.select(*keep, "_n", F.transform(F.filter("_p", lambda p: p != NONE), lambda p: p.bitwiseAND(F.lit(2 * PLACES + 1))).alias("_d"))
    df = df.select(*keep, "_n", "_d", F.coalesce(F.get(F.sort_array("_d"), (F.size("_d") / 2).cast("int")), F.lit(0)).alias("_m"))
    # the median is named twice: named once, it would be sorted out anew for each anchor
    mid = lambda d: (d <= F.col("_m") + DRIFT) & (d >= F.col("_m") - DRIFT)
    near = lambda d, other: F.coalesce(F.abs(d - other) <= DRIFT, F.lit(False))
    hits = F.size(F.filter("_d", lambda d, i: mid(d) | near(d, F.get(F.col("_d"), i - 1)) | near(d, F.get(F.col("_d"), i + 1))))
    return df.select(*keep, F.when(F.col("_n") == 0, 1.0).otherwise(2.0 * hits / F.col("_n")).alias(out))


def _ranged(rows: DataFrame) -> DataFrame:
    """rows (key, h) with b, sub: ranges that grow with (key, h); an id of more rows than a range is split by h."""
    n = rows.count()
    many = min(MOST_RANGES, n // RANGE_ROWS)
    if many < 2:
        return rows.withColumns({"b": F.lit(0), "sub": F.lit(0)})
    side = max(2, round(many**0.5))
    shares = [i / (side * side) for i in range(1, side * side)]
    every = [int(x) for x in rows.agg(F.percentile_approx("key", shares, max(10_000, 20 * side * side))).first()[0]]
    cuts = sorted(set(every))
    groups = [cuts[i : i + side] for i in range(0, len(cuts), side)]
    lits = lambda xs: F.array(*[F.lit(x).cast("long") for x in xs])
    upto = lambda array: F.size(F.filter(array, lambda x: x <= F.col("key")))
    coarse = upto(lits([g[0] for g in groups]))
    fine = upto(F.get(F.array(*[lits(g) for g in groups]), F.greatest(coarse - 1, F.lit(0))))
    out = rows.withColumn("b", (F.greatest(coarse - 1, F.lit(0)) * side + fine).cast("int"))
    hot = [(k, c + 1) for k, c in Counter(every).items() if c > 1]  # MOST_RANGES at most
    if not hot:
        return out.withColumn("sub", F.lit(0))
    table = rows.sparkSession.createDataFrame(hot, "hot long, parts int")
    part = F.floor((F.col("h") / 2.0**64 + 0.5) * F.col("parts")).cast("int")
    out = out.join(F.broadcast(table), F.col("key") == F.col("hot"), "left")
    last = F.lit(1 << 30)  # of other ids in the range, which come after
    return out.withColumn("sub", F.when(F.col("parts").isNull(), last).otherwise(F.least(F.greatest(part, F.lit(0)), F.col("parts") - 1))).drop("hot", "parts")


def edited_with_next(docs: DataFrame) -> DataFrame:
    """doc_id, text, anchors, next_text, next_anchors: each row beside the next by doc_id, the last beside the first.

    One shuffle, of texts: rows are dealt by range of ids and each range's first row is also sent to the range before.  Anchors, which grow
    with the texts, are found after it, once for each text.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOWEST)).alias("key"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"))
    own = _ranged(rows)
    heads = sorted((r["b"], r["sub"], r["head"]["key"], r["head"]["h"]) for r in own.groupBy("b", "sub").agg(F.min(F.struct("key", "h")).alias("head")).collect())  # twice MOST_RANGES at most
    before = [(key, h, *heads[i - 1][:2], int(i == 0)) for i, (_, _, key, h) in enumerate(heads)]
    ghosts = docs.sparkSession.createDataFrame(before, "gk long, gh long, gb int, gs int, gw int")
    both = own.join(F.broadcast(ghosts), (own["key"] == F.col("gk")) & (own["h"] == F.col("gh")), "left")
    stay = F.struct(F.col("b"), F.col("sub"), F.lit(0).alias("wrap"), F.lit(False).alias("ghost"))
    sent = F.struct(F.col("gb").alias("b"), F.col("gs").alias("sub"), F.col("gw").alias("wrap"), F.lit(True).alias("ghost"))
    dealt = both.select("doc_id", "key", "h", "text", F.explode(F.when(F.col("gk").isNull(), F.array(stay)).otherwise(F.array(stay, sent))).alias("to")).select("doc_id", "key", "h", "text", "to.*")
    dealt = anchored(dealt.repartition("b", "sub"), "text", "anchors")
    w = Window.partitionBy("b", "sub").orderBy("wrap", "key", "h", "ghost")
    paired = dealt.withColumns({"next_text": F.lead("text").over(w), "next_anchors": F.lead("anchors").over(w)})
    return paired.filter(~F.col("ghost")).select("doc_id", "text", "anchors", "next_text", "next_anchors")


def compared(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of the text with its last quarter replaced by the next document's start."""
    df = edited_with_next(docs)
    n = F.length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - quarter), F.substring(F.col("next_text"), F.lit(1), quarter))
    df = df.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "anchors", "next_anchors")
    df = anchored(df, "edited", "edited_anchors")
    df = with_likeness(df, "anchors", "edited_anchors", "near_edited")
    return with_likeness(df, "anchors", "next_anchors", "near_next")


def op10_syncmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compared(documents(spark, sf_dir)).select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), fingerprint("anchors").alias("fingerprint"), fingerprint("edited_anchors").alias("edited_fingerprint"), "near_edited", "near_next"
    )
