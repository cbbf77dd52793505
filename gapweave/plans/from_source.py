"""The whole way from source text, and the spacing rules, over the driver's tables: each order becomes a generated source file.

A line item is a guard (quantity above 25) or a call; some have a blank line above.  The SQL reasons from the table alone, without text.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.once import stored
from ..operators import reporting, spacing
from . import analysis
from .kernels import kernel

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount"]
STATEMENTS = """WITH s AS (SELECT l_orderkey k, row_number() OVER w r, l_quantity > 25 g, l_discount < 0.03 AND row_number() OVER w > 1 b FROM lineitem
WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount)),
t AS (SELECT *, r + sum(b::int) OVER (PARTITION BY k ORDER BY r) AS line, coalesce(lag(g) OVER (PARTITION BY k ORDER BY r), false) AS pg FROM s),
u AS (SELECT *, pg AND g AS chain, pg AND NOT g AS step FROM t)"""


#: Orders, of those whose rows tie, that are broadcast at most.
MOST_TIED = 100_000


def packed(items: DataFrame) -> DataFrame:
    """l_orderkey, rows: a long for each line item, sorted by l_linenumber and l_partkey, whose last bits say whether it is a guard and has a blank line above; -1 where that doesn't fit."""
    line, part = F.col("l_linenumber"), F.col("l_partkey")
    bit = lambda c: F.coalesce(c, F.lit(False)).cast("long")
    row = F.shiftleft(line.cast("long"), 59) + F.shiftleft(part.cast("long"), 2) + 2 * bit(F.col("l_quantity") > 25) + bit(F.col("l_discount") < 0.03)
    fits = line.between(0, 15) & part.between(0, (1 << 57) - 1)
    dealt = items.select("l_orderkey", F.when(fits, row).otherwise(F.lit(-1).cast("long")).alias("row")).repartition("l_orderkey")  # two longs a row; arrays of few would be more
    return dealt.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("row")).alias("rows"))


def sources(t) -> DataFrame:
    """path, text of a file for each order.

    A line item is sent as a single long (packed), so the shuffle is a fraction of that of all columns of ORDER.  Orders where that leaves open which of two
    different statements comes first, or where a row doesn't fit, are read again with all of ORDER.
    """
    items = t("lineitem")
    text = lambda rows, guard, blank: F.array_join(F.transform(rows, lambda x, i: F.concat(F.when(blank(x) & (i > 0), "\n").otherwise(""), F.when(guard(x), "if (x) return;").otherwise("step();"))), "\n")
    tied = (F.get("rows", F.lit(0)) < 0) | (F.size(F.array_distinct("rows")) > F.size(F.array_distinct(F.transform("rows", lambda x: F.shiftright(x, 2)))))
    every = stored(packed(items).select("l_orderkey", tied.alias("tied"), text("rows", lambda x: x.bitwiseAND(2) > 0, lambda x: x.bitwiseAND(1) > 0).alias("text")))
    again = every.filter("tied").select(F.col("l_orderkey").alias("k"))
    n = again.count()
    if n:
        mine = items.join(F.broadcast(again) if n <= MOST_TIED else again.hint("merge"), F.col("l_orderkey").eqNullSafe(F.col("k")), "left_semi")
        rows = mine.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(*ORDER))).alias("rows"))
        full = rows.select("l_orderkey", text("rows", lambda x: x["l_quantity"] > 25, lambda x: x["l_discount"] < 0.03).alias("text"))
        every = every.filter("not tied").select("l_orderkey", "text").unionByName(full)
    return every.select(F.format_string("o%d.ts", "l_orderkey").alias("path"), "text")


@kernel(STATEMENTS + """, v AS (SELECT *, sum((NOT chain)::int) OVER (PARTITION BY k ORDER BY r) AS held FROM u),
w AS (SELECT *, count(*) OVER (PARTITION BY k, held) < 6 AS use FROM v),
x AS (SELECT *, (NOT use OR r = 1 OR step OR (b AND NOT chain) OR NOT coalesce(lag(use) OVER (PARTITION BY k ORDER BY r), false)) AS starts FROM w),
y AS (SELECT *, sum(starts::int) OVER (PARTITION BY k ORDER BY r) AS run FROM x),
z AS (SELECT k, min(line) AS line, count(*) AS n FROM y WHERE use GROUP BY k, run HAVING count(*) >= 6),
f AS (SELECT k, line, 'guard-chain' AS rule, 'remove the blank line between these compact guards' AS message, true AS fixable FROM u WHERE chain AND b
UNION ALL SELECT k, line, 'after-guard', 'add a blank line after the guard above, a new step starts here', true FROM u WHERE step AND NOT b
UNION ALL SELECT k, line, 'wall', 'split these ' || n || ' statements into steps with a blank line', false FROM z)
SELECT 'o' || k || '.ts' AS path, CAST(line AS INTEGER) AS line, CAST(1 AS INTEGER) AS col, rule, message, fixable FROM f""")
def e1_findings(t) -> DataFrame:
    return analysis.findings(sources(t))


@kernel(STATEMENTS + """ SELECT 'o' || k || '.ts' AS path, string_agg(CASE WHEN step OR (b AND NOT chain) THEN chr(10) ELSE '' END || CASE WHEN g THEN 'if (x) return;' ELSE 'step();' END, chr(10) ORDER BY r) AS text FROM u GROUP BY k""")
def e1_fixed(t) -> DataFrame:
    return analysis.fixed(sources(t))


@kernel("""WITH w AS (SELECT user_id, event_id, event_type, value, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events),
r AS (SELECT *, sum(CASE WHEN p IS NULL OR value > 15 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM w)
SELECT user_id, min(event_id) AS event_id, count(*) AS size FROM r GROUP BY user_id, run HAVING count(*) >= 6""")
def g3_walls(t) -> DataFrame:
    s = t("events").select(F.col("user_id").alias("path"), F.lit(0).alias("list_id"), F.col("event_id").alias("idx"), F.lit("Block").alias("list_kind"), F.lit(True).alias("counted"), F.lit(False).alias("forced"), (F.col("value") > 15).alias("parted"))
    return spacing.walls(s).select(F.col("path").alias("user_id"), F.col("idx").alias("event_id"), "size")


@kernel("""SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber >= 2 AND CASE WHEN l.l_returnflag = 'N' THEN l.l_linenumber <= 4 ELSE l.l_linenumber < 4 END)""")
def f10_in_scope(t) -> DataFrame:
    found = t("orders").select(F.col("o_orderkey").alias("path"), F.lit(2).alias("a"), F.lit(4).alias("b"))
    changed = t("lineitem").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "N", "line").otherwise("deleted_after").alias("kind"))
    return spacing.in_scope(found, changed, "a", "b").select(F.col("path").alias("o_orderkey"))


@kernel("""SELECT c_custkey, CASE WHEN p <> '' THEN p END AS path, try_cast(nullif(a, '') AS INTEGER) AS line, try_cast(nullif(b, '') AS INTEGER) AS col FROM
(SELECT c_custkey, regexp_extract(x, f, 1) AS p, regexp_extract(x, f, 2) AS a, regexp_extract(x, f, 3) AS b FROM (SELECT c_custkey, c_mktsegment || ':' || c_nationkey || CASE WHEN c_custkey % 2 = 0 THEN ':' || c_custkey ELSE '' END AS x, '^(.+?):([1-9][0-9]*)(?::([1-9][0-9]*))?$' AS f FROM customer))""")
def c8_location(t) -> DataFrame:
    x = F.concat("c_mktsegment", F.lit(":"), "c_nationkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(":"), F.col("c_custkey"))).otherwise(""))
    return t("customer").withColumn("x", x).select("c_custkey", reporting.location("x").alias("l")).select("c_custkey", "l.path", "l.line", "l.col")
