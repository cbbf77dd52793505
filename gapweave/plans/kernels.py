"""The kernels over the driver's tables, each beside its SQL.  They show that a kernel is right, not that source code is understood."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..operators import relational as rel

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def kernel(sql: str):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))
        ORACLES[f.__name__] = sql
        return f

    return add


@kernel("""WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
e AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS line FROM s)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(coalesce(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, t AS line_text FROM e""")
def p1_lines(t) -> DataFrame:
    return tx.lines(t("documents").select("doc_id", "text"), "doc_id", "text")


@kernel("""SELECT doc_id, CAST(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS BIGINT) AS units FROM documents""")
def c2_utf16_length(t) -> DataFrame:
    return t("documents").select("doc_id", tx.utf16_length("text").alias("units"))


@kernel("""WITH w AS (SELECT user_id, event_id AS a, value AS va, lead(event_id) OVER p AS b, lead(value) OVER p AS vb FROM events WINDOW p AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, a, b, vb - va AS step FROM w WHERE b IS NOT NULL""")
def g0_adjacent(t) -> DataFrame:
    pairs = rel.adjacent(t("events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"])
    return pairs.select("user_id", F.col("prev.event_id").alias("a"), F.col("next.event_id").alias("b"), (F.col("next.value") - F.col("prev.value")).alias("step"))


@kernel("""WITH w AS (SELECT user_id, event_id, value v, event_type f, lead(value) OVER p AS nv, lead(event_type) OVER p AS nf, lead(event_id) OVER p AS ne FROM events WINDOW p AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, CASE WHEN v < 5 AND nv < 5 THEN 'both-small' WHEN f = nf THEN 'same-type' WHEN nv > v THEN 'rises' ELSE 'keep' END AS rule,
concat_ws(',', CASE WHEN v < 5 AND nv < 5 AND f = nf THEN 'same-type' END, CASE WHEN ((v < 5 AND nv < 5) OR f = nf) AND nv > v THEN 'rises' END) AS outranked FROM w WHERE ne IS NOT NULL""")
def g1_ladder(t) -> DataFrame:
    pairs = rel.adjacent(t("events").select("user_id", "event_id", "value", "event_type"), ["user_id"], ["event_id"])
    p, n = (lambda c: F.col(f"prev.{c}")), (lambda c: F.col(f"next.{c}"))
    rule, outranked = rel.ladder([("both-small", (p("value") < 5) & (n("value") < 5)), ("same-type", p("event_type") == n("event_type")), ("rises", n("value") > p("value"))])
    return pairs.select("user_id", p("event_id").alias("event_id"), rule.alias("rule"), F.array_join(outranked, ",").alias("outranked"))


@kernel("""WITH w AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS pt FROM events),
r AS (SELECT *, sum(CASE WHEN pt = event_type THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM w)
SELECT user_id, min(event_id) AS event_id, count(*) AS size FROM r GROUP BY user_id, run HAVING count(*) >= 2""")
def g3_runs(t) -> DataFrame:
    from pyspark.sql import Window

    e = t("events").select("user_id", "event_id", "event_type")
    e = e.withColumn("p", F.lag("event_type").over(Window.partitionBy("user_id").orderBy("event_id")))
    return rel.runs(e, ["user_id"], ["event_id"], F.col("p") != F.col("event_type"), 2)


@kernel("""SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity BETWEEN 10 AND 12)""")
def j3_range_semi(t) -> DataFrame:
    spans = t("orders").select(F.col("o_orderkey").alias("k"), F.lit(10).alias("a"), F.lit(12).alias("b"))
    points = t("lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_quantity").alias("x"))
    return rel.touched(spans, points, "k", "a", "b", "x").select(F.col("k").alias("o_orderkey"))




@kernel("SELECT conv_id, role, min(turn) AS first, arg_max(text, turn) AS text FROM conversations GROUP BY conv_id, role")
def j4_last_wins(t) -> DataFrame:
    return rel.last_wins(t("conversations"), ["conv_id", "role"], "turn", "text")


@kernel("""WITH p AS (SELECT DISTINCT url FROM pages), s AS (SELECT url, string_split(url, '/') AS x FROM p),
e AS (SELECT url, n AS depth, array_to_string(list_slice(x, 1, n), '/') AS dir FROM (SELECT url, x, unnest(range(1, greatest(len(x) - 1, 1) + 1)) AS n FROM s)),
h AS (SELECT DISTINCT array_to_string(list_slice(string_split(url, '/'), 1, 3), '/') AS dir FROM pages WHERE page_id % 2 = 0)
SELECT url, arg_max(dir, depth) AS dir FROM e JOIN h USING (dir) GROUP BY url""")
def j8_nearest_ancestor(t) -> DataFrame:
    holders = t("pages").filter("page_id % 2 = 0").select(F.array_join(F.slice(F.split("url", "/", -1), 1, 3), "/").alias("dir"))
    return rel.nearest_ancestor(t("pages").select("url").distinct(), holders, "url", "dir")


@kernel("""SELECT user_id, event_type FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY floor(value / 10) DESC, event_id DESC) AS r FROM events) WHERE r = 1""")
def a10_fold(t) -> DataFrame:
    layers = t("events").select("user_id", "event_type", "event_id", F.floor(F.col("value") / 10).alias("rank"))
    return rel.fold(layers, ["user_id"], "event_type", "rank", "event_id")


@kernel("SELECT user_id, string_agg(event_type, ',' ORDER BY o) AS types FROM (SELECT user_id, event_type, min(event_id) AS o FROM events GROUP BY 1, 2) GROUP BY user_id")
def a6_distinct_in_order(t) -> DataFrame:
    return rel.distinct_in_order(t("events"), ["user_id"], "event_type", "event_id").select("user_id", F.array_join("values", ",").alias("types"))


@kernel("""WITH x AS (SELECT user_id, event_id AS s, event_id + 40 AS e FROM events), m AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
r AS (SELECT *, sum(CASE WHEN reach >= s THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS run FROM m)
SELECT user_id, min(s) AS s, max(e) AS e FROM r GROUP BY user_id, run""")
def g8_merged_regions(t) -> DataFrame:
    return rel.merged(t("events").select("user_id", F.col("event_id").alias("s"), (F.col("event_id") + 40).alias("e")), ["user_id"], "s", "e")


@kernel("""SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_quantity < 25 AND NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_quantity >= 25 AND b.l_orderkey = a.l_orderkey AND b.l_linenumber IN (a.l_linenumber, a.l_linenumber + 1))""")
def u4_away_from(t) -> DataFrame:
    rows = t("lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return rel.away_from(rows.filter("l_quantity < 25"), rows.filter("l_quantity >= 25"), "l_orderkey", "l_linenumber").select("l_orderkey", "l_linenumber")


@kernel("""WITH e AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS f FROM lineitem GROUP BY 1)
SELECT CAST(sum(n) AS BIGINT) AS findings, CAST(sum(f) AS BIGINT) AS fixable, count(*) AS files, CAST(sum(CASE WHEN n > f THEN 1 ELSE 0 END) AS BIGINT) AS by_hand_files, CASE WHEN count(*) > 0 THEN 1 ELSE 0 END AS status FROM e""")
def a1_tally(t) -> DataFrame:
    return rel.tally(t("lineitem"), "l_orderkey", F.col("l_returnflag") == "R")


@kernel("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY 1, 2, 3 LIMIT 12")
def o2_first_twelve(t) -> DataFrame:
    return rel.first_rows(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey", "l_linenumber", "l_partkey"])


@kernel("SELECT c_custkey, CAST(max(length(c_name)) OVER (PARTITION BY c_nationkey) AS INTEGER) AS width, rpad(c_name, CAST(max(length(c_name)) OVER (PARTITION BY c_nationkey) AS INTEGER), ' ') AS c_name FROM customer")
def k3_padded(t) -> DataFrame:
    return rel.padded(t("customer").select("c_custkey", "c_nationkey", "c_name"), "c_nationkey", "c_name").select("c_custkey", "width", "c_name")
