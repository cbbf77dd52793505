"""Settings and searches over tables made of the driver's, each beside its SQL."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import catalog, patterns
from ..operators import config as cfg
from ..sources import selection
from .kernels import kernel


@kernel("""WITH l AS (SELECT l_orderkey AS k, l_linenumber * 1000000 + l_partkey AS ord, CASE l_returnflag WHEN 'R' THEN 'on' WHEN 'A' THEN 'off' ELSE 'unknown' END AS setting,
CASE WHEN l_tax < 0.03 THEN 'all' WHEN l_tax < 0.06 THEN 'some' ELSE 'none' END AS reach, CAST(l_quantity AS INTEGER) % 4 AS rank, l_discount > 0.05 AS overriding FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY rank DESC, overriding DESC, ord DESC) AS n FROM l WHERE reach = 'all' OR (reach = 'some' AND setting <> 'off'))
SELECT k, setting FROM r WHERE n = 1""")
def a10_reaching_layers(t) -> DataFrame:
    setting = F.when(F.col("l_returnflag") == "R", "on").when(F.col("l_returnflag") == "A", "off").otherwise("unknown")
    reach = F.when(F.col("l_tax") < 0.03, "all").when(F.col("l_tax") < 0.06, "some").otherwise("none")
    layers = t("lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("ord"), setting.alias("setting"), reach.alias("reach"), (F.col("l_quantity").cast("int") % 4).alias("rank"), (F.col("l_discount") > 0.05).alias("overriding"))
    return cfg.folded(layers, ["k"])


@kernel("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) SELECT user_id, event_type, event_id FROM r WHERE n = 1""")
def a12_last_layers(t) -> DataFrame:
    return cfg.last_layers(t("events").select("user_id", "event_type", "event_id", F.col("event_id").alias("ord")), ["user_id"], "event_type").select("user_id", "event_type", "event_id")


FAMILIES = ("flat", "legacy", "biome", "oxlint")
FOUND = f"""WITH f AS (SELECT l_orderkey AS k, list_extract({list(FAMILIES)}, 1 + CAST(l_suppkey % 4 AS INTEGER)) AS family, l_linenumber AS depth, 'c' || l_partkey || '-' || l_suppkey || '-' || CAST(l_extendedprice * 100 AS BIGINT) AS file,
CASE WHEN l_quantity < 15 THEN NULL WHEN l_returnflag = 'R' THEN 'on' WHEN l_returnflag = 'A' THEN 'unknown' ELSE 'off' END AS setting, CASE WHEN l_tax < 0.03 THEN true WHEN l_tax < 0.06 THEN false END AS root FROM lineitem),
near AS (SELECT DISTINCT ON (k, family) * FROM f WHERE setting IS NOT NULL ORDER BY k, family, depth, file), strict AS (SELECT DISTINCT ON (k, family) * FROM f WHERE setting IN ('on', 'unknown') ORDER BY k, family, depth, file),
stop AS (SELECT DISTINCT ON (k, family) * FROM f WHERE setting IS NOT NULL OR root ORDER BY k, family, depth, file), low AS (SELECT k, family, min(depth) AS depth FROM f GROUP BY 1, 2),
here AS (SELECT k, family, count(*) AS n, list_sort(list(file)) AS files, arg_min(setting, file) AS s FROM (SELECT f.*, file || '' AS g FROM f JOIN low USING (k, family, depth)) GROUP BY 1, 2),
d AS (SELECT k, family, CASE WHEN n > 1 THEN 'unknown' ELSE (SELECT setting FROM f WHERE f.k = here.k AND f.family = here.family AND f.file = here.files[1] LIMIT 1) END AS setting, CASE WHEN n > 1 THEN files ELSE [files[1]] END AS files FROM here WHERE family = 'oxlint'
UNION ALL SELECT k, family, setting, [file] FROM stop WHERE family = 'legacy'
UNION ALL SELECT near.k, near.family, CASE WHEN near.family = 'biome' AND near.root = false THEN near.setting ELSE coalesce(strict.setting, near.setting) END, [CASE WHEN near.family = 'biome' AND near.root = false THEN near.file ELSE coalesce(strict.file, near.file) END]
FROM near LEFT JOIN strict ON near.k = strict.k AND near.family = strict.family WHERE near.family IN ('flat', 'biome')),
e AS (SELECT * FROM d WHERE setting IS NOT NULL)"""


def found(t) -> DataFrame:
    family = F.get(F.array(*[F.lit(x) for x in FAMILIES]), (F.col("l_suppkey") % 4).cast("int"))
    setting = F.when(F.col("l_quantity") >= 15, F.when(F.col("l_returnflag") == "R", "on").when(F.col("l_returnflag") == "A", "unknown").otherwise("off"))
    root = F.when(F.col("l_tax") < 0.03, True).when(F.col("l_tax") < 0.06, False)
    file = F.concat(F.lit("c"), F.concat_ws("-", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long")))
    return t("lineitem").select(F.col("l_orderkey").alias("path"), family.alias("family"), F.col("l_linenumber").alias("depth"), file.alias("file"), setting.alias("setting"), root.alias("root"))


@kernel(FOUND + " SELECT k, family, setting, array_to_string(files, ',') AS files FROM e")
def a13_decided(t) -> DataFrame:
    return cfg.decided(found(t)).select(F.col("path").alias("k"), "family", "setting", F.array_join("files", ",").alias("files"))


@kernel(FOUND + """ SELECT k, bool_or(setting <> 'off') AS enforced, CASE WHEN bool_or(setting = 'on') THEN '' ELSE coalesce(array_to_string(list_sort(list_distinct(flatten(list(files) FILTER (setting = 'unknown')))), ','), '') END AS unread FROM e GROUP BY k""")
def a9_braces(t) -> DataFrame:
    return cfg.braces(cfg.decided(found(t))).select(F.col("path").alias("k"), "enforced", F.array_join("unread", ",").alias("unread"))


@kernel("""WITH f AS (SELECT p_partkey, p_brand || '/' || p_type || '/' || p_name || '.ts' AS path, p_brand AS b, p_brand || '/' || p_type AS bt FROM part),
c AS (SELECT p_brand AS dir, min(p_size) AS columns, 'prettier' AS formatter FROM part WHERE p_size > 10 GROUP BY 1 UNION ALL SELECT p_brand || '/' || p_type, min(40 + p_size), 'biome' FROM part WHERE p_retailprice > 1400 GROUP BY 1
UNION ALL SELECT p_brand || '/' || p_type, max(40 + p_size), 'oxfmt' FROM part WHERE p_retailprice > 1600 GROUP BY 1),
n AS (SELECT f.path, c.*, row_number() OVER (PARTITION BY f.path ORDER BY length(c.dir) DESC, c.columns, c.formatter) AS n FROM f JOIN c ON c.dir IN (f.b, f.bt))
SELECT DISTINCT f.path, CAST(coalesce(columns, 80) AS INTEGER) AS columns, formatter FROM f LEFT JOIN (SELECT * FROM n WHERE n = 1) m USING (path)""")
def r4_widths(t) -> DataFrame:
    """The nearest folder's configuration, the smallest of several there."""
    part = t("part")
    files = part.select(F.concat_ws("/", "p_brand", "p_type", F.concat("p_name", F.lit(".ts"))).alias("path")).distinct()
    low = part.filter("p_size > 10").groupBy(F.col("p_brand").alias("dir")).agg(F.min("p_size").alias("columns")).withColumn("formatter", F.lit("prettier"))
    folder = F.concat_ws("/", "p_brand", "p_type")
    mid = part.filter("p_retailprice > 1400").groupBy(folder.alias("dir")).agg(F.min(40 + F.col("p_size")).alias("columns")).withColumn("formatter", F.lit("biome"))
    high = part.filter("p_retailprice > 1600").groupBy(folder.alias("dir")).agg(F.max(40 + F.col("p_size")).alias("columns")).withColumn("formatter", F.lit("oxfmt"))
    rows = low.unionByName(mid).unionByName(high)
    settings = rows.select("dir", F.concat_ws("/", "dir", "formatter").alias("file"), "formatter", F.lit(0).alias("ord"), F.lit(None).cast("string").alias("pattern"), F.col("columns").cast("double").alias("columns"), F.lit(None).cast("double").alias("tab"), F.lit(True).alias("editorconfig"), F.lit(False).alias("unread"))
    return cfg.widths(files, settings).select("path", "columns", "formatter")


@kernel("""WITH w AS (SELECT unnest(['the', 'he', 'tion', 'th', 'thing', 'er the ']) AS p), s AS (SELECT doc_id, p, string_split(text, p) AS parts FROM documents, w),
e AS (SELECT doc_id, p, unnest(parts) AS part, generate_subscripts(parts, 1) AS k, len(parts) AS n FROM s)
SELECT doc_id, p AS pattern, CAST(sum(length(part)) OVER (PARTITION BY doc_id, p ORDER BY k) + (k - 1) * length(p) + 1 AS INTEGER) AS start FROM e QUALIFY k < n""")
def c5_occurrences(t) -> DataFrame:
    return patterns.occurrences(t("documents"), "doc_id", "text", ["the", "he", "tion", "th", "thing", "er the "])


@kernel("SELECT rule, fixable, gap FROM (VALUES " + ", ".join(f"('{r}', {str(f).lower()}, {'NULL' if g is None else repr(g)})" for r, f, g, _ in catalog.RULES) + ") v(rule, fixable, gap)")
def k8_catalog(t) -> DataFrame:
    return catalog.catalog(t("region").sparkSession).select("rule", "fixable", "gap")


@kernel("""SELECT DISTINCT l.l_orderkey || '' AS path, NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = l.l_orderkey) AS hunked FROM lineitem l JOIN (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_quantity > 45) q USING (l_orderkey) WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l.l_orderkey AND o_orderstatus <> 'F')
UNION SELECT user_id || '', false FROM events WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = user_id AND o_orderstatus <> 'F')""")
def j1_changed_files(t) -> DataFrame:
    """Changed names without untracked ones, both once, and only what was written."""
    name = lambda c: F.col(c).cast("string").alias("path")
    diff, new = t("lineitem").filter("l_quantity > 45").select(name("l_orderkey")), t("events").select(name("user_id"))
    return selection.changed_files(diff, new, t("orders").filter("o_orderstatus <> 'F'").select(name("o_orderkey")))


@kernel("""WITH r AS (SELECT page_id, url, '/' || regexp_replace(url, '^https?://', '') AS path FROM pages) SELECT page_id, path = '/a' OR starts_with(path, '/' || regexp_extract(url, '^https?://([^/]*)', 1) || '/') OR path = '/' || regexp_extract(url, '^https?://([^/]*)', 1) AS inside FROM r""")
def f9_within(t) -> DataFrame:
    path = F.concat(F.lit("/"), F.regexp_replace("url", "^https?://", ""))
    root = F.concat(F.lit("/"), F.regexp_extract("url", "^https?://([^/]*)", 1))
    return t("pages").select("page_id", selection.within(root, path).alias("inside"))
