"""Feed parsers over feeds that Spark derives from the tables: each must give back what went in."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import scalars as C
from tidemark.plans.catalog import query
from tidemark.sources import feeds as S
from tidemark.sources import views as V

E = f"WITH {V.EVENT_SQL}"


_CLEAN = """trim(regexp_replace(replace(replace(replace(replace(replace(replace(replace(regexp_replace(title, '<[^>]*>', ' ', 'g'),
  '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&apos;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g'))"""


@query("s2_rss", f"""WITH {V.DOC_SQL}, c AS (SELECT doc_id, {_CLEAN} AS title FROM v_doc)
  SELECT doc_id, title, 'http://x/' || CAST(doc_id AS VARCHAR) AS link, CASE doc_id % 3 WHEN 0 THEN '2024-01-01' WHEN 1 THEN '2024-01-02' END AS published
  FROM c WHERE length(title) > 3""")
def rss(spark, d):
    docs = V.documents(spark, d)
    title, link = F.col("title"), F.concat(F.lit("http://x/"), F.col("doc_id").cast("string"))
    escaped = F.replace(F.replace(F.replace(title, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    # three kinds of feed; each file ends in an item that was cut off
    rss = F.concat(F.lit("<rss><item><title><![CDATA["), title, F.lit("]]></title><link> "), link, F.lit(" </link><pubDate>Mon, 01 Jan 2024 00:00:00 +0000</pubDate></item><item><title>cut off"))
    rdf = F.concat(F.lit('<RDF><ITEM about="x"><TITLE>'), escaped, F.lit("</TITLE><Link>"), link, F.lit("</Link><dc:date>2024-01-02T00:00:00Z</dc:date></ITEM><item><title>torn</b></title></item>"))
    atom = F.concat(F.lit('<feed><entry xml:lang="x"><link rel="self" href="no"/><link rel="alternate" href="'), link, F.lit('"/><title type="html">'), escaped, F.lit("</title></entry><entry>"))
    kind = F.col("doc_id") % 3
    feed = F.when(kind == 0, rss).when(kind == 1, rdf).otherwise(atom)
    out = S.rss_items(docs.select("doc_id", feed.alias("value")))
    return out.select("doc_id", "title", "link", F.to_date("published").cast("string").alias("published"))


@query("s3_quakes", f"""{E} SELECT md5('usgs:' || CAST(id AS VARCHAR)) AS id, country AS title, round(least(10, greatest(4.5, severity)), 6) AS severity FROM v_event WHERE severity >= 4.5""")
def quakes(spark, d):
    e = V.events(spark, d)
    feature = F.struct(
        F.col("id").cast("string").alias("id"),
        F.struct(F.col("severity").alias("mag"), F.col("country").alias("place"), F.unix_millis(F.col("ts").cast("timestamp")).alias("time")).alias("properties"),
        F.struct(F.array(F.lit(1.5), F.lit(2.5)).alias("coordinates")).alias("geometry"),
    )
    raw = e.select(F.to_json(F.struct(F.array(feature).alias("features"))).alias("value"))
    return S.quakes(raw).select("id", "title", F.round("severity", 6).alias("severity"))


@query("s5_articles", f"""{E} SELECT md5('u' || CAST(id AS VARCHAR)) AS id, 'article on ' || country AS title, round(least(1.0, greatest(-1.0, (severity - 5) * 6 / 20)), 6) AS sentiment FROM v_event""")
def articles(spark, d):
    e = V.events(spark, d)
    a = F.struct(
        F.concat(F.lit("u"), F.col("id").cast("string")).alias("url"), F.concat(F.lit("article on "), "country").alias("title"), F.lit("20240101T000000Z").alias("seendate"),
        F.concat(((F.col("severity") - 5) * 6).cast("string"), F.lit(",1,2")).alias("tone"),
    )
    raw = e.select(F.to_json(F.struct(F.array(a).alias("articles"))).alias("value"))
    return S.articles(raw).select("id", "title", F.round("sentiment", 6).alias("sentiment"))


@query("s8_observations", """WITH o AS (SELECT p_brand AS series, l_orderkey AS day, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_tax END AS v FROM lineitem JOIN part ON l_partkey = p_partkey),
  g AS (SELECT series, day, max(v) AS v FROM o GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS p FROM g WHERE v IS NOT NULL)
  SELECT series, max(v) FILTER (p = 1) AS value, max(v) FILTER (p = 2) AS previous FROM r WHERE p <= 2 GROUP BY series""")
def observations(spark, d):
    li = V.table(spark, d, "lineitem").join(V.table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    v = F.when(F.col("l_linenumber") != 1, F.col("l_tax"))
    rows = li.groupBy(F.col("p_brand").alias("series"), F.col("l_orderkey").alias("day")).agg(F.max(v).alias("v"))
    return S.latest_observations(rows.select("series", "day", F.coalesce(F.col("v").cast("string"), F.lit(".")).alias("value")))


@query("s14_filings", """SELECT cik, form, filed, accession, place FROM (SELECT o_custkey AS cik, '13F-HR' AS form, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS filed, CAST(o_orderkey AS VARCHAR) AS accession,
  row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE) DESC, CAST(o_orderkey AS VARCHAR)) AS place FROM orders WHERE o_orderstatus = 'F') WHERE place <= 4""")
def filings(spark, d):
    o = V.table(spark, d, "orders").select("o_custkey", F.when(F.col("o_orderstatus") == "F", "13F-HR").otherwise("10-K").alias("form"), F.to_date("o_orderdate").cast("string").alias("filed"), F.col("o_orderkey").cast("string").alias("accession"))
    packed = o.groupBy(F.col("o_custkey").alias("cik")).agg(F.collect_list(F.struct("form", "filed", "accession")).alias("x"))
    raw = packed.select("cik", F.to_json(F.struct(F.col("x.form").alias("form"), F.col("x.filed").alias("filed"), F.col("x.accession").alias("accession"))).alias("value"))
    return S.filings(raw)


@query("s17_node_blocks", """SELECT n_name AS src, r_name AS tgt, 'part of' AS relation, least(3.0, n_nationkey / 4) AS weight FROM nation JOIN region ON n_regionkey = r_regionkey""")
def node_blocks(spark, d):
    n = V.table(spark, d, "nation").join(V.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    text = F.concat(
        F.lit("# NODE: "), "n_name", F.lit("\ntype: country\n# EDGE: "), "n_name", F.lit(" -> "), "r_name", F.lit("\nrelation: part of\nweight: "), (F.col("n_nationkey") / 4).cast("string"), F.lit("\n")
    )
    return S.node_blocks(n.select(text.alias("value")))[1]


@query("sf11_edge_weight", f"""{E} SELECT id, round(greatest(0, least(1, (0.35 * severity / 10 + 0.2 * 0.5 + 0.25 * ln(1 + (id % 7)) / ln(11) + 0.2 * 0.3) * exp(-0.05 * (id % 30)) * 0.9)), 4) AS weight FROM v_event""")
def edge_weight(spark, d):
    e = V.events(spark, d)
    w = C.edge_weight(F.col("severity"), F.lit(-0.5), F.col("id") % 7, F.lit(0.3), F.col("id") % 30, F.lit(0.9))
    return e.select("id", w.alias("weight"))


@query("sf18_signed_assets", """WITH s AS (SELECT p_partkey, unnest(string_split(p_brand || '+,' || p_type || '-', ',')) AS x FROM part) SELECT p_partkey, left(x, length(x) - 1) AS asset, CASE WHEN right(x, 1) = '-' THEN -1 ELSE 1 END AS sign FROM s""")
def signed_assets(spark, d):
    p = V.table(spark, d, "part")
    x = F.explode(C.signed_assets(F.concat("p_brand", F.lit("+,"), "p_type", F.lit("-"))))
    return p.select("p_partkey", x.alias("x")).select("p_partkey", "x.asset", "x.sign")
