"""Landed feed files as tables of text: parsers from one raw column to typed rows, all in built-in functions.

Each takes a DataFrame with the raw text in a column (one file or one record a
row, as spark.read.text gives it) and explodes its items; malformed records give
no rows or nulls, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import clamp, clean_html, first_time


#: The fields of an item; XML names count in any case and without their prefix, so dc:date is date.
ITEM = """title string, description string, summary string, content string, encoded string, pubDate string, published string, updated string,
date string, link array<struct<_VALUE:string,_href:string,_rel:string>>"""


def rss_items(files: DataFrame, raw: str = "value") -> DataFrame:
    """Items of RSS and Atom feeds: title (over three characters), summary, link, published.

    A file is cut where items open and close, and each item is read as XML by
    itself, so that a broken item loses only itself: it gives nulls, and no row
    without a title. An ampersand that starts no XML entity is taken as text.
    Of several links the first with a text counts, else the first that is not
    rel="self", else the first.
    """
    keep = [c for c in files.columns if c != raw]
    plain = F.regexp_replace(raw, r"&(?!(?:amp|lt|gt|quot|apos|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")
    opened = F.filter(F.split(plain, r"(?i)<(?=(?:item|entry)[\s>])"), lambda t, i: i > 0)
    parts = F.filter(F.transform(opened, lambda t: F.split(t, r"(?i)</(?:item|entry)\s*>", 2)), lambda t: F.size(t) == 2)
    item = F.transform(parts, lambda t: F.concat(F.lit("<"), F.regexp_replace(t[0], r"^[A-Za-z]+", "item"), F.lit("</item>")))
    x = files.select(*keep, F.explode(item).alias("__x")).select(*keep, F.from_xml("__x", ITEM, {"ignoreNamespace": "true"}).alias("x"))
    link = F.col("x.link")
    texts = F.filter(F.transform(link, lambda v: F.trim(v["_VALUE"])), lambda t: F.length(t) > 0)
    others = F.filter(link, lambda v: ~F.coalesce(v["_rel"] == "self", F.lit(False)))
    df = x.select(
        *keep,
        clean_html(F.col("x.title")).alias("title"),
        clean_html(F.coalesce("x.description", "x.summary", "x.content", "x.encoded")).alias("summary"),
        F.coalesce(F.get(texts, 0), F.get(others, 0)["_href"], F.get(link, 0)["_href"]).alias("link"),
        first_time(F.coalesce("x.pubDate", "x.published", "x.updated", "x.date")).alias("published"),
    )
    return df.where(F.length("title") > 3)


QUAKES = """struct<features:array<struct<id:string,properties:struct<mag:double,place:string,time:bigint,url:string>,
geometry:struct<coordinates:array<double>>>>>"""


def quakes(files: DataFrame, raw: str = "value", least: float = 4.5) -> DataFrame:
    """Earthquake features of at least a magnitude: id (md5), ts, title, severity, lat, lon."""
    f = files.select(F.explode(F.from_json(F.col(raw), QUAKES)["features"]).alias("f"))
    mag = F.col("f.properties.mag")
    return f.where(mag >= least).select(
        F.md5(F.concat(F.lit("usgs:"), "f.id")).alias("id"),
        F.timestamp_millis("f.properties.time").alias("ts"),
        F.col("f.properties.place").alias("title"),
        clamp(mag, least, 10.0).alias("severity"),
        F.try_element_at("f.geometry.coordinates", F.lit(2)).alias("lat"),
        F.try_element_at("f.geometry.coordinates", F.lit(1)).alias("lon"),
    )


NATURAL = "struct<events:array<struct<id:string,title:string,categories:array<struct<id:string>>,geometry:array<struct<date:string,coordinates:string>>>>>"


def natural_events(files: DataFrame, severities: dict[str, float], raw: str = "value", default: float = 6.0) -> DataFrame:
    """Natural events with the newest geometry (a point, or a polygon's first vertex) and the category's severity."""
    e = files.select(F.explode(F.from_json(F.col(raw), NATURAL)["events"]).alias("e"))
    last = F.try_element_at("e.geometry", F.lit(-1))
    numbers = F.regexp_extract_all(last["coordinates"], F.lit(r"-?[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    category = F.try_element_at("e.categories", F.lit(1))["id"]
    known = F.create_map(*[F.lit(x) for kv in severities.items() for x in kv])
    return e.select(
        F.col("e.id").alias("id"), F.col("e.title").alias("title"), category.alias("category"), first_time(last["date"]).alias("ts"),
        F.try_element_at(numbers, F.lit(2)).cast("double").alias("lat"), F.try_element_at(numbers, F.lit(1)).cast("double").alias("lon"),
        F.coalesce(F.try_element_at(known, category), F.lit(default)).alias("severity"),
    )


ARTICLES = "struct<articles:array<struct<url:string,title:string,seendate:string,tone:string,domain:string>>>"


def articles(files: DataFrame, raw: str = "value", least_title: int = 8) -> DataFrame:
    """Article lists: sentiment is the first field of tone over twenty, held within one."""
    a = files.select(F.explode(F.from_json(F.col(raw), ARTICLES)["articles"]).alias("a"))
    tone = F.split("a.tone", ",")[0].try_cast("double")
    return a.where(F.length("a.title") >= least_title).select(
        F.md5("a.url").alias("id"),
        F.col("a.title").alias("title"),
        F.col("a.domain").alias("domain"),
        F.try_to_timestamp("a.seendate", F.lit("yyyyMMdd'T'HHmmss'Z'")).alias("ts"),
        clamp(F.coalesce(tone, F.lit(0.0)) / 20, -1.0, 1.0).alias("sentiment"),
    )


def latest_observations(observations: DataFrame, series: str = "series", day: str = "day", value: str = "value") -> DataFrame:
    """Per series the newest value and the one before; text values that are no numbers (such as '.') are dropped."""
    from pyspark.sql import Window as W

    rows = observations.withColumn("__v", F.col(value).try_cast("double")).where("__v IS NOT NULL")
    p = F.row_number().over(W.partitionBy(series).orderBy(F.desc(day)))
    ranked = rows.withColumn("__p", p).where("__p <= 2")
    return ranked.groupBy(series).agg(
        F.max(F.when(F.col("__p") == 1, F.col("__v"))).alias("value"), F.max(F.when(F.col("__p") == 2, F.col("__v"))).alias("previous")
    )


FILINGS = "struct<form:array<string>,filed:array<string>,accession:array<string>>"


def filings(files: DataFrame, raw: str = "value", form: str = "13F-HR", newest: int = 4) -> DataFrame:
    """Filing indexes with parallel arrays: the newest filings of a form by filer (column cik)."""
    from tidemark.operators.kpis import top_per_group

    parsed = files.withColumn("f", F.from_json(F.col(raw), FILINGS))
    zipped = F.arrays_zip(F.col("f.form").alias("form"), F.col("f.filed").alias("filed"), F.col("f.accession").alias("accession"))
    rows = parsed.select("cik", F.explode(zipped).alias("x")).select("cik", "x.*").where(F.col("form") == form)
    return top_per_group(rows, "cik", [F.desc("filed"), "accession"], newest)


def node_blocks(files: DataFrame, raw: str = "value") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of texts with `# NODE: name` and `# EDGE: a -> b` blocks of `key: value` lines; weight at most 3, confidence at most 1."""
    blocks = F.regexp_extract_all(F.col(raw), F.lit(r"(?s)# (?:NODE|EDGE):.*?(?=\n# (?:NODE|EDGE):|\z)"), F.lit(0))
    b = files.select(F.explode(blocks).alias("b"))

    def field(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract("b", rf"(?m)^{name}:[ \t]*(.*)$", 1)), F.lit(""))

    nodes = b.where(F.startswith("b", F.lit("# NODE:"))).select(
        F.trim(F.regexp_extract("b", r"# NODE:[ \t]*([^\n]*)", 1)).alias("label"), field("type").alias("type"), field("description").alias("description"),
        F.least(F.lit(1.0), F.coalesce(field("confidence").try_cast("double"), F.lit(0.5))).alias("confidence"),
    )
    edges = b.where(F.startswith("b", F.lit("# EDGE:"))).select(
        F.trim(F.regexp_extract("b", r"# EDGE:[ \t]*(.*?)[ \t]*->", 1)).alias("src"), F.trim(F.regexp_extract("b", r"->[ \t]*([^\n]*)", 1)).alias("tgt"),
        F.coalesce(field("relation"), F.lit("related")).alias("relation"),
        F.least(F.lit(3.0), F.coalesce(field("weight").try_cast("double"), F.lit(1.0))).alias("weight"),
    )
    return nodes, edges


def export_csv(df: DataFrame, path: str, arrays: tuple[str, ...] = ()) -> None:
    """Rows as CSV files with a header; arrays are joined, line breaks become spaces."""
    for c in arrays:
        df = df.withColumn(c, F.array_join(c, ", "))
    for c, kind in df.dtypes:
        if kind == "string":
            df = df.withColumn(c, F.regexp_replace(c, r"[\r\n]+", " "))
    df.write.mode("overwrite").option("header", True).csv(path)


def export_jsonl(df: DataFrame, path: str, least: int) -> None:
    """Rated question and answer pairs as JSON lines: input, output, rating."""
    rows = df.where(F.col("rating") >= least)
    rows.select(F.col("question").alias("input"), F.col("answer").alias("output"), "rating").write.mode("overwrite").json(path)
