"""Relationships between events by time, place and vectors, and entities of a text under canonical ids."""

from __future__ import annotations

import re
import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators.knowledge import WORD, outermost, runs, terms_of
from tidemark.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# A relationship's type, and its weight as a share of the cosine, by rule in this order.
WEIGHTS = {"hierarchical": 0.9, "causal": 0.75, "close": 0.8, "temporal": 0.65, "other": 0.5}


#: Events of a bucket that one task scores at a time.
SLICE = 10_000


def _unit(v: pa.ChunkedArray, of: np.ndarray, size: int) -> np.ndarray:
    """The vectors of the rows `of`, each of `size` numbers, scaled to length one."""
    m = v.take(pa.array(of)).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    return m / np.sqrt((m * m).sum(axis=1))[:, None]


def _best(events: pa.Table, near: pa.Table, width: int, top: int, least: float) -> pa.Table:
    """Of every event its `top` candidates of a cosine above least: columns of both and at, cosine and hours."""
    near = near.sort_by("key")  # so that the first of equal cosines is the smallest key
    s, s2 = events["s"].to_numpy(), near["s"].to_numpy()
    key, key2 = events["key"].to_pylist(), near["key"].to_pylist()
    places = {}
    for j, k in enumerate(key2):
        places.setdefault(k, []).append(j)
    sizes, sizes2 = pc.list_value_length(events["v"]).to_numpy(), pc.list_value_length(near["v"]).to_numpy()
    cosine = np.full((len(s), len(s2)), -np.inf)
    with np.errstate(all="ignore"):
        for size in np.intersect1d(sizes, sizes2):
            one, other = np.flatnonzero(sizes == size), np.flatnonzero(sizes2 == size)
            cosine[np.ix_(one, other)] = np.round(_unit(events["v"], one, size) @ _unit(near["v"], other, size).T, 9)
    cosine[~(cosine > least) | (np.abs(s2[None, :] - s[:, None]) > width)] = -np.inf
    for i, k in enumerate(key):
        if k in places:
            cosine[i, places[k]] = -np.inf
    left, right, at, value = [], [], [], []
    row = np.arange(len(s))
    for place in range(min(top, len(s2))):
        j = cosine.argmax(axis=1)
        x = cosine[row, j]
        found = np.flatnonzero(x > -np.inf)
        left.append(found), right.append(j[found]), at.append(np.full(len(found), place)), value.append(x[found])
        cosine[row, j] = -np.inf
    left, right, at, value = (np.concatenate(c) if c else np.zeros(0) for c in (left, right, at, value))
    a, b = events.drop_columns(["v"]).take(pa.array(left, pa.int64())), near.drop_columns(["v"]).take(pa.array(right, pa.int64()))
    hours = np.abs(b["s"].to_numpy() - a["s"].to_numpy()) / 3_600_000_000
    columns = [a["key"], a["country"], a["category"], pa.array(at, pa.int32()), pa.array(value, pa.float64()), b["key"], pa.array(hours, pa.float64()), b["country"], b["category"], b["severity"]]
    return pa.table(columns, names=["key", "country", "category", "at", "cosine", "target", "hours", "country2", "category2", "severity2"])


def relationships(events: DataFrame, key: str, vector: str, hours: int = 120, most: int = 50, top: int = 5, least: float = 0.25) -> DataFrame:
    """Of every event its `top` likest candidates of a cosine above least: key, target, place, rel_type, weight, confidence, hours_diff.

    Time is cut into buckets of `hours`; a bucket's candidates are its `most` severest events (ties by key), and an
    event meets those of its own and both neighbouring buckets that are at most `hours` away. So an event meets at most
    3 * most candidates however many events there are. A bucket's events are dealt to as many slices as its number asks
    for, each slice gets the bucket's candidates, and its cosines are one product of matrices. events: key, ts, country, category, severity and the vector (array of
    double). Ties in cosine (nine decimals) stand by key. A null or zero vector or a null ts gives no relationship; a null
    country equals none.
    """
    width = hours * 3_600_000_000
    e = events.select(F.col(key).alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("s"), "country", "category", "severity", F.col(vector).alias("v"))
    e = e.where(F.col("s").isNotNull() & F.forall("v", lambda x: x.isNotNull()) & F.exists("v", lambda x: x * x > 0))
    e = e.withColumn("b", F.expr(f"(s - pmod(s, {width}L)) div {width}L"))
    rank = W.partitionBy("b").orderBy(F.desc("severity"), "key")
    chosen = e.withColumn("place", F.row_number().over(rank)).where(F.col("place") <= most).drop("place")
    slices = F.broadcast(e.groupBy("b").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices")))  # a row for each bucket of time
    near = chosen.withColumn("b", F.explode(F.array(F.col("b") - 1, F.col("b"), F.col("b") + 1))).join(slices, "b")
    near = near.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
    near = near.select(*[F.col(c).alias(c) for c in ("b", "slice", "key", "s", "country", "category", "severity", "v")])  # columns of its own, for the cogroup
    dealt = e.join(slices, "b").withColumn("slice", F.pmod(F.xxhash64("key", "s"), F.col("slices")).cast("int")).drop("slices")
    kinds = {f.name: f.dataType.simpleString() for f in e.schema}
    shape = f"key {kinds['key']}, country {kinds['country']}, category {kinds['category']}, at int, cosine double, target {kinds['key']}, hours double, country2 {kinds['country']}, category2 {kinds['category']}, severity2 {kinds['severity']}"

    def score(one: pa.Table, other: pa.Table) -> pa.Table:
        return _best(one, other, width, top, least)

    x = dealt.groupBy("b", "slice").cogroup(near.groupBy("b", "slice")).applyInArrow(score, shape)
    cosine, apart = F.col("cosine"), F.col("hours")
    same_country = F.coalesce((F.col("country") == F.col("country2")) & (F.col("country") != "XX"), F.lit(False))
    same_category = F.coalesce(F.col("category") == F.col("category2"), F.lit(False))
    rule = (
        F.when(same_country & same_category & (apart < 48), "hierarchical")
        .when(same_country & (apart < 72) & (F.col("severity2") >= 6.5), "causal")
        .when((cosine > 0.6) & (apart < 120), "close")
        .when((apart < 12) & same_category, "temporal")
        .otherwise("other")
    )
    share = F.create_map(*[F.lit(i) for kv in WEIGHTS.items() for i in kv])
    return x.withColumn("rule", rule).select(
        F.col("key").alias(key), "target", (F.col("at") + 1).alias("place"),
        F.when(F.col("rule").isin("close", "other"), "correlated").otherwise(F.col("rule")).alias("rel_type"),
        F.round(cosine * share[F.col("rule")], 3).alias("weight"), F.round(cosine, 3).alias("confidence"), F.round(apart, 1).alias("hours_diff"),
    )


def undirected(relations: DataFrame, key: str) -> DataFrame:
    """One edge (a < b) for each pair: the relationship of the smaller source, the first by place."""
    ends = {"a": F.least(key, "target"), "b": F.greatest(key, "target")}
    first = relations.withColumns(ends).groupBy("a", "b").agg(F.min_by(F.struct("rel_type", "weight"), F.struct(key, "place")).alias("x"))
    return first.select("a", "b", "x.rel_type", "x.weight")


# Confidence and salience of what a text's kinds of entities have (country codes of the row itself have 1, and severity / 10).
FOUND = {"country": (0.85, 0.60), "company": (0.95, None), "company_sector": (0.95, 0.70), "sector": (0.80, 0.65), "commodity": (0.88, 0.60), "person": (0.90, 0.75), "titled": (0.78, 0.65)}
ENTITY = "struct<node:string,node_type:string,label:string,confidence:double,salience:double,rank:int>"
ORDER = ["country", "company", "company_sector", "sector", "commodity", "person", "titled"]


def normalised(
    df: DataFrame, key: str, text: Column, country: Column, severity: Column, names: DataFrame, companies: DataFrame, titles: list[str],
    tasks: int | None = None,
) -> DataFrame:
    """key, node (type:name), node_type, label, confidence and salience of every entity of a row, each node once.

    Sources in order of precedence, the first to name a node gives its values: the row's own country (not XX), countries
    in the text, ticker symbols (upper case as written, with or without $) and their sectors, sectors, commodities,
    persons, and two capitalised words behind a title. Rows that share a key are one. names: term, kind (country, sector, commodity, person), label;
    companies: symbol, name, sector (or null). Both meet texts by one equi-join on words, so neither has to be small;
    rows are dealt out by key before they become words, and while names are few, that is the only time they travel. Terms
    may have several words; one inside a longer term that stands there does not count. tasks: over how many rows are dealt (the session's partitions).
    """
    own_id = F.monotonically_increasing_id().alias("row")
    rows = df.select(F.col(key).alias("key"), own_id, text.alias("t"), country.alias("c"), severity.alias("s"))
    # a stated number: a text is many words, so few bytes that come in are no reason for fewer tasks
    rows = rows.repartition(tasks or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "key")

    def entity(kind: str, label: Column, name: Column, sure: float, salience: Column, rank: int) -> Column:
        return F.struct(
            F.concat(F.lit(f"{kind}:"), F.replace(name, F.lit(" "), F.lit("_"))).alias("node"), F.lit(kind).alias("node_type"), label.alias("label"),
            F.lit(sure).alias("confidence"), salience.cast("double").alias("salience"), F.lit(rank).alias("rank"),
        )

    def known(kind: str, as_kind: str, label: Column) -> Column:
        return entity(as_kind, label, label, FOUND[kind][0], F.lit(FOUND[kind][1]), ORDER.index(kind) + 1)

    c, s = F.col("c"), F.col("s")
    none = F.array().cast(f"array<{ENTITY}>")
    own = F.when(c.isNotNull() & ~c.isin("", "XX"), F.array(entity("country", c, c, 1.0, F.least(F.lit(1.0), s / 10), 0))).otherwise(none)
    behind = F.regexp_extract_all("t", F.lit(rf"\b(?:{'|'.join(map(re.escape, titles))})\s+([A-Z][a-z]+ [A-Z][a-z]+)\b"), F.lit(1)) if titles else F.array().cast("array<string>")
    titled = F.coalesce(F.transform(behind, lambda x: known("titled", "person", x)), none)
    symbols = F.array_distinct(F.transform(F.regexp_extract_all("t", F.lit(r"\$?\b[A-Z][A-Z0-9]*\b"), F.lit(0)), lambda x: F.ltrim(x, F.lit("$"))))

    # what to look up by its size and words: terms, and symbols of size 0
    kinds = ("country", "sector", "commodity", "person")
    terms, sizes = terms_of(names.select("term", F.when(F.col("kind").isin(*kinds), F.col("kind")).alias("kind"), "label"))
    label = F.concat("symbol", F.lit(" ("), "name", F.lit(")"))
    named = lambda kind, label, name: F.struct(F.lit(kind).alias("kind"), label.alias("label"), name.alias("name"))
    of_firm = F.array(named("company", label, F.col("symbol")), named("company_sector", F.col("sector"), F.col("sector")))
    firms = companies.select(F.lit(0).alias("size"), F.col("symbol").alias("__g"), F.explode(of_firm).alias("x")).select("size", "__g", "x.*").where("kind = 'company' OR label IS NOT NULL")
    known_names = settle(terms.select("size", "__g", "kind", "label", F.col("label").alias("name")).unionByName(firms).withColumn("known", F.lit(True)))

    # everything that a row says, and after the join with names what of it is an entity
    item = lambda e, at, size, g: F.struct(e.cast(ENTITY).alias("e"), at.alias("at"), size.alias("size"), g.alias("__g"))
    no, nowhere = F.lit(None), F.lit(-1)
    words = F.regexp_extract_all(F.lower("t"), F.lit(WORD), F.lit(0))
    parts = [
        F.transform(F.concat(own, titled), lambda e: item(e, nowhere, nowhere, e["node"])),
        F.coalesce(F.transform(symbols, lambda x: item(no, nowhere, F.lit(0), x)), F.array().cast(f"array<struct<e:{ENTITY},at:int,size:int,__g:string>>")),
    ]
    if sizes:
        parts.append(F.transform(runs(F.col("w"), sizes), lambda x: item(no, x["at"], x["size"], x["__g"])))
    said = rows.withColumn("w", words).select("key", "row", "s", F.explode(F.concat(*parts)).alias("x")).select("key", "row", "s", "x.*")
    found = outermost(said.join(known_names, ["size", "__g"], "left").where("e IS NOT NULL OR known"), ["key", "row"])
    kind, label, name = F.col("kind"), F.col("label"), F.col("name")
    company = entity("company", label, name, FOUND["company"][0], F.least(F.lit(1.0), s / 8), ORDER.index("company") + 1)
    e = F.coalesce(
        F.col("e"), F.when(kind == "company", company.cast(ENTITY)), F.when(kind == "company_sector", known("company_sector", "sector", label).cast(ENTITY)),
        *[F.when(kind == k, known(k, k, label).cast(ENTITY)) for k in kinds],
    )
    out = found.select("key", e.alias("e")).where("e IS NOT NULL").select("key", "e.*")
    kept = out.groupBy("key", "node").agg(F.min_by(F.struct("node_type", "label", "confidence", "salience"), F.struct("rank", "label", -F.col("salience"))).alias("x"))
    return kept.select(F.col("key").alias(key), "node", "x.*")
