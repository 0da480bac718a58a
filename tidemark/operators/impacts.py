"""Factor impacts, place lookups, dependency edges by category rules, phrases with values and causes, and composite scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions import scalars as C
from tidemark.operators import series as S
from tidemark.session import settle

# Verbs that join two ends of a causal pair, and of a pair that moves together.
CAUSES = ["caused", "cause", "led to", "lead to", "resulted in", "result in", "triggered", "trigger", "drove", "pushed", "push", "boosted", "boost", "lowered", "lower", "raised", "raise", "increased", "increase", "decreased", "decrease"]
MOVES = ["correlate with", "correlates with", "track", "tracks", "follow", "follows", "move with", "moves with", "inversely correlate", "inversely correlates"]

# Words between a measure's name and its value, and units.
LINKS = ["of", "at", "reached", "hit", "was", "is"]
UNITS = ["%", "bps", "bp", "bn", "B", "T", "M", "K", "x", "times"]


def places(df: DataFrame, code: str, known: DataFrame) -> DataFrame:
    """df with name, lat and lon of its upper-case code; an unknown or null code names itself and stands at (0, 0).

    known (code, name, lat, lon) has one row a code.
    """
    k = known.select(F.upper("code").alias("__code"), F.col("name").alias("__name"), F.col("lat").alias("__lat"), F.col("lon").alias("__lon"))
    out = df.join(k, F.upper(code) == F.col("__code"), "left").withColumns(
        {"name": F.coalesce("__name", F.col(code)), "lat": F.coalesce("__lat", F.lit(0.0)), "lon": F.coalesce("__lon", F.lit(0.0))}
    )
    return out.drop("__code", "__name", "__lat", "__lon")


def enriched(df: DataFrame, generic: str, rule: Column, rule_severity: Column, found: Column) -> DataFrame:
    """Late enrichment: rows of the generic category (or none) take the rule's category and the higher severity; country XX takes the found code."""
    plain = F.coalesce(F.col("category"), F.lit("")).isin("", generic)
    return df.withColumns(
        {
            "category": F.when(plain, rule).otherwise(F.col("category")),
            "severity": F.when(plain, F.greatest("severity", rule_severity)).otherwise(F.col("severity")),
            "country": F.when(F.coalesce("country", F.lit("XX")) == "XX", found).otherwise(F.col("country")),
        }
    )


def factor_impacts(events: DataFrame, factors: DataFrame, digits: int = 1) -> DataFrame:
    """One row for each event and factor of its category: magnitudes within 1..10 and moves in percent, short and long.

    factors (category, instrument, type, sign, base) is a rule table. Moves have so many digits; halves go to the even digit.
    """

    def bounded(x: Column) -> Column:
        return F.least(F.lit(10), F.greatest(F.lit(1), x)).cast("int")

    severity, base = F.col("severity"), F.col("base")
    df = events.join(factors, "category").withColumn("short_magnitude", bounded(F.bround(bounded(F.bround(severity * 1.05)) * base * 10)))
    return df.withColumns(
        {
            "direction": F.when(F.col("sign") > 0, "positive").otherwise("negative"),
            "long_magnitude": F.greatest(F.lit(1), F.col("short_magnitude") - 2),
            "short_move": F.bround(base * severity * 1.5, digits),
            "long_move": F.bround(base * severity * 0.8, digits),
        }
    )


def entity_pairs(entities: DataFrame, events: DataFrame, seq: str) -> DataFrame:
    """Pairs of each event's entities (event, kind, node, at), the earlier one first, with the event's columns and seen: how many events have held the pair so far.

    An event names a handful of entities, so pairs stay within a small multiple of events.
    """
    own = entities.dropDuplicates(["event", "node"])
    a = own.select("event", F.col("kind").alias("src_kind"), F.col("node").alias("src"), F.col("at").alias("src_at"))
    b = own.select("event", F.col("kind").alias("tgt_kind"), F.col("node").alias("tgt"), F.col("at").alias("tgt_at"))
    pairs = a.join(b, "event").where("src_at < tgt_at").join(events, "event")
    pair = W.partitionBy(F.least("src", "tgt"), F.greatest("src", "tgt")).orderBy(seq)
    return pairs.withColumn("seen", F.row_number().over(pair))


def dependency_edges(pairs: DataFrame, rules: DataFrame, market: Column, sentiment: Column, strong: float = 7.0, least: float = 0.3) -> DataFrame:
    """Edges that an event's pairs give: src, tgt, relation, weight, event.

    rules (category, src_kind, tgt_kind, relation, factor) give an edge of the event's base weight times the factor; a
    strong event also links each pair by the weight of its count so far, if that reaches least.
    """

    def weight(n: Column, confidence: float) -> Column:
        return C.edge_weight(F.col("severity"), sentiment, n, market, F.lit(0), F.lit(confidence))

    by_rule = pairs.join(rules, ["category", "src_kind", "tgt_kind"]).select(
        "src", "tgt", "relation", (weight(F.lit(1), 0.75) * F.col("factor")).alias("weight"), "event"
    )
    s, t = F.col("src_kind"), F.col("tgt_kind")
    relation = (
        F.when((s == "country") & (t == "country"), "geopolitical")
        .when((s == "country") & t.isin("sector", "commodity"), F.when(F.col("category").isin("ENERGY", "TRADE"), "supply_chain").otherwise("regulatory"))
        .when(s.isin("sector", "company") & (t == "commodity"), "supply_chain")
        .when((s == "country") & (t == "asset"), "macro")
        .when((s == "company") & (t == "company"), "ownership")
        .when(s == "person", "political_control")
        .when((s == "asset") & (t == "asset"), "market_correlation")
        .otherwise("mentions")
    )
    together = pairs.where(F.col("severity") >= strong).select("src", "tgt", relation.alias("relation"), weight(F.col("seen"), 1.0).alias("weight"), "event")
    return by_rule.unionByName(together.where(F.col("weight") >= least))


#: Words of an end of a pair. A name of under 50 characters has fewer than 26 words, so no more are looked at.
END_WORDS, NAME_WORDS = 10, 26

#: Where a clause ends: marks before white space or the end, and line breaks.
CLAUSE_END = r"[.,;:!?]+(?:\s+|$)|\n+"
_LETTERS = r"^\p{L}+$"
_VALUE = r"^([0-9][0-9,.]*)(\D*)$"


def clauses(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, clause (number within the text), w (its tokens) and low (the tokens in lower case) of every clause of at least two tokens."""
    each = df.select(key, F.posexplode(F.split(text, CLAUSE_END)).alias("clause", "t"))
    words = each.select(key, "clause", F.filter(F.split("t", r"\s+"), lambda x: F.length(x) > 0).alias("w"))
    return words.where(F.size("w") > 1).withColumn("low", F.transform("w", F.lower))


def _run(words: Column) -> Column:
    """The words of letters only that words starts with."""
    broken = F.array_position(F.transform(words, lambda x: x.rlike(_LETTERS)), F.lit(False))
    return F.slice(words, F.lit(1), F.when(broken > 0, broken.cast("int") - 1).otherwise(F.size(words)))


def _run_before(words: Column) -> Column:
    return F.reverse(_run(F.reverse(words)))


def _before(words: str, at: Column, most: int) -> Column:
    """The words before place at (from 0), the last `most` of them."""
    first = F.greatest(at - most, F.lit(0))
    return F.slice(words, first + 1, at - first)


def measures(df: DataFrame, key: str, text: Column, links: list[str] = LINKS, units: list[str] = UNITS) -> DataFrame:
    """key, clause, at (the value's token), name (over 3, under 50 characters), value (no thousands commas) and unit of every stated measure.

    A token that starts with a digit is a value if the token before it is one of the links; the words of letters before
    that are its name. What follows the digits, or else the next token, is its unit if it is one of the units.
    """
    wanted = [x.lower() for x in links]
    at = F.filter(F.sequence(F.lit(2), F.size("w") - 1), lambda i: F.get("w", i).rlike(_VALUE) & F.get("low", i - 1).isin(wanted))
    # what is near a value goes on with it, not the clause, so a long clause is not copied for each value
    near = F.transform(at, lambda i: F.struct(i.alias("at"), _before("w", i - 1, NAME_WORDS).alias("before"), F.get("w", i).alias("token"), F.get("w", i + 1).alias("after")))
    found = clauses(df, key, text).where(F.size("w") > 2).select(key, "clause", F.explode(near).alias("x")).select(key, "clause", "x.*")
    token, after = F.col("token"), F.col("after")
    own = F.regexp_extract(token, _VALUE, 2)
    unit = F.when(own.isin(units), own).when((own == "") & after.isin(units), after).otherwise("")
    out = found.select(
        key, "clause", "at", F.array_join(_run_before(F.col("before")), " ").alias("name"),
        F.replace(F.rtrim(F.regexp_extract(token, _VALUE, 1), F.lit(".,")), F.lit(","), F.lit("")).alias("value"), unit.alias("unit"),
    )
    return out.where("length(name) > 3 AND length(name) < 50")


def stated_pairs(df: DataFrame, key: str, text: Column, verbs: list[str], relation: str, weight: float) -> DataFrame:
    """key, clause, src, tgt (up to 60 characters, over 3), relation and weight of every clause in which one of the verbs joins two ends.

    The ends are the words of letters right before and right after the verb, END_WORDS at most; a clause states the
    pair of its first verb with both ends, the longer verb first. Clauses meet verbs by an equi-join on the verb's first word.
    """
    spark = df.sparkSession
    table = spark.createDataFrame([(v.lower().split()[0], v.lower().split()) for v in verbs], "first string, verb array<string>")
    most = max((len(v.split()) for v in verbs), default=1)
    firsts = sorted({v.lower().split()[0] for v in verbs})
    at = F.filter(F.sequence(F.lit(0), F.size("w") - 1), lambda i: F.get("low", i).isin(firsts))
    near = F.transform(
        at,
        lambda i: F.struct(
            i.alias("at"), F.get("low", i).alias("first"), F.slice("low", i + 1, F.lit(most)).alias("here"),
            _before("w", i, END_WORDS).alias("before"), F.slice("w", i + 1, F.lit(most + END_WORDS)).alias("on"),
        ),
    )
    tokens = clauses(df, key, text).select(key, "clause", F.explode(near).alias("x")).select(key, "clause", "x.*")
    size = F.size("verb")
    found = tokens.join(F.broadcast(table), "first").where(F.slice("here", F.lit(1), size) == F.col("verb"))  # as many rows as the caller names verbs
    src, tgt = _run_before(F.col("before")), _run(F.slice("on", size + 1, F.lit(END_WORDS)))
    ends = found.select(key, "clause", "at", size.alias("size"), *[F.substring(F.array_join(x, " "), 1, 60).alias(n) for x, n in ((src, "src"), (tgt, "tgt"))])
    ends = ends.where("length(src) > 3 AND length(tgt) > 3")
    first = ends.groupBy(key, "clause").agg(F.min_by(F.struct("src", "tgt"), F.struct("at", -F.col("size"))).alias("x"))
    return first.select(key, "clause", "x.src", "x.tgt", F.lit(relation).alias("relation"), F.lit(weight).alias("weight"))


# Weights of the groups of a composite score (X3).
GROUPS = {"technical": 0.30, "regime": 0.15, "momentum": 0.20, "cross_asset": 0.15, "sentiment": 0.10, "prediction": 0.10}


def composite(df: DataFrame, bars: Column, weights: dict[str, float] | None = None, threshold: float = 0.15) -> DataFrame:
    """composite (weighted sum of the groups' columns within one, four decimals), confidence from bars and the agreement of technical and momentum, and action.

    A group that is null or whose column is missing counts as 0.
    """
    weights = weights or GROUPS
    total, part = F.lit(0.0), {}
    for name, w in weights.items():
        part[name] = F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in df.columns else F.lit(0.0)
        total = total + part[name] * w
    strength = F.abs(part["technical"]) * 0.3 + F.abs(part["momentum"]) * 0.3
    df = df.withColumn("composite", F.round(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), total)), 4))
    action = F.when(F.col("composite") > threshold, "BUY").when(F.col("composite") < -threshold, "SELL").otherwise("HOLD")
    return df.withColumns({"confidence": F.round(F.least(F.lit(1.0), bars / 200 * 0.4 + strength), 3), "action": action})


def overlay(events: DataFrame, bars: DataFrame, key: str, most: int = 50, severity: float = 5.0, relevance: float = 0.2) -> DataFrame:
    """Events (key, symbol, category, severity, relevance, on) over a symbol's bars: the most of highest relevance times severity, with reactions and cluster.

    Only events within the bars' dates count. Chosen events of a symbol and category at most a day apart share a cluster,
    numbered from 1 by date. Equal ranks stand by key.
    """
    span = bars.groupBy("symbol").agg(F.min("date").alias("__from"), F.max("date").alias("__to"))
    near = events.where((F.col("severity") >= severity) & (F.col("relevance") >= relevance)).join(F.broadcast(span), "symbol")  # a row a symbol; events stay where they are until the best of each task are known
    rank = W.partitionBy("symbol").orderBy(F.desc(F.round(F.col("relevance") * F.col("severity"), 9)), key)
    kept = near.where("on BETWEEN __from AND __to").withColumn("place", F.row_number().over(rank)).where(F.col("place") <= most).drop("__from", "__to")
    kept = settle(kept)  # at most `most` rows a symbol, read for the clusters and for the reactions
    line = W.partitionBy("symbol", "category").orderBy("on", key)
    apart = F.coalesce(F.datediff("on", F.lag("on").over(line)) > 1, F.lit(True)).cast("int")
    clustered = kept.withColumn("__new", apart).withColumn("cluster", F.sum("__new").over(line.rowsBetween(W.unboundedPreceding, 0))).drop("__new")
    reactions = S.reaction(bars, clustered.select(key, "symbol", "on"), key).select(key, "symbol", "r1", "r2", "r5", "spike")
    return clustered.join(reactions, [key, "symbol"], "left")
