"""Raw records to typed rows, and rows that leave the library: codes, quotes, calendars, disclosures, graph export, digests, model portfolios."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.functions.lexicons import ACTION_CATEGORY, PORTFOLIOS
from tidemark.functions.scalars import clamp
from tidemark.operators.graph import induced


def action_category(code: Column) -> Column:
    """The category of an action code: by its first two characters, then by its first one, else GEOPOLITICS."""
    table = F.create_map(*[F.lit(x) for x in chain.from_iterable(ACTION_CATEGORY.items())])
    return F.coalesce(table[F.substring(code, 1, 2)], table[F.substring(code, 1, 1)], F.lit("GEOPOLITICS"))


def scale_severity(scale: Column) -> Column:
    """A conflict scale of -10 (worst) to 10 as a severity of 1 to 10; 5 where it is null."""
    return F.when(scale.isNull(), 5.0).otherwise(F.round(clamp(5 - scale / 2, 1, 10), 1))


QUOTES = "map<string,struct<usd:double,usd_24h_change:double>>"


def coin_quotes(files: DataFrame, raw: str = "value") -> DataFrame:
    """Quotes from a JSON object by coin: coin, value, change_pct and the price a day before (the price itself at a change of -100 %)."""
    q = files.select(*[c for c in files.columns if c != raw], F.explode(F.from_json(raw, QUOTES)).alias("coin", "q")).where("q IS NOT NULL")
    price, change = F.coalesce("q.usd", F.lit(0.0)), F.coalesce("q.usd_24h_change", F.lit(0.0))
    before = F.when(change != -100, price / F.nullif(1 + change / 100, F.lit(0.0))).otherwise(price)
    kept = [c for c in files.columns if c != raw]
    return q.select(*kept, "coin", F.round(price, 6).alias("value"), F.round(before, 6).alias("previous"), F.round(change, 4).alias("change_pct"))


def earnings(lines: DataFrame, file: str, at: str, raw: str = "value", most: int = 10) -> DataFrame:
    """symbol, date and eps from lines symbol,date,eps: each file's first lines (by at) whose eps is a number."""
    part = F.split(raw, ",")
    rows = lines.select(file, at, F.trim(part[0]).alias("symbol"), F.trim(part[1]).alias("date"), F.try_element_at(part, F.lit(3)).try_cast("double").alias("eps"))
    place = F.row_number().over(W.partitionBy(file).orderBy(at))
    return rows.where("eps IS NOT NULL AND symbol <> ''").withColumn("place", place).where(F.col("place") <= most)


def latest_quotes(bars: DataFrame, most: int = 10) -> DataFrame:
    """Each symbol's last close, its change against the close before, and its last closes, oldest first."""
    b = bars.where("close IS NOT NULL")
    place = F.row_number().over(W.partitionBy("symbol").orderBy(F.desc("date")))
    near = b.withColumn("place", place).where(F.col("place") <= most).groupBy("symbol")
    q = near.agg(F.transform(F.array_sort(F.collect_list(F.struct("date", "close"))), lambda x: x["close"]).alias("c"))
    now = F.element_at("c", -1)
    before = F.coalesce(F.try_element_at("c", F.lit(-2)), now)
    pct = F.coalesce((now / F.nullif(before, F.lit(0.0)) - 1) * 100, F.lit(0.0))
    rounded = F.transform("c", lambda x: F.round(x, 4))
    return q.select("symbol", F.round(now, 4).alias("price"), F.round(pct, 3).alias("change_pct"), F.round(now - before, 4).alias("change_abs"), rounded.alias("history"))


FLAT = "struct<representative:string,ticker:string,type:string,transaction_date:string,disclosure_date:string>"
NESTED = "struct<senator:string,transactions:array<struct<ticker:string,type:string,transaction_date:string>>>"


def disclosures(flat: DataFrame, nested: DataFrame, raw: str = "value") -> DataFrame:
    """Trades of both chambers' JSON records, flat ones and ones with a list of transactions; rows without a ticker go."""
    house = flat.select(F.from_json(raw, FLAT).alias("r")).select(
        F.lit("house").alias("chamber"), F.col("r.representative").alias("name"), "r.ticker", "r.type", "r.transaction_date", "r.disclosure_date"
    )
    block = nested.select(F.from_json(raw, NESTED).alias("r")).select("r.senator", F.explode("r.transactions").alias("t"))
    senate = block.select(
        F.lit("senate").alias("chamber"), F.col("senator").alias("name"), "t.ticker", "t.type", "t.transaction_date", F.col("t.transaction_date").alias("disclosure_date")
    )
    lag = F.datediff(F.col("disclosure_date").try_cast("date"), F.col("transaction_date").try_cast("date"))
    both = house.unionByName(senate).withColumn("ticker", F.upper(F.trim("ticker"))).where("ticker NOT IN ('', '--', 'N/A')")
    return both.select(
        "chamber", F.coalesce("name", F.lit("Unknown")).alias("name"), "ticker", F.coalesce(F.lower("type"), F.lit("purchase")).alias("transaction_type"),
        "transaction_date", "disclosure_date", F.greatest(F.lit(0), F.coalesce(lag, F.lit(0))).alias("disclosure_lag"),
    )


def node_link(nodes: DataFrame, edges: DataFrame, least: float = 0.1, types: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, node_type) of the types with their in-degree, and edges (src, tgt, weight) of a least weight between them."""
    kept = nodes.where(F.col("node_type").isin(types)) if types else nodes
    strong = induced(edges.where(F.col("weight") >= least), kept.select(F.col("id").alias("node")))
    degree = strong.groupBy(F.col("tgt").alias("id")).agg(F.count("*").alias("in_degree"))
    return kept.join(degree, "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0).cast("long"))), strong


def write_graph(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """Both sides of node_link() as JSON lines."""
    nodes.write.mode("overwrite").json(f"{path}/nodes")
    edges.write.mode("overwrite").json(f"{path}/edges")


def digest_lines(events: DataFrame, most: int = 12, categories: int = 4, each: int = 3) -> DataFrame:
    """The most severe events as lines of text: the first categories met, and a few events of each."""
    top = events.orderBy(F.desc("severity"), "id").limit(most)
    # most rows at most from here on
    order = W.partitionBy("category").orderBy(F.desc("severity"), "id")
    top = top.withColumn("place", F.row_number().over(order)).withColumn("best", F.first(F.struct(-F.col("severity"), "id")).over(order))
    kept = top.withColumn("nth", F.dense_rank().over(W.orderBy("best"))).where((F.col("nth") <= categories) & (F.col("place") <= each))
    line = F.concat(F.lit("["), F.round("severity").cast("int").cast("string"), F.lit("/10] "), "title", F.lit(" - "), "country")
    return kept.select("nth", "category", "place", line.alias("line"))


def best_topic(query: Column, topics: list[str]) -> tuple[Column, Column]:
    """The topic that most words of a query hold or are held by (the first of equals; null without any), and its score."""
    words = F.filter(F.split(F.lower(query), r"[ \t\n\x0B\f\r]+"), lambda w: w != "")
    hit = lambda t: F.size(F.filter(words, lambda w: F.contains(F.lit(t), w) | F.contains(w, F.lit(t))))
    scored = F.array_max(F.array(*[F.struct(hit(t.lower()).alias("score"), F.lit(-i).alias("i"), F.lit(t).alias("topic")) for i, t in enumerate(topics)]))
    return F.when(scored["score"] > 0, scored["topic"]), F.greatest(scored["score"], F.lit(0))


def running_pairs(rows: DataFrame, nodes: str) -> DataFrame:
    """How often two nodes stand in one row's array: a < b and n. On a stream it is a count to be written in update mode."""
    own = F.array_sort(F.array_distinct(nodes))
    pairs = F.flatten(F.transform(own, lambda a, i: F.transform(F.slice(own, i + 2, F.size(own)), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return rows.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count("*").alias("n"))


def model_portfolio(clients: DataFrame, risk: str = "risk", amount: str = "amount") -> DataFrame:
    """Each client's amount dealt out over the model portfolio of their risk; an unknown risk is Moderate."""
    known = F.when(F.col(risk).isin(list(PORTFOLIOS)), F.col(risk)).otherwise("Moderate")
    rows = [(r, t, p) for r, parts in PORTFOLIOS.items() for t, p in parts.items()]
    table = clients.sparkSession.createDataFrame(rows, "risk string, ticker string, pct int")  # 18 fixed rows
    return clients.withColumn("risk", known).join(F.broadcast(table), "risk").withColumn("part", F.col(amount) * F.col("pct") / 100)


def labelled_signals(signals: DataFrame, by: list[str], order: list[Column], min_rows: int = 50, most: int = 5000) -> DataFrame:
    """Resolved BUY and SELL signals as training rows, features (JSON text) as a map: each group's newest ones, if it has min_rows of them."""
    kept = signals.where("outcome IS NOT NULL AND action <> 'HOLD'")
    near = kept.withColumn("__p", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("__p") <= most)
    enough = near.withColumn("__n", F.max("__p").over(W.partitionBy(*by))).where(F.col("__n") >= min_rows).drop("__p", "__n")
    empty = F.create_map().cast("map<string,double>")
    return enough.withColumn("features", F.coalesce(F.from_json("features", "map<string,double>"), empty))


def later_outcomes(signals: DataFrame, prices: DataFrame, after: str = "1 day", band: float = 0.5) -> DataFrame:
    """Signals (id, symbol, action, price, ts) with the first price of their symbol later than `after`, the return in percent (turned
    round for SELL) and WIN, LOSS or NEUTRAL; null while no such price is there. One union and one sort by symbol, no join by range.
    """
    none = F.lit(None)
    due = (F.col("ts") + F.expr(f"INTERVAL {after}")).alias("t")
    asked = signals.where("action <> 'HOLD'").select("symbol", due, F.lit(1).alias("kind"), "id", "action", "price", "ts", none.cast("double").alias("later"))
    known = prices.where("price IS NOT NULL").select(
        "symbol", F.col("ts").alias("t"), F.lit(0).alias("kind"), *[none.alias(c) for c in ("id", "action", "price", "ts")], F.col("price").cast("double").alias("later")
    )
    # read from the newest back: a frame that only grows costs a step a row, one that runs to a key's end as many as the key has rows.
    # at one time signals stand before prices, so that only later ones are behind them; of equal times the highest price counts
    behind = W.partitionBy("symbol").orderBy(F.desc("t"), F.desc("kind"), "later").rowsBetween(W.unboundedPreceding, 0)
    df = asked.unionByName(known).withColumn("later", F.last("later", ignorenulls=True).over(behind)).where("kind = 1")
    change = (F.col("later") / F.nullif(F.col("price"), F.lit(0.0)) - 1) * 100
    df = df.withColumn("change", F.when(F.col("action") == "SELL", 0 - change).otherwise(change))
    label = F.when(F.col("change") > band, "WIN").when(F.col("change") < -band, "LOSS").when(F.col("change").isNotNull(), "NEUTRAL")
    return df.withColumn("outcome", label).select("id", "symbol", "action", "price", "ts", "later", "change", "outcome")
