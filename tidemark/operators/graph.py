"""Graph jobs over an edge table (src, tgt, weight): joins, aggregates, and driver loops whose state stays in Spark.

Every round of a loop reads its state more than once, so the state is written
to the shared folder and read back each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import settle


def nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("node")).union(edges.select("tgt")).distinct()


def undirected(edges: DataFrame) -> DataFrame:
    flip = edges.select(F.col("tgt").alias("src"), F.col("src").alias("tgt"), "weight")
    return edges.select("src", "tgt", "weight").union(flip)


def degrees(edges: DataFrame) -> DataFrame:
    """In, out and total degree, and total over (n - 1)."""
    both = edges.select(F.col("src").alias("node"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(
        edges.select("tgt", F.lit(0), F.lit(1))
    )
    d = both.groupBy("node").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"))
    n = d.select(F.count("*")).scalar()
    total = F.col("out_degree") + F.col("in_degree")
    return d.withColumn("degree", total).withColumn("centrality", F.try_divide(total, F.lit(n - 1)))


def pagerank(edges: DataFrame, rounds: int = 20, alpha: float = 0.85) -> DataFrame:
    """Weighted PageRank; the mass of nodes without out-edges is dealt to all."""
    edges = settle(edges)
    out = edges.groupBy("src").agg(F.sum(F.abs("weight")).alias("total"))
    steps = edges.join(out, "src").select("src", "tgt", F.try_divide(F.abs("weight"), F.col("total")).alias("p"))
    steps = settle(steps)
    every = settle(nodes(edges).join(out, F.col("node") == F.col("src"), "left").select("node", F.col("total").isNull().alias("dangling")))
    n = every.count()
    rank = every.withColumn("rank", F.lit(1.0 / max(n, 1)))
    if not n:
        return rank.select("node", "rank")
    for _ in range(rounds):
        lost = rank.where("dangling").agg(F.coalesce(F.sum("rank"), F.lit(0.0)).alias("lost"))
        given = steps.join(rank, F.col("src") == F.col("node")).groupBy("tgt").agg(F.sum(F.col("rank") * F.col("p")).alias("got"))
        value = (1 - alpha) / n + alpha * (F.coalesce("got", F.lit(0.0)) + F.col("lost") / n)
        rank = (
            every.join(given, F.col("node") == F.col("tgt"), "left").join(F.broadcast(lost))
            .select("node", "dangling", value.alias("rank"))
        )
        rank = settle(rank)
    return rank.select("node", "rank")


def hits(edges: DataFrame, rounds: int = 10) -> DataFrame:
    """Hub and authority scores, each scaled to sum one."""
    edges = settle(edges)
    hub = nodes(edges).withColumn("hub", F.lit(1.0))
    auth = None
    for _ in range(rounds):
        a = edges.join(hub, F.col("src") == F.col("node")).groupBy(F.col("tgt").alias("node")).agg(F.sum(F.col("hub") * F.col("weight")).alias("auth"))
        a = settle(a)
        auth = a.withColumn("auth", F.try_divide(F.col("auth"), a.select(F.sum("auth")).scalar()))
        h = edges.join(auth, F.col("tgt") == F.col("node")).groupBy(F.col("src").alias("node")).agg(F.sum(F.col("auth") * F.col("weight")).alias("hub"))
        h = settle(h)
        hub = h.withColumn("hub", F.try_divide(F.col("hub"), h.select(F.sum("hub")).scalar()))
    both = hub.join(auth, "node", "full_outer")
    return both.select("node", F.coalesce("hub", F.lit(0.0)).alias("hub"), F.coalesce("auth", F.lit(0.0)).alias("auth"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: the smallest node of each connected component.

    Every round a node takes the smallest label of its neighbours and itself,
    then its label's label, until no label moves.
    """
    links = undirected(edges.withColumn("weight", F.lit(1.0))).select("src", "tgt").distinct()
    links = settle(links)
    state = nodes(links).withColumn("component", F.col("node"))
    while True:
        near = links.join(state, F.col("tgt") == F.col("node")).groupBy("src").agg(F.min("component").alias("low"))
        low = state.join(near, F.col("node") == F.col("src"), "left").select(
            "node", F.least("component", "low").alias("label"), (F.col("low") < F.col("component")).alias("moved")
        )
        low = settle(low)
        if low.where("moved").isEmpty():
            return state
        up = low.select(F.col("node").alias("parent"), F.col("label").alias("top"))
        jumped = low.join(up, F.col("label") == F.col("parent"))
        state = settle(jumped.select("node", F.least("label", "top").alias("component")))


def label_propagation(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Synchronous rounds: each node takes its neighbours' heaviest label, the smallest of equal ones."""
    links = settle(undirected(edges))
    state = nodes(links).withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = links.join(state, F.col("tgt") == F.col("node")).groupBy("src", "label").agg(F.round(F.sum("weight"), 9).alias("w"))
        place = F.row_number().over(W.partitionBy("src").orderBy(F.desc("w"), "label"))
        state = settle(votes.withColumn("place", place).where("place = 1").select(F.col("src").alias("node"), "label"))
    return state


def propagate(edges: DataFrame, seeds: DataFrame, hops: int = 4, damping: float = 0.65, least: float = 0.1) -> DataFrame:
    """Impact of seeds (seed, node, impact) along edges: times weight and damping a hop, dropped below least; the best per node."""
    edges = settle(edges)
    reached = seeds.select("seed", "node", "impact", F.lit(0).alias("hop"))
    front = reached
    for hop in range(1, hops + 1):
        front = (
            front.join(edges, F.col("node") == F.col("src"))
            .select("seed", F.col("tgt").alias("node"), (F.col("impact") * F.col("weight") * damping).alias("impact"))
            .where(F.col("impact") >= least)
            .groupBy("seed", "node")
            .agg(F.max("impact").alias("impact"))
            .withColumn("hop", F.lit(hop))
        )
        front = settle(front)
        reached = reached.union(front)
    best = reached.groupBy("seed", "node").agg(F.max("impact").alias("impact"), F.max_by("hop", F.struct("impact", -F.col("hop"))).alias("hop"))
    return best.where("hop > 0")


def neighbours(edges: DataFrame, k: int) -> DataFrame:
    """The k strongest neighbours of every node, in either direction."""
    by = W.partitionBy("src").orderBy(F.desc("weight"), "tgt")
    return undirected(edges).withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int, fan: int) -> DataFrame:
    """Nodes within hops of each seed (seed, node), each hop over a node's fan strongest edges; the first hop that meets a node counts."""
    strong = settle(neighbours(edges, fan).select("src", "tgt"))
    seen = seeds.select("seed", "node", F.lit(0).alias("hop"))
    front = seen
    for hop in range(1, hops + 1):
        nxt = front.join(strong, F.col("node") == F.col("src")).select("seed", F.col("tgt").alias("node")).distinct()
        front = settle(nxt.join(seen.select("seed", "node"), ["seed", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        seen = seen.union(front)
    return seen


def induced(edges: DataFrame, kept: DataFrame) -> DataFrame:
    """Edges with both ends in kept (node)."""
    half = edges.join(kept.select(F.col("node").alias("src")), "src", "left_semi")
    return half.join(kept.select(F.col("node").alias("tgt")), "tgt", "left_semi")


def merge_nodes(rows: DataFrame) -> DataFrame:
    """Nodes (label, type, confidence, description, seq) merged: count, highest confidence, first description that is not empty."""
    text = F.when(F.col("description") != "", F.struct("seq", "description"))
    return rows.groupBy("label", "type").agg(
        F.count("*").alias("n"), F.max("confidence").alias("confidence"), F.min(text)["description"].alias("description")
    )


def merge_edges(rows: DataFrame, most: float = 5.0, step: float = 0.1) -> DataFrame:
    """Edges (src, tgt, relation, weight, seq) merged: evidence count, and the first weight plus a step for each further one."""
    first = F.min(F.struct("seq", "weight"))["weight"]
    agg = rows.where("src <> tgt").groupBy("src", "tgt", "relation").agg(F.count("*").alias("evidence"), first.alias("w"))
    return agg.withColumn("weight", F.least(F.lit(most), F.col("w") + step * (F.col("evidence") - 1))).drop("w")


def co_occurrence(members: DataFrame, group: str, node: str, scale: int = 10) -> DataFrame:
    """Pairs of nodes that share groups: n and weight = min(1, n / scale). A group's members are joined by group, each pair once."""
    m = members.select(group, node).distinct()
    other = m.select(group, F.col(node).alias("b"))
    pairs = m.join(other, group).where(F.col(node) < F.col("b")).groupBy(F.col(node).alias("a"), "b").agg(F.count("*").alias("n"))
    return pairs.withColumn("weight", F.least(F.lit(1.0), F.col("n") / scale))
