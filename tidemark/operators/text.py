"""Text analytics over (id, text) tables; lexicons are parameters, and everything is a column expression or a term table."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.session import settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def words(text: Column, least: int = 1) -> Column:
    """Runs of at least `least` ASCII letters of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"[a-z]{{{least},}}"), F.lit(0))


def hits(text: Column, terms: list[str]) -> Column:
    """How many of the terms stand in the lower-cased text."""
    return hits_in(F.lower(text), terms)


def hits_in(low: Column, terms: list[str]) -> Column:
    """How many of the terms stand in a text that is lower-cased already."""
    return sum((F.contains(low, F.lit(t)).cast("int") for t in terms), F.lit(0))


def classify(df: DataFrame, text: Column, rules: dict[str, list[str]], weights: dict[str, float], default: str) -> DataFrame:
    """label: the rule with the most weighted hits (the first of equal ones); and its score."""
    scored = [
        F.struct((hits(text, terms) * F.lit(weights.get(name, 1.0))).alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
        for i, (name, terms) in enumerate(rules.items())
    ]
    best = df.withColumn("__b", F.array_max(F.array(*scored)))
    found = F.col("__b.score") > 0
    return best.withColumn("label", F.when(found, F.col("__b.name")).otherwise(default)).withColumn("score", F.col("__b.score")).drop("__b")


def sentiment(df: DataFrame, text: Column, positive: list[str], negative: list[str]) -> DataFrame:
    """score: clamp((positive - negative) / sqrt(words) * 3); tone beyond 0.2 either way."""
    df = df.withColumn("__w", words(text))
    pos = F.size(F.filter("__w", lambda w: w.isin(positive)))
    neg = F.size(F.filter("__w", lambda w: w.isin(negative)))
    raw = (pos - neg) / F.sqrt(F.greatest(F.size("__w"), F.lit(1))) * 3
    df = df.withColumn("pos", pos).withColumn("neg", neg).withColumn("score", F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw)))
    tone = F.when(F.col("score") > 0.2, "positive").when(F.col("score") < -0.2, "negative").when((F.col("pos") > 0) & (F.col("neg") > 0), "mixed")
    return df.withColumn("tone", tone.otherwise("neutral")).drop("__w")


def terms(df: DataFrame, key: str, text: Column, least: int = 1) -> DataFrame:
    """key, term, tf."""
    return df.select(key, F.explode(words(text, least)).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def keywords(df: DataFrame, key: str, title: Column, body: Column, k: int = 6) -> DataFrame:
    """The k most frequent words of four letters or more, the title counted twice; ties by first place."""
    both = F.concat(words(title, 4), words(title, 4), words(body, 4))
    # texts are dealt out by key before they become words, so neither the count nor the ranking moves words
    t = df.repartition(key).select(key, F.posexplode(both).alias("at", "term")).groupBy(key, "term").agg(F.count("*").alias("n"), F.min("at").alias("at"))
    place = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "at"))
    return t.withColumn("place", place).where(F.col("place") <= k).select(key, "term", "n", "place")


def narrative_id(text: Column) -> Column:
    """The same for texts that share their first six long words in alphabetic order."""
    long_words = F.array_sort(F.array_distinct(words(text, 5)))
    return F.substring(F.md5(F.array_join(F.slice(long_words, 1, 6), " ")), 1, 8)


def topic_vector(text: Column, dims: list[list[str]]) -> Column:
    """Density of each dimension's words, scaled to length one, four decimals."""
    w = F.coalesce(words(text), F.array().cast("array<string>"))

    # counted in one pass over the words; what stands in a lambda is worked out again for every element, so the norm is bound first
    zero = F.array(*[F.lit(0.0)] * len(dims))
    raw = F.aggregate(w, zero, lambda n, x: F.array(*[n[i] + x.isin(d).cast("double") for i, d in enumerate(dims)]))
    bound = F.array(F.struct(raw.alias("n")))
    bound = F.transform(bound, lambda r: F.struct(r["n"].alias("n"), F.sqrt(F.aggregate(r["n"], F.lit(0.0), lambda a, x: a + x * x)).alias("norm")))
    return F.transform(bound, lambda r: F.transform(r["n"], lambda x: F.when(r["norm"] > 0, F.round(x / r["norm"], 4)).otherwise(0.0)))[0]


def hashed_bag(df: DataFrame, key: str, text: Column, dims: int = 64) -> DataFrame:
    """Words of three letters or more counted by a hash of dims slots, scaled to length one: key, slot, v."""
    t = terms(df, key, text, 3)
    slot = F.conv(F.substring(F.md5("term"), 31, 2), 16, 10).cast("int") % dims
    v = t.groupBy(key, slot.alias("slot")).agg(F.sum("tf").alias("n"))
    return v.withColumn("v", F.col("n") / F.sqrt(F.sum(F.col("n") * F.col("n")).over(W.partitionBy(key)))).drop("n")


def bm25(df: DataFrame, key: str, text: Column, query_terms: list[str], weight: Column | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Score of every text that holds a query term."""
    low = [t.lower() for t in query_terms]
    w = df.select(key, words(text).alias("w"), (weight if weight is not None else F.lit(1.0)).alias("weight"))
    stats = w.agg(F.count("*").alias("docs"), F.avg(F.size("w")).alias("mean"))
    tf = (
        w.select(key, "weight", F.size("w").alias("len"), F.explode("w").alias("term"))
        .where(F.col("term").isin(low))
        .groupBy(key, "term", "len", "weight")
        .agg(F.count("*").alias("tf"))
    )
    df_ = tf.groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log1p((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    joined = tf.join(F.broadcast(df_), "term").join(F.broadcast(stats), F.lit(True))
    return joined.groupBy(key).agg(F.sum(part * F.col("weight")).alias("score"))


def tfidf(df: DataFrame, key: str, text: Column, least: int = 3) -> DataFrame:
    """key, term, w: smooth inverse document frequency, each text scaled to length one."""
    t = terms(df.repartition(key), key, text, least)  # texts are dealt out by key, so that counting moves no words
    n = df.select(F.count("*")).scalar()
    docs = t.groupBy("term").agg(F.count("*").alias("df"))
    raw = t.join(docs, "term").withColumn("r", F.col("tf") * (F.log((1 + n) / (1 + F.col("df"))) + 1))
    return raw.withColumn("w", F.col("r") / F.sqrt(F.sum(F.col("r") * F.col("r")).over(W.partitionBy(key)))).select(key, "term", "w", "df")


#: Texts of a block, on average at most, and texts that are few enough for one.
BLOCK, FEW = 10_000, 500
#: Products that a task adds up at a time.
STEP = 4_000_000
#: Words of one block in so many of its texts or more that are multiplied as columns of a matrix, and how many at most.
SHARE, COLUMNS = 32, 1024


def packed(weights: DataFrame, key: str, w: str = "w") -> DataFrame:
    """key, sizes, words, w: a row a text of weights (key, term, w), its words' bytes and weights side by side. Written."""

    def run(batches):
        for x in batches:
            flat = x.column(1).values.cast(pa.large_string())
            off, raw = (np.frombuffer(b, t) if b is not None else np.empty(0, t) for b, t in zip(flat.buffers()[1:], (np.int64, np.uint8)))
            off, own, value = off[flat.offset :], x.column(1).offsets.to_numpy(), x.column(2).values.to_numpy()
            rows = list(zip(own.tolist(), own[1:].tolist()))
            sizes = [np.diff(off[a : b + 1]).astype(np.int32).tobytes() for a, b in rows]
            words = [raw[off[a] : off[b]].tobytes() for a, b in rows]
            yield pa.RecordBatch.from_arrays([x.column(0), *[pa.array(c, pa.binary()) for c in (sizes, words, [value[a:b].tobytes() for a, b in rows])]], names=["key", "sizes", "words", "w"])

    kind = dict(weights.dtypes)[key]
    # where weights lie by key already (tfidf), nothing travels for this
    each = weights.groupBy(F.col(key).alias("key")).agg(F.collect_list(F.struct("term", F.col(w).cast("double").alias("w"))).alias("x"))
    return settle(each.select("key", "x.term", "x.w").mapInArrow(run, f"key {kind}, sizes binary, words binary, w binary"))


class _Block:
    """Packed rows as arrays: the keys, and of every weight its row, word and value."""

    def __init__(self, rows: pa.Table):
        self.keys = rows["key"].to_numpy()
        raw = [b"".join(rows[c].to_pylist()) for c in ("sizes", "words", "w")]
        offsets = np.concatenate([[0], np.cumsum(np.frombuffer(raw[0], np.int32), dtype=np.int64)])
        self.words = pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(raw[1]))
        self.w = np.frombuffer(raw[2])
        self.row = np.repeat(np.arange(len(self.keys)), [len(x) // 8 for x in rows["w"].to_pylist()])


def _dots(one: _Block, other: _Block):
    """Of some rows of other at a time: the first one's number, and their cosines with all rows of one (a row each).

    Words of many texts are columns of a product of matrices, the products of all others are added up one by one.
    """
    many, n = len(one.keys), len(other.keys)
    coded = pa.chunked_array([one.words, other.words]).combine_chunks().dictionary_encode()
    term, term2 = np.split(coded.indices.to_numpy(), [len(one.w)])
    held = np.bincount(term, minlength=len(coded.dictionary))
    common = np.flatnonzero(held >= max(8, many / SHARE))
    common = common[np.argsort(-held[common], kind="stable")][:COLUMNS]
    column = np.full(len(held), -1)
    column[common] = np.arange(len(common))

    def split(x: _Block, t: np.ndarray) -> tuple:
        wide = column[t] >= 0
        return (x.row[wide], column[t][wide], x.w[wide]), (x.row[~wide], t[~wide], x.w[~wide])

    def matrix(row: np.ndarray, at: np.ndarray, w: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(row * len(common) + at, w, rows * len(common)).reshape(rows, len(common))

    (row, at, w), rare = split(one, term)
    wide = matrix(row, at, w, many).T
    by_term = np.argsort(rare[1], kind="stable")
    a, value = rare[0][by_term], rare[2][by_term]
    start = np.searchsorted(rare[1][by_term], np.arange(len(held) + 1))
    (row2, at2, w2), (b, term2, value2) = split(other, term2)
    pairs = np.diff(start)[term2]  # the products of each weight of the other block
    upto = np.concatenate([[0], np.cumsum(pairs)])
    rows, rows2 = (np.searchsorted(x, np.arange(n + 1)) for x in (b, row2))
    lo = 0
    while lo < n:
        hi = max(lo + 1, min(int(np.searchsorted(upto[rows], upto[rows[lo]] + STEP, "right")) - 1, lo + max(1, STEP // max(1, many)), n))
        r, r2 = slice(rows[lo], rows[hi]), slice(rows2[lo], rows2[hi])
        k = pairs[r]
        place = np.arange(k.sum()) + np.repeat(start[term2[r]] - (np.cumsum(k) - k), k)
        cell = np.repeat((b[r] - lo) * many, k) + a[place]
        dot = np.bincount(cell, value[place] * np.repeat(value2[r], k), (hi - lo) * many).reshape(hi - lo, many)
        if len(common):
            dot = dot + matrix(row2[r2] - lo, at2[r2], w2[r2], hi - lo) @ wide
        yield lo, dot
        lo = hi


def _reaching(one: pa.Table, other: pa.Table, least: float, same: bool) -> pa.Table:
    """a, b, cosine of the packed rows of two blocks whose cosine reaches least; of a block with itself each pair once."""
    one, other = _Block(one), _Block(other)
    if same:
        other = one
    left, right, value = [one.keys[:0]], [other.keys[:0]], [np.empty(0)]
    for lo, dot in _dots(one, other):
        y, x = np.nonzero(dot >= least)
        if same:
            x, y = x[x < y + lo], y[x < y + lo]
        left.append(one.keys[x]), right.append(other.keys[y + lo]), value.append(dot[y, x])
    return pa.table({"a": np.concatenate(left), "b": np.concatenate(right), "cosine": np.concatenate(value)})


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.withColumn("own", F.pmod(F.xxhash64("key"), F.lit(blocks)).cast("int"))


def _block_count(texts: int, spread: int) -> int:
    """Blocks of at most BLOCK texts; up to `spread` of them while they have more than FEW."""
    return max(1, -(-texts // BLOCK), min(spread, texts // FEW))


PACKED = ["i", "j", "key", "sizes", "words", "w"]


def _meet(left: DataFrame, right: DataFrame, tasks: int, go, columns: list[str]) -> DataFrame:
    """go(i, j, rows, rows) for each pair of blocks that left and right hold rows for: two columns of the kind of key, then doubles."""
    whole = dict(left.dtypes)["key"]
    kinds = [whole, whole, *["double"] * (len(columns) - 2)]
    none = pa.table({c: pa.array([], {"int": pa.int32(), "double": pa.float64()}.get(t, pa.int64())) for c, t in zip(columns, kinds)})
    each = [x.select(*[F.col(c).alias(c) for c in PACKED]).repartition(tasks, "i", "j").groupBy("i", "j") for x in (left, right)]

    def run(block: tuple, one: pa.Table, other: pa.Table) -> pa.Table:
        if not one.num_rows or not other.num_rows:
            return none
        return go(*(x.as_py() for x in block), one, other)

    return each[0].cogroup(each[1]).applyInArrow(run, ", ".join(f"{c} {t}" for c, t in zip(columns, kinds)))


def similar_pairs(weights: DataFrame, key: str, least: float) -> DataFrame:
    """Pairs whose cosine reaches least > 0; weights: key (a whole number), term, w, df, each text of length one.

    All pairs are compared, in blocks: texts are dealt out by hash to blocks of about BLOCK, a row each, and a task
    compares two blocks, some rows at a time. So a text travels as often as there are blocks, products of pairs never
    travel, and a task holds two blocks and the pairs it has found. Words of one text alone meet none and are left out.
    """
    held = packed(weights.where("df > 1"), key)
    spread = int((2 * int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))) ** 0.5)
    blocks = _block_count(held.count(), spread)
    own = _dealt(held, blocks)
    left = own.withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence(F.col("own"), F.lit(blocks - 1))))
    right = own.withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("own"))))
    # as many tasks as pairs of blocks, whatever the number of partitions is set to
    met = _meet(left, right, blocks * (blocks + 1) // 2, lambda i, j, one, other: _reaching(one, other, least, i == j), ["a", "b", "cosine"])
    return met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "cosine")


def _likest(rows: pa.Table, seeds: pa.Table, least: float, k: int) -> pa.Table:
    """seed, key, similarity and near (nine decimals): of each seed the k likest other rows, by near and key."""
    one, other = _Block(rows), _Block(seeds)
    left, right, value = [other.keys[:0]], [one.keys[:0]], [np.empty(0)]
    for lo, dot in _dots(one, other):
        y, x = np.nonzero(dot >= least)
        apart = other.keys[y + lo] != one.keys[x]
        x, y = x[apart], y[apart]
        s = dot[y, x]
        order = np.lexsort((one.keys[x], -np.round(s, 9), y))
        x, y, s = x[order], y[order], s[order]
        some = np.arange(len(y)) - np.searchsorted(y, y) < k
        left.append(other.keys[y[some] + lo]), right.append(one.keys[x[some]]), value.append(s[some])
    s = np.concatenate(value)
    return pa.table({"seed": np.concatenate(left), "key": np.concatenate(right), "similarity": s, "near": np.round(s, 9)})


def similar_to(weights: DataFrame, key: str, w: str, seeds: DataFrame, least: float, k: int) -> DataFrame:
    """seed, key, similarity and rank: of each seed (key) the k other rows whose cosine is highest, if it reaches least > 0.

    Texts are dealt out to blocks and seeds to blocks of their own; a task compares one of each and hands on k rows a
    seed. So texts travel as often as there are blocks of seeds, seeds as often as there are blocks of texts, and
    products of pairs never.
    """
    held = packed(weights, key, w)
    asked = settle(held.join(seeds.select(F.col(key).alias("key")).distinct(), "key", "left_semi"))
    spread = int(held.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    across, down = _block_count(held.count(), spread), _block_count(asked.count(), 1)
    left = _dealt(held, across).withColumn("i", F.col("own")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    right = _dealt(asked, down).withColumn("j", F.col("own")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    found = _meet(left, right, across * down, lambda i, j, one, other: _likest(one, other, least, k), ["seed", "key", "similarity", "near"])
    rank = F.row_number().over(W.partitionBy("seed").orderBy(F.desc("near"), "key"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("seed", F.col("key").alias(key), "similarity", "rank")


def chunks(df: DataFrame, key: str, text: Column, most: int = 1200, cap: int = 100) -> DataFrame:
    """Paragraphs packed in order into chunks of at most `most` characters: key, place, chunk."""
    parts = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda p: F.trim(p)), lambda p: p != "")
    zero = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(acc: Column, p: Column) -> Column:
        joined = F.when(acc["open"] == "", p).otherwise(F.concat(acc["open"], F.lit("\n\n"), p))
        fits = (F.length(joined) <= most) | (acc["open"] == "")
        return F.struct(
            F.when(fits, joined).otherwise(p).alias("open"),
            F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"),
        )

    packed = F.aggregate(parts, zero, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))
    return df.select(key, F.posexplode(F.slice(packed, 1, cap)).alias("place", "chunk"))


def page_text(html: Column, most: int = 8000) -> Column:
    """The page's text: scripts, styles and tags dropped, a few entities decoded, spaces collapsed."""
    t = F.regexp_replace(html, r"(?is)<(script|style)[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"<[^>]*>", " ")
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.substring(F.trim(F.regexp_replace(t, r"\s+", " ")), 1, most)


def conversation_documents(turns: DataFrame, least: int = 50, part: int = 2000, first: int = 10) -> DataFrame:
    """One document a conversation: its first assistant turns longer than `least`, each cut to `part`."""
    long_turns = turns.where((F.col("role") == "assistant") & (F.length("text") > least))
    place = F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "text"))
    kept = long_turns.withColumn("place", place).where(F.col("place") <= first)
    parts = F.array_sort(F.collect_list(F.struct("place", F.substring("text", 1, part).alias("t"))))
    return kept.groupBy("conv_id").agg(F.count("*").alias("n"), F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("document"))


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    return F.try_divide(dot, norm(a) * norm(b))
