"""Operator 13, phrase collocation mining over sorted count streams.

Texts are cut into pieces at marks and line breaks and pieces into words. Counts
of phrases of one to four words are made level by level: a phrase of k words is
counted only where both its phrases of k-1 words are frequent (at least LEAST
occurrences), which loses no frequent phrase. The frequent ones of the level
before go to tasks as a set of hash slots of fixed size; what passes it by
chance is dropped when the counts are summed.

The counts of all levels form one stream. In prefix order (words from the first)
a phrase stands behind its own first words and before the phrases that extend
it, so one pass in step through all levels gives every phrase the counts of its
first 1, 2 and 3 words and the highest count of its extensions to the right; no
lookup by hash. The same pass in suffix order (words from the last) gives the
counts of its last words and its extensions to the left. Each order is dealt out
by ranges of whole phrases, so a word that starts a third of all phrases is
spread; what a range needs of those before it (the last phrase of each level)
and gives back to them (extensions of these) is three rows a range.

A word is known by 64 bits of hash of its language and bytes. While the words are
counted each hash is checked for a second word; should there be one, all is done
anew with another hash function, so phrases are told apart exactly.

Defined cases: a null text is empty; a null lang is `und`; repeated rows count
each; ties in score are ranked by count, then by phrase; extra columns are not
read; an empty table gives an empty result. Texts are taken whole; a batch is
worked in slices of about SLICE_BYTES, and a longer text stands alone.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens as T
from tidemark.llm.common import Members, read_table, shared_folder, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

LEAST = 30
LONGEST = 4
TOP = 2000
#: Percent of a phrase's count that a longer one must have to stand for it.
COVER = 80
SCALE = 2_000_000
SLICE_BYTES = 4_000_000
SET_BITS = 26
RANGE_ROWS = 200_000
PAD = -(1 << 63)  # no word's hash; sorts first

_ENDS = ".,;:!?\n\x0b\x0c\r"
_PIECE_END = np.array([chr(b) in _ENDS for b in range(256)])
_WORD_BYTES = np.array([chr(b) not in _ENDS + " \t" for b in range(256)])
LANES = [f"h{i}" for i in range(1, LONGEST + 1)]


def _table(salt: int) -> np.ndarray:
    """A permutation of the byte values: another hash function for each salt."""
    return np.arange(256, dtype=np.uint8) if not salt else np.random.default_rng(salt).permutation(256).astype(np.uint8)


def _lang_hashes(langs: pa.Array, salt: int) -> np.ndarray:
    texts = T.texts_of(langs, lower=False)
    data = _table(salt)[texts.data]
    return T.ranges(T.prefix_sums(data), texts.offsets[:-1], texts.offsets[1:])


def words_in(langs: pa.Array, column: pa.Array, salt: int):
    """Of every word: its start and end in the texts' bytes, its hash with its language, its text's number and its piece's."""
    texts = T.texts_of(column)
    words = T.words_of(texts, _WORD_BYTES)
    doc = np.repeat(np.arange(len(column)), np.diff(words.bounds))
    h = T.ranges(T.prefix_sums(_table(salt)[texts.data]), words.start, words.end)
    h = T.mix(h ^ T.mix(_lang_hashes(langs, salt))[doc]) if len(doc) else h
    piece = np.cumsum(_PIECE_END[texts.data])[words.start] + doc if len(doc) else doc
    return texts, words, h, doc, piece


def _grouped(key: np.ndarray, lanes: list[np.ndarray]):
    """An order in which equal lanes meet (key is a function of them), the first of each run and the runs' lengths."""
    order = np.argsort(key, kind="stable")
    change = np.ones(len(order), dtype=bool)
    if len(order):
        change[1:] = np.any([x[order][1:] != x[order][:-1] for x in lanes], axis=0)
    first = np.flatnonzero(change)
    return order[first], np.diff(np.r_[first, len(order)])


def _slices(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        yield from T.slices(batch, 1, SLICE_BYTES)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")


def vocabulary(docs: DataFrame, salt: int) -> DataFrame:
    """h1, f, lang, word and clash (a second word has this hash) of every word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            texts, words, h, doc, _ = words_in(part.column(0), part.column(1), salt)
            at, count = _grouped(h, [h])
            size = words.end[at] - words.start[at]
            ends = np.r_[0, np.cumsum(size)]
            data = texts.data[np.arange(ends[-1]) + np.repeat(words.start[at] - ends[:-1], size)]
            word = pa.Array.from_buffers(pa.large_string(), len(at), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)]).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[at].view(np.int64)), pa.array(count.astype(np.int64)), part.column(0).take(pa.array(doc[at])), word],
                names=["h1", "f", "lang", "word"],
            )

    rows = _source(docs).mapInArrow(run, "h1 long, f long, lang string, word string")
    name = F.struct("lang", "word")
    return (
        rows.groupBy("h1").agg(F.sum("f").alias("f"), F.min(name).alias("low"), F.max(name).alias("high"))
        .select("h1", "f", "low.lang", "low.word", ((F.col("low") != F.col("high")) | (F.col("h1") == PAD)).alias("clash"))
    )


def _key(lanes: list[np.ndarray]) -> np.ndarray:
    """One hash for a phrase."""
    out = np.zeros(len(lanes[0]), dtype=np.uint64)
    for x in lanes:
        out = T.mix(out * T.BASE + x)
    return out


def keys_of(phrases: DataFrame, k: int) -> DataFrame:
    """The column key of phrases of k words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            key = _key([np.asarray(x).view(np.uint64) for x in b.columns])
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64))], names=["key"])

    return phrases.select(*LANES[:k]).mapInArrow(run, "key long")


def counted(docs: DataFrame, k: int, below: Members, least: int, salt: int) -> DataFrame:
    """h1 to hk and f of the phrases of k words with f >= least. below: the frequent phrases of k - 1 words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            _, _, h, _, piece = words_in(part.column(0), part.column(1), salt)
            n = max(len(h) - k + 2, 0)
            known = below.inside_hashes(_key([h[i : i + n] for i in range(k - 1)]))
            m = max(n - 1, 0)
            at = np.flatnonzero(known[:m] & known[1:] & (piece[:m] == piece[k - 1 :]))
            lanes = [h[at + i] for i in range(k)]
            first, count = _grouped(_key(lanes), lanes)
            yield pa.RecordBatch.from_arrays([*(pa.array(x[first].view(np.int64)) for x in lanes), pa.array(count.astype(np.int64))], names=[*LANES[:k], "f"])

    rows = _source(docs).mapInArrow(run, ", ".join(f"{x} long" for x in LANES[:k]) + ", f long")
    return rows.groupBy(*LANES[:k]).agg(F.sum("f").alias("f")).where(F.col("f") >= least)


def streams(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """The vocabulary, and the counts of all frequent phrases: n (words), h1 to h4 (PAD beyond n) and f."""
    salt = 0
    while True:
        words = stored(vocabulary(docs, salt))
        if words.where("clash").isEmpty():
            break
        salt += 1
    level = words.where(F.col("f") >= least).select("h1", "f")
    every = []
    for k in range(1, LONGEST + 1):
        if k > 1:
            level = stored(counted(docs, k, Members(keys_of(level, k - 1), "key", bits=SET_BITS, hashed=True), least, salt))
        every.append(level.select(F.lit(k).alias("n"), *(F.col(x) if i < k else F.lit(PAD).alias(x) for i, x in enumerate(LANES)), "f"))
    out = every[0]
    for x in every[1:]:
        out = out.unionByName(x)
    return words, out


def _in_step(n: np.ndarray, f: np.ndarray, before: list[int]):
    """Of rows in prefix order: counts of their first 1, 2 and 3 words, and the highest count of their extensions by a word.

    before: the count of the last phrase of 1, 2 and 3 words in the ranges before. Also, for these, their highest extension here (or -1).
    """
    row = np.arange(len(n))
    counts, best, back = [], np.zeros(len(n), dtype=np.int64), []
    for k in range(1, LONGEST):
        last = np.maximum.accumulate(np.where(n == k, row, -1)) if len(n) else row
        counts.append(np.where(n < k, 0, np.where(last >= 0, f[last], before[k - 1])))
        longer = np.flatnonzero(n == k + 1)
        owner = last[longer]
        back.append(int(f[longer[owner < 0]].max(initial=-1)))
        longer, owner = longer[owner >= 0], owner[owner >= 0]
        first = np.flatnonzero(np.r_[True, np.diff(owner) > 0]) if len(owner) else owner
        if len(first):
            best[owner[first]] = np.maximum.reduceat(f[longer], first)
    return counts, best, back


def extended(rows: DataFrame, lanes: list[str], names: list[str], best: str, ranges: int) -> DataFrame:
    """rows (n, h1.., f, more) with the counts of their first words by lanes as names, and the highest count of an extension as best."""
    if rows.sparkSession.sparkContext.getCheckpointDir() is None:
        rows.sparkSession.sparkContext.setCheckpointDir(shared_folder(rows.sparkSession))
    # checkpoint() keeps the partitions apart, so a range knows its number
    dealt = rows.repartitionByRange(ranges, *lanes).sortWithinPartitions(*lanes).checkpoint()
    last = [F.max(F.when(F.col("n") == k, F.struct(*lanes, "f"))).alias(f"last{k}") for k in range(1, LONGEST)]
    held = [None] * (LONGEST - 1)
    carry: dict[int, list] = {}
    for r in dealt.groupBy(F.spark_partition_id().alias("part")).agg(*last).orderBy("part").collect():  # a row for each range
        carry[r.part] = list(held)
        held = [r[f"last{k + 1}"] or held[k] for k in range(LONGEST - 1)]
    fields = [*dealt.columns, *names, best, "back"]
    kinds = {f.name: pa.int64() for f in dealt.schema} | {"n": pa.int32()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)  # one range, about RANGE_ROWS rows
        before = carry[TaskContext.get().partitionId()]
        n, f = (np.asarray(table.column(x)) for x in ("n", "f"))
        counts, top, back = _in_step(n, f, [x["f"] if x else 0 for x in before])
        cols = [*table.columns, *map(pa.array, counts), pa.array(top), pa.array(np.zeros(len(n), dtype=bool))]
        yield from pa.Table.from_arrays([pa.chunked_array(c) if isinstance(c, pa.Array) else c for c in cols], names=fields).combine_chunks().to_batches()
        given = [(x, b) for x, b in zip(before, back, strict=True) if b >= 0]
        if given:
            cols = [pa.array([x[c] if c in lanes else 0 for x, _ in given], kinds[c]) for c in table.column_names]
            zeros = pa.array([0] * len(given), pa.int64())
            cols += [*[zeros for _ in names], pa.array([b for _, b in given], pa.int64()), pa.array([True] * len(given))]
            yield pa.RecordBatch.from_arrays(cols, names=fields)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema) + "".join(f", {x} long" for x in (*names, best)) + ", back boolean"
    out = stored(dealt.mapInArrow(run, schema))
    given = out.where("back").groupBy(*lanes).agg(F.max(best).alias("given"))  # at most three rows a range
    return (
        out.where("not back").join(F.broadcast(given), lanes, "left")
        .withColumn(best, F.greatest(best, F.coalesce("given", F.lit(0)))).drop("given", "back")
    )


def scored(phrases: DataFrame) -> DataFrame:
    """n, h1 to h4, a, l, r and score of the candidates that no longer one stands for. phrases: the stream of counts."""
    size = phrases.count()
    ranges = max(1, -(-size // RANGE_ROWS))
    left = extended(phrases, LANES, ["p1", "p2", "p3"], "right", ranges)
    # the words from the last to the first
    n = F.col("n")
    turned = [F.coalesce(*(F.when(n == i + j, F.col(LANES[j - 1])) for j in range(1, LONGEST + 1 - i)), F.lit(PAD)).alias(f"g{i + 1}") for i in range(LONGEST)]
    both = extended(left.select("*", *turned), [f"g{i + 1}" for i in range(LONGEST)], ["s1", "s2", "s3"], "left", ranges)
    whole = lambda c: c.cast("decimal(20,0)")
    longer = F.greatest("right", "left")
    kept = both.where((n > 1) & ~(whole(longer) * 100 >= whole(F.col("f")) * COVER)).withColumnRenamed("f", "a")

    def cut(k: int) -> Column:
        """The phrase cut after k words; sorts by score, then by k."""
        rest = F.coalesce(*(F.when(n == k + m, F.col(f"s{m}")) for m in range(1, LONGEST + 1 - k)))
        score = F.expr(f"cast(a as decimal(20,0)) * {SCALE}").cast("decimal(30,0)")
        kept_l = F.col(f"p{k}")
        return F.when(n > k, F.struct(score.alias("top"), (whole(kept_l) + whole(rest)).alias("low"), F.lit(k).alias("k"), kept_l.alias("l"), rest.alias("r")))

    cuts = F.filter(F.array(*(cut(k) for k in range(1, LONGEST))), lambda c: c.isNotNull())
    each = kept.withColumn("cuts", cuts)
    best = F.expr("array_min(transform(cuts, c -> struct(c.top div c.low as score, c.k, c.l, c.r)))")
    return each.withColumn("cut", best).select("n", *LANES, "a", "cut.l", "cut.r", "cut.score")


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first `top` phrases."""
    words, phrases = streams(docs, least)
    found = stored(scored(stored(phrases)))
    lexicon = words.where(F.col("f") >= least).select(F.col("h1").alias("h"), "lang", "word")
    place = F.posexplode(F.slice(F.array(*LANES), 1, F.col("n"))).alias("place", "h")
    texts = (
        found.select(*LANES, "n", place).join(lexicon, "h").groupBy(*LANES)
        .agg(F.max("lang").alias("lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    )
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = found.drop("n").join(texts, LANES).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", F.col("score").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


def _parts(n: int) -> str:
    pieces = (f"SELECT lang, w, {n} AS n, unnest(range(1, len(w) - {n} + 2)) AS s FROM pieces WHERE len(w) >= {n}",)
    return f"SELECT lang, n, array_to_string(w[s : s + {n - 1}], ' ') AS phrase FROM ({pieces[0]})"


def _cuts() -> str:
    rows = []
    for n in range(2, LONGEST + 1):
        for k in range(1, n):
            rows.append(
                f"SELECT c.lang, c.phrase, {k} AS k, x.f AS l, y.f AS r FROM cand c"
                f" JOIN counts x ON x.lang = c.lang AND x.n = {k} AND x.phrase = array_to_string(string_split(c.phrase, ' ')[1:{k}], ' ')"
                f" JOIN counts y ON y.lang = c.lang AND y.n = {n - k} AND y.phrase = array_to_string(string_split(c.phrase, ' ')[{k + 1}:{n}], ' ')"
                f" WHERE c.n = {n}"
            )
    return " UNION ALL ".join(rows)


ORACLE_SQL = f"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
    SELECT coalesce(lang, 'und') AS lang,
      unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents)
),
counts AS (SELECT lang, n, phrase, count(*) AS f FROM ({" UNION ALL ".join(_parts(n) for n in range(1, LONGEST + 1))}) GROUP BY ALL),
cand AS (SELECT * FROM counts WHERE n > 1 AND f >= {LEAST}),
covered AS (
  SELECT DISTINCT x.lang, x.phrase FROM cand x JOIN (
    SELECT lang, f, unnest([array_to_string(w[i : i + m - 1], ' ') FOR i IN range(1, len(w) - m + 2)]) AS inner_phrase
    FROM (SELECT lang, f, string_split(phrase, ' ') AS w, unnest(range(2, n)) AS m FROM cand WHERE n > 2)
  ) y ON x.lang = y.lang AND x.phrase = y.inner_phrase AND 100 * y.f >= {COVER} * x.f
),
scores AS (SELECT t.*, (CAST({SCALE} AS HUGEINT) * c.f) // (t.l + t.r) AS score, c.f AS a FROM ({_cuts()}) t JOIN cand c USING (lang, phrase)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS first FROM scores) WHERE first = 1),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best
  WHERE (lang, phrase) NOT IN (SELECT (lang, phrase) FROM covered)
),
totals AS (SELECT lang, sum(f) AS n FROM counts WHERE n = 1 GROUP BY lang)
SELECT lang, rank, phrase, a, l, r, CAST(totals.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {TOP}
"""
