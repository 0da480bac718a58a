"""Operator 5, quality rules: a threshold table compiled into one projection.

Every metric is a built-in column expression over the whole text; the rules are
rows of a table that become one array of failed rule names. No user functions,
no shuffle.

Defined cases: a null text has no words, lines or symbols; an empty text fails
the word count; extra columns pass through and clash with nothing, since the
working columns live in one struct that is dropped at the end (the output
columns replace input columns of the same name); repeated rows are judged each
on its own; an empty table gives an empty result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table

WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
WINDOW = 8

# Frequent function words of English, French, German and Spanish.
STOP_WORDS = (
    "the", "be", "to", "of", "and", "that", "have", "with", "is", "in", "it", "for", "on", "was", "as", "are", "this",
    "le", "la", "les", "de", "des", "du", "et", "un", "une", "en", "que", "qui", "dans", "pour", "pas", "sur", "par",
    "der", "die", "das", "und", "ist", "nicht", "ein", "eine", "zu", "den", "von", "mit", "sich", "auf", "für", "im",
    "el", "los", "las", "y", "del", "se", "por", "con", "una", "su", "para", "es", "al", "lo", "como", "no",
)


class Rule(NamedTuple):
    """A document fails the rule if its metric is below low or above high."""

    name: str
    metric: str
    low: float | None = None
    high: float | None = None


#: The production table. Ratios are per word or per line.
RULES = (
    Rule("too_few_words", "n_words", low=20),
    Rule("repeated_windows", "repeat_ratio", high=0.30),
    Rule("word_length", "mean_word_chars", low=2, high=15),
    Rule("symbols", "symbol_ratio", high=0.25),
    Rule("exclamations", "exclaim_ratio", high=0.5),
    Rule("stop_words", "n_stop_words", low=1),
    Rule("duplicate_lines", "dup_line_ratio", high=0.5),
    Rule("bullet_lines", "bullet_ratio", high=0.9),
    Rule("ellipsis_lines", "ellipsis_ratio", high=0.3),
)

#: Rules whose failing is the base verdict.
BASE = ("too_few_words", "repeated_windows")


def _ratio(over: Column, under: Column) -> Column:
    return F.when(under > 0, over / under).otherwise(F.lit(0.0))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with one more struct column __m of all metrics."""
    body = F.coalesce(F.col(text), F.lit(""))
    cased = [w.capitalize() for w in STOP_WORDS]
    stops = F.array(*[F.lit(w) for w in dict.fromkeys([*STOP_WORDS, *cased])])
    df = docs.withColumn("__w", F.regexp_extract_all(body, F.lit(WORD), F.lit(0))).withColumn(
        "__l", F.filter(F.split(body, "\n", -1), lambda x: x.rlike(WORD))
    )
    # one 64-bit hash per window of eight words; equal windows have equal hashes
    windows = F.transform(
        F.sequence(F.lit(1), F.size("__w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("__w"), i, WINDOW))
    )
    df = df.withColumn("__h", F.when(F.size("__w") >= WINDOW, windows).otherwise(F.array().cast("array<bigint>")))
    # only texts in which some window repeats sort their windows
    placed = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = df.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), placed))
    m = F.size("__s")
    twins = F.zip_with(
        F.slice("__s", 1, m - 1),
        F.slice("__s", 2, m - 1),
        lambda a, b: F.when(a["h"] == b["h"], F.array(a["i"], b["i"])).otherwise(F.array().cast("array<int>")),
    )
    starts = F.array_sort(F.array_distinct(F.flatten(twins)))
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    covered = F.aggregate(
        starts,
        zero,
        lambda acc, i: F.struct(
            (i + WINDOW).alias("end"), (acc["n"] + i + WINDOW - F.greatest(acc["end"], i)).alias("n")
        ),
        lambda acc: acc["n"],
    )
    n_words, n_lines = F.size("__w").cast("long"), F.size("__l").cast("long")
    bare = F.translate(body, " \t\n\x0b\x0c\r", "")
    counts = {
        "n_words": n_words,
        "word_chars": F.length(bare).cast("long"),
        "n_symbols": (F.length(body) - F.length(F.translate(body, SYMBOLS, ""))).cast("long"),
        "n_exclaim": (F.length(body) - F.length(F.translate(body, "!", ""))).cast("long"),
        "n_lines": n_lines,
        "n_dup_lines": n_lines - F.size(F.array_distinct("__l")),
        "n_bullets": F.size(F.filter("__l", lambda x: x.rlike(r"^[\x20\x09]*[-*•]"))).cast("long"),
        "n_ellipsis": F.size(F.filter("__l", lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long"),
        "n_stop_words": F.size(F.array_distinct(F.transform(F.array_intersect("__w", stops), F.lower))).cast("long"),
        "n_repeat_words": F.when(F.col("__s").isNull(), F.lit(0)).otherwise(covered).cast("long"),
    }
    df = df.withColumn("__c", F.struct(*[c.alias(k) for k, c in counts.items()]))
    c = F.col("__c")
    ratios = {
        "repeat_ratio": _ratio(c["n_repeat_words"], c["n_words"]),
        "mean_word_chars": _ratio(c["word_chars"], c["n_words"]),
        "symbol_ratio": _ratio(c["n_symbols"], c["n_words"]),
        "exclaim_ratio": _ratio(c["n_exclaim"], c["n_words"]),
        "dup_line_ratio": _ratio(c["n_dup_lines"], c["n_lines"]),
        "bullet_ratio": _ratio(c["n_bullets"], c["n_lines"]),
        "ellipsis_ratio": _ratio(c["n_ellipsis"], c["n_lines"]),
    }
    parts = [c[k].alias(k) for k in counts] + [r.alias(k) for k, r in ratios.items()]
    return df.withColumn("__m", F.struct(*parts)).drop("__w", "__l", "__h", "__s", "__c")


def verdict(metrics: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The names of the rules that fail, as an array compiled from the table."""
    checks = []
    for rule in rules:
        fails = [metrics[rule.metric] < rule.low] if rule.low is not None else []
        fails += [metrics[rule.metric] > rule.high] if rule.high is not None else []
        bad = fails[0] if len(fails) == 1 else fails[0] | fails[1]
        # the base limit on repeated windows is held in whole numbers, so that no rounding decides it
        if rule.name == "repeated_windows" and rule.high is not None:
            bad = 100 * metrics["n_repeat_words"] > round(100 * rule.high) * metrics["n_words"]
        checks.append(F.when(bad, F.lit(rule.name)))
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """docs with quality_metrics, failed_rules and kept."""
    df = measure(docs, text).withColumn("failed_rules", verdict(F.col("__m"), rules))
    return df.withColumn("kept", F.size("failed_rules") == 0).withColumnRenamed("__m", "quality_metrics")


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that no rule rejects, with their own columns only.

    A row is kept by exploding an array of one or no element: a filter would be
    pushed below the projections, and each metric would be computed again
    wherever the filter's expression names it.
    """
    judged = judge(docs, rules)
    names = [F.col(f"`{c}`") for c in docs.columns]
    return judged.select(*names, F.explode(F.array_repeat(F.lit(1), F.col("kept").cast("int"))).alias("__one")).drop("__one")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = judge(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    m = F.col("quality_metrics")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = F.arrays_overlap("failed_rules", F.array(*[F.lit(x) for x in BASE]))
    return df.select(
        "doc_id",
        *[m[k].alias(k) for k in names],
        failed.alias("base_failed"),
        F.array_join("failed_rules", ",").alias("failed_rules"),
        "kept",
    )


def _sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys([*STOP_WORDS, *[w.capitalize() for w in STOP_WORDS]]))
    checks = []
    for rule in RULES:
        parts = [f"{rule.metric} < {rule.low}"] if rule.low is not None else []
        parts += [f"{rule.metric} > {rule.high}"] if rule.high is not None else []
        bad = " OR ".join(parts)
        if rule.name == "repeated_windows":
            bad = f"100 * n_repeat_words > {round(100 * rule.high)} * n_words"
        checks.append(f"CASE WHEN {bad} THEN '{rule.name}' END")
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), a AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '{WORD}') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS l
  FROM d
), win AS (
  SELECT rid, i, list_slice(w, i, i + {WINDOW - 1}) AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM a WHERE len(w) >= {WINDOW})
), rep AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM win) WHERE c > 1
), cov AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + {WINDOW})) AS p FROM rep) GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(l) AS BIGINT) AS n_lines,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(length(t) - length(replace(t, '!', '')) AS BIGINT) AS n_exclaim,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullets,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
         len(list_distinct(list_transform(list_filter(w, lambda x: x IN ({stops})), lambda x: lower(x)))) AS n_stop_words,
         CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM a LEFT JOIN cov USING (rid)
), r AS (
  SELECT *, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS mean_word_chars,
         CASE WHEN n_words > 0 THEN n_symbols / n_words ELSE 0 END AS symbol_ratio,
         CASE WHEN n_words > 0 THEN n_exclaim / n_words ELSE 0 END AS exclaim_ratio,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_ratio,
         CASE WHEN n_lines > 0 THEN n_bullets / n_lines ELSE 0 END AS bullet_ratio,
         CASE WHEN n_lines > 0 THEN n_ellipsis / n_lines ELSE 0 END AS ellipsis_ratio
  FROM m
), f AS (
  SELECT *, concat_ws(',', {", ".join(checks)}) AS failed_rules FROM r
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, failed_rules, failed_rules = '' AS kept
FROM f
"""


ORACLE_SQL = _sql()
