"""Operator 6, secret scans, in built-in functions only.

Three fixed patterns give the base spans. A further kind, entropy, takes
candidate strings (long runs of key characters that hold a digit) and slides a
window over each: the window's Shannon entropy is kept by incremental counts (a
count per character of the class; one character enters, one leaves) in a fold
over the characters. The highest window decides against the threshold of the
candidate's character class; an allow-list suppresses known harmless forms.

Places come from two aligned arrays: the text split at the pattern gives the
gaps, the pattern's matches fill them; their lengths add up to offsets in code
points. No shuffle, no Python.

Defined cases: a null text is empty and has no spans; candidates that overlap a
base span are not reported again; extra columns pass through scan() untouched
(its output columns replace input columns of the same name); repeated rows are
scanned each on its own; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import read_table

# The base patterns.
_KEYWORD = (
    "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]"
    "|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
)
ASSIGN = _KEYWORD + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
LEAST_ASSIGNED = 6

_RUN = "A-Za-z0-9+/_=-"
#: A whole run of at least WINDOW key characters with a digit in it.
CANDIDATE = rf"(?<![{_RUN}])(?=[A-Za-z+/_=-]*[0-9])[{_RUN}]{{20,}}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WINDOW = 20
#: Bits a character that the highest window must reach, by the candidate's character class.
THRESHOLDS = (("[0-9a-fA-F]+", 3.0), ("[A-Z0-9]+", 3.6), ("[a-z0-9]+", 3.6), (f"[{_RUN}]+", 3.8))
#: Candidates that match one of these are harmless: numbers and dates, UUIDs, placeholders, words joined by marks.
ALLOWED = (
    r"[0-9+/_=-]+",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    r"(?i).*(example|placeholder|dummy|xxxx|0000000|1234567).*",
    r"[A-Za-z]+([+/_=-]+([A-Za-z]+|[0-9]{1,4}))+",
)
KINDS = ("assign", "access", "hex", "entropy")


def _places(gaps: Column, found: Column) -> Column:
    """Start and end of every match, from the gaps before them."""
    steps = F.zip_with(
        F.slice(gaps, 1, F.size(found)),
        found,
        lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("size")),
    )
    none = F.array().cast("array<struct<s:int,e:int>>")
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("s"), (start + x["size"]).alias("e"))
        return F.struct((start + x["size"]).alias("at"), F.array_append(acc["out"], span).alias("out"))

    return F.aggregate(steps, zero, step, lambda acc: acc["out"])


def _nlogn(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def highest_entropy(text: Column, window: int = WINDOW) -> Column:
    """The highest Shannon entropy (bits a character) of any window of a string of ALPHABET's characters.

    The state is a count per character and the sum of n*log2(n) over the counts;
    each step changes two counts, so the sum is mended, not made anew.
    """
    codes = F.transform(F.split(text, ""), lambda c: F.instr(F.lit(ALPHABET), c))
    codes = F.filter(codes, lambda c: c > 0)
    pairs = F.zip_with(
        codes,
        F.slice(F.concat(F.array_repeat(F.lit(0), window), codes), 1, F.size(codes)),
        lambda a, b: F.struct(a.alias("enter"), b.alias("leave")),
    )
    zero = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET)).alias("n"),
        F.lit(0.0).alias("sum"),
        F.lit(0).alias("seen"),
        F.lit(0.0).alias("best"),
    )

    def step(acc: Column, x: Column) -> Column:
        same = x["enter"] == x["leave"]
        n_in = F.element_at(acc["n"], x["enter"])
        n_out = F.element_at(acc["n"], F.greatest(x["leave"], F.lit(1)))
        gain = _nlogn(n_in + 1) - _nlogn(n_in)
        loss = F.when(x["leave"] > 0, _nlogn(n_out) - _nlogn(n_out - 1)).otherwise(F.lit(0.0))
        total = acc["sum"] + F.when(same, F.lit(0.0)).otherwise(gain - loss)
        entropy = F.log2(F.lit(float(window))) - total / window
        full = acc["seen"] + 1 >= window
        return F.struct(
            F.transform(
                acc["n"], lambda v, j: v + (j + 1 == x["enter"]).cast("int") - (j + 1 == x["leave"]).cast("int")
            ).alias("n"),
            total.alias("sum"),
            (acc["seen"] + 1).alias("seen"),
            F.when(full, F.greatest(acc["best"], entropy)).otherwise(acc["best"]).alias("best"),
        )

    return F.aggregate(pairs, zero, step, lambda acc: acc["best"])


def _suspicious(text: Column) -> Column:
    allowed = F.lit(False)
    for pattern in ALLOWED:
        allowed = allowed | text.rlike(f"^(?:{pattern})$")
    level = F.lit(THRESHOLDS[-1][1])
    for pattern, bits in reversed(THRESHOLDS[:-1]):
        level = F.when(text.rlike(f"^(?:{pattern})$"), F.lit(bits)).otherwise(level)
    return ~allowed & (highest_entropy(text) >= level)


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with secret_spans: array of (kind, start, end), by start and then kind as in KINDS."""
    body = F.coalesce(F.col(text), F.lit(""))
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "entropy": CANDIDATE}
    found = F.struct(*[F.regexp_extract_all(body, F.lit(p), F.lit(0)).alias(k) for k, p in patterns.items()])
    df = docs.withColumn("__f", found)
    f = F.col("__f")
    value = F.when(F.size(f["assign"]) > 0, F.regexp_extract_all(body, F.lit(ASSIGN), F.lit(2)))
    gaps = [F.when(F.size(f[k]) > 0, F.split(body, p, -1)).alias(k) for k, p in patterns.items()]
    df = df.withColumn("__v", value).withColumn("__g", F.struct(*gaps))
    empty = F.array().cast("array<struct<s:int,e:int>>")
    spans = [
        F.when(F.size(f[k]) > 0, _places(F.col("__g")[k], f[k])).otherwise(empty).alias(k) for k in patterns
    ]
    df = df.withColumn("__p", F.struct(*spans))
    p = F.col("__p")

    def kept(k: str, extra: Column, test) -> Column:
        """Spans of kind k whose aligned string passes the test."""
        both = F.filter(F.zip_with(p[k], extra, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda x: test(x["b"]))
        # no extra strings: no spans either
        return F.coalesce(F.transform(both, lambda x: x["a"]), empty)

    df = df.withColumn(
        "__b",
        F.struct(
            kept("assign", F.col("__v"), lambda v: F.length(v) >= LEAST_ASSIGNED).alias("assign"),
            p["access"].alias("access"),
            p["hex"].alias("hex"),
        ),
    )
    high = F.when(F.size(f["entropy"]) > 0, kept("entropy", f["entropy"], _suspicious)).otherwise(empty)
    df = df.withColumn("__e", high)
    b = F.col("__b")
    base = F.concat(b["assign"], b["access"], b["hex"])
    fresh = F.filter("__e", lambda x: ~F.exists(base, lambda y: (x["s"] < y["e"]) & (y["s"] < x["e"])))

    def named(spans: Column, rank: int) -> Column:
        return F.transform(
            spans, lambda x: F.struct(x["s"].alias("start"), F.lit(rank).alias("rank"), x["e"].alias("end"))
        )

    every = [named(b[k], i) for i, k in enumerate(KINDS[:3])]
    every.append(named(F.when(F.size("__e") > 0, fresh).otherwise(empty), 3))
    names = F.array(*[F.lit(k) for k in KINDS])
    df = df.withColumn("__all", F.array_sort(F.concat(*every)))
    out = F.transform(
        "__all",
        lambda x: F.struct(
            F.element_at(names, x["rank"] + 1).alias("kind"), x["start"].alias("start"), x["end"].alias("end")
        ),
    )
    return df.withColumn("secret_spans", out).drop("__f", "__v", "__g", "__p", "__b", "__e", "__all")


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """docs in which every span's characters are replaced by the mark; overlapping spans fall together."""
    df = scan(docs, text)
    t = F.col(f"`{text}`")
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        inside = x["end"] <= acc["at"]
        over = x["start"] < acc["at"]
        piece = F.when(over, F.lit("")).otherwise(F.concat(F.substring(t, acc["at"] + 1, x["start"] - acc["at"]), F.lit(mark)))
        return F.struct(
            F.greatest(acc["at"], x["end"]).alias("at"),
            F.when(inside, acc["out"]).otherwise(F.array_append(acc["out"], piece)).alias("out"),
        )

    clean = F.aggregate(
        "secret_spans",
        none,
        step,
        lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(t, acc["at"] + 1, F.length(t))),
    )
    # all but the spans' own characters stays as it was
    out = F.when(F.size("secret_spans") > 0, clean).otherwise(t)
    return df.withColumn(text, out).drop("secret_spans")


def length_of(docs: DataFrame, text: str) -> Column:
    """Code points of a text column, as long; null for null."""
    return F.length(docs[text]).cast("long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.col("secret_spans")

    def digest(kinds: tuple) -> Column:
        own = F.filter(spans, lambda x: x["kind"].isin(*kinds))
        return F.array_join(F.transform(own, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long")

    return df.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in KINDS[:3]],
        F.sha2(digest(KINDS[:3]), 256).alias("base_sha256"),
        digest(KINDS).alias("spans"),
        count("entropy").alias("n_entropy"),
    )
