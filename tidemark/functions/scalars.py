"""Scalar column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The entities that feeds use most.
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
TIME_FORMATS = ("yyyy-MM-dd'T'HH:mm:ssX", "yyyy-MM-dd'T'HH:mm:ss.SSSX", "yyyy-MM-dd HH:mm:ss", "EEE, dd MMM yyyy HH:mm:ss Z", "yyyy-MM-dd")


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def clean_html(text: Column) -> Column:
    """Tags dropped, entities decoded, white space collapsed."""
    t = F.regexp_replace(text, r"<[^>]*>", " ")
    for a, b in ENTITIES:
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def first_time(text: Column, fallback: Column | None = None) -> Column:
    """The time of a text in the first format that fits, else the fallback."""
    tries = [F.try_to_timestamp(text, F.lit(f)) for f in TIME_FORMATS if not f.startswith("EEE")]
    day = F.regexp_replace(text, r"^[A-Za-z]{3},\s*", "")  # the weekday says nothing new
    tries.append(F.try_to_timestamp(day, F.lit("d MMM yyyy HH:mm:ss Z")))
    return F.coalesce(*tries, *([fallback] if fallback is not None else []))


def recency(age_hours: Column) -> Column:
    """exp(-age/72) of at least 0.4; 0.7 where the age is unknown."""
    return F.coalesce(F.greatest(F.lit(0.4), F.exp(-age_hours / 72)), F.lit(0.7))


def market_impact(severity: Column, sentiment: Column) -> Column:
    return F.least(F.lit(1.0), severity / 10 * (F.abs(sentiment) + 0.1))


def edge_weight(severity: Column, sentiment: Column, frequency: Column, market: Column, days: Column, confidence: Column) -> Column:
    """Weighted mean of severity, sentiment, frequency and market, fading by day, within 0 and 1, four decimals."""
    raw = 0.35 * severity / 10 + 0.20 * F.abs(sentiment) + 0.25 * F.log1p(frequency) / F.log1p(F.lit(10.0)) + 0.20 * market
    return F.round(clamp(raw * F.exp(-0.05 * days) * confidence, 0.0, 1.0), 4)


def grade(score: Column) -> Column:
    """S from 900, then A, B, C, D in steps, else F."""
    out = F.lit("F")
    for name, low in (("D", 350), ("C", 500), ("B", 650), ("A", 800), ("S", 900)):
        out = F.when(score >= low, name).otherwise(out)
    return out


def signed_assets(text: Column) -> Column:
    """'OIL+,SPX-' as an array of (asset, sign)."""
    parts = F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: F.length(x) > 1)
    return F.transform(
        parts,
        lambda x: F.struct(
            F.substring(x, F.lit(1), F.length(x) - 1).alias("asset"),
            F.when(F.substring(x, -1, 1) == "-", -1).otherwise(1).alias("sign"),
        ),
    )


def volatility_regime(vix: Column) -> Column:
    return F.when(vix >= 30, "panic").when(vix >= 20, "stressed").when(vix >= 15, "normal").otherwise("calm")


def fear_greed(vix: Column) -> Column:
    return clamp(1 - (vix - 10) / 40, 0.0, 1.0)


def trade_plan(price: Column, span: Column, stop: float, target: float) -> tuple[Column, Column, Column, Column]:
    """Stop and target at so many spans from a price, and both distances in percent of it (null for a price of 0)."""
    return price - stop * span, price + target * span, F.try_divide(100 * stop * span, price), F.try_divide(100 * target * span, price)


def moved(change: Column, least: float = 0.5) -> Column:
    """up, down or stable by a change in percent."""
    return F.when(change > least, "up").when(change < -least, "down").when(change.isNotNull(), "stable")


def probability_label(p: Column) -> Column:
    return F.when(p >= 0.8, "very likely").when(p >= 0.6, "likely").when(p >= 0.4, "even").when(p >= 0.2, "unlikely").otherwise("very unlikely")
