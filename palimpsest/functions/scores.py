"""Vector, time and ageing expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DAY = 86_400.0


def dot(a: Column, b: Column) -> Column:
    """Sum of products in double precision, added from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths or without length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (size > 0), dot(a, b) / size).otherwise(0.0)


def unit(a: Column) -> Column:
    """The vector over its length; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))


def days_between(earlier: Column, later: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(1e6 * DAY)


def recency(days: Column) -> Column:
    """e^(-days/30)."""
    return F.exp(-days / 30.0)


def importance(base: Column, accesses: Column, days: Column) -> Column:
    """Half the base, three tenths of the log of accesses, two tenths of recency, between 0 and 1 (I4)."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * base + 0.3 * F.ln(accesses + 1) + 0.2 * recency(days)))


def half_life(value: Column, days: Column, half: float = 30.0, least: float = 0.1, change: float = 0.05) -> Column:
    """Halved every ``half`` days down to ``least``; kept within the first day and for changes of ``change`` or less."""
    decayed = F.greatest(F.lit(least), value * F.exp(-F.ln(F.lit(2.0)) / half * days))
    return F.when((days >= 1) & (F.abs(value - decayed) > change), decayed).otherwise(value)


def daily_decay(value: Column, factor: float = 0.98, least: float = 0.01) -> Column:
    """(I6, I8)"""
    return F.greatest(F.lit(least), value * factor)


def relation_decay(days: Column, rate: float = 0.01) -> Column:
    """e^(-rate) a month of 30 days."""
    return F.exp(-rate * days / 30.0)


def time_window(intent: Column, historical: Column) -> Column:
    """Days that a query looks back."""
    near = F.when(intent == "episodic", 7).when(intent == "reflection", 90).otherwise(30)
    return F.when(historical, F.when(intent.isin("semantic", "reflection"), 730).otherwise(365)).otherwise(near)


def memory_score(kind: Column, intent: Column, detail: Column, days: Column, similarity: Column) -> Column:
    """Intent match times the kind's priority, plus age and similarity."""
    match = F.when(kind == intent, 1.0).otherwise(0.5)
    plain = F.when(kind == "reflection", 1.2).when(kind == "semantic", 1.0).otherwise(0.8)
    priority = F.when(detail, F.when(kind == "episodic", 1.5).otherwise(0.8)).otherwise(plain)
    return match * priority + F.pow(F.lit(0.98), F.greatest(F.lit(0.0), days)) * 0.8 + similarity * 0.7


def token_estimate(text: Column) -> Column:
    """A token for every four characters begun."""
    return F.ceil(F.length(text) / 4).cast("long")


def compression(tokens_in: Column, tokens_out: Column) -> Column:
    """Ratio of a summary's tokens, and whether it is too short, too long or fine."""
    ratio = F.when(tokens_in > 0, tokens_out / tokens_in).otherwise(0.0)
    return F.struct(ratio.alias("ratio"), F.when(ratio < 0.1, "over").when(ratio > 0.9, "under").otherwise("fine").alias("verdict"))
