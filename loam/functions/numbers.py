"""Scores, bands, similarities and rounding as expressions over columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bands of scores and of probabilities.
SCORE_BANDS = [("[0.3,0.5)", 0.3, 0.5), ("[0.5,1)", 0.5, 1.0), ("[1,2)", 1.0, 2.0), ("[2,5)", 2.0, 5.0), ("[5,∞)", 5.0, float("inf"))]
DECISION_LINES = {"rerank": (0.60, 0.10), "mergePair": (0.50, 0.15)}
CADENCE_DAYS = {"daily": 1, "3d": 3, "7d": 7}


def rounded(x: Column, places: int) -> Column:
    """Half goes up, also below zero."""
    scale = float(10**places)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def score_band(score: Column) -> Column:
    out = F.lit(None).cast("string")
    for label, low, high in SCORE_BANDS:
        out = F.when((score >= low) & (score < high), label).otherwise(out)
    return out


def decision_band(p: Column, kind: str) -> Column:
    adopt, record = DECISION_LINES[kind]
    return F.when(p >= adopt, "adopt").when(p >= record, "record").otherwise("fallback")


def near_bucket(score: Column) -> Column:
    """Lower end of the score's bucket of 0.05, in twentieths."""
    return F.floor(score * F.lit(20.0)).cast("long")


def cosine(a: Column, b: Column) -> Column:
    """0 for empty or zero vectors and for unequal sizes."""
    double = lambda v: F.transform(v, lambda x: x.cast("double"))
    a, b = double(a), double(b)
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    squares = lambda v: F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x)
    norm = squares(a) * squares(b)
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot / F.sqrt(norm)).otherwise(0.0)


def containment(of: Column, within: Column) -> Column:
    return F.when((F.size(of) > 0) & (F.size(within) > 0), F.size(F.array_intersect(of, within)) / F.size(of)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(0.0)


def overlaps(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False))


def delegation_depth(session: Column, option: Column) -> Column:
    """The deeper of what a session and an option say; nulls and what is below 0 count as 0."""
    return F.greatest(F.coalesce(session.cast("long"), F.lit(0)), F.coalesce(option.cast("long"), F.lit(0)), F.lit(0).cast("long"))


def probability(answer: Column) -> Column:
    p = answer.try_cast("double")
    return F.when(p.between(0.0, 1.0), p)


def cadence_days(value: Column) -> Column:
    out = F.lit(None).cast("int")
    for name, days in CADENCE_DAYS.items():
        out = F.when(value == name, days).otherwise(out)
    return out
