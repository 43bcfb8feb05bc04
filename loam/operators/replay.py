"""Replays of gates and decision logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.numbers import decision_band, rounded

THRESHOLDS = (0.20, 0.25, 0.30, 0.35, 0.40, 0.45)
RESCUE = 0.5


def reason_fields(reasons: Column) -> Column:
    """Map of the fields and positive values that reason strings state."""
    pairs = F.transform(reasons, lambda r: F.struct(F.regexp_extract(r, r"^([^:]+):", 1).alias("k"), F.regexp_extract(r, r"^[^:]+:(.*)$", 1).try_cast("double").alias("v")))
    good = F.filter(pairs, lambda p: (p["k"] != "") & ~p["k"].isin("depends", "tag-boost") & (F.coalesce(p["v"], F.lit(0.0)) > 0))
    return F.map_from_entries(F.aggregate(good, F.array().cast("array<struct<k:string,v:double>>"), lambda a, p: F.concat(F.filter(a, lambda q: q["k"] != p["k"]), F.array(p))))


def simulate_gate(hits: DataFrame, threshold: Column) -> DataFrame:
    """hits (score, reasons, n_query) with gate_score, strong, body_tokens and the verdict of the structural gate, taken
    from the reasons alone."""
    f = reason_fields(F.col("reasons"))
    back = lambda k: F.coalesce(F.floor(F.try_element_at(f, F.lit(k)) * F.col("n_query") + 0.5), F.lit(0)).cast("long")
    gate = rounded(F.col("score") - F.when(F.array_contains("reasons", "recency"), 0.2).otherwise(0.0), 3)
    strong = F.exists(F.map_keys(f), lambda k: k.isin("triggers", "title", "slug"))
    out = hits.withColumns({"gate_score": gate, "strong": strong, "body_tokens": back("description") + back("conclusion")})
    over = F.col("gate_score") >= threshold
    return out.withColumn("verdict", F.when(~over, "below-threshold").when(F.col("strong") | (F.col("body_tokens") >= 2), "pass").otherwise("gate-blocked"))


def sweep(hits: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """threshold, verdict, n: every hit against each threshold of a short list."""
    rows = hits.withColumn("threshold", F.explode(F.array(*[F.lit(t) for t in thresholds])))
    return simulate_gate(rows, F.col("threshold")).groupBy("threshold", "verdict").agg(F.count(F.lit(1)).alias("n"))


def gate_summary(simulated: DataFrame) -> DataFrame:
    """One row of counts over hits and rounds (round, injected): rounds that pass, injected ones that no longer would, and others that would."""
    per = simulated.groupBy("round", "injected").agg(F.bool_or(F.col("verdict") == "pass").alias("passes"), F.count(F.lit(1)).alias("hits"), *[F.count(F.when(F.col("verdict") == v, 1)).alias(v.replace("-", "_")) for v in ("pass", "gate-blocked", "below-threshold")])
    total = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return per.agg(total("hits").alias("hits"), total("pass").alias("n_pass"), total("gate_blocked").alias("n_blocked"), total("below_threshold").alias("n_below"),
        F.count(F.when(F.col("injected") & ~F.col("passes"), 1)).alias("injected_lost"), F.count(F.when(~F.col("injected") & F.col("passes"), 1)).alias("uninjected_gain"))


def dispositions(mentions: DataFrame) -> DataFrame:
    """round, at, slug, disposition, score: a slug's strongest mention in a round. mentions: round, at, slug, kind (hit, gate-blocked,
    nearFloor), score, nth."""
    order = F.when(F.col("kind") == "hit", 0).otherwise(1)
    # Of several hits the last one counts, of several near misses the first.
    nth = F.when(F.col("kind") == "hit", -F.col("nth")).otherwise(F.col("nth"))
    w = Window.partitionBy("round", "slug").orderBy(order, nth)
    return mentions.withColumn("k", F.row_number().over(w)).where("k = 1").select("round", "at", "slug", F.col("kind").alias("disposition"), "score")


def join_verdicts(verdicts: DataFrame, mentions: DataFrame, window_seconds: int) -> DataFrame:
    """verdicts (event_id, slug, at, probability) with the nearest round in the window that mentions the slug, of two
    the earlier one, of those at one time the first by name; verdicts without a round have nulls.

    Cells of time are as long as the window: a verdict looks into its own cell and the two beside it. There it meets no more than the last
    mention before it and the first one after it, found by one pass over the cell in time order, so that a frequent slug costs no pairs.
    """
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    cell = F.floor(micros / F.lit(window_seconds * 1_000_000)).cast("long")
    found = F.struct(micros.alias("t"), "round", F.col("at").alias("round_at"), "disposition", F.col("score").alias("lexical"))
    m = dispositions(mentions).where("slug is not null and at is not null").groupBy("slug", cell.alias("cell"), micros.alias("t")).agg(F.min(found).alias("m"))
    v = verdicts.select("event_id", "slug", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"), micros.alias("t"))
    rows = m.withColumns({"event_id": F.lit(None).cast(dict(verdicts.dtypes)["event_id"]), "asks": F.lit(False)}).unionByName(v.withColumns({"m": F.lit(None).cast(m.schema["m"].dataType), "asks": F.lit(True)}))
    upto = Window.partitionBy("slug", "cell").orderBy("t", "asks")
    before = F.last("m", True).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    # Backwards, a verdict comes before what is mentioned at its time, which the other one has.
    after = F.last("m", True).over(Window.partitionBy("slug", "cell").orderBy(F.col("t").desc(), F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, 0))
    met = rows.withColumns({"before": before, "after": after}).where("asks").select("event_id", "t", F.explode(F.array("before", "after")).alias("m"))
    apart = F.abs(F.col("m.t") - F.col("t"))
    near = met.where(apart <= window_seconds * 1_000_000).groupBy("event_id").agg(F.min(F.struct(apart.alias("apart"), "m")).alias("x"))
    best = near.select("event_id", "x.m.round", "x.m.round_at", "x.m.disposition", "x.m.lexical")
    return verdicts.join(best, "event_id", "left").withColumn("band", decision_band(F.col("probability"), "rerank"))


def agreement(joined: DataFrame) -> DataFrame:
    """joined with agree: the disposition, or wouldBlock for a hit that the model would have kept out; and rescue."""
    agree = F.when((F.col("disposition") == "hit") & (F.col("band") == "fallback"), "wouldBlock").when(F.col("disposition").isNull(), "n/a").otherwise(F.col("disposition"))
    return joined.withColumns({"agree": agree, "rescue": F.coalesce((F.col("disposition") == "gate-blocked") & (F.col("probability") >= RESCUE), F.lit(False))})


def verdict_summary(joined: DataFrame) -> DataFrame:
    """One row: verdicts, joined, unmatched, rates (null without a base) and mean probability by disposition."""
    a = agreement(joined)
    n, hit = F.count(F.lit(1)), F.count("disposition")
    wrong = F.count(F.when((F.col("agree") == "wouldBlock") | F.col("rescue"), 1))
    means = [rounded(F.try_avg(F.when(F.col("disposition") == d, F.col("probability"))), 3).alias(f"mean_{d.replace('-', '_').lower()}") for d in ("hit", "nearFloor", "gate-blocked")]
    return a.agg(n.alias("verdicts"), hit.alias("joined"), (n - hit).alias("unmatched"), rounded(F.try_divide(hit, n), 3).alias("reconcile_rate"), rounded(F.try_divide(wrong, hit), 3).alias("disagreement_rate"), *means)


def calibration(joined: DataFrame, outcome: Column, bins: int = 10) -> DataFrame:
    """bin, n, mean probability, share of outcomes: what an expected calibration error is summed from."""
    b = F.least(F.floor(F.col("probability") * bins), F.lit(bins - 1)).cast("int")
    return joined.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("probability"), 6).alias("mean_probability"), rounded(F.avg(outcome.cast("double")), 6).alias("share"))
