"""Work that asks a model, which the caller brings: gates around what it answers, and small driver loops."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Limits of batches and answers.
BATCH, LEAST_BATCH, CALLS, MOST_PICKS, WHY = 40, 5, 8, 2, 200


def balanced_object(text: str) -> dict:
    """The first balanced JSON object in a text, strings respected; ValueError if there is none."""
    for start in (i for i, c in enumerate(text or "") if c == "{"):
        try:
            found, _ = json.JSONDecoder().raw_decode(text, start)
        except ValueError:
            continue
        return found
    raise ValueError("no object")


def parsed_answers(answers: DataFrame, schema: str, text_col: str = "answer") -> DataFrame:
    """answers with parsed: the first object of each answer in this schema; null if there is none."""

    @F.pandas_udf("string")
    def extract(texts):
        def one(t):
            try:
                return json.dumps(balanced_object(t))
            except ValueError:
                return None

        return texts.map(one)

    return answers.withColumn("parsed", F.from_json(extract(F.col(text_col)), schema))


def gated_ops(ops: DataFrame, topics: DataFrame) -> DataFrame:
    """ops (id, op, kind, slug, title, description, conclusion, triggers, scope) with outcome: what a schema gate and the list of topics say."""
    known = topics.select("slug", F.lit(True).alias("known"))
    n = F.size(F.filter(F.coalesce("triggers", F.array().cast("array<string>")), lambda t: F.trim(t) != ""))
    some = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    topic_ok = some("description") & n.between(3, 8)
    lesson_ok = some("conclusion") & n.between(3, 8) & F.coalesce(F.col("scope").isin("workspace", "global"), F.lit(False))
    outcome = F.when(~F.col("op").isin("create", "update"), "invalid").when((F.col("op") == "update") & F.col("known").isNull(), "unknown-topic").when((F.col("op") == "create") & ~F.when(F.col("kind") == "lesson", lesson_ok).otherwise(topic_ok), "incomplete").otherwise("accepted")
    return ops.join(known, "slug", "left").withColumn("outcome", outcome).drop("known")


def valid_picks(picks: DataFrame, candidates: DataFrame, most: int = MOST_PICKS) -> DataFrame:
    """picks (query_id, nth, slug, why) that are candidates and say why: the first of each slug, two a query, reasons cut."""
    from pyspark.sql import Window

    ok = picks.where(F.trim(F.coalesce("why", F.lit(""))) != "").join(candidates.select("query_id", "slug").distinct(), ["query_id", "slug"], "left_semi")
    one = ok.groupBy("query_id", "slug").agg(F.min_by("why", "nth").alias("why"), F.min("nth").alias("nth"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("nth"))
    return one.withColumn("rank", rank).where(F.col("rank") <= most).select("query_id", "rank", "slug", F.substring("why", 1, WHY).alias("why"))


def gate_candidates(found: DataFrame, roster: DataFrame, most: int = 8) -> DataFrame:
    """query_id, question, slug, title: the first `most` candidates (query_id, slug, rank) of each query that the roster still has; questions
    are numbered over those."""
    from pyspark.sql import Window

    some = found.where(F.col("rank") <= most).join(roster.select("slug", "title"), "slug")
    nth = F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))
    return some.select("query_id", F.concat(F.lit("c"), nth.cast("string")).alias("question"), "slug", "title")


def op_key(op, slug, title):
    """The slug that an operation is about, as columns: its own for an update, that of its title otherwise."""
    from loam.functions.text import slugify

    named = F.when(op == "update", slug).otherwise(title)
    return F.when(named.isNull(), "").otherwise(slugify(named))


def attributed(ops: DataFrame, fed: DataFrame) -> DataFrame:
    """ops (id, observed array) with valid (the ids that were fed, in order), filtered (how many others) and dropped (none is left). fed: id."""
    rows = ops.select("id", F.posexplode_outer("observed").alias("nth", "obs")).join(fed.select(F.col("id").alias("obs"), F.lit(True).alias("known")).distinct(), "obs", "left")
    per = rows.groupBy("id").agg(F.array_sort(F.collect_list(F.when(F.col("known"), F.struct("nth", "obs")))).alias("v"), F.count("nth").alias("n"))
    valid = F.transform("v", lambda x: x["obs"])
    return ops.join(per, "id").select(*[ops[c] for c in ops.columns], valid.alias("valid"), (F.col("n") - F.size("v")).alias("filtered"), (F.size("v") == 0).alias("dropped"))


def routed(observations: DataFrame) -> DataFrame:
    """observations with branch: what a run takes. Signals that were fed make lessons, and wait as long as there is anything else."""
    signal = (F.col("source") == "fed") & (F.col("kind") == "signal")
    others = observations.agg(F.coalesce(F.bool_or(~F.coalesce(signal, F.lit(False))), F.lit(False)).alias("others"))
    rows = observations.join(F.broadcast(others)).withColumn("signal", F.coalesce(signal, F.lit(False)))
    return rows.withColumn("branch", F.when(~F.col("signal"), "topic").when(F.col("others"), "waits").otherwise("lesson")).drop("signal", "others")


def flagged_conflicts(ops: DataFrame, established: DataFrame) -> DataFrame:
    """id, conflicts (different slugs of established lessons that the op says it conflicts with, in order, joined by commas), declared
    (how many it named); ops without any are left out."""
    rows = ops.select("id", F.size("conflicts_with").alias("declared"), F.posexplode("conflicts_with").alias("nth", "slug"))
    known = rows.join(established.select("slug").distinct(), "slug", "left_semi").groupBy("id", "declared", "slug").agg(F.min("nth").alias("nth"))
    per = known.groupBy("id", "declared").agg(F.array_sort(F.collect_list(F.struct("nth", "slug"))).alias("v"))
    return per.select("id", F.array_join(F.transform("v", lambda x: x["slug"]), ",").alias("conflicts"), "declared")


def run_counters(outcomes: DataFrame) -> DataFrame:
    """One row of a run's counters over its operations (op, outcome, filtered, marked)."""
    n = lambda test, name: F.count(F.when(test, 1)).alias(name)
    ok = F.col("outcome") == "accepted"
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return outcomes.agg(n(ok & (F.col("op") == "create"), "created"), n(ok & (F.col("op") == "update"), "updated"), n(F.col("outcome") == "invalid", "invalid"), n(~F.col("outcome").isin("accepted", "invalid"), "rejected"), total("filtered"), total("marked"))


def comparison_rows(answers: DataFrame) -> DataFrame:
    """answers (slug, probability as text) as verdict rows of a comparison: band forced to record; what is no probability is left out."""
    from loam.functions.numbers import probability

    return answers.select("slug", probability(F.col("probability")).alias("probability")).where("probability is not null").select(F.concat(F.lit("slug:"), "slug").alias("ref"), "probability", F.lit("record").alias("band"))


def verdicts_of(log: DataFrame, lane: str = "fastgate-shadow", adopt: float = 0.6, record: float = 0.1) -> DataFrame:
    """Rows of one lane of a decision log (lane, ref, probability, band) that name a topic and have a probability: slug, probability, band (by the
    probability where the row has none of its own)."""
    p = F.col("probability").cast("double")
    ok = (F.col("lane") == lane) & F.col("ref").startswith("slug:") & p.isNotNull() & ~F.isnan(p) & (F.abs(p) < F.lit(float("inf")))
    band = F.when(F.col("band").isin("adopt", "record", "fallback"), F.col("band")).when(p >= adopt, "adopt").when(p >= record, "record").otherwise("fallback")
    return log.where(ok).withColumn("slug", F.substr("ref", F.lit(6))).withColumn("band", band)


def distill(pending: list[dict], call: Callable[[str], str], batch: int = BATCH) -> list[dict]:
    """Operations that a model proposes for a queue of observations, batch by batch: a batch too long for an answer is
    halved (to 5 at least), a malformed answer is asked for once more, eight calls at most. call raises OverflowError where the answer was cut off."""
    out, at, calls = [], 0, 0
    while at < len(pending) and calls < CALLS:
        part, again = pending[at : at + batch], False
        while calls < CALLS:
            calls += 1
            try:
                out += balanced_object(call(json.dumps(part, ensure_ascii=False)))["ops"]
            except OverflowError:
                if batch <= LEAST_BATCH:
                    return out
                batch = max(LEAST_BATCH, batch // 2)
                part = pending[at : at + batch]
                continue
            except (ValueError, KeyError):
                if again:
                    return out
                again = True
                continue
            at += len(part)
            break
    return out
