"""Telemetry over injection and open logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.numbers import SCORE_BANDS, near_bucket, rounded, score_band

# Windows and limits.
TOP, ZERO_OPEN_LEAST, ZERO_OPEN_DAYS, ATTRIBUTION_HOURS, ATTRIBUTION_TAIL = 10, 5, 30, 48, 50


def moment(now: str) -> Column:
    return F.lit(now).cast("timestamp_ntz")


def days_before(now: Column, days: int) -> Column:
    return now - F.make_dt_interval(F.lit(days))


def rate(n: Column, of: Column) -> Column:
    return F.when(of > 0, F.least(F.lit(1.0), n / of)).otherwise(0.0)


def stats(rounds: DataFrame) -> DataFrame:
    """One row of totals."""
    n = F.count(F.lit(1))
    mean = lambda total, of, places: F.when(of > 0, rounded(total / of, places)).otherwise(0.0)
    used = F.count(F.when(F.col("used_tokens") > 0, 1))
    return rounds.agg(
        n.alias("rounds"), F.count(F.when(F.col("injected"), 1)).alias("injected_rounds"), mean(F.count(F.when(F.col("injected"), 1)), n, 3).alias("hit_rate"),
        F.count(F.when(F.size("hits") == 0, 1)).alias("zero_hit_rounds"), mean(F.sum(F.size("hits")), n, 2).alias("avg_hits"),
        mean(F.sum(F.when(F.col("used_tokens") > 0, F.col("used_tokens"))), used, 2).alias("avg_tokens"),
    )


def _live(*left_out: str) -> Column:
    """A round's hits whose slug is in none of these lists of it."""
    out = F.array_distinct(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in left_out]))
    return F.filter("hits", lambda h: ~F.array_contains(out, h["slug"]))


def top_injected(rounds: DataFrame, n: int = TOP) -> DataFrame:
    """Slugs by how often they were hits, neither de-duplicated nor echoed; ties by slug."""
    hit = F.explode(_live("deduped", "echoed"))
    return rounds.select(hit.alias("h")).groupBy(F.col("h.slug").alias("slug")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "slug").limit(n)


def near_miss_histogram(rounds: DataFrame) -> DataFrame:
    return rounds.select(F.explode("near").alias("x")).groupBy(near_bucket(F.col("x.score")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def usage(rounds: DataFrame, opens: DataFrame, now: str, days: int) -> DataFrame:
    """slug, hits, opens in the window that ends now: hits of injected rounds that were neither de-duplicated, echoed nor
    dropped, and slow picks; opens count one each."""
    since = days_before(moment(now), days)
    lives = F.transform(_live("deduped", "echoed", "dropped"), lambda h: h["slug"])
    hit = rounds.where(F.col("injected") & (F.col("at") >= since)).select(F.explode(F.concat(lives, F.transform("slow", lambda s: s["slug"]))).alias("slug"))
    both = hit.select("slug", F.lit(1).alias("h"), F.lit(0).alias("o")).unionByName(opens.where(F.col("at") >= since).select("slug", F.lit(0).alias("h"), F.lit(1).alias("o")))
    return both.groupBy("slug").agg(F.sum("h").alias("hits"), F.sum("o").alias("opens"))


def rendered(rounds: DataFrame) -> DataFrame:
    """session, day, at, slug, score: pointers that each round showed, once each; slow picks without a score."""
    live = _live("deduped", "echoed", "dropped")
    shown = F.concat(F.transform(live, lambda h: F.struct(h["slug"].alias("slug"), h["score"].alias("score"))), F.transform("slow", lambda s: F.struct(s["slug"].alias("slug"), F.lit(None).cast("double").alias("score"))))
    rows = rounds.select("session", "day", "at", F.posexplode(shown).alias("nth", "x"))
    first = rows.groupBy("session", "day", "at", F.col("x.slug").alias("slug")).agg(F.min_by(F.col("x.score"), F.col("nth")).alias("score"))
    return first


def zero_open(rounds: DataFrame, opens: DataFrame, now: Column) -> DataFrame:
    """Slugs rendered five times or more in the 30 days before now and never opened."""
    often = rendered(rounds.where(F.col("at") >= days_before(now, ZERO_OPEN_DAYS))).groupBy("slug").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= ZERO_OPEN_LEAST)
    return often.join(opens.select("slug").distinct(), "slug", "left_anti")


def zero_open_list(rounds: DataFrame, opens: DataFrame, n: int = TOP) -> DataFrame:
    """slug, injections, total: the n most rendered slugs of zero_open() as of the newest round, ties by slug, and how many there are."""
    now = rounds.agg(F.max("at").alias("now"))
    recent = rounds.join(F.broadcast(now)).where(F.col("at") >= days_before(F.col("now"), ZERO_OPEN_DAYS))
    often = rendered(recent).groupBy("slug").agg(F.count(F.lit(1)).alias("injections")).where(F.col("injections") >= ZERO_OPEN_LEAST)
    all_ = often.join(opens.select("slug").distinct(), "slug", "left_anti")
    top = all_.orderBy(F.col("injections").desc(), "slug").limit(n)
    return top.join(F.broadcast(all_.agg(F.count(F.lit(1)).alias("total"))))


def status_report(topics: DataFrame, observations: DataFrame, conflicts: DataFrame, broken: DataFrame, within: int = 2000) -> DataFrame:
    """One row: topics by status, observations (of the last `within`) pending and all, conflicting slugs and broken topics."""
    by = topics.agg(F.count(F.lit(1)).alias("topics"), *[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in ("draft", "stable", "deprecated")])
    seen = observations.orderBy(F.col("place").desc()).limit(within)
    obs = seen.agg(F.count(F.when(~F.col("distilled"), 1)).alias("pending"), F.count(F.lit(1)).alias("observations"))
    n = lambda df, name: df.select("slug").distinct().agg(F.count(F.lit(1)).alias(name))
    return by.join(obs).join(n(conflicts, "conflicts")).join(n(broken, "broken"))


def open_topics(rounds: DataFrame, opens: DataFrame, n: int = TOP) -> DataFrame:
    """The most rendered slugs with their opens and open rate; ties by slug."""
    shown = rendered(rounds).groupBy("slug").agg(F.count(F.lit(1)).alias("injections"))
    opened = opens.groupBy("slug").agg(F.count(F.lit(1)).alias("opens"))
    both = shown.join(opened, "slug", "left").fillna(0, ["opens"])
    return both.withColumn("open_rate", rate(F.col("opens"), F.col("injections"))).orderBy(F.col("injections").desc(), "slug").limit(n)


def open_panel(rounds: DataFrame, opens: DataFrame) -> DataFrame:
    """One row: pointers rendered, different rendered slugs opened since the first round (searches don't count), rate, and opens by source. opens: slug,
    at, source."""
    shown = rendered(rounds)
    entries = shown.agg(F.count(F.lit(1)).alias("pointers"))
    start = rounds.agg(F.min("at").alias("start"))
    counted = opens.where(F.coalesce(F.col("source") != "search", F.lit(True))).join(F.broadcast(start)).where(F.col("start").isNull() | F.col("at").isNull() | (F.col("at") >= F.col("start")))
    opened = counted.join(shown.select("slug").distinct(), "slug", "left_semi").agg(F.count_distinct("slug").alias("opened"))
    by = opens.agg(F.count(F.when(F.col("source") == "pointer", 1)).alias("pointer_opens"), F.count(F.when(F.col("source") == "search", 1)).alias("search_opens"))
    return entries.join(opened).join(by).withColumn("open_rate", rate(F.col("opened"), F.col("pointers")))


def band_rates(rounds: DataFrame, opens: DataFrame) -> DataFrame:
    """Pointers, opens from pointers and rate for each score band, empty bands too. opens: source, score."""
    spark = rounds.sparkSession
    bands = spark.createDataFrame([(i, b[0]) for i, b in enumerate(SCORE_BANDS)], "nth int, band string")
    shown = rendered(rounds).select(score_band(F.col("score")).alias("band"), F.lit(1).alias("p"), F.lit(0).alias("o"))
    opened = opens.where("source = 'pointer'").select(score_band(F.col("score")).alias("band"), F.lit(0).alias("p"), F.lit(1).alias("o"))
    sums = shown.unionByName(opened).where("band is not null").groupBy("band").agg(F.sum("p").alias("pointers"), F.sum("o").alias("opens"))
    out = bands.join(sums, "band", "left").fillna(0, ["pointers", "opens"])
    return out.select("band", "pointers", "opens", rate(F.col("opens"), F.col("pointers")).alias("open_rate"))


def numbered(rows: DataFrame, order: str, *then: str, cell: Column) -> DataFrame:
    """rows with nth, their number from 1 in the order of these columns. cell: a whole number that grows with the order and splits it
    into ranges; ranges are counted, and rows numbered within them, so no task holds more than the rows of a range and the list of ranges."""
    celled = rows.withColumn("_cell", cell)
    before = F.sum("_n").over(Window.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1))
    starts = celled.groupBy("_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(before, F.lit(0))).drop("_n")
    place = F.row_number().over(Window.partitionBy("_cell").orderBy(order, *then))
    return celled.withColumn("_k", place).join(starts, "_cell").withColumn("nth", F.col("_k") + F.col("_before")).drop("_cell", "_k", "_before")


def attribute_opens(opens: DataFrame, rounds: DataFrame, hours: int = ATTRIBUTION_HOURS, tail: int = ATTRIBUTION_TAIL) -> DataFrame:
    """opens (event_id, session, slug, at) with source, score and since (seconds): the newest round of the session, in
    log order and among the last `tail` rounds of the log at that time, not over 48 hours old, in which the slug was shown (also
    one de-duplicated there, but no dropped or echoed one); otherwise the source is search.

    Log order is place. The log at the time of an open reaches up to the last place of a round that isn't later than it, so a
    round whose clock is ahead counts if it lies before that place. The number of a log's rows by then is a running maximum
    over time, by hours and within them; then an as-of join by session and slug, and one best row an open.
    """
    was = _live("dropped", "echoed")
    log = numbered(rounds, "place", "session", cell=F.floor(F.col("place") / F.lit(1 << 16)))
    hour = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(3_600_000_000)).cast("long")
    marks = log.select("at", "nth", F.lit(None).cast("long").alias("event_id")).unionByName(opens.select("at", F.lit(None).cast("long").alias("nth"), "event_id")).withColumn("hour", hour("at"))
    reached = F.max("_n").over(Window.orderBy("hour").rowsBetween(Window.unboundedPreceding, -1))
    hours_of = marks.groupBy("hour").agg(F.max("nth").alias("_n")).withColumn("earlier", reached).drop("_n")
    upto = F.max("nth").over(Window.partitionBy("hour").orderBy("at"))
    length = marks.withColumn("upto", upto).where("event_id is not null").join(hours_of, "hour").select("event_id", F.greatest("upto", "earlier").alias("length"))
    shown = F.concat(F.transform(was, lambda h: F.struct(h["slug"].alias("slug"), h["score"].alias("score"))), F.transform("slow", lambda s: F.struct(s["slug"].alias("slug"), F.lit(None).cast("double").alias("score"))))
    rows = log.select("session", F.col("nth").alias("line"), F.col("at").alias("r_at"), F.posexplode(shown).alias("nth", "x"))
    rows = rows.select("session", "line", "r_at", "nth", F.col("x.slug").alias("slug"), F.col("x.score").alias("r_score"))
    age = F.timestamp_diff("MICROSECOND", F.col("r_at"), F.col("at")) / 1e6
    seen = (F.col("line") <= F.col("length")) & (F.col("line") > F.col("length") - tail)
    both = opens.join(length, "event_id").join(rows, ["session", "slug"]).withColumn("since", F.greatest(age, F.lit(0.0))).where(seen & (age <= hours * 3600))
    newest = Window.partitionBy("event_id").orderBy(F.col("line").desc(), "nth")
    found = both.withColumn("k", F.row_number().over(newest)).where("k = 1").select("event_id", "r_score", "since", F.lit("pointer").alias("hit"))
    out = opens.join(found, "event_id", "left")
    return out.select("event_id", "session", "slug", "at", F.coalesce("hit", F.lit("search")).alias("source"), F.col("r_score").alias("score"), "since")


def slow_lane(rounds: DataFrame) -> DataFrame:
    """One row: rounds with slow picks, and the upper median of their seconds from computed to consumed, none below 0."""
    lag = F.greatest(F.lit(0.0), F.timestamp_diff("MICROSECOND", F.col("at"), F.col("consumed_at")) / 1e6)
    s = rounds.where((F.size("slow") > 0) & F.col("consumed_at").isNotNull()).select(lag.alias("lag"), F.floor(lag).cast("long").alias("second"))
    every = rounds.agg(F.count(F.when(F.size("slow") > 0, 1)).alias("slow_rounds"))
    # The upper median by rank: the second it lies in by counts of seconds, then its place among the lags of that second.
    seconds = s.groupBy("second").agg(F.count(F.lit(1)).alias("n"))
    ranked = seconds.withColumn("upto", F.sum("n").over(Window.orderBy("second"))).withColumn("middle", F.floor(F.sum("n").over(Window.partitionBy()) / 2))
    here = ranked.where((F.col("upto") > F.col("middle")) & (F.col("upto") - F.col("n") <= F.col("middle"))).select("second", (F.col("middle") - F.col("upto") + F.col("n") + 1).alias("k"))
    lags = s.groupBy("second", "lag").agg(F.count(F.lit(1)).alias("n")).join(F.broadcast(here), "second")
    median = lags.withColumn("upto", F.sum("n").over(Window.partitionBy("second").orderBy("lag"))).where(F.col("upto") >= F.col("k")).agg(F.min("lag").alias("median_lag"))
    return every.join(median)


def tuning_hint(rounds: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row: whether many near misses lie just under the threshold while few rounds fire."""
    near = rounds.select(F.explode("near").alias("x")).where((F.col("x.score") >= threshold - 0.15) & (F.col("x.score") < threshold)).agg(F.count(F.lit(1)).alias("near"))
    n = stats(rounds).select("rounds", "hit_rate")
    return n.join(near).select("rounds", "near", ((F.col("rounds") >= 20) & (F.col("hit_rate") < 0.5) & (F.col("near") >= 0.3 * F.col("rounds"))).alias("lower_threshold"))


def sparkline(histogram: DataFrame, buckets: int) -> DataFrame:
    """bucket, level 0 to 7 of each of the buckets 0 to buckets - 1, by log10 of the count + 1 against the largest."""
    spine = histogram.sparkSession.range(buckets).select(F.col("id").alias("bucket"))
    height = F.log10(F.coalesce(F.col("n"), F.lit(0)) + 1.0)
    rows = spine.join(histogram, "bucket", "left").select("bucket", height.alias("height"))
    top = rows.agg(F.max("height").alias("top"))
    return rows.join(F.broadcast(top)).select("bucket", F.when(F.col("top") > 0, F.floor(F.col("height") / F.col("top") * 7 + 0.5)).otherwise(0).cast("int").alias("level"))


def heartbeat(rounds: DataFrame, opens: DataFrame, now: str) -> DataFrame:
    """One row: the last entries of both logs, and whether injection has been idle for two days while the other log moves."""
    last = rounds.agg(F.max_by("at", "place").alias("last_round")).join(opens.agg(F.max_by("at", "event_id").alias("last_open")))
    idle = F.col("last_round") < days_before(moment(now), 2)
    return last.withColumn("stale", idle & (F.col("last_open") >= days_before(moment(now), 1)))


def status_counts(topics: DataFrame) -> DataFrame:
    return topics.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))


def echoes(found: DataFrame) -> DataFrame:
    """One row: how many hits were the session's own. found: outcome."""
    return found.agg(F.count(F.when(F.col("outcome") == "echoed", 1)).alias("echoes"), F.count(F.when(F.col("outcome") == "deduped", 1)).alias("deduped"))


def usage_weight(hits: Column, opens: Column) -> Column:
    """What packing orders equals by."""
    return opens * 3 + hits
