"""The engine's own inputs, derived from the given tables: topics, queries, rounds, opens, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = "2024-01-31 00:00:00"
LESSON_SOURCE = "src7"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All topics, a row a document: the first line is the title, the second the description, the whole text the
    conclusion. Labels give the status; one source holds lessons. Every topic depends on one other and links to one."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    # Not split(), which copies the rest as well, for each line that is taken.
    title = F.substring_index("text", "\n", 1)
    second = F.when(F.contains("text", F.lit("\n")), F.substring_index(F.substring_index("text", "\n", 2), "\n", -1)).otherwise("")
    rows = docs.join(labels, "doc_id", "left")
    status = F.when(F.col("toxic") == 1, "deprecated").when(F.col("quality") == 0, "draft").otherwise("stable")
    slug = lambda c: F.concat(F.lit("d"), c.cast("string"))
    return rows.select(
        F.col("doc_id").alias("pos"), slug(F.col("doc_id")).alias("slug"), title.alias("title"), second.alias("description"),
        F.col("text").alias("conclusion"), F.array("lang", "source").alias("tags"), F.slice(F.split(title, " "), 1, 3).alias("triggers"), status.alias("status"),
        F.when(F.col("source") == LESSON_SOURCE, "lesson").otherwise("topic").alias("kind"), F.array(slug((F.col("doc_id") * 7 + 1) % 997)).alias("depends"), F.array(slug((F.col("doc_id") * 5 + 3) % 991)).alias("links"),
        F.expr(f"timestamp_ntz'{NOW}' - make_interval(0, 0, 0, 0, cast(doc_id % 400 as int))").alias("generated_at"),
    )


def roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topics that retrieval searches: neither deprecated nor lessons."""
    return topics(spark, sf_dir).where("status <> 'deprecated' and kind = 'topic'")


TOPICS_SQL = f"""
topics as (
  select d.doc_id as pos, 'd' || d.doc_id as slug, string_split(text, chr(10))[1] as title, coalesce(string_split(text, chr(10))[2], '') as description,
    text as conclusion, [lang, source] as tags, string_split(string_split(text, chr(10))[1], ' ')[1:3] as triggers,
    case when toxic = 1 then 'deprecated' when quality = 0 then 'draft' else 'stable' end as status,
    case when source = '{LESSON_SOURCE}' then 'lesson' else 'topic' end as kind,
    ['d' || ((d.doc_id * 7 + 1) % 997)] as depends, ['d' || ((d.doc_id * 5 + 3) % 991)] as links,
    timestamp '{NOW}' - to_hours((d.doc_id % 400)::int) as generated_at
  from documents d left join labels l on l.doc_id = d.doc_id),
roster as (select * from topics where status <> 'deprecated' and kind = 'topic')"""


def queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log: session, day, slug, score, place."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "ts", F.col("user_id").alias("session"), F.to_date("ts").alias("day"), "event_type", F.concat(F.lit("t"), F.get_json_object("props", "$.k")).alias("slug"), F.col("value"))


def rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Retrieval rounds, a row for each session and day, as the injection log has them: views are hits (those of 100 and
    more: slow picks), errors were dropped, sign-ups de-duplicated, purchases near misses, and every second purchase names a
    slug that came out of the session itself (echoed); a round with a hit is injected unless everything was de-duplicated."""
    f = facts(spark, sf_dir)
    picked = lambda test, *cols: F.transform(F.array_sort(F.collect_list(F.when(test, F.struct("ts", "event_id", *cols)))), lambda x: F.struct(*[x[c].alias(c) for c in ("slug", "score") if c in cols]))
    f = f.withColumn("score", F.col("value") / 20)
    fast, slow = (F.col("event_type") == "view") & (F.col("value") < 100), (F.col("event_type") == "view") & (F.col("value") >= 100)
    slugs = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("event_type") == kind, F.struct("ts", "event_id", "slug")))), lambda x: x["slug"])
    out = f.groupBy("session", "day").agg(
        F.min("ts").alias("at"), picked(fast, "slug", "score").alias("hits"), picked(slow, "slug").alias("slow"), slugs("error").alias("dropped"), slugs("signup").alias("deduped"),
        F.collect_set(F.when((F.col("event_type") == "purchase") & (F.col("event_id") % 2 == 0), F.col("slug"))).alias("echoed"),
        picked(F.col("event_type") == "purchase", "slug", "score").alias("near"), F.max("event_id").alias("place"),
    )
    return out.withColumns({"injected": F.size("hits") > F.size("deduped"), "used_tokens": 60 * F.size("hits"), "consumed_at": F.expr("at + make_dt_interval(0, 0, 0, size(slow) * 2.5)")})


FACTS_SQL = """
facts as (
  select event_id, ts, user_id as session, ts::date as day, event_type, 't' || (props::json->>'$.k') as slug, value, value / 20 as score,
    case when event_type = 'view' then (case when value < 100 then 'hit' else 'slow' end) when event_type = 'error' then 'dropped'
      when event_type = 'signup' then 'deduped' when event_type = 'purchase' then 'near' else 'open' end as kind, event_type = 'purchase' and event_id % 2 = 0 as echo
  from events),
rounds as (
  select session, day, min(ts) as at, max(event_id) as place, count(*) filter (kind = 'hit') as n_hits, count(*) filter (kind = 'deduped') as n_deduped,
    count(*) filter (kind = 'slow') as n_slow, count(*) filter (kind = 'hit') > count(*) filter (kind = 'deduped') as injected
  from facts group by session, day)"""


def opens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Topic opens: clicks."""
    return facts(spark, sf_dir).where("event_type = 'click'").select("event_id", "slug", F.col("ts").alias("at"), "session")


def verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decision verdicts: purchases, with a probability of value / 500 and at most 1."""
    return facts(spark, sf_dir).where("event_type = 'purchase'").select("event_id", "slug", F.col("ts").alias("at"), F.least(F.col("value") / 500, F.lit(1.0)).alias("probability"))
