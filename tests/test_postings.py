"""Search over postings beside plain scoring; an index kept in runs beside one made anew."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from loam.operators import postings, retrieve, shared

TOPIC = "slug string, pos long, title string, description string, conclusion string, tags array<string>, triggers array<string>, generated_at timestamp_ntz"


def topics_of(spark, n: int, seed: int = 1):
    draw = random.Random(seed)
    words = [f"word{i}" for i in range(400)]
    often = [1 / (i + 1) for i in range(400)]
    some = lambda k: draw.choices(words, often, k=k)
    rows = [(f"s{i}", i, " ".join(some(3)), None if i % 9 == 0 else " ".join(some(4)), "" if i % 11 == 0 else " ".join(some(60)), some(1), some(2), None) for i in range(n)]
    return spark.createDataFrame(rows, TOPIC), spark.createDataFrame([(i, None if i == 0 else "" if i == 1 else " ".join(some(12))) for i in range(40)], "query_id int, text string")


def rows(df):
    return sorted(map(tuple, df.collect()))


@pytest.mark.parametrize("floor", [0.0, 0.15, 0.3, 1.0, 2.5, 100.0])
def test_search_is_scoring_from_a_floor_on(spark, floor):
    topics, queries = topics_of(spark, 150)
    want = retrieve.score_topics(queries, topics).where(F.col("gate_score") >= floor)
    assert rows(postings.search(queries, topics, floor=floor)) == rows(want)


def test_search_with_modifiers(spark):
    topics, queries = topics_of(spark, 150, 2)
    more = {"usage": topics.where("pos % 3 = 0").select("slug", F.lit(1).alias("hits"), F.lit(0).alias("opens")), "conflicts": topics.where("pos % 5 = 0").select("slug"), "zero_open": topics.where("pos % 7 = 0").select("slug")}
    want = retrieve.score_topics(queries, topics, **more).where("gate_score >= 0.15")
    assert rows(postings.search(queries, topics, **more)) == rows(want)


@pytest.mark.parametrize("gate", [True, False])
@pytest.mark.parametrize("k", [1, 4, 8])
def test_first_of_pruned_search_are_first_of_all(spark, gate, k):
    topics, queries = topics_of(spark, 200, 3)
    topics = topics.unionByName(topics.withColumns({"slug": F.concat("slug", F.lit("b")), "pos": F.col("pos") + 1000}))  # ties
    cfg = retrieve.Retrieval(top_k=k, gate=gate)
    want = retrieve.hits(retrieve.score_topics(queries, topics, cfg), cfg)
    assert rows(retrieve.hits(postings.search_top(queries, topics, k, cfg), cfg)) == rows(want)


def test_few_postings_are_met_where_the_floor_is_high(spark):
    topics, queries = topics_of(spark, 300, 4)
    made = retrieve.field_tokens(topics)
    sizes = postings.lists(made)
    tokens = retrieve.query_tokens(queries).join(sizes, "token")
    all_scores = retrieve.score_topics(queries, topics)
    plan = postings.planned(tokens, F.lit(2.5))
    met = plan.where("not spare").join(sizes, ["token", "fields"]).agg(F.sum("n")).first()[0]
    assert met < tokens.agg(F.sum("n")).first()[0] / 5
    assert all_scores.where("gate_score >= 2.5").count() <= postings.proposed(plan, made).count() < all_scores.count()


def test_empty(spark):
    topics, queries = topics_of(spark, 5)
    assert postings.search(queries, topics.limit(0)).count() == 0
    assert postings.search(queries.limit(0), topics).count() == 0
    assert postings.search_top(queries, topics.limit(0), 4).count() == 0


def test_kept_index_equals_one_made_anew(spark):
    topics, _ = topics_of(spark, 60)
    kept = postings.Kept(shared.folder(spark, "test"), 4)
    assert kept.postings(spark).count() == 0
    batches = [topics.where("pos % 4 <> 0"), topics.withColumn("title", F.when(F.col("pos") % 3 == 0, "other title").otherwise(F.col("title"))), topics.where("pos > 20"), topics.limit(0), topics]
    for i, batch in enumerate(batches):
        assert kept.update(batch)
        assert not kept.update(batch)  # nothing has changed
        assert rows(kept.postings(spark)) == rows(retrieve.field_tokens(batch))
        if i == 2:
            kept.compact(spark)
            assert rows(kept.postings(spark)) == rows(retrieve.field_tokens(batch))
            assert kept.vacuum(spark) == ["run-000001", "run-000002", "run-000003"]


def test_only_changed_topics_are_made_again(spark):
    topics, _ = topics_of(spark, 60)
    kept = postings.Kept(shared.folder(spark, "test"), 4)
    kept.update(topics)
    kept.update(topics.withColumn("description", F.when(F.col("pos") == 7, "new").otherwise(F.col("description"))))
    assert [r["slug"] for r in spark.read.parquet(f"{kept.path}/run-000002/postings").select("slug").distinct().collect()] == ["s7"]
    assert kept.stamps(spark).where("run = 2").count() == 1


def test_a_lost_writer_leaves_the_index_as_it_was(spark):
    topics, _ = topics_of(spark, 30)
    kept = postings.Kept(shared.folder(spark, "test"), 4)
    kept.update(topics.where("pos < 20"))
    retrieve.field_tokens(topics.where("pos >= 25")).write.parquet(f"{kept.path}/run-000002/postings")  # died before its stamps
    assert rows(kept.postings(spark)) == rows(retrieve.field_tokens(topics.where("pos < 20")))
    kept.update(topics)
    assert rows(kept.postings(spark)) == rows(retrieve.field_tokens(topics))


def test_shortlist_is_enough(spark):
    """Whatever takes the first rows of a query takes the same ones of the shortlist."""
    topics, queries = topics_of(spark, 300, 5)
    scored = retrieve.score_topics(queries, topics).cache()
    few = retrieve.shortlist(scored).cache()
    assert 0 < few.count() < scored.count() / 4
    for f in (retrieve.hits, retrieve.near_misses, retrieve.explicit_search, lambda x: retrieve.slow_candidates(x, retrieve.hits(x).select("query_id", "slug"))):
        assert rows(f(few)) == rows(f(scored))


def exchanges(df) -> list[str]:
    df.write.format("noop").mode("overwrite").save()
    return [line for line in df._jdf.queryExecution().executedPlan().toString().split("\n") if "Exchange hashpartitioning" in line]


def test_shared_tokens_are_not_shuffled(spark):
    topics, queries = topics_of(spark, 100)
    made, queries = shared.written(retrieve.field_tokens(topics)), shared.written(queries)
    for df in (retrieve.score_topics(queries, topics, postings=made), postings.search(queries, topics, floor=1.0, postings=made)):
        assert all("query_id" not in line for line in exchanges(df))


def test_postings_of_one_token_lie_in_all_parts(spark):
    """A token that all topics have isn't one task's work."""
    topics, _ = topics_of(spark, 60)
    kept = postings.Kept(shared.folder(spark, "test"), 4)
    kept.update(topics.withColumn("tags", F.array(F.lit("everywhere"))))
    at = kept.postings(spark).where("token = 'everywhere'").groupBy(F.input_file_name()).count().collect()
    assert len(at) == 4 and max(r["count"] for r in at) < 40


def test_texts_and_postings_that_nobody_asks_for_are_not_shuffled(spark):
    """What is dealt by slug are postings of tokens that some query has: neither texts nor other postings."""
    topics, queries = topics_of(spark, 100)
    topics, queries = shared.written(topics), shared.written(queries.where("query_id = 5"))
    df = retrieve.score_topics(queries, topics)
    made = retrieve.asked(topics, None, retrieve.query_tokens(queries))
    asked = {r["token"] for r in retrieve.query_tokens(queries).select("token").collect()}
    assert {r["token"] for r in made.select("token").distinct().collect()} <= asked
    assert 0 < made.count() < retrieve.field_tokens(topics).count() / 4
    lines = exchanges(df)
    assert lines and all("conclusion" not in line for line in lines)
    assert "LeftSemi" in df._jdf.queryExecution().executedPlan().toString()


def test_parts_grow_with_the_topics(spark, monkeypatch):
    topics, queries = topics_of(spark, 200)
    want = rows(retrieve.score_topics(queries, topics))
    monkeypatch.setattr(retrieve, "PART_TOPICS", 10)
    made = retrieve.dealt(retrieve.field_tokens(topics), topics)
    assert made.rdd.getNumPartitions() == 20
    assert rows(retrieve.score_topics(queries, topics)) == want


def test_a_kept_topic_is_one_row(spark, monkeypatch):
    """Runs are merged by moving a row a topic, not one a posting, whether the changed topics are few or many."""
    topics, _ = topics_of(spark, 60)
    for few in (0, postings.FEW):
        monkeypatch.setattr(postings, "FEW", few)
        kept = postings.Kept(shared.folder(spark, "test"), 4)
        for batch in (topics.where("pos < 40"), topics.withColumn("title", F.when(F.col("pos") < 9, "new").otherwise(F.col("title"))).where("pos > 2")):
            kept.update(batch)
        assert [spark.read.parquet(f"{kept.path}/run-{i:06d}/postings").count() for i in (1, 2)] == [40, 26]
        kept.compact(spark)
        assert spark.read.parquet(f"{kept.path}/whole-000003/postings").count() == 57
        assert rows(kept.postings(spark)) == rows(retrieve.field_tokens(batch))


def test_no_set_is_made_of_a_whole_text(spark):
    """Of two arrays, Spark makes a set of the right one: that must not be the conclusion's tokens."""
    topics, _ = topics_of(spark, 5)
    plan = retrieve.field_tokens(topics)._jdf.queryExecution().analyzed().toString()
    assert "array_intersect(_conclusion" in plan and ", _conclusion" not in "".join(x.split(")")[0] for x in plan.split("array_")[1:])


def test_a_part_has_few_groups(spark):
    """A part's groups are its topics times the queries: few enough to be counted without going through much memory."""
    topics, _ = topics_of(spark, 2)
    many = spark.range(60_000).select(F.col("id").cast("string").alias("slug"))
    assert retrieve.dealt(retrieve.field_tokens(topics), many).rdd.getNumPartitions() >= 30


def test_texts_are_tokenised_once(spark):
    """Spark must not push a question for the size of the lists below what makes them."""
    topics, _ = topics_of(spark, 5)
    plan = retrieve.field_tokens(shared.written(topics))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("2E80") == len(retrieve.WEIGHTS)


def test_lines_of_topics_are_taken_without_splitting_the_text(spark, tmp_path):
    """Title and description are the first two lines, whatever the text; nothing splits or copies the rest for them."""
    from loam.plans import inputs

    texts = [None, "", "\n", "\n\n", "one", "one\n", "one\ntwo", "one\n\nthree", "\ntwo\nthree", "a b c d\ntwo  x\nthree\nfour\n", "é\r\nü\x0bö\n", " \n "]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumns({"lang": F.lit("en"), "source": F.lit("src1")}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = inputs.topics(spark, str(tmp_path))
    lines = [None if t is None else t.split("\n", 2) for t in texts]
    want = [(i, None if x is None else x[0], x[1] if x and len(x) > 1 else "", None if x is None else x[0].split(" ")[:3]) for i, x in enumerate(lines)]
    assert rows(got.select("pos", "title", "description", "triggers")) == want
    assert "split(text" not in got._jdf.queryExecution().optimizedPlan().toString()
