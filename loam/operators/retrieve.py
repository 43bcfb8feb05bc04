"""Weighted lexical retrieval: scores of queries against topics, gates, top-k and near misses."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.numbers import rounded
from loam.functions.text import tokenize

# Weights of the fields, in the order in which their terms are added, and boosts.
WEIGHTS = {"triggers": 5.0, "title": 3.0, "slug": 2.0, "tags": 2.0, "description": 1.2, "conclusion": 0.8}
STRONG, BODY = ("triggers", "title", "slug"), ("description", "conclusion")
USAGE_MOST, RECENCY, CONFLICT, DECAY = 0.2, 0.2, 0.3, 0.5
NEAR_MISSES, EXTRA_SLOTS = 8, 2
#: The largest of all limits of a query's rows.
SHORTLIST = 12
#: Topics that are scored in one part, at most on average.
PART_TOPICS = 2_000


@dataclass(frozen=True)
class Retrieval:
    threshold: float = 0.3
    top_k: int = 4
    tag_boost: float = 0.15
    usage_boost: float = 0.15
    recency_days: int = 7
    graph_depth: int = 2
    gate: bool = True


def query_tokens(queries: DataFrame) -> DataFrame:
    """query_id, n_query, token: a row for each different token of each query."""
    q = queries.select("query_id", tokenize(F.col("text")).alias("tokens")).where(F.size("tokens") > 0)
    return q.select("query_id", F.size("tokens").alias("n_query"), F.explode("tokens").alias("token"))


def tokenized(topics: DataFrame) -> tuple[DataFrame, Column]:
    """Topics with the tokens of each field, and field_lists() of them as an expression."""
    text = lambda f: F.array_join(F.col(f), " ") if dict(topics.dtypes)[f].startswith("array") else F.coalesce(F.col(f), F.lit(""))
    names = list(WEIGHTS)
    bit = {f: 1 << i for i, f in enumerate(names)} | {"body": 1 << len(names)}
    rows = topics.select("slug", *[tokenize(text(f)).alias(f"_{f}") for f in names])
    tagged = lambda tokens, bits: F.struct(F.lit(bits).alias("fields"), tokens.alias("tokens"))
    # Spark makes a set of the array on the right: of the description, which is short, never of the conclusion.
    rows = rows.withColumn("_both", F.array_intersect("_conclusion", "_description"))
    lists = [tagged(F.col(f"_{f}"), bit[f]) for f in names if f not in BODY]
    lists += [tagged(F.col("_conclusion"), bit["conclusion"] | bit["body"]), tagged(F.col("_both"), bit["description"])]
    lists += [tagged(F.array_except("_description", "_both"), bit["description"] | bit["body"])]
    return rows, F.array(*lists)


def field_lists(topics: DataFrame) -> DataFrame:
    """slug, lists: a row for each topic, with the different tokens of each field (tokens) and the field as a bit in the order of WEIGHTS (fields). One list of each
    token of the body (description or conclusion) has the bit after those too. Made row by row, without a shuffle."""
    rows, lists = tokenized(topics)
    return rows.select("slug", lists.alias("lists"))


def listed_tokens(rows: DataFrame, lists: Column | str = "lists") -> DataFrame:
    """slug, token, fields: a row for each token of each list of field_lists()."""
    return rows.select("slug", F.explode(lists).alias("x")).select("slug", F.explode("x.tokens").alias("token"), "x.fields")


def field_tokens(topics: DataFrame) -> DataFrame:
    """slug, token, fields: a row for each different token of each field, with the fields as field_lists() has them."""
    return listed_tokens(*tokenized(topics))  # of a column of lists Spark would ask the size first, and tokenise for that as well


def field_counts() -> list[Column]:
    """n_triggers to n_conclusion and n_body: how many of the tokens met are in each field."""
    bits = {f: F.lit(1 << i) for i, f in enumerate((*WEIGHTS, "body"))}
    return [F.count(F.when(F.col("fields").bitwiseAND(b) > 0, 1)).alias(f"n_{f}") for f, b in bits.items()]


def lexical(cfg: Retrieval) -> Column:
    """What the fields add, in the order of their weights, and the boost for tags."""
    s = sum((F.lit(w) * (F.col(f"n_{f}") / F.col("n_query")) for f, w in list(WEIGHTS.items())[1:]), F.lit(WEIGHTS["triggers"]) * (F.col("n_triggers") / F.col("n_query")))
    return s + F.when(F.col("n_tags") > 0, cfg.tag_boost).otherwise(0.0)


def score_topics(queries: DataFrame, topics: DataFrame, cfg: Retrieval = Retrieval(), usage: DataFrame | None = None, conflicts: DataFrame | None = None, zero_open: DataFrame | None = None, now: str | None = None, postings: DataFrame | None = None) -> DataFrame:
    """query_id, slug, pos, score, gate_score, strong, body_hits of every query and topic that share a token.

    The tokens of queries and topics are joined by token, so nothing is compared that has no token in common. Postings of tokens that some query has are
    dealt by topic first: what a topic and a query share is then counted where it is met, and neither texts, other postings nor the tokens shared are shuffled. usage
    (slug, hits, opens), conflicts and zero_open (slug) and now add their terms only where given. Where only scores from a floor on are
    wanted, postings.search() meets fewer. postings: field_tokens() of the topics, where there are some already.
    """
    tokens = query_tokens(queries)
    shared = tokens.join(dealt(asked(topics, postings, tokens), topics), "token")
    found = shared.groupBy("query_id", "slug").agg(F.max("n_query").alias("n_query"), *field_counts())
    return scores(found, topics, cfg, usage, conflicts, zero_open, now)


def asked(topics: DataFrame, postings: DataFrame | None, tokens: DataFrame) -> DataFrame:
    """Postings (those of the topics, unless given) of these tokens. Found where the postings are made."""
    postings = field_tokens(topics) if postings is None else postings
    return postings.join(tokens.select("token"), "token", "left_semi")


def dealt(postings: DataFrame, topics: DataFrame) -> DataFrame:
    """Postings dealt by slug, in so many parts that what is counted in one doesn't grow with the topics, which are counted first."""
    spark = topics.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-topics.count() // PART_TOPICS))
    return postings.repartition(parts, "slug")


def scores(found: DataFrame, topics: DataFrame, cfg: Retrieval = Retrieval(), usage: DataFrame | None = None, conflicts: DataFrame | None = None, zero_open: DataFrame | None = None, now: str | None = None) -> DataFrame:
    """score_topics() of counted tokens: found has query_id, slug, n_query and the counts by field."""
    found, s = found.withColumnRenamed("n_body", "body_hits"), lexical(cfg)
    found = found.join(topics.select("slug", "pos", "generated_at").hint("shuffle_hash"), "slug")
    if usage is not None:
        found = found.join(usage.select("slug", (F.col("hits") + F.col("opens")).alias("uses")), "slug", "left")
        s = s + F.when((s > 0) & (F.col("uses") > 0), min(cfg.usage_boost, USAGE_MOST)).otherwise(0.0)
    recent: Column = F.lit(0.0)
    if now is not None and cfg.recency_days > 0:
        age = F.timestamp_diff("MICROSECOND", F.col("generated_at"), F.lit(now).cast("timestamp_ntz"))
        recent = F.when((s > 0) & age.between(0, cfg.recency_days * 86_400_000_000), RECENCY).otherwise(0.0)
    for marked, factor, name in ((conflicts, CONFLICT, "conflict"), (zero_open, DECAY, "decay")):
        if marked is not None:
            found = found.join(marked.select("slug", F.lit(True).alias(name)).distinct(), "slug", "left")
            s = s * F.when(F.col(name), factor).otherwise(1.0)
    strong = (F.col("n_triggers") > 0) | (F.col("n_title") > 0) | (F.col("n_slug") > 0)
    return found.select("query_id", "slug", "pos", rounded(s + recent, 3).alias("score"), rounded(s, 3).alias("gate_score"), strong.alias("strong"), F.col("body_hits"))


def passes_gate() -> Column:
    return F.col("strong") | (F.col("body_hits") >= 2)


def best(scored: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n of each query, as rank 1 to n; by default by falling score, then in roster order."""
    order = order or (F.col("score").desc(), F.col("pos"))
    return scored.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col("rank") <= n)


def shortlist(scored: DataFrame, cfg: Retrieval = Retrieval(), n: int = SHORTLIST) -> DataFrame:
    """The rows of which hits(), near_misses(), explicit_search() and slow_candidates() of all rows are made, for limits up to n: the first n of each
    query among those that pass, that the gate keeps out, and that miss the threshold by half of it at most."""
    over = F.col("gate_score") >= cfg.threshold
    kind = F.when(over & passes_gate(), 0).when(over, 1).when(F.col("gate_score") >= cfg.threshold * 0.5, 2)
    first = Window.partitionBy("query_id", "kind").orderBy(F.col("score").desc(), "pos")
    return scored.withColumn("kind", kind).where("kind is not null").withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= n).drop("kind", "nth")


def hits(scored: DataFrame, cfg: Retrieval = Retrieval()) -> DataFrame:
    ok = F.col("gate_score") >= cfg.threshold
    return best(scored.where(ok & passes_gate() if cfg.gate else ok), cfg.top_k)


def near_misses(scored: DataFrame, cfg: Retrieval = Retrieval()) -> DataFrame:
    """Up to eight: first those that only the structural gate kept out (up to top_k), then those from half the threshold."""
    blocked = best(scored.where((F.col("gate_score") >= cfg.threshold) & ~passes_gate() & F.lit(cfg.gate)), cfg.top_k)
    floor = best(scored.where((F.col("gate_score") >= cfg.threshold * 0.5) & (F.col("gate_score") < cfg.threshold)), NEAR_MISSES)
    both = blocked.withColumn("band", F.lit("gate-blocked")).unionByName(floor.withColumn("band", F.lit("near-floor")))
    return best(both, NEAR_MISSES, F.when(F.col("band") == "gate-blocked", 0).otherwise(1), F.col("rank"))


def explicit_search(scored: DataFrame, cfg: Retrieval = Retrieval()) -> DataFrame:
    return hits(scored, Retrieval(threshold=cfg.threshold, top_k=max(cfg.top_k, 8), gate=False))


def slow_candidates(scored: DataFrame, exclude: DataFrame, cfg: Retrieval = Retrieval(), fetch: int = 12, take: int = 6) -> DataFrame:
    """Ungated hits and then near misses, without the excluded (query_id, slug), six a query."""
    open_cfg = Retrieval(threshold=cfg.threshold, top_k=fetch, gate=False)
    both = hits(scored, open_cfg).withColumn("lane", F.lit(0)).unionByName(near_misses(scored, open_cfg).drop("band").withColumn("lane", F.lit(1)))
    return best(both.join(exclude, ["query_id", "slug"], "left_anti"), take, F.col("lane"), F.col("rank")).drop("lane")


def lesson_match(scored: DataFrame, lessons: DataFrame) -> DataFrame:
    """The best lesson of each query, among those that a trigger word matched."""
    return best(scored.join(lessons.select("slug"), "slug", "left_semi").where("by_trigger"), 1)


def trigger_matches(queries: DataFrame, topics: DataFrame) -> DataFrame:
    bit = 1 << list(WEIGHTS).index("triggers")
    return query_tokens(queries).join(field_tokens(topics), "token").where(F.col("fields").bitwiseAND(F.lit(bit)) > 0).select("query_id", "slug").distinct()


def session_filter(found: DataFrame, injected: DataFrame, distilled: DataFrame) -> DataFrame:
    """found (session, slug, ...) with outcome: deduped if the session has had the slug, else echoed if the slug came
    out of the session itself, else fresh."""
    a = injected.select("session", "slug", F.lit(True).alias("had")).distinct()
    b = distilled.select("session", "slug", F.lit(True).alias("own")).distinct()
    both = found.join(a, ["session", "slug"], "left").join(b, ["session", "slug"], "left")
    return both.withColumn("outcome", F.when(F.col("had"), "deduped").when(F.col("own"), "echoed").otherwise("fresh")).drop("had", "own")


def graph_expansion(found: DataFrame, edges: DataFrame, cfg: Retrieval = Retrieval()) -> DataFrame:
    """Hits with neighbours over undirected edges, up to top_k + 2 a query: query_id, slug, score, depth. edges: src, dst, ord (place among
    the references of src) and back (place of src in the roster); a node's own references come first, then what refers to it.

    Breadth first: at depth d a neighbour gets its parent's score * 0.5 ** d, the parent's own decay included. A node is
    met once, by its first parent in rank order and there by edge order, and then neither passes on nor takes a slot if it
    misses the threshold or no slot is left. Each depth is two joins; the number of slots bounds what is carried on.
    """
    both = edges.select(F.col("src").alias("from"), F.col("dst").alias("slug"), F.lit(0).alias("way"), "ord").unionByName(edges.select(F.col("dst").alias("from"), F.col("src").alias("slug"), F.lit(1).alias("way"), F.col("back").alias("ord")))
    out = found.select("query_id", "slug", F.col("gate_score").alias("value"), "score", "rank", F.lit(0).alias("depth"))
    frontier, met = out, out.select("query_id", "slug")
    for depth in range(1, cfg.graph_depth + 1):
        step = frontier.select("query_id", F.col("slug").alias("from"), F.col("value").alias("above"), F.col("rank").alias("parent")).join(both, "from")
        first = Window.partitionBy("query_id", "slug").orderBy("parent", "way", "ord")
        new = step.join(met, ["query_id", "slug"], "left_anti").withColumn("nth", F.row_number().over(first)).where("nth = 1")
        met = met.unionByName(new.select("query_id", "slug"))
        new = new.withColumn("value", F.col("above") * F.lit(0.5**depth)).where(F.col("value") >= cfg.threshold)
        taken = out.groupBy("query_id").agg(F.count(F.lit(1)).alias("have"))
        order = Window.partitionBy("query_id").orderBy("parent", "way", "ord", "slug")
        new = new.join(taken, "query_id").withColumn("rank", F.col("have") + F.row_number().over(order)).where(F.col("rank") <= cfg.top_k + EXTRA_SLOTS)
        frontier = new.select("query_id", "slug", "value", rounded(F.col("value"), 3).alias("score"), F.col("rank").cast("int").alias("rank"), F.lit(depth).alias("depth"))
        out = out.unionByName(frontier)
    return out.select("query_id", "slug", "score", "rank", "depth")


def adopted_picks(answers: DataFrame, adopt: float = 0.6, most: int = 2) -> DataFrame:
    """The likeliest answers (query_id, slug, probability) of each query in the adopt band."""
    ok = answers.where(F.col("probability").between(adopt, 1.0))
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("probability").desc(), "slug"))).where(F.col("rank") <= most)


def regate(picks: DataFrame, scored: DataFrame) -> DataFrame:
    """picks (query_id, slug) with whether the structural gate would pass them, and why. Nothing is left out."""
    both = picks.join(scored.select("query_id", "slug", "strong", "body_hits"), ["query_id", "slug"], "left").fillna({"strong": False, "body_hits": 0})
    return both.select("query_id", "slug", passes_gate().alias("pass"), F.when(F.col("strong"), "strong").otherwise(F.concat(F.lit("body-hits:"), F.col("body_hits").cast("string"))).alias("why"))
