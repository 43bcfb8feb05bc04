"""Vector rerank of a score band, and upkeep of the vector index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.numbers import cosine, rounded


def usable(index: DataFrame) -> DataFrame:
    """Index entries whose vector has the stated size, without null, NaN or infinite components."""
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return index.where((F.col("dim") > 0) & (F.size("vec") == F.col("dim")) & finite)


def rerank_band(candidates: DataFrame, index: DataFrame, queries: DataFrame, floor: float, ceiling: float) -> DataFrame:
    """candidates (query_id, slug, gate_score, place) in a new order: those of the band [floor, ceiling) that have a
    vector by falling cosine to the query's (query_id, qvec), then all others as they were. Adds similarity (4 places;
    null outside) and rank."""
    rows = candidates.join(usable(index).select("slug", "vec"), "slug", "left").join(queries, "query_id", "left")
    in_band = (F.col("gate_score") >= floor) & (F.col("gate_score") < ceiling) & F.col("vec").isNotNull() & F.col("qvec").isNotNull()
    rows = rows.withColumn("exact", F.when(in_band, cosine(F.col("vec"), F.col("qvec"))))
    order = Window.partitionBy("query_id").orderBy(F.col("exact").isNull(), rounded(F.col("exact"), 9).desc(), "place")
    return rows.select("query_id", "slug", "gate_score", "place", rounded(F.col("exact"), 4).alias("similarity"), F.row_number().over(order).alias("rank"))


def splice_back(candidates: DataFrame, reranked: DataFrame, floor: float, ceiling: float) -> DataFrame:
    """The places that band members (by score) had among the candidates, given to the same members in reranked order."""
    band = (F.col("score") >= floor) & (F.col("score") < ceiling)
    slots = candidates.where(band).select("query_id", "place", F.row_number().over(Window.partitionBy("query_id").orderBy("place")).alias("nth"))
    members = candidates.where(band).select("query_id", "slug").join(reranked.select("query_id", "slug", "rank"), ["query_id", "slug"])
    members = members.withColumn("nth", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    moved = members.join(slots, ["query_id", "nth"]).select("query_id", "slug", "place")
    return moved.unionByName(candidates.where(~band).select("query_id", "slug", "place"))


def stale(roster: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """Slugs without a usable entry of this model; none if no model is set."""
    if not model:
        return roster.select("slug").limit(0)
    return roster.select("slug").join(index.where((F.col("model") == model) & (F.col("dim") > 0) & (F.size("vec") == F.col("dim"))), "slug", "left_anti")


def refreshed(index: DataFrame, fresh: DataFrame) -> DataFrame:
    """The index with the fresh entries in place of old ones."""
    return index.join(fresh.select("slug"), "slug", "left_anti").unionByName(fresh)
