"""Groups that no task holds whole: dealing their pairs to tasks block by block, and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import partitions, staged, unstage

SMALL, LARGE = 64, 2048


def dealt(members: DataFrame, group: str, member: str, weight: str, heaviest: int) -> DataFrame:
    """members with columns a, b and own: every two members of a group meet in a task (group, a, b).

    A group of up to a block goes to one task. A larger one is dealt into blocks by a hash of the member, and each pair
    of blocks is a task; a member goes to as many tasks as its group has blocks, under the number of its own block. The size of a
    block follows the mean load of a task, between SMALL and LARGE members, and its members weigh no more than heaviest on average.
    """
    spark = members.sparkSession
    block = max(SMALL, min(LARGE, members.count() // (8 * partitions(spark))))
    blocks = F.least(F.col("n_group"), F.greatest(F.ceil(F.col("n_group") / block), F.ceil(F.col("held") / heaviest))).cast("int")
    large = members.groupBy(group).agg(F.count(F.lit(1)).alias("n_group"), F.sum(weight).alias("held"))
    large = staged(large.select(group, blocks.alias("blocks")).where("blocks > 1"), "large-groups")
    rows = members.join(large.hint("merge"), group, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64(member, F.lit(11)), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return rows.withColumns({"a": F.least("own", "other"), "b": F.greatest("own", "other")}).drop("blocks", "other")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.repartition(4 * partitions(rows.sparkSession), *keys)


def _min_neighbour(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def components(edges: DataFrame) -> DataFrame:
    """node, component: each node of the edges (u, v; longs) and the smallest node it is connected to.

    Alternating large-star and small-star rounds: each node hands its larger (then smaller) neighbours to its smallest
    one, until every component is a star; the rounds grow with the logarithm of the longest path. Minima are partial sums; the joins
    have one row a node on one side, so that hot nodes can be split.
    """
    now = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    sign = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = staged(_min_neighbour(both).select("u", F.least("u", "m").alias("m")), "stars")
        large = both.where(F.col("v") > F.col("u")).join(low.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = staged(large, "edges")
        least = staged(_min_neighbour(large), "stars")
        small = large.join(least.hint("merge"), "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        small = staged(small, "edges")
        unstage(now, low, large, least)
        now = small
        r = now.agg(F.count(F.lit(1)).alias("n"), F.sum(_sign(F.col("u"), F.col("v"))).alias("s")).first()
        if sign == (r["n"], r["s"]):
            break
        sign = (r["n"], r["s"])
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _sign(u: Column, v: Column) -> Column:
    return F.shiftright(F.xxhash64(u, v), 24)


class Forest:
    """Union-find over places 0 to n - 1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j
