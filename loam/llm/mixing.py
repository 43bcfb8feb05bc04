"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import identity, n_words, partitions, staged, text_of

WEIGHTS, SHARE, REPEATS = (3, 1, 2), 1.5, 2
#: Hash ranges that a source is dealt into, so that a hot source has many tasks.
RANGES = 256
#: Ranges of finish time at most; each is a bound in an expression.
MAX_RANGES = 1024


def shuffled(id_col: Column) -> Column:
    """A document's place in the shuffle: 60 bits of its id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def water_level(sources: DataFrame, share: float, repeats: int) -> DataFrame:
    """sources (rank, source, source_size, weight) with target and budget.

    Targets: share * all sizes, dealt by weight, where no source gets more than repeats times its size. The amount
    that level L deals, sum of min(cap, L * weight), is concave, so L is the largest of the levels at which the
    budget meets its linear pieces: with the sources in order of cap / weight, piece i has the first i - 1 capped.
    """
    s = sources.withColumn("cap", F.col("source_size") * repeats).withColumn("ratio", F.col("cap").cast("double") / F.col("weight"))
    upto = Window.orderBy("ratio", "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({"budget": F.sum("source_size").over(every).cast("double") * share, "weights": F.sum("weight").over(every), "capped": F.coalesce(F.sum("cap").over(upto), F.lit(0)), "past": F.coalesce(F.sum("weight").over(upto), F.lit(0))})
    s = s.withColumn("level", F.max((F.col("budget") - F.col("capped")) / (F.col("weights") - F.col("past"))).over(every))
    return s.select("rank", "source", "source_size", "weight", "budget", F.when(F.col("ratio") <= F.col("level"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Draws share times all words from the sources by weight; a document is drawn at most repeats times.

    Sources, by code point with null last, take the weights in turn. Within its source each document gets a place by
    a hash of its id. Its virtual finish time is the words of its source up to and with it (for its n-th copy, n - 1
    whole sources more) divided by the source's weight. All copies are range-sorted by that time and cut where
    their words reach the budget. A source that has run out (repeats times) no longer takes its share, which so goes to
    the others by weight: the same as target, computed by water_level. Every source's words differ from its target by
    about a document.

    A row for each row of docs: doc_id, size (words), source, source_size, target, taken (words drawn), copies,
    text_key. Documents without words (null or empty text) are never drawn. Rows that repeat others are documents of
    their own. Empty table: no rows. Reruns agree.

    Scale: no window is over a whole source: a source is dealt into hash ranges, whose totals are summed first. The
    source table, of one row a source, is the only thing sorted in one task.
    """
    text = text_of(text_col)
    narrow = docs.select(*identity(id_col, text), n_words(text).alias("size"), F.col(f"`{source_col}`").cast("string").alias("source"), shuffled(F.col(f"`{id_col}`")).alias("place"))
    narrow = staged(narrow, "mix-rows")
    cols = [*narrow.columns]
    turn = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    sources = staged(water_level(sizes.withColumn("weight", turn), share, repeats), "mix-sources").withColumnRenamed("source", "its_source")
    rows = narrow.join(sources, narrow["source"].eqNullSafe(sources["its_source"])).drop("its_source")

    # The words of the source before this hash range, then those within it.
    rows = rows.withColumn("part", F.shiftright("place", 60 - RANGES.bit_length() + 1))
    before = Window.partitionBy("rank").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("rank", "part").agg(F.sum("size").alias("words")).select("rank", "part", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("rank", "part").orderBy("place", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("upto", F.sum("size").over(within)).join(parts, ["rank", "part"]).withColumn("upto", F.col("upto") + F.col("ahead"))
    rows = staged(rows.select(*cols, "source_size", "target", "budget", "weight", "rank", "upto"), "mix-places")

    def finish(n) -> Column:
        return (F.col("upto") + F.col("source_size") * n).cast("double") / F.col("weight")

    copies = rows.where("size > 0").select("rank", "size", "budget", F.explode(F.array(*[finish(n) for n in range(repeats)])).alias("finish"))
    cut = _cut(copies, min(MAX_RANGES, 4 * partitions(docs.sparkSession)))
    drawn = F.lit(0)
    if cut is not None:
        for n in range(repeats):
            drawn = drawn + F.when((F.col("size") > 0) & (F.struct(finish(n), F.col("rank")) <= F.struct(F.lit(cut[0]), F.lit(cut[1]))), 1).otherwise(0)
    return rows.withColumn("copies", drawn).select("doc_id", "size", "source", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies", "text_key")


def _cut(copies: DataFrame, ranges: int) -> tuple[float, int] | None:
    """Finish time and source rank of the last copy within the budget. Copies are dealt into ranges of finish time
    (bounds from a quantile sketch; any bounds give the same cut), summed range by range, then within each range."""
    bounds = sorted(set(copies.approxQuantile("finish", [i / ranges for i in range(1, ranges)], 0.25 / ranges)))
    dealt = copies.withColumn("part", _part(F.col("finish"), bounds))
    totals = dealt.groupBy("part").agg(F.sum("size").alias("words"))
    ahead = totals.select("part", F.coalesce(F.sum("words").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("part").orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, 0)
    run = dealt.withColumn("upto", F.sum("size").over(within)).join(ahead, "part")
    last = run.where(F.col("upto") + F.col("ahead") <= F.col("budget")).agg(F.max(F.struct("finish", "rank")).alias("m")).first()["m"]
    return None if last is None else (last["finish"], last["rank"])


def _part(value: Column, bounds: list[float]) -> Column:
    """How many bounds lie below value, by a search tree of comparisons."""
    if not bounds:
        return F.lit(0)

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(value <= F.lit(bounds[mid]), tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(bounds))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows that mix draws, with the columns of docs, each as many times as it is drawn. Rows that repeat both id
    and text are drawn as one of them, as many times as all together."""
    found = mix(docs, id_col=id_col, text_col=text_col, **options).where("copies > 0")
    found = staged(found.groupBy(F.col("doc_id").alias("k_doc"), F.col("text_key").alias("k_text")).agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("times")), "mix-drawn")
    keys = identity(id_col, text_of(text_col))
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *keys)

    def drawn(names: DataFrame) -> DataFrame:
        return rows.join(names.hint("merge"), rows["doc_id"].eqNullSafe(names["k_doc"]) & (rows["text_key"] == names["k_text"])).select("row", "k_doc", "k_text", "copies")

    out = drawn(found.where("times = 1"))
    if not (again := found.where("times > 1")).isEmpty():
        out = out.unionByName(drawn(again).dropDuplicates(["k_doc", "k_text"]))
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies").cast("long"))).alias("copy")).select("row.*")
