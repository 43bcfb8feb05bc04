"""Exact dedup by distributed MSD radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import ascii_lower, identity, partitions, release, same, staged, text_of, unstage

FIRST_DIGIT, GROWTH = 64, 8
#: Groups that are dealt into cells at most: those with more than one in so many of a round's grouped rows.
HOT = 256


def dealt(keyed: DataFrame, groups: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides of a join of rows with their groups, and its keys: a hot group's rows are dealt into cells, as many as its share of
    two rounds of partitions, and the group has a row a cell. Any other group is one cell. A row's cell comes from its name, not from its place,
    so that a task that runs again deals it alike. What the driver learns is HOT numbers."""
    name, total = F.xxhash64(*by), groups.agg(F.sum("group_size")).first()[0] or 0
    hot = {r["h"]: r["n"] for r in groups.where(F.col("group_size") * HOT > total).groupBy(name.alias("h")).agg(F.sum("group_size").alias("n")).collect()}
    n = [max(1, -(-2 * partitions(keyed.sparkSession) * x // total)) for x in hot.values()]
    cells = F.coalesce(F.try_element_at(F.map_from_arrays(F.lit(list(hot)), F.lit(n)), name), F.lit(1)) if hot else F.lit(1)
    rows = keyed.withColumn("cell", F.pmod(F.xxhash64("doc_id", "text_key", F.lit(5)), cells).cast("int"))
    return rows, groups.withColumn("cell", F.explode(F.sequence(F.lit(0), cells.cast("int") - 1))), [*by, "cell"]


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups documents whose texts are equal after lower-casing A-Z.

    All documents begin in one group. Each round splits every open group by the next digit of its texts, a run of
    successive bytes (64, then 8 times as many each round, so a text of n bytes takes about log n rounds). A document
    leaves when it is alone in its group, or when its text ended: then all that share its group are equal to it byte
    by byte, and no digest was needed. Only open documents go on, with the bytes that are left.

    A group larger than a task is no trouble: groups are counted with partial sums, and for the join that tells the
    documents their new group the rows of large groups are dealt into cells (see dealt), at any size of the table.

    Returns a row for each row of docs: doc_id, keep_id (largest id of the group; null if all are), group_size,
    kept (true for one row of each group, among rows that repeat the largest id too), text_sha256, text_key (names the row, see
    common.identity). Null texts count as empty; an empty table gives no rows.
    """
    raw = text_of(text_col)
    text = ascii_lower(raw)
    rows = docs.select(*identity(id_col, raw), F.sha2(text, 256).alias("text_sha256"), F.encode(text, "UTF-8").alias("rest"), F.lit(0).cast("long").alias("grp"))
    done, width, level = [], FIRST_DIGIT, 0
    while True:
        keyed = rows.withColumns({"digit": F.substring("rest", 1, width), "ended": F.octet_length("rest") <= width})
        groups = staged(
            keyed.groupBy("grp", "digit", "ended").agg(F.count(F.lit(1)).alias("group_size"), F.max("doc_id").alias("keep_id")).where("group_size > 1").withColumn("next", F.monotonically_increasing_id()),
            "radix-groups",
        )
        left, right, keys = dealt(keyed, groups, ["grp", "digit", "ended"])
        out = (
            left.join(right.hint("merge"), keys, "left")
            .withColumn("open", F.col("next").isNotNull() & ~F.col("ended"))
            .select(
                "doc_id", "text_key", "text_sha256", "open",
                F.when(F.col("next").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
                F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
                F.col("next").alias("grp"),
                F.when(F.col("open"), F.expr(f"substring(rest, {width + 1})")).alias("rest"),
                F.monotonically_increasing_id().alias("place"),
            )
        )
        out = staged(out, "radix-level")
        unstage(groups)
        done.append(out.where("not open").drop("open", "rest").withColumn("level", F.lit(level)))
        rows = out.where("open").select("doc_id", "text_key", "text_sha256", "rest", "grp")
        if rows.isEmpty():
            break
        width, level = width * GROWTH, level + 1
    every = reduce(DataFrame.unionByName, done)
    # Rows that repeat the largest id of a group: the first in place stays.
    release(docs.sparkSession)
    first = every.where("group_size > 1 and doc_id <=> keep_id").groupBy("level", "grp").agg(F.min("place").alias("place")).select("level", "place", F.lit(True).alias("won"))
    return every.join(first, ["level", "place"], "left").select("doc_id", "keep_id", "group_size", (F.col("won").isNotNull() | (F.col("group_size") == 1)).alias("kept"), "text_sha256", "text_key")


def drop_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that exact_duplicates drops; columns as they were. Rows that repeat both id and text
    (raw, not normalised) are one row afterwards."""
    found = exact_duplicates(docs, id_col, text_col)
    names = found.groupBy("doc_id", "text_key").agg(F.max("kept").alias("any_kept"), F.count(F.lit(1)).alias("times"))
    marked = staged(names.where("not any_kept or times > 1"), "radix-drops")
    return without(docs, marked, id_col, text_col)


def without(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs without the names in marked (doc_id, text_key, any_kept); of names with any_kept, one row stays."""
    keys = identity(id_col, text_of(text_col))
    row = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *[k.alias(n) for k, n in zip(keys, ("k_doc", "k_text"), strict=True)])
    gone = marked.select(F.col("doc_id").alias("k_doc"), F.col("text_key").alias("k_text"), "any_kept")
    out = row.join(gone.hint("merge"), same(row, gone, "k_doc", "k_text"), "left_anti")
    if not (again := gone.where("any_kept")).isEmpty():
        out = out.unionByName(row.join(again.hint("merge"), same(row, again, "k_doc", "k_text"), "left_semi").dropDuplicates(["k_doc", "k_text"]))
    return out.select("row.*")
