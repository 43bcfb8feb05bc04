"""Prefix trie of conversations: chained digests name the prefixes, nodes are groups of equal ones."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import partitions, ship, staged, unstage

#: Turns of one chain, and conversation ids of one piece of a list, that a task holds together.
BLOCK, PIECE = 512, 4096
NODE = ["depth", "digest"]


def turns_of(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, nth (from 1), item (digest of role and text), chars: each turn, in the order of its turn number (null first). Null role
    or text counts as empty; turns of one number go by their digests; rows without a conversation are left out.

    Turns are numbered range by range, so a conversation of any length is shared by as many tasks as its turns fill."""
    role, text = (F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role_col, text_col))
    rows = conversations.select(
        F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)).alias("item"),
        F.length(text).cast("long").alias("chars"), F.monotonically_increasing_id().alias("place"),
    ).where("conv_id is not null")
    order = ["turn", "item", "place"]
    rows = staged(rows.repartitionByRange(2 * partitions(rows.sparkSession), "conv_id", *order).withColumn("part", F.spark_partition_id()), "trie-turns")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = staged(rows.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n")).select("conv_id", "part", before.alias("before")), "trie-starts")
    within = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order))
    return rows.withColumn("within", within).join(starts.hint("merge"), ["conv_id", "part"]).select("conv_id", (F.col("before") + F.col("within")).alias("nth"), "item", "chars")


def chained(rows: DataFrame, group: list[str], order: str, item: str) -> DataFrame:
    """rows with digest, that of the row before it in its group (empty at the first) and its own item, hashed; and before, the one
    that it was chained to. A task holds a batch of rows and one digest."""
    ship(rows.sparkSession)
    at = rows.columns.index(item)
    keys = [rows.columns.index(g) for g in group]

    def run(batches):
        import pyarrow as pa

        last, state = None, b""
        for batch in batches:
            own, before = [], []
            for *key, x in zip(*[batch.column(i).to_pylist() for i in keys], batch.column(at).to_pylist(), strict=True):
                if key != last:
                    last, state = key, b""
                before.append(state)
                state = hashlib.sha256(state + x).digest()
                own.append(state)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.binary()), pa.array(before, pa.binary())], names=[*batch.schema.names, "digest", "before"])

    schema = ", ".join(f"{n} {t}" for n, t in rows.dtypes) + ", digest binary, before binary"
    return rows.repartition(2 * partitions(rows.sparkSession), *group).sortWithinPartitions(*group, order).mapInArrow(run, schema)


def joined(a: Column, b: Column) -> Column:
    return F.unhex(F.sha2(F.concat(a, b), 256))


def prefixes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, depth, digest, parent (the digest of the prefix one shorter; empty at depth 1), chars: every prefix of each
    conversation. turns: conv_id, depth (from 1, without gaps), item, chars.

    Digests are chained within blocks of turns, and blocks within a conversation: no task has all of a long conversation.
    Equal sequences have equal digests at each depth, different ones different digests but for a collision of SHA-256."""
    rows = staged(chained(turns.withColumn("block", F.floor((F.col("depth") - 1) / block)), ["conv_id", "block"], "depth", "item").drop("item"), "trie-chains")
    # chained: the blocks up to this one, as one digest; full: the prefix that ends with this block.
    ends = chained(rows.where(F.col("depth") % block == 0).select("conv_id", "block", F.col("digest").alias("item")), ["conv_id"], "block", "item")
    full = F.when(F.col("block") == 0, F.col("item")).otherwise(joined(F.col("before"), F.col("item")))
    ends = staged(ends.select("conv_id", (F.col("block") + 1).alias("block"), F.col("digest").alias("blocks"), full.alias("full")), "trie-block-ends")
    first = F.col("block") == 0
    both = rows.join(ends.hint("merge"), ["conv_id", "block"], "left")
    parent = F.when(first, F.col("before")).when(F.octet_length("before") == 0, F.col("full")).otherwise(joined(F.col("blocks"), F.col("before")))
    return both.select("conv_id", "depth", F.when(first, F.col("digest")).otherwise(joined(F.col("blocks"), F.col("digest"))).alias("digest"), parent.alias("parent"), "chars")


def ends_of(members: DataFrame) -> DataFrame:
    """depth, digest, ends_sha256: hex digest of the ascending ids of the conversations that end at a node, joined by commas.

    Ids are sorted in ranges and joined piece by piece; what one task gets of a node is its pieces, in order, which it hashes one
    after the other."""
    ship(members.sparkSession)
    n = 2 * partitions(members.sparkSession)

    def runs(batches, columns):
        for batch in batches:
            yield from zip(*[batch.column(c).to_pylist() for c in columns], strict=True)

    def pieces(batches):
        import pyarrow as pa

        def flush():
            return pa.RecordBatch.from_pydict({"depth": pa.array([x[0] for x in out], pa.int64()), "digest": pa.array([x[1] for x in out], pa.binary()), "first": pa.array([x[2] for x in out], pa.int64()), "ids": pa.array([x[3] for x in out], pa.string())})

        out, node, ids = [], None, []
        for depth, digest, conv in runs(batches, ("depth", "digest", "conv_id")):
            if ids and (node != (depth, digest) or len(ids) == PIECE):
                out.append((*node, ids[0], ",".join(map(str, ids))))
                ids = []
            node = depth, digest
            ids.append(conv)
            if len(out) == 1024:
                yield flush()
                out = []
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
        yield flush()

    def digests(batches):
        import pyarrow as pa

        def flush():
            return pa.RecordBatch.from_pydict({"depth": pa.array([x[0] for x in out], pa.int64()), "digest": pa.array([x[1] for x in out], pa.binary()), "ends_sha256": pa.array([x[2] for x in out], pa.string())})

        out, node, hashed = [], None, None
        for depth, digest, ids in runs(batches, ("depth", "digest", "ids")):
            if node != (depth, digest):
                if node:
                    out.append((*node, hashed.hexdigest()))
                node, hashed = (depth, digest), hashlib.sha256(ids.encode())
            else:
                hashed.update(b"," + ids.encode())
            if len(out) == 1024:
                yield flush()
                out = []
        if node:
            out.append((*node, hashed.hexdigest()))
        yield flush()

    cut = members.select("depth", "digest", "conv_id").repartitionByRange(n, "depth", "digest", "conv_id").sortWithinPartitions("depth", "digest", "conv_id")
    cut = cut.mapInArrow(pieces, "depth long, digest binary, first long, ids string")
    return cut.repartition(n, "depth", "digest").sortWithinPartitions("depth", "digest", "first").mapInArrow(digests, "depth long, digest binary, ends_sha256 string")


def trie(rows: DataFrame, convs: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of conversations.

    rows: turns in order (conv_id, depth, item, chars); convs: every conversation (conv_id, total turns), those without turns too.
    A row a node: conv_id (smallest member), depth, digest, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Subtree sums: a chain of nodes with the same members is one segment, summed first; each segment is then exploded to all
    segments above it, whose sums are partial before the shuffle. A segment starts where another conversation leaves, and has no
    more segments above it than that one has turns, so the exploded rows are at most about twice the turns, however deep the trie.
    """
    prefix = staged(prefixes(rows, block), "trie-prefixes")
    grouped = prefix.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("parent").alias("parent"), F.max("chars").alias("chars"))
    nodes = staged(grouped, "trie-nodes")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).first()  # one row
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_convs").alias("parent_n"))
    below = staged(nodes.where("depth > 1").groupBy((F.col("depth") - 1).alias("depth"), F.col("parent").alias("digest")).agg(F.count(F.lit(1)).alias("n_children")), "trie-children")
    tree = nodes.join(above.hint("merge"), ["depth", "parent"], "left").join(below.hint("merge"), NODE, "left").select(
        *NODE, "conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
        F.when(F.col("depth") == 1, F.lit(root["conv_id"]).cast("long")).otherwise(F.col("parent_conv_id")).alias("parent_conv_id"),
        ((F.col("depth") == 1) | (F.col("parent_n") > F.col("n_convs"))).alias("top"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"),
    )
    tree = staged(tree, "trie-tree")
    segment = ["conv_id", "n_convs"]
    segments = staged(tree.groupBy(*segment).agg(F.min("depth").alias("top_depth"), F.sum("saved").alias("saved"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf")), "trie-segments")
    tops = staged(tree.where("top and n_convs > 1").select(*NODE, F.col("conv_id").alias("up_conv"), F.col("n_convs").alias("up_n")), "trie-tops")
    path = prefix.select("conv_id", *NODE).join(tops.hint("merge"), NODE).select("conv_id", "depth", "up_conv", "up_n")
    given = segments.where("saved > 0 or leaf > 0").join(path, "conv_id").where("depth < top_depth").groupBy("up_conv", "up_n").agg(F.sum("saved").alias("below_saved"), F.sum("leaf").alias("below_leaves"))
    sums = segments.join(given.select(F.col("up_conv").alias("conv_id"), F.col("up_n").alias("n_convs"), "below_saved", "below_leaves"), segment, "left")
    sums = staged(sums.select(*segment, (F.col("leaf") + F.coalesce("below_leaves", F.lit(0))).alias("n_leaves"), F.coalesce("below_saved", F.lit(0)).alias("below_saved")), "trie-sums")

    # Within a segment: what is saved from a node on, in blocks of depths. A conversation on its own saves nothing.
    parts = tree.where("n_convs > 1").withColumn("part", F.floor(F.col("depth") / block))
    later = F.coalesce(F.sum("saved").over(Window.partitionBy(*segment).orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = staged(parts.groupBy(*segment, "part").agg(F.sum("saved").alias("saved")).select(*segment, "part", later.alias("later")), "trie-later")
    own = F.sum("saved").over(Window.partitionBy(*segment, "part").orderBy(F.col("depth").desc()))
    shared = parts.withColumn("own", own).join(later.hint("merge"), [*segment, "part"]).withColumn("own", F.col("own") + F.col("later")).drop("part", "later")
    every = shared.unionByName(tree.where("n_convs = 1").withColumn("own", F.lit(0).cast("long")))

    cols = ["conv_id", "depth", "digest", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]
    inner = every.join(sums.hint("merge"), segment).withColumn("saved_tokens", F.col("own") + F.col("below_saved")).select(*cols)
    total = tree.agg(F.coalesce(F.sum("saved"), F.lit(0)).alias("saved_tokens"), F.count(F.when(F.col("n_children") == 0, 1)).alias("leaves"), F.count(F.when(F.col("depth") == 1, 1)).alias("n_children"))
    n = lambda x: F.lit(x).cast("long")
    top = total.where(F.lit(bool(root["n_convs"]))).select(n(root["conv_id"]).alias("conv_id"), n(0).alias("depth"), F.lit(b"").alias("digest"), n(None).alias("parent_conv_id"), n(root["n_convs"]).alias("n_convs"), "n_children", F.greatest(F.lit(1), "leaves").alias("n_leaves"), "saved_tokens")
    ends = prefix.select("conv_id", *NODE).join(convs.where("total > 0").select("conv_id", F.col("total").alias("depth")), ["conv_id", "depth"])
    ends = ends.select(*NODE, "conv_id").unionByName(convs.where("total = 0").select(n(0).alias("depth"), F.lit(b"").alias("digest"), "conv_id"))
    ends = staged(ends_of(ends), "trie-ends")
    unstage(nodes, below, segments, tops)
    return inner.unionByName(top).join(ends.hint("merge"), NODE, "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())))


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 6, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Conversations that share beginnings: the first h turns of conversation c - c % every (all if it has fewer, none if there is no such one), then
    c's own after its first h; h is the unsigned crc32 of the decimal c, modulo `most`. Returns turns (conv_id, depth, item, chars) and
    conversations (conv_id, total)."""
    turns = staged(turns_of(conversations, **columns), "trie-numbered")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.expr(f"conv_id - conv_id % {every}")
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).withColumns({"h": h, "base": base})
    firsts = turns.where((F.col("nth") < most) & (base == F.col("conv_id"))).groupBy(F.col("conv_id").alias("base")).agg(F.array_sort(F.collect_list(F.struct("nth", "item", "chars"))).alias("firsts"))
    convs = own.join(firsts, "base", "left").withColumn("taken", F.slice(F.coalesce("firsts", F.array().cast("array<struct<nth:bigint,item:binary,chars:bigint>>")), F.lit(1), F.col("h").cast("int")))
    convs = staged(convs.select("conv_id", "h", "taken", (F.size("taken") + F.greatest(F.lit(0), F.col("n") - F.col("h"))).alias("total")), "trie-convs")
    shared = convs.select("conv_id", F.explode("taken").alias("t")).select("conv_id", F.col("t.nth").alias("depth"), "t.item", "t.chars")
    rest = turns.join(convs.select("conv_id", "h", F.size("taken").alias("taken")).hint("merge"), "conv_id").where("nth > h")
    return rest.select("conv_id", (F.col("nth") - F.col("h") + F.col("taken")).alias("depth"), "item", "chars").unionByName(shared), convs.select("conv_id", "total")


def plain(conversations: DataFrame, **columns: str) -> tuple[DataFrame, DataFrame]:
    """Conversations as they are: turns and conversations for trie()."""
    turns = staged(turns_of(conversations, **columns), "trie-numbered").withColumnRenamed("nth", "depth")
    return turns, turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("total"))
