"""N-gram Jaccard join by signature trees."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import identity, release, ship, staged, text_of, unstage
from loam.llm.grouping import Forest, components, dealt, spread
from loam.llm.shingles import sets

#: Entries of a leaf, and children of a node.
LEAF, FANOUT = 8, 4
#: Shingles in at least one of so many documents of a slice may be common; at most so many of the commonest are told to all tasks.
COMMON_SHARE, COMMON = 4000, 400_000
#: Shingles of a block of full sets, on average (8 bytes each).
BLOCK_SHINGLES = 2 << 20


# --- signature trees ---------------------------------------------------------------------------------------------


def width_of(size: int) -> int:
    """Bits of a set's bitmap: two to four a shingle, a power of two."""
    return max(64, 1 << (2 * size - 1).bit_length())


def signature(s: np.ndarray) -> bytes:
    """Bitmap of a set: bit (hash mod width) of each shingle."""
    w = width_of(len(s))
    bits = np.zeros(w, dtype=bool)
    bits[(s & np.uint64(w - 1)).astype(np.int64)] = True
    return np.packbits(bits, bitorder="little").tobytes()


def folded(bits: int, width: int, to: int) -> int:
    """The bitmap that the set would have at a smaller width."""
    while width > to:
        width //= 2
        bits = (bits >> width) | (bits & ((1 << width) - 1))
    return bits


@dataclass
class Node:
    """low and high: smallest and largest set below; bits: their bitmaps, OR-combined; slack: the most by which a set is
    larger than its bitmap has bits; done: what a traversal has found out about all sets below (a place, or -1)."""

    low: int
    high: int
    bits: int
    slack: int
    places: list[int]
    children: list[Node] = field(default_factory=list)
    done: int = -1


def tree(places: list[int], sizes: list[int], bits: list[int]) -> Node:
    """A tree over sets of one width, packed from the leaves up in the order of their sizes."""
    order = sorted(places, key=lambda i: sizes[i])
    level = []
    for i in range(0, len(order), LEAF):
        own, all_bits = order[i : i + LEAF], 0
        for j in own:
            all_bits |= bits[j]
        level.append(Node(sizes[own[0]], sizes[own[-1]], all_bits, max(sizes[j] - bits[j].bit_count() for j in own), own))
    while len(level) > 1:
        up = []
        for i in range(0, len(level), FANOUT):
            own, all_bits = level[i : i + FANOUT], 0
            for x in own:
                all_bits |= x.bits
            up.append(Node(own[0].low, own[-1].high, all_bits, max(x.slack for x in own), [], own))
        level = up
    return level[0]


def need(x: int, y: int, percent: int) -> int:
    """The least overlap of two sets of these sizes whose Jaccard similarity is at least percent / 100."""
    return -(-percent * (x + y) // (100 + percent))


def node_pair_may_link(a: Node, b: Node, percent: int) -> bool:
    """No pair below can link if even the nearest sizes are too far apart, or if the bits that both nodes have, with
    the shingles that share a bit, are fewer than the least overlap that any pair needs. With p for percent / 100 a pair needs at least
    p times its larger set, and so at least p times the larger of the two smallest sizes."""
    if 100 * b.high < percent * a.low or 100 * a.high < percent * b.low:
        return False
    return (a.bits & b.bits).bit_count() + min(a.slack, b.slack) >= -(-percent * max(a.low, b.low) // 100)


def pair_may_link(x: int, y: int, bx: int, by: int, percent: int) -> bool:
    """Each bit that only one set has stands for a shingle at least that the other lacks."""
    if 100 * min(x, y) < percent * max(x, y):
        return False
    least = need(x, y, percent)
    return x - (bx & ~by).bit_count() >= least and y - (by & ~bx).bit_count() >= least


def dual(a: Node, b: Node, percent: int, visit, settled) -> None:
    """Calls visit(leaf, leaf) for the pairs of leaves that no bound rules out and that aren't settled(node, node) by what was found
    before; of a tree with itself each pair once."""
    stack = [(a, b)]
    while stack:
        a, b = stack.pop()
        if (a is not b and not node_pair_may_link(a, b, percent)) or settled(a, b):
            continue
        if a.places and b.places:
            visit(a, b)
        elif a is b:
            c = a.children
            stack.extend((c[i], c[j]) for i in range(len(c)) for j in range(i, len(c)))
        elif b.places or (a.children and a.high >= b.high):
            stack.extend((x, b) for x in a.children)
        else:
            stack.extend((a, x) for x in b.children)


def traverse(sizes: list[int], bitmaps: list[bytes], own: list[int] | None, percent: int, meet, settled) -> None:
    """Calls meet(i, j) for the pairs of places that bitmaps can't rule out, but those below settled nodes. own: the block of each
    member, if a task has two different ones; then only pairs across the blocks count. Sets that can link have widths that differ at
    most by factors that folding evens out."""
    bits = [int.from_bytes(b, "little") for b in bitmaps]
    widths = [8 * len(b) for b in bitmaps]
    two = own is not None and len(set(own)) > 1
    classes: dict[int, list[int]] = {}
    for i, w in enumerate(widths):
        classes.setdefault(w, []).append(i)
    for w, members in sorted(classes.items()):
        wide = 2 * w
        near = []
        while 100 * (w // 2) >= percent * (wide // 4):  # sizes of width w go up to w / 2; of `wide` from wide / 4
            near += classes.get(wide, [])
            wide *= 2
        at = {i: bits[i] for i in members} | {i: folded(bits[i], widths[i], w) for i in near}

        def visit(a: Node, b: Node, at=at) -> None:
            for n, i in enumerate(a.places):
                for j in b.places[n + 1 :] if a is b else b.places:
                    if (not two or own[i] != own[j]) and pair_may_link(sizes[i], sizes[j], at[i], at[j], percent):
                        meet(i, j)

        if len(members) + len(near) <= 1:
            continue
        lower = tree(members, sizes, at)
        dual(lower, lower, percent, visit, settled)
        if near:
            dual(lower, tree(near, sizes, at), percent, visit, settled)


def able_members(sizes: list[int], bitmaps: list[bytes], own: list[int] | None, percent: int) -> set[int]:
    """Places that bitmaps let link with another one. Nodes all of which are known to be so don't meet again."""
    hit: set[int] = set()

    def all_hit(x: Node) -> bool:
        if x.done < 0 and (all(i in hit for i in x.places) if x.places else all(all_hit(c) for c in x.children)):
            x.done = 0
        return x.done == 0

    traverse(sizes, bitmaps, own, percent, lambda i, j: hit.update((i, j)), lambda a, b: all_hit(a) and all_hit(b))
    return hit


def linked_members(full: list[np.ndarray], own: list[int] | None, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets (sorted hashes), verified on the sets. What is connected already doesn't meet again, neither
    member by member nor node by node, so a group of near copies costs few verifications more than it has members."""
    forest, out = Forest(len(full)), []

    def one(x: Node) -> int:
        """A place below the node if all that are below it are connected, else -1."""
        if x.done < 0:
            first = [x.places[0]] if x.places else [one(x.children[0])]
            rest = (x.places[1:] if x.places else (one(c) for c in x.children[1:])) if first[0] >= 0 else [-1]
            root = forest.root(first[0]) if first[0] >= 0 else -1
            if root >= 0 and all(i >= 0 and forest.root(i) == root for i in rest):
                x.done = first[0]
        return x.done

    def settled(a: Node, b: Node) -> bool:
        i = one(a)
        if i < 0 or (j := one(b)) < 0:
            return False
        return forest.root(i) == forest.root(j)

    def meet(i: int, j: int) -> None:
        if forest.root(i) == forest.root(j):
            return
        a, b = (full[i], full[j]) if len(full[i]) <= len(full[j]) else (full[j], full[i])
        at = np.minimum(np.searchsorted(b, a), len(b) - 1)
        shared = int((b[at] == a).sum())
        if 100 * shared >= percent * (len(a) + len(b) - shared):
            forest.join(i, j)
            out.append((i, j))

    traverse([len(s) for s in full], [signature(s) for s in full], own, percent, meet, settled)
    return out


# --- the join ----------------------------------------------------------------------------------------------------


def prefix(s: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles of a set, in an order that puts the common ones last, of which two sets that link must share
    one: as many as can be missing from the overlap, and one more."""
    n = len(s)
    if n and len(common):
        at = np.minimum(np.searchsorted(common, s), len(common) - 1)
        late = common[at] == s
        s = np.concatenate([s[~late], s[late]])
    return s[: n - -(-percent * n // 100) + 1]


def node_of(s: np.ndarray) -> int:
    """A set's name: 64 bits of it."""
    if not len(s):
        return 0
    with np.errstate(over="ignore"):
        x = np.add.reduce(s) * np.uint64(0x9E3779B97F4A7C15) ^ np.bitwise_xor.reduce(s * np.uint64(0xBF58476D1CE4E5B9)) ^ np.uint64(len(s))
    return int(x.astype(np.uint64).view(np.int64))


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(np.uint64).view(np.int64)


def in_arrow(batches, rows: int = 512):
    for whole in batches:
        for i in range(0, whole.num_rows, rows):
            yield whole.slice(i, rows)


def encoded(batch, name: str = "text") -> list[bytes]:
    return [x.encode() for x in batch.column(name).to_pylist()]


def described(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_key, node, n (size of the set), sig; and, in rows of their own (n null), shingles that are common in
    a slice of documents and in how many of them they are."""

    def run(batches):
        import pyarrow as pa

        schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("node", pa.int64()), ("n", pa.int32()), ("sig", pa.binary()), ("common", pa.list_(pa.int64())), ("times", pa.list_(pa.int32()))])
        held, size = [], 0

        def commons():
            u, c = np.unique(np.concatenate(held), return_counts=True)
            often = c >= max(3, len(held) / COMMON_SHARE)
            return pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.int32()), pa.nulls(1, pa.binary()), pa.array([signed(u[often]).tolist()], pa.list_(pa.int64())), pa.array([c[often].tolist()], pa.list_(pa.int32()))], schema=schema)

        for batch in in_arrow(batches):
            found = list(sets(encoded(batch), k))
            m = len(found)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_key"), pa.array([node_of(s) for s in found], pa.int64()), pa.array([len(s) for s in found], pa.int32()), pa.array([signature(s) if len(s) else b"" for s in found], pa.binary()), pa.nulls(m, pa.list_(pa.int64())), pa.nulls(m, pa.list_(pa.int32()))], schema=schema)
            held += found
            size += sum(map(len, found))
            if size > 4 << 20:
                yield commons()
                held, size = [], 0
        if size:
            yield commons()

    return docs.mapInArrow(run, "doc_id long, text_key long, node long, n int, sig binary, common array<long>, times array<int>")


def postings(docs: DataFrame, k: int, percent: int, common) -> DataFrame:
    """h, node, n: the prefix of each different set of a task's documents."""

    def run(batches):
        import pyarrow as pa

        known, seen = common.value, set()
        for batch in in_arrow(batches):
            hs, nodes, ns = [np.empty(0, np.uint64)], [], []
            for s in sets(encoded(batch), k):
                if len(s) and (node := node_of(s)) not in seen:
                    seen.add(node)
                    hs.append(prefix(s, known, percent))
                    nodes.append(np.full(len(hs[-1]), node, dtype=np.int64))
                    ns.append(np.full(len(hs[-1]), len(s), dtype=np.int32))
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(signed(np.concatenate(hs))), pa.array(np.concatenate(nodes)), pa.array(np.concatenate(ns))], names=["h", "node", "n"])

    return docs.select("text").mapInArrow(run, "h long, node long, n int")


def n_gram_join(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Connected components of documents under: Jaccard similarity of their sets of k-word shingles >= percent / 100.

    A row for each row of docs: doc_id, n_shingles, component_id (smallest id in the component; of null ids alone,
    null), text_key. Words are split at ASCII white space, A-Z lower-cased. Null or blank texts have no shingles and
    link with nothing. Rows that repeat others are in one component with them. Empty table: no rows.

    1. Documents with equal sets are one node (64-bit name). 2. Roots of the signature trees: two sets that link share
    a shingle of their prefixes; common shingles come last in the order of prefixes, so passages that many documents share
    bring few together. Of the nodes that share a prefix shingle the smallest is its pivot, and the nodes with one pivot
    form a tree. 3. In each tree, dealt block by block, a dual traversal over OR-combined bitmaps and size ranges leaves the nodes that
    may link with another one. 4. Those nodes' full sets go to the same trees, where the remaining pairs are verified exactly,
    but for pairs that are connected already; so a task returns at most a link for each node. 5. Components of the links.
    Equal bits of 64-bit hashes stand for equal shingles and sets.
    """
    spark = docs.sparkSession
    ship(spark)
    text = text_of(text_col)
    rows = docs.select(*identity(id_col, text), text.alias("text"))
    every = staged(described(rows, k), "sets")
    often = every.where("n is null").select(F.explode(F.arrays_zip("common", "times")).alias("x")).groupBy("x.common").agg(F.sum("x.times").alias("times"))
    often = staged(often, "common")
    common = spark.sparkContext.broadcast(np.sort(np.array([r[0] for r in _commonest(often, COMMON).collect()], dtype=np.int64).view(np.uint64)))  # 3.2 MB at most
    unstage(often)
    every = every.where("n is not null").select("doc_id", "text_key", "node", "n", "sig")

    posts = postings(rows, k, percent, common)
    pivots = posts.groupBy("h").agg(F.min("node").alias("pivot"), F.max("node").alias("last")).where("pivot <> last").select("h", "pivot")
    pivots = staged(pivots, "pivots")
    release(spark)
    members = posts.join(pivots.hint("merge"), "h").select("pivot", "node", "n").distinct()
    members = staged(members, "members")
    release(spark)
    sigs = every.select("node", "n", "sig").where("n > 0").groupBy("node", "n").agg(F.first("sig").alias("sig"))
    able = staged(_survivors(dealt(members, "pivot", "node", "n", 8 * BLOCK_SHINGLES).join(sigs.hint("merge"), ["node", "n"]), percent), "survivors")
    release(spark)

    # The sets of the nodes that are left, each from one document that has it.
    picked = able.select("node").distinct()
    one = every.groupBy("node").agg(F.min(F.struct("doc_id", "text_key")).alias("x")).join(picked.hint("merge"), "node").select(F.col("x.doc_id").alias("k_doc"), F.col("x.text_key").alias("k_text"))
    texts = rows.join(one.distinct().hint("merge"), rows["doc_id"].eqNullSafe(F.col("k_doc")) & (rows["text_key"] == F.col("k_text"))).select("text")
    full = staged(_full_sets(texts, k), "full-sets")
    release(spark)
    found = _links(dealt(able, "pivot", "node", "n", BLOCK_SHINGLES).join(full.hint("merge"), "node"), percent)
    links = staged(found, "links")
    unstage(pivots, members, able, full)

    labels = components(links)
    nodes = every.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("first"))
    nodes = nodes.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("component", "node"))
    nodes = staged(nodes, "nodes")
    # Written first, so that a component of very many nodes can be split in the join.
    firsts = staged(nodes.groupBy("component").agg(F.min("first").alias("component_id")), "firsts")
    named = staged(nodes.join(firsts.hint("merge"), "component").select("node", "component_id"), "named")
    unstage(links, nodes, firsts)
    cols = lambda component: ["doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), "text_key"]
    out = every.where("n > 0").join(named.hint("merge"), "node").select(*cols(F.col("component_id")))
    return out.unionByName(every.where("n = 0").select(*cols(F.col("doc_id"))))


def _commonest(often: DataFrame, most: int) -> DataFrame:
    """The shingles (common) that are so often (times) that at most `most` are as often or more: by counts of ranges of times, eighths of
    powers of two, of which there are a few hundred at most."""
    band = F.floor(8 * F.log2("times")).cast("int")
    held, least = 0, None
    for r in often.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("band").desc()).collect():
        if (held := held + r["n"]) > most:
            break
        least = r["band"]
    return often.where(band >= least if least is not None else F.lit(False)).select("common")


def _lists(rows: DataFrame, *cols: str) -> DataFrame:
    """A row for each task of dealt members, with their columns as parallel lists."""
    return spread(rows, "pivot", "a", "b").groupBy("pivot", "a", "b").agg(F.collect_list(F.struct(*cols)).alias("m")).where(F.size("m") > 1).select("pivot", "m")


def _each(batches):
    for batch in batches:
        pivots, lists = batch.column("pivot"), batch.column("m")
        for i in range(batch.num_rows):
            yield pivots[i].as_py(), lists[i].as_py()


def _survivors(rows: DataFrame, percent: int) -> DataFrame:
    """pivot, node, n of the members that may link with another one of their tree."""

    def run(batches):
        import pyarrow as pa

        out: list[tuple[int, int, int]] = []
        for pivot, m in _each(batches):
            out += [(pivot, m[i]["node"], m[i]["n"]) for i in able_members([x["n"] for x in m], [x["sig"] for x in m], [x["own"] for x in m], percent)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["pivot", "node", "n"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in range(3)], names=["pivot", "node", "n"])

    return _lists(rows, "node", "n", "sig", "own").mapInArrow(run, "pivot long, node long, n long").distinct()


def _full_sets(texts: DataFrame, k: int) -> DataFrame:
    def run(batches):
        import pyarrow as pa

        for batch in in_arrow(batches):
            found = list(sets(encoded(batch), k))
            yield pa.RecordBatch.from_arrays([pa.array([node_of(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.binary())], names=["node", "full"])

    return texts.mapInArrow(run, "node long, full binary").groupBy("node").agg(F.first("full").alias("full"))


def _links(rows: DataFrame, percent: int) -> DataFrame:
    """u, v: a spanning forest of the links within each task."""

    def run(batches):
        import pyarrow as pa

        out: list[tuple[int, int]] = []
        for _, m in _each(batches):
            full = [np.frombuffer(x["full"], dtype=np.uint64) for x in m]
            out += [(m[i]["node"], m[j]["node"]) for i, j in linked_members(full, [x["own"] for x in m], percent)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])
                out = []
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.int64()) for k in (0, 1)], names=["u", "v"])

    return _lists(rows, "node", "full", "own").mapInArrow(run, "u long, v long")


def one_of_each(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each component, that with the smallest id; of rows that repeat id and text one.
    Columns stay as they were. Rows without an id stay only where their component has no id at all. Documents without
    words are components of their own."""
    from loam.llm.exact_dedup import without

    found = n_gram_join(docs, k, percent, id_col, text_col)
    stays = (F.col("doc_id").eqNullSafe(F.col("component_id"))) | (F.col("n_shingles") == 0)
    names = found.withColumn("stays", stays).groupBy("doc_id", "text_key").agg(F.max("stays").alias("any_kept"), F.count(F.lit(1)).alias("times"), F.max("n_shingles").alias("n"))
    marked = staged(names.where("not any_kept or (times > 1 and n > 0)"), "join-drops")
    return without(docs, marked, id_col, text_col)
