"""Exact top-k inner products by norm-bucketed retrieval."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import partitions, ship, staged

SCALE, K, EVERY = 256, 5, 50
#: Vectors in a bucket, and queries in a block, on average.
BUCKET, BLOCK = 2048, 512
#: Ranges of length at most; a range with more vectors than two buckets is dealt into several.
MAX_TIERS = 1024
#: Local cosine thresholds from which a bucket is pruned by coordinates rather than by length alone; coordinates looked at.
STEEP, FOCUS = 0.6, 4
#: Inner products of integers below this are exact in float64.
EXACT = float(1 << 53)


def quantised(vec_col: str, scale: int = SCALE):
    """floor(scale * x) of each component; null for vectors that are null, or hold null or non-finite components."""
    v = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.when(good, F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("double")))


def matrix(vecs) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros."""
    dims = max((len(v) for v in vecs), default=0)
    if all(len(v) == dims for v in vecs):
        return np.array([np.asarray(v, dtype=np.float64) for v in vecs], dtype=np.float64).reshape(len(vecs), dims)
    out = np.zeros((len(vecs), dims))
    for row, v in zip(out, vecs, strict=True):
        row[: len(v)] = v
    return out


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: float64 where no partial sum can leave its exact range, whole numbers of any size
    otherwise (then cut to the range of long)."""
    dims = min(q.shape[1], c.shape[1])
    q, c = q[:, :dims], c[:, :dims]
    if not q.size or not c.size or np.abs(q).max() * np.abs(c).max() * dims < EXACT:
        return (q @ c.T).astype(np.int64)
    whole = np.array([[int(x) for x in row] for row in q], dtype=object) @ np.array([[int(x) for x in row] for row in c], dtype=object).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(scores) > 4 * k:
        cut = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = np.flatnonzero(scores >= cut)
        return near[np.lexsort((ids[near], -scores[near]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def scan(queries, q_ids, floors, cands, c_ids, lengths, k: int):
    """(query's place, candidate's place, score) of each query's k best in a bucket, whose vectors come with falling
    length; only those that reach the query's floor, the k-th best score known so far.

    A candidate can reach the floor only if its cosine reaches floor / (|q| |c|). For the bucket's longest vector that
    is the local threshold: over 1, the bucket is skipped. A low one prunes by length: only the candidates with
    |c| >= floor / |q|, a prefix, are verified. A high one prunes by coordinate too: on the query's largest coordinates F, with
    what is left bounded by Cauchy-Schwarz, q_F c_F + |q_rest| |c_rest| must reach the floor.
    """
    slack = 1 + 1e-9
    norms = np.sqrt((queries**2).sum(1))
    dims = min(queries.shape[1], cands.shape[1])
    out = []
    full = None
    for i in range(len(queries)):
        floor, norm = floors[i], norms[i]
        n = len(c_ids)
        picked = None
        if np.isfinite(floor) and floor > 0 and n:
            if norm * lengths[0] * slack < floor:
                continue
            n = int(np.searchsorted(-lengths, -(floor / (norm * slack)), side="right"))
            if n == 0:
                continue
            if floor / (norm * lengths[0]) >= STEEP and dims > FOCUS:
                q = queries[i, :dims]
                top = np.argpartition(-np.abs(q), FOCUS)[:FOCUS]
                part = cands[:n][:, top]
                rest_q = np.sqrt(max(0.0, norm**2 - (q[top] ** 2).sum()))
                rest_c = np.sqrt(np.maximum(0.0, lengths[:n] ** 2 - (part**2).sum(1)))
                picked = np.flatnonzero((part @ q[top] + rest_q * rest_c) * slack + 1 >= floor)
        if picked is None:
            if full is None:
                full = products(queries, cands)
            scores, places = full[i, :n], np.arange(n)
        else:
            scores, places = products(queries[i : i + 1], cands[picked])[0], picked
        ok = (c_ids[places] != q_ids[i]) & (scores >= floor)
        scores, places = scores[ok], places[ok]
        for j in best(scores, c_ids[places], k):
            out.append((i, int(places[j]), int(scores[j])))
    return out


def top_k(vectors: DataFrame, k: int = K, every: int = EVERY, scale: int = SCALE, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """For each query, a row whose id is divisible by every, its k highest integer inner products with all other rows
    (other ids), ties to the smaller id: query_id, rank from 1, vec_id, score.

    Vectors are dealt into buckets of similar length, and queries into blocks. First each query meets the one bucket
    of the longest vectors; its k-th best score there is its floor. Then a query goes to each further bucket whose longest vector
    can still reach the floor, and scan() prunes there by length or coordinate. All remaining products are
    verified as whole numbers, so nothing is approximate.

    Rows without a usable vector or id take no part. Vectors of different sizes are compared as if filled with zeros.
    Rows that repeat an id are candidates each, and queries each (their answers are the best over both). Empty table: no rows. A query with fewer candidates
    than k gets them all. Queries and buckets meet block by block: a task holds one block and one bucket.
    """
    spark = vectors.sparkSession
    ship(spark)
    q = quantised(vec_col, scale)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), q.alias("v")).where("vec_id is not null and v is not null")
    rows = rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "search-rows")
    n = rows.count()
    if n == 0:
        return spark.createDataFrame([], "query_id long, `rank` int, vec_id long, score long")
    n_buckets, n_queries = max(1, -(-n // BUCKET)), rows.where(F.col("vec_id") % every == 0).count()
    bounds = _bounds(rows, n_buckets)
    # Buckets by length; equal lengths, however many, are dealt over as many buckets as their rows need.
    rows = rows.withColumn("tier", F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("length"))) if bounds else F.lit(0))
    tiers = rows.groupBy("tier").agg(F.count(F.lit(1)).alias("rows_in"), F.max("length").alias("longest")).withColumn("cells", F.ceil(F.col("rows_in") / (2 * BUCKET)).cast("int"))
    tiers = staged(tiers, "search-tiers")
    cell = F.pmod(F.xxhash64("vec_id", F.lit(7)), F.col("cells")).cast("int")
    packed = rows.join(F.broadcast(tiers.select("tier", "cells")), "tier").withColumn("cell", cell)
    blocks = max(1, -(-n_queries // BLOCK))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), "v", "tier", F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(blocks)).cast("int").alias("block"))
    buckets = packed.groupBy("tier", "cell").agg(F.collect_list(F.struct("vec_id", "row", "v", "length")).alias("rows"))
    buckets = staged(buckets.repartition(max(1, min(2 * partitions(spark), n_buckets)), "tier", "cell"), "search-buckets")
    head = rows.agg(F.max("tier")).first()[0]

    def meet(asked: DataFrame) -> DataFrame:
        """asked: query_id, v, floor, block, tier, cell."""
        grouped = asked.groupBy("block", "tier", "cell").agg(F.collect_list(F.struct("query_id", "v", "floor")).alias("asks"))

        def run(batches):
            import pyarrow as pa

            for batch in batches:
                for r in range(batch.num_rows):
                    asks, cands = (batch.column(c)[r].values for c in ("asks", "rows"))
                    q_ids, floors = (asks.field(c).to_numpy(zero_copy_only=False) for c in ("query_id", "floor"))
                    c_ids, c_rows, lengths = (cands.field(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "row", "length"))
                    fall = np.argsort(-lengths, kind="stable")
                    found = scan(matrix(asks.field("v").to_numpy(zero_copy_only=False)), q_ids, floors, matrix(cands.field("v").to_numpy(zero_copy_only=False)[fall]), c_ids[fall], lengths[fall], k)
                    c_ids, c_rows = c_ids[fall], c_rows[fall]
                    yield pa.RecordBatch.from_pydict({"query_id": pa.array([q_ids[i] for i, _, _ in found], pa.int64()), "vec_id": pa.array([c_ids[j] for _, j, _ in found], pa.int64()), "row": pa.array([c_rows[j] for _, j, _ in found], pa.int64()), "score": pa.array([s for _, _, s in found], pa.int64())})

        both = grouped.join(buckets, ["tier", "cell"]).repartition(4 * partitions(spark), "block", "tier", "cell").select("asks", "rows")
        return both.mapInArrow(run, "query_id long, vec_id long, row long, score long")

    ordered = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id", "row")

    def cut(found: DataFrame) -> DataFrame:
        # Only repeated query rows find the same row with the same score again.
        return found.distinct().withColumn("rank", F.row_number().over(ordered)).where(F.col("rank") <= k)

    first_cell = queries.withColumns({"tier": F.greatest("tier", F.lit(head)), "cell": F.lit(0), "floor": F.lit(float("-inf"))})
    seen = staged(cut(meet(first_cell)), "search-first")
    floors = seen.where(F.col("rank") == k).select("query_id", F.col("score").cast("double").alias("floor"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    rest = queries.drop("tier").join(floors, "query_id", "left").fillna(float("-inf"), ["floor"]).withColumn("norm", norm)
    known = [F.struct(F.lit(t["tier"]).alias("tier"), F.lit(t["cells"]).alias("cells"), F.lit(t["longest"]).alias("longest")) for t in tiers.collect()]  # MAX_TIERS at most
    able = F.filter(F.array(*known), lambda t: (F.col("floor") <= 0) | (t["longest"] * F.col("norm") * (1 + 1e-9) + 1 >= F.col("floor")))
    goes = rest.withColumn("t", F.explode(able)).select("query_id", "v", "floor", "block", F.col("t.tier").alias("tier"), F.explode(F.sequence(F.lit(0), F.col("t.cells") - 1)).alias("cell"))
    goes = goes.where(~((F.col("tier") == head) & (F.col("cell") == 0)))
    every_one = seen.select("query_id", "vec_id", "row", "score").unionByName(meet(goes))
    return cut(every_one).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _bounds(rows: DataFrame, n: int) -> list[float]:
    """Upper lengths of n tiers, but the last one's."""
    n = min(n, MAX_TIERS)
    return sorted(set(rows.approxQuantile("length", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
