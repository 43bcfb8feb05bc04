"""Line dedup over levelled sorted runs."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.llm.common import SPACE, ascii_lower, identity, new_path, partitions, same, staged, text_of, unstage

KEY = ["h1", "h2"]
#: Batches of documents; different common lines of a document that are looked up in a list.
BATCHES, MANY = 4, 64
#: Names of documents (16 bytes each) that are broadcast; more are merge-joined.
SENT = 200_000
ORDERED = "spark.sql.legacy.bucketedTableScan.outputOrdering"


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def key_hash(key: Column) -> Column:
    """128 bits of a line's key: two hashes, each of the whole key under a seed of its own."""
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2"))


class LineRuns:
    """How many documents hold each line, as sorted runs of line hashes on levels.

    add() merge-anti-joins a batch with the run of settled lines, those already seen in min_docs documents, and writes
    what is left as a run of level 0. When a level has two runs they are merged into one run of the next level;
    lines that reach min_docs then move to the settled run. So a line is rewritten about log(batches) times, and the
    commonest lines, once settled, are never written again.

    Runs are tables in the shared folder, dealt into as many buckets by hash as there are partitions, a sorted file a bucket. So merges and
    the anti-join read the runs bucket by bucket in order: merge joins without an exchange or a sort over any run.
    """

    def __init__(self, spark: SparkSession, min_docs: int):
        self.spark, self.min_docs, self.buckets = spark, min_docs, partitions(spark)
        self.levels: list[DataFrame | None] = []
        self.settled: DataFrame | None = None

    def add(self, batch: DataFrame) -> None:
        """batch: h1, h2, a row for each document and line."""
        counts = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n")).repartition(self.buckets, *KEY)
        if self.settled is not None:
            counts = counts.join(self.settled.hint("merge"), KEY, "left_anti")
        run, level = self._run(counts), 0
        while level < len(self.levels) and (other := self.levels[level]) is not None:
            self.levels[level], level = None, level + 1
            run = self._merge(other, run)
        self.levels[level : level + 1] = [run]

    def _run(self, df: DataFrame) -> DataFrame:
        """df, which comes dealt by hash into as many partitions as there are buckets, as a run."""
        path, name = new_path(self.spark, "line-run"), f"loam_{uuid4().hex}"
        df.write.format("parquet").option("compression", "zstd").option("path", path).bucketBy(self.buckets, *KEY).sortBy(*KEY).saveAsTable(name)
        out = self.spark.table(name)
        out._loam_table, out._loam_path = name, path
        return out

    def _drop(self, *runs: DataFrame | None) -> None:
        for run in runs:
            if run is not None:
                self.spark.sql(f"drop table {run._loam_table}")
                unstage(run)

    def _merge(self, a: DataFrame, b: DataFrame) -> DataFrame:
        """Both runs as one, without the lines that are settled now."""
        n = F.coalesce(a["n"], F.lit(0)) + F.coalesce(b["n"], F.lit(0))
        both = self._run(a.join(b.hint("merge"), KEY, "full_outer").select(*KEY, n.alias("n")))
        self._drop(a, b)
        self._settle(both)
        rest = self._run(both.where(F.col("n") < self.min_docs))
        self._drop(both)
        return rest

    def _settle(self, run: DataFrame) -> None:
        now, before = run.where(F.col("n") >= self.min_docs).select(*KEY), self.settled
        self.settled = self._run(now if before is None else now.join(before.hint("merge"), KEY, "full_outer"))
        self._drop(before)

    def frequent(self) -> DataFrame:
        """h1, h2 of the lines in at least min_docs documents, after a last merge of all levels."""
        last = None
        for run in (x for x in self.levels if x is not None):
            last = run if last is None else self._merge(last, run)
        if last is not None:
            self._settle(last)
        self._drop(last)
        self.levels = []
        if self.settled is None:
            return self.spark.createDataFrame([], "h1 long, h2 long")
        out = staged(self.settled, "frequent-lines")
        self._drop(self.settled)
        self.settled = None
        return out


def common_lines(docs: DataFrame, min_docs: int, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """doc_id, text_key (see common.identity), drops: the hashes of the row's lines that are in min_docs documents or
    more. Rows without such lines are left out. Every row counts as a document, also one that repeats another."""
    text = text_of(text_col)
    batch = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), text), F.lit(batches)).cast("int")
    # Each key is made once, and hashed outside of the array functions, in generated code.
    keys = F.array_distinct(F.filter(F.transform(lines_of(text), line_key), lambda k: k != ""))
    rows = docs.select(*identity(id_col, text), batch.alias("batch"), F.explode(keys).alias("key")).withColumn("h", key_hash(F.col("key")))
    spark = docs.sparkSession
    lines = staged(rows.select("doc_id", "text_key", "h.h1", "h.h2", "batch"), "lines", ["batch"])
    runs = LineRuns(spark, min_docs)
    ordered = spark.conf.get(ORDERED, None)
    spark.conf.set(ORDERED, "true")  # lets scans of sorted buckets count as sorted
    for b in range(batches):
        runs.add(lines.where(F.col("batch") == b).select(*KEY))
    common = runs.frequent()
    spark.conf.unset(ORDERED) if ordered is None else spark.conf.set(ORDERED, ordered)
    hit = lines.join(common, KEY)
    out = staged(hit.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct(*KEY)).alias("drops")), "drops")
    unstage(lines, common)
    return out


def drop_common_lines(docs: DataFrame, min_docs: int = 10, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Drops, in every document, all lines whose key (stripped of white space at both ends, A-Z lower-cased) is in at
    least min_docs documents; lines with an empty key stay.

    A row for each row of docs: doc_id, n_lines before, n_dropped, kept_text. Null or empty text: one empty line, which
    stays. Lines are compared by 128-bit hashes.
    """
    text = text_of(text_col)
    rows = docs.select(*identity(id_col, text), text.alias("text"))
    found = common_lines(docs, min_docs, id_col, text_col)
    both = rows.join(found, same(rows, found, "doc_id", "text_key"), "left").select(rows["doc_id"], lines_of(rows["text"]).alias("lines"), "drops")
    both = both.where(F.col("drops").isNull() | (F.size("drops") <= MANY))
    keyed = F.transform("lines", lambda x: F.struct(x.alias("line"), line_key(x).alias("key")))
    stays = F.filter(keyed, lambda x: (x["key"] == "") | ~F.array_contains("drops", key_hash(x["key"])))
    kept = F.when(F.col("drops").isNull(), F.col("lines")).otherwise(F.transform(stays, lambda x: x["line"]))
    out = both.select("doc_id", F.size("lines").cast("long").alias("n_lines"), kept.alias("kept"))
    out = out.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join("kept", "\n").alias("kept_text"))
    many = found.where(F.size("drops") > MANY)
    n = many.count()
    return out.unionByName(_without_many(rows, many, n <= SENT)) if n else out


def _without_many(rows: DataFrame, many: DataFrame, few: bool) -> DataFrame:
    """The same of documents with many different common lines: line by line, so that none is looked up in a list."""
    gone = many.select(F.col("doc_id").alias("k_doc"), F.col("text_key").alias("k_text"), F.explode("drops").alias("h")).select("k_doc", "k_text", F.col("h.h1").alias("g1"), F.col("h.h2").alias("g2"))
    names = many.select(F.col("doc_id").alias("k_doc"), F.col("text_key").alias("k_text"))
    some = rows.join(names.hint("broadcast" if few else "merge"), rows["doc_id"].eqNullSafe(names["k_doc"]) & (rows["text_key"] == names["k_text"]), "left_semi")
    lines = some.select("doc_id", "text_key", F.posexplode(lines_of(F.col("text"))).alias("pos", "line")).withColumn("key", line_key(F.col("line"))).withColumn("h", key_hash(F.col("key")))
    on = lines["doc_id"].eqNullSafe(gone["k_doc"]) & (lines["text_key"] == gone["k_text"]) & (F.col("h.h1") == gone["g1"]) & (F.col("h.h2") == gone["g2"])
    stays = F.col("g1").isNull() | (F.col("key") == "")
    found = lines.join(gone.hint("merge"), on, "left").groupBy("doc_id", "text_key").agg(
        F.count(F.when(F.col("pos") == 0, 1)).alias("times"), (F.max("pos") + 1).cast("long").alias("n_lines"), F.sort_array(F.collect_set(F.when(stays, F.struct("pos", "line")))).alias("kept")
    )
    rows_of = found.withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), "times")))  # rows that repeat id and text
    return rows_of.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).alias("n_dropped"), F.array_join(F.transform("kept", lambda x: x["line"]), "\n").alias("kept_text"))
