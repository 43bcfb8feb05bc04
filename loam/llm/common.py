"""What the corpus operators share: staged tables, text rules and shipping of this package to executors.

Every operator first projects its input onto the columns that it needs, under its own names, so extra columns of the
input, whatever they are called, can't clash with internal ones.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space of the text rules: space, tab, line feed, vertical tab, form feed, carriage return.
SPACE = " \t\n\x0b\x0c\r"
#: A word: a longest run of other characters.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a local one where that is unset and there are no other
    executors (tests). What lies in it of this application goes when the driver ends."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loam-")
        atexit.register(shutil.rmtree, found[7:], ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    sc = spark.sparkContext
    top = f"{shared_dir(spark)}/loam-{sc.applicationId}"
    if getattr(sc, "_loam_top", None) != top:  # staged tables that later steps still read can go only at the end
        at = spark._jvm.org.apache.hadoop.fs.Path(top)
        fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        sc._loam_top = top
    return f"{top}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """df, written as a table in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loam_path = path
    return out


def unstage(*tables: DataFrame | None) -> None:
    """Deletes staged tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "_loam_path", None):
            jvm = df.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of steps whose results are written: its cleaner acts when the driver's garbage is
    collected, which in a long job of few objects may be never before the disks are full."""
    gc.collect()
    spark._jvm.System.gc()


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, once a context."""
    sc = spark.sparkContext
    if getattr(sc, "_loam_shipped", False):
        return
    top = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="loam-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(out := os.path.join(folder, "loam.zip"), "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, p.relative_to(top.parent))
    sc.addPyFile(out)
    sc._loam_shipped = True


def text_of(name: str = "text") -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased. translate() looks up each character; text of ASCII alone takes the byte loop of lower()."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit(WORD)).cast("long")


def id_bucket(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id has no remainder."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % n


def identity(id_col: str, text: Column) -> list[Column]:
    """A row's name: its id, and a fingerprint of its text, so that rows that share an id stay apart. Rows equal in
    both are alike in every decision that looks at the text."""
    return [F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_key")]


def same(a: DataFrame, b: DataFrame, *names: str) -> Column:
    out = F.lit(True)
    for n in names:
        out = out & a[n].eqNullSafe(b[n])
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
