"""Spelling variants: words one edit apart, found by scanning a forward and a reversed dictionary."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import UPPER, staged, text_of, unstage

RUN = r"[A-Za-zÀ-ÿ]+"
#: Words of a block that are compared with one another; larger blocks are subdivided.
BLOCK = 96
#: A block: pairs whose shorter word has `short` code points and whose first difference lies in [lo, hi). Its words share
#: what comes before lo (head) and what comes after hi (tail).
KEY = ["short", "lo", "hi", "head", "tail"]


def vocabulary(docs: DataFrame, least_chars: int = 6, least_n: int = 5, every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: the runs of letters of all whole texts (A-Z lower-cased) with at least least_chars code points and least_n occurrences.

    every: of a run whose unsigned crc32 h of "<id>:<run>" it divides, the code point h % length is deleted first (planted slips of the pen).
    Null texts have no runs; a null id counts as an empty one. Counts are partial sums before the shuffle, so no word is hot.
    """
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(text_of(text_col), F.lit(RUN), F.lit(0))).alias("raw"))
    runs = runs.where(F.length("raw") >= least_chars)
    lower = F.when(F.octet_length("raw") == F.length("raw"), F.lower("raw")).otherwise(F.translate("raw", UPPER, UPPER.lower()))
    runs = runs.select("id", lower.alias("word"))
    if every:
        runs = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")))
        at = (F.col("h") % F.length("word")).cast("int")
        slip = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.length("word")))
        runs = runs.withColumn("word", F.when(F.col("h") % every == 0, slip).otherwise(F.col("word"))).where(F.length("word") >= least_chars)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least_n)


def placed(rows: DataFrame) -> DataFrame:
    """rows (word, n, short, lo, hi) with the block that each is in."""
    rest = F.greatest(F.lit(0), F.col("short") - F.col("hi"))
    return rows.withColumns({"head": F.expr("left(word, lo)"), "tail": F.when(rest > 0, F.expr("right(word, short - hi)")).otherwise("")})


def halves(words: DataFrame) -> DataFrame:
    """Each word four times: as the shorter and as the longer of a pair, in the forward dictionary (the first half is shared:
    the first difference comes after it) and in the reversed one (the second half is)."""
    rows = words.select("word", "n", F.explode(F.array(F.length("word"), F.length("word") - 1)).alias("short")).where("short > 0")
    half = F.floor(F.col("short") / 2).cast("int")
    sides = F.array(F.struct(half.alias("lo"), (F.col("short") + 1).alias("hi")), F.struct(F.lit(0).alias("lo"), half.alias("hi")))
    return placed(rows.select("word", "n", "short", F.explode(sides).alias("s")).where("s.lo < s.hi").select("word", "n", "short", "s.lo", "s.hi"))


def blocks(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """The rows of all blocks in which two words may meet, none larger than `most`, or so narrow that the alphabet bounds it.

    A block that is larger is subdivided: its interval of first differences is halved, so that its words, by then in two
    blocks each, share more of their beginnings or more of their ends. After log2(length) rounds an interval has one
    position, and a block at most as many words as there are letters for the one or two places that are free.
    """
    rows, done, held = halves(words), [], []
    while True:
        has_short = F.count(F.when(F.length("word") == F.col("short"), 1))
        sizes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("rows"), has_short.alias("shorts")).where("rows > 1 and shorts > 0")
        sizes = staged(sizes.select(*KEY, ((F.col("rows") > most) & (F.col("hi") - F.col("lo") > 1)).alias("large")), "spelling-sizes")
        level = staged(rows.join(sizes.hint("merge"), KEY), "spelling-blocks")
        unstage(sizes)
        held.append(level)
        done.append(level.where("not large").drop("large"))
        large = level.where("large")
        if large.isEmpty():
            return reduce(DataFrame.unionByName, done)
        mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
        parts = F.array(F.struct(F.col("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), F.col("hi")))
        rows = placed(large.select("word", "n", "short", F.explode(parts).alias("s")).select("word", "n", "short", "s.lo", "s.hi"))


def near_words(words: DataFrame, most: int = BLOCK) -> DataFrame:
    """word, n, near, near_n: each word beside each word that one inserted, deleted or replaced code point makes of it. words: different
    words with their counts. A pair meets in one block only, that of its first difference, so nothing is found twice."""
    rows = blocks(words, most)
    a = rows.where(F.length("word") == F.col("short")).select(*KEY, "word", "n")
    b = rows.select(*KEY, F.col("word").alias("near"), F.col("n").alias("near_n"))
    differs = (F.col("hi") > F.col("short")) | (F.expr("left(word, hi)") != F.expr("left(near, hi)"))
    met = a.join(b.hint("merge"), KEY).where((F.col("word") != F.col("near")) & differs & (F.levenshtein("word", "near", 1) == 1))
    one = F.struct("word", "n", "near", "near_n")
    other = F.struct(F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    # Words of equal length meet both ways round; a longer one is met by the shorter one only.
    return met.select(F.explode(F.when(F.length("near") == F.length("word"), F.array(one)).otherwise(F.array(one, other))).alias("p")).select("p.*")


def roots(forms: DataFrame) -> DataFrame:
    """word, root of forms (word, form): the last word of the chain of forms, by doubling. Each form is met `times` as often as
    its word, so chains are short and have no rings."""
    now = staged(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        out = staged(now.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        unstage(now)
        if out.where("moved").isEmpty():
            return out.drop("moved")
        now = out.drop("moved")
        now._loam_path = out._loam_path


def spelling_groups(words: DataFrame, times: int = 5, most: int = BLOCK) -> DataFrame:
    """Groups of spelling variants among words (word, n; different words).

    A row a word: word, n, n_near (how many of the words are one edit away), form (that of largest n, ties to the smallest in
    code-point order, if its n is at least `times` the word's; else null), form_n and root (the last word that forms lead to;
    the word itself where there is none). An empty table gives no rows.
    """
    words = staged(words.select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    best = F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w")))
    near = near_words(words, most).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    near = staged(near.select("word", "n_near", F.col("best.w").alias("best"), (-F.col("best.m")).alias("best_n")), "spelling-near")
    has = F.col("best_n") >= times * F.col("n")
    rows = words.join(near.hint("merge"), "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("best")).alias("form"), F.when(has, F.col("best_n")).alias("form_n"))
    rows = staged(rows, "spelling-forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends.hint("merge"), "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
