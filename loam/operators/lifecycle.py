"""Table transformations for observations, topics and logs. Each takes tables and gives the next state as a table; what
stores them is up to the caller."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import depends_path

# Limits.
STRIKES, LOG_LIMIT, RECENT = 3, 512 * 1024, 500
ENTRIES, KEY_CHARS, VALUE_CHARS = 16, 64, 256
EVENT_KINDS = ("slow-lane-outcome", "distill-op-invalid", "distill-op-retry-exhausted", "link-ref-rejected", "seam-observations-fed", "seam-lesson-status", "lesson-conflict-flagged")


def mark_distilled(observations: DataFrame, marks: DataFrame) -> DataFrame:
    """observations with the rows named in marks (id, into) distilled into these topics; rows that are so already stay."""
    m = marks.groupBy("id").agg(F.array_sort(F.collect_set("into")).alias("new_into"))
    both = observations.join(m, "id", "left")
    now = F.col("new_into").isNotNull() & ~F.col("distilled")
    return both.withColumns({"distilled_into": F.when(now, F.col("new_into")).otherwise(F.col("distilled_into")), "distilled": F.col("distilled") | now}).drop("new_into")


def strike(observations: DataFrame, fed: DataFrame, consumed: DataFrame, most: int = STRIKES) -> DataFrame:
    """Rows that were fed (id) and neither consumed (id) nor distilled get an attempt more; at the third they go."""
    missed = fed.select("id").distinct().join(consumed.select("id"), "id", "left_anti").withColumn("missed", F.lit(True))
    both = observations.join(missed, "id", "left")
    tries = F.col("attempts") + F.when(F.col("missed") & ~F.col("distilled"), 1).otherwise(0)
    return both.withColumn("attempts", tries).where(F.col("distilled") | (F.col("attempts") < most)).drop("missed")


def latest(log: DataFrame, key: str, order: str) -> DataFrame:
    """The newest row of each key: current state out of an appended history."""
    cols = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*cols), order).alias("x")).select(key, "x.*")


def upsert(current: DataFrame, patch: DataFrame, key: str, keep: tuple[str, ...]) -> DataFrame:
    """current with the patch's rows; fields named in keep keep their old value where the patch has null."""
    old, new = current.alias("o"), patch.withColumn("_patched", F.lit(True)).alias("p")
    both = old.join(new, F.col(f"o.{key}") == F.col(f"p.{key}"), "full_outer")
    pick = lambda c: F.coalesce(F.col(f"p.{c}"), F.col(f"o.{c}")) if c == key or c in keep else F.when(F.col("p._patched"), F.col(f"p.{c}")).otherwise(F.col(f"o.{c}"))
    return both.select(*[pick(c).alias(c) for c in current.columns])


def tail(log: DataFrame, n: int, order: str = "place", by: list[str] | None = None) -> DataFrame:
    """The last n rows (of each group) in log order. Without groups this is a top-n, not a sort of the log."""
    if not by:
        return log.orderBy(F.col(order).desc()).limit(n)
    w = Window.partitionBy(*by).orderBy(F.col(order).desc())
    return log.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def compact(lines: DataFrame, by: str, keep_newest: float, limit: int = LOG_LIMIT) -> DataFrame:
    """lines (by, place, line) of logs longer than the limit cut to their newest share (at least a line); others whole."""
    sizes = lines.groupBy(by).agg(F.sum(F.length("line") + 1).alias("size"), F.count(F.lit(1)).alias("lines"))
    nth = F.row_number().over(Window.partitionBy(by).orderBy(F.col("place").desc()))
    # The newest quarter is rounded down; of three quarters what goes is.
    keep = F.greatest(F.lit(1), F.floor(F.col("lines") * keep_newest) if keep_newest < 0.5 else F.col("lines") - F.floor(F.col("lines") * (1 - keep_newest)))
    rows = lines.join(sizes, by).withColumn("nth", nth)
    return rows.where((F.col("size") <= limit) | (F.col("nth") <= keep)).select(*lines.columns)


NUMBERED = r"^(.*)-([2-9]|[1-9]\d{1,8})$"


def unique_slugs(wanted: DataFrame, taken: DataFrame) -> DataFrame:
    """wanted (id, slug) with final: the slug, or the slug with the first number from 2 on that is free, in id order; what earlier
    rows were given isn't free either.

    Names can only meet within a family, the slugs that are the same without the numbers at their ends. The n-th comer of a slug gets its
    n-th free number, counted without trying them in turn. A slug that is another one's with a number (a-2 of a) takes that number from it
    if its first comer is there before the other one's n-th comer has got so far; else it is itself taken. That is settled between the
    different slugs of a family, so no task holds a family's rows.
    """
    id_type = dict(wanted.dtypes)["id"]
    root = F.regexp_replace("slug", r"(?:-(?:[2-9]|[1-9]\d{1,8}))+$", "")
    held = taken.select("slug").distinct()
    numbers = held.select(F.regexp_extract("slug", NUMBERED, 1).alias("slug"), F.regexp_extract("slug", NUMBERED, 2).try_cast("long").alias("i")).where("i is not null")
    used = numbers.unionByName(held.select("slug", F.lit(1).cast("long").alias("i"))).distinct()

    # Slugs that are another wanted slug with a number, when they first come, and how many of the other one were there by then.
    firsts = wanted.groupBy("slug").agg(F.min("id").alias("id"))
    claims = firsts.select(F.regexp_extract("slug", NUMBERED, 1).alias("base"), F.regexp_extract("slug", NUMBERED, 2).try_cast("long").alias("i"), F.col("slug").alias("claim"), "id").where("i is not null")
    claims = claims.join(firsts.select(F.col("slug").alias("base")), "base", "left_semi")
    rows = wanted.select("id", "slug", F.lit(1).alias("one"), F.lit(None).cast("long").alias("i"), F.lit(None).cast("string").alias("claim"))
    rows = rows.unionByName(claims.select("id", F.col("base").alias("slug"), F.lit(0).alias("one"), "i", "claim"))
    rows = rows.withColumn("nth", F.sum("one").over(Window.partitionBy("slug").orderBy("id").rowsBetween(Window.unboundedPreceding, 0)))

    def settle(asked, there):
        """Of a family's claims (those of shorter slugs first, and each slug's in id order), the numbers that slugs lose."""
        import bisect

        import pandas as pd

        gone, lost, out = {}, set(), []
        for slug, i in zip(there["slug"], there["i"]):
            gone.setdefault(slug, set()).add(i)
        for base, own in sorted(asked.groupby("slug"), key=lambda x: len(x[0])):
            numbers = sorted(gone.get(base, set()) | ({1} if base in lost else set()))
            for x in own.sort_values("id").itertuples():
                k = bisect.bisect_left(numbers, x.i)
                if k < len(numbers) and numbers[k] == x.i:
                    continue  # taken from the beginning
                if x.i - 1 - k >= x.nth:
                    numbers.insert(k, x.i)
                    out.append((base, x.i))
                else:
                    lost.add(x.claim)
                    out.append((x.claim, 1))
        return pd.DataFrame(out, columns=["slug", "i"]).astype({"slug": "object", "i": "int64"})

    asked = rows.where("one = 0").withColumn("root", root)
    moved = asked.groupBy("root").cogroup(used.withColumn("root", root).join(asked.select("root").distinct(), "root", "left_semi").groupBy("root")).applyInPandas(settle, "slug string, i long")
    lists = used.unionByName(moved).groupBy("slug").agg(F.array_sort(F.collect_set("i")).alias("used"))
    # The n-th number that isn't used: n, moved on by one for each used number up to it.
    free = F.aggregate(F.coalesce("used", F.array().cast("array<bigint>")), F.col("nth"), lambda a, u: F.when(u <= a, a + 1).otherwise(a))
    simple = rows.where("one = 1").join(lists, "slug", "left").select("id", "slug", free.alias("i"))
    return simple.select(F.col("id").cast(id_type).alias("id"), F.when(F.col("i") == 1, F.col("slug")).otherwise(F.concat("slug", F.lit("-"), F.col("i").cast("string"))).alias("final"))


def clean_detail(detail: Column) -> Column:
    """A map's scalar entries within the limits; null if nothing is left."""
    out = F.map_filter(detail, lambda k, v: v.isNotNull() & (k != "") & (F.length(k) <= KEY_CHARS) & (F.length(v) <= VALUE_CHARS))
    out = F.map_from_entries(F.slice(F.array_sort(F.map_entries(out)), 1, ENTRIES))
    return F.when(F.size(out) > 0, out)


def feed(batch: DataFrame, existing: DataFrame, recent: int = RECENT) -> DataFrame:
    """batch (place, actor, kind, source, session, text) with outcome: rejected without actor or text, duplicate if one
    of the last rows of existing, or an earlier one of the batch, has the same kind, source, session and text, else accepted."""
    key = ["kind", "source", "session", "text"]
    had = tail(existing, recent).select(*key, F.lit(True).alias("had")).distinct()
    good = (F.coalesce("actor", F.lit("")) != "") & (F.trim(F.coalesce("text", F.lit(""))) != "")
    same = F.lit(True)
    rows = batch.withColumn("ok", good)
    for c in key:
        same = same & rows[c].eqNullSafe(had[c])
    rows = rows.join(had, same, "left").select(*[rows[c] for c in rows.columns], had["had"])
    nth = F.row_number().over(Window.partitionBy(*key, "ok").orderBy("place"))
    return rows.withColumn("nth", nth).withColumn("outcome", F.when(~F.col("ok"), "rejected").when(F.coalesce("had", F.lit(False)) | (F.col("nth") > 1), "duplicate").otherwise("accepted")).drop("ok", "had", "nth")


def expired(topics: DataFrame, now: str, days: int) -> DataFrame:
    """Deprecated topics generated `days` before now or earlier; none if days is 0 or less, or the time unknown."""
    cutoff = F.lit(now).cast("timestamp_ntz") - F.make_dt_interval(F.lit(days))
    return topics.where(F.lit(days > 0) & (F.col("status") == "deprecated") & (F.col("generated_at") <= cutoff))


def newest(topics: DataFrame, n: int = 100) -> DataFrame:
    """The n topics generated last, ties by slug, with rank. A top-n, not a sort of all."""
    top = topics.orderBy(F.col("generated_at").desc(), "slug").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.col("generated_at").desc(), "slug")))


def undistilled(observations: DataFrame, n: int = 40, within: int = 2000) -> DataFrame:
    """The last n rows that aren't distilled, among the last `within` of the log."""
    return tail(tail(observations, within).where(~F.col("distilled")), n)


def repair_depends(topics: DataFrame) -> DataFrame:
    """topics whose depends changed by taking each reference's one path, empty and repeated ones left out."""
    fixed = F.array_distinct(F.filter(F.transform("depends", depends_path), lambda x: x != ""))
    return topics.withColumn("fixed", fixed).where(F.col("fixed") != F.col("depends")).drop("depends").withColumnRenamed("fixed", "depends")


def index_lines(topics: DataFrame) -> DataFrame:
    """slug, line of an index of all topics, to be read in slug order."""
    described = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), F.col("description"))).otherwise("")
    return topics.select("slug", F.concat(F.lit("- ["), F.col("title"), F.lit("](topics/"), F.col("slug"), F.lit(".md) `"), F.col("status"), F.lit("`"), described).alias("line"))


def lesson_transition(lessons: DataFrame, requests: DataFrame, actors: tuple[str, ...]) -> DataFrame:
    """requests (id, actor, slug, state) with outcome: why one is refused, or ok; and next, the status that a lesson has after an accepted
    one (archived once removed). lessons: slug, kind, status."""
    rows = requests.join(lessons.select("slug", "kind", "status"), "slug", "left")
    outcome = F.when(~F.col("actor").isin(*actors), "unauthorized").when(~F.col("state").isin("established", "deprecated", "removed"), "invalid-state").when(F.col("kind").isNull(), "not-found").when(F.col("kind") != "lesson", "not-a-lesson").otherwise("ok")
    after = F.when(F.col("state") == "established", "stable").when(F.col("state") == "removed", "archived").otherwise("deprecated")
    return rows.withColumn("outcome", outcome).withColumn("next", F.when(F.col("outcome") == "ok", after).otherwise(F.col("status")))


def open_records(log: DataFrame) -> DataFrame:
    """Rows of an open log (slug, at, session, source, score, since; all text as it was read) that have a slug and a time: fields of another
    type or an unknown source are null."""
    number = lambda c: F.col(c).try_cast("double").alias(c)
    source = F.when(F.col("source").isin("pointer", "search"), F.col("source")).alias("source")
    return log.where("slug is not null and at is not null").select("slug", "at", "session", source, number("score"), number("since"))


def observed(batch: DataFrame, now: str) -> DataFrame:
    """New rows of the observation log (id, at, kind, source, session, text): the model is their source unless one is named."""
    row_id = F.sha2(F.concat_ws("\x00", "session", "kind", "text"), 256)
    return batch.select(F.substring(row_id, 1, 16).alias("id"), F.lit(now).alias("at"), "kind", F.coalesce("source", F.lit("model")).alias("source"), "session", "text", F.lit(False).alias("distilled"), F.lit(0).alias("attempts"))


def opened(requests: DataFrame, topics: DataFrame) -> DataFrame:
    """requests (id, ref, however wrapped or written) with the slug that each names, whether there is such a topic, and its fields."""
    from loam.functions.text import slugify, unwrap_ref

    asked = requests.withColumn("slug", slugify(unwrap_ref(F.col("ref"))))
    return asked.join(topics.select("slug", "title", "status", "conclusion", F.lit(True).alias("there")), "slug", "left").withColumn("found", F.coalesce("there", F.lit(False))).drop("there")


def history(versions: DataFrame, limit: int = 20) -> DataFrame:
    """versions (slug, rev, at, subject, body) as the newest `limit` of each topic: revision to ten characters, and the
    first line of its conclusion."""
    from loam.functions.text import first_line, section

    rows = tail(versions, limit, "at", ["slug"])
    return rows.select("slug", F.substring("rev", 1, 10).alias("rev"), "at", "subject", first_line(F.coalesce(section(F.col("body"), "conclusion"), F.lit(""))).alias("conclusion"))


def archived(topics: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What goes to the archive, whole rows, and what stays. gone: slug."""
    return topics.join(gone, "slug", "left_semi"), topics.join(gone, "slug", "left_anti")


def conflict_paths(paths: DataFrame) -> DataFrame:
    """path, slug: different paths of topics; others are left out."""
    return paths.where(F.col("path").rlike(r"^topics/.+\.md$")).select("path", F.regexp_extract("path", r"^topics/(.+)\.md$", 1).alias("slug")).distinct()


def allowed_events(events: DataFrame) -> DataFrame:
    """Events of known kinds with their detail cleaned."""
    return events.where(F.col("kind").isin(*EVENT_KINDS)).withColumn("detail", clean_detail(F.col("detail")))


def consolidated(topics: DataFrame, ops: DataFrame, now: str) -> DataFrame:
    """topics after ops (op, slug, target) that name topics: deprecate and promote set the status, refresh the time, merge
    deprecates a topic and gives its tags to the target."""
    some = ops.join(topics.select("slug"), "slug", "left_semi")
    flags = some.groupBy("slug").agg(*[F.bool_or(F.col("op") == o).alias(f"_{o}") for o in ("merge", "promote", "deprecate", "refresh")])
    given = some.where("op = 'merge'").join(topics.select("slug", F.explode("tags").alias("tag")), "slug").where("target <> slug").groupBy(F.col("target").alias("slug")).agg(F.array_sort(F.collect_set("tag")).alias("_given"))
    rows = topics.join(flags, "slug", "left").join(given, "slug", "left")
    status = F.when(F.col("_deprecate") | F.col("_merge"), "deprecated").when(F.col("_promote"), "stable").otherwise(F.col("status"))
    made = F.when(F.col("_refresh"), F.lit(now).cast("timestamp_ntz")).otherwise(F.col("generated_at"))
    return rows.withColumns({"status": status, "generated_at": made, "tags": F.array_union("tags", F.coalesce("_given", F.array().cast("array<string>")))}).select(*topics.columns)
