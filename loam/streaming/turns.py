"""Session streams: assembling turns, rings of last turns, one-slot mailboxes with an expiry, dedup of what was shown."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TURNS = "session long, turn long, user string, assistant string"
STATE = "turn long, user string, assistant string"
# Sizes and lives.
RING, TTL_SECONDS, TURN_LAG = 3, 600, 2


def turns(messages: DataFrame) -> DataFrame:
    """session, turn, user, assistant of messages (session, seq, role, text), in batch: a user's message begins a turn,
    assistants' messages until the next one belong to it; text before the first user's message is no turn."""
    w = Window.partitionBy("session").orderBy("seq")
    rows = messages.withColumn("turn", F.count(F.when(F.col("role") == "user", 1)).over(w)).where("turn > 0")
    said = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("seq", "text")))), lambda x: x["text"])
    return rows.groupBy("session", "turn").agg(F.array_join(said("user"), "").alias("user"), F.array_join(said("assistant"), "\n").alias("assistant"))


def turn_stream(messages: DataFrame) -> DataFrame:
    """The same over a stream, by a state of one open turn a session: a turn comes out when the next one begins, or with a message
    of role "end". Messages of a session must arrive in order."""

    def step(key: tuple, batches: Iterator, state) -> Iterator:
        import pandas as pd

        turn, user, said = state.get if state.exists else (0, None, None)
        out = []
        for rows in batches:
            for x in rows.sort_values("seq").itertuples():
                if x.role in ("user", "end"):
                    if turn and user is not None:
                        out.append((key[0], turn, user, said or ""))
                    turn, user, said = (turn + 1, x.text, None) if x.role == "user" else (turn, None, None)
                elif x.role == "assistant" and user is not None:
                    said = x.text if said is None else f"{said}\n{x.text}"
        state.update((turn, user, said))
        yield pd.DataFrame(out, columns=["session", "turn", "user", "assistant"])

    return messages.groupBy("session").applyInPandasWithState(step, TURNS, STATE, "append", "NoTimeout")


def rings(found: DataFrame, n: int = RING) -> DataFrame:
    """Each turn with the texts of the last n turns of its session, itself included."""
    w = Window.partitionBy("session").orderBy("turn").rowsBetween(-(n - 1), 0)
    return found.select("session", "turn", F.collect_list("user").over(w).alias("ring"))


def cadence(found: DataFrame, every: int) -> DataFrame:
    """The turns at which a job that runs each `every` turns is due."""
    return found.where((F.col("turn") % every) == 0).select("session", "turn")


def mailbox(events: DataFrame, ttl: int = TTL_SECONDS, lag: int = TURN_LAG) -> DataFrame:
    """events (session, seq, at, turn, kind put or take) with what each take finds in its session's one slot: the
    last put, if no take came since; delivered, or expired by age (ttl) or by turns (turn-lag); else empty."""
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda kind, c: F.max_by(F.when(F.col("kind") == kind, F.col(c)), F.when(F.col("kind") == kind, F.col("seq"))).over(w)
    rows = events.withColumns({"put_seq": before("put", "seq"), "put_at": before("put", "at"), "put_turn": before("put", "turn"), "take_seq": before("take", "seq")}).where("kind = 'take'")
    gone = F.col("put_seq").isNull() | (F.coalesce("take_seq", F.lit(-1)) > F.col("put_seq"))
    late = F.timestamp_diff("MICROSECOND", F.col("put_at"), F.col("at")) > ttl * 1_000_000
    outcome = F.when(gone, "empty").when(late, "ttl").when(F.col("turn") - F.col("put_turn") > lag, "turn-lag").otherwise("delivered")
    return rows.select("session", "seq", F.when(gone, None).otherwise(F.col("put_seq")).alias("put_seq"), outcome.alias("outcome"))


def first_shown(events: DataFrame, watermark: str | None = None) -> DataFrame:
    """The first time each session is shown each slug. On a stream: within the watermark, which bounds the state."""
    if events.isStreaming:
        return events.withWatermark("at", watermark or "48 hours").dropDuplicatesWithinWatermark(["session", "slug"])
    return events.groupBy("session", "slug").agg(F.min(F.struct("at", "event_id")).alias("x")).select("session", "slug", "x.at", "x.event_id")


def inbox(splices: DataFrame) -> DataFrame:
    """session, pending: what each session's inbox holds after its splices (session, seq, start, removed, inserted) in
    order. A fold over one session's splices, whose count is the length of a session; malformed ones (null or negative) are skipped."""
    s = splices.where("start >= 0 and removed >= 0 and inserted is not null")
    ordered = s.groupBy("session").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "removed", "inserted"))).alias("log"))

    def step(a, x):
        head = F.slice(a, 1, F.least(x["start"], F.size(a)))
        rest = F.slice(a, F.least(x["start"] + x["removed"], F.size(a)) + 1, F.size(a) + 1)
        return F.concat(head, x["inserted"], rest)

    return ordered.select("session", F.aggregate("log", F.array().cast("array<string>"), step).alias("pending"))


def day_windows(events: DataFrame, watermark: str = "2 days") -> DataFrame:
    """Events a day and type; on a stream late ones count until the watermark has passed the day."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("at", watermark)
    out = rows.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum(F.floor(F.col("value") * 100 + 0.5).cast("long")).alias("cents"))
    return out.select(F.to_date("w.start").alias("day"), "event_type", "n", "cents")


def top_level(events: DataFrame, enabled: bool = False) -> DataFrame:
    """events (depth, option_depth, ...) of sessions that no other session delegated; all of them if enabled. Works on streams too."""
    from loam.functions.numbers import delegation_depth

    return events if enabled else events.where(delegation_depth(F.col("depth"), F.col("option_depth")) == 0)


def slow_outcomes(exits: DataFrame) -> DataFrame:
    """exits (message, aborted, picks) of a slow lane with the outcome that its ledger keeps: every exit has one."""
    failed = F.col("message").isNotNull()
    late = F.coalesce(F.col("message").startswith("slow-lane call timeout"), F.lit(False)) | F.coalesce("aborted", F.lit(False))
    return exits.withColumn("outcome", F.when(failed & late, "timeout").when(failed, "llm-error").when(F.coalesce("picks", F.lit(0)) == 0, "none-relevant").otherwise("picked"))


def due(runs: DataFrame, now: str, days: int | None) -> DataFrame:
    """runs (job, at) with due: the last evaluated run is unknown or days old or more; never due without a cadence."""
    last = runs.groupBy("job").agg(F.max("at").alias("last"))
    age = F.timestamp_diff("MICROSECOND", F.col("last"), F.lit(now).cast("timestamp_ntz"))
    return last.withColumn("due", F.lit(days is not None) & (F.col("last").isNull() | (age >= (days or 0) * 86_400_000_000)))


def shadow_due(triggers: DataFrame, enabled: bool, lane: str, every: int = 5) -> DataFrame:
    """triggers (session, turn, query, candidates) that start a comparison: the lane is on (each turn, or every so many), there is
    something to ask, and none of the session is under way (busy)."""
    on = lane == "always" or lane == "sampled"
    turn = F.lit(True) if lane != "sampled" else (F.col("turn") % every) == 0
    return triggers.where(F.lit(enabled and on) & turn & (F.trim(F.coalesce("query", F.lit(""))) != "") & (F.col("candidates") > 0) & ~F.coalesce("busy", F.lit(False)))


def session_ends(events: DataFrame) -> DataFrame:
    """session, seq: the end that counts. Ends may come twice; the first fires, and no other until the session is seeded
    again. events: session, seq, kind (end, seed, other)."""
    w = Window.partitionBy("session").orderBy("seq")
    rows = events.withColumn("epoch", F.count(F.when(F.col("kind") == "seed", 1)).over(w)).where("kind = 'end'")
    return rows.groupBy("session", "epoch").agg(F.min("seq").alias("seq")).select("session", "seq")
