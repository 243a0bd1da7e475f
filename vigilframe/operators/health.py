"""Health of a collection: schedule, freshness, outcome, and the state machine of its attempts.

The state is a table of one row.  A step makes the next row from the last one; the row
is checked as a whole before it is published, and published only over the version that
it was made from.  The last success stays over attempts that fail.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.sources import publication

#: How attempts end, are started and scheduled, and what is said of their end.
SUMMARIES = {
    "healthy-empty": "Input was processed successfully; no candidate matched the publication heuristic.",
    "healthy-matches": "Input was processed successfully and one or more candidates matched.",
    "no-input": "A source connection opened, but no certificate DNS names were received.",
    "partial": "The collector processed only part of its expected listening window.",
    "failed": "The collector could not establish or complete a usable listening window.",
}
HEALTHY = ("healthy-empty", "healthy-matches")
RUNNING = "Collection attempt in progress."
DATASET = "collection-health"
COUNTERS = ("messages", "dnsNames", "matches", "newRecords", "connectionAttempts", "connections")
MOST_COUNT, MOST_BYTES = 2_147_483_647, 32 * 1024
ATTEMPT = f"struct<startedAt: timestamp, collectorStartedAt: timestamp, endedAt: timestamp, trigger: string, scheduledFor: timestamp, scheduleStatus: string, delaySeconds: bigint, expectedListeningSeconds: int, listeningSeconds: double, {', '.join(f'{c}: bigint' for c in COUNTERS)}, outcome: string, summary: string>"
STATE = f"schemaVersion int, dataset string, generatedAt timestamp, expectedIntervalSeconds int, staleAfterSeconds int, lastSuccessAt timestamp, freshness struct<status: string, referenceAt: timestamp, ageSeconds: bigint>, latestAttempt {ATTEMPT}"


def scheduled_slot(started: Column, minutes: Column) -> Column:
    """The latest configured minute at or before a start; else the hour before's last."""
    hour = F.date_trunc("hour", started)
    now = F.array_max(F.filter(minutes, lambda m: m <= F.minute(started)))
    return F.when(now.isNotNull(), hour + F.make_dt_interval(mins=now)).otherwise(hour - F.expr("interval 1 hour") + F.make_dt_interval(mins=F.array_max(minutes)))


def delay_seconds(started: Column, slot: Column) -> Column:
    return F.greatest(F.lit(0), F.floor(F.unix_micros(started.cast("timestamp")) / 1e6) - F.unix_timestamp(slot)).cast("long")


def freshness(reference: Column, now: Column, stale_after: int | Column = 5_400) -> Column:
    age = F.greatest(F.lit(0), F.unix_timestamp(now) - F.unix_timestamp(reference)).cast("long")
    return F.struct(F.when(reference.isNull(), "unavailable").when(age <= stale_after, "current").otherwise("stale").alias("status"), reference.alias("referenceAt"), F.when(reference.isNotNull(), age).alias("ageSeconds"))


def outcome(messages: Column, matches: Column, listened: Column, wanted: Column, failed: Column) -> Column:
    """Of a finished attempt: failed, no-input, partial below nine tenths of the window, healthy."""
    return F.when(failed, "failed").when(messages == 0, "no-input").when((wanted > 0) & (listened < 0.9 * wanted), "partial").when(matches == 0, "healthy-empty").otherwise("healthy-matches")


def attempt_valid(a: Column, running: bool = False) -> Column:
    """The contract of an attempt: its counters agree with each other, with its schedule and with its outcome."""
    get = lambda name: a[name]
    none = lambda *names: F.lit(True) if not names else get(names[0]).isNull() & none(*names[1:])
    known = lambda c, some: c.isin(list(some))
    counters = F.forall(F.array(*[get(c) for c in COUNTERS]), lambda x: x.isNotNull() & x.between(0, MOST_COUNT))
    seconds = lambda c: get(c).isNotNull() & get(c).between(0, 86_400)
    summary = F.length(get("summary")).between(1, 240) & (F.trim(get("summary")) == get("summary")) & ~get("summary").rlike(r"\p{Cntrl}")
    slot = (get("trigger") == "schedule") & (get("scheduledFor") <= get("startedAt")) & (get("delaySeconds") == delay_seconds(get("startedAt"), get("scheduledFor")))
    free = none("scheduledFor", "delaySeconds") & ((get("scheduleStatus") == "manual") == (get("trigger") == "manual"))
    base = (
        get("startedAt").isNotNull() & known(get("trigger"), ("schedule", "manual", "unknown")) & known(get("scheduleStatus"), ("scheduled", "delayed", "manual", "unknown")) & seconds("expectedListeningSeconds") & seconds("listeningSeconds")
        & counters & (get("dnsNames") >= get("matches")) & (get("connectionAttempts") >= get("connections")) & summary
        & (get("collectorStartedAt").isNull() | ((get("collectorStartedAt") >= get("startedAt")) & (get("endedAt").isNull() | (get("collectorStartedAt") <= get("endedAt")))))
        & F.when(known(get("scheduleStatus"), ("scheduled", "delayed")), slot).otherwise(free)
    )
    took = (get("connections") > 0) & (get("dnsNames") > 0)
    agrees = (
        F.when(get("outcome") == "healthy-empty", took & (get("matches") == 0))
        .when(get("outcome") == "healthy-matches", took & (get("matches") > 0))
        .when(get("outcome") == "partial", took)
        .when(get("outcome") == "no-input", (get("connections") > 0) & (get("dnsNames") == 0))
        .otherwise(get("outcome") == "failed")
    )
    ended = (get("endedAt") >= get("startedAt")) & (get("newRecords") <= get("matches")) & agrees
    return F.coalesce(base & F.when(get("outcome").isNull(), F.lit(running) & get("endedAt").isNull()).otherwise(ended), F.lit(False))


def state_valid(running: bool = False) -> Column:
    """The contract of the whole state; ``running`` admits an attempt without an outcome."""
    a, last, at = F.col("latestAttempt"), F.col("lastSuccessAt"), F.col("generatedAt")
    fresh = freshness(last, at, F.col("staleAfterSeconds"))
    told = F.col("freshness.status").eqNullSafe(fresh["status"]) & F.col("freshness.referenceAt").eqNullSafe(last) & F.col("freshness.ageSeconds").eqNullSafe(fresh["ageSeconds"])
    open_ = a["outcome"].isNull() & (a["startedAt"] <= at) & (last <= a["startedAt"])
    closed = a["outcome"].isNotNull() & (a["endedAt"] <= at) & F.when(a["outcome"].isin(list(HEALTHY)), a["endedAt"] == last).otherwise(last <= a["startedAt"])
    good = (
        (F.col("schemaVersion") == 1) & (F.col("dataset") == DATASET) & at.isNotNull() & F.col("expectedIntervalSeconds").between(1, MOST_COUNT) & F.col("staleAfterSeconds").between(1, MOST_COUNT)
        & (a.isNull() | attempt_valid(a, running)) & told & (last.isNull() | (a.isNotNull() & (last <= at) & (open_ | closed)))
    )
    return F.coalesce(good, F.lit(False))


def attempt_problems(rows: DataFrame) -> DataFrame:
    """Attempts whose counters contradict each other."""
    good = F.forall(F.array(*[F.col(c).cast("long") for c in COUNTERS]), lambda x: x.isNotNull() & (x >= 0))
    good = good & (F.col("matches") <= F.col("dnsNames")) & (F.col("newRecords") <= F.col("matches")) & (F.col("connections") <= F.col("connectionAttempts"))
    return rows.where(~F.coalesce(good, F.lit(False)))


def _next(state: DataFrame, at: Column, attempt: Column, success: Column) -> DataFrame:
    """The state with its attempt and last success as they are now, and what follows from them."""
    moved = state.withColumns({"generatedAt": F.date_trunc("millisecond", at), "latestAttempt": attempt, "lastSuccessAt": success})
    return moved.withColumn("freshness", freshness(F.col("lastSuccessAt"), F.col("generatedAt"), F.col("staleAfterSeconds"))).select(*_names())


def _names() -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return [f.name for f in _parse_datatype_string(STATE)]


def _counted(metrics: dict) -> list[tuple[str, Column]]:
    """Fields of an attempt from the metrics of its batches; what they do not name is none."""
    started = F.lit(metrics.get("collectorStartedAt")).cast("timestamp")
    listened = F.round(F.greatest(F.lit(0.0), F.lit(float(metrics.get("listeningSeconds", 0.0)))), 3)
    return [("collectorStartedAt", F.date_trunc("millisecond", started)), ("listeningSeconds", listened), *[(c, F.lit(int(metrics.get(c) or 0)).cast("long")) for c in COUNTERS]]


def _with(attempt: Column, fields: list[tuple[str, Column]]) -> Column:
    for name, value in fields:
        attempt = attempt.withField(name, value)
    return attempt


def begun(spark: SparkSession, last: DataFrame | None, at: Column, trigger: str | None, interval: int = 1_800, stale_after: int = 5_400, listening: int = 240, minutes: tuple[int, ...] = (2, 32), late: int = 300) -> DataFrame:
    """A running attempt; the last success stays."""
    word = {"schedule": "schedule", "manual": "manual", "workflow_dispatch": "manual"}.get((trigger or "").strip().lower(), "unknown")
    interval = min(86_400, max(60, interval))
    base = spark.range(1).select(F.lit(1).alias("schemaVersion"), F.lit(DATASET).alias("dataset"), F.lit(interval).alias("expectedIntervalSeconds"), F.lit(min(7 * 86_400, max(interval, stale_after))).alias("staleAfterSeconds"))
    before = last.select("lastSuccessAt") if last is not None else spark.range(1).select(F.lit(None).cast("timestamp").alias("lastSuccessAt"))
    started = F.date_trunc("millisecond", at)
    slot = scheduled_slot(started, F.array(*[F.lit(m) for m in sorted(minutes)])).cast("timestamp") if word == "schedule" else F.lit(None).cast("timestamp")
    delay = delay_seconds(started, slot) if word == "schedule" else F.lit(None).cast("long")
    status = F.when(delay > late, "delayed").otherwise("scheduled") if word == "schedule" else F.lit(word)
    nothing = F.lit(None).cast("timestamp")
    fields = {"startedAt": started, "collectorStartedAt": nothing, "endedAt": nothing, "trigger": F.lit(word), "scheduledFor": slot, "scheduleStatus": status, "delaySeconds": delay, "expectedListeningSeconds": F.lit(min(86_400, max(0, listening))), "listeningSeconds": F.lit(0.0)}
    fields |= {c: F.lit(0).cast("long") for c in COUNTERS} | {"outcome": F.lit(None).cast("string"), "summary": F.lit(RUNNING)}
    # One row and at most one row.
    return _next(base.join(before), at, F.struct(*[v.alias(k) for k, v in fields.items()]).cast(ATTEMPT), F.col("lastSuccessAt"))


def counted(state: DataFrame, at: Column, metrics: dict) -> DataFrame:
    """The running attempt with the metrics so far."""
    return _next(state, at, _with(F.col("latestAttempt"), _counted(metrics)), F.col("lastSuccessAt"))


def completed(state: DataFrame, at: Column, result: Column | str, metrics: dict | None = None) -> DataFrame:
    """The attempt with its outcome; a healthy one is the last success.  Without ``metrics`` those counted before stay."""
    ended = F.date_trunc("millisecond", at)
    result = F.lit(result) if isinstance(result, str) else result
    told = F.coalesce(*[F.when(result == k, v) for k, v in SUMMARIES.items()])
    fields = [*(_counted(metrics) if metrics is not None else []), ("endedAt", ended), ("outcome", result), ("summary", told)]
    return _next(state, at, _with(F.col("latestAttempt"), fields), F.when(result.isin(list(HEALTHY)), ended).otherwise(F.col("lastSuccessAt")))


def abandoned(prepared: bool = True) -> Column:
    """The outcome of an attempt that was left running."""
    a = F.col("latestAttempt")
    return F.when(~F.lit(prepared) | (a["connections"] == 0), "failed").when(a["dnsNames"] == 0, "no-input").otherwise("partial")


class Store:
    """The published state at ``root``; every step reads it, checks it, and publishes over what it read."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root

    def read(self, running: bool = False) -> DataFrame | None:
        """The state, or None before the first; one that breaks its contract is an error."""
        state = publication.read(self.spark, self.root)
        if state is not None and (state.limit(2).count() != 1 or state.where(state_valid(running)).isEmpty()):
            raise ValueError("the health state does not keep its contract")
        return state

    def _write(self, state: DataFrame, running: bool, after: int) -> publication.Version:
        from vigilframe.plans.shared import cut

        held = cut(state.coalesce(1))
        if held.where(state_valid(running)).count() != 1:
            raise ValueError("refusing to publish a health state that does not keep its contract")
        # All columns count: a later look is news even when nothing else has changed.
        return publication.publish(held, self.root, ignored=(), most_bytes=MOST_BYTES, after=after)

    def _number(self) -> int:
        now = publication.latest(self.spark, self.root)
        return now.number if now else 0

    def begin(self, at: Column, trigger: str | None = None, **settings) -> publication.Version:
        after = self._number()
        return self._write(begun(self.spark, self.read(running=True), at, trigger, **settings), True, after)

    def _open(self) -> DataFrame:
        state = self.read(running=True)
        if state is None or state.where("latestAttempt is not null and latestAttempt.outcome is null").isEmpty():
            raise ValueError("no attempt is running")
        return state

    def count(self, at: Column, metrics: dict) -> publication.Version:
        after = self._number()
        return self._write(counted(self._open(), at, metrics), True, after)

    def complete(self, at: Column, result: str, metrics: dict) -> publication.Version:
        if result not in SUMMARIES:
            raise ValueError(f"no outcome: {result}")
        if (state := self.read(running=True)) is None or state.where("latestAttempt is not null").isEmpty():
            self.begin(at)
        after = self._number()
        return self._write(completed(self._open(), at, result, metrics), False, after)

    def finish(self, at: Column, prepared: bool = True) -> None:
        """Closes an attempt that was left running; does nothing to one that has ended."""
        if (state := self.read(running=True)) is None or state.where("latestAttempt is not null").isEmpty():
            self.begin(at)
        after = self._number()
        state = self.read(running=True)
        if not state.where("latestAttempt.outcome is null").isEmpty():
            self._write(completed(state, at, abandoned(prepared)), False, after)
