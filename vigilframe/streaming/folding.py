"""The fold of the event log as a stream: keyed state with bounds, and timers that expire it.

A signal's state is what ``history.fold`` keeps of it, with the newest 64 event ids and
16 transitions, so it does not grow with its events.  An event-time timer clears a
signal that was not seen for ``expiry_days``.  Rows of a signal stream through, a bounded
number of them is sorted at a time.
"""

from __future__ import annotations

import json
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from vigilframe.operators.history import FOLDED, MOST_COUNT, RECENT, TRANSITIONS

#: Times are microseconds in what the workers give.
TRANSITION = "struct<observedAt: long, eventId: string, previousStatus: string, status: string, sources: array<string>, reasonCodes: array<string>>"
OUT = (
    "id string, domain string, brand string, firstSeen long, lastSeen long, observationCount int, sources array<string>, latestStatus string, statusObservedAt long, "
    f"reasonCodes array<string>, statusTransitions array<{TRANSITION}>, recentEventIds array<string>, conflicting boolean, events long"
)
_TEXTS = T.ArrayType(T.StringType())
#: Kept of a signal.  Times are microseconds; ``moved`` is JSON of the transitions.
STATE = T.StructType(
    [
        T.StructField(name, kind)
        for name, kind in {
            "domain": T.StringType(), "brand": T.StringType(), "first": T.LongType(), "last": T.LongType(), "observations": T.LongType(), "sources": _TEXTS, "status": T.StringType(), "statusAt": T.LongType(), "statusId": T.StringType(),
            "codes": _TEXTS, "moved": T.StringType(), "recentAt": T.ArrayType(T.LongType()), "recentIds": _TEXTS, "conflicting": T.BooleanType(), "events": T.LongType(),
        }.items()
    ]
)
MOST_CODES, SORTED = 16, 10_000


def empty() -> dict:
    return {"domain": None, "brand": None, "first": None, "last": None, "observations": 0, "sources": [], "status": None, "statusAt": -1, "statusId": "", "codes": [], "moved": [], "recent": [], "conflicting": False, "events": 0}


def add(state: dict, event: dict) -> None:
    """One event into a state; an event that is among the recent ones changes nothing."""
    at, key, recent = event["at"], event["eventId"], state["recent"]
    place = bisect_left(recent, (at, key))
    if recent[place : place + 1] == [(at, key)]:
        return
    state["events"] += 1
    for name in ("domain", "brand"):
        if state[name] is None:
            state[name] = event[name]
        elif state[name] != event[name]:
            state["conflicting"] = True
    state["first"] = at if state["first"] is None else min(at, state["first"])
    state["last"] = at if state["last"] is None else max(at, state["last"])
    state["observations"] += event["eventType"] == "observation"
    if any(x not in state["sources"] for x in event["sources"]):
        state["sources"] = sorted({*state["sources"], *event["sources"]})
    if any(x not in state["codes"] for x in event["reasonCodes"]):
        state["codes"] = list(dict.fromkeys([*state["codes"], *event["reasonCodes"]]))[:MOST_CODES]
    if (at, key) > (state["statusAt"], state["statusId"]):
        state["statusAt"], state["statusId"], state["status"] = at, key, event["status"]
    if event["eventType"] == "status-transition":
        insort(state["moved"], (at, key, event["previousStatus"], event["status"], list(event["sources"]), list(event["reasonCodes"])), key=lambda m: m[:2])
        del state["moved"][:-TRANSITIONS]
    recent.insert(place, (at, key))
    del recent[:-RECENT]


class Fold(StatefulProcessor):
    def __init__(self, expiry_days: int) -> None:
        self.expiry = expiry_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("folded", STATE)

    def _read(self) -> dict:
        if (kept := self.kept.get()) is None:
            return empty()
        domain, brand, first, last, observations, sources, status, status_at, status_id, codes, moved, recent_at, recent_ids, conflicting, events = kept
        plain = {"domain": domain, "brand": brand, "first": first, "last": last, "observations": observations, "sources": list(sources), "status": status, "statusAt": status_at, "statusId": status_id, "codes": list(codes)}
        return plain | {"moved": [tuple(m) for m in json.loads(moved)], "recent": list(zip(recent_at, recent_ids, strict=True)), "conflicting": conflicting, "events": events}

    def _write(self, s: dict) -> None:
        at, ids = [r[0] for r in s["recent"]], [r[1] for r in s["recent"]]
        self.kept.update((s["domain"], s["brand"], s["first"], s["last"], s["observations"], s["sources"], s["status"], s["statusAt"], s["statusId"], s["codes"], json.dumps(s["moved"]), at, ids, s["conflicting"], s["events"]))

    def _due(self, state: dict) -> int:
        """When a signal expires, in milliseconds."""
        return state["last"] // 1_000 + self.expiry

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self._read()
        before = None if state["last"] is None else self._due(state)
        # Rows come in no order; among those sorted together the order of events decides which codes are the first.
        while some := list(islice(rows, SORTED)):
            events = [json.loads(row["event"]) for row in some]
            for event in sorted(events, key=lambda e: (e["at"], e["eventId"])):
                add(state, event)
        self._write(state)
        if (due := self._due(state)) != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(due)
        moved = [dict(zip(("observedAt", "eventId", "previousStatus", "status", "sources", "reasonCodes"), m, strict=True)) for m in state["moved"]]
        yield Row(
            id=key[0], domain=state["domain"], brand=state["brand"], firstSeen=state["first"], lastSeen=state["last"], observationCount=min(MOST_COUNT, state["observations"]), sources=state["sources"], latestStatus=state["status"],
            statusObservedAt=state["statusAt"], reasonCodes=state["codes"], statusTransitions=moved, recentEventIds=[i for _, i in state["recent"]], conflicting=state["conflicting"], events=state["events"],
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # A timer of another ``expiry_days`` may be left from before a restart.
        state = self._read()
        if state["last"] is None or expiredTimerInfo.getExpiryTimeInMs() >= self._due(state):
            self.kept.clear()
        return iter([])

    def close(self) -> None:
        pass


def folded(events: DataFrame, late: str = "30 days", expiry_days: int = 730) -> DataFrame:
    """A stream of ``history.EVENT`` rows as a stream of folds: for every batch, each signal that it changed.

    Events that are ``late`` behind the newest are dropped.  Needs the RocksDB state store
    (``with_rocksdb``).  ``events`` counts a signal's events, so that of its rows the one
    that has most is the latest.
    """
    # One text an event: Spark hands a row to Python value by value.
    fields = F.struct(F.unix_micros("observedAt").alias("at"), "eventId", "eventType", "domain", "brand", "sources", "status", "previousStatus", "reasonCodes")
    rows = events.select("signalId", "observedAt", F.to_json(fields, {"ignoreNullFields": "false"}).alias("event")).withWatermark("observedAt", late)
    kept = rows.groupBy("signalId").transformWithState(Fold(expiry_days), OUT, "Update", "EventTime")
    moved = F.transform("statusTransitions", lambda t: t.withField("observedAt", F.timestamp_micros(t["observedAt"])))
    return kept.withColumns({c: F.timestamp_micros(c) for c in ("firstSeen", "lastSeen", "statusObservedAt")} | {"statusTransitions": moved})


def with_rocksdb(spark) -> None:
    """The state store that keyed state with timers needs, unless the session names one."""
    setting = "spark.sql.streaming.stateStore.providerClass"
    if "RocksDB" not in spark.conf.get(setting, ""):
        spark.conf.set(setting, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def latest(updates: DataFrame) -> DataFrame:
    """The last fold of each signal; signals with two domains or brands go, as in ``history.fold``."""
    last = updates.groupBy("id").agg(F.max_by(F.struct(*[c for c in updates.columns if c != "id"]), "events").alias("r")).select("id", "r.*")
    return last.where("not conflicting").select(*FOLDED)
