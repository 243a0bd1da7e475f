"""Published tables and the health state that is one."""

from __future__ import annotations

import threading
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import health
from vigilframe.sources import publication


def rows(spark, *some):
    return spark.createDataFrame([(i, t, "now") for i, t in some], "id long, text string, generatedAt string")


def test_equal_tables_are_published_once(spark, tmp_path):
    root = str(tmp_path / "t")
    assert publication.read(spark, root) is None
    first = publication.publish(rows(spark, (1, "a"), (2, None), (2, None)), root)
    assert (first.number, first.rows, first.changed) == (1, 3, True)
    # The order of rows and the time of a document make no difference; a repeated row does.
    again = publication.publish(rows(spark, (2, None), (1, "a"), (2, None)).withColumn("generatedAt", F.lit("later")), root)
    assert (again.number, again.changed) == (1, False)
    assert publication.publish(rows(spark, (2, None), (1, "a")), root).number == 2
    assert publication.publish(rows(spark), root).number == 3 and publication.read(spark, root).count() == 0
    assert publication.publish(rows(spark, (1, "a")).withColumn("id", F.col("id").cast("int")), root).number == 4
    assert publication.prune(spark, root, keep=1) == 3 and publication.read(spark, root).schema["id"].dataType.simpleString() == "int"


def test_rows_are_computed_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = rows(spark, *[(i, "x") for i in range(10)]).mapInArrow(count, "id long, text string, generatedAt string")
    publication.publish(counted, str(tmp_path / "t"))
    assert seen.value == 10


def test_a_failed_write_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    publication.publish(rows(spark, (1, "a")), root)
    with pytest.raises(Exception, match="broken"):
        publication.publish(rows(spark, (1, "a"), (2, "b")).withColumn("text", F.when(F.col("id") == 2, F.raise_error(F.lit("broken"))).otherwise(F.col("text"))), root)
    with pytest.raises(ValueError, match="bytes"):
        publication.publish(rows(spark, (1, "long " * 100)), root, most_bytes=100)
    assert [tuple(r)[:2] for r in publication.read(spark, root).collect()] == [(1, "a")] and publication.latest(spark, root).number == 1


def test_one_of_two_writers_is_told(spark, tmp_path):
    root = str(tmp_path / "t")
    publication.publish(rows(spark, (1, "a")), root)
    with pytest.raises(publication.Conflict):
        publication.publish(rows(spark, (2, "b")), root, after=0)
    told = []

    def write(n):
        try:
            told.append(publication.publish(rows(spark, (n, "x")), root, after=1).number)
        except publication.Conflict:
            told.append(None)

    threads = [threading.Thread(target=write, args=(n,)) for n in (5, 6)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(told, key=str) == [2, None] and publication.read(spark, root).count() == 1


def at(hour, minute, second=0):
    return F.lit(f"2026-08-21T{hour:02}:{minute:02}:{second:02}Z").cast("timestamp")


METRICS = {"collectorStartedAt": "2026-08-21T19:02:05Z", "listeningSeconds": 240.0042, "messages": 83_875, "dnsNames": 146_591, "matches": 0, "newRecords": 0, "connectionAttempts": 1, "connections": 1}


def test_a_healthy_attempt_is_the_last_success(spark, tmp_path):
    store = health.Store(spark, str(tmp_path / "h"))
    assert store.read() is None
    store.begin(at(19, 2), "schedule")
    running = store.read(running=True).first()
    assert running["latestAttempt"]["outcome"] is None and running["latestAttempt"]["scheduleStatus"] == "scheduled" and running["freshness"]["status"] == "unavailable"
    with pytest.raises(ValueError):
        store.read()
    store.count(at(19, 4), METRICS | {"messages": 5})
    assert store.read(running=True).first()["latestAttempt"]["messages"] == 5
    store.complete(at(19, 6, 6), "healthy-empty", METRICS)
    row = store.read().first()
    assert row["lastSuccessAt"] == datetime(2026, 8, 21, 19, 6, 6) and tuple(row["freshness"])[::2] == ("current", 0)
    assert row["latestAttempt"]["listeningSeconds"] == 240.004 and row["latestAttempt"]["summary"].startswith("Input was processed")
    with pytest.raises(ValueError):
        store.count(at(19, 7), METRICS)
    store.finish(at(19, 8))
    assert store.read().first() == row


def test_a_failure_keeps_the_last_success(spark, tmp_path):
    store = health.Store(spark, str(tmp_path / "h"))
    store.begin(at(17, 2), "workflow_dispatch")
    assert store.read(running=True).first()["latestAttempt"]["scheduledFor"] is None
    store.complete(at(17, 6), "healthy-matches", METRICS | {"matches": 2, "newRecords": 1, "collectorStartedAt": None})
    store.begin(at(19, 22), "schedule")
    attempt = store.read(running=True).first()["latestAttempt"]
    assert (attempt["scheduleStatus"], attempt["delaySeconds"]) == ("delayed", 1200)
    store.finish(at(19, 23), prepared=False)
    row = store.read().first()
    assert row["lastSuccessAt"] == datetime(2026, 8, 21, 17, 6) and row["freshness"]["status"] == "stale" and row["latestAttempt"]["outcome"] == "failed"
    # What does not keep the contract is not published.
    store.begin(at(20, 2), None)
    for result, wrong in (("healthy-empty", METRICS | {"matches": 1}), ("partial", METRICS | {"connections": 0}), ("no-input", METRICS), ("healthy-matches", METRICS | {"matches": 1, "newRecords": 2}), ("failed", METRICS | {"connections": 2})):
        with pytest.raises(ValueError):
            store.complete(at(20, 6), result, wrong)
    store.count(at(20, 5), METRICS | {"collectorStartedAt": None})
    store.finish(at(20, 6))
    assert store.read().first()["latestAttempt"]["outcome"] == "partial"
