"""The streamed fold against the batch fold."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from vigilframe.operators import history
from vigilframe.streaming import certificates, folding

LOG = "eventId string, signalId string, eventType string, observedAt timestamp, domain string, brand string, sources array<string>, status string, previousStatus string, confidence int, reasonCodes array<string>"


def log(spark, first, n, start=datetime(2026, 7, 1)):
    kind = lambda i: "status-transition" if i % 3 == 0 else "observation"
    rows = [(f"e{i:04}", f"s{i % 4}", kind(i), start + timedelta(minutes=i ^ 5), f"d{i % 4}", "B" if i % 4 or i < 100 else f"B{i % 8}", [f"F{i % 3}"], "active" if i % 2 else "offline", None, 80, ["manual-review", f"c{i % 5}"]) for i in range(first, first + n)]
    return spark.createDataFrame(rows, LOG)


def stream(spark, path):
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(spark, path, name, **more):
    folding.with_rocksdb(spark)
    return folding.latest(certificates.drain(folding.folded(stream(spark, path), **more), name, "update"))


def test_stream_equals_the_batch_fold(spark, tmp_path):
    # One file a batch; the second repeats some of the first's last events.
    for part in (log(spark, 0, 300), log(spark, 290, 200)):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got = {r["id"]: r for r in run(spark, tmp_path / "in", "fold").collect()}
    want = {r["id"]: r for r in history.fold(log(spark, 0, 490)).collect()}
    assert got.keys() == want.keys() == {"s1", "s2", "s3"}
    for k, w in want.items():
        g = got[k].asDict()
        assert {c: g[c] for c in g if c != "reasonCodes"} == {c: w[c] for c in g if c != "reasonCodes"} and set(g["reasonCodes"]) == set(w["reasonCodes"])
        assert len(g["recentEventIds"]) == 64 and len(g["statusTransitions"]) == 16


def test_restart_goes_on_from_the_checkpoint_and_timers_expire(spark, tmp_path):
    folding.with_rocksdb(spark)
    seen = []

    def start():
        query = folding.folded(stream(spark, tmp_path / "in"), late="1 hour", expiry_days=1).writeStream.foreachBatch(lambda batch, _: seen.extend(batch.select("id", "observationCount", "events").collect())).outputMode("update")
        query.option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()

    one = lambda i, day: log(spark, i, 1, datetime(2026, 7, day)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    one(1, 1)
    start()
    one(5, 1)
    start()
    assert [tuple(r) for r in seen] == [("s1", 1, 1), ("s1", 2, 2)]
    # Another signal's event of a later day passes the timer of the first, which starts anew.
    one(2, 5)
    start()
    one(13, 6)
    start()
    assert [tuple(r) for r in seen][2:] == [("s2", 1, 1), ("s1", 1, 1)]
