"""The append-only ledger."""

from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_operators import REGISTRY

from vigilframe.sources import ledger

REQUEST = "n int, recorded_at timestamp, action string, domain string, url string, brand string, scope string, reason_code string, confidence int, note string"
TIME = datetime(2026, 8, 21)


def requests(spark, *rows):
    base = {"recorded_at": TIME, "action": "add", "domain": "seb-login.example"}
    return spark.createDataFrame([base | {"n": i} | r for i, r in enumerate(rows)], REQUEST)


def test_entries_are_numbered_on_and_checked(spark, tmp_path):
    root = str(tmp_path / "ledger")
    assert ledger.read_ledger(spark, root).count() == 0
    assert ledger.record(requests(spark, {"note": " a\n b "}, {"domain": "X[.]example.", "action": "restore"}), root) == 2
    ledger.record(requests(spark, {"confidence": 0}), root)
    rows = ledger.read_ledger(spark, root).orderBy("sequence").collect()
    assert [(r["sequence"], r["domain"], r["note"]) for r in rows] == [(1, "seb-login.example", "a b"), (2, "x.example", None), (3, "seb-login.example", None)]
    assert len({r["event_id"] for r in rows}) == 3
    for wrong in ({"action": "drop"}, {"domain": "no host"}, {"scope": "all"}, {"confidence": 101}, {"recorded_at": None}):
        with pytest.raises(ValueError):
            ledger.record(requests(spark, {}, wrong), root)
    assert ledger.read_ledger(spark, root).count() == 3
    spark.createDataFrame([(4, "x", TIME, "drop", "a.example", None, None, None, None, None, None)], ledger.ENTRY).write.parquet(f"{root}/{9:012}")
    with pytest.raises(PySparkException, match="invalid entry"):
        ledger.read_ledger(spark, root).collect()


def test_brands_of_requests(spark):
    snapshot = spark.createDataFrame([("plain[.]example", "SEB"), ("two[.]example", "SEB"), ("two[.]example", "Swedbank")], "domain string, brand string")
    rows = requests(spark, {}, {"domain": "plain.example"}, {"domain": "two.example"}, {"domain": "seb-revolut-login.example"}, {"domain": "other.example", "brand": "swedbank"}, {"brand": "SEB"})
    got = ledger.resolved_brands(rows, REGISTRY, snapshot).orderBy("n").collect()
    assert [r["brand"] for r in got] == ["SEB", "SEB", None, None, "Swedbank", "SEB"]
    with pytest.raises(PySparkException, match="conflicts"):
        ledger.resolved_brands(requests(spark, {"brand": "Swedbank"}, {"brand": "Nobody", "domain": "other.example"}), REGISTRY, snapshot).collect()


def test_indicators(spark):
    rows = spark.createDataFrame([("hxxps://A[.]example/b?c",), ("plain.example",), ("ftp://x.example",), (None,)], "i string")
    got = [(r["domain"], r["url"]) for r in ledger.indicators(rows.withColumn("n", F.monotonically_increasing_id()), "i").orderBy("n").collect()]
    assert got == [("a.example", "https://a.example/b"), ("plain.example", "https://plain.example"), (None, None), (None, None)]
