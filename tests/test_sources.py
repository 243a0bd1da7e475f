"""Archived rows as sources, decisions, retained rows and counters of a synchronisation."""

from __future__ import annotations

import hashlib
import json
from datetime import date, datetime, timedelta

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from test_operators import REGISTRY, now, raw

from vigilframe.functions import signals as S
from vigilframe.operators import matching, review, views
from vigilframe.plans import archived, sync
from vigilframe.sources import archives, decisions
from vigilframe.streaming import certificates

NO_RULES = "domain string, scope string, brand string"


def test_synchronise_counts_and_retains(spark):
    """Fresh rows of one source, rows of another that did not answer, and one host that both have."""
    digest = lambda c: c * 64
    rows = raw(
        spark,
        {"last_seen": "2026-08-21T09:00:00Z", "hashes": [digest("b"), digest("a")]},
        {"url": "https://x.bad.example/", "brand": "SEB"},
        {"url": "https://nothing.example/"},
        {"url": "https://seb-login.example/", "source": "Other", "last_seen": "2026-08-21T08:00:00Z", "hashes": [digest("a"), digest("c")], "reason_codes": ["punycode"]},
    )
    rules = spark.createDataFrame([("bad.example", "subdomains", None)], NO_RULES)
    time = datetime(2026, 8, 20)
    old = spark.createDataFrame(
        [
            (S_ID, "hxxps://seb-login[.]example/a/longer/path", "seb-login[.]example", time, time, ["Feed", "Gone"], "active", "SEB", "LT", 99, ["manual-review"], [digest("d")]),
            ("x", "hxxps://swedbank-login[.]example", "swedbank-login[.]example", time, time, ["Gone"], "active", "Swedbank", None, 70, ["punycode"], [digest("d")]),
            ("y", "hxxps://swedbank[.]lt/x", "swedbank[.]lt", time, time, ["Gone"], "active", "Swedbank", None, 70, ["punycode"], []),
            ("z", "hxxps://revolut-login[.]example", "revolut-login[.]example", time, time, ["Feed"], "active", "Revolut", None, 70, ["punycode"], []),
            ("w", "hxxps://omniva-login[.]example", "omniva-login[.]example", datetime(2026, 8, 1), datetime(2026, 8, 1), ["Gone"], "active", "Omniva", None, 70, ["punycode"], []),
        ],
        "id string, url string, domain string, firstSeen timestamp, lastSeen timestamp, sources array<string>, status string, brand string, country string, confidence int, reasonCodes array<string>, hashes array<string>",
    )
    kept = sync.retained(old, now(), 7, ["Feed", "Other", "Gone"], ["Feed", "Other", "Gone"], ["Feed", "Other"])
    made = sync.synchronise(rows, REGISTRY, rules, now(), old=kept, sources=["Feed", "Other", "Gone"])
    assert {r["source"]: (r["accepted"], r["excluded"], r["note"]) for r in made.counts.collect()} == {"Feed": (1, 2, "2 non-registry targets excluded"), "Other": (1, 0, None), "Gone": (0, 0, None)}
    got = {r["domain"]: r for r in made.snapshot.collect()}
    assert set(got) == {"seb-login[.]example", "swedbank-login[.]example"}
    both, carried = got["seb-login[.]example"], got["swedbank-login[.]example"]
    assert (both["sources"], both["hashes"], both["reasonCodes"]) == (["Feed", "Gone", "Other"], [digest("b"), digest("a"), digest("c")], ["brand-exact-token", "punycode", "manual-review"])
    assert (both["url"], both["status"], both["confidence"], both["firstSeen"], both["country"]) == ("hxxps://seb-login[.]example/a/longer/path", "suspected", 99, time, "LT")
    assert (carried["url"], carried["brand"], carried["status"], carried["sources"], carried["lastSeen"], carried["hashes"]) == ("hxxps://swedbank-login[.]example", "Swedbank", "active", ["Gone"], time, [])
    assert {e["domain"] for e in made.events.where("eventType = 'observation'").collect()} == {"seb-login[.]example"}


S_ID = hashlib.sha256(b"seb-login[.]example").hexdigest()[:20]


def test_exclusion_notes(spark):
    rows = spark.createDataFrame([("Old note", 1), (None, 2), ("Old note", 0)], "note string, n long")
    assert [r[0] for r in rows.select(sync.exclusion_note(F.col("note"), F.col("n"))).collect()] == ["Old note; 1 non-registry target excluded", "2 non-registry targets excluded", "Old note"]


def test_archived_candidates_are_scored_again(spark):
    day = date(2026, 8, 21)
    rows = spark.createDataFrame([(day, "i", datetime(2026, 8, 21, 9), d, d, "S", "Stale brand", 1, ["old"]) for d in ("seb-login.example", "swedbank.lt", "nothing.example", "revolut-swedbank-login.example")], "day date, id string, observedAt timestamp, domain string, registrable string, source string, brand string, confidence int, reasons array<string>")
    (got,) = archived.candidate_signals(rows, REGISTRY, "Sample").collect()
    assert (got["url"], got["brand"], got["confidence"], got["reason_codes"], got["last_seen"]) == ("seb-login.example", "SEB", 90.0, ["brand-exact-token", "suspicious-context", "different-tld"], "2026-08-21T09:00:00.000Z")
    assert archived.candidate_signals(rows.limit(0), REGISTRY, "Sample").count() == 0


def test_lines_are_read_once_and_not_before_a_distinct(spark):
    """Checks of a line's fields stay after what makes the lines: before, each was moved below the distinct and read the line anew."""
    line = F.to_json(F.struct(F.lit(1).alias("schemaVersion"), (F.col("id") % 3).cast("string").alias("domain"), F.lit("x").alias("brand")))
    lines = spark.range(9).select(F.lit("2026-08-21").cast("date").alias("day"), line.alias("line")).distinct().withColumn("value", F.try_parse_json("line"))
    for rows in (archives.candidates(lines), archives.reports(lines, now())):
        plan = rows._jdf.queryExecution().optimizedPlan().toString().lower()
        below = plan.split("aggregate [")[1].split("\n", 1)[1]
        assert plan.count("parsejson") == 1 and "parsejson" not in below and "filter" not in below
        assert rows.count() == 0


def test_archived_reports_need_the_support_of_now(spark):
    """What is written as an archive is read, reviewed, and published again by a synchronisation."""

    def row(domain, brand, *evidence):
        shown = domain.replace(".", "[.]")
        return (date(2026, 8, 21), shown, "hxxps://" + shown + "/x", brand, list(evidence))

    rows = spark.createDataFrame([row("seb-login.example", "SEB", "domain"), row("seb-support.example", "Swedbank", "title"), row("plain.example", "Swedbank", "domain"), row("kit.example", "swedbank", "title"), row("x.swedbank.lt", "Swedbank", "verdict"), row("bigbang.example", "Big Bank", "verdict"), row("other.example", "Unknown", "title")], "day date, domain string, url string, brand string, brandEvidence array<string>")
    time = F.lit("2026-08-21T09:00:00Z").cast("timestamp")
    nothing = F.lit(None).cast("string")
    full = rows.withColumns({"id": S.short_id(F.col("domain")), "status": F.lit("suspected"), "country": nothing, "host": nothing, "screenshotUrl": nothing, "referenceUrl": F.lit("https://reports.test/1"), "firstSeen": time, "lastSeen": time, "hashes": F.array(F.lit("ab" * 32)), "confidence": F.lit(90)})
    kept = archived.reviewed_reports(full, REGISTRY)
    assert sorted(r["domain"] for r in kept.collect()) == ["kit[.]example", "seb-login[.]example"]
    made = sync.synchronise(archived.report_signals(kept, "Reports"), REGISTRY, spark.createDataFrame([], NO_RULES), now())
    got = {r["domain"]: r for r in made.snapshot.collect()}
    assert got["kit[.]example"]["brand"] == "Swedbank" and got["kit[.]example"]["reasonCodes"] == ["brand-title-match"] and got["seb-login[.]example"]["referenceUrl"] == "https://reports.test/1"


def document(**change):
    def identified(fields):
        text = json.dumps(fields, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
        return {"id": hashlib.sha256(text.encode()).hexdigest()[:24]} | fields

    suppression = {"domain": "seb-login[.]example", "scope": "exact", "brand": "SEB", "reasonCode": "wrong-brand"} | change.pop("suppression", {})
    shown = "revolut-login[.]example"
    candidate = {"signalId": hashlib.sha256(shown.encode()).hexdigest()[:20], "url": f"hxxps://{shown}/é", "domain": shown, "observedAt": "2026-08-21T09:00:00.000Z", "brand": "Revolut", "confidence": 80, "reasonCodes": ["manual-review"]} | change.pop("candidate", {})
    candidate["url"] = change.pop("url", f"hxxps://{shown}/%C3%A9")
    body = {"schemaVersion": 1, "dataset": decisions.DATASET, "generatedAt": "2026-08-21T09:00:00.000Z", "suppressions": [identified(suppression), identified({"domain": "other[.]example", "scope": "subdomains", "brand": None, "reasonCode": "legitimate-domain"})], "candidates": [identified(candidate)]}
    return body | change


def test_decisions_are_read_whole(spark, tmp_path):
    path = tmp_path / "decisions.json"
    none = decisions.read_decisions(spark, str(path), REGISTRY, now())
    assert none.suppressions.count() == none.candidates.count() == none.manual_signals("Review").count() == 0
    path.write_text(json.dumps(document()))
    policy = decisions.read_decisions(spark, str(path), REGISTRY, now())
    (signal,) = policy.manual_signals("Review").collect()
    assert (signal["url"], signal["brand"], signal["confidence"]) == ("https://revolut-login.example/%C3%A9", "Revolut", 80.0)
    hosts = spark.createDataFrame([("seb-login[.]example", "SEB"), ("seb-login[.]example", "Revolut"), ("a[.]other[.]example", "SEB")], "domain string, brand string")
    assert [r["brand"] for r in review.drop_suppressed(hosts, policy.rules()).collect()] == ["Revolut"]


@pytest.mark.parametrize(
    "broken",
    [
        "no json",
        json.dumps(document(schemaVersion=2)),
        json.dumps(document(extra=1)),
        json.dumps(document(suppressions={})),
        json.dumps(document(suppression={"brand": "Revolut"})),
        json.dumps(document(candidate={"confidence": 101})),
        json.dumps(document(suppressions=[document()["suppressions"][0]] * 2)),
        json.dumps(document()) + " " * decisions.MOST_BYTES,
    ],
    ids=["json", "version", "keys", "list", "wrong brand", "too sure", "repeated", "size"],
)
def test_broken_decisions_fail_closed(spark, tmp_path, broken):
    (tmp_path / "d.json").write_text(broken)
    with pytest.raises(PySparkException, match="review document"):
        decisions.read_decisions(spark, str(tmp_path / "d.json"), REGISTRY, now())


def test_only_the_days_of_a_batch_are_read(spark, tmp_path):
    first = date(2026, 1, 1)
    stored = spark.range(40).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("day"), F.lit("a").alias("id"), F.col("id").alias("n"))
    archives.write_days(stored, str(tmp_path / "t"))
    rows = spark.createDataFrame([(first + timedelta(days=3), "a", 1), (first + timedelta(days=3), "b", 1), (first + timedelta(days=90), "a", 1)], "day date, id string, n long")
    found = certificates.stored_days(rows, str(tmp_path / "t"))
    assert [r["n"] for r in found.collect()] == [3] and len(found.inputFiles()) >= 1
    scan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in scan and "day#" in scan.split("PartitionFilters: [")[1].split("]")[0]
    assert sorted(r["id"] + str(r["day"]) for r in archives.append_new(rows, found, F.col("n")).collect()) == ["a2026-04-01", "b2026-01-04"]
    assert certificates.stored_days(rows, str(tmp_path / "nothing")).count() == 0


def test_titles_and_facets_of_any_accent(spark):
    titles = spark.createDataFrame([("Ŝẅëḋbänḱ – prisijungimas",), ("ＳＷＥＤＢＡＮＫ",), ("swedbankas",), ("svedbank",), ("ѕwedbank",), ("swed bank",), ("Swedbank and Revolut",), ("",), (None,)], "title string")
    got = {r["title"]: r["title_brand"] for r in matching.title_brand(titles, REGISTRY).collect()}
    assert {t for t, b in got.items() if b == "Swedbank"} == {"Ŝẅëḋbänḱ – prisijungimas", "ＳＷＥＤＢＡＮＫ", "ѕwedbank"} and got["swedbankas"] is got["svedbank"] is got["Swedbank and Revolut"] is None and len(got) == 9
    values = spark.createDataFrame([(v,) for v in ["Zoe", "zoe", "Éa", "eb", "ea", "ö", "p", "O", "", None, "zoe"]], "v string")
    assert [r["value"] for r in views.facets(values, "v").collect()] == ["ea", "Éa", "eb", "O", "ö", "p", "zoe", "Zoe"]
