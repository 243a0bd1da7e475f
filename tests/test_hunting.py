"""The composed hunt against a sequential model and by its stated rules."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from test_operators import REGISTRY, now
from vigilframe.plans import hunting
from vigilframe.plans.shared import cut
from vigilframe.sources import feeds

KIT, OTHER = "ab" * 32, "cd" * 32
REPLIES = "phase string, query string, pos int, j string"


def uuid(i):
    return f"00000000-0000-0000-0000-{i:012}"


def reply(phase, pos, i, url, title=None, query=None, visibility="public", task=None):
    scan = {"_id": uuid(i).upper(), "task": {"visibility": visibility, "url": task or url, "time": "2026-08-20T01:02:03.004Z"}, "page": {"url": url, "title": title, "country": "LT", "asn": "AS1"}}
    return phase, query, pos, json.dumps(scan)


def detail(i, url, title=None, digest=KIT, brands=(), categories=(), score=0, visibility="public", **page):
    document = {"request": {"type": "Document"}, "response": {"hash": digest, "response": {"url": url, "status": 200, "mimeType": "text/html", "encodedDataLength": 0, "dataLength": 900}}}
    body = {"task": {"visibility": visibility, "url": url}, "page": {"url": url, "title": title} | page, "verdicts": {"svc": {"score": score, "categories": list(categories), "brands": [{"name": b} for b in brands]}}, "data": {"requests": [7, {"response": {"hash": 5}}, document]}}
    return uuid(i), json.dumps(body)


def run(spark, replies, details, seeds=(), **limits):
    scans = feeds.scans(spark.createDataFrame(replies, REPLIES).select("phase", "query", "pos", F.try_parse_json("j").alias("v")))
    told = feeds.details(spark.createDataFrame(details, "uuid string, j string").select("uuid", F.try_parse_json("j").alias("v")), "svc")
    wanted = spark.createDataFrame(list(seeds), "domain string, brand string, confidence int")
    return scans, told, wanted, hunting.Limits(**limits)


def shown(found):
    return [(r["phase"], int(r["uuid"][-4:]), r["brand"], int(r["confidence"]), r["brand_evidence"]) for r in found.orderBy("seq").collect()]


def signals(spark, *args, **limits):
    scans, told, wanted, bounds = run(spark, *args, **limits)
    return shown(hunting.raw_signals(scans, told, wanted, REGISTRY, now(), "Reports", "https://reports.test", bounds))


def test_phases_domain_title_pivot_in_order(spark):
    replies = [
        reply("domain", 0, 1, "https://secure-swedbank-login.example/a"),
        reply("domain", 1, 2, "https://no-brand.example/"),
        reply("title", 0, 1, "https://secure-swedbank-login.example/a", "Swedbank"),
        reply("title", 1, 3, "https://anything.example/", "Swedbank login"),
        reply("pivot", 0, 4, "https://shared-kit.example/x", query=KIT),
        reply("pivot", 1, 1, "https://secure-swedbank-login.example/a", query=KIT),
        reply("pivot", 2, 5, "https://resource-only.example/", query=KIT),
    ]
    details = [
        detail(1, "https://secure-swedbank-login.example/a", "Swedbank", brands=["Swedbank"], categories=["Phishing "], score=50, country=None, ip="192.0.2.1"),
        detail(3, "https://anything.example/", "Swedbank login", digest=OTHER, categories=["phishing"]),
        detail(4, "https://shared-kit.example/x", "Swedbank"),
        detail(5, "https://resource-only.example/", "Swedbank", digest=OTHER),
    ]
    scans, told, wanted, bounds = run(spark, replies, details)
    found = cut(hunting.raw_signals(scans, told, wanted, REGISTRY, now(), "Reports", "https://reports.test", bounds))
    assert shown(found) == [(1, 1, "Swedbank", 100, ["domain", "title", "verdict"]), (2, 3, "Swedbank", 95, ["title"]), (3, 4, "Swedbank", 94, ["title", "primary-html-sha256"])]
    merged = {r["domain"]: r for r in hunting.published(found, now(), bounds).collect()}
    first = merged["secure-swedbank-login[.]example"]
    # The detail's key decides, also where it holds nothing: no country, but the reply's network.
    assert (first["country"], first["host"], first["hashes"]) == (None, "AS1 · 192[.]0[.]2[.]1", [KIT])
    assert first["url"] == "hxxps://secure-swedbank-login[.]example/a" and first["sources"] == ["Reports"] and first["status"] == "suspected"
    assert str(first["firstSeen"]).endswith("01:02:03.004000") and first["referenceUrl"].endswith(f"/result/{uuid(1)}/")
    assert merged["shared-kit[.]example"]["brandEvidence"] == ["title", "primary-html-sha256"]


def test_only_public_replies_and_details_count(spark):
    host = "https://secure-swedbank-{}.example/".format
    replies = [reply("domain", i, i, host(i), visibility=v) for i, v in enumerate(["public", "unlisted", None, "public", "public"])]
    details = [detail(0, host(0), visibility="private"), detail(1, host(1)), detail(2, host(2)), detail(3, host(3), visibility=None), detail(4, host(4))]
    # What has no public detail takes nothing from the budget.
    assert [s[1] for s in signals(spark, replies, details, domain_details=1)] == [4]


def test_seeds_budgets_and_what_was_fetched(spark):
    seeds = [("kit-a.example", "SEB", 90), ("kit-b.example", "SEB", 80), ("kit-c.example", "Swedbank", 85), ("swedbank.lt", "Swedbank", 99)]
    # Batches of two: swedbank.lt and kit-a, then kit-c and kit-b.
    replies = [
        reply("seed", 0, 1, "https://swedbank.lt/", query="0"),
        reply("seed", 1, 2, "https://kit-a.example/", query="0", task="https://swedbank.lt/x"),
        reply("seed", 2, 3, "https://kit-a.example/", query="0"),
        reply("seed", 3, 3, "https://kit-a.example/", query="0"),
        reply("seed", 0, 4, "https://kit-b.example/", query="1", task="https://kit-c.example/"),
        reply("seed", 1, 5, "https://kit-c.example/", query="1"),
        reply("seed", 2, 6, "https://kit-a.example/", query="1"),
        reply("seed", 3, 7, "https://kit-b.example/", query="1"),
        reply("domain", 0, 3, "https://seb-login.example/"),
        reply("domain", 1, 8, "https://seb-login.example/"),
    ]
    details = [detail(i, u, t) for i, u, t in [(1, "https://swedbank.lt/", "x"), (2, "https://kit-a.example/", "SEB"), (3, "https://kit-a.example/", "Swedbank"), (4, "https://kit-b.example/", "x"), (5, "https://kit-c.example/", "Swedbank"), (6, "https://kit-a.example/", "x"), (7, "https://kit-b.example/", "x"), (8, "https://swedbank.lt/login", "SEB")]]
    # 1: the brand's own host; 2 and 4: two brands; 3: fetched, but its title names another brand, and not fetched
    # again for its domain; 6: not of its batch; 7: no evidence; 8: ends on a suppressed host.
    got = signals(spark, replies, details, seeds, seed_batch=2)
    assert got == [(0, 5, "Swedbank", 85, ["title"])]
    assert signals(spark, replies, details, seeds, seed_batch=2, seed_details=1) == []


def test_pivots_need_the_digest_the_brand_and_strong_evidence(spark):
    weak = "ef" * 32
    replies = [
        reply("domain", 0, 1, "https://secure-swedbank-login.example/"),
        reply("domain", 1, 2, "https://seb-login.example/"),
        reply("pivot", 0, 3, "https://kit-a.example/", query=KIT),
        reply("pivot", 1, 4, "https://kit-b.example/", query=KIT),
        reply("pivot", 0, 5, "https://kit-c.example/", query=weak),
    ]
    details = [
        detail(1, "https://secure-swedbank-login.example/", "Swedbank"),
        detail(2, "https://seb-login.example/", "x", digest=weak),
        detail(3, "https://kit-a.example/", "Swedbank", digest=OTHER),
        detail(4, "https://kit-b.example/", "Revolut secure", brands=["Revolut"]),
        detail(5, "https://kit-c.example/", "SEB", digest=weak),
    ]
    # 3: another main document; 4: another brand; 5: the host's evidence alone does not make its digest one to look for.
    assert [s[:2] for s in signals(spark, replies, details)] == [(1, 1), (1, 2)]


def test_nothing_landed(spark):
    assert signals(spark, [], []) == []


def test_document_digest_needs_a_successful_reply_and_size(spark):
    def digests(**change):
        _, body = detail(1, "https://a.example/")
        body = json.loads(body)
        body["data"]["requests"][2]["response"]["response"] |= change
        rows = spark.createDataFrame([(uuid(1), json.dumps(body))], "uuid string, j string").select("uuid", F.parse_json("j").alias("v"))
        return feeds.details(rows, "svc").first()["digests"]

    assert digests() == [KIT] and digests(status=404) == digests(dataLength=511) == digests(mimeType="text/css") == digests(url="https://b.example/") == []
