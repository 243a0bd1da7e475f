from __future__ import annotations

import json
import random
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from vigilframe.functions import signals as S
from vigilframe.operators import health, history, hunt, matching, merge, review, seeds, views
from vigilframe.plans import sync
from vigilframe.sources import archives, feeds, snapshots
from vigilframe.streaming import certificates

def now():
    return F.lit("2026-08-21T10:00:00Z").cast("timestamp")

REGISTRY = matching.Registry(
    (
        matching.Brand("SEB", ("SEB",), ("seb.lt", "seb.com")),
        matching.Brand("Swedbank", ("Swedbank",), ("swedbank.lt", "swedbank.com"), fuzzy_aliases=("Swedbank",)),
        matching.Brand("Tele2", ("Tele2",), ("tele2.lt",), fuzzy_aliases=("Tele2",)),
        matching.Brand("Revolut", ("Revolut",), ("revolut.com",)),
        matching.Brand("Paysera", ("Paysera",), ("paysera.com",)),
        matching.Brand("Omniva", ("Omniva",), ("omniva.lt",)),
        matching.Brand("Big Bank", ("Big Bank",), ("bigbank.lt",), excluded_terms=("bigbang",), excluded_domains=("bigbank.net",)),
        matching.Brand("Vinted", ("Vinted",), ("vinted.lt",)),
    ),
    suffixes=("co.uk",),
).check()

HOSTS = {
    "seb-login.example.com": ("SEB", 85),
    "swedbannk-auth.example.com": ("Swedbank", 83),
    "swedbnak-auth.example": ("Swedbank", 88),
    "teel2-support.example": ("Tele2", 88),
    "rev-olut-login.example": ("Revolut", 100),
    "secure-pay-sera.example": ("Paysera", 100),
    "s-w-e-d-b-a-n-k-auth.example": ("Swedbank", 100),
    "xn--wedbank-iog.example": ("Swedbank", 95),
    "*.secure-omniva.example": ("Omniva", 100),
    "paysera.login-secure.test": None,
    "loginrevolut.example": ("Revolut", 98),
    "swedbnak.example": None,
    "login.swedbnak.example": None,
    "tele3-support.example": None,
    "rev-olut.example": None,
    "revolution-login.example": None,
    "s-e-b-login.example": None,
    "revolut.xn--bcher-kva.example": None,
    "login.swedbank.lt": None,
    "big-bank-login.bigbank.net": None,
    "bigbang-big-bank-login.example": None,
    "minted-login.example": None,
    "secure-revolut-swedbank-login.example": None,
    "vinted-login.co.uk.mcas-df.ms": None,
    "vinted-login.co.uk": ("Vinted", 100),
    "not a host": None,
}


def test_hosts(spark):
    rows = spark.createDataFrame([(h,) for h in HOSTS], "host string")
    got = {r["domain"]: (r["brand"], r["confidence"]) for r in matching.unique_matches(rows, REGISTRY).collect()}
    want = {h.removeprefix("*."): m for h, m in HOSTS.items() if m}
    # An omniva host has one hyphen, a joined one none.
    want["secure-omniva.example"] = ("Omniva", 100)
    assert got == want


def test_prefilter_never_drops_a_match(spark):
    rows = spark.createDataFrame([(h.removeprefix("*."),) for h in HOSTS], "host string")
    kept = {r["host"] for r in rows.where(seeds.may_match(REGISTRY, F.col("host"))).collect()}
    assert {h.removeprefix("*.") for h, m in HOSTS.items() if m} <= kept and "minted-login.example" not in kept


@pytest.mark.parametrize(
    "change",
    [
        {"fuzzy_aliases": ("SEBB",)},
        {"official_domains": ("not a domain",)},
        {"excluded_domains": ("seb.lt",)},
        {"aliases": ("SEB", "seb")},
        {"sources": ("http://plain.test",)},
    ],
)
def test_contradicting_registries_are_rejected(change):
    entry = {"brand": "SEB", "aliases": ("SEB",), "official_domains": ("seb.lt",)} | change
    with pytest.raises(ValueError):
        matching.Registry((matching.Brand(**entry),)).check()


def test_titles(spark):
    rows = spark.createDataFrame([("Log in – Swedbank",), ("big bank online",), ("Swedbank, Revolut",), (None,), ("SEB login",)], "title string")
    got = {r["title"]: r["title_brand"] for r in matching.title_brand(rows, REGISTRY).collect()}
    assert got == {"Log in – Swedbank": "Swedbank", "big bank online": "Big Bank", "Swedbank, Revolut": None, None: None, "SEB login": None}


def test_scope(spark):
    rows = spark.createDataFrame([(1, "seb-login.example", None), (2, "seb-login.example", "Swedbank"), (3, "other.example", "revolut"), (4, "other.example", None), (5, "x.swedbank.lt", "Swedbank"), (6, "bigbang.example", "Big Bank"), (7, "secure-revolut-swedbank-login.example", "Revolut")], "i int, host string, brand string")
    got = {r["i"]: r["brand"] for r in matching.scope(rows, matching.score(rows, REGISTRY), REGISTRY).collect()}
    assert got == {1: "SEB", 3: "Revolut"}


def sequential(rows):
    """A plain model of the merge, one row after the other."""
    out, gone = {}, set()
    for r in rows:
        i = r["id"]
        if i in gone:
            continue
        if i not in out:
            out[i] = dict(r)
            continue
        c = out[i]
        if c["brand"] and r["brand"] and c["brand"] != r["brand"]:
            del out[i]
            gone.add(i)
            continue
        newer, same = r["lastSeen"] > c["lastSeen"], r["lastSeen"] == c["lastSeen"]
        if newer or (same and S.PRIORITY[r["status"]] > S.PRIORITY[c["status"]]):
            c["status"] = r["status"]
        for f in merge.FILLED:
            c[f] = (r[f] or c[f]) if newer else (c[f] or r[f])
        c["brand"] = c["brand"] or r["brand"]
        c["lastSeen"], c["firstSeen"] = max(c["lastSeen"], r["lastSeen"]), min(c["firstSeen"], r["firstSeen"])
        c["confidence"] = max(c["confidence"], r["confidence"])
        c["hashes"] = list(dict.fromkeys(c["hashes"] + r["hashes"]))[:8]
        c["sources"] = sorted({*c["sources"], *r["sources"]})
    return out


def test_merge_equals_a_sequential_model(spark):
    rng = random.Random(3)
    start = datetime(2026, 8, 1, tzinfo=UTC)
    some = lambda values: rng.choice([None, *values])
    rows = []
    for seq in range(600):
        time = start + timedelta(hours=rng.randint(0, 5))
        rows.append({"seq": seq, "id": f"i{rng.randint(0, 60)}", "url": "hxxps://a[.]test", "domain": "a[.]test", "firstSeen": time - timedelta(hours=rng.randint(0, 3)), "lastSeen": time, "sources": [rng.choice("ABC")], "status": rng.choice(list(S.PRIORITY)),
                     "brand": some(["X"] * 30 + ["Y"]), "country": some("PQ"), "host": some("RS"), "screenshotUrl": some("TU"), "referenceUrl": some("VW"), "hashes": [rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 3))], "brandEvidence": [], "reasonCodes": [], "confidence": rng.randint(0, 100)})
    schema = "seq long, id string, url string, domain string, firstSeen timestamp, lastSeen timestamp, sources array<string>, status string, brand string, country string, host string, screenshotUrl string, referenceUrl string, hashes array<string>, brandEvidence array<string>, reasonCodes array<string>, confidence int"
    table = spark.createDataFrame([tuple(r.values()) for r in rows], schema).repartition(7)
    got = {r["id"]: r.asDict() for r in merge.merge(table).collect()}
    want = sequential(rows)
    assert got.keys() == want.keys()
    for i, w in want.items():
        for f in ("status", "brand", "confidence", "hashes", "sources", *merge.FILLED):
            assert got[i][f] == w[f], (i, f)
        assert got[i]["lastSeen"].timestamp() == w["lastSeen"].timestamp() or got[i]["lastSeen"].replace(tzinfo=UTC) == w["lastSeen"]


def test_merge_splits_the_rows_of_one_id(spark):
    n, at = 600, lambda i: F.timestamp_seconds(F.lit(1_780_000_000) + i)
    i = F.col("seq")
    rows = spark.range(n).withColumnRenamed("id", "seq").select(
        "seq", F.lit("x").alias("id"), F.lit("hxxps://a[.]b").alias("url"), F.lit("a[.]b").alias("domain"), at(i * 0).alias("firstSeen"), at(i * 37 % 101).alias("lastSeen"), F.array((i % 3).cast("string")).alias("sources"), F.lit("active").alias("status"), F.lit("B").alias("brand"),
        *[F.when(i % k == k - 1, i.cast("string")).alias(c) for c, k in zip(merge.FILLED, (2, 3, 700, 599), strict=True)],
        *[F.array((n - i).cast("string"), F.lit("z")).alias(c) for c in ("hashes", "brandEvidence", "reasonCodes")], F.lit(80).alias("confidence"),
    )
    merged = merge.merge(rows)
    got = merged.first()
    newest, want = None, dict.fromkeys(merge.FILLED)
    for s in range(n):
        t, new = s * 37 % 101, newest is None or s * 37 % 101 > newest
        for c, k in zip(merge.FILLED, (2, 3, 700, 599), strict=True):
            want[c] = str(s) if s % k == k - 1 and (new or want[c] is None) else want[c]
        newest = t if new else newest
    assert {c: got[c] for c in merge.FILLED} == want and got["sources"] == ["0", "1", "2"]
    assert [got[c] for c in ("hashes", "brandEvidence", "reasonCodes")] == [["600", "z", *map(str, range(599, 0, -1))][:k] for k in (8, 64, 16)]
    plan = merged._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten(" not in plan and "WindowGroupLimit" in plan and "_range#" in plan


RAW = "seq long, url string, source string, first_seen string, last_seen string, status string, brand string, country string, host string, hashes array<string>, confidence double, reason_codes array<string>"


def raw(spark, *rows):
    full = [{"url": "https://seb-login.example/x?y", "source": "Feed", "status": "potential", "confidence": 77.6, "reason_codes": ["brand-exact-token"]} | r for r in rows]
    return spark.createDataFrame([(i, *(r.get(c) for c in [f.split()[0] for f in RAW.split(", ")[1:]])) for i, r in enumerate(full)], RAW)


def test_prepare(spark):
    rows = raw(spark, {"last_seen": "9999-01-01T00:00:00Z", "host": "AS64500 · 192.0.2.10"}, {"url": "javascript:x"}, {"source": " "}, {"first_seen": "2026-08-20", "last_seen": "2026-08-19T01:02:03.4567+02:00"})
    first, last = sorted(merge.prepare(rows, now()).collect())
    assert (first["url"], first["status"], first["confidence"], first["host"]) == ("hxxps://seb-login[.]example/x", "suspected", 78, "AS64500 · 192[.]0[.]2[.]10")
    assert first["lastSeen"] == first["firstSeen"] == datetime(2026, 8, 21, 10) and last["firstSeen"] == last["lastSeen"] == datetime(2026, 8, 18, 23, 2, 3, 456_000)


def test_synchronise_publishes_and_replays_nothing(spark):
    rules = spark.createDataFrame([("bad.example", "subdomains", None)], "domain string, scope string, brand string")
    rows = raw(spark, {"last_seen": "2026-08-21T09:00:00Z"}, {"url": "https://x.bad.example/", "brand": "SEB"}, {"url": "https://swedbank.lt/", "brand": "Swedbank"}, {"url": "https://seb-login.example/longer", "last_seen": "2026-08-20T09:00:00Z"})
    got = sync.synchronise(rows, REGISTRY, rules, now())
    (signal,) = got.snapshot.collect()
    assert (signal["brand"], signal["url"], signal["lastSeen"]) == ("SEB", "hxxps://seb-login[.]example/longer", datetime(2026, 8, 21, 9))
    events = got.events.collect()
    assert sorted(e["eventType"] for e in events) == ["observation", "observation", "status-transition"] and {e["brand"] for e in events} == {"SEB"}
    assert history.new_events(got.events, got.events).count() == 0
    again = sync.synchronise(rows, REGISTRY, rules, now(), previous=spark.createDataFrame([(signal["id"], signal["status"])], "id string, latestStatus string"))
    assert again.events.where("eventType = 'status-transition'").count() == 0
    old = got.snapshot.withColumn("sources", F.array(F.lit("Gone"), F.lit("Feed")))
    kept = sync.retained(old, now(), 7, ["Gone", "Feed"], ["Gone", "Feed"], ["Feed"]).collect()
    assert [(r["sources"], r["hashes"]) for r in kept] == [(["Gone"], [])]


def test_size_guard_and_settings():
    with pytest.raises(ValueError):
        sync.check_size(2, 100, sync.Settings())
    sync.check_size(2, 100, sync.Settings(), allow_small=True)
    sync.check_size(25, 100, sync.Settings())
    assert sync.Settings.of({"max_signals": "99999", "retain_days": "x", "detail_days": " 1 "}) == sync.Settings(max_signals=25_000, detail_days=7)


LOG = "eventId string, signalId string, eventType string, observedAt timestamp, domain string, brand string, sources array<string>, status string, previousStatus string, confidence int, reasonCodes array<string>, day date"


def log(spark, n, kind="observation", signal="s", brand="B"):
    start = datetime(2026, 7, 1)
    return spark.createDataFrame([(f"e{i:03}", signal, kind, start + timedelta(minutes=i), "a[.]test", brand, ["F"], "active" if i % 2 else "offline", None, 80, ["manual-review"], start.date()) for i in range(n)], LOG)


def test_a_replay_does_not_inflate_counts(spark):
    events = log(spark, 65)
    folded = history.fold(events)
    row = folded.first()
    assert row["observationCount"] == 65 and len(row["recentEventIds"]) == 64 and row["latestStatus"] == "offline"
    again = history.fold(events.where("eventId = 'e064'"), folded).first()
    assert again["observationCount"] == 65 and again["recentEventIds"] == row["recentEventIds"]
    assert history.fold(log(spark, 3).unionByName(log(spark, 5, brand="C").where("eventId > 'e002'"))).count() == 0
    moves = history.fold(log(spark, 20, "status-transition")).first()
    assert [t["eventId"] for t in moves["statusTransitions"]] == [f"e{i:03}" for i in range(4, 20)]


def test_fold_reduces_before_it_collects(spark):
    kinds = F.when(F.col("id") % 3 == 0, "status-transition").otherwise("observation")
    at = F.timestamp_seconds(F.lit(1_780_000_000) + F.col("id") % 700)
    codes = F.transform(F.array(F.lit(0), F.lit(7)), lambda x: F.concat(F.lit("c"), ((F.col("id") + x) % 40).cast("string")))
    events = spark.range(2000).select(
        F.format_string("e%05d", "id").alias("eventId"), F.lit("s").alias("signalId"), kinds.alias("eventType"), at.alias("observedAt"), F.lit("d").alias("domain"), F.lit("B").alias("brand"), F.array((F.col("id") % 5).cast("string")).alias("sources"),
        F.lit("active").alias("status"), F.lit(None).cast("string").alias("previousStatus"), F.lit(80).alias("confidence"), codes.alias("reasonCodes"),
    )
    folded = history.fold(events)
    row = folded.first()
    ordered = sorted((i % 700, i) for i in range(2000))
    assert row["recentEventIds"] == [f"e{i:05}" for _, i in ordered[-64:]] and row["sources"] == list("01234")
    assert [t["eventId"] for t in row["statusTransitions"]] == [f"e{i:05}" for _, i in ordered if i % 3 == 0][-16:]
    assert row["reasonCodes"] == list(dict.fromkeys(f"c{(i + x) % 40}" for _, i in ordered for x in (0, 7)))[:16]
    # No list of a whole signal: every collected row has been through a rank or a distinct.
    plan = folded._jdf.queryExecution().optimizedPlan().toString()
    assert "flatten(" not in plan and "WindowGroupLimit" in plan


def test_compaction_under_a_watermark(spark):
    events = log(spark, 3)
    folded, mark = history.compact(events, None, None, "2026-08-21", now())
    assert folded.first()["observationCount"] == 3 and str(mark.first()[0]) == "2026-07-01"
    late, mark = history.compact(events, folded, "2026-07-01", "2026-08-21", now())
    assert late.first()["observationCount"] == 3 and str(mark.first()[0]) == "2026-07-01"
    expired, _ = history.compact(events, None, None, "2030-08-21", F.lit("2030-08-21T10:00:00Z").cast("timestamp"))
    assert expired.count() == 0 and history.retained(events, "2026-07-10").count() == 3


def test_hosts_are_normalised_once_they_are_distinct(spark):
    """Python sees each host once: before, the check for null ones took it below the distinct, to every row."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(host):
        seen.add(1)
        return host

    rows = spark.range(400, numPartitions=1).select(F.format_string("seb-login%d.example", F.col("id") % 2).alias("host"), F.lit(None).cast("string").alias("brand"))
    plain = matching.normalize_domain
    try:
        matching.normalize_domain = lambda c: counted(plain(c))
        matches = matching.score(rows, REGISTRY)
        assert 0 < seen.value <= 4
        seen.value = 0
        assert matching.scope(rows, matches, REGISTRY).count() == matching.scope(rows, matches, REGISTRY, pairs=rows.distinct()).count()
        # Judged per pair, in two scopes.
        assert seen.value <= 16
    finally:
        matching.normalize_domain = plain


def test_scope_keeps_rows_and_brands(spark):
    rows = spark.createDataFrame([(1, "seb-login.example", None), (2, "seb-login.example", "SEB"), (3, "seb-login.example", None), (4, None, "SEB"), (5, "SEB-login.example", "seb"), (6, "plain.example", None), (7, "plain.example", "Swedbank")], "n int, host string, brand string")
    got = {r["n"]: (r["host"], r["brand"]) for r in matching.scope(rows, matching.score(rows, REGISTRY), REGISTRY).collect()}
    assert got == {1: ("seb-login.example", "SEB"), 2: ("seb-login.example", "SEB"), 3: ("seb-login.example", "SEB"), 5: ("SEB-login.example", "SEB"), 7: ("plain.example", "Swedbank")}


def test_compaction_keeps_every_signal(spark):
    """A summary has no bound of its own; the newest signals only stay where one is asked for."""
    n = 25_200
    events = spark.range(n).select(
        F.format_string("e%05d", "id").alias("eventId"), F.format_string("s%05d", "id").alias("signalId"), F.lit("observation").alias("eventType"), F.timestamp_seconds(F.lit(1_780_000_000) + F.col("id")).alias("observedAt"), F.lit("d").alias("domain"), F.lit("B").alias("brand"), F.array(F.lit("F")).alias("sources"),
        F.lit("active").alias("status"), F.lit(None).cast("string").alias("previousStatus"), F.lit(80).alias("confidence"), F.array(F.lit("punycode")).alias("reasonCodes"), F.lit("2026-07-01").cast("date").alias("day"),
    )
    folded, _ = history.compact(events, None, None, "2026-08-21", now())
    assert folded.count() == n
    newest, _ = history.compact(events, None, None, "2026-08-21", now(), most=2)
    assert sorted(r["id"] for r in newest.collect()) == ["s25198", "s25199"]


def test_public_rows(spark):
    fold = spark.createDataFrame([("1", "seb-login[.]example", "SEB", ["punycode"]), ("2", "other[.]example", "SEB", ["punycode"]), ("3", "other[.]test", "SEB", ["provider-verdict"])], "id string, domain string, brand string, reasonCodes array<string>")
    fold = fold.withColumns({c: F.lit(None) for c in ("firstSeen", "lastSeen", "observationCount", "sources", "latestStatus", "statusTransitions")})
    hosts = fold.withColumn("host", F.replace("domain", F.lit("[.]"), F.lit(".")))
    matches = matching.score(hosts, REGISTRY)
    got = history.public(fold, matches, matching.scope(hosts, matches, REGISTRY))
    assert sorted(r["id"] for r in got.collect()) == ["1", "3"]


def candidate(**change):
    row = {"schemaVersion": 1, "id": None, "observedAt": "2026-08-21T20:00:00.000Z", "indicatorType": "domain", "domain": "seb-login[.]example[.]com", "registrableDomain": "example[.]com", "source": "Log", "brand": "SEB", "confidence": 85, "reasons": ["x"]}
    import hashlib

    row["id"] = hashlib.sha256(b"seb-login.example.com").hexdigest()[:20]
    return json.dumps(row | change)


def test_candidate_rows_are_closed(spark, tmp_path):
    bad = [{"domain": "seb-login.example.com"}, {"registrableDomain": "other[.]com"}, {"id": "0" * 20}, {"observedAt": "2026-08-21T20:00:00Z"}, {"confidence": 101}, {"confidence": True}, {"confidence": 85.0}, {"brand": " "}, {"brand": "b" * 121}, {"reasons": []}, {"reasons": ["r" * 241]}, {"reasons": [1]}, {"more": 1}, {"observedAt": "2026-08-21T21:00:00.000Z"}]
    day = tmp_path / "2026-08-21"
    day.mkdir()
    (day / "domains.ndjson").write_text("\n".join([candidate(), *(candidate(**b) for b in bad), "", "no json", "[1]", '{"a":' + '"x"' * 3, candidate()[:-1] + " " * 20_000 + "}"]))
    rows = archives.candidates(archives.read_lines(spark, str(tmp_path), "domains.ndjson"))
    assert [r["domain"] for r in rows.collect()] == ["seb-login.example.com"]


def test_event_log_fails_closed(spark, tmp_path):
    events = log(spark, 2).withColumn("sources", F.array(F.lit("F"))).withColumn("signalId", S.short_id(F.col("domain")))
    good = events.withColumn("eventId", S.event_id(signal=F.col("signalId"), kind=F.col("eventType"), at=S.shown_time(F.col("observedAt")), sources=F.col("sources"), status=F.col("status"), previous=F.col("previousStatus")))
    lines = [json.loads(r[0]) for r in good.withColumn("observedAt", S.shown_time(F.col("observedAt"))).drop("day").withColumn("schemaVersion", F.lit(1)).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    day = tmp_path / "2026-07-01"
    day.mkdir()
    read = lambda some: ((day / "events.ndjson").write_text("\n".join(map(json.dumps, some)) + "\n"), archives.events(archives.read_lines(spark, str(tmp_path), "events.ndjson")))[1]
    assert read(lines).count() == 2
    for wrong in ([*lines, lines[0]], [lines[0] | {"status": "mitigated"}], [lines[0] | {"x": 1}]):
        with pytest.raises(ValueError):
            read(wrong)


def test_append_and_write_once(spark, tmp_path):
    rows = spark.createDataFrame([("2026-08-21", "a", 2), ("2026-08-21", "a", 1), ("2026-08-22", "a", 3)], "day string, id string, n int")
    first = archives.append_new(rows, rows.limit(0), F.col("n"))
    assert sorted(tuple(r) for r in first.collect()) == [("2026-08-21", "a", 1), ("2026-08-22", "a", 3)]
    archives.write_days(first, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t")).withColumn("day", F.col("day").cast("string"))
    assert archives.append_new(rows, stored, F.col("n")).count() == 0
    with pytest.raises(ValueError):
        archives.at_most(rows, 2)


def test_feeds(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# comment\r\nhttps://seb-login.example/x\r\n! other\n\nnothing.example\nhxxp://seb-login[.]example\n")
    rows, counts = feeds.read_each(spark, {"a": str(tmp_path / "a.txt"), "b": str(tmp_path / "missing.txt")})
    assert counts == {"configured": 2, "completed": 1, "failed": 1} and rows.count() == 3
    assert [tuple(r) for r in feeds.seeds(rows, REGISTRY).collect()] == [("seb-login.example", "SEB", 90)]
    (tmp_path / "p.json").write_text(json.dumps({"signals": [{"indicator": "a.test", "brandTargeted": "SEB", "confidenceScore": 70, "confidence": True, "first_seen": "2026-08-01"}, {"x": 1}, {"url": "b.test", "hashes": ["ab"], "confidence": 5.5}]}))
    partner = feeds.partner_rows(spark, str(tmp_path / "p.json"), F.lit("now")).orderBy("seq").collect()
    assert [(r["url"], r["brand"], r["confidence"], r["last_seen"], r["hashes"]) for r in partner] == [("a.test", "SEB", 70.0, "now", None), ("b.test", None, 5.5, "now", None)]


def test_ledger_and_suppressions(spark):
    rows = spark.createDataFrame([(1, "false-positive", "a.test", "SEB", "exact", "r", None, None), (2, "restore", "a.test", None, None, "r", None, None), (3, "false-positive", "b.test", None, "subdomains", "r", None, None), (4, "add", "c.test", "SEB", None, "r", "https://c.test", 80)], "sequence long, action string, domain string, brand string, scope string, reason_code string, url string, confidence int")
    state = review.state(rows)
    assert {(r["domain"], r["action"]) for r in state.collect()} == {("b.test", "false-positive"), ("c.test", "add")}
    negative, added = review.public_export(state)
    assert [r["domain"] for r in negative.collect()] == ["b.test"] and "note" not in negative.columns and added.first()["url"] == "https://c.test"
    assert review.additions(added, F.lit(0)).first()["reason_codes"] == ["manual-review"]
    signals = spark.createDataFrame([("x[.]b[.]test", "SEB"), ("a[.]test", "SEB"), ("bad host", "SEB")], "domain string, brand string")
    assert [r["domain"] for r in review.drop_suppressed(signals, negative).collect()] == ["a[.]test"]


def test_hunt(spark):
    uuid = lambda i: f"00000000-0000-0000-0000-{i:012}"
    found = [(json.dumps({"_id": uuid(i), "task": {"visibility": v, "url": f"https://{h}/"}, "page": {"url": f"https://{h}/in", "title": t}}), i) for i, (v, h, t) in enumerate([("public", "seb-login.example", "x"), ("private", "seb-login.example", "x"), ("public", "other.example", "Swedbank"), ("public", "other.example", "SEB and Revolut")])]
    replies = spark.createDataFrame(found, "j string, pos int").select(F.parse_json("j").alias("v"), "pos")
    scans = feeds.scans(replies)
    assert scans.count() == 3
    digest = "ab" * 32
    request = {"type": "Document", "response": {"hash": digest, "status": 200, "size": 900, "response": {"url": "https://other.example/in", "status": 200, "mimeType": "text/html"}}}
    detail = lambda i: json.dumps({"task": {"visibility": "public"}, "page": {"url": "https://other.example/in", "ip": "192.0.2.1", "asn": "AS1", "asnname": "N"}, "verdicts": {"svc": {"malicious": True, "score": 50, "categories": ["Phishing"], "brands": [{"name": "Swedbank"}]}}, "data": {"requests": [request, request | {"response": request["response"] | {"size": 10}}]}})
    details = feeds.details(spark.createDataFrame([(uuid(i), detail(i)) for i in (0, 2, 3)], "uuid string, j string").select("uuid", F.parse_json("j").alias("v")), "svc")
    row = details.where(F.col("uuid") == uuid(2)).first()
    assert (row["digests"], row["phishing"], row["score"], row["d_ip"]["text"], row["verdict_brands"]) == ([digest], True, 50, "192.0.2.1", ["Swedbank"])
    got = hunt.phase(scans.withColumn("wanted", F.lit("Swedbank")), details, None, 10)
    titles = matching.title_brand(got.select("title").distinct(), REGISTRY).withColumnRenamed("title", "_title")
    verdicts = got.select("uuid", F.get("verdict_brands", F.lit(0)).alias("verdict_brand"))
    judged = hunt.evidence(got.drop("verdict_brands"), matching.score(spark.createDataFrame([("seb-login.example",)], "host string"), REGISTRY), titles, verdicts)
    kept = hunt.gate(judged, "title").collect()
    assert [r["uuid"] for r in kept] == [uuid(2)]
    assert hunt.gate(judged, "title").select(hunt.evidence_labels(True).alias("l"), hunt.boosted(F.lit(92)).alias("c")).first().asDict() == {"l": ["title", "verdict", "primary-html-sha256"], "c": 97}
    assert hunt.phase(scans, details, got, 10).count() == 0


def test_views(spark):
    rows = spark.createDataFrame([("1", "u", "Example Bank", "LT", "active", 90, ["A"]), ("2", "u", "Example Bank", "", "offline", 10, ["B"]), ("3", "v", "Example Mail", "PL", "suspected", 70, ["a-x"])], "id string, domain string, brand string, country string, status string, confidence int, sources array<string>")
    assert [r["id"] for r in views.search(rows, " A-X", columns=("domain", "brand"), facets={"status": "all"}).collect()] == ["3"]
    assert tuple(views.metrics(rows).first()) == (3, 1, 1, 2, 2)
    assert [tuple(r) for r in views.top_groups(rows, "country").collect()] == [("LT", 1), ("PL", 1), ("Unknown", 1)]
    assert sorted(r[0] for r in views.facets(rows, "country").collect()) == ["LT", "PL"]
    assert [r["share"] for r in views.bars(views.top_groups(rows, "brand")).orderBy("count").collect()] == [0.5, 1.0]
    assert views.pages(0) == 1 and views.pages(26) == 2
    assert views.search_joined(rows, "example mail").count() == 1


def test_health(spark):
    time = lambda t: F.lit(t).cast("timestamp")
    minutes = F.array(F.lit(2), F.lit(32))
    row = spark.range(1).select(health.scheduled_slot(time("2026-08-22T22:52:32Z"), minutes).alias("a"), health.scheduled_slot(time("2026-08-22T22:01:00Z"), minutes).alias("b"), health.delay_seconds(time("2026-08-22T22:52:32.9Z"), time("2026-08-22T22:32:00Z")).alias("c"), health.freshness(time("2026-08-22T20:00:00Z"), time("2026-08-22T22:00:00Z")).alias("d"), health.outcome(F.lit(5), F.lit(0), F.lit(100.0), F.lit(240), F.lit(False)).alias("e")).first()
    assert (row["a"], row["b"], row["c"]) == (datetime(2026, 8, 22, 22, 32), datetime(2026, 8, 22, 21, 32), 1232)
    assert (row["d"]["status"], row["d"]["ageSeconds"], row["e"]) == ("stale", 7200, "partial")


def test_stream_collects_each_host_once(spark, tmp_path):
    message = lambda *names: json.dumps({"message_type": "certificate_update", "data": {"leaf_cert": {"all_domains": list(names)}}})
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.txt").write_text("\n".join([message("*.seb-login.example", "example.com", 5), message("seb-login.example"), json.dumps({"message_type": "dns_entries", "data": ["swedbank-auth.example"]}), json.dumps({"message_type": "heartbeat"}), "no json", message(*["x.example"] * 500, "revolut-login.example")]))
    root = str(tmp_path / "out")
    run = lambda: certificates.collect(certificates.read_messages(spark, str(tmp_path / "in")), REGISTRY, root, str(tmp_path / "check")).awaitTermination()
    run()
    assert sorted(r["domain"] for r in spark.read.parquet(root).collect()) == ["seb-login.example", "swedbank-auth.example"]
    (tmp_path / "in" / "2.txt").write_text(message("seb-login.example", "revolut-login.example"))
    run()
    assert spark.read.parquet(root).count() == 3


def test_drained_rows_stay_off_the_driver(spark, tmp_path):
    schema = "ts timestamp, event_type string, value double"
    for day in range(1, 4):
        spark.createDataFrame([(datetime(2026, 1, day), "view", 1.0)] * 2, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    once = certificates.drain(certificates.deduplicated(stream(), ["event_type", "ts"], late="40 days"), "drained_rows")
    assert sorted(r["ts"].day for r in once.collect()) == [1, 2, 3]
    counts = certificates.drain(certificates.daily_counts(stream()), "drained_counts", "complete")
    assert sorted((str(r["day"]), r["n"], r["total"]) for r in counts.collect()) == [(f"2026-01-0{d}", 2, 2.0) for d in (1, 2, 3)]
    for made in (once, counts):
        files = made.inputFiles()
        assert files and all(f.endswith(".parquet") and "/stream-" in f for f in files)


def test_published_documents(spark, tmp_path):
    signals = merge.merge(merge.prepare(raw(spark, {"last_seen": "2026-08-21T09:00:00Z", "brand": "SEB"}, {"url": "https://b.example/", "last_seen": "2026-08-20T09:00:00Z"}), now()))
    document = snapshots.as_document(signals, "2026-08-21T10:00:00.000Z").first()[0]
    assert [s["domain"] for s in json.loads(document)["signals"]] == ["seb-login[.]example", "b[.]example"]
    data = json.loads(document)
    good = data["signals"][0]
    data["signals"] += [good | {"id": "0" * 20}, good | {"url": good["url"] + "?x"}, good | {"sources": ["Other"]}, good | {"confidence": 101}, good | {"lastSeen": "2026"}]
    (tmp_path / "radar.json").write_text(json.dumps(data))
    back = snapshots.read_snapshot(spark, str(tmp_path / "radar.json"), ["Feed"])
    assert back.count() == 2 and snapshots.recent_count(back, F.lit("2026-08-21T00:00:00Z").cast("timestamp")).first()[0] == 1


def test_summary_documents_fail_closed(spark, tmp_path):
    made = sync.synchronise(raw(spark, {"last_seen": "2026-08-21T09:00:00Z"}), REGISTRY, spark.createDataFrame([], "domain string, scope string, brand string"), now())
    folded = history.fold(made.events)
    rows = json.loads(snapshots.as_document(folded.withColumn("statusTransitions", F.transform("statusTransitions", lambda t: t.withField("observedAt", S.shown_time(t["observedAt"])))), "x").first()[0])["signals"]
    read = lambda some: ((tmp_path / "summary.json").write_text(json.dumps({"signals": some})), snapshots.read_history(spark, str(tmp_path / "summary.json")))[1]
    assert snapshots.previous_statuses(read(rows)).first()["latestStatus"] == "suspected"
    for wrong in ([*rows, *rows], [rows[0] | {"observationCount": -1}], [rows[0] | {"recentEventIds": ["a", "a"]}], [rows[0] | {"id": "x"}]):
        with pytest.raises(ValueError):
            read(wrong)


def test_decisions_need_evidence(spark):
    matches = matching.score(spark.createDataFrame([("seb-login.example",), ("revolut-login.example",)], "host string"), REGISTRY)
    rows = spark.createDataFrame([("seb-login.example", "exact", "SEB"), ("seb-login.example", "exact", "Revolut"), ("x.swedbank.lt", "subdomains", "Swedbank"), ("other.example", "exact", None), ("Bad Host", "exact", None)], "domain string, scope string, brand string")
    assert sorted((r[0], r[2]) for r in review.valid_suppressions(rows, matches, REGISTRY).collect()) == [("other.example", None), ("seb-login.example", "SEB"), ("x.swedbank.lt", "Swedbank")]
    added = spark.createDataFrame([("seb-login.example", "SEB", 90), ("seb-login.example", "SEB", 91), ("revolut-login.example", "SEB", 10)], "domain string, brand string, confidence int")
    assert [(r[0], r[2]) for r in review.valid_additions(added, matches, now()).collect()] == [("seb-login.example", 90)]


def test_remote_queries():
    assert hunt.title_query(['a "b"'], 7) == 'task.visibility:public AND date:>now-7d AND (page.title:"a \\"b\\"")'
    assert "task.visibility:public" in hunt.domain_query(["swedbank"], ["swedbank.lt"], 7) and "NOT (page.domain:swedbank.lt)" in hunt.domain_query(["swedbank"], ["swedbank.lt"], 7)
    assert hunt.host_query(["a.test"], 1).count("a.test") == 2
    assert seeds.search_terms(REGISTRY) == ["bigbank", "omniva", "paysera", "revolut", "swedbank", "tele2", "vinted"]
