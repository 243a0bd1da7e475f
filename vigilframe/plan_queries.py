"""Queries of whole plans over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions import signals as S
from vigilframe.functions import suffixes
from vigilframe.functions import urls as U
from vigilframe.operators import health, history, hunt, matching, review, views
from vigilframe.plans import archived, hunting, sync
from vigilframe.plans.shared import cut, shared_folder
from vigilframe.queries import _CUSTOMER_SQL, _HOST_SQL, _REGISTRY, _customer_hosts, _fold_sql, _log, _name, _read, _shown_fold, query
from vigilframe.sources import archives, decisions, feeds, ledger, publication, snapshots
from vigilframe.streaming import certificates, folding


def _time(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def _folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_folder(spark)}/{kind}-{uuid.uuid4().hex}"


#: Hosts of ``_customer_hosts`` that match a brand of ``_REGISTRY``, as SQL over ``_CUSTOMER_SQL``.
_MATCHES = "segment IN ('household', 'machinery', 'furniture', 'building') AND kind IN (0, 2, 3)"
_BRAND = "upper(segment[1]) || segment[2:]"
_CONFIDENCE = "CASE WHEN kind = 3 THEN 78 ELSE 80 END + 15 + CASE WHEN segment = 'building' THEN 0 ELSE 5 END"
_CODES = "[CASE WHEN kind = 3 THEN 'brand-joined-affix' ELSE 'brand-exact-token' END, 'suspicious-context'] || CASE WHEN segment = 'building' THEN [] ELSE ['different-tld'] END"


# Registrable domains

_RULES = ("example.com", "*.example.net", "org", "net")


@query(f"""WITH h AS (SELECT DISTINCT {_HOST_SQL} AS host FROM pages), n AS (SELECT host, string_split(host, '.') AS l, CASE WHEN suffix(host, '.example.com') OR host = 'example.com' THEN 2 WHEN suffix(host, '.example.net') THEN 3 WHEN suffix(host, '.net') OR suffix(host, '.org') THEN 1 END AS n FROM h)
SELECT host, array_to_string(l[-n:], '.') AS suffix, CASE WHEN n IS NULL THEN host ELSE array_to_string(l[greatest(1, len(l) - n):], '.') END AS registrable FROM n""")
def registrable_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = _read(spark, sf_dir, "pages").select(U.url_host(F.col("url")).alias("host")).where("host is not null").distinct()
    return suffixes.registrable(hosts, suffixes.rule_table(spark, _RULES))


# Synchronising

def _raw_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers' hosts as raw signals of three sources."""
    nothing = F.lit(None).cast("string")
    return _customer_hosts(spark, sf_dir).select(
        F.concat(F.lit("https://"), "host", F.lit("/"), F.col("c_custkey") % 3).alias("url"), F.concat(F.lit("Source "), F.col("c_custkey") % 3).alias("source"), nothing.alias("first_seen"), F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("c_custkey") % 1_000), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("last_seen"),
        F.lit("live").alias("status"), nothing.alias("brand"), nothing.alias("country"), nothing.alias("host"), F.array(F.sha2((F.col("c_custkey") % 11).cast("string"), 256), F.sha2((F.col("c_custkey") % 7).cast("string"), 256)).alias("hashes"), F.lit(80.0).alias("confidence"),
        F.array(F.when(F.col("c_custkey") % 2 == 0, "punycode").otherwise("manual-review")).alias("reason_codes"), F.col("c_custkey").alias("seq"),
    )


_NOW = "2024-01-02T00:00:00Z"


def _no_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], "domain string, scope string, brand string")


@query(f"""SELECT 'Source ' || (c_custkey % 3) AS source, count(*) FILTER ({_MATCHES}) AS accepted, count(*) - count(*) FILTER ({_MATCHES}) AS excluded,
  CASE WHEN count(*) - count(*) FILTER ({_MATCHES}) > 0 THEN (count(*) - count(*) FILTER ({_MATCHES})) || ' non-registry target' || CASE WHEN count(*) - count(*) FILTER ({_MATCHES}) = 1 THEN '' ELSE 's' END || ' excluded' END AS note FROM ({_CUSTOMER_SQL}) GROUP BY 1""")
def source_exclusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accepted and excluded rows per source, observed in the pass that filters."""
    made = sync.synchronise(_raw_customers(spark, sf_dir), _REGISTRY, _no_rules(spark), _time(_NOW), sources=["Source 0", "Source 1", "Source 2"])
    return made.counts


_FRESH_SQL = f"SELECT *, c_custkey AS seq, TIMESTAMP '2024-01-01 00:00:00' + INTERVAL 1 SECOND * (c_custkey % 1000) AS t, 'Source ' || (c_custkey % 3) AS source FROM ({_CUSTOMER_SQL}) WHERE {_MATCHES} AND c_custkey % 3 <> 2"
_OLD_SQL = f"SELECT host, {_BRAND} AS brand, max(c_custkey) AS k FROM ({_CUSTOMER_SQL}) WHERE {_MATCHES} AND c_custkey % 4 = 0 GROUP BY ALL"


@query(f"""WITH f AS ({_FRESH_SQL}), o AS ({_OLD_SQL}), e AS (SELECT host, unnest([sha256((c_custkey % 11)::VARCHAR), sha256((c_custkey % 7)::VARCHAR)]) AS digest, unnest([0, 1]) AS pos, seq FROM f), d AS (SELECT host, digest, min((seq, pos)) AS ord FROM e GROUP BY ALL),
c AS (SELECT host, code, min(ord) AS ord FROM (SELECT host, CASE WHEN c_custkey % 2 = 0 THEN 'punycode' ELSE 'manual-review' END AS code, seq AS ord FROM f UNION ALL SELECT host, 'suspicious-context', 1::BIGINT << 60 FROM o) GROUP BY ALL),
s AS (SELECT host, source FROM f UNION SELECT host, 'Source 2' FROM o),
a AS (SELECT host, max(t) AS t FROM (SELECT host, t FROM f UNION ALL SELECT host, TIMESTAMP '2023-12-31 00:00:00' FROM o) GROUP BY host)
SELECT replace(host, '.', '[.]') AS domain, array_to_string(list(source ORDER BY source), ',') AS sources, strftime(any_value(t), '%Y-%m-%dT%H:%M:%S') AS last_seen,
  coalesce(any_value((SELECT array_to_string(list(digest ORDER BY ord)[:8], ',') FROM d WHERE d.host = s.host)), '') AS hashes, any_value((SELECT array_to_string(list(code ORDER BY ord), ',') FROM c WHERE c.host = s.host)) AS codes FROM s JOIN a USING (host) GROUP BY host""")
def retained_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A synchronisation whose third source did not answer: its rows of the last snapshot go on, after all new ones."""
    fresh = _raw_customers(spark, sf_dir).where("seq % 3 <> 2")
    hosts = matching.unique_matches(_customer_hosts(spark, sf_dir).where("c_custkey % 4 = 0"), _REGISTRY)
    shown, day, none = F.replace(F.col("domain"), F.lit("."), F.lit("[.]")), _time("2023-12-31T00:00:00Z"), F.lit(None).cast("string")
    old = hosts.select(
        S.short_id(shown).alias("id"), F.concat(F.lit("hxxps://"), shown).alias("url"), shown.alias("domain"), day.alias("firstSeen"), day.alias("lastSeen"), F.array(F.lit("Source 1"), F.lit("Source 2")).alias("sources"), F.lit("active").alias("status"), "brand", none.alias("country"), none.alias("host"),
        F.array(F.lit("00" * 32)).alias("hashes"), F.array(F.lit("suspicious-context")).alias("reasonCodes"), F.lit(70).alias("confidence"),
    )
    names = ["Source 0", "Source 1", "Source 2"]
    kept = sync.retained(old, _time(_NOW), 7, names, names, names[:2])
    made = sync.synchronise(fresh, _REGISTRY, _no_rules(spark), _time(_NOW), old=kept, settings=sync.Settings(max_signals=25_000))
    joined = lambda c: F.array_join(c, ",").alias(c if c != "reasonCodes" else "codes")
    return made.snapshot.select("domain", joined("sources"), F.date_format("lastSeen", "yyyy-MM-dd'T'HH:mm:ss").alias("last_seen"), joined("hashes"), joined("reasonCodes"))


# The library's own archives as sources

@query(f"""SELECT DISTINCT CAST(DATE '2024-01-01' + CAST(c_custkey % 3 AS INT) AS DATE) AS day, host AS url, {_BRAND} AS brand, CAST({_CONFIDENCE} AS BIGINT) AS confidence, array_to_string({_CODES}, ',') AS codes FROM ({_CUSTOMER_SQL}) WHERE {_MATCHES}""")
def archived_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of an archive, read, checked and scored again; the brand that they were stored with no longer counts."""
    host = F.col("host")
    day = F.date_add(_time("2024-01-01T00:00:00Z").cast("date"), (F.col("c_custkey") % 3).cast("int"))
    shown = F.replace(host, F.lit("."), F.lit("[.]"))
    stored = _customer_hosts(spark, sf_dir).select("host", day.alias("day")).distinct().select(
        "day",
        F.to_json(F.struct(F.lit(1).alias("schemaVersion"), S.short_id(host).alias("id"), F.concat(F.col("day").cast("string"), F.lit("T10:00:00.000Z")).alias("observedAt"), F.lit("domain").alias("indicatorType"), shown.alias("domain"), shown.alias("registrableDomain"), F.lit("Sample").alias("source"), F.lit("Stale").alias("brand"), F.lit(50).alias("confidence"), F.array(F.lit("old")).alias("reasons"))).alias("line"),
    )
    lines = stored.select("day", "line", F.try_parse_json("line").alias("value"))
    made = archived.candidate_signals(archives.candidates(lines), _REGISTRY, "Sample")
    return made.select(F.to_date("last_seen").alias("day"), "url", "brand", F.col("confidence").cast("long").alias("confidence"), F.array_join("reason_codes", ",").alias("codes"))


@query(f"""WITH r AS (SELECT DISTINCT host, segment, kind, CASE WHEN c_custkey % 2 = 0 THEN 'title' ELSE 'domain' END AS evidence, CASE WHEN c_custkey % 7 = 0 THEN 'Household' ELSE {_BRAND} END AS brand FROM ({_CUSTOMER_SQL}))
SELECT DISTINCT 'hxxps://' || replace(host, '.', '[.]') AS url, brand, CASE evidence WHEN 'title' THEN 'brand-title-match' ELSE 'brand-domain-match' END AS codes FROM r
WHERE brand IN ('Household', 'Machinery', 'Furniture', 'Building') AND CASE WHEN {_MATCHES} THEN brand = {_BRAND} ELSE evidence = 'title' END""")
def archived_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of a report archive, read, reviewed against the registry and turned into raw signals."""
    rows = _customer_hosts(spark, sf_dir)
    shown = F.replace(F.col("host"), F.lit("."), F.lit("[.]"))
    evidence = F.when(F.col("c_custkey") % 2 == 0, "title").otherwise("domain")
    brand = F.when(F.col("c_custkey") % 7 == 0, "Household").otherwise(F.initcap(F.lower("c_mktsegment")))
    text, none = "2024-01-01T10:00:00.000Z", F.lit(None).cast("string")
    fields = F.struct(
        F.lit(2).alias("schemaVersion"), S.short_id(shown).alias("id"), F.concat(F.lit("hxxps://"), shown).alias("url"), shown.alias("domain"), F.lit(text).alias("firstSeen"), F.lit(text).alias("lastSeen"), F.array(F.lit("Reports")).alias("sources"), F.lit("suspected").alias("status"), brand.alias("brand"), none.alias("country"), none.alias("host"),
        none.alias("screenshotUrl"), none.alias("referenceUrl"), F.array(F.sha2(shown, 256)).alias("hashes"), F.lit("primary-html-sha256").alias("hashType"), F.array(evidence).alias("brandEvidence"), F.lit(90).alias("confidence"),
    )
    stored = rows.select(F.to_json(fields, {"ignoreNullFields": "false"}).alias("line")).distinct()
    lines = stored.select(F.lit("2024-01-01").cast("date").alias("day"), "line", F.try_parse_json("line").alias("value"))
    kept = archived.reviewed_reports(archives.reports(lines, _time(_NOW)), _REGISTRY)
    made = archived.report_signals(kept, "Reports")
    return made.select(F.replace(F.replace("url", F.lit("https://"), F.lit("hxxps://")), F.lit("."), F.lit("[.]")).alias("url"), "brand", F.array_join("reason_codes", ",").alias("codes"))


# The composed hunt

_UUID = "'00000000-0000-0000-0000-' || lpad(c_custkey::VARCHAR, 12, '0')"


@query(f"""WITH c AS (SELECT *, {_UUID} AS uuid, {_BRAND} AS brand, {_MATCHES} AS matches, c_custkey % 5 = 0 AS titled, sha256((c_custkey % 13)::VARCHAR) AS digest, row_number() OVER (ORDER BY c_custkey) - 1 AS pos FROM ({_CUSTOMER_SQL})),
ours AS (SELECT * FROM c WHERE segment <> 'automobile'),
p0 AS (SELECT 0 AS phase, *, row_number() OVER (ORDER BY pos) AS n FROM ours WHERE c_custkey % 11 = 3 AND pos < 400 AND kind = 1 QUALIFY n <= 6),
p1 AS (SELECT 1 AS phase, *, row_number() OVER (ORDER BY pos) AS n FROM ours WHERE matches AND pos < 300 AND uuid NOT IN (SELECT uuid FROM p0) QUALIFY n <= 25),
p2 AS (SELECT 2 AS phase, *, row_number() OVER (ORDER BY pos) AS n FROM ours WHERE titled AND pos < 300 AND uuid NOT IN (SELECT uuid FROM p0 UNION SELECT uuid FROM p1) QUALIFY n <= 8),
found AS (SELECT * FROM p0 WHERE titled OR c_custkey % 4 = 0 UNION ALL SELECT * FROM p1 UNION ALL SELECT * FROM p2 WHERE c_custkey % 4 = 0),
strong AS (SELECT brand, digest, min((phase, pos)) AS ord FROM found WHERE titled OR c_custkey % 4 = 0 GROUP BY ALL ORDER BY ord LIMIT 3),
w AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM strong),
a3 AS (SELECT 3 AS phase, c.*, w.brand AS wanted, w.n * 1048576 + c.pos AS ord FROM c JOIN w ON c.digest = w.digest WHERE c.pos < 200 AND c.uuid NOT IN (SELECT uuid FROM p0 UNION SELECT uuid FROM p1 UNION SELECT uuid FROM p2)),
o3 AS (SELECT * FROM a3 QUALIFY row_number() OVER (PARTITION BY uuid ORDER BY ord) = 1),
p3 AS (SELECT *, row_number() OVER (ORDER BY ord) AS n FROM o3 QUALIFY n <= 10),
said AS (SELECT phase, uuid, brand, CASE phase WHEN 0 THEN 70 WHEN 1 THEN {_CONFIDENCE} ELSE 92 END AS base, matches, titled, c_custkey FROM found
  UNION ALL SELECT 3, uuid, wanted, 94, matches, titled, c_custkey FROM p3 WHERE segment <> 'automobile' AND brand = wanted AND (matches OR titled OR c_custkey % 4 = 0))
SELECT phase, uuid, brand, CAST(CASE WHEN c_custkey % 4 = 0 THEN greatest(base, 97) ELSE base END AS INT) AS confidence,
  array_to_string(list_filter([CASE WHEN matches THEN 'domain' END, CASE WHEN titled THEN 'title' END, CASE WHEN c_custkey % 4 = 0 THEN 'verdict' END, CASE WHEN phase = 3 THEN 'primary-html-sha256' END], lambda x: x IS NOT NULL), ',') AS evidence FROM said""")
def hunt_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All four phases over search replies and details made of customers: budgets, what was fetched before, evidence, pivots."""
    position = hunt.numbered_batches(_customer_hosts(spark, sf_dir), ["c_custkey"], 1).withColumnRenamed("batch", "pos")
    key, brand = F.col("c_custkey"), F.initcap(F.lower("c_mktsegment"))
    rows = position.select(
        "c_custkey", "pos", "c_mktsegment", F.format_string("00000000-0000-0000-0000-%012d", key).alias("uuid"), F.concat(F.lit("https://"), "host", F.lit("/in")).alias("url"), "host", brand.alias("brand"),
        F.when(key % 5 == 0, F.concat(brand, F.lit(" online"))).otherwise("Welcome").alias("title"), F.sha2((key % 13).cast("string"), 256).alias("digest"),
    )
    task, page = F.struct(F.lit("public").alias("visibility"), "url"), F.struct("url", "title")
    reply = lambda phase, some, asked: some.select(F.lit(phase).alias("phase"), asked.alias("query"), "pos", F.parse_json(F.to_json(F.struct(F.col("uuid").alias("_id"), task.alias("task"), page.alias("page")))).alias("v"))
    # The hosts of a seed carry no context word, so nothing but the seed and the detail speaks for their brand.
    known = rows.where("c_mktsegment <> 'AUTOMOBILE'")
    seeds = known.where((key % 11 == 3) & (key % 5 == 1)).select(F.col("host").alias("domain"), "brand", F.lit(70).alias("confidence")).distinct()
    searched = reply("seed", known.where((key % 11 == 3) & (key % 5 == 1)), F.lit("0")).unionByName(reply("domain", rows, F.lit(""))).unionByName(reply("title", known.where(key % 5 == 0), F.lit(""))).unionByName(reply("pivot", rows, F.col("digest")))
    document = F.struct(F.struct("url", F.lit(200).alias("status"), F.lit("text/html").alias("mimeType"), F.lit(900).alias("dataLength")).alias("response"), F.col("digest").alias("hash"))
    verdict = F.when(key % 4 == 0, F.struct(F.lit(50).alias("score"), F.array(F.lit("phishing")).alias("categories"), F.array(F.struct(F.col("brand").alias("name"))).alias("brands")))
    detail = F.struct(task.alias("task"), page.alias("page"), F.struct(verdict.alias("svc")).alias("verdicts"), F.struct(F.array(F.struct(F.lit("Document").alias("type"), document.alias("response"))).alias("requests")).alias("data"))
    told = feeds.details(rows.select("uuid", F.parse_json(F.to_json(detail)).alias("v")), "svc")
    bounds = hunting.Limits(seed_batch=1_000, seed_results=400, results=300, pivot_results=200, seed_details=6, domain_details=25, title_details=8, pivot_details=10)
    made = hunting.raw_signals(feeds.scans(searched), told, seeds, _REGISTRY, _time(_NOW), "Reports", "https://reports.test", bounds)
    return made.select("phase", "uuid", "brand", F.col("confidence").cast("int").alias("confidence"), F.array_join("brand_evidence", ",").alias("evidence"))


# Order and folding of words

@query("""WITH w AS (SELECT DISTINCT unnest([n_name, lower(n_name), upper(n_name[1]) || lower(n_name)[2:], lower(n_name) || 'é', lower(n_name) || 'ez']) AS value FROM nation JOIN customer ON n_nationkey = c_nationkey)
SELECT value, row_number() OVER (ORDER BY replace(lower(value), 'é', 'e'), contains(value, 'é'), translate(value, 'ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz', 'bbbbbbbbbbbbbbbbbbbbbbbbbbaaaaaaaaaaaaaaaaaaaaaaaaaa')) - 1 AS place FROM w""")
def collated_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facets in the order of letters, then accents, then case."""
    rows = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("n_name").distinct()
    low = F.lower("n_name")
    words = rows.select(F.explode(F.array("n_name", low, F.concat(F.upper(F.left(low, F.lit(1))), F.substring(low, F.lit(2), F.length(low))), F.concat(low, F.lit("é")), F.concat(low, F.lit("ez")))).alias("value"))
    return _placed(views.facets(words, "value"))


def _placed(rows: DataFrame) -> DataFrame:
    """Facets, of which there are few, with their places."""
    listed = F.array_sort(F.collect_list(F.struct(views.collated("value").alias("k"), "value")))
    return rows.agg(listed.alias("v")).select(F.posexplode("v").alias("place", "x")).select("x.value", F.col("place").cast("long").alias("place"))


@query("SELECT c_custkey, upper(lower(c_mktsegment)[1]) || lower(c_mktsegment)[2:] AS title_brand FROM customer WHERE c_mktsegment <> 'AUTOMOBILE' AND c_custkey % 3 <> 2")
def accented_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles whose letters carry accents or pass for others name their brand all the same; half a word does not."""
    name = F.lower("c_mktsegment")
    title = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.translate(name, "aeiou", "åéïőů"), F.lit(" – login"))).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("Welcome: "), F.translate(name, "aeo", "аео"))).otherwise(F.concat(name, F.lit("é")))
    rows = _read(spark, sf_dir, "customer").select("c_custkey", title.alias("title"))
    return matching.title_brand(rows, _REGISTRY).where("title_brand is not null").select("c_custkey", "title_brand")


# Streams and publication

@query(_fold_sql("true"))
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log folded as a stream, with bounded state."""
    folding.with_rocksdb(spark)
    stream = _log(spark, sf_dir, spark.readStream.schema(_read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*"))
    return _shown_fold(folding.latest(certificates.drain(folding.folded(stream, late="3650 days", expiry_days=3_650), _name("fold"), "update")))


@query("SELECT c_custkey, c_mktsegment, 2 AS version FROM customer WHERE c_acctbal >= 0")
def published_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published, published again in another order (no change), then with rows less (a new version); readers see the last."""
    root, rows = _folder(spark, "published"), _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal", F.current_timestamp().alias("generatedAt"))
    publication.publish(rows, root)
    publication.publish(rows.orderBy(F.desc("c_acctbal")), root)
    last = publication.publish(rows.where("c_acctbal >= 0"), root)
    return publication.read(spark, root).select("c_custkey", "c_mktsegment", F.lit(last.number).alias("version"))


@query("""WITH m AS (SELECT count(*) AS messages, count(*) FILTER (event_type <> 'view') AS names, count(*) FILTER (value > 100) AS matches FROM events)
SELECT messages, least(names, messages) AS names, least(matches, names) AS matches, CASE WHEN least(matches, names) = 0 THEN 'healthy-empty' ELSE 'healthy-matches' END AS outcome, '2024-01-02T10:06:00' AS last_success, 'current' AS status, 3 AS version FROM m""")
def collection_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An attempt begun, counted from what a pass over the table observed, and completed; the published state."""
    from pyspark.sql import Observation

    store, seen = health.Store(spark, _folder(spark, "health")), Observation()
    store.begin(_time("2024-01-02T10:02:00Z"), "schedule")
    metrics = [F.count(F.lit(1)).alias("messages"), F.count_if(F.col("event_type") != "view").alias("dnsNames"), F.count_if(F.col("value") > 100).alias("matches")]
    _read(spark, sf_dir, "events").observe(seen, *metrics).write.format("noop").mode("overwrite").save()
    found = seen.get
    found = found | {"matches": min(found["matches"], found["dnsNames"]), "listeningSeconds": 240.0, "connectionAttempts": 1, "connections": 1}
    store.count(_time("2024-01-02T10:04:00Z"), found)
    last = store.complete(_time("2024-01-02T10:06:00Z"), "healthy-matches" if found["matches"] else "healthy-empty", found)
    a = F.col("latestAttempt")
    return store.read().select(a["messages"].alias("messages"), a["dnsNames"].alias("names"), a["matches"].alias("matches"), a["outcome"].alias("outcome"), F.date_format("lastSuccessAt", "yyyy-MM-dd'T'HH:mm:ss").alias("last_success"), "freshness.status", F.lit(last.number).alias("version"))


# Events and archives

_ORDER_SQL = "SELECT o_custkey, min(o_orderdate) AS a, max(o_orderdate) AS b, 'c' || o_custkey || '[.]example[.]com' AS domain, o_custkey % 3 AS kind FROM orders GROUP BY o_custkey"


@query(f"""WITH o AS ({_ORDER_SQL}), s AS (SELECT *, substr(sha256(domain), 1, 20) AS id, CASE WHEN kind = 0 THEN 'offline' ELSE 'active' END AS status FROM o),
e AS (SELECT id, domain, 'observation' AS kind, unnest(CASE WHEN a = b THEN [a] ELSE [a, b] END) AS moment, status, NULL AS previous, 'manual-review' AS codes FROM s WHERE o_custkey % 7 <> 0
  UNION ALL SELECT id, domain, 'status-transition', b, status, CASE WHEN o_custkey % 5 > 0 THEN 'active' END, CASE WHEN o_custkey % 5 > 0 THEN 'manual-review,source-status-change' ELSE 'manual-review,first-publication' END FROM s WHERE o_custkey % 7 <> 0 AND (o_custkey % 5 = 0 OR status <> 'active'))
SELECT id AS signal, kind, strftime(moment, '%Y-%m-%dT%H:%M:%S') AS moment, status, previous, codes, substr(sha256('{{"eventType":"' || kind || '","observedAt":"' || strftime(moment, '%Y-%m-%dT%H:%M:%S') || '.000Z","previousStatus":' || coalesce('"' || previous || '"', 'null') || ',"schemaVersion":1,"signalId":"' || id || '","sources":["F"],"status":"' || status || '"}}'), 1, 32) AS identity FROM e""")
def observed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a publication: both ends of the observations of what is published, and its changes of status."""
    domain = F.concat(F.lit("c"), "o_custkey", F.lit("[.]example[.]com"))
    rows = _read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("timestamp").alias("firstSeen"), F.max("o_orderdate").cast("timestamp").alias("lastSeen"))
    rows = rows.select("o_custkey", S.short_id(domain).alias("id"), domain.alias("domain"), F.lit("Brand").alias("brand"), "firstSeen", "lastSeen", F.array(F.lit("F")).alias("sources"), F.when(F.col("o_custkey") % 3 == 0, "offline").otherwise("active").alias("status"), F.lit(80).alias("confidence"), F.array(F.lit("manual-review")).alias("reasonCodes"))
    current = rows.where("o_custkey % 7 <> 0")
    before = rows.where("o_custkey % 5 > 0").select("id", F.lit("active").alias("latestStatus"))
    made = history.build_events(rows, current, before)
    return made.select(F.col("signalId").alias("signal"), F.col("eventType").alias("kind"), F.date_format("observedAt", "yyyy-MM-dd'T'HH:mm:ss").alias("moment"), "status", F.col("previousStatus").alias("previous"), F.array_join("reasonCodes", ",").alias("codes"), F.col("eventId").alias("identity"))


@query("SELECT lpad(event_id::VARCHAR, 12, '0') AS event_id FROM events WHERE NOT (event_type = 'view' AND CAST(ts AS DATE) <= DATE '2024-01-20')")
def appended_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that the log does not have yet, each once though it comes twice."""
    log = _log(spark, sf_dir)
    stored = log.where("array_contains(sources, 'view') and day <= '2024-01-20'")
    return history.new_events(log.unionByName(log.where("day = '2024-01-25'")), stored).select(F.col("eventId").alias("event_id"))


@query("""SELECT CAST(ts AS DATE) AS day, user_id AS id, min(event_id) AS event_id FROM events WHERE event_type <> 'view' AND (CAST(ts AS DATE), user_id) NOT IN (SELECT (CAST(ts AS DATE), user_id) FROM events WHERE event_type = 'view') GROUP BY ALL""")
def archive_appends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of each day and user that the archive does not have."""
    rows = _read(spark, sf_dir, "events").select(F.to_date("ts").alias("day"), F.col("user_id").alias("id"), "event_id", "event_type")
    return archives.append_new(rows.where("event_type <> 'view'").drop("event_type"), rows.where("event_type = 'view'"), F.col("event_id"))


@query(f"""SELECT c_custkey, brand FROM (SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN 'Machinery' WHEN c_custkey % 4 = 1 THEN {_BRAND} WHEN c_custkey % 4 = 2 THEN 'No Brand' END AS declared, CASE WHEN {_MATCHES} THEN {_BRAND} END AS own FROM ({_CUSTOMER_SQL})),
  LATERAL (SELECT CASE WHEN declared IN ('Household', 'Machinery', 'Furniture', 'Building') THEN declared END AS known), LATERAL (SELECT coalesce(known, own) AS brand) WHERE brand IS NOT NULL AND (known IS NULL OR own IS NULL OR known = own)""")
def registry_scope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose declared brand the registry knows and the host does not contradict, or whose host alone names it."""
    declared = F.when(F.col("c_custkey") % 4 == 0, "machinery").when(F.col("c_custkey") % 4 == 1, F.initcap(F.lower("c_mktsegment"))).when(F.col("c_custkey") % 4 == 2, "No Brand")
    rows = _customer_hosts(spark, sf_dir).withColumn("brand", declared)
    return matching.scope(rows, matching.score(rows, _REGISTRY), _REGISTRY).select("c_custkey", "brand")


_LINE_FAULTS = "CASE c_custkey % 9 WHEN 1 THEN 1 WHEN 2 THEN 1 WHEN 3 THEN 1 WHEN 4 THEN 1 WHEN 5 THEN 1 WHEN 6 THEN 1 WHEN 7 THEN 1 ELSE 0 END"


@query(f"SELECT c_custkey, host AS domain, CAST(c_custkey % 101 AS INT) AS confidence FROM ({_CUSTOMER_SQL}) WHERE {_LINE_FAULTS} = 0")
def archive_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON lines of which seven in nine break the closed schema in some way; the others are read."""
    key, host = F.col("c_custkey"), F.col("host")
    fault = lambda n, wrong, good: F.when(key % 9 == n, wrong).otherwise(good)
    shown = F.replace(host, F.lit("."), F.lit("[.]"))
    fields = [
        F.lit(1).alias("schemaVersion"), fault(1, F.lit("0" * 20), S.short_id(host)).alias("id"), fault(2, F.lit("2024-01-01T10:00:00Z"), F.lit("2024-01-01T10:00:00.000Z")).alias("observedAt"), F.lit("domain").alias("indicatorType"), fault(3, host, shown).alias("domain"), shown.alias("registrableDomain"),
        fault(4, F.lit(" Sample"), F.lit("Sample")).alias("source"), F.concat(F.lit("B"), key).alias("brand"), fault(5, F.lit(101), (key % 101).cast("int")).alias("confidence"), fault(6, F.array().cast("array<string>"), F.array(F.lit("r"))).alias("reasons"),
    ]
    line = F.when(key % 9 == 7, F.to_json(F.struct(*fields, F.lit(1).alias("extra")))).otherwise(F.to_json(F.struct(*fields)))
    lines = _customer_hosts(spark, sf_dir).select(F.lit("2024-01-01").cast("date").alias("day"), line.alias("line")).withColumn("value", F.try_parse_json("line"))
    return archives.candidates(lines).select(F.substring("brand", 2, 20).cast("long").alias("c_custkey"), "domain", "confidence")


_CHANGES = {
    "user:pw@": None,
    "": "/plain",
    "/account/12345": "/account/redacted",
    "/a;token=abc;b": "/redacted",
    "/0123456789abcdef01234567/x": "/redacted/x",
    "/%6Cogin": "/login",
    "/call/+370 600 12345": "/call/redacted",
    "/go/https://other.example/x": "/go/embedded-url-redacted",
    "/x@y.example": "/redacted",
    "/file.page.html": "/file[.]page[.]html",
}


@query("WITH k(kind, suffix) AS (VALUES " + ", ".join(f"({i}, {v!r})" for i, v in enumerate(_CHANGES.values()) if v) + f""")
SELECT page_id, CASE WHEN page_id % 11 = 10 THEN 'hxxps://2001[:]db8[:][:]1:8443/x' ELSE 'hxxps://' || replace({_HOST_SQL}, '.', '[.]') || suffix END AS display_url FROM pages LEFT JOIN k ON page_id % 11 = kind WHERE suffix IS NOT NULL OR page_id % 11 = 10""")
def private_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses with private, encoded and nested parts, IPv6 hosts and user information in their published form."""
    host, kind = U.url_host(F.col("url")), F.col("page_id") % 11
    address = F.concat(F.lit("https://"), F.when(kind == 0, "user:pw@").otherwise(""), host, F.when(kind == 1, "/plain").otherwise(""))
    for i, path in enumerate(_CHANGES):
        if path.startswith("/"):
            address = F.concat(address, F.when(kind == i, path).otherwise(""))
    address = F.when(kind == 10, "https://[2001:db8::1]:8443/x?q#f").otherwise(address)
    rows = _read(spark, sf_dir, "pages").select("page_id", U.safe_url(address).alias("u"))
    return rows.where("u.display_url is not null").select("page_id", "u.display_url")


@query(f"""SELECT host AS domain, {_BRAND} AS brand, {_CONFIDENCE} AS confidence FROM (SELECT DISTINCT host, segment, kind FROM ({_CUSTOMER_SQL}) WHERE {_MATCHES}) ORDER BY confidence DESC, domain, brand LIMIT 250""")
def feed_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best hosts of a text feed with comments, addresses and hosts."""
    folder = _folder(spark, "feed")
    line = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("  https://"), "host", F.lit("/path?x \r"))).otherwise(F.col("host"))
    rows = _customer_hosts(spark, sf_dir).select(line.alias("value"))
    rows.unionByName(rows.select(F.concat(F.lit("# "), "value").alias("value"))).write.text(folder)
    made = feeds.seeds(feeds.text_feed(spark, folder), _REGISTRY)
    return made.select("domain", "brand", F.col("confidence").cast("int").alias("confidence"))


@query("""WITH s AS (SELECT c_custkey AS id, strftime(TIMESTAMP '2024-01-01' + INTERVAL 1 SECOND * (c_custkey % 50), '%Y-%m-%dT%H:%M:%S') AS seen, CASE c_custkey % 4 WHEN 0 THEN ['Passive'] WHEN 1 THEN ['Own', 'Passive'] WHEN 2 THEN ['Other', 'Passive'] ELSE ['Own'] END AS sources FROM customer),
j AS (SELECT id, seen, length('{"id":' || id || ',"lastSeen":"' || seen || '","sources":["Passive"]}') + 1 AS n FROM s WHERE list_contains(sources, 'Passive') AND NOT list_contains(sources, 'Other'))
SELECT id FROM (SELECT id, sum(n) OVER (ORDER BY seen DESC, id) AS used FROM j) WHERE used <= 20000""")
def partner_hand_off(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of allowed sources that the passive one saw, as many of the newest as fit in a budget of bytes."""
    seen = F.date_format(F.timestamp_seconds(F.lit(1_704_067_200) + F.col("c_custkey") % 50), "yyyy-MM-dd'T'HH:mm:ss")
    sources = F.element_at(F.array(*[F.array(*[F.lit(x) for x in some]) for some in (["Passive"], ["Own", "Passive"], ["Other", "Passive"], ["Own"])]), (F.col("c_custkey") % 4 + 1).cast("int"))
    rows = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), seen.alias("lastSeen"), sources.alias("sources"))
    return feeds.hand_off(rows, ["Own", "Passive"], ["Passive"], 20_000).select("id")


# Decisions, documents and what may be shown

_JSON = "'{{\"brand\":' || coalesce('\"' || brand || '\"', 'null') || ',\"domain\":\"' || replace(host, '.', '[.]') || '\",\"reasonCode\":\"wrong-brand\",\"scope\":\"exact\"}}'"


@query(f"""WITH d AS (SELECT host, max(c_custkey) AS k, any_value(segment) AS segment, any_value(kind) AS kind FROM ({_CUSTOMER_SQL}) WHERE c_custkey % 5 IN (0, 2, 3) AND segment <> 'automobile' GROUP BY host),
j AS (SELECT *, CASE WHEN k % 3 = 0 THEN {_BRAND} END AS brand, {_BRAND} AS own, {_CONFIDENCE} AS most FROM d)
SELECT 'suppression' AS family, substr(sha256({_JSON.replace('{{', '{').replace('}}', '}')}), 1, 24) AS id, replace(host, '.', '[.]') AS domain, brand, NULL AS url FROM j WHERE k % 2 = 0
UNION ALL SELECT 'addition', NULL, replace(host, '.', '[.]'), own, 'hxxps://' || replace(host, '.', '[.]') || '/kit' FROM j WHERE k % 2 = 1 AND k % 4 <> 3""")
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger's decisions in force, exported as a document and read back whole; additions that claim too much are left out."""
    folder = _folder(spark, "review")
    rows = _customer_hosts(spark, sf_dir).where("c_custkey % 5 in (0, 2, 3) and c_mktsegment <> 'AUTOMOBILE'").groupBy(F.col("host").alias("domain")).agg(F.max("c_custkey").alias("k"), F.first(F.initcap(F.lower("c_mktsegment"))).alias("own"))
    k, negative = F.col("k"), F.col("k") % 2 == 0
    entry = lambda sequence, action: rows.select(
        F.lit(sequence).alias("sequence"), action.alias("action"), "domain", F.when(~negative | (k % 3 == 0), F.col("own")).alias("brand"), F.when(negative, "exact").alias("scope"), F.when(negative, "wrong-brand").alias("reason_code"),
        F.concat(F.lit("https://"), "domain", F.lit("/kit")).alias("url"), F.when(k % 4 == 3, 101).otherwise(80).alias("confidence"), _time("2024-01-01T10:00:00Z").alias("recorded_at"),
    )
    ledger = entry(1, F.lit("allowlist")).unionByName(entry(2, F.lit("unallowlist"))).unionByName(entry(3, F.when(negative, "false-positive").otherwise("add")))
    decisions.as_document(decisions.exported(review.state(ledger), _REGISTRY, _time(_NOW)), "2024-01-01T10:00:00.000Z").coalesce(1).write.text(folder)
    policy = decisions.read_decisions(spark, f"{folder}/part-*", _REGISTRY, _time(_NOW))
    none = F.lit(None).cast("string")
    return policy.suppressions.select(F.lit("suppression").alias("family"), "id", "domain", "brand", none.alias("url")).unionByName(policy.candidates.select(F.lit("addition").alias("family"), none.alias("id"), "domain", "brand", "url"))


@query(f"""SELECT DISTINCT host AS domain, {_BRAND} AS brand FROM ({_CUSTOMER_SQL}) WHERE segment <> 'automobile' AND CASE WHEN {_MATCHES} THEN true ELSE c_custkey % 2 = 0 END""")
def shown_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals of the history that may be shown: their hosts match their brand, or evidence of another kind speaks for it."""
    shown = F.replace(F.col("host"), F.lit("."), F.lit("[.]"))
    typed = F.when(F.col("c_custkey") % 2 == 0, "provider-verdict").otherwise("brand-exact-token")
    rows = _customer_hosts(spark, sf_dir).where("c_mktsegment <> 'AUTOMOBILE'")
    time = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("c_custkey"))
    log = rows.select(
        F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("eventId"), S.short_id(shown).alias("signalId"), F.lit("observation").alias("eventType"), time.alias("observedAt"), shown.alias("domain"), F.initcap(F.lower("c_mktsegment")).alias("brand"), F.array(F.lit("F")).alias("sources"), F.lit("active").alias("status"),
        F.lit(None).cast("string").alias("previousStatus"), F.lit(80).alias("confidence"), F.array(typed).alias("reasonCodes"),
    )
    folded = cut(history.fold(log))
    plain = folded.withColumn("host", F.replace(F.col("domain"), F.lit("[.]"), F.lit(".")))
    matches = cut(matching.score(plain, _REGISTRY))
    kept = matching.scope(plain, matches, _REGISTRY)
    return history.public(folded, matches, kept, 100_000).select(F.replace("domain", F.lit("[.]"), F.lit(".")).alias("domain"), "brand")


@query("""SELECT 'https://c' || c_custkey || '.example.com/' AS url, CASE WHEN c_custkey % 3 = 0 THEN 'B' || c_custkey END AS brand, CASE WHEN c_custkey % 4 <> 1 THEN c_custkey % 100 END AS confidence, CASE WHEN c_custkey % 2 = 0 THEN 1 ELSE 0 END AS hashes FROM customer WHERE c_custkey % 7 <> 6 ORDER BY c_custkey LIMIT 25000""")
def partner_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A partner's document whose rows name their fields in different ways, as raw signals."""
    folder, key = _folder(spark, "partner"), F.col("c_custkey")
    address, brand = F.concat(F.lit("https://c"), key, F.lit(".example.com/")), F.when(key % 3 == 0, F.concat(F.lit("B"), key))
    fields = F.struct(
        F.when(key % 7 < 3, address).alias("url"), F.when((key % 7 >= 3) & (key % 7 < 6), address).alias("indicator"), F.when(key % 6 == 0, brand).alias("brand"), F.when(key % 6 == 3, brand).alias("brand_targeted"), F.when(key % 4 == 0, key % 100).alias("confidence"),
        F.when(key % 4 == 1, F.lit("90")).alias("confidenceScore"), F.when(key % 4 > 1, key % 100).alias("confidence_score"), F.when(key % 2 == 0, "primary-html-sha256").alias("hashType"), F.array(F.sha2(key.cast("string"), 256)).alias("hashes"),
    )
    listed = F.transform(F.array_sort(F.collect_list(F.struct(key.alias("k"), fields.alias("v")))), lambda x: x["v"])
    # The document is one row, bounded by its contract.
    rows = _read(spark, sf_dir, "customer").where("c_custkey % 7 <> 6").orderBy("c_custkey").limit(25_000)
    rows.agg(listed.alias("signals")).select(F.to_json(F.struct("signals")).alias("value")).coalesce(1).write.text(folder)
    made = feeds.partner_rows(spark, f"{folder}/part-*", F.lit("2024-01-01T00:00:00.000Z"))
    return made.select("url", "brand", F.col("confidence").cast("long").alias("confidence"), F.coalesce(F.size("hashes"), F.lit(0)).alias("hashes"))


@query(f"""WITH h AS (SELECT DISTINCT host, segment, kind FROM ({_CUSTOMER_SQL}) WHERE {_MATCHES}) SELECT replace(host, '.', '[.]') AS domain, {_BRAND} AS brand, 'Source 0' AS sources FROM h WHERE host NOT LIKE 'household%'""")
def snapshot_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot published as a document with broken rows among its own, read back: the broken ones are skipped."""
    folder = _folder(spark, "snapshot")
    raw = _raw_customers(spark, sf_dir).withColumn("source", F.lit("Source 0"))
    made = sync.synchronise(raw, _REGISTRY, _no_rules(spark), _time(_NOW), settings=sync.Settings(max_signals=25_000)).snapshot
    broken = made.withColumn("confidence", F.when(F.col("brand") == "Household", 101).otherwise(F.col("confidence")))
    snapshots.as_document(broken, "2024-01-01T10:00:00.000Z").coalesce(1).write.text(folder)
    back = snapshots.read_snapshot(spark, f"{folder}/part-*", ["Source 0"])
    return back.select("domain", "brand", F.array_join("sources", ",").alias("sources"))


# The ledger and the views of sources

@query(f"""WITH r AS (SELECT c_custkey, host, {_BRAND} AS own, {_MATCHES} AS matches, row_number() OVER (ORDER BY c_custkey) AS n FROM ({_CUSTOMER_SQL})), t AS (SELECT count(*) AS total FROM r)
SELECT n + p.again * total AS sequence, host AS domain, 'https://' || host || '/kit' AS url, CASE WHEN matches THEN own WHEN segment_shown AND p.again = 0 THEN 'Household' END AS brand, CASE WHEN p.again = 0 THEN 'add' ELSE 'remove' END AS action
FROM (SELECT *, NOT matches AND host LIKE 'automobile%' AS segment_shown FROM r) r, t, (VALUES (0), (1)) AS p(again)""")
def ledger_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators taken apart, their brands resolved from hosts and from a snapshot, recorded in two batches and read back."""
    root, none = _folder(spark, "ledger"), F.lit(None).cast("string")
    rows = _customer_hosts(spark, sf_dir).select(F.col("c_custkey").alias("n"), F.concat(F.lit("hxxps://"), F.replace("host", F.lit("."), F.lit("[.]")), F.lit("/kit?token=1")).alias("indicator"))
    requests = cut(ledger.indicators(rows, "indicator")).select("n", _time(_NOW).alias("recorded_at"), F.lit("add").alias("action"), "domain", "url", none.alias("brand"), F.lit("exact").alias("scope"), none.alias("reason_code"), F.lit(80).alias("confidence"), F.lit(" a  note ").alias("note"))
    shown = _customer_hosts(spark, sf_dir).where("c_mktsegment = 'AUTOMOBILE'").select(F.replace("host", F.lit("."), F.lit("[.]")).alias("domain"), F.lit("Household").alias("brand"))
    ledger.record(ledger.resolved_brands(requests, _REGISTRY, shown), root)
    ledger.record(ledger.resolved_brands(requests.withColumn("action", F.lit("remove")), _REGISTRY), root)
    return ledger.read_ledger(spark, root).select("sequence", "domain", "url", "brand", "action")


@query(f"""WITH r AS (SELECT host, {_BRAND} AS brand, c_custkey % 5 AS age, c_custkey FROM ({_CUSTOMER_SQL}) WHERE {_MATCHES} AND c_custkey % 5 < 3)
SELECT replace(host, '.', '[.]') AS domain, any_value(brand) AS brand, strftime(DATE '2024-01-10' - CAST(min(age) AS INT), '%Y-%m-%d') AS last_seen, max(c_custkey % 101) AS confidence FROM r GROUP BY host""")
def recent_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports of the last three days, checked against the registry and merged per host."""
    shown = F.replace(F.col("host"), F.lit("."), F.lit("[.]"))
    day = F.date_sub(F.lit("2024-01-10").cast("date"), (F.col("c_custkey") % 5).cast("int"))
    time, none, texts = day.cast("timestamp"), F.lit(None).cast("string"), F.array().cast("array<string>")
    rows = _customer_hosts(spark, sf_dir).where("c_mktsegment <> 'AUTOMOBILE'").select(
        day.alias("day"), S.short_id(shown).alias("id"), F.concat(F.lit("hxxps://"), shown).alias("url"), shown.alias("domain"), time.alias("firstSeen"), time.alias("lastSeen"), F.array(F.lit("Reports")).alias("sources"), F.lit("suspected").alias("status"), F.initcap(F.lower("c_mktsegment")).alias("brand"),
        none.alias("country"), none.alias("host"), none.alias("screenshotUrl"), none.alias("referenceUrl"), texts.alias("hashes"), F.array(F.lit("domain")).alias("brandEvidence"), (F.col("c_custkey") % 101).cast("int").alias("confidence"),
    )
    made = archived.recent_reports(rows, _REGISTRY, F.lit("2024-01-10").cast("date"), 3, 1_000_000)
    return made.select("domain", "brand", F.date_format("lastSeen", "yyyy-MM-dd").alias("last_seen"), F.col("confidence").cast("long").alias("confidence"))


@query(f"""SELECT count(*) FILTER (state = 'healthy') AS healthy, count(*) FILTER (state = 'partial') AS partial, count(*) FILTER (state = 'skipped') AS skipped FROM (SELECT event_type, CASE WHEN count(*) FILTER (value > 100) = 0 THEN 'skipped' WHEN count(*) % 2 = 0 THEN 'healthy' ELSE 'partial' END AS state FROM events GROUP BY 1)""")
def source_state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _read(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("high"), F.count("*").alias("n"))
    state = F.when(F.col("high") == 0, "skipped").when(F.col("n") % 2 == 0, "healthy").otherwise("partial")
    return views.state_counts(states.select(state.alias("state")))
