"""Queries over the driver's tables, one or more per operator, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions import display as D
from vigilframe.functions import hosts as H
from vigilframe.functions import signals as S
from vigilframe.functions import text as T
from vigilframe.functions import urls as U
from vigilframe.operators import health, history, hunt, matching, merge, review, seeds, views
from vigilframe.sources import archives
from vigilframe.streaming import certificates

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _utc(column: str) -> Column:
    """A table's zoneless time as a UTC timestamp."""
    return F.to_utc_timestamp(F.col(column).cast("string").cast("timestamp"), "UTC")


# Hosts, addresses and text

_HOST_SQL = "lower(regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1))"
_DISPLAY_SQL = f"replace(regexp_extract(url, '^([a-z]+)://', 1), 'http', 'hxxp') || '://' || replace({_HOST_SQL}, '.', '[.]') || replace(CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) = '/' THEN '' ELSE regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) END, '.html', '[.]html')"


@query(f"SELECT page_id, substr(sha256(replace({_HOST_SQL}, '.', '[.]')), 1, 20) AS id, {_DISPLAY_SQL} AS display_url, replace({_HOST_SQL}, '.', '[.]') AS display_domain FROM pages")
def defang_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages").select("page_id", U.safe_url(F.col("url")).alias("u"))
    return rows.select("page_id", S.short_id(F.lower("u.display_domain")).alias("id"), "u.display_url", "u.display_domain")


@query(f"SELECT replace({_HOST_SQL}, '.', '[.]') AS domain, count(*) AS pages, max(page_id) AS latest_page, arg_max({_DISPLAY_SQL}, page_id) AS latest_url FROM pages GROUP BY 1")
def host_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages").select("page_id", U.safe_url(F.col("url")).alias("u")).where("u.key is not null")
    return rows.groupBy(F.col("u.display_domain").alias("domain")).agg(F.count("*").alias("pages"), F.max("page_id").alias("latest_page"), F.max_by("u.display_url", "page_id").alias("latest_url"))


@query(f"SELECT page_id, {_HOST_SQL} AS host, CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN 0 ELSE length(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)) END AS path_length, CASE WHEN url LIKE 'https://%' THEN 1 ELSE 0 END AS secure FROM pages")
def url_specificity(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages").select("page_id", U.url_host(F.col("url")).alias("host"), U.specificity(F.col("url")).alias("s"))
    return rows.select("page_id", "host", F.col("s.length").alias("path_length"), F.col("s.secure").alias("secure"))


@query(r"""WITH runs AS (SELECT doc_id, list_filter(regexp_extract_all(text, '[0-9.]+'), lambda x: regexp_full_match(x, '\d{1,3}(\.\d{1,3}){3}')) AS ips FROM documents)
SELECT doc_id, len(ips) AS addresses, replace(ips[1], '.', '[.]') AS first_address FROM runs WHERE len(ips) > 0""")
def defang_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.regexp_extract_all("text", F.lit(T.IPV4), F.lit(0))
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.size(found).alias("addresses"), T.defang_ipv4(F.get(found, F.lit(0))).alias("first_address"))
    return rows.where("addresses > 0").withColumn("addresses", F.col("addresses").cast("long"))


@query(r"SELECT doc_id, nullif(left(trim(regexp_replace(text, '[[:cntrl:]\s]+', ' ', 'g')), 160), '') AS cleaned FROM documents")
def clean_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text"), 160).alias("cleaned"))


@query(f"SELECT DISTINCT {_HOST_SQL} AS host, string_split({_HOST_SQL}, '.')[1] AS first_label, len(string_split({_HOST_SQL}, '.')) AS labels, length({_HOST_SQL}) - length(replace({_HOST_SQL}, '-', '')) AS hyphens, array_to_string(list_filter(string_split(replace(array_to_string(string_split({_HOST_SQL}, '.')[:-2], '-'), '.', '-'), '-'), lambda x: x <> ''), ' ') AS parts FROM pages")
def host_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages").select(H.normalize_domain(U.url_host(F.col("url"))).alias("host")).where("host is not null").distinct().withColumn("folded", H.folded_host(F.col("host")))
    groups = H.label_groups(F.col("host"), F.col("folded"), F.lit(1))
    labels = F.split("host", r"\.")
    return rows.select("host", F.get(labels, F.lit(0)).alias("first_label"), F.size(labels).cast("long").alias("labels"), H.hyphens(F.col("host")).cast("long").alias("hyphens"), F.array_join(F.flatten(groups["parts"]), " ").alias("parts"))


@query(f"SELECT host, part FROM (SELECT DISTINCT {_HOST_SQL} AS host, unnest(string_split(replace({_HOST_SQL}, '.', '-'), '-')) AS part FROM pages) WHERE part IN ({', '.join(repr(w) for w in H.CONTEXT_WORDS)})")
def context_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = _read(spark, sf_dir, "pages").select(U.url_host(F.col("url")).alias("host")).distinct()
    return host.select("host", F.explode(F.array_distinct(F.split("host", "[.-]"))).alias("part")).where(F.col("part").isin(H.CONTEXT_WORDS))


_ALIASES = ("widget", "gadget", "bolt", "rnig", "gear", "smal", "blu")


@query(f"SELECT DISTINCT word, alias FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) w, (SELECT unnest([{', '.join(repr(a) for a in _ALIASES)}]) AS alias) a WHERE damerau_levenshtein(word, alias) = 1")
def one_edit_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words within one edit of an alias: joined on what is left without one character, then verified."""
    words = _read(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word")).distinct()
    aliases = spark.createDataFrame([(a,) for a in _ALIASES], "alias string")
    near = words.withColumn("key", F.explode(H.deletions(F.col("word")))).join(aliases.withColumn("key", F.explode(H.deletions(F.col("alias")))), "key")
    return near.select("word", "alias").distinct().where(H.one_edit(F.col("word"), F.col("alias")))


# Registry

_SUFFIXES = ("example.org", "blog.tionsh.example.net", "www.ththhe.example.com")
_REGISTRY = matching.Registry(
    (
        matching.Brand("Household", ("Household",), ("household.test",)),
        matching.Brand("Machinery", ("Machinery",), ("machinery.test",)),
        matching.Brand("Furniture", ("Furniture",), ("furniture.test",), fuzzy_aliases=("Furniture",)),
        matching.Brand("Building", ("Building",), ("building.example",)),
    )
)


@query(f"SELECT DISTINCT {_HOST_SQL} AS host FROM pages WHERE NOT ({' OR '.join(f'({_HOST_SQL} = {s!r} OR suffix({_HOST_SQL}, {("." + s)!r}))' for s in _SUFFIXES)})")
def suppressed_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "pages").select(U.url_host(F.col("url")).alias("host")).distinct()
    return matching.drop_below(rows, "host", spark.createDataFrame([(s,) for s in _SUFFIXES], "suffix string"))


def _customer_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*[F.lit(w) for w in ("-login", "-news", "-secure", "billing", "")]), (F.col("c_custkey") % 5 + 1).cast("int"))
    segment = F.lower("c_mktsegment")
    # Dealt, as the table is one small file of very many rows.
    rows = _read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_nationkey").repartition("c_custkey")
    return rows.select("c_custkey", "c_mktsegment", F.concat(segment, word, F.lit(".n"), F.col("c_nationkey"), F.lit(".example")).alias("host"))


_CUSTOMER_SQL = "SELECT c_custkey, lower(c_mktsegment) || ['-login', '-news', '-secure', 'billing', ''][c_custkey % 5 + 1] || '.n' || c_nationkey || '.example' AS host, lower(c_mktsegment) AS segment, c_custkey % 5 AS kind FROM customer"
_SCORED_SQL = f"""SELECT DISTINCT host AS domain, upper(segment[1]) || segment[2:] AS brand,
  CASE WHEN kind = 3 THEN 78 ELSE 80 END + 15 + CASE WHEN segment = 'building' THEN 0 ELSE 5 END AS confidence FROM ({_CUSTOMER_SQL})
  WHERE segment IN ('household', 'machinery', 'furniture', 'building') AND kind IN (0, 2, 3)"""


@query(_SCORED_SQL)
def brand_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.unique_matches(_customer_hosts(spark, sf_dir), _REGISTRY)
    return found.select("domain", "brand", F.col("confidence").cast("long").alias("confidence"))


@query(f"SELECT brand, code, count(*) AS hosts FROM (SELECT brand, unnest(['suspicious-context', CASE WHEN confidence < 99 AND brand <> 'Building' OR brand = 'Building' AND confidence = 93 THEN 'brand-joined-affix' ELSE 'brand-exact-token' END] || CASE WHEN brand = 'Building' THEN [] ELSE ['different-tld'] END) AS code FROM ({_SCORED_SQL})) GROUP BY ALL")
def match_reason_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = matching.unique_matches(_customer_hosts(spark, sf_dir), _REGISTRY)
    codes = found.select("brand", F.explode(matching.match_reasons(F.col("reasons"))).alias("code"))
    return codes.groupBy("brand", "code").agg(F.count("*").alias("hosts"))


@query("SELECT p_name AS title, min(alias) AS title_brand FROM (SELECT DISTINCT p_name, unnest(string_split(p_name, ' ')) AS alias FROM part) WHERE alias IN ('widget', 'bracket', 'green', 'small') GROUP BY p_name HAVING count(DISTINCT alias) = 1")
def brand_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    registry = matching.Registry(tuple(matching.Brand(w, (w,), (f"{w}.test",)) for w in ("widget", "bracket", "green", "small")))
    titles = _read(spark, sf_dir, "part").select(F.col("p_name").alias("title")).distinct()
    return matching.title_brand(titles, registry).where("title_brand is not null").select("title", "title_brand")


@query("SELECT user_id, min(event_type) AS event_type FROM events WHERE value > 200 GROUP BY user_id HAVING count(DISTINCT event_type) = 1")
def unique_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seeds.unique_value(_read(spark, sf_dir, "events").where("value > 200"), "user_id", "event_type").select("user_id", "event_type")


@query("SELECT l_partkey AS domain, l_returnflag AS brand, max(CAST(l_quantity AS INT)) AS confidence FROM lineitem GROUP BY ALL ORDER BY confidence DESC, domain, brand LIMIT 250")
def seed_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("domain"), F.col("l_returnflag").alias("brand"), F.col("l_quantity").cast("int").alias("confidence"))
    return seeds.merge_seeds(rows, unambiguous=False)


@query("WITH g AS (SELECT l_orderkey AS domain, l_returnflag AS brand, max(CAST(l_quantity AS INT)) AS confidence FROM lineitem GROUP BY 1, 2) SELECT domain, brand, confidence FROM g WHERE domain IN (SELECT domain FROM g GROUP BY domain HAVING count(*) = 1) ORDER BY confidence DESC, domain, brand LIMIT 250")
def unambiguous_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("domain"), F.col("l_returnflag").alias("brand"), F.col("l_quantity").cast("int").alias("confidence"))
    return seeds.merge_seeds(rows)


# Merging signals

_STATUS = {"view": "live", "click": "pending", "signup": "offline", "purchase": "takedown", "error": "odd"}
_MAPPED_SQL = "CASE event_type WHEN 'view' THEN 'active' WHEN 'click' THEN 'suspected' WHEN 'signup' THEN 'offline' WHEN 'purchase' THEN 'mitigated' ELSE 'unknown' END"
_PRIORITY_SQL = "CASE event_type WHEN 'view' THEN 5 WHEN 'click' THEN 4 WHEN 'error' THEN 3 WHEN 'signup' THEN 2 ELSE 1 END"


def _raw_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw signals: hour of the event as its time, so that times tie."""
    hour = F.date_trunc("hour", _utc("ts"))
    word = F.element_at(F.create_map(*[F.lit(x) for p in _STATUS.items() for x in p]), F.col("event_type"))
    return _read(spark, sf_dir, "events").select(
        F.concat(F.lit("https://u"), F.col("user_id"), F.lit(".example.com/"), F.when(F.col("value") > 50, F.concat(F.lit("p"), F.col("event_id") % 7)).otherwise("")).alias("url"), F.concat(F.lit("Feed "), F.col("event_type")).alias("source"),
        F.date_format(hour, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'").alias("last_seen"), F.lit(None).cast("string").alias("first_seen"), word.alias("status"), F.when(F.col("user_id") % 10 == 0, F.col("event_type")).otherwise("Brand").alias("brand"),
        F.when(F.col("value") > 30, F.concat(F.lit("C"), F.col("event_id") % 5)).alias("country"), F.lit(None).cast("string").alias("host"), F.array(F.sha2(F.col("event_type"), 256)).alias("hashes"), F.col("value").alias("confidence"),
        F.array(F.lit("manual-review"), F.when(F.col("value") > 90, "punycode").otherwise("not-a-code")).alias("reason_codes"), F.col("event_id").alias("seq"),
    )


@query(f"""WITH r AS (SELECT event_id AS seq, 'u' || user_id || '[.]example[.]com' AS domain, date_trunc('hour', ts) AS t, {_MAPPED_SQL} AS status, {_PRIORITY_SQL} AS pr, event_type,
  CASE WHEN user_id % 10 = 0 THEN event_type ELSE 'Brand' END AS brand, CASE WHEN value > 30 THEN 'C' || (event_id % 5) END AS country, CAST(floor(least(100, greatest(0, value)) + 0.5) AS INT) AS conf,
  'hxxps://u' || user_id || '[.]example[.]com' || CASE WHEN value > 50 THEN '/p' || (event_id % 7) ELSE '' END AS url, CASE WHEN value > 50 THEN 1 ELSE 0 END AS spec FROM events),
m AS (SELECT *, max(t) OVER w AS newest, count(country) OVER w AS filled FROM r WINDOW w AS (PARTITION BY domain ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT substr(sha256(domain), 1, 20) AS id, domain, strftime(min(t), '%Y-%m-%dT%H:%M:%S') AS first_seen, strftime(max(t), '%Y-%m-%dT%H:%M:%S') AS last_seen, arg_max(status, (t, pr, -seq)) AS status, max(brand) AS brand,
  arg_max(country, seq) FILTER (country IS NOT NULL AND (newest IS NULL OR t > newest OR filled = 0)) AS country, arg_max(url, (spec, -seq)) AS url, max(conf) AS confidence, count(DISTINCT event_type) AS sources
FROM m GROUP BY domain HAVING count(DISTINCT brand) = 1""")
def merge_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.prepare(_raw_events(spark, sf_dir), F.lit("2024-02-01T00:00:00Z").cast("timestamp"))
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    return merge.merge(rows).select("id", "domain", time("firstSeen").alias("first_seen"), time("lastSeen").alias("last_seen"), "status", "brand", "country", "url", "confidence", F.size("sources").cast("long").alias("sources"))


@query(f"""WITH r AS (SELECT event_id AS seq, 'u' || user_id || '[.]example[.]com' AS domain, date_trunc('hour', ts) AS t, CASE WHEN user_id % 10 = 0 THEN event_type ELSE 'Brand' END AS brand FROM events),
g AS (SELECT substr(sha256(domain), 1, 20) AS id, min(t) AS a, max(t) AS b FROM r GROUP BY domain HAVING count(DISTINCT brand) = 1)
SELECT id, row_number() OVER (ORDER BY b DESC, a DESC, id) AS place FROM g ORDER BY place LIMIT 40""")
def merge_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = merge.merge(merge.prepare(_raw_events(spark, sf_dir), F.lit("2024-02-01T00:00:00Z").cast("timestamp")), 40)
    listed = F.array_sort(F.collect_list(F.struct((-F.unix_micros("lastSeen")).alias("b"), (-F.unix_micros("firstSeen")).alias("a"), "id")))
    return rows.agg(listed.alias("x")).select(F.posexplode("x").alias("place", "x")).select("x.id", (F.col("place") + 1).cast("long").alias("place"))


@query(f"SELECT event_id, {_MAPPED_SQL} AS status, CAST(floor(least(100, greatest(0, value)) + 0.5) AS INT) AS confidence, {_PRIORITY_SQL} AS priority FROM events")
def status_and_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.create_map(*[F.lit(x) for p in _STATUS.items() for x in p]), F.col("event_type"))
    return _read(spark, sf_dir, "events").select("event_id", S.status(word).alias("status"), S.confidence(F.col("value")).alias("confidence"), S.priority(S.status(word)).alias("priority"))


# History

_EVENT_SQL = f"""SELECT event_id, substr(sha256('u' || user_id || '[.]example[.]com'), 1, 20) AS id, 'u' || user_id || '[.]example[.]com' AS domain, date_trunc('millisecond', ts) AS moment, {_MAPPED_SQL} AS status, event_type,
  CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'observation' ELSE 'status-transition' END AS kind, CAST(ts AS DATE) AS day FROM events"""


def _log(spark: SparkSession, sf_dir: str, events: DataFrame | None = None) -> DataFrame:
    """Events, of the table or a stream of it, as rows of an event log."""
    word = F.element_at(F.create_map(*[F.lit(x) for p in _STATUS.items() for x in p]), F.col("event_type"))
    domain = F.concat(F.lit("u"), F.col("user_id"), F.lit("[.]example[.]com"))
    return (_read(spark, sf_dir, "events") if events is None else events).select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("eventId"), S.short_id(domain).alias("signalId"), F.when(F.col("event_type").isin("view", "click", "signup"), "observation").otherwise("status-transition").alias("eventType"),
        F.date_trunc("millisecond", _utc("ts")).alias("observedAt"), domain.alias("domain"), F.lit("Brand").alias("brand"), F.array(F.col("event_type")).alias("sources"), S.status(word).alias("status"), F.lit(None).cast("string").alias("previousStatus"),
        F.lit(80).alias("confidence"), F.array(F.lit("manual-review")).alias("reasonCodes"), F.to_date("ts").alias("day"),
    )


def _fold_sql(where: str) -> str:
    return f"""SELECT id, domain, strftime(min(moment), '%Y-%m-%dT%H:%M:%S.%g') AS first_seen, strftime(max(moment), '%Y-%m-%dT%H:%M:%S.%g') AS last_seen, count(*) FILTER (kind = 'observation') AS observations, arg_max(status, (moment, event_id)) AS latest_status,
  least(16, count(*) FILTER (kind = 'status-transition')) AS transitions, least(64, count(*)) AS recent, count(DISTINCT event_type) AS sources FROM ({_EVENT_SQL}) WHERE {where} GROUP BY id, domain"""


def _shown_fold(rows: DataFrame) -> DataFrame:
    time = lambda c: F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    n = lambda c: F.size(c).cast("long")
    return rows.select("id", "domain", time("firstSeen").alias("first_seen"), time("lastSeen").alias("last_seen"), F.col("observationCount").cast("long").alias("observations"), F.col("latestStatus").alias("latest_status"), n("statusTransitions").alias("transitions"), n("recentEventIds").alias("recent"), n("sources").alias("sources"))


@query(_fold_sql("true"))
def history_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown_fold(history.fold(_log(spark, sf_dir)))


@query(_fold_sql("true"))
def history_fold_in_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fold that goes on from an earlier one, with one day folded again: replays count once."""
    log = _log(spark, sf_dir)
    first = history.fold(log.where("day <= '2024-01-15'"))
    return _shown_fold(history.fold(log.where("day > '2024-01-15'"), first))


@query(_fold_sql("day < DATE '2024-01-30' - 10 AND day > DATE '2024-01-05'"))
def history_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days out of the detail window and after the watermark are folded; days folded before change nothing."""
    folded, _ = history.compact(_log(spark, sf_dir), None, "2024-01-05", "2024-01-30", F.lit("2024-01-30T00:00:00Z").cast("timestamp"), detail_days=10)
    return _shown_fold(folded)


@query(f"SELECT max(day) AS watermark FROM ({_EVENT_SQL}) WHERE day < DATE '2024-01-30' - 10 AND day > DATE '2024-01-05'")
def history_watermark(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, mark = history.compact(_log(spark, sf_dir), None, "2024-01-05", "2024-01-30", F.lit("2024-01-30T00:00:00Z").cast("timestamp"), detail_days=10)
    return mark.select(F.col("compactedThrough").alias("watermark"))


@query("SELECT o_custkey AS id, unnest(CASE WHEN min(o_orderdate) = max(o_orderdate) THEN [min(o_orderdate)] ELSE [min(o_orderdate), max(o_orderdate)] END) AS at FROM orders GROUP BY 1")
def observation_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    ends = _read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("a"), F.max("o_orderdate").alias("b"))
    return ends.select("id", F.explode(F.array_distinct(F.array("a", "b"))).alias("at"))


@query(f"""WITH s AS (SELECT id, arg_max(status, (moment, event_id)) AS status FROM ({_EVENT_SQL}) GROUP BY id), p AS (SELECT id, arg_max(status, (moment, event_id)) AS was FROM ({_EVENT_SQL}) WHERE day <= DATE '2024-01-25' GROUP BY id)
SELECT s.id AS signal, status, was AS previous, CASE WHEN was IS NULL THEN 'first-publication' ELSE 'source-status-change' END AS reason FROM s LEFT JOIN p USING (id) WHERE status IS DISTINCT FROM was""")
def status_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _log(spark, sf_dir)
    now = history.fold(log).select("id", "domain", "brand", F.col("latestStatus").alias("status"), "firstSeen", "lastSeen", "sources", F.lit(80).alias("confidence"), "reasonCodes")
    before = history.fold(log.where("day <= '2024-01-25'")).select("id", "latestStatus")
    made = history.build_events(now.limit(0), now, before)
    return made.select(F.col("signalId").alias("signal"), "status", F.col("previousStatus").alias("previous"), F.element_at("reasonCodes", -1).alias("reason"))


@query(f"""SELECT event_id, substr(sha256('{{"eventType":"' || kind || '","observedAt":"' || strftime(moment, '%Y-%m-%dT%H:%M:%S.%gZ') || '","previousStatus":null,"schemaVersion":1,"signalId":"' || id || '","sources":["' || event_type || '"],"status":"' || status || '"}}'), 1, 32) AS identity FROM ({_EVENT_SQL})""")
def event_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    identity = S.event_id(signal=F.col("signalId"), kind=F.col("eventType"), at=S.shown_time(F.col("observedAt")), sources=F.col("sources"), status=F.col("status"), previous=F.col("previousStatus"))
    return _log(spark, sf_dir).select(F.col("eventId").cast("long").alias("event_id"), identity.alias("identity"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 5000)")
def append_new_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = _read(spark, sf_dir, "customer").where("c_acctbal < 5000").select(F.col("c_custkey").alias("o_custkey"))
    return _read(spark, sf_dir, "orders").join(stored, "o_custkey", "left_anti").select("o_orderkey", "o_custkey")


@query("""SELECT day, user_id AS id, min(event_id) AS event_id FROM (SELECT *, CAST(timezone('Europe/Vilnius', timezone('UTC', ts)) AS DATE) AS day FROM events) WHERE event_type <> 'error' GROUP BY ALL""")
def first_per_local_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").where("event_type <> 'error'").select(S.local_day(_utc("ts")).alias("day"), F.col("user_id").alias("id"), "event_id")
    return archives.append_new(rows, rows.limit(0), F.col("event_id"))


@query("""WITH a AS (SELECT user_id, list_sort(list_distinct(list(event_type))) AS sources, max(ts) AS last FROM events WHERE value > 60 GROUP BY user_id)
SELECT user_id, array_to_string(list_filter(sources, lambda x: x IN ('click', 'view')), ',') AS kept FROM a WHERE len(list_filter(sources, lambda x: x IN ('click', 'view'))) > 0 AND last >= TIMESTAMP '2024-01-24'""")
def retain_unrefreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilframe.plans.sync import retained

    old = _read(spark, sf_dir, "events").where("value > 60").groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("sources"), F.max(_utc("ts")).alias("lastSeen"))
    kept = retained(old, F.lit("2024-01-31T00:00:00Z").cast("timestamp"), 7, ["click", "view", "error", "signup"], ["click", "view", "error"], ["error"])
    return kept.select("user_id", F.array_join("sources", ",").alias("kept"))


# Limits, budgets, pages

@query("SELECT event_id FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-30' - 6 AND DATE '2024-01-30' ORDER BY CAST(ts AS DATE) DESC, event_id LIMIT 500")
def lookback_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", F.to_date("ts").alias("day"))
    return archives.recent(rows, F.lit("2024-01-30").cast("date"), 7, 500, [F.col("event_id")]).select("event_id")


@query("SELECT doc_id, used FROM (SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id) AS used FROM documents) WHERE used <= 500000")
def byte_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"))
    return views.within_budget(rows, F.col("bytes"), 500_000, [F.col("doc_id")], "used").select("doc_id", "used")


@query("SELECT c_custkey FROM customer ORDER BY c_acctbal DESC, c_custkey LIMIT 25 OFFSET 25")
def second_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.page(_read(spark, sf_dir, "customer"), [F.desc("c_acctbal"), F.col("c_custkey")], 2).select("c_custkey")


@query("SELECT c_custkey, CAST(floor((row_number() OVER (ORDER BY c_custkey) - 1) / 20) AS BIGINT) AS batch FROM customer")
def seed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hunt.numbered_batches(_read(spark, sf_dir, "customer").select("c_custkey"), ["c_custkey"], 20)


# Hunting

@query("""WITH h AS (SELECT doc_id, sha256(text) AS digest FROM documents), w AS (SELECT digest FROM h GROUP BY digest HAVING count(*) > 1)
SELECT digest, doc_id AS uuid FROM (SELECT digest, doc_id, row_number() OVER (PARTITION BY digest ORDER BY doc_id) AS n FROM h JOIN w USING (digest)) WHERE n <= 10""")
def hash_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("uuid"), F.col("doc_id").alias("pos"), F.array(F.sha2("text", 256)).alias("digests"))
    wanted = docs.select(F.explode("digests").alias("digest")).groupBy("digest").count().where("count > 1").select(F.lit("Brand").alias("brand"), "digest")
    return hunt.pivot_candidates(wanted, docs).select("digest", "uuid")


@query("""WITH f AS (SELECT event_id AS uuid FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 300)
SELECT event_id AS uuid FROM events WHERE value > 20 AND event_id NOT IN (SELECT uuid FROM f) ORDER BY event_id LIMIT 200""")
def phase_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two phases over one table: what the first fetched is not fetched again."""
    rows = _read(spark, sf_dir, "events").select(F.col("event_id").alias("uuid"), F.col("event_id").alias("pos"), "event_type", "value")
    details = rows.select("uuid")
    first = hunt.phase(rows.where("event_type = 'error'"), details, None, 300)
    return hunt.phase(rows.where("value > 20"), details, first, 200).select("uuid")


@query("SELECT event_id, CAST(CASE event_type WHEN 'error' THEN greatest(80, least(99, 95 + floor(greatest(0, CAST(floor(value) AS INT)) / 25))) WHEN 'click' THEN greatest(80, least(90, 80 + greatest(0, CAST(floor(value) AS INT)))) ELSE 80 END AS INT) AS confidence FROM events WHERE value < 100")
def verdict_boost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").where("value < 100").select("event_id", F.floor("value").cast("int").alias("score"), (F.col("event_type") == "error").alias("phishing"), (F.col("event_type") == "click").alias("malicious"))
    return rows.select("event_id", hunt.boosted(F.lit(80)).alias("confidence"))


# Review

_ACTIONS = ("false-positive", "restore", "allowlist", "unallowlist", "add")
_ACTION_SQL = "CASE event_type WHEN 'view' THEN 'false-positive' WHEN 'click' THEN 'restore' WHEN 'signup' THEN 'allowlist' WHEN 'purchase' THEN 'unallowlist' ELSE 'add' END"


def _ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    action = F.element_at(F.create_map(*[F.lit(x) for p in zip(("view", "click", "signup", "purchase", "error"), _ACTIONS, strict=True) for x in p]), F.col("event_type"))
    return _read(spark, sf_dir, "events").select(F.col("event_id").alias("sequence"), action.alias("action"), F.concat(F.lit("u"), F.col("user_id"), F.lit(".example.com")).alias("domain"), F.lit(None).cast("string").alias("brand"), F.lit("subdomains").alias("scope"))


@query(f"""SELECT domain, family, arg_max(action, sequence) AS action, max(sequence) AS sequence FROM (SELECT event_id AS sequence, 'u' || user_id || '.example.com' AS domain, {_ACTION_SQL} AS action,
  CASE WHEN event_type IN ('view', 'click') THEN 'suppression' WHEN event_type IN ('signup', 'purchase') THEN 'allow' ELSE 'addition' END AS family FROM events) GROUP BY domain, family HAVING arg_max(action, sequence) IN ('false-positive', 'allowlist', 'add')""")
def ledger_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.state(_ledger(spark, sf_dir)).select("domain", "family", "action", "sequence")


@query(f"SELECT page_id FROM pages WHERE NOT ({' OR '.join(f'({_HOST_SQL} = {s!r} OR suffix({_HOST_SQL}, {("." + s)!r}))' for s in ('tionsh.example.net', 'example.org'))}) AND {_HOST_SQL} <> 'www.ththhe.example.com'")
def drop_suppressed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scope ``subdomains`` covers what is below a host, scope ``exact`` just the host; a rule for another brand nothing."""
    rules = spark.createDataFrame([("tionsh.example.net", "subdomains", None), ("example.org", "subdomains", "Brand"), ("www.ththhe.example.com", "exact", None), ("example.com", "exact", None), ("example.net", "subdomains", "Other")], "domain string, scope string, brand string")
    rows = _read(spark, sf_dir, "pages").select("page_id", U.url_host(F.col("url")).alias("domain"), F.lit("Brand").alias("brand"))
    return review.drop_suppressed(rows, rules).select("page_id")


# Views

_CUSTOMERS_SQL = "SELECT c_custkey AS id, c_name AS domain, c_mktsegment AS brand, n_name AS country, CAST(least(100, greatest(0, c_acctbal / 100)) AS INT) AS confidence, CASE WHEN c_acctbal < 0 THEN 'offline' ELSE 'active' END AS status FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "customer").join(_read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    confidence = F.round(F.least(F.lit(100.0), F.greatest(F.lit(0.0), F.col("c_acctbal") / 100))).cast("int")
    return rows.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("domain"), F.col("c_mktsegment").alias("brand"), F.col("n_name").alias("country"), confidence.alias("confidence"), F.when(F.col("c_acctbal") < 0, "offline").otherwise("active").alias("status"), F.array(F.lower("c_mktsegment"), F.lit("feed")).alias("sources"))


@query(f"SELECT id FROM ({_CUSTOMERS_SQL}) WHERE (lower(domain) LIKE '%00012%' OR lower(brand) LIKE '%00012%' OR lower(country) LIKE '%00012%' OR lower(brand) LIKE '%00012%') AND status = 'active' AND confidence >= 20")
def filter_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.search(_customers(spark, sf_dir), " 00012", columns=("domain", "brand", "country"), facets={"status": "active", "country": "all"}, least=20).select("id")


@query(f"SELECT count(*) AS total, count(*) FILTER (status = 'active') AS active, count(*) FILTER (confidence >= 80) AS high_confidence, count(DISTINCT nullif(brand, '')) AS brands, count(DISTINCT nullif(country, '')) AS countries FROM ({_CUSTOMERS_SQL})")
def dashboard_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.metrics(_customers(spark, sf_dir))


@query(f"SELECT coalesce(country, 'Unknown') AS name, count(*) AS count FROM ({_CUSTOMERS_SQL}) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 5")
def top_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.top_groups(_customers(spark, sf_dir), "country")


@query(f"SELECT DISTINCT lower(brand) AS value FROM ({_CUSTOMERS_SQL}) UNION SELECT 'feed'")
def source_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.facets(_customers(spark, sf_dir), "sources", listed=True)


@query(f"SELECT lower(brand) AS source, count(*) AS records FROM ({_CUSTOMERS_SQL}) GROUP BY 1 UNION ALL SELECT 'feed', count(*) FROM ({_CUSTOMERS_SQL})")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.source_counts(_customers(spark, sf_dir))


@query(f"SELECT CAST(sum(observations) AS BIGINT) AS observations, CAST(sum(transitions) AS BIGINT) AS transitions FROM ({_fold_sql('true')})")
def history_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.history_totals(history.fold(_log(spark, sf_dir)))


# Health

@query("""SELECT event_id, CASE WHEN minute(ts) >= 32 THEN date_trunc('hour', ts) + INTERVAL 32 MINUTE WHEN minute(ts) >= 2 THEN date_trunc('hour', ts) + INTERVAL 2 MINUTE ELSE date_trunc('hour', ts) - INTERVAL 1 HOUR + INTERVAL 32 MINUTE END AS slot FROM events""")
def schedule_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", health.scheduled_slot(F.col("ts"), F.array(F.lit(2), F.lit(32))).cast("timestamp_ntz").alias("slot"))


@query("SELECT event_id, CASE WHEN age <= 86400 THEN 'current' ELSE 'stale' END AS status, age FROM (SELECT event_id, greatest(0, CAST(epoch(TIMESTAMP '2024-01-30 12:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT)) AS age FROM events)")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", health.freshness(_utc("ts"), F.lit("2024-01-30T12:00:00Z").cast("timestamp"), 86_400).alias("f"))
    return rows.select("event_id", "f.status", F.col("f.ageSeconds").alias("age"))


@query("""SELECT user_id, CASE WHEN count(*) FILTER (event_type = 'error') > 20 THEN 'failed' WHEN count(*) FILTER (event_type = 'view') = 0 THEN 'no-input' WHEN count(*) < 54 THEN 'partial' WHEN count(*) FILTER (value > 200) = 0 THEN 'healthy-empty' ELSE 'healthy-matches' END AS outcome FROM events GROUP BY user_id""")
def collection_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = lambda k: F.count_if(F.col("event_type") == k)
    rows = _read(spark, sf_dir, "events").groupBy("user_id").agg(kind("view").alias("m"), F.count_if(F.col("value") > 200).alias("x"), F.count("*").alias("n"), kind("error").alias("e"))
    return rows.select("user_id", health.outcome(F.col("m"), F.col("x"), F.col("n"), F.lit(60), F.col("e") > 20).alias("outcome"))


# Display

@query("""SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago'
  ELSE (s // 86400) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' END AS age, CASE WHEN value >= 80 THEN 'high' WHEN value >= 50 THEN 'medium' ELSE 'low' END AS bucket, s > 7200 AS stale
  FROM (SELECT *, greatest(0, CAST(epoch(TIMESTAMP '2024-01-31 00:00:00') AS BIGINT) - CAST(floor(epoch(ts)) AS BIGINT)) AS s FROM events)""")
def shown_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = F.lit("2024-01-31T00:00:00Z").cast("timestamp")
    return _read(spark, sf_dir, "events").select("event_id", D.relative_time(_utc("ts"), now).alias("age"), D.confidence_bucket(F.col("value")).alias("bucket"), D.stale(_utc("ts"), now).alias("stale"))


@query("SELECT n_name, upper(lower(n_name)[1]) || lower(n_name)[2:] AS title, count(*) AS customers FROM nation JOIN customer ON n_nationkey = c_nationkey GROUP BY ALL")
def sentence_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "nation").join(_read(spark, sf_dir, "customer"), F.col("n_nationkey") == F.col("c_nationkey"))
    return rows.groupBy("n_name").agg(F.count("*").alias("customers")).select("n_name", D.sentence_case(F.lower("n_name")).alias("title"), "customers")


# JSON

@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return rows.select("event_id", archives.whole(F.col("v"), "k").alias("k"))


@query("SELECT event_id FROM events WHERE json_keys(props) = ['k'] AND json_type(props, '$.k') = 'UBIGINT' AND CAST(json_extract(props, '$.k') AS BIGINT) BETWEEN 10 AND 60")
def closed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").alias("v"))
    return rows.where(archives.same_keys(F.col("v"), ["k"]) & archives.whole(F.col("v"), "k").between(10, 60)).select("event_id")


# Streams

@query("SELECT user_id, CAST(ts AS DATE) AS day, event_type FROM events GROUP BY ALL")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = spark.readStream.schema(_read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumns({"ts": _utc("ts"), "day": F.to_date("ts")})
    return certificates.drain(certificates.deduplicated(stream, ["user_id", "day", "event_type"], late="40 days").select("user_id", "day", "event_type"), _name("dedupe"))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def stream_daily_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    stream = spark.readStream.schema(_read(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*").withColumn("ts", _utc("ts"))
    return certificates.drain(certificates.daily_counts(stream), _name("counts"), "complete").withColumn("total", F.round("total", 2))


def _name(kind: str) -> str:
    import uuid

    return f"{kind}_{uuid.uuid4().hex}"


def entry(spark: SparkSession) -> DataFrame:
    return host_groups(spark, "/root/testdata/sf0.001")

