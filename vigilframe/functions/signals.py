"""Times, codes, statuses and identifiers of signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reason codes, in the order in which they are documented.
REASONS = (
    "brand-domain-match brand-title-match provider-verdict primary-html-hash-pivot brand-exact-token brand-joined-affix brand-split-token "
    "brand-lookalike-edit suspicious-context punycode different-tld multiple-hyphens partner-public-export manual-review first-publication source-status-change"
).split()
#: Kinds of evidence and the reasons that they give.
EVIDENCE = {"domain": "brand-domain-match", "title": "brand-title-match", "verdict": "provider-verdict", "primary-html-sha256": "primary-html-hash-pivot"}
#: The words of feeds for a status, and which status wins at equal times.
STATUSES = {"active": "active confirmed live online verified", "suspected": "potential pending suspected", "offline": "down inactive offline", "mitigated": "mitigated removed takedown"}
PRIORITY = {"active": 5, "suspected": 4, "unknown": 3, "offline": 2, "mitigated": 1}
#: Fixed value: the digest of no content, which says nothing.
NO_CONTENT = "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
CANONICAL = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d\.\d{3}Z$"


def short_id(value: Column, n: int = 20) -> Column:
    return F.left(F.sha2(value, 256), F.lit(n))


def shown_time(value: Column) -> Column:
    return F.date_format(value, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def canonical_time(value: Column) -> Column:
    """The timestamp of a canonical text (milliseconds, Z); else null."""
    return F.when(value.rlike(CANONICAL), F.try_to_timestamp(value))


def parsed_time(value: Column, fallback: Column) -> Column:
    return F.coalesce(F.date_trunc("millisecond", F.try_to_timestamp(F.nullif(value, F.lit("")))), fallback)


def local_day(time: Column, zone: str = "Europe/Vilnius") -> Column:
    """Calendar day of a UTC time in a zone."""
    return F.to_date(F.from_utc_timestamp(time.cast("timestamp"), zone))


def status(value: Column) -> Column:
    word = F.lower(F.trim(value))
    out = F.lit(None)
    for name, words in STATUSES.items():
        out = F.coalesce(out, F.when(word.isin(words.split()), name))
    return F.coalesce(out, F.lit("unknown"))


def priority(status_: Column) -> Column:
    return F.coalesce(*[F.when(status_ == s, n) for s, n in PRIORITY.items()])


def confidence(value: Column) -> Column:
    """0..100, halves rounded up; 50 when not given or not finite."""
    known = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    return F.when(known, F.floor(F.least(F.lit(100.0), F.greatest(F.lit(0.0), value)) + 0.5)).otherwise(50).cast("int")


def hashes(values: Column) -> Column:
    """The first eight distinct SHA-256 digests, lower case, that of no content aside."""
    good = F.filter(values, lambda x: x.rlike("(?i)^[a-f0-9]{64}$") & (F.lower(x) != NO_CONTENT))
    return F.coalesce(F.slice(F.array_distinct(F.transform(good, F.lower)), 1, 8), F.array().cast("array<string>"))


def reasons(values: Column) -> Column:
    """Known reason codes, distinct in order, sixteen at most."""
    return F.slice(F.array_distinct(F.filter(F.coalesce(values, F.array().cast("array<string>")), lambda x: x.isin(REASONS))), 1, 16)


def evidence_reasons(values: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in EVIDENCE.items() for x in pair])
    return reasons(F.transform(values, lambda x: F.element_at(pairs, x)))


def event_id(*, signal: Column, kind: Column, at: Column, sources: Column, status: Column, previous: Column, n: int = 32) -> Column:
    """Digest of the canonical JSON of what makes an event the same event."""
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    text = F.concat(
        F.lit('{"eventType":'), quoted(kind), F.lit(',"observedAt":'), quoted(at), F.lit(',"previousStatus":'), F.coalesce(quoted(previous), F.lit("null")),
        F.lit(',"schemaVersion":1,"signalId":'), quoted(signal), F.lit(',"sources":'), F.to_json(sources), F.lit(',"status":'), quoted(status), F.lit("}"),
    )
    return short_id(text, n)
