"""URL filters: host-suffix and path-prefix expressions met with a rule table by hash prefixes.

A rule is a host and a path; it fits an address whose host is the rule's or below it
and whose path starts with the rule's.  The longest rule that fits decides.

Addresses meet the rules in two equality joins.  First each host is expanded into its
suffixes of whole labels, which meet the rules' hosts; a listed host brings the lengths
that its rules' paths have.  Then each expression of a suffix and a path prefix of one
of those lengths meets the rules.  Both joins are on the first hex digits of a digest,
confirmed by the whole digest.  So hosts that no rule names end in the first join, and
no address is compared with the rules one by one, however many share a host.

Only built-in functions are used.  A side of rules is broadcast only if its counted rows
are few; otherwise rules are repeated over salts, so that an expression that many
addresses share is spread over tasks.

Null and malformed addresses (without ``://``) have an empty host and path.  An empty
path starts with no rule's path but an empty one.  Rules with a null host, path or
verdict do not count; of equal rules, ``block`` wins; among rules of one length, the
longer host.  Every row of the input gives one row, repeated rows included; other
columns are not read.  Without rules, every address gets the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.llm.common import table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Hex digits of a digest that the joins meet on, and the repeats of a rule set too large to broadcast.
PREFIX, SALTS = 8, 16
#: Rules at most of a broadcast side.
FEW_RULES = 20_000


def host_of(url: Column) -> Column:
    """The part after the first ``://`` up to ``/``, ``?`` or ``#``, with A-Z in lower case."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """The part after the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def _met(expressions: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows of ``expressions(digest, ...)`` with those of ``rules(digest, ...)`` of the same digest.

    They meet on the digest's first digits; the whole digests confirm.
    """
    short = F.left("digest", F.lit(PREFIX)).alias("_short")
    listed, looked, keys = rules.withColumnRenamed("digest", "_digest").select("*", F.left("_digest", F.lit(PREFIX)).alias("_short")), expressions.select("*", short), ["_short"]
    if rules.limit(FEW_RULES + 1).count() <= FEW_RULES:
        listed = F.broadcast(listed)
    else:
        listed = listed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        looked = looked.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(SALTS)).cast("int"))
        keys.append("_salt")
    return looked.join(listed, keys).where("digest = _digest").drop("_digest", *keys)


def judge(urls: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``(id, host, path, rule, verdict)`` for every row of ``urls``.

    ``rules(host, path, verdict)`` with verdicts ``allow`` and ``block``.
    """
    usable = rules.select(F.col("host").cast("string"), F.col("path").cast("string"), F.col("verdict").cast("string")).dropna()
    usable = usable.groupBy(F.translate("host", UPPER, LOWER).alias("host"), "path").agg(F.max("verdict").alias("verdict"))
    labels = usable.agg(F.max(F.regexp_count("host", F.lit(r"\."))).alias("n")).first()["n"]
    # A host's rules bring the lengths of their paths: as many rows as lengths that differ.
    hosts = usable.groupBy(F.sha2("host", 256).alias("digest"), F.char_length("path").alias("length")).agg(F.lit(1).alias("_one")).drop("_one")
    whole = usable.select(F.sha2(F.concat("host", "path"), 256).alias("digest"), F.concat("host", "path").alias("rule"), F.char_length("host").alias("host_chars"), "verdict")

    rows = urls.select(F.col(id_col).alias("_id"), F.col(url_col).cast("string").alias("url"))
    parsed = rows.select("url").withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    # No rule has more labels than ``labels + 1``, so no longer suffix can fit.
    depth = F.least(F.regexp_count("host", F.lit(r"\.")), F.lit(labels or 0)) + 1
    suffixes = F.transform(F.sequence(F.lit(1), depth), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    spread = parsed.where("url is not null").select("url", "path", F.explode(suffixes).alias("suffix")).withColumn("digest", F.sha2("suffix", 256))
    listed = _met(spread, hosts).where(F.col("length") <= F.char_length("path"))
    expressions = listed.select("url", F.sha2(F.concat("suffix", F.left("path", F.col("length"))), 256).alias("digest"))
    fitting = _met(expressions, whole)
    rank = F.struct(F.char_length("rule"), "host_chars", "verdict")
    decided = fitting.groupBy("url").agg(F.max_by(F.struct("rule", "verdict"), rank).alias("_won"))
    out = rows.join(decided, "url", "left")
    return out.select(
        F.col("_id").alias(id_col),
        host_of(F.col("url")).alias("host"),
        path_of(F.col("url")).alias("path"),
        F.col("_won.rule").alias("rule"),
        F.coalesce("_won.verdict", F.lit(default)).alias("verdict"),
    )


#: The rules of the query, as host, path and verdict.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)).toDF("host", "path", "verdict")
    return judge(table(spark, sf_dir, "pages"), rules)


OP11_SQL = """
WITH rules(host, path, verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
rest AS (SELECT row_number() OVER () AS k, page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
parsed AS (SELECT k, page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
fit AS (SELECT k, max_by(r.host || r.path, length(r.host || r.path)) AS rule, max_by(r.verdict, length(r.host || r.path)) AS verdict
  FROM parsed p JOIN rules r ON (p.host = r.host OR ends_with(p.host, '.' || r.host)) AND starts_with(p.path, r.path) GROUP BY k)
SELECT page_id, host, path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict FROM parsed LEFT JOIN fit USING (k)
"""
