"""Public suffixes: what of a host was registered, by a table of rules.

A rule is a suffix (``co.uk``), a wildcard for one more label (``*.ck``) or an exception
to a wildcard (``!www.ck``).  The longest rule that a host ends in decides, an exception
before all others.  Hosts meet the rules by equality: each of a host's ancestors, and
each with its first label as a wildcard, is looked up.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilframe.functions.hosts import ancestors


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """``rule`` of each line of a list; blank lines and those that begin with ``//`` are comments, private rules count too."""
    line = F.lower(F.regexp_extract("value", r"^\s*(\S*)", 1))
    return spark.read.text(path).select(line.alias("rule")).where("rule <> '' and rule not like '//%'").distinct()


def rule_table(spark: SparkSession, rules: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(r,) for r in sorted(set(rules))], "rule string")


def suffix_sizes(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """``(host, suffix_n)`` for the distinct hosts that end in a rule: the labels of their public suffix."""
    sizes = rules.select(F.regexp_replace("rule", "^!", "").alias("rule"), F.startswith("rule", F.lit("!")).alias("_but"))
    known = hosts.select(F.col(host).alias("host")).where("host is not null").distinct()
    spread = known.select("host", F.explode(ancestors(F.col("host"))).alias("name")).withColumn("n", F.size(F.split("name", r"\.")))
    wild = F.when(F.col("n") > 1, F.concat(F.lit("*."), F.regexp_extract("name", r"^[^.]*\.(.*)$", 1)))
    asked = spread.select("host", "n", F.explode(F.array_compact(F.array("name", wild))).alias("rule"))
    met = asked.join(sizes, "rule")
    best = met.groupBy("host").agg(F.max_by(F.when(F.col("_but"), F.col("n") - 1).otherwise(F.col("n")), F.struct("_but", "n")).alias("suffix_n"))
    return best


def registrable(hosts: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """``hosts`` with ``suffix`` and ``registrable``: the suffix and the label before it.

    A host that ends in no rule, or is a suffix itself, is its own registrable name, and
    has no suffix in the first case.  A null host gives nulls.
    """
    sizes = suffix_sizes(hosts, rules, host).withColumnRenamed("host", "_of")
    own, n = F.col(host), F.col("suffix_n")
    last = lambda k: F.call_function("substring_index", own, F.lit("."), -k)
    out = hosts.join(sizes, own == F.col("_of"), "left")
    return out.withColumns({"suffix": F.when(n.isNotNull(), last(n)), "registrable": F.when(n.isNull(), own).otherwise(last(n + 1))}).drop("_of", "suffix_n")
