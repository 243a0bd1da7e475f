"""Registrable domains against plain code."""

from __future__ import annotations

import random

from vigilframe.functions import suffixes


def plain(host, rules):
    """Walks a host's ancestors from the longest on."""
    if host is None:
        return None, None
    labels = host.split(".")
    fit = []
    for i in range(len(labels)):
        name, above = ".".join(labels[i:]), ".".join(labels[i + 1 :])
        if "!" + name in rules:
            fit.append((2, len(labels) - i - 1))
        if name in rules or (above and "*." + above in rules):
            fit.append((1, len(labels) - i))
    n = max(fit)[1] if fit else None
    if n is None:
        return None, host
    return ".".join(labels[len(labels) - n :]), ".".join(labels[max(0, len(labels) - n - 1) :])


def test_registrable_domains_equal_plain_code(spark, tmp_path):
    rng = random.Random(4)
    rules = {"com", "co.uk", "uk", "*.ck", "!www.ck", "*.kobe.jp", "!city.kobe.jp", "jp", "a.b.c", "blogspot.com"}
    labels = ["a", "b", "c", "com", "co", "uk", "ck", "www", "kobe", "jp", "city", "blogspot", "unknown"]
    hosts = [None, "ck", "www.ck", "x.www.ck", "y.x.ck", "city.kobe.jp", "z.city.kobe.jp", "q.w.e.kobe.jp", "localhost"]
    hosts += [".".join(rng.choice(labels) for _ in range(rng.randint(1, 5))) for _ in range(400)]
    rows = spark.createDataFrame([(i, h, "x") for i, h in enumerate(hosts)], "i int, host string, rule string")
    got = suffixes.registrable(rows, suffixes.rule_table(spark, rules)).collect()
    assert {r["i"]: (r["suffix"], r["registrable"]) for r in got} == {i: plain(h, rules) for i, h in enumerate(hosts)} and len(got) == len(hosts)
    (tmp_path / "rules").write_text("// comment\n\ncom // of companies\nCo.UK\n*.ck\n!www.ck\n")
    assert sorted(r["rule"] for r in suffixes.read_rules(spark, str(tmp_path / "rules")).collect()) == ["!www.ck", "*.ck", "co.uk", "com"]


def test_without_rules_or_hosts(spark):
    rows = spark.createDataFrame([("a.b",)], "host string")
    assert suffixes.registrable(rows, suffixes.rule_table(spark, [])).first()["registrable"] == "a.b"
    assert suffixes.registrable(rows.limit(0), suffixes.rule_table(spark, ["b"])).count() == 0
