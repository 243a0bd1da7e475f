"""URL rules against plain code."""

from __future__ import annotations

import random
import re

import pytest

from vigilframe.llm import url_filter

RULES = "host string, path string, verdict string"


def plain(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3 :]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fit = [(len(h + p), len(h), v, h + p) for h, p, v in rules if None not in (h, p, v) and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fit)[3], max(fit)[2]) if fit else (host, path, None, default)


def urls(spark, rows):
    """Pages with further columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, u, "h", "p", "r", "v", 1) for i, u in rows], "page_id long, url string, host string, path string, rule string, digest string, length int")


@pytest.mark.parametrize("few", [20_000, 3])
def test_judged_as_plain_code(spark, monkeypatch, few):
    monkeypatch.setattr(url_filter, "FEW_RULES", few)
    rng = random.Random(1)
    labels, steps = ["a", "b", "com", "org", ""], ["/", "/x", "/x/", "/xy", "", "/é", "?q=/x", "#/x"]
    made = lambda some, n: "".join(rng.choice(some) for _ in range(rng.randint(0, n)))
    host = lambda: ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))
    rules = sorted({(host(), made(steps[:6], 3), rng.choice(["allow", "block"])) for _ in range(60)})
    rules += [(None, "/", "block"), ("a", None, "block"), ("b", "/", None), ("com", "/x", "allow"), ("com", "/x", "block")]
    rows = [(i, f"{rng.choice(['http', 'HTTPS', ''])}://{host().upper()}{made(steps, 4)}") for i in range(300)]
    rows += [(1000, None), (1001, ""), (1002, "a.com/x"), (1003, "://"), (1004, "x://com/x://org/y"), (1005, "a\nb://com/x\ny?z"), (None, "http://com/x"), (1006, "http://com/x"), (1006, "http://com/x"), (1007, "http://" + "a." * 5_000 + "com/x/y"), (1008, "http://Ä.ÖRG/x" + "/é" * 20_000), (1009, "http://com:80/x"), (1010, "http://com./x")]
    got = url_filter.judge(urls(spark, rows), spark.createDataFrame(rules, RULES)).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r) for r in got), key=key) == sorted(((i, *plain(u, rules)) for i, u in rows), key=key)


def test_without_rules_or_urls(spark):
    none = spark.createDataFrame([], RULES)
    assert [tuple(r) for r in url_filter.judge(urls(spark, [(1, "http://A/b")]), none, default="block").collect()] == [(1, "a", "/b", None, "block")]
    assert url_filter.judge(urls(spark, []), spark.createDataFrame([("a", "/", "block")], RULES)).count() == 0


def test_no_python_in_the_plan(spark, tmp_path):
    rows = urls(spark, [(1, "http://a/b")])
    plan = url_filter.judge(rows, spark.createDataFrame([("a", "/", "block")], RULES))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas|Cartesian|NestedLoop", plan)
