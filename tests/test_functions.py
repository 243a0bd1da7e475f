from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from vigilframe.functions import hosts as H
from vigilframe.functions import signals as S
from vigilframe.functions import text as T
from vigilframe.functions import urls as U


def values(spark, inputs, *columns):
    rows = spark.createDataFrame(list(enumerate(inputs)), "i int, x string").select("i", *[c.alias(f"c{k}") for k, c in enumerate(columns)])
    return [tuple(r)[1:] if len(columns) > 1 else r[1] for r in sorted(rows.collect())]


URLS = {
    "https://Example.com/login?token=1#x": ("hxxps://example[.]com/login", "example[.]com"),
    "hxxp://a[.]example.test": ("hxxp://a[.]example[.]test", "a[.]example[.]test"),
    "example.test/": ("hxxps://example[.]test", "example[.]test"),
    "http://example.test:8080/a/b/": ("hxxp://example[.]test:8080/a/b/", "example[.]test"),
    "https://user:pw@example.test/": (None, None),
    "javascript:alert(1)": (None, None),
    "ftp://example.test/x": (None, None),
    "https://192.0.2.1/x": ("hxxps://192[.]0[.]2[.]1/x", "192[.]0[.]2[.]1"),
    "https://[2001:db8::1]/x": ("hxxps://2001[:]db8[:][:]1/x", "2001[:]db8[:][:]1"),
    "https://bücher.example/": ("hxxps://xn--bcher-kva[.]example", "xn--bcher-kva[.]example"),
    "https://example.test/go/https://other.test/x": ("hxxps://example[.]test/go/embedded-url-redacted", "example[.]test"),
    "https://example.test/a@b.test/x": ("hxxps://example[.]test/redacted/x", "example[.]test"),
    "https://example.test/token/abc/x": ("hxxps://example[.]test/token/redacted/x", "example[.]test"),
    "https://example.test/id=7;v=2/x": ("hxxps://example[.]test/redacted/x", "example[.]test"),
    "https://example.test/%2574oken/abc": ("hxxps://example[.]test/token/redacted", "example[.]test"),
    "https://example.test/0123456789abcdef0123456789abcdef": ("hxxps://example[.]test/redacted", "example[.]test"),
    "https://example.test/+370 600 12345": ("hxxps://example[.]test/redacted", "example[.]test"),
    "https://example.test/short-slug": ("hxxps://example[.]test/short-slug", "example[.]test"),
    "https://example.test/see/other.test": ("hxxps://example[.]test/see/other[.]test", "example[.]test"),
    "": (None, None),
    None: (None, None),
}


def test_safe_urls(spark):
    u = U.safe_url(F.col("x"))
    assert dict(zip(URLS, values(spark, list(URLS), u["display_url"], u["display_domain"]), strict=True)) == URLS


def test_plain_paths_need_no_redaction(spark):
    paths = {"": "", "/": "", "/a": "/a", "/a/b2/": "/a/b2/", "/user/x": "/user/redacted", "/Token": "/Token", "/to-ken/x": "/to-ken/redacted", "/key//x": "/key//redacted", "/a+b": "/a+b", "/50%zz": "/50%zz", "/é x": "/%C3%A9%20x", "/a%20b": "/a%20b", "/x;token;7/y": "/redacted/y"}
    keys = {"/": "", "/é x": "/%C3%A9%20x"}
    for tail in ("", "?a=1", "#z"):
        u = U.safe_url(F.col("x"))
        got = values(spark, [f"http://a.test{p}{tail}" for p in paths], u["key"], u["display_url"])
        assert got == [(f"http://a.test{keys.get(p, p)}", f"hxxp://a[.]test{shown}") for p, shown in paths.items()]


def test_ports_and_host_forms(spark):
    cases = {"http://a.test:80": "hxxp://a[.]test:80", "http://a.test:": "hxxp://a[.]test", "http://a.test:99999": None, "http://a.test:x": None, "http://a..test": None, "http://a.test./": "hxxp://a[.]test[.]", "http://[::1": None, "http://[1:2]/": None, "HTTP://A.TEST": "hxxp://a[.]test", "http://" + "a" * 64 + ".test": None}
    assert values(spark, list(cases), U.safe_url(F.col("x"))["display_url"]) == list(cases.values())


def test_ipv6(spark):
    import ipaddress

    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "1::2::3", ":::", ":1::2", "1::2:", "12345::", "g::1", "::ffff:192.0.2.1", "::256.0.0.1", "10:30", "fe80::a:b"]

    def valid(x):
        try:
            return ipaddress.ip_address(x).version == 6
        except ValueError:
            return False

    assert values(spark, texts, T.is_ipv6(F.col("x"))) == [valid(x) for x in texts]


@pytest.mark.parametrize(("text", "clean"), [("  a\x00b​c   d\n", "a bc d"), ("", None), ("  　 ", None), ("x" * 9, "x" * 5)])
def test_clean_text(spark, text, clean):
    assert values(spark, [text], T.clean_text(F.col("x"), 6 if clean and len(clean) > 5 else 5 if text[:1] == "x" else 60))[0] == clean


def test_safe_host(spark):
    got = values(spark, ["AS64500 · 192.0.2.10", "2001:db8::4 node", "node.provider.example", "at 10:30", None], T.safe_host(F.col("x")))
    assert got == ["AS64500 · 192[.]0[.]2[.]10", "2001[:]db8[:][:]4 node", "node[.]provider[.]example", "at 10:30", None]


def test_domains(spark):
    cases = {" *.Example.COM. ": "example.com", "bücher.example": "xn--bcher-kva.example", "localhost": None, "a..b": None, "-a.test": None, "a_b.test": None, "x" * 64 + ".test": None, "a:b.test": None, "": None}
    assert values(spark, list(cases), H.normalize_domain(F.col("x"))) == list(cases.values())


def test_canonical(spark):
    assert values(spark, ["Ra-di_o1", "ѕwеdbаnk", "Crédit", "ﬁne", ""], H.canonical(F.col("x"))) == ["radio1", "swedbank", "credit", "fine", ""]


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_one_edit_equals_the_distance(spark):
    from itertools import product

    words = ["".join(p) for n in range(5) for p in product("abc", repeat=n)]
    pairs = [(a, b) for a in words[:60] for b in words]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", H.one_edit(F.col("a"), F.col("b")).alias("e"), F.arrays_overlap(H.deletions(F.col("a")), H.deletions(F.col("b"))).alias("k"))
    for a, b, edit, key in rows.collect():
        assert edit == (osa(a, b) == 1), (a, b)
        assert key or osa(a, b) > 1


def test_codes_statuses_and_confidence(spark):
    assert values(spark, ["Live", " pending ", "down", "takedown", "?", None], S.status(F.col("x"))) == ["active", "suspected", "offline", "mitigated", "unknown", "unknown"]
    assert values(spark, ["77.5", "-3", "101", "NaN", None, "0.49"], S.confidence(F.col("x").cast("double"))) == [78, 0, 100, 50, 50, 0]
    listed = F.split("x", ",")
    assert values(spark, ["punycode,x,punycode,manual-review", ""], S.reasons(listed)) == [["punycode", "manual-review"], []]
    digest = "AB" * 32
    assert values(spark, [f"{digest},{digest.lower()},junk,{S.NO_CONTENT}"], S.hashes(listed)) == [[digest.lower()]]
    assert values(spark, ["title,domain,other"], S.evidence_reasons(listed)) == [["brand-title-match", "brand-domain-match"]]


def test_times(spark):
    day = S.local_day(F.to_timestamp("x"))
    assert [str(v) for v in values(spark, ["2026-08-21T20:59:59Z", "2026-08-21T21:00:00Z", "2026-01-21T22:00:00Z"], day)] == ["2026-08-21", "2026-08-22", "2026-01-22"]
    assert [v is None for v in values(spark, ["2026-08-21T20:59:59.000Z", "2026-08-21T20:59:59Z", "2026-13-21T20:59:59.000Z"], S.canonical_time(F.col("x")))] == [False, True, True]


def test_reports_are_allow_listed(spark):
    uuid = "01234567-89ab-cdef-0123-456789abcdef"
    cases = {f"https://reports.test/shots/{uuid}.png?x=1": f"https://reports.test/shots/{uuid}.png", f"http://reports.test/shots/{uuid}.png": None, f"https://evil.test/shots/{uuid}.png": None, "https://reports.test/shots/x.png": None}
    assert values(spark, list(cases), U.allowed_report(F.col("x"), "reports.test", "/shots/", ".png")) == list(cases.values())


def test_clean_text_by_the_short_way(spark):
    """Plain words need no replacing; what is not plain is still cleaned."""
    values = {"a b": "a b", " a": "a", "a ": "a", "a  b": "a b", "a\n": "a", "a\tb": "a b", "": None, " ": None, "é​ x": "é x", "a b": "a b", "abcdefgh": "abcdef", "­a": "a", "ab cde f": "ab cde"}
    rows = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string").select("v", T.clean_text(F.col("v"), 6).alias("c"))
    assert {r["v"]: r["c"] for r in rows.collect()} == values | {None: None}
