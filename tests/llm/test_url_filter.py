import pytest

from sparkmill.llm import url_filter
from sparkmill.llm.queries import URL_RULES

SCHEMA = "page_id long, url string, host string, block int"
URLS = [
    None, "", "no scheme", "http://", "HTTP://A.Example.COM/En/x?q#f", "https://example.com/en/1", "https://www.example.com/en/1", "https://x.www.example.com/en/", "http://badexample.com/en/1", "ftp://site.net/es/a", "ftp://NET/fr/",
    "http://site.net/de/es/", "http://É.net/fr/é?x", "a://b://c/d", "http://u:p@h.com:80/x#y?z", "http://h.com?x=/a", "http://h.com#/a", "://net/es/", "http://www.twice.org/a//", "https://twice.org/a", "http://com", "x\n://y.com/\n",
]


def plain(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = url.partition("://")[2]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]


def canonical(host, path):
    return host.removeprefix("www.") + path.rstrip("/")


def verdict(host, path, listed):
    fit = [(h + p, v) for v, h, p in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fit:
        return max(fit, key=lambda x: len(x[0]))
    return None, "block" if canonical(host, path) in listed else "allow"


def test_verdicts(spark):
    rows = [(i, u, "h", 1) for i, u in enumerate(URLS)] + [(3, URLS[5], "h", 1), (None, URLS[4], "h", 1)]
    listed = ["twice.org/a", "h.com/x", None, "", "u:p@h.com:80/x", "twice.org/a", "never.org"] + [f"filler{i}.org" for i in range(500)]
    out = url_filter.url_filter(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame([(x,) for x in listed], "key string"), URL_RULES).collect()
    want = []
    for i, u, *_ in rows:
        host, path = plain(u)
        rule, v = verdict(host, path, {x for x in listed if x})
        want.append((str(i), host, path, str(rule), v))
    assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in out) == sorted(want)


@pytest.mark.parametrize("bytes_", [0, 8 << 20])
def test_filter_has_no_false_negatives_and_few_false_positives(spark, monkeypatch, bytes_):
    monkeypatch.setattr(url_filter, "BROADCAST_BYTES", bytes_)
    listed = spark.createDataFrame([(f"a{i}.org/x",) for i in range(3000)], "key string")
    pages = spark.createDataFrame([(i, f"http://a{i}.org/x") for i in range(9000)], "page_id long, url string")
    out = url_filter.url_filter(pages, listed, ())
    assert {r.page_id for r in out.where("listed").collect()} == set(range(3000))
    assert out.where("verdict = 'block'").count() == 3000


def test_no_rows(spark):
    empty, keys = spark.createDataFrame([], SCHEMA), spark.createDataFrame([], "key string")
    assert url_filter.url_filter(empty, keys, URL_RULES).collect() == []
    assert url_filter.url_filter(spark.createDataFrame([(1, "http://x.org/", "", 1)], SCHEMA), keys, ()).first().verdict == "allow"
