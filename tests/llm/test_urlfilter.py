"""Rules and URL parts against plain Python; mined rules against counting all combinations."""

import itertools
import random
import re

import pytest
from helpers import rows as sorted_rows
from llm_helpers import found

from snaplog.llm import urlfilter

URLS = [
    None, "", "no scheme", "http://", "http://a.net", "http://a.net/", "HTTP://A.NET/x?y#z", "x://net/", "http://xnet/", "http://example.net/en/1", "http://Sub.Example.NET/en/", "http://example.net/EN/", "http://example.com/de/2", "http://a.example.com/de",
    "http://example.com/fr/", "http://my.org/fr/x", "http://org/fr/", "http://example.org/fr/#q", "http://example.org?/fr/", "a://b://c.net/d", "http://u@h.net:80/p", "http://ÄB.net/x", "http://net/\n/y", "//x.net/", "http:///path", "http://example.net/en",
]


def parts(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in urlfilter.RULES if (host == (h := r.split("/")[0]) or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return host, path, max(fits)[1:] if fits else None


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")


def test_hosts_paths_and_rules(spark, nothing):
    pages = spark.createDataFrame([(k, u, "x", "x", "x", "x") for k, u in enumerate(URLS)] + [(None, URLS[5], "x", "x", "x", "x")], "page_id long, url string, html string, host string, verdict string, key string")
    got = found(urlfilter.judge(pages, nothing), "page_id", "host", "path", "rule", "verdict")
    want = [(k, h, p, r[0] if r else None, r[1] if r else "allow") for k, u in [*enumerate(URLS), (None, URLS[5])] for h, p, r in [parts(u)]]
    assert got == sorted(want, key=repr)
    assert urlfilter.judge(pages.limit(0), nothing).count() == 0


def site(draw):
    bad = draw.random() < 0.3
    host = f"{draw.choice(['www', 'm'])}.{draw.choice(['zeta', 'eta'] if bad and draw.random() < 0.9 else ['theta', 'iota', 'eta'])}.info"
    return f"https://{host}/{draw.choice(['buy', 'win'] if bad else ['news', 'buy', 'wiki'])}/{draw.randrange(99999)}{draw.choice(['', '.html', '?ref=1'])}", "block" if bad else "allow"


def test_mined_rules(spark):
    draw = random.Random(9)
    rows = [site(draw) for _ in range(400)]
    df = spark.createDataFrame(rows, "url string, label string")
    mined = urlfilter.mine(df).collect()
    # an item stands for all tokens of the same URLs, so a rule for a rule of each choice among them
    got = {(tuple(sorted(c)), r["label"]): (r["freq"], round(r["confidence"], 9), min(r["key"])) for r in mined for c in itertools.product(*r["antecedent"])}
    assert any(len(item) > 1 for r in mined for item in r["antecedent"])
    sets = [(frozenset(r["t"]), r["label"]) for r in df.select(urlfilter.tokens(df["url"]).alias("t"), "label").collect()]
    share = {t: sum(t in s for s, _ in sets) / 400 for s, _ in sets for t in s}
    sets = [(frozenset(t for t in s if share[t] < 1), y) for s, y in sets]
    held, marked = {}, {}
    for s, y in sets:
        for n in range(1, len(s) + 1):
            for c in itertools.combinations(sorted(s), n):
                held[c] = held.get(c, 0) + 1
                marked[c, y] = marked.get((c, y), 0) + 1
    least = max(urlfilter.COUNT, urlfilter.SUPPORT * 400)
    rules = {k: (n, n / held[k[0]]) for k, n in marked.items() if n >= least and n / held[k[0]] >= urlfilter.CONFIDENCE}
    spare = {k for k in rules for t in k[0] if len(k[0]) > 1 and (part := (tuple(x for x in k[0] if x != t), k[1])) in rules and rules[part][1] >= rules[k][1]}
    want = {k: (n, round(c, 9), min(held[(t,)] for t in k[0])) for k, (n, c) in rules.items() if k not in spare}
    assert {k: (n, c, held[(t,)]) for k, (n, c, t) in got.items()} == want and want
    mined = urlfilter.mine(df)
    verdicts = {r["url"]: r["verdict"] for r in urlfilter.match(df, mined).collect()}
    for (url, _), (s, _) in zip(rows, sets):
        fit = [(c, n, y == "block", list(a), y) for (a, y), (n, c, _) in want.items() if set(a) <= s]
        assert verdicts.get(url) == (max(fit)[-1] if fit else None)


def test_words_that_a_site_repeats(spark):
    """25 path words in the same URLs: one item, not 2 ** 25 combinations; any of the words is a rule's token."""
    shared = "/".join(f"part{chr(97 + k)}" for k in range(25))
    rows = [(f"http://a.info/{shared}/{k}", "block") for k in range(6)] + [(f"http://b{k}.info/news/{k}", "allow") for k in range(60)]
    df = spark.createDataFrame(rows, "url string, label string")
    mined = urlfilter.mine(df)
    rules = [r for r in mined.collect() if r["label"] == "block"]
    assert [r["confidence"] for r in rules] == [1.0] and len(rules[0]["antecedent"][0]) == 27 and rules[0]["freq"] == 6
    asked = spark.createDataFrame([("http://c.info/x/partq/1", 1), ("http://c.info/x/other", 1), (None, 1), ("http://c.info/" + "partc/" * 5_000, 1)], "url string, key int")
    assert sorted(len(r["url"]) for r in urlfilter.match(asked, mined).collect() if r["verdict"] == "block") == [23, 30_014]


def test_labels_with_clashing_columns(spark):
    pages = spark.createDataFrame([(k, f"http://{'bad' if k % 2 else 'good'}.info/x/{k}", "x", "x", "x") for k in range(40)], "page_id long, url string, label string, tokens string, item string")
    labels = spark.createDataFrame([(k, 1, k % 2, "x", "x", "x") for k in range(40)], "doc_id long, quality int, toxic int, url string, label string, held string")
    got = found(urlfilter.judge(pages, labels), "page_id", "verdict")
    assert got == sorted(((k, "block" if k % 2 else "allow") for k in range(40)), key=repr)


def test_labels_and_query(spark, small):
    pages = spark.createDataFrame([(1, "http://a.info/x/7"), (2, "http://b.info/y/8"), (3, "http://casino-win.info/z/99"), (4, None), (5, "http://c.info/9.html")], "page_id long, url string")
    labels = spark.createDataFrame([(7, 1, 1), (8, 1, 0), (8, 1, None), (9, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert found(urlfilter.label_pages(pages, labels), "url", "label") == [("http://a.info/x/7", "block"), ("http://b.info/y/8", "allow"), ("http://c.info/9.html", "block"), ("http://casino-win.info/z/99", "block")]
    q = urlfilter.op7_url_filter(spark, small)
    assert not re.search("Python|Pandas|Arrow", q._jdf.queryExecution().executedPlan().toString())
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    for r in q.collect():
        host, path, rule = parts(urls[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule and rule[0]) and r["verdict"] in ("allow", "block")
        assert not rule or r["verdict"] == rule[1]


def test_sql(spark, small, sql):
    q = urlfilter.op7_url_filter(spark, small)
    assert sorted_rows(q) == sql(urlfilter.ORACLES["op7_url_filter"], q.columns)
