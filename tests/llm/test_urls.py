import random

from pyspark.sql import functions as F

from dialectic.llm import urls


def plain(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url[url.index("://") + 3:]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host, tail = rest[:cut], rest[cut:]
    path = tail[:min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for rule, said in urls.RULES:
        h, _, p = rule.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
            best = (rule, said)
    return (host, path) + (best or (None, None))


URLS = ["http://a.example.org/es/1", "https://EXAMPLE.org/en/12?x=1", "http://org/", "http://forg/x", "http://x.com/fr/1",
        "http://x.com/de/1#t", "ftp://x.net", "no scheme", "", None, "a://b://c/d", "http://É.com/FR/", "://", "http://x.org",
        "http://x.org?y=/es/", "http://x.com/frx/1", "http://y.example.org/en/1", "http://y.example.org/en/2",
        "x://h/" + "p/" * 5000, "http://a\nb.com/de/z\ny"]


def test_parts_and_rules(spark):
    df = spark.createDataFrame([(i, u, "<p>") for i, u in enumerate(URLS + URLS)], "page_id long, url string, host string")
    got = {(r.page_id): r for r in urls.judge(df).collect()}
    assert len(got) == 2 * len(URLS)
    for i, u in enumerate(URLS + URLS):
        w = plain(u)
        assert (got[i].host, got[i].path) == w[:2], u
        if u and "://" in u:
            assert got[i].rule == w[2], u
            if w[3]:
                assert got[i].verdict == w[3]
        assert got[i].verdict in ("allow", "block")


def test_degenerate_labels(spark):
    none = spark.createDataFrame([(1, "http://x.net/a"), (2, None)], "page_id long, url string")
    assert {r.verdict for r in urls.judge(none).collect()} == {"allow"}
    one = spark.createDataFrame([(1, "http://x.com/de/a"), (2, "http://x.net/")], "page_id long, url string")
    assert {r.verdict for r in urls.judge(one).collect()} == {"block"}
    assert urls.judge(one.limit(0)).count() == 0


def test_trees_learn_held_out_urls(spark):
    """Shape decides the verdict; URLs outside the rules follow it."""
    rnd = random.Random(1)
    rows = []
    for i in range(900):
        bad = rnd.random() < 0.5
        tail = "".join(rnd.choice("0123456789") for _ in range(12)) if bad else rnd.choice(["about", "news", "help"])
        host = rnd.choice(["a", "b"]) + (".com/de/" if bad else ".com/fr/")
        if i % 3 == 0:
            host = "c.net/xx/"
        rows.append((i, f"http://{host}{tail}" + ("?a=1&b=2&c=3" if bad else ""), bad))
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    out = urls.judge(df).join(df.select("page_id", "bad"), "page_id").filter("rule is null")
    assert out.filter((F.col("verdict") == "block") == F.col("bad")).count() / out.count() > 0.95


def test_rates_cover_all_labelled_urls(spark):
    """Only the section decides; most sections are not among the fitted URLs."""
    rules = [("a.com/", "allow"), ("b.com/", "block")]
    rows, n = [], 0
    for s in range(100):
        for u in range(10):
            bad = s % 2 == 0
            rows += [(n, f"http://{'b' if bad else 'a'}.com/s{s + 100}/p{u}", bad)]
            n += 1
        rows += [(n, f"http://c.com/s{s + 100}/p1", bad)]
        n += 1
    df = spark.createDataFrame(rows, "page_id long, url string, bad boolean")
    out = urls.judge(df, rules, fit_rows=40).join(df.select("page_id", "bad"), "page_id").filter("rule is null")
    assert out.count() == 100
    assert out.filter((F.col("verdict") == "block") == F.col("bad")).count() >= 95
