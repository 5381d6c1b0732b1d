"""URL rules against SQL and a plain loop."""

from oracle import compare

from pyspark.sql import functions as F

from segspark.llm import url_filter
from segspark.llm.queries import SQL, URL_RULES, op8_urls

SF = "/root/testdata/sf0.001"
URLS = [None, "", "x", "http://", "https://EXAMPLE.com", "https://Example.com/", "http://www.example.com/en/1?x#y", "a://b.www.example.com/en/", "a://wexample.com/en/", "http://é.net/es/", "http://a.net/esx/", "http://net/fr/x", "http://.net/fr/", "http://a.b.org/com/", "x://example.com?/en/", "x://h:80/en/", "://com/", "http://u\n.com/a", "a://b://c.com/", "http://a.net/" + "es/" * 9000]


def brute(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = rest
    for c in "/?#":
        host = host.split(c, 1)[0]
    path = rest[len(host) :].split("?", 1)[0].split("#", 1)[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, None, default))
    return host, path, best[2], best[3]


def check(spark, rules):
    rows = [(i, u) for i, u in enumerate(URLS)] + [(3, URLS[6]), (None, URLS[6]), (3, URLS[6])]
    df = spark.createDataFrame([(i, u, "h", "p") for i, u in rows], "page_id long, url string, host string, path string")
    got = url_filter.judge(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(((i, *brute(u, rules)) for i, u in rows), key=repr)


def test_query_equals_sql(spark):
    assert compare(op8_urls(spark, SF), SQL["op8_urls"], SF) > 0


def test_urls(spark):
    check(spark, URL_RULES)


def test_many_rules_and_none(spark):
    check(spark, [(f"h{i}.org", f"/{i}", "block") for i in range(3000)] + [("com", "", "block"), ("com", "", "allow"), ("b.org", "/co", "block")])
    check(spark, [])


def test_filter_has_no_false_negatives_and_few_false_positives(spark):
    keys = spark.range(5000).selectExpr("concat('h', id) host", "'/' path")
    held = url_filter.may_hold(spark, keys)
    rows = spark.range(20000).selectExpr("id", "concat('h', id) host", "'/' path")
    hits = [r.id for r in rows.withColumn("hits", held(F.array(F.struct("host", "path")))).where(F.size("hits") > 0).collect()]
    assert set(range(5000)) <= set(hits) and len(hits) < 5300


def test_long_hosts(spark):
    """A host of very many labels makes no more keys than listed hosts have labels."""
    rows = [(1, "http://" + "a." * 12000 + "example.com/en/x"), (2, "http://" + "a." * 12000 + "com"), (3, "http://.com/"), (4, None), (5, "http://org")]
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).collect()}
    assert got == {1: ("example.com/en/", "block"), 2: (None, "allow"), 3: ("com/", "allow"), 4: (None, "allow"), 5: (None, "allow")}


def test_empty(spark):
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).count() == 0
