from check import compare, open_tables
from veritrail.llm import urls


def test_against_sql(spark, sf):
    assert compare(spark, open_tables(sf), "op3", urls.op3_bloom_url_filter, urls.OP3_SQL, sf, True)[0] == "ok"


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        return "", "", None, default
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = rest[end:].split("?")[0].split("#")[0]
    fit = []
    for rule, verdict in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            fit.append((len(rule), len(h), rule, verdict))
    best = max(fit, default=(0, 0, None, default))
    return host, path, best[2], best[3]


URLS = [
    "http://a.b.example.net/en/x", "http://EXAMPLE.net/en/", "https://example.net/enx", "http://net/", "http://net", "ftp://x.org/fr/y?z#q", "http://x.org/frei",
    "http://notexample.com/de/", "http://m.example.com/de/1", "nothing", "", None, "http://", "http:///en/", "http://h?x://net/", "://net/a", "http://a..net/",
    "http://u:p@x.net:80/", "http://x.net/\nsecond", "line\nhttp://x.net/", "http://" + "a." * 20_000 + "net/x", "http://x.net/" + "p" * 50_000, "http://x.net/a", "http://x.net/a",
]


def test_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, "k", "r", "v") for i, u in enumerate(URLS)], "page_id long, url string, key string, rule string, verdict string")
    listed = spark.createDataFrame([*urls.RULES, ("net/", "allow"), (None, "block"), ("/x", "block"), ("plain", "block"), ("ORG/fr/y", "block")], "rule string, verdict string")
    rules = [*urls.RULES, ("org/fr/y", "block")]
    got = {r["page_id"]: r for r in urls.filter_urls(pages, listed).collect()}
    for i, u in enumerate(URLS):
        host, path, rule, verdict = brute(u, rules)
        r = got[i]
        assert (r["host"], r["path"], (r["rule"] or "").lower() or None, r["verdict"]) == (host, path, rule, verdict), u
    assert len(got) == len(URLS)


def test_empty_tables(spark):
    pages = spark.createDataFrame([(1, "http://x.net/")], "page_id long, url string")
    none = spark.createDataFrame([], "rule string, verdict string")
    assert [r["verdict"] for r in urls.filter_urls(pages, none).collect()] == ["allow"]
    assert urls.filter_urls(pages.where("false"), none).count() == 0


def test_filter_passes_all_listed_keys_and_few_others(spark):
    keys = spark.range(5_000).selectExpr("concat('h', id, '.com/') as key")
    blocks, bits = urls.bloom_filter(keys, 5_000)
    assert urls.possible_hits(keys, blocks, bits).count() == 5_000
    others = spark.range(50_000).selectExpr("concat('o', id, '.com/') as key")
    assert urls.possible_hits(others, blocks, bits).count() < 500


def test_long_lists_are_probed_before_anything_is_multiplied(spark):
    paths = spark.range(100_000).selectExpr("concat('h', id % 997, '.com/', substring(repeat('p', 400), 1, cast(id % 400 as int)), id) as rule", "if(id % 3 = 0, 'allow', 'block') as verdict")
    rules = [tuple(r) for r in paths.collect()]
    pages = [(i, f"http://a.b.h{i % 1200}.com/" + "p" * (i % 400) + str(i * 7 % 120_000)) for i in range(3000)]
    got = {r["page_id"]: r for r in urls.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), paths).collect()}
    by_host = {}
    for rule, verdict in rules:
        by_host.setdefault(rule.split("/", 1)[0], []).append((rule, verdict))
    for i, url in pages:
        near = by_host.get(url.split("/")[2].split(".", 2)[2], [])
        assert (got[i]["rule"], got[i]["verdict"]) == brute(url, near)[2:], url
    assert sum(r["rule"] is not None for r in got.values()) > 50
    # the share of absent keys that the filter of such a list lets through
    blocks, bits = urls.bloom_filter(paths.selectExpr("rule as key"), len(rules))
    absent = spark.range(200_000).selectExpr("concat('x', id, '.org/') as key")
    assert urls.possible_hits(absent, blocks, bits).count() < 2_000


def test_canonical_hosts(spark):
    pages = [(0, "http://u:p@X.net:80/"), (1, "https://x.net.:443"), (2, "http://x.net:8080/"), (3, "http://x.net./en/")]
    df = spark.createDataFrame(pages, "page_id long, url string")
    listed = spark.createDataFrame([("net/", "block"), ("x.net/en/", "allow")], "rule string, verdict string")
    for canonical, want in ((False, ["allow"] * 4), (True, ["block", "block", "allow", "allow"])):
        got = {r["page_id"]: r["verdict"] for r in urls.filter_urls(df, listed, canonical=canonical).collect()}
        assert [got[i] for i in range(4)] == want
