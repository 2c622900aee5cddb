import random
import re

from vectrail.llm import url_filter as U
from vectrail.llm.queries import ALLOW, BLOCK, LISTED

URLS = [None, "", "nothing", "http://", "http://net", "http://net/", "HTTP://A.NET/x?y", "https://example.net/en/1", "https://b.example.net/en", "http://example.com/de/",
        "http://m.Example.COM/de/x#y", "http://org/fr/", "http://a.org/fr", "http://xnet/", "http://a.b://c.net/", "http://adult-x.example.com", "http://m.adult-x.example.org/fr/1",
        "http://.net/", "http://net:80/", "http://a.net./", "http://a?b://c.net/"]


def judge(url, listed):
    m = re.search("://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, rules in (("block", BLOCK), ("allow", ALLOW)):
        for rule in rules:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[0])):
                best = rule, verdict
    hit = next((k for k in listed if host == k or host.endswith("." + k)), None)
    return host, path, best and best[0], best[1] if best else "block" if hit else "allow"


def test_against_rules(spark):
    made = random.Random(1)
    urls = URLS + [f"http://{'.'.join(made.choice(['a', 'net', 'org', 'example', 'com', 'free-bets']) for _ in range(made.randint(1, 4)))}/{made.choice(['', 'en/', 'de/', 'fr/', 'x'])}{made.choice(['', '?q', '#f'])}" for _ in range(300)]
    pages = spark.createDataFrame([(i, u, "z") for i, u in enumerate(urls + urls[:5])], "page_id bigint, url string, host string")
    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in U.judge(pages, BLOCK, ALLOW, LISTED, ["page_id"]).collect()}
    assert found == {i: judge(u, LISTED) for i, u in enumerate(urls + urls[:5])}
    assert U.judge(pages.limit(0), BLOCK, ALLOW, LISTED, ["page_id"]).count() == 0
    assert {r["verdict"] for r in U.judge(pages, [], [], [], ["page_id"]).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    from pyspark.sql import functions as F

    universe = spark.range(20_000).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("key")).cache()
    listed = universe.where(F.xxhash64("key") % 50 == 0)
    cascade = U.build(listed, universe)
    assert len(cascade.levels) > 1
    got = {r["key"] for r in universe.where(cascade.holds(F.col("key"))).collect()}
    assert got == {r["key"] for r in listed.collect()}
