import random
import re

from sparkfield.llm import url_filter as U


def brute(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        raw = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(raw) :])[0]
        host = raw.translate({c: c + 32 for c in range(65, 91)})
    fit = [(len(h), len(p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def test_against_brute_force(spark):
    rng = random.Random(5)
    labels = ["com", "net", "example", "www", "a", "É", "B", ""]
    paths = ["/", "/en/", "/en", "/es/x", "/fr/é", "", "/EN/", "/en/\n/x", "/" + "long/" * 300]
    urls = [f"{rng.choice(['http://', '://', 'x://', '', 'http:/'])}{'.'.join(rng.choices(labels, k=rng.randint(1, 5)))}{rng.choice(paths)}{rng.choice(['', '?q=/en/', '#t', '?a#b'])}" for _ in range(1500)]
    urls += [None, "", "://", "http://com/", "HTTP://COM/", "http://a://b.com/"]
    rules = [*U.RULES, ("net", "", "block"), ("com", "/e", "allow"), ("b.com", "/", "block"), ("b.com", "/", "allow"), ("net", "/es/", "block")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string").selectExpr("*", "1 as host", "2 as rule")
    exact = [r for r in rules if r != ("b.com", "/", "allow")]
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, U.rule_table(spark, rules)).collect()}
    assert got == {i: brute(u, exact) for i, u in enumerate(urls)}


def test_nothing(spark):
    pages = spark.createDataFrame([(1, "http://a.com/"), (None, None), (1, "http://a.com/")], "page_id long, url string")
    assert [r.verdict for r in U.judge(pages, U.rule_table(spark, [])).collect()] == ["allow"] * 3
    assert U.judge(pages.limit(0), U.rule_table(spark, U.RULES)).count() == 0
