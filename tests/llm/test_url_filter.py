import random
import re

from callweave.llm import url_filter

PAGES = "page_id long, url string"


def plain(url, rules=url_filter.RULES):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"), default=None)
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in url or "")
    has = lambda t: re.search(rf"(?<![a-z\u0080-\U0010ffff]){re.escape(t)}(?![a-z\u0080-\U0010ffff])", low)
    strict, soft = sum(1 for t in url_filter.STRICT if has(t)), [w for t, w in url_filter.SOFT.items() if has(t)]
    own = "block" if strict or sum(soft) >= url_filter.LIMIT else "allow"
    return host, path, best and best[0] + best[1], best[2] if best else own, strict, len(soft), sum(soft)


def addresses(n, seed=5):
    r = random.Random(seed)
    words = ["casino", "free", "bets", "cheap", "pills", "ads", "track", "Spam", "house", "wins", "winé", "é", "7", "www", "m"]
    fixed = [None, "", "no scheme casino", "http://", "https://A.Example.ORG/es/1", "http://example.org", "http://example.org?x=/es/", "http://xexample.org/es/", "http://a.org#top", "ftp://com/fr/", "http://b.com/de", "http://b.com/de/7?free-bets", "a://b://c.com/de/", "\nhttp://x.com/de/", "http://casino777.net/", "http://xcasino.net/", "http://fr-casino.com/fr/", "http://free.net/free/free", "http://x.net/" + "free-" * 50_000, "http://Ünder.NET/ÄB"]
    return fixed + [f"http{r.choice(['', 's'])}://{'.'.join(r.choices(words, k=r.randint(1, 3)))}.{r.choice(['com', 'org', 'net', 'example.org'])}/{r.choice(['en/1', 'en/2', 'es/', 'de/', 'fr/', ''])}{r.choice('-_/?#.')}{r.choice(['', '-', '/']).join(r.choices(words, k=3))}" for _ in range(n)]


def test_verdicts(spark):
    urls = addresses(400)
    rows = [(k, u) for k, u in enumerate(urls)] + [(3, urls[30]), (3, urls[30]), (None, urls[31])]
    table = spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES + ", host string, verdict string")
    got = url_filter.judged(table)
    assert got.columns == ["page_id", "host", "path", "rule", "verdict", "n_strict", "n_soft", "soft_weight"]
    order = lambda x: str(x)
    assert sorted(map(tuple, got.collect()), key=order) == sorted(((i, *plain(u)) for i, u in rows), key=order)
    assert got.where("false").count() == 0 and url_filter.judged(table.where("false")).count() == 0


def test_a_single_soft_term_never_blocks_and_weights_add(spark):
    urls = [(1, "http://free.net/"), (2, "http://bets.net/bets"), (3, "http://free.net/bets"), (4, "http://xxx.net/")]
    got = {r.page_id: r.verdict for r in url_filter.judged(spark.createDataFrame(urls, PAGES)).collect()}
    assert got == {1: "allow", 2: "allow", 3: "block", 4: "block"}
    assert {r.verdict for r in url_filter.judged(spark.createDataFrame(urls, PAGES), strict=(), soft={}).collect()} == {"allow"}


def test_rules_of_a_table_equal_rules_of_a_list(spark):
    rules = [*url_filter.RULES, ("bets.com", "/", "block"), ("org", "/en/", "block"), ("ample.org", "/", "block"), ("com", "/de/", "block"), ("net", "", "allow")]
    table = spark.createDataFrame([(k, u) for k, u in enumerate(addresses(300, 6))], PAGES)
    given = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    held = url_filter.judged(table, rules).collect()
    assert sorted(held, key=str) == sorted(url_filter.judged(table, given).collect(), key=str)
    assert sorted(map(tuple, held), key=str) == sorted(((k, *plain(u, rules)) for k, u in enumerate(addresses(300, 6))), key=str)
