import re

from folio.llm import url_rules as u

PAGES = "page_id long, url string, html string, token string, row string"


def expected(url):
    """Every rule on every url."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = host.translate(str.maketrans(u.UPPER, u.LOWER))
    best = None
    for rule in ("com/", "example.com/en/", "www.example.com/en/", "net/es/", "net/fr/"):
        name, _, start = rule.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + start) and (best is None or len(rule) > len(best)):
            best = rule
    verdict = {None: None, "com/": "allow", "example.com/en/": "block", "www.example.com/en/": "allow"}.get(best, "block")
    other = None
    if best is None:
        verdict, found = "allow", sorted(r.name for r in u.PATTERNS if re.search(r.pattern, host + path))
        if found:
            verdict, other = "block", found[0]
    return host, path, best, verdict, other


URLS = ["http://example.com/en/1", "https://WWW.Example.com/en/x?y#z", "http://a.www.example.com/en/", "http://example.com", "http://example.com/", "http://x.net/es/1", "http://x.net/ES/1", "http://net/fr/", "http://notexample.com/en/", "http://x.org/banners/top/ads/1", "ftp://casino.org/play", "http://org/a-casino.b", "http://supercasinos.org", "no scheme", "", None, "://", "http://a.com:80/en/", "http://x.org/wp-login.php", "http://é.net/es/", "http://x.net?/es/", "http://example.com/enx", "http://x.org/WP-Admin/a", "http://www.example.com/de/?u=http://example.com/en/"]


def test_against_every_rule(spark):
    rows = [(i, x, None, "t", "r") for i, x in enumerate(URLS)] + [(3, URLS[0], None, "t", "r"), (None, URLS[5], None, "t", "r"), (0, URLS[0], None, "t", "r")]
    got = u.judge(spark.createDataFrame(rows, PAGES)).collect()
    assert sorted(map(str, ((r.page_id, (r.host, r.path, r.rule, r.verdict, r.pattern)) for r in got))) == sorted(map(str, ((r[0], expected(r[1])) for r in rows)))


def test_index_uses_the_rarest_token(spark):
    rules = [u.host_rule("common.rare.org", "/a/", u.BLOCK), u.phrase_rule("any", "zz")]
    tokens = spark.createDataFrame([("common",)] * 5 + [("org",)] * 9 + [("rare",)] * 2 + [("a",)] * 3, "token string")
    index = {r.name: r.token for r in u.index_rules(tokens, u.rule_table(spark, rules)).collect()}
    assert index == {"common.rare.org/a/": "rare", "any": ""}


def test_empty_table_shuffled_index_and_allowed(spark, monkeypatch):
    pages = spark.createDataFrame([(1, URLS[0], None, "t", "r"), (2, URLS[1], None, "t", "r")], PAGES)
    assert u.judge(pages.limit(0)).count() == 0
    monkeypatch.setattr(u, "MAX_BROADCAST_RULES", 0)
    assert [r.page_id for r in u.allowed(pages).collect()] == [2]


def test_host_rule_tokens_are_whole(spark):
    assert u.host_rule("a.com", "/en", u.BLOCK).tokens == ("a", "com")
    assert u.host_rule("A.com", "/en/", u.BLOCK).tokens == ("a", "com", "en")
