import functools
import re

import pytest

from scenewright.llm import url_rules as U

RULES = U.HOST_RULES + U.PATTERN_RULES
URLS = [
    None, "", "nothing", "http://", "http://com", "http://x.com/", "http://X.COM/a", "https://example.com/en/1", "https://www.Example.com/en/1",
    "https://a.www.example.com/en/", "https://example.com/EN/1", "https://notexample.com/en/1", "http://a.net/es/", "http://net/fr/x", "http://a.net/es",
    "http://cheap-pills.example.org/en/1", "http://a.cheap-x.org/", "http://a.org/login", "http://a.org/login2", "http://a.org/x.exe", "http://a.org/x.exe?q",
    "http://a.org/tag/robots.txt", "http://a.org/?sid=4", "http://a.org/?xsid=4", "http://a.org/LOGIN?x", "a://b://c.com/d", "http://a.org:80/cart", "HTTP://DoubleClick.net/x",
    "http://example.com?x/en/", "http://ü.com/é?ß#x", "http://a.org/x\ny.exe", "http://a.org/y.exe\n",
]


COMPILED = {r.regex: re.compile(r.regex.replace(r"\z", r"\Z")) for r in RULES}


@functools.cache
def brute(url):
    m = re.search(U.PARTS, url or "")
    low = lambda s: re.sub("[A-Z]", lambda c: c[0].lower(), s)
    host, path = (low(m[1]), m[2]) if m else ("", "")
    fit = lambda r, s: COMPILED[r.regex].search(s)
    hosts = sorted((r for r in RULES if r.kind == "host" and fit(r, host + path)), key=lambda r: r.length)
    patterns = sorted((r for r in RULES if r.kind == "pattern" and fit(r, low(url or ""))), key=lambda r: r.verdict != "allow")
    rule = hosts[-1] if hosts else None
    verdict = rule.verdict if rule else patterns[0].verdict if patterns else "allow"
    return host, path, rule and rule.name, verdict


def test_every_url_is_judged_as_by_all_rules(spark):
    rows = [(i, u, "clash", "x") for i, u in enumerate(URLS + URLS[:9])]
    df = spark.createDataFrame(rows, "page_id long, url string, rule string, token string")
    got = U.judge(df, "url", RULES).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url), r.url
    assert {r.verdict for r in got} == {"allow", "block"}
    assert U.judge(df.limit(0), "url", RULES).count() == 0


def test_the_rarest_token_files_a_rule(spark):
    urls = spark.createDataFrame([("http://example.com/en/",), ("http://example.org/en/",), ("http://example.net/en/",)], "url string")
    filed = {r.rule: r.token for r in U.index(urls, "url", U.HOST_RULES).collect()}
    assert filed["example.com/en/"] == "com" and filed["www.example.com/en/"] == "www" and filed["net/es/"] == "es"


def test_a_rule_without_a_token_is_refused():
    with pytest.raises(ValueError, match="literal token"):
        U.pattern_rule("block", "*porn*")


def test_a_url_runs_few_of_thousands_of_rules_and_a_hot_one_goes_to_no_single_task(spark):
    assert len(RULES) > 2500
    urls = ["http://cheap-pills.example.org/en/1", "http://a.org/loans-payday/2", "http://a.org/x", "http://casino-cash.com/x"]
    df = spark.createDataFrame([(i, urls[i % 4] if i % 3 else urls[0]) for i in range(900)] + [(900, None)], "page_id long, url string")
    got = U.judge(df, "url", RULES).collect()
    assert sorted(r.page_id for r in got) == list(range(901))
    for r in got:
        assert (r.host, r.path, r.rule, r.verdict) == brute(r.url), r.url
        assert r.candidates < len(RULES) / 20
    assert {r.pattern for r in got} >= {"||cheap-pills.", "/loans-payday^"}


def test_the_sql_runs_every_rule(spark):
    import duckdb

    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?)", list(enumerate(URLS[:26])))
    told = con.execute(U.brute_force_sql(RULES)).fetchall()
    df = spark.createDataFrame(list(enumerate(URLS[:26])), "page_id long, url string")
    got = U.judge(df, "url", RULES).select("page_id", "host", "path", "rule", "pattern", "verdict").collect()
    assert sorted(map(tuple, got)) == sorted(told)


LIST = """[Adblock Plus 2.0]
! a comment
||ads.example.org^
||track.*/pixel^$domain=shop.org|~safe.shop.org
@@||ads.example.org/about^
@@/robots.txt|
/banner/*/img^$third-party
*swf
example.com##.ad
/[a-z]+[0-9]/
||video.org^$media
||ADS.example.org^
||x.org^$domain=~y.x.org,document
"""


def test_rules_from_a_filter_list(spark, tmp_path):
    (tmp_path / "list.txt").write_text(LIST)
    rules = U.read_rules(spark, str(tmp_path / "list.txt"))
    assert [(r.name, r.verdict) for r in rules] == [
        ("||ads.example.org^", "block"), ("||track.*/pixel^", "block"), ("||ads.example.org/about^", "allow"), ("/robots.txt|", "allow"), ("/banner/*/img^", "block"),
        ("*swf", "block"), ("||x.org^", "block"),
    ]
    urls = {
        "http://ads.example.org/x": "||ads.example.org^", "http://a.ads.example.org/about": "||ads.example.org/about^", "http://nads.example.org/x": None,
        "http://track.shop.org/pixel?1": "||track.*/pixel^", "http://track.safe.shop.org/pixel": None, "http://track.b.org/pixel": None, "http://ads.example.org/robots.txt": "/robots.txt|",
        "http://q.de/banner/1/img/": "/banner/*/img^", "http://q.de/m.SWF?x": "*swf", "http://www.x.org/": "||x.org^", "http://y.x.org/": None, "http://a.y.x.org/": None, None: None, "": None,
    }
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r.url: (r.pattern, r.verdict) for r in U.judge(df, "url", rules).collect()}
    verdict = {r.name: r.verdict for r in rules}
    assert got == {u: (p, verdict.get(p, "allow")) for u, p in urls.items()}
