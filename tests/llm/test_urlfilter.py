import pytest

from sampleloom.llm import urlfilter as U

PAGE = "page_id long, url string, html string, decision string, url_key string, node string, component string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", "z", "w") for r in rows], PAGE)


def rules(spark, **said):
    return spark.createDataFrame([(r, d) for d, r in said.items()], "rule string, decision string")


def link(to):
    return f'<html><head><link rel="canonical" href="{to}"></head></html>'


@pytest.mark.parametrize(
    ("url", "key"),
    [
        ("HTTP://WWW.Example.com:80/A/?utm_source=x&b=2#top", "example.com/A/?b=2"),
        ("https://example.com/", "example.com"),
        ("https://example.com/index.html", "example.com"),
        ("https://m.example.com/a/", "m.example.com/a"),
        ("https://example.com/a?ref=x", "example.com/a"),
        ("", ""),
        (None, None),
    ],
)
def test_normal_form(spark, url, key):
    assert spark.createDataFrame([(url,)], "u string").selectExpr(U.normalised("u")).first()[0] == key


def test_blocks_go_to_aliases_and_explicit_allowances_stay(spark):
    rows = [
        (1, "http://a.com/1", link("http://b.com/1")),
        (2, "https://www.b.com/1/", link("/2")),
        (3, "http://b.com/2", '<meta http-equiv="refresh" content="0; url=http://evil.com/x">'),
        (4, "http://shop.evil.com/y", None),
        (5, "http://c.com", "<p>canonical evil.com</p>"),
        (6, "http://good.com/z", link("http://evil.com/x")),
        (7, "http://good.com.other.com/z", link("http://evil.com/q")),
        (8, None, link("http://evil.com/x")),
        (9, "http://d.com/1", "plain"),
        (9, "http://d.com/1", "plain"),
    ]
    redirects = spark.createDataFrame([("http://d.com/1", "http://e.com/1"), ("http://e.com/1", "http://evil.com/"), (None, "x")], "src string, dst string")
    got = sorted((r.page_id, r.decision) for r in U.decide(pages(spark, rows), redirects, rules(spark, block="evil.com", allow="good.com")).collect())
    assert got == [(1, "block"), (2, "block"), (3, "block"), (4, "block"), (5, "pass"), (6, "allow"), (7, "block"), (8, "pass"), (9, "block"), (9, "block")]


def test_sql_says_the_same(spark):
    import duckdb

    rows = [(i, f"https://h{i}.com/p?utm_a=1", link(f"https://h{i + 1}.com/p")) for i in range(5)] + [(6, "https://x.casino-win.example.net/1", ""), (7, "http://h5.com/p/", '<meta http-equiv=refresh content="1;url=https://ads-track.example.com/">')]
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    table = pages(spark, rows)
    got = sorted(map(tuple, U.decide(table, U.service_redirects(table)).collect()))
    assert got == sorted(con.execute(U.decide_sql()).fetchall())
    assert {r[2] for r in got} == {"block"}


def test_empty_and_null(spark):
    assert U.decide(pages(spark, [])).count() == 0
    assert [tuple(r) for r in U.decide(pages(spark, [(None, None, None)])).collect()] == [(None, None, "pass")]


@pytest.mark.parametrize(
    ("url", "html"),
    [
        ("http://a.com/d/p.html", link("bad.html")),
        ("http://a.com/d/e/p", link("../bad.html")),
        ("http://a.com/d/p", '<meta http-equiv="refresh" content="0; url=bad.html">'),
        ("http://a.com/x", '<base href="http://a.com/d/">' + link("bad.html")),
        ("http://a.com/x", link("http://fine.com/") + link("/d/bad.html")),
        ("http://a.com/x", '<meta http-equiv=refresh content="1;url=/y"><meta http-equiv=refresh content="2;url=d/bad.html">'),
        ("a.com/d/x", link("./bad.html")),
    ],
)
def test_every_link_of_a_page_is_an_edge(spark, url, html):
    rows = [(1, url, html), (2, "http://a.com/d/bad.html", link("http://evil.com/")), (3, "http://a.com/q", link("mailto:x@evil.com"))]
    got = {r.page_id: r.decision for r in U.decide(pages(spark, rows), None, rules(spark, block="evil.com")).collect()}
    assert got == {1: "block", 2: "block", 3: "pass"}


def test_query_targets_are_resolved(spark):
    rows = [(1, "http://a.com/d/p?id=1", link("?id=2")), (2, "http://a.com/d/p?id=2", link("http://evil.com/"))]
    assert {r.decision for r in U.decide(pages(spark, rows), None, rules(spark, block="evil.com")).collect()} == {"block"}


@pytest.mark.parametrize(
    ("rule", "yes", "no"),
    [
        ("evil.com", ["evil.com/x", "a.b.evil.com", "EVIL.com?x=1"], ["notevil.com", "evil.com.org", "good.com/evil.com"]),
        ("=evil.com", ["evil.com/x"], ["a.evil.com/x"]),
        ("evil.*", ["evil.com", "a.evil.co.uk/x"], ["devil.com", "x.com/evil.com"]),
        ("=evil.*", ["evil.net/q"], ["m.evil.net/q"]),
        ("a.com/p", ["a.com/p", "http://www.a.com/p/"], ["a.com/p2", "a.com"]),
    ],
)
def test_forms_of_rules(spark, rule, yes, no):
    rows = [(i, u, None) for i, u in enumerate(yes + no)]
    got = {r.page_id: r.decision for r in U.decide(pages(spark, rows), None, rules(spark, block=rule)).collect()}
    assert [got[i] for i in range(len(rows))] == ["block"] * len(yes) + ["pass"] * len(no)


def test_both_decisions_and_aliases_occur_in_the_query(spark, tmp_path):
    from sampleloom.llm.queries import op10_url_filter

    rows = [(1, "http://m.casino-win.example.net/a", "p"), (2, "http://casino-win.example.com/b", "p"), (3, "http://blog.free-bets.example.com/c", "p"), (4, "http://m.fine.example.com", "p"), (5, "http://blog.free-bets.example.net/c", "p")]
    pages(spark, rows).write.parquet(str(tmp_path / "pages.parquet"))
    got = {r.page_id: r.decision for r in op10_url_filter(spark, str(tmp_path)).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "pass", 5: "block"}


def test_many_rules_and_odd_ones(spark):
    said = [(f"site{i}.com", "block") for i in range(3000)] + [(None, "block"), ("x.com", None), ("y.com", "other"), (" Z.com ", "BLOCK"), ("site5.com", "allow")]
    rows = [(1, "http://a.site17.com", None), (2, "http://x.com", None), (3, "http://y.com", None), (4, "http://z.com", None), (5, "http://site5.com", None)]
    got = {r.page_id: r.decision for r in U.decide(pages(spark, rows), None, spark.createDataFrame(said, "rule string, decision string")).collect()}
    assert got == {1: "block", 2: "pass", 3: "pass", 4: "block", 5: "allow"}
