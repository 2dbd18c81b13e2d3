import re

import pytest

from spotweave.llm.queries import ORACLES, URL_RULES
from spotweave.llm.url_filter import judge, rules_table

PAGES = "page_id long, url string, html string, _host string, rule int"


def address(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    return (found[1].translate({c: c + 32 for c in range(65, 91)}), found[2]) if found else ("", "")


def node(url):
    host, _ = address(url)
    rest = re.match(r"(?s).*?://[^/?#]*([^#]*)", url)[1]
    return host + (rest if rest.startswith("/") else "/" + rest)


def own_rule(url, rules):
    host, path = address(url)
    fitting = [(len(h + p), len(h), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fitting)[3:] if fitting else (None, None)


def plain(pages, edges, rules):
    """Verdicts by walking over all edges from every blocked URL."""
    urls = [u for _, u, *_ in pages if u and "://" in u] + [u for e in edges for u in e]
    reached = {node(u) for u in urls if own_rule(u, rules)[1] == "block"}
    while True:
        more = {node(y) for a, b in edges for x, y in ((a, b), (b, a)) if node(x) in reached} - reached
        if not more:
            break
        reached |= more
    out = []
    for page_id, url, *_ in pages:
        rule, verdict = own_rule(url, rules) if url and "://" in url else (None, None)
        alias = "block" if url and "://" in url and node(url) in reached else "allow"
        out.append((page_id, *address(url), rule, verdict or alias))
    return sorted(out, key=repr)


def page(page_id, url, html=""):
    return (page_id, url, html, "clash", page_id)


def fixture():
    canonical = '<head><link data-x="1" rel="canonical" href="{}"></head>'
    refresh = "<META HTTP-EQUIV=refresh content='0; URL={}'>"
    pages = [
        page(1, "http://Blog.Example.NET/en/1#top"),
        page(2, "https://example.net/fr/2"),
        page(3, "https://a.example.com/de/3?x=1", canonical.format("https://c.example.com/en/9")),
        page(4, "http://c.example.com/en/9", "null"),
        page(5, "http://d.example.com/en/5", refresh.format("/en/6")),
        page(6, "http://d.example.com/en/6", canonical.format("//c.example.com/en/9")),
        page(7, "http://x.example.org/fr/7", canonical.format("https://a.example.com/de/3?x=1")),
        page(8, "http://y.example.org/en/8", canonical.format("http://x.example.org/fr/7")),
        page(9, "http://z.example.com/en/0", "<!--" + canonical.format("http://q.net/") + "--><script>" + refresh.format("http://q.net/") + "</script>"),
        page(10, "http://z.example.com/en/1", canonical.format("http://unknown.host.net/en/1")),
        page(11, "http://net", canonical.format("#here")),
        page(12, "HTTPS://net/"),
        page(13, "http://notexample.com/de/"),
        page(14, "http://z.example.com/a/b?c", canonical.format("d&amp;e") + canonical.format("mailto:x@y.net") + canonical.format("?c=2")),
        page(15, "http://z.example.com/a/d&e", canonical.format("http://example.com/de/")),
        page(16, None, canonical.format("http://q.net/")),
        page(17, "no address", canonical.format("http://q.net/")),
        page(18, "", None),
        page(19, "://", None),
        page(20, "http://long.example.com/" + "x" * 200_000, canonical.format("http://q.net/")),
        (None, "http://z.example.com/en/1", None, None, None),
    ]
    edges = [
        ("https://a.example.com/de/3?x=1", "https://c.example.com/en/9"),
        ("http://d.example.com/en/5", "http://d.example.com/en/6"),
        ("http://d.example.com/en/6", "http://c.example.com/en/9"),
        ("http://x.example.org/fr/7", "https://a.example.com/de/3?x=1"),
        ("http://y.example.org/en/8", "http://x.example.org/fr/7"),
        ("http://z.example.com/en/1", "http://unknown.host.net/en/1"),
        ("http://net", "http://net/"),
        ("http://z.example.com/a/b?c", "http://z.example.com/a/d&e"),
        ("http://z.example.com/a/b?c", "http://z.example.com/a/b?c=2"),
        ("http://z.example.com/a/d&e", "http://example.com/de/"),
        ("http://long.example.com/" + "x" * 200_000, "http://q.net/"),
    ]
    pages += [page(100 + i, f"http://s{i}.example.com/en/{i}", canonical.format("http://hub.example.com/en/")) for i in range(300)]
    pages += [page(500 + i, "http://s7.example.com/en/7") for i in range(400)]  # a URL with a third of all rows
    edges += [(f"http://s{i}.example.com/en/{i}", "http://hub.example.com/en/") for i in range(300)]
    return pages, edges


def judged(spark, pages, rules, **options):
    out = judge(spark.createDataFrame(pages, PAGES), rules_table(spark, rules), ["page_id"], **options)
    return sorted(((r.page_id, r._host, r._path, r._rule, r._verdict) for r in out.collect()), key=repr)


def test_aliases_and_precedence(spark):
    pages, edges = fixture()
    got = judged(spark, pages, URL_RULES)
    assert got == plain(pages, edges, URL_RULES)
    by_id = {r[0]: r for r in got}
    assert by_id[4][4] == by_id[5][4] == "block" and by_id[7][4] == "allow"  # by alias; explicitly allowed
    assert by_id[8][4] == "block" and by_id[9][4] == "allow" and by_id[11] == (11, "net", "", None, "block")


def test_logged_redirects_and_equally_long_rules(spark):
    rules = [("net", "/abc", "block"), ("b.net", "/a", "allow"), ("Q.net", "", "allow"), ("q.NET", "", "block"), (None, "/", "block"), ("x.net", "/", "other")]
    pages = [page(1, "http://b.net/abc"), page(2, "http://c.b.net/abc"), page(3, "http://q.net?"), page(4, "http://x.net/"), page(5, "http://r.com/1")]
    logged = [("http://r.com/1", "http://r.com/2"), ("http://r.com/2", "http://n.net/abcd"), (None, "http://b.net/"), ("x", "http://n.net/abc")]
    redirects = spark.createDataFrame(logged, "from_url string, to_url string")
    edges = [e for e in logged if e[0] and "://" in e[0]]
    known = [r for r in rules if r[0] and r[2] != "other"]
    lowered = [(h.lower(), p, v) for h, p, v in known]
    assert judged(spark, pages, rules, redirects=redirects) == plain(pages, edges, lowered)


def test_empty_table_and_no_rules(spark):
    assert judged(spark, [], URL_RULES) == []
    got = judged(spark, [page(1, "http://a.net/"), page(1, "http://a.net/")], [])
    assert got == [(1, "a.net", "/", None, "allow")] * 2


def test_columns_of_the_row_pass_and_no_python(spark):
    pages, _ = fixture()
    out = judge(spark.createDataFrame(pages, PAGES), rules_table(spark, URL_RULES), ["_host", "rule", "page_id"])
    assert out.columns == ["_host", "rule", "page_id", "_host", "_path", "_rule", "_verdict"] and out.count() == len(pages)
    assert "Python" not in out._jdf.queryExecution().toString() and "ArrowEval" not in out._jdf.queryExecution().toString()


def test_sql_twin_on_the_planted_pages(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    pages, _ = fixture()
    frame = spark.createDataFrame(pages, PAGES).select("page_id", "url", "html")
    frame.write.parquet(str(tmp_path / "pages"))
    db = duckdb.connect()
    db.execute(f"create view pages as select distinct * from '{tmp_path}/pages/*.parquet'")
    want = sorted(db.execute(ORACLES["op12_url_rules"]).fetchall(), key=repr)
    assert judged(spark, sorted(set(pages), key=repr), URL_RULES) == want
