import duckdb
from pyspark.sql import functions as F

from millrace.llm import components, urlfilter
from tests.llm.fixtures import CLASH, rows_of

PAGES = "page_id bigint, url string, html string"


def link(to):
    return f'<html><head><LINK href="{to}" rel=canonical></head></html>'


def refresh(to):
    return f"<meta http-equiv='Refresh' content='0; URL={to}'>"


ROWS = [
    (1, "https://a.example.org/es/1", "", "block"), (2, "http://example.org/es/", None, "block"), (3, "http://EXAMPLE.ORG/en/12?x#y", "", "block"),
    (4, "http://x.com/fr/1", "", "allow"), (5, "http://x.com/de/1", "", "block"), (6, "http://x.com/en/1", link("http://x.com/de/1"), "block"),
    (7, "http://y.net/a", refresh("http://x.com/en/1"), "block"), (8, "http://x.com/fr/2", link("http://x.com/de/1"), "allow"), (9, "http://z.net/q", "", "allow"),
    (10, None, link("http://x.com/de/1"), "allow"), (11, "no scheme/de/", "", "allow"), (12, "http://notexample.org/es/", "", "allow"), (13, "http://example.org", "", "allow"),
    (14, "HTTP://Y.net/a", "", "block"), (15, "http://w.net/", '<a href="http://x.com/de/1">canonical</a>', "allow"), (16, "http://com/de/", "", "block"), (16, "http://com/de/", "", "block"),
    (17, "a://b://c.com/de/", "", "allow"), (18, "http://u.com/x?http://v.com/de/", "", "allow"), (19, "", "", "allow"), (20, "http://v.net/" + "p" * 20000, "", "allow"),
    (21, "http://r.com/de/x", link("/en/y"), "block"), (22, "http://r.com/en/y", "", "block"), (23, "http://s.net/a/b", refresh("//x.com/de/1"), "block"), (24, "http://r.com/en/z?q", link("../de"), "allow"),
    (25, "http://r.com/de/dir/x", link("sub"), "block"), (26, "http://t.net/", "<link rel='alternate canonical' href=/k>", "allow"), (27, "http://r.com/en/m", link("mailto:a@b"), "allow"), (28, "http://r.com", link("en/y"), "block"),
    (29, "http://r.com/en/q", link("?x=1"), "allow"),
]


def table(spark, rows=ROWS):
    return spark.createDataFrame([r[:3] for r in rows], PAGES).withColumns({c: F.lit(c) for c in CLASH})


def test_rules_and_aliases(spark):
    got = rows_of(urlfilter.judge(table(spark)))
    assert sorted((r[0], r[4]) for r in got) == sorted((r[0], r[3]) for r in ROWS)
    by = {r[0]: r for r in got}
    assert by[3][1:4] == ("example.org", "/en/12", "example.org/en/1") and by[1][3] == "example.org/es/" and by[8][3] == "com/fr/"
    assert by[10][1:4] == ("", "", None) and by[11][1:4] == ("", "", None) and by[13][2:4] == ("", None) and by[12][3] == "org/"
    assert by[6][3] is None and by[17][1:3] == ("b:", "//c.com/de/")


def test_sql_agrees_on_links(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    rows = [r[:3] for r in ROWS]
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    assert sorted(con.execute(urlfilter.SQL).fetchall()) == sorted(rows_of(urlfilter.judge(table(spark, rows))))


def test_components_at_size(spark, monkeypatch):
    """100,000 edges: a hub, a long chain, pairs and triples; every round over all partitions."""
    monkeypatch.setattr(components, "ONE_TASK", 0)
    hub = [(0, 10 * i) for i in range(1, 50_001)]
    chain = [(1_000_001 + i, 1_000_002 + i) for i in range(1_500)]
    pairs = [(2_000_000 + 3 * i, 2_000_001 + 3 * i + i % 2) for i in range(50_000)]
    edges = hub + chain + pairs
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = dict(rows_of(components.connected_components(spark.createDataFrame([e[:: 1 if i % 2 else -1] for i, e in enumerate(edges)], "a bigint, b bigint"))))
    assert got == {x: root(x) for x in list(up)}


def test_redirect_table_and_empty(spark):
    moved = spark.createDataFrame([("http://z.net/q", "http://gone.com/de/5"), (None, "http://x.com/de/1"), ("nothing", "http://x.com/de/1")], "src string, dst string")
    by = {r[0]: r[4] for r in rows_of(urlfilter.judge(table(spark), moved))}
    assert by[9] == "block" and by[15] == "allow"
    assert rows_of(urlfilter.judge(table(spark).limit(0))) == []
