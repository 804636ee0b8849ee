import duckdb
from coratings.llm.queries import URL_RULES
from coratings.llm.urls import spread, url_verdicts, verdict_sql
from pyspark.sql import functions as F


def link(*hosts):
    return "".join(f'<a href="http://{h}/x">' for h in hosts)


PAGES = [
    (1, "http://WWW.Example.com/en/1?q#f", ""), (2, "http://a.example.com/en/1", ""), (3, "http://a.example.com/fr/1", ""),
    (4, "https://good.com/", link("friend.org", "good.com")), (5, "http://friend.org/a", link("pal.org")), (6, "http://pal.org", ""),
    (7, "http://bad.net/es/1", ""), (8, "http://helper.org/", link("bad.net", "BAD.net")), (9, "http://helper2.org/", link("helper.org")),
    (10, None, None), (11, "no scheme", ""), (12, "http://", None), (13, "x://net/fr/", ""), (14, "http://notcom/en/", ""), (14, "http://notcom/en/", ""),
    (None, "http://bad.net/en/?a://b", None),
]


def test_rules_and_links(spark):
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, host string, verdict int")
    got = {r.page_id: r for r in url_verdicts(pages, URL_RULES).collect()}
    assert url_verdicts(pages, URL_RULES).count() == len(PAGES)
    assert (got[1].host, got[1].path, got[1].rule, got[1].verdict) == ("www.example.com", "/en/1", "www.example.com/en/", "allow")
    assert (got[2].rule, got[2].verdict) == ("example.com/en/", "block")
    assert (got[3].rule, got[3].verdict) == ("com/", "allow")
    assert (got[13].rule, got[13].verdict) == ("net/fr/", "block")
    assert (got[14].rule, got[14].verdict) == (None, "allow")
    # Trust follows links, distrust goes back along them.
    assert got[5].trust > got[6].trust > 0 and got[6].verdict == "allow"
    assert got[8].distrust > got[9].distrust > 0 and (got[8].verdict, got[9].verdict) == ("block", "block")
    assert (got[None].rule, got[None].path, got[None].verdict) == (None, "/en/", "block")
    for page in (10, 11, 12):
        assert (got[page].host, got[page].path, got[page].rule, got[page].verdict) == ("", "", None, "allow")


def test_page_rank_by_hand(spark):
    """What the linkless c holds goes back to the seed, so scores add up to 1."""
    seeds = spark.createDataFrame([("trust", "a", 1.0)], "kind string, host string, p double")
    edges = spark.createDataFrame([("a", "b", 3), ("a", "c", 1), ("b", "a", 1)], "src string, dst string, n long")
    got = {r.host: r.p for r in spread(seeds, edges, 10**6).where("kind = 'trust'").collect()}
    a = 1 / 1.85
    assert abs(got["a"] - a) < 1e-7 and abs(got["b"] - a * 0.85 * 0.75) < 1e-7 and abs(got["c"] - a * 0.85 * 0.25) < 1e-7
    assert set(got) == {"a", "b", "c"}


def test_a_long_chain_is_judged_to_its_end(spark):
    pages = [(k, f"http://h{k}.org/", link(f"h{k - 1}.org" if k else "bad.net")) for k in range(40)]
    pages = spark.createDataFrame([*pages, (-1, "http://bad.net/es/1", ""), (-2, "http://alone.org/", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_verdicts(pages, URL_RULES).collect()}
    assert [got[k].verdict for k in range(40)] == ["block"] * 40 and got[-2].verdict == "allow"
    assert all(got[k].distrust > got[k + 1].distrust > 0 for k in range(39))


def test_few_blocked_pages_seed_too(spark):
    """One blocked page of five tells against a host without trust, and with trust the greater share decides."""
    rows = [(k, "http://mixed.net/en/", "") for k in range(4)] + [(4, "http://mixed.net/es/", "")]
    rows += [(5, "http://b.example.com/en/", ""), (6, "http://b.example.com/", "")] + [(k, "http://www.example.com/en/", link("c.org", "mixed.net")) for k in (7, 8)] + [(9, "http://c.org/", "")]
    got = {r.page_id: r for r in url_verdicts(spark.createDataFrame(rows, "page_id long, url string, html string"), URL_RULES).collect()}
    assert got[0].distrust > 0 and got[0].trust > 0 and got[9].trust > 0 and got[9].verdict == "allow"
    assert got[0].verdict == ("block" if got[0].distrust >= got[0].trust else "allow")


def test_hosts_with_blocked_pages_carry_distrust(spark, sf_check):
    got = url_verdicts(spark.read.parquet(f"{sf_check}/pages.parquet"), URL_RULES)
    by_host = got.groupBy("host").agg(F.max(F.expr("rule IN ('net/es/', 'net/fr/', 'example.com/en/')")).alias("ruled"), F.min("distrust").alias("least"))
    rows = by_host.where("ruled").collect()
    assert len(rows) >= 4 and all(r.least > 0 for r in rows)


def test_sql_on_a_graph(spark, tmp_path):
    """The SQL twin agrees where links carry trust, with links in every form."""
    forms = [(100 + i, f"http://helper{i}.org/", html) for i, html in enumerate([*FORMS, *NO_LINKS])]
    chain = [(200 + k, f"http://h{k}.org/", link(f"h{k - 1}.org" if k else "bad.net", "good.com")) for k in range(6)]
    pages = spark.createDataFrame([*PAGES, *forms, *chain], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages/*.parquet'")
    columns = ["page_id", "host", "path", "rule", "verdict"]
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({verdict_sql(URL_RULES)})").fetchall()
    got = [tuple(r) for r in url_verdicts(pages, URL_RULES).select(*columns).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_no_pages(spark):
    assert url_verdicts(spark.createDataFrame([], "page_id long, url string, html string"), URL_RULES).collect() == []


FORMS = [
    '<a href="http://bad.net/x">', '<A HREF="HTTP://BAD.net/">', "<a href='https://bad.net'>", "<a href=http://bad.net/>", "<a href=//bad.net>",
    '<a Href = "//bad.net/">', "<a href =\n'http://bad.net?q'>", "<a class=x href= http://bad.net/ id=y>", '<a href=" http://bad.net/ ">',
]


NO_LINKS = ["<a href='/bad.net/'>", "<a href=bad.net>", "<a title='http://bad.net/'>", '<a href="http://other.net/bad.net">']


def test_forms_of_links(spark):
    pages = [(i, f"http://helper{i}.org/", html) for i, html in enumerate([*FORMS, *NO_LINKS])]
    pages = spark.createDataFrame([*pages, (-1, "http://bad.net/es/1", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in url_verdicts(pages, URL_RULES).collect() if r.page_id >= 0}
    assert {i: r.verdict for i, r in got.items()} == {i: "block" if i < len(FORMS) else "allow" for i in got}
    assert len(got) == len(FORMS) + len(NO_LINKS)
