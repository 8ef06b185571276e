"""License scans and URL filters against plain Python and SQL."""

from __future__ import annotations

import duckdb
import pytest

from tests.llm import brute, cases
from tidepool.llm import license_scan, queries, url_filter

pytestmark = pytest.mark.skipif(not cases.HAVE, reason="driver tables not present")


def sql(query, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toArrow())
    return cases.ordered(con.execute(query).fetchall())


def test_license_base(spark):
    docs = cases.sample(spark)
    got = cases.rows(license_scan.scan(docs), "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    pairs = docs.select("doc_id", "text").collect()
    assert got == cases.ordered([(r.doc_id, *brute.license_base(r.text)) for r in pairs])


def test_license_templates(spark):
    texts = [t for t, _ in license_scan.NOTICES.values()]
    rows = [(i, f"Intro. {t.upper()}; the end") for i, t in enumerate(texts)]
    rows += [(100, "licensed maybe by an apache license version 2 0"), (101, "apache license version two"),
             (102, "license " * 3000 + "mit license"), (103, "apache apache license license version")]
    docs = cases.documents(spark, [*rows, *cases.ODD])
    got = {r.doc_id: r for r in license_scan.scan(docs.where("doc_id >= 100 or doc_id < 14")).collect()}
    for i, label in enumerate(license_scan.NOTICES):
        if i not in {d for d, _ in cases.ODD}:
            assert label in got[i].labels.split(",")
    assert got[102].n_base == 1 and got[102].first_word == 3000 and got[102].labels == "mit"
    want = sql(license_scan.oracle("d"), d=docs.select("doc_id", "text"))
    assert cases.rows(license_scan.scan(docs), *(license_scan.scan(docs).columns)) == want


def test_url_rules_and_templates(spark):
    urls = [None, "", "no scheme", "http://", "http://X.COM", "HTTP://WWW.Example.COM/en/1?x=/de/", "http://example.com/en/",
            "http://a.example.com/en/2", "http://notexample.com/en/2", "ftp://y.NET/es/a#b", "a://b://c.net/fr/x", "http://net/fr/1",
            "http://com?x", "http://com/", "http://blog.org/en/99/", "http://blog.org/aabbccddeeff00112233/x", "x://h/\n/é"]
    rows = [(i, u) for i, u in enumerate(urls)]
    rows += [(1000 + i, f"http://many.org/p/slug{chr(97 + i % 26)}{chr(97 + i // 26)}") for i in range(60)]
    rows += [(2000 + i, f"http://z{i % 3}.net/{'es' if i % 4 else 'fr'}/n{i}") for i in range(80)] + [(3000, "http://q.org/es/n5")]
    pages = spark.createDataFrame([(i, u, "x") for i, u in rows] + [(0, None, "x"), (None, "http://h.net/es/1", "x")], "page_id long, url string, html string")
    pages = pages.selectExpr("*", "1 as host", "2 as leaf", "3 as template")
    got = url_filter.judge(pages)
    assert cases.rows(got, *got.columns) == sql(url_filter.oracle("p"), p=pages.select("page_id", "url"))
    by = {r.page_id: r for r in got.collect()}
    assert (by[5].rule, by[5].verdict, by[7].verdict, by[8].rule, by[3000].verdict) == ("www.example.com/en/", "allow", "block", "com/", "block")
    assert (by[4].host, by[4].path, by[4].rule) == ("x.com", "", None)
    assert (by[10].host, by[10].rule) == ("b:", None)
    assert len({by[1000 + i].template for i in range(60)}) == 1


def test_empty_native(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


@pytest.mark.parametrize("name", ["op1_license_scan", "op7_url_filter"])
def test_oracle(spark, name):
    df = queries.QUERIES[name](spark, cases.SF)
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{cases.SF}/{t}.parquet'")
    cur = con.execute(queries.ORACLES[name])
    assert [d[0] for d in cur.description] == df.columns
    assert cases.rows(df, *df.columns) == cases.ordered(cur.fetchall())


def test_url_templates_of_deep_paths(spark):
    slugs = [f"slug{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    urls = [f"http://many.org/es/news/world/{s}" for s in slugs] + [f"http://deep.org/a/b/c/d/e/f/{s}/g" for s in slugs]
    urls += [f"http://z.net/{'es' if i % 4 else 'xx'}/news/world/{s}" for i, s in enumerate(slugs)]
    urls += ["http://many.org/es", "http://many.org/", "http://short.org"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    by = {r.page_id: r for r in url_filter.judge(pages).collect()}
    assert len(by) == len(urls)
    assert len({by[i].template for i in range(60)}) == 1 and by[0].template.endswith("/world/*")
    assert len({by[i].template for i in range(60, 120)}) == 1 and by[60].template.endswith("/f/*/*")
    assert {by[i].verdict for i in range(60)} == {"block"}  # as its template on z.net, where it is labelled


def test_one_long_url_costs_no_jobs(spark):
    """Thousands of segments: no more jobs than without it, and the same verdicts elsewhere."""
    normal = [(i, f"http://h{i % 4}.org/{'ab'[i % 2]}/x{chr(97 + i % 26)}/p{i}") for i in range(60)] + [(100 + i, f"http://z.net/es/s{i}") for i in range(9)]
    long = [(900, "http://long.org" + "/s" * 5000), (901, "http://z.net/es" + "/q" * 3000), (902, "http://h1.org/" + "x" * 50_000)]
    tracker = spark.sparkContext.statusTracker()

    def run(rows, group):
        spark.sparkContext.setJobGroup(group, group)
        got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()
        return {r.page_id: r for r in got}, len(tracker.getJobIdsForGroup(group))

    plain, jobs = run(normal, "plain")
    both, more = run(normal + long, "both")
    spark.sparkContext.setJobGroup("", "")
    assert abs(more - jobs) <= 2
    assert {i: both[i].verdict for i in plain} == {i: r.verdict for i, r in plain.items()}
    assert both[900].rule is None and (both[901].verdict, both[901].rule) == ("block", "net/es/")


def test_chains_without_siblings_need_no_walk(spark):
    """What the closed form gives is what the SQL's walk gives."""
    urls = ["http://a.com/x/y", "http://a.net/es/y", "http://a.net/fr/y/z", "http://b.org/x/y", "http://b.org/", "http://a.net/es", "http://c.net/es/q", "http://c.net/de/q"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = url_filter.judge(pages)
    assert cases.rows(got, *got.columns) == sql(url_filter.oracle("p"), p=pages)
