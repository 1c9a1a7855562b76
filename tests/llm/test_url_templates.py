"""Rules, templates and verdicts; the whole query is held against its SQL with the others."""

from lexspan.llm.url_templates import judged

LABELS = "page_id long, bad boolean"


def test_edge_cases(spark):
    urls = [None, "", "no-scheme/x", "http://", "HTTP://A.B.NET", "http://A.b.net/x?y", "x://net/", "x://notnet/", "x://example.net/en/1", "x://sub.example.net/en/", "x://example.com/de", "x://a.example.com/de/q#z", "x://org/fr/", "x://y://net/", "x://É.ORG/fr/a/b/c/d", "x://net\n/"]
    pages = spark.createDataFrame([(i, u, "r", "t") for i, u in enumerate(urls)] + [(None, "x://net/", "r", "t"), (3, "http://", "r", "t")], "page_id long, url string, rule string, t string")
    labels = spark.createDataFrame([(None, True), (2, None), (5, False)], LABELS)
    rows = judged(pages, labels).collect()
    assert len(rows) == len(urls) + 2
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in rows if r.page_id is not None}
    nothing = ("", "", None, "allow")
    assert [got[i] for i in range(4)] == [nothing, nothing, nothing, nothing]
    assert got[4] == ("a.b.net", "", None, "allow")
    assert got[5] == ("a.b.net", "/x", "net/", "block")
    assert got[6][2:] == ("net/", "block") and got[7][2:] == (None, "allow")
    assert got[8][2:] == got[9][2:] == ("example.net/en/", "allow")
    assert got[10][2:] == (None, "allow") and got[11] == ("a.example.com", "/de/q", "example.com/de/", "block")
    assert got[12][2:] == ("org/fr/", "allow") and got[13][:3] == ("y:", "//net/", None)
    assert got[14][:3] == ("É.org", "/fr/a/b/c/d", "org/fr/") and got[15][0] == "net\n"
    assert judged(pages.limit(0), labels).collect() == [] and judged(pages, labels.limit(0)).count() == len(rows)


def test_bad_templates_are_rejected(spark):
    """One branch of a host is spam by its labels, the other isn't; numbers and slugs generalise."""
    rows, labels = [], []
    for i in range(200):
        spam = i % 2 == 0
        rows.append((i, f"http://h.example/{'win' if spam else 'news'}/{i}/page"))
        if i < 120:
            labels.append((i, spam))
    rows += [(1000 + i, f"http://h.example/topic{i}") for i in range(30)] + [(2000, "http://other.example/win/1")]
    out = {r.page_id: r for r in judged(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, LABELS), rules=[]).collect()}
    assert out[198].verdict == "block" and out[199].verdict == "allow" and out[2000].verdict == "allow"
    assert out[198].template.startswith("h.example/win/") and out[198].n_pages == 100
    assert out[1000].template == out[1029].template


def test_query_against_sql(spark, sf):
    import duckdb

    import __spark_entry__ as entry

    con = duckdb.connect()
    for t in ("pages", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    found = con.execute(entry.oracle_sql()["op5_url_templates"])
    names = [d[0] for d in found.description]
    df = entry.queries()["op5_url_templates"](spark, sf)
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == sorted(map(str, found.fetchall()))


def test_branches_below_the_third_segment(spark):
    """Spam and clean pages part at the fourth segment, and at the tenth."""
    rows, labels = [], []
    for i in range(200):
        bad = i % 2 == 0
        rows += [(i, f"http://h.example/a/b/c/{'win' if bad else 'news'}/i{i}"), (1000 + i, f"http://d.example/{'x/' * 9}{'win' if bad else 'news'}/{i}")]
        labels += [(i, bad), (1000 + i, bad)] if i < 160 else []
    rows.append((5000, "http://long.example/" + "s/" * 3000 + "z" * 5000))
    out = {r.page_id: r for r in judged(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(labels, LABELS), rules=[]).collect()}
    assert len(out) == len(rows)
    assert all(out[i].verdict == out[1000 + i].verdict == ("block" if i % 2 == 0 else "allow") for i in range(200))
    assert out[5000].verdict == "allow" and out[198].template.startswith("h.example/{=}/{=}/{=}/win/")
