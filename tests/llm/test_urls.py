import random

import duckdb

from layertext.llm import urls

DDL = "page_id long, url string"


def compare(spark, rows):
    df = spark.createDataFrame(rows, DDL).selectExpr("*", "1 as host", "2 as n", "3 as s1")
    got = urls.filter_urls(df).toPandas()
    con = duckdb.connect()
    con.execute("CREATE TABLE pages (page_id BIGINT, url VARCHAR)")
    if rows:
        con.executemany("INSERT INTO pages VALUES (?, ?)", rows)
    want = con.execute(urls.sql())
    names = [d[0] for d in want.description]
    assert sorted(map(repr, got[names].itertuples(index=False, name=None))) == sorted(map(repr, spark.createDataFrame(want.fetchall() or [], urls.filter_urls(df).select(names).schema).toPandas().itertuples(index=False, name=None)))
    return got


def test_rules_and_templates_equal_sql(spark):
    r = random.Random(8)
    hosts = ["example.com", "WWW.example.com", "a.example.net", "b.org", "x.b.org", "other.io"]
    rows = [(i, f"http://{r.choice(hosts)}/{r.choice(['en', 'de', 'es', 'shop/a/b/c/d/e', 'x' + str(i)])}/{r.choice(['7', '8', '', 'p' + str(i % 40)])}{r.choice(['', '?q=1', '#top', '/'])}") for i in range(600)]
    rows += [(None, None), (1, "no scheme"), (2, "://"), (3, "http://com/en/"), (4, "http://COM?x"), (5, "a://b://c/d"), (6, "http://h\n/x"), (3, "http://com/en/")]
    got = compare(spark, rows)
    by = {(u, p): v for u, p, v in zip(got.host, got.path, got.rule)}
    assert by["com", "/en/"] == "com/en/" and by["", ""] is None


def test_rejected_branch():
    assert urls.REJECT > urls.PRIOR


def test_purity_rejects_unruled_siblings(spark):
    rules = (("block", "bad.io/a"), ("allow", "good.io/a"))
    rows = [(i, f"http://bad.io/a{i}/{i}") for i in range(60)] + [(1000 + i, f"http://bad.io/{c}{i}/{i}") for i, c in enumerate("bcd" * 3)] + [(2000 + i, f"http://good.io/{c}{i}/{i}") for i, c in enumerate("abcd" * 9)]
    out = {r.page_id: r.verdict for r in urls.filter_urls(spark.createDataFrame(rows, DDL), rules).collect()}
    assert all(out[i] == "block" for i in range(60)) and all(v == "allow" for i, v in out.items() if i >= 2000)


def test_empty(spark):
    assert urls.filter_urls(spark.createDataFrame([], DDL)).collect() == []
