import datetime as dt

import duckdb
from pyspark.sql import functions as F

from tracewell.llm import oracles, queries, url_lists

SF = "/root/testdata/sf0.01"
D = dt.date


def test_oracle_agrees(spark):
    mine = sorted(map(tuple, queries.op3_url_filters(spark, SF).collect()))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    assert sorted(con.sql(oracles.URL_LISTS).fetchall()) == mine
    assert 0.1 < sum(r[3] for r in mine) / len(mine) < 0.95


def test_hot_patterns_are_parted(spark):
    captures = spark.range(4000).selectExpr("id AS page_id", "concat('http://h', if(id % 3 > 0, 0, id), '.x.com/', id % 5, '/', repeat('long', cast(id % 2 as int) * 20000)) AS url", "date '2024-02-02' AS fetched_at")
    entries = spark.createDataFrame([("a", "x.com", D(2024, 1, 1), "add"), ("b", "h0.x.com", D(2024, 1, 1), "add"), ("c", "h0.x.com/3", D(2024, 3, 1), "add"), ("d", "h3.x.com/3", D(2024, 2, 2), "add")], "list string, pattern string, listed_at date, action string")
    asked = captures.select(F.col("page_id").alias("capture"), F.col("page_id").alias("h"), F.explode(url_lists.patterns_of(F.col("url"))).alias("asked"))
    salts = {r.hot: r.salts for r in url_lists.hot_patterns(asked, 8).collect()}
    assert salts["x.com"] > 1 and salts["h0.x.com"] > 1 and "h3.x.com" not in salts
    rows = {r.page_id: r.lists for r in url_lists.judge(captures, entries).collect()}
    assert rows == {k: "a,b" if k % 3 or k == 0 else "a,d" if k == 3 else "a" for k in range(4000)}


def test_intervals_and_ties(spark):
    entries = spark.createDataFrame(
        [("a", "x.com", D(2024, 1, 1), "add"), ("a", "x.com", D(2024, 2, 1), "remove"), ("a", "x.com", D(2024, 2, 1), "add"), ("a", "x.com", D(2024, 3, 1), "add"),
         ("b", "s.x.com/p", D(2024, 1, 5), "add"), ("b", None, D(2024, 1, 5), "add"), ("b", "x.com", None, "add"), ("a", "x.com", D(2024, 3, 1), "add")],
        "list string, pattern string, listed_at date, action string",
    )
    got = {(r.pattern, r.since, r.until) for r in url_lists.intervals(entries).collect()}
    assert got == {("x.com", D(2024, 1, 1), D(2024, 2, 1)), ("x.com", D(2024, 3, 1), None), ("s.x.com/p", D(2024, 1, 5), None)}
    captures = spark.createDataFrame(
        [(1, "http://X.com/", D(2023, 12, 31), "q"), (2, "http://a.x.com:80/z?u", D(2024, 1, 1), "q"), (3, "http://x.com", D(2024, 2, 1), "q"), (4, "https://u@s.x.com/P/r#f", D(2024, 4, 1), "q"),
         (5, None, D(2024, 1, 1), "q"), (6, "not a url", D(2024, 1, 1), "q"), (7, "http://x.com", None, "q"), (None, "http://x.com", D(2024, 1, 1), "q"), (2, "http://b.x.com", D(2024, 1, 2), "q")],
        "page_id long, url string, fetched_at date, list string",
    )
    rows = url_lists.judge(captures, entries).collect()
    assert len(rows) == 9
    verdict = {r.page_id: (r.n_active, r.lists, r.blocked) for r in rows}
    assert verdict == {1: (0, "", False), 2: (1, "a", True), 3: (0, "", False), 4: (2, "a,b", True), 5: (0, "", False), 6: (0, "", False), 7: (0, "", False), None: (1, "a", True)}
    assert url_lists.judge(captures.limit(0), entries).count() == 0
    assert not any(r.blocked for r in url_lists.judge(captures, entries.limit(0)).collect())
