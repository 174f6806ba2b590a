from pyspark.sql import functions as F

from stipendlens.llm import url_reputation as U

PAGES = "page_id bigint, url string, html string, bad int, host string, verdict string"


def judge(spark, rows):
    return {r["page_id"]: r for r in U.judge_urls(
        spark.createDataFrame([(*r, "clash", "clash") for r in rows], PAGES), outcome=F.col("bad")).collect()}


def test_rules_hosts_and_paths(spark):
    urls = {1: ("https://WWW.Example.com/en/x?q#f", "www.example.com", "/en/x", "www.example.com/en/", "allow"),
            2: ("http://m.example.com/en/", "m.example.com", "/en/", "example.com/en/", "block"),
            3: ("http://notexample.com/en/", "notexample.com", "/en/", "com/", "allow"),
            4: ("http://a.net/es/1", "a.net", "/es/1", "net/es/", "block"), 5: ("http://a.net", "a.net", "", None, "allow"),
            6: ("http://com?x", "com", "", None, "allow"), 7: ("no scheme", "", "", None, "allow"), 8: (None, "", "", None, "allow"),
            9: ("x://y://z/p", "y:", "//z/p", None, "allow"), 10: ("", "", "", None, "allow"), 11: ("://\n/a#b", "\n", "/a", None, "allow")}
    got = judge(spark, [(k, v[0], None, None) for k, v in urls.items()])
    assert {k: tuple(r)[1:] for k, r in got.items()} == {k: v[1:] for k, v in urls.items()}


def test_reputation_is_shrunk_and_joined_back(spark):
    rows = [(i, f"http://spam.org/{i}", "", 1) for i in range(40)]
    rows += [(100 + i, f"http://ok{i % 8}.org/x", "", 0) for i in range(80)]
    rows += [(300, "http://once.org/", "", 1), (301, "http://spam.org/unlabelled", None, None), (301, "http://spam.org/unlabelled", None, None)]
    got = judge(spark, rows)
    assert {got[i]["verdict"] for i in range(40)} == {"block"} and got[301]["verdict"] == "block"
    assert got[300]["verdict"] == "allow", "one bad page is not evidence enough"
    assert {got[100 + i]["verdict"] for i in range(80)} == {"allow"}


def test_posterior_matches_the_formula(spark):
    rows = [("a.x.org", 1)] * 9 + [("a.x.org", 0)] + [("b.x.org", 0)] * 30 + [("c.y.net", 1)] * 3 + [("c.y.net", 0)] * 17
    got = {r["host"]: r for r in U.host_reputation(spark.createDataFrame(rows, "host string, bad int")).collect()}
    assert got["a.x.org"]["n_pages"] == 10 and got["a.x.org"]["n_bad"] == 9
    assert 0.3 < got["a.x.org"]["post_mean"] < 0.9 and got["b.x.org"]["post_mean"] < 0.2
    assert all(r["post_lower"] <= r["post_mean"] for r in got.values())


def test_public_suffixes_and_ports(spark):
    hosts = ["a.b.co.uk", "b.co.uk:8080", "co.uk", "uk", "x.example.com:", "example.com", "", "a.b.c.org", "c.org"]
    rows = {r["h"]: (r["d"], r["s"]) for r in spark.createDataFrame([(h,) for h in hosts], "h string").select(
        "h", U.registered_domain_of(F.col("h")).alias("d"), U.suffix_of(F.col("h")).alias("s")).collect()}
    assert rows == {"a.b.co.uk": ("b.co.uk", "co.uk"), "b.co.uk:8080": ("b.co.uk", "co.uk"), "co.uk": ("co.uk", "co.uk"), "uk": ("uk", "uk"),
                    "x.example.com:": ("example.com", "com"), "example.com": ("example.com", "com"), "": ("", ""),
                    "a.b.c.org": ("c.org", "org"), "c.org": ("c.org", "org")}
    # a registered name under co.uk does not answer for its neighbours
    pages = [(i, f"http://w{i % 4}.bad.co.uk/{i}", "", 1) for i in range(60)] + [(100 + i, f"http://w{i % 4}.good.co.uk/{i}", "", 0) for i in range(60)]
    got = judge(spark, pages + [(500, "http://new.bad.co.uk/", "", 1), (501, "http://new.good.co.uk/", "", 1)])
    assert got[500]["verdict"] == "block" and got[501]["verdict"] == "allow"


def test_content_rule_blocks_a_host_of_junk_as_the_sql_does(spark, tmp_path):
    """Without labels: junk by repeated words, symbols or capitals; the same verdicts from DuckDB."""
    import duckdb

    from stipendlens.llm.oracles import OP8

    words = " ".join(f"word{i} text" for i in range(40))
    junk = ("<p>" + "buy " * 60 + "</p>", "<b>" + "$$$ *** " * 30 + words[:50] + "</b>", "<i>" + words.upper() + "</i>")
    pages = [(i, f"http://shop.junk.org/{i}", junk[i % 3]) for i in range(30)]
    pages += [(100 + i, f"http://h{i % 6}.fine.org:80/{i}", f"<p>{words} {i}</p>") for i in range(60)]
    pages += [(200, "http://shop.junk.org/fine", words), (201, "http://shop.junk.org/none", None), (202, None, junk[0]),
              (203, "http://a.co.uk/" + "x" * 300_000, "<p>" + words * 2_000 + "</p>"), (204, "", "")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    got = sorted(map(tuple, U.judge_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()))
    verdicts = {r[0]: r[4] for r in got}
    assert {verdicts[i] for i in [*range(30), 200, 201]} == {"block"} and {verdicts[100 + i] for i in range(60)} == {"allow"}
    df.coalesce(1).write.parquet(str(tmp_path / "pages"))
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{tmp_path}/pages/*.parquet'")
    assert sorted(con.sql(OP8).fetchall()) == got


def test_empty_table(spark):
    assert U.judge_urls(spark.createDataFrame([], PAGES)).count() == 0
