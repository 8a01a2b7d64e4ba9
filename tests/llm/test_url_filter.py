"""The model on URLs it was not trained on, and the defined results."""

import zlib

from tallywright.llm import url_filter as uf


def test_held_out_accuracy():
    rows, part = uf.labelled_urls(), lambda r: zlib.crc32(r[0].encode()) % 3
    model = uf.train([r for r in rows if part(r)])
    held = [r for r in rows if not part(r)]
    right = sum((model.score(*uf.parts(url)) >= 0.5) == bool(blocked) for url, blocked in held)
    print(right, len(held))
    assert len(held) > 90 and right >= 0.9 * len(held)


def test_no_host_of_the_pages_is_in_the_table(spark):
    names = {uf.parts(r.url)[0].rsplit(".", 2)[0].split(".")[-1] for r in spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url").collect()}
    known = {uf.parts(u)[0].rsplit(".", 1)[0].split(".")[-1] for u, _ in uf.labelled_urls()}
    assert not names & known


def test_junk_hosts_of_the_pages(spark):
    rows = uf.judge(spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select("url")).collect()
    junk = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
    own = [r for r in rows if r.rule is None]
    right = sum((r.verdict == "block") == any(j in r.host for j in junk) for r in own)
    assert right >= 0.95 * len(own)


def test_defined_results(spark):
    rows = [(1, None, "h"), (2, "", "h"), (3, "no scheme", "h"), (4, "http://" + "a" * 50_000 + ".org/x", "h"), (4, "http://A.Example.com/en/7", "h"), (4, "http://A.Example.com/en/7", "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, judged string")
    got = uf.judge(pages)
    assert got.columns == ["page_id", "url", "judged", "host", "path", "rule", "verdict", "score"]
    found = got.collect()
    assert [(r.host, r.path) for r in found if r.page_id < 4] == [("", "")] * 3 and len(found) == 6
    assert uf.judge(pages.limit(0)).count() == 0 and uf.train([]).score("a", "b") == 0.5
