"""All queries on small tables: SQL where there is some, else brute force and known facts."""

import re
from collections import defaultdict

import duckdb
import pytest

import corpus_pipeline
from tallywright.llm import decontaminate
from tallywright.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.execute(ORACLES[name])
    names = [d[0] for d in want.description]
    got = sorted(tuple(r) for r in QUERIES[name](spark, DATA).select(*names).collect())
    assert got == sorted(want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, DATA).collect()


def test_url_parts_and_rules(spark):
    from tallywright.llm.url_filter import RULES, judge

    urls = [None, "", "no", "http://A.Example.com/en/7?x", "https://x.net", "http://b.org/es/#a", "http://com/en/1", "s://exam.com/EN/"]
    rows = judge(spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")).orderBy("page_id").collect()
    for r in rows:
        m = re.match(r".*?://([^/?#]*)([^?#]*)", r.url or "", re.S)
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        fits = [(len(k), k, v) for k, v in RULES for h, p in [k.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        assert (r.host, r.path, r.rule) == (host, path, max(fits)[1] if fits else None)
        assert not fits or r.verdict == max(fits)[2]


def test_language_held_out(spark):
    got = QUERIES["op9_language_id"](spark, DATA).join(spark.read.parquet(f"{DATA}/documents.parquet"), "doc_id")
    rows = [r for r in got.collect() if r.held_out and r.lang_pred != "und" and r.lang and len(r.text) > 100]
    assert sum(r.lang_pred == r.lang for r in rows) >= 0.9 * len(rows)


def test_decontamination_finds_changed_passages(spark):
    item = [f"w{i}" for i in range(40)]
    changed = list(item)
    changed[12] = changed[25] = "other"
    rows = [(1, " ".join(["a"] * 30 + item + ["b"] * 30)), (2, " ".join(changed)), (3, "w1 w2 w3"), (4, None), (5, ""), (6, " ".join(reversed(item)))]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, item string")
    items = spark.createDataFrame([(7, " ".join(item)), (8, None), (9, "")], "item_id long, text string")
    for block in (decontaminate.BLOCK, 20):
        kept = decontaminate.clean_documents(docs, items, block=block)
        assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    seen = defaultdict(set)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns
        seen[name] = {r.doc_id for r in out.select("doc_id").collect()}
    assert len(seen["language_id"]) >= 190 and 0 < len(seen["ngram_join"]) < len(seen["line_dedup"])
    assert corpus_pipeline.run(spark, DATA).where("n_tokens > 0").count() > 0
