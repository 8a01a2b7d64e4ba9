"""Line dedup against its own SQL on made-up tables, and the defined results."""

import random

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tallywright.llm import line_dedup as ld


def both(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'q' AS lost", "1 AS doc", "2 AS n_lines")
    out = ld.dedup_lines(docs)
    assert out.columns == ["doc_id", "text", "lost", "doc", "n_lines", "n_dropped"]
    got = out.selectExpr("doc_id", "n_lines", "n_dropped", "sha2(text, 256) AS kept_sha256", "lost", "doc").collect()
    assert all((r.lost, r.doc) == ("q", 1) for r in got)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame({"doc_id": [i for i, _ in rows], "text": pd.Series([t for _, t in rows], dtype=object)}))
    return sorted(tuple(r)[:4] for r in got), sorted(con.execute(ld.OP10_SQL).fetchall())


@pytest.mark.parametrize("broadcast", [0, 1000])
def test_against_sql(spark, monkeypatch, broadcast):
    monkeypatch.setattr(ld, "BROADCAST_LINES", broadcast)
    rng = random.Random(2)
    common = [f"Common line number {i} that is long enough to be counted {i}" for i in range(30)]
    made = lambda: rng.choice([rng.choice(common), f"  {rng.choice(common).upper()}\t", "short", "", f"own {rng.random()} line that is long enough to be looked at"])
    rows = [(i, "\n".join(made() for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(500, None), (501, "")]
    got, want = both(spark, rows)
    assert got == want and sum(r[2] for r in got) > 50


def test_rows_of_one_id_are_one_document(spark):
    line = "This very line stands in a handful of rows of two documents only"
    rows = [(1, f"{line}\n{i}") for i in range(5)] + [(2, line)]
    out = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"))
    assert [r.n_dropped for r in out.collect()] == [0] * 6
    rows += [(i, f"{line}\nx") for i in (3, 4, 9)]
    out = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_dropped) for r in out) == [(1, 1)] * 5 + [(2, 1), (3, 1), (4, 1), (9, 0)]
    assert sorted(r.text for r in out if r.doc_id == 1) == ["0", "1", "2", "3", "4"]


def test_null_ids_and_empty(spark):
    line = "A line of more than forty characters in some documents without id"
    rows = [(None, line), (None, line), (1, line), (2, line), (3, line), (4, line), (4, line)]
    out = ld.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.n_dropped) for r in out), key=str) == sorted([(None, 1), (None, 1), (1, 1), (2, 1), (3, 1), (4, 0), (4, 0)], key=str)
    assert ld.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_a_document_of_many_lines(spark):
    import time

    common = "a line of over forty characters that many documents hold"
    start = None
    for n in (8_000, 64_000):
        long = spark.range(1).select(F.lit(0).cast("long").alias("doc_id"), F.array_join(F.concat(F.array(F.lit(common)), F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("own line "), i))), "\n").alias("text"))
        short = spark.range(1, 7).select(F.col("id").alias("doc_id"), F.lit(common).alias("text"))
        start = time.time()
        row = ld.dedup_lines(long.unionByName(short)).where("doc_id = 0").first()
        assert (row.n_lines, row.n_dropped) == (n + 1, 1) and row.text.startswith("own line 1\n") and row.text.endswith(f"own line {n}")
    assert time.time() - start < 30
