"""Votes and trigrams do not depend on windows; answers agree with the labels; defined results."""

import numpy as np
import pyarrow as pa
import pytest

from tallywright.llm import quality

TEXTS = ["", None, "One two two two. " * 30, "A sentence of plain words. " * 40, "BUY NOW!!! $$$ ### " * 25, "x" * 300, "é ü ö " * 50, "  lead and trail  ", "|| a || b || " * 30]


@pytest.mark.parametrize("window", [8, 33, 100])
def test_windows_change_nothing(monkeypatch, window):
    column = pa.array(TEXTS)
    whole = quality.votes(column)

    def grams():
        out = np.zeros((len(TEXTS), 256), dtype=int)
        for raw, row, counted in quality.byte_runs(column):
            slots, of = quality.trigrams(raw, row, counted, 8)
            np.add.at(out, (of, slots), 1)
        return out

    want = grams()
    monkeypatch.setattr(quality, "WINDOW", window)
    assert (quality.votes(column) == whole).all() and (grams() == want).all()
    assert want.sum(axis=1).tolist() == [max(0, len((t or "").encode()) - 2) for t in TEXTS]


def test_agrees_with_labels(spark):
    data = "/root/testdata/sf0.01"
    rows = quality.op8_quality(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").collect()
    assert sum(r.keep == bool(r.quality) for r in rows) >= 0.9 * len(rows)


def test_defined_results(spark):
    docs = spark.createDataFrame([(i, t, 0.5, "f") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], 0.5, "f")] * 300, "doc_id long, text string, score double, found string")
    got = quality.judge(docs, *quality.train(docs))
    assert got.columns == ["doc_id", "text", "found", "n_good", "n_bad", "posterior", "score", "keep"]
    rows = got.collect()
    assert len(rows) == len(TEXTS) + 300 and all((r.score, r.keep) == (0.0, False) for r in rows if not r.text)
    empty = docs.limit(0)
    assert quality.judge(empty, *quality.train(empty)).count() == 0
