"""Each stage on rows with repeated ids, nulls, ties and clashing columns, against what they should leave."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

DATA = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, key string, class_id int, lost string, part int, doc string"


def made(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "k", 1, "l", 2, "d") for i, t in rows], COLUMNS)


def left(stage, spark, rows):
    out = STAGES[stage](spark, made(spark, rows), DATA)
    assert out.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    return Counter((r.doc_id, r.text) for r in out.collect())


def words(a, b):
    return " ".join(f"w{i}" for i in range(a, b))


def shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def plain_classes(rows):
    """One row of each group of texts that reach 0.8, directly or through others."""
    groups = []
    for row in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        own = shingles(row[1] or "")
        near = [g for g in groups if own and any(s and len(s & own) >= 0.8 * len(s | own) for _, s in g)]
        groups = [g for g in groups if g not in near] + [[m for g in near for m in g] + [(row, own)]]
    return Counter(min((m[0] for m in g), key=lambda r: (r[0] is None, r[0] or 0)) for g in groups)


def test_near_duplicates_go_by_row(spark):
    rows = [
        (1, words(0, 100)), (1, words(500, 600)), (2, words(0, 100) + " end"), (3, words(900, 950)), (3, words(900, 950)), (None, words(0, 99)), (None, words(2000, 2050)),
        (4, words(40, 140)), (5, None), (6, ""), (7, "..."), (5, None), (9, words(500, 601)), (8, words(500, 602)), (10, "two words"), (11, "two words"),
    ]
    assert left("ngram_join", spark, rows) == plain_classes(rows)


def test_language_and_lines_and_passages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    texts = [r.text for r in docs.orderBy("doc_id").limit(30).collect()]
    rows = [(i // 2, t) for i, t in enumerate(texts)] + [(None, texts[0]), (90, None), (91, ""), (92, "123 456"), (93, texts[1]), (93, texts[1])]
    assert left("language_id", spark, rows) == Counter(r for r in rows if any(c.isalpha() for c in r[1] or ""))
    line = "a line that is longer than forty characters, for sure"
    own = [(i, f"{line}\nown {i}") for i in range(5)] + [(5, line), (6, line), (None, f"x\n{line}"), (7, None), (8, ""), (6, line)]
    assert left("line_dedup", spark, own) == Counter({**{(i, f"own {i}"): 1 for i in range(5)}, (6, line): 2, (None, "x"): 1, (7, ""): 1, (8, ""): 1})
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").where(F.size(F.split("text", " ")) > 20).first().text
    rows = [(1, f"a b c {item} d"), (1, "clean text of some words"), (2, item), (None, item), (None, None), (3, ""), (4, " ".join(reversed(item.split())))]
    assert left("decontamination", spark, rows) == Counter(r for r in rows if item not in (r[1] or ""))


@pytest.mark.parametrize("stage", list(STAGES))
def test_empty_table(spark, stage):
    assert STAGES[stage](spark, made(spark, []).limit(0), DATA).collect() == []


def test_pieces_round_trip(spark):
    rows = [(1, "some words"), (1, "some words"), (2, None), (None, "é ▁ x" * 400), (3, "long " * 30_000)]
    got = STAGES["sentencepiece"](spark, made(spark, rows), DATA).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows) and all(r.round_trip for r in got)
