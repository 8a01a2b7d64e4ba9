"""Exact dedup against a plain grouping, and its edges."""

import hashlib
from collections import Counter, defaultdict

import pytest

from tallywright.llm.exact_dedup import BLANKS, bloom_of_repeats, copy_classes, drop_copies, filter_bits

ROWS = [
    (5, "a b\tc"), (3, "abc"), (9, "a  b\r\nc"), (2, "a  b\x0b\x0cc"), (1, None), (4, ""), (6, " \n "), (7, "A b c"), (8, "a bc"),
    (10, "é" * 3), (11, "x" * 200_000), (12, " " + "x" * 200_000), (13, "alone"), (13, "alone too"), (14, "twice"), (14, "twice"), (None, "twice"), (None, "no id"),
]


def bare(text):
    return "".join(c for c in text or "" if c not in BLANKS)


def plain(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[bare(t)].append((-len(t or ""), i is None, i))
    out = []
    for key, members in groups.items():
        first = min(members, key=lambda m: (m[0], m[1], m[2] or 0))
        sha = hashlib.sha256(key.encode()).hexdigest()
        out += [(i, first[2], len(members), sha) for _, _, i in members]
    return Counter(out), {key: min(m, key=lambda m: (m[0], m[1], m[2] or 0)) for key, m in groups.items()}


@pytest.mark.parametrize("max_bits", [1 << 28, 1 << 12])
def test_same_as_plain_grouping(spark, max_bits):
    rows = ROWS + [(100 + i, f"text {i % 700}") for i in range(1000)]
    docs = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id long, text string, sha string")
    got = copy_classes(docs, max_bits=max_bits).collect()
    want, first = plain(rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.sha.hex()) for r in got) == want
    kept = Counter(r.sha.hex() for r in got if r.kept)
    assert set(kept.values()) == {1} and len(kept) == len(first)
    assert all(r.doc_id == r.keep_id for r in got if r.kept)
    left = drop_copies(docs, max_bits=max_bits)
    assert left.columns == docs.columns
    assert sorted((bare(r.text), -len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in left.collect()) == sorted((k, a, b, c or 0) for k, (a, b, c) in first.items())


def test_one_large_group_and_empty_table(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, concat('same', repeat(' ', int(id % 7))), concat('own ', id)) AS text")
    got = copy_classes(docs)
    assert got.where("group_size = 1000").count() == 1000 and got.where("kept").count() == 2001
    assert {r.keep_id for r in got.where("group_size = 1000").collect()} == {6}
    empty = docs.limit(0)
    assert copy_classes(empty).collect() == [] and drop_copies(empty).collect() == []


def test_only_rows_that_may_repeat_are_tested_true(spark):
    from pyspark.sql import functions as F

    from tallywright.llm.exact_dedup import _tested

    hashed = spark.range(20_000).select(F.unhex(F.sha2(F.when(F.col("id") < 100, F.lit("x")).otherwise(F.col("id").cast("string")), 256)).alias("sha"))
    bits = filter_bits(20_000)
    maybe = _tested(hashed, bloom_of_repeats(hashed, bits), bits).where("maybe").count()
    assert 100 <= maybe <= 100 + 0.03 * 20_000
