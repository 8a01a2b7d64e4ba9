"""Which alignments count, against all stretches by brute force."""

from itertools import combinations

from pyspark.sql import functions as F

from tallywright.llm.decontaminate import MASKS, MIN_SHARE, MIN_WORDS, SHORT, SHORT_MASKS, best_stretch, clean_documents, overlaps


def counts(same, enough):
    n = len(same)
    return any(5 * sum(same[a:b]) >= 4 * (b - a) for a in range(n) for b in range(a + enough, n + 1))


def test_any_stretch_that_is_long_enough_counts(spark):
    """Items of 8 to 30 words, every placing of one and two replaced words; and half-alike ones."""
    cases = [[int(i not in gone) for i in range(n)] for n in range(8, 31) for k in (0, 1, 2) for gone in combinations(range(n), k)]
    cases += [[int((i * i + seed * i) % 7 > seed % 3) for i in range(n)] for n in (13, 20, 30) for seed in range(40)]
    rows = [(i, [s if s else -1 for s in same], [1] * len(same)) for i, same in enumerate(cases)]
    df = spark.createDataFrame(rows, "i int, d array<bigint>, b array<bigint>").repartition(8)
    enough = F.least(F.lit(MIN_WORDS), F.size("b"))
    for r in df.select("i", enough.alias("enough"), best_stretch(F.col("d"), F.col("b"), enough, MIN_SHARE).alias("s")).collect():
        same, s = cases[r.i], r.s
        assert (s.sum >= 0) == counts(same, r.enough), same
        assert s.n_words >= r.enough and s.n_same == sum(same[s.start : s.start + s.n_words])
        assert s.sum == 5 * s.n_same - 4 * s.n_words
        assert s.sum == max(5 * sum(same[a:b]) - 4 * (b - a) for a in range(len(same)) for b in range(a + r.enough, len(same) + 1))


def test_a_word_replaced_near_an_end(spark):
    """A 15-word item with one word replaced, at each place."""
    item = [f"w{i}" for i in range(15)]
    rows = [(at, " ".join(["a"] * 9 + item[:at] + ["other"] + item[at + 1 :] + ["b"] * 9)) for at in range(15)]
    docs = spark.createDataFrame([*rows, (99, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")
    assert [r.doc_id for r in clean_documents(docs, items).collect()] == [99]


def test_masks_reach_every_placing():
    """Some mask fits between the replaced words, wherever they are: 3 to 25 words, as many replaced as the share admits."""
    for n in range(3, 26):
        masks = SHORT_MASKS if n < SHORT else MASKS
        places = [sum(1 << (at + i) for i, c in enumerate(m) if c == "1") for m in masks for at in range(n - len(m) + 1)]
        for gone in combinations(range(n), n // 5):
            replaced = sum(1 << i for i in gone)
            assert any(not place & replaced for place in places), (n, gone)


def test_short_items(spark):
    """Every length from 3 words, evenly replaced as far as the share admits; one more is too many."""
    items = [(n, [f"i{n}w{i}" for i in range(n)]) for n in range(3, 26)]
    rows = []
    for n, item in items:
        for more in (0, 1):
            k = n // 5 + more
            gone = {(i + 1) * n // (k + 1) for i in range(k)} if n < 13 or not more else set(range(1, n, 3))
            rows.append((2 * n + more, " ".join(["a", *("other" if i in gone else w for i, w in enumerate(item)), "b"])))
    found = overlaps(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(n, " ".join(i)) for n, i in items], "item_id long, text string"))
    assert sorted({(r.doc, r.item) for r in found.collect()}) == [(2 * n, n) for n, _ in items]
