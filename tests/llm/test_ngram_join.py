import random

from tallywright.llm.ngram_join import bands_for, join_classes


def shingles(text):
    w = "".join(c.lower() if c.isalnum() else " " for c in text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    links = {i: 0 for i, _ in rows}
    group = {i: i for i, _ in rows}
    for n, (i, a) in enumerate(rows):
        for j, b in rows[:n]:
            if a and b and len(a & b) >= 0.8 * len(a | b):
                links[i] += 1
                links[j] += 1
                lo, hi = sorted((group[i], group[j]))
                group = {k: lo if v == hi else v for k, v in group.items()}
    return {(i, group[i], links[i]) for i, _ in rows}


def test_against_brute_force(spark):
    rng = random.Random(3)
    base = [[f"w{rng.randrange(500)}" for _ in range(120)] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "one two"), (3, "One, two"), (4, "!?")]
    for i in range(10, 170):
        w = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(9)
        rows.append((i, " ".join(w)))
    docs = spark.createDataFrame(rows + [(None, "one two")], "doc_id long, text string")
    for block in (1024, 7):
        got = {tuple(r) for r in join_classes(docs, block=block).collect()}
        assert (None, None, None) in got
        assert got - {(None, None, None)} == brute(rows)


def test_empty_and_bands(spark):
    assert join_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    n = bands_for(0.8, 0.999, 7)
    assert (1 - 0.8**7) ** n <= 0.001 < (1 - 0.8**7) ** (n - 1)
