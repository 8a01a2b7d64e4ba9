"""Rank-order profiles against a plain out-of-place distance, and the defined results."""

import random
from collections import Counter

from tallywright.llm import language_id as lid


def plain_grams(text):
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split(" ")
    out = []
    for word in filter(None, words):
        marked = f" {word} "
        out += list(word)
        out += [marked[i : i + 2] for i in range(len(marked) - 1)]
        out += [marked[i : i + 3] for i in range(len(marked) - 2)]
    # A blank between words is one edge, seen from either side.
    return out


def code(gram):
    out = 0
    for c in gram:
        out = (out << 21) | ord(c)
    return out


def plain_ranking(text, top):
    counts = Counter(map(code, plain_grams(text)))
    return sorted(counts, key=lambda g: (-counts[g], g))[:top]


def plain_nearest(rankings, text, top):
    own = plain_ranking(text, top)
    if not own:
        return "und", 0.0
    found = []
    for name in sorted(rankings):
        place = {g: i for i, g in enumerate(rankings[name])}
        apart = sum(abs(place[g] - i) if g in place else top for i, g in enumerate(own))
        found.append((apart, name))
    apart, name = min(found)
    return name, 1 - apart / (len(own) * top)


def test_distance_is_the_plain_one(monkeypatch):
    rng = random.Random(3)
    alphabets = {"a": "abcdefg", "b": "fghijkl", "c": "klmnopé"}
    texts = {n: " ".join("".join(rng.choices(s, k=rng.randint(1, 7))) for _ in range(300)) for n, s in alphabets.items()}
    for top in (5, 40, 300):
        rankings = {n: plain_ranking(t, top) for n, t in texts.items()}
        profiles = lid.Profiles.of(rankings, top)
        for window in (16, 1 << 17):
            monkeypatch.setattr(lid, "WINDOW", window)
            for _ in range(40):
                n = rng.choice("abc")
                text = " ".join("".join(rng.choices(alphabets[n] + "XY1!", k=rng.randint(1, 9))) for _ in range(rng.randint(1, 60)))
                name, score = profiles.nearest(text)
                want, near = plain_nearest(rankings, text, top)
                assert name == want and abs(score - near) < 1e-12


def test_defined_results(spark):
    rows = [(1, "aaa bbb", None, "x"), (2, None, "en", "x"), (3, "", "en", "x"), (4, "12 !?", "en", "x"), (5, "aaa bbb " * 40_000, "en", "x"), (5, "aaa bbb", "en", "x"), (None, "aaa", "en", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, found string")
    profiles = lid.learn(docs, "doc_id", "text", "lang")
    assert profiles.names == ("en",)
    got = lid.identify(docs, profiles)
    assert got.columns == [*docs.columns, "lang_pred", "score"]
    found = [(r.doc_id, r.lang_pred) for r in got.collect()]
    assert sorted(found, key=str) == sorted([(1, "en"), (2, "und"), (3, "und"), (4, "und"), (5, "en"), (5, "en"), (None, "en")], key=str)
    assert all(0 <= r.score <= 1 for r in got.collect())
    empty = lid.learn(docs.limit(0), "doc_id", "text", "lang")
    assert [r.lang_pred for r in lid.identify(docs, empty).collect()] == ["und"] * 7
    assert lid.identify(docs.limit(0), profiles).count() == 0


def test_many_languages(spark):
    docs = spark.createDataFrame([(i, "abc" * (i % 5 + 1), f"l{i:04}") for i in range(700)], "doc_id long, text string, lang string")
    assert len(lid.learn(docs, "doc_id", "text", "lang").names) == 700
