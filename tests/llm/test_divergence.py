"""Source divergence: hashes and slices against the library, rows against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from tallywright.llm import divergence as dv

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def padded(data):
    out = np.zeros(len(data) + 8, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out


def test_slice_hashes_are_xxh64():
    data = random.Random(1).randbytes(4000)
    starts = np.array([random.Random(i).randrange(3900) for i in range(500)])
    sizes = np.array([1 + i % 60 for i in range(500)])
    got = dv.slice_hashes(padded(data), starts, sizes)
    assert got.tolist() == [xxhash.xxh64_intdigest(data[a : a + n]) for a, n in zip(starts, sizes, strict=True)]


def test_colliding_hashes_are_told_apart():
    data = b"abc abd abc abcd longerthaneight longerthaneighs abd"
    slices = [m.span() for m in re.finditer(rb"\w+", data)]
    starts, sizes = np.array([a for a, _ in slices]), np.array([b - a for a, b in slices])
    first, code = dv.grouped_slices(padded(data), starts, sizes, hashes=np.zeros(len(slices), dtype=np.uint64))
    words = [data[starts[i] : starts[i] + sizes[i]] for i in first]
    assert [words[c] for c in code] == data.split() and len(set(words)) == len(words) == 5


@pytest.mark.parametrize("piece", [16, 1 << 20])
def test_counts_of_a_batch(piece):
    texts = ["A b-a", "", "éÉ x_y Ab", "b", "b" * 40 + " c" * 30, "0\x7f[]", "tail"]
    batch = pa.RecordBatch.from_arrays([pa.array(["l"] * 4 + ["m"] * 3), pa.array(list("stsstts")), pa.array(texts)], names=["lang", "source", "text"])
    got = defaultdict(lambda: [0, 0])
    for out in dv.count_terms(batch.slice(1), piece):
        for r in out.to_pylist():
            key = (r["lang"], r["source"], r["term"])
            got[key] = [got[key][0] + r["n"], got[key][1] + r["docs"]]
    want = defaultdict(lambda: [0, 0])
    for lang, source, text in list(zip(["l"] * 4 + ["m"] * 3, "stsstts", texts, strict=True))[1:]:
        for term, n in Counter(TERM.findall(text.translate(LOWER))).items():
            want[lang, source, term][0] += n
            want[lang, source, term][1] += 1
    assert got == want


def plain(rows, min_docs, top):
    docs, n = defaultdict(Counter), defaultdict(Counter)
    sources = defaultdict(set)
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        found = Counter(TERM.findall((text or "").translate(LOWER)))
        docs[lang].update(found.keys())
        n[lang, source].update(found)
        sources[lang].add(source)
    out = []
    for lang, own in sources.items():
        kept = sorted(t for t, k in docs[lang].items() if k >= min_docs)

        def shares(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 5) // (total + 5 * len(kept)) for t in kept}

        q = shares(sum((n[lang, s] for s in own), Counter()))
        p = {s: shares(n[lang, s]) for s in own}
        for s in own:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s)
            terms = sorted((q[t] - p[s][t], t.encode()) for t in kept if n[lang, s][t] and p[s][t] > q[t])[:top]
            out += [(lang, s, part, i.decode(), -v, k + 1) for part, found in (("pair", pairs), ("term", terms)) for k, (v, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("block", [250_000, 7])
def test_same_as_plain_counting(spark, block):
    draw = random.Random(3)
    pool = ["a", "B", "éa", "zz", "ﬀ", "日本", "w" * 50, *(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))]
    rows = []
    for i in range(400):
        words = [pool[min(int(draw.expovariate(0.08)) + i % 3, len(pool) - 1)] for _ in range(draw.randrange(30))]
        rows.append((draw.choice(["x", "y", None]), draw.choice(["s1", "S", "é", None, ""]), draw.choice([" ", "-", "\n"]).join(words)))
    rows += [("x", "bare", None), ("x", "bare2", "..."), ("rare", "only", "one"), ("rare", "two", ""), ("single", "s", "a " * 50_000)] + [("single", "s", "a")] * 40
    df = spark.createDataFrame(rows, "lang string, source string, text string").withColumn("term", F.lit(1)).withColumn("n", F.lit("n"))
    got = dv.divergences(df, min_docs=12, top=6, block=block)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain(rows, 12, 6)


def test_empty_table_and_large_counts(spark):
    none = spark.createDataFrame([], "lang string, source string, text string")
    assert dv.divergences(none).collect() == []
    n, total, v = 7 * 10**14, 9 * 10**17, 10**9
    got = spark.range(1).select(dv.share(F.lit(n), F.lit(total), F.lit(v)).alias("p")).first().p
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)
