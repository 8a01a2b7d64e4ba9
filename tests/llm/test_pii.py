import hashlib
import re

from tallywright.llm.pii import KINDS, base_spans, op5_pii, sanitise

RULES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        odd = digits[::-1][::2]
        even = [d * 2 - 9 * (d > 4) for d in digits[::-1][1::2]]
        return 16 <= len(digits) <= 19 and (sum(odd) + sum(even)) % 10 == 0
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k in KINDS for m in re.finditer(RULES[k], text or "") if good(k, m[0])]


def test_base_spans(spark):
    texts = [
        None, "", "x", "mail a.b@c.de, a@b.c_d@e.f @ a@b x@y..z me@x.y.z.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3",
        "4111 1111 1111 1111 and 4111-1111-1111-1112 5500000000000004-", "ü😀 +1 (555) 123-4567, +49 30 1234567. +123 +1-2-",
        "9" * 30000, "a" * 50000 + "@", "1 " * 20000, "a@b" + ".c" * 20000, "+1" + "-2" * 20000,
    ]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for row in base_spans(docs).collect():
        assert [(s.kind, s.start, s.end) for s in row.base] == brute(row.text), row.doc_id


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    for row in base_spans(docs).collect():
        assert [(s.kind, s.start, s.end) for s in row.base] == brute(row.text)


def test_query(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in op5_pii(spark, "/root/testdata/sf0.001").collect():
        want = brute(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in KINDS] == [sum(w[0] == k for w in want) for k in KINDS]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()


def test_disclosing_terms(spark):
    rows = [(i, f"the agent zorro wrote ann@x.org for us {i}") for i in range(5)]
    rows += [(i, f"the agent smith{i} wrote user{i}@x.org for us") for i in range(10, 40)]
    got = {r.doc_id: r for r in sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [s.value for s in got[0].added] == ["zorro"] and got[0].clean == "the agent  wrote [EMAIL] for us 0"
    assert not got[11].added and got[11].clean == "the agent smith11 wrote [EMAIL] for us"
    assert hashlib.sha256(got[11].clean.encode()).hexdigest()


def test_empty(spark):
    assert sanitise(spark.createDataFrame([], "doc_id long, text string, base int")).collect() == []


def test_rare_entities_are_judged(spark):
    """A name that stands once, beside an email that stands once, is told by the size of the corpus alone."""
    rows = [(0, "the agent zorro wrote ann@x.org for us")]
    rows += [(i, f"the agent wrote user{i}@x.org for us") for i in range(1, 1500)]
    got = sanitise(spark.createDataFrame(rows, "doc_id long, text string")).where("size(added) > 0").collect()
    assert [(r.doc_id, [s.value for s in r.added], r.clean) for r in got] == [(0, ["zorro"], "the agent  wrote [EMAIL] for us")]


def test_terms_count_over_whole_texts_and_are_marked_everywhere(spark):
    """Far from the entity a term is a span too; one that is frequent away from all entities is none."""
    far = " ".join(["far"] * 60)
    rows = [(i, f"Zorro {far} often wrote ann@x.org, {far} zorro.") for i in range(5)]
    rows += [(i, f"the agent wrote user{i}@x.org for us") for i in range(10, 40)]
    rows += [(i, f"far away they often talk of {i}") for i in range(40, 400)]
    docs = spark.createDataFrame(rows + rows[:1] * 9, "doc_id long, text string")
    got = sanitise(docs).where("size(added) > 0").collect()
    assert sorted(r.doc_id for r in got) == [0] * 10 + [1, 2, 3, 4]
    for r in got:
        assert [(s.value, s.start, s.end) for s in r.added] == [("zorro", m.start(), m.end()) for m in re.finditer("(?i)zorro", r.text)]
        assert r.clean == f" {far} often wrote [EMAIL], {far} ."


def test_terms_against_brute_force(spark):
    import math
    import random

    rng = random.Random(5)
    texts = []
    for _ in range(1500):
        k, holds = rng.randrange(100), rng.random() < 0.5
        told = f"x{k}" if holds and rng.random() < 0.7 else f"x{rng.randrange(2000)}"
        texts.append(" ".join([told, *(f"w{rng.randrange(300)}" for _ in range(9)), f"m{k}@x.org" if holds else "w"]))
    words = [set(re.findall(r"[^\W_]+", re.sub(r"\S+@\S+", " ", t))) for t in texts]
    mails = [set(re.findall(r"\S+@\S+", t)) for t in texts]
    want = {}
    for mail in set().union(*mails):
        with_it = [i for i, m in enumerate(mails) if mail in m]
        share = len(with_it) / len(texts)
        for w in set().union(*(words[i] for i in with_it)):
            n_both, n_term = sum(w in words[i] for i in with_it), sum(w in x for x in words)
            if math.log((n_both + share) / (n_term + 1) / share) >= -0.9 * math.log(share):
                for i in with_it:
                    want.setdefault(i, set()).update({w} & words[i])
    assert want
    got = sanitise(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).where("size(added) > 0").collect()
    assert {r.doc_id: {s.value for s in r.added} for r in got} == {i: w for i, w in want.items() if w}
