import random

import numpy as np
import pytest

from tallywright.llm import packing
from tallywright.llm import sentencepiece_scan as sp


@pytest.fixture(scope="module")
def pieces():
    return sp.Pieces.load(sp.MODEL)


def brute(pieces, text):
    """Greatest score of any segmentation, from the back."""
    text = sp.marked(text)
    best = [0] * (len(text) + 1)
    for i in range(len(text) - 1, -1, -1):
        ends = range(i + 1, min(len(text), i + pieces.longest) + 1)
        got = [pieces.scores[text[i:j]] + best[j] for j in ends if text[i:j] in pieces.scores]
        if text[i] not in pieces.scores:
            got.append(sp.UNKNOWN + best[i + 1])
        best[i] = max(got)
    return best[0]


def score(pieces, ids, text):
    names = {i: p for p, i in pieces.ids.items()}
    known = sum(pieces.scores[names[i]] for i in ids.tolist() if i in names)
    return known + sp.UNKNOWN * sum(c not in pieces.scores for c in sp.marked(text))


TEXTS = ["", " ", "a", "Hello  the world\n\n of   pieces ", "▁x ▁", "naïve 😀 日本語", "internationalisation" * 9, "    " * 20, "x" * 300, " " * 40 + "a" * 50]


def by_chunks(pieces, text, chunk, group):
    """The ids by way of matrices of chunks and of groups of chunks."""
    text = sp.marked(text)
    parts = [(text[a : a + chunk + pieces.longest - 1], min(chunk, len(text) - a)) for a in range(0, len(text), chunk)]
    if not parts:
        return []
    made = [sp.chunk_matrix(pieces, *p) for p in parts]
    made = [sp.Matrix.unpack(m.pack(), pieces.longest) for m in made]
    groups = [made[i : i + group] for i in range(0, len(made), group)]
    outer = sp.boundary_states([sp.product(g) for g in groups])
    ids = []
    for n, (g, a, b) in enumerate(zip(groups, outer, outer[1:])):
        inner = sp.boundary_states(g, a, b)
        for p, x, y in zip(parts[n * group :], inner, inner[1:]):
            ids += sp.chunk_ids(pieces, *p, x, y).tolist()
    return ids


@pytest.mark.parametrize("text", TEXTS)
def test_scan_is_best_and_round_trips(pieces, text):
    whole = sp.encode_text(pieces, text)
    assert score(pieces, whole, text) == brute(pieces, text)
    assert pieces.text_of(whole) == text


def test_ids_do_not_depend_on_chunks(pieces):
    rng = random.Random(5)
    texts = TEXTS + ["".join(rng.choice(["    ", "a", "aa", "ing", " the", "\n", "é", "xyz", "    a"]) for _ in range(rng.randint(5, 60))) for _ in range(60)]
    for text in texts:
        whole = list(sp.encode_text(pieces, text))
        for chunk, group in ((16, 1), (17, 3), (23, 2), (64, 4)):
            assert by_chunks(pieces, text, chunk, group) == whole


def test_combining_is_associative(pieces):
    for text in ("some wordsandmorewordsthatgoon " * 8, " " * 200, "aaaa" * 50):
        text = sp.marked(text)
        a, b, c = (sp.chunk_matrix(pieces, text[i : i + 20 + pieces.longest - 1], 20) for i in (0, 20, 40))
        left, right = sp.combine(sp.combine(a, b), c), sp.combine(a, sp.combine(b, c))
        live = left.score > sp.NEVER
        assert (left.score == right.score).all() and (left.order[live] == right.order[live]).all()


def test_encode_table(spark, pieces):
    rng = random.Random(1)
    rows = [(i, t) for i, t in enumerate([None, *TEXTS])] + [(99, " ".join(rng.choice(TEXTS[3].split()) for _ in range(300)))] * 2
    docs = spark.createDataFrame([(i, t, "k", "w") for i, t in rows], "doc_id long, text string, key string, window string")
    coded = sp.decode(sp.encode(docs, giant=100, chunk=64, group=2))
    assert coded.columns == [*docs.columns, "part", "ids", "decoded"]
    got = coded.collect()
    once = sp.encode(docs, giant=100, chunk=64, group=2, decoded="decoded")
    assert sorted(map(str, once.collect())) == sorted(map(str, got)) and once.columns == coded.columns
    assert all(r.decoded == (r.text or "") and (r.key, r.window) == ("k", "w") for r in got)
    for i, text in rows:
        own = sorted((r.part, r.decoded, tuple(r.ids)) for r in got if r.doc_id == i)
        copies = rows.count((i, text))
        assert len(own) == copies * len(set(own))
        own = sorted(set(own))
        assert "".join(d for _, d, _ in own) == (text or "")
        assert [x for _, _, ids in own for x in ids] == list(sp.encode_text(pieces, text))
    assert sp.encode(docs.limit(0)).count() == 0


def test_digests_give_each_row(spark, pieces):
    long = "one two  three " * 4000
    rows = [(1, "hello world"), (1, "hello world"), (None, "hello world"), (2, None), (3, ""), (4, long), (4, long), (4, long + "x"), (None, long), (None, long)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_tokens, r.n_bytes, r.n_parts, r.round_trip) for r in sp.digests(docs).collect()), key=str)
    want = []
    for i, text in rows:
        text = text or ""
        want.append((i, len(sp.encode_text(pieces, text)), len(text.encode()), -(-len(text) // sp.CHUNK) if len(text) > sp.GIANT else 1, True))
    assert got == sorted(want, key=str)


def test_packing(spark):
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(1, 101, 500)]
    rows = packing.pack(sizes, 100)
    assert sorted(i for r in rows for i in r) == list(range(500)) and all(sum(sizes[i] for i in r) <= 100 for r in rows)
    naive: list[list[int]] = []  # the same by looking at every row
    for i in sorted(range(500), key=lambda i: (-sizes[i], i)):
        fits = [r for r in naive if sum(sizes[j] for j in r) + sizes[i] <= 100]
        best = max(fits, key=lambda r: sum(sizes[j] for j in r), default=None)
        naive.append([i]) if best is None else best.append(i)
    assert len(rows) == len(naive)
    texts = [(1, "Hello the world. " * 40), (2, None), (3, ""), (4, "one"), (None, "two three")]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    import base64

    import tiktoken

    with open(packing.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    enc = tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    found = {}
    for r in packing.packed(docs, length=32).collect():
        ids = np.frombuffer(r.ids, dtype="<u2")
        assert len(ids) == 32 and r.cu_seqlens[-1] == r.n_tokens
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            found[doc, piece] = ids[a:b].tolist()
            assert r.positions[a:b] == list(range(b - a))
    for doc, text in texts:
        own = [i for key in sorted((k for k in found if k[0] == doc), key=lambda k: k[1]) for i in found[key]]
        assert own == (enc.encode_ordinary(text) if text else [])


def encoder():
    import base64

    import tiktoken

    with open(packing.VOCABULARY, "rb") as file:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    return tiktoken.Encoding("own", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", ["1234 567, " * 60, "don't  stop\n\n  now 12ab " * 40, "abcdefg" * 200, "   \t x" * 100, "é1 " * 200])
def test_ids_are_those_of_the_whole_text(text):
    enc = encoder()
    for limit in (7, 50, 333):
        assert [i for r in packing.runs(text, limit) for i in enc.encode_ordinary(r)] == enc.encode_ordinary(text)


def test_packing_long_texts_and_other_ids(spark, tmp_path):
    long = "1234 567, " * 12_000
    docs = spark.createDataFrame([("a", long), ("b", "one"), (None, "two"), ("b", "one"), ("c", "")], "doc_id string, text string")
    packing.write(packing.packed(docs, length=64), str(tmp_path / "rows"))
    found = {}
    for r in spark.read.parquet(str(tmp_path / "rows")).collect():
        ids = np.frombuffer(r.ids, dtype="<u2")
        for doc, piece, a, b in zip(r.doc_ids, r.pieces, r.cu_seqlens, r.cu_seqlens[1:]):
            found.setdefault((doc, piece), []).append(ids[a:b].tolist())
    assert [i for n in range(len([k for k in found if k[0] == "a"])) for i in found["a", n][0]] == encoder().encode_ordinary(long)
    assert len(found["b", 0]) == 2 and len(found[None, 0]) == 1 and ("c", 0) not in found
