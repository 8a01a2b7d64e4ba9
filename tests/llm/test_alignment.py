"""Alignment: words against whole texts of both libraries, rows against plain counting."""

import random
from collections import Counter, defaultdict
from hashlib import sha256
from pathlib import Path

import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallywright.llm import alignment as al

A = Tokenizer.from_file(al.A_FILE)
A.encode_special_tokens = True
B = sentencepiece.SentencePieceProcessor(model_file=al.B_FILE)
LETTERS = al._byte_letters()

TEXTS = [
    "Hello, world! It's  a   test.\n\n  indented\tline \n", " starts with a blank", "ends with blanks  ", "   ", " ", "\n", "a \n b  c  d",
    "<|endoftext|> <s>x</s> <0x41> <unk>", "has ▁ in it", "日本語 テキスト 🎉🎉 é ①ﬁ", "x" * 300 + " " + "ab1" * 100, "I'll we've 's 't 12 345 ... --", None, "",
    "\x1c a\x1d b", "a\x00b", "the the the the", " \t x\r\n  y",
]


def plain(text):
    """Ids of whole texts, and groups between common ends of bytes."""
    whole = " " + (text or "")
    if not text:
        return None
    a, b = A.encode(whole, add_special_tokens=False).ids, B.encode(text)
    a_parts = [bytes(LETTERS[c] for c in A.id_to_token(i)) for i in a]
    b_parts = [bytes([int(B.id_to_piece(i)[3:5], 16)]) if B.is_byte(i) else B.id_to_piece(i).replace("▁", " ").encode() for i in b]
    if not b"".join(a_parts) == b"".join(b_parts) == whole.encode():
        return None

    def ends(parts):
        at, out = 0, []
        for p in parts:
            at += len(p)
            out.append(at)
        return out

    a_ends, b_ends = ends(a_parts), ends(b_parts)
    groups, place_a, place_b = [], {e: n + 1 for n, e in enumerate(a_ends)}, {e: n + 1 for n, e in enumerate(b_ends)}
    i = j = 0
    for at in sorted(place_a.keys() & place_b.keys()):
        groups.append((a[i : place_a[at]], b[j : place_b[at]]))
        i, j = place_a[at], place_b[at]
    of_end = {e: i for i, e in zip(a, a_ends)}
    links = [(of_end[f], j) for j, f in zip(b, b_ends) if f in of_end]
    return len(a), len(b), groups, links


def rows_of(texts):
    made = [plain(t) for t in texts]
    counts = Counter(link for m in made if m for link in m[3])
    most = defaultdict(int)
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    out = []
    for m in made:
        if m is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = m
        written = ";".join(f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in groups)
        best = sum(counts[x] == most[x[1]] for x in links)
        out.append((n_a, n_b, len(groups), len(links), best, sum(counts[x] for x in links), sha256(written.encode()).hexdigest()))
    return out


@pytest.fixture(scope="module")
def pair():
    return al.Pair(Path(al.A_FILE).read_bytes(), Path(al.B_FILE).read_bytes())


def test_words_make_the_text():
    for text in TEXTS:
        for size in (1 << 20, 5):
            if text:
                assert "".join(" " + w for run in al.windows(text, size) for w in al.words_of(run)) == " " + text


@pytest.mark.parametrize("size", [1 << 20, 7])
def test_words_as_whole_texts(pair, size):
    draw = random.Random(5)
    chars = ["a", "the", " ", " ", "  ", "\n", "\t", "é", "日", "🎉", "'s", ".", "1", " ", " ", "\x85", "x" * 5]
    texts = TEXTS + ["".join(draw.choice(chars) for _ in range(60)) for _ in range(300)]
    made = al.align_texts(pair, texts, size)
    for text, got, want in zip(texts, made, (plain(t) for t in texts), strict=True):
        if want is None:
            assert got == al.NOTHING
            continue
        written = [f"{','.join(map(str, a))}|{','.join(map(str, b))}" for a, b in want[2]]
        assert got[:3] == (want[0], want[1], len(written)), repr(text)
        assert got[3] == sha256(";".join(written).encode()).hexdigest()
        assert dict(zip(got[4], got[5], strict=True)) == Counter(written)
        assert sorted(x for g in written for x in pair.links(g)) == sorted(want[3])


@pytest.mark.parametrize("hot", [500_000, 20])
def test_rows_as_plain_counting(spark, hot):
    texts = TEXTS + [t.text for t in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40).collect()] + ["again and again"] * 30 + ["no blanks" * 5, "w" * 70_000]
    docs = spark.createDataFrame([(None if i == 3 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumn("row", F.lit("r")).withColumn("group", F.lit(1))
    got, pairs = al.align(docs, hot=hot)
    want = Counter((None if i == 3 else i // 2, *r) for i, r in enumerate(rows_of(texts)))
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.select(*columns).collect())) == want
    assert pairs.agg(F.sum("count")).first()[0] == sum(r[4] for r in want.elements())


def test_empty_table_and_memo(spark, pair, monkeypatch):
    got, pairs = al.align(spark.createDataFrame([], "doc_id string, text string"))
    assert got.collect() == [] and pairs.collect() == [] and dict(got.dtypes)["doc_id"] == "string"
    monkeypatch.setattr(al, "MEMO", 3)
    texts = [f"word{i} word{i % 5} other" for i in range(50)]
    assert [r[:4] for t in texts for r in al.align_texts(pair, [t])] == [r[:4] for r in al.align_texts(pair, texts)]
