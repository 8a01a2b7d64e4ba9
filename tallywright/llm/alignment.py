"""Cross-tokenizer alignment: which ids of one tokenizer stand where those of another do.

Both tokenizers cover the same bytes.  Where a token of A and one of B both end, a
group ends: the A ids and the B ids since the last such place.  The corpus is a long
sequence of few different groups, so groups are interned: a document is stored as its
different groups and how often it holds each; a group is expanded into its links (A
and B tokens whose byte ranges end together) once, however often it occurs; its links
are multiplied by its frequency into counts of id pairs; and what the counts say of a
group is joined back to the documents by group.

Texts are cut before blanks where both tokenizers always begin a token, so a word is
encoded once a task and looked up after that (``MEMO`` words of up to ``SHORT`` code
points at a time; others are encoded where they stand).  Texts longer than ``WINDOW``
are read window by window.

* The tokenizers' files are read by the driver; tasks get their bytes.
* Groups above 1 / ``HOT`` of all occurrences, fewer than ``HOT`` of them, meet the
  documents by broadcast; others by a shuffle, in which no group has more rows than that.

Defined results: a null or empty text has no tokens; nor has one whose A or B bytes are
not a blank and the text, as where it holds U+2581; strings of special tokens are plain
text; rows are documents, also those of one id; a null id is carried; other columns are
ignored.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import accumulate, chain, pairwise
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import spread, stored, table

A_FILE, B_FILE = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Fixed value: how A's vocabulary cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
MEMO, SHORT, WINDOW, ROWS, HOT = 200_000, 64, 1 << 20, 128, 500_000

#: A starts a word with the last blank of a run, B with the first: both start one at a single blank.
CUT = re.compile(r"(?<! ) (?=\S)")
_UNSPLIT = re.compile(r" (?:\s|\Z)")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: itself where it prints, else one from U+0100 on."""
    prints = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(0x100 + i): b for i, b in enumerate(others)}


class Pair:
    """Both tokenizers, and a word's encoding by each."""

    def __init__(self, a_file: bytes, b_file: bytes):
        import sentencepiece
        import tiktoken

        model = json.loads(a_file)
        letters, special = _byte_letters(), {t["content"] for t in model["added_tokens"]}
        vocabulary = {bytes(letters[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
        self.a = tiktoken.Encoding("a", pat_str=PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self.a_bytes = {i: token for token, i in vocabulary.items()}
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.memo: dict[str, tuple | None] = {}

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def word(self, text: str, b_ids: list[int]) -> tuple[int, int, tuple[str, ...]] | None:
        """Tokens of A and of B, and the groups as `a,a|b`; None where bytes differ from a blank and ``text``."""
        whole = " " + text
        a_ids = self.a.encode_ordinary(whole)
        a_parts, b_parts = [self.a_bytes[i] for i in a_ids], [self.b_bytes[i] for i in b_ids]
        if not b"".join(a_parts) == b"".join(b_parts) == whole.encode():
            return None
        groups = []
        i = j = 0
        while i < len(a_ids):
            first, second, ahead = i, j, len(a_parts[i]) - len(b_parts[j])
            while ahead:
                if ahead < 0:
                    i += 1
                    ahead += len(a_parts[i])
                else:
                    j += 1
                    ahead -= len(b_parts[j])
            i, j = i + 1, j + 1
            groups.append(f"{','.join(map(str, a_ids[first:i]))}|{','.join(map(str, b_ids[second:j]))}")
        return len(a_ids), len(b_ids), tuple(groups)

    def links(self, group: str) -> list[tuple[int, int]]:
        """The id pairs of a group whose byte ranges end together."""
        a_ids, b_ids = ([int(i) for i in side.split(",")] for side in group.split("|"))
        ends = dict(zip(accumulate(len(self.a_bytes[i]) for i in a_ids), a_ids, strict=True))
        b_ends = accumulate(len(self.b_bytes[i]) for i in b_ids)
        return [(ends[at], i) for at, i in zip(b_ends, b_ids, strict=True) if at in ends]

    def encoded(self, words: set[str]) -> dict[str, tuple | None]:
        """What ``word`` says of each; short words are kept for later calls."""
        known = {w: self.memo[w] for w in words if w in self.memo}
        new = [w for w in words if w not in known]
        made = {w: self.word(w, ids) for w, ids in zip(new, self.b.encode(new, num_threads=1), strict=True)} if new else {}
        if len(self.memo) + len(made) > MEMO:
            self.memo = known.copy()
        self.memo.update((w, m) for w, m in made.items() if len(w) <= SHORT)
        return known | made


def words_of(text: str) -> list[str]:
    """A blank and the text, cut at ``CUT``; each part without its first blank."""
    if not text.startswith(" ") and not _UNSPLIT.search(text):
        return text.split(" ")
    whole = " " + text
    bounds = [0, *(c for m in CUT.finditer(whole) if (c := m.start())), len(whole)]
    return [whole[a + 1 : b] for a, b in pairwise(bounds)]


def windows(text: str, size: int = WINDOW) -> Iterator[str]:
    """The text in runs of whole words of about ``size`` code points, each without its first blank."""
    begin = 0
    while len(text) - begin > size and (cut := CUT.search(text, begin + size)):
        yield text[begin : cut.start()]
        begin = cut.start() + 1
    yield text[begin:]


#: A text of which nothing is aligned.
NOTHING = (0, 0, 0, "", [], [])


def align_text(pair: Pair, text: str | None, size: int = WINDOW, known: dict[str, tuple | None] | None = None) -> tuple:
    """(n_a, n_b, n_groups, the groups' SHA-256, its different groups, how often each); ``known`` has the words of a short text."""
    digest, n_a, n_b, groups, between = sha256(), 0, 0, Counter(), ""
    if not text:
        return NOTHING
    for run in windows(text, size):
        words = words_of(run)
        of = pair.encoded(set(words)) if known is None else known
        found = [of[w] for w in words]
        if None in found:
            return NOTHING
        in_a, in_b, own = zip(*found, strict=True)
        n_a, n_b = n_a + sum(in_a), n_b + sum(in_b)
        own = list(chain.from_iterable(own))
        digest.update((between + ";".join(own)).encode())
        between = ";"
        groups.update(own)
    return n_a, n_b, groups.total(), digest.hexdigest(), list(groups), list(groups.values())


def align_texts(pair: Pair, texts: list[str | None], size: int = WINDOW) -> list[tuple]:
    """``align_text`` of many texts, the new words of short ones encoded at once."""
    short = [t for t in texts if t and len(t) <= size]
    known = pair.encoded(set(chain.from_iterable(map(words_of, short))))
    return [align_text(pair, t, size, known if t and len(t) <= size else None) for t in texts]


@lru_cache(maxsize=1)
def _pair(a_file: bytes, b_file: bytes) -> Pair:
    """One to a worker, with what it remembers."""
    return Pair(a_file, b_file)


def align(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", a_file: str = A_FILE, b_file: str = B_FILE, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """Documents and id pairs.

    The documents are (id, n_a, n_b, n_groups, groups_sha256, n_links, n_best, count_sum), a row for each of ``docs``;
    the pairs (a, b, count, best), ``best`` where no A id has more links with that B id.
    """
    spark = docs.sparkSession
    files = spark.sparkContext.broadcast(tuple(Path(f).read_bytes() for f in (a_file, b_file)))
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    columns = "n_a long, n_b long, n_groups long, groups_sha256 string, groups array<string>, times array<int>"
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32())]
    names = [c.split()[0] for c in columns.split(", ")]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*files.value)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                own = batch.slice(at, ROWS)
                made = zip(*align_texts(pair, own.column(1).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([own.column(0), *(pa.array(c, t) for c, t in zip(made, types, strict=True))], ["id", *names])

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(*files.value)
        for batch in batches:
            links = [pair.links(g) for g in batch.column(0).to_pylist()]
            row = pa.array([i for i, own in enumerate(links) for _ in own], pa.int64())
            a, b = (pa.array([link[side] for own in links for link in own], pa.int32()) for side in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), a, b], ["group", "n", "a", "b"])

    coded = named.mapInArrow(encode, f"id {named.schema['id'].dataType.simpleString()}, {columns}")
    coded = stored(coded.withColumn("row", F.monotonically_increasing_id()), "aligned")
    held = coded.select("row", F.explode(F.arrays_zip("groups", "times")).alias("held")).select("row", F.col("held.groups").alias("group"), F.col("held.times").cast("long").alias("times"))

    groups = held.groupBy("group").agg(F.sum("times").alias("n"))
    links = stored(groups.mapInArrow(expand, "group string, n long, a int, b int"), "group_links")
    counts = links.groupBy("a", "b").agg(F.sum("n").alias("count"))
    most = counts.groupBy("b").agg(F.max("count").alias("most"))
    pairs = stored(counts.join(most, "b").select("a", "b", "count", (F.col("count") == F.col("most")).alias("best")), "id_pairs")

    one = F.lit(1).cast("long")
    judged = links.join(pairs, ["a", "b"]).groupBy("group").agg(
        F.max("n").alias("n"), F.count(one).alias("links"), F.sum(F.col("best").cast("long")).alias("bests"), F.sum("count").alias("counts")
    )
    judged = stored(judged, "judged_groups")
    total = judged.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    frequent, rare = (judged.where(f"n {sign} {total / hot!r}D").drop("n") for sign in (">", "<="))
    known = held.join(F.broadcast(frequent), "group").unionByName(held.join(F.broadcast(frequent.select("group")), "group", "left_anti").join(rare, "group"))

    def times(column: str) -> Column:
        return F.sum(F.col("times") * F.col(column))

    sums = known.groupBy("row").agg(times("links").alias("n_links"), times("bests").alias("n_best"), times("counts").alias("count_sum"))
    whole = coded.drop("groups", "times").join(sums, "row", "left")
    result = whole.select(
        F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "groups_sha256",
        *(F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_links", "n_best", "count_sum")),
    )
    return result, pairs


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))[0]
