"""Encoding with a piece vocabulary by Viterbi, as a max-plus scan over chunks; and decoding.

The best segmentation has the greatest sum of piece scores.  A text is cut into
chunks; a piece may hang over a chunk's end by less than the longest piece, so
the state at a boundary is how far it hangs over.  Each chunk yields a matrix of
best scores from state to state; matrices combine associatively under (max, +),
which fixes every boundary's state, and then each chunk is traced back by itself.

Blanks become a mark that a piece can only begin with, so every path is cut where
a run of marks begins; and also between a word's letters and what is no letter,
if no piece of the vocabulary crosses there, which loading looks up.  Between such
places best segmentations are independent, and kept for stretches met before.  The
matrix of a chunk with a run of marks in it is a column plus a row.

* Documents of up to ``GIANT`` code points are one chunk in one task, where they
  lie.  Longer ones are exploded into chunks over all tasks; only matrices meet,
  ``GROUP`` of them at a time, and then the groups' products.
* The model's file is read by the driver; tasks get its pieces.

Scores are whole numbers, so sums are exact; of equal segmentations the one wins
whose last piece, going back from the end, is longest.  A code point in no piece
costs ``UNKNOWN`` and becomes its UTF-8 bytes.

Defined results: null and empty texts have no ids; ids of any text decode to just
that text, and do not depend on how it is cut into chunks; repeated rows are each
encoded; a null id is carried; other columns pass through ``encode``, and ``part``
and ``ids`` replace columns of those names.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import fresh, spread, stored, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
LITERAL = "\ud800"  # stands for a mark in the text itself; no valid text has it
GIANT, CHUNK, UNKNOWN = 32_768, 8_192, -100_000
GROUP = 256  # parts whose matrices are combined at once; as many groups again hold any text that fits a row
WIDE = 64  # chunks that are cut from a text together
KEPT = 400_000  # stretches whose ids a task remembers, about 250 bytes each
NEVER = -(1 << 60)
#: A run of marks and what follows it, or what comes before the first.
WORD = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")


def stretches_of(pieces: Iterable[str]) -> re.Pattern:
    """A pattern of stretches that no piece crosses: words as above, cut between letters or digits and others.

    A character of a word that some piece joins to one of no word counts as the latter.
    """
    pairs = {p[i : i + 2] for p in pieces for i in range(len(p) - 1)} | {"_"}
    pairs = {p for p in pairs if MARK not in p}
    loose = {c for p in pairs for c in p if c == "_" or not re.match(r"\w", c)}
    while more := {c for p in pairs if loose.intersection(p) for c in p} - loose:
        loose |= more
    odd = re.escape("".join(sorted(c for c in loose if re.match(r"\w", c))))
    return re.compile(rf"{MARK}*[^\W{odd}]+|{MARK}*(?:[^\w{MARK}]|[{odd}])+|{MARK}+")


def marked(text: str) -> str:
    return text.replace(MARK, LITERAL).replace(" ", MARK)


class Seen(dict):
    """Ids (32 bits each) of stretches that pieces neither enter nor leave, found when first asked for.

    Half of what is kept is new; when it is full it becomes the older half, from
    which what is asked for again is taken over, and the rest is forgotten.
    """

    def __init__(self, pieces: Pieces) -> None:
        self.pieces, self.older = pieces, {}

    def __missing__(self, text: str) -> bytes:
        found = self.older.get(text)
        if found is None:
            _, back = self.pieces.forward(text, [0], len(text))
            found = self.pieces.trace(text, back, len(text))
        if len(text) <= 64:
            if len(self) >= KEPT // 2:
                self.older = dict(self)
                self.clear()
            self[text] = found
        return found

    def __reduce__(self) -> tuple:
        return Seen, (self.pieces,)


@dataclass
class Pieces:
    ids: dict[str, int]
    scores: dict[str, int]
    bytes_from: int  # id of byte 0
    longest: int
    trie: dict[str, tuple[int, dict]]  # by code point: score of what ends here, none worth taking if it only begins pieces, and how it goes on
    blob: np.ndarray  # the pieces' bytes, and where those of each id begin and how many they are
    begins: np.ndarray
    sizes: np.ndarray
    costs: np.ndarray  # scores by id; a code point's bytes cost ``UNKNOWN`` together
    stretches: re.Pattern
    seen: Seen = field(init=False)

    def __post_init__(self) -> None:
        self.seen = Seen(self)

    @staticmethod
    def load(path: str) -> Pieces:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        special = [i for i in range(model.get_piece_size()) if model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)]
        ids = {model.id_to_piece(i): i for i in sorted(set(range(model.get_piece_size())) - set(special))}
        scores = {p: round(model.get_score(i)) for p, i in ids.items()}
        # Pieces that stand outside the ranking have a placeholder; they come right after it.
        last = min((s for s in scores.values() if s > -1_000_000), default=0) - 1
        scores = {p: s if s > -1_000_000 else last for p, s in scores.items()}
        if any(MARK in p.lstrip(MARK) for p in scores):
            raise ValueError("a piece holds a mark after other characters")
        trie: dict[str, tuple[int, dict]] = {}
        for piece, own in scores.items():
            below = trie
            for c in piece[:-1]:
                below = below.setdefault(c, (UNKNOWN if below is trie else 2 * NEVER, {}))[1]
            below[piece[-1]] = own, below.get(piece[-1], (0, {}))[1]
        first = model.piece_to_id("<0x00>")
        raw = {i: p.replace(MARK, " ").encode("utf-8") for p, i in ids.items()} | {first + b: bytes([b]) for b in range(256)}
        held = [raw.get(i, b"") for i in range(model.get_piece_size())]
        sizes = np.array([len(h) for h in held], dtype=np.int64)
        blob = np.frombuffer(b"".join(held), dtype=np.uint8)
        costs = np.zeros(len(sizes), dtype=np.int64)
        costs[[*ids.values()]] = [*scores.values()]
        costs[[first + b for b in range(256) if not 0x80 <= b < 0xC0]] = UNKNOWN
        return Pieces(ids, scores, first, max(map(len, scores)), trie, blob, np.cumsum(sizes) - sizes, sizes, costs, stretches_of(scores))

    def forward(self, text: str, start: list[int], stop: int) -> tuple[list[int], list[int]]:
        """Best scores and last piece lengths at every place up to ``stop`` + longest - 1.

        ``start[s]`` is the score of beginning at place ``s``; pieces begin before
        ``stop`` and may end after it.
        """
        end = min(len(text), stop + self.longest - 1)
        best, back = [NEVER] * (end + 1), [0] * (end + 1)
        best[: len(start)] = start[: end + 1]
        trie, longest, unknown = self.trie, self.longest, (UNKNOWN, {})
        for i in range(stop):
            base = best[i]
            if base <= NEVER:
                continue
            j, (score, below) = i + 1, trie.get(text[i], unknown)
            if base + score > best[j]:
                best[j], back[j] = base + score, 1
            for c in text[j : min(end, i + longest)]:
                if c not in below:
                    break
                score, below = below[c]
                j += 1
                if base + score > best[j]:
                    best[j], back[j] = base + score, j - i
        return best, back

    def trace(self, text: str, back: list[int], end: int) -> bytes:
        """Ids (32 bits each) of the path to ``end``, from the place where nothing leads further back."""
        out: list[int] = []
        while back[end]:
            piece = text[end - back[end] : end]
            if piece in self.ids:
                out.append(self.ids[piece])
            else:
                raw = piece.replace(MARK, " ").replace(LITERAL, MARK).encode("utf-8")
                out += [self.bytes_from + b for b in reversed(raw)]
            end -= back[end]
        return array("i", out[::-1]).tobytes()

    def whole(self, text: str) -> bytes:
        """Ids of a text that pieces neither enter nor leave."""
        return b"".join(map(self.seen.__getitem__, self.stretches.findall(text)))

    def text_of(self, ids: np.ndarray) -> str:
        """What ids stand for, gathered from the pieces' bytes at once."""
        sizes = self.sizes[ids]
        places = np.repeat(self.begins[ids] - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        return self.blob[places].tobytes().decode("utf-8")


def cuts(text: str, stop: int) -> list[int]:
    """Places after the first and before ``stop`` where a run of marks begins."""
    out, at = [], text.find(MARK, 1, stop)
    while at >= 0:
        if text[at - 1] != MARK:
            out.append(at)
        at = text.find(MARK, at + 1, stop)
    return out


@dataclass
class Matrix:
    """From hanging over by i at the front (rows) to hanging over by j at the end (columns).

    ``score`` is the best path's.  ``order`` ranks, within each column, the best
    paths of all rows by their pieces from the end backwards: longer ones first.
    So of equal scores the path of lower order is the one that the text traced as
    a whole takes, however it was cut into chunks.
    """

    score: np.ndarray
    order: np.ndarray

    def pack(self) -> bytes:
        return self.score.astype("<i8").tobytes() + self.order.astype("<i2").tobytes()

    @staticmethod
    def unpack(raw: bytes, width: int) -> Matrix:
        split = width * width * 8
        return Matrix(*(np.frombuffer(part, kind).astype(np.int64).reshape(width, width) for part, kind in ((raw[:split], "<i8"), (raw[split:], "<i2"))))


def ranks_of(keys: list) -> np.ndarray:
    """Each key's place among the different keys in order."""
    place = {k: n for n, k in enumerate(sorted(set(keys)))}
    return np.array([place[k] for k in keys], dtype=np.int64)


def chunk_matrix(pieces: Pieces, text: str, stop: int) -> Matrix:
    """The matrix of a chunk; ``text`` goes on past ``stop`` by what a piece may hang over."""
    width = pieces.longest
    score = np.full((width, width), NEVER, dtype=np.int64)
    order = np.full((width, width), width, dtype=np.int64)
    at = cuts(text, stop)
    if not at:
        runs = [pieces.forward(text, [NEVER] * i + [0], stop) for i in range(min(width, len(text) + 1))]
        for j in range(min(width, len(text) - stop + 1)):
            seen = [i for i, (best, _) in enumerate(runs) if best[stop + j] > NEVER]
            if seen:
                score[seen, j] = [runs[i][0][stop + j] for i in seen]
                order[seen, j] = ranks_of([tuple(ends(runs[i][1], stop + j)) for i in seen])
        return Matrix(score, order)
    # Every path goes through the first cut: what follows it is the same for all rows.
    middle = int(pieces.costs[np.frombuffer(pieces.whole(text[at[0] : at[-1]]), dtype=np.int32)].sum())
    best, _ = pieces.forward(text[at[-1] :], [0], stop - at[-1])
    tail = best[stop - at[-1] :][:width]
    exits = np.array(tail + [NEVER] * (width - len(tail)), dtype=np.int64)
    heads = {}
    for i in range(min(width, at[0] + 1)):
        best, back = pieces.forward(text[: at[0]], [NEVER] * i + [0], at[0])
        if best[at[0]] > NEVER:
            heads[i] = best[at[0]], tuple(ends(back, at[0]))
    for i, rank in zip(heads, ranks_of([path for _, path in heads.values()])):
        score[i] = np.where(exits > NEVER, heads[i][0] + middle + exits, NEVER)
        order[i] = np.where(exits > NEVER, rank, width)
    return Matrix(score, order)


def ends(back: list[int], end: int) -> Iterator[int]:
    """Where the pieces of a path begin, from its end backwards."""
    while back[end]:
        end -= back[end]
        yield end


def _choose(score: np.ndarray, order: np.ndarray) -> int:
    """Of the greatest scores the one of lowest order."""
    best = np.flatnonzero(score == score.max())
    return int(best[order[best].argmin()])


def combine(a: Matrix, b: Matrix) -> Matrix:
    """The (max, +) product of two neighbours; associative."""
    width = len(a.score)
    both = np.maximum(a.score[:, :, None] + b.score[None, :, :], NEVER)
    top = both.max(axis=1, keepdims=True)
    # Later pieces decide first: the second matrix's order, then the first's.
    by_end = np.where(both == top, b.order[None, :, :], width + 1)
    via = by_end.argmin(axis=1)
    score = np.where(top[:, 0, :] > NEVER // 2, top[:, 0, :], NEVER)
    keys = np.take_along_axis(b.order, via, axis=0) * (width + 1) + np.take_along_axis(a.order, via, axis=1)
    order = np.full((width, width), width, dtype=np.int64)
    for j in range(width):
        live = np.flatnonzero(score[:, j] > NEVER)
        order[live, j] = ranks_of(keys[live, j].tolist())
    return Matrix(score, order)


def product(matrices: list[Matrix]) -> Matrix:
    """All of them combined, as a tree."""
    while len(matrices) > 1:
        matrices = [combine(*pair) if len(pair) == 2 else pair[0] for pair in (matrices[i : i + 2] for i in range(0, len(matrices), 2))]
    return matrices[0]


def boundary_states(matrices: list[Matrix], enter: int = 0, leave: int = 0) -> list[int]:
    """States at all boundaries of the best path between two states."""
    forward = [np.where(np.arange(len(matrices[0].score)) == enter, 0, NEVER)]
    for m in matrices[:-1]:
        forward.append(np.maximum((forward[-1][:, None] + m.score).max(axis=0), NEVER))
    states = [leave]
    for m, f in zip(reversed(matrices), reversed(forward)):
        states.append(_choose(f + m.score[:, states[-1]], m.order[:, states[-1]]))
    return states[::-1]


def chunk_ids(pieces: Pieces, text: str, stop: int, enter: int, leave: int) -> np.ndarray:
    """Ids of the pieces that begin in the chunk, given its two states."""
    end = stop + leave
    at = [a for a in cuts(text, stop) if a >= enter]
    if not at:
        _, back = pieces.forward(text, [NEVER] * enter + [0], stop)
        return np.frombuffer(pieces.trace(text, back, end), dtype=np.int32)
    first, tail = text[enter : at[-1]], text[at[-1] :]
    _, back = pieces.forward(tail, [0], stop - at[-1])
    return np.frombuffer(pieces.whole(first) + pieces.trace(tail, back, end - at[-1]), dtype=np.int32)


def encode_text(pieces: Pieces, text: str | None) -> np.ndarray:
    return np.frombuffer(pieces.whole(marked(text or "")), dtype=np.int32)


def _ints(ids: list[np.ndarray]) -> pa.Array:
    """Lists of ids as one Arrow column."""
    offsets = np.zeros(len(ids) + 1, dtype=np.int32)
    np.cumsum([len(i) for i in ids], out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.empty(0, dtype=np.int32), *ids])))


def _slices(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """Few rows at a time, so that what is made of them stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def encode(docs: DataFrame, text_col: str = "text", model: str = MODEL, giant: int = GIANT, chunk: int = CHUNK, group: int = GROUP, decoded: str | None = None) -> DataFrame:
    """``docs`` with ``part`` and ``ids``: one row for a text, or for each chunk of a giant one, in order of ``part``.

    The text column holds what a row's ids stand for: the parts of a giant text,
    cut between pieces, follow each other without gap or overlap.  ``decoded`` names
    one more column, for what the ids decode to, made in the same pass.
    """
    made = [T.StructField("ids", T.ArrayType(T.IntegerType()))] + ([T.StructField(decoded, T.StringType())] if decoded else [])

    def columns(pieces: Pieces, texts: list[str | None], ids: list[np.ndarray]) -> list[pa.Array]:
        return [_ints(ids)] + ([pa.array([pieces.text_of(i) for i in ids], pa.string())] if decoded else [])

    whole, parts = _encoded(docs, text_col, model, giant, chunk, group, made, columns)
    return whole.unionByName(parts)


def _encoded(docs: DataFrame, text_col: str, model: str, giant: int, chunk: int, group: int, made: list[T.StructField], columns_of: Callable[..., list[pa.Array]]) -> tuple[DataFrame, DataFrame]:
    """``docs`` with ``part`` and the columns that ``columns_of`` makes of the pieces, the texts and their ids: whole texts, and parts of giant ones."""
    spark = docs.sparkSession
    pieces = Pieces.load(model)
    shared, width = spark.sparkContext.broadcast(pieces), pieces.longest
    docs = docs.drop("part", *(m.name for m in made))
    key, of, window, enter, leave = fresh(docs.columns + ["part", *(m.name for m in made)], "key", "of", "window", "enter", "leave")
    long_text = F.coalesce(F.length(text_col) > giant, F.lit(False))

    columns, at = docs.columns, docs.columns.index(text_col)
    schema = T.StructType([*docs.schema.fields, T.StructField("part", T.IntegerType()), *made])

    def with_ids(kept: list[pa.Array], part: pa.Array, texts: list[str | None], ids: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*kept, part, *columns_of(shared.value, texts, ids)], schema.names)

    def whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _slices(batches, 256):
            texts = own.column(at).to_pylist()
            ids = [encode_text(shared.value, t) for t in texts]
            yield with_ids(own.columns, pa.array(np.zeros(len(ids), dtype=np.int32)), texts, ids)

    whole = docs.where(~long_text).mapInArrow(whole_texts, schema)

    # A chunk and what its last piece may hang over by.  Finding a place in a text means going there from its
    # start, so texts are cut into wide pieces first and those into chunks.
    wide, length = WIDE * chunk, F.length(text_col)
    piece, below, held = fresh(docs.columns + ["part", key, of, window, enter, leave, *(m.name for m in made)], "piece", "below", "held")
    many = docs.where(long_text).withColumn(key, F.sha2(text_col, 256)).withColumn(piece, F.explode(F.sequence(F.lit(0), F.ceil(length / wide).cast("int") - 1)))
    many = many.withColumn(held, F.col(text_col).substr(F.col(piece) * wide + 1, F.lit(wide + width - 1)))
    chunks = F.ceil(F.least(F.lit(wide), length - F.col(piece) * wide) / chunk).cast("int")
    many = many.withColumn(below, F.explode(F.sequence(F.lit(0), chunks - 1))).withColumn("part", F.col(piece) * WIDE + F.col(below))
    many = many.withColumn(window, F.col(held).substr(F.col(below) * chunk + 1, F.lit(chunk + width - 1))).drop(piece, below, held)

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own in _slices(batches, 64):
            packed = [chunk_matrix(shared.value, marked(t), min(chunk, len(t))).pack() for t in own.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), pa.array(packed, pa.binary())], ["key", "part", "m"])

    def unpacked(rows: pd.DataFrame) -> list[Matrix]:
        return [Matrix.unpack(m, width) for m in rows["m"]]

    def combined(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        return pd.DataFrame({"key": [key[0]], "part": [key[1]], "m": [product(unpacked(rows)).pack()]})

    def states(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("part")
        first, last = (int(rows[c].iloc[0]) for c in ("first", "last"))
        found = np.array(boundary_states(unpacked(rows), first, last), dtype=np.int32)
        return pd.DataFrame({"key": key[0], "part": rows["part"].to_numpy(np.int32), "enter": found[:-1], "leave": found[1:]})

    # Copies of a giant text share their matrices.  Groups of parts are combined, the groups' states
    # follow from the groups' matrices, and then each group's inner states from its own.
    leaves = many.select(F.col(key).alias("key"), "part", F.col(window).alias("window")).dropDuplicates(["key", "part"])
    leaves = stored(leaves.mapInArrow(matrices, "key string, part int, m binary"), "matrices")
    above = F.floor(F.col("part") / group).cast("int")
    groups = leaves.groupBy("key", above.alias("part")).applyInPandas(combined, "key string, part int, m binary")
    found = "key string, part int, enter int, leave int"
    of_groups = groups.withColumns({"first": F.lit(0), "last": F.lit(0)}).groupBy("key").applyInPandas(states, found)
    within = leaves.withColumn("of", above).join(of_groups.select("key", F.col("part").alias("of"), F.col("enter").alias("first"), F.col("leave").alias("last")), ["key", "of"])
    known = within.groupBy("key", "of").applyInPandas(states, found)
    known = known.select(F.col("key").alias(key), F.col("part").alias(of), F.col("enter").alias(enter), F.col("leave").alias(leave))

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(columns)
        for own in _slices(batches, 64):
            texts, ids = [], []
            for part, first, last in zip(*(own.column(n + i).to_pylist() for i in (1, 2, 3))):
                stop = min(chunk, len(part))
                texts.append(part[first : stop + last])
                ids.append(chunk_ids(shared.value, marked(part), stop, first, last))
            kept = [pa.array(texts, pa.string()) if i == at else own.column(i) for i in range(n)]
            yield with_ids(kept, own.column(n), texts, ids)

    # The whole text stays behind: a chunk's row holds its own window.
    named = [F.lit("").alias(c) if c == text_col else docs[c] for c in columns]
    parts = many.join(known, (many[key] == known[key]) & (many["part"] == known[of])).select(*named, "part", window, enter, leave)
    return whole, parts.mapInArrow(traced, schema)


def decode(encoded: DataFrame, model: str = MODEL, into: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids; those of one text's parts, in order of ``part``, make the whole."""
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces.load(model))

    @F.arrow_udf("string")
    def texts(ids: pa.Array) -> pa.Array:
        return pa.array([shared.value.text_of(np.array(i.as_py() or [], dtype=np.int32)) for i in ids], pa.string())

    # An expression of the JVM between two functions of Python keeps the ids from being made once for each.
    return encoded.withColumn(into, texts(F.coalesce("ids", F.array().cast("array<int>"))))


#: What ``digests`` says of a part, made where its ids are, which are many more bytes.
DIGEST = [
    T.StructField("n", T.LongType()), T.StructField("sha", T.StringType()),
    T.StructField("bytes", T.LongType()), T.StructField("same", T.BooleanType()),
]


def _digest(pieces: Pieces, texts: list[str | None], ids: list[np.ndarray]) -> list[pa.Array]:
    said = [pieces.text_of(i) for i in ids]
    return [
        pa.array([len(i) for i in ids], pa.int64()),
        pa.array([sha256(i.astype("<i4").tobytes()).hexdigest() for i in ids], pa.string()),
        pa.array([len(d.encode("utf-8")) for d in said], pa.int64()),
        pa.array([d == (t or "") for d, t in zip(said, texts)], pa.bool_()),
    ]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: numbers of ids, parts and bytes, a digest of the ids and whether they decode to the text.

    The digest is of the parts' digests, those of the ids as 32-bit numbers, low
    byte first.  Texts of one part are judged where they lie; only parts of giant
    ones meet, and of repeated rows each gets its own.
    """
    named = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("of"))
    coded = _encoded(named, "text", MODEL, GIANT, CHUNK, GROUP, DIGEST, _digest)
    # Two frames, not a filter over both, which would encode every text once for each side.
    whole, parts = (c.select("id", "of", F.struct("part", *(d.name for d in DIGEST)).alias("p")) for c in coded)
    met = parts.groupBy("id", "of").agg(F.sort_array(F.collect_set("p")).alias("ps"), F.sum((F.col("p.part") == 0).cast("int")).alias("rows"))
    # A row for each repeat.
    met = met.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.col("rows")))).select("id", "ps")
    rows = whole.select("id", F.array("p").alias("ps")).unionByName(met)

    def total(name: str) -> Column:
        return F.aggregate("ps", F.lit(0).cast("long"), lambda a, p: a + p[name])

    return rows.select(
        F.col("id").alias(id_col), total("n").alias("n_tokens"), F.size("ps").alias("n_parts"), F.sha2(F.array_join(F.col("ps.sha"), ","), 256).alias("ids_sha256"),
        total("bytes").alias("n_bytes"), F.forall("ps", lambda p: p["same"]).alias("round_trip"),
    )


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document: how many ids and parts, a digest of the ids, and whether they decode to the text."""
    return digests(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
