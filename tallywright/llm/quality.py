"""Quality classifier from weak labels.

Overlapping heuristic labellers vote good, bad or nothing on every document.
Expectation-maximisation over all votes estimates how often each labeller's votes
are right and the share of good documents; the posteriors are soft
labels, and a linear scorer on hashed byte trigrams is trained on them.

* EM needs only how often each pattern of votes occurs: at most 3**7 counts
  reach the driver, over all documents.
* The scorer is fitted on a bounded sample, about ``fit_docs`` and at most twice as
  many different texts chosen by a hash, whose features have at most ``2**bits``
  entries each.
* Texts are read whole, in windows of bytes that bound a task's memory; nothing
  is shuffled but the pattern counts.

Defined results: a null or empty text gets no votes, its posterior is the share
of good documents, its score 0 and ``keep`` false; where there are no documents
the scorer is 0.5 throughout; repeated rows are each judged and each counts;
other columns pass through, and the added ones replace columns of their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywright.llm.common import fresh, spread, table

# All but the last detect one kind of junk each and never vote good; the last judges any text and overlaps them.
LABELLERS = ("symbols", "capitals", "repeats", "cells", "shouts", "sentences", "plain_words")
NOTHING, BAD, GOOD = 0, 1, 2
WINDOW = 1 << 20
FIT_DOCS, BITS, SCALE = 3_000, 14, 60.0
#: Trigrams added to each count, so that what a few words say weighs little.
CALM = 64

# Classes of bytes: white space, lower, upper, digit, closing mark, exclamation, symbol, others.
_SPACE, _LOWER, _UPPER, _DIGIT, _CLOSE, _SHOUT, _SYMBOL, _OTHER = range(8)
_CLASS = np.full(256, _OTHER, dtype=np.int64)
for _chars, _kind in (
    (b" \t\n\r\x0b\x0c", _SPACE), (bytes(range(97, 123)), _LOWER), (bytes(range(65, 91)), _UPPER), (b"0123456789", _DIGIT),
    (b".?", _CLOSE), (b"!", _SHOUT), (b"#$%&*+/<=>@\\^_`{|}~", _SYMBOL),
):
    _CLASS[list(_chars)] = _kind
_MIX = np.random.default_rng(7).integers(1, 1 << 62, size=256, dtype=np.int64) | 1
_PLACE = np.random.default_rng(8).integers(1, 1 << 62, size=256, dtype=np.int64) | 1


def byte_runs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes, row of each byte, counted) of the texts, about WINDOW bytes at a time.

    A longer text comes in several windows, cut after white space.  Each of them begins
    with the last word of the one before, which is not counted again.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, offsets, data = column.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, dtype=np.uint8)
    at, end = int(starts[0]), int(starts[-1])
    while at < end:
        row = int(np.searchsorted(starts, at, side="right")) - 1
        last = int(np.searchsorted(starts, at + WINDOW, side="right")) - 1
        first, stop = at, int(starts[last])
        if last <= row:  # a part of one text
            own_end = int(starts[row + 1])
            stop = min(at + WINDOW, own_end)
            while stop < own_end and _CLASS[raw[stop - 1]] != _SPACE:
                stop += 1
        if at > starts[row]:  # the last word before, whatever white space follows it
            first = at - 1
            while first > starts[row] and _CLASS[raw[first]] == _SPACE:
                first -= 1
            while first > starts[row] and _CLASS[raw[first - 1]] != _SPACE:
                first -= 1
        cuts = np.clip(starts[row : max(last, row + 1) + 1], first, stop)
        yield raw[first:stop], np.repeat(np.arange(row, row + len(cuts) - 1), np.diff(cuts)), np.arange(first, stop) >= at
        at = stop


def votes(column: pa.Array) -> np.ndarray:
    """votes[document, labeller], from counts over each whole text."""
    n = len(column)
    kinds, words, same, closed, lone, plain = np.zeros((n, 8)), *np.zeros((5, n))
    for raw, row, counted in byte_runs(column):
        kind = _CLASS[raw]
        kinds += np.bincount((row * 8 + kind)[counted], minlength=n * 8).reshape(n, 8)
        inside = kind != _SPACE
        edge = np.concatenate(([True], row[1:] != row[:-1]))
        starts = np.flatnonzero(inside & (edge | np.concatenate(([True], ~inside[:-1]))))
        if not len(starts):
            continue
        tail = inside & np.concatenate((edge[1:] | ~inside[1:], [True]))
        ends, new = np.flatnonzero(tail), counted[starts]
        mixed = np.where(inside, _MIX[raw], 0)
        place = np.arange(len(raw)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(raw)]))))
        hashed = np.add.reduceat(mixed * _PLACE[place & 255], starts)
        of = row[starts]
        words += np.bincount(of[new], minlength=n)
        again = np.concatenate(([False], (hashed[1:] == hashed[:-1]) & (of[1:] == of[:-1])))
        same += np.bincount(of[again & new], minlength=n)
        last = kind[ends]
        closed += np.bincount(row[ends[((last == _CLOSE) | (last == _SHOUT)) & new]], minlength=n)
        odd = (kind == _SYMBOL) | (kind == _SHOUT) | (kind == _DIGIT) | (kind == _UPPER)
        odd[starts] &= kind[starts] != _UPPER
        plain += np.bincount(of[(np.add.reduceat(odd.astype(np.int64), starts) == 0) & ~again & new], minlength=n)
        lone += np.bincount(of[(starts == ends) & (kind[starts] == _SYMBOL) & new], minlength=n)
    solid = np.maximum(kinds.sum(axis=1) - kinds[:, _SPACE], 1)
    cased, w = kinds[:, _LOWER] + kinds[:, _UPPER], np.maximum(words, 1)

    never = np.zeros(n, dtype=bool)

    def vote(enough: np.ndarray, bad: np.ndarray, good: np.ndarray = never) -> np.ndarray:
        return np.where(enough & bad, BAD, np.where(enough & good, GOOD, NOTHING))

    some, many = words >= 1, words >= 15
    ends, regular = closed / w, plain / w
    return np.column_stack((
        vote(some, kinds[:, _SYMBOL] / solid > 0.03), vote(cased >= 20, kinds[:, _UPPER] / np.maximum(cased, 1) > 0.3),
        vote(many, same / w > 0.15), vote(many, lone / w > 0.1), vote(some, kinds[:, _SHOUT] / solid > 0.03),
        vote(many, (ends < 0.004) | (ends > 0.6)), vote(some, regular < 0.85, regular > 0.93),
    )).astype(np.int64)


POWERS = 3 ** np.arange(len(LABELLERS))


@dataclass(frozen=True)
class LabelModel:
    """Share of good documents, and how often each labeller's votes are right."""

    prior: float
    accuracy: np.ndarray

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        weight = np.log(self.accuracy / (1 - self.accuracy))
        z = np.log(self.prior / (1 - self.prior)) + (cast == GOOD) @ weight - (cast == BAD) @ weight
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> LabelModel:
    """``patterns[i]`` holds the votes that ``counts[i]`` documents got.

    Accuracies start at 0.8 and are held to 0.55-0.98, so that no labeller is
    read as its own opposite or as beyond doubt.
    """
    model = LabelModel(0.7, np.full(len(LABELLERS), 0.8))
    if not counts.sum():
        return model
    said_good, said_bad = patterns == GOOD, patterns == BAD
    for _ in range(rounds):
        good = model.posterior(patterns) * counts
        bad = counts - good
        right = good @ said_good + bad @ said_bad
        voted = counts @ (said_good | said_bad)
        prior = np.clip(good.sum() / counts.sum(), 0.05, 0.95)
        model = LabelModel(float(prior), np.clip((right + 4) / (voted + 5), 0.55, 0.98))
    return model


def trigrams(raw: np.ndarray, row: np.ndarray, counted: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashed slots of a window's byte trigrams and the row of each."""
    if len(raw) < 3:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    wide = raw.astype(np.int64)
    packed = (wide[:-2] << 16) | (wide[1:-1] << 8) | wide[2:]
    slots = ((packed * 2654435761) & 0xFFFFFFFF) >> (32 - bits)
    whole = (row[2:] == row[:-2]) & counted[2:]  # each where its last byte counts
    return slots[whole], row[2:][whole]


@dataclass(frozen=True)
class Scorer:
    weights: np.ndarray
    bias: float
    bits: int

    def score(self, column: pa.Array) -> np.ndarray:
        n = len(column)
        total, size = np.zeros(n), np.zeros(n)
        for raw, row, counted in byte_runs(column):
            slots, of = trigrams(raw, row, counted, self.bits)
            total += np.bincount(of, self.weights[slots], minlength=n)
            size += np.bincount(of, minlength=n)
        z = self.bias + SCALE * total / (size + CALM)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(features: list[tuple[np.ndarray, np.ndarray]], soft: np.ndarray, bits: int, steps: int = 150) -> Scorer:
    """Logistic regression on shares of trigrams, by Adam in full batches."""
    w, b = np.zeros(1 << bits), 0.0
    if not len(soft):
        return Scorer(w, b, bits)
    row = np.repeat(np.arange(len(soft)), [len(s) for s, _ in features])
    col = np.concatenate([s for s, _ in features]).astype(np.int64)
    value = np.concatenate([v for _, v in features]).astype(float) * SCALE
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    for t in range(1, steps + 1):
        z = b + np.bincount(row, w[col] * value, minlength=len(soft))
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - soft
        g = np.bincount(col, error[row] * value, minlength=len(w)) / len(soft) + 1e-5 * w
        gb = float(error.mean())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        down, up = 1 - 0.9**t, 1 - 0.99**t
        w -= 0.05 * (m / down) / (np.sqrt(v / up) + 1e-8)
        b -= 0.05 * (mb / down) / ((vb / up) ** 0.5 + 1e-8)
    return Scorer(w, b, bits)


def train(docs: DataFrame, text_col: str = "text", fit_docs: int = FIT_DOCS, bits: int = BITS) -> tuple[LabelModel, Scorer]:
    texts = docs.select(F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(3 ** len(LABELLERS), dtype=np.int64)
        for batch in batches:
            seen += np.bincount(votes(batch.column(0)) @ POWERS, minlength=len(seen))
        some = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[some])], ["pattern", "n"])

    rows = texts.mapInArrow(count, "pattern long, n long").groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    patterns = np.array([r["pattern"] for r in rows], dtype=np.int64)[:, None] // POWERS % 3
    counts = np.array([r["n"] for r in rows], dtype=float)
    labels = expectation_maximisation(patterns, counts)
    share = min(1_000_000, int(fit_docs * 1_000_000 / max(1.0, counts.sum())) + 1)
    sample = texts.where(F.pmod(F.xxhash64("text", F.lit(8)), F.lit(1_000_000)) < share)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(0).slice(i, 1)
                held = np.zeros(1 << bits)
                for raw, row, counted in byte_runs(own):
                    held += np.bincount(trigrams(raw, row, counted, bits)[0], minlength=len(held))
                some = np.flatnonzero(held)
                cast = int((votes(own) @ POWERS)[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([cast]), pa.array([some.astype(np.int32).tobytes()]), pa.array([(held[some] / (held.sum() + CALM)).astype(np.float32).tobytes()])],
                    ["pattern", "slots", "shares"],
                )

    # Repeated texts count once, which bounds what reaches the driver whatever is repeated.
    rows = sample.mapInArrow(features, "pattern long, slots binary, shares binary").where(F.length("slots") > 0).distinct()
    rows = rows.orderBy(F.xxhash64("slots", "shares"), "pattern").limit(2 * fit_docs)
    got = sorted((r["pattern"], bytes(r["slots"]), bytes(r["shares"])) for r in rows.collect())
    soft = labels.posterior(np.array([p for p, _, _ in got], dtype=np.int64)[:, None] // POWERS % 3) if got else np.empty(0)
    return labels, fit([(np.frombuffer(s, np.int32), np.frombuffer(v, np.float32)) for _, s, v in got], soft, bits)


def judge(docs: DataFrame, labels: LabelModel, scorer: Scorer, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with votes (good, bad), weak-label posterior, the scorer's score and ``keep``; only texts go to Python."""
    added = T.StructType().add("n_good", T.LongType()).add("n_bad", T.LongType()).add("posterior", T.DoubleType()).add("score", T.DoubleType()).add("keep", T.BooleanType())

    @F.arrow_udf(added)
    def judged(texts: pa.Array) -> pa.Array:
        parts = []
        for at in range(0, max(1, len(texts)), 256):
            text = texts.slice(at, 256)
            cast, score = votes(text), scorer.score(text)
            some = np.array([bool(x) for x in pc.greater(pc.fill_null(pc.binary_length(text), 0), 0).to_pylist()], dtype=bool)
            score = np.where(some, score, 0.0)
            new = [(cast == GOOD).sum(axis=1), (cast == BAD).sum(axis=1), labels.posterior(cast), score, (score >= threshold) & some]
            parts.append(pa.StructArray.from_arrays([pa.array(x) for x in new], added.names))
        return pa.concat_arrays(parts)

    (found,) = fresh(docs.columns, "found")
    kept = [c for c in docs.columns if c not in added.names]
    rows = docs.withColumn(found, judged(docs[text_col].cast("string")))
    return rows.select(*kept, *[F.col(found)[n].alias(n) for n in added.names])


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    judged = judge(docs, *train(docs))
    return judged.select("doc_id", "n_good", "n_bad", "posterior", "score", "keep")
