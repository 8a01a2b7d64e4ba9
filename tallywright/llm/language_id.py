"""Language ID by rank-order profiles.

A profile is the ranking of a language's most frequent character n-grams (one to
three letters, a blank standing for a word's edge).  A document's own ranking is
laid beside each profile; the out-of-place distance adds up how far apart an
n-gram stands in the two, or the profile's length where it is missing there, and
the nearest profile names the language.

* Profiles are learned from a bounded sample: about ``per_lang`` documents of a
  language, chosen by a hash of ``doc_id`` with a share that follows from the
  language's own count.  The driver and tasks hold ``top`` numbers a language.
* Predicting shuffles nothing.  Only texts go to Python; each is read whole, in
  windows cut between words, so a task holds a window's n-grams at a time.

Defined results: ``und`` with score 0 if the text is null or has no letter, or
if nothing could be learned; equal distances go to the smaller language name;
rows without a language or ``doc_id`` are never learned from; a null ``doc_id``
is not held out; repeated rows are each judged; other columns pass through and
``lang_pred`` and ``score`` replace columns of that name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallywright.llm.common import fresh, spread, stored, table

UNKNOWN = "und"
TOP = 300
PER_LANG = 2_000
WINDOW = 1 << 17
BROADCAST_LANGS = 100_000
BLANK = 32

_letters: np.ndarray | None = None


def letters() -> np.ndarray:
    """For every code point, whether it is a letter; built once a worker."""
    global _letters
    if _letters is None:
        _letters = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _letters


def windows(text: str) -> Iterator[str]:
    """Parts of about ``WINDOW`` code points, cut only where a letter does not meet a letter."""
    at = 0
    while at < len(text):
        end = at + WINDOW
        while end < len(text) and text[end - 1].isalpha() and text[end].isalpha():
            end += 1
        yield text[at:end]
        at = end


def grams(text: str) -> np.ndarray:
    """All one- to three-letter n-grams of the text's words as numbers, 21 bits a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
    is_letter = letters()[points]
    if not is_letter.any():
        return np.empty(0, dtype=np.int64)
    points = np.where(is_letter, points, BLANK)
    points = np.concatenate(([BLANK], points, [BLANK]))
    points = points[np.concatenate(([True], (points[1:] != BLANK) | (points[:-1] != BLANK)))]
    two = (points[:-1] << 21) | points[1:]
    three = (two[:-1] << 21) | points[2:]
    return np.concatenate((points[points != BLANK], two, three[points[1:-1] != BLANK]))


def summed(parts: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One table of values and counts from several."""
    values, counts = (np.concatenate(x) for x in zip(*parts))
    known, place = np.unique(values, return_inverse=True)
    return known, np.bincount(place, counts, minlength=len(known)).astype(np.int64)


def counted(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of a whole text, ascending, and how often each occurs."""
    parts = [np.unique(grams(part), return_counts=True) for part in windows(text or "")]
    return summed(parts) if len(parts) > 1 else parts[0] if parts else (np.empty(0, dtype=np.int64),) * 2


def ranked(values: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent first; of equal counts the smaller number."""
    return values[np.lexsort((values, -counts))[:top]]


@dataclass(frozen=True)
class Profiles:
    """Rankings by n-gram: ``lang`` and ``rank`` from ``start[i]`` to ``start[i + 1]`` are those of ``known[i]``."""

    names: tuple[str, ...]
    known: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    rank: np.ndarray
    top: int

    @staticmethod
    def of(rankings: dict[str, list[int]], top: int) -> Profiles:
        names = tuple(sorted(rankings))
        lang = np.repeat(np.arange(len(names)), [len(rankings[n]) for n in names])
        rank = np.array([i for n in names for i in range(len(rankings[n]))], dtype=np.int64)
        gram = np.array([g for n in names for g in rankings[n]], dtype=np.int64)
        order = np.argsort(gram, kind="stable")
        known, start = np.unique(gram[order], return_index=True)
        return Profiles(names, known, np.append(start, len(gram)), lang[order], rank[order], top)

    def nearest(self, text: str | None) -> tuple[str, float]:
        own = ranked(*counted(text), self.top)
        if not len(own) or not len(self.known):
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
        place = np.flatnonzero(self.known[at] == own)
        at = at[place]
        many = self.start[at + 1] - self.start[at]
        entry = np.repeat(self.start[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
        # Every n-gram is out of place by ``top`` until a profile says by how much less.
        less = self.top - np.abs(self.rank[entry] - np.repeat(place, many))
        apart = len(own) * self.top - np.bincount(self.lang[entry], less, minlength=len(self.names))
        best = int(apart.argmin())
        return self.names[best], float(1 - apart[best] / (len(own) * self.top))


def learn(labelled: DataFrame, id_col: str, text_col: str, lang_col: str, top: int = TOP, per_lang: int = PER_LANG) -> Profiles:
    """Profiles from a bounded sample of each language's rows."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull()).select(
        F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")
    )
    sizes = stored(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("rows")), "languages")
    few = sizes.count() <= BROADCAST_LANGS  # else texts are shuffled to meet them
    sample = rows.join(F.broadcast(sizes) if few else sizes, "lang").where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < F.ceil(F.lit(per_lang * 1_000_000) / F.col("rows")))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            tables = {lang: summed(parts) for lang, parts in held.items()}
            lang = [name for name, (values, _) in tables.items() for _ in range(len(values))]
            columns = [np.concatenate([t[i] for t in tables.values()]) for i in (0, 1)]
            return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), *map(pa.array, columns)], ["lang", "gram", "n"])

        for batch in batches:
            for i in range(batch.num_rows):
                values, counts = counted(batch.column(1)[i].as_py())
                held.setdefault(batch.column(0)[i].as_py(), []).append((values, counts))
                size += len(values)
                if size > 500_000:
                    yield flush()
                    held, size = {}, 0
        if held:
            yield flush()

    sums = sample.select("lang", "text").mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    best = sums.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    rankings: dict[str, list[int]] = {}
    for row in best.orderBy("lang", "rank").collect():  # ``top`` rows a language
        rankings.setdefault(row["lang"], []).append(row["gram"])
    return Profiles.of(rankings, top)


def identify(docs: DataFrame, profiles: Profiles, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``; only the text goes to Python, whole and once."""

    @F.arrow_udf("lang_pred string, score double")
    def judge(texts: pa.Array) -> pa.Array:
        judged = [profiles.nearest(texts[i].as_py()) for i in range(len(texts))]
        names, scores = zip(*judged) if judged else ((), ())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    (found,) = fresh(docs.columns, "found")
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    judged = docs.withColumn(found, judge(docs[text_col].cast("string")))
    return judged.select(*kept, F.col(found)["lang_pred"].alias("lang_pred"), F.col(found)["score"].alias("score"))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(3)) == 1, F.lit(False))


def learned_from(docs: DataFrame) -> Profiles:
    return learn(docs.where(~held_out()), "doc_id", "text", "lang")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    judged = identify(spread(docs.select("doc_id", "text")), learned_from(docs.select("doc_id", "text", "lang")))
    return judged.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
