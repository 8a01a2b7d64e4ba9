"""Source divergence audit: how far the word shares of a language's sources lie apart.

A byte-level tokenizer reads Arrow's own UTF-8 buffers: a lookup table of 256 entries
lower-cases A-Z and marks what is no term byte, so that the buffer's non-zero runs
within a row are the terms.  XXH64, computed for all slices at once, groups them;
every slice is compared byte by byte with its group's first.  A piece of a batch
becomes a CSR matrix of documents by terms, and ``reduceat`` sums it by (lang, source).

Spark then sums counts and documents by (lang, term, source) in one shuffle by
(lang, term), keeps the terms of enough documents, and deals each language's terms
into blocks of about ``BLOCK`` counts.  A block is a CSR matrix of sources by terms;
its absolute differences, source by source, come from ``reduceat`` over the counts
above zero, and from prefix sums for those at zero.  Blocks give a number for each two
sources, which Spark adds; no task holds a language's whole table.

Shares are whole numbers, p = 1 + floor(1e9 * (count + 5) / (N + 5 * V)), divided as
decimals, so counts of any size stay exact.

Defined results: null texts, languages and sources are ''; a row is a document, also
if its id repeats; a group without terms has p from its zero counts; a language without
kept terms has value 0 for every pair of its sources and no ``term`` rows; a language of
one source has no ``pair`` rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.llm.common import spread, stored, table

MIN_DOCS, TOP, PIECE, BLOCK = 30, 50, 8 << 20, 25_000

#: Term bytes are letters of ASCII, made small, and all of 0x80 and above; 0 is anything else.
FOLD = np.zeros(256, dtype=np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
FOLD[0x61:0x7B] = FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)

#: The five primes of XXH64.
P1, P2, P3, P4, P5 = (
    np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _windows(buffer: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` bytes from each place on as a number; ``buffer`` has 8 bytes to spare."""
    return np.ndarray((len(buffer) - width + 1,), dtype=f"<u{width}", buffer=buffer, strides=(1,))


def slice_hashes(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each slice, all of one size below 32 at once."""
    out = np.empty(len(starts), dtype=np.uint64)
    by8, by4 = _windows(buffer, 8), _windows(buffer, 4)
    capped = np.minimum(sizes, 32).astype(np.uint8)
    order = np.argsort(capped, kind="stable")
    bounds = np.searchsorted(capped[order], np.arange(1, 33))
    with np.errstate(over="ignore"):
        for size in range(1, 32):
            own = order[bounds[size - 1] : bounds[size]]
            if not len(own):
                continue
            at = starts[own]
            h = np.full(len(own), P5 + np.uint64(size), dtype=np.uint64)
            for _ in range(size // 8):
                h = _turned(h ^ (_turned(by8[at] * P2, 31) * P1), 27) * P1 + P4
                at = at + 8
            if size % 8 >= 4:
                h = _turned(h ^ (by4[at].astype(np.uint64) * P1), 23) * P2 + P3
                at = at + 4
            for _ in range(size % 4):
                h = _turned(h ^ (buffer[at].astype(np.uint64) * P5), 11) * P1
                at = at + 1
            h = (h ^ (h >> np.uint64(33))) * P2
            h = (h ^ (h >> np.uint64(29))) * P3
            out[own] = h ^ (h >> np.uint64(32))
    for i in order[bounds[31] :]:
        out[i] = xxhash.xxh64_intdigest(buffer[starts[i] : starts[i] + sizes[i]])
    return out


def _same_bytes(buffer: np.ndarray, a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the slices from ``a`` and from ``b``, of the same sizes, have the same bytes."""
    same, by8 = np.ones(len(a), dtype=bool), _windows(buffer, 8)
    left, rest, done = np.arange(len(a)), sizes.astype(np.int64), 0
    while len(left):
        extra = (8 * np.maximum(8 - rest, 0)).astype(np.uint64)
        same[left] &= ((by8[a[left] + done] ^ by8[b[left] + done]) << extra) == 0
        done += 8
        left, rest = left[rest > 8], rest[rest > 8] - 8
    return same


def grouped_slices(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray, hashes: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(first, code): a slice of each different one, and for each slice which of them it is."""
    hashes = slice_hashes(buffer, starts, sizes) if hashes is None else hashes
    _, first, code = np.unique(hashes, return_index=True, return_inverse=True)
    met = first[code]
    differ = sizes != sizes[met]
    alike = np.flatnonzero(~differ)
    differ[alike] = ~_same_bytes(buffer, starts[alike], starts[met[alike]], sizes[alike])
    known: dict[bytes, int] = {}
    for i in np.flatnonzero(differ):  # hashes that collide; mostly none
        term = buffer[starts[i] : starts[i] + sizes[i]].tobytes()
        if term not in known:
            known[term] = len(first)
            first = np.append(first, i)
        code[i] = known[term]
    return first, code


def term_slices(buffer: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, size, row) of each term of a folded buffer; rows begin at ``offsets`` and end at the last."""
    inside = buffer[offsets[0] : offsets[-1]] != 0
    before, after = np.zeros_like(inside), np.zeros_like(inside)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    edge = offsets[1:-1] - offsets[0]
    edge = edge[(edge > 0) & (edge < len(inside))]
    before[edge], after[edge - 1] = False, False
    starts = np.flatnonzero(inside & ~before) + offsets[0]
    ends = np.flatnonzero(inside & ~after) + 1 + offsets[0]
    return starts, ends - starts, np.searchsorted(offsets, starts, side="right") - 1


def counted(major: np.ndarray, minor: np.ndarray, n_minor: int, weights: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """(major, minor, entries, sum of weights) of each different pair, as a CSR matrix has them."""
    keys = major.astype(np.int64) * n_minor + minor
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.diff(keys, prepend=-1))
    entries = np.diff(heads, append=len(keys))
    summed = entries if weights is None or not len(heads) else np.add.reduceat(weights[order], heads)
    return keys[heads] // n_minor, keys[heads] % n_minor, entries, summed


def _term_array(buffer: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> pa.Array:
    ends = np.cumsum(sizes)
    places = np.repeat(starts - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(buffer[places]))


def _pieces(offsets: np.ndarray, piece: int) -> Iterator[tuple[int, int]]:
    """Runs of rows of about ``piece`` bytes."""
    low = 0
    while low < len(offsets) - 1:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + piece, side="right")) - 1)
        yield low, high
        low = high


def _long_text(buffer: np.ndarray, low: int, high: int, piece: int) -> tuple[list[bytes], np.ndarray]:
    """Terms of one text and their counts, cut behind bytes that are in no term."""
    total: dict[bytes, int] = {}
    while low < high:
        end = min(high, low + piece)
        while end < high and buffer[end - 1]:
            end += 1
        starts, sizes, _ = term_slices(buffer, np.array([low, end]))
        first, code = grouped_slices(buffer, starts, sizes)
        for i, n in zip(first, np.bincount(code, minlength=len(first)), strict=True):
            term = buffer[starts[i] : starts[i] + sizes[i]].tobytes()
            total[term] = total.get(term, 0) + int(n)
        low = end
    return list(total), np.array(list(total.values()), dtype=np.int64)


_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])


def count_terms(batch: pa.RecordBatch, piece: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Rows (lang, source, text) to (lang, source, term, n, docs), a row for each different key of a piece."""
    lang, source, text = (batch.column(i) for i in range(3))
    wide = pa.types.is_large_string(text.type)
    _, raw_offsets, raw = text.buffers()
    offsets = np.frombuffer(raw_offsets, dtype=np.int64 if wide else np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.empty(0, dtype=np.uint8)
    lang, source = lang.cast(pa.string()).dictionary_encode(), source.cast(pa.string()).dictionary_encode()
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()

    def rows(groups: np.ndarray, terms: pa.Array, n: np.ndarray, docs: np.ndarray) -> pa.RecordBatch:
        of_lang, of_source = pa.array(groups // len(source.dictionary)), pa.array(groups % len(source.dictionary))
        return pa.RecordBatch.from_arrays([lang.dictionary.take(of_lang), source.dictionary.take(of_source), terms, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], schema=_COUNTS)

    for low, high in _pieces(offsets, piece):
        begin, end = int(offsets[low]), int(offsets[high])
        buffer = np.zeros(end - begin + 8, dtype=np.uint8)
        buffer[: end - begin] = FOLD[data[begin:end]]
        if end - begin > 2 * piece:
            terms, n = _long_text(buffer, 0, end - begin, piece)
            yield rows(np.full(len(n), group[low]), pa.array(terms, pa.binary()).cast(pa.string()), n, np.ones(len(n), dtype=np.int64))
            continue
        starts, sizes, row = term_slices(buffer, offsets[low : high + 1] - begin)
        if not len(starts):
            continue
        first, code = grouped_slices(buffer, starts, sizes)
        doc, term, n, _ = counted(row, code, len(first))
        of, term, docs, n = counted(group[low:high][doc], term, len(first), n)
        yield rows(of, _term_array(buffer, starts[first], sizes[first]).take(pa.array(term)), n, docs)


def kept_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, source, term, n, lang_n, head): counts above zero of the terms that enough documents of the language hold.

    ``lang_n`` is the term's count in the whole language, ``head`` marks one row a term.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from count_terms(batch)

    none = F.lit("")
    named = docs.select(*(F.coalesce(F.col(c), none).alias(k) for c, k in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))
    made = named.mapInArrow(count, "lang string, source string, term string, n long, docs long")
    # One shuffle: a (lang, term) lies in one task, so that groups, windows and what follows need no other.
    summed = made.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")
    judged = summed.select(
        "lang", "source", "term", "n",
        F.sum("docs").over(term).alias("docs"),
        F.sum("n").over(term).alias("lang_n"),
        (F.row_number().over(term.orderBy("source")) == 1).alias("head"),
    )
    return judged.where(F.col("docs") >= min_docs).drop("docs")


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(1e9 * (count + 5) / (total + 5 * terms)), exact for any counts."""
    whole = "decimal(20,0)"
    over, under = (count.cast(whole) + 5) * F.lit(1_000_000_000), total.cast(whole) + terms.cast(whole) * 5
    return F.lit(1).cast("long") + F.call_function("div", over, under)


def block_differences(source: np.ndarray, term: np.ndarray, p: np.ndarray, zero: np.ndarray, n_terms: int) -> np.ndarray:
    """Sums over all terms of |p of a - p of b| for sources a < b, as a square matrix.

    ``source``, ``term`` and ``p`` are the entries above zero of a matrix whose others are ``zero`` of their source.
    """
    order = np.lexsort((term, source))
    source, term, p = source[order], term[order], p[order]
    ptr = np.searchsorted(source, np.arange(len(zero) + 1))
    out = np.zeros((len(zero), len(zero)), dtype=np.int64)
    full = np.flatnonzero(np.diff(ptr))
    for a in range(len(zero) - 1):
        own = slice(ptr[a], ptr[a + 1])
        here = np.full(n_terms, zero[a], dtype=np.int64)
        here[term[own]] = p[own]
        # What b would have if it were zero everywhere: a's values below and above b's zero.
        values = np.sort(here)
        sums = np.concatenate([[0], np.cumsum(values)])
        below = np.searchsorted(values, zero)
        out[a] = zero * (2 * below - n_terms) + sums[-1] - 2 * sums[below]
        met = here[term]
        change = np.abs(p - met) - np.abs(zero[source] - met)
        if len(full):
            out[a, full] += np.add.reduceat(change, ptr[full])
    return np.triu(out, 1)


def divergences(
    docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
    min_docs: int = MIN_DOCS, top: int = TOP, block: int = BLOCK,
) -> DataFrame:
    """(lang, source, part, item, value, rank): ``pair`` rows for each other source, ``term`` rows for what stands out."""
    counts = stored(kept_terms(docs, lang_col, source_col, text_col, min_docs), "term_counts")
    every = docs.select(F.coalesce(F.col(lang_col), F.lit("")).alias("lang"), F.coalesce(F.col(source_col), F.lit("")).alias("source")).distinct()
    langs = counts.groupBy("lang").agg(F.sum("n").alias("lang_total"), F.sum(F.col("head").cast("long")).alias("terms"), F.count(F.lit(1)).alias("entries"))
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    nil = F.lit(0).cast("long")
    groups = every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").select(
        "lang", "source", *(F.coalesce(c, nil).alias(c) for c in ("total", "lang_total", "terms", "entries"))
    )
    blocks = F.ceil(F.col("entries") / block)
    zero = F.when(F.col("terms") > 0, share(nil, F.col("total"), F.col("terms"))).otherwise(nil)
    groups = stored(groups.select("*", F.greatest(blocks, F.lit(1)).alias("blocks"), zero.alias("zero")), "term_groups")

    shares = counts.join(groups, ["lang", "source"]).select(
        "lang", "source", "term",
        share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
        F.pmod(F.xxhash64("term"), F.col("blocks")).alias("block"),
    )

    def compare(key: tuple, entries: pd.DataFrame, sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources.sort_values("source")
        names, zeros = sources["source"].to_numpy(), sources["zero"].to_numpy(np.int64)
        terms, code = np.unique(entries["term"].to_numpy(np.int64), return_inverse=True)
        at = pd.Index(names).get_indexer(entries["source"])
        sums = block_differences(at, code, entries["p"].to_numpy(np.int64), zeros, len(terms))
        a, b = np.triu_indices(len(names), 1)
        return pd.DataFrame({"lang": key[0], "a": names[a], "b": names[b], "value": sums[a, b]})

    # Within a block terms are told apart by number, given in the order of (lang, block).
    numbered = shares.select("lang", "block", "source", "p", F.dense_rank().over(Window.partitionBy("lang", "block").orderBy("term")).cast("long").alias("term"))
    spread_groups = groups.select("lang", "source", "zero", F.explode(F.sequence(nil, F.col("blocks") - 1)).alias("block"))
    halves = (
        numbered.groupBy("lang", "block").cogroup(spread_groups.groupBy("lang", "block"))
        .applyInPandas(compare, "lang string, a string, b string, value long")
        .groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    )
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    pairs = halves.select("lang", both.alias("of"), "value").select("lang", "of.source", F.lit("pair").alias("part"), "of.item", "value")
    marked = shares.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    ranked = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return pairs.withColumn("rank", ranked).unionByName(marked.withColumn("rank", ranked).where(F.col("rank") <= top))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergences(spread(table(spark, sf_dir, "documents").select("lang", "source", "text")))


OP13_SQL = r"""
WITH docs AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found
  FROM documents),
terms AS (SELECT doc, lang, source, unnest(found) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM terms GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
langs AS (
  SELECT l.lang, coalesce(sum(k.n), 0)::HUGEINT AS total, count(k.term)::HUGEINT AS v
  FROM (SELECT DISTINCT lang FROM docs) l LEFT JOIN kept k USING (lang) GROUP BY l.lang),
counts AS (SELECT lang, source, term, count(*) AS n FROM terms JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (
  SELECT d.lang, d.source, coalesce(c.total, 0)::HUGEINT AS total
  FROM (SELECT DISTINCT lang, source FROM docs) d
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY lang, source) c USING (lang, source)),
shares AS (
  SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (t.total + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM totals t JOIN langs l USING (lang) JOIN kept k USING (lang)
  LEFT JOIN counts c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source
  GROUP BY a.lang, a.source, b.source),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(s.value, 0) AS value
  FROM totals a JOIN totals b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
ranked AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q),
numbered AS (
  SELECT lang, source, part, item, value::BIGINT AS value,
         row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank
  FROM ranked)
SELECT * FROM numbered WHERE part = 'pair' OR rank <= 50
"""
