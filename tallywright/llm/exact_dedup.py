"""Exact dedup: a two-pass Bloom filter finds hashes that may repeat, and only their rows shuffle.

Texts are read once, and a narrow row is kept of each: id, code points and SHA-256
of the text without its white space.  The first pass over these rows counts the
Bloom cells that they fall on, two a row in one block of ``BLOCK`` cells; the cells
met twice are the filter, ``bits`` / 8 bytes at most.  The second pass tests each
row against it: a row with a cell met once has no copy and goes straight through;
the others are grouped by their SHA-256.  DataFrame functions only.

* Cells and groups are counted within each task before they shuffle, so a text in a
  third of all rows is a row a task.
* Groups of over 1 / ``HOT`` of all rows, ``HOT`` of them at most, are met by broadcast;
  a key of the shuffled join has no more rows than that.
* The filter has ``CELLS_A_ROW`` cells a row up to ``MAX_BITS``, for the broadcast; with
  ``n`` rows on ``m`` cells a row without copies shuffles with probability
  (1 - exp(-2n / m)) ** 2: 1.4 % at 16 a row, 28 % where 10 ** 8 rows meet 2 ** 28 cells,
  nearly all from 10 ** 9 on.  Such a row is 60 bytes, and results stay exact.

Defined results: a null text counts as empty, and all empty texts are one group; of
rows equal in code points and id, one stays; a null id comes after all others; other
columns play no part in ``copy_classes`` and pass through ``drop_copies`` unchanged,
whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import spread, stored, table

#: What texts lose before they are compared: blank and \x09-\x0D.
BLANKS = " \t\n\x0b\x0c\r"
BLOCK, CELLS_A_ROW, MIN_BITS, MAX_BITS, HOT = 4096, 16, 1 << 16, 1 << 28, 10_000


def without_blanks(text: Column) -> Column:
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit("")), BLANKS, F.coalesce(text, F.lit("")))


def filter_bits(rows: int, max_bits: int = MAX_BITS) -> int:
    """Cells of a filter over so many rows: the next power of two, within the bounds."""
    return min(max_bits, max(MIN_BITS, 1 << (CELLS_A_ROW * rows).bit_length()))


def _with_cells(df: DataFrame, bits: int) -> DataFrame:
    """The block of a row and its two cells in it."""
    within = F.xxhash64(F.lit(1), "sha")
    first, second = within.bitwiseAND(F.lit(BLOCK - 1)), F.shiftright(within, 12).bitwiseAND(F.lit(BLOCK - 1))
    block = F.pmod(F.xxhash64("sha"), F.lit(bits // BLOCK))
    return df.withColumns({"block": block, "first": first.cast("int"), "second": second.cast("int")})


def bloom_of_repeats(hashed: DataFrame, bits: int) -> DataFrame:
    """(block, words): the cells that two rows or more of ``hashed`` (sha) fall on, 64 to a word."""
    cells = _with_cells(hashed.select("sha"), bits).select("block", F.explode(F.array("first", "second")).alias("cell"))
    met = cells.groupBy("block", "cell").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    bit = F.expr("shiftleft(1L, cell & 63)")
    words = met.groupBy("block", F.shiftright("cell", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
    known = words.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("known"))
    every = F.sequence(F.lit(0), F.lit(BLOCK // 64 - 1))
    return known.select("block", F.transform(every, lambda w: F.coalesce(F.try_element_at("known", w), F.lit(0).cast("long"))).alias("words"))


def _tested(hashed: DataFrame, bloom: DataFrame, bits: int) -> DataFrame:
    """``hashed`` with ``maybe``: whether both cells of the row were met twice."""
    met = [F.expr(f"coalesce((shiftright(get(words, shiftright({c}, 6)), {c} & 63) & 1) = 1, false)") for c in ("first", "second")]
    joined = _with_cells(hashed, bits).join(F.broadcast(bloom), "block", "left")
    return joined.withColumn("maybe", met[0] & met[1]).drop("block", "first", "second", "words")


def copy_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """A row for each row of ``docs``: its id, ``keep_id``, ``group_size``, ``kept`` and ``sha``.

    Of equal texts the row of most code points, then of smallest id, stays.
    """
    text = F.col(text_col)
    hashed = docs.select(
        F.col(id_col).alias("id"),
        F.char_length(F.coalesce(text, F.lit(""))).alias("chars"),
        F.unhex(F.sha2(without_blanks(text), 256)).alias("sha"),
    )
    hashed = stored(hashed.withColumn("row", F.monotonically_increasing_id()), "text_hashes")
    n = hashed.count()
    bits = filter_bits(n, max_bits)
    tested = _tested(hashed, stored(bloom_of_repeats(hashed, bits), "bloom"), bits)

    repeated = tested.where("maybe")
    order = F.struct((-F.col("chars")).alias("c"), F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("row").alias("row"))
    groups = repeated.groupBy("sha").agg(F.count(F.lit(1)).alias("group_size"), F.min(order).alias("best")).where("group_size > 1")
    groups = stored(groups.select("sha", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row")), "copy_groups")
    hot, cold = (groups.where(f"group_size {sign} {n / HOT!r}D") for sign in (">", "<="))

    in_hot = repeated.join(F.broadcast(hot), "sha")
    others = repeated.join(F.broadcast(hot.select("sha")), "sha", "left_anti").join(cold, "sha", "left")
    single = tested.where("NOT maybe").withColumns({c: F.lit(None).cast(groups.schema[c].dataType) for c in ("group_size", "keep_id", "keep_row")})
    every = in_hot.unionByName(others).unionByName(single)
    alone = F.col("keep_row").isNull()
    return every.select(
        F.col("id").alias(id_col),
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "sha",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_bits: int = MAX_BITS) -> DataFrame:
    """``docs`` without copies: rows that have none pass where they lie, one of each group comes from a shuffle."""
    held = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("held"))
    text, own = F.col("held").getField(text_col), F.col("held").getField(id_col)
    hashed = held.withColumn("sha", F.unhex(F.sha2(without_blanks(text), 256)))
    bare = stored(hashed.select("sha"), "text_hashes")
    bits = filter_bits(bare.count(), max_bits)
    tested = _tested(hashed, stored(bloom_of_repeats(bare, bits), "bloom"), bits)
    order = F.struct(-F.char_length(F.coalesce(text, F.lit(""))), own.isNull(), own)
    one = tested.where("maybe").groupBy("sha").agg(F.min_by("held", order).alias("held"))
    return tested.where("NOT maybe").select("held.*").unionAll(one.select("held.*"))


def op12_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return copy_classes(docs).withColumn("text_sha256", F.lower(F.hex("sha"))).drop("sha")


OP12_SQL = r"""
WITH normal AS (
  SELECT doc_id, coalesce(text, '') AS whole,
         translate(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '') AS bare
  FROM documents),
ranked AS (
  SELECT doc_id, bare, row_number() OVER best AS place, first_value(doc_id) OVER best AS keep_id,
         count(*) OVER (PARTITION BY bare) AS group_size
  FROM normal WINDOW best AS (PARTITION BY bare ORDER BY length(whole) DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, sha256(bare) AS text_sha256
FROM ranked
"""
