"""Benchmark decontamination by spaced seeds.

A seed is a mask over a run of words: positions marked 1 are hashed, those
marked 0 are ignored, so two passages meet on a seed though words under its
zeros were replaced.  All seeds of all benchmark items are joined to all seeds
of all documents; a hit fixes an alignment, along which document and item are
compared word by word, and the alignment counts if any stretch of it is long
enough and enough of its words agree.  DataFrame functions only.

* A document becomes one array of word hashes.  Its seeds are made from that
  array, looked up and mostly discarded within one generated stage, which holds
  the array once: neither texts nor words are copied per seed, and no text is
  shuffled to be compared.
* A hit whose predecessor, one word earlier in both texts, is a hit of the same
  mask too says nothing new and goes, so an alignment is compared a few times
  and not once a word.  What is compared is cut to the item's length.
* Only the benchmark is broadcast.  Its seeds are counted first and items sent
  in blocks of about ``BLOCK`` seeds, a pass over the documents for each block, so
  what is broadcast stays bounded whatever the benchmark's size; one item is
  never split.
* What is shuffled is a row for each stretch that counts.

Defined results: words are lower-cased runs of letters and digits, told apart by
64-bit hashes; null and empty texts have none and never match; items shorter
than ``MIN_WORDS`` count if all their length agrees to the same share, and items
of one or two words never match; repeated items and
documents match each by itself; a null id stays null; other columns pass through
``clean_documents``.
"""

from __future__ import annotations

from collections.abc import Collection
from fractions import Fraction
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import spread, table, words

#: One of them fits between the replaced words of any 7 to 25 of which four in five agree; a longer
#: stretch of that share holds such a one of 13 to 25 words.  Items of 3 to 6 words have masks of their own.
MASKS, SHORT_MASKS, SHORT = ("1111", "11101"), ("111", "1101"), 7
MIN_WORDS, MIN_SHARE = 13, 0.8
BLOCK = 1_000_000


def word_hashes(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.xxhash64(w))


def _seed(hashes: Column, at: Column, n: int, mask: str) -> Column:
    """The hash of what the mask marks at this place; null where the mask reaches over the end."""
    marked = [F.get(hashes, at + F.lit(i)) for i, c in enumerate(mask) if c == "1"]
    return F.when(at + F.lit(len(mask)) <= F.size(hashes), F.xxhash64(F.lit(n), *marked))


def _seeds(hashes: Column, at: Column, masks: tuple[str, ...], used: Collection[int] | None = None) -> Column:
    """A (seed, mask) struct for each mask, or each that is used."""
    made = [F.struct(_seed(hashes, at, n, m).alias("seed"), F.lit(n).alias("mask")) for n, m in enumerate(masks) if used is None or n in used]
    return F.array(*made)


def _places(hashed: DataFrame, hashes: str) -> DataFrame:
    return hashed.select("*", F.posexplode(hashes).alias("at", "_word")).drop("_word")


def benchmark_items(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(item, item_key, item_hashes); the key stands for id and text."""
    return (
        items.select(F.col(id_col).alias("item"), F.xxhash64(id_col, text_col).alias("item_key"), word_hashes(F.col(text_col)).alias("item_hashes"))
        .where(F.size("item_hashes") > 0)
        .dropDuplicates(["item", "item_key"])
    )


def benchmark_seeds(items: DataFrame, masks: tuple[str, ...], short_masks: tuple[str, ...] = ()) -> DataFrame:
    """(seed, mask, item_key, item_at, before): ``before`` is the same mask's seed one word earlier.

    Items of fewer than ``SHORT`` words have seeds of the short masks, which are numbered after the others.
    """
    n_long, masks = len(masks), masks + short_masks
    placed = _places(items.select("item_key", "item_hashes"), "item_hashes")
    made = placed.select("item_key", "item_hashes", F.col("at").alias("item_at"), F.explode(_seeds(F.col("item_hashes"), F.col("at"), masks)).alias("s"))
    own = (F.col("s.mask") >= n_long) == (F.size("item_hashes") < SHORT) if short_masks else F.lit(True)
    return made.where(F.col("s.seed").isNotNull() & own).select("s.seed", "s.mask", "item_key", "item_at", _before(F.col("item_hashes"), F.col("item_at"), F.col("s.mask"), masks).alias("before"))


def _before(hashes: Column, at: Column, mask: Column, masks: tuple[str, ...]) -> Column:
    """The mask's seed one word earlier; null at the first word."""
    found = F.lit(None).cast("long")
    for n, m in enumerate(masks):
        found = F.when(mask == n, _seed(hashes, at - 1, n, m)).otherwise(found)
    return F.when(at > 0, found)


def best_stretch(doc_part: Column, item_part: Column, enough: Column, min_share: float) -> Column:
    """The stretch of at least ``enough`` words that is most above the share, of two aligned arrays.

    A word that agrees counts ``whole - share``, another ``-share``, both whole numbers,
    so a stretch reaches the share if its sum is not negative, and some stretch that is
    long enough reaches it if the greatest sum is not negative.  Of equal sums the
    longer one, then the first.  A struct with its start, its length, how many of its
    words agree and its sum; null where the arrays are shorter than ``enough``.
    """
    share = Fraction(str(min_share))

    def step(s: Column, i: Column) -> Column:
        same = F.when(F.get(doc_part, i) == F.get(item_part, i), 1).otherwise(0)
        total, agreed = s["total"] + share.denominator * same - share.numerator, s["agreed"] + same
        # Sums up to the last start that leaves enough words, and the least of them.
        at = i + 1 - enough
        late = F.when(at > 0, F.when(F.get(doc_part, at - 1) == F.get(item_part, at - 1), 1).otherwise(0))
        low_total = F.when(at > 0, s["low_total"] + share.denominator * late - share.numerator).otherwise(0)
        low_agreed = F.when(at > 0, s["low_agreed"] + late).otherwise(0)
        here = F.struct(low_total.alias("total"), at.alias("start"), low_agreed.alias("agreed"))
        least = F.when((at == 0) | ((at > 0) & (low_total < s["least"]["total"])), here).otherwise(s["least"])
        length, points = i + 1 - least["start"], total - least["total"]
        now = F.struct(points.alias("sum"), length.alias("n_words"), least["start"].alias("start"), (agreed - least["agreed"]).alias("n_same"))
        better = s["best"].isNull() | (points > s["best"]["sum"]) | ((points == s["best"]["sum"]) & (length > s["best"]["n_words"]))
        best = F.when((at >= 0) & better, now).otherwise(s["best"])
        return F.struct(
            total.alias("total"), agreed.alias("agreed"), low_total.alias("low_total"), low_agreed.alias("low_agreed"), least.alias("least"), best.alias("best")
        ).cast(state)

    state = (
        "struct<total:int,agreed:int,low_total:int,low_agreed:int,least:struct<total:int,start:int,agreed:int>,"
        "best:struct<sum:int,n_words:int,start:int,n_same:int>>"
    )
    zero = F.struct(*[F.lit(0)] * 4, F.struct(*[F.lit(0)] * 3), F.lit(None)).cast(state)
    return F.aggregate(F.sequence(F.lit(0), F.least(F.size(doc_part), F.size(item_part)) - 1), zero, step, lambda s: s["best"])


def overlaps(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text",
    masks: tuple[str, ...] = MASKS, short_masks: tuple[str, ...] = SHORT_MASKS, min_words: int = MIN_WORDS, min_share: float = MIN_SHARE, block: int = BLOCK,
) -> DataFrame:
    """(doc, text_hash, item, doc_at, n_words, n_same): each stretch of a document that counts for an item."""
    own = benchmark_items(items, item_id_col, item_text_col)
    seeds = benchmark_seeds(own, masks, short_masks)
    used = {r["mask"]: r["count"] for r in seeds.groupBy("mask").count().collect()}  # a row for each mask
    blocks, masks = max(1, -(-sum(used.values()) // block)), masks + short_masks

    def dealt(df: DataFrame, n: int) -> DataFrame:
        return F.broadcast(df.where(F.pmod("item_key", F.lit(blocks)) == n) if blocks > 1 else df)

    hashed = docs.select(F.col(id_col).alias("doc"), F.xxhash64(text_col).alias("text_hash"), word_hashes(F.col(text_col)).alias("hashes"))
    placed = _places(hashed, "hashes")
    seeded = placed.select("doc", "text_hash", "hashes", "at", F.explode(_seeds(F.col("hashes"), F.col("at"), masks, used or {0})).alias("s"))
    seeded = seeded.select("doc", "text_hash", "hashes", "at", "s.seed").where("seed IS NOT NULL")
    first = ~F.coalesce(F.col("before") == _before(F.col("hashes"), F.col("at"), F.col("mask"), masks), F.lit(False))
    parts = [seeded.join(dealt(seeds, n), "seed").where(first).join(dealt(own, n), "item_key") for n in range(blocks)]

    shift = F.col("at") - F.col("item_at")
    doc_from, item_from = F.greatest(F.lit(0), shift), F.greatest(F.lit(0), -shift)
    length = F.least(F.size("hashes") - doc_from, F.size("item_hashes") - item_from)
    judged = reduce(DataFrame.unionAll, parts).select(
        "doc", "text_hash", "item", doc_from.alias("doc_from"), F.least(F.lit(min_words), F.size("item_hashes")).alias("enough"),
        F.slice("hashes", doc_from + 1, length).alias("doc_part"), F.slice("item_hashes", item_from + 1, length).alias("item_part"),
    )
    long_enough = judged.where(F.size("doc_part") >= F.col("enough"))
    best = long_enough.withColumn("s", best_stretch(F.col("doc_part"), F.col("item_part"), F.col("enough"), min_share))
    return (
        best.where("s.sum >= 0")
        .select("doc", "text_hash", "item", (F.col("doc_from") + F.col("s.start")).alias("doc_at"), "s.n_words", "s.n_same")
        .groupBy("doc", "text_hash", "item", "doc_at", "n_words")
        .agg(F.max("n_same").alias("n_same"))
    )


def clean_documents(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how: object) -> DataFrame:
    """``docs`` without the rows that overlap an item; all columns as they are."""
    found = overlaps(docs, items, id_col, text_col, **how).select(F.col("doc").alias("_doc"), F.col("text_hash").alias("_hash")).distinct()
    return docs.join(found, docs[id_col].eqNullSafe(found["_doc"]) & (F.xxhash64(docs[text_col]) == found["_hash"]), "left_anti")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and item that overlap: the longest stretch, of equal ones the first."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = overlaps(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    best = F.max(F.struct("n_words", "n_same", (-F.col("doc_at")).alias("at"))).alias("b")
    return (
        found.groupBy(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))
        .agg(best, F.count(F.lit(1)).alias("n_places"))
        .select("doc_id", "item_id", (-F.col("b.at")).alias("word_at"), "b.n_words", "b.n_same", "n_places")
    )
