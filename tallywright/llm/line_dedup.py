"""Line dedup: a line that many documents hold stays in one of them only.

Normalised lines are exploded and hashed to 128 bits, documents are counted per
hash, and each document is put together again by position without the lines it
has to lose.  DataFrame functions only.

* What is counted is hashes, counted within each task before the shuffle, so a
  line in a third of all documents is a few rows a task.
* A text moves once, to meet the positions that it loses; looking those up is
  linear in its lines however many they are.

* Frequent lines are looked up by a broadcast of at most ``BROADCAST_LINES`` of them,
  24 bytes each; more of them are joined, every line spread over ``SALTS`` tasks.

Defined results: a null or empty text is one empty line; a line twice in one
document counts once; rows of one ``doc_id`` are one document, and all of them
keep the line if it is the largest; a null ``doc_id`` is a document too, but
the largest only where all are null.  Other columns pass through, in their order;
``n_lines`` and ``n_dropped`` replace columns of those names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import fresh, lower_ascii, spread, stored, table

#: What a key loses at both ends: blank and \x09-\x0D.
MARGIN = " \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
BROADCAST_LINES, SALTS = 500_000, 8


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(MARGIN)))


def line_hashes(text: Column, min_chars: int) -> Column:
    """For each line 128 bits of its key, null if the key is short.

    Short lines go first and keys come before hashes, so that a key is made once.
    """
    keys = F.transform(F.split(text, "\n"), lambda line: F.when(F.length(line) >= min_chars, line_key(line)))
    return F.transform(
        keys,
        lambda key: F.when(F.length(key) >= min_chars, F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit(0x11E5), key).alias("b"))),
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
) -> DataFrame:
    """``docs`` with the kept lines in ``text_col``, and ``n_lines`` (before) and ``n_dropped``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.where(F.length(text) >= min_chars).select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("of"), line_hashes(text, min_chars).alias("hs"))

    def lines_of(rows: DataFrame) -> DataFrame:
        """A row for each different key of a row."""
        return rows.select("doc", F.explode(F.array_distinct("hs")).alias("h")).where("h IS NOT NULL").select("doc", "h.a", "h.b")

    by_row = lines_of(own).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.max("doc").alias("last"))
    # A document of several rows counts once; ids that stand in one row, mostly all of them, need no look at their lines.
    again = stored(docs.groupBy(F.col(id_col).alias("doc")).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc"), "repeated_ids")
    if not again.isEmpty():
        both = own.join(again.withColumnRenamed("doc", "id"), F.col("doc").eqNullSafe(F.col("id")), "left_semi")
        of_doc = lines_of(both).groupBy("doc", "a", "b").agg((1 - F.count(F.lit(1))).alias("n"))
        extra = of_doc.where("n < 0").groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("doc").alias("last"))
        by_row = by_row.unionByName(extra).groupBy("a", "b").agg(F.sum("n").alias("n"), F.max("last").alias("last"))
    counted = stored(by_row.where(F.col("n") >= min_docs).select("a", "b", "last"), "frequent_lines")

    placed = own.select("doc", "of", F.posexplode("hs").alias("at", "h")).where("h IS NOT NULL").select("doc", "of", "at", "h.a", "h.b")
    if counted.count() <= BROADCAST_LINES:
        met = placed.join(F.broadcast(counted), ["a", "b"])
    else:  # a line of a third of all documents is ``SALTS`` tasks' work
        salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")
        met = placed.withColumn("salt", F.pmod(F.xxhash64("doc", "at"), F.lit(SALTS)).cast("int")).join(counted.select("*", salts), ["a", "b", "salt"])
    lost = met.where(~F.col("doc").eqNullSafe(F.col("last"))).groupBy("doc", "of").agg(F.collect_set("at").alias("lost"))

    doc, of, gone, split, stay = fresh(docs.columns + ["n_lines", "n_dropped"], "doc", "of", "lost", "lines", "stay")
    lost = lost.select(F.col("doc").alias(doc), F.col("of").alias(of), F.col("lost").alias(gone))
    joined = docs.join(lost, docs[id_col].eqNullSafe(F.col(doc)) & (F.xxhash64(text) == F.col(of)), "left")
    # Lines and the places that stay are columns, each made once a row: a document is put together in proportion to its lines.
    named = [docs[c] for c in docs.columns if c not in ("n_lines", "n_dropped")]
    joined = joined.select(*named, F.col(gone), F.split(text, "\n").alias(split))
    here = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col(gone))
    joined = joined.withColumn(stay, F.when(F.col(gone).isNotNull(), here))
    kept = F.when(F.col(stay).isNull(), text).otherwise(F.array_join(F.transform(stay, lambda at: F.get(F.col(split), at)), "\n"))
    n_lines = F.size(split).cast("long")
    n_kept = F.coalesce(F.size(stay).cast("long"), n_lines)
    rest = [kept.alias(c) if c == text_col else F.col(c) for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*rest, n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS line_no
  FROM documents),
keyed AS (
  SELECT doc_id, line_no, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
frequent AS (
  SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (
  SELECT k.doc_id, k.line_no, k.line, f.key IS NOT NULL AND k.doc_id <> f.last_doc AS gone
  FROM keyed k LEFT JOIN frequent f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
