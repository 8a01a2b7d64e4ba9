"""Documents to pieces: five stages, each written and read again by the next.

Every stage sees all rows its predecessor kept.  The last stage adds ``n_tokens``
and a digest of the ids; all others return the columns of ``documents``.

Defined results of every stage: rows are judged each by itself, whatever other rows
have their id, but for line dedup, where rows of one id are one document; a null id is
carried; a null or empty text has no language and goes with the first stage, and where a
later stage meets one it stays; an empty table gives an empty one; columns that a stage
makes for itself give way to the caller's of the same name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import fresh, spread, stored, table
from tallywright.llm.decontaminate import clean_documents
from tallywright.llm.language_id import UNKNOWN, identify, learned_from
from tallywright.llm.line_dedup import dedup_lines
from tallywright.llm.ngram_join import join_classes
from tallywright.llm.sentencepiece_scan import digests


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts of no language go; ``lang`` stays as it was."""
    profiles = learned_from(docs.select("doc_id", "text", "lang"))
    return identify(docs, profiles).where(F.col("lang_pred") != UNKNOWN).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Frequent lines stay once; a document that loses every line goes."""
    kept = dedup_lines(docs)
    emptied = (F.col("n_dropped") > 0) & (F.btrim("text") == "")
    return kept.where(~emptied).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of like texts one row stays: of the smallest id, null after all others, and of its rows any one.

    Rows are told apart by id and text, so a row goes for its own text and not for that
    of another row of its id; rows alike in both are copies too, of which one stays.
    """
    name, of = fresh(docs.columns, "row_key", "of")
    said = F.concat(F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-")), F.lit("\n"), F.coalesce(F.concat(F.lit("="), "text"), F.lit("-")))
    keyed = docs.withColumn(name, F.md5(said))
    rows = stored(keyed.groupBy(F.col(name).alias("key")).agg(F.first("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("rows")), "rows")
    classes = join_classes(keyed.select(F.col(name).alias("doc_id"), "text")).select(F.col("doc_id").alias("key"), "class_id").distinct()
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key"))
    kept = rows.join(classes, "key").groupBy("class_id").agg(best.alias("best")).select(F.col("best.key").alias(of))
    kept = stored(rows.join(kept, rows["key"] == kept[of], "left_semi"), "kept")
    once, again = kept.where("rows = 1").select(F.col("key").alias(name)), kept.where("rows > 1").select(F.col("key").alias(name))
    one = keyed.join(again, name, "left_semi").dropDuplicates([name])
    return keyed.join(once, name, "left_semi").unionByName(one).select(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return clean_documents(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes every text; ``round_trip`` says whether its ids give it back."""
    return digests(docs)


STAGES = [
    ("language_id", language),
    ("line_dedup", lines),
    ("ngram_join", near_duplicates),
    ("decontamination", decontaminate),
    ("sentencepiece", pieces),
]

#: The stages learn and hash, which SQL does not express; tests compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spread(table(spark, sf_dir, "documents"))
    for n, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n + 1 < len(STAGES):
            docs = stored(docs, name)
    return docs
