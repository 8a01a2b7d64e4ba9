"""A landing folder as a stream: files that arrive become documents of a stored table, each batch once.

A batch is merged by document id and carries its number, so one that is run again
after a failure finds its number stored and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallywright.operators import ingest, store
from tallywright.operators.versions import Store

COLUMNS = f"document_id string, source_name string, fields {ingest.FIELDS}, text string, error string, batch long"


def arriving(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """(path, name, suffix, content, error) of supported files, as they come; folders below are looked into."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    found = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", files_a_batch).load(folder)
    return ingest.supported(found)


def merge_batch(tables: Store, name: str, documents: DataFrame, batch: int) -> bool:
    """Merges a batch's documents unless it is stored already; whether it was merged.

    Files that could not be read are kept too, under their names.  Of documents of one id in a batch one stays.
    """
    tables.create(name, COLUMNS)
    held = tables.table(name)
    if not held.where(F.col("batch") >= batch).isEmpty():
        return False
    own = documents.withColumn("document_id", F.coalesce("document_id", F.concat(F.lit("error:"), "source_name"))).withColumn("batch", F.lit(batch).cast("long"))
    once = own.dropDuplicates(["document_id"])
    if not once.isEmpty():
        tables.write(name, store.upsert(held, once.select(held.columns), ["document_id"]))
    return True


def land(spark: SparkSession, folder: str, tables: Store, name: str, progress: str, files_a_batch: int = 100) -> StreamingQuery:
    """Starts a query that takes what lies in ``folder`` and is new, batch by batch, and then ends; ``progress`` is its checkpoint folder."""
    documents = ingest.ingest(arriving(spark, folder, files_a_batch))
    return (
        documents.writeStream.foreachBatch(lambda rows, batch: merge_batch(tables, name, rows, batch))
        .option("checkpointLocation", progress).trigger(availableNow=True).start()
    )
