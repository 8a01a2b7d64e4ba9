"""Connected components by spreading the least label, with pointer jumping."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _shared_folder(df: DataFrame) -> str:
    context = df.sparkSession.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = context.getConf().get("spark.checkpoint.dir")
        if not named and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tallywright-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the session's checkpoint folder."""
    _shared_folder(df)
    return df.checkpoint()


def kept(df: DataFrame) -> DataFrame:
    """Cut the lineage with Parquet files in the checkpoint folder: of many rows a reader takes only the columns and rows it needs."""
    path = f"{_shared_folder(df).rstrip('/')}/kept-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, root): the least id reachable; ``nodes`` has id, ``edges`` has left_id and right_id.

    The number of rounds grows with the logarithm of the longest path, and a round works only on components
    that still have more than one label: most are small and done at once.  Nodes without edges are their own roots.
    """
    both = edges.select(F.col("left_id").alias("id"), F.col("right_id").alias("other")).where("id <> other")
    # Each edge both ways, with the labels of its ends.
    open_edges = cut(both.unionByName(both.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct().select("*", F.col("id").alias("root"), F.col("other").alias("far")))
    done = None
    while True:
        near = open_edges.groupBy("id").agg(F.least(F.min("root"), F.min("far")).alias("root"))
        further = near.select(F.col("id").alias("root"), F.col("root").alias("jump"))
        labels = cut(near.join(further, "root").select("id", F.least("root", "jump").alias("root")))
        ends = open_edges.select("id", "other").join(labels, "id").join(labels.select(F.col("id").alias("other"), F.col("root").alias("far")), "other")
        ends = cut(ends.select("id", "other", "root", "far"))
        still = cut(ends.where("root <> far").select("root").distinct())
        if still.isEmpty():
            done = labels if done is None else done.unionByName(labels)
            return nodes.select("id").join(done, "id", "left").select("id", F.coalesce("root", "id").alias("root"))
        settled = labels.join(still, "root", "left_anti").select("id", "root")
        done = settled if done is None else done.unionByName(settled)
        open_edges = cut(ends.join(still, "root", "left_semi").select("id", "other", "root", "far"))
