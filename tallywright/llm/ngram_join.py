"""N-gram Jaccard join: MinHash banding finds candidates, full sets decide.

Texts of the same words are one node.  A node's signature is cut into bands of
``rows`` hashes, with as many bands as the wished recall needs at the threshold.
Nodes that meet in a band's bucket, directly or through others, form a candidate
component, found by spreading minima over (node, bucket) rows, so a bucket costs
its members and not their pairs.  Components then get their full sets and are
compared in blocks of about ``BLOCK`` nodes, two blocks a task: a task multiplies
sparse incidence columns, counts links and returns one row a node with its root
in a spanning forest.  No pair is ever emitted, and a component of a third of
all rows is many tasks of bounded size.

Defined results: words are lower-cased runs of letters and digits; a text of
fewer than ``n`` words has one n-gram, all its words; a text without words links
to nothing and is its own class; rows without an id are kept with class and
links null; rows of one id and one text count as copies each; other columns are
ignored.  Texts are told apart by a 64-bit hash of their words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import cut, spread, stored, table, words

N, THRESHOLD, RECALL, ROWS, BLOCK = 5, 0.8, 0.999, 7, 1024
_ODD = np.uint64(0x9E3779B97F4A7C15)


def bands_for(threshold: float, recall: float, rows: int) -> int:
    """Least number of bands for which a pair at the threshold meets with that probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * _ODD
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def grams_of(hashes: np.ndarray, n: int) -> np.ndarray:
    """N-gram hashes of a text's word hashes, in order and with repeats."""
    h = np.asarray(hashes, dtype=np.int64).view(np.uint64)
    span = min(n, len(h))
    out = np.zeros(len(h) - span + 1, dtype=np.uint64)
    for j in range(span):
        out = _mixed(out + h[j : j + len(out)] + np.uint64(j + 1))
    return out


def gram_set(hashes: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-gram hashes of a text's word hashes."""
    return np.unique(grams_of(hashes, n))


def buckets(grams: np.ndarray, a: np.ndarray, b: np.ndarray, bands: int) -> np.ndarray:
    """One bucket number a band; repeated n-grams change nothing.

    Minima are of 32-bit hashes, which vectorise well, in runs that fit a core's cache.
    """
    x = (grams >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(a), np.iinfo(np.uint32).max, dtype=np.uint32)
    for at in range(0, len(x), 128):
        hashed = x[at : at + 128, None] * a
        hashed += b
        np.minimum(least, hashed.min(axis=0), out=least)
    out = np.arange(1, bands + 1, dtype=np.uint64)
    for column in least.astype(np.uint64).reshape(bands, -1).T:
        out = _mixed(out + column)
    return out.view(np.int64)


def components(rows: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable through shared buckets; ``rows`` has node and bucket."""
    labels = cut(rows.select("node").distinct().withColumn("label", F.col("node")))
    while True:
        least = rows.join(labels, "node").groupBy("bucket").agg(F.min("label").alias("least"))
        near = rows.join(least, "bucket").groupBy("node").agg(F.min("least").alias("near"))
        step = near.withColumnRenamed("near", "label")
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = step.join(jump, "label").select("node", F.least("label", "further").alias("label"))
        step = cut(step)
        moved = step.join(labels.withColumnRenamed("label", "old"), "node").where("label <> old").limit(1).count()
        labels = step
        if not moved:
            return labels


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs reach the threshold: a symmetric matrix without its diagonal."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    grams, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    everywhere = int((count == len(sets)).sum())
    shared = (count > 1) & (count < len(sets))
    number = np.cumsum(shared) - 1
    used = shared[column]
    owner, column = owner[used], number[column[used]]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    both = np.full((len(sets), len(sets)), everywhere, dtype=np.float32)
    for low in range(0, int(shared.sum()), 4096):
        lo, hi = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((len(sets), 4096), dtype=np.float32)
        part[owner[lo:hi], column[lo:hi] - low] = 1
        both += part @ part.T
    either = sizes[:, None] + sizes[None, :] - both
    out = both >= threshold * either - 1e-6
    np.fill_diagonal(out, False)
    return out


def _forest(links: np.ndarray) -> np.ndarray:
    root = np.arange(len(links))
    while True:
        step = np.minimum(root, np.where(links, root, len(root)).min(axis=1))
        step = step[step]
        if (step == root).all():
            return root
        root = step


def join_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N,
    threshold: float = THRESHOLD, recall: float = RECALL, rows: int = ROWS, block: int = BLOCK,
) -> DataFrame:
    """(id, class_id, n_links): the smallest id of the connected group, and how many rows it links to."""
    bands = bands_for(threshold, recall, rows)
    draw = np.random.default_rng(20240229)
    a = draw.integers(0, 2**31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    b = draw.integers(0, 2**32, bands * rows, dtype=np.uint32)
    named = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    key_type = named.schema["id"].dataType.simpleString()

    def noded(df: DataFrame) -> DataFrame:
        hashed = df.withColumn("hs", F.transform(words(F.col("text")), lambda w: F.xxhash64(w))).drop("text")
        return hashed.withColumn("key", F.xxhash64("hs"))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            made = [buckets(grams_of(h, n), a, b, bands) if len(h) else np.empty(0, dtype=np.int64) for h in batch["hs"]]
            yield batch[["id", "key"]].assign(buckets=made)

    # The one pass over all texts; whatever follows starts from ids and bucket numbers.
    signed = noded(named).mapInPandas(sign, f"id {key_type}, key long, buckets array<long>")
    signed = stored(signed.select("id", F.when(F.size("buckets") > 0, F.col("key")).alias("node"), "buckets"), "signed")
    members = signed.select("id", "node")
    nodes = signed.where("node IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first"), F.first("buckets").alias("buckets"))
    nodes = stored(nodes, "nodes")
    met = nodes.select("node", F.explode("buckets").alias("bucket"))
    nodes = nodes.drop("buckets")
    full = met.groupBy("bucket").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select("bucket")
    met = cut(met.join(full, "bucket"))
    labels = components(met)
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("size"))
    placed = cut(labels.join(sizes, "label").join(nodes, "node"))

    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="hs").assign(grams=[gram_set(h, n).tobytes() for h in batch["hs"]])

    # Texts and not their hashes are shuffled: they take less room.
    wanted = placed.select(F.col("first").alias("id"), "node", "label", "copies", F.ceil(F.col("size") / block).alias("parts"))
    dealt = (
        noded(named.join(wanted, "id"))
        .where("key = node")
        .select("node", "label", "copies", "parts", "hs")
        .mapInPandas(sets, "node long, label long, copies long, parts long, grams binary")
        .withColumn("own", F.pmod(F.xxhash64("node"), F.col("parts")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
        .withColumn("lo", F.least("own", "other"))
        .withColumn("hi", F.greatest("own", "other"))
    )

    def verify(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.drop_duplicates("node").sort_values("node")
        grams = [np.frombuffer(g, dtype=np.uint64) for g in group["grams"]]
        node, copies, own = (group[c].to_numpy(np.int64) for c in ("node", "copies", "own"))
        links = linked(grams, threshold)
        counted = links & ((own[:, None] != own[None, :]) | (key[1] == key[2]))
        return pd.DataFrame({"node": node, "links": counted @ copies, "root": node[_forest(links)]})

    judged = cut(dealt.groupBy("label", "lo", "hi").applyInPandas(verify, "node long, links long, root long"))
    forest = judged.select("node", F.explode(F.array("node", "root")).alias("bucket")).distinct()
    groups = components(cut(forest))
    links = judged.groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.join(links, "node", "left").join(groups, "node", "left").withColumn("label", F.coalesce("label", "node"))
    known = cut(known)
    least = known.groupBy("label").agg(F.min("first").alias("class_id"))
    known = known.join(least, "label").select("node", "class_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    found = members.where("node IS NOT NULL").join(known, "node").select(F.col("id").alias(id_col), "class_id", "n_links")
    none = members.where("node IS NULL").select(F.col("id").alias(id_col), F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"))
    nameless = docs.where(F.col(id_col).isNull()).select(F.col(id_col), F.col(id_col).alias("class_id"), F.lit(None).cast("long").alias("n_links"))
    return found.unionByName(none).unionByName(nameless)


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_classes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
