"""Exact top-k by inner product with M-trees.

Vectors go to cells by their nearest pivot, and a cell to shards of bounded size;
each shard is an M-tree of paged nodes.  An entry of an inner page is a routing
object, its covering radius and its distance to the parent's routing object; a
leaf's entries are vectors with their distance to the parent's.  Pages wait in a
heap by the least distance that anything below can have for any query of a
block; stored parent distances rule entries out before their own distance is
computed; and the search ends when the heap's best is beyond every query's k-th.

Inner products become distances by one more coordinate: with ``m`` the shard's
largest squared norm, ``x' = (x, sqrt(m - |x|^2))`` and ``q' = (q, 0)`` give
``d(q', x')^2 = |q|^2 + m - 2 q.x``, a metric in which nearest means largest
product.  Distances only prune, with a slack for rounding.  Scores are exact: of
doubles where no product can pass 2**53, else of Python's whole numbers for the
candidates that rounding leaves open.

* A query is answered in the cell of its nearest pivot first.  With its k-th score it
  then goes to those other cells whose ball may hold a better one.
* Of equal vectors only those with the ``k + 1`` smallest ids are kept, up to ``k``
  times each: no answer needs more of them, and copies cost nothing.
* Shards hold about ``SHARD`` vectors, at most ``MAX_CELLS`` pivots and their radii are
  sent to tasks, and a task holds one shard and ``BLOCK`` queries.

Defined results: a vector that is null, empty or has a null or non-finite
component (also after scaling) takes no part, nor does a row without an id; a
score beyond 64 bits saturates; only vectors of equal length are compared; all
rows with the query's id count as its own row; repeated rows are candidates each;
a query id with different vectors is a query with each; ties go to the smaller
id; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from tallywright.llm.common import stored, table

SHARD, BLOCK, PAGE, FANOUT, MAX_CELLS = 8192, 8192, 256, 16, 4096
SCALE, EXACT, LARGEST = 256, float(1 << 53), (1 << 63) - 1
KEY = ["dim", "cell", "salt"]


class MTree:
    """Pages of one shard.  ``pages[i]`` is (leaf?, rows or objects, radii, parent distances, children)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.lexsort((*vectors.T[::-1], ids))
        self.ids, self.vectors = ids[order], vectors[order]
        self.most = float(np.abs(vectors).max())
        self.unit = 2.0 ** np.ceil(np.log2(max(1.0, self.most)))  # exact to divide by; squares stay small
        near = self.vectors / self.unit
        norms = (near**2).sum(axis=1)
        self.top = float(norms.max())
        self.points = np.column_stack((near, np.sqrt(np.maximum(self.top - norms, 0))))
        self.pages: list[tuple] = []
        self.root = self._build(np.arange(len(ids)), None)

    def _build(self, rows: np.ndarray, parent: np.ndarray | None) -> int:
        points = self.points[rows]
        to_parent = np.linalg.norm(points - parent, axis=1) if parent is not None else np.zeros(len(rows))
        if len(rows) <= PAGE:
            self.pages.append((True, rows, np.zeros(len(rows)), to_parent, None))
            return len(self.pages) - 1
        pivots = self._pivots(points)
        near = ((points**2).sum(1)[:, None] - 2 * points @ pivots.T + (pivots**2).sum(1)).argmin(axis=1)
        groups = [np.flatnonzero(near == j) for j in range(len(pivots))]
        if max(map(len, groups)) == len(rows):  # all alike: any split will do
            groups = np.array_split(np.arange(len(rows)), FANOUT)
        objects, radii, up, children = [], [], [], []
        for own in groups:
            if len(own):
                center = points[own[((points[own] - points[own].mean(axis=0)) ** 2).sum(axis=1).argmin()]]
                objects.append(center)
                radii.append(np.linalg.norm(points[own] - center, axis=1).max())
                up.append(np.linalg.norm(center - parent) if parent is not None else 0.0)
                children.append(self._build(rows[own], center))
        self.pages.append((False, np.array(objects), np.array(radii), np.array(up), children))
        return len(self.pages) - 1

    @staticmethod
    def _pivots(points: np.ndarray) -> np.ndarray:
        """Far from each other: each next is the farthest of a spread of the points."""
        spread = points[:: max(1, len(points) // 512)]
        chosen = [spread[0]]
        away = np.linalg.norm(spread - chosen[0], axis=1)
        for _ in range(min(FANOUT, len(spread)) - 1):
            chosen.append(spread[away.argmax()])
            away = np.minimum(away, np.linalg.norm(spread - chosen[-1], axis=1))
        return np.array(chosen)

    def search(self, own_ids: np.ndarray, queries: np.ndarray, k: int, known: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query its k best (score, id) of at least the ``known`` score, best first, without its own id."""
        best: list[list[tuple[int, int]]] = [[] for _ in own_ids]  # heaps of (score, -id)
        near = queries / self.unit
        points = np.column_stack((near, np.zeros(len(near))))
        norms = (near**2).sum(axis=1)
        slack = 1e-6 * (1 + np.sqrt(norms + self.top))
        least = known.astype(float)  # the score that a candidate must reach

        def reach(which: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(norms[which] + self.top - 2 * (least[which] / self.unit / self.unit), 0)) + slack[which]

        heap = [(0.0, 0, self.root, np.arange(len(own_ids)), np.zeros(len(own_ids)), None)]
        pushed = 0
        while heap:
            lowest, _, page, which, floor, from_parent = heapq.heappop(heap)
            within = reach(which)
            if lowest > within.max(initial=0.0) and lowest > reach(np.arange(len(own_ids))).max():
                break
            live = floor <= within
            which, within = which[live], within[live]
            if not len(which):
                continue
            leaf, objects, radii, to_parent, children = self.pages[page]
            wanted = np.ones((len(which), len(objects)), dtype=bool)
            if from_parent is not None:  # stored distances first
                from_parent = from_parent[live]
                wanted = np.abs(from_parent[:, None] - to_parent) - radii <= within[:, None]
            rows, entries = np.flatnonzero(wanted.any(axis=1)), np.flatnonzero(wanted.any(axis=0))
            if not len(rows):
                continue
            which, within = which[rows], within[rows]
            if leaf:
                self._offer(best, least, which, own_ids, queries, objects[entries], k)
                continue
            own = objects[entries]
            away = np.sqrt(np.maximum((points[which] ** 2).sum(1)[:, None] - 2 * points[which] @ own.T + (own**2).sum(1), 0))
            floors = np.maximum(away - radii[entries], 0)
            for j, entry in enumerate(entries):
                some = np.flatnonzero(floors[:, j] <= within)
                if len(some):
                    pushed += 1
                    heapq.heappush(heap, (float(floors[some, j].min()), pushed, children[entry], which[some], floors[some, j], away[some, j]))
        return [[(score, -i) for score, i in sorted(b, reverse=True)] for b in best]

    def _offer(self, best: list, least: np.ndarray, which: np.ndarray, own_ids: np.ndarray, queries: np.ndarray, rows: np.ndarray, k: int) -> None:
        """Score these rows for these queries by one matrix product and keep what is good enough."""
        asked, held, ids = queries[which], self.vectors[rows], self.ids[rows]
        scores = asked @ held.T
        most = len(held[0]) * float(np.abs(asked).max()) * self.most
        error = None if most < EXACT else (np.abs(asked) @ np.abs(held).T) * (len(held[0]) + 2) * 2.0**-52
        ahead = scores if error is None else scores + error
        ok = (ahead >= least[which][:, None]) & (ids != own_ids[which][:, None])
        for r in np.flatnonzero(ok.any(axis=1)):
            q, columns = which[r], np.flatnonzero(ok[r])
            heap = best[q]
            if len(columns) > k:  # only what may be among the k best of these
                sure = scores[r, columns] if error is None else scores[r, columns] - error[r, columns]
                columns = columns[ahead[r, columns] >= np.partition(sure, -k)[-k]]
            for c in columns:
                score = int(scores[r, c]) if error is None else sum(int(x) * int(y) for x, y in zip(asked[r], held[c]))
                item = (score, -int(ids[c]))
                if len(heap) < k:
                    heapq.heappush(heap, item)
                elif item > heap[0]:
                    heapq.heapreplace(heap, item)
            if len(heap) == k:
                # Rounded down, so that an equal score is never ruled out.
                least[q] = max(least[q], np.nextafter(float(heap[0][0]), -np.inf) if abs(heap[0][0]) > EXACT else float(heap[0][0]))


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, as doubles; null for a vector that takes no part."""
    whole = F.transform(vector, lambda x: _floor(x.cast("double") * scale))
    fine = F.forall(vector, lambda x: F.coalesce((F.abs(x.cast("double") * scale) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return F.when(vector.isNotNull() & (F.size(vector) > 0) & fine, whole)


def _floor(x: Column) -> Column:
    """Floor as a double; what is beyond 2**53 is whole already, and would not fit a long."""
    return F.when(F.abs(x) < EXACT, F.floor(x).cast("double")).otherwise(x)


def distinct_enough(vectors: DataFrame, k: int) -> DataFrame:
    """Of rows with one vector those with the k + 1 smallest ids, each at most k times."""
    counted = vectors.groupBy("id", "vec").agg(F.least(F.count(F.lit(1)), F.lit(k)).cast("int").alias("copies"))
    order = Window.partitionBy("of", "vec").orderBy("id")
    ranked = counted.withColumn("of", F.xxhash64("vec")).withColumn("n", F.row_number().over(order)).where(F.col("n") <= k + 1)
    return ranked.select(F.explode(F.array_repeat("id", F.col("copies"))).alias("id"), "vec")


class Cells:
    """Pivots by dimension, and the nearest of them; a vector with none of its dimension is in cell -1 round 0."""

    def __init__(self, pivots: list[list[float]]):
        self.pivots: dict[int, np.ndarray] = {}
        for p in sorted({tuple(p) for p in pivots}):
            self.pivots.setdefault(len(p), []).append(p)
        self.pivots = {d: np.array(own) for d, own in self.pivots.items()}

    def center(self, dim: int, cell: int) -> np.ndarray:
        return np.zeros(dim) if cell < 0 else self.pivots[dim][cell]

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cell and distance to its center of each row."""
        own = self.pivots.get(vectors.shape[1])
        if own is None:
            return np.full(len(vectors), -1), np.linalg.norm(vectors, axis=1)
        unit = max(1.0, float(np.abs(vectors).max(initial=0)), float(np.abs(own).max()))
        v, p = vectors / unit, own / unit
        cell = ((p**2).sum(axis=1) - 2 * v @ p.T).argmin(axis=1)
        return cell, np.linalg.norm(v - p[cell], axis=1) * unit


def rows_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) for each length of the lists in a column."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    starts, out = np.cumsum(ends) - ends, []
    for dim in np.unique(ends):
        at = np.flatnonzero(ends == dim)
        out.append((at, flat[starts[at][:, None] + np.arange(dim)]))
    return out


def build_index(vectors: DataFrame, n: int) -> tuple[DataFrame, dict[tuple[int, int], tuple[np.ndarray, float, int]], Cells]:
    """One row a shard (dim, cell, salt, tree); and center, radius and number of shards by (dim, cell)."""
    count = min(MAX_CELLS, max(1, -(-n // SHARD)))
    cells = Cells([r["vec"] for r in vectors.orderBy(F.xxhash64("id", "vec"), "id").limit(count).select("vec").collect()])

    @F.arrow_udf("cell int, away double")
    def place(vecs: pa.Array) -> pa.Array:
        cell, away = np.zeros(len(vecs), dtype=np.int32), np.zeros(len(vecs))
        for at, own in rows_of(vecs):
            cell[at], away[at] = cells.nearest(own)
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(away)], ["cell", "away"])

    placed = vectors.select("id", "vec", F.size("vec").alias("dim"), place("vec").alias("p")).select("id", "vec", "dim", "p.cell", "p.away")
    placed = stored(placed, "placed")
    # A row for each pivot, and for each dimension that has none.
    found = placed.groupBy("dim", "cell").agg(F.max("away").alias("radius"), F.ceil(F.count(F.lit(1)) / SHARD).cast("int").alias("shards")).collect()
    directory = {(r["dim"], r["cell"]): (cells.center(r["dim"], r["cell"]), r["radius"], r["shards"]) for r in found}

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        tree = MTree(rows["id"].to_numpy(np.int64), np.stack(rows["vec"].to_numpy()).astype(np.float64))
        return pd.DataFrame({"dim": [key[0]], "cell": [key[1]], "salt": [key[2]], "tree": [pickle.dumps(tree, protocol=5)]})

    shards = placed.sparkSession.createDataFrame([(d, c, s) for (d, c), (_, _, s) in directory.items()], "dim int, cell int, shards int")
    dealt = placed.join(F.broadcast(shards), ["dim", "cell"]).withColumn("salt", F.pmod(F.xxhash64("id", "vec"), F.col("shards")).cast("int"))
    trees = dealt.select(*KEY, "id", "vec").groupBy(*KEY).applyInPandas(build, "dim int, cell int, salt int, tree binary")
    return stored(trees, "trees"), directory, cells


def search(index: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """(query_id, mark, vec_id, score): up to k answers of each shard for each query that ``asked`` sends there."""
    total = asked.groupBy(*KEY).agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = asked.join(total, KEY).withColumn("block", F.pmod(F.xxhash64("id", "mark"), F.col("blocks"))).drop("blocks")
    trees = index.join(total.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))), KEY)

    def run(tree: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        if not len(tree) or not len(rows):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("query_id", "mark", "vec_id", "score")})
        ids = rows["id"].to_numpy(np.int64)
        found = pickle.loads(tree["tree"].iloc[0]).search(ids, np.stack(rows["vec"].to_numpy()), k, rows["least"].to_numpy(float))
        flat = [(q, m, i, max(-LARGEST - 1, min(LARGEST, score))) for q, m, own in zip(ids, rows["mark"], found) for score, i in own]
        return pd.DataFrame(flat, columns=["query_id", "mark", "vec_id", "score"], dtype="int64")

    by = [*KEY, "block"]
    return trees.groupBy(*by).cogroup(dealt.groupBy(*by)).applyInPandas(run, "query_id long, mark long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score); both inputs have ``id`` and ``vec``, doubles that hold whole numbers."""
    index, directory, cells = build_index(distinct_enough(vectors, k), vectors.count())
    dims: dict[int, list[int]] = {}
    for dim, cell in sorted(directory):
        dims.setdefault(dim, []).append(cell)

    @F.arrow_udf("array<int>")
    def home(vecs: pa.Array) -> pa.Array:
        out: list[list[int]] = [[]] * len(vecs)
        for at, own in rows_of(vecs):
            for i, cell in zip(at, cells.nearest(own)[0]):
                out[i] = [int(cell)] if (own.shape[1], int(cell)) in directory else []
        return pa.array(out, pa.list_(pa.int32()))

    @F.arrow_udf("array<int>")
    def others(vecs: pa.Array, least: pa.Array, been: pa.Array) -> pa.Array:
        """Cells that may hold a score of at least ``least``: q.c + |q| r bounds q.x over a ball."""
        out: list[list[int]] = [[]] * len(vecs)
        floor, seen = least.to_numpy(zero_copy_only=False), been.to_pylist()
        for at, own in rows_of(vecs):
            known = dims.get(own.shape[1], [])
            if known:
                centers = np.array([directory[own.shape[1], c][0] for c in known])
                radii = np.array([directory[own.shape[1], c][1] for c in known])
                norms = np.linalg.norm(own, axis=1)[:, None]
                bound = own @ centers.T + norms * (radii + 1e-9 * (np.linalg.norm(centers, axis=1) + radii)) + 1
                for i, row in zip(at, bound >= floor[at][:, None]):
                    out[i] = [c for c, good in zip(known, row) if good and c not in seen[i]]
        return pa.array(out, pa.list_(pa.int32()))

    spark = queries.sparkSession
    shards = F.broadcast(spark.createDataFrame([(d, c, s) for (d, c), (_, _, s) in directory.items()], "dim int, cell int, shards int"))

    def sent(rows: DataFrame, to: str) -> DataFrame:
        """A row for each shard of each cell."""
        rows = rows.select("id", "mark", "vec", "least", F.size("vec").alias("dim"), F.explode(to).alias("cell")).join(shards, ["dim", "cell"])
        return rows.select("id", "mark", "vec", "least", "dim", "cell", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("salt"))

    asked = stored(queries.select("id", "vec", F.xxhash64("vec").alias("mark")).withColumn("home", home("vec")), "queries")
    first = stored(search(index, sent(asked.withColumn("least", F.lit(-np.inf)), "home"), k), "first")
    order = Window.partitionBy("query_id", "mark").orderBy(F.desc("score"), "vec_id")
    kth = first.withColumn("n", F.row_number().over(order)).where(F.col("n") == k)
    kth = kth.select(F.col("query_id").alias("id"), "mark", F.col("score").cast("double").alias("least"))
    rest = asked.join(kth, ["id", "mark"], "left").withColumn("least", F.coalesce("least", F.lit(-np.inf)))
    second = search(index, sent(rest.withColumn("others", others("vec", "least", "home")), "others"), k)
    ranked = first.unionByName(second).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), whole_numbers(F.col("embedding")).alias("vec"))
    vectors = rows.where("id IS NOT NULL AND vec IS NOT NULL")
    return top_k(vectors, vectors.where(F.pmod("id", F.lit(50)) == 0).distinct(), 5)


OP2_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS vec
  FROM embeddings
  WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_inner_product(q.vec::DOUBLE[], c.vec::DOUBLE[]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""
