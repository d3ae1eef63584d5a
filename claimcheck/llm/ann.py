"""Approximate nearest neighbours by balanced posting lists.

Vectors are normalised, so that the nearest by distance are the nearest by cosine. Centroids, as many as a
list length asks for, are fitted on a bounded sample by splitting it again and again into clusters of even
size. Every vector of the table is listed under its nearest centroid, and near a border under further ones
that are nearly as near and lie in other directions, so that it is found from both sides. Centroids are
searched by a graph of their neighbours, held in memory. A query reads the lists whose centroids are within
a ratio of its distance to the nearest one; both ratios are measured on the sample.

Equal vectors are one point with its smallest keys, so that a vector that a third of all rows share is
listed once, and searched once however many queries ask for it. A long list, or one of many queries, is
dealt over a grid of blocks of both.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from claimcheck.llm.shared import saved

#: Points of a list before replication, on average, and lists at most: their graph is held by every worker.
LIST_ROWS, MOST_LISTS = 50, 8_192
#: Rows of the sample that centroids and ratios are fitted on: so many, or so many a list, by hash.
SAMPLE_ROWS, SAMPLE_PER_LIST = 20_000, 20
#: Lists that a vector is in at most, and the bound of the ratio within which further ones are taken.
REPLICAS, MOST_CLOSURE = 4, 1.3
#: Recall wanted of the queries that the ratio is measured with, and how many these are.
RECALL, MEASURED = 0.93, 300
#: Postings and queries of a block on average.
BLOCK_ROWS, BLOCK_QUERIES = 8_000, 2_000
GRAPH_DEGREE, BEAM, LISTING_BEAM = 16, 64, 24
#: Lists that a query reads at least.
LEAST_LISTS = 4


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not null, not zero, and no component null or not finite."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = scaled(vectors)
    return vectors / np.linalg.norm(vectors, axis=1, keepdims=True)


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Vectors times powers of two, which changes no cosine and keeps squares within range."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def matrix(column) -> np.ndarray:
    """Rows of a list column (arrays of one length) as doubles."""
    return np.stack([np.asarray(x, dtype=np.float64) for x in column]) if len(column) else np.empty((0, 1))


def balanced_centroids(sample: np.ndarray, clusters: int, seed: int = 5) -> np.ndarray:
    """Directions of the centres of ``clusters`` groups of even size: each split cuts at the median between two centres."""
    draw = np.random.default_rng(seed)
    waiting, done = [(np.arange(len(sample)), clusters)], []
    while waiting:
        rows, parts = waiting.pop()
        if parts <= 1 or len(rows) < 2:
            done.append(sample[rows].mean(axis=0))
            continue
        centres = sample[draw.choice(rows, 2, replace=False)]
        left = parts // 2
        cut = len(rows) * left // parts
        order = np.arange(len(rows))
        for _ in range(8):
            nearer = sample[rows] @ (centres[1] - centres[0])
            order = np.argsort(nearer, kind="stable")
            centres = np.stack([sample[rows[order[:cut]]].mean(axis=0), sample[rows[order[cut:]]].mean(axis=0)])
        waiting += [(rows[order[:cut]], left), (rows[order[cut:]], parts - left)]
    found = np.stack(done)
    size = np.linalg.norm(found, axis=1, keepdims=True)
    # Lists are compared by angle: short centres, those of wide clusters, would be near to each other and to nothing else.
    found = np.round(np.divide(found, size, out=sample[: len(found)].copy(), where=size > 1e-9), 12)
    return found[np.sort(np.unique(found, axis=0, return_index=True)[1])]  # in the order of the splits, so that neighbours stand together


@dataclass
class Graph:
    """Centroids with their nearest others; every centroid is reachable because a ring joins all."""

    centres: np.ndarray
    near: np.ndarray
    closure: float = 1.0  # further lists of a vector: their distance to the nearest one's at most

    @classmethod
    def of(cls, centres: np.ndarray, degree: int = GRAPH_DEGREE) -> Graph:
        count = len(centres)
        near = np.empty((count, min(degree, max(count - 1, 1)) + 1), dtype=np.int64)
        for i in range(count):
            distance = -2 * (centres @ centres[i]) + (centres * centres).sum(axis=1)
            order = np.argsort(distance, kind="stable")
            order = order[order != i][: near.shape[1] - 1] if count > 1 else order
            near[i] = [*order, *[i] * (near.shape[1] - 1 - len(order)), (i + 1) % count]
        return cls(centres, near)

    def search(self, vectors: np.ndarray, ratio: float, beam: int = BEAM, least: int = 1) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each vector the centroids within ``ratio`` of its distance to the nearest one found, nearest first.

        They are ``least`` at least, as far as there are so many.

        A walk, of many vectors at a time, from the nearest of a few centroids expands the nearest centroid not
        expanded yet, until it has expanded ``beam`` and all that are within the ratio: what is left to expand
        is farther then.
        """
        found, count = [], len(self.centres)
        squares = (self.centres * self.centres).sum(axis=1)
        entries = np.unique(np.linspace(0, count - 1, min(count, 32)).astype(np.int64))
        for start in range(0, len(vectors), 256):
            some = vectors[start : start + 256]
            each, own = np.arange(len(some)), (some * some).sum(axis=1)
            distance = np.full((len(some), count), np.inf)
            distance[:, entries] = np.maximum(own[:, None] + squares[entries] - 2 * some @ self.centres[entries].T, 0)
            waiting = distance.copy()  # infinite where unknown or expanded
            nearest = distance.min(axis=1)
            for step in range(count):
                at = waiting.argmin(axis=1)
                value = waiting[each, at]
                going = np.flatnonzero(np.isfinite(value) & ((step < beam) | (value <= ratio**2 * nearest)))
                if not len(going):
                    break
                waiting[each, at] = np.inf
                others = self.near[at[going]]
                far = np.maximum(own[going, None] + squares[others] - 2 * np.einsum("ijk,ik->ij", self.centres[others], some[going]), 0)
                new = np.isinf(distance[going[:, None], others])
                row, column = going[np.nonzero(new)[0]], others[new]
                distance[row, column] = waiting[row, column] = far[new]
                np.minimum.at(nearest, row, far[new])
            for i in each:
                known = np.flatnonzero(np.isfinite(distance[i]))
                order = known[np.argsort(distance[i, known], kind="stable")]
                within = order[: max(least, np.searchsorted(distance[i, order], ratio**2 * distance[i, order[0]], side="right"))]
                found.append((within, np.sqrt(distance[i, within])))
        return found

    def lists_of(self, vectors: np.ndarray) -> list[list[int]]:
        """The lists that hold each vector: its nearest, and others within the closure that no chosen one is nearer to than the vector."""
        chosen = []
        for found, distances in self.search(vectors, self.closure, beam=LISTING_BEAM):
            own = [int(found[0])]
            for centre, distance in zip(found[1:].tolist(), distances[1:].tolist()):
                if len(own) == REPLICAS:
                    break
                if (((self.centres[own] - self.centres[centre]) ** 2).sum(axis=1) > distance**2).all():
                    own.append(centre)
            chosen.append(own)
        return chosen


def wanted_closure(graph: Graph, sample: np.ndarray, vectors: int = 2_000) -> float:
    """The ratio within which half of the sample's vectors have as many lists as ``REPLICAS``, and ``MOST_CLOSURE`` at most."""
    some = sample[:: max(1, len(sample) // vectors)]
    ratios = [d[min(REPLICAS, len(d)) - 1] / max(d[0], 1e-12) for _, d in graph.search(some, 1.0, beam=LISTING_BEAM, least=REPLICAS)]
    return min(MOST_CLOSURE, float(np.median(ratios)) * 1.001)


def wanted_ratio(graph: Graph, vectors: DataFrame, asked: np.ndarray, top: int, recall: float = RECALL) -> float:
    """The least ratio at which the lists read hold ``recall`` of the true neighbours of ``asked`` among all ``vectors``.

    The neighbours come from an exact search of these few queries over all rows, of which each task keeps the best.
    """
    most = top + 1  # a query may find itself

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores, held = np.empty((len(asked), 0)), np.empty((len(asked), 0, asked.shape[1]))
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                rows = unit(matrix(batch.column(0).slice(at, 2_000).to_numpy(zero_copy_only=False)))
                now = asked @ rows.T
                order = np.argpartition(-now, min(most, len(rows)) - 1, axis=1)[:, :most]
                scores, held = np.concatenate([scores, np.take_along_axis(now, order, axis=1)], axis=1), np.concatenate([held, rows[order]], axis=1)
                order = np.argsort(-scores, axis=1, kind="stable")[:, :most]
                scores, held = np.take_along_axis(scores, order, axis=1), np.take_along_axis(held, order[:, :, None], axis=1)
        if scores.size:
            query = np.repeat(np.arange(len(asked), dtype=np.int32), scores.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(scores.ravel()), pa.array(list(held.reshape(-1, asked.shape[1])), pa.list_(pa.float64()))], names=["query", "score", "vector"])

    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vector"))
    found = vectors.mapInArrow(best, "query int, score double, vector array<double>").withColumn("place", place).where(F.col("place") <= most).drop("place").toPandas()
    found = found[found["score"] < 1 - 1e-12].sort_values(["query", "score"], ascending=[True, False]).groupby("query").head(top)
    if not len(found):
        return 1.0
    distance = np.sqrt(np.maximum(2 - 2 * asked @ graph.centres.T, 0))
    lists = graph.lists_of(matrix(found["vector"]))
    needed = [distance[q][own].min() / max(distance[q].min(), 1e-12) for q, own in zip(found["query"], lists)]
    return float(np.quantile(needed, recall, method="higher")) * 1.001


def fit(vectors: DataFrame, count: int, top: int = 5) -> tuple[Graph, float]:
    """Centroid graph and list ratio for the ``count`` rows (vector), from a sample chosen by hash.

    The sample has about ``SAMPLE_ROWS`` rows, or ``SAMPLE_PER_LIST`` for each of ``MOST_LISTS`` lists at most.
    """
    lists = max(1, min(MOST_LISTS, count // LIST_ROWS))
    rows, scale = max(SAMPLE_ROWS, SAMPLE_PER_LIST * lists), 1 << 30
    sample = vectors if count <= rows else vectors.where(F.pmod(F.xxhash64("vector"), F.lit(scale)) < rows * scale // count)
    points = unit(matrix(sample.select("vector").toPandas()["vector"]))
    points = points[np.lexsort(points.T)]  # in an order of their own
    graph = Graph.of(balanced_centroids(points, lists))
    graph.closure = wanted_closure(graph, points)
    return graph, wanted_ratio(graph, vectors, points[:: max(1, -(-len(points) // MEASURED))], top)


def nearest(table: DataFrame, top: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``top`` nearest rows found for each row whose key ``every`` divides.

    Nearness is the cosine in double precision of the original vectors; ties go to the smaller key. A query
    doesn't find its own key. Vectors that are null, empty, zero or hold a null or non-finite component take
    no part, and neither do rows with a null key. Vectors of different lengths have no cosine: each length is
    searched for itself. Rows that repeat a key and its vector count once. A key with several vectors is as
    near as its nearest one, and as a query asks with each. Fewer candidates than ``top`` give fewer rows, an
    empty table gives none. Extra columns don't matter.
    """
    spark = table.sparkSession
    vectors = table.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector")).where(F.col("id").isNotNull() & usable(F.col("vector")))
    # Of a point's keys, more than `top` + 1 can't be needed: the smallest ones are the nearest, but for the query's own.
    place = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    points = vectors.distinct().withColumn("place", place).where(F.col("place") <= top + 1)
    points = points.groupBy("vector").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("node", F.monotonically_increasing_id())
    points = saved(points, "points")
    asked = vectors.where(F.col("id") % every == 0).distinct()
    asked = saved(asked.join(points, "vector").select(F.col("id").alias("query_id"), F.col("node").alias("asked")), "asked")
    found = None
    for row in points.groupBy(F.size("vector").alias("n")).count().collect():  # one row for each length of a vector
        some = _found(points.where(F.size("vector") == row.n), row["count"], asked, top)
        found = some if found is None else found.union(some)
    if found is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = asked.join(found, "asked").withColumn("vec_id", F.explode("ids")).where("vec_id <> query_id")
    rows = rows.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return rows.withColumn("rank", rank).where(F.col("rank") <= top).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def postings_of(points: DataFrame, graph: Graph) -> DataFrame:
    """(list, node, vector): each of the ``points`` in all its lists."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = graph.lists_of(unit(matrix(batch.column(1).to_numpy(zero_copy_only=False))))
                row = pa.array(np.repeat(np.arange(batch.num_rows), [len(x) for x in lists]))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists).astype(np.int32)), *[c.take(row) for c in batch.columns]], names=["list", "node", "vector"])

    return points.select("node", "vector").mapInArrow(deal, "list int, node long, vector array<double>")


def probes_of(points: DataFrame, asked: DataFrame, graph: Graph, ratio: float, block_of: np.ndarray) -> DataFrame:
    """(block, node, vector, lists): each of the asked points once for each block with lists that it reads."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows, blocks, lists = [], [], []
            for row, (found, _) in enumerate(graph.search(unit(matrix(batch.column(1).to_numpy(zero_copy_only=False))), ratio, least=LEAST_LISTS)):
                found = np.sort(found)  # blocks are runs of lists
                own, begins = np.unique(block_of[found], return_index=True)
                rows += [row] * len(own)
                blocks += own.tolist()
                lists += np.split(found, begins[1:])
            row = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int32()), *[c.take(row) for c in batch.columns], pa.array(lists, pa.list_(pa.int32()))], names=["block", "node", "vector", "lists"])

    asking = points.select("node", "vector").join(asked.select(F.col("asked").alias("node")).distinct(), "node", "left_semi")
    return asking.mapInArrow(deal, "block int, node long, vector array<double>, lists array<int>")


def _found(points: DataFrame, count: int, asked: DataFrame, top: int) -> DataFrame:
    """(asked, ids, score): for each asked node the nearest points found, more than ``top`` of them."""
    spark = points.sparkSession
    graph, ratio = fit(points.select("vector"), count, top)
    postings = saved(postings_of(points, graph), "postings")
    sizes = np.zeros(len(graph.centres), dtype=np.int64)
    for row in postings.groupBy("list").count().collect():  # one row a list, `MOST_LISTS` at most
        sizes[row["list"]] = row["count"]
    # Neighbouring lists make a block; one that is longer than a block is dealt over several rows of blocks.
    block_of = ((np.cumsum(sizes) - sizes) // BLOCK_ROWS).astype(np.int32)
    probes = saved(probes_of(points, asked, graph, ratio, block_of), "probes")
    rows_of = np.maximum(1, np.bincount(block_of, weights=sizes) // BLOCK_ROWS).astype(int)
    lists = spark.createDataFrame([(i, int(b), int(rows_of[b])) for i, b in enumerate(block_of)], "list int, block int, rows int")
    columns = probes.groupBy("block").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("columns"))
    grid = F.broadcast(saved(lists.join(columns, "block"), "grid"))  # one row a list
    own = lambda side: F.pmod(F.xxhash64("node"), F.col(side)).cast("int")
    every = lambda side: F.explode(F.sequence(F.lit(0), F.col(side) - 1))
    postings = postings.join(grid, "list").withColumn("row", own("rows")).withColumn("column", every("columns")).drop("rows", "columns")
    sides = F.broadcast(grid.select("block", "rows", "columns").distinct())
    probes = probes.join(sides, "block").withColumn("column", own("columns")).withColumn("row", every("rows")).drop("rows", "columns")
    most = 2 * top + 2  # distinct vectors, one of which may be the query's own

    def compare(queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        parts = []
        if len(queries) and len(rows):
            nodes, first, place = np.unique(rows["node"].to_numpy(), return_index=True, return_inverse=True)
            names, listed = np.unique(rows["list"].to_numpy(), return_inverse=True)
            holds = np.zeros((len(names), len(nodes)), dtype=np.float32)
            holds[listed, place] = 1
            given = scaled(matrix(rows["vector"].iloc[first]))
            size = np.sqrt(np.einsum("ij,ij->i", given, given))
            for at in range(0, len(queries), 256):
                some = queries.iloc[at : at + 256]
                reads = np.stack([np.isin(names, x) for x in some["lists"]]).astype(np.float32)
                vectors = scaled(matrix(some["vector"]))
                length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
                scores = np.where(reads @ holds > 0, (vectors @ given.T) / size, -np.inf)
                best = np.argpartition(-scores, min(most, len(nodes)) - 1, axis=1)[:, :most]
                row, found = np.nonzero(np.isfinite(np.take_along_axis(scores, best, axis=1)))
                best = best[row, found]
                score = np.einsum("ij,ij->i", vectors[row], given[best]) / (length[row] * size[best])  # a pair's own, whatever stands beside it
                parts.append(pd.DataFrame({"asked": some["node"].to_numpy()[row], "node": nodes[best], "score": score}))
        return pd.concat(parts) if parts else pd.DataFrame({"asked": [], "node": [], "score": []})

    found = probes.groupBy("block", "row", "column").cogroup(postings.groupBy("block", "row", "column")).applyInPandas(compare, "asked long, node long, score double")
    found = found.groupBy("asked", "node").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "node"))
    found = found.withColumn("rank", rank).where(F.col("rank") <= most).select("asked", "node", "score")
    return found.join(points.select("node", "ids"), "node").select("asked", "ids", "score")
