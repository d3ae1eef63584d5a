import numpy as np
import pytest
from pyspark.sql import functions as F

from claimcheck.llm import ann, queries


def exact(rows, every, top):
    ids, points = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    found = {}
    for i in np.flatnonzero(ids % every == 0):
        scores = unit @ unit[i]
        order = [j for j in np.lexsort((ids, -np.round(scores, 12))) if ids[j] != ids[i]][:top]
        found[int(ids[i])] = [(int(ids[j]), scores[j]) for j in order]
    return found


def test_recall_of_the_query(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    want, got = exact(rows, 50, 5), {}
    for r in queries.op2_ann(spark, folder).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert np.mean([len({i for i, _ in got[q]} & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9
    points = dict(rows)
    for q, found in got.items():
        assert [s for _, s in found] == sorted((s for _, s in found), reverse=True)
        for i, s in found:
            a, b = np.array(points[q], dtype=float), np.array(points[i], dtype=float)
            assert s == pytest.approx(a @ b / np.linalg.norm(a) / np.linalg.norm(b), abs=1e-12)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 1e300]), (4, [0.0, 0.0]), (5, None), (6, [1.0, None]), (7, [float("nan"), 1.0]), (8, [float("inf"), 1.0]), (9, [1.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (50, [-1.0, 1e-300])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("list", F.lit(1))
    found = [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in ann.nearest(df).orderBy("query_id", "rank").collect()]
    assert found == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, 0.0), (0, 4, 50, -1.0), (50, 1, 3, 0.0), (50, 2, 0, -1.0), (50, 3, 1, -1.0), (50, 4, 2, -1.0)]
    assert ann.nearest(df.where("false")).isEmpty() and ann.nearest(df.where("vec_id = 4")).isEmpty()


def test_one_vector_that_a_third_of_the_rows_share(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 100)
    monkeypatch.setattr(ann, "BLOCK_QUERIES", 7)
    draw = np.random.default_rng(3)
    rows = [(i, [1.0, 2.0, 3.0, 4.0] if i % 3 == 0 else draw.normal(size=4).tolist()) for i in range(1500)]
    found = {}
    for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found[0] == [3, 6, 9, 12, 15] and found[150] == [0, 3, 6, 9, 12] and len(found) == 30


def test_balanced_centroids_and_graph():
    draw = np.random.default_rng(1)
    points = ann.unit(draw.normal(size=(2000, 8)))
    centres = ann.balanced_centroids(points, 40)
    assert len(centres) == 40
    graph = ann.Graph.of(centres)
    for (found, distances), p in zip(graph.search(points[:50], 1.3), points):
        true = np.sqrt(((centres - p) ** 2).sum(axis=1))
        assert distances[0] == pytest.approx(true.min()) and set(found) == set(np.flatnonzero(true <= 1.3 * true.min()))
    assert all(1 <= len(x) <= ann.REPLICAS for x in graph.lists_of(points[:50]))


@pytest.mark.parametrize("kind", ["spread", "clustered"])
def test_replication_and_pruning_at_20_000_vectors(spark, kind):
    """Vectors are in several lists, queries read under a quarter of them and find 0.9 of all rows' nearest."""
    draw = np.random.default_rng(4)
    points = draw.normal(size=(20_000, 32))
    if kind == "clustered":
        points = points / 2 + draw.normal(size=(200, 32))[draw.integers(0, 200, 20_000)]
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(points)], "vec_id long, embedding array<double>").repartition(8)
    vectors = df.select(F.col("vec_id").alias("node"), F.col("embedding").alias("vector")).cache()
    graph, ratio = ann.fit(vectors.select("vector"), len(points))
    asked = vectors.where("node % 50 = 0").select(F.col("node").alias("asked"))
    postings = ann.postings_of(vectors, graph)
    probes = ann.probes_of(vectors, asked, graph, ratio, np.arange(400, dtype=np.int32) // 20)
    assert len(graph.centres) == 400
    assert postings.count() / len(points) > (1.2 if kind == "spread" else 1.05) and probes.agg(F.sum(F.size("lists"))).first()[0] / 400 < 0.25 * len(graph.centres)
    assert postings.select("node").distinct().count() == len(points)
    want, got = exact([(i, x) for i, x in enumerate(points)], 50, 5), {}
    for r in ann.nearest(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert np.mean([len(got[q] & {i for i, _ in want[q]}) / 5 for q in want]) >= 0.9
