import numpy as np
import pytest

from claimcheck.llm import ann


@pytest.mark.parametrize("seed", range(2))
def test_keys_with_several_vectors(spark, seed):
    """Every vector of a key counts, in whatever order the rows come."""
    rows = [(0, [1.0, 0.0, 0.0]), (50, [0.0, 1.0, 0.0]), (50, [0.0, 0.0, 1.0])]
    rows += [(7, [1.0, 0.01 * i, 0.0]) for i in range(6)] + [(7, [0.0, 0.0, 1.0])]
    rows += [(i, [1.0, 0.1 * i, 0.05 * i * i]) for i in range(10, 18)] + [(17, [0.1, 1.0, 0.1])] * 2
    np.random.default_rng(seed).shuffle(given := [(k, tuple(v)) for k, v in rows])
    df = spark.createDataFrame([(int(k), [float(x) for x in v]) for k, v in given], "vec_id long, embedding array<double>")
    found = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, pytest.approx(r.score, abs=1e-12)))
    cosine = lambda a, b: np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)
    for q in (0, 50):
        best = {k: max(cosine(a, b) for j, a in rows if j == q for i, b in rows if i == k) for k in {k for k, _ in rows} - {q}}
        assert [(k, best[k]) for k in sorted(best, key=lambda k: (-round(best[k], 12), k))[:5]] == found[q]
