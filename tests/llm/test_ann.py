import numpy as np
import pandas as pd
import pytest

from kinelake.llm import ann


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall(spark, sf):
    t = pd.read_parquet(f"/root/testdata/{sf}/embeddings.parquet")
    names, x = t.vec_id.to_numpy(), np.stack(t.embedding).astype(float)
    got = ann.op9_ann(spark, f"/root/testdata/{sf}").toPandas().sort_values(["query_id", "rank"])
    asked = names[names % 20 == 0]
    assert sorted(got.query_id.unique()) == sorted(asked) and (got.groupby("query_id").size() == 20).all()
    hits = 0
    for q, g in got.groupby("query_id"):
        i = int(np.flatnonzero(names == q)[0])
        assert g["rank"].tolist() == list(range(1, 21)) and q not in set(g.vec_id)
        assert np.allclose(g.score, x[[int(np.flatnonzero(names == v)[0]) for v in g.vec_id]] @ x[i]) and (np.diff(g.score) <= 0).all()
        hits += len(set(g.vec_id) & set(ann.brute_force(names, x, q, x[i], 20)))
    assert hits / (20 * len(asked)) >= 0.9


def test_odd_rows(spark):
    inf = float("inf")
    rows = [(0, [1.0, 0.0], "x", 1), (1, [2.0, 0.0], "x", 1), (2, [2.0, 0.0], "x", 1), (3, [0.0, 0.0], "x", 1), (4, None, "x", 1), (5, [1.0, None], "x", 1), (6, [inf, 1.0], "x", 1), (7, [float("nan"), 1.0], "x", 1), (8, [1.0, 0.0, 0.0], "x", 1), (20, [0.0, 0.0], "x", 1), (40, [-1.0, 0.5], "x", 1), (None, [2.0, 0.0], "x", 1), (2, [2.0, 0.0], "x", 1)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<float>, block string, rank int")
    got = [tuple(r) for r in ann.nearest(t, t.filter("vec_id % 20 = 0"), 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 2, 2.0), (40, 1, 0, -1.0), (40, 2, 1, -2.0), (40, 3, 2, -2.0)]
    assert ann.nearest(t.limit(0), t.limit(0), 3).count() == 0
