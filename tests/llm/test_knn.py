import numpy as np

from tidemark.llm import knn
from tidemark.llm.knn import nearest_neighbours, neighbour_pairs

SCHEMA = "id long, embedding array<float>, cell int, key string"


def table(spark, rows):
    return spark.createDataFrame([(i, None if e is None else [None if x is None else float(x) for x in e], 1, "x") for i, e in rows], SCHEMA)


def exact(ids, x, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    return {int(ids[i]): {int(ids[j]) for j in np.argsort(-s[i])[:k]} for i in range(len(ids))}


def data(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((40, 64))
    return (centres[rng.integers(0, 40, n)] + 0.3 * rng.standard_normal((n, 64))) * rng.uniform(0.1, 30, (n, 1))


def recall(got, want):
    return np.mean([len(got.get(k, set()) & v) / len(v) for k, v in want.items()])


def collect(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.id, set()).add(r.neighbour)
    return out


def test_recall_and_hot_lists(spark, monkeypatch):
    x = data()
    rows = [(i, v) for i, v in enumerate(x)]
    want = exact(np.arange(len(x)), x, 10)
    got = collect(nearest_neighbours(table(spark, rows), rows_per_list=200))
    assert recall(got, want) >= 0.9 and all(len(v) == 10 for v in got.values())
    # every list cut into shards of members and queries gives the same
    monkeypatch.setattr(knn, "MEMBERS_PER_SHARD", 60)
    monkeypatch.setattr(knn, "QUERIES_PER_SHARD", 150)
    cut = collect(nearest_neighbours(table(spark, rows), rows_per_list=200))
    assert recall(cut, want) >= 0.9 and all(len(v) == 10 for v in cut.values())


def test_unusable_repeated_and_copied(spark):
    x = data(60, 3)
    rows = [(i, v) for i, v in enumerate(x)] + [(0, x[0]), (100, None), (101, []), (102, x[0][:32]), (103, [0.0] * 64), (104, [float("nan")] * 64), (105, [None] * 64), (None, x[1])]
    got = collect(nearest_neighbours(table(spark, rows)))
    assert set(got) == set(range(60)) and recall(got, exact(np.arange(60), x, 10)) >= 0.9
    copies = [(i, v) for i, v in enumerate(x)] + [(1000 + i, x[0]) for i in range(25)]
    got = collect(nearest_neighbours(table(spark, copies)))
    assert len(got) == 85 and all(len(v) == 10 for v in got.values())
    assert got[1003] <= {0, *range(1000, 1025)} and 1003 not in got[1003]


def test_small_tables(spark):
    x = data(3, 1)
    assert nearest_neighbours(table(spark, [])).count() == 0
    assert nearest_neighbours(table(spark, [(1, x[0])])).count() == 0
    two = neighbour_pairs(nearest_neighbours(table(spark, [(1, x[0]), (2, x[1])])))
    assert [tuple(r) for r in two.collect()] == [(1, 2)]


def test_two_levels_of_centroids(spark, monkeypatch):
    monkeypatch.setattr(knn, "FLAT_LISTS", 16)
    monkeypatch.setattr(knn, "LISTS_PER_CELL", 8)
    x = data(3000, 5)
    got = collect(nearest_neighbours(table(spark, [(i, v) for i, v in enumerate(x)]), rows_per_list=60))
    assert recall(got, exact(np.arange(len(x)), x, 10)) >= 0.9 and all(len(v) == 10 for v in got.values())
