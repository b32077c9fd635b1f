import numpy as np
import pytest

from tessera.llm import vectors as V


def exact(ids, vectors, q, k=20):
    scores = [(-float((vectors[i] * vectors[q]).sum()), int(ids[i])) for i in range(len(ids)) if ids[i] != ids[q]]
    return sorted(scores)[:k]


def frame(spark, ids, vectors, more=()):
    rows = [(int(i), [float(x) for x in v], 0) for i, v in zip(ids, vectors)]
    return spark.createDataFrame([*rows, *more], "vec_id long, embedding array<double>, label int")


def test_factor_one_is_exact(spark):
    r = np.random.default_rng(1)
    ids, x = np.arange(900), r.normal(size=(900, 8)) * r.uniform(0.1, 3, (900, 1))
    x[100:400] = x[100]  # copies
    x[500:520] = x[40]
    rows = frame(spark, ids, x, [(-1, None, 0), (-2, [0.0] * 8, 0), (-3, [float("nan")] * 8, 0), (-20, [None] * 8, 0), (-40, [float("inf")] + [1.0] * 7, 0)])
    got = {}
    for a in V.nearest(rows, rows.filter("vec_id % 20 = 0"), factor=1.0, shard_rows=200).collect():
        got.setdefault(a.query_id, {})[a.rank] = (-a.score, a.vec_id)
    assert set(got) == set(range(0, 900, 20))
    for q, found in got.items():
        want = exact(ids, x, q)
        assert [v for _, (_, v) in sorted(found.items())] == [v for _, v in want]
        assert np.allclose([s for _, (s, _) in sorted(found.items())], [s for s, _ in want], rtol=1e-12)


def test_recall(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(10, 32))[r.integers(0, 10, 3000)] + r.normal(size=(3000, 32))
    rows = frame(spark, np.arange(3000), x)
    got = {}
    for a in V.nearest(rows, rows.filter("vec_id % 20 = 0")).collect():
        got.setdefault(a.query_id, set()).add(a.vec_id)
    hit = [len(got[q] & {v for _, v in exact(np.arange(3000), x, q)}) / 20 for q in got]
    assert len(got) == 150 and np.mean(hit) >= 0.9


@pytest.mark.parametrize("long", [10, 20, 100])
def test_recall_with_one_long_vector(spark, long):
    r = np.random.default_rng(4)
    x = r.normal(size=(10, 64))[r.integers(0, 10, 3000)] + r.normal(size=(3000, 64))
    x /= np.sqrt((x**2).sum(axis=1))[:, None]
    x[7] *= long
    rows = frame(spark, np.arange(3000), x)
    got = {}
    for a in V.nearest(rows, rows.filter("vec_id % 20 = 0"), shard_rows=3000).collect():
        got.setdefault(a.query_id, set()).add(a.vec_id)
    hit = [len(got[q] & {v for _, v in exact(np.arange(3000), x, q)}) / 20 for q in got]
    assert len(got) == 150 and np.mean(hit) >= 0.9


def test_few_candidates_and_empty_tables(spark):
    rows = frame(spark, [0, 1, 2], np.eye(3))
    got = V.nearest(rows, rows.filter("vec_id = 0")).collect()
    assert [(a.rank, a.vec_id, a.score) for a in sorted(got, key=lambda a: a.rank)] == [(1, 1, 0.0), (2, 2, 0.0)]
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert V.nearest(none, none).count() == 0


def test_vectors_of_other_lengths(spark):
    rows = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (20, [1.0]), (2, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    assert [(a.query_id, a.vec_id, a.score) for a in V.nearest(rows, rows.filter("vec_id % 20 = 0")).collect()] == [(0, 1, 3.0)]


def test_rows_that_repeat_the_querys_id(spark):
    """Many rows of the query's own id have the vector of other ids, which are its nearest."""
    r = np.random.default_rng(6)
    x = r.normal(size=(80, 6))
    near = x[0] * 2
    more = [(0, [float(v) for v in near], 0)] * 30 + [(k, [float(v) for v in near], 0) for k in range(100, 130)] + [(200, [float(v) for v in near], 0)] * 40
    rows = frame(spark, np.arange(80), x, more)
    got = V.nearest(rows, frame(spark, [0], x[:1]), shard_rows=1000).collect()
    assert [a.vec_id for a in sorted(got, key=lambda a: a.rank)] == list(range(100, 120))
    # of an id that repeats, each row is a candidate
    got = V.nearest(frame(spark, [], [], more[60:] + [(1, [1.0] * 6, 0)]), frame(spark, [1], [[float(v) for v in near]]), k=50).collect()
    assert [a.vec_id for a in got] == [200] * 40


def test_clashing_columns(spark):
    rows = frame(spark, np.arange(40), np.random.default_rng(8).normal(size=(40, 4))).selectExpr("*", "1 AS s", "2 AS cell", "'x' AS tree", "0 AS rank", "0.5D AS score", "3 AS b")
    got = V.nearest(rows, rows.filter("vec_id % 20 = 0")).collect()
    assert len(got) == 40 and {a.query_id for a in got} == {0, 20}
