"""Hash index of wide vectors against all pairs."""

import numpy as np
import pytest

from loomwork.operators import vector_index as vi


def points(spark, x, first=0):
    return spark.createDataFrame([(first + i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, x array<double>").repartition(3)


def exact(x, queries, k):
    out = {}
    for i in queries:
        d = ((x - x[i]) ** 2).sum(axis=1)
        out[i] = [j for j in np.lexsort((np.arange(len(x)), d.round(12))) if j != i][:k]
    return out


@pytest.fixture(scope="module")
def cloud():
    """Scattered vectors, a third of all rows in one tight ball, a third copies of one vector."""
    rng = np.random.default_rng(7)
    return np.concatenate([rng.normal(size=(400, 24)), 3 + 1e-3 * rng.normal(size=(400, 24)), np.full((400, 24), -2.0)])


def test_exact_search(spark, cloud, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK_DOUBLES", 24 * 50)  # several blocks for the hot buckets
    monkeypatch.setattr(vi, "QUERY_DOUBLES", 24 * 7)
    index = vi.build_index(points(spark, cloud), 24, bits=4)
    assert index.rows == 801 and index.copies.count() == 1200
    assert max(len(r["locs"]) for r in index.blocks.collect()) < 100
    queries = list(range(0, 1200, 30))
    got = vi.nearest(index, points(spark, cloud).where("id % 30 = 0"), 5, 1, exact=True).collect()
    want = exact(cloud, queries, 5)
    assert {i: [r["neighbour"] for r in sorted((r for r in got if r["id"] == i), key=lambda r: r["rank"])] for i in queries} == want


def test_calibrated_recall(spark, cloud):
    index = vi.build_index(points(spark, cloud), 24)
    probes = vi.calibrated_probes(index, 5, recall=0.9)
    assert 1 <= probes <= 1 << index.bits
    near = vi.nearest(index, points(spark, cloud).where("id % 30 = 0"), 5, probes)
    true = spark.createDataFrame([(int(i), int(j)) for i, js in exact(cloud, range(0, 1200, 30), 5).items() for j in js], "id long, neighbour long")
    row = vi.recall(near, true).first()
    assert row["queries"] == 40 and row["recall"] >= 0.9


def test_bound_holds():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(300, 10)), rng.normal(size=(20, 10))
    planes = np.linalg.qr(rng.normal(size=(10, 10)))[0][None, :, :6]
    mine, theirs = vi._margins(q, x.mean(0), planes)[0], vi._margins(x, x.mean(0), planes)[0]
    bound = vi._bounds(mine)[np.arange(20)[:, None], vi._code(mine)[:, None] ^ vi._code(theirs)[None, :]]
    assert (bound <= ((q[:, None] - x[None]) ** 2).sum(-1) + 1e-9).all()


def test_odd_inputs(spark):
    empty = vi.build_index(points(spark, np.zeros((0, 3))), 3)
    assert empty.rows == 0 and vi.calibrated_probes(empty, 2) == 1
    assert vi.nearest(empty, points(spark, np.ones((2, 3))), 2, 1, exact=True).collect() == []
    one = vi.build_index(points(spark, np.ones((1, 3))), 3)
    assert vi.nearest(one, points(spark, np.ones((1, 3))), 2, 1, exact=True).collect() == []
    assert [r["neighbour"] for r in vi.nearest(one, points(spark, np.ones((1, 3)), first=9), 2, 1).collect()] == [0]
    for bad in ([1.0, float("nan"), 0.0], [1.0], None):
        with pytest.raises(ValueError):
            vi.build_index(spark.createDataFrame([(1, bad)], "id long, x array<double>"), 3)


def test_groups_of_bounded_size(spark, cloud, monkeypatch):
    """Parts of the index meet parts of the queries: no group holds all of either, and a query is sent once to a part."""
    monkeypatch.setattr(vi, "BLOCK_DOUBLES", 24 * 20)
    monkeypatch.setattr(vi, "STORED_DOUBLES", 24 * 200)
    monkeypatch.setattr(vi, "QUERY_DOUBLES", 24 * 10)
    index = vi.build_index(points(spark, cloud), 24, bits=6)
    asked = spark.createDataFrame([(i, [float(v) for v in cloud[i]], float("inf")) for i in range(0, 1200, 30)], "loc long, x array<double>, reach double")
    held, searched = spark.sparkContext.accumulator(0), vi._searched

    def counted(*settings):
        run = searched(*settings)

        def inner(some, stored):
            held.add(some.num_rows)
            assert some.num_rows <= 30 and sum(len(x) for x in stored["locs"]) <= 600
            return run(some, stored)

        return inner

    monkeypatch.setattr(vi, "_searched", counted)
    found = vi._nearest_vectors(index, asked, 3, 0).collect()
    assert held.value == 40 * 5  # five parts of the index
    for r in (r for r in found if r["rank"] == 1):
        assert r["d2"] == 0.0
    assert len(found) == 40 * 3
