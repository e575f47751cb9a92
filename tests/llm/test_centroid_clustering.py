"""Lloyd's rounds by column blocks against plain rounds in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from tributary.llm import centroid_clustering as cc

SCHEMA = "vec_id bigint, embedding array<float>"


def plain(rows, k, rounds, dimensions, scale=256):
    kept = [
        (i, [math.floor(float(np.float32(x)) * scale) for x in v])
        for i, v in rows
        if v is not None and len(v) == dimensions and all(x is not None and math.isfinite(x) for x in v)
    ]
    by = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in by[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        for n, members in groups.items():
            centroids[n] = [sum(column) // len(members) for column in zip(*members, strict=True)]
    return sorted(((i, *nearest(v)[::-1]) for i, v in kept), key=str), centroids


def found(spark, rows, k, rounds, dimensions, **more):
    vectors = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA + ", cluster string").repartition(3)
    out = cc.lloyd(vectors, k, rounds, dimensions, **more)
    return sorted((tuple(r) for r in out.assigned.select("vec_id", "cluster", "distance").collect()), key=str), out


@pytest.mark.parametrize("block_size", [1, 3, 8, 50])
def test_equals_plain_rounds(spark, block_size):
    rng = random.Random(block_size)
    centres = [[rng.uniform(-1, 1) for _ in range(8)] for _ in range(4)]
    rows = [(i, [c + rng.gauss(0, 0.2) for c in rng.choice(centres)]) for i in range(300)]
    rows += [(1000 + i, [0.5] * 8) for i in range(150)]  # a third of all rows is one vector
    got, out = found(spark, rows, 9, 4, 8, block_size=block_size, chunk=7 * block_size)
    expected, centroids = plain(rows, 9, 4, 8)
    assert got == expected
    assert out.centroids.tolist() == centroids


def test_rows_that_are_no_vectors_and_repeated_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (1, [0.1, 0.2]), (1, [0.1, 0.2]), (1, [0.3, -0.2]), (None, [0.5, 0.5]), (None, None), (2, None), (3, []), (4, [1.0]), (5, [1.0, 2.0, 3.0]),
        (6, [None, 1.0]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [-inf, 1.0]), (10, [-0.001, -0.0]), (11, [100000.0, -100000.0]),
    ]
    got, _ = found(spark, rows, 3, 2, 2)
    expected, _ = plain(rows, 3, 2, 2)
    assert got == expected
    assert len(got) == 6


def test_equal_distances_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    rows = [(i, [1.0, 1.0]) for i in range(5)]
    got, out = found(spark, rows, 4, 3, 2)
    assert got == [(i, 0, 0) for i in range(5)]
    assert out.centroids.tolist() == [[256, 256]] * 4


def test_fewer_vectors_than_centroids_and_none(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0])]
    got, out = found(spark, rows, 40, 5, 2)
    assert [r[2] for r in got] == [0, 0] and len(out.centroids) == 2
    for none in ([], [(1, [1.0])]):
        got, out = found(spark, none, 40, 5, 2)
        assert got == [] and out.assigned.columns == ["vec_id", "cluster", "distance"]
        assert cc.with_inertia(out).collect() == []


def test_components_too_large(spark):
    with pytest.raises(Exception, match="or more in size"):
        found(spark, [(1, [1e9, 0.0])], 1, 1, 2)


def test_large_numbers_are_exact():
    rng = np.random.default_rng(1)
    vectors, centroids = (rng.integers(-(2**27) + 1, 2**27, (n, 5)) for n in (6, 4))
    expected = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids] for v in vectors]
    assert cc.partial_distances(vectors, centroids).tolist() == expected
    small = cc.partial_distances(vectors % 1000, centroids % 1000)
    assert small.tolist() == [[int(((v - c) ** 2).sum()) for c in centroids % 1000] for v in vectors % 1000]


def test_inertia_and_digests(spark):
    rows = [(i, [i % 3 + i / 100, -i / 50]) for i in range(60)]
    _, out = found(spark, rows, 5, 3, 2)
    table = [r.asDict() for r in cc.with_inertia(out).collect()]
    assert len(table) == 60
    for row in table:
        assert row["cluster_inertia"] == sum(r["distance"] for r in table if r["cluster"] == row["cluster"])
        assert row["inertia"] == sum(r["distance"] for r in table)
        centroid = ",".join(map(str, out.centroids[row["cluster"]].tolist()))
        assert row["centroid_sha256"] == hashlib.sha256(centroid.encode()).hexdigest()


def test_settings_are_put_back(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    found(spark, [(1, [1.0, 2.0])], 1, 1, 2)
    assert spark.conf.get(name, None) == before
