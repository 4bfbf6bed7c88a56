"""As-of lookups against a plain search."""

import random

import pytest

from tallywort.operators import asof


@pytest.mark.parametrize("ranges", [1, 4, 13])
def test_as_of_matches_a_search(spark, ranges):
    r = random.Random(ranges)
    key = lambda: r.choice([1, 1, 1, 1, 2, 3, 4, None])
    versions = [(key(), r.choice([None, *range(40)]), r.randrange(9), r.choice("ab")) for _ in range(150)]
    probes = [(key(), r.choice([None, *range(-3, 45)]), i % 90) for i in range(200)]
    v, p = spark.createDataFrame(versions, "k int, since int, x int, y string"), spark.createDataFrame(probes, "k int, at int, id int")
    want = []
    for k, at, i in probes:
        fits = [(t, x, y) for j, t, x, y in versions if k is not None and j == k and t is not None and at is not None and t <= at]
        want.append((k, at, i, *(max(fits)[1:] if fits else (None, None))))
    got = asof.as_of(p, v, "k", "at", "since", ["x", "y"], ranges)
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_empty_sides(spark):
    v, p = spark.createDataFrame([], "k int, since int, x int"), spark.createDataFrame([(1, 2)], "k int, at int")
    assert [tuple(r) for r in asof.as_of(p, v, "k", "at", "since", ["x"]).collect()] == [(1, 2, None)]
    assert asof.as_of(p.limit(0), v, "k", "at", "since", ["x"]).count() == 0
