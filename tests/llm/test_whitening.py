"""Whitening against exact sums and a whole decomposition."""

import math
from fractions import Fraction

import numpy as np
import pytest

from tallywort.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def vectors(n=150, d=40, seed=4):
    r = np.random.default_rng(seed)
    x = (r.normal(size=(n, 12)) @ r.normal(size=(12, d)) + 0.3 * r.normal(size=(n, d))).astype(np.float32)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    return rows + [rows[3], rows[3], (None, rows[5][1]), (-7, rows[8][1])]


def brute(rows, k=32):
    """By vector: exact deviation; exact covariance; projections up to sign."""
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    n, d = len(x), len(x[0])
    s = [sum(v[i] for v in x) for i in range(d)]
    dev = [sum((n * c - t) ** 2 for c, t in zip(v, s, strict=True)) for v in x]
    apart = [[Fraction(n * c - t, n) for c, t in zip(v, s, strict=True)] for v in x]
    cov = np.array([[float(sum(a[i] * a[j] for a in apart) / n) for j in range(d)] for i in range(d)])
    e, u = np.linalg.eigh(cov)
    e, u = e[::-1], u[:, ::-1]
    w = np.array([[float(c) for c in a] for a in apart]) @ u[:, :k] / np.sqrt(e[:k])
    return n, dev, np.abs(w), e[:k] / e.sum(), cov


def test_matches_brute_force(spark):
    rows = vectors()
    bad = [(900, None), (901, []), (902, [1.0] * 39 + [None]), (903, [1.0] * 39 + [float("nan")]), (904, [float("-inf")] + [0.0] * 39)]
    df = spark.createDataFrame(rows + bad, SCHEMA).selectExpr("*", "1 AS v", "2 AS x0", "3 AS component", "4 AS n")
    out = whitening.whitened(df)
    assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    got = out.collect()
    n, dev, w, share, _ = brute(rows)
    assert len(got) == 32 * n and {r["n"] for r in got} == {n}
    want = sorted((-1 if i is None else i, k + 1, dev[p], w[p][k], share[k]) for p, (i, _) in enumerate(rows) for k in range(32))
    have = sorted((-1 if r["vec_id"] is None else r["vec_id"], r["component"], r["deviation"], abs(r["whitened"]), r["explained"]) for r in got)
    for a, b in zip(want, have, strict=True):
        assert a[:3] == b[:3] and b[3] == pytest.approx(a[3], abs=1e-7) and b[4] == pytest.approx(a[4], rel=1e-9)
    assert {r["identity_error"] for r in got} == {got[0]["identity_error"]} and got[0]["identity_error"] < 1e-9
    # one sign for all rows of a component
    by = {}
    for r in got:
        by.setdefault(r["component"], []).append(r["whitened"])
    assert all(abs(sum(v)) < 1e-6 and sum(x * x for x in v) / n == pytest.approx(1) for v in by.values())


def test_sums_in_parts_are_the_same(spark, monkeypatch):
    df = spark.createDataFrame(vectors(60, 9), SCHEMA)
    key = lambda r: (str(r["vec_id"]), r["component"], round(r["whitened"], 6), r["deviation"])
    whole = sorted(map(key, whitening.whitened(df).collect()))
    monkeypatch.setattr(whitening, "SUMS", 7)
    assert sorted(map(key, whitening.whitened(df).collect())) == whole


def test_covariance_matches_numpy(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(50, 5)) + 1e6
    df = spark.createDataFrame([tuple(map(float, v)) for v in x], "a double, b double, c double, d double, `e f` double")
    got = whitening.pair_sums(df, df.columns, x.mean(0).tolist())
    assert np.allclose(got, (x - x.mean(0)).T @ (x - x.mean(0)), rtol=1e-9)


def test_without_variance_and_of_unlike_lengths(spark):
    rows = [(1, [1.0, 2.0, 5.0]), (2, [3.0, 2.0, 1.0]), (3, [4.0, 2.0, 9.0]), (4, [0.5, 0.25]), (5, [0.5])]
    got = {(r["vec_id"], r["component"]): r for r in whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 3 * 3 + 2 + 1
    assert got[1, 3]["whitened"] is None and got[1, 3]["explained"] == 0 and got[1, 1]["whitened"] is not None
    assert got[4, 1]["n"] == 1 and got[4, 1]["whitened"] is None and got[4, 1]["explained"] is None and got[4, 1]["identity_error"] is None and got[4, 1]["deviation"] == 0


def test_huge_entries_and_empty_tables(spark):
    rows = [(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.5])]
    got = whitening.whitened(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == 6 and {r["deviation"] for r in got if r["vec_id"] == 1} == {None}
    assert whitening.whitened(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None)], SCHEMA)).columns[0] == "vec_id"
    many = [(n, [[0] * 3]) for n in (5, 10**12)]
    assert [whitening.deviations(np.array([[1_000_001, 999_999, 1_000_000]]), n, [n * 1_000_000] * 3) for n, _ in many] == [[50], [None]]
