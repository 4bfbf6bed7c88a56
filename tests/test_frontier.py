"""Ranks over ranges and crawls by jobs against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tallywort.operators import graph, search


def test_numbers(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "a", "a", "b", None]), i) for i in r.sample(range(1000), 300)]
    df = spark.createDataFrame(rows, "k string, v int")
    want = {}
    for k, v in sorted(rows, key=lambda x: x[1]):
        want.setdefault(k, []).append(v)
    got = {(x["k"], x["v"]): x["n"] for x in graph.numbered(df, "n", [F.col("v")], ["k"]).collect()}
    assert got == {(k, v): i for k, vs in want.items() for i, v in enumerate(vs)}
    every = sorted(v for _, v in rows)
    for low, high in ((0, 5), (120, 140), (295, 400), (500, 600)):
        assert [x["v"] for x in search.deep_page(df, [F.col("v")], high - low, low).collect()] == every[low:high]
    assert graph.numbered(df.limit(0), "n", [F.col("v")], ["k"]).count() == 0


def crawl(seeds, edges, max_depth, max_pages):
    seen, level, limited, depth = {}, sorted(set(seeds)), False, 0
    while level:
        room = max_pages - len(seen) if depth <= max_depth else 0
        limited |= len(level) > room
        level = level[:room]
        seen |= dict.fromkeys(level, depth)
        level = sorted({d for s, d in edges if s in set(level)} - set(seen))
        depth += 1
    return seen, limited


@pytest.mark.parametrize("seed", [1, 2])
def test_jobs_match_a_plain_crawl(spark, seed):
    r = random.Random(seed)
    edges = [(r.randrange(40), r.randrange(40)) for _ in range(70)]
    seeds = [(j, r.randrange(40)) for j in range(5) for _ in range(3)] + [(77, 1), (0, 3), (0, 3)]
    limits = [(j, r.randrange(4), r.choice([1, 2, 6, 100])) for j in range(6)]
    visited, jobs = graph.job_depths(
        spark.createDataFrame(seeds, "job int, node int"), spark.createDataFrame(edges, "src int, dst int"), spark.createDataFrame(limits, "job int, max_depth int, max_pages int"),
    )
    want = {j: crawl([n for k, n in seeds if k == j], edges, d, p) for j, d, p in limits}
    assert {(x["job"], x["node"]): x["depth"] for x in visited.collect()} == {(j, n): d for j, (seen, _) in want.items() for n, d in seen.items()}
    assert {x["job"]: (x["n_pages"], x["limited"]) for x in jobs.collect()} == {j: (len(seen), cut) for j, (seen, cut) in want.items()}
