"""The index of sitemaps by state, by batches in any order."""

import random

from pyspark.sql import functions as F

from tallywort.operators import graph, sitemaps

MEMBERS = "index_id string, place int, url string, lastmod string, parsed boolean, states array<string>"
INDEX = "index_id string, state string, url string"


def children(spark, rows):
    return spark.createDataFrame(rows, "index_id string, place int, url string, lastmod string")


def test_batches_in_any_order_equal_a_rebuild(spark):
    r = random.Random(8)
    listed = [("a", i, f"s{i}", "1") for i in range(7)] + [("b", i, f"s{i}", "1") for i in range(2)]
    members = graph.held(sitemaps.refreshed(spark.createDataFrame([], MEMBERS), children(spark, listed)))
    index = spark.createDataFrame([], INDEX)
    want, parsed = {}, set()
    for _ in range(4):
        some = r.sample(listed, 3)
        locs = []
        for index_id, _, url, _ in some:
            parsed.add((index_id, url))
            want[index_id, url] = set()
            for state in r.sample(["wi", "IL", "mn", "xx9"], r.randint(0, 3)):
                locs += [(index_id, url, f"https://x.example/us/{state}/city/profile/roof/biz-1")] * 2
                want[index_id, url] |= {state.upper()} - {"XX9"}
        batch = sitemaps.observed(spark.createDataFrame([(i, u) for i, _, u, _ in some], "index_id string, url string"), spark.createDataFrame(locs or [("a", "s0", "https://x.example/none")], "index_id string, url string, loc string"))
        members, index = (graph.held(t) for t in sitemaps.applied(members, index, batch))
        members, index = (graph.held(t) for t in sitemaps.applied(members, index, batch))  # a repeated batch
        have = {(x["index_id"], x["state"], x["url"]) for x in index.collect()}
        assert have == {(i, s, u) for (i, u), states in want.items() for s in states} == {(x["index_id"], x["state"], x["url"]) for x in sitemaps.rebuilt(members).collect()}
        assert index.count() == len(have)
        done = {i: next((k for k in range(n) if (i, f"s{k}") not in parsed), n) for i, n in (("a", 7), ("b", 2))}
        assert {x["index_id"]: (x["cursor"], x["complete"]) for x in sitemaps.cursors(members).collect()} == {i: (c, c == n) for (i, c), n in zip(done.items(), (7, 2), strict=True)}
        assert {(x["index_id"], x["place"]) for x in sitemaps.next_batch(members, 2).collect()} == {(i, k) for (i, c), n in zip(done.items(), (7, 2), strict=True) for k in range(c, min(c + 2, n)) if c < n}
    asked = spark.createDataFrame([("a", "WI"), ("a", "TX"), ("b", "TX"), ("c", "WI")], "index_id string, state string")
    status = {(x["index_id"], x["state"]): x["status"] for x in sitemaps.support(index, members.withColumn("parsed", F.col("parsed") | (F.col("index_id") == "b")), asked).collect()}
    assert status["b", "TX"] == "unsupported" and status["c", "WI"] == "unknown" and status["a", "TX"] in ("unknown", "unsupported")


def test_refresh(spark):
    members = spark.createDataFrame([("a", 0, "s0", "1", True, ["WI"]), ("a", 1, "s1", "1", True, ["IL"]), ("b", 0, "t", "", True, ["MN"])], MEMBERS)
    rows = lambda df: {(x["index_id"], x["url"]): (x["place"], x["parsed"], x["states"]) for x in df.collect()}
    b = {("b", "t"): (0, True, ["MN"])}
    same = children(spark, [("a", 1, "s1", "1"), ("a", 0, "s0", "1"), ("a", 5, "s0", "1")])
    assert rows(sitemaps.refreshed(members, same)) == {("a", "s0"): (0, True, ["WI"]), ("a", "s1"): (1, True, ["IL"])} | b
    new = children(spark, [("a", 0, "s0", "1"), ("a", 1, "s2", None), ("a", 2, "s1", "2")])
    opened = {("a", "s2"): (1, False, []), ("a", "s1"): (2, False, [])} | b
    assert rows(sitemaps.refreshed(members, new)) == {("a", "s0"): (0, False, [])} | opened
    kept = sitemaps.refreshed(members, new, only_changed=True)
    assert rows(kept) == {("a", "s0"): (0, True, ["WI"])} | opened
    assert {(x["state"], x["url"]) for x in sitemaps.pruned(sitemaps.rebuilt(members), kept).collect()} == {("WI", "s0"), ("MN", "t")}
    assert sitemaps.fingerprint(same.repartition(3)).first()["fingerprint"] == sitemaps.fingerprint(same).first()["fingerprint"]
