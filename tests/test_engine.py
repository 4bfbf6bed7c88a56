"""The engine's operators on small tables with known outcomes."""

import random

import pytest
from pyspark.sql import functions as F

from tallywort.operators import changes, findings, graph, identity, imports, proposals, runs, schema, search


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_import_is_sequential(spark):
    blank = {c: "" for c in schema.COLUMNS if c != "id"}
    def row(**v):
        return {**blank, **v}
    master = [dict(row(contractor_name="Acme"), pk=1, bidder_id="10"), dict(row(contractor_name="Solo"), pk=2, bidder_id="")]
    incoming = [
        dict(row(contractor_name="ACME", city="Madison"), line=2, id="10"),
        dict(row(contractor_name="New Co"), line=3, id="30"),
        dict(row(contractor_name="New Co", city="Dane"), line=4, id="30"),
        dict(row(contractor_name="solo"), line=5, id=""),
        dict(row(contractor_name="Other"), line=6, id=""),
    ]
    cols = [c for c in schema.COLUMNS if c != "id"]
    m = schema.master_norms(spark.createDataFrame(master, "pk long, bidder_id string, " + ", ".join(f"{c} string" for c in cols)))
    r = schema.master_norms(spark.createDataFrame(incoming, "line long, id string, " + ", ".join(f"{c} string" for c in cols)))
    out = imports.merge_master(m, r)
    assert rows(out, "pk", "contractor_name", "city", "outcome") == [
        (1, "ACME", "Madison", "updated"), (2, "solo", "", "updated"), (3, "New Co", "Dane", "inserted"), (4, "Other", "", "inserted")
    ]


def test_corroboration(spark):
    parts = ("address", "city", "state", "zip")
    def check(a, b, c=None):
        side = lambda t: dict(zip(parts, map(F.lit, t), strict=True))
        return spark.range(1).select(identity.location_corroborates(side(a), *(side(x) for x in (b, c) if x)).alias("v")).first()["v"]
    assert check(("", "Madison", "WI", ""), ("", "MADISON", "wi", ""))
    assert not check(("", "Madison", "IL", "53703"), ("", "Madison", "WI", "53703"))
    assert check(("", "", "", "53703-1234"), ("", "", "WI", "53703"))
    assert not check(("", "", "", ""), ("", "", "", ""))
    assert check(("", "Dane", "WI", ""), ("", "X", "IL", ""), ("", "Dane", "WI", ""))


def test_findings_never_a_false_no(spark):
    c = spark.createDataFrame([(i,) for i in range(1, 6)], "owner long")
    inspected = spark.createDataFrame([(1, "a", "2003-01-01"), (1, "b", "2004-01-01")], "owner long, activity_nr string, open_date string")
    v = spark.createDataFrame(
        [("a", "1", "S", "", "2005-02-02", 1), ("a", "2", "R", "", "", 2), ("a", "3", "O", "", "2006-01-01", 3), ("b", "4", "S", "X", "2007-01-01", 4)],
        "activity_nr string, citation_id string, viol_type string, delete_flag string, issuance_date string, seq long",
    )
    doubt = spark.createDataFrame([(2,)], "owner long")
    whole = spark.createDataFrame([(1, True), (2, True), (3, False), (4, True)], "owner long, complete boolean")
    out = findings.inspections(c, inspected, v, doubt, whole)
    assert rows(out, "owner", "osha", "osha_severe_violations", "years") == [(1, "Y", "2", "2003, 2005"), (2, "", "", ""), (3, "", "", ""), (4, "N", "", ""), (5, "", "", "")]


def test_complaints(spark):
    c = spark.createDataFrame([(i,) for i in range(1, 6)], "owner long")
    p = spark.createDataFrame([(1, 3), (2, 0), (3, None), (4, 0)], "owner long, total int")
    doubt = spark.createDataFrame([(4,)], "owner long")
    whole = spark.createDataFrame([(i, True) for i in range(1, 6)], "owner long, complete boolean")
    out = findings.complaints(c, p, doubt, whole)
    assert rows(out, "owner", "better_business_bureau_complaints") == [(1, "Y"), (2, "N"), (3, ""), (4, ""), (5, "")]


def test_upsert(spark):
    cur = spark.createDataFrame([], "k string, content_hash string, payload string, first_seen string, last_seen string, last_changed string, active boolean")
    inc = spark.createDataFrame([("a", "h1", "p1")] * 12, "k string, content_hash string, payload string")
    snap, hist = changes.upsert(cur, inc, ["k"], F.lit("t1"))
    assert rows(snap, "k", "outcome") == [("a", "new")] and hist.count() == 1
    again, hist = changes.upsert(snap.drop("outcome"), inc, ["k"], F.lit("t2"))
    assert rows(again, "outcome", "last_changed", "last_seen") == [("unchanged", "t1", "t2")] and hist.count() == 0
    new = spark.createDataFrame([("a", "h2", "p2")], "k string, content_hash string, payload string")
    last, hist = changes.upsert(again.drop("outcome"), new, ["k"], F.lit("t3"))
    assert rows(last, "outcome", "payload") == [("updated", "p2")] and rows(hist, "old_payload", "new_payload") == [("p1", "p2")]


def test_proposal_life(spark):
    master = spark.createDataFrame([(1, "10", "Acme", "", ""), (2, "20", "Beta", "Y", "")], "pk long, bidder_id string, contractor_name string, osha string, osha_severe_violations string")
    ev = spark.createDataFrame(
        [(1, 100, "https://api.dol.gov/x", "s", "u", "id", True, "Y", "2"), (2, 200, "https://api.dol.gov/x", "s", "u", "id", False, "N", "0"), (1, 300, "https://elsewhere/", "s", "u", "id", True, "N", "9")],
        "pk long, record_id long, start_url string, source_name string, source_url string, reason string, complete_aggregate boolean, osha string, osha_severe_violations string",
    )
    none = spark.createDataFrame([], "id long, signature string, status string")
    made = proposals.compare(ev, master, none)
    assert rows(made, "master_pk", "field_name", "new_value") == [(1, "osha", "Y"), (1, "osha_severe_violations", "2")]
    numbered = made.withColumn("id", F.when(F.col("field_name") == "osha", 1).otherwise(2).cast("long"))
    m2, p2, h = proposals.apply(spark.createDataFrame([(1,)], "id long"), ev, master, numbered, F.lit("now"))
    assert rows(m2, "pk", "osha") == [(1, "Y"), (2, "Y")] and rows(h, "proposal_id", "old_value", "new_value") == [(1, "", "Y")]
    p3 = proposals.dismiss(spark.createDataFrame([(2,)], "id long"), p2)
    assert rows(p3, "id", "status") == [(1, "applied"), (2, "dismissed")]
    assert proposals.compare(ev, m2, p3.select("id", "signature", "status")).count() == 0
    m4, _, h4 = proposals.apply(spark.createDataFrame([(1,)], "id long"), ev, m2, p3, F.lit("later"))
    assert rows(m4, "pk", "osha") == [(1, "Y"), (2, "Y")] and h4.count() == 0


def test_stale_evidence(spark):
    ev = spark.createDataFrame([(1, True, "https://sam.gov/", "", 5), (2, True, "https://api.dol.gov/", "", 7), (3, True, "https://api-alpha.sam.gov/", "", 5)], "source_id long, active boolean, start_url string, environment string, job_id long")
    jobs = spark.createDataFrame([(5, 1, "completed"), (7, 2, "completed"), (8, 2, "failed"), (5, 3, "completed")], "id long, source_id long, status string")
    assert rows(proposals.fresh_evidence(ev, jobs), "source_id") == [(1,)]


def test_recovery(spark):
    jobs = spark.createDataFrame([(1, 9, "running", None, "[1]", 1), (2, 9, "interrupted", None, "", 3), (3, 9, "interrupted", None, "", 1), (4, 9, "completed", 3, "", 2)], "id long, source_id long, state string, parent_job_id long, selection string, attempt_no int")
    after, children = runs.recovered(jobs)
    assert rows(after, "id", "state") == [(1, "interrupted"), (2, "interrupted"), (3, "interrupted"), (4, "completed")]
    assert rows(children, "parent_job_id", "attempt_no", "selection") == [(1, 2, "[1]")]


def test_graph(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "src long, dst long")
    assert {r["component"] for r in graph.components(edges).collect()} == {1, 100}
    seen, limited = graph.depths(spark.createDataFrame([(1,)], "node long"), edges.union(spark.createDataFrame([(1, 5)], "src long, dst long")), 3)
    assert rows(seen, "node", "depth") == [(1, 0), (2, 1), (3, 2), (4, 3), (5, 1), (6, 2), (7, 3)] and limited


def test_fuzzy_pairs_match_brute_force(spark):
    import difflib
    import random

    rnd = random.Random(5)
    base = ["acme builders", "north star roofing", "green field paving", "acme", "lakeside", "red oak"]
    names = sorted({"".join(c for c in rnd.choice(base) + rnd.choice(["", " x", " south", "s"]) if rnd.random() > 0.04) for _ in range(60)})
    cands, targets = names[::2], names[1::2]
    want = {(c, t) for c in cands for t in targets if len(c) >= 6 and (c in t or t in c or difflib.SequenceMatcher(None, c, t).ratio() >= 0.84)}
    c, t = spark.createDataFrame([(c,) for c in cands], "candidate string"), spark.createDataFrame([(t,) for t in targets], "target string")
    for shared in (None, 2, 3):
        assert {(r["candidate"], r["target"]) for r in identity.plausible(c, t, shared=shared).collect()} == want
    # the pairs of a context only
    own = {n: i % 3 for i, n in enumerate(names)}
    got = identity.plausible_in_context(c.withColumn("owner", F.expr("pmod(hash(candidate), 3)")), t.withColumn("owner", F.expr("pmod(hash(target), 3)")), "owner", 5)
    owner = {r["n"]: r["o"] for r in spark.createDataFrame([(n,) for n in own], "n string").selectExpr("n", "pmod(hash(n), 3) AS o").collect()}
    close = lambda a, b: a in b or b in a or difflib.SequenceMatcher(None, a, b).ratio() >= 0.84
    assert {(r["candidate"], r["target"]) for r in got.collect()} == {(a, b) for a in cands for b in targets if owner[a] == owner[b] and len(a) >= 5 and close(a, b)}


def test_search_is_literal(spark):
    m = spark.createDataFrame([(1, "1", "100% Roofing"), (2, "2", "a_b"), (3, "3", "ÉCOLE")], "pk long, bidder_id string, contractor_name string")
    hit = lambda q: [r["pk"] for r in m.where(search.matches(q, ["contractor_name"])).collect()]
    assert hit("%") == [1] and hit("_") == [2] and hit("école") == [] and hit("roof") == [1]
    with pytest.raises(ValueError, match="unknown"):
        search.master_columns("nope")
    with pytest.raises(ValueError, match="rows"):
        search.exportable(m, 2)


def test_canonical_and_projection(spark):
    df = spark.createDataFrame([("Acme", " (608) 555-1234", "Madison", "WI", "53703", "Y", "Open", "1001")], "contractor_name string, phone string, city string, state string, zip string, osha string, osha_status string, bidder_id string")
    canon = schema.canonical_records(df)
    r = canon.first()
    assert (r["company"], r["phone"], r["location"], r["osha_status"]) == ("Acme", "608-555-1234", "Madison, WI 53703", "open")
    row = schema.evidence_rows(canon).first()
    assert (row["id"], row["contractor_name"], row["zip"], row["osha"]) == ("1001", "Acme", "53703", "Y")


@pytest.fixture(scope="module")
def odd_places(spark):
    """Two tables of places with unknown parts, ZIPs with and without an ending, and repeated rows."""
    r = random.Random(8)
    def table(n):
        own = [(r.randrange(n), *(r.choice(x) for x in (["WI", "wi", "IL", "", None], ["Port A", "port a", "B", ""], ["53703", "53703-1234", "60601", None], ["1 Oak", "1 OAK", "2 Elm", ""]))) for _ in range(n)]
        return spark.createDataFrame(own + own[:5], "k long, state string, city string, zip string, address string")
    return table(40).cache(), table(60).cache()


def brute_pairs(left, right, ok):
    side = lambda p: {c: F.col(f"{p}_{c}") for c in ("state", "city", "zip", "address")}
    both = left.distinct().toDF(*(f"l_{c}" for c in left.columns)).crossJoin(right.distinct().toDF(*(f"r_{c}" for c in right.columns)))
    return both.where(ok(side("l"), side("r"))).withColumn("score", identity.location_score(side("l"), side("r")))


def agree(a, b):
    same = {c: (identity.match_text(a[c]) != "") & (F.substring(identity.match_text(a[c]), 1, 5 if c == "zip" else 99) == F.substring(identity.match_text(b[c]), 1, 5 if c == "zip" else 99)) for c in a}
    return same["zip"] | same["state"] & (same["city"] | same["address"])


@pytest.mark.parametrize("corroborated", [False, True])
def test_location_pairs_match_brute_force(spark, odd_places, corroborated):
    want = brute_pairs(*odd_places, identity.location_corroborates if corroborated else agree).drop("score")
    got = identity.location_pairs(*odd_places, corroborated=corroborated)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.count() > 200


def test_unique_best_location_matches_pairs(spark, odd_places):
    left, right = odd_places
    for share in (right, right.where("k % 9 = 0"), right.where("k % 20 = 0"), right.limit(0)):
        want = identity.unique_best(brute_pairs(left, share, agree), "l_k", "r_k", "score")
        got = identity.unique_best_location(left, share, "k")
        assert rows(got, "l_k", "r_k", "score") == rows(want, "l_k", "r_k", "score")
    assert identity.unique_best_location(left, right.where("k % 20 = 0"), "k").count() > 0


def test_best_locations_are_found_without_pairs(spark):
    """A thousand places of one ZIP on both sides are a million pairs; the counts are a few rows a place."""
    same = lambda n: spark.range(n).select(F.col("id").alias("k"), F.lit("WI").alias("state"), F.lit("Port").alias("city"), F.lit("53703").alias("zip"), F.concat(F.col("id").cast("string"), F.lit(" Oak")).alias("address"))
    best = identity.unique_best_location(same(1000), same(1000), "k")
    assert best.where("l_k = r_k and score = 11").count() == 1000
    assert spark_rows(best) < 100_000


def spark_rows(df):
    """The most rows that an operator of the plan made."""
    df.collect()
    def walk(node):
        name = node.getClass().getSimpleName()
        own = [node.metrics().apply("numOutputRows").value()] if node.metrics().contains("numOutputRows") else []
        inner = [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
        for x in (*inner, *(node.children().apply(i) for i in range(node.children().size()))):
            own += walk(x)
        return own
    return max(walk(df._jdf.queryExecution().executedPlan()))
