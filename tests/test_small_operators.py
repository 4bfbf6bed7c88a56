"""Operators that no query of the engine runs: request building, profile evidence, display order, exports."""

import json

import pytest
from pyspark.sql import functions as F

from tallywort.functions import text, urls
from tallywort.operators import extract, identity, profiles, schema
from tallywort.sources import bidder_csv, payloads


def test_paging_and_queries(spark):
    body = lambda n: json.dumps({"data": [{"a": "1"}] * n})
    df = spark.createDataFrame([("x", 0, body(2)), ("y", 4, body(1)), ("z", 0, body(0))], "term string, offset int, body string")
    assert [tuple(r) for r in payloads.next_offsets(df, limit=2).collect()] == [("x", 2)]
    url = spark.createDataFrame([("acme & co",)], "t string").select(payloads.inspection_query(F.col("t"), 5000).alias("q")).first()["q"]
    assert url.startswith("limit=5000&offset=5000&fields=activity_nr,estab_name") and "sort=desc&sort_by=open_date" in url and "%25acme+%26+co%25" in url
    none, reason = payloads.disabled_source(spark, "off")
    assert none.count() == 0 and none.columns == ["owner", "value"] and reason == "off"


def test_profile_evidence(spark):
    c = spark.createDataFrame([("a", "d1", "t", "s")] * 3 + [("a", "d2", "t", "s")] + [("b", f"d{i:03}", "", "") for i in range(70)], "k string, date string, type string, status string")
    got = {r["k"]: r["metadata"] for r in profiles.complaint_metadata(c, "k").collect()}
    assert [m["date"] for m in got["a"]] == ["d1", "d2"] and len(got["b"]) == profiles.MAX_METADATA and got["b"][0]["date"] == "d000"
    p = spark.createDataFrame([("a", 1, "c", "", "x"), ("a", 2, "c", "s", ""), ("a", 3, "d", None, "x"), ("b", 1, "", "", "")], "k string, place int, city string, state string, zip string")
    best = {r["k"]: (r["place"], r["city"]) for r in profiles.most_complete(p, "k", ["city", "state", "zip"]).collect()}
    assert best == {"a": (3, "d"), "b": (1, "")}
    rows = spark.createDataFrame([("u", 0, "Acme", "", "1"), ("u", 1, "Acme Inc", "Oak", "2"), ("u", 2, "Beta Inc", "Elm", ""), ("v", 0, "", "", "")], "url string, place int, name string, address string, phone string")
    got = {r["url"]: (r["name"], r["address"], r["phone"]) for r in extract.merged_profiles(rows, "url").collect()}
    assert got == {"u": ("Acme Inc", "Oak", "1"), "v": ("", "", "")}


def test_location_evidence_and_context(spark):
    parts = ("address", "city", "state", "zip")
    side = lambda *v: dict(zip(parts, map(F.lit, v), strict=True))
    e = spark.range(1).select(identity.location_evidence(side("12 Oak Rd Suite 5", "Madison", "WI", "53703-1234"), side("12 oak rd", "MADISON", "IL", "53703")).alias("e")).first()["e"]
    assert e.asDict() == {"state": False, "city": True, "zip": True, "address": True, "street_number": True}
    e = spark.range(1).select(identity.location_evidence(side("", None, "", ""), side("", "", "", "")).alias("e")).first()["e"]
    assert not any(e)
    seen = lambda t, *p: spark.range(1).select(identity.in_context(F.lit(t), *(tuple(map(F.lit, x)) for x in p)).alias("v")).first()["v"]
    assert seen("in Madison, WI", ("Madison", "WI", "")) and seen("zip 53703", ("X", "IL", "53703")) and not seen("Madison only", ("Madison", "WI", "53703"), ("", "", ""))


def test_urls_and_order(spark):
    ok = lambda u: spark.range(1).select(urls.allowed_url(F.lit(u), F.lit("https://a.example/x")).alias("v")).first()["v"]
    assert ok("https://A.example/y?z=1.pdf") and ok("http://a.example:80/") and not ok("https://b.example/") and not ok("https://a.example/f.PDF") and not ok("https://a.example:8080/") and not ok(None)
    s = spark.createDataFrame([(1, "other"), (2, "second"), (3, "first"), (4, "another")], "id int, name string")
    assert [r["id"] for r in profiles.in_display_order(s, ["first", "second"]).collect()] == [3, 2, 1, 4]


def test_stored_master_and_exports(spark, tmp_path):
    df = spark.createDataFrame([(5, "1001", "=SUM(A1)", None, "01234", "2024")], "pk long, bidder_id string, contractor_name string, city string, zip string, updated_at string")
    rows = schema.master_rows(df)
    r = rows.first()
    assert (r["id"], r["contractor_name"], r["city"], r["zip"], r["_master_id"], r["_updated_at"]) == ("1001", "=SUM(A1)", "", "01234", 5, "2024") and rows.columns[: len(schema.COLUMNS)] == schema.COLUMNS
    bidder_csv.write_csv(rows, str(tmp_path / "c"))
    back = spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first()
    assert back["contractor_name"] == "'=SUM(A1)" and back["zip"] == "01234"
    bidder_csv.write_json(rows, str(tmp_path / "j"))
    assert spark.read.schema(", ".join(f"{c} string" for c in schema.COLUMNS)).json(str(tmp_path / "j")).first()["contractor_name"] == "=SUM(A1)"
    assert spark.createDataFrame([("a\0b",), (None,)], "v string").select(text.csv_cell(F.col("v")).alias("o")).collect()[0]["o"] == "ab"


@pytest.mark.parametrize(("place", "want"), [(("Madison", "wi", "53703"), "Madison, WI 53703"), (("Madison", "", "53703"), "53703"), (("", "wi", ""), "WI"), ((None, None, None), "")])
def test_location_queries(spark, place, want):
    from tallywort.sources import business_search

    row = spark.createDataFrame([place], "c string, s string, z string")
    assert row.select(business_search.location_query(F.col("c"), F.col("s"), F.col("z")).alias("q")).first()["q"] == want
