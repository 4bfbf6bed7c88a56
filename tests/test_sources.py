"""Readers, extraction, store and streams on small inputs."""

import zipfile

import pytest
from pyspark.sql import functions as F

from tallywort.functions import finders
from tallywort.operators import extract, store
from tallywort.operators.schema import COLUMNS
from tallywort.sources import bidder_csv, exclusions, minnesota, payloads
from tallywort.streaming import events


def test_master_csv(spark, tmp_path):
    head = ["ID ", *COLUMNS[1:], "note"]
    row = lambda **v: ",".join('"' + v.get(c, "").replace('"', '""') + '"' for c in [*COLUMNS, "note"])
    path = tmp_path / "m.csv"
    path.write_text("﻿" + ",".join(head) + "\n" + row(id="1001", contractor_name=" Acme & Sons; ", zip="01234", related_companies="a\nb", note="x") + "\n" + row(id="9") + "\n" + row() + "\n", encoding="utf-8")
    rows, skipped, warnings = bidder_csv.read_master_csv(spark, str(path))
    r = rows.collect()
    assert len(r) == 1 and (r[0]["id"], r[0]["zip"], r[0]["contractor_name"], r[0]["related_companies"]) == ("1001", "01234", " Acme & Sons; ", "a\nb")
    assert [x["line"] for x in skipped.collect()] == [3] and warnings == ["ignored columns: note"]
    (tmp_path / "bad.csv").write_text("id,contractor_name\n1,x\n")
    with pytest.raises(ValueError, match="missing"):
        bidder_csv.read_master_csv(spark, str(tmp_path / "bad.csv"))


def test_exclusions(spark, tmp_path):
    head = "Exclusion ID,Classification,Name,UEI,Record Status,Active Date\n"
    with zipfile.ZipFile(tmp_path / "x.zip", "w") as z:
        z.writestr("public/x.csv", head + "1,Firm,\"Acme, Inc\",U1,Active,2024-01-01\n2,Firm,Beta,,Inactive,\n")
    rows = exclusions.read_exclusions(spark, exclusions.unpack(spark, str(tmp_path / "x.zip"), str(tmp_path)))
    assert [(r["exclusion_identifier"], r["entity_name"], r["active"]) for r in rows.collect()] == [("1", "Acme, Inc", True), ("2", "Beta", False)]
    with zipfile.ZipFile(tmp_path / "bad.zip", "w") as z:
        z.writestr("../x.csv", head)
    with pytest.raises(ValueError, match="unsafe"):
        exclusions.unpack(spark, str(tmp_path / "bad.zip"), str(tmp_path))
    with pytest.raises(ValueError, match="repeated"):
        exclusions.fields_of(["Name", "name "])


def test_listing(spark):
    cols = "path string, fileName string, publicationTimestamp string, size string, contentType string, url string"
    rows = [
        ("Exclusions/Public V2", "a.zip", "2024-01-01T00:00:00Z", "10", "application/zip", "u1"), ("Exclusions/Public V2", "b.zip", "2024-02-01T00:00:00+01:00", "10", "", "u2"),
        ("Exclusions/Public V2/Historical", "c.zip", "2025-01-01", "10", "", "u3"), ("Exclusions/Public V2", "d.zip", "soon", "10", "", "u4"),
        ("Exclusions/Public V2", "e.zip", "Mon, 15 Jan 2024 10:00:00 GMT", "10", "", "u5"), ("Exclusions/Public V2", "f.txt", "2026-01-01", "10", "", "u6"),
    ]
    assert [r["url"] for r in exclusions.newest_artifact(spark.createDataFrame(rows, cols)).collect()] == ["u2"]


def test_payloads(spark):
    df = spark.createDataFrame([(1, '{"data": [{"ACTIVITY_NR": "5", "estab_name": " Acme "}]}')], "q long, body string")
    r = payloads.api_rows(df, payloads.INSPECTION).first()
    assert (r["q"], r["activity_nr"], r["estab_name"], r["site_zip"]) == (1, "5", "Acme", "")
    with pytest.raises(Exception, match="not a data response"):
        payloads.api_rows(spark.createDataFrame([(1, '{"error": 1}')], "q long, body string"), payloads.INSPECTION).collect()
    xml = "<urlset><url><loc> https://x/1 </loc><lastmod>2024-01-01</lastmod></url><url><loc>https://x/2</loc></url></urlset>"
    got = spark.createDataFrame([(xml,)], "x string").select(payloads.sitemap(F.col("x")).alias("s")).first()["s"]
    assert [tuple(s) for s in got] == [("https://x/1", "2024-01-01"), ("https://x/2", "")]
    il = spark.createDataFrame([("Acme Co has been debarred from any public works project for a period of four years effective May 5, 2025.",), ("other",)], "text string")
    assert [tuple(r) for r in payloads.illinois_entries(il).collect()] == [("Acme Co", "2025-05-05", "2029-05-05")]
    wi = spark.createDataFrame([("List: ACME  CO Madison WI Debarment 1/2/2024 to 1/2/2027 Statewide. Beta Co nothing",)], "text string")
    al = spark.createDataFrame([(1, "Acme Co"), (2, "Beta Co"), (3, "abc")], "owner long, alias string")
    assert [(r["owner"], r["effective"], r["termination"], r["action"]) for r in payloads.wisconsin_hits(wi, al).collect()] == [(1, "1/2/2024", "1/2/2027", "Debarment")]
    t = spark.createDataFrame([("3 total complaints in the last 3 years",), ("1,200 complaints closed in the last 12 months",)], "t string").select(payloads.complaint_summary(F.col("t")).alias("s")).collect()
    assert [tuple(x["s"]) for x in t] == [(3, None), (None, 1200)]


HTML = """<html><head><script type="application/ld+json">{"@graph":[{"@type":"LocalBusiness","name":"Acme","telephone":"608-555-1234","address":{"streetAddress":"1 Oak","addressLocality":"Madison"}}]}</script></head>
<body><h1>Page</h1><table><tr><th>Company Name:</th><th>Phone</th></tr><tr><td><a href="/b">Beta</a></td><td>555</td></tr></table><dl><dt>Name</dt><dd>Jo</dd><dt>Record ID</dt><dd>77</dd></dl>
<div><p>Owner: Kim Lee of the firm</p><p>Phone: 608-555-9999</p></div></body></html>"""


def test_extraction(spark):
    df = spark.createDataFrame([(1, "https://x/p", HTML), (2, "https://x/q", None)], "page_id long, url string, html string")
    rows = {r["extractor"]: r for r in extract.extract_records(df).collect()}
    assert (rows["jsonld"]["company"], rows["jsonld"]["address"]) == ("Acme", "1 Oak, Madison")
    assert (rows["table"]["company"], rows["table"]["source_url"]) == ("Beta", "https://x/b")
    assert (rows["list"]["name"], rows["list"]["external_id"]) == ("Jo", "77")
    assert rows["block"]["phone"] == "608-555-9999"
    assert extract.safe_link("https://u:p@y/", "https://x/") == "https://x/" and extract.safe_link("javascript:1", "https://x/") == "https://x/"


CARD = """<html><body><div class="listing card"><h3>Gamma Works</h3><a href="/g">more</a><p>12 Long Oak Street, Suite 4</p><p>Call (608) 555-1234 by May 3, 2024</p></div>
<table><tr><th>Contractor Name</th><th>City</th><th>DFI</th><th>WC:</th></tr><tr><td>Delta</td><td>Madison</td><td>Y</td><td>N</td></tr></table><p>Call 608-555-0000</p></body></html>"""


def test_extraction_of_master_fields_and_cards(spark):
    df = spark.createDataFrame([(1, "https://x/p", CARD)], "page_id long, url string, html string")
    rows = {r["extractor"]: r for r in extract.extract_records(df).collect()}
    t, b = rows["table"], rows["block"]
    assert (t["contractor_name"], t["city"], t["dfi"], t["wc"]) == ("Delta", "Madison", "Y", "N")
    assert (b["name"], b["phone"], b["address"], b["date"], b["source_url"]) == ("Gamma Works", "(608) 555-1234", "12 Long Oak Street", "May 3, 2024", "https://x/g")
    assert extract.field_for(" ZIP code: ") == "zip" and extract.field_for("id") == "bidder_id" and extract.field_for("x") is None


def test_finders(spark):
    rows = [("due 2024-05-06 or 5/6/24",), ("on Sept. 3 2021",), ("77 N. 5th Ave. East; x",), ("12345 608.555.1234 1",), (None,)]
    out = spark.createDataFrame(rows, "t string").select(*(f(F.col("t")).alias(n) for n, f in (("d", finders.first_date), ("s", finders.first_street), ("p", finders.first_phone)))).collect()
    assert [r["d"] for r in out] == ["2024-05-06", "Sept. 3 2021", "", "", ""]
    assert [r["s"] for r in out] == ["", "", "77 N. 5th Ave. East", "", ""] and [r["p"] for r in out] == ["", "", "", "608.555.1234", ""]


def test_list_readers(spark):
    wi = spark.createDataFrame([("Acme Co Debarment 1/2/2024 Indefinite Statewide",), ("x acme co, acme co suspended 3/4/2020 5/6/2021 statewide",), ("nothing",)], "text string")
    al = spark.createDataFrame([(1, "ACME Co"), (2, "Acme Company")], "owner long, alias string")
    got = {(r["owner"], r["effective"], r["termination"], r["action"]) for r in payloads.wisconsin_hits(wi, al).collect()}
    assert got == {(1, "1/2/2024", "Indefinite", "Debarment"), (1, "3/4/2020", "5/6/2021", "Suspended")}
    texts = ["5 complaints, 3 complaints closed in last 12 months", "7 closed complaints in the last 12 months; 1,024 total complaints in the last 3 years", "complaints in the last 3 years", ""]
    out = spark.createDataFrame([(t,) for t in texts], "t string").select(payloads.complaint_summary(F.col("t")).alias("s")).collect()
    assert [tuple(x["s"]) for x in out] == [(None, None), (1024, 7), (None, None), (None, None)]
    with pytest.raises(Exception, match="unreadable"):
        payloads.illinois_entries(spark.createDataFrame([("A" + payloads.DEBARRED + "soon.",)], "text string")).collect()


def mn_page(n, shown):
    row = '<div class="results"><h2 class="result-link"><a id="v{0}">Vendor {0}, Inc.</a></h2><table><tr><td>{0} Oak Rd</td></tr><tr><td>Saint Paul, MN 55101</td></tr><tr><td>Debarment Date:</td><td>1/2/2024</td></tr><tr><td>Debarment End Date:</td><td>{1}</td></tr></table></div>'
    return f'<p>Results 1 - {shown} of {shown}</p><div class="search-results">' + "".join(row.format(i, "1/2/2027" if i else "soon") for i in range(n)) + "</div>"


def test_minnesota(spark):
    v = minnesota.listed_vendors(spark.createDataFrame([("https://mn/", mn_page(3, 3))], "url string, html string"))
    r = v.orderBy("place").collect()
    assert [(x["name"], x["address"], x["city"], x["state"], x["zip"], x["source_url"]) for x in r][1] == ("Vendor 1, Inc.", "1 Oak Rd", "Saint Paul", "MN", "55101", "https://mn/#v1")
    act = {x["place"]: x["active"] for x in minnesota.active(v, F.lit("2025-01-01").cast("date")).collect()}
    assert act == {0: None, 1: True, 2: True}
    c = spark.createDataFrame([(1, "Vendor 1 LLC", "", "", "saint paul", "MN", ""), (2, "Other", "vendor 2", "", "", "WI", "55101")], "owner long, contractor_name string, related_companies string, address_1 string, city string, state string, zip string")
    assert sorted((x["owner"], x["place"], x["confirmed"]) for x in minnesota.candidates(v, c).collect()) == [(1, 1, True), (2, 2, False)]
    with pytest.raises(Exception, match="incomplete"):
        minnesota.listed_vendors(spark.createDataFrame([("u", mn_page(2, 3))], "url string, html string")).collect()


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "s"))
    s.write({"records": spark.range(3).toDF("id")})
    s.write({"bidder_master": spark.range(2).toDF("id")})
    assert s.version() == 2 and s.read("records").count() == 3 and s.verify() == []
    part = next((tmp_path / "s" / "records" / "v1").glob("*.parquet"))
    part.write_bytes(part.read_bytes() + b"x")
    assert s.verify() == ["changed records"]


def test_stream(spark, tmp_path):
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:20:00", "a", 2.0), (3, "2024-01-01 03:00:00", "b", 5.0)]
    spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").withColumn("ts", F.to_timestamp("ts")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.event_stream(spark, str(tmp_path / "in"), "event_id long, ts timestamp, event_type string, value double")
    q = events.append_once(events.windowed_counts(stream), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    got = [(r["event_type"], r["n"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()]
    assert ("a", 2, 3.0) in got
