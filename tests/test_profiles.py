"""Profile URLs, addresses and display states."""

import datetime
import zipfile

import pytest
from pyspark.sql import functions as F

from tallywort.operators import profiles, store


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("o")).first()["o"]


def test_urls(spark):
    base = "https://www.bbb.org/us/wi/madison/profile/roofing/acme-roofing-0694-1000"
    for tail in ("", "/", "/complaints", "/customer-reviews?x=1", "/addressId/77", "#top"):
        assert one(spark, profiles.profile_base, base + tail) == base
    assert one(spark, profiles.complaints_url, base + "?a") == base + "/complaints"
    assert one(spark, profiles.name_from_slug, base) == "Acme Roofing"
    assert one(spark, profiles.is_profile, base) and one(spark, profiles.is_complaints, base + "/complaints") and not one(spark, profiles.is_complaints, base)


def test_addresses(spark):
    assert tuple(one(spark, profiles.address_in, "At 12 Oak Rd, Madison, WI 53703-1234 now")) == ("12 Oak Rd", "Madison", "WI", "53703-1234")
    assert tuple(one(spark, profiles.address_in, "Madison, WI 53703")) == ("", "Madison", "WI", "53703")
    assert tuple(one(spark, profiles.address_in, None)) == ("", "", "", "")
    assert tuple(one(spark, profiles.address_in, "Call 5. 100 Main Springfield, IL 62701")) == ("100 Main", "Springfield", "IL", "62701")
    assert tuple(one(spark, profiles.address_in, "12 Oak Rd Suite 5, St. Paul, MN 55101")) == ("12 Oak Rd Suite 5", "St. Paul", "MN", "55101")
    assert tuple(one(spark, profiles.address_in, "no address, at all 12345")) == ("", "", "", "")


def test_states(spark):
    rows = [({"status": "x"}, True), ({"complete": "false"}, True), ({"match_status": "Ambiguous"}, True), ({}, False), ({}, True)]
    out = spark.createDataFrame(rows, "extra map<string,string>, active boolean").select(profiles.evidence_state(F.col("extra"), F.col("active")).alias("s"))
    assert [r["s"] for r in out.collect()] == ["x", "incomplete", "ambiguous", "inactive", "complete"]
    now = F.lit(datetime.datetime(2024, 1, 3, 1))
    t = spark.createDataFrame([(datetime.datetime(2024, 1, 1),), (datetime.datetime(2024, 1, 2),), (None,)], "t timestamp")
    assert [r[0] for r in t.select(profiles.is_stale(F.col("t"), now)).collect()] == [True, False, True]


def test_restore_and_bundle(spark, tmp_path):
    s = store.Store(spark, str(tmp_path / "a"))
    s.write({"records": spark.range(3).toDF("id"), "bidder_master": spark.range(1).toDF("id")})
    back = store.restore(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    assert back.read("records").count() == 3
    with pytest.raises(ValueError, match="exists"):
        store.restore(spark, str(tmp_path / "a"), str(tmp_path / "b"))
    ev = spark.createDataFrame([(1, "INFO", "token=abc", '{"password": "p"}'), (2, "ERROR", "ok", "{}")], "id long, level string, message string, details string")
    store.bundle(ev, str(tmp_path / "x.zip"))
    text = zipfile.ZipFile(tmp_path / "x.zip").read("events.jsonl").decode()
    assert "abc" not in text and '"p"' not in text and text.count("\n") == 1
