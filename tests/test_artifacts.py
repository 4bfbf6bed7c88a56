"""The artifact cache: staged, validated, then published."""

import zipfile
from datetime import UTC, datetime, timedelta

import pytest

from tallywort.sources import artifacts, exclusions

NOW = datetime(2024, 5, 1, 12, tzinfo=UTC)


def zipped(path, members):
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, text in members:
            z.writestr(name, text)
    return str(path)


def test_a_broken_artifact_never_replaces_a_good_one(spark, tmp_path):
    (tmp_path / "cache").mkdir()
    cache, url = artifacts.ArtifactCache(spark, str(tmp_path / "cache")), "https://x.example/a.zip"
    read = lambda p: spark.read.csv(exclusions.unpack(spark, p, str(tmp_path)), header=True)
    assert cache.metadata() == {} and cache.validators(url) == {} and cache.path() is None
    with pytest.raises(artifacts.ArtifactError, match="nothing is retained"):
        cache.accept(304, url, {}, None, read, NOW)
    good = zipped(tmp_path / "one", [("a.csv", "n\n1\n2\n")])
    rows, made = cache.accept(200, url, {"ETag": "e1", "Content-Type": "application/zip", "Last-Modified": "m"}, good, read, NOW)
    assert rows.count() == 2 and not made["cache_reused"] and cache.validators(url) == {"If-None-Match": "e1", "If-Modified-Since": "m"} and cache.validators("other") == {}
    held = cache.path()
    size = (tmp_path / "cache" / made["file"]).stat().st_size
    later = NOW + timedelta(hours=47)
    bad = zipped(tmp_path / "bad", [("a.csv", "n\n1\n"), ("../b.csv", "x")])
    for status, headers, staged, most, reason in [
        (200, {}, bad, 10**9, "can't be read"), (200, {}, str(tmp_path / "bad"), 10, "too large"), (200, {"content-length": "5"}, bad, 10**9, "incomplete"),
        (200, {"content-type": "text/html"}, bad, 10**9, "kind"), (503, {}, None, 10**9, "503"), (200, {}, None, 10**9, "200"),
    ]:
        with pytest.raises(artifacts.ArtifactError, match=reason) as e:
            cache.accept(status, url, headers, staged, read, later, max_bytes=most)
        assert e.value.metadata["retained_age_seconds"] == 47 * 3600 and cache.path() == held and cache.metadata() == {k: v for k, v in made.items() if k != "cache_reused"}
    rows, again = cache.accept(304, url, {}, None, read, later)
    assert rows.count() == 2 and again["cache_reused"] and again["size"] == size
    with pytest.raises(artifacts.ArtifactError, match="stale"):
        cache.accept(304, url, {}, None, read, NOW + timedelta(hours=49))
    rows, new = cache.accept(200, url, {}, zipped(tmp_path / "two", [("a.csv", "n\n7\n")]), read, later)
    assert [r["n"] for r in rows.collect()] == ["7"] and new["file"] != made["file"] and not (tmp_path / "cache" / made["file"]).exists()
    with open(cache.path(), "ab") as f:
        f.write(b"x")
    with pytest.raises(artifacts.ArtifactError, match="has changed"):
        cache.accept(304, url, {}, None, read, later)


def test_archives_are_checked_as_they_are_read(spark, tmp_path):
    big = zipped(tmp_path / "big.zip", [("a.csv", "x" * 5000)])
    with pytest.raises(ValueError, match="too large"):
        exclusions.unpack(spark, big, str(tmp_path), most=4999)
    assert open(exclusions.unpack(spark, big, str(tmp_path), most=5000)).read() == "x" * 5000
    for members, reason in [([("a.csv", ""), ("A.CSV", "")], "repeated"), ([("a.csv", ""), ("b.zip", "")], "within"), ([("/a.csv", "")], "unsafe"), ([("a.txt", "")], "one CSV"), ([("a.csv", ""), ("b.csv", "")], "one CSV")]:
        with pytest.raises(ValueError, match=reason):
            exclusions.unpack(spark, zipped(tmp_path / "m.zip", members), str(tmp_path))
