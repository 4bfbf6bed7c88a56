"""The daily exclusions extract: listing, archive and rows, all validated before anything is believed."""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterable, Iterator
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywort.functions.text import LOWER, UPPER
from tallywort.operators.store import Files

#: Headers by field, and values of a record's status.
HEADERS = {
    "exclusion_identifier": ["Exclusion ID", "Exclusion Identifier", "SAM Number"],
    "classification": ["Classification", "Classification Type"],
    "entity_name": ["Name", "Entity Name"],
    "record_status": ["Record Status", "Active Status", "Status"],
    "aliases": ["Aliases", "Alias"],
    "uei": ["UEI", "UEI SAM", "Unique Entity ID"],
    "cage_code": ["CAGE Code", "CAGE"],
    "address_1": ["Address 1", "Address Line 1"],
    "address_2": ["Address 2", "Address Line 2"],
    "city": ["City"],
    "state": ["State", "State / Province", "State Or Province Code"],
    "zip": ["ZIP", "ZIP Code", "Postal Code"],
    "country": ["Country", "Country Code"],
    "exclusion_type": ["Exclusion Type"],
    "exclusion_program": ["Exclusion Program"],
    "agency": ["Excluding Agency", "Excluding Agency Name", "Agency"],
    "activation_date": ["Active Date", "Activation Date"],
    "termination_date": ["Termination Date"],
}
REQUIRED = ["exclusion_identifier", "classification", "entity_name", "record_status"]
ACTIVE = ["active", "a", "yes", "y", "true", "1"]
INACTIVE = ["inactive", "terminated", "expired", "no", "n", "false", "0"]
MAX_COMPRESSED, MAX_UNCOMPRESSED = 512 * 2**20, 2 * 2**30


def header_key(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", name.lower()).strip()


def fields_of(header: list[str]) -> dict[str, str]:
    """Field to header; an error for empty, repeated or ambiguous headers and missing required fields."""
    keys = [header_key(h) for h in header]
    if not all(keys) or len(set(keys)) < len(keys):
        raise ValueError("empty or repeated headers")
    known = {header_key(n): f for f, names in HEADERS.items() for n in names}
    out: dict[str, str] = {}
    for h, k in zip(header, keys, strict=True):
        if k in known:
            if known[k] in out:
                raise ValueError(f"several headers for {known[k]}")
            out[known[k]] = h
    if missing := [f for f in REQUIRED if f not in out]:
        raise ValueError("missing fields: " + ", ".join(missing))
    return out


def csv_member(members: Iterable[tuple[str, int]], most: int = MAX_UNCOMPRESSED) -> str:
    """The archive's one CSV, of members (name, size); an error for unsafe or repeated names, archives within, and sizes
    above most. Members are asked for one by one, so that an error ends the reading."""
    seen, total, found = set(), 0, []
    for said, size in members:
        name = said.replace("\\", "/")
        path = PurePosixPath(name)
        if not name or path.is_absolute() or ".." in path.parts or "\0" in name:
            raise ValueError("unsafe path in the archive")
        if name.casefold() in seen:
            raise ValueError("repeated name in the archive")
        seen.add(name.casefold())
        total += size
        if total > most:
            raise ValueError("the archive is too large")
        if path.suffix.lower() in (".zip", ".gz", ".7z", ".tar"):
            raise ValueError("an archive within the archive")
        if path.suffix.lower() == ".csv":
            found.append(said)
    if len(found) != 1:
        raise ValueError("the archive must hold one CSV")
    return found[0]


def unpack(spark: SparkSession, zip_path: str, folder: str, most: int = MAX_UNCOMPRESSED) -> str:
    """Extract the checked CSV into a folder; returns its path. Both lie on any of Spark's file systems. The archive is one
    file, so one JVM streams it: once to check what it holds, whatever sizes it declares, and once to copy the CSV."""
    jvm, files = spark.sparkContext._jvm, Files(spark, zip_path)
    copy = jvm.org.apache.commons.io.IOUtils.copyLarge

    def entries() -> Iterator[tuple[str, object]]:
        stream = jvm.java.util.zip.ZipInputStream(files.fs.open(files.path(zip_path)))
        try:
            while (entry := stream.getNextEntry()) is not None:
                yield entry.getName(), stream
        finally:
            stream.close()

    nowhere = jvm.java.io.OutputStream.nullOutputStream()
    chosen = csv_member(((name, copy(stream, nowhere, 0, most + 1)) for name, stream in entries()), most)
    target = f"{folder.rstrip('/')}/{PurePosixPath(chosen.replace(chr(92), '/')).name}"
    place = Files(spark, folder)
    for name, stream in entries():
        if name == chosen:
            out = place.fs.create(place.path(target), True)
            try:
                copy(stream, out)
            finally:
                out.close()
            break
    return target


def read_exclusions(spark: SparkSession, path: str) -> DataFrame:
    """Rows of an extracted CSV by field, with active. Ragged rows and unknown statuses are errors, as is an empty file;
    nothing is guessed."""
    first = spark.read.text(path).first()
    if first is None:
        raise ValueError("the extract is empty")
    header = next(csv.reader(io.StringIO(first["value"].removeprefix("﻿"))))
    fields = fields_of(header)
    schema = ", ".join(f"`{h}` string" for h in header)
    raw = spark.read.csv(path, schema=schema, header=True, multiLine=True, escape='"', mode="FAILFAST", enforceSchema=True)
    rows = raw.select(*(F.coalesce(F.trim(F.col(f"`{h}`")), F.lit("")).alias(f) for f, h in fields.items()))
    status = F.translate("record_status", UPPER, LOWER)
    active = F.when(status.isin(ACTIVE), True).when(status.isin(INACTIVE), False).otherwise(F.raise_error(F.concat(F.lit("unknown record status: "), "record_status")).cast("boolean"))
    out = rows.withColumn("active", active)
    if not out.take(1):
        raise ValueError("the extract has no rows")
    return out


def newest_artifact(listing: DataFrame) -> DataFrame:
    """The newest usable file of a listing (path, fileName, publicationTimestamp, size, contentType, url): one row."""
    name = F.lower(F.concat_ws("/", "path", "fileName"))
    ending = F.lower(F.regexp_extract("fileName", r"(\.[A-Za-z0-9]+)$", 1))
    kind = F.lower(F.coalesce("contentType", F.lit("")))
    fits = F.when(ending == ".zip", kind.rlike("zip|octet-stream")).when(ending == ".csv", kind.rlike("csv|text/plain|octet-stream")).otherwise(False) | ((kind == "") & ending.isin(".zip", ".csv"))
    stamp = parse_time(F.col("publicationTimestamp"))
    size = F.coalesce(F.col("size").try_cast("long"), F.lit(0))
    ok = name.contains("public v2") & ~name.contains("histor") & ~name.contains("fascsa") & fits & stamp.isNotNull() & size.between(0, MAX_COMPRESSED) & (F.coalesce("url", F.lit("")) != "")
    return listing.where(ok).withColumn("published", stamp).orderBy(F.desc("published"), F.desc(F.lower("fileName"))).limit(1)


def parse_time(c: Column) -> Column:
    """A time in ISO or mail form, UTC where none is named; null if neither."""
    iso = F.regexp_replace(c, "Z$", "+00:00")
    forms = ["yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]XXX", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS]", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "EEE, d MMM yyyy HH:mm:ss Z"]
    return F.coalesce(*(F.try_to_timestamp(F.regexp_replace(iso, "GMT$", "+0000"), F.lit(f)) for f in forms[:4]), F.try_to_timestamp(F.regexp_replace(F.regexp_replace(c, "GMT$", "+0000"), r"^[A-Za-z]{3}, ", ""), F.lit("d MMM yyyy HH:mm:ss Z")))
