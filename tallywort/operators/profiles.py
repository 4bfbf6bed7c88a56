"""Business profiles: the algebra of their URLs, addresses in running text, complaint dates, and display states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywort.functions.text import blank, clean_text
from tallywort.functions.urls import logical_url

#: Fixed value: the form of profile paths.
PROFILE = r"(?i)^https?://[^/]+(/us/[a-z]{2}/[^/]+/profile/[^/]+/[^/?#]+)"
#: What ends an American address: a comma, two capitals and a ZIP.
STATE_AND_ZIP = r", *([A-Z][A-Z]) +([0-9]{5}(?:-[0-9]{4})?)(?![0-9-])"
MAX_METADATA = 50
STALE_HOURS = 48


def profile_base(url: Column) -> Column:
    """A profile's URL without query, address id, complaints and reviews."""
    plain = F.regexp_replace(logical_url(url), r"/+$", "")
    plain = F.regexp_replace(plain, r"(?i)/addressId/[^/]+", "")
    return F.regexp_replace(plain, r"(?i)/(?:complaints|customer-reviews)$", "")


def complaints_url(url: Column) -> Column:
    return F.concat(profile_base(url), F.lit("/complaints"))


def is_profile(url: Column) -> Column:
    return blank(url).rlike(PROFILE)


def is_complaints(url: Column) -> Column:
    return logical_url(url).rlike(r"(?i)/profile/[^/]+/[^/?#]+/complaints/?$")


def name_from_slug(url: Column) -> Column:
    """A business's name as its profile's last path part spells it, without the number at its end."""
    last = F.element_at(F.split(profile_base(url), "/"), -1)
    return F.initcap(F.replace(F.regexp_replace(last, r"(?:-\d+)+$", ""), F.lit("-"), F.lit(" ")))


def address_in(text: Column) -> Column:
    """(address, city, state, zip) around the first state and ZIP in a text. Read backwards from there: the words after
    the last comma are the city; the street is what the part before it says from its last number with words after it
    on. Without that comma, the street is a number and the word after it, and the rest is the city."""
    t = clean_text(text)
    parts = F.split(F.split(t, STATE_AND_ZIP, 2)[0], ",")
    last, before = F.trim(F.element_at(parts, -1)), F.trim(F.coalesce(F.get(parts, F.size(parts) - 2), F.lit("")))
    street = F.regexp_extract(before, r"^(?:.* )?([0-9]{1,8} +[^0-9 ].*)$", 1)
    joint = r"^(?:.* )?([0-9]{1,8} +[^ ]+) +([A-Za-z][A-Za-z .'-]*)$"
    city = F.trim(F.regexp_extract(last, r"([A-Za-z .'-]*)$", 1))
    is_joint = (street == "") & last.rlike(joint)
    found = t.rlike(STATE_AND_ZIP)
    pick = lambda c: F.when(found, c).otherwise("")
    return F.struct(
        pick(F.when(is_joint, F.regexp_extract(last, joint, 1)).otherwise(street)).alias("address"),
        pick(F.when(is_joint, F.regexp_extract(last, joint, 2)).otherwise(city)).alias("city"),
        F.regexp_extract(t, STATE_AND_ZIP, 1).alias("state"), F.regexp_extract(t, STATE_AND_ZIP, 2).alias("zip"),
    )


def complaint_metadata(complaints: DataFrame, key: str) -> DataFrame:
    """(key, metadata): distinct (date, type, status) of complaints, MAX_METADATA at most as the report has it; no narratives."""
    one = F.struct("date", "type", "status")
    return complaints.groupBy(key).agg(F.slice(F.array_sort(F.collect_set(one)), 1, MAX_METADATA).alias("metadata"))


def most_complete(candidates: DataFrame, key: str, parts: list[str]) -> DataFrame:
    """A key's candidate with most location parts, the later of equals (by place)."""
    filled = sum((F.when(blank(F.col(c)) != "", 1).otherwise(0) for c in parts), F.lit(0))
    rest = [c for c in candidates.columns if c not in (key, "place")]
    best = candidates.withColumn("_n", filled).groupBy(key).agg(F.max(F.struct("_n", "place", *rest)).alias("b"))
    return best.select(key, *(F.col(f"b.{c}").alias(c) for c in ("place", *rest)))


def evidence_state(extra: Column, active: Column) -> Column:
    """How evidence is shown: as its source states it, else incomplete, ambiguous, inactive or complete."""
    said = [F.nullif(F.element_at(extra, F.lit(k)), F.lit("")) for k in ("collection_state", "result_state", "source_state", "status")]
    flag = lambda k, v: F.coalesce(F.element_at(extra, F.lit(k)) == v, F.lit(False))
    match = F.lower(F.coalesce(F.element_at(extra, F.lit("match_status")), F.element_at(extra, F.lit("identity_status")), F.lit("")))
    derived = F.when(flag("complete", "false") | flag("incomplete", "true"), "incomplete").when(match.contains("ambig"), "ambiguous").when(~active, "inactive").otherwise("complete")
    return F.coalesce(*said, derived)


def is_stale(retrieved: Column, now: Column, hours: int = STALE_HOURS) -> Column:
    """Whether an artifact is too old to conclude anything from."""
    return retrieved.isNull() | (now > retrieved + F.make_interval(hours=F.lit(hours)))


def in_display_order(sources: DataFrame, built_in: list[str]) -> DataFrame:
    """Sources with the built-in ones first, in their order, then the others by id."""
    rank = F.lit(len(built_in))
    for i, name in enumerate(built_in):
        rank = F.when(F.col("name") == name, i).otherwise(rank)
    return sources.orderBy(rank, "id")
