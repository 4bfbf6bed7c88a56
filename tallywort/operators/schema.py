"""The master table's columns, who owns them, and the projections between evidence and master rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywort.functions import urls
from tallywort.functions.text import blank, clean_text, inspection_status, iso_date, location_parts, match_text, phone

#: The business columns of the master, in order.
COLUMNS = [
    "id",
    "contractor_name",
    "related_companies",
    "address_1",
    "city",
    "state",
    "zip",
    "additional_address",
    "additional_address_city",
    "additional_address_state",
    "additional_address_zip",
    "dfi",
    "wc",
    "wc_date",
    "osha_severe_violations",
    "years",
    "osha",
    "state_federal_debarment",
    "mndol_ineligibility",
    "public_works_projects_budget_time_quality_complaint",
    "federal_court",
    "circuit_court",
    "ccap_show150",
    "environmental_violations",
    "prevailing_wage_violations",
    "dwd",
    "dwd_substance_abuse_plan",
    "better_business_bureau_complaints",
    "misc_violations",
    "tax_liability",
]
ADDRESS_COLUMNS = COLUMNS[3:11]
COMPLIANCE_COLUMNS = COLUMNS[11:]

#: Hosts of the sources and the columns that each may change.
OWNERS = {
    "osha": (["apiprod.dol.gov", "api.dol.gov", "www.osha.gov"], ["osha", "osha_severe_violations", "years"]),
    "pacer": ([], ["federal_court"]),
    "sam": (["sam.gov", "www.sam.gov", "api.sam.gov", "api-alpha.sam.gov"], ["state_federal_debarment"]),
    "bbb": (["bbb.org", "www.bbb.org"], ["better_business_bureau_complaints"]),
    "vt": (["violationtracker.goodjobsfirst.org"], ["environmental_violations", "prevailing_wage_violations", "misc_violations"]),
    "state_mn": (["mn.gov"], ["state_federal_debarment"]),
    "state_il": (["labor.illinois.gov"], ["state_federal_debarment", "prevailing_wage_violations"]),
    "state_wi": (["wisconsindot.gov", "www.wisconsindot.gov"], ["state_federal_debarment"]),
}
ALPHA_HOST = "api-alpha.sam.gov"


def owned_fields(url: Column) -> Column:
    """The columns that the source at a URL may change; none for unknown hosts."""
    pairs = [x for hosts, fields in OWNERS.values() for h in hosts for x in (F.lit(h), F.array(*map(F.lit, fields)))]
    return F.coalesce(F.create_map(*pairs)[urls.host(url)], F.array().cast("array<string>"))


def field_sources(spark) -> DataFrame:
    """(field, sources): for every master column, the sources that own it."""
    rows = [(c, i, sorted(k for k, (_, fields) in OWNERS.items() if c in fields)) for i, c in enumerate(COLUMNS)]
    return spark.createDataFrame(rows, "field string, place int, sources array<string>")


def master_rows(df: DataFrame) -> DataFrame:
    """A stored master under its outside names: bidder_id as id, all business columns as texts without nulls."""
    have = set(df.columns)
    pick = lambda c: blank(F.col(c)) if c in have else F.lit("")
    cols = [pick("bidder_id" if "bidder_id" in have else "id").alias("id"), *(pick(c).alias(c) for c in COLUMNS[1:])]
    extra = [F.col("pk").alias("_master_id")] if "pk" in have else []
    return df.select(*cols, *extra, *(F.col(c).alias(f"_{c}") for c in ("updated_at", "source_import_id") if c in have))


def address_norm(address: Column, city: Column, state: Column, zip_code: Column) -> Column:
    return match_text(F.concat_ws(" ", *(blank(c) for c in (address, city, state, zip_code))))


def master_norms(df: DataFrame) -> DataFrame:
    """A master with the normal forms it is matched by."""
    address = address_norm(*(F.col(c) for c in ("address_1", "city", "state", "zip")))
    return df.withColumn("contractor_norm", match_text(F.col("contractor_name"))).withColumn("address_norm", address)


def canonical_records(df: DataFrame) -> DataFrame:
    """Evidence in canonical form: cleaned fields, company and address from the master columns it carries where it
    has none of its own, a location put together from their city, state and ZIP, and those columns as a map
    bidder_fields. An internal id is never taken for a bidder's."""
    have = set(df.columns)
    get = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    filled = lambda c: F.when(blank(get(c)) != "", F.trim(blank(get(c))))
    entries = F.map_from_entries(
        F.filter(
            F.array(*(F.struct(F.lit(c).alias("k"), filled("bidder_id" if c == "id" else c).alias("v")) for c in COLUMNS)),
            lambda e: e["v"].isNotNull(),
        )
    )
    pick = lambda a, b: F.coalesce(F.nullif(clean_text(get(a)), F.lit("")), clean_text(filled(b)))
    place = F.concat_ws(
        ", ", F.nullif(clean_text(filled("city")), F.lit("")),
        F.nullif(F.concat_ws(" ", F.nullif(clean_text(filled("state")), F.lit("")), F.nullif(clean_text(filled("zip")), F.lit(""))), F.lit("")),
    )
    status = clean_text(get("osha_status"))
    fields = {
        "name": clean_text(get("name")), "company": pick("company", "contractor_name"), "owner": clean_text(get("owner")), "phone": phone(get("phone")),
        "address": pick("address", "address_1"), "location": F.coalesce(F.nullif(clean_text(get("location")), F.lit("")), place),
        "osha_status": inspection_status(get("osha_status")),
        "osha_details": F.coalesce(F.nullif(clean_text(get("osha_details")), F.lit("")), F.when(status != "unknown", status).otherwise("")),
        "date": iso_date(get("date")), "external_id": clean_text(get("external_id")), "source_url": clean_text(get("source_url")),
        "bidder_fields": entries,
    }
    rest = [c for c in df.columns if c not in fields and c not in COLUMNS and c != "bidder_id"]
    return df.select(*rest, *(c.alias(n) for n, c in fields.items()))


def evidence_rows(df: DataFrame, fallback_id: bool = True) -> DataFrame:
    """Canonical evidence as master rows: its bidder fields first, then postal address (a map, if there is one),
    then its own fields. An inspection status sets the osha flag only where the source gave no flag."""
    have = set(df.columns)
    bidder = lambda c: F.nullif(F.trim(blank(F.element_at("bidder_fields", F.lit(c)))), F.lit(""))
    postal = lambda c: F.nullif(F.trim(blank(F.element_at("postal_address", F.lit(c)))), F.lit("")) if "postal_address" in have else F.lit(None).cast("string")
    own = lambda c: F.nullif(F.trim(blank(F.col(c))), F.lit("")) if c in have else F.lit(None).cast("string")
    parts = location_parts(F.col("location"))
    first = lambda *c: F.coalesce(*c, F.lit(""))
    special = {
        "id": first(bidder("id"), own("record_id") if fallback_id else F.lit(None).cast("string")),
        "contractor_name": first(bidder("contractor_name"), own("company"), own("name"), own("owner")),
        "address_1": first(bidder("address_1"), postal("streetAddress"), own("address")),
        "city": first(bidder("city"), postal("addressLocality"), parts["city"]),
        "state": first(bidder("state"), postal("addressRegion"), parts["state"]),
        "zip": first(bidder("zip"), postal("postalCode"), parts["zip"]),
        "osha": first(bidder("osha"), F.when(F.col("osha_status") == "none_reported", "N").when(F.col("osha_status").isin("open", "closed"), "Y")),
    }
    keep = [c for c in df.columns if c not in COLUMNS]
    return df.select(*keep, *(special.get(c, first(bidder(c))).alias(c) for c in COLUMNS))
