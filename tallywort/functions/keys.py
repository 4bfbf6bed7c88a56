"""Stable keys and digests: entity keys, content hashes and proposal signatures.

All are SHA-256 over a JSON text of fields in fixed order; they are stable here, not equal to other systems'.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import blank, clean_text

HASHED = ["name", "company", "owner", "phone", "address", "location", "osha_status", "osha_details", "date", "external_id"]
#: Members of extra that tell where a record came from, not what it says.
PROVENANCE = ["raw_text", "extraction", "jsonld_type", "collected_from_url"]


def _digest(*parts: Column) -> Column:
    return F.sha2(F.to_json(F.array(*(blank(p) for p in parts))), 256)


def entity_key(bidder_id: Column, external_id: Column, url: Column, name: Column, company: Column, owner: Column, address: Column) -> Column:
    """Who a record is about: by bidder id, external id, name, owner, address or page, the first that is there."""
    b, e, n, c, o, a = (clean_text(x) for x in (bidder_id, external_id, name, company, owner, address))
    return (
        F.when(b != "", _digest(F.lit("bidder"), b)).when(e != "", _digest(F.lit("id"), e))
        .when((n != "") | (c != ""), _digest(F.lit("named"), url, F.lower(n), F.lower(c)))
        .when(o != "", _digest(F.lit("owner"), url, F.lower(o))).when(a != "", _digest(F.lit("address"), url, F.lower(a)))
        .otherwise(_digest(F.lit("url"), url))
    )


def record_hash(fields: list[Column], extra: Column | None = None) -> Column:
    """What a record says, whatever its provenance. extra is a map of texts."""
    parts = [blank(f) for f in fields]
    if extra is not None:
        kept = F.map_filter(extra, lambda k, _: ~k.isin(PROVENANCE))
        parts.append(F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept)))), F.lit("{}")))
    return _digest(*parts)


def signature(master: Column, record: Column, kind: Column, field: Column, value: Column) -> Column:
    """What a proposal would change, whatever the value it replaces."""
    return _digest(master, record, kind, field, value)
