"""Search, paging, cursors and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywort.functions.text import ascii_fold, blank

from .graph import numbered
from .schema import ADDRESS_COLUMNS, COLUMNS, COMPLIANCE_COLUMNS

EXPORT_LIMIT = 250_000
EVENTS_KEPT = 5_000
RECORD_COLUMNS = ["name", "company", "owner", "phone", "address", "location", "osha_status", "osha_details", "date", "external_id", "source_url"]


def matches(query: str, columns: list[str]) -> Column:
    """Whether any of the columns holds the query literally, A-Z in either case; all rows for the empty query."""
    if not query:
        return F.lit(True)
    folded = ascii_fold(F.lit(query))
    out = F.lit(False)
    for c in columns:
        out = out | ascii_fold(blank(F.col(c))).contains(folded)
    return out


def master_columns(field: str) -> list[str]:
    """The stored columns that a search field stands for."""
    stored = ["bidder_id", *COLUMNS[1:]]
    groups = {"all": stored, "contractor": stored[:3], "address": ADDRESS_COLUMNS, "compliance": COMPLIANCE_COLUMNS}
    if field in groups:
        return groups[field]
    if field in COLUMNS:
        return ["bidder_id" if field == "id" else field]
    raise ValueError("unknown search field")


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page in a total order. limit + offset rows are kept by each task, not the whole table."""
    return df.orderBy(*order).offset(offset).limit(limit)


def deep_page(df: DataFrame, order: list[Column], limit: int, offset: int) -> DataFrame:
    """One page far into a total order: only the ranges of rows that hold it are sorted, and no task keeps what lies before."""
    return numbered(df, "_number", order, between=(offset, offset + limit)).orderBy("_number").drop("_number")


def search(df: DataFrame, query: str, columns: list[str], order: list[Column], limit: int, offset: int = 0) -> tuple[int, DataFrame]:
    """(number of hits, one page of them)."""
    hits = df.where(matches(query, columns))
    return hits.count(), page(hits, order, limit, offset)


def search_master(master: DataFrame, query: str = "", field: str = "all", limit: int = 100, offset: int = 0) -> tuple[int, DataFrame]:
    return search(master, query, master_columns(field), [ascii_fold(F.col("contractor_name")), F.col("pk")], limit, offset)


def search_records(records: DataFrame, query: str = "", field: str | None = None, status: str | None = None, source_id: int | None = None, limit: int = 100, offset: int = 0) -> tuple[int, DataFrame]:
    """Records that match, the last changed first."""
    if field is not None and field not in RECORD_COLUMNS:
        raise ValueError("unknown search field")
    if status is not None and status not in ("unknown", "open", "closed", "none_reported"):
        raise ValueError("unknown status")
    some = records if source_id is None else records.where(F.col("source_id") == source_id)
    some = some if status is None else some.where(F.col("osha_status") == status)
    return search(some, query, [field] if field else RECORD_COLUMNS, [F.desc("last_changed"), F.desc("id")], limit, offset)


def exportable(df: DataFrame, limit: int = EXPORT_LIMIT) -> DataFrame:
    """The table, if it isn't larger than an export may be: an error, never a truncation."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows; narrow the search")
    return df


def read_after(events: DataFrame, after: int, limit: int, key: str = "id") -> tuple[DataFrame, int, bool]:
    """(rows, newest key, whether the cursor is ahead of all rows and must start anew). after > 0 reads forward from
    it; else the newest rows in ascending order."""
    latest = events.agg(F.coalesce(F.max(key), F.lit(0))).first()[0]
    if after > 0:
        return events.where(F.col(key) > after).orderBy(key).limit(limit), latest, after > latest
    return tail(events, limit, key), latest, False


def tail(events: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The newest rows, oldest of them first."""
    return events.orderBy(F.desc(key)).limit(limit).orderBy(key)


def retained(events: DataFrame, kept: int = EVENTS_KEPT, key: str = "id") -> DataFrame:
    """Events whose id is within kept of the newest."""
    newest = events.agg(F.max(key).alias("_newest"))
    return events.join(F.broadcast(newest), F.col(key) > F.col("_newest") - kept).drop("_newest")  # one row


def changed_within(records: DataFrame, changed: str, interval: str) -> DataFrame:
    """Records that changed within an interval of the last change of all."""
    newest = records.agg(F.max(changed).alias("_newest"))
    return records.join(F.broadcast(newest), F.col(changed) >= F.col("_newest") - F.expr(interval)).drop("_newest")  # one row


def latest_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """A key's row of highest order: one aggregate with partial maxima, no sort."""
    return df.groupBy(key).agg(F.max(F.struct(order, *[c for c in columns if c != order])).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in columns))


def first_per_key(df: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.min(F.struct(order, *[c for c in columns if c != order])).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in columns))


def activity(events: DataFrame, level: str | None = None, text: str = "") -> DataFrame:
    """Log events of a level (ERROR includes CRITICAL) that hold a text in message, details or job."""
    some = events
    if level:
        some = some.where(F.col("level").isin("ERROR", "CRITICAL") if level == "ERROR" else F.col("level") == level)
    return some.where(F.lower(F.concat_ws(" ", "message", "details", F.col("job_id").cast("string"))).contains(text.lower())) if text else some
