"""Joins of rows with their sources, pages and terms, and lookups by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNKNOWN_SOURCE = "Unknown source"


def with_source(rows: DataFrame, sources: DataFrame, columns: list[str], key: str = "source_id") -> DataFrame:
    """Rows that have a source, with columns of it. sources: id and these."""
    return rows.join(sources.select(F.col("id").alias(key), *columns), key)


def with_source_name(rows: DataFrame, sources: DataFrame, key: str = "source_id") -> DataFrame:
    """All rows with their source's name as source_name, or that it is unknown."""
    named = sources.select(F.col("id").alias(key), F.col("name").alias("source_name"))
    return rows.join(named, key, "left").withColumn("source_name", F.coalesce("source_name", F.lit(UNKNOWN_SOURCE)))


def on_page(page_records: DataFrame, records: DataFrame, columns: list[str]) -> DataFrame:
    """Records that pages hold: (page_id, record_id) with columns of the record."""
    return page_records.select("page_id", "record_id").join(records.select(F.col("id").alias("record_id"), *columns), "record_id")


def among(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table holds."""
    return rows.join(keys.select(key), key, "left_semi")


def without(rows: DataFrame, children: DataFrame, key: str) -> DataFrame:
    """Rows whose key the other table doesn't hold."""
    return rows.join(children.select(key), key, "left_anti")


def looked_up(rows: DataFrame, table: DataFrame, by: str, into: str, value: str = "id") -> DataFrame:
    """Rows whose text key the table holds, with the value there; keys are unique in the table, and rows without one drop."""
    return rows.join(table.select(by, F.col(value).alias(into)), by)


def by_term(rows: DataFrame, owner: str, term: str) -> DataFrame:
    """(term, owner): who a search for a term is made for, each once; empty terms are for no one."""
    return rows.where(F.col(term) != "").select(F.col(term).alias("term"), owner).distinct()


def answered(answers: DataFrame, terms: DataFrame, owner: str) -> DataFrame:
    """Answers to searches, once for each owner of their term."""
    return answers.join(terms.select("term", owner), "term")


def point(df: DataFrame, key: str, value: object) -> DataFrame:
    """The row of a key."""
    return df.where(F.col(key) == F.lit(value)).limit(1)


def history(df: DataFrame, key: str, value: object, order: str = "id", limit: int = 100) -> DataFrame:
    """A key's newest rows, newest first."""
    return df.where(F.col(key) == F.lit(value)).orderBy(F.desc(order)).limit(limit)


def evidence(rows: DataFrame, key: str, item: list[str], limit: int | None = None) -> DataFrame:
    """(key, evidence): a key's distinct items in order, at most so many where a report shows so many."""
    items = F.array_sort(F.collect_set(F.struct(*item)))
    return rows.groupBy(key).agg((items if limit is None else F.slice(items, 1, limit)).alias("evidence"))
