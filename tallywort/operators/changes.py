"""Change tracking over immutable snapshots: upserts with history, sightings, conflicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(current: DataFrame, incoming: DataFrame, keys: list[str], now: Column) -> tuple[DataFrame, DataFrame]:
    """The next snapshot of records, with outcome (new, updated, unchanged, unseen), and the history rows.

    current has keys, content_hash, payload, first_seen, last_seen, last_changed, active; incoming has keys,
    content_hash, payload; of incoming rows of equal keys the one of greatest (content_hash, payload) counts.
    One full outer join on the keys.
    """
    new = incoming.groupBy(*keys).agg(F.max(F.struct("content_hash", "payload")).alias("n")).select(*keys, F.col("n.content_hash").alias("n_hash"), F.col("n.payload").alias("n_payload"))
    j = current.join(new, keys, "full_outer")
    seen, known = F.col("n_hash").isNotNull(), F.col("content_hash").isNotNull()
    outcome = F.when(~seen, "unseen").when(~known, "new").when(F.col("n_hash") == F.col("content_hash"), "unchanged").otherwise("updated")
    j = j.withColumn("outcome", outcome)
    fresh = F.col("outcome").isin("new", "updated")
    snapshot = j.select(
        *keys, F.when(fresh, F.col("n_hash")).otherwise(F.col("content_hash")).alias("content_hash"), F.when(fresh, F.col("n_payload")).otherwise(F.col("payload")).alias("payload"),
        F.coalesce("first_seen", now).alias("first_seen"), F.when(seen, now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(fresh, now).otherwise(F.col("last_changed")).alias("last_changed"), (seen | F.coalesce("active", F.lit(False))).alias("active"), "outcome",
    )
    history = j.where(fresh).select(*keys, now.alias("changed_at"), F.when(F.col("outcome") == "updated", F.col("payload")).alias("old_payload"), F.col("n_payload").alias("new_payload"))
    return snapshot, history


def inactivate_unseen(records: DataFrame, seen: DataFrame, key: str, complete: bool, now: Column) -> DataFrame:
    """The records, those that a complete run didn't see inactive since now; an incomplete run changes nothing."""
    if not complete:
        return records
    marked = records.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    gone = F.col("_seen").isNull() & F.col("active")
    return marked.withColumn("inactive_since", F.when(gone, now).otherwise(F.col("inactive_since"))).withColumn("active", F.col("active") & F.col("_seen").isNotNull()).drop("_seen")


def replace_lineage(lineage: DataFrame, observed: DataFrame, page: list[str]) -> DataFrame:
    """Lineage with the observed pages' sets of records replaced."""
    return lineage.join(observed.select(*page).distinct(), page, "left_anti").unionByName(observed.distinct())


def touch(lineage: DataFrame, page: list[str], cached: DataFrame, job: Column) -> DataFrame:
    """Lineage in which pages served from the cache count as seen by the job."""
    hit = cached.select(*page).distinct().withColumn("_hit", F.lit(True))
    return lineage.join(hit, page, "left").withColumn("last_job", F.when(F.col("_hit"), job).otherwise(F.col("last_job"))).drop("_hit")


def conflicts(observed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n_versions): records that one run saw in different versions. Their run is partial."""
    n = observed.groupBy(*keys).agg(F.countDistinct("content_hash").alias("n_versions"))
    return n.where(F.col("n_versions") > 1)


def upsert_pages(cache: DataFrame, fetched: DataFrame, now: Column) -> DataFrame:
    """The fetch cache with new pages; a column that a fetch doesn't supply keeps its value."""
    keys = ["source_id", "url"]
    values = [c for c in cache.columns if c not in (*keys, "last_crawled_at")]
    new = fetched.select(*keys, *(F.col(c).alias(f"_{c}") if c in fetched.columns else F.lit(None).alias(f"_{c}") for c in values), F.lit(True).alias("_new"))
    j = cache.join(new, keys, "full_outer")
    return j.select(*keys, *(F.coalesce(f"_{c}", c).alias(c) for c in values), F.when(F.col("_new"), now).otherwise(F.col("last_crawled_at")).alias("last_crawled_at"))


def split_by_hash(cache: DataFrame, fetched: DataFrame) -> DataFrame:
    """Fetched pages with action: replay (not modified or equal content), or parse."""
    old = cache.select("source_id", "url", F.col("content_hash").alias("_hash"))
    j = fetched.join(old, ["source_id", "url"], "left")
    same = (F.col("status") == 304) | (F.col("content_hash") == F.col("_hash"))
    return j.withColumn("action", F.when(F.coalesce(same, F.lit(False)) & F.col("_hash").isNotNull(), "replay").otherwise("parse")).drop("_hash")
