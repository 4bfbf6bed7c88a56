"""Runs: job states, recovery, the frontier, scheduling, integrity and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Job states, and where each may go.
TRANSITIONS = {
    "queued": ["running", "failed", "cancelled", "interrupted"],
    "running": ["partial", "completed", "failed", "cancelled", "interrupted"],
    "partial": [],
    "completed": [],
    "failed": [],
    "cancelled": [],
    "interrupted": [],
}
MAX_ATTEMPTS = 3


def legal(old: Column, new: Column) -> Column:
    """Whether a job may go from one state to another; staying is always legal."""
    table = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    return (old == new) | F.coalesce(F.array_contains(table[old], new), F.lit(False))


def moved(jobs: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """The jobs after requested changes (id, state), with rejected where a change isn't legal."""
    j = jobs.join(changes.select("id", F.col("state").alias("_to")), "id", "left")
    ok = legal(F.col("state"), F.col("_to"))
    going = F.col("_to").isNotNull() & ok
    ends = F.col("_to").isin(*(k for k, v in TRANSITIONS.items() if not v))
    return (
        j.withColumn("rejected", F.col("_to").isNotNull() & ~ok)
        .withColumn("started_at", F.when(going & (F.col("_to") == "running"), F.coalesce("started_at", now)).otherwise(F.col("started_at")))
        .withColumn("finished_at", F.when(going & ends, F.coalesce("finished_at", now)).otherwise(F.col("finished_at")))
        .withColumn("state", F.when(going, F.col("_to")).otherwise(F.col("state"))).drop("_to")
    )


def recovered(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(jobs with those under way interrupted, children to queue): a child for each interrupted job that has none
    yet and attempts left, with its selection."""
    now_interrupted = jobs.withColumn("state", F.when(F.col("state").isin("queued", "running"), "interrupted").otherwise(F.col("state")))
    parents = now_interrupted.where((F.col("state") == "interrupted") & (F.col("attempt_no") < MAX_ATTEMPTS))
    have = jobs.where("parent_job_id is not null").select(F.col("parent_job_id").alias("id")).distinct()
    children = parents.join(have, "id", "left_anti").select(F.col("id").alias("parent_job_id"), "source_id", "selection", (F.col("attempt_no") + 1).alias("attempt_no"), F.lit("queued").alias("state"))
    return now_interrupted, children


def add_to_frontier(frontier: DataFrame, found: DataFrame) -> DataFrame:
    """The frontier with new URLs queued; known ones stay as they are."""
    new = found.select("job_id", "url").distinct().join(frontier.select("job_id", "url"), ["job_id", "url"], "left_anti")
    return frontier.unionByName(new.withColumn("state", F.lit("queued")), allowMissingColumns=True)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Counts by value, and of all as the row of null."""
    return df.rollup(column).agg(F.count("*").alias("n"))


def due(sources: DataFrame, now: Column) -> DataFrame:
    """Sources whose interval has passed since their last run, or that never ran."""
    return sources.where(F.col("last_run").isNull() | (now >= F.col("last_run") + F.make_interval(mins=F.col("interval_minutes"))))


def circuit(attempts: DataFrame) -> DataFrame:
    """(source_id, open): whether a source has blocked an attempt, so that no more are made."""
    return attempts.groupBy("source_id").agg(F.bool_or(F.col("category").isin("access_block", "challenge")).alias("open"))


def first_failure(diagnostics: DataFrame) -> DataFrame:
    """(job_id, message): a job's first error, which becomes its message."""
    return diagnostics.where("level = 'ERROR'").groupBy("job_id").agg(F.min_by("message", "id").alias("message"))


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference leads nowhere."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias(key)).distinct(), key, "left_anti")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def delete_cascade(sources: DataFrame, gone: DataFrame, *children: DataFrame) -> list[DataFrame]:
    """The sources and their dependent tables (with source_id) without the sources gone (id)."""
    ids = gone.select("id").distinct()
    return [sources.join(ids, "id", "left_anti"), *(c.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_anti") for c in children)]


def ensured(current: DataFrame, desired: DataFrame, key: str) -> DataFrame:
    """Desired rows with action: create, update where a value differs, or keep."""
    values = [c for c in desired.columns if c != key]
    j = desired.join(current.select(key, *(F.col(c).alias(f"_{c}") for c in values), F.lit(True).alias("_known")), key, "left")
    differs = F.lit(False)
    for c in values:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
    return j.select(*desired.columns, F.when(F.col("_known").isNull(), "create").when(differs, "update").otherwise("keep").alias("action"))


def statistics(records: DataFrame, now: Column) -> DataFrame:
    """One row of counts: records, active ones, and those changed in the last day."""
    return records.agg(
        F.count("*").alias("records"), F.count(F.when(F.col("active"), 1)).alias("active"),
        F.count(F.when(F.col("last_changed") >= now - F.expr("INTERVAL 1 DAY"), 1)).alias("changed_24h"),
    )


def contiguous(members: DataFrame, place: str, done: str) -> DataFrame:
    """(cursor): how many members from the first on are done without a gap."""
    first_open = members.agg(F.min(F.when(~F.col(done), F.col(place))).alias("open"), F.max(place).alias("last"))
    return first_open.select(F.coalesce(F.col("open"), F.col("last") + 1, F.lit(0)).alias("cursor"))
