"""Per-contractor findings: three-valued flags from evidence.

A flag is Y, N or empty for unknown. Absence of evidence is unknown unless the collection was complete and
nothing is ambiguous; sources that list only offenders never give N.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywort.functions.text import blank, match_text, year_of

#: Citation types that are severe, and marks of deletion.
SEVERE = ["s", "serious", "w", "willful", "r", "repeat", "repeated"]
DELETED = ["X", "Y", "1", "TRUE", "DELETED"]
DAY = "M/d/yyyy"


def is_severe(kind: Column) -> Column:
    return match_text(kind).isin(SEVERE)


def is_deleted(mark: Column) -> Column:
    return F.upper(F.trim(blank(mark))).isin(DELETED)


def yes_no_unknown(found: Column, ambiguous: Column, complete: Column) -> Column:
    """Y if found; unknown if something is ambiguous or the collection is incomplete; else N."""
    sure = lambda c: F.coalesce(c, F.lit(False))
    return F.when(sure(found), "Y").when(sure(ambiguous) | ~sure(complete), "").otherwise("N")


def yes_unknown(found: Column) -> Column:
    """Y if found, else unknown."""
    return F.when(F.coalesce(found, F.lit(False)), "Y").otherwise("")


def inspections(contractors: DataFrame, inspected: DataFrame, violations: DataFrame, ambiguous: DataFrame, complete: DataFrame) -> DataFrame:
    """(owner, osha, osha_severe_violations, years, latest, n_inspections).

    inspected: owner, activity_nr, open_date. violations: activity_nr, citation_id, viol_type, delete_flag,
    issuance_date, seq; of equal (activity_nr, citation_id) the one of highest seq counts. ambiguous: owner.
    complete: owner, complete. Severe citations without a year take their inspection's. Everything is aggregated
    by activity, then by owner.
    """
    visits = inspected.groupBy("owner", "activity_nr").agg(F.max("open_date").alias("open_date"))
    last = violations.groupBy("activity_nr", "citation_id").agg(F.max(F.struct("seq", "viol_type", "delete_flag", "issuance_date")).alias("v"))
    severe = last.where(is_severe(F.col("v.viol_type")) & ~is_deleted(F.col("v.delete_flag")))
    counted = (
        severe.join(visits, "activity_nr")
        .withColumn("year", F.coalesce(F.nullif(year_of(F.col("v.issuance_date")), F.lit("")), year_of(F.col("open_date"))))
        .groupBy("owner").agg(F.count("*").alias("n_severe"), F.collect_set(F.nullif("year", F.lit(""))).alias("year_set"))
    )
    seen = visits.groupBy("owner").agg(F.count("*").alias("n_inspections"), F.max("open_date").alias("latest"))
    doubt = ambiguous.select("owner").distinct().withColumn("doubt", F.lit(True))
    whole = complete.groupBy("owner").agg(F.bool_and("complete").alias("complete"))
    all_ = contractors.select("owner").distinct()
    for part in (seen, counted, doubt, whole):
        all_ = all_.join(part, "owner", "left")
    found, sure = F.col("n_inspections").isNotNull(), F.coalesce("complete", F.lit(False)) & F.col("doubt").isNull()
    return all_.select(
        "owner", yes_no_unknown(found, F.col("doubt"), F.col("complete")).alias("osha"),
        F.when(found & sure, F.coalesce("n_severe", F.lit(0)).cast("string")).otherwise("").alias("osha_severe_violations"),
        F.when(found & sure, F.array_join(F.array_sort(F.coalesce("year_set", F.array().cast("array<string>"))), ", ")).otherwise("").alias("years"),
        F.coalesce("latest", F.lit("")).alias("latest"), F.coalesce("n_inspections", F.lit(0)).alias("n_inspections"),
    )


def exclusions(contractors: DataFrame, matches: DataFrame) -> DataFrame:
    """(owner, state_federal_debarment, date, n): Y or unknown, with the latest activation date as text."""
    found = matches.groupBy("owner").agg(F.count("*").alias("n"), F.max("activation_date").alias("date"))
    both = contractors.select("owner").distinct().join(found, "owner", "left")
    return both.select("owner", yes_unknown(F.col("n") > 0).alias("state_federal_debarment"), blank(F.col("date")).alias("date"), F.coalesce("n", F.lit(0)).alias("n"))


def complaints(contractors: DataFrame, profiles: DataFrame, ambiguous: DataFrame, complete: DataFrame) -> DataFrame:
    """(owner, better_business_bureau_complaints). profiles: owner, total (null if not parsed)."""
    p = profiles.groupBy("owner").agg(
        F.count("*").alias("n"), F.bool_or(F.coalesce(F.col("total") > 0, F.lit(False))).alias("positive"), F.bool_and(F.col("total").isNotNull()).alias("parsed")
    )
    doubt = ambiguous.select("owner").distinct().withColumn("doubt", F.lit(True))
    whole = complete.groupBy("owner").agg(F.bool_and("complete").alias("complete"))
    j = contractors.select("owner").distinct().join(p, "owner", "left").join(doubt, "owner", "left").join(whole, "owner", "left")
    sure = F.coalesce("complete", F.lit(False)) & F.coalesce("parsed", F.lit(False))
    flag = F.when(sure & F.col("positive"), "Y").when(sure & (F.col("n") > 0) & F.col("doubt").isNull(), "N").otherwise("")
    return j.select("owner", flag.alias("better_business_bureau_complaints"))


def listed(contractors: DataFrame, candidates: DataFrame) -> DataFrame:
    """(owner, state_federal_debarment) of offender lists. candidates: owner, confirmed, active."""
    hit = candidates.groupBy("owner").agg(F.bool_or(F.col("confirmed") & F.coalesce("active", F.lit(False))).alias("hit"))
    return contractors.select("owner").distinct().join(hit, "owner", "left").select("owner", yes_unknown(F.col("hit")).alias("state_federal_debarment"))


def active_between(start: Column, end: Column, today: Column) -> Column:
    """True within a closed interval, false outside, null if a bound is missing or the interval is reversed."""
    return F.when(start <= end, (start <= today) & (today <= end))


def active_on(intervals: DataFrame, key: str, today: Column) -> DataFrame:
    """(key, active) over texts start and end in m/d/yyyy: true if any interval holds today, else null if any is
    malformed or reversed, else false. Intervals without both bounds say nothing."""
    stated = intervals.where((blank(F.col("start")) != "") | (blank(F.col("end")) != ""))
    day = lambda c: F.try_to_timestamp(F.col(c), F.lit(DAY)).cast("date")
    one = stated.select(key, active_between(day("start"), day("end"), today).alias("a"))
    folded = one.groupBy(key).agg(F.bool_or("a").alias("any"), F.bool_or(F.col("a").isNull()).alias("unclear"))
    active = F.when(F.coalesce("any", F.lit(False)), True).when(F.col("unclear"), F.lit(None).cast("boolean")).otherwise(False)
    return intervals.select(key).distinct().join(folded.select(key, active.alias("active"), F.lit(True).alias("stated")), key, "left").select(
        key, F.when(F.col("stated"), F.col("active")).otherwise(F.lit(False)).alias("active")
    )


def open_ended_active(effective: Column, termination: Column, today: Column) -> Column:
    """As active_between over texts, where the end may be Indefinite."""
    start, end = (F.try_to_timestamp(c, F.lit(DAY)).cast("date") for c in (effective, termination))
    return F.when(start.isNull(), F.lit(None).cast("boolean")).when(start > today, False).when(F.lower(termination) == "indefinite", True).otherwise(today <= end)


def complete_runs(runs: DataFrame) -> DataFrame:
    """(owner, complete): no limit hit, no errors, all pages seen."""
    return runs.groupBy("owner").agg(F.bool_and(~F.col("limited") & (F.col("errors") == 0)).alias("complete"))
