"""Field-level proposals: compare evidence with the master, list, apply, dismiss, supersede."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywort.functions.keys import signature
from tallywort.functions.text import blank, match_text, values_equal
from tallywort.functions.urls import host

from .schema import ALPHA_HOST, COLUMNS, owned_fields

STATUSES = ["pending", "applied", "dismissed", "superseded"]


def latest_status(proposals: DataFrame) -> DataFrame:
    """(signature, status): the latest decision on each signature."""
    return proposals.groupBy("signature").agg(F.max_by("status", "id").alias("status"))


def fresh_evidence(evidence: DataFrame, jobs: DataFrame) -> DataFrame:
    """Active evidence of sources that own fields, seen by the latest job of its source if that ended well. A test
    source's evidence never counts."""
    last = jobs.groupBy("source_id").agg(F.max(F.struct("id", "status")).alias("j"))
    usable = evidence.where(F.col("active") & (F.size(owned_fields(F.col("start_url"))) > 0) & (host(F.col("start_url")) != ALPHA_HOST) & (blank(F.col("environment")) != "alpha_test"))
    j = usable.join(last, "source_id", "left")
    return j.where(F.col("j").isNull() | (F.col("j.status").isin("completed", "partial") & (F.col("j.id") == F.col("job_id")))).drop("j")


def candidates(evidence: DataFrame, master: DataFrame) -> DataFrame:
    """The field changes that matched evidence supports: one row for each owned field with a value that differs.

    evidence: record_id, start_url, source_name, source_url, pk (of the matched master row), reason,
    complete_aggregate, and the business columns. N and 0 count only from a complete collection, and a debarment
    only as Y. Fields are unpivoted before the join, so that the master is read for the matched rows only.
    """
    fields = [c for c in COLUMNS if c in evidence.columns]
    pairs = F.array(*(F.struct(F.lit(c).alias("field_name"), F.trim(blank(F.col(c))).alias("new_value")) for c in fields))
    owned = owned_fields(F.col("start_url"))
    cells = (
        evidence.where("pk is not null").withColumn("_owned", owned)
        .select("pk", "record_id", "source_name", "source_url", "reason", "complete_aggregate", "_owned", F.inline(pairs))
        .where(F.array_contains("_owned", F.col("field_name")) & (F.col("new_value") != ""))
        .where(~F.col("new_value").isin("N", "0") | F.coalesce("complete_aggregate", F.lit(False)))
        .where((F.col("field_name") != "state_federal_debarment") | (F.col("new_value") == "Y"))
    )
    stored = F.create_map(*(x for c in fields for x in (F.lit(c), F.trim(blank(F.col("bidder_id" if c == "id" else c))))))
    j = cells.join(master.select("pk", stored.alias("_stored")), "pk")
    j = j.withColumn("old_value", F.element_at("_stored", F.col("field_name"))).where(~values_equal(F.col("old_value"), F.col("new_value")))
    sig = signature(F.col("pk"), F.col("record_id"), F.lit("field_update"), F.col("field_name"), F.col("new_value"))
    return j.select(
        sig.alias("signature"), F.col("pk").alias("master_pk"), F.col("record_id").alias("source_record_id"), F.lit("field_update").alias("proposal_type"),
        "field_name", "old_value", "new_value", "source_name", "source_url", F.col("reason").alias("match_reason"),
    )


def compare(evidence: DataFrame, master: DataFrame, earlier: DataFrame) -> DataFrame:
    """Pending proposals; what was last dismissed isn't proposed again."""
    gone = latest_status(earlier.where("status <> 'pending'")).where("status = 'dismissed'").select("signature")
    return candidates(evidence, master).join(gone, "signature", "left_anti").withColumn("status", F.lit("pending"))


def listed(proposals: DataFrame, master: DataFrame, status: str = "pending", limit: int = 500) -> DataFrame:
    """Proposals with their contractor, field updates first, by contractor, field and newest."""
    if status != "all" and status not in STATUSES:
        raise ValueError("unknown proposal status")
    some = proposals if status == "all" else proposals.where(F.col("status") == status)
    j = some.join(master.select(F.col("pk").alias("master_pk"), F.col("contractor_name").alias("master_contractor")), "master_pk", "left")
    kind = F.when(F.col("proposal_type") == "field_update", 0).when(F.col("proposal_type") == "new_record", 1).otherwise(2)
    return j.orderBy(kind, F.coalesce("master_contractor", F.lit("")), "field_name", F.desc("id")).limit(limit)


def refused(selected: DataFrame, evidence: DataFrame, master: DataFrame, proposals: DataFrame) -> DataFrame:
    """The selected proposals (id) with refusal: why one can't be applied now, or null. evidence is fresh evidence in
    master form, with record_id, start_url, complete_aggregate."""
    p = proposals.join(selected.select("id").distinct(), "id")
    fields = [c for c in COLUMNS if c in evidence.columns]
    said = F.create_map(*(x for c in fields for x in (F.lit(c), F.trim(blank(F.col(c))))))
    e = evidence.select(F.col("record_id").alias("source_record_id"), owned_fields(F.col("start_url")).alias("_owned"), F.coalesce("complete_aggregate", F.lit(False)).alias("_whole"), said.alias("_said"))
    stored = F.create_map(*(x for c in fields for x in (F.lit(c), F.trim(blank(F.col("bidder_id" if c == "id" else c))))))
    m = master.select(F.col("pk").alias("master_pk"), stored.alias("_stored"))
    j = p.join(e, "source_record_id", "left").join(m, "master_pk", "left")
    why = (
        F.when(F.col("status") != "pending", "resolved").when(F.col("proposal_type") != "field_update", "not a field update")
        .when(F.col("_said").isNull(), "evidence is stale").when(~F.array_contains("_owned", F.col("field_name")), "source does not own the field")
        .when(F.col("new_value").isin("N", "0") & ~F.col("_whole"), "incomplete evidence cannot clear a field")
        .when(~F.element_at("_said", F.col("field_name")).eqNullSafe(F.col("new_value")), "evidence changed")
        .when(F.col("_stored").isNull(), "no such master row").when(F.element_at("_stored", F.col("field_name")) != F.trim(blank(F.col("old_value"))), "master changed")
    )
    return j.select(*proposals.columns, why.alias("refusal"))


def apply(selected: DataFrame, evidence: DataFrame, master: DataFrame, proposals: DataFrame, now) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(master, proposals, history) after applying the selected proposals that aren't refused. Of several for one
    field of one master row the newest is applied and the rest, like all other pending ones for it, are superseded.
    A second run changes nothing."""
    ok = refused(selected, evidence, master, proposals).where("refusal is null")
    won = ok.groupBy("master_pk", "field_name").agg(F.max(F.struct("id", "new_value", "old_value", "source_record_id", "source_name", "source_url")).alias("w"))
    won = won.select("master_pk", "field_name", "w.*")
    taken = won.select(F.col("new_value").alias("_id"), F.col("master_pk").alias("_pk")).where(won["field_name"] == "id")
    used = master.select(F.col("bidder_id").alias("_id")).where("_id <> ''")
    clash = taken.join(used, "_id", "left_semi").select("_pk")
    won = won.join(clash, (F.col("field_name") == "id") & (F.col("master_pk") == F.col("_pk")), "left_anti")
    changes = won.groupBy("master_pk").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "new_value"))).alias("_new"))
    m = master.join(changes, master["pk"] == changes["master_pk"], "left").drop("master_pk")
    value = lambda c: F.coalesce(F.element_at("_new", F.lit("id" if c == "bidder_id" else c)), F.col(c))
    business = set(COLUMNS[1:]) | {"bidder_id"}
    new_master = m.select(*(value(c).alias(c) if c in business else F.when(F.col("_new").isNotNull(), now).otherwise(F.col(c)).alias(c) if c == "updated_at" else F.col(c) for c in master.columns))
    if "contractor_norm" in master.columns:
        from .schema import master_norms

        new_master = master_norms(new_master).select(*master.columns)
    w = won.select(F.col("id").alias("_won"), F.col("master_pk").alias("_pk"), F.col("field_name").alias("_field"))
    p = proposals.join(w, (F.col("master_pk") == F.col("_pk")) & (F.col("field_name") == F.col("_field")), "left")
    pending = F.col("status") == "pending"
    status = F.when(pending & (F.col("id") == F.col("_won")), "applied").when(pending & F.col("_won").isNotNull(), "superseded").otherwise(F.col("status"))
    new_proposals = p.withColumn("status", status).select(*proposals.columns)
    history = won.select("master_pk", "field_name", "old_value", "new_value", "source_record_id", "source_name", "source_url", now.alias("applied_at"), F.col("id").alias("proposal_id"))
    return new_master, new_proposals, history


def dismiss(selected: DataFrame, proposals: DataFrame) -> DataFrame:
    """The proposals, the selected pending ones dismissed."""
    hit = selected.select("id").distinct().withColumn("_hit", F.lit(True))
    status = F.when(F.col("_hit") & (F.col("status") == "pending"), "dismissed").otherwise(F.col("status"))
    return proposals.join(hit, "id", "left").withColumn("status", status).select(*proposals.columns)


def bucket(status, kind):
    """Where a proposal is shown: resolved, identity or changes."""
    return F.when(status != "pending", "resolved").when(kind.isin("ambiguous", "new_record"), "identity").otherwise("changes")


__all__ = ["apply", "bucket", "candidates", "compare", "dismiss", "fresh_evidence", "latest_status", "listed", "match_text", "refused"]
