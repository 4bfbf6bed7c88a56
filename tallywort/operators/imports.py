"""The import of a master file: what a row-by-row import would give, by rounds of independent rows.

A row matches an entity by id, else by a name that one entity has, else by name and address; it overwrites what it matches
and is a new entity else. A later row sees what earlier ones did. Rows affect each other through ids and names only, so a
round settles all rows whose keys no earlier open row can touch, with joins and minima by key. Rows that leave id, name and
address as they are touch nothing, however many share a name. What rounds don't settle, as where many rows of a file share
a name and change it, is replayed by connected keys, on ids and names alone; values are joined to the outcome at the end.
"""

from __future__ import annotations

from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, held, numbered
from .schema import COLUMNS

#: Rounds at most, and the share of open rows (one in so many) that a round must settle for another to follow.
ROUNDS, LEAST_SHARE = 8, 16
#: References of new entities: this and the line that brought them, so that they come after all others, by line.
NEW = 1 << 61
STATE = ["ref", "id", "name", "addr"]


def _tentative(opened: DataFrame, state: DataFrame) -> DataFrame:
    """Open rows with the entity they would match now, and its keys. Entities are reduced to one row a key before they are
    joined, so no name brings more than one row, however many share it."""
    ids = state.where("id <> ''").groupBy(F.col("id").alias("own")).agg(F.min("ref").alias("id_ref"), F.min_by("name", "ref").alias("id_name"), F.min_by("addr", "ref").alias("id_addr"))
    names = state.where("name <> ''").groupBy("name").agg(F.count("*").alias("n_name"), F.min("ref").alias("name_ref"), F.min_by("id", "ref").alias("name_id"))
    places = state.where("name <> '' and addr <> ''").groupBy("name", "addr").agg(F.count("*").alias("n_place"), F.min("ref").alias("place_ref"), F.min_by("id", "ref").alias("place_id"))
    j = opened.withColumn("own", F.trim("id")).join(ids, "own", "left").join(names, "name", "left").join(places, ["name", "addr"], "left")
    one, there = F.col("n_name") == 1, (F.col("n_name") > 1) & (F.col("n_place") == 1)
    by_name = F.when(one, F.col("name_ref")).when(there, F.col("place_ref"))
    other_id = F.when(one, F.col("name_id")).when(there, F.col("place_id"))
    quiet = F.col("id_ref").isNotNull() & (F.col("id") == F.col("own")) & (F.col("id_name") == F.col("name")) & (F.col("id_addr") == F.col("addr"))
    return j.select("line", "id", "name", "addr", "own", F.coalesce("id_ref", by_name).alias("target"), "id_name", other_id.alias("other_id"), F.coalesce(quiet, F.lit(False)).alias("quiet"))


def _round(opened: DataFrame, state: DataFrame) -> DataFrame:
    """Open rows with target, quiet and settled: whether no earlier open row shares a key with it. Keys are its own id and
    name, those of the entity it would match, by id or by name. Quiet rows, which change no key, don't hinder each other.

    An earlier row that ends up elsewhere than it would now does so because of one earlier still, with which it shares a
    key; and what it touches then has its name or id, which is among the keys of whoever else would match that.
    """
    t = held(_tentative(opened, state))
    i, n = (lambda c: F.concat(F.lit("i:"), F.col(c))), (lambda c: F.concat(F.lit("n:"), F.col(c)))
    some = F.array_distinct(F.filter(F.array(i("own"), i("id"), i("other_id"), n("name"), n("id_name")), lambda k: k.isNotNull() & (F.length(k) > 2)))
    keys = t.select("line", "quiet", F.explode(some).alias("key"))
    first = keys.groupBy("key").agg(F.min("line").alias("first"), F.min(F.when(~F.col("quiet"), F.col("line"))).alias("first_loud"))
    late = F.when(F.col("quiet"), F.coalesce(F.col("first_loud") < F.col("line"), F.lit(False))).otherwise(F.col("first") < F.col("line"))
    hindered = keys.join(first, "key").where(late).select("line").distinct().withColumn("settled", F.lit(False))
    return t.join(hindered, "line", "left").withColumn("settled", F.coalesce("settled", F.lit(True)))


def _applied(state: DataFrame, settled: DataFrame) -> DataFrame:
    """The entities after settled rows; of those of one entity at most one changes keys."""
    ref = F.coalesce("target", F.col("line") + NEW)
    new = settled.where("not quiet").select(ref.alias("ref"), F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("addr").alias("_addr"), F.lit(True).alias("_new"))
    j = state.join(new, "ref", "full_outer")
    return j.select("ref", *(F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in STATE[1:]))


def _replayed(opened: DataFrame, state: DataFrame) -> DataFrame:
    """(line, ref) of open rows, row by row within connected ids and names. A group's rows carry their keys only, some
    hundred bytes each; entities that no open row can reach stay out."""
    every = state.select(F.lit(0).cast("long").alias("line"), *STATE).unionByName(opened.select("line", F.lit(-1).cast("long").alias("ref"), *STATE[1:]))
    every = held(every.withColumn("node", F.xxhash64("line", "ref")))
    keys = every.select("node", F.explode(F.filter(F.array(F.concat(F.lit("i:"), "id"), F.concat(F.lit("i:"), F.trim("id")), F.concat(F.lit("n:"), "name")), lambda k: F.length(k) > 2)).alias("k"))
    links = keys.join(keys.groupBy("k").agg(F.min("node").alias("hub")), "k").select(F.col("node").alias("src"), F.col("hub").alias("dst"))
    comp = components(links)
    grouped = held(every.join(comp, every["node"] == comp["id"], "left").withColumn("grp", F.coalesce("component", "node")).select("grp", "line", "ref", every["id"], "name", "addr"))
    live = grouped.where("line > 0").select("grp").distinct()
    return grouped.join(live, "grp", "left_semi").groupBy("grp").applyInPandas(lambda g: replay(g), "line long, ref long")


def replay(group: pd.DataFrame) -> pd.DataFrame:
    """(line, ref) of a group's open rows (line above 0), in order of line, among its entities (line 0)."""
    order = group.sort_values(["line", "ref"])
    refs: list[int] = []  # of the entities in order, and their keys now
    held_keys: list[tuple[str, str, str]] = []
    by_id: dict[str, list[int]] = {}  # places by id, first ones on top; left there when an id changes
    by_name: dict[object, set[int]] = {}
    out: list[tuple[int, int]] = []

    def put(at: int, keys: tuple[str, str, str]) -> None:
        held_keys[at] = keys
        if keys[0]:
            heappush(by_id.setdefault(keys[0], []), at)
        for k in (keys[1], keys[1:]):
            by_name.setdefault(k, set()).add(at)

    def matched(own: str, name: str, addr: str) -> int | None:
        same = by_id.get(own, [])
        while same and held_keys[same[0]][0] != own:
            heappop(same)
        if own and same:
            return same[0]
        found = by_name.get(name, ()) if name else ()
        if len(found) > 1:
            found = by_name.get((name, addr), ()) if addr else ()
        return next(iter(found)) if len(found) == 1 else None

    for line, ref, *keys in zip(*(order[c].tolist() for c in ["line", *STATE]), strict=True):
        at = matched(keys[0].strip(" "), keys[1], keys[2]) if line > 0 else None
        if at is None:
            refs.append(int(ref) if line == 0 else NEW + line)
            held_keys.append(("", "", ""))
            at = len(refs) - 1
        else:
            for k in (held_keys[at][1], held_keys[at][1:]):
                by_name[k].discard(at)
        put(at, tuple(keys))
        if line > 0:
            out.append((line, refs[at]))
    return pd.DataFrame(out, columns=["line", "ref"], dtype="int64")


def resolved(master: DataFrame, rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(line, ref): the entity that each row of a file (line, id, contractor_norm, address_norm) ends up in: the pk of a
    master row (pk, bidder_id, contractor_norm, address_norm), or NEW plus the line that brought it."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    state = held(master.select(F.col("pk").cast("long").alias("ref"), text("bidder_id").alias("id"), text("contractor_norm").alias("name"), text("address_norm").alias("addr")))
    opened = held(rows.select(F.col("line").cast("long").alias("line"), text("id").alias("id"), text("contractor_norm").alias("name"), text("address_norm").alias("addr")))
    left, done = opened.count(), []
    if state.where("id <> ''").groupBy("id").count().where("count > 1").take(1):
        rounds = 0  # rounds count on ids of one entity each
    for _ in range(rounds):
        if not left:
            break
        judged = held(_round(opened, state))
        settled = judged.where("settled")
        done.append(settled.select("line", F.coalesce("target", F.col("line") + NEW).alias("ref")))
        state = held(_applied(state, settled))
        opened = judged.where("not settled").select("line", *STATE[1:])
        before, left = left, opened.count()
        if (before - left) * LEAST_SHARE < before:
            break
    if left:
        done.append(held(_replayed(opened, state)))
    out = opened.select("line", F.lit(None).cast("long").alias("ref")).limit(0)
    for part in done:
        out = out.unionByName(part)
    return out


def merge_master(master: DataFrame, rows: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """The master after an import, with outcome (inserted, updated, unchanged, kept) and pk. rows has the business
    columns, line (from 1), contractor_norm and address_norm; master also has pk, from 1.

    The last row of an entity gives its values; it counts as updated if any of its rows differed from it. New entities get
    their pk by line, after the highest. Null values count as empty texts.
    """
    cols = ["bidder_id", *(c for c in COLUMNS if c != "id")]
    kept = [*cols, "contractor_norm", "address_norm"]
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    old = master.select(F.col("pk").cast("long").alias("ref"), *map(text, kept))
    new = held(rows.withColumn("bidder_id", F.col("id")).select(F.col("line").cast("long").alias("line"), *map(text, kept)))
    found = held(resolved(master, rows, rounds))
    before = old.select("ref", F.struct(*cols).alias("_old"))
    differs = F.coalesce(F.struct(*cols) != F.col("_old"), F.lit(True))
    written = new.join(found, "line").join(before, "ref", "left").groupBy("ref").agg(F.max("line").alias("line"), F.max(F.when(differs, 1).otherwise(0)).alias("_changed"))
    last = held(written.join(new, "line"))
    stays = old.join(last.select("ref"), "ref", "left_anti").select("ref", *kept, F.lit("kept").alias("outcome"))
    outcome = F.when(F.col("ref") >= NEW, "inserted").when(F.col("_changed") == 1, "updated").otherwise("unchanged")
    top = master.agg(F.coalesce(F.max("pk"), F.lit(0))).first()[0]
    numbers = numbered(last.where(F.col("ref") >= NEW).select("ref"), "n", [F.col("ref")]).select("ref", (F.col("n") + 1 + top).alias("pk"))
    out = stays.unionByName(last.select("ref", *kept, outcome.alias("outcome"))).join(numbers, "ref", "left")
    return out.select(F.coalesce("pk", "ref").alias("pk"), *kept, "outcome")


def import_counts(merged: DataFrame, found: DataFrame) -> DataFrame:
    """One row of counters of an import: rows of the file, entities inserted and updated, and the master's size."""
    return merged.agg(
        F.count(F.when(F.col("outcome") == "inserted", 1)).alias("inserted"), F.count(F.when(F.col("outcome") == "updated", 1)).alias("updated"),
        F.count(F.when(F.col("outcome") == "unchanged", 1)).alias("unchanged"), F.count("*").alias("master_total"),
    ).crossJoin(found.agg(F.count("*").alias("rows_total")))
