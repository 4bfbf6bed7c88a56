"""Upkeep of an index from states to the sitemaps (members) that list businesses there, by batches of parsed members.

Three tables: members (index_id, place, url, lastmod, parsed, states), the index (index_id, state, url), and what a batch
observed. A batch changes the rows of its own members only; the index is kept up by the difference of their states. The
cursor moves over parsed members without a gap, so that a crash repeats a member rather than skips it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywort.functions.text import blank

#: Members of a batch, and where a profile's path has its state.
BATCH = 100
STATE_IN = r"(?i)^https?://[^/?#]+/us/([a-z]{2})/[^/?#]+/profile/[^?#]+$"
KEY = ["index_id", "url"]


def state_of(loc: Column) -> Column:
    """The state of a profile's URL in capitals, or the empty text."""
    return F.upper(F.regexp_extract(blank(loc), STATE_IN, 1))


def fingerprint(children: DataFrame) -> DataFrame:
    """(index_id, n, fingerprint): of each index's entries (index_id, place, url, lastmod), whatever their partitioning. Sums
    of hashes, so that no list is gathered."""
    h = F.xxhash64("place", "url", blank(F.col("lastmod")))
    parts = children.groupBy("index_id").agg(F.count("*").alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    return parts.select("index_id", "n", F.sha2(F.concat_ws(":", "n", "s", "x"), 256).alias("fingerprint"))


def refreshed(members: DataFrame, children: DataFrame, only_changed: bool = False) -> DataFrame:
    """The members after their indexes were read again (children: index_id, place, url, lastmod; of a repeated url the first
    counts). Indexes that weren't read stay. One whose fingerprint is as it was keeps all; else all its members are to be
    parsed again, or with only_changed those that are new or whose lastmod differs; members gone from it are dropped."""
    first = children.groupBy(*KEY).agg(F.min(F.struct("place", blank(F.col("lastmod")).alias("lastmod"))).alias("c")).select(*KEY, "c.place", "c.lastmod")
    old_mark = fingerprint(members).select("index_id", F.col("fingerprint").alias("_old"))
    same = fingerprint(first).join(old_mark, "index_id", "left").select("index_id", F.coalesce(F.col("_old") == F.col("fingerprint"), F.lit(False)).alias("_same"))
    known = members.select(*KEY, F.col("lastmod").alias("_lastmod"), "parsed", "states")
    j = first.join(same, "index_id").join(known, KEY, "left")
    keeps = F.col("_same") | (F.lit(only_changed) & (F.col("lastmod") == F.col("_lastmod")))
    keeps = F.coalesce(keeps & F.col("parsed"), F.lit(False))
    none = F.array().cast("array<string>")
    fresh = j.select("index_id", "place", "url", "lastmod", keeps.alias("parsed"), F.when(keeps, F.col("states")).otherwise(none).alias("states"))
    return members.join(first.select("index_id").distinct(), "index_id", "left_anti").unionByName(fresh)


def cursors(members: DataFrame) -> DataFrame:
    """(index_id, cursor, complete): how many members from the first on are parsed without a gap."""
    rank = members.groupBy("index_id").agg(F.min(F.when(~F.col("parsed"), F.col("place"))).alias("open"), F.count("*").alias("n"))
    before = members.join(rank.where("open is not null").select("index_id", "open"), "index_id").where(F.col("place") < F.col("open")).groupBy("index_id").agg(F.count("*").alias("before"))
    j = rank.join(before, "index_id", "left")
    return j.select("index_id", F.when(F.col("open").isNull(), F.col("n")).otherwise(F.coalesce("before", F.lit(0))).alias("cursor"), F.col("open").isNull().alias("complete"))


def next_batch(members: DataFrame, size: int = BATCH) -> DataFrame:
    """The next members of each index to fetch: those within `size` places from the first open one on, parsed or not."""
    first = members.where(~F.col("parsed")).groupBy("index_id").agg(F.min("place").alias("open"))
    return members.join(first, "index_id").where((F.col("place") >= F.col("open")) & (F.col("place") < F.col("open") + size)).select("index_id", "place", "url")


def observed(batch: DataFrame, locs: DataFrame) -> DataFrame:
    """(index_id, url, seen): the states of each parsed member (batch: index_id, url) by its locations (index_id, url, loc);
    a member without any has none. There are as many states as pairs of letters at most."""
    states = locs.select(*KEY, state_of(F.col("loc")).alias("state")).where("state <> ''").distinct()
    seen = states.groupBy(*KEY).agg(F.array_sort(F.collect_list("state")).alias("seen"))
    return batch.select(*KEY).distinct().join(seen, KEY, "left").select(*KEY, F.coalesce("seen", F.array().cast("array<string>")).alias("seen"))


def applied(members: DataFrame, index: DataFrame, batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, index) after a batch of observed members. A member that is no longer listed changes nothing; one that was
    parsed before is replaced. Applying a batch again changes nothing."""
    j = members.join(batch, KEY, "left")
    after = j.select("index_id", "place", "url", "lastmod", (F.col("parsed") | F.col("seen").isNotNull()).alias("parsed"), F.coalesce("seen", "states").alias("states"))
    touched = members.join(batch, KEY)
    gone = touched.select(*KEY, F.explode(F.array_except("states", "seen")).alias("state"))
    new = touched.select(*KEY, F.explode(F.array_except("seen", "states")).alias("state"))
    kept = index.join(gone, [*KEY, "state"], "left_anti")
    return after, kept.unionByName(new.select(*index.columns))


def pruned(index: DataFrame, members: DataFrame) -> DataFrame:
    """The index without the members that a refresh dropped or reopened."""
    return index.join(members.where("parsed").select(*KEY), KEY, "left_semi")


def rebuilt(members: DataFrame) -> DataFrame:
    """The index from nothing: (index_id, state, url) of all parsed members."""
    return members.where("parsed").select("index_id", F.explode("states").alias("state"), "url")


def support(index: DataFrame, members: DataFrame, asked: DataFrame) -> DataFrame:
    """(index_id, state, n_members, status) of the states asked for: supported if a parsed member lists them; unsupported
    only once the whole index is parsed; unknown until then, so that nothing is concluded from what wasn't read."""
    n = index.groupBy("index_id", "state").agg(F.count("*").alias("n_members"))
    j = asked.select("index_id", "state").distinct().join(n, ["index_id", "state"], "left").join(cursors(members).select("index_id", "complete"), "index_id", "left")
    status = F.when(F.col("n_members") > 0, "supported").when(F.col("complete"), "unsupported").otherwise("unknown")
    return j.select("index_id", "state", F.coalesce("n_members", F.lit(0)).alias("n_members"), status.alias("status"))
