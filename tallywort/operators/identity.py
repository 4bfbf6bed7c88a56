"""Identity resolution: which master row a piece of evidence is about, if that is certain."""

from __future__ import annotations

import difflib
from functools import reduce
from itertools import combinations
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallywort.functions.text import blank, match_text

#: Weights of equal location parts.
WEIGHTS = {"state": 4, "zip": 3, "city": 2, "address": 2}


def find_matches(incoming: DataFrame, master: DataFrame, key: str = "row_id") -> DataFrame:
    """(key, pk, reason) for every incoming row: an equal id, else a name that one master row has, else the one
    row of that name with the same address; else why not. Incoming has id, contractor_norm, address_norm; master pk,
    bidder_id, contractor_norm, address_norm.

    Master rows are counted by name and by name and address before they are joined, so no name brings more than
    one row to any join, however many contractors share it.
    """
    ids = master.where(blank(F.col("bidder_id")) != "").groupBy(F.trim("bidder_id").alias("m_id")).agg(F.min("pk").alias("id_pk"))
    names = master.where("contractor_norm <> ''").groupBy("contractor_norm").agg(F.count("*").alias("same_name"), F.min("pk").alias("name_pk"))
    places = master.where("contractor_norm <> '' and address_norm <> ''").groupBy("contractor_norm", "address_norm").agg(F.count("*").alias("same_place"), F.min("pk").alias("place_pk"))
    own_id = F.trim(blank(incoming["id"]))
    joined = (
        incoming.withColumn("_id", own_id)
        .join(ids, F.col("_id") == F.col("m_id"), "left").join(names, "contractor_norm", "left").join(places, ["contractor_norm", "address_norm"], "left")
    )
    by_id = (F.col("_id") != "") & F.col("id_pk").isNotNull()
    reason = (
        F.when(by_id, "bidder_id").when(F.col("contractor_norm") == "", "no_contractor_name").when(F.col("same_name") == 1, "contractor_name")
        .when(F.col("same_place") == 1, "contractor_name_and_address").when(F.col("same_name") > 1, "ambiguous_contractor_name").otherwise("not_found")
    )
    pk = F.when(by_id, F.col("id_pk")).when(F.col("same_name") == 1, F.col("name_pk")).when(F.col("same_place") == 1, F.col("place_pk"))
    return joined.select(key, F.when(by_id | (F.col("contractor_norm") != ""), pk).alias("pk"), reason.alias("reason"))


def location_corroborates(candidate: dict[str, Column], *places: dict[str, Column]) -> Column:
    """Whether a candidate's location supports a match: at one of the places, without a different state, an equal
    ZIP, or an equal city or address within an equal state. Unknown parts support nothing."""
    out = F.lit(False)
    left = {k: match_text(v) for k, v in candidate.items()}
    for place in places:
        right = {k: match_text(v) for k, v in place.items()}
        both = lambda k: (left[k] != "") & (left[k] == right[k])  # noqa: B023, E731
        conflict = (left["state"] != "") & (right["state"] != "") & (left["state"] != right["state"])
        zips = (left["zip"] != "") & (right["zip"] != "") & (F.substring(left["zip"], 1, 5) == F.substring(right["zip"], 1, 5))
        out = out | (~conflict & (zips | both("state") & (both("city") | both("address"))))
    return out


def location_score(candidate: dict[str, Column], place: dict[str, Column]) -> Column:
    """Sum of the weights of equal, known location parts."""
    total = F.lit(0)
    for part, weight in WEIGHTS.items():
        a, b = match_text(candidate[part]), match_text(place[part])
        if part == "zip":
            a, b = F.substring(a, 1, 5), F.substring(b, 1, 5)
        total = total + F.when((a != "") & (a == b), weight).otherwise(0)
    return total


#: Rows that a task takes at once where places are told apart.
PLACES_A_TASK = 50_000


def _told_apart(df: DataFrame, p: str) -> DataFrame:
    """The distinct rows, columns under the prefix p, with the folded parts of their locations under _p; of ZIPs the
    first five characters. Tasks hold PLACES_A_TASK rows however many there are."""
    own = df.select(*(F.col(c).alias(f"{p}_{c}") for c in df.columns))
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.count() // PLACES_A_TASK + 1)
    folded = {c: match_text(F.col(f"{p}_{c}")) for c in WEIGHTS}
    folded["zip"] = F.substring(folded["zip"], 1, 5)
    return own.repartition(n, *own.columns).distinct().select("*", *(v.alias(f"_{p}_{c}") for c, v in folded.items()))


def location_pairs(left: DataFrame, right: DataFrame, corroborated: bool = False) -> DataFrame:
    """Rows of two tables, their columns under l_ and r_, whose locations may agree: by ZIP, or by city or address
    within a state; with corroborated those of which location_corroborates holds. Parts (state, city, zip, address) are
    compared by match text, of ZIPs five characters; unknown ones join nothing.

    A pair comes from one join only, the first that has it, so pairs leave the joins as they are found and are never
    sorted or gathered; only the tables' own rows are.
    """
    a, b = _told_apart(left, "l"), _told_apart(right, "r")
    same = {c: (F.col(f"_l_{c}") != "") & (F.col(f"_l_{c}") == F.col(f"_r_{c}")) for c in WEIGHTS}
    conflict = (F.col("_l_state") != "") & (F.col("_r_state") != "") & (F.col("_l_state") != F.col("_r_state"))
    by_zip = same["zip"] & ~conflict if corroborated else same["zip"]
    by_city, by_address = same["state"] & same["city"], same["state"] & same["address"]
    joins = (by_zip, by_city & ~same["zip"], by_address & ~same["zip"] & ~same["city"])
    out = None
    for on in joins:
        some = a.join(b, on).select(*(f"l_{c}" for c in left.columns), *(f"r_{c}" for c in right.columns))
        out = some if out is None else out.union(some)
    return out


#: The sets of parts by whose agreement two places become a pair.
PART_SETS = [x for n in range(1, len(WEIGHTS) + 1) for x in combinations(WEIGHTS, n) if "zip" in x or "state" in x and n > 1]


def unique_best_location(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(l_key, r_key, score): what unique_best gives on all location_pairs by their location_score, without the pairs.

    Each row of the right table is counted under each set of its parts by which it can become a pair, and each row of the
    left asks for these counts: one row a set. A set with rows counts those that agree in more parts too, but these have
    a higher score, so at the highest score found the counts are exact and no row is counted twice. Every pair has a
    positive score, so an item's only candidate is its best one.
    """
    def counted_by(df: DataFrame, p: str) -> DataFrame:
        part = lambda c: F.col(f"_{p}_{c}")
        made = []
        for i, parts in enumerate(PART_SETS):
            said = F.struct(F.lit(i).alias("set"), *((part(c) if c in parts else F.lit("")).alias(c) for c in WEIGHTS))
            made.append(F.when(reduce(and_, (part(c) != "" for c in parts)), said))
        return df.select(f"{p}_{key}", F.explode(F.filter(F.array(*made), lambda x: x.isNotNull())).alias("s")).select(f"{p}_{key}", "s.*")

    on = ["set", *WEIGHTS]
    there = counted_by(_told_apart(right, "r"), "r").groupBy(*on).agg(F.count("*").alias("n"), F.min(f"r_{key}").alias(f"r_{key}"))
    score = F.element_at(F.array(*(F.lit(sum(WEIGHTS[c] for c in parts)) for parts in PART_SETS)), F.col("set") + 1)
    hits = counted_by(_told_apart(left, "l"), "l").join(there, on).select(f"l_{key}", f"r_{key}", "n", score.alias("score"))
    ties = hits.groupBy(f"l_{key}", "score").agg(F.sum("n").alias("n"), F.min(f"r_{key}").alias(f"r_{key}"))
    best = ties.groupBy(f"l_{key}").agg(F.max(F.struct("score", "n", f"r_{key}")).alias("best"))
    return best.where("best.n = 1").select(f"l_{key}", f"best.r_{key}", "best.score")


def unique_best(scored: DataFrame, item: str, candidate: str, score: str) -> DataFrame:
    """(item, candidate, score): an item's only candidate, or of several the one with the highest score, if that is
    positive and no other's. Two aggregates, no sort: a hot item pre-aggregates."""
    top = scored.groupBy(item).agg(F.count("*").alias("n"), F.max(F.struct(score, candidate)).alias("best"))
    ties = scored.groupBy(item, score).agg(F.count("*").alias("ties"))
    best = top.select(item, "n", F.col(f"best.{score}").alias(score), F.col(f"best.{candidate}").alias(candidate))
    sure = (F.col("n") == 1) | (F.col(score) > 0) & (F.col("ties") == 1)
    return best.join(ties, [item, score]).where(sure).select(item, candidate, score)


def cross_claims(claims: DataFrame, item: str, claimant: str) -> DataFrame:
    """The claims with status: matched, or ambiguous for all claimants of an item that several claim. The outcome
    doesn't depend on the order of claims."""
    n = claims.groupBy(item).agg(F.min(claimant).alias("_low"), F.max(claimant).alias("_high"))
    return claims.join(n, item).withColumn("status", F.when(F.col("_low") == F.col("_high"), "matched").otherwise("ambiguous")).drop("_low", "_high")


def single_or_ambiguous(accepted: DataFrame, owner: str) -> DataFrame:
    """Accepted profiles with status: a second accepted profile makes all of its owner's ambiguous."""
    n = accepted.groupBy(owner).agg(F.count("*").alias("_n"))
    return accepted.join(n, owner).withColumn("status", F.when(F.col("_n") == 1, "matched").otherwise("ambiguous")).drop("_n")


def first_index(items: DataFrame, item: str, *indexes: tuple[DataFrame, str, str]) -> DataFrame:
    """(item, target, basis): targets by the first of several indexes (table of key and target, key column, basis)
    that holds the item's key; later indexes aren't asked."""
    parts = []
    for rank, (table, key, basis) in enumerate(indexes):
        hit = items.where(blank(F.col(key)) != "").join(table, key).select(item, "target", F.lit(rank).alias("rank"), F.lit(basis).alias("basis"))
        parts.append(hit)
    hits = parts[0]
    for p in parts[1:]:
        hits = hits.union(p)
    best = hits.groupBy(item).agg(F.min("rank").alias("rank"))
    return hits.join(best, [item, "rank"]).select(item, "target", "basis").distinct()


def location_evidence(candidate: dict[str, Column], place: dict[str, Column]) -> Column:
    """Which location parts agree, as a struct of booleans; addresses also agree if one holds the other."""
    same = lambda a, b: (a != "") & (b != "") & (a == b)
    digits = lambda c: F.substring(F.regexp_replace(blank(c), r"\D", ""), 1, 5)
    a, b = match_text(candidate["address"]), match_text(place["address"])
    number = lambda c: F.regexp_extract(blank(c), r"^(\d+)", 1)
    return F.struct(
        same(match_text(candidate["state"]), match_text(place["state"])).alias("state"),
        same(match_text(candidate["city"]), match_text(place["city"])).alias("city"),
        same(digits(candidate["zip"]), digits(place["zip"])).alias("zip"),
        ((a != "") & (b != "") & (a.contains(b) | b.contains(a))).alias("address"),
        same(number(candidate["address"]), number(place["address"])).alias("street_number"),
    )


def in_context(context: Column, *places: tuple[Column, Column, Column]) -> Column:
    """Whether a text names one of the places (city, state, zip): its ZIP, or both city and state."""
    text, out = match_text(context), F.lit(False)
    for city, state, zip_code in places:
        c, s, z = match_text(city), match_text(state), match_text(zip_code)
        out = out | (z != "") & text.contains(z) | (c != "") & (s != "") & text.contains(c) & text.contains(s)
    return out


@F.pandas_udf(T.DoubleType())
def ratio(candidate: pd.Series, target: pd.Series) -> pd.Series:
    """Share of matching blocks (Ratcliff and Obershelp) of candidate and target, in that order."""
    return pd.Series([
        None if a is None or b is None else difflib.SequenceMatcher(None, a, b).ratio() for a, b in zip(candidate, target, strict=True)
    ], dtype="float64")


#: Names from which on candidates must share two rare pairs of letters, and three.
TWO_FROM, THREE_FROM = 20_000, 2_000_000


def plausible_in_context(candidates: DataFrame, targets: DataFrame, context: str, min_length: int, least: float = 0.84) -> DataFrame:
    """(context, candidate, target): the pairs of a context, such as the owners whose search found the candidate, of which
    one name holds the other or whose ratio reaches least. candidates has context and candidate, of which those shorter
    than min_length are never plausible; targets has context and target. Contexts meet by equality; lengths are compared
    before any ratio is taken."""
    c = candidates.select(context, "candidate").where(F.length("candidate") >= min_length).distinct()
    t = targets.select(context, "target").where("target <> ''").distinct()
    j = c.join(t, context)
    holds = F.col("candidate").contains(F.col("target")) | F.col("target").contains(F.col("candidate"))
    fits = 2 * F.least(F.length("candidate"), F.length("target")) >= least * (F.length("candidate") + F.length("target"))
    close = F.when(~holds & fits, ratio(F.when(~holds & fits, F.col("candidate")), F.col("target")))
    return j.where(holds | F.coalesce(close >= least, F.lit(False)))


def plausible(candidates: DataFrame, targets: DataFrame, least: float = 0.84, min_length: int = 6, containment: bool = True, shared: int | None = None) -> DataFrame:
    """(candidate, target): pairs of distinct names, at least min_length long on the candidate's side, of which one
    holds the other or whose ratio reaches least. candidates has candidate, targets has target.

    No pair is compared that can't qualify. A ratio of r leaves at most (1 - r)(n + k) characters unmatched, so that
    matching blocks hold (1.5 r - 1)(n + k) - 1 common pairs of neighbouring letters or more. Each name is indexed by its
    rarest pairs of letters, as many as any match must have `shared` of in common, and by combinations of so many of them:
    the more names there are, the more must agree at once (one to three, by the counted names, unless given), so that keys
    get rarer as names get more. Names too short for that many use fewer. Then lengths and letters must fit, and the UDF
    sees survivors only. For containment, targets are looked up by their windows of the candidate's length and vice versa.
    """
    c = candidates.select("candidate").where(F.length("candidate") >= min_length).distinct()
    t = targets.select("target").where("target <> ''").distinct()
    if shared is None:
        n = c.count() + t.count()
        shared = 1 if n < TWO_FROM else 2 if n < THREE_FROM else 3

    # each character, or pair of neighbours, with its number of earlier occurrences is one element of a name's bag
    def numbered(items: Column) -> Column:
        ordered = F.array_sort(items)
        return F.transform(ordered, lambda x, i: F.concat(x, (i - F.array_position(ordered, x) + 1).cast("string")))

    def bag(col: str) -> Column:
        return numbered(F.split(F.col(col), ""))

    def pairs(col: str) -> Column:
        n = F.length(col)
        return numbered(F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(F.col(col), i, F.lit(2)))).otherwise(F.array().cast("array<string>")))

    def keyed(df: DataFrame, col: str) -> DataFrame:
        return df.select(col, F.explode(pairs(col)).alias("element"))

    # the common pairs of letters of a name of n characters with any match; the other has r n / (2 - r) characters at least
    def need(n: Column) -> Column:
        return F.greatest(F.lit(1), F.ceil((1.5 * least - 1) * (n + n * (least / (2 - least))) - 1 - 1e-9)).cast("int")

    def combined(prefix: Column, m: int, i: Column | None = None, *had: Column) -> Column:
        """Hashes of the combinations of m elements of a prefix, in its order; a collision only adds a pair to compare."""
        rest = prefix if i is None else F.slice(prefix, i + 2, F.greatest(F.size(prefix) - i - 1, F.lit(0)))
        if m == 1:
            return F.transform(rest, lambda x: F.xxhash64(F.lit(len(had) + 1), *had, x))
        base = F.lit(0) if i is None else i + 1
        return F.flatten(F.transform(rest, lambda x, k: combined(prefix, m - 1, base + k, *had, x)))

    both = keyed(c, "candidate").select("element").union(keyed(t, "target").select("element")).groupBy("element").agg(F.count("*").alias("freq"))

    def indexed(df: DataFrame, col: str) -> DataFrame:
        n = F.length(col)
        ranked = keyed(df, col).join(both, "element").groupBy(col).agg(F.array_sort(F.collect_list(F.struct("freq", "element"))).alias("p"))  # a name's own pairs
        shortest = F.ceil(n * (least / (2 - least)) - 1e-9).cast("int")
        most, fewest = F.least(F.lit(shared), need(n)), F.least(F.lit(shared), need(shortest))
        ordered = ranked.select(col, F.transform("p", lambda x: x["element"]).alias("p"), F.explode(F.sequence(fewest, most)).alias("m"), need(n).alias("need"))
        prefix = F.slice(F.col("p"), F.lit(1), F.greatest(F.size("p") - F.col("need") + F.col("m"), F.lit(0)))
        by_m = F.array().cast("array<bigint>")
        for m in range(1, shared + 1):
            by_m = F.when(F.col("m") == m, combined(prefix, m)).otherwise(by_m)
        return ordered.select(col, F.explode(F.array_distinct(by_m)).alias("key"))

    fits = 2 * F.least(F.length("candidate"), F.length("target")) >= least * (F.length("candidate") + F.length("target"))
    common = F.size(F.array_intersect(bag("candidate"), bag("target")))
    near = (
        indexed(c, "candidate").join(indexed(t, "target"), "key").where(fits).select("candidate", "target").distinct()
        .where(2 * common >= least * (F.length("candidate") + F.length("target")))
    )
    hits = near.where(ratio("candidate", "target") >= least)
    if containment:
        def windows(df: DataFrame, col: str, lengths: DataFrame) -> DataFrame:
            spans = df.join(F.broadcast(lengths), F.length(col) >= F.col("n"))  # at most one row for each length of a name
            return spans.select(col, F.explode(F.transform(F.sequence(F.lit(1), F.length(col) - F.col("n") + 1), lambda i: F.substring(F.col(col), i, F.col("n")))).alias("part")).distinct()

        len_c, len_t = c.select(F.length("candidate").alias("n")).distinct(), t.select(F.length("target").alias("n")).distinct()
        held = windows(t, "target", len_c).join(c, F.col("part") == F.col("candidate")).select("candidate", "target")
        holds = windows(c, "candidate", len_t).join(t, F.col("part") == F.col("target")).select("candidate", "target")
        hits = hits.union(held).union(holds)
    return hits.distinct()
