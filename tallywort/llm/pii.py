"""PII: patterns of personal data, and terms that give away the entities found.

All steps are DataFrame expressions. Four kinds are matched by pattern, leftmost and non-overlapping for
each kind, and dropped if they fail their test: email; ip, with parts of at most 255; card, 12 to 19 digits that
pass Luhn's test; phone, 9 to 15 digits. The patterns are written so that matching is linear in the text.

The information-theoretic step then looks for terms that disclose an entity even when it is masked. Probabilities
are shares of the different texts of the corpus, each taken whole, base spans left out:

* p(e): texts with entity e; IC(e) = -log2 p(e) is what knowing e is worth
* PMI(t; e) = log2(p(t, e) / (p(t) p(e))): what term t says of e

An entity is a value or, where fewer than ``MIN_TEXTS`` texts hold the value, its class (the domain of an email, the
network of an ip, the leading digits of a card or phone) and, where that is as rare, its kind. A term discloses
e if PMI reaches ``DISCLOSURE`` of IC(e) and ``MIN_TEXTS`` texts hold both. Every occurrence of such a term in
the texts of e becomes a span of kind ``term``. Masking generalises it to ``<term>`` below full disclosure and
removes it at it; base spans become ``<kind>``.

Null and empty texts have no spans, and an empty table gives an empty table. Rows are told apart by doc_id and text, so
repeated rows get equal spans; positions are code points. Other columns pass unused.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("email", "ip", "card", "phone")
#: Fixed values. The lookbehinds and possessive quantifiers change no match; they keep long runs linear.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to have a match of a kind.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]++\.[0-9]++\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){11}", "phone": "+"}
MIN_TERM_CHARS = 4
#: Items of an array that are walked before their values are put aside.
BLOCK = 128
MIN_TEXTS, DISCLOSURE = 3, 0.8
WORDS = r"\p{L}++"
SPAN = "array<struct<start:int,rank:int,stop:int,kind:string,value:string>>"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's test."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.when(n > 0, F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), add) % 10 == 0).otherwise(False)


def _valid(kind: str, x: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(x, r"\."), lambda p: F.coalesce(p.try_cast("int") <= 255, F.lit(False)))
    if kind == "card":
        return F.length(_digits(x)).between(12, 19) & luhn(_digits(x))
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.lit(True)


def _folded(items: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """Walks an array with a position, from 0: step takes the position and an item and gives the next position and an
    array of values (null: none). Returns the last position (at) and all values (out). Values are gathered in blocks,
    so that long arrays aren't copied at each item."""
    none = F.array().cast(f"array<{kind}>")
    last = F.greatest(F.size(items) - 1, F.lit(0))
    blocks = F.transform(F.sequence(F.lit(0), F.floor(last / BLOCK).cast("int")), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))

    def within(acc: Column, x: Column) -> Column:
        at, out = step(acc["at"], x)
        return F.struct(at.alias("at"), F.when(out.isNull(), acc["out"]).otherwise(F.concat(acc["out"], out)).cast(f"array<{kind}>").alias("out"))

    def add(done: Column, block: Column) -> Column:
        begin = F.struct(F.coalesce(F.try_element_at(done, F.lit(-1))["at"], F.lit(0)).alias("at"), none.alias("out"))
        return F.concat(done, F.array(F.aggregate(block, begin, within)))

    parts = F.aggregate(blocks, F.array().cast(f"array<struct<at:int,out:array<{kind}>>>"), add)
    return F.transform(F.array(parts), lambda p: F.struct(F.try_element_at(p, F.lit(-1))["at"].alias("at"), F.flatten(F.transform(p, lambda x: x["out"])).alias("out")))[0]


def spans(text: Column, kind: str) -> Column:
    """The matches of a kind, as array of (start, rank, stop, kind, value)."""
    pattern, rank = PATTERNS[kind], KINDS.index(kind)
    gaps, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.arrays_zip(gaps.alias("gap"), found.alias("value"))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        here = F.when(x["value"].isNotNull() & _valid(kind, x["value"]), F.array(F.struct(start.alias("start"), x["value"].alias("value"))))
        return start + F.coalesce(F.length(x["value"]), F.lit(0)), here

    placed = _folded(pairs, "struct<start:int,value:string>", step)["out"]

    def whole(x: Column) -> Column:
        stop = x["start"] + F.length(x["value"])
        return F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), stop.alias("stop"), F.lit(kind).alias("kind"), x["value"].alias("value"))

    hint = text.contains(HINTS[kind]) if kind in ("email", "phone") else text.rlike(HINTS[kind])
    return F.when(hint, F.transform(placed, whole)).otherwise(F.array().cast(SPAN)).cast(SPAN)


def blanked(text: Column, spans_: Column) -> Column:
    """The text with spaces in place of its spans, which are ordered by start."""
    def step(at: Column, s: Column) -> tuple[Column, Column]:
        start, stop = F.greatest(s["start"], at), F.greatest(s["stop"], at)
        return stop, F.array(F.concat(F.substring(text, at + 1, start - at), F.repeat(F.lit(" "), stop - start)))

    def whole(r: Column) -> Column:
        return F.concat(F.array_join(r["out"], ""), F.substring(text, r["at"] + 1, F.length(text)))

    return F.when(F.size(spans_) > 0, F.transform(F.array(_folded(spans_, "string", step)), whole)[0]).otherwise(text)


def found(docs: DataFrame) -> DataFrame:
    """(doc_id, key, spans, words) for every document: base spans by start, then kind, and the different terms outside them."""
    text = F.coalesce("text", F.lit(""))
    each = docs.select("doc_id", text.alias("text"), F.xxhash64("text").alias("key"), *(spans(text, k).alias(k) for k in KINDS))
    each = each.select("doc_id", "key", "text", F.array_sort(F.concat(*KINDS)).alias("spans"))
    hits = F.regexp_extract_all(blanked(F.col("text"), F.col("spans")), F.lit(WORDS), F.lit(0))
    words = F.array_distinct(F.transform(F.filter(hits, lambda w: F.length(w) >= MIN_TERM_CHARS), F.lower))
    return common.materialize(each.select("doc_id", "key", "spans", words.alias("words")), "pii-base")


def _entities(s: Column) -> Column:
    """A span's value, class and kind, finest first."""
    value, digits = F.lower(s["value"]), _digits(s["value"])
    group = (
        F.when(s["kind"] == "email", F.regexp_extract(value, "@.*", 0)).when(s["kind"] == "ip", F.regexp_extract(value, r"^(.*\.)[0-9]+$", 1))
        .when(s["kind"] == "card", F.concat(F.substring(digits, 1, 6), F.lit("*"))).otherwise(F.concat(F.lit("+"), F.substring(digits, 1, 4), F.lit("*")))
    )
    same = F.when(s["kind"].isin("card", "phone"), digits).otherwise(value)
    return F.array(F.concat_ws(":", s["kind"], same), F.concat_ws(":", s["kind"], group), s["kind"])


def disclosing(docs: DataFrame, base: DataFrame) -> DataFrame:
    """(doc_id, key, terms): spans of the terms that disclose an entity of the document."""
    n_texts = base.select("key").distinct().count()
    n = F.lit(float(max(1, n_texts)))
    empty = docs.sparkSession.createDataFrame([], "doc_id long, key long, terms " + SPAN)
    holding = common.materialize(base.where(F.size("spans") > 0).dropDuplicates(["key"]).select("key", "spans", "words"), "pii-holding")
    spans_ = holding.select("key", F.explode(F.array_distinct(F.transform("spans", _entities))).alias("levels"))
    held = spans_.select("key", F.explode("levels").alias("entity")).distinct()
    counts = common.materialize(held.groupBy("entity").agg(F.count("*").alias("n_e")).where(F.col("n_e") >= MIN_TEXTS), "pii-entities")
    least = counts.agg(F.min("n_e")).first()[0]
    if least is None or not n_texts:
        return empty
    # an entity's probability where a term is found, p(e|t), must reach p(e) ** (1 - DISCLOSURE), and no entity's is
    # above that of holding any: terms short of it for the rarest entity can't pass and aren't paired
    copies = common.materialize(base.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"), "pii-copies")
    weighed = common.join_by_id(base.select(F.col("key").alias("_key"), "spans", "words"), copies, F.col("_key") == F.col("key"), "left")
    weight = F.lit(1.0) / F.coalesce("copies", F.lit(1))
    every = weighed.select(weight.alias("w"), F.when(F.size("spans") > 0, weight).otherwise(0.0).alias("h"), F.explode("words").alias("term"))
    terms = every.groupBy("term").agg(F.round(F.sum("w"), 3).alias("n_t"), F.round(F.sum("h"), 3).alias("n_h"))
    floor = (least / n_texts) ** (1 - DISCLOSURE) * (1 - 1e-9)
    terms = common.materialize(terms.where((F.col("n_h") >= MIN_TEXTS) & (F.col("n_h") >= F.col("n_t") * floor)), "pii-terms")
    # the finest entity of each span that enough texts hold
    finest = spans_.select("key", F.posexplode("levels").alias("level", "entity"), F.xxhash64("levels").alias("span")).join(counts.select("entity"), "entity")
    used = common.materialize(finest.groupBy("key", "span").agg(F.min_by("entity", "level").alias("entity")).select("key", "entity").distinct(), "pii-used")
    events = held.join(used.select("entity").distinct(), "entity")
    word = common.materialize(holding.select("key", F.explode("words").alias("term")).join(terms.select("term"), "term"), "pii-words")
    pairs = word.join(events, "key").groupBy("entity", "term").agg(F.count("*").alias("n_te")).where(F.col("n_te") >= MIN_TEXTS)
    pmi = F.log2(F.col("n_te") * n / (F.col("n_t") * F.col("n_e")))
    worth = F.log2(n / F.col("n_e"))
    telling = common.materialize(
        pairs.join(terms, "term").join(counts, "entity").withColumn("share", pmi / worth)
        .where((worth > 0) & (F.col("share") >= DISCLOSURE)).select("entity", "term", "share"),
        "pii-telling",
    )
    if not telling.take(1):
        return empty
    shares = word.join(used, "key").join(telling, ["entity", "term"]).groupBy("key", "term").agg(F.max("share").alias("share"))
    shares = shares.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "share"))).alias("shares"))
    # by rows of the base table, which hold the spans to blank; documents without disclosing terms fall away first
    there = base.where(F.size("spans") > 0).select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "spans").dropDuplicates(["_id", "_key"])
    there = common.materialize(there.join(shares.withColumnRenamed("key", "_of"), F.col("_key") == F.col("_of")).drop("_of"), "pii-shares")
    mine = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    hits = common.join_by_id(mine, there, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("key") == F.col("_key")), "inner")
    hits = hits.select("doc_id", "key", "shares", blanked(F.coalesce("text", F.lit("")), F.col("spans")).alias("text"))
    return hits.select("doc_id", "key", _occurrences(F.col("text"), F.col("shares")).alias("terms"))


def _occurrences(text: Column, shares: Column) -> Column:
    """Spans of the words that shares names."""
    gaps, hits = F.split(text, WORDS, -1), F.regexp_extract_all(text, F.lit(WORDS), F.lit(0))

    def step(at: Column, x: Column) -> tuple[Column, Column]:
        start = at + F.length(x["gap"])
        stop = start + F.coalesce(F.length(x["value"]), F.lit(0))
        share = F.try_element_at(shares, F.lower(x["value"]))
        value = F.when(share >= 1 - 1e-9, "").otherwise("<term>")
        span = F.struct(start.alias("start"), F.lit(len(KINDS)).alias("rank"), stop.alias("stop"), F.lit("term").alias("kind"), value.alias("value"))
        return stop, F.when(share.isNotNull(), F.array(span))

    return _folded(F.arrays_zip(gaps.alias("gap"), hits.alias("value")), SPAN[6:-1], step)["out"].cast(SPAN)


def _listed(spans_: Column) -> Column:
    return F.array_join(F.transform(spans_, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")


def detected(docs: DataFrame) -> DataFrame:
    """(doc_id, key, base, spans): base spans, and all spans by start, then kind."""
    base = found(docs)
    terms = disclosing(docs, base).dropDuplicates(["doc_id", "key"])
    both = base.join(terms, base["doc_id"].eqNullSafe(terms["doc_id"]) & (base["key"] == terms["key"]), "left")
    every = F.array_sort(F.concat(base["spans"], F.coalesce("terms", F.array().cast(SPAN))))
    return both.select(base["doc_id"], base["key"], base["spans"].alias("base"), every.alias("spans"))


def report(docs: DataFrame) -> DataFrame:
    """Counts by kind and of flagged terms, digest of the base spans, and all spans as text, for every document."""
    d = detected(docs)
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    n_terms = (F.size("spans") - F.size("base")).cast("long").alias("n_terms")
    return d.select("doc_id", *map(count, KINDS), n_terms, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame) -> DataFrame:
    """The documents with their spans masked; overlapping spans are masked as one, by the kind of the first."""
    id_, key, spans_ = common.unused(docs.columns, "masked_id", "masked_key", "masked_spans")
    d = detected(docs.select("doc_id", "text")).where(F.size("spans") > 0).dropDuplicates(["doc_id", "key"]).select(F.col("doc_id").alias(id_), F.col("key").alias(key), F.col("spans").alias(spans_))
    both = docs.join(d, F.col("doc_id").eqNullSafe(F.col(id_)) & (F.xxhash64("text") == F.col(key)), "left")

    def step(at: Column, s: Column) -> tuple[Column, Column]:
        mask = F.when(s["kind"] == "term", s["value"]).otherwise(F.concat(F.lit("<"), s["kind"], F.lit(">")))
        return F.greatest(at, s["stop"]), F.when(s["start"] >= at, F.array(F.concat(F.substring(F.col("text"), at + 1, s["start"] - at), mask)))

    masked = F.transform(F.array(_folded(F.col(spans_), "string", step)), lambda r: F.concat(F.array_join(r["out"], ""), F.substring(F.col("text"), r["at"] + 1, F.length("text"))))[0]
    return both.select(*(F.when(F.col(spans_).isNotNull(), masked).otherwise(F.col("text")).alias(c) if c == "text" else F.col(c) for c in docs.columns))
