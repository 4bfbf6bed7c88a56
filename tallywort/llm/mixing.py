"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

1. Sources, in code point order with null last, take the weights in turn. Targets share ``TOTAL_PERCENT``
   of all sizes by weight; a target stops at ``MAX_REPEATS`` times its source's size and the excess is
   shared among the others by weight until none is above.
2. A source is cut into shards of about ``SHARD_WORDS`` words by a seeded hash of the document id, so a
   large source is many shards. A shard's votes are its part of its source's target.
3. Blocks of ``BLOCK_WORDS`` words go to the shards with the highest quotients votes / (2k + 1), which
   gives an integer quota a shard. The cut-off quotient is found by narrowing a bracket, each pass one
   aggregate over the shards, and equal quotients at the cut-off are awarded in order of shard.
4. In a shard, documents in seeded order form one stream of words cut into blocks. Each block is taken
   quota div blocks times, and quota mod blocks of them, spread evenly from a seeded start, once more.
   The words that a document gives are a closed form of its place in the stream.

Nothing but sums leaves the executors, and the slim table (id, source, digest, size) is all that shuffles. Null
and empty texts have size 0 and give nothing; a source of size 0 has target 0. Repeated rows, and rows of one
doc_id or of none, are separate documents. An empty table gives an empty mix. Results depend on the rows alone, so
reruns agree.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

WEIGHTS = (3, 1, 2)
TOTAL_PERCENT = 150
MAX_REPEATS = 2
BLOCK_WORDS = 16
SHARD_WORDS = 1_000_000
SEED = 20_240
#: Thresholds tried in one pass over the shards, and passes.
FAN, PASSES = 32, 8


def ranked_sources(slim: DataFrame) -> DataFrame:
    """(source, source_size, place): sizes of the sources and their places in code point order, null last.

    Places are dealt without gathering the sources: they are sorted by range, and only the number of rows
    of each range goes to the driver.
    """
    sizes = slim.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = [F.col("source").asc_nulls_last()]
    held = common.materialize(sizes.sort(*order).withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    shift, before = 33, 0
    offsets = F.create_map(F.lit(-1).cast("long"), F.lit(0).cast("long"))
    part = F.shiftright("at", shift)
    pairs = []
    for r in held.groupBy(part.alias("part")).count().orderBy("part").collect():
        pairs += [F.lit(r["part"]).cast("long"), F.lit(before).cast("long")]
        before += r["count"]
    if pairs:
        offsets = F.create_map(*pairs)
    within = F.col("at").bitwiseAND(F.lit(2**shift - 1))
    return held.select("source", "source_size", (offsets[part] + within).alias("place"))


def targets(sources: DataFrame, weights: tuple = WEIGHTS, total_percent: int = TOTAL_PERCENT, repeats: int = MAX_REPEATS) -> DataFrame:
    """The sources with weight and target. Each round's level is a sum over all sources; sources whose cap
    lies below it stop there, and the rest is shared anew until no cap is met."""
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")).cast("double")
    s = sources.withColumn("weight", weight).withColumn("cap", (repeats * F.col("source_size")).cast("double"))
    total = (s.agg(F.sum("source_size")).first()[0] or 0) * total_percent / 100
    level, stopped = 0.0, -1
    ratio = F.col("cap") / F.col("weight")
    while True:
        r = s.agg(
            F.sum(F.when(ratio <= level, F.col("cap"))).alias("full"), F.sum(F.when(ratio > level, F.col("weight"))).alias("open"),
            F.count(F.when(ratio <= level, 1)).alias("n"),
        ).first()
        if r.n == stopped or not r.open:
            break
        stopped, level = r.n, (total - (r.full or 0.0)) / r.open
    return s.withColumn("target", F.least(F.col("weight") * F.lit(level), "cap")).drop("cap", "place")


def apportioned(shards: DataFrame, blocks: int) -> DataFrame:
    """The shards (shard, votes, most) with quota: the given number of blocks to the highest quotients
    votes / (2k + 1), no shard above most. Equal quotients at the cut-off go in order of shard."""
    def awarded(t: float):
        return F.least(F.col("most"), F.floor(F.col("votes") / (2 * t) + 0.5).cast("long"))

    low, high = 0.0, 2.0 * (shards.agg(F.max("votes")).first()[0] or 0.0) + 1.0
    if blocks > 0:
        for _ in range(PASSES):
            tried = [low + (high - low) * k / FAN for k in range(1, FAN)]
            sums = shards.agg(*(F.sum(awarded(t)).alias(f"n{i}") for i, t in enumerate(tried))).first()
            over = [t for i, t in enumerate(tried) if (sums[i] or 0) >= blocks]
            under = [t for i, t in enumerate(tried) if (sums[i] or 0) < blocks]
            low, high = max([low, *over]), min([high, *under])
    sure = shards.withColumn("quota", awarded(high) if blocks > 0 else F.lit(0).cast("long"))
    left = max(0, blocks - (sure.agg(F.sum("quota")).first()[0] or 0))
    upper = awarded(low) if low > 0 else F.col("most")
    more = (
        sure.where(upper > F.col("quota"))
        .select("shard", F.explode(F.sequence("quota", upper - 1)).alias("k"), "votes")
        .orderBy(F.desc(F.col("votes") / (2 * F.col("k") + 1)), "shard", "k")
        .limit(left)
        .groupBy("shard").agg(F.count("*").alias("more"))
    )
    return sure.join(more, "shard", "left").withColumn("quota", F.col("quota") + F.coalesce("more", F.lit(0))).drop("more")


def _placed(docs: DataFrame, block_words: int, shard_words: int, seed: int) -> DataFrame:
    """Each document's place in its shard's stream, and its shard's quota of blocks."""
    digests = [F.xxhash64(F.lit(k), "text").alias(f"d{k}") for k in (1, 2)]
    slim = common.materialize(docs.select("doc_id", "source", *digests, common.word_count(F.col("text")).alias("size")), "mix-sizes")
    goal = common.materialize(targets(ranked_sources(slim)), "mix-targets")
    n_shards = F.ceil(F.greatest("source_size", F.lit(1)) / shard_words).cast("long")
    placed = (
        slim.join(goal, slim["source"].eqNullSafe(goal["source"])).drop(goal["source"])
        .withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "d1"))
        .withColumn("shard", F.xxhash64("source", F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", "d1"), n_shards)))
    )
    own = placed.groupBy("shard").agg(F.sum("size").alias("words"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))
    shards = common.materialize(
        own.withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("words") / F.col("source_size")).otherwise(0.0))
        .withColumn("n_blocks", F.ceil(F.col("words") / block_words).cast("long"))
        .withColumn("most", MAX_REPEATS * F.col("n_blocks"))
        .select("shard", "words", "votes", "n_blocks", "most"),
        "mix-shards",
    )
    total = shards.agg(F.sum(F.col("votes").cast("decimal(38,6)"))).first()[0] or 0  # exact in any order
    quotas = apportioned(shards, round(float(total) / block_words)).select("shard", "n_blocks", "quota")
    stream = Window.partitionBy("shard").orderBy("order", "doc_id", "d1", "d2", "size").rowsBetween(Window.unboundedPreceding, 0)
    blocks = F.greatest("n_blocks", F.lit(1))
    base = F.floor(F.col("quota") / blocks).cast("long")
    return (
        placed.join(quotas, "shard")
        .withColumn("end", F.sum("size").over(stream)).withColumn("start", F.col("end") - F.col("size"))
        .withColumn("blocks", blocks).withColumn("base", base).withColumn("rest", F.col("quota") - base * F.col("n_blocks"))
        .withColumn("turn", F.pmod(F.xxhash64(F.lit(seed + 2), "shard"), blocks))
    )


def mixed(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): the words that the mix takes of each document."""
    d = _placed(docs, block_words, shard_words, seed)

    def chosen(j):
        """Of the first j blocks, those that are taken once more."""
        return F.floor((j * F.col("rest") + F.col("turn")) / F.col("blocks")).cast("long")

    def before(x):
        """Words taken of the first x words of the stream."""
        j = F.floor(x / block_words).cast("long")
        return F.col("base") * x + chosen(j) * block_words + (chosen(j + 1) - chosen(j)) * (x - j * block_words)

    taken = (before(F.col("end")) - before(F.col("start"))).cast("long")
    return d.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))


def applied(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, seed: int = SEED) -> DataFrame:
    """The mix itself, with the columns of the documents: a document whole for each full turn of its shard,
    and once more with the words of the blocks that are taken again, a line break between stretches that
    don't touch. A document of which nothing is taken, such as an empty one, is left out. Rows that agree in doc_id,
    source and text lie side by side in the stream; one of them, the least in its other columns, stands for all."""
    common.bound_batches(docs)
    key = ["id", "source_", "one", "two"]
    id_, source_, one, two, copies, start_, base_, rest_, turn_, blocks_ = new = common.unused(docs.columns, *key, "copies", "start", "base", "rest", "turn", "blocks")
    keys = ["doc_id", "source", "d1", "d2"]
    plan = common.materialize(
        _placed(docs.select("doc_id", "source", "text"), block_words, shard_words, seed).where("size > 0 and (base > 0 or rest > 0)")
        .groupBy(*keys, "base", "rest", "turn", "blocks").agg(F.count("*").alias("copies"), F.min("start").alias("start"))
        .select(*(F.col(a).alias(b) for a, b in zip([*keys, "copies", "start", "base", "rest", "turn", "blocks"], new, strict=True))),
        "mix-plan",
    )
    same = F.col("doc_id").eqNullSafe(F.col(id_)) & F.col("source").eqNullSafe(F.col(source_)) & (F.xxhash64(F.lit(1), "text") == F.col(one)) & (F.xxhash64(F.lit(2), "text") == F.col(two))
    both = common.join_by_id(docs, plan, same, "inner").drop(id_, source_)
    if plan.where(F.col(copies) > 1).take(1):
        # only rows that have equals are grouped; of each group a task sends on one row
        row = F.struct(*(F.col(c).alias(f"c{i}") for i, c in enumerate(docs.columns)))
        grouped = [copies, start_, base_, rest_, turn_, blocks_]
        twins = both.where(F.col(copies) > 1).withColumn("row", row).groupBy("doc_id", "source", one, two, *grouped).agg(F.min("row").alias("row"))
        twins = twins.select(*(F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)), one, two, *grouped)
        both = both.where(F.col(copies) == 1).union(twins)
    both = both.drop(one, two)
    names = docs.columns
    place = names.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        for batch in batches:
            rows, texts = [], []
            more = [batch.column(i).to_pylist() for i in range(len(names), batch.num_columns)]
            for i, text in enumerate(batch.column(place)):
                text = text.as_py() or ""
                copies, first, base, rest, turn, blocks = (c[i] for c in more)
                words = [m.span() for m in _WORD.finditer(text)]
                rows += [i] * base * copies
                texts += [text] * base * copies
                for start in range(first, first + copies * len(words), len(words)):
                    parts: list[list[int]] = []
                    for j in range(start // block_words, (start + len(words) - 1) // block_words + 1):
                        if ((j + 1) * rest + turn) // blocks > (j * rest + turn) // blocks:
                            a, b = max(0, j * block_words - start), min(len(words), (j + 1) * block_words - start)
                            if parts and parts[-1][1] == a:
                                parts[-1][1] = b
                            else:
                                parts.append([a, b])
                    if parts:
                        rows.append(i)
                        texts.append(text if parts == [[0, len(words)]] else "\n".join(text[words[a][0] : words[b - 1][1]] for a, b in parts))
            out = batch.select(list(range(len(names)))).take(pa.array(rows, pa.int64()))
            cols = out.columns
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(cols, names)

    return both.mapInArrow(cut, docs.schema)


_WORD = re.compile(common.WORD)
