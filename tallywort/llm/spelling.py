"""Spelling variant grouping by rolling-hash deletions.

Words that differ by one inserted, deleted or replaced code point share a key: both without the replaced place, or the
longer without the inserted place and the shorter as it is. Keys are 64-bit integers made from prefix and suffix
polynomial hashes, for all places of all words of a batch at once; no deleted string is built. Keys are partitioned by
their leading bits and sorted there. Only words whose key came twice travel on with their strings, and it is the strings
that are grouped then, so a collision of hashes can't make a link.

A group is reduced to its size and its best word. No pairs are formed: a word that several groups hold sums their sizes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: The letters of a run.
LETTERS = r"A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: One run in so many loses a code point (a fixed value of the data preparation).
EVERY = 199
#: Keys that a task sorts at once; the number of partitions follows the counted keys.
KEYS_A_BUCKET = 1 << 18
#: Code points whose keys are made at once.
CHUNK = 1 << 18
#: The base of the polynomials, odd so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 2**64)
#: Kinds of keys: one place open, one place deleted, the word as it is.
OPEN, DELETED, WHOLE = 0, 1, 2
ENTRY = np.dtype([("key", "<u8"), ("id", "<i8"), ("at", "<i4"), ("kind", "i1")])


def counted_words(docs: DataFrame, min_chars: int, min_count: int) -> DataFrame:
    """(word, n): the words of documents (doc_id, text) with their number of occurrences, after the deletions that the
    runs' checksums order. Expressions only; counts are summed in the tasks before the shuffle."""
    runs = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"[{LETTERS}]{{{min_chars},}}"), F.lit(0))
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    folded = docs.select(key.alias("doc"), F.explode(runs).alias("run")).select("doc", F.translate("run", UPPER, LOWER).alias("run"))
    h = F.crc32(F.concat_ws(":", "doc", "run"))
    hashed = folded.select("run", h.alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = hashed.select(F.when(F.col("h") % EVERY == 0, shorter).otherwise(F.col("run")).alias("word"))
    return words.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def ranked(words: DataFrame) -> DataFrame:
    """The words with an id that grows as n falls and, among equals, with the word: the best of a group is its least id."""
    return common.materialize(words.orderBy(F.desc("n"), "word").withColumn("id", F.monotonically_increasing_id()), "spelling-words")


def keys_of(words: list[str], ids: np.ndarray) -> np.ndarray:
    """The keys of some words, as entries."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.uint64)
    if not len(points):
        return np.empty(0, ENTRY)
    starts = np.cumsum(lengths) - lengths
    word = np.repeat(np.arange(len(words)), lengths)
    at = np.arange(len(points)) - starts[word]
    powers = np.ones(int(lengths.max()), np.uint64)
    powers[1:] = np.uint64(BASE)
    powers = np.multiply.accumulate(powers)
    # sums modulo 2^64 up to each place, from the word's start, and behind it, to the word's end
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(common.mix64(points + np.uint64(1)) * powers[at])])
    before = sums[:-1] - sums[starts][word]
    whole = sums[starts + lengths] - sums[starts]
    behind = sums[starts + lengths][word] - sums[1:]
    # deleting any place of a run of equal letters gives the same string: only the first counts
    first = (at == 0) | (points != np.concatenate([points[:1], points[:-1]]))
    out = np.empty(len(points) + int(first.sum()) + int((lengths > 0).sum()), ENTRY)
    n, m = len(points), len(points) + int(first.sum())
    out["key"][:n] = common.mix64(before + behind + common.mix64(at.astype(np.uint64) + np.uint64(0x5BD1E995)))
    out["key"][n:m] = common.mix64(before + behind * np.uint64(INVERSE))[first]
    out["key"][m:] = common.mix64(whole)[lengths > 0]
    out["id"][:n], out["id"][n:m], out["id"][m:] = ids[word], ids[word[first]], ids[lengths > 0]
    out["at"][:n], out["at"][n:m], out["at"][m:] = at, at[first], 0
    out["kind"][:n], out["kind"][n:m], out["kind"][m:] = OPEN, DELETED, WHOLE
    return out


def _chunks(words: list[str], ids: np.ndarray) -> Iterator[tuple[list[str], np.ndarray]]:
    """Stretches of a batch of about CHUNK code points."""
    begin = size = 0
    for i, w in enumerate(words):
        size += len(w)
        if size >= CHUNK:
            yield words[begin : i + 1], ids[begin : i + 1]
            begin, size = i + 1, 0
    if begin < len(words):
        yield words[begin:], ids[begin:]


def repeated(entries: np.ndarray) -> np.ndarray:
    """The entries whose key can link words: one open at the same place in two, or deleted in one and whole in another."""
    entries = entries[np.argsort(entries["key"], kind="stable")]
    edge = np.flatnonzero(np.concatenate([[True], entries["key"][1:] != entries["key"][:-1]])) if len(entries) else np.empty(0, np.int64)
    if not len(edge):
        return entries
    of = [np.add.reduceat((entries["kind"] == k).astype(np.int64), edge) for k in (OPEN, DELETED, WHOLE)]
    links = (of[0] > 1) | (of[1] > 0) & (of[2] > 0)
    return entries[np.repeat(links, np.diff(np.append(edge, len(entries))))]


def members(words: DataFrame, hash_bits: int = 64) -> DataFrame:
    """(id, at, kind) of the keys that came twice. Keys are dealt by their leading bits in packed blocks, so that
    partitions are alike in size whatever the words are, and sorted there."""
    total = words.agg(F.sum(2 * F.length("word") + 1)).first()[0] or 0
    bits = max(4, int(total // KEYS_A_BUCKET).bit_length())

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some, ids in _chunks(batch.column("word").to_pylist(), batch.column("id").to_numpy(zero_copy_only=False)):
                entries = keys_of(some, ids)
                entries["key"] &= np.uint64(2**64 - 2 ** (64 - hash_bits))
                bucket = (entries["key"] >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
                order = np.argsort(bucket, kind="stable")  # a radix sort up to 16 bits
                entries, bucket = entries[order], bucket[order]
                edge = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(bucket) else np.empty(0, np.int64)
                ends = np.append(edge[1:], len(bucket))
                blocks = [entries[a:b].tobytes() for a, b in zip(edge, ends, strict=True)] if len(edge) else []
                yield pa.RecordBatch.from_arrays([pa.array(bucket[edge].astype(np.int32), pa.int32()), pa.array(blocks, pa.binary())], ["bucket", "block"])

    def meet(table: pa.Table) -> pa.Table:
        blocks = [np.frombuffer(b.as_buffer(), ENTRY) for b in table.column("block")]
        found = repeated(np.concatenate(blocks))
        return pa.table({"id": pa.array(found["id"]), "at": pa.array(found["at"]), "kind": pa.array(found["kind"].astype(np.int32))})

    blocks = words.select("word", "id").mapInArrow(deal, "bucket int, block binary")
    return blocks.groupBy("bucket").applyInArrow(meet, "id long, at int, kind int")


def neighbours(words: DataFrame, hash_bits: int = 64) -> DataFrame:
    """(id, n_near, best): the number of words at distance one and the least id of a group that holds one; the id may be
    the word's own, where it is the best of its groups."""
    m = members(words, hash_bits).join(words.select("id", "word"), "id")
    left, right = F.substring(F.col("word"), F.lit(1), F.col("at")), F.substring(F.col("word"), F.col("at") + 2, F.length("word"))
    rest = F.when(F.col("kind") == OPEN, F.concat(left, F.lit("\0"), right)).when(F.col("kind") == DELETED, F.concat(left, right)).otherwise(F.col("word"))
    group = Window.partitionBy("rest")
    of = lambda k, x: F.when(F.col("kind") == k, x)
    seen = m.select("id", "kind", rest.alias("rest")).select(
        "id", "kind", F.count("*").over(group).alias("size"), F.min("id").over(group).alias("first"),
        F.count(of(DELETED, 1)).over(group).alias("longer"), F.min(of(DELETED, F.col("id"))).over(group).alias("first_longer"), F.min(of(WHOLE, F.col("id"))).over(group).alias("shorter"),
    )
    near = F.when(F.col("kind") == OPEN, F.col("size") - 1).when(F.col("kind") == WHOLE, F.col("longer")).otherwise(F.when(F.col("shorter").isNotNull(), 1).otherwise(0))
    best = F.when(F.col("kind") == OPEN, F.col("first")).when(F.col("kind") == WHOLE, F.col("first_longer")).otherwise(F.col("shorter"))
    return seen.select("id", near.cast("long").alias("near"), best.alias("best")).where("near > 0").groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): where following forms (id, form) ends. Each round lets a word jump to its root's root, so rounds grow
    with the logarithm of a chain's length, and a chain has few steps, since each multiplies n. Forms can't make a ring."""
    links = common.materialize(forms.select("id", F.col("form").alias("root")), "spelling-roots")
    while True:
        far = links.select(F.col("id").alias("_id"), F.col("root").alias("_far"))
        new = common.materialize(links.join(far, F.col("root") == F.col("_id"), "left").select("id", F.coalesce("_far", "root").alias("root"), F.col("_far").isNotNull().alias("moved")), "spelling-roots")
        links = new.select("id", "root")
        if not new.where("moved").take(1):
            return links


def variants(docs: DataFrame, min_chars: int = 6, min_count: int = 5, ratio: int = 5, hash_bits: int = 64) -> DataFrame:
    """(word, form, root, n, n_near, form_n): one row a word of at least min_chars code points that occurs at least
    min_count times. Its form is its near word of largest n (of equal ones the first in code-point order), if that n is at
    least ratio times its own, else null; its root is where forms lead, itself without one. Fewer hash_bits mean more
    collisions, which the strings settle.

    Null and empty texts have no words; a null doc_id counts as an empty one in the checksum; repeated rows count again;
    other columns are ignored; words may be of any length; an empty table gives no rows.
    """
    if ratio < 2:
        raise ValueError("a form must be more frequent than its word")
    common.bound_batches(docs)
    words = ranked(counted_words(docs.select("doc_id", "text"), min_chars, min_count))
    near = common.materialize(neighbours(words, hash_bits), "spelling-near")
    own, best = words.select("id", "n"), words.select(F.col("id").alias("best"), F.col("n").alias("form_n"))
    forms = near.join(own, "id").join(best, "best").where(F.col("form_n") >= ratio * F.col("n"))
    forms = common.materialize(forms.select("id", F.col("best").alias("form"), "form_n"), "spelling-forms")
    name = lambda c: words.select(F.col("id").alias(f"_{c}"), F.col("word").alias(f"{c}_word"))
    found = forms.join(roots(forms), "id").join(name("form"), F.col("form") == F.col("_form")).join(name("root"), F.col("root") == F.col("_root"))
    found = found.select("id", "form_n", "form_word", "root_word")
    out = words.join(near.select("id", "n_near"), "id", "left").join(found, "id", "left")
    return out.select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")
