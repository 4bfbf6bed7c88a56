"""Quality rules: word and line statistics of every text, and the divergence of its histograms from its language's.

Two histograms are compared with a reference by Jensen-Shannon distance (base 2, so 0 to 1):

* character classes: lower case, upper case, digits, white space, sentence punctuation, exclamation
  marks, symbols, other ASCII, non-ASCII characters;
* common words: the ``TOP_WORDS`` most frequent lower-cased words of the language, and the rest.

A language's reference sums the histograms of all its documents; documents of null language use the sum of all.
References go to the tasks as a broadcast while there are at most ``HELD`` languages, else with their documents by
a join, with the same result. A text shorter than the guards is never judged by a distance, since its histogram is mostly noise.

Null and empty texts have no words, all counts 0, and fail the base rule. Rows are judged one by one, so
repeated rows get equal verdicts. Other columns pass; those named as the new ones are replaced. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Bytes of the character classes.
LOWER = b"abcdefghijklmnopqrstuvwxyz"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
DIGITS = b"0123456789"
PUNCTUATION = b".,;:?'\"()-"
SHOUTING = b"!"
SYMBOLS = b"#*$%&|<>"

TOP_WORDS = 64
HELD = 1_000
#: Parts in which a language's words are ranked before their best are ranked together.
PARTS = 16
MIN_WORDS = 30
MIN_CHARS = 150
MAX_CHAR_DISTANCE = 0.24
MAX_WORD_DISTANCE = 0.49
MIN_BASE_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5

_CLASSES = (LOWER, UPPER, DIGITS, common.SPACE_BYTES, PUNCTUATION, SHOUTING, SYMBOLS)
_CLASS_OF = np.full(256, len(_CLASSES), np.int64)
for _k, _members in enumerate(_CLASSES):
    _CLASS_OF[list(_members)] = _k
_CLASS_OF[0xC0:] = len(_CLASSES) + 1
_CLASS_OF[0x80:0xC0] = len(_CLASSES) + 2  # bytes inside a character, not counted
N_CLASSES = len(_CLASSES) + 2
_BY_CLASS = np.zeros((256, N_CLASSES + 1))
_BY_CLASS[np.arange(256), _CLASS_OF] = 1


def repeated_words(hashes: np.ndarray, k: int = WINDOW) -> int:
    """Words inside runs of k words that the text holds at least twice."""
    runs = common.window_hashes(hashes, k)
    if len(runs) < 2:
        return 0
    order = np.argsort(runs, kind="stable")
    same = runs[order[1:]] == runs[order[:-1]]
    if not same.any():
        return 0
    starts = np.zeros(len(hashes) + 1, np.int64)
    again = np.zeros(len(runs), bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    at = np.flatnonzero(again)
    np.add.at(starts, at, 1)
    np.add.at(starts, at + k, -1)
    return int((np.cumsum(starts)[:-1] > 0).sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(common.SPACE_BYTES)]
    return len(lines) - len(set(lines))


def histogram(text: bytes) -> np.ndarray:
    """Characters of a text by class."""
    return (np.bincount(np.frombuffer(text, np.uint8), minlength=256) @ _BY_CLASS)[:N_CLASSES]


def distance(p: np.ndarray, q: np.ndarray) -> float:
    """Jensen-Shannon distance of two histograms; 0 if either is empty."""
    if not p.sum() or not q.sum():
        return 0.0
    p, q = p / p.sum(), q / q.sum()
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        total = np.where(p > 0, p * np.log2(p / m), 0).sum() + np.where(q > 0, q * np.log2(q / m), 0).sum()
    return float(np.sqrt(max(0.0, total / 2)))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial counts by language: words, and character classes under names that no word can have."""
    common.lean_worker()

    def flush(counts: dict) -> pa.RecordBatch:
        rows = [(lang, key, n) for lang, c in counts.items() for key, n in c.items()]
        lang, key, n = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(lang, pa.string()), pa.array(key, pa.binary()), pa.array(n, pa.int64())], ["lang", "key", "n"]
        )

    counts: dict = {}
    for batch in batches:
        for lang, text in zip(batch.column(0), batch.column(1), strict=True):
            lang, text = lang.as_py(), text.as_py() or b""
            c = counts.setdefault(lang, Counter())
            c.update(text.lower().split())
            for k, n in enumerate(histogram(text).astype(int).tolist()):
                c[b" %d" % k] += n
        if sum(map(len, counts.values())) > 100_000:
            yield flush(counts)
            counts = {}
    if counts:
        yield flush(counts)


def references(docs: DataFrame) -> DataFrame:
    """A row by language, and one of null that sums all: (lang, chars, words, counts), character-class counts, the common
    words by rank, and their counts (last: all others)."""
    by_lang = (
        docs.select("lang", F.col("text").cast("binary").alias("text"))
        .mapInArrow(_counted, "lang string, key binary, n long")
        .groupBy("lang", "key")
        .agg(F.sum("n").alias("n"))
    )
    counts = common.materialize(by_lang, "word-counts")
    is_class = F.substring("key", 1, 1) == F.lit(b" ")
    every = counts.groupBy("key").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "key", "n")
    both = counts.where("lang is not null").select("lang", "key", "n").union(every)
    best = Window.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(PARTS))).orderBy(F.desc("n"), "key")
    top = both.where(~is_class).withColumn("r", F.row_number().over(best)).where(F.col("r") <= TOP_WORDS)
    top = top.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))).where(F.col("r") <= TOP_WORDS)
    words = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "key", "n"))).alias("top"))
    totals = both.groupBy("lang").agg(
        F.sum(F.when(~is_class, F.col("n")).otherwise(0)).alias("total"),
        *(F.sum(F.when(F.col("key") == F.lit(b" %d" % k), F.col("n")).otherwise(0)).alias(f"c{k}") for k in range(N_CLASSES)),
    )
    n = F.coalesce(F.transform("top", lambda x: x["n"]), F.array().cast("array<long>"))
    rest = F.col("total") - F.aggregate(n, F.lit(0).cast("long"), lambda a, x: a + x)
    placed = totals.alias("t").join(words.alias("w"), F.col("t.lang").eqNullSafe(F.col("w.lang")), "left")
    return common.materialize(
        placed.select(
            "t.lang", F.array(*(f"c{k}" for k in range(N_CLASSES))).alias("chars"),
            F.coalesce(F.transform("top", lambda x: x["key"]), F.array().cast("array<binary>")).alias("words"), F.concat(n, F.array(rest)).alias("counts"),
        ),
        "word-references",
    )


@dataclass
class Reference:
    chars: np.ndarray
    places: dict[bytes, int]
    counts: np.ndarray

    @classmethod
    def of(cls, chars: list, words: list, counts: list) -> Reference:
        return cls(np.array(chars, float), {bytes(w): i for i, w in enumerate(words)}, np.array(counts, float))


def measured(text: bytes, ref: Reference) -> tuple:
    """The values of NEW for a text."""
    words = text.split()
    bytes_ = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = (bytes_ @ _BY_CLASS)[:N_CLASSES]
    near = far = 0.0
    if len(words) >= MIN_WORDS and classes.sum() >= MIN_CHARS:
        near = distance(classes, ref.chars)
        found = np.bincount([ref.places[w] for w in text.lower().split() if w in ref.places], minlength=len(ref.places)).astype(float)
        far = distance(np.append(found, len(words) - found.sum()), ref.counts)
    n_repeat = repeated_words(common.word_hashes(words)) if len(words) > WINDOW else 0
    failed = len(words) < MIN_BASE_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * len(words)
    kept = not failed and near <= MAX_CHAR_DISTANCE and far <= MAX_WORD_DISTANCE
    return len(words), int(classes.sum() - classes[3]), int(bytes_[list(SYMBOLS)].sum()), repeated_lines(text), n_repeat, near, far, failed, kept


def judged(docs: DataFrame) -> DataFrame:
    """The documents with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance,
    word_distance, base_failed and kept. A document is kept if it passes the base rule and neither of its
    histograms, where it is long enough to have one, is further from its language's than the threshold."""
    common.bound_batches(docs)
    plain = docs.drop(*(c for c in NEW if c in docs.columns))
    table = references(docs.select("lang", "text"))
    held = None
    own = common.unused(plain.columns, "ref_lang", "ref_chars", "ref_words", "ref_counts")
    if table.count() <= HELD:
        held = docs.sparkSession.sparkContext.broadcast({r["lang"]: Reference.of(*r[1:]) for r in table.collect()})
        rows = plain
    else:
        rows = plain.join(table.toDF(*own), F.col("lang").eqNullSafe(F.col(own[0])), "left").drop(own[0])
    n = len(plain.columns)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        known: dict = held.value if held is not None else {}
        for batch in batches:
            out = []
            for i, (lang, text) in enumerate(zip(batch.column(batch.schema.get_field_index("lang")), batch.column(batch.schema.get_field_index("text")), strict=True)):
                lang = lang.as_py()
                if lang not in known:
                    if len(known) > HELD:
                        known.clear()
                    known[lang] = Reference.of(*(batch.column(n + k)[i].as_py() for k in range(3)))
                out.append(measured((text.as_py() or "").encode(), known[lang]))
            cols = list(zip(*out, strict=True)) or [()] * 9
            types = [pa.int64()] * 5 + [pa.float64()] * 2 + [pa.bool_()] * 2
            fields = [*list(batch.schema)[:n], *(pa.field(n, t) for n, t in zip(NEW, types, strict=True))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], schema=pa.schema(fields))

    kinds = [T.LongType()] * 5 + [T.DoubleType()] * 2 + [T.BooleanType()] * 2
    added = [T.StructField(n, k) for n, k in zip(NEW, kinds, strict=True)]
    return rows.mapInArrow(measure, T.StructType([*plain.schema.fields, *added]))


NEW = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept"]
