"""Line dedup: drop lines that other documents hold too, but for the smallest doc_id that holds them.

A line's key is the line without white space at its ends, A-Z in lower case. Keys of fewer than
``MIN_CHARS`` code points are never dropped.

1. Lines are counted, and the filters sized by ``LINE_BITS`` a line.
2. Each task hashes its documents' distinct keys and marks two probe bits a key in a once-seen filter,
   and in a twice-seen filter if it met the key in two documents. It emits marks as sorted positions by
   filter segment, a few bytes a line.
3. Segments merge: a bit once-seen by two tasks becomes twice-seen. False positives can arise here,
   false negatives cannot.
4. The twice-seen filter, of ``FILTER_BITS`` / 8 bytes at most, is broadcast. Lines that it doesn't know are
   done; only suspected repeats shuffle. Smallest and largest doc_id by key (one row a key and task enters the
   shuffle) confirm exactly which keys at least two documents hold.
5. Line keys to drop return to their documents by doc_id.

A filter of that size with fewer than ``LEAST_BITS`` a line would suspect nearly everything. Then 128-bit digests
of all keys shuffle in place of suspects; the result is the same. More suspects never change the result. Null and
empty texts have one empty line. Rows of equal doc_id count as one document; rows of null doc_id neither claim nor
lose lines. A document keeps all its lines of a key or none. Other columns pass through unchanged, but for those
named as the new ones, which are replaced. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

MIN_CHARS = 10
#: Bits of the filters at most (32 MB are broadcast), of their segments, and by line: as sized, and at least.
FILTER_BITS, SEGMENT_BITS = 2**28, 2**20
LINE_BITS, LEAST_BITS = 12, 4
#: Keys that a task holds before it emits its marks.
CHUNK = 500_000


def line_key(line: bytes) -> bytes:
    """The key of a line in UTF-8."""
    return line.strip(common.SPACE_BYTES).lower()


def counts(key: bytes) -> bool:
    """Whether a key is long enough, in code points, to be dropped."""
    return len(key) >= 4 * MIN_CHARS or len(key) >= MIN_CHARS and len(key.decode("utf-8", "replace")) >= MIN_CHARS


def _probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    mask = np.uint64(bits - 1)
    return np.concatenate([hashes & mask, (hashes >> np.uint64(32)) * np.uint64(0x9E3779B1) & mask]).astype(np.int64)


def _marks(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        def emit(held: list[np.ndarray]) -> pa.RecordBatch:
            seen, n = np.unique(np.concatenate(held), return_counts=True)
            rows = []
            once, twice = np.unique(_probes(seen, bits)), np.unique(_probes(seen[n > 1], bits))
            segment = min(SEGMENT_BITS, bits)
            for k in np.unique(once // segment).tolist():
                a, b = ((x[np.searchsorted(x, k * segment) : np.searchsorted(x, (k + 1) * segment)] - k * segment).astype("<i4") for x in (once, twice))
                rows.append((k, a.tobytes(), b.tobytes()))
            cols = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["segment", "once", "twice"])

        held: list[np.ndarray] = []
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                if doc.is_valid and text.is_valid:
                    own = [xxhash.xxh3_64_intdigest(x) for x in _keys(text.as_py())]
                    if own:
                        held.append(np.array(own, np.uint64))
            if sum(map(len, held)) > CHUNK:
                yield emit(held)
                held = []
        if held:
            yield emit(held)

    return run


def _merged(bits: int):
    segment = min(SEGMENT_BITS, bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        def emit() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([np.packbits(twice).tobytes()], pa.binary())], ["segment", "bits"])

        at, once, twice = None, None, None
        for batch in batches:
            for k, a, b in zip(*batch.columns, strict=True):
                if k.as_py() != at:
                    if at is not None and twice.any():
                        yield emit()
                    at, once, twice = k.as_py(), np.zeros(segment, bool), np.zeros(segment, bool)
                a, b = np.frombuffer(a.as_py(), "<i4"), np.frombuffer(b.as_py(), "<i4")
                twice[a[once[a]]] = True
                twice[b] = True
                once[a] = True
        if at is not None and twice.any():
            yield emit()

    return run


def repeat_filter(docs: DataFrame, bits: int) -> np.ndarray:
    """The twice-seen filter of the line keys, as packed bits."""
    slim = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    marks = slim.mapInArrow(_marks(bits), "segment int, once binary, twice binary")
    size = min(SEGMENT_BITS, bits)
    merged = marks.repartition(min(64, bits // size), "segment").sortWithinPartitions("segment").mapInArrow(_merged(bits), "segment int, bits binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in merged.collect():  # as many bytes as the filter has, which FILTER_BITS bounds
        out[r.segment * size // 8 : (r.segment + 1) * size // 8] = np.frombuffer(r.bits, np.uint8)
    return out


def _keys(text: bytes) -> list[bytes]:
    """The different keys of a text that are long enough."""
    return [x for x in {line_key(x) for x in text.split(b"\n") if len(x) >= MIN_CHARS} if counts(x)]


def _suspects(known, bits: int):
    """Keys that the twice-seen filter knows, whole."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        twice = known.value
        for batch in batches:
            ids: list[int] = []
            hashes: list[int] = []
            keys: list[bytes] = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                own = _keys(text.as_py()) if doc.is_valid and text.is_valid else []
                if own:
                    h = np.array([xxhash.xxh3_64_intdigest(x) for x in own], np.uint64)
                    p = _probes(h, bits)
                    hit = (twice[p >> 3] >> (7 - (p & 7)).astype(np.uint8) & 1).astype(bool)
                    for i in np.flatnonzero(hit[: len(h)] & hit[len(h) :]).tolist():
                        ids.append(doc.as_py())
                        hashes.append(int(h[i].astype(np.int64)))
                        keys.append(own[i])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(keys, pa.binary())], ["doc_id", "hash", "key"])

    return run


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All keys, as digests."""
    common.lean_worker()
    for batch in batches:
        rows = [(doc.as_py(), xxhash.xxh3_64_intdigest(x), xxhash.xxh3_128_digest(x)) for doc, text in zip(*batch.columns, strict=True) if doc.is_valid and text.is_valid for x in _keys(text.as_py())]
        ids, hashes, keys = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.array(hashes, np.uint64).view(np.int64)), pa.array(keys, pa.binary())], ["doc_id", "hash", "key"])


def repeats(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """(doc_id, drop): hashes of the keys that each document loses; documents that lose none are left out. bits: of
    the filters, a power of 2; sized by the number of lines if not given, and no filters with 0."""
    if bits is None:
        breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
        lines = docs.agg(F.sum(breaks + 1)).first()[0] or 0
        bits = min(FILTER_BITS, max(SEGMENT_BITS, 1 << (LINE_BITS * lines).bit_length())) if lines * LEAST_BITS <= FILTER_BITS else 0
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    find = _suspects(docs.sparkSession.sparkContext.broadcast(repeat_filter(docs, bits)), bits) if bits else _digests
    found = common.materialize(slim.mapInArrow(find, "doc_id long, hash long, key binary"), "line-suspects")
    # a table, so that the join shuffles both sides and a common key's rows can be split among tasks
    owners = common.materialize(found.groupBy("key").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("last")).where("owner < last").drop("last"), "line-owners")
    lost = found.join(owners, "key").where("doc_id > owner").select("doc_id", "hash").distinct()
    return lost.groupBy("doc_id").agg(F.collect_list("hash").alias("drop"))


#: Columns that deduplicated() adds to those of its input.
NEW = ["n_lines", "n_dropped"]


def deduplicated(docs: DataFrame, bits: int | None = None) -> DataFrame:
    """The documents without repeated lines, with n_lines (before) and n_dropped. A null text stays null if
    nothing is dropped from it; a document that loses every line has an empty text."""
    common.bound_batches(docs)
    docs = docs.drop(*(c for c in NEW if c in docs.columns))
    own, gone_ = common.unused(docs.columns, "own_id", "drop")
    lost = common.materialize(repeats(docs.select("doc_id", "text"), bits).select(F.col("doc_id").alias(own), F.col("drop").alias(gone_)), "line-drops")
    rows = lost.agg(F.sum(F.size(gone_))).first()[0] or 0
    both = common.join_by_id(docs, lost, F.col("doc_id").cast("long") == F.col(own), "left", rows).drop(own)
    place = docs.columns.index("text")

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        for batch in batches:
            texts, before, gone = [], [], []
            for text, drop in zip(batch.column(place), batch.column(batch.num_columns - 1), strict=True):
                text, drop = text.as_py(), drop.as_py()
                before.append((text or "").count("\n") + 1)
                dropped = 0
                if drop:
                    drop, kept = set(drop), []
                    for line in text.encode().split(b"\n"):
                        key = line_key(line)
                        if len(key) >= MIN_CHARS and counts(key) and int(np.uint64(xxhash.xxh3_64_intdigest(key)).astype(np.int64)) in drop:
                            dropped += 1
                        else:
                            kept.append(line)
                    text = b"\n".join(kept).decode()
                texts.append(text)
                gone.append(dropped)
            cols = batch.columns[:-1]
            cols[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*cols, pa.array(before, pa.int64()), pa.array(gone, pa.int64())], [*batch.schema.names[:-1], *NEW])

    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in NEW)])
    return both.mapInArrow(rebuild, schema)
