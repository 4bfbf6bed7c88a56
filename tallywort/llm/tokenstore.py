"""Token ids in binary shards, with a minimal perfect hash index from document keys to shard offsets.

A shard is a file of raw little-endian ids, 2 bytes each where the vocabulary allows, else 4, followed by the end of each
record (8 bytes, in ids from the shard's start) and a trailer. Shards follow each other in ascending order of the key.

An index file holds the keys of one range of hashes: levels of bits, in which a key's place at the first level where no
other key fell on it ranks it among all, and a slot for each rank: fingerprint, number of records, shard, offset, length.
A lookup is a few bit tests, one slot and one read, whatever the number of documents. Keys that no level tells apart, as
only keys of equal hash may be, are listed at the end. The 64-bit hash is one-to-one for integers.
"""

from __future__ import annotations

import itertools
import os
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Characters of texts of a shard, beyond which there are more shards than shuffle partitions.
SHARD_CHARS = 1 << 27
#: Keys of an index file.
KEYS_A_BLOCK = 1 << 18
#: Bits of a level for each key left, most levels, and what the trailer and an index file begin with.
GAMMA, LEVELS = 2, 32
MAGIC = b"TWTS0001"
TRAILER = struct.Struct("<8sIIQQ")
SLOT = np.dtype([("fingerprint", "<u4"), ("count", "<u4"), ("shard", "<u4"), ("record", "<u8"), ("offset", "<u8"), ("length", "<u8")])
REST = np.dtype([("hash", "<u8"), ("null", "<u4"), ("slot", "<u4")])
#: Characters of texts that are encoded together, remembered chunks of a generation, and a chunk's greatest length.
ENCODE_CHARS, REMEMBERED, CHUNK_CHARS = 1 << 21, 1 << 18, 48
#: Marks that end a word, and the last letter whose lower case is one letter whatever stands around it.
MARKS, LAST_LATIN = ".,;:!?#$%&*()", "\u00ff"
#: Words that are encoded in one call, and the mark between them.
TOGETHER, BETWEEN = 64, "|"
#: Bytes that are read at once, and the gap between records over which reading goes on.
READ_BYTES, GAP_BYTES = 1 << 22, 1 << 16
SEED = 42
#: Columns of a document's place.
PLACE = ["key", "shard", "record", "offset", "length", "count"]


def _word_and_marks(chunk: str) -> tuple[str, str]:
    """A chunk as a word and the marks behind it, if both are encoded alike on their own, else as one part."""
    word = chunk.rstrip(MARKS)
    if not word or word == chunk or not word[-1].isalpha() or max(word) > LAST_LATIN:
        return chunk, ""
    return word, chunk[len(word) :]


class Encoder:
    """Ids of texts as bytes. With by_chunk, what stands between spaces and line feeds is encoded on its own and
    remembered, words apart from the marks behind them, and texts of Latin letters without their capitals. That gives equal ids for tokenizers
    that fold case, keep letters apart from marks, end a token at white space and drop it; others need by_chunk off."""

    def __init__(self, path: str, end_id: int, by_chunk: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.kind = np.dtype("<u2" if max(self.model.get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.kind).tobytes()
        self.by_chunk = by_chunk
        self.added = [x.content for x in self.model.get_added_tokens_decoder().values()]
        self.between = self.model.encode(BETWEEN, add_special_tokens=False).ids
        self.recent: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, self.kind).tobytes() for x in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of chunks, many in one call: they are joined by a mark of one id that none of them holds, and the ids are
        cut at it."""
        if len(self.between) != 1:
            return self._whole(words)
        plain = [w for w in words if BETWEEN not in w and len(w) <= CHUNK_CHARS]
        glue = f" {BETWEEN} "
        runs = self.model.encode_batch_fast([glue.join(plain[i : i + TOGETHER]) for i in range(0, len(plain), TOGETHER)], add_special_tokens=False)
        ids = np.concatenate([np.empty(0, self.kind), *(np.array(r.ids + self.between, self.kind) for r in runs)])
        ends = np.flatnonzero(ids == self.between[0]) * self.kind.itemsize
        starts = np.concatenate([[0], ends[:-1] + self.kind.itemsize])[: len(ends)]
        data = ids.tobytes()
        coded = dict(zip(plain, (data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), strict=True))
        rest = [w for w in words if w not in coded]
        coded.update(zip(rest, self._whole(rest), strict=True))
        return [coded[w] for w in words]

    def _lower(self, text: str) -> str:
        """A text of Latin letters without its capitals, unless that spells a token that is looked for in texts as they are."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text
        low = text.lower()
        return text if any(x in low for x in self.added) else low

    def _remembered(self, chunks: list[str]) -> list[bytes | None]:
        """What is remembered of chunks; what the older generation holds moves to the recent one."""
        out, older = list(map(self.recent.get, chunks)), self.older
        if older:
            for i in [i for i, x in enumerate(out) if x is None and chunks[i] in older]:
                out[i] = self.recent[chunks[i]] = older[chunks[i]]
        return out

    def _ids_of(self, chunks: list[str]) -> list[bytes]:
        """Ids of different chunks, remembered or not."""
        out = self._remembered(chunks)
        at = [i for i, x in enumerate(out) if x is None]
        new = [chunks[i] for i in at]
        parts = {c: pair for c in new if not c.isalpha() and (pair := _word_and_marks(c))[1]}
        more = list({x for pair in parts.values() for x in pair})
        first = sorted({c for c in new if c not in parts}.union(x for x, ids in zip(more, self._remembered(more), strict=True) if ids is None))
        recent = self.recent
        recent.update(zip(first, self._words(first), strict=True))
        for c, (word, marks) in parts.items():
            recent[c] = recent[word] + recent[marks]
        for i, c in zip(at, new, strict=True):
            out[i] = recent[c]
        for c in [c for c in (*new, *first) if len(c) > CHUNK_CHARS]:
            recent.pop(c, None)
        if len(recent) > REMEMBERED:
            self.older, self.recent = recent, {"": b""}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if not self.by_chunk:
            return [x + self.end for x in self._whole(texts)]
        if not texts:
            return []
        lists = pc.split_pattern(pc.replace_substring(pa.array(map(self._lower, texts), pa.large_string()), "\n", " "), " ")
        chunks = lists.flatten().dictionary_encode()
        ids = pa.array(self._ids_of(chunks.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(chunks.indices)
        ends, data = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1), ids.buffers()[2] or b""
        edges = ends[lists.offsets.to_numpy()].tolist()
        whole = memoryview(data)
        return [bytes(whole[a:b]) + self.end for a, b in itertools.pairwise(edges)]


_encoders: dict[tuple, Encoder] = {}


def encoder_of(path: str, end_id: int, by_chunk: bool) -> Encoder:
    """The worker's encoder, kept with its remembered chunks from task to task."""
    key = path, end_id, by_chunk, REMEMBERED
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(path, end_id, by_chunk)
    return _encoders[key]


def _filesystem(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def key_hash(key: Column) -> Column:
    """The hash of an integer key; null has one too."""
    return F.xxhash64(key.cast("long"))


def hash_of(key: int | None) -> int:
    """The same hash of one key, without a sign."""
    return SEED if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), SEED)


def fingerprints(hashes: np.ndarray, null: np.ndarray) -> np.ndarray:
    return (common.mix64(hashes ^ np.uint64(0xA5A5A5A55A5A5A5A)).astype(np.uint32) ^ null.astype(np.uint32)).astype("<u4")


class Index(NamedTuple):
    """A minimal perfect hash over keys (hash, null) and their slots."""

    sizes: np.ndarray  # words of each level
    words: np.ndarray  # bits of all levels
    ranks: np.ndarray  # bits set before each word
    rest: np.ndarray  # keys that no level tells apart
    slots: np.ndarray

    @classmethod
    def build(cls, hashes: np.ndarray, null: np.ndarray, values: np.ndarray) -> Index:
        left, sizes, levels = np.arange(len(hashes)), [], []
        slot = np.empty(len(hashes), np.int64)
        done = 0
        for level in range(LEVELS):
            if not len(left):
                break
            n_words = max(1, -(-GAMMA * len(left) // 64))
            at = _place(hashes[left], level, n_words)
            alone = np.bincount(at, minlength=64 * n_words)[at] == 1
            bits = np.zeros(64 * n_words, bool)
            bits[at[alone]] = True
            slot[left[alone]] = done + (np.cumsum(bits) - 1)[at[alone]]
            done += int(alone.sum())
            levels.append(np.packbits(bits, bitorder="little").view("<u8"))
            sizes.append(n_words)
            left = left[~alone]
        slot[left] = done + np.arange(len(left))
        rest = np.empty(len(left), REST)
        rest["hash"], rest["null"], rest["slot"] = hashes[left], null[left], slot[left]
        words = np.concatenate([*levels, np.empty(0, "<u8")]).astype("<u8")
        counts = np.bitwise_count(words).astype(np.int64)
        slots = np.empty(len(hashes), SLOT)
        for c in values.dtype.names:
            slots[c][slot] = values[c]
        slots["fingerprint"][slot] = fingerprints(hashes, null)
        return cls(np.array(sizes, "<u4"), words, (np.cumsum(counts) - counts).astype("<u4"), rest, slots)

    def find(self, hashes: np.ndarray, null: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that isn't there; an unknown key passes with a chance of 2^-32."""
        found = np.full(len(hashes), -1, np.int64)
        left, base = np.arange(len(hashes)), 0
        for level, n_words in enumerate(self.sizes.tolist()):
            at = _place(hashes[left], level, n_words)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            hit = (self.words[word] >> bit) & np.uint64(1) == 1
            below = self.words[word[hit]] & ((np.uint64(1) << bit[hit]) - np.uint64(1))
            found[left[hit]] = self.ranks[word[hit]] + np.bitwise_count(below)
            left, base = left[~hit], base + n_words
        for r in self.rest:
            found[left[(hashes[left] == r["hash"]) & (null[left] == r["null"])]] = r["slot"]
        sure = found >= 0
        sure[sure] = self.slots["fingerprint"][found[sure]] == fingerprints(hashes[sure], null[sure])
        return np.where(sure, found, -1)

    def dump(self) -> bytes:
        head = np.array([len(self.sizes), len(self.words), len(self.rest), len(self.slots)], "<u8")
        return MAGIC + head.tobytes() + b"".join(x.tobytes() for x in self)

    @classmethod
    def load(cls, data: bytes) -> Index:
        if data[:8] != MAGIC:
            raise ValueError("not an index file")
        counts, at, out = np.frombuffer(data, "<u8", 4, 8).tolist(), 40, []
        for kind, n in zip(("<u4", "<u8", "<u4", REST, SLOT), (counts[0], counts[1], counts[1], counts[2], counts[3]), strict=True):
            out.append(np.frombuffer(data, kind, n, at))
            at += out[-1].nbytes
        return cls(*out)


def _place(hashes: np.ndarray, level: int, n_words: int) -> np.ndarray:
    return (common.mix64(hashes + np.uint64(0x9E3779B97F4A7C15 * (level + 1) % 2**64)) % np.uint64(64 * n_words)).astype(np.int64)


class Store(NamedTuple):
    """A written store: its folder, the shards in order, with the records and ids before each, and the index files by
    leading bits of the hash. There is one entry a file, as many as tasks wrote."""

    folder: str
    names: list[str]
    records_before: np.ndarray
    ids_before: np.ndarray
    bits: int
    blocks: dict[int, str]

    def get(self, key: int | None) -> np.ndarray | None:
        """The ids of one document (of equal keys the first), or None: keyed access without Spark."""
        h = hash_of(key)
        name = self.blocks.get(h >> (64 - self.bits) if self.bits else 0)
        if name is None:
            return None
        files, root = _filesystem(self.folder)
        with files.open_input_file(f"{root}/{name}") as f:
            index = Index.load(f.read())
        slot = int(index.find(np.array([h], np.uint64), np.array([key is None]))[0])
        if slot < 0:
            return None
        s = index.slots[slot]
        with files.open_input_file(f"{root}/{self.names[s['shard']]}") as f:
            kind = shard_kind(f)
            return np.frombuffer(f.read_at(int(s["length"]) * kind.itemsize, int(s["offset"]) * kind.itemsize), kind).astype("<u4")


def trailer(width: int, records: int, ids: int) -> bytes:
    return TRAILER.pack(MAGIC, width, 0, records, ids)


def shard_kind(f) -> np.dtype:
    """The type of a shard's ids, by its trailer."""
    magic, width, _, _, _ = TRAILER.unpack(f.read_at(TRAILER.size, f.size() - TRAILER.size))
    if magic != MAGIC:
        raise ValueError("not a shard")
    return np.dtype(f"<u{width}")


def record_ends(f) -> np.ndarray:
    """The end of each record of a shard."""
    _, _, _, n, _ = TRAILER.unpack(f.read_at(TRAILER.size, f.size() - TRAILER.size))
    return np.frombuffer(f.read_at(8 * n, f.size() - TRAILER.size - 8 * n), "<u8")


def _pieces(ids: pa.Array, texts: pa.Array) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts of a batch in stretches of about ENCODE_CHARS characters."""
    keys, some, size = [], [], 0
    for k, t in zip(ids, texts, strict=True):
        keys.append(k.as_py())
        some.append(t.as_py() or "")
        size += len(some[-1])
        if size >= ENCODE_CHARS:
            yield keys, some
            keys, some, size = [], [], 0
    if keys:
        yield keys, some


def _shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int, by_chunk: bool) -> DataFrame:
    """(key, shard, name, record, offset, length) of the documents after their shards were written. A shard takes its
    name from the attempt that wrote it; only names that Spark has committed are ever read."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // SHARD_CHARS + 1)
    rows = docs.select(F.col("doc_id").cast("long").alias("key"), "text").withColumn("order", F.xxhash64("text"))
    dealt = rows.repartitionByRange(n, "key", "order").sortWithinPartitions("key", "order", "text").select("key", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        encoder = encoder_of(tokenizer, end_id, by_chunk)
        files, root = _filesystem(folder)
        files.create_dir(root, recursive=True)
        shard = TaskContext.get().partitionId()
        name = f"ids-{shard:06d}-{uuid.uuid4().hex}.bin"
        out, ends, width, total, largest = None, [], encoder.kind.itemsize, 0, 0
        for batch in batches:
            for keys, texts in _pieces(*batch.columns):
                coded = encoder.encode(texts)
                if out is None:
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                out.write(b"".join(coded))
                lengths = np.fromiter((len(c) // width for c in coded), np.int64, len(coded))
                stops = total + np.cumsum(lengths)
                records = largest + np.arange(len(keys))
                ends.append(stops.astype("<u8").tobytes())
                total, largest = int(stops[-1]), largest + len(keys)
                same = lambda v, kind: pa.array([v] * len(keys), kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), same(shard, pa.int32()), same(name, pa.string()), pa.array(records), pa.array(stops - lengths), pa.array(lengths)],
                    ["key", "shard", "name", "record", "offset", "length"],
                )
        if out is not None:
            out.write(b"".join(ends) + trailer(width, largest, total))
            out.close()

    return common.materialize(dealt.mapInArrow(run, "key long, shard int, name string, record long, offset long, length long"), "tokens-entries")


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, by_chunk: bool = True) -> Store:
    """Write the ids of all documents (doc_id, text), each with end_id behind it, in ascending order of doc_id, and an
    index of the doc_ids. Null texts count as empty, a null doc_id is a key like others and comes first. Documents of one
    doc_id follow each other in an order that is the same in every run; the index leads to the first of them and has
    their number. doc_id is an integer; other columns are ignored; an empty table gives a store without files.
    """
    common.bound_batches(docs)
    entries = _shards(docs.select("doc_id", "text"), folder, tokenizer, end_id, by_chunk)
    shards = entries.groupBy("shard", "name").agg(F.count("*").alias("records"), F.sum("length").alias("ids")).orderBy("shard").collect()
    place = {r["shard"]: i for i, r in enumerate(shards)}
    before = lambda c: np.cumsum([0, *(r[c] for r in shards)])
    records_before, ids_before = before("records"), before("ids")
    bits = max(0, int(records_before[-1]) // KEYS_A_BLOCK).bit_length()
    first = F.min(F.struct("shard", "record", "offset", "length"))
    keys = entries.groupBy("key").agg(first.alias("f"), F.count("*").alias("count")).select("key", "f.*", "count", key_hash(F.col("key")).alias("hash"))
    bucket = F.shiftrightunsigned("hash", 64 - bits).cast("int") if bits else F.lit(0)
    schema = "bucket int, name string"

    def index(key: tuple, table: pa.Table) -> pa.Table:
        of = lambda c: table.column(c).to_numpy()
        values = np.empty(table.num_rows, [(c, "<u8") for c in ("count", "shard", "record", "offset", "length")])
        at = np.array([place[s] for s in of("shard").tolist()], np.int64)
        values["count"], values["shard"], values["offset"], values["length"] = of("count"), at, of("offset"), of("length")
        values["record"] = records_before[at] + of("record")
        null = table.column("key").is_null().to_numpy()
        data = Index.build(of("hash").astype(np.uint64), null, values).dump()
        files, root = _filesystem(folder)
        name = f"index-{key[0].as_py():06d}-{uuid.uuid4().hex}.bin"
        with files.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(data)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "name": [name]})

    made = common.materialize(keys.withColumn("bucket", bucket).groupBy("bucket").applyInArrow(index, schema), "tokens-blocks")
    return Store(folder, [r["name"] for r in shards], records_before, ids_before, bits, {r["bucket"]: r["name"] for r in made.collect()})


def located(store: Store, keys: DataFrame) -> DataFrame:
    """(key, shard, record, offset, length, count) of the keys (key) that the store has, by its index. Each index file is
    read by one task, with the keys of its range of hashes."""
    blocks, folder = store.blocks, store.folder
    h = key_hash(F.col("key"))
    bucket = F.shiftrightunsigned(h, 64 - store.bits).cast("int") if store.bits else F.lit(0)
    asked = keys.select(F.col("key").cast("long").alias("key")).distinct().select("key", h.alias("hash"), bucket.alias("bucket"))

    def look(key: tuple, table: pa.Table) -> pa.Table:
        name = blocks.get(key[0].as_py())
        if name is None:
            return pa.table({c: pa.array([], pa.int32() if c == "shard" else pa.int64()) for c in PLACE})
        files, root = _filesystem(folder)
        with files.open_input_file(f"{root}/{name}") as f:
            index = Index.load(f.read())
        null = table.column("key").is_null().to_numpy()
        slot = index.find(table.column("hash").to_numpy().astype(np.uint64), null)
        there = slot >= 0
        s = index.slots[slot[there]]
        of = lambda c, kind: pa.array(s[c].astype(kind))
        return pa.table({
            "key": table.column("key").filter(pa.array(there)), "shard": of("shard", np.int32), "record": of("record", np.int64),
            "offset": of("offset", np.int64), "length": of("length", np.int64), "count": of("count", np.int64),
        })

    return asked.groupBy("bucket").applyInArrow(look, ", ".join(f"{c} {'int' if c == 'shard' else 'long'}" for c in PLACE))


def read(spark: SparkSession, store: Store, keys: DataFrame) -> DataFrame:
    """(key, start, n_tokens, ids) of all documents with one of the keys (key): the ids before it in the whole store, and
    its own as little-endian 32-bit integers. Unknown keys give no row. A shard's records are read in order, by one task."""
    names, folder, ids_before, records_before = store.names, store.folder, store.ids_before, store.records_before
    schema = "key long, start long, n_tokens long, ids binary"
    if not names:
        return spark.createDataFrame([], schema)
    found = located(store, keys)

    @F.pandas_udf("int")
    def shard_of(record: pd.Series) -> pd.Series:
        return pd.Series((np.searchsorted(records_before, record.to_numpy(), "right") - 1).astype(np.int32))

    # the records of a repeated key follow its first, also in later shards, where only the record's number is known
    one = found.where("count = 1").select("key", "shard", "record", "offset", "length")
    more = found.where("count > 1").select("key", F.explode(F.expr("sequence(record, record + count - 1)")).alias("record"))
    none = F.lit(None).cast("long")
    places = one.unionByName(more.select("key", shard_of("record").alias("shard"), "record", none.alias("offset"), none.alias("length")))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), len(names))
    dealt = places.repartition(parts, "shard").sortWithinPartitions("shard", "record")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _filesystem(folder)
        shard, f, kind, ends = None, None, np.dtype("<u4"), None
        for batch in batches:
            cols = [c.to_pylist() for c in batch.columns]
            wanted: list[tuple] = []  # of one shard, close to each other
            for key, s, record, offset, length in zip(*cols, strict=True):
                if s != shard:
                    if wanted:
                        yield from _fetched(f, kind, wanted, int(ids_before[shard]))
                        wanted = []
                    if f is not None:
                        f.close()
                    shard, ends = s, None
                    f = files.open_input_file(f"{root}/{names[s]}")
                    kind = shard_kind(f)
                if offset is None:
                    ends = record_ends(f) if ends is None else ends
                    at = record - int(records_before[s])
                    offset = int(ends[at - 1]) if at else 0
                    length = int(ends[at]) - offset
                if wanted and (
                    (offset - wanted[-1][1] - wanted[-1][2]) * kind.itemsize > GAP_BYTES or (offset + length - wanted[0][1]) * kind.itemsize > READ_BYTES
                ):
                    yield from _fetched(f, kind, wanted, int(ids_before[shard]))
                    wanted = []
                wanted.append((key, offset, length))
            if wanted:
                yield from _fetched(f, kind, wanted, int(ids_before[shard]))
        if f is not None:
            f.close()

    return dealt.mapInArrow(run, schema)


def _fetched(f, kind: np.dtype, wanted: list[tuple], before: int) -> Iterator[pa.RecordBatch]:
    """Records that lie close together, by one read."""
    first, last = wanted[0][1], wanted[-1][1] + wanted[-1][2]
    ids = np.frombuffer(f.read_at((last - first) * kind.itemsize, first * kind.itemsize), kind).astype("<u4")
    yield pa.RecordBatch.from_arrays(
        [
            pa.array([k for k, _, _ in wanted], pa.int64()), pa.array([before + o for _, o, _ in wanted], pa.int64()), pa.array([n for _, _, n in wanted], pa.int64()),
            pa.array([ids[o - first : o - first + n].tobytes() for _, o, n in wanted], pa.binary()),
        ],
        ["key", "start", "n_tokens", "ids"],
    )
