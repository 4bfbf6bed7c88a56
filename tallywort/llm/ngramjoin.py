"""N-gram Jaccard join by universe partition and pigeonhole.

A document's set holds the 64-bit hashes of its distinct runs of k words (A-Z lower-cased; with fewer words
the whole sequence is one; without words the set is empty and links with nothing). Two documents link when
100 * |A & B| >= percent * |A | B|. Links and their components are exact:

1. Equal sets form a class, represented by its smallest doc_id; only classes go on.
2. Sizes fall into bands; a linked pair lies in one band or two neighbours. A context is an upper band with
   the band below it; in it a linked pair differs in at most H elements. The hash universe is partitioned
   into segments whose weights sum to H + 1: a segment of weight 1 is matched exactly, one of weight 2
   also after the deletion of one element. By the pigeonhole principle every linked pair agrees in a
   segment. The number of segments of weight 2 follows a cost model of bytes: signatures against expected
   chance agreements in the context, whose part of the sets grows with their number.
3. Agreement on nothing says nothing, so signatures of no elements are left out: spare weight makes up for
   segments with too few elements, and a set that has more of these than the spare weight keeps them all.
4. Signatures shuffle once, packed by range of values to about six bytes with a code of their set; they are cut to
   as many bits as leave few chance agreements, which only add candidates. A task sends on one set of those that
   share a signature and links the others to it. Of a signature's sets each is compared with a first one. Once these
   links have merged components, sets in other components than a signature's next centre, by hash, are compared
   with that; and after ``ROUNDS`` of these, all pairs of a signature in different components, in blocks. So no
   link between components is lost, and a large group of near copies isn't expanded into all its pairs.
5. Candidates pass a lower bound of their difference (parities of hashed elements), then the exact test.

Rows of one doc_id are one node. Null doc_id: component null. Null texts are empty. Other columns pass unused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Cost model, in bytes shuffled: a signature takes SIGNATURE_BYTES, a chance pair PAIR_BYTES and PARITY_BYTES an element for
#: the parities of one of its sets. How much unrelated sets share is measured on SAMPLE sets, of which about SAMPLE_ELEMENTS elements are looked at.
SIGNATURE_BYTES, PAIR_BYTES, PARITY_BYTES, SAMPLE, SAMPLE_ELEMENTS = 6.0, 48.0, 0.375, 500, 200_000
#: Signatures that a task holds before it packs and emits them, and signatures of a range of the exchange.
CHUNK, RANGE = 500_000, 1_500_000
#: Bits of a signature and of a set's code beyond those that tell all apart on average.
SIGNATURE_SPARE, CODE_SPARE = 8, 5
#: Sets of a block of the last comparison of all pairs.
BLOCK = 2_000
#: Parity buckets an element, and rounds of comparing with further centres.
BUCKETS, ROUNDS = 2, 2


def shingles(text: bytes, k: int) -> np.ndarray:
    """The sorted set of a text."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = common.word_hashes(words)
    if len(words) < k:
        return common.mix64(common.window_hashes(hashes, len(words)) + np.uint64(len(words)))
    return np.unique(common.window_hashes(hashes, k))


def most_apart(total: int, percent: int) -> int:
    """Largest symmetric difference of linked sets whose sizes sum to total."""
    return (100 - percent) * total // (100 + percent)


def bands(largest: int, percent: int) -> list[tuple[int, int]]:
    """Bands of sizes from 1: from the largest size down a factor of percent."""
    out, low = [], 1
    while low <= largest:
        high = low * 100 // percent
        out.append((low, high))
        low = high + 1
    return out


class Plan:
    """Segments of a context: bounds in the hash universe, salts, and which of them are of weight 2."""

    def __init__(self, context: int, low: int, high: int, sets: int, percent: int, shared: float, pair_bytes: float = PAIR_BYTES):
        """low: smallest size; high: largest; sets: number of sets in the context; shared: part of their elements that
        unrelated sets share; pair_bytes: cost of a chance pair beside its parities."""
        self.apart = most_apart(2 * high, percent)
        need, size = self.apart + 1, (low + high) / 2
        best = None
        for part in (0.0, 0.25, 0.5, 0.75, 1.0):
            twos = int(need * part) // 2
            spare = 0
            for _ in range(6):  # spare weight covers segments that chance leaves too thin
                ones = need + spare - 2 * twos
                per = low / (need + spare)
                thin = ones * math.exp(-per) + 2 * twos * math.exp(-2 * per) * (1 + 2 * per)
                spare = math.floor(thin + 3 * math.sqrt(thin))
            ones = need + spare - 2 * twos
            unit = 2 * size / (1 + shared) / (need + spare)
            lone = lambda w: math.exp(-unit * w * (1 - shared)) - math.exp(-unit * w)
            # sets that agree by chance with one before them: each is compared with one of them
            met = lambda p: -math.expm1(-sets / 2 * p)
            chance = ones * met(lone(1)) + twos * met(lone(2) * (1 + 2 * unit))
            emitted = ones + twos * (1 + 2 * size / (need + spare))
            cost = sets * (emitted * SIGNATURE_BYTES + (pair_bytes + PARITY_BYTES * size) * chance)
            if best is None or cost < best[0]:
                best = cost, twos, ones, spare, sets * emitted
        _, self.twos, ones, self.spare, self.expected = best
        widths = np.array([2] * self.twos + [1] * ones, np.float64)
        ends = np.cumsum(widths) / widths.sum()
        self.bounds = np.array([min(2**64 - 1, int(x * 2**64)) for x in ends[:-1]], np.uint64)
        self.salts = common.mix64(np.arange(len(widths), dtype=np.uint64) + np.uint64(context << 40))

    def signatures(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Signatures of a set's segments, and of the segments of weight 2 without one element each."""
        at = np.concatenate([[0], np.searchsorted(s, self.bounds), [len(s)]])
        n = np.diff(at)
        mixed = common.mix64(s + np.uint64(0x9E3779B97F4A7C15))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed, dtype=np.uint64)])
        own = sums[at[1:]] - sums[at[:-1]]
        wasted = int((n[self.twos :] == 0).sum() + 2 * (n[: self.twos] <= 1).sum())
        least = 0 if wasted > self.spare else 1
        step = np.uint64(0xD6E8FEB86659FD93)
        full = common.mix64(own + self.salts + n.astype(np.uint64) * step)[n >= least]
        if not self.twos:
            return full, full[:0]
        m = n[: self.twos]
        seg = np.repeat(np.arange(self.twos), m)
        less = common.mix64(own[seg] - mixed[: len(seg)] + self.salts[seg] + (m[seg] - 1).astype(np.uint64) * step)
        return full, less[m[seg] - 1 >= least]


def parities(s: np.ndarray) -> bytes:
    """Parities of the numbers of elements by hash bucket, at least BUCKETS buckets an element."""
    bits = max(64, 1 << (BUCKETS * len(s) - 1).bit_length()) if len(s) else 64
    odd = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def fold(p: np.ndarray, size: int) -> np.ndarray:
    """Parities of fewer buckets."""
    while p.shape[-1] > size:
        half = p.shape[-1] // 2
        p = p[..., :half] ^ p[..., half:]
    return p


def apart_at_least(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    size = min(len(x), len(y))
    return int(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """The exact test of two sorted sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common_ = int((both[1:] == both[:-1]).sum())
    return 100 * common_ >= percent * (len(a) + len(b) - common_)


def _profile(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        import xxhash

        for batch in batches:
            rows = []
            for doc, text in zip(*batch.columns, strict=True):
                s = shingles(text.as_py() or b"", k)
                digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
                rows.append((doc.as_py(), len(s), int(digest[0]) & ~1, int(digest[1]), parities(s)))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 4 + [pa.binary()], strict=True)], ["doc_id", "n", "d1", "d2", "odd"])

    return run


class Layout:
    """How signatures are packed for the exchange: the top bits of a signature, its range of values, and codes of sets."""

    def __init__(self, signatures: float, sets: int):
        self.bits = min(60, max(20, math.ceil(math.log2(signatures + 2)) + SIGNATURE_SPARE))
        self.code_bits = min(60, max(7, math.ceil(math.log2(sets + 2)) + CODE_SPARE))
        self.ranges = max(1, math.ceil(signatures / RANGE))
        self.width = -(-(1 << self.bits) // self.ranges)

    def codes(self, own: np.ndarray) -> np.ndarray:
        """Codes of sets by their digests; the lowest bit, set for signatures after a deletion, stays."""
        return (own >> np.uint64(64 - self.code_bits) << np.uint64(1) | own & np.uint64(1)).astype(np.int64)

    def pack(self, sig: np.ndarray, *codes: np.ndarray) -> tuple[int, bytes, bytes, list[bytes]]:
        """Sorted signatures of a range as counts by bucket and low bytes of as many bytes as take least; the codes cut to their width."""
        room = (self.width - 1).bit_length()
        low = min(range(1, 8), key=lambda b: len(sig) * b + 2 * (1 << max(0, room - 8 * b)))
        local = sig % self.width
        counts = np.bincount(local >> 8 * low, minlength=1 << max(0, room - 8 * low)).astype("<u4")
        cut = lambda x, n: np.ascontiguousarray(x.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :n].tobytes()
        return low, counts.tobytes(), cut(local, low), [cut(c, self.code_bytes) for c in codes]

    @property
    def code_bytes(self) -> int:
        return -(-(self.code_bits + 1) // 8)

    def unpack(self, at: int, low: int, counts: bytes, lows: bytes, *codes: bytes) -> list[np.ndarray]:
        """The signatures of range ``at``, and their codes."""
        def whole(data: bytes, n: int) -> np.ndarray:
            out = np.zeros((len(data) // n, 8), np.uint8)
            out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
            return out.view("<i8").ravel()

        high = np.repeat(np.arange(len(counts) // 4, dtype=np.int64), np.frombuffer(counts, "<u4"))
        return [(high << 8 * low) + whole(lows, low) + at * self.width, *(whole(c, self.code_bytes) for c in codes)]


PACKED = "dealt int, at int, low int, counts binary, lows binary, owner binary, first binary"


def _grouped(sig: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct (signature, owner) in order; each row's first owner with the whole segment, or -1, and the number of sets of its signature."""
    order = np.lexsort((owner, sig))
    sig, owner = sig[order], owner[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (owner[1:] != owner[:-1])
    sig, owner = sig[new], owner[new]
    start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, int)
    size = np.diff(np.append(start, len(sig)))
    none = np.iinfo(np.int64).max
    first = np.minimum.reduceat(np.where(owner & 1, none, owner), start) if len(sig) else owner
    other = np.ones(len(sig), np.int64)
    other[1:] = (sig[1:] != sig[:-1]) | (owner[1:] >> 1 != owner[:-1] >> 1)
    sets = np.add.reduceat(other, start) if len(sig) else size
    return sig, owner, np.repeat(np.where(first == none, -1, first), size), np.repeat(sets, size)


def _signatures(k: int, percent: int, plans):
    """Signatures by range. Sets of a task that share one whole are linked there with the first of them, which alone goes on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        import xxhash

        by_band, lows, layout = plans.value
        done: set[int] = set()
        sigs: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        held = turn = 0
        fields = pa.schema([(n, pa.int32()) for n in ("dealt", "at", "low")] + [(n, pa.binary()) for n in ("counts", "lows", "owner", "first")])

        def emit() -> pa.RecordBatch:
            sig, owner, first, sets = _grouped(np.concatenate(sigs).view(np.int64), np.concatenate(owners))
            shared = (first >= 0) & (sets > 1)
            rows = []
            for keep, star in ((~shared | (owner == first), False), (shared, True)):
                part, at = [x[keep] for x in (sig, owner, first)], sig[keep] // layout.width
                ends = np.flatnonzero(np.append(at[1:] != at[:-1], True)) + 1 if len(at) else []
                begin = 0
                for end in ends:
                    s, o, f = (x[begin:end] for x in part)
                    low, counts, lows_, codes = layout.pack(s, *((o >> 1, f >> 1) if star else (o,)))
                    here = int(at[begin])
                    rows.append((layout.ranges + (here + turn) % layout.ranges if star else here, here, low, counts, lows_, codes[0], codes[1] if star else None))
                    begin = end
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

        for batch in batches:
            for text in batch.column(0):
                s = shingles(text.as_py() or b"", k)
                if not len(s):
                    continue
                own = int(np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<u8")[0]) & ~1
                if own in done:
                    continue
                if len(done) < 2_000_000:
                    done.add(own)
                band = int(np.searchsorted(lows, len(s), side="right")) - 1
                for context in (band, band + 1):
                    plan = by_band.get(context)
                    if plan is not None:
                        for kind, x in enumerate(plan.signatures(s)):
                            sigs.append(x >> np.uint64(64 - layout.bits))
                            owners.append(layout.codes(np.full(len(x), own | kind, np.uint64)))
                            held += len(x)
                if held >= CHUNK:
                    yield emit()
                    sigs, owners, held, turn = [], [], 0, turn + 1
        if held:
            yield emit()

    return run


def _shared(plans):
    """Of the signatures of a range, those that two sets share, one of them whole; with the first whole one."""
    def run(t: pa.Table) -> pa.Table:
        common.lean_worker()
        layout = plans.value[2]
        out = [[np.empty(0, np.int64)] * 3]
        # blocks are read where they lie; only the numbers become Python objects
        blocks = [[v.as_buffer() if v.is_valid else None for v in t.column(c)] for c in ("counts", "lows", "owner", "first")]
        rows = list(zip(t.column("at").to_pylist(), t.column("low").to_pylist(), *blocks, strict=True))
        if rows and rows[0][5] is not None:
            out += [layout.unpack(*r) for r in rows]
        elif rows:
            sig, owner, first, sets = _grouped(*map(np.concatenate, zip(*(layout.unpack(*r[:5]) for r in rows), strict=True)))
            keep = (first >= 0) & (sets > 1)
            out.append([sig[keep], owner[keep] >> 1, first[keep] >> 1])
        return pa.table(dict(zip(("sig", "id", "first"), map(np.concatenate, zip(*out, strict=True)), strict=True)))

    return run


def _near(percent: int):
    """Pairs whose difference may be small enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        for batch in batches:
            keep = []
            for n, m, a, b in zip(*(batch.column(c) for c in ("na", "nb", "oa", "ob")), strict=True):
                n, m = n.as_py(), m.as_py()
                keep.append(100 * min(n, m) >= percent * max(n, m) and apart_at_least(a.as_py(), b.as_py()) <= most_apart(n + m, percent))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _across(percent: int):
    """Pairs of a signature in different components that may be near enough, but for those with its first set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        def pairs(rows: list[tuple]) -> pa.RecordBatch | None:
            found: list[tuple[int, int]] = []
            rows = list({r[0]: r for r in rows}.values())
            by_size: dict[int, list] = {}
            for r in rows:
                by_size.setdefault(len(r[3]), []).append(r)
            groups = {size: ([r[0] for r in g], np.array([r[1] for r in g]), np.array([r[2] for r in g]), np.frombuffer(b"".join(r[3] for r in g), np.uint8).reshape(len(g), size)) for size, g in by_size.items()}
            for size, (ids, comps, ns, odd) in groups.items():
                for other in (size, 2 * size):
                    if other not in groups:
                        continue
                    ids2, comps2, ns2, odd2 = groups[other]
                    odd2 = fold(odd2, size)
                    for i in range(len(ids)):
                        j = slice(i + 1, None) if other == size else slice(None)
                        gap = np.bitwise_count(odd2[j] ^ odd[i]).sum(axis=1, dtype=np.int64)
                        total = ns2[j] + ns[i]
                        ok = (comps2[j] != comps[i]) & (gap * (100 + percent) <= (100 - percent) * total) & (100 * np.minimum(ns2[j], ns[i]) >= percent * np.maximum(ns2[j], ns[i]))
                        found += [(ids[i], ids2[(i + 1 if other == size else 0) + int(x)]) for x in np.flatnonzero(ok)]
            if not found:
                return None
            a, b = zip(*found, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        at, held = None, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row[0] != at:
                    if len(held) > 1 and (out := pairs(held)) is not None:
                        yield out
                    at, held = row[0], []
                held.append(row[1:])
        if len(held) > 1 and (out := pairs(held)) is not None:
            yield out

    return run


def verified(docs: DataFrame, pairs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids that link. Only the documents concerned are read into sets."""
    ids = common.materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "join-ids")
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    own = common.join_by_id(slim, ids, F.col("doc_id") == F.col("id"), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        for batch in batches:
            out = [shingles(x.as_py() or b"", k).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "s"])

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        for batch in batches:
            ok = [linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    held = common.materialize(own.mapInArrow(sets, "id long, s binary"), "join-sets")
    a, b = (held.select(F.col("id").alias(c), F.col("s").alias(f"s{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "sa", "sb").mapInArrow(test, "a long, b long").distinct()


def shared_part(docs: DataFrame, reps: DataFrame, k: int, percent: int) -> float:
    """The mean part of their elements that two sets share unless they are half as similar as linked ones, by a sample of
    the sets in hash order; the elements looked at are those with the smallest hashes, the same for all sets."""
    r = reps.agg(F.sum("n").alias("n"), F.count("*").alias("sets")).first()
    if not r.sets or r.sets < 2:
        return 0.0
    part = min(1.0, SAMPLE_ELEMENTS / (r.n / r.sets * SAMPLE))
    ids = [x.rep for x in reps.select("rep", "d1", "d2").orderBy(F.xxhash64("d1", "d2"), "d1", "d2").limit(SAMPLE).collect()]
    limit = np.uint64(min(2**64 - 1, int(part * 2**64)))

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.lean_worker()
        for batch in batches:
            sets = [shingles(x.as_py() or b"", k) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[common.mix64(x) <= limit].tobytes() for x in sets], pa.binary())], ["id", "s"])

    some = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("text")).where(F.col("id").isin(ids))
    found = {x.id: np.frombuffer(x.s, np.uint64) for x in some.mapInArrow(sketch, "id long, s binary").collect()}
    sets = [x for x in found.values() if len(x)]
    values, doc = np.concatenate([*sets, np.empty(0, np.uint64)]), np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, place, n = np.unique(values, return_inverse=True, return_counts=True)
    often = np.flatnonzero(n > 1)
    both = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, len(often), 20_000):
        mine = often[at : at + 20_000]
        keep = np.isin(place, mine)
        held = np.zeros((len(sets), len(mine)), np.float32)
        held[doc[keep], np.searchsorted(mine, place[keep])] = 1
        both += held @ held.T
    size = np.array([len(x) for x in sets], np.float32)
    alike = both / np.maximum(1, size[:, None] + size - both)
    alike = alike[np.triu_indices(len(sets), 1)]
    alike = alike[200 * alike < percent]
    return float(alike.mean()) if len(alike) else 0.0


def classes(docs: DataFrame, k: int = 3, percent: int = 90, pair_bytes: float = PAIR_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of documents."""
    spark = docs.sparkSession
    common.bound_batches(docs)
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    profile = common.materialize(slim.mapInArrow(_profile(k), "doc_id long, n long, d1 long, d2 long, odd binary"), "join-profile")
    reps = common.materialize(
        profile.where("n > 0 and doc_id is not null").groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("odd").alias("odd")),
        "join-classes",
    )
    largest = reps.agg(F.max("n")).first()[0] or 0
    ranges = bands(largest, percent)
    lows = np.array([x[0] for x in ranges], np.int64)
    edges = [x[1] for x in ranges]
    # one row a band: their number grows with the logarithm of the largest size
    band = F.size(F.filter(F.array(*map(F.lit, edges[:-1] or [largest])), lambda x: F.col("n") > x))
    sizes = {r["band"]: r["count"] for r in reps.select("n").groupBy("n").count().select(band.alias("band"), "count").groupBy("band").agg(F.sum("count").alias("count")).collect()} if ranges else {}
    shared = shared_part(docs, reps, k, percent)
    plans = {}
    for i, (low, high) in enumerate(ranges):
        sets = sizes.get(i, 0) + sizes.get(i - 1, 0)
        if sizes.get(i, 0) and sets > 1 and most_apart(2 * high, percent) > 0:
            plans[i] = Plan(i, ranges[i - 1][0] if i and sizes.get(i - 1, 0) else low, high, sets, percent, shared, pair_bytes)
    layout = Layout(sum(p.expected for p in plans.values()), sum(sizes.values()))
    known = spark.sparkContext.broadcast((plans, lows, layout))

    members = common.materialize(
        slim.where("doc_id is not null").select("text").mapInArrow(_signatures(k, percent, known), PACKED)
        .groupBy("dealt").applyInArrow(_shared(known), "sig long, id long, first long"),
        "join-members",
    )
    node = reps.select(F.shiftrightunsigned("d1", 64 - layout.code_bits).alias("id"), "rep")
    facts = reps.select("rep", "n", "odd")

    def near(pairs: DataFrame, name: str) -> DataFrame:
        """Distinct pairs (a, b) of documents that pass the bound; their parities join once a pair."""
        pairs = pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        for c in "ab":
            pairs = pairs.join(facts.select(F.col("rep").alias(c), F.col("n").alias(f"n{c}"), F.col("odd").alias(f"o{c}")), c)
        return common.materialize(pairs.select("a", "b", "na", "nb", "oa", "ob").mapInArrow(_near(percent), "a long, b long").distinct(), name)

    star = members.where("id <> first").select("id", "first").distinct()
    star = star.join(node.withColumnRenamed("rep", "a"), "id").join(node.select(F.col("id").alias("first"), F.col("rep").alias("b")), "first")
    # sets whose codes happen to be equal count as one in the exchange, so they are compared here
    twins = node.groupBy("id").agg(F.min("rep").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n").join(node.withColumnRenamed("rep", "b"), "id")
    links = common.materialize(verified(docs, near(star.select("a", "b").union(twins.select("a", "b")), "join-near"), k, percent), "join-links")
    merged = common.components(links, "join-components", "a", "b")

    def undecided(merged: DataFrame, members: DataFrame) -> DataFrame:
        """Members with their components, of signatures that more than one component shares."""
        where = node.join(merged, node["rep"] == merged["id"], "left").select(node["id"], "rep", F.coalesce("component", "rep").alias("comp"))
        placed = members.join(where, "id")
        open_ = placed.groupBy("sig").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high").select("sig")
        return placed.join(common.materialize(open_, "join-open-sigs"), "sig", "left_semi").select("sig", "id", "rep", "comp")

    def joined(more: DataFrame, links: DataFrame, name: str) -> tuple[DataFrame, DataFrame] | None:
        """The links with those of the pairs that are verified, and their components; none if there are no pairs."""
        if not more.take(1):
            return None
        links = links.union(common.materialize(verified(docs, more, k, percent), f"{name}-links"))
        return links, common.components(links, f"{name}-components", "a", "b")

    rest = members.select("sig", "id")
    for turn in range(ROUNDS):
        own = common.materialize(undecided(merged, rest).distinct(), f"join-open-{turn}")
        # a table, so that the join shuffles both sides and a common signature's rows can be split among tasks
        centre = common.materialize(own.groupBy("sig").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "rep").alias("h"), "id", "rep", "comp")).alias("c")), f"join-centre-{turn}")
        pairs = own.join(centre, "sig").where(F.col("comp") != F.col("c.comp")).select(F.col("c.rep").alias("a"), F.col("rep").alias("b"))
        found = joined(near(pairs, f"join-more-{turn}"), links, f"join-turn-{turn}")
        rest = own.join(centre.select("sig", F.col("c.rep").alias("rep")), ["sig", "rep"], "left_anti").select("sig", "id")
        if found is None:
            continue
        links, merged = found
    last = common.materialize(undecided(merged, rest).distinct(), "join-last-open")
    sizes_ = common.materialize(last.groupBy("sig").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")), "join-last-sizes")
    dealt = last.join(sizes_, "sig").join(facts, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    # every two blocks of a signature meet in one group
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other")).alias("sig"), "rep", "comp", "n", "odd"
    )
    across = common.materialize(met.repartition("sig").sortWithinPartitions("sig", "rep").mapInArrow(_across(percent), "a long, b long").distinct(), "join-last")
    links, merged = joined(across, links, "join-across") or (links, merged)
    comp = merged.select(F.col("id").alias("rep"), "component")
    own = common.materialize(reps.join(comp, "rep", "left").select(*(F.col(c).alias(f"_{c}") for c in ("n", "d1", "d2")), F.coalesce("component", "rep").alias("_comp")), "join-placed")
    same = (profile["n"] == own["_n"]) & (profile["d1"] == own["_d1"]) & (profile["d2"] == own["_d2"])
    # sets without elements are no class and stay out of the join
    both = profile.where("n > 0").join(own, same, "left").select("doc_id", "n", "_comp").union(profile.where("n = 0").select("doc_id", "n", F.lit(None).cast("long")))
    return both.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("_comp", "doc_id")).alias("component_id"))


def representatives(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The documents without those of a component with a smaller doc_id. Documents without words and rows of
    null doc_id stay; repeated rows of a doc_id are one document and stay together."""
    found = classes(docs.select("doc_id", "text"), k, percent)
    (own,) = common.unused(docs.columns, "gone_id")
    gone = common.materialize(found.where("component_id < doc_id").select(F.col("doc_id").alias(own)).distinct(), "join-gone")
    return common.join_by_id(docs, gone, F.col("doc_id").cast("long") == F.col(own), "left_anti")
