"""Embedding near-dedup by an inverted multi-index.

Two vectors link when their cosine is ``threshold`` or more; vectors that are null, zero or hold a null or
non-finite component link with nothing.

1. Equal vectors form a class and only one of them is indexed.
2. Two codebooks of K words each, for the halves of the normalised vectors, are fitted on a bounded sample
   (``SAMPLE`` classes in hash order); their product is a grid of K * K cells. Every class is indexed in the cell
   of its nearest words.
3. A vector's search visits cells by the multi-sequence algorithm, nearest sum of half distances first. The
   number of cells visited is the smallest at which either search finds ``RECALL`` of the links of ``QUERIES``
   classes, compared exactly with all classes, in each of ``BANDS`` bands of cosine between the threshold and 1, and
   of links planted at the threshold, one for each of these classes. A group of near copies weighs as much as a pair.
4. Neighbouring cells make up regions, so that a vector is sent once to a region and not to each of its cells. A
   region's members and visitors meet in blocks of bounded size; cosines count in double precision, single precision only
   sets aside pairs that are far from the threshold.
   A pair counts for both vectors whichever finds it. Blocks return counts and, of their links, a spanning
   forest, so a dense group isn't expanded into pairs.

Components come from the forests' edges. Rows of one vec_id are separate rows with a common component. Vectors of
different lengths don't link; each length has an index of its own. Rows of null vec_id link with nothing. An empty table
gives an empty table, and other columns pass unused.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

SAMPLE, QUERIES, RECALL = 20_000, 2_000, 0.995
#: Bands of cosine that each must reach RECALL, links ranked for a query in a task, and the step between ranks told apart.
BANDS, LINKS, STEP = 4, 16, 1.1
MAX_WORDS, PER_CELL = 512, 32
#: Rows of a block; regions are of that size, or smaller where that leaves fewer than REGIONS.
MEMBERS, VISITORS, REGIONS = 8_000, 8_000, 8


def codebook(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """k-means centres of the rows."""
    rng = np.random.default_rng(seed)
    centres = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = distances(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum(0, (x * x).sum(1)[:, None] - 2 * x @ centres.T + (centres * centres).sum(1))


def multi_sequence(a: np.ndarray, b: np.ndarray, cells: int) -> list[tuple[int, int]]:
    """The cells (word of the first half, of the second) with the smallest sums of distances, in order."""
    oa, ob = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    a, b = a[oa].tolist(), b[ob].tolist()
    heap, out, pushed = [(a[0] + b[0], 0, 0)], [], {(0, 0)}
    while heap and len(out) < cells:
        _, i, j = heapq.heappop(heap)
        out.append((int(oa[i]), int(ob[j])))
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in pushed:
                pushed.add((x, y))
                heapq.heappush(heap, (a[x] + b[y], x, y))
    return out


class Index:
    """Codebooks, the regions of cells, and the number of cells that a search visits."""

    def __init__(self, sample: np.ndarray, classes: int):
        self.half = sample.shape[1] // 2
        k = max(1, min(MAX_WORDS, len(sample) // 8, int(np.sqrt(classes / PER_CELL))))
        self.books = tuple(self._in_line(codebook(x, k)) for x in (sample[:, : self.half], sample[:, self.half :]))
        self.k = len(self.books[0])
        a, b = self.halves(sample)
        size = np.bincount(a.argmin(1) * self.k + b.argmin(1), minlength=self.k**2) * (classes / len(sample))
        self.regions = ((np.cumsum(size) - size) // min(MEMBERS, max(1, classes / REGIONS))).astype(np.int32)
        self.cells = self.k**2

    @staticmethod
    def _in_line(book: np.ndarray) -> np.ndarray:
        """The words by their place on the widest axis, so that neighbouring cells tend to be close."""
        if not book.shape[1]:
            return book
        centred = book - book.mean(0)
        return book[np.argsort(centred @ np.linalg.svd(centred, full_matrices=False)[2][0], kind="stable")]

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distances of both halves to their codebooks."""
        return distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])

    def visits(self, x: np.ndarray) -> Iterator[list[int]]:
        """The regions that each vector visits, its own first."""
        a, b = self.halves(x)
        own = self.regions[a.argmin(1) * self.k + b.argmin(1)].tolist()
        grid, rows = self.k**2, max(1, 4_000_000 // self.k**2)
        whole = grid <= 4096 or self.cells > grid // 16
        for at in range(0, len(x), rows):
            p, q = a[at : at + rows], b[at : at + rows]
            if whole:
                cells = np.argpartition((p[:, :, None] + q[:, None, :]).reshape(len(p), grid), self.cells - 1, axis=1)[:, : self.cells]
            else:
                cells = [[i * self.k + j for i, j in multi_sequence(u, v, self.cells)] for u, v in zip(p, q, strict=True)]
            for home, c in zip(own[at : at + rows], cells, strict=True):
                yield [home, *(r for r in np.unique(self.regions[c]).tolist() if r != home)]


def rank(a: np.ndarray, b: np.ndarray, cell: tuple[int, int]) -> int:
    """How many cells a search visits, at most, until it comes to a cell; a and b are its half distances."""
    return int(np.searchsorted(np.sort(b), a[cell[0]] + b[cell[1]] - a + 1e-12, side="right").sum())


def link_rank(x: tuple[np.ndarray, np.ndarray], y: tuple[np.ndarray, np.ndarray]) -> int:
    """How many cells either vector's search visits until one comes to the other's cell."""
    home, other = ((int(a.argmin()), int(b.argmin())) for a, b in (x, y))
    return 1 if home == other else min(rank(*x, other), rank(*y, home))


def planted_cells(index: Index, queries: np.ndarray, threshold: float, seed: int = 11) -> int:
    """Cells that find RECALL of links at the threshold, one in a random direction from each vector."""
    away = np.random.default_rng(seed).normal(size=queries.shape)
    away -= (away * queries).sum(1)[:, None] * queries
    away /= np.maximum(np.sqrt((away * away).sum(1)), 1e-300)[:, None]
    other = threshold * queries + np.sqrt(max(0.0, 1 - threshold**2)) * away
    x, y = index.halves(queries), index.halves(other)
    ranks = [link_rank((x[0][i], x[1][i]), (y[0][i], y[1][i])) for i in range(len(queries))]
    return int(np.quantile(ranks, RECALL, method="higher"))


def _mixed(ids: np.ndarray) -> np.ndarray:
    """The ids in an order without pattern (the finaliser of splitmix64)."""
    x = ids.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def linked_cells(index: Index, queries: np.ndarray, reps: np.ndarray, classes: DataFrame, threshold: float) -> int:
    """Cells that find RECALL of the vectors' links with all classes, in each band; 1 if they have none."""
    shared = classes.sparkSession.sparkContext.broadcast((index, queries, reps))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, queries, reps = shared.value
        qa, qb = index.halves(queries)
        # for a query and band: links met, and the LINKS of least hash among them, as (hash, step)
        met: dict[tuple[int, int], int] = {}
        kept: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.float64).reshape(batch.num_rows, -1)
            rep, (a, b) = batch.column(0).to_numpy(), index.halves(x)
            order = _mixed(rep)
            for at in range(0, len(queries), 250):
                cos = queries[at : at + 250] @ x.T
                for i in np.flatnonzero((cos >= threshold).any(axis=1)).tolist():
                    q, row = at + i, cos[i]
                    near = np.flatnonzero((row >= threshold) & (rep != reps[q]))
                    band = np.clip((row[near] - threshold) / max(1e-12, 1 - threshold) * BANDS, 0, BANDS - 1).astype(int)
                    for k in np.unique(band).tolist():
                        some, best = near[band == k], kept.setdefault((q, k), [])
                        met[q, k] = met.get((q, k), 0) + len(some)
                        if len(best) == LINKS:
                            some = some[order[some] < best[-1][0]]
                        if len(some) > LINKS:
                            some = some[np.argpartition(order[some], LINKS)[:LINKS]]
                        for j in some.tolist():
                            r = link_rank((qa[q], qb[q]), (a[j], b[j]))
                            best.append((int(order[j]), int(np.ceil(np.log(r) / np.log(STEP)))))
                        if len(some):
                            best.sort()
                            del best[LINKS:]
        out = [(q, k, step, met[q, k] / len(best)) for (q, k), best in kept.items() for _, step in best]
        cols = zip(*out, strict=True) if out else [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.float64()), strict=True)], ["q", "band", "step", "n"])

    links = common.materialize(classes.select("rep", "unit").mapInArrow(ranked, "q int, band int, step int, n double").groupBy("q", "band", "step").agg(F.sum("n").alias("n")), "vec-ranks")
    # a group of m is drawn m times as often as a single vector and each of its members has m links
    weight = links.join(links.groupBy("q").agg(F.sum("n").alias("all")), "q").groupBy("band", "step").agg(F.sum(F.col("n") / F.col("all") ** 2).alias("w"))
    bands: dict[int, list[tuple[int, float]]] = {}
    for r in weight.orderBy("band", "step").collect():
        bands.setdefault(r.band, []).append((r.step, r.w))
    steps = [0]
    for found in bands.values():
        reached = np.cumsum([w for _, w in found])
        steps.append(found[int(np.searchsorted(reached, RECALL * reached[-1] * (1 - 1e-9)))][0])
    return int(np.ceil(STEP ** max(steps)))


def _unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """vec_id, unit vector in doubles (null if the vector can't link) and its digest."""
    import xxhash

    for batch in batches:
        units, ones, twos = [], [], []
        for v in batch.column(1):
            x = None
            if v.is_valid and v.values is not None and v.values.null_count == 0 and len(v):
                x = np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64)
                x = x / scale if np.isfinite(x).all() and (scale := np.abs(x).max()) > 0 else None
            if x is None:
                units.append(None), ones.append(None), twos.append(None)
                continue
            digest = np.frombuffer(xxhash.xxh3_128_digest(np.asarray(v.values.to_numpy(zero_copy_only=False), np.float64).tobytes()), "<i8")
            units.append((x / np.sqrt((x * x).sum())).tobytes()), ones.append(int(digest[0])), twos.append(int(digest[1]))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(units, pa.binary()), pa.array(ones, pa.int64()), pa.array(twos, pa.int64())], ["vec_id", "unit", "d1", "d2"])


def _forest(a: np.ndarray, b: np.ndarray) -> list[int]:
    """Positions of links that span all links."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for i, (x, y) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = find(x), find(y)
        if x != y:
            parent[x] = y
            out.append(i)
    return out


def _spanning(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Positions of links (i, j) that connect whatever all connect: the first of each j, and one of each pair of an i
    and the i that j was first met by."""
    if not len(i):
        return np.zeros(0, np.int64)
    order = np.lexsort((i, j))
    _, start, group = np.unique(j[order], return_index=True, return_inverse=True)
    first = order[start]
    pair = i[order].astype(np.int64) * (int(i.max()) + 1) + i[first][group]
    _, one = np.unique(pair, return_index=True)
    return np.unique(np.concatenate([first, order[one]]))


def _close(x: np.ndarray, y: np.ndarray, x32: np.ndarray, y32: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """The pairs of rows with a cosine of threshold or more in double precision. Single precision decides where its
    error, which is bounded by the length of the vectors, can't change the outcome; the rest is computed in double."""
    margin = 2.0 ** -22 * (x.shape[1] + 4)
    cos = x32 @ y32.T
    i, j = np.nonzero(cos >= np.float32(threshold - margin))
    sure = cos[i, j] >= threshold + margin
    for at in range(0, len(i), 100_000):
        some = at + np.flatnonzero(~sure[at : at + 100_000])
        sure[some] = np.einsum("ij,ij->i", x[i[some]], y[j[some]]) >= threshold
    return i[sure], j[sure]


def _meet(threshold: float):
    def run(t: pa.Table) -> pa.Table:
        visitor = t.column("visitor").to_numpy()
        unit = np.frombuffer(b"".join(t.column("unit").to_pylist()), np.float64).reshape(len(visitor), -1)
        slim = unit.astype(np.float32)
        rep, mult, home = (t.column(c).to_numpy() for c in ("rep", "mult", "home"))
        q, m = np.flatnonzero(visitor), np.flatnonzero(~visitor)
        total, credit = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64)
        # whether a member's own search comes to the home of a visitor
        homes, at_home = np.unique(home[q], return_inverse=True)
        visits = t.column("visits").combine_chunks().take(pa.array(m))
        region = visits.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(m)), np.diff(visits.offsets.to_numpy()))
        place = np.minimum(np.searchsorted(homes, region), max(0, len(homes) - 1))
        known = homes[place] == region if len(homes) else np.zeros(len(region), bool)
        back = np.zeros((len(m), len(homes)), bool)
        back[owner[known], place[known]] = True
        edges: list[tuple[int, int]] = []
        for at in range(0, len(q), 500):
            part = q[at : at + 500]
            i, j = _close(unit[part], unit[m], slim[part], slim[m], threshold)
            other = rep[part[i]] != rep[m[j]]
            i, j = i[other], j[other]
            total[part] += np.bincount(i, mult[m[j]], len(part)).astype(np.int64)
            only = ~back[j, at_home[at + i]]  # the other's search doesn't come here
            credit[m] += np.bincount(j[only], mult[part[i[only]]], len(m)).astype(np.int64)
            few = _spanning(i, j)
            a, b = rep[part[i[few]]], rep[m[j[few]]]
            edges += [(int(a[e]), int(b[e])) for e in _forest(a, b)]
        n = total + credit
        at = np.flatnonzero(n)
        kept = _forest(*np.array(edges, np.int64).reshape(-1, 2).T) if edges else []
        a = np.concatenate([rep[at], np.array([edges[e][0] for e in kept], np.int64)])
        b = pa.array([None] * len(at) + [edges[e][1] for e in kept], pa.int64())
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": pa.array([*n[at].tolist(), *[0] * len(kept)], pa.int64())})

    return run


def _met(classes: DataFrame, n: int, threshold: float) -> DataFrame:
    """(a, b, n) of the links between n classes of one length: counts by vector (b null) and forests of links."""
    spark = classes.sparkSession
    rows = classes.select("rep", "unit").orderBy(F.xxhash64("d1", "d2"), "d1", "d2").limit(SAMPLE + QUERIES).collect()
    # the last rows, which the codebooks haven't seen unless they have seen nearly all
    sample, queries = (np.array([np.frombuffer(r.unit, np.float64) for r in x]) for x in (rows[:SAMPLE], rows[-QUERIES:]))
    reps = np.array([r.rep for r in rows[-QUERIES:]])
    fitted = Index(sample, n)
    fitted.cells = min(fitted.k**2, max(planted_cells(fitted, queries, threshold), linked_cells(fitted, queries, reps, classes, threshold)))
    index = spark.sparkContext.broadcast(fitted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.float64).reshape(batch.num_rows, -1) if batch.num_rows else None
            visits = list(index.value.visits(x)) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([v[0] for v in visits], pa.int32()), pa.array(visits, pa.list_(pa.int32()))], ["rep", "mult", "unit", "home", "visits"])

    placed = common.materialize(classes.select("rep", "mult", "unit").mapInArrow(place, "rep long, mult long, unit binary, home int, visits array<int>"), "vec-cells")
    visiting = placed.select("rep", "mult", "unit", "home", F.explode("visits").alias("region"))
    members = placed.groupBy(F.col("home").alias("region")).agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("m_blocks"))
    visitors = visiting.groupBy("region").agg(F.ceil(F.count("*") / VISITORS).cast("int").alias("v_blocks"))
    sizes = common.materialize(members.join(visitors, "region"), "vec-region-sizes")
    salt = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    here = placed.withColumn("region", F.col("home")).join(sizes, "region").withColumn("m", salt("m_blocks")).withColumn("v", spread("v_blocks")).withColumn("visitor", F.lit(False))
    there = visiting.join(sizes, "region").withColumn("v", salt("v_blocks")).withColumn("m", spread("m_blocks")).withColumn("visitor", F.lit(True)).withColumn("visits", F.lit(None).cast("array<int>"))
    cols = ["region", "m", "v", "rep", "mult", "unit", "home", "visits", "visitor"]
    return common.materialize(here.select(cols).union(there.select(cols)).groupBy("region", "m", "v").applyInArrow(_meet(threshold), "a long, b long, n long"), "vec-links")


def linked(vectors: DataFrame, threshold: float = 0.9) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of (vec_id, embedding)."""
    units = common.materialize(vectors.select("vec_id", "embedding").mapInArrow(_unit, "vec_id long, unit binary, d1 long, d2 long"), "vec-units")
    classes = common.materialize(
        units.where("unit is not null and vec_id is not null").groupBy("d1", "d2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("mult"), F.first("unit").alias("unit")),
        "vec-classes",
    )
    found: DataFrame | None = None
    # one index a vector length; a table has few lengths, and vectors of different lengths have no cosine
    for r in classes.groupBy(F.length("unit").alias("size")).count().where("count > 1").orderBy("size").collect():
        own = _met(classes.where(F.length("unit") == r["size"]), r["count"], threshold)
        found = own if found is None else found.union(own)
    own = classes.select("d1", "d2", "rep", "mult")
    if found is None:
        own = own.withColumn("n", F.lit(0)).withColumn("component", F.col("rep"))
    else:
        counts = found.where("b is null").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
        comp = common.components(found.where("b is not null").select("a", "b"), "vec-components", "a", "b").select(F.col("id").alias("rep"), "component")
        own = common.materialize(own.join(counts, "rep", "left").join(comp, "rep", "left"), "vec-placed")
    # vectors that can't link stay out of the join
    none = [F.lit(None).cast("long").alias(c) for c in ("rep", "mult", "n", "component")]
    out = units.where("d1 is not null").join(own, ["d1", "d2"], "left").select("vec_id", "rep", "mult", "n", "component").union(units.where("d1 is null").select("vec_id", *none))
    component = F.coalesce("component", F.when(F.col("vec_id").isNotNull(), F.coalesce("rep", "vec_id")))
    links = F.coalesce(F.col("mult") - 1 + F.coalesce("n", F.lit(0)), F.lit(0)).cast("long")
    return out.select("vec_id", links.alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
