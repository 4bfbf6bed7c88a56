"""Embedding whitening by upper-triangle column aggregates.

The covariance of d columns is one aggregation of d (d + 1) / 2 generated SQL sums of centred products, pre-aggregated in
the tasks, so that a row of sums a task is all that shuffles. The matrix, whose size depends on d alone, is decomposed by
LAPACK on the driver; rows are projected in their tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: How entries become whole numbers: floor(SCALE c) + SHIFT (fixed values).
SCALE, SHIFT = 64, 1_000_000
#: Entries beyond this times 1 / SCALE count as this, so that whole numbers stay exact as doubles.
MOST = 2**52
COMPONENTS = 32
#: Sums of one aggregation. Wider vectors (of more than 90 entries) take several, each over its pairs' columns only.
SUMS = 4096


def pair_sums(df: DataFrame, columns: list[str], means: list[float]) -> np.ndarray:
    """The matrix of sums of centred products of all columns of doubles, by the upper triangle."""
    d = len(columns)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    out = np.zeros((d, d))
    for begin in range(0, len(pairs), SUMS):
        some = pairs[begin : begin + SUMS]
        used = sorted({k for pair in some for k in pair})
        centred = df.selectExpr(*(f"`{columns[k]}` - ({means[k]!r}D) AS c{k}" for k in used))
        row = centred.selectExpr(*(f"sum(c{i} * c{j}) AS s{i}_{j}" for i, j in some)).first()
        for (i, j), x in zip(some, row, strict=True):
            out[i, j] = out[j, i] = x or 0.0
    return out


def decomposed(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in falling order and unit eigenvectors as columns, each with its largest entry positive. Values
    within rounding of nought are nought."""
    e, u = np.linalg.eigh(v)
    e, u = e[::-1].copy(), u[:, ::-1]
    e[e <= max(e[0], 0) * len(e) * np.finfo(float).eps] = 0
    return e, u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums of (n x - S)^2 by row; null where a sum doesn't fit a long."""
    apart = np.abs(n * x.astype(float) - np.array(sums, float)).max(initial=0)
    if n * float(np.abs(x).max(initial=0)) < 2**62 and apart**2 * x.shape[1] < 2**62:
        return ((n * x - np.array(sums, np.int64)) ** 2).sum(1).tolist()
    exact = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums, strict=True)) for row in x]
    return [y if y < 2**63 else None for y in exact]


def _whitened(rows: DataFrame, d: int, components: int) -> DataFrame:
    """The result for vectors of one length: rows has vec_id and v."""
    kind = rows.schema["vec_id"].dataType
    units = [f"CAST(floor(least(greatest({SCALE}D * CAST(v[{i}] AS DOUBLE), -{MOST}D), {MOST}D)) AS BIGINT) + {SHIFT}L" for i in range(d)]
    entries = rows.selectExpr("vec_id", *(f"{u} AS x{i}" for i, u in enumerate(units)))
    n, *sums = entries.selectExpr("count(*) AS n", *(f"sum(CAST(x{i} AS DECIMAL(20, 0))) AS s{i}" for i in range(d))).first()
    sums = [int(s) for s in sums]
    means = [s / n for s in sums]
    names = [f"x{i}" for i in range(d)]
    e, u = decomposed(pair_sums(entries.selectExpr(*(f"CAST({c} AS DOUBLE) AS {c}" for c in names)), names, means) / n)
    k = min(components, d)
    live = e[:k] > 0
    u = np.where(live, u[:, :k] / np.sqrt(np.where(live, e[:k], 1)), np.nan)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(batch.num_rows, d)
            x = np.floor(np.clip(SCALE * c, -MOST, MOST)).astype(np.int64) + SHIFT
            w = (x - np.array(means)) @ u
            ends = pa.array(np.arange(batch.num_rows + 1) * k, pa.int32())
            flat = pa.array(w.ravel(), pa.float64(), mask=np.isnan(w.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(deviations(x, n, sums), pa.int64()), pa.ListArray.from_arrays(ends, flat)], ["vec_id", "deviation", "w"])

    schema = T.StructType([T.StructField("vec_id", kind), T.StructField("deviation", T.LongType()), T.StructField("w", T.ArrayType(T.DoubleType()))])
    projected = common.materialize(rows.mapInArrow(project, schema), "whitening-projected")
    some = [i for i in range(k) if live[i]]
    error = None
    if some:
        columns = projected.selectExpr(*(f"w[{i}] AS w{i}" for i in some))
        middle = columns.selectExpr(*(f"avg(w{i}) AS m{i}" for i in some)).first()
        error = float(np.abs(pair_sums(columns, [f"w{i}" for i in some], list(middle)) / n - np.eye(len(some))).max())
    shares = [x / e.sum() if e.sum() > 0 else None for x in e[:k].tolist()]
    explained = F.array(*(F.lit(x).cast("double") for x in shares))
    one = projected.select("vec_id", "deviation", F.posexplode("w").alias("place", "whitened"))
    return one.select(
        "vec_id", (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
        F.get(explained, F.col("place")).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )


def whitened(embeddings: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) of embeddings (vec_id, embedding): a row a
    vector and component, the first `components` by falling variance.

    Vectors that are null, or hold null or non-finite entries, are dropped; empty ones have no components. Vectors of
    unlike lengths are fitted apart, one fit a length, so lengths should be few. Repeated rows and null ids each keep
    rows of their own. A component without variance has a null whitened value and no part in identity_error. Entries
    beyond 2^46 count as 2^46; a deviation that doesn't fit a long is null. An empty table gives no rows; other columns
    are ignored.
    """
    common.bound_batches(embeddings)
    v = F.col("embedding")
    finite = F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    rows = embeddings.where(v.isNotNull() & (F.size(v) > 0)).where(finite).select("vec_id", v.alias("v"))
    lengths = sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())
    out = [_whitened(rows if len(lengths) == 1 else rows.where(F.size("v") == d), d, components) for d in lengths]
    if not out:
        kind = embeddings.schema["vec_id"].dataType.simpleString()
        return embeddings.sparkSession.createDataFrame([], f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double")
    whole = out[0]
    for x in out[1:]:
        whole = whole.unionByName(x)
    return whole
