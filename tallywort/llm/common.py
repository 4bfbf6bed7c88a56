"""Shared pieces of the pipeline operators: working storage, word splitting, hashing, components."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Regular expression class of the white space that separates words.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
SPACE_BYTES = b" \t\n\x0b\x0c\r"

#: Rows of a batch of texts in a Python worker, where the session doesn't set a number of its own.
TEXT_ROWS = 1_000
#: The number of a setting of glibc (fixed value).
M_MMAP_THRESHOLD = -3
_ROWS_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(df: DataFrame) -> None:
    """Make the session hand texts to Python workers in batches of TEXT_ROWS, since ten thousand long ones would
    fill a worker's memory. A number that the session sets itself stays."""
    conf = df.sparkSession.conf
    if conf.get(_ROWS_SETTING) == "10000":
        conf.set(_ROWS_SETTING, str(TEXT_ROWS))


def lean_worker() -> None:
    """Let a Python worker give memory back: arrays of a quarter of a megabyte or more are mapped on their own, so that
    they are returned when freed, and what earlier tasks left is released. Without glibc only the latter, by Arrow."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt") and hasattr(libc, "malloc_trim"):
        libc.mallopt(M_MMAP_THRESHOLD, 1 << 18)
        libc.malloc_trim(0)
    pa.default_memory_pool().release_unused()


_own_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session, which is one
    process, gets a folder of its own; on a cluster it would be each machine's own disk, so there it is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _own_folders[app] = _own_folders.get(app) or tempfile.mkdtemp(prefix="tallywort-")
    return folder.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, removed when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/tallywort-{uuid.uuid4().hex}/{name}"
    jvm = spark.sparkContext._jvm
    parent = jvm.org.apache.hadoop.fs.Path(path).getParent()
    parent.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(parent)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back. The files outlive any executor,
    and their known size lets Spark choose between broadcast and shuffle."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unused(columns: list[str], *names: str) -> list[str]:
    """Names for helper columns that no column has, in any case of letters."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Most rows of ids that are broadcast.
BROADCAST_ROWS = 1_000_000


def join_by_id(df: DataFrame, other: DataFrame, on: Column, how: str, rows: int | None = None) -> DataFrame:
    """Join a wide table with a slim materialized one: a broadcast if the slim side's rows (counted, unless
    given) are few enough, else a shuffle with its hash table on the slim side, so that texts aren't sorted."""
    n = other.count() if rows is None else rows
    return df.join(F.broadcast(other) if n <= BROADCAST_ROWS else other.hint("shuffle_hash"), on, how)


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    squeezed = F.regexp_replace(F.regexp_replace(text, WORD, "x"), f"[{SPACE}]+", "")
    return F.coalesce(F.length(squeezed), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all output bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def window_hashes(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the runs of k consecutive words, in order; empty if there are fewer words."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, k):
        out = mix64(out + np.uint64(0x9E3779B97F4A7C15 * j % 2**64)) ^ hashes[j : j + n]
    return mix64(out)


def components(edges: DataFrame, name: str = "components", src: str = "src", dst: str = "dst") -> DataFrame:
    """Connected components of undirected links between integer ids: (id, component), the component
    being its smallest id. Only ids with a link are returned.

    Alternates large-star and small-star steps over an edge table. A hub's neighbours are never
    gathered: each step takes a minimum per node, pre-aggregated before the shuffle, and joins it back.
    Every round is written to the shared folder.
    """
    e = materialize(
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v")).where("u <> v").distinct(),
        f"{name}-0",
    )
    last = None
    for step in range(1, 60):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        )
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(joined.select("u", F.col("m").alias("v")))
            .distinct()
        )
        e = materialize(small, f"{name}-{step}")
        sums = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sums == last:
            break
        last = sums
    else:
        raise RuntimeError("components did not settle")
    pairs = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return pairs.union(pairs.select(F.col("component").alias("id"), "component").distinct())
