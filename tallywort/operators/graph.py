"""Graph steps, as joins and aggregates: connected components, breadth-first depth, ranks over any number of rows."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_own: dict[str, str] = {}


def held(df: DataFrame) -> DataFrame:
    """A table written to the folder that driver and executors share (spark.checkpoint.dir) and read back: the cut in
    lineage that iterations need. Where that is unset, a local session, which is one process, gets a folder of its own;
    on a cluster that would be each machine's own disk, so there it is an error."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        folder = _own[app] = _own.get(app) or tempfile.mkdtemp(prefix="tallywort-")
    path = f"{folder.rstrip('/')}/tallywort-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame) -> DataFrame:
    """(id, component): each linked node's smallest reachable node. links has src and dst.

    Labels spread along links and then jump to their label's label, so that rounds grow with the logarithm of a
    chain's length; each round is one join and one minimum by node.
    """
    edges = held(links.where("src <> dst").select("src", "dst").union(links.where("src <> dst").select("dst", "src")).distinct())
    labels = held(edges.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    while True:
        near = edges.join(labels, edges["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("low"))
        spread = labels.join(near, labels["id"] == near["src"]).select("id", "component", F.least("component", "low").alias("next"))
        jump = labels.select(F.col("id").alias("_id"), F.col("component").alias("_far"))
        new = held(spread.join(jump, spread["next"] == jump["_id"], "left").select("id", F.least("next", F.coalesce("_far", "next")).alias("component"), (F.col("next") != F.col("component")).alias("moved")))
        labels = new.select("id", "component")
        if not new.where("moved").take(1):
            return labels


def depths(seeds: DataFrame, edges: DataFrame, max_depth: int, max_nodes: int | None = None) -> tuple[DataFrame, bool]:
    """(node, depth) of all nodes within max_depth of the seeds, at their shortest depth, and whether a limit was hit.
    Each level is one join and one anti join; seeds has node, edges has src and dst."""
    frontier = held(seeds.select("node").distinct())
    seen = frontier.withColumn("depth", F.lit(0))
    total, limited = frontier.count(), False
    for depth in range(1, max_depth + 2):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = held(step.join(seen.select("node"), "node", "left_anti"))
        n = frontier.count()
        if not n:
            break
        if depth > max_depth or max_nodes is not None and total + n > max_nodes:
            limited = True
            break
        total += n
        seen = held(seen.unionByName(frontier.withColumn("depth", F.lit(depth))))
    return seen, limited


def numbered(df: DataFrame, name: str, order: list[Column], by: list[str] | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """The rows with their number from 0 in order, within equal `by`, as column name; with between (low, high) only those
    numbered from low on and below high. order should be total.

    Rows are dealt into ranges of by and order and numbered within them; a range's first number is the count of the ranges
    before, so no window holds more than a range, however many rows a value of `by` has. Ranges outside of between aren't
    sorted."""
    by = by or []
    dealt = held(df.repartitionByRange(*(F.col(c) for c in by), *order).withColumn("_part", F.spark_partition_id()))
    counts = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.withColumn("_before", F.coalesce(earlier, F.lit(0)))
    if between:
        starts = starts.where((F.col("_before") < between[1]) & (F.col("_before") + F.col("_n") > between[0]))
    same = F.col("_part") == F.col("_p")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    starts = starts.select(F.col("_part").alias("_p"), "_before", *(F.col(c).alias(f"_by_{c}") for c in by))
    placed = dealt.join(starts, same)
    number = F.row_number().over(Window.partitionBy(*by, "_part").orderBy(*order)) - 1 + F.col("_before")
    out = placed.withColumn(name, number.cast("long")).drop("_part", "_p", "_before", *(f"_by_{c}" for c in by))
    return out.where((F.col(name) >= between[0]) & (F.col(name) < between[1])) if between else out


def job_depths(seeds: DataFrame, edges: DataFrame, limits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(visited, jobs): the nodes that each job reaches, (job, node, depth), and (job, n_pages, limited). seeds has job and
    node; edges src and dst, shared by all jobs; limits job, max_depth and max_pages.

    All jobs advance by levels together. Of a level that would take a job beyond max_pages its first nodes in order stay;
    limited says that a job was cut so, or would have gone deeper than max_depth. Jobs without seeds reach nothing; seeds of
    unknown jobs are left out."""
    cap = limits.select("job", "max_depth", "max_pages")
    level = held(seeds.join(cap, "job").select("job", "node").distinct())
    visited, cut, depth = None, [], 0
    while True:
        used = None if visited is None else visited.groupBy("job").agg(F.count("*").alias("_used"))
        j = numbered(level, "_rank", [F.col("node")], ["job"]).join(cap, "job")
        j = j.withColumn("_used", F.lit(0)) if used is None else j.join(used, "job", "left")
        fits = (F.col("_rank") + F.coalesce("_used", F.lit(0)) < F.col("max_pages")) & (F.lit(depth) <= F.col("max_depth"))
        j = held(j.select("job", "node", fits.alias("_fits")))
        cut.append(j.where(~F.col("_fits")).select("job").distinct())
        kept = j.where("_fits").select("job", "node")
        if not kept.take(1):
            break
        new = kept.withColumn("depth", F.lit(depth))
        visited = held(new if visited is None else visited.unionByName(new))
        step = kept.join(edges, F.col("node") == F.col("src")).select("job", F.col("dst").alias("node")).distinct()
        level = held(step.join(visited.select("job", "node"), ["job", "node"], "left_anti"))
        depth += 1
    if visited is None:
        visited = j.where("_fits").select("job", "node", F.lit(0).alias("depth"))
    limited = cut[0]
    for c in cut[1:]:
        limited = limited.union(c)
    n = visited.groupBy("job").agg(F.count("*").alias("n_pages"))
    jobs = cap.select("job").join(n, "job", "left").join(limited.distinct().withColumn("_cut", F.lit(True)), "job", "left")
    return visited, jobs.select("job", F.coalesce("n_pages", F.lit(0)).alias("n_pages"), F.coalesce("_cut", F.lit(False)).alias("limited"))
