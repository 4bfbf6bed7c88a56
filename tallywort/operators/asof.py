"""Records as they stood at a time: each probe with its key's last version up to then.

Versions and probes are sorted together into ranges of (key, time), so that a key of any size is spread over as many ranges
as it fills. Within a range the last version runs along; only a range's last versions are carried on to later ranges of the
same key, one row a range and key that goes on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import held


def as_of(probes: DataFrame, versions: DataFrame, key: str, at: str, since: str, values: list[str], ranges: int | None = None) -> DataFrame:
    """The probes with the values of their key's latest version whose time `since` is not after the probe's time `at`; null
    where there is none. Versions of the same time: the one of greatest values counts. Probes and versions without a key or
    a time don't meet anything; repeated probes stay."""
    spark = probes.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in probes.columns if c not in (key, at)]
    ok = F.col(key).isNotNull() & F.col(at).isNotNull()
    one = versions.where(F.col(key).isNotNull() & F.col(since).isNotNull()).select(F.col(key).alias("_k"), F.col(since).alias("_t"), F.lit(0).alias("_kind"), F.struct(*values).alias("_v"))
    two = probes.where(ok).select(F.col(key).alias("_k"), F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.struct(*rest, F.lit(1).alias("_")).alias("_p"))
    both = one.unionByName(two, allowMissingColumns=True)
    salt = F.xxhash64(F.to_json("_v"), F.to_json("_p"))  # so that many rows of one key and time are spread too
    dealt = held(both.withColumn("_s", salt).repartitionByRange(n, "_k", "_t", "_kind", "_s").withColumn("_part", F.spark_partition_id()))
    along = Window.partitionBy("_part", "_k").orderBy("_t", "_kind", "_v").rowsBetween(Window.unboundedPreceding, 0)
    seen = dealt.withColumn("_last", F.last(F.when(F.col("_kind") == 0, F.struct("_t", "_v")), ignorenulls=True).over(along)).where("_kind = 1")
    ends = dealt.groupBy("_k", "_part").agg(F.max(F.when(F.col("_kind") == 0, F.struct("_t", "_v"))).alias("_end"))
    several = ends.groupBy("_k").agg(F.count("*").alias("_n")).where("_n > 1").select("_k")
    before = Window.partitionBy("_k").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(several, "_k").select("_k", "_part", F.max("_end").over(before).alias("_carried"))
    found = seen.join(carried, ["_k", "_part"], "left").withColumn("_best", F.greatest("_last", "_carried"))
    out = found.select(F.col("_k").alias(key), F.col("_t").alias(at), *(F.col(f"_p.{c}").alias(c) for c in rest), *(F.col(f"_best._v.{c}").alias(c) for c in values))
    none = [F.lit(None).cast(versions.schema[c].dataType).alias(c) for c in values]
    return out.unionByName(probes.where(~ok).select(key, at, *rest, *none))
