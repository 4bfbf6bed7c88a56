"""Versioned snapshots: each write is a new folder with a manifest, and one pointer file names the current one.

All files are reached through Spark's file systems, so a store may lie on any of them. Parts are hashed where they are
read, by the executors; the driver sees one short row a part.
"""

from __future__ import annotations

import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUIRED = ["bidder_master", "records"]


class Files:
    """Small files, and renames, of the file system that holds a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.gateway = spark.sparkContext._gateway
        self.fs = self.path(folder).getFileSystem(conf)
        self.context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def exists(self, name: str) -> bool:
        return self.fs.exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def size(self, name: str) -> int:
        return self.fs.getFileStatus(self.path(name)).getLen()

    def sha256(self, name: str) -> str:
        """A file's digest, read in pieces by the JVM."""
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.codec.digest.DigestUtils.sha256Hex(stream)
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.path(name), False)

    def create(self, name: str, text: str, overwrite: bool = False) -> None:
        """Write a file; one that exists is an error unless it may be overwritten."""
        stream = self.fs.create(self.path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def replace(self, name: str, target: str) -> None:
        """Rename, in one step, over what is there."""
        kind = self.jvm.org.apache.hadoop.fs.Options.Rename
        options = self.gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE
        self.context.rename(self.path(name), self.path(target), options)

    def move(self, name: str, target: str) -> None:
        """Rename a folder to a name that nothing has."""
        self.context.rename(self.path(name), self.path(target), self.gateway.new_array(self.jvm.org.apache.hadoop.fs.Options.Rename, 0))


class Store:
    """Tables of one writer below a folder. Readers see whole versions only: the pointer moves by an atomic rename
    after everything is written."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Files(spark, self.folder)

    def _pointer(self) -> str:
        return f"{self.folder}/_CURRENT"

    def version(self) -> int:
        return int(self.files.read(self._pointer())) if self.files.exists(self._pointer()) else 0

    def write(self, tables: dict[str, DataFrame]) -> int:
        """A new version with these tables replaced and all others as they were."""
        old, new = self.version(), self.version() + 1
        manifest = dict(self.manifest()) if old else {}
        for name, df in tables.items():
            path = f"{self.folder}/{name}/v{new}"
            df.write.parquet(path)
            manifest[name] = {"path": f"{name}/v{new}", "rows": self.spark.read.parquet(path).count(), "sha256": _digest(self.spark, path)}
        self.files.create(f"{self.folder}/manifest-{new}.json", json.dumps(manifest, indent=2, sort_keys=True))
        self.files.create(f"{self._pointer()}.{new}", str(new), overwrite=True)
        self.files.replace(f"{self._pointer()}.{new}", self._pointer())
        return new

    def manifest(self) -> dict:
        return json.loads(self.files.read(f"{self.folder}/manifest-{self.version()}.json"))

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{self.manifest()[name]['path']}")

    def verify(self, required: list[str] = REQUIRED) -> list[str]:
        """What is wrong with the current version: missing tables, changed files, changed row counts."""
        if not self.version():
            return [f"missing {t}" for t in required]
        manifest = self.manifest()
        wrong = [f"missing {t}" for t in required if t not in manifest]
        for name, m in manifest.items():
            path = f"{self.folder}/{m['path']}"
            if not self.files.exists(path) or _digest(self.spark, path) != m["sha256"]:
                wrong.append(f"changed {name}")
            elif self.spark.read.parquet(path).count() != m["rows"]:
                wrong.append(f"row count of {name}")
        return wrong


def _digest(spark: SparkSession, path: str) -> str | None:
    """One digest of a table's parts by name; none if the file system finds that a part isn't what was written."""
    parts = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path)
    each = F.struct(F.regexp_extract("path", "[^/]*$", 0).alias("name"), F.sha2("content", 256).alias("sha256"))
    try:
        return parts.select(each.alias("part")).agg(F.sha2(F.to_json(F.sort_array(F.collect_list("part"))), 256)).first()[0]
    except Py4JJavaError as e:
        if "ChecksumException" in str(e):
            return None
        raise


def restore(spark: SparkSession, backup: str, target: str) -> Store:
    """The current version of a verified store, copied by the executors to a folder that doesn't exist yet; nothing is
    ever overwritten."""
    source = Store(spark, backup)
    wrong = source.verify()
    if wrong:
        raise ValueError("the backup is damaged: " + ", ".join(wrong))
    files = Files(spark, target)
    if files.exists(target):
        raise ValueError("the target exists")
    made = Store(spark, f"{target.rstrip('/')}.new")
    manifest = source.manifest()
    made.write({name: source.read(name) for name in manifest})
    if {n: m["rows"] for n, m in made.manifest().items()} != {n: m["rows"] for n, m in manifest.items()}:
        raise ValueError("the copy lost rows")
    files.move(made.folder, target)
    return Store(spark, target)


def bundle(events: DataFrame, path: str, limit: int = 5_000) -> None:
    """A zip of the newest log events, redacted on the executors; at most limit short rows reach the driver."""
    import zipfile

    from tallywort.functions.urls import redacted, sanitized_json

    rows = events.orderBy(F.desc("id")).limit(limit).select("id", "level", redacted(F.col("message")).alias("message"), sanitized_json(F.col("details")).alias("details"))
    lines = [json.dumps(r.asDict(), sort_keys=True) for r in rows.collect()]
    with zipfile.ZipFile(path, "x", zipfile.ZIP_DEFLATED) as z:
        z.writestr("events.jsonl", "\n".join(reversed(lines)))
        z.writestr("summary.json", json.dumps({"events": len(lines)}))
