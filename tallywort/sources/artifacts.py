"""A cache of one published artifact: what was fetched is staged, validated by reading it, and only then put in place.

The cache is a folder of any of Spark's file systems. An artifact's file is named by its digest and the metadata file names
the current one, so that a single rename publishes both; a broken artifact never replaces a good one.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from tallywort.operators.store import Files

#: How long an artifact may be used, and its greatest size.
MAX_AGE_HOURS, MAX_BYTES = 48, 512 * 2**20


class ArtifactError(ValueError):
    """An artifact that can't be used; metadata tells of the one that is retained."""

    def __init__(self, reason: str, metadata: dict | None = None):
        super().__init__(reason)
        self.metadata = metadata or {}


class ArtifactCache:
    """One writer's cache below a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.files = Files(spark, self.folder)

    def _meta(self) -> str:
        return f"{self.folder}/metadata.json"

    def metadata(self) -> dict:
        """Of the current artifact; empty if there is none, or its file can't be read as such."""
        if not self.files.exists(self._meta()):
            return {}
        try:
            found = json.loads(self.files.read(self._meta()))
        except ValueError:
            return {}
        return found if isinstance(found, dict) else {}

    def path(self) -> str | None:
        name = self.metadata().get("file")
        return f"{self.folder}/{name}" if name else None

    def validators(self, url: str) -> dict[str, str]:
        """Headers that let a source say that the artifact at the url hasn't changed."""
        old = self.metadata()
        pairs = {"If-None-Match": old.get("etag"), "If-Modified-Since": old.get("last_modified")}
        return {k: v for k, v in pairs.items() if v} if old.get("url") == url else {}

    def _age(self, now: datetime) -> float | None:
        said = self.metadata().get("retrieved_at")
        return None if not said else max(0.0, (now - datetime.fromisoformat(said)).total_seconds())

    def accept(
        self, status: int, url: str, headers: dict[str, str], staged: str | None, read: Callable[[str], DataFrame], now: datetime, extension: str = ".zip",
        max_bytes: int = MAX_BYTES, max_age_hours: float = MAX_AGE_HOURS,
    ) -> tuple[DataFrame, dict]:
        """(rows, metadata) after a fetch that answered with a status, its headers (names in any case) and, for 200, a staged
        file. read reads an artifact's file and raises if it is broken.

        200: the staged file is checked for size and kind, read, and only then published. 304: the retained artifact is used
        if its digest still holds and it isn't older than max_age_hours. Anything else, and every failed check, is an
        ArtifactError that leaves the cache as it was, with the retained artifact's age; it is never used in its stead."""
        now = now if now.tzinfo else now.replace(tzinfo=UTC)
        low = {k.lower(): v for k, v in headers.items()}
        old, age = self.metadata(), self._age(now)
        kept = {**old, "retained_age_seconds": None if age is None else int(age)}
        if status == 304:
            current = self.path()
            if current is None or not self.files.exists(current) or age is None:
                raise ArtifactError("not modified, but nothing is retained", kept)
            if self.files.sha256(current) != old.get("sha256"):
                raise ArtifactError("the retained artifact has changed", kept)
            if age > max_age_hours * 3600:
                raise ArtifactError("the retained artifact is stale", kept)
            return read(current), {**kept, "cache_reused": True}
        if status != 200 or staged is None:
            raise ArtifactError(f"the fetch answered {status}", kept)
        size, declared = self.files.size(staged), low.get("content-length", "")
        if size > max_bytes or declared.isdigit() and int(declared) > max_bytes:
            raise ArtifactError("the artifact is too large", kept)
        if declared.isdigit() and int(declared) != size:
            raise ArtifactError("the artifact is incomplete", kept)
        kind = low.get("content-type", "").lower()
        if extension == ".zip" and kind and "zip" not in kind and "octet-stream" not in kind:
            raise ArtifactError("the artifact is of an unexpected kind", kept)
        try:
            rows = read(staged)
        except Exception as e:
            raise ArtifactError(f"the artifact can't be read: {e}", kept) from e
        digest = self.files.sha256(staged)
        name = f"artifact-{digest}{extension}"
        made = {
            "file": name, "url": url, "sha256": digest, "size": size, "etag": low.get("etag", ""), "last_modified": low.get("last-modified", ""),
            "retrieved_at": now.isoformat(),
        }
        if not self.files.exists(f"{self.folder}/{name}"):
            self.files.move(staged, f"{self.folder}/{name}")
        self.files.create(f"{self._meta()}.new", json.dumps(made, sort_keys=True, indent=2), overwrite=True)
        self.files.replace(f"{self._meta()}.new", self._meta())
        if old.get("file") and old["file"] != name:
            self.files.delete(f"{self.folder}/{old['file']}")
        return rows, {**made, "cache_reused": False}
