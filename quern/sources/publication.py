"""Versioned publication: a generation is written, read back and validated before one atomic rename makes it current.

    <root>/chunks/generation_id=…/source_id=…   the chunks, never rewritten
    <root>/manifests/<generation_id>.json       what was written, and its status
    <root>/current.json                         the pointer that readers resolve once
"""

from __future__ import annotations

import json
import re
import uuid
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.retrieval import nearest

_ID = re.compile(r"^\d{8}T\d{6}Z-[0-9a-f]{12}$")


class PublicationError(ValueError):
    """A generation that must not become current."""


class Store:
    """Generations below a root that any Hadoop file system holds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _read(self, name: str) -> dict | None:
        at = f"{self.root}/{name}"
        if not self._fs.exists(self._path(at)):
            return None
        return json.loads("\n".join(r["value"] for r in self.spark.read.text(at).collect()))

    def _write(self, name: str, value: dict) -> None:
        """Written beside its place and renamed over it, so that a reader sees the old or the new one."""
        at, beside = self._path(f"{self.root}/{name}"), self._path(f"{self.root}/_{uuid.uuid4().hex}")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(json.dumps(value, sort_keys=True, ensure_ascii=False).encode()))
        stream.close()
        options = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        array = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        array[0] = options
        self._fs.mkdirs(at.getParent())
        context = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri() if at.toUri().getScheme() else self._path(f"file://{at}").toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        context.rename(beside, at, array)

    @contextmanager
    def _writing(self):
        """One writer at a time: a file that only one can create. A writer that died leaves it; see unlock."""
        at = self._path(f"{self.root}/_writer")
        try:
            self._fs.create(at, False).close()
        except Exception as e:
            raise PublicationError("another writer is at work") from e
        try:
            yield
        finally:
            self._fs.delete(at, False)

    def unlock(self) -> bool:
        """Take away the lock of a writer that is known to be dead; whether there was one."""
        return bool(self._fs.delete(self._path(f"{self.root}/_writer"), False))

    def _noted(self, action: str, generation: str, outcome: str) -> None:
        """A line of the audit: a file for each, so that nothing is rewritten."""
        at = datetime.now(UTC).isoformat()
        self._write(f"audit/{at.replace(':', '')}-{uuid.uuid4().hex[:8]}.json", {"at": at, "action": action, "generation_id": generation, "outcome": outcome})

    def audit(self) -> DataFrame:
        """(at, action, generation_id, outcome) of everything that was tried."""
        return self.spark.read.schema("at string, action string, generation_id string, outcome string").json(f"{self.root}/audit")

    def manifest(self, generation: str) -> dict | None:
        """What is known of a generation. The pointer alone says which one is active: one that was, or had been about to be
        when its writer died, is superseded."""
        told = self._read(f"manifests/{generation}.json")
        if told and told["status"] in ("active", "superseded"):
            told["status"] = "active" if self.current() == generation else "superseded"
        return told

    def current(self) -> str | None:
        """The current generation; None where there is none, or its name is empty or not well formed."""
        name = (self._read("current.json") or {}).get("generation_id") or ""
        return name if _ID.match(name) else None

    def ready(self) -> bool:
        """Whether the pointer leads to a manifest that is active."""
        name = self.current()
        return bool(name) and (self.manifest(name) or {}).get("status") == "active"

    def chunks(self, generation: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/chunks/generation_id={generation}").withColumn("generation_id", F.lit(generation))

    def passages(self, generation: str) -> DataFrame:
        """The chunks as retrieval shows them, without their embedding."""
        return self.chunks(generation).drop("embedding")

    def _validated(self, generation: str, count: int, width: int) -> dict[str, bool]:
        """Read back: as many rows as stated, every embedding of the stated width, and a search with the first chunk of each
        source finds it, or one equal to it, in that source."""
        rows = self.chunks(generation)
        found = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("embedding").isNull() | (F.size("embedding") != width)).alias("bad"), F.count_distinct("source_id").alias("sources")).first()
        asked = rows.groupBy("source_id").agg(F.min_by("embedding", "chunk_id").alias("embedding")).withColumn("query_id", F.xxhash64("source_id"))
        hits = nearest(asked.select("query_id", "embedding"), rows, 1, 1e-6).where(F.col("query_id") == F.xxhash64("source_id"))
        return {"count": found["n"] == count, "dimensions": found["bad"] == 0, "smoke": hits.count() == found["sources"]}

    def publish(self, generation: str, chunks: DataFrame, width: int, **stated) -> dict:
        """Write, validate and make current; the manifest. Chunks need chunk_id, source_id and embedding. What fails leaves
        its manifest as failed and the pointer alone; a generation that exists is refused."""
        if not _ID.match(generation):
            raise PublicationError(f"{generation} is no generation id")
        if self.manifest(generation):
            raise PublicationError(f"{generation} exists")
        with self._writing():
            try:
                told = self._published(generation, chunks, width, stated)
            except Exception as e:
                self._noted("publish", generation, f"failed: {type(e).__name__}")
                raise
            self._noted("publish", generation, "active")
            return told

    def _published(self, generation: str, chunks: DataFrame, width: int, stated: dict) -> dict:
        count = chunks.count()
        if not count or chunks.where(F.col("embedding").isNull()).limit(1).count():
            raise PublicationError("nothing to publish, or a chunk without an embedding")
        told = {"generation_id": generation, "status": "staging", "chunk_count": count, "embedding_dimensions": width, "previous_generation_id": self.current(), **stated}
        self._write(f"manifests/{generation}.json", told)
        try:
            chunks.write.mode("errorifexists").partitionBy("source_id").parquet(f"{self.root}/chunks/generation_id={generation}")
            told["validation_results"] = self._validated(generation, count, width)
            if not all(told["validation_results"].values()):
                raise PublicationError(f"validation failed: {told['validation_results']}")
        except Exception:
            self._write(f"manifests/{generation}.json", told | {"status": "failed"})
            raise
        return self._switch(told)

    def _switch(self, told: dict) -> dict:
        """The pointer's rename is the one step that counts; what the manifests say follows it (see manifest)."""
        before = self.current()
        told = told | {"status": "active"}
        self._write(f"manifests/{told['generation_id']}.json", told)
        self._write("current.json", {"generation_id": told["generation_id"]})
        if before and before != told["generation_id"]:
            self._write(f"manifests/{before}.json", self.manifest(before) | {"status": "superseded"})
        return told

    def rollback(self, generation: str, expected: str) -> dict:
        """Make an earlier generation current again if ``expected`` still is: it must be superseded and validate anew."""
        with self._writing():
            told = self.manifest(generation)
            if not told or told["status"] != "superseded":
                raise PublicationError(f"{generation} is not superseded")
            if not all(self._validated(generation, told["chunk_count"], told["embedding_dimensions"]).values()):
                raise PublicationError(f"{generation} does not validate")
            if self.current() != expected:
                raise PublicationError("another generation became current meanwhile")
            self._noted("rollback", generation, "active")
            return self._switch(told)
