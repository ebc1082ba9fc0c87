"""Files that arrive: a stream of files, parsed and merged into typed tables batch by batch.

State is the tables themselves. A batch skips files whose path and content are known and replaces all rows
of the others' sources; rows and hashes appear together, so that a batch that fails is taken in again.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomspan.common import cut
from loomspan.operators.store import changed, replace_by_source
from loomspan.sources import files as S

TABLES = tuple(S.SCHEMAS)


def source_column(name: str) -> str:
    """The column of a stored table that holds the file's path; some records have a path of their own."""
    return "source_path" if "path" in S.field_names(name) else "path"


def stored_schema(name: str) -> str:
    return f"{source_column(name)} string, {S.SCHEMAS[name]}"


BUCKETS = 32  # parts of each table, by the path that rows come from; a batch rewrites those that its files fall into


class TableStore:
    """Typed tables as Parquet folders, each in BUCKETS parts. A manifest names the folders that make up all
    tables; it's put in place as the last step of a batch, so readers see all of a batch or nothing of it,
    and a batch that fails leaves nothing behind that is read. Folders that neither the manifest nor the
    one before it names are deleted."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _fs(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        return path(self.folder).getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def _versions(self) -> list[int]:
        fs, path = self._fs()
        at = path(f"{self.folder}/manifests")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def _manifest(self, version: int | None = None) -> dict[str, dict[str, str]]:
        versions = self._versions()
        if not versions:
            return {}
        rows = self.spark.read.text(f"{self.folder}/manifests/{version if version is not None else versions[-1]}.json", wholetext=True)
        return json.loads(rows.first()[0])

    def read(self, name: str, schema: str, buckets: list[int] | None = None) -> DataFrame:
        """A table, or some of its buckets, as of the last complete batch."""
        held = self._manifest().get(name, {})
        folders = [f"{self.folder}/{at}" for bucket, at in sorted(held.items()) if buckets is None or int(bucket) in buckets]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def holds(self, name: str, buckets: list[int]) -> bool:
        """Whether a table has rows in any of these buckets."""
        return any(int(bucket) in buckets for bucket in self._manifest().get(name, {}))

    def commit(self, changes: dict[str, tuple[DataFrame, str]], buckets: list[int]) -> None:
        """Puts new rows, of the column that holds their path, in place of the given buckets of tables, all at once."""
        fs, path = self._fs()
        manifest, mark = self._manifest(), uuid.uuid4().hex
        for name, (rows, source) in changes.items():
            at = f"{name}/{mark}"
            rows.withColumn("_bucket", bucket_of(F.col(source))).write.partitionBy("_bucket").parquet(f"{self.folder}/{at}")
            kept = {k: v for k, v in manifest.get(name, {}).items() if int(k) not in buckets}
            parts = [p.getPath().getName() for p in fs.listStatus(path(f"{self.folder}/{at}"))]
            manifest[name] = kept | {p.removeprefix("_bucket="): f"{at}/{p}" for p in parts if p.startswith("_bucket=")}
        versions = self._versions()
        number = versions[-1] + 1 if versions else 0
        draft, final = path(f"{self.folder}/manifests/_{mark}"), path(f"{self.folder}/manifests/{number}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if not fs.rename(draft, final):
            raise RuntimeError("another batch was written at the same time")
        self._sweep([manifest, self._manifest(versions[-1]) if versions else {}], versions[:-1])

    def _sweep(self, manifests: list[dict[str, dict[str, str]]], old: list[int]) -> None:
        fs, path = self._fs()
        used = {"/".join(at.split("/")[:2]) for m in manifests for parts in m.values() for at in parts.values()}
        for name in manifests[0]:
            if not fs.exists(path(f"{self.folder}/{name}")):
                continue
            for folder in fs.listStatus(path(f"{self.folder}/{name}")):
                if f"{name}/{folder.getPath().getName()}" not in used:
                    fs.delete(folder.getPath(), True)
        for version in old:
            fs.delete(path(f"{self.folder}/manifests/{version}.json"), False)


def bucket_of(path: Column) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def _buckets(paths: DataFrame) -> list[int]:
    return sorted(r[0] for r in paths.select(bucket_of(F.col("path"))).distinct().collect())  # BUCKETS rows at most


SOURCE = "path string, content_hash string"


def merge_batch(store: TableStore, files: DataFrame, batch: int, parse: Callable[[DataFrame], DataFrame] = S.parse, tables: tuple[str, ...] = TABLES) -> None:
    """Takes a batch of files (path, content, content_hash) into the store's tables, all in one commit. Files
    whose path and content are known are skipped; of repeats of a path the largest row counts."""
    latest = files.filter("path IS NOT NULL").groupBy("path").agg(F.max(F.struct("content_hash", "content")).alias("f")).select("path", "f.content", "f.content_hash")
    fresh = cut(changed(latest, store.read("source", SOURCE)))
    buckets = _buckets(fresh)
    if not buckets:
        return
    parsed = cut(parse(fresh))
    found = {r.tag for r in parsed.select("tag").distinct().collect()}  # as many as there are tables, at most
    changes = {}
    for name in tables:
        if name not in found and not store.holds(name, buckets):
            continue
        source = source_column(name)
        changes[name] = (replace_by_source(store.read(name, stored_schema(name), buckets), S.records(parsed, name, source), source, fresh.select(F.col("path").alias(source))), source)
    changes["source"] = (replace_by_source(store.read("source", SOURCE, buckets), fresh.select("path", "content_hash"), "path"), "path")
    store.commit(changes, buckets)


def forget_sources(store: TableStore, paths: DataFrame) -> None:
    """Takes files that are gone (path) and all that came of them out of the store."""
    gone = cut(paths.select("path").distinct())
    buckets, changes = _buckets(gone), {}
    for name in (*TABLES, "source"):
        source, schema = ("path", SOURCE) if name == "source" else (source_column(name), stored_schema(name))
        if not store.holds(name, buckets):
            continue
        changes[name] = (store.read(name, schema, buckets).join(gone.select(F.col("path").alias(source)), source, "left_anti"), source)
    if changes:
        store.commit(changes, buckets)


def watch(spark: SparkSession, folder: str, store: TableStore, checkpoint: str, pattern: str = "*", once: bool = True) -> StreamingQuery:
    """A stream over a folder's files into the store: all that are there and then stop, or for ever."""
    stream = (
        spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
        .select(F.regexp_replace("path", "^file:/+", "/").alias("path"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("content_hash"))
    )
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: merge_batch(store, df, n))
    return (writer.trigger(availableNow=True) if once else writer).start()


def activity(events: DataFrame, watermark: str = "1 hour", window: str = "1 day") -> DataFrame:
    """Accesses per user and window of a stream or table of events (user_id, ts): late rows beyond the
    watermark drop out of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", watermark)
    return timed.groupBy("user_id", F.window("ts", window)).agg(F.count(F.lit(1)).alias("accesses"), F.max("ts").alias("last_at")).select("user_id", F.col("window.start").alias("day"), "accesses", "last_at")
