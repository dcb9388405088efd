"""Sharding by size-tiered compaction under versioned manifests.

A store is a folder with immutable Parquet shards and one manifest for each
version. Arrivals are appended as small shards. Shards whose sizes lie within a
factor of each other form a tier; a tier with enough shards is merged into files of
about the target size without a shuffle. Each change is committed by renaming a new manifest into place, which
fails if that version exists: readers see the old shards or the new, never both.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import running, shared_dir, without

TARGET = 128 << 20
#: Shards of a tier differ in size by less than this factor; a tier of so many shards is merged.
FANOUT = 4
#: Rows of an arrival's shards at most.
ARRIVAL_ROWS = 4000
_MANIFEST = "shard string, path string, rows long, bytes long, since int"


class Conflict(RuntimeError):
    """Another writer has committed the version."""


def _path(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def versions(spark: SparkSession, root: str) -> list[int]:
    """The committed versions, oldest first."""
    fs, folder = _path(spark, f"{root}/manifest")
    if not fs.exists(folder):
        return []
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(folder) if s.getPath().getName().startswith("v"))


def manifest(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The shards of a version (the last): shard, path, rows, bytes, since. A row without a shard holds the rows' schema. A store without versions has no rows."""
    known = versions(spark, root)
    if not known:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest/v{known[-1] if version is None else version:08d}")


def _commit(spark: SparkSession, root: str, shards: DataFrame, version: int) -> int:
    staged = f"{root}/staged/{uuid.uuid4().hex}"
    shards.coalesce(1).write.parquet(staged)
    fs, source = _path(spark, staged)
    _, target = _path(spark, f"{root}/manifest/v{version:08d}")
    fs.mkdirs(target.getParent())
    rename = spark._jvm.org.apache.hadoop.fs.Options.Rename
    flags = spark.sparkContext._gateway.new_array(rename, 1)
    flags[0] = rename.NONE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(source, target, flags)
    except Exception as e:
        if version in versions(spark, root):
            raise Conflict(f"version {version} has been committed already") from e
        raise
    return version


def _written(spark: SparkSession, folder: str, schema: T.StructType, version: int) -> DataFrame:
    """Manifest rows of the files of a folder."""
    rows = spark.read.schema(schema).parquet(folder)
    files = rows.groupBy(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).agg(F.count("*").alias("rows"))
    numbered = running(files, [F.col("path")], n=F.lit(1))
    return numbered.select(F.format_string(f"{version:08d}-%06d", "n").alias("shard"), "path", F.col("rows").cast("long").alias("rows"), F.col("bytes").cast("long").alias("bytes"), F.lit(version).cast("int").alias("since"))


def append(spark: SparkSession, root: str, docs: DataFrame, rows: int = ARRIVAL_ROWS) -> int:
    """Writes ``docs`` as new shards and commits them; returns the version.

    Any columns, nulls, empty tables and repeated rows are kept as they are. Later
    arrivals must have the first one's schema (ValueError).
    """
    last = manifest(spark, root)
    version = (versions(spark, root) or [0])[-1] + 1
    schema = T.StructType([T.StructField(f.name, f.dataType, True) for f in docs.schema])
    header = last.where("shard is null").first()
    if header and T.StructType.fromJson(json.loads(header["path"])) != schema:
        raise ValueError("the arrival's columns aren't the store's")
    folder = f"{root}/data/{uuid.uuid4().hex}"
    docs.write.option("maxRecordsPerFile", rows).parquet(folder)
    held = last if header else spark.createDataFrame([(None, schema.json(), 0, 0, version)], _MANIFEST)
    return _commit(spark, root, held.unionByName(_written(spark, folder, schema, version)), version)




def compact(spark: SparkSession, root: str, target: int = TARGET, fanout: int = FANOUT) -> int:
    """Merges full tiers until none is left; returns the last version.

    Tier 0 has the shards of at least 1/fanout of ``target``, which stay as they
    are; each further tier's are smaller by the factor ``fanout``. A merge leaves
    fewer shards than it takes, so this ends.
    """
    while True:
        known = versions(spark, root)
        if not known:
            return 0
        shards = manifest(spark, root)
        schema = T.StructType.fromJson(json.loads(shards.where("shard is null").first()["path"]))
        tier = F.greatest(F.lit(0), F.ceil(F.log(float(fanout), F.lit(float(target)) / F.greatest("bytes", F.lit(1)))) - 1)
        tiered = shards.where("shard is not null").withColumn("tier", tier)
        full = [r["tier"] for r in tiered.where("tier > 0").groupBy("tier").count().where(F.col("count") >= fanout).collect()]
        if not full:
            return known[-1]
        merged = tiered.where(F.col("tier").isin(full))
        # The manifest's paths are what a reader of these shards is given.
        paths = [r["path"] for r in merged.select("path").toLocalIterator()]
        folder, version = f"{root}/data/{uuid.uuid4().hex}", known[-1] + 1
        size = merged.agg(F.sum("bytes")).first()[0]
        # Whole partitions of the scan are put together, without a shuffle.
        with _scanned_by(spark, target):
            spark.read.schema(schema).parquet(*paths).coalesce(-(-size // target)).write.parquet(folder)
        rest = tiered.where(~F.col("tier").isin(full)).drop("tier").unionByName(shards.where("shard is null"))
        _commit(spark, root, rest.unionByName(_written(spark, folder, schema, version)), version)


@contextmanager
def _scanned_by(spark: SparkSession, size: int) -> Iterator[None]:
    """While it lasts, scans are cut so that no partition is larger than ``size``, nor made larger for the files' number."""
    held = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "0"}
    before = {k: spark.conf.get(k) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def vacuum(spark: SparkSession, root: str) -> int:
    """Deletes the shards that the last version doesn't have, and the versions before it; returns their number."""
    known, gone = versions(spark, root), 0
    if len(known) < 2:
        return 0
    last = manifest(spark, root).where("shard is not null").select("path")
    for version in known[:-1]:
        for r in manifest(spark, root, version).where("shard is not null").join(last, "path", "left_anti").toLocalIterator():
            fs, path = _path(spark, r["path"])
            gone += bool(fs.delete(path, False))
        fs, path = _path(spark, f"{root}/manifest/v{version:08d}")
        fs.delete(path, True)
    return gone


def snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The rows of a version (the last), with ``shard``, ``shard_rows``, ``shard_bytes`` and ``since`` in place of columns of these names. A store without versions is a ValueError."""
    shards = manifest(spark, root, version)
    header = shards.where("shard is null").first()
    if header is None:
        raise ValueError(f"no version in {root}")
    schema = T.StructType.fromJson(json.loads(header["path"]))
    paths = [r["path"] for r in shards.where("shard is not null").select("path").toLocalIterator()]
    rows = spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
    named = shards.where("shard is not null").select(F.col("path").alias("_path"), "shard", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"), "since")
    at = F.col("_metadata.file_path") if paths else F.lit(None).cast("string")
    return without(rows.withColumn("_path", at), "shard", "shard_rows", "shard_bytes", "since").join(named, "_path").drop("_path")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in two arrivals, compacted after each: where each came to lie."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    late = F.coalesce(F.xxhash64("doc_id") % 4 == 0, F.lit(False))
    for arrival in (docs.where(~late), docs.where(late)):
        append(spark, root, arrival)
        version = compact(spark, root)
        vacuum(spark, root)
    found = snapshot(spark, root)
    return found.select("doc_id", F.sha2("text", 256).alias("text_sha256"), "shard", "shard_rows", "shard_bytes", "since", F.lit(version).alias("version"))
