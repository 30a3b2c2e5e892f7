"""A keyed store that grows: rows in buckets by their key, of which a change rewrites only those it touches.

A manifest lists each bucket's folder and has the rows' schema; columns that older rows lack are null there. A change writes the touched buckets into new folders and then the next manifest, numbered one higher; it counts once
Spark's ``_SUCCESS`` stands in it. So a reader sees the store before a change or after it, never half of it, and a writer that is beaten to a number fails
and can try again. Folders that no kept manifest lists are deleted by ``vacuum``.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: A bucket is read and rewritten as a whole; this many keep a store of 100 GB in pieces of 400 MB.
BUCKETS = 256
_MANIFEST = "bucket int, folder string, key string, buckets int, shape string"


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm.org.apache.hadoop.fs
    return jvm.Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), jvm.Path


def _manifests(spark: SparkSession, path: str) -> list[int]:
    files, at = _files(spark, path)
    return sorted(int(f.getPath().getParent().getName()) for f in files.globStatus(at(f"{path}/manifests/*/_SUCCESS")) or [])


def _manifest(spark: SparkSession, path: str, number: int | None = None) -> list:
    """The newest manifest's rows, of which there is one for each bucket; none without a store."""
    numbers = _manifests(spark, path)
    return spark.read.schema(_MANIFEST).json(f"{path}/manifests/{numbers[-1] if number is None else number}").collect() if numbers else []


def exists(spark: SparkSession, path: str) -> bool:
    return bool(_manifests(spark, path))


def _bucket(key: str, buckets: int):
    return F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(buckets)).cast("int")


def read(spark: SparkSession, path: str, buckets: list[int] | None = None, number: int | None = None) -> DataFrame:
    """The store's rows, of all buckets or of some, as of the newest or of an earlier manifest."""
    rows = _manifest(spark, path, number)
    if not rows:
        raise FileNotFoundError(f"no store at {path}")
    wanted = [r["folder"] for r in rows if buckets is None or r["bucket"] in set(buckets)]
    shape = StructType.fromJson(json.loads(rows[0]["shape"]))
    return spark.read.schema(shape).parquet(*wanted) if wanted else spark.createDataFrame([], shape)


def newest(stored: DataFrame, incoming: DataFrame, key: str, stamp: str) -> DataFrame:
    """The newest row of each key of both; of equal stamps the incoming one."""
    both = stored.withColumn("_in", F.lit(0)).unionByName(incoming.withColumn("_in", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("_in", key)]
    latest = both.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.coalesce(F.col(stamp), F.lit("2000-01-01").cast("timestamp")), "_in")).alias("row"))
    return latest.select(key, "row.*")


def merge(spark: SparkSession, incoming: DataFrame, path: str, key: str, stamp: str, buckets: int = BUCKETS) -> list[int]:
    """Put rows into the store, which is made if there is none: a key's newest row stays. Returns the buckets rewritten, at most their number.

    ``incoming`` is read twice, for its buckets and for its rows; a null key has a bucket as others do.
    """
    numbers, old = _manifests(spark, path), _manifest(spark, path)
    if old and old[0]["key"] != key:
        raise ValueError(f"the store is keyed by {old[0]['key']}")
    n = old[0]["buckets"] if old else buckets
    placed = incoming.withColumn("_bucket", _bucket(key, n))
    touched = sorted(r[0] for r in placed.select("_bucket").distinct().collect())
    if not touched:
        return []
    there = [b for b in touched if b in {r["bucket"] for r in old}]
    stored = read(spark, path, there) if there else incoming.limit(0)
    version = f"{path}/rows/{uuid.uuid4().hex}"
    merged = newest(stored, incoming, key, stamp).withColumn("_bucket", _bucket(key, n))
    # one file for each bucket; a key has one row, so hashing keeps them even
    merged.repartition("_bucket").write.partitionBy("_bucket").parquet(version)
    shape = merged.drop("_bucket").schema.json()
    rows = [(r["bucket"], r["folder"], key, n, shape) for r in old if r["bucket"] not in set(touched)] + [(b, f"{version}/_bucket={b}", key, n, shape) for b in touched]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.mode("error").json(f"{path}/manifests/{numbers[-1] + 1 if numbers else 1}")
    return touched


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Forget all but the newest ``keep`` manifests and delete the folders that only those listed; how many folders went."""
    numbers = _manifests(spark, path)
    listed = {r["folder"] for n in numbers[-keep:] for r in _manifest(spark, path, n)}
    files, at = _files(spark, path)
    for n in numbers[:-keep]:
        files.delete(at(f"{path}/manifests/{n}"), True)
    gone = [f.getPath() for f in files.globStatus(at(f"{path}/rows/*/_bucket=*")) or [] if not any(f.getPath().toString().endswith(x.split("/rows/")[1]) for x in listed)]
    for folder in gone:
        files.delete(folder, True)
    return len(gone)
