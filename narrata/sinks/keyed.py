"""Tables with a key: rows whose key is already stored are ignored.

A table is a folder of batches. A batch's rows lie in one folder per *part* of the key's hash, and a Bloom filter tells for
each part which keys it may hold. An insert asks the filters first and reads only the parts of batches that may hold one of
its keys. ``_versions`` lists the batches of each version; a version is made by renaming a finished file to a name that must
not exist yet, so of two writers that started from the same version one finds the name taken, drops the keys that the
other one has stored meanwhile, and tries the next. Both can write at any time and no key is stored twice.

Rows without a key count as rows with one and the same key: the first one is kept, and saving it again adds nothing.
Batches that no version lists (of a writer that was lost) are not part of the table.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata.operators.ranking import first_per_group
from narrata.shared import own_columns

PARTS = 16  # parts of a new table; as many as make a part of a batch fit a task
BITS_PER_KEY, HASHES = 10, 7  # about one key in a hundred passes by chance
_BATCH, _PART = "key_batch", "key_part"  # columns of the folders; rows cannot have columns of these names


def new_rows(incoming: DataFrame, stored: DataFrame | None, key: str, order: list[Column]) -> DataFrame:
    """Rows of ``incoming`` an insert-or-ignore would add.

    The batch is reduced to one row per key first, so a key repeated many times
    in it is gone before the anti join.
    """
    first = first_per_group(incoming, [key], order, 1)
    return first if stored is None else _without(first, stored.select(key), key)


def _without(rows: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    keys = keys.select(F.col(key).alias("_stored_key"))
    return rows.join(keys, F.col(key).eqNullSafe(F.col("_stored_key")), "left_anti")


def file_system(spark: SparkSession, path: str):
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()), hadoop_path


def _exists(spark: SparkSession, path: str) -> bool:
    fs, hadoop_path = file_system(spark, path)
    return fs.exists(hadoop_path)


def read_if_exists(spark: SparkSession, path: str, schema) -> DataFrame | None:
    return spark.read.schema(schema).parquet(path) if _exists(spark, path) else None


# ------------------------------------------------------------------------------------------------------------- versions


@dataclass(frozen=True)
class Version:
    """The batches of a table at one time."""

    number: int = 0
    parts: int = PARTS
    batches: tuple[str, ...] = ()
    schema: str = ""  # of the rows, as JSON


def current(spark: SparkSession, path: str) -> Version:
    fs, folder = file_system(spark, f"{path}/_versions")
    if not fs.exists(folder):
        return Version()
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    last = max((n for n in names if n.endswith(".json") and not n.startswith(".")), default=None)
    if last is None:
        return Version()
    stream = fs.open(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/{last}"))
    try:
        found = json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()
    return Version(found["number"], found["parts"], tuple(found["batches"]), found["schema"])


def _commit(spark: SparkSession, path: str, version: Version) -> bool:
    """Make ``version`` the current one, unless another writer has made one of its number."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/{version.number:012d}.json")
    draft = jvm.org.apache.hadoop.fs.Path(f"{path}/_versions/.{uuid.uuid4().hex}")
    fs = target.getFileSystem(conf)
    out = fs.create(draft)
    out.write(json.dumps(asdict(version)).encode())
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(target).toUri(), conf)
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(fs.makeQualified(draft), fs.makeQualified(target), options)
    except Exception:
        if not fs.exists(target):
            raise
        fs.delete(draft, False)
        return False
    return True


# -------------------------------------------------------------------------------------------------------------- filters


def _hashes(key: str) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(7), F.col(key)).alias("h2")]


def _places(h1: np.ndarray, h2: np.ndarray, size: int) -> np.ndarray:
    """Bits of each key in a filter of ``size`` bits, one row per hash."""
    steps = np.arange(HASHES, dtype=np.uint64)[:, None]
    return (h1.astype(np.uint64)[None] + steps * (h2.astype(np.uint64) | np.uint64(1))[None]) % np.uint64(size)


def _filter_of(table: pa.Table) -> pa.Table:
    h1, h2 = table.column("h1").to_numpy(), table.column("h2").to_numpy()
    bits = np.zeros(-(-max(64, len(h1) * BITS_PER_KEY) // 8) * 8, np.uint8)
    bits[_places(h1, h2, len(bits)).ravel()] = 1
    return pa.table({_PART: table.column(_PART).slice(0, 1), "bits": pa.array([np.packbits(bits).tobytes()], pa.binary())})


def _may_hold(left: pa.Table, right: pa.Table) -> pa.Table:
    """The batches whose filter of this part passes one of the asked keys."""
    found = []
    if left.num_rows:
        h1, h2 = left.column("h1").to_numpy(), left.column("h2").to_numpy()
        for batch, data in zip(right.column("batch").to_pylist(), right.column("bits").to_pylist()):
            bits = np.unpackbits(np.frombuffer(data, np.uint8))
            if bits[_places(h1, h2, len(bits))].all(axis=0).any():
                found.append(batch)
    parts = right.column(_PART).to_pylist()[:1] * len(found)
    return pa.table({_PART: pa.array(parts, pa.int32()), "batch": pa.array(found, pa.string())})


def _batch(path: str, batch: str) -> str:
    return f"{path}/{_BATCH}={batch}"


def touched(spark: SparkSession, path: str, rows: DataFrame, key: str, batches: tuple[str, ...], parts: int) -> list[tuple[str, int]]:
    """(batch, part) of what may hold a key of ``rows``; at most one entry for each part of a batch."""
    if not batches:
        return []
    asked = rows.select(_part_of(key, parts), *_hashes(key))
    filters = spark.read.schema(f"{_PART} int, bits binary, batch string").option("basePath", f"{path}/_filters")
    filters = filters.parquet(*[f"{path}/_filters/batch={b}" for b in batches])
    found = own_columns(asked).groupBy(_PART).cogroup(own_columns(filters).groupBy(_PART)).applyInArrow(_may_hold, f"{_PART} int, batch string")
    return sorted((r["batch"], r[_PART]) for r in found.collect())


def _part_of(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.lit(parts)).cast("int").alias(_PART)


# -------------------------------------------------------------------------------------------------------- reading, writing


def _parts(spark: SparkSession, path: str, which: list[tuple[str, int]], schema: T.StructType) -> DataFrame | None:
    """Rows of parts of batches; a part without rows has no folder."""
    folders = [f for b, p in which if _exists(spark, f := f"{_batch(path, b)}/{_PART}={p}")]
    return spark.read.schema(schema).parquet(*folders) if folders else None


def read_table(spark: SparkSession, path: str) -> DataFrame | None:
    """The current version of the table, or None if there is none."""
    version = current(spark, path)
    if not version.number:
        return None
    reader = spark.read.schema(T.StructType.fromJson(json.loads(version.schema)))
    return reader.option("basePath", path).parquet(*[_batch(path, b) for b in version.batches]).drop(_BATCH, _PART)


def _write(spark: SparkSession, path: str, rows: DataFrame, key: str, parts: int, gather: bool = True) -> str:
    """Write a batch: one file a part, or, without ``gather``, one a part and task, which spares a shuffle of the rows."""
    batch = uuid.uuid4().hex
    rows = rows.withColumn(_PART, _part_of(key, parts))
    (rows.repartition(parts, _PART) if gather else rows).write.partitionBy(_PART).parquet(_batch(path, batch), compression="zstd")
    written = _parts(spark, path, [(batch, p) for p in range(parts)], rows.schema)
    target = f"{path}/_filters/batch={batch}"
    if written is None:
        spark.createDataFrame([], f"{_PART} int, bits binary").write.parquet(target)
    else:
        keys = written.select(_part_of(key, parts), *_hashes(key))
        keys.groupBy(_PART).applyInArrow(_filter_of, f"{_PART} int, bits binary").write.parquet(target)
    return batch


def _fresh(spark: SparkSession, path: str, rows: DataFrame, key: str, batches: tuple[str, ...], parts: int) -> DataFrame:
    """``rows`` without those whose key one of ``batches`` holds."""
    found = touched(spark, path, rows, key, batches, parts)
    stored = _parts(spark, path, found, rows.schema)
    return rows if stored is None else _without(rows, stored, key)


def insert_or_ignore(incoming: DataFrame, path: str, key: str, order: list[Column], parts: int = PARTS, unique: bool = False) -> Version:
    """Add the rows of ``incoming`` whose key the table at ``path`` lacks; gives the version that has them.

    ``unique`` says that no key (or missing key) comes twice in ``incoming``, so rows need not meet to find the first one,
    and are written where they lie.
    """
    spark = incoming.sparkSession
    base = current(spark, path)
    known = base.parts if base.number else parts
    first = incoming if unique else first_per_group(incoming, [key], order, 1)
    rows = _fresh(spark, path, first, key, base.batches, known)
    return add_batch(spark, path, key, base, _write(spark, path, rows, key, known, not unique), known, incoming.schema)


def add_batch(spark: SparkSession, path: str, key: str, base: Version, batch: str, parts: int, schema: T.StructType) -> Version:
    """Commit a written batch that is new as of ``base``; what other writers have added since is taken out of it first."""
    while True:
        if not base.number or parts == base.parts:
            version = Version(base.number + 1, parts, (*base.batches, batch), base.schema or schema.json())
            if _commit(spark, path, version):
                return version
        newer = current(spark, path)
        rows = _parts(spark, path, [(batch, p) for p in range(parts)], schema)
        if rows is not None:
            added = tuple(b for b in newer.batches if b not in base.batches)
            rows = _fresh(spark, path, rows, key, added, newer.parts)
            batch = _write(spark, path, rows, key, newer.parts)
        base, parts = newer, newer.parts


def save_posts(posts: DataFrame, path: str, unique: bool = False) -> None:
    insert_or_ignore(posts, path, "post_id", [F.asc("seq"), F.asc("created_utc")], unique=unique)


def save_comments(comments: DataFrame, path: str) -> None:
    insert_or_ignore(comments, path, "comment_id", [F.asc("comment_seq"), F.asc("created_utc")])


def orphans(comments: DataFrame, posts: DataFrame) -> DataFrame:
    """Comments whose post is not in ``posts``."""
    return comments.join(posts.select("post_id"), "post_id", "left_anti")
