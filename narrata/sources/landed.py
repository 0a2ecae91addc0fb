"""Landed raw posts and comments, and the files this package writes."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from narrata import schemas
from narrata.functions import text as tx
from narrata.shared import cut

_REJECT = "_corrupt_record"


def read_landed(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json") -> tuple[DataFrame, DataFrame]:
    """(good rows, rejects) of a landed table.

    A record that cannot be read goes to the rejects with its text and does not
    stop the job. Parquet carries its own types, so it has no rejects.
    """
    if fmt != "json":
        good = spark.read.schema(schema).format(fmt).load(path)
        return good, spark.createDataFrame([], T.StructType([T.StructField(_REJECT, T.StringType())]))
    lines = spark.read.text(path).where(F.trim("value") != "")
    wide = T.StructType([*schema.fields, T.StructField(_REJECT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _REJECT}
    parsed = lines.select(F.from_json("value", wide, options).alias("r"))
    good = parsed.where(F.col(f"r.{_REJECT}").isNull()).select("r.*").drop(_REJECT)
    rejects = parsed.where(F.col(f"r.{_REJECT}").isNotNull()).select(f"r.{_REJECT}")
    return good, rejects


def _typed(df: DataFrame, schema: T.StructType, arrays_from_json: bool) -> DataFrame:
    columns = []
    for field in schema.fields:
        c = F.col(field.name)
        if isinstance(field.dataType, T.TimestampNTZType):
            c = tx.parse_iso(c)
        elif arrays_from_json and isinstance(field.dataType, T.ArrayType):
            c = F.from_json(c, field.dataType)
        columns.append(c.alias(field.name))
    return df.select(*columns)


def _as_stored(schema: T.StructType, arrays_as_text: bool) -> T.StructType:
    def stored(t: T.DataType) -> T.DataType:
        as_text = isinstance(t, T.TimestampNTZType) or (arrays_as_text and isinstance(t, T.ArrayType))
        return T.StringType() if as_text else t

    return T.StructType([T.StructField(f.name, stored(f.dataType)) for f in schema.fields])


# How this package writes CSV.
_CSV = {"quote": '"', "escape": '"', "emptyValue": "", "nullValue": "\0"}
_WHOLE, _HEAD, _BETWEEN, _TAIL = range(4)


def csv_records(spark: SparkSession, path: str, header: str) -> DataFrame:
    """(record): the records of CSV files whose quoted fields may hold line breaks; every file is read in splits.

    A line ends a record if the number of quotes up to its end is even. One row per split, its number of quotes, tells with
    which parity the next split starts. A task then joins the lines of records inside its splits; what a record has in
    other splits is joined afterwards. Each file's first record must be ``header``, and is left out.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    odd = (F.coalesce(F.sum("n").over(before), F.lit(0)) % 2).alias("odd")
    starts = lines.groupBy("file", "block").agg(F.sum(quotes).alias("n")).select("file", "block", odd)
    lines = lines.join(F.broadcast(starts), ["file", "block"])  # keeps the order of lines

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parity, held, inside, first = None, 0, [], False, False
        for batch in batches:
            rows: list[tuple] = []
            for value, file, block, start in zip(*(c.to_pylist() for c in batch.columns)):
                if (file, block) != at:
                    if held:
                        rows.append((*at, _BETWEEN if inside else _TAIL, "\n".join(held)))
                    at, parity, held, inside, first = (file, block), start, [], bool(start), block == 0
                held.append(value)
                parity ^= value.count('"') & 1
                if parity:
                    continue
                record, held = "\n".join(held), []
                if first and record.rstrip("\r") != header:
                    raise ValueError(f"{file} has the header {record!r}, not {header!r}")
                if not first:
                    rows.append((*at, _HEAD if inside else _WHOLE, record))
                inside = first = False
            yield _record_batch(rows)
        if held:
            yield _record_batch([(*at, _BETWEEN if inside else _TAIL, "\n".join(held))])

    parts = lines.select("value", "file", "block", F.col("odd").cast("int")).mapInArrow(join, "file string, block bigint, kind int, record string")
    parts = cut(parts, "csv")
    order = Window.partitionBy("file").orderBy("block", "kind")
    pieces = parts.where(F.col("kind") != _WHOLE).withColumn("nth", F.count_if(F.col("kind") == _TAIL).over(order))
    joined = pieces.groupBy("file", "nth").agg(F.array_sort(F.collect_list(F.struct("block", "kind", "record"))).alias("p"))
    joined = joined.select(F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    return parts.where(F.col("kind") == _WHOLE).select("record").unionByName(joined)


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    types = (pa.string(), pa.int64(), pa.int32(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], names=["file", "block", "kind", "record"])


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a header; quoted fields may span lines. One file is as many tasks as it has splits."""
    # An unquoted empty field is null and a quoted one is ''; the null marker is a
    # character no text holds, so the reader keeps the two apart.
    records = csv_records(spark, path, ",".join(schema.names))
    stored = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in _as_stored(schema, True).fields)
    record = F.regexp_replace("record", "\r$", "")
    raw = records.where(record != "").select(F.from_csv(record, stored, _CSV).alias("r")).select("r.*")
    return _typed(raw, schema, arrays_from_json=True)


def read_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    raw = spark.read.schema(_as_stored(schema, False)).json(path)
    return _typed(raw, schema, arrays_from_json=False)


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.VECTORS).parquet(path)


def without_vector(posts: DataFrame, vectors: DataFrame) -> DataFrame:
    """Posts that have no stored vector yet."""
    return posts.join(vectors.select("post_id"), "post_id", "left_anti")
