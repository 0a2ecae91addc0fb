"""Tables written to the folder all executors share."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or one in the warehouse where it is unset.

    A warehouse on the local disk is one folder to all tasks only if they run
    in this process, so elsewhere the setting is required then.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/narrata-scratch"
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        scheme = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).getUri().getScheme()
        if scheme == "file" and not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return path.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/narrata/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """Write ``df`` and read it back.

    The written table replaces the lineage, survives lost executors and gives
    the optimizer real sizes to choose join strategies from.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path, compression=compression)
    out = spark.read.schema(df.schema).parquet(path)
    out._narrata_folder = path
    return out


def drop(df: DataFrame | None) -> None:
    """Remove the table that ``cut`` wrote for ``df``, once nothing reads it any more: a loop moves on, say."""
    path = getattr(df, "_narrata_folder", None)
    if path:
        spark = df.sparkSession
        hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop_path, True)


def own_columns(df: DataFrame) -> DataFrame:
    """The same rows under new column ids, for grouping a table with itself."""
    return df.select(*[F.col(c).alias(c) for c in df.columns])
