"""Text to vectors, and vectors to fewer dimensions."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata import schemas
from narrata.functions import text as tx
from narrata.functions.stopwords import ENGLISH_STOP_WORDS
from narrata.shared import cut
from narrata.sinks.keyed import read_if_exists
from narrata.sources.landed import without_vector

# Builds an encoder inside a task: a function from texts to a matrix of row vectors.
EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def term_counts(texts: DataFrame, size: int) -> DataFrame:
    """(post_id, bucket, tf): how often each text has terms of each bucket; stop words are no terms.

    A term's bucket is the first 28 bits of its md5, modulo ``size``.
    """
    terms = F.filter(tx.tokens(F.col("comment_text")), lambda t: ~t.isin(list(ENGLISH_STOP_WORDS)))
    words = texts.select("post_id", F.explode(terms).alias("term"))
    bucket = F.pmod(F.conv(F.substring(F.md5(F.col("term").cast("binary")), 1, 7), 16, 10).cast("bigint"), F.lit(size)).cast("int")
    return words.groupBy("post_id", bucket.alias("bucket")).agg(F.count("*").alias("tf"))


def document_frequencies(counts: DataFrame) -> DataFrame:
    """(bucket, df) of ``term_counts``, and the number of texts under bucket -1. Tables of several batches add up."""
    one = counts.groupBy("bucket").agg(F.count("*").alias("df"))
    return one.unionByName(counts.agg(F.lit(-1).alias("bucket"), F.countDistinct("post_id").alias("df")))


def weights(counts: DataFrame, frequencies: DataFrame) -> DataFrame:
    """(post_id, terms): unit TF-IDF weights of each text as (bucket, weight) by bucket; IDF is ln((texts + 1) / (df + 1)).

    ``frequencies`` has one row per bucket, so it is small whatever the corpus.
    """
    known = frequencies.groupBy("bucket").agg(F.sum("df").alias("df"))
    total = known.where("bucket = -1").agg(F.coalesce(F.max("df"), F.lit(0))).first()[0]
    idf = known.where("bucket >= 0").select("bucket", F.log(F.lit(total + 1) / (F.col("df") + 1)).alias("idf"))
    # A bucket that no counted text has is as rare as can be.
    rows = counts.join(F.broadcast(idf), "bucket", "left")
    weight = F.col("tf") * F.coalesce("idf", F.log(F.lit(float(total + 1))))
    terms = rows.groupBy("post_id").agg(F.array_sort(F.collect_list(F.struct("bucket", weight.alias("weight")))).alias("terms"))
    norm = F.sqrt(F.aggregate("terms", F.lit(0.0), lambda acc, t: acc + t["weight"] * t["weight"]))
    unit = _once(norm, lambda n: F.transform("terms", lambda t: F.struct(t["bucket"].alias("bucket"), F.when(n > 0, t["weight"] / n).otherwise(0.0).alias("weight"))))
    return terms.select("post_id", unit.alias("terms"))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once per row: as a column it would be put into every step of inner functions."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _dense(weighted: DataFrame, size: int) -> DataFrame:
    every = F.sequence(F.lit(0), F.lit(size - 1))
    filled = _once(F.map_from_entries("terms"), lambda by: F.transform(every, lambda i: F.coalesce(F.element_at(by, i), F.lit(0.0)).cast("float")))
    return weighted.select("post_id", filled.alias("embedding"))


_COUNTED, _VERSIONS = "batch string, bucket int, df bigint", "version int, batches array<string>"


def _version(spark: SparkSession, model: str) -> tuple[int, list[str]]:
    """The newest version of the model at ``model`` and the batches of texts it counts."""
    known = read_if_exists(spark, f"{model}/versions", _VERSIONS)
    row = known.orderBy(F.desc("version")).first() if known is not None else None
    return (row.version, row.batches) if row else (0, [])


def _hashed(texts: DataFrame, missing: DataFrame, size: int, model: str, fresh: bool, refresh: bool) -> tuple[DataFrame, int]:
    """Unit TF-IDF vectors of ``missing`` (with ``refresh``: of all texts), and the version of the model they are made with.

    Every batch of new texts adds its document frequencies to the model, but they count from the next version on, so
    vectors of one version are comparable. ``fresh`` starts a version from these texts alone, ``refresh`` one from all
    batches so far: the model that one batch of all texts would have given.
    """
    spark = texts.sparkSession
    counts = cut(term_counts(missing, size), "terms")
    batch = uuid.uuid4().hex
    counted = document_frequencies(counts).select(F.lit(batch).alias("batch"), "bucket", F.col("df").cast("bigint").alias("df"))
    counted.write.mode("append").parquet(f"{model}/counts")
    version, batches = (0, []) if fresh else _version(spark, model)
    if refresh:
        batches = [r.batch for r in spark.read.schema(_COUNTED).parquet(f"{model}/counts").select("batch").distinct().collect()] if not fresh else [batch]
        counts = cut(term_counts(texts, size), "terms")
    if fresh or refresh or not version:
        version = _version(spark, model)[0] + 1
        batches = batches if refresh else [batch]
        spark.createDataFrame([(version, batches)], _VERSIONS).write.mode("append").parquet(f"{model}/versions")
    frequencies = spark.read.schema(_COUNTED).parquet(f"{model}/counts").where(F.col("batch").isin(batches))
    return _dense(weights(counts, frequencies), size), version


def _encoded(texts: DataFrame, factory: EncoderFactory) -> DataFrame:
    """Vectors from a caller's encoder, built once per task and fed Arrow batches."""

    def encode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = factory()
        for batch in batches:
            matrix = np.asarray(encoder(batch["comment_text"].tolist()), dtype=np.float32)
            yield pd.DataFrame({"post_id": batch["post_id"], "embedding": list(matrix)})

    return texts.mapInPandas(encode, schemas.VECTORS)


def embed_posts(
    posts: DataFrame, path: str, size: int = 768, encoder: EncoderFactory | None = None, overwrite: bool = False, refresh: bool = False
) -> DataFrame:
    """Vectors of all posts with text, stored under ``path`` and keyed by post.

    Only posts without a stored vector are embedded unless ``overwrite`` is set.
    A post without comment text gets no vector. Without an ``encoder`` vectors are
    hashed TF-IDF; each names the ``version`` of the document frequencies it was
    made with. ``refresh`` makes a version of all texts counted so far and embeds
    all given posts with it.
    """
    spark = posts.sparkSession
    table, model = f"{path}/vectors", f"{path}/model"
    texts = posts.where(F.col("comment_text") != "").select("post_id", "comment_text")
    stored = None if overwrite else read_if_exists(spark, table, schemas.VECTORS)
    missing = texts if stored is None else without_vector(texts, stored)
    if encoder:
        made, version = _encoded(missing, encoder), None
    else:
        # a table without rows has no model yet
        fresh = stored is None or stored.isEmpty()
        made, version = _hashed(texts, missing, size, model, fresh, refresh and not fresh)
    made = made.withColumn("version", F.lit(version).cast("int"))
    replaced = stored is None or (refresh and not encoder)
    if replaced and stored is not None:
        made = cut(made, "vectors")  # it replaces the table that told which posts are missing
    made.write.mode("overwrite" if replaced else "append").parquet(table)
    return spark.read.schema(schemas.VECTORS).parquet(table)


def _as_vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select("post_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("_raw"))


def standardise(vectors: DataFrame) -> DataFrame:
    """Columns with mean 0 and standard deviation 1 (0 for a constant column)."""
    dense = _as_vectors(vectors)
    scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True)
    return scaler.fit(dense).transform(dense).select("post_id", "_scaled")


def reduce_vectors(vectors: DataFrame, components: int = 50) -> DataFrame:
    """(post_id, vec): standardised vectors projected on the leading principal components.

    Fitting aggregates moments and one d x d matrix; only those reach the driver.
    """
    shape = vectors.agg(F.count("*").alias("n"), F.min(F.size("embedding")).alias("d"), F.max(F.size("embedding")).alias("d2")).first()
    if shape.n == 0:
        return vectors.select("post_id", F.col("embedding").cast("array<double>").alias("vec"))
    if shape.d != shape.d2:
        raise ValueError(f"vectors differ in length: {shape.d} to {shape.d2}")
    scaled = standardise(vectors)
    pca = PCA(k=min(components, shape.n, shape.d), inputCol="_scaled", outputCol="_reduced")
    return pca.fit(scaled).transform(scaled).select("post_id", vector_to_array("_reduced").alias("vec"))
