"""URL filter: a rule list, and for the rest logistic regression on hashed character n-grams of host and path.

The host is what follows the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; the path follows it up to ``?``, ``#``
or the end. A rule fits its host and all subdomains if the path starts with the rule's; the longest fitting rule decides.

Defined results: a null URL or one without ``://`` has an empty host and path and no rule. Repeated rows are judged each. Without
labels of both kinds the method gives the more frequent verdict (allow without labels). Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.base import Sent

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest fitting rule of (verdict, host and path), or null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        own, at, rest = rule.partition("/")
        fits = ((host == own) | host.endswith("." + own)) & path.startswith(at + rest)
        out = F.when(fits, rule).otherwise(out)
    return out


def grams(host: str | None, path: str | None) -> list[int]:
    out = {zlib.crc32(b"bias") % BUCKETS}
    for kind, text in (("h", f"^{host or ''}$"), ("p", f"^{path or ''}$")):
        for k in GRAMS:
            out.update(zlib.crc32((kind + text[i : i + k]).encode("utf-8", "replace")) % BUCKETS for i in range(max(1, len(text) - k + 1)))
    return sorted(out)


@dataclass
class Model:
    weights: np.ndarray

    def scores(self, urls: list[tuple[str | None, str | None]]) -> np.ndarray:
        """Probability of block."""
        rows = [grams(h, p) for h, p in urls]
        if not rows:
            return np.zeros(0)
        sizes = np.array([len(r) for r in rows])
        total = np.add.reduceat(self.weights[np.concatenate(rows)], np.cumsum(sizes) - sizes)
        return 1 / (1 + np.exp(-np.clip(total / np.sqrt(sizes), -40, 40)))


def _first_by_hash(known: DataFrame, rows: int) -> list:
    """The first ``rows`` of (host, path, y) by hash. Only about twice as many are sorted and leave their tasks, however many there are."""
    draw, share = F.xxhash64("host", "path"), 2 * rows / max(1, known.count())
    while True:
        some = known if share >= 1 else known.where(draw < int(share * 2.0**64) - 2**63)
        table = some.orderBy(draw, "host", "path", "y").limit(rows).collect()
        if len(table) == rows or share >= 1:
            return table
        share *= 4


def fit(labelled: DataFrame, rows: int = 4000, rounds: int = 80, rate: float = 0.5, decay: float = 1e-4) -> Model:
    """From at most ``rows`` of (host, path, y), y = 1 for block, taken in the order of a hash of host and path; full-batch Adagrad."""
    known = labelled.select("host", "path", F.col("y").cast("double").alias("y")).where("y is not null")
    table = _first_by_hash(known, rows)
    y = np.array([r["y"] for r in table])
    weights = np.zeros(BUCKETS)
    bias = zlib.crc32(b"bias") % BUCKETS
    if not len(y) or y.min() == y.max():
        weights[bias] = 1e3 if len(y) and y[0] > 0.5 else -1e3
        return Model(weights)
    own = [grams(r["host"], r["path"]) for r in table]
    sizes = np.array([len(g) for g in own])
    at, starts, scale = np.concatenate(own), np.cumsum(sizes) - sizes, 1 / np.sqrt(sizes)
    seen = np.full(BUCKETS, 1e-8)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.add.reduceat(weights[at], starts) * scale, -40, 40)))
        g = np.bincount(at, np.repeat((y - p) * scale, sizes), BUCKETS) / len(y) - decay * weights
        seen += g * g
        weights += rate * g / np.sqrt(seen)
    return Model(weights)


def scorer(rows: DataFrame, model: Model):
    """A column function of host and path: the probability of block."""
    send = Sent(rows.sparkSession, model)

    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for hosts, paths in batches:
            yield pa.array(send.value.scores(list(zip(hosts.to_pylist(), paths.to_pylist()))), pa.float64())

    of.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(of, "double")


def parts(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """(page_id, host, path, rule) of each row of (page_id, url)."""
    own = pages.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return own.withColumn("rule", rule_of(F.col("host"), F.col("path"), rules))


def judge(pages: DataFrame, rules: list[tuple[str, str]], labelled: DataFrame | None = None, rows: int = 4000) -> DataFrame:
    """(page_id, host, path, rule, score, verdict) of each row of (page_id, url).

    ``labelled`` is a table of (url, y), y = 1 for block; by default the URLs that a rule decides are it.
    """
    own = parts(pages, rules)
    verdicts = F.create_map(*[F.lit(x) for verdict, rule in rules for x in (rule, verdict)])
    if labelled is None:
        known = own.where(F.col("rule").isNotNull()).select("host", "path", (verdicts[F.col("rule")] == "block").cast("int").alias("y"))
    else:
        known = labelled.select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), "y")
    own = own.withColumn("score", scorer(pages, fit(known, rows))(F.col("host"), F.col("path")))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return own.withColumn("verdict", F.coalesce(verdicts[F.col("rule")], method))
