"""SimHash near-duplicates: fingerprints, pigeonhole blocks, Hamming check, groups.

Nulls and texts without words have fingerprint zero and link like any other.
Rows with a null id belong to their group but never name it; a group of such rows
alone has a null component. Repeated rows give repeated result rows. Only
``doc_id`` and ``text`` are read, so further columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.base import connected_components
from narrata.shared import cut

BITS = 64
SLICE = 1 << 14  # shingles whose bits are counted at once


def fingerprint_of(text: bytes | None, shingle: int) -> int:
    """Signed 64-bit SimHash of one text's word shingles, repeats counted."""
    words = (text or b"").lower().split()  # both are ASCII only for bytes: A-Z, and 0x20 and 0x09-0x0D
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    hashes = [digest(line[s:e], 42) for s, e in zip(starts[: len(words) - k + 1].tolist(), ends[k - 1 :].tolist())]
    h = np.array(hashes, dtype="<u8")
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(h), SLICE):
        octets = h[at : at + SLICE].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<i8")[0])


def fingerprint(text: Column, shingle: int = 3) -> Column:
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint_of(t, shingle) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())

    hints = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    of.__annotations__ = hints
    return F.arrow_udf(of, "bigint")(text)


def close_links(prints: DataFrame, distance: int = 2, blocks: int = 4, block_rows: int = 256) -> DataFrame:
    """(a, b) that join every two values of ``prints.f`` at ``distance`` or fewer bits, directly or over values between them.

    The fingerprint is split into ``blocks`` blocks. Two values at ``distance``
    bits agree in at least ``blocks - distance`` of them, so each choice of that
    many blocks is one key to join on, and the Hamming distance is then checked.
    Keys shared by more than ``block_rows`` values are not joined in pairs: each of their values meets the others at the values
    ``distance / 2`` flips away from it (at most one flip, so ``distance`` is at most 2).
    Two values meet there exactly if they are that close, and no meeting point
    has more than 65 visitors, so the work stays in proportion to the values.
    """
    if not 0 <= distance <= 2 or distance >= blocks:
        raise ValueError("distance must be 0, 1 or 2 and below the number of blocks")
    width = [BITS * (i + 1) // blocks - BITS * i // blocks for i in range(blocks)]
    at = [BITS * i // blocks for i in range(blocks)]
    masks = [sum(((1 << width[i]) - 1) << at[i] for i in kept) for kept in combinations(range(blocks), blocks - distance)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*[F.struct(F.lit(t).alias("t"), F.col("f").bitwiseAND(F.lit(m).cast("bigint")).alias("k")) for t, m in enumerate(signed)])
    keyed = prints.select("f", F.explode(keys).alias("e")).select("e.t", "e.k", "f")
    sizes = keyed.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1")
    live = cut(keyed.join(sizes, ["t", "k"]), "blocks")
    few = live.where(F.col("n") <= block_rows)
    left, right = few.select("t", "k", F.col("f").alias("a")), few.select("t", "k", F.col("f").alias("b"))
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance
    pairs = left.join(right, ["t", "k"]).where((F.col("a") < F.col("b")) & near).select("a", "b")
    flips = [0, *([(1 << i) - (1 << 64) * (i == 63) for i in range(BITS)] if distance else [])]
    crowd = live.where(F.col("n") > block_rows).select("f").distinct()
    meet = crowd.select("f", F.explode(F.transform(F.array(*[F.lit(x).cast("bigint") for x in flips]), lambda x: x.bitwiseXOR(F.col("f")))).alias("m"))
    if distance == 1:  # a value and its visitor from one flip away, not two visitors
        found = meet.join(crowd.select(F.col("f").alias("m")), "m").where("f != m").select(F.col("f").alias("a"), F.col("m").alias("b"))
    else:
        first = meet.groupBy("m").agg(F.min("f").alias("b"), F.count("*").alias("n")).where("n > 1").select("m", "b")
        found = meet.join(first, "m").where("f != b").select(F.col("f").alias("a"), "b")
    return pairs.unionByName(found)


def near_duplicates(docs: DataFrame, shingle: int = 3, distance: int = 2, blocks: int = 4, block_rows: int = 256) -> DataFrame:
    """(doc_id, f, root, component_id) per document: its fingerprint, the name of its group and the least id in it, that is,
    reachable by links of at most ``distance`` bits.

    Equal fingerprints are one node of the graph, so copies cost one row.
    """
    own = cut(docs.select("doc_id", fingerprint(F.col("text"), shingle).alias("f")), "fingerprints")
    nodes = cut(own.groupBy("f").agg(F.min("doc_id").alias("least")), "nodes")
    roots = connected_components(close_links(nodes.select("f"), distance, blocks, block_rows))
    named = nodes.join(roots.withColumnRenamed("v", "f"), "f", "left").withColumn("root", F.coalesce("root", "f"))
    groups = named.groupBy("root").agg(F.min("least").alias("component_id"))
    names = named.join(groups, "root").select("f", "root", "component_id")
    return own.join(names, "f").select("doc_id", "f", "root", "component_id")


def keep_one(docs: DataFrame, shingle: int, distance: int) -> DataFrame:
    """``docs`` without the documents whose group has a smaller id; rows without an id stay.

    An id may be repeated: each of its rows is judged by its own text, and of those in one group the row with the least
    text (then the least other columns) stays.
    """
    groups = cut(near_duplicates(docs, shingle, distance), "groups")
    gone = groups.where("doc_id != component_id").select("doc_id").distinct()
    again = groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("copies")).where("copies > 1").select("doc_id")
    again = cut(again, "repeated")
    if again.isEmpty():
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = docs.join(gone.unionByName(again), "doc_id", "left_anti").select(*docs.columns)
    rows = docs.join(again, "doc_id", "left_semi").select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    rows = rows.select("row", F.col("row.doc_id").alias("doc_id"), fingerprint(F.col("row.text"), shingle).alias("f"))
    known = groups.join(again, "doc_id", "left_semi").where("doc_id = component_id").select("doc_id", "f", "root").distinct()
    best = rows.join(known, ["doc_id", "f"]).groupBy("doc_id", "root").agg(F.min(F.struct("row.text", "row")).alias("least"))
    return once.unionByName(best.select("least.row.*"))
