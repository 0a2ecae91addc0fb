"""Substring deduplication: words of long passages that an earlier document also has.

A window is ``WINDOW`` consecutive words. Only documents that share a window need
to meet, and they are brought together by content: every window is filed under the
least hash of its 16-word grams, a value that depends on the window alone.
Consecutive windows under one value form a passage. Passages are first
grouped by content, so copies cost one row. Where one value files different
passages, those go to a shard, which builds an FM-index over them and streams
them through it: backward search gives for every window end how far back the
words also stand in a document with a smaller id.

Defined results: null texts have no words. A null id counts as larger than all
others. Rows that repeat an id are one document to each other (none removes the
other's words), and each gives a result row. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from narrata.llm.fmindex import FMIndex
from narrata.shared import cut

WINDOW = 50
GRAM = 16
LONGEST = 256  # windows of a passage
SLICE_WORDS = 1 << 20  # words hashed at once
SHARD_PASSAGES = 1024
KEY_PASSAGES = 512  # different passages one value may file in a shard; beyond, windows are compared by hash

_A, _B, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 0x5851F42D4C957F2D
NO_ID = (1 << 63) - 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _A + (b ^ (b >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, np.uint64)
    p[:1] = 1
    return np.multiply.accumulate(p)


def span_hashes(h: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Polynomial hash (mod 2**64) of each span of words, whatever its place."""
    total = int((start + length).max()) if len(start) else 0
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h[:total] * _powers(_BASE, total))))
    raw = (sums[start + length] - sums[start]) * _powers(pow(_BASE, -1, 1 << 64), total + 1)[start]
    return raw ^ (raw >> np.uint64(31)) ^ (length.astype(np.uint64) * _A)


def filed_windows(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, value) of each window inside one document; ``doc`` numbers the words' documents in order."""
    n = len(h)
    if n < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    gram, width = h, 1
    while width < GRAM:
        gram = _mix(gram[:-width], gram[width:])
        width *= 2
    span, least, width = WINDOW - GRAM + 1, gram, 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    rest = span - width
    least = np.minimum(least[: len(least) - rest], least[rest:]) if rest else least
    start = np.flatnonzero(doc[: n - WINDOW + 1] == doc[WINDOW - 1 :])
    return start, least[start]


def passages(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """(start, windows, value, content) of each run of windows filed under one value."""
    start, value = filed_windows(h, doc)
    if not len(start):
        return start, start, value, value
    fresh = np.concatenate(([True], (value[1:] != value[:-1]) | (doc[start[1:]] != doc[start[:-1]])))
    first = np.flatnonzero(fresh)
    since = np.arange(len(start)) - first[np.cumsum(fresh) - 1]
    first = np.flatnonzero(fresh | (since % LONGEST == 0))
    windows = np.diff(np.append(first, len(start)))
    return start[first], windows, value[first], span_hashes(h, start[first], windows + WINDOW - 1)


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The rows' words, about SLICE_WORDS at once, with the first row's number."""
    texts = batch.column("text").cast(pa.binary())
    at, words, n = 0, [], 0
    for i in range(len(texts)):
        own = (texts[i].as_py() or b"").split()  # bytes split at 0x20 and 0x09-0x0D
        words.append(own)
        n += len(own)
        if n >= SLICE_WORDS:
            yield at, words
            at, words, n = i + 1, [], 0
    if words:
        yield at, words


def _file(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at, words in _slices(batch):
            sizes = np.array([len(w) for w in words])
            h = word_hashes([x for w in words for x in w])
            doc = np.repeat(np.arange(len(words)), sizes)
            start, windows, value, content = passages(h, doc)
            row = doc[start]
            local = start - (np.cumsum(sizes) - sizes)[row]
            took = pa.array(at + row)
            yield pa.RecordBatch.from_arrays(
                [batch.column("d").take(took), batch.column("x").take(took), pa.array(value.view(np.int64)), pa.array(content.view(np.int64)), pa.array(local, pa.int32()), pa.array(windows, pa.int32())],
                names=["d", "x", "value", "content", "start", "windows"],
            )


def _words_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The hashed words of the passages listed with each text."""
    for batch in batches:
        rows = []
        for d, text, spans in zip(*(batch.column(c).to_pylist() for c in ("d", "text", "spans"))):
            h = word_hashes(text.encode().split())
            for s in spans:
                rows.append((d, s["value"], s["content"], s["start"], s["windows"], h[s["start"] : s["start"] + s["windows"] + WINDOW - 1].tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        columns = zip(*rows) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["d", "value", "content", "start", "windows", "words"])


def _search_shard(shard: pd.DataFrame) -> pd.DataFrame:
    """(value, content, first, last): window numbers of each passage that stand in a smaller document's passage of the shard."""
    shard = shard.sort_values(["value", "content"]).reset_index(drop=True)
    words = np.frombuffer(b"".join(shard["words"]), np.uint64)
    windows = shard["windows"].to_numpy(np.int64)
    lengths = windows + WINDOW - 1
    index = FMIndex(words, lengths, shard["d"].to_numpy(np.int64))
    passage = np.repeat(np.arange(len(shard)), windows)
    number = np.arange(len(passage)) - np.repeat(np.cumsum(windows) - windows, windows)
    ends = index.starts[passage] + number + WINDOW
    hit = index.matching(ends, shard["d"].to_numpy(np.int64)[passage], WINDOW) >= WINDOW
    passage, number = passage[hit], number[hit]
    fresh = np.ones(len(passage), bool)
    fresh[1:] = (passage[1:] != passage[:-1]) | (number[1:] != number[:-1] + 1)
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(passage))[: len(first)] - 1
    own = shard.iloc[passage[first]]
    return pd.DataFrame({"value": own["value"].to_numpy(), "content": own["content"].to_numpy(), "first": number[first], "last": number[last]})


def _window_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for d, value, content, windows, words in zip(*(batch.column(c).to_pylist() for c in ("d", "value", "content", "windows", "words"))):
            at = np.arange(windows)
            hashes = span_hashes(np.frombuffer(words, np.uint64), at, np.full(windows, WINDOW))
            same = [pa.array(np.full(windows, v), pa.int64()) for v in (d, value, content)]
            yield pa.RecordBatch.from_arrays([*same, pa.array(hashes.view(np.int64)), pa.array(at, pa.int64())], names=["d", "value", "content", "hash", "first"])


def _with_keys(docs: DataFrame, *more: Column) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(*more, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("d"), F.xxhash64(text).alias("x"), text.alias("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(d, x, spans): word ranges [start, end) of each row that lie in windows an earlier document has; d and x name the row."""
    keyed = _with_keys(docs)
    filed = cut(keyed.select("d", "x", "text").mapInArrow(_file, "d bigint, x bigint, value bigint, content bigint, start int, windows int"), "filed")
    kinds = cut(
        filed.groupBy("value", "content")
        .agg(F.min(F.struct("d", "x", "start", "windows")).alias("least"), F.max("d").alias("last"))
        .select("value", "content", "least.*", "last"),
        "passages",
    )
    # copies of a passage: everything but the first document's
    copied = kinds.where("last > d").select("value", "content", F.col("d").alias("d0"))
    spans = filed.join(copied, ["value", "content"]).where("d > d0").select("d", "x", "start", (F.col("start") + F.col("windows") + WINDOW - 1).alias("end"))
    # different passages under one value
    sizes = kinds.groupBy("value").agg(F.count("*").alias("n")).where("n > 1")
    mixed = cut(kinds.drop("last").join(sizes, "value"), "mixed")
    total = mixed.count()
    listed = mixed.groupBy("d", "x").agg(F.collect_list(F.struct("value", "content", "start", "windows")).alias("spans"))
    texts = keyed.select("d", "x", "text").join(listed, ["d", "x"]).select("d", "text", "spans")
    held = texts.mapInArrow(_words_of, "d bigint, value bigint, content bigint, start int, windows int, words binary")
    held = cut(held.dropDuplicates(["value", "content"]).join(sizes, "value"), "words")
    shards = max(1, -(-total // SHARD_PASSAGES))
    found = (
        held.where(F.col("n") <= KEY_PASSAGES)
        .withColumn("shard", F.pmod(F.xxhash64("value"), F.lit(shards)))
        .groupBy("shard")
        .applyInPandas(_search_shard, "value bigint, content bigint, first bigint, last bigint")
    )
    # values with very many passages: each window's first document, by hash
    single = cut(held.where(F.col("n") > KEY_PASSAGES).drop("n").mapInArrow(_window_rows, "d bigint, value bigint, content bigint, hash bigint, first bigint"), "windows")
    earliest = single.groupBy("value", "hash").agg(F.min("d").alias("d0"), F.count("*").alias("m")).where("m > 1").drop("m")
    found = found.unionByName(single.join(earliest, ["value", "hash"]).where("d0 < d").select("value", "content", "first", F.col("first").alias("last")))
    owner = mixed.select("value", "content", F.col("d").alias("d0"))  # its document may hold the passage more than once
    spans = spans.unionByName(
        found.join(owner, ["value", "content"]).join(filed, ["value", "content"]).where("d = d0").select("d", "x", (F.col("start") + F.col("first")).cast("int").alias("start"), (F.col("start") + F.col("last") + WINDOW).cast("int").alias("end"))
    )
    return spans.groupBy("d", "x").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _removed(n: int, spans: list | None) -> np.ndarray:
    edge = np.zeros(n + 1, np.int64)
    for s in spans or ():
        edge[s["start"]] += 1
        edge[s["end"]] -= 1
    return np.cumsum(edge[:n]) > 0


def strip_column():
    """A column function of text and spans: (n_words, n_removed, kept_sha256, kept_text)."""
    kind = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept_text", pa.string())])

    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, all_spans in batches:
            out = []
            for text, spans in zip(texts.to_pylist(), all_spans.to_pylist()):
                words = (text or "").encode().split()
                gone = _removed(len(words), spans)
                kept = b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if spans else words)
                out.append({"n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(kept).hexdigest(), "kept_text": kept.decode() if spans else text})
            yield pa.array(out, kind)

    of.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    return F.arrow_udf(of, "struct<n_words:bigint,n_removed:bigint,kept_sha256:string,kept_text:string>")


def strip_repeats(docs: DataFrame) -> DataFrame:
    """(row, cut) per row of ``docs``: the row as it was, and (n_words, n_removed, kept_sha256, kept_text).

    ``kept_text`` is the text as it was where nothing goes, else the kept words joined by one space.
    """
    rows = _with_keys(docs, F.struct(*docs.columns).alias("row")).drop("text")
    joined = rows.join(repeated_spans(docs), ["d", "x"], "left")
    return joined.select("row", strip_column()(F.col("row.text"), F.col("spans")).alias("cut"))
