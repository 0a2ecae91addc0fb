"""Documents as token ids, cut and packed into as few sequences of at most ``size`` tokens as best fit finds.

Every document is its ids and an end id. Longer ones are cut into pieces of ``size`` tokens, the first of which
may be shorter. Pieces are range-sorted by length, and those of one length act together, longest first: a step sweeps
the open gaps upward from the length (the successors are the tightest fits), the pieces take them in the order of their ranks, as many of the same length as a
gap holds, the rest open new sequences, and the gaps are updated. This is best-fit decreasing. Equal gaps are one run with
a count, so a step costs a few numbers whatever the data, and at most ``size`` steps are
needed; finding the ranks and placing the pieces is distributed.

Defined results: a null text is an empty one, which has the end id alone. Repeated rows and rows without an id are
packed each. An empty table gives no rows. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.shared import cut

# fixed values: the split pattern of byte-level vocabulary files
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WHITE = re.compile(r"\s{1024}")
LONGEST_RUN = 1 << 14  # characters between spaces, beyond which the file's own library reads a text
PLAN = "length int, first bigint, last bigint, each bigint, sequence bigint, place int"


def _octets() -> dict[str, int]:
    """The character that byte-level vocabularies write for each byte: itself if it prints, else the next one from 256 on."""
    printed = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in printed]
    return {chr(256 + hidden.index(b) if b in hidden else b): b for b in range(256)}


class Encoder:
    """Ids of whole texts as little-endian bytes.

    They are the ids that the library of the vocabulary file gives. If the file is a plain byte-level one whose merges are
    numbered in their order, tiktoken finds the same ids from its merges in a quarter of the time; other files, and
    texts that hold an added token's string or very long runs without a space or of white space, are read by that library.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path, self.library = path, None
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        self.fast, self.special = self._plain(file), [t["content"] for t in file.get("added_tokens", ())]

    @staticmethod
    def _plain(file: dict):
        model, split = file["model"], file.get("pre_tokenizer") or {}
        byte_level = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        odd = file.get("normalizer") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model.get("type") != "BPE" or not byte_level or odd:
            return None
        special = {t["content"] for t in file.get("added_tokens", ()) if t.get("special")}
        if len(special) < len(file.get("added_tokens", ())):
            return None
        vocabulary, octets = model["vocab"], _octets()
        made = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
        ids = [vocabulary[m] for m in made]
        if len(set(ids)) < len(ids) or ids != sorted(ids) or len(ids) + len(octets) != len(vocabulary.keys() - special) or any(vocabulary.get(c, len(vocabulary)) >= ids[0] for c in octets):
            return None
        import tiktoken

        ranks = {bytes(map(octets.__getitem__, word)): i for word, i in vocabulary.items() if word not in special}
        return tiktoken.Encoding("plain", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def by_library(self, text: str) -> bytes:
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if self.fast is None or any(t in text for t in self.special) or (len(text) > LONGEST_RUN and not self._spaced(text)):
            return self.by_library(text)
        return np.array(self.fast.encode_ordinary(text), "<u4").tobytes()

    @staticmethod
    def _spaced(text: str) -> bool:
        return max(map(len, text.split(" "))) <= LONGEST_RUN and WHITE.search(text) is None


def _encoded(path: str, size: int, end: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = Encoder(path), np.array([end], "<u4").tobytes()
        for batch in batches:
            rows, numbers = [], []
            for row, text in enumerate(batch.column("text")):
                ids = encoder.encode(text.as_py() or "") + last
                start, n = 0, len(ids) // 4
                for piece in range(-(-n // size)):
                    stop = start + ((n - 1) % size + 1 if piece == 0 else size)
                    rows.append(row)
                    numbers.append((piece, start, stop - start, zlib.crc32(memoryview(ids)[4 * start : 4 * stop])))
                    start = stop
            took = pa.array(rows, pa.int64())
            columns = zip(*numbers) if numbers else [()] * 4
            made = [pa.array(list(c), k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.int32(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("rid").take(took), batch.column("doc_id").take(took), *made], names=["rid", "doc_id", "piece", "start", "length", "ids_crc32"])

    return of


def encode_pieces(docs: DataFrame, tokenizer: str, size: int, end: int) -> DataFrame:
    """(rid, doc_id, piece, start, length, ids_crc32) per piece; rid names the row."""
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return own.mapInArrow(_encoded(tokenizer, size, end), "rid bigint, doc_id bigint, piece int, start bigint, length int, ids_crc32 bigint")


def plan_packing(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first, last, each, sequence, place): the pieces of this length with ranks first to last go, ``each`` to a
    sequence, to the sequences from this number on, the first of them at this place."""
    plan: list[tuple[int, int, int, int, int, int]] = []
    runs: dict[int, list[tuple[int, int]]] = {}  # gap -> runs (first sequence, number of sequences)
    gaps: list[int] = []  # the gaps there are, ascending
    opened = 0

    def leave(gap: int, sequence: int, number: int) -> None:
        if gap and number:
            if gap not in runs:
                runs[gap] = []
                insort(gaps, gap)
            runs[gap].append((sequence, number))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(gaps, length)
            if at < len(gaps):
                gap = gaps[at]
                sequence, number = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[at]
            else:
                gap, sequence = size, opened
                number = -(-left // (size // length))
                opened += number
            each = gap // length
            full = min(number, left // each)
            rest = left - full * each if full < number else 0
            if full:
                plan.append((length, rank, rank + full * each - 1, each, sequence, size - gap))
                leave(gap - each * length, sequence, full)
            if rest:  # fewer than one sequence takes
                plan.append((length, rank + full * each, rank + full * each + rest - 1, rest, sequence + full, size - gap))
                leave(gap - rest * length, sequence + full, 1)
            used = full + (1 if rest else 0)
            leave(gap, sequence + used, number - used)
            rank += full * each + rest
            left -= full * each + rest
    return plan


def pack(pieces: DataFrame, size: int) -> DataFrame:
    """``pieces`` (rid, piece, length of 1 to ``size``, ...) with their sequence and the place in it."""
    spark = pieces.sparkSession
    ordered = pieces.repartitionByRange("length", "rid", "piece").sortWithinPartitions("length", "rid", "piece")
    ordered = cut(ordered.withColumn("at", F.monotonically_increasing_id()), "sorted-pieces")
    ordered = ordered.withColumn("part", F.shiftright("at", 33))
    # after the range sort there are about as many of these rows as partitions and lengths together
    blocks = ordered.groupBy("length", "part").agg(F.min("at").alias("least"), F.count("*").alias("n")).collect()
    counts: dict[int, int] = {}
    before = []
    for b in sorted(blocks, key=lambda b: (b["length"], b["part"])):
        before.append((b["length"], b["part"], counts.get(b["length"], 0) - b["least"]))
        counts[b["length"]] = counts.get(b["length"], 0) + b["n"]
    plan = F.broadcast(spark.createDataFrame(plan_packing(counts, size), PLAN))
    shift = F.broadcast(spark.createDataFrame(before, "length int, part bigint, shift bigint"))
    ranked = ordered.join(shift, ["length", "part"]).withColumn("rank", F.col("at") + F.col("shift")).drop("at", "part", "shift")
    nth = F.col("rank") - F.col("first")
    placed = ranked.join(plan, "length").where("rank between first and last")
    placed = placed.withColumn("sequence_id", F.col("sequence") + F.floor(nth / F.col("each")))
    placed = placed.withColumn("offset", F.col("place") + nth % F.col("each") * F.col("length"))
    return placed.drop("rank", "first", "last", "each", "sequence", "place")


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 1024, end: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) per piece."""
    pieces = cut(encode_pieces(docs, tokenizer, size, end), "pieces")
    return pack(pieces, size).select(
        "doc_id", "piece", "start", F.col("length").cast("bigint").alias("length"), "ids_crc32", "sequence_id", F.col("offset").cast("bigint").alias("offset")
    )
