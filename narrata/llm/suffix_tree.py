"""Language-model scores from a probabilistic suffix tree.

A text is its lower-cased words, each closed by one space, and an end. The tree's symbols are the bytes
of that line, so every word has a probability, known or not. Contexts are up to ``depth`` bytes long. A context
is considered if it makes up at least ``least_share`` of the training symbols (so there are
at most ``depth / least_share`` of them, however large the corpus) and retained if
its next-symbol distribution diverges from that of its longest proper suffix:
count times Kullback-Leibler divergence above ``divergence`` times the logarithm
of all symbols. Distributions are smoothed towards the next shorter retained context
by the number of different symbols seen (Witten and Bell). A symbol is scored
in the state of the longest retained suffix of what precedes it.

A token's probability is last smoothed with its add-one share of the training tokens: ``share`` of that and the rest
of the product of the tree's symbols. The sum of the logarithms of the add-one shares alone is the base score. Words that are frequent in training are looked
up in a table of at most ``frequent`` rows; the others are joined.

Defined results: a null text is an empty one (its end is scored). Rows without
an id are learned from only if fold 0 is. Repeated rows count and are scored each.
Without training text every symbol is equally likely. Only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.base import Sent, fold
from narrata.shared import cut

SYMBOLS = 252  # byte values that can occur: all but the six white-space ones, and the space and the end
END = 10
SLICE_BYTES = 1 << 20  # of text at once; the arrays worked out for a slice take tens of times as much
KEYS_HELD = 1_500_000  # packed keys of all parts of a tally, before they are merged
WORDS_HELD = 400_000
KINDS = "w bigint, word string, n bigint"
FREQUENT_BYTES = 24  # longest word in the table of frequent words


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[int, list[list[bytes]]]]:
    """The rows' lower-cased words, about SLICE_BYTES at once, with the first row's number."""
    texts = batch.column("text").cast(pa.binary())
    at, out, n = 0, [], 0
    for i in range(len(texts)):
        own = (texts[i].as_py() or b"").lower().split()  # of bytes: A-Z; 0x20 and 0x09-0x0D
        out.append(own)
        n += sum(map(len, own)) + len(own)
        if n >= SLICE_BYTES:
            yield at, out
            at, out, n = i + 1, [], 0
    if out:
        yield at, out


def _stream(lines: list[list[bytes]], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one byte array, each after ``depth`` spaces; where each begins, and which bytes are scored."""
    pad = b" " * depth
    parts = [pad + b" ".join([*w, b"\n"]) for w in lines]  # a space closes every word, then the end
    sizes = np.array([len(p) for p in parts])
    starts = np.cumsum(sizes) - sizes
    real = np.ones(int(sizes.sum()), bool)
    real[(starts[:, None] + np.arange(depth)).ravel()] = False
    return np.frombuffer(b"".join(parts), np.uint8), starts, real


def _windows(stream: np.ndarray, real: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Each context of ``depth`` bytes with the byte after it, packed, and how often."""
    n = len(stream) - depth
    key = np.zeros(n, np.int64)
    for i in range(depth + 1):
        key = (key << 8) | stream[i : i + n]
    return np.unique(key[real[depth:]], return_counts=True)


class Tally:
    """Numbers of packed keys, merged now and then; handed out when many are left by that."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray) -> None:
        if not len(keys):
            return
        self.parts.append(np.unique(keys, return_counts=True))
        if self.held() > KEYS_HELD:
            self.merge()

    def held(self) -> int:
        return sum(len(k) for k, _ in self.parts)

    def full(self) -> bool:
        return len(self.parts) == 1 and self.held() > KEYS_HELD * 3 // 4

    def merge(self) -> None:
        if len(self.parts) < 2:
            return
        keys, times = (np.concatenate(x) for x in zip(*self.parts))
        self.parts = []
        order = np.argsort(keys, kind="stable")  # each part is in order, so this merges them
        keys = keys[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        self.parts = [(keys[first], np.add.reduceat(times[order], first))]

    def rows(self) -> pa.RecordBatch:
        self.merge()
        ((keys, times),) = self.parts
        self.parts = []
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.nulls(len(keys), pa.string()), pa.array(times)], names=["w", "word", "n"])


def _packed(stream: np.ndarray, length: int) -> np.ndarray:
    """Every ``length`` consecutive bytes as one number."""
    n = len(stream) - length + 1
    key = np.zeros(n, np.int64)
    for i in range(length):
        key = (key << 8) | stream[i : i + n]
    return key


def _count_shallow(depth: int):
    """Words, and every byte with the ``depth`` bytes before it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter = Counter()
        tally = Tally()

        def words_out():
            n = len(words)
            out = pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.array([w.decode() for w in words], pa.string()), pa.array(list(words.values()), pa.int64())], names=["w", "word", "n"])
            words.clear()
            return out

        for batch in batches:
            for _, lines in _lines(batch):
                for w in lines:
                    words.update(w)
                if len(words) > WORDS_HELD:
                    yield words_out()
                stream, _, real = _stream(lines, depth)
                tally.add(_packed(stream, depth + 1)[real[depth:]])
                if tally.full():
                    yield tally.rows()
        if words:
            yield words_out()
        if tally.parts:
            yield tally.rows()

    return count


def _slots(keys: np.ndarray) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(42)).astype(np.int64)


def _count_deep(depth: int, common):
    """Every byte after a string of ``depth - 1`` bytes that may be common, with the byte before that string if the two make one
    that may be common up to its last byte, else with 255 for it (no text has that byte)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally, may = Tally(), np.zeros(1 << 22, bool)
        may[_slots(common.value)] = True
        for batch in batches:
            for _, lines in _lines(batch):
                stream, _, real = _stream(lines, depth)
                hit = may[_slots(_packed(stream, depth - 1))]
                keys = _packed(stream, depth + 1)
                n = len(keys)
                late, early = hit[1 : n + 1], hit[:n]
                keys = np.where(early, keys, keys | np.int64(255 << 8 * depth))
                tally.add(keys[late & real[depth:]])
                if tally.full():
                    yield tally.rows()
        if tally.parts:
            yield tally.rows()

    return count


class Automaton:
    """The retained contexts as a machine that always stands in the longest one matching what it has read."""

    def __init__(self, counts: dict[bytes, dict[int, int]]):
        """``counts``: of each retained context, of the empty one at least, the next symbols and their numbers."""
        used = sorted({s for c in counts.values() for s in c} | {x for c in counts for x in c})
        self.width = len(used) + 1  # the last column stands for every byte never seen
        self.code = np.full(256, len(used), np.int64)
        self.code[used] = np.arange(len(used))
        contexts = sorted(counts, key=len)
        number = {c: i for i, c in enumerate(contexts)}
        prob = np.zeros((len(contexts), self.width))
        for c in contexts:
            seen = counts[c]
            row, total = prob[number[c]], sum(seen.values())
            if c:
                parent = next(c[i:] for i in range(1, len(c) + 1) if c[i:] in number)
                row += len(seen) * prob[number[parent]]
                weight = len(seen)
            else:
                row += 1.0
                weight = SYMBOLS
            for s, n in seen.items():
                row[self.code[s]] += n
            row /= total + weight
        nodes = {b"": 0}  # all prefixes of contexts, shorter ones first
        for p in sorted({c[:i] for c in contexts for i in range(1, len(c) + 1)}, key=len):
            nodes[p] = len(nodes)
        state = np.zeros(len(nodes), np.int64)
        move = np.zeros((len(nodes), self.width), np.int32)
        for p, i in nodes.items():
            suffix = next((p[k:] for k in range(1, len(p) + 1) if p[k:] in nodes), b"")
            state[i] = number[p] if p in number else state[nodes[suffix]]
        self.log = np.log10(prob)[state].astype(np.float32).ravel()
        self.move = self._complete(nodes, move)

    def _complete(self, nodes: dict[bytes, int], move: np.ndarray) -> np.ndarray:
        children: dict[int, list[tuple[int, int]]] = {}
        for p, i in nodes.items():
            if p:
                children.setdefault(nodes[p[:-1]], []).append((int(self.code[p[-1]]), i))
        for p, i in nodes.items():
            if p:
                suffix = next(p[k:] for k in range(1, len(p) + 1) if p[k:] in nodes)
                move[i] = move[nodes[suffix]]
            # nodes come shorter ones first, so the row of the suffix is complete
            for symbol, child in children.get(i, ()):
                move[i, symbol] = child
        return move.ravel()

    def logs(self, stream: np.ndarray, depth: int, piece: int = 512) -> np.ndarray:
        """log10 probability of every byte. The state depends on ``depth`` bytes, so pieces are read side by side."""
        n = -(-len(stream) // piece)
        padded = np.full(n * piece + depth, 32, np.uint8)
        padded[depth : depth + len(stream)] = stream
        codes = np.empty((piece + depth, n), np.int64)
        for t in range(piece + depth):
            codes[t] = self.code[padded[t : t + (n - 1) * piece + 1 : piece]]
        out = np.empty((piece, n))
        at = np.zeros(n, np.int64)
        for t in range(piece + depth):
            place = at * self.width + codes[t]
            if t >= depth:
                out[t - depth] = self.log[place]
            at = self.move[place].astype(np.int64)
        return out.T.ravel()[: len(stream)]


def fit_tree(windows: DataFrame, train: DataFrame, depth: int, least_share: float, divergence: float) -> Automaton:
    """``windows``: (w, n), bytes with the ``depth - 2`` before them.

    A string is common only if its parts are, so the deepest two levels are counted, in a second pass, after
    common strings only.
    """
    total = windows.agg(F.sum("n")).first()[0] or 0
    if not total:
        return Automaton({b"": {}})
    shallow, least = depth - 2, max(1.0, least_share * total)
    often = windows.where(F.col("n") >= least).select("w").toLocalIterator()  # at most 1 / least_share rows
    often = Sent(train.sparkSession, np.fromiter((r["w"] for r in often), np.int64))
    deep = train.select("text").mapInArrow(_count_deep(depth, often), KINDS).groupBy("w").agg(F.sum("n").alias("n"))

    def cuts(levels):
        return F.array(*[F.struct(F.lit(j).alias("j"), F.col("w").bitwiseAND(F.lit((1 << 8 * (j + 1)) - 1)).alias("pair")) for j in levels])

    ends = windows.select("n", F.explode(cuts(range(shallow + 1))).alias("e")).unionByName(deep.select("n", F.explode(cuts((depth - 1, depth))).alias("e")))
    ends = ends.where((F.col("e.j") < depth) | (F.shiftright("e.pair", 8 * depth) != 255))
    pairs = ends.groupBy("e.j", "e.pair").agg(F.sum("n").alias("n"))
    pairs = cut(pairs.withColumn("context", F.shiftright("pair", 8)), "pairs")
    common = pairs.groupBy("j", "context").agg(F.sum("n").alias("total")).where(F.col("total") >= least)
    pairs = cut(pairs.join(common, ["j", "context"]), "common")
    mask = F.expr("shiftleft(1L, 8 * j) - 1")
    parent = pairs.select((F.col("j") + 1).alias("j"), F.col("pair").alias("short"), F.col("n").alias("n_short"), F.col("total").alias("total_short"))
    compared = pairs.where("j > 0").withColumn("short", F.col("pair").bitwiseAND(mask)).join(parent, ["j", "short"])
    gain = F.sum(F.col("n") * F.log(F.col("n") / F.col("total") * F.col("total_short") / F.col("n_short")))
    kept = compared.groupBy("j", "context").agg(gain.alias("gain")).where(F.col("gain") > divergence * math.log(total)).select("j", "context")
    kept = kept.unionByName(pairs.where("j = 0").select("j", "context").distinct())
    counts: dict[bytes, dict[int, int]] = {b"": {}}
    for r in pairs.join(kept, ["j", "context"]).select("j", "pair", "n").toLocalIterator():
        packed = r["pair"].to_bytes(r["j"] + 1, "big")
        counts.setdefault(packed[:-1], {})[packed[-1]] = r["n"]
    return Automaton(counts)


def _scorer(tree, frequent, depth: int, size: int, ends: int, share: float):
    """Sums of each text over its end and its frequent words; of each other word the tree's probability."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = tree.value, frequent.value
        kind = pa.list_(pa.struct([("word", pa.string()), ("log", pa.float64())]))
        for batch in batches:
            for at, lines in _lines(batch):
                stream, _, real = _stream(lines, depth)
                sums = np.cumsum(np.where(real, model.logs(stream, depth), 0.0))
                closes = np.flatnonzero(real & ((stream == 32) | (stream == END)))
                logs = np.diff(sums[closes], prepend=0.0)  # of every token, words and ends
                counts = np.array([len(w) + 1 for w in lines])
                starts = np.cumsum(counts) - counts
                flat = [t for w in lines for t in (*w, None)]
                c = np.fromiter(map(known.get, flat, repeat(-1.0)), np.float64, len(flat))
                c[starts + counts - 1] = ends
                there = c >= 0
                prior = (np.maximum(c, 0) + 1) / size
                base = np.add.reduceat(np.where(there, np.log10(prior), 0.0), starts)
                mixed = np.add.reduceat(np.where(there, np.log10(share * prior + (1 - share) * 10.0**logs), 0.0), starts)
                hits = np.add.reduceat(c > 0, starts, dtype=np.int64)
                rest: list[list] = [[] for _ in lines]
                away = np.flatnonzero(~there)
                for r, i, x in zip((np.searchsorted(starts, away, side="right") - 1).tolist(), away.tolist(), logs[away].tolist()):
                    rest[r].append({"word": flat[i].decode(), "log": x})
                n = len(lines)
                columns = [pa.array(counts, pa.int64()), pa.array(hits), pa.array(base), pa.array(mixed), pa.array(rest, kind)]
                yield pa.RecordBatch.from_arrays([batch.column("rid").slice(at, n), batch.column("doc_id").slice(at, n), *columns], names=["rid", "doc_id", "n_tokens", "hits", "base", "mixed", "rest"])

    return score


def score_texts(
    docs: DataFrame, train: DataFrame, depth: int = 6, least_share: float = 1e-5, divergence: float = 1.0, frequent: int = 150_000, share: float = 0.5
) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``, learned from ``train``."""
    spark = docs.sparkSession
    counted = cut(train.select("text").mapInArrow(_count_shallow(depth - 2), KINDS), "counted")
    windows = cut(counted.where("w is not null").groupBy("w").agg(F.sum("n").alias("n")), "windows")
    tree = fit_tree(windows, train, depth, least_share, divergence)
    words = cut(counted.where("word is not null").groupBy("word").agg(F.sum("n").alias("c")), "words")
    ends = train.count()
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    n, v = n + ends, v + (ends > 0)
    size = n + v + 1
    short = F.octet_length("word") <= FREQUENT_BYTES
    top = cut(words.where(short).orderBy(F.desc("c"), "word").limit(frequent), "frequent")
    known = {r["word"].encode(): float(r["c"]) for r in top.toLocalIterator()}
    send = partial(Sent, spark)
    own = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    kinds = "rid bigint, doc_id bigint, n_tokens bigint, hits bigint, base double, mixed double, rest array<struct<word:string,log:double>>"
    scored = cut(own.mapInArrow(_scorer(send(tree), send(known), depth, size, ends, share), kinds), "scored")
    rest = scored.select("rid", F.explode("rest").alias("r")).select("rid", "r.word", "r.log").join(words, "word", "left")
    prior = (F.coalesce("c", F.lit(0)) + 1) / F.lit(float(size))
    found = rest.groupBy("rid").agg(
        F.count("c").alias("more"), F.sum(F.log10(prior)).alias("base_more"), F.sum(F.log10(share * prior + (1 - share) * F.pow(F.lit(10.0), F.col("log")))).alias("mixed_more")
    )
    return scored.drop("rest").join(found, "rid", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("hits") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(n).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("base_more", F.lit(0.0))).alias("base_score"),
        (F.col("mixed") + F.coalesce("mixed_more", F.lit(0.0))).alias("score"),
    )


def score_documents(docs: DataFrame, folds: int, held_out: int, **settings) -> DataFrame:
    """``score_texts`` learned from the documents outside fold ``held_out``, and whether each is in it."""
    inside = fold(F.col("doc_id"), folds) == held_out
    return score_texts(docs, docs.where(~inside), **settings).withColumn("held_out", inside)
