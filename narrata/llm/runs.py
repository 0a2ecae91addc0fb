"""Periodic runs of words in documents.

A run is a stretch of words with smallest period q that holds at least four periods and six words and cannot be extended.
Each document is searched by itself, inside the task that reads it:

1. *Stretches that can hold a run.* Three neighbouring words of a run stand at least three times in it. Places whose three
   words are rarer within their stretch divide it, again and again until nothing changes; what is left holds every run
   whole. Ordinary prose leaves next to nothing.
2. *Suffix trees* (Ukkonen, 1995) of what is left and of its reversal. The least string depth between two leaves on the
   Euler tour is the length of what their suffixes have in common: a range minimum, found from block minima in constant
   time and linear space.
3. *Lyndon roots.* The longest Lyndon word at a place ends before the next smaller suffix, and for the reversed alphabet
   before the next greater one, both read off the order of the leaves. One of the two at some place is the root of each
   run (Bannai et al., 2017); every candidate is extended to the right and to the left by common extensions.

Defined results: a null text has no words; a text without runs keeps all its words, and the columns of its longest run are
null. Repeated rows are judged each by itself. Other columns stay as they are, gathered in ``row``. Memory is in proportion
to one document.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PERIODS = 4  # a run holds at least so many periods
LEAST = 6  # and so many words
_ANCHOR = 3  # neighbouring words that are counted to find stretches; with the two bounds above each recurs three times in a run
_BLOCK = 64


def _numbered(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.int64)


def crowded(codes: np.ndarray) -> list[tuple[int, int]]:
    """[start, stop) of the stretches in which every three neighbouring words stand three times or more."""
    if len(codes) < LEAST:
        return []
    width = int(codes.max()) + 1
    anchors = _numbered(_numbered(codes[:-2] * width + codes[1:-1]) * width + codes[2:])
    at = np.arange(len(anchors))  # places of anchors that are left
    while len(at):
        stretch = np.concatenate(([0], np.cumsum(np.diff(at) > 1)))
        _, kind, count = np.unique(stretch * (len(anchors) + 1) + anchors[at], return_inverse=True, return_counts=True)
        kept = at[count[kind] >= 3]
        if len(kept) == len(at):
            break
        at = kept
    if not len(at):
        return []
    edges = np.nonzero(np.diff(at) > 1)[0]
    starts, stops = at[np.concatenate(([0], edges + 1))], at[np.concatenate((edges, [len(at) - 1]))] + _ANCHOR
    return [(int(a), int(b)) for a, b in zip(starts, stops) if b - a >= LEAST]


class SuffixTree:
    """Ukkonen's tree of a list of numbers whose last one stands nowhere else, with its Euler tour."""

    def __init__(self, text: list[int]):
        self.size = len(text)
        self._build(text)
        self._tour()

    def _build(self, text: list[int]) -> None:
        size, sigma = self.size, max(text) + 1
        first, stop, link, child = [0], [0], [0], {}
        node = edge = length = rest = 0  # the active point, and how many suffixes wait to be inserted
        for i, symbol in enumerate(text):
            rest += 1
            unlinked = 0
            while rest:
                if not length:
                    edge = i
                key = node * sigma + text[edge]
                below = child.get(key)
                if below is None:
                    child[key] = len(first)
                    first.append(i), stop.append(size), link.append(0)
                    if unlinked:
                        link[unlinked] = node
                        unlinked = 0
                else:
                    begin, span = first[below], stop[below] - first[below]
                    if length >= span:
                        node, edge, length = below, edge + span, length - span
                        continue
                    if text[begin + length] == symbol:
                        length += 1
                        if unlinked:
                            link[unlinked] = node
                        break
                    middle = len(first)
                    first.append(begin), stop.append(begin + length), link.append(0)
                    child[key] = middle
                    child[middle * sigma + symbol] = middle + 1
                    first.append(i), stop.append(size), link.append(0)
                    first[below] = begin + length
                    child[middle * sigma + text[begin + length]] = below
                    if unlinked:
                        link[unlinked] = middle
                    unlinked = middle
                rest -= 1
                if node:
                    node = link[node]
                elif length:
                    length -= 1
                    edge = i - rest + 1
        keys = np.fromiter(child.keys(), np.int64, len(child))
        order = np.argsort(keys)
        self._kids = np.fromiter(child.values(), np.int64, len(child))[order].tolist()
        bounds = np.searchsorted(keys[order] // sigma, np.arange(len(first) + 1)).tolist()
        self._begin, self._end = bounds[:-1], bounds[1:]
        self._span = (np.array(stop) - np.array(first)).tolist()

    def _tour(self) -> None:
        """String depths in the order of the tour, each suffix's place on it, and the suffixes in order."""
        kids, begin, end, span = self._kids, self._begin, self._end, self._span
        at, depth, tour, seen, leaves, path, node = list(begin), [0] * len(span), [], [0] * self.size, [], [], 0
        while True:
            here, place = depth[node], at[node]
            tour.append(here)
            if place < end[node]:
                at[node] = place + 1
                path.append(node)
                node = kids[place]
                depth[node] = here + span[node]
                continue
            if begin[node] == end[node]:
                suffix = self.size - here
                seen[suffix] = len(tour) - 1
                leaves.append(suffix)
            if not path:
                break
            node = path.pop()
        del self._kids, self._begin, self._end, self._span
        self.leaves, self._seen, self._least = np.array(leaves), np.array(seen), BlockMinima(np.array(tour, np.int32))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of suffixes ``a`` and ``b``, pair by pair, none with itself."""
        x, y = self._seen[a], self._seen[b]
        return self._least(np.minimum(x, y), np.maximum(x, y))


class BlockMinima:
    """Least value of any range: minima from and to the borders of blocks, and a table of all power-of-two runs of blocks."""

    def __init__(self, values: np.ndarray):
        blocks = -(-len(values) // _BLOCK)
        padded = np.full(blocks * _BLOCK + 1, np.iinfo(np.int32).max, np.int32)
        padded[: len(values)] = values
        self.values = padded
        square = padded[:-1].reshape(blocks, _BLOCK)
        self.to, self.since = np.minimum.accumulate(square, 1).ravel(), np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
        self.rows, width = [square.min(1)], 1
        while 2 * width <= blocks:
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-width], last[width:]))
            width *= 2

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Ranges [low, high], both ends included."""
        first, last = low // _BLOCK, high // _BLOCK
        out = np.minimum(self.since[low], self.to[high])
        near = np.nonzero(first == last)[0]
        if len(near):
            out[near] = np.minimum.reduceat(self.values, np.column_stack((low[near], high[near] + 1)).ravel())[::2]
        far = np.nonzero(last - first > 1)[0]
        level = np.frexp((last - first - 1)[far].astype(np.float64))[1] - 1
        for one in np.unique(level):
            row, some = self.rows[one], far[level == one]
            out[some] = np.minimum(out[some], np.minimum(row[first[some] + 1], row[last[some] - (1 << one)]))
        return out.astype(np.int64)


def _next_lesser(rank: list[int]) -> list[int]:
    """For each place the next one with a lesser rank, or the end."""
    out, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return out


def _runs_of(text: np.ndarray) -> np.ndarray:
    """(start, length, period) of every run of ``text``, whose last number stands nowhere else."""
    size = len(text)
    ahead = SuffixTree(text.tolist())
    rank = np.empty(size, np.int64)
    rank[ahead.leaves] = np.arange(size)
    at = np.arange(size)
    least = [np.array(_next_lesser(r.tolist())) - at for r in (rank, size - rank)]
    start, period = np.concatenate((at, at)), np.concatenate(least)
    kept = (period * PERIODS < size) & (start + period < size)
    start, period = start[kept], period[kept]
    right = ahead.common(start, start + period)
    # A place's left side is a suffix of the reversal, whose end gets the number that stands nowhere else.
    behind = SuffixTree([*text[-2::-1].tolist(), int(text[-1])])
    left = np.zeros(len(start), np.int64)
    some = np.nonzero(start > 0)[0]
    left[some] = behind.common(size - 1 - start[some], size - 1 - start[some] - period[some])
    length = left + period + right
    found = np.column_stack((start - left, length, period))[length >= np.maximum(LEAST, PERIODS * period)]
    return np.unique(found, axis=0)


def find_runs(words: list) -> np.ndarray:
    """(start, length, period) of every run of ``words``, by start, then period."""
    names: dict = {}
    codes = np.fromiter((names.setdefault(w, len(names)) for w in words), np.int64, len(words))
    stretches = crowded(codes)
    if not stretches:
        return np.empty((0, 3), np.int64)
    # The stretches in a row, each closed by a number of its own.
    parts, places, width = [], [], len(names)
    for i, (a, b) in enumerate(stretches):
        parts += [codes[a:b], [width + i]]
        places.append(np.arange(a, b + 1))
    text, place = _numbered(np.concatenate(parts)), np.concatenate(places)
    runs = _runs_of(text)
    runs[:, 0] = place[runs[:, 0]]
    return runs[np.lexsort((runs[:, 1], runs[:, 2], runs[:, 0]))]


def collapsed(words: list, runs: np.ndarray) -> list:
    """``words`` without those that a run holds after its first period."""
    change = np.zeros(len(words) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    inside = np.cumsum(change)[:-1] > 0
    return [w for w, gone in zip(words, inside.tolist()) if not gone] if len(runs) else words


def split_words(text: bytes | None) -> list[bytes]:
    """Words between the six ASCII white-space characters, which are those ``bytes.split`` splits at."""
    return (text or b"").split()


FOUND = "runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed_text string"
_FOUND = pa.struct([
    ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
    ("collapsed_text", pa.string()),
])


def with_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", rewrite: Callable[[list[bytes], object], list[bytes]] | None = None) -> DataFrame:
    """(row, found) of every row: its runs in order and the text without their repeats, words joined by one space.

    ``rewrite`` changes a document's words before they are searched, given the row's ``key``.
    """

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, keys = batch.columns
            found = []
            for value, of in zip(texts.cast(pa.large_binary()), keys):
                words = split_words(value.as_py())
                if rewrite:
                    words = rewrite(words, of.as_py())
                runs = find_runs(words)
                kept = b" ".join(collapsed(words, runs)).decode()
                found.append({"runs": [{"start": a, "length": n, "period": q} for a, n, q in runs.tolist()], "collapsed_text": kept})
            yield pa.RecordBatch.from_arrays([rows, pa.array(found, _FOUND)], names=["row", "found"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    asked = rows.select("row", F.col(f"row.`{text}`").cast("string").alias("text"), F.col(f"row.`{key}`").alias("key"))
    return asked.mapInArrow(search, f"row {rows.schema['row'].dataType.simpleString()}, found struct<{FOUND.replace(' array', ':array').replace(' string', ':string')}>")


def run_columns(found: str = "found") -> dict:
    """Columns that sum up the runs: their number, the longest (ties: least start, then period), and all as lines."""
    runs = F.col(f"{found}.runs")
    first = F.get(F.array_sort(F.transform(runs, lambda r: F.struct((-r["length"]).alias("n"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    line = F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return {
        "n_runs": F.size(runs).cast("bigint"),
        "start": first["start"],
        "length": -first["n"],
        "period": first["period"],
        "exponent_milli": F.floor(-first["n"] * 1000 / first["period"]).cast("bigint"),
        "runs_sha256": F.sha2(line.cast("binary"), 256),
        "collapsed_sha256": F.sha2(F.col(f"{found}.collapsed_text").cast("binary"), 256),
    }
