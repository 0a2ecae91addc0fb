"""Sampled SentencePiece segmentations by forward filtering and backward sampling, and lossless decoding.

A line is the text with a space before it, spaces written as the vocabulary's mark. Pieces hold the mark at their beginning
only, so the lattice of a text falls into one lattice per word. Piece weights are ``exp(score / heat)`` with scores that fall with the logarithm of the
vocabulary's rank; a character that no piece covers is its bytes. The forward pass sums the weights of all segmentations of each beginning of a
word, for all different words of a batch side by side. The backward pass draws the last piece of each occurrence in proportion to
what it closes, then the one before, and so on. The draws are hashes of the row's key, the word's place in the text and the step, so a segmentation depends on nothing but
its row and the seed.

Decoding joins pieces and bytes, turns marks into spaces and drops the first one. A mark that stands in the text itself is
always encoded as bytes, so decoding restores every text.

Defined results: a null text is an empty one: one mark (a space before nothing), which decodes to the empty text. A null key draws like key zero. Repeated rows
get the same segmentation. Only the key and the text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
SLICE = 1 << 20  # characters segmented at once
KINDS = 4096  # different words whose lattices are held at once
COMMON = 256  # characters below this code are looked up in a table
LONG = 64  # characters of a word handled at once; longer words are cut


class Pieces:
    """The vocabulary as a trie over characters, in arrays."""

    def __init__(self, path: str, heat: float):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.texts = [model.id_to_piece(i) for i in range(size)]
        self.octet = np.full(256, -1, np.int64)  # id of each byte piece
        plain = []
        for i, text in enumerate(self.texts):
            if model.is_byte(i):
                self.octet[int(text[3:5], 16)] = i
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) and MARK not in text[1:]:
                plain.append(i)
        self.data = [t.replace(MARK, " ").encode() for t in self.texts]  # what each id stands for
        for b in range(256):
            self.data[self.octet[b]] = bytes([b])
        nodes: dict[tuple[int, str], int] = {}
        piece = [-1]
        self.longest = max(len(self.texts[i]) for i in plain)
        for i in plain:
            at = 0
            for c in self.texts[i]:
                if (at, c) not in nodes:
                    nodes[at, c] = len(piece)
                    piece.append(-1)
                at = nodes[at, c]
            piece[at] = i
        rank = {i: r for r, i in enumerate(plain)}
        self.piece = np.array(piece)
        self.log = np.full(len(piece), -np.inf)
        for node, i in enumerate(piece):
            if i >= 0:
                self.log[node] = -np.log(rank[i] + 2) / heat
        self.octet_log = -np.log(len(plain) + 2) / heat
        keys = np.array([(n << 21) | ord(c) for n, c in nodes], np.int64)
        order = np.argsort(keys)
        self.keys, self.next = keys[order], np.fromiter(nodes.values(), np.int64)[order]
        # Steps by common characters are looked up in a table of inner nodes; leaves share its empty last row.
        inner = np.unique(self.keys >> 21)
        self.row = np.full(len(piece), len(inner), np.int32)
        self.row[inner] = np.arange(len(inner))
        self.table = np.full((len(inner) + 1) * COMMON, -1, np.int32)
        column = self.keys & ((1 << 21) - 1)
        common = column < COMMON
        self.table[self.row[self.keys[common] >> 21].astype(np.int64) * COMMON + column[common]] = self.next[common]

    def step(self, node: np.ndarray, char: np.ndarray) -> np.ndarray:
        """Where each character leads, -1 for nowhere."""
        common = char < COMMON
        out = self.table[self.row[node].astype(np.int64) * COMMON + np.where(common, char, 0)].astype(np.int64)
        rare = np.flatnonzero(~common)
        if len(rare):
            key = (node[rare] << 21) | char[rare]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            out[rare] = np.where(self.keys[at] == key, self.next[at], -1)
        return out


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def draws(key: np.ndarray, place: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    """Uniform numbers in (0, 1) of row key, word and character."""
    x = _mixed(key.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
    x = _mixed(x + place.astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
    x = _mixed(x + end.astype(np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53


class Lattice:
    """All segmentations of different words: for each end and piece length the weight of closing there."""

    def __init__(self, words: list[str], pieces: Pieces):
        n = len(words)
        self.sizes = np.array([len(w) for w in words])
        width = int(self.sizes.max())
        flat = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        chars = np.zeros((n, width), np.int64)
        inside = np.arange(width) < self.sizes[:, None]
        chars[inside] = flat
        own_mark = (chars == ord(MARK)) & (np.arange(width) > 0)
        self.chars, span = chars, min(pieces.longest, width)
        # node[l][w, i]: the piece of l + 1 characters from i on
        self.nodes = np.full((n, width, span), -1, np.int32)  # by end and length
        row, start = np.nonzero(inside & ~own_mark)
        node = np.zeros(len(row), np.int64)
        for length in range(1, span + 1):
            at = start + length - 1
            ok = (at < self.sizes[row]) & ~own_mark[row, np.minimum(at, width - 1)]
            row, start, node, at = row[ok], start[ok], node[ok], at[ok]
            node = pieces.step(node, chars[row, at])
            ok = node >= 0
            row, start, node, at = row[ok], start[ok], node[ok], at[ok]
            if not len(row):
                break
            whole = pieces.piece[node] >= 0
            self.nodes[row[whole], at[whole], length - 1] = node[whole]
        # forward filtering in logarithms; column 0 also stands for bytes
        self.alpha = np.full((n, width + 1), -np.inf)
        self.alpha[:, 0] = 0
        self.close = np.full((n, width, span), -np.inf)
        octets = np.where(chars < 0x80, 1, np.where(chars < 0x800, 2, np.where(chars < 0x10000, 3, 4)))
        for end in range(width):
            most = min(span, end + 1)
            nodes = self.nodes[:, end, :most]
            weight = np.where(nodes >= 0, pieces.log[nodes], -np.inf)
            weight[:, 0] = np.where(nodes[:, 0] >= 0, weight[:, 0], octets[:, end] * pieces.octet_log)
            got = weight + self.alpha[:, end - most + 1 : end + 1][:, ::-1]
            self.close[:, end, :most] = got
            top = got.max(1)
            self.alpha[:, end + 1] = top + np.log(np.exp(got - top[:, None]).sum(1))

    def sample(self, word: np.ndarray, key: np.ndarray, place: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(occurrence, end, length) of the drawn pieces of each occurrence of a word."""
        out = []
        which, end = np.arange(len(word)), self.sizes[word].copy()
        while len(which):
            own = word[which]
            weight = np.exp(self.close[own, end - 1] - self.alpha[own, end][:, None])
            edge = np.cumsum(weight, axis=1)
            u = draws(key[which], place[which], end, seed) * edge[:, -1]
            length = (edge <= u[:, None]).sum(1) + 1
            out.append((which, end, length))
            end = end - length
            left = end > 0
            which, end = which[left], end[left]
        return tuple(np.concatenate(x) for x in zip(*out))


def words_of(text: str) -> list[str]:
    """The marked line, cut before every mark that stands for a space, and words that are very long again."""
    words = (MARK + text.replace(" ", " " + MARK)).split(" ")
    if max(map(len, words)) <= LONG:
        return words
    out = []
    for word in words:
        out.append(word[:LONG])
        out.extend(word[i : i + LONG - 1] for i in range(LONG, len(word), LONG - 1))
    return out


def segment(texts: list[str | None], keys: np.ndarray, pieces: Pieces, seed: int) -> list[np.ndarray]:
    """Piece ids of each text."""
    words = [words_of(t or "") for t in texts]
    counts = np.array([len(w) for w in words])
    flat = list(chain.from_iterable(words))
    kinds = list(dict.fromkeys(flat))
    word = np.fromiter(map(dict(zip(kinds, range(len(kinds)))).__getitem__, flat), np.int64, len(flat))
    key = np.repeat(keys, counts)
    place = np.arange(len(word)) - np.repeat(np.cumsum(counts) - counts, counts)
    sizes = np.array([len(k) for k in kinds])
    row, at, ids = [], [], []
    # words of like length share a lattice
    edges = [0, 6, 10, 16, 32, LONG + 1]
    for low, high in zip(edges, edges[1:]):
        mine = np.flatnonzero((sizes > low) & (sizes <= high))
        for k in range(0, len(mine), KINDS):
            part = mine[k : k + KINDS]
            renumber = np.full(len(kinds), -1)
            renumber[part] = np.arange(len(part))
            where = np.flatnonzero(renumber[word] >= 0)
            lattice = Lattice([kinds[i] for i in part], pieces)
            own = renumber[word[where]]
            which, end, length = lattice.sample(own, key[where], place[where], seed)
            node = lattice.nodes[own[which], end - 1, length - 1]
            plain = node >= 0
            row.append(where[which[plain]])
            at.append(end[plain] * 4)
            ids.append(pieces.piece[node[plain]])
            for o, e in zip(which[~plain].tolist(), end[~plain].tolist()):
                data = chr(lattice.chars[own[o], e - 1]).encode("utf-8")
                row.append(np.full(len(data), where[o]))
                at.append(e * 4 - 3 + np.arange(len(data)) + (4 - len(data)))
                ids.append(pieces.octet[list(data)])
    if not row:
        return [np.zeros(0, np.int64) for _ in texts]
    row, at, ids = np.concatenate(row), np.concatenate(at), np.concatenate(ids)
    order = np.lexsort((at, row))
    text = np.repeat(np.arange(len(texts)), counts)[row[order]]
    return np.split(ids[order], np.cumsum(np.bincount(text, minlength=len(texts)))[:-1])


def decode(ids: np.ndarray, pieces: Pieces) -> bytes:
    """The UTF-8 text."""
    return b"".join(map(pieces.data.__getitem__, ids.tolist()))[1:]


def _slices(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    at, n = 0, 0
    for i, t in enumerate(texts):
        n += len(t or "")
        if n >= SLICE or i == len(texts) - 1:
            yield at, i + 1
            at, n = i + 1, 0


def _encoder(path: str, heat: float, seed: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path, heat)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            keys = batch.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False)
            for start, stop in _slices(texts):
                ids = segment(texts[start:stop], keys[start:stop], pieces, seed)
                ends = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids).astype(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, stop - start), lists], names=["doc_id", "ids"])

    return of


def _decoder(path: str):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces(path, 1.0)
        for batch in batches:
            ids = batch.column("ids")
            values, ends = ids.flatten().to_numpy(), np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            parts = np.split(values, ends[:-1]) if len(ends) else []
            texts = [decode(x, pieces).decode() for x in parts]
            sums = [zlib.crc32(x.astype("<u4").tobytes()) for x in parts]
            columns = [batch.column("doc_id"), pa.array([len(x) for x in parts], pa.int64()), pa.array(sums, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_ids", "ids_crc32", "text"])

    return of


def encode(docs: DataFrame, vocabulary: str, heat: float = 0.5, seed: int = 4) -> DataFrame:
    """(doc_id, ids) of each row's text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_encoder(vocabulary, heat, seed), "doc_id bigint, ids array<int>")


def decode_rows(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_ids, ids_crc32, text) of each row of ``encode``; the sum is of the ids as little-endian 32-bit numbers."""
    return encoded.select("doc_id", "ids").mapInArrow(_decoder(vocabulary), "doc_id bigint, n_ids bigint, ids_crc32 bigint, text string")
