"""Packing and sampled segmentations."""

from __future__ import annotations

import math
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import public_tokenizers
from edges import ROWS, documents
from tokenizers import Tokenizer

from narrata.llm import packing, sampled_pieces

SF = "/root/testdata/sf0.001"
BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["a\n \nb", " lead", "trail ", "two  spaces", "a \n b", "tab\t x", "\u00a0 x \u2028y", "don't 've", "x" * 300, "<|endoftext|> z", "a\n\n b", " "]


def slow(text, size):
    t = Tokenizer.from_file(BPE)
    ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
    first = (len(ids) - 1) % size + 1
    bounds = [0, *range(first, len(ids) + 1, size)]
    return [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(bounds, bounds[1:]))]


def check(rows, got, size):
    expected = Counter((repr(i), *p) for i, t in rows for p in slow(t, size))
    assert Counter((repr(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    held: dict[int, list] = {}
    for r in got:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for spans in held.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and sum(spans[-1]) <= size
    return len(held)


def test_packing(spark):
    rows = ROWS + [(100 + i, t) for i, t in enumerate(ODD)]
    check(rows, packing.pack_documents(documents(spark, rows), BPE, 64).collect(), 64)
    assert packing.pack_documents(documents(spark, []), BPE, 64).collect() == []
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = packing.pack_documents(docs, BPE, 1024).collect()
    assert check(rows, got, 1024) <= math.ceil(sum(r["length"] for r in got) / 1024) * 1.02 + 1


def test_fast_ids_are_those_of_the_library():
    encoder = packing.Encoder(BPE)
    assert encoder.fast is not None
    letters = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(letters), 400):
        text = "".join(f"a{c}1{c}, {c}{c} '{c}\n" for c in letters[i : i + 400])
        assert encoder.encode(text) == encoder.by_library(text)
    for text in ("x" * 50_000, " " * 50_000, "\t\n" * 3000 + "x", "ab " * 20_000):
        assert encoder.encode(text) == encoder.by_library(text)


def test_plan_is_best_fit_decreasing():
    draw = np.random.default_rng(6)
    for size in (10, 37, 200):
        lengths = draw.integers(1, size + 1, 400)
        gaps, sequences = [], 0
        for n in sorted(lengths.tolist(), reverse=True):
            at = bisect_left(gaps, n)
            gap = gaps.pop(at) if at < len(gaps) else size
            sequences += gap == size and at >= len(gaps)
            if gap > n:
                insort(gaps, gap - n)
        plan = packing.plan_packing(dict(Counter(lengths.tolist())), size)
        used = {s + i for n, a, b, each, s, _ in plan for i in range(-(-(b - a + 1) // each))}
        assert len(used) == max(used) + 1 and len(used) <= sequences + 1
        assert sum(b - a + 1 for _, a, b, *_ in plan) == 400


def test_segmentations(spark):
    docs = documents(spark, ROWS + [(50, " x "), (51, "é" * 200), (52, "a\n▁b")])
    encoded = sampled_pieces.encode(docs, PIECES, seed=4)
    back = sampled_pieces.decode_rows(encoded, PIECES)
    texts = sorted(repr((r["doc_id"], r["text"] or "")) for r in docs.collect())
    assert sorted(repr((r["doc_id"], r["text"])) for r in back.collect()) == texts
    again = sampled_pieces.encode(docs.repartition(5), PIECES, seed=4)
    key = lambda df: sorted(repr(tuple(r)) for r in df.collect())
    assert key(encoded) == key(again) != key(sampled_pieces.encode(docs, PIECES, seed=5))
    assert sampled_pieces.encode(documents(spark, []), PIECES).collect() == []


def test_samples_follow_the_lattice():
    pieces = sampled_pieces.Pieces(PIECES, 0.5)
    word, n = "▁there", 6000
    weights = {}

    def walk(at, path, w):
        if at == len(word):
            weights[path] = math.exp(w)
            return
        node, any_one = 0, False
        for end in range(at, len(word)):
            node = int(pieces.step(np.array([node]), np.array([ord(word[end])]))[0])
            if node < 0:
                break
            if pieces.piece[node] >= 0:
                any_one = any_one or end == at
                walk(end + 1, (*path, int(pieces.piece[node])), w + pieces.log[node])
        assert any_one

    walk(0, (), 0.0)
    total = sum(weights.values())
    drawn = Counter(tuple(x.tolist()) for x in sampled_pieces.segment([word[1:]] * n, np.arange(n), pieces, 1))
    assert set(drawn) <= set(weights)
    for path, w in weights.items():
        p = w / total
        assert abs(drawn[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-9
