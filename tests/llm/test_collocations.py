"""Collocations against counts of all phrases."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from edges import ROWS, documents

from narrata.llm import collocations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def counted(rows):
    counts, totals = {}, Counter()
    for text, lang in rows:
        c = counts.setdefault(lang or "und", Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = [x for x in re.split("[\x20\x09]+", piece) if x]
            totals[lang or "und"] += len(w)
            c.update(tuple(w[i : i + k]) for k in range(1, 6) for i in range(len(w) - k + 1))
    return counts, totals


def test_a_shard_is_walked_in_spans(monkeypatch):
    """The same phrases in the same order from spans of any length, holding little at once."""
    text = np.append(np.random.default_rng(2).zipf(1.3, 400_000) % 300, 0).astype(np.int64)
    packed = [pa.array([collocations.packed(way[collocations.suffix_order_to(way, 5) - 1])], pa.binary()) for way in (text, text[::-1])]
    ids = pa.ListArray.from_arrays([0, 299], pa.array(np.arange(1000, 1299)))
    shard = collocations._Shard(pa.table({"ids": ids, "forward": packed[0], "backward": packed[1]}))
    found, peaks = [], []
    for rows in (1 << 40, 20_000, 7):
        monkeypatch.setattr(collocations, "ROWS", rows)
        live = shard.words()
        live = live[:, live[1] > 0]
        tracemalloc.start()
        keys, values = shard.longer(live)
        peaks.append(tracemalloc.get_traced_memory()[1] - keys.nbytes - values.nbytes)
        tracemalloc.stop()
        found.append((keys, values, shard.around(live), *shard.longer(np.vstack((np.arange(keys.shape[1]), values)))))
        none = shard.longer(live[:, :0])
        assert none[0].shape == (2, 0) and none[1].shape == (3, 0)
    for other in found[1:]:
        assert all(np.array_equal(a, b) for a, b in zip(found[0], other))
    assert peaks[1] < peaks[0]


def by_counting(rows, least, most):
    out, (counts, totals) = [], counted(rows)
    for lang, c in counts.items():
        candidates = {w: f for w, f in c.items() if len(w) > 1 and f >= least}
        held = {(w[i:j], f) for w, f in candidates.items() for i in range(len(w)) for j in range(i + 2, len(w) + 1) if j - i < len(w)}
        ranked = []
        for w, a in candidates.items():
            if (w, a) not in held:
                score, k = min((1000 * a * totals[lang] // (c[w[:k]] * c[w[k:]]), k) for k in range(1, len(w)))
                ranked.append((-score, -a, " ".join(w).encode(), c[w[:k]], c[w[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(ranked)[:most], 1)]
    return sorted(out)


def found(df, least, most, shard_words):
    tables, totals = collocations.phrases(df, least=least, shard_words=shard_words)
    rows = collocations.top(collocations.scored(tables, totals), most).collect()
    return sorted((r["lang"], r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in rows)


@pytest.mark.parametrize("shard_words", [300, 1 << 20])
def test_phrases_equal_counts(spark, shard_words):
    rng = random.Random(shard_words)
    texts = []
    for i in range(60):
        words = [rng.choice(["the", "The", "of", "a", "b", "New", "York", "é"]) + rng.choice([" ", " ", "\t ", ", ", "\n", "; "]) for _ in range(rng.randint(0, 60))]
        texts.append(("".join(words) + " new york city" * rng.randint(0, 3), rng.choice(["en", "en", None, "fr"])))
    texts += [(None, "en"), ("", None), ("a a a a a a a", "fr"), ("..,\x0b!", "xx"), ("\x1cq\x85 " * 4, "fr")]
    df = spark.createDataFrame(texts, "text string, lang string").repartition(3)
    for least, most in ((3, 1000), (1, 5)):
        assert found(df, least, most, shard_words) == by_counting(texts, least, most)


def test_table_equals_counts(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [(r.text, r["lang"]) for r in df.collect()]
    want = by_counting(texts, 10, 50)
    assert want and found(df, 10, 50, 20_000) == want


def test_bounds_tell_what_always_surrounds_a_phrase(spark):
    df = spark.createDataFrame([("x a b y",), ("x a b",), ("a c d",), ("x a c e",)], "text string").selectExpr("text", "'l' as lang")
    tables, _ = collocations.phrases(df, least=1, most_words=3, shard_words=1)
    pairs = {r.phrase: (r.f, r.left_bound, r.right_bound) for r in tables[1].collect()}
    assert pairs["a b"] == (2, True, False) and pairs["x a"] == (3, False, False) and pairs["a c"] == (2, False, False) and pairs["c d"] == (1, True, False)


def test_products_may_pass_64_bits(spark):
    columns = "id bigint, lang string, phrase string, f bigint, heads array<bigint>, tails array<bigint>, left_bound boolean, right_bound boolean"
    big = 3_000_000_000
    words = spark.createDataFrame([], columns)
    pairs = spark.createDataFrame([(1, "l", "a b", big, [big + 1, big], [big + 2, big], False, False)], columns)
    totals = spark.createDataFrame([("l", 10**14)], "lang string, n bigint")
    row = collocations.scored([words, pairs], totals).first()
    assert (row.l, row.r, row.score) == (big + 1, big + 2, 1000 * big * 10**14 // ((big + 1) * (big + 2)))


def test_defined_results(spark):
    assert found(documents(spark), 100, 2000, 1 << 20) == by_counting([(text, None) for _, text in ROWS], 100, 2000)
    empty, none = collocations.phrases(documents(spark, []), least=1)
    assert collocations.scored(empty, none).collect() == []


def test_order_round_the_end():
    text = np.array([2, 1, 2, 1, 3, 0])
    rows = collocations.suffix_order_to(text, 6)
    ring = [tuple(np.roll(text, -i)) for i in range(len(text))]
    assert rows.tolist() == sorted(range(len(text)), key=lambda i: ring[i])
    for symbols in (np.array([], np.int64), np.array([5, 0, 70_000])):
        assert collocations.unbundled(collocations.bundled(symbols, -symbols)).tolist() == [symbols.tolist(), (-symbols).tolist()]
        assert collocations.unpacked(collocations.packed(symbols)).tolist() == symbols.tolist()
