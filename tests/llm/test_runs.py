"""Periodic runs against their definition."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from edges import LONG, documents

from narrata.llm import runs
from narrata.llm.queries import _repeating_tail, op12_periodic_runs


def by_definition(words):
    """Every maximal stretch with smallest period q that holds max(6, 4 q) words."""
    found, n = [], len(words)
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q) and not any(words[i : j + q - d] == words[i + d : j + q] for d in range(1, q)):
                found.append((i, j + q - i, q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("seed", range(6))
def test_runs_equal_the_definition(seed):
    rng = random.Random(seed)
    for _ in range(150):
        letters, words = rng.choice([1, 2, 3, 5]), []
        for _ in range(rng.randint(0, 8)):
            root = [rng.randrange(letters) for _ in range(rng.randint(1, 6))]
            words += root * rng.randint(1, 7) + root[: rng.randint(0, len(root))] + [rng.randrange(letters + 3)]
        assert [tuple(r) for r in runs.find_runs(words).tolist()] == by_definition(words)


def test_suffix_tree_knows_common_prefixes():
    rng = np.random.default_rng(3)
    text = [*rng.integers(0, 2, 300).tolist(), 9]
    tree = runs.SuffixTree(text)
    assert tree.leaves.tolist() == sorted(range(len(text)), key=lambda i: text[i:])
    a, b = rng.integers(0, 301, 400), rng.integers(0, 301, 400)
    a, b = a[a != b], b[a != b]
    for x, y, got in zip(a, b, tree.common(a, b)):
        want = next(k for k in range(301) if text[x + k] != text[y + k])
        assert got == want


def test_least_of_ranges():
    values = np.random.default_rng(1).integers(0, 1000, 5000).astype(np.int32)
    low = np.random.default_rng(2).integers(0, 5000, 2000)
    high = np.minimum(low + np.random.default_rng(3).integers(0, 3000, 2000) // np.random.default_rng(4).choice([1, 50, 3000], 2000), 4999)
    assert runs.BlockMinima(values)(low, high).tolist() == [values[a : b + 1].min() for a, b in zip(low, high)]


def test_defined_results(spark):
    rows = [(1, "x " * 7), (2, None), (2, None), (None, "a b " * 4 + "c"), (3, ""), (4, "a b a b a b a"), (5, LONG), (6, "k" + " ya" * 100_000), (7, " \t\n ")]
    found = runs.with_runs(documents(spark, rows))
    got = found.select("row.doc_id", "row.row", *[c.alias(n) for n, c in runs.run_columns().items()], "found.collapsed_text").collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and all(r.row == "row" for r in got)
    assert (by[1].n_runs, by[1].start, by[1].length, by[1].period, by[1].exponent_milli, by[1].collapsed_text) == (1, 0, 7, 1, 7000, "x")
    assert (by[None].n_runs, by[None].length, by[None].period, by[None].collapsed_text) == (1, 8, 2, "a b c")
    assert (by[6].start, by[6].length, by[6].period, by[6].collapsed_text) == (1, 100_000, 1, "k ya")
    empty = hashlib.sha256(b"").hexdigest()
    for i in (2, 3, 7):
        assert (by[i].n_runs, by[i].start, by[i].period, by[i].exponent_milli, by[i].runs_sha256, by[i].collapsed_sha256) == (0, None, None, None, empty, empty)
    assert by[4].n_runs == 0 and by[4].collapsed_text == "a b a b a b a"
    assert by[5].n_runs == len(by_definition(LONG.split())) and by[1].runs_sha256 == hashlib.sha256(b"0,7,1\n").hexdigest()
    assert runs.with_runs(documents(spark, [])).collect() == []


def test_query_equals_the_definition(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.doc_id: r for r in op12_periodic_runs(spark, sf).collect()}
    tails = 0
    for doc in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        words = (doc.text or "").encode().split()
        h, n = zlib.crc32(str(doc.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            tails += 1
        assert words == _repeating_tail((doc.text or "").encode().split(), doc.doc_id)
        want = by_definition(words) if n < 1500 else [tuple(r) for r in runs.find_runs(words).tolist()]
        gone = {i for a, length, q in want for i in range(a + q, a + length)}
        row = got[doc.doc_id]
        assert row.n_runs == len(want)
        assert row.runs_sha256 == hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in want).encode()).hexdigest()
        assert row.collapsed_sha256 == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
        if want:
            a, m, q = min(want, key=lambda r: (-r[1], r[0], r[2]))
            assert (row.start, row.length, row.period, row.exponent_milli) == (a, m, q, 1000 * m // q)
        else:
            assert (row.start, row.length, row.period, row.exponent_milli) == (None,) * 4
    assert tails > 5 and len(got) == 200
