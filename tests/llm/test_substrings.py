from __future__ import annotations

import hashlib

import numpy as np
import pytest
from edges import ROWS, documents

from narrata.llm import substrings
from narrata.llm.fmindex import FMIndex, suffix_order

SF = "/root/testdata/sf0.01"


def brute(rows, window=50):
    first, words = {}, []
    for i, t in rows:
        words.append((t or "").encode().split())
        order = 1 << 63 if i is None else i
        for s in range(len(words[-1]) - window + 1):
            k = hashlib.md5(b" ".join(words[-1][s : s + window])).digest()
            first[k] = min(first.get(k, order), order)
    out = []
    for (i, _), w in zip(rows, words):
        gone = [False] * len(w)
        order = 1 << 63 if i is None else i
        for s in range(len(w) - window + 1):
            if first[hashlib.md5(b" ".join(w[s : s + window])).digest()] < order:
                gone[s : s + window] = [True] * window
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((repr(i), len(w), sum(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((repr(r["row"]["doc_id"]), r["cut"]["n_words"], r["cut"]["n_removed"], r["cut"]["kept_sha256"]) for r in df.collect())


def passages(n=120):
    draw = np.random.default_rng(3)
    shared = [" ".join(f"s{k}x{i}" for i in range(70)) for k in range(3)]
    fresh = lambda m: " ".join(f"v{x}" for x in draw.integers(0, 5000, m))
    rows = [(i, " ".join([fresh(30), shared[i % 3], fresh(20), shared[(i + 1) % 3] if i % 4 == 0 else "", fresh(9)])) for i in range(n)]
    return rows + [(n, shared[0] + " " + shared[0] + " end"), (n + 1, "again " * 300), (n + 2, "again " * 200 + "x"), (None, rows[5][1])]


@pytest.mark.parametrize("most", [512, 1])
def test_equals_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(substrings, "KEY_PASSAGES", most)
    rows = passages() + [(200, substrings_text) for substrings_text in (ROWS[7][1], ROWS[7][1] + " more")]
    assert got(substrings.strip_repeats(documents(spark, rows))) == brute(rows)


def test_edges(spark):
    assert got(substrings.strip_repeats(documents(spark))) == brute(ROWS)
    assert substrings.strip_repeats(documents(spark, [])).collect() == []
    kept = {r["row"]["doc_id"]: r["cut"]["kept_text"] for r in substrings.strip_repeats(documents(spark)).collect()}
    assert kept[4] == " \t\n " and kept[2] is None


def test_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert got(substrings.strip_repeats(docs)) == brute(rows)


def test_index_against_search():
    draw = np.random.default_rng(2)
    parts = [draw.integers(0, 4, n).astype(np.uint64) for n in (30, 1, 25, 40)]
    owner = np.array([5, 1, 3, 9])
    index = FMIndex(np.concatenate(parts), np.array([len(p) for p in parts]), owner)
    assert sorted(suffix_order(index.text).tolist()) == list(range(len(index.text)))
    lists = [p.tolist() for p in parts]
    for part, below in ((0, 5), (2, 4), (3, 9)):
        w = lists[part]
        for end in range(6, len(w) + 1):
            smaller = [lists[k] for k in range(4) if owner[k] < below]
            best = max(n for n in range(7) if n == 0 or any(o[i : i + n] == w[end - n : end] for o in smaller for i in range(len(o) - n + 1)))
            found = index.matching(np.array([index.starts[part] + end]), np.array([below]), 6)
            assert found[0] == best
