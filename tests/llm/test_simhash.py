from __future__ import annotations

import numpy as np
import xxhash
from edges import ROWS, documents

from narrata.llm import simhash

SF = "/root/testdata/sf0.01"


def slow_print(text, k=3):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, distance=2):
    prints = [slow_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = {}
    for g, (i, _) in zip(group, rows):
        if i is not None:
            least[g] = min(least.get(g, i), i)
    return sorted((repr(i), p, repr(least.get(g))) for (i, _), p, g in zip(rows, prints, group))


def got(df):
    return sorted((repr(r["doc_id"]), r["f"] % (1 << 64), repr(r["component_id"])) for r in df.collect())


def test_edges(spark):
    assert got(simhash.near_duplicates(documents(spark))) == brute(ROWS)
    assert simhash.near_duplicates(documents(spark, [])).collect() == []


def test_blocks_and_crowds_agree_with_all_pairs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    expected = brute(rows[:400])
    some = docs.where("doc_id < 400")
    assert [r[0] for r in rows[:400]] == list(range(400))
    assert got(simhash.near_duplicates(some)) == expected
    assert got(simhash.near_duplicates(some, block_rows=1)) == expected


def test_links_of_close_values(spark):
    draw = np.random.default_rng(1)
    base = draw.integers(0, 1 << 63, 20).tolist()
    values = sorted({b ^ (1 << i) ^ (1 << j) for b in base for i, j in draw.integers(0, 63, (12, 2)).tolist()})
    prints = spark.createDataFrame([(v,) for v in values], "f bigint")
    for distance in (1, 2):
        exact = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= distance}
        found = {(r["a"], r["b"]) for r in simhash.close_links(prints, distance).collect()}
        assert found == exact
        crowd = {tuple(sorted((r["a"], r["b"]))) for r in simhash.close_links(prints, distance, block_rows=1).collect()}
        reach = {v: v for v in values}
        for a, b in crowd:
            old, new = reach[a], reach[b]
            reach = {k: new if x == old else x for k, x in reach.items()}
        assert all(reach[a] == reach[b] for a, b in exact)


def test_one_of_each_group_stays(spark):
    left = simhash.keep_one(documents(spark), shingle=3, distance=2)
    assert left.columns == documents(spark).columns
    ids = [r["doc_id"] for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [1, 2, 5, 6, 8, 9] and ids.count(None) == 2


def test_rows_that_repeat_an_id_are_judged_by_their_own_text(spark):
    x, y, z = ("some quite long text about one thing " * 4, "another text of other words entirely here " * 4, "the third one has its own words too " * 4)
    rows = [(1, x), (5, y), (5, x), (5, y), (7, z), (7, x), (8, z)]
    for order in (rows, rows[::-1]):
        left = simhash.keep_one(documents(spark, order).repartition(3), shingle=3, distance=2)
        assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(1, x), (5, y), (7, z)]
