"""Language model, quality, toxicity and URL models."""

from __future__ import annotations

import itertools
import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from edges import ROWS, documents, labels
from pyspark.sql import functions as F

from narrata.llm import queries, quality, suffix_tree, toxicity, urls

SF = "/root/testdata/sf0.01"


def base_of(rows, trained):
    words = [[*(t or "").encode().lower().split(), None] for _, t in rows]
    c = Counter(w for ws, k in zip(words, trained) if k for w in ws)
    n, v = sum(c.values()), len(c)
    return n, [(len(ws), sum(w in c for w in ws), math.fsum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws)) for ws in words]


def test_contexts_hold_little_at_once():
    """The sums of a large slice, without the index vectors of all its tokens at once."""
    draw = np.random.default_rng(1)
    words = {f"w{i}": i for i in range(500)}
    index = quality.index_vectors()
    plain = np.concatenate((index[[zlib.crc32(w.encode()) % quality.BUCKETS for w in words]], index))
    texts = [" ".join(f"w{i}" for i in draw.integers(0, 700, n)) for n in (0, 1, 2, 3, 150_000, 160_000)]

    class Given:
        value = quality.Model(words, plain, plain)

    tracemalloc.start()
    (out,) = quality._contexts(Given)(iter([pa.record_batch({"t": pa.array(texts)})]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    got = np.frombuffer(out.column(0)[0].as_py()).reshape(-1, quality.DIMS)
    expected = np.zeros_like(got)
    for text in texts:
        rows = np.array([quality.Numbers(words)[t] >> 1 for t in text.split()], int)
        near = np.zeros((len(rows), quality.DIMS))
        for k in (1, 2):
            near[k:] += plain[rows[:-k]]
            near[:-k] += plain[rows[k:]]
        np.add.at(expected, rows[rows < 500], near[rows < 500])
    assert np.allclose(got, expected, atol=1e-2) and peak < 120e6


def test_suffix_tree_edges(spark):
    docs = documents(spark)
    for frequent in (100_000, 1):
        got = suffix_tree.score_documents(docs, folds=7, held_out=2, frequent=frequent).collect()
        trained = [i is None or zlib.crc32(str(i).encode()) % 7 != 2 for i, _ in ROWS]
        n, expected = base_of(ROWS, trained)
        assert {r["train_tokens"] for r in got} == {n} and all(r["score"] < 0 for r in got)
        key = lambda x: (x[0], x[1], round(x[2], 4))
        assert sorted(key((r["n_tokens"], r["n_known"], r["base_score"])) for r in got) == sorted(map(key, expected))
    assert suffix_tree.score_documents(documents(spark, []), 7, 2).collect() == []
    nothing = suffix_tree.score_texts(docs, docs.limit(0)).where("n_tokens = 1").first()
    assert nothing["n_known"] == 0 and nothing["train_tokens"] == 0 and abs(nothing["score"] - math.log10(0.5 + 0.5 / suffix_tree.SYMBOLS)) < 1e-5


def test_suffix_tree_counts_and_states(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    depth, share = 6, 3e-4
    train = docs.where("doc_id < 300")
    lines = [r["text"].encode().lower().split() for r in train.select("text").collect()]
    counted = train.select("text").mapInArrow(suffix_tree._count_shallow(depth - 2), suffix_tree.KINDS)
    windows = counted.where("w is not null").groupBy("w").agg(F.sum("n").alias("n"))
    tree = suffix_tree.fit_tree(windows, train, depth, share, 1.0)
    counts: dict[bytes, Counter] = {}
    total = 0
    for words in lines:
        line = b" " * depth + b" ".join([*words, b"\n"])
        for p in range(depth, len(line)):
            total += 1
            for j in range(depth + 1):
                counts.setdefault(line[p - j : p], Counter())[line[p]] += 1

    def gain(c):
        own, short = counts[c], counts[c[1:]]
        n, m = sum(own.values()), sum(short.values())
        return sum(x * math.log(x / n * m / short[s]) for s, x in own.items())

    # contexts of spaces only reach before the text and are left to the shallower levels
    kept = {c: counts[c] for c in counts if not c or (sum(counts[c].values()) >= share * total and gain(c) > math.log(total) and not (len(c) >= depth - 1 and c[-(depth - 1) :].startswith(b"  ")))}
    slow = suffix_tree.Automaton({c: dict(n) for c, n in kept.items()})
    stream, _, real = suffix_tree._stream(lines[:40], depth)
    assert np.allclose(tree.logs(stream, depth)[real], slow.logs(stream, depth, piece=97)[real], atol=2e-2)
    assert abs(tree.logs(stream, depth)[real].sum() / slow.logs(stream, depth)[real].sum() - 1) < 1e-3
    prob = 10.0 ** tree.log.reshape(-1, tree.width)
    unseen = suffix_tree.SYMBOLS - (tree.width - 1)
    assert np.allclose(prob[:, :-1].sum(1) + unseen * prob[:, -1], 1, atol=1e-4)


def test_suffix_tree_holds_little_at_once(monkeypatch):
    """Counts and scores of many texts in one batch: the same as of all at once, in less memory."""
    draw = np.random.default_rng(2)
    words = np.array([f"{x:07x}" for x in draw.integers(0, 1 << 28, 5_000)])
    texts = ["", None, *(" ".join(words[draw.integers(0, 5_000, n)]) for n in (1, 2, *[15_000] * 32)), ""]
    depth, n = 6, len(texts)
    batch = pa.record_batch({"rid": pa.array(range(n)), "doc_id": pa.array(range(n)), "text": pa.array(texts)})

    class Given:
        def __init__(self, value):
            self.value = value

    stream, _, real = suffix_tree._stream([(t or "").encode().split() for t in texts[:6]], depth)
    counts: dict[bytes, dict[int, int]] = {b"": {}}
    for p in np.flatnonzero(real).tolist():
        for j in range(4):
            own = counts.setdefault(stream[p - j : p].tobytes(), {})
            own[int(stream[p])] = own.get(int(stream[p]), 0) + 1
    tree = Given(suffix_tree.Automaton(counts))
    known = Given({w.encode(): 5.0 for w in words.tolist()[:4_000]})
    common = np.unique(suffix_tree._packed(stream, depth - 1)[::3])
    passes = [
        suffix_tree._count_shallow(depth - 2),
        suffix_tree._count_deep(depth, Given(common)),
        suffix_tree._count_deep(depth, Given(common[:0])),
        suffix_tree._scorer(tree, known, depth, 9_999, 7, 0.5),
    ]

    def counted(out):
        got: Counter = Counter()
        for b in out:
            keys, spoken, times = (b.column(i).to_pylist() for i in range(3))
            for k, w, c in zip(keys, spoken, times):
                got[k if w is None else w] += c
        return got

    def run(most=None):
        out = []
        for f in passes:
            tracemalloc.start()
            out.append(list(f(iter([batch]))))
            peak = tracemalloc.get_traced_memory()[1]
            tracemalloc.stop()
            assert most is None or peak < most
        return [*map(counted, out[:3]), [r for b in out[3] for r in b.to_pylist()]]

    usual = run(80e6)
    monkeypatch.setattr(suffix_tree, "KEYS_HELD", 50_000)  # so that counts are handed out now and then
    often = run(80e6)
    monkeypatch.setattr(suffix_tree, "SLICE_BYTES", 1 << 30)
    monkeypatch.setattr(suffix_tree, "KEYS_HELD", 1 << 30)
    whole = run()
    assert whole[:3] == usual[:3] == often[:3] and len(whole[0]) > 10_000 and len(whole[1]) > 10_000 and not whole[2]
    assert [r["rid"] for r in whole[3]] == list(range(n))
    for x, y in zip(whole[3], usual[3], strict=True):
        logs = [[r.pop("log") for r in z.pop("rest")] for z in (x, y)]
        assert np.allclose(*logs, atol=1e-6) and np.allclose([*x.values()], [*y.values()], rtol=1e-9)


def test_suffix_tree_beats_the_base_on_held_out_texts(spark):
    r = queries.QUERIES["op3_suffix_tree_lm"](spark, SF).where("held_out").agg(F.avg("score"), F.avg("base_score")).first()
    assert r[0] > r[1]


def test_quality(spark):
    known = spark.read.parquet(f"{SF}/labels.parquet")
    r = queries.QUERIES["op8_quality_classifier"](spark, SF)
    assert r.count() == 1000 and r.where("score < 0 or score > 1").count() == 0
    right = r.join(known, "doc_id").groupBy("held_out").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("share")).collect()
    assert all(x["share"] > 0.93 for x in right)
    docs = documents(spark)
    for table in (labels(spark), labels(spark, [(1, 1, 0)]), labels(spark, [(None, None, None)])):
        got = quality.with_score(docs, quality.fit(docs, table), "score").collect()
        assert len(got) == len(ROWS) and all(0 <= x["score"] <= 1 for x in got)
    assert quality.with_score(documents(spark, []), quality.fit(documents(spark, []), labels(spark)), "score").count() == 0


def test_temperature_and_network_fit():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(2000, 6))
    y = (draw.random(2000) < 1 / (1 + np.exp(-3 * x[:, 0] * x[:, 1]))).astype(float)
    net = quality.train_network(x, y)
    p = net.scores(x)
    assert ((p > 0.5) == (y > 0.5)).mean() > 0.7
    assert abs(p.mean() - y.mean()) < 0.08


def test_marginals_equal_enumeration():
    draw = np.random.default_rng(4)
    field = toxicity.Field(np.zeros(1), draw.normal(size=(2, 2)), 0.7)
    lengths = np.array([4, 1, 6])
    emission = draw.normal(size=11)
    got = toxicity.marginals(emission, lengths, field)
    at = 0
    for n in lengths:
        total, on = 0.0, np.zeros(n)
        for tags in itertools.product((0, 1), repeat=int(n)):
            w = field.start * tags[0] + sum(emission[at + i] for i in range(n) if tags[i]) + sum(field.moves[a, b] for a, b in zip(tags, tags[1:]))
            total += math.exp(w)
            on += np.array(tags) * math.exp(w)
        assert np.allclose(got[at : at + n], on / total)
        at += n


def test_toxicity(spark):
    known = spark.read.parquet(f"{SF}/labels.parquet")
    r = queries.QUERIES["op2_toxicity"](spark, SF).cache()
    assert r.count() == 1000 and r.where("score < 0 or score > 1").count() == 0
    x = r.join(known, "doc_id").agg(F.avg((F.col("predicted") == F.col("toxic")).cast("double")), F.avg(F.when(F.col("toxic") == 0, F.col("predicted")))).first()
    assert x[0] > 0.9 and x[1] < 0.03
    texts = {d["doc_id"]: d["text"] for d in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for row in r.where("n_spans > 0").limit(20).collect():
        assert all(texts[row["doc_id"]].lower()[s["begin"] : s["end"]].isalpha() for s in row["spans"])
    docs = documents(spark)
    for table in (labels(spark), labels(spark, [(1, 1, 0)]), labels(spark, [(None, None, None)])):
        got = toxicity.with_judgement(docs, toxicity.fit(docs, table), "judged").collect()
        assert len(got) == len(ROWS) and all(0 <= x["judged"]["score"] <= 1 for x in got)
    assert toxicity.with_judgement(documents(spark, []), toxicity.fit(documents(spark, []), labels(spark)), "judged").count() == 0


def test_urls(spark):
    rules = queries.URL_RULES
    cases = {
        "http://A.Example.NET/en/1?x#y": ("a.example.net", "/en/1", "example.net/en/"),
        "x://badexample.net/en/": ("badexample.net", "/en/", "net/"),
        "https://net/": ("net", "/", "net/"),
        "https://www.example.com/de/": ("www.example.com", "/de/", "example.com/de/"),
        "https://www.example.com/fr/": ("www.example.com", "/fr/", None),
        "a://b.org/fr/c://d": ("b.org", "/fr/c://d", "org/fr/"),
        "a://b.net?q=/": ("b.net", "", None),
        "no scheme": ("", "", None),
        "": ("", "", None),
        "x://É.ORG/Fr/\n/z": ("É.org", "/Fr/\n/z", None),
    }
    rows = [(i, u, "h", "p", "r") for i, u in enumerate(cases)] + [(None, None, "h", "p", "r"), (0, next(iter(cases)), "h", "p", "r")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, host string, path string, rule string")
    got = {(r["page_id"]): r for r in urls.judge(pages, rules).collect()}
    for i, (host, path, rule) in enumerate(cases.values()):
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, rule)
        assert got[i]["verdict"] == (dict((r, v) for v, r in rules)[rule] if rule else got[i]["verdict"])
    assert urls.judge(pages, rules).count() == len(rows) and urls.judge(pages.limit(0), rules).collect() == []
    labelled = spark.createDataFrame([(f"http://{k}{i}.example.com/{k}/{i}", int(k == "spam")) for k in ("spam", "fine") for i in range(60)], "url string, y int")
    fresh = spark.createDataFrame([(1, "http://spam99.example.com/spam/7"), (2, "http://fine99.example.com/fine/7")], "page_id bigint, url string")
    assert [r["verdict"] for r in urls.judge(fresh, rules, labelled).orderBy("page_id").collect()] == ["block", "allow"]


def test_offsets_are_of_the_given_text(monkeypatch):
    """Some characters are longer in lower case."""
    text = "İİ hate İyou"
    n = len(toxicity.SPAN.findall(text.lower()))
    monkeypatch.setattr(toxicity, "tagged", lambda texts, emissions: [(np.ones(n), np.array([n]))])
    field = toxicity.Field(np.zeros(1), np.zeros((2, 2)), 0.0)
    field.document = np.zeros(5)
    [judged] = toxicity.judged(field, [text], None)
    read = [text[s["begin"] : s["end"]] for s in judged["spans"]]
    assert len(read) == n and "hate" in read and read[-1].endswith("you") and all(w in text.split() or w in text for w in read) and " " not in "".join(read)


def test_labelled_urls_are_the_first_by_hash(spark):
    known = spark.range(5000).select(F.concat(F.lit("h"), F.col("id") % 900).alias("host"), F.col("id").cast("string").alias("path"), (F.col("id") % 2).cast("double").alias("y"))
    known = known.unionByName(known.limit(40)).repartition(7)
    whole = known.orderBy(F.xxhash64("host", "path"), "host", "path", "y")
    for rows in (1, 50, 3000, 9000):
        assert urls._first_by_hash(known, rows) == whole.limit(rows).collect()
    assert urls._first_by_hash(known.limit(0), 5) == []
