"""Document quality: random-indexing word vectors, pooled per document, and a two-layer network.

Every token has an index vector, sparse and ternary, drawn from the token's hash bucket. The words that are
frequent in the labelled texts also have a context vector: the sum of the index vectors that
stood within ``REACH`` places of them. A document is the mean of its tokens' vectors, with the length of the mean index
vector (large where few words repeat), the shares of repeated near neighbours and of capitals, and its length. The network's
logit is divided by a temperature fitted on labelled documents it was not trained on.

The fit uses at most ``rows`` labelled documents. Scores are of whole texts.
Null and empty texts have the features of no tokens and a score like any other. Without
labels of both kinds every score is the share of ones (0.5 without labels). The
column form reads nothing but the text, so other columns never clash; repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.base import Sent, labelled_rows

DIMS = 48
ONES = 6  # entries of an index vector
BUCKETS = 4096
REACH = 2
WIDTH = DIMS + 5  # features of a document
SLICE = 300_000  # tokens pooled at once
CACHE = 300_000
TOKEN = re.compile(r"\w+|[^\w\s]+")


def index_vectors() -> np.ndarray:
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for b in range(BUCKETS):
        draw = np.random.default_rng(b)
        out[b, draw.choice(DIMS, ONES, replace=False)] = draw.choice((-1.0, 1.0), ONES)
    return out / np.sqrt(ONES)


class Numbers(dict):
    """Token -> row: of its word if frequent, else of its bucket after those. Holds at most CACHE tokens."""

    def __init__(self, words: dict[str, int]):
        self.words = words

    def __missing__(self, token: str) -> int:
        low = token.lower()
        at = self.words.get(low)
        if at is None:
            at = len(self.words) + zlib.crc32(low.encode("utf-8", "replace")) % BUCKETS
        at = 2 * at + (token.isupper() and len(token) > 1)
        if len(self) < CACHE and len(token) < 64:
            self[token] = at
        return at


def _slices(texts: list[str | None], numbers: Numbers) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, capitals, sizes) of consecutive texts, about SLICE tokens at once."""
    held, sizes, n = [], [], 0
    for i, t in enumerate(texts):
        tokens = TOKEN.findall(t or "")
        held.append(np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens)))
        sizes.append(len(tokens))
        n += len(tokens)
        if n >= SLICE or i == len(texts) - 1:
            codes = np.concatenate(held)
            yield codes >> 1, codes & 1, np.array(sizes)
            held, sizes, n = [], [], 0


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Sum of each text's rows; texts without rows have zero."""
    out = np.zeros((len(sizes), *values.shape[1:]), np.float64)
    full = sizes > 0
    if full.any():
        starts = (np.cumsum(sizes) - sizes)[full]
        out[full] = np.add.reduceat(values, starts, axis=0)
    return out


def features(texts: list[str | None], numbers: Numbers, vectors: np.ndarray, plain: np.ndarray) -> np.ndarray:
    out = [np.zeros((0, WIDTH))]
    for rows, capitals, sizes in _slices(texts, numbers):
        n = np.maximum(sizes, 1)
        mean = np.empty((len(sizes), DIMS))
        spread = np.zeros(len(sizes))
        for d in range(0, DIMS, 16):
            part = slice(d, d + 16)
            mean[:, part] = _sums(vectors[:, part][rows], sizes) / n[:, None]
            spread += ((_sums(plain[:, part][rows], sizes) / n[:, None]) ** 2).sum(1)
        text, again = np.repeat(np.arange(len(sizes)), sizes), []
        for k in (1, 2):  # the same token before this one, or before the one between (a full stop, say)
            same = np.zeros(len(rows))
            same[k:] = (rows[k:] == rows[:-k]) & (text[k:] == text[:-k])
            again.append(_sums(same, sizes) / n)
        extra = [np.sqrt(spread), *again, _sums(capitals, sizes) / n, np.log1p(sizes) / 10]
        out.append(np.column_stack([mean, *extra]))
    return np.concatenate(out)


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.centre) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -50, 50)))


def train_network(x: np.ndarray, y: np.ndarray, hidden: int = 24, rounds: int = 600, rate: float = 0.01, decay: float = 1e-4) -> Network:
    """Adam on the log loss over four fifths of the rows; the temperature is the best for the rest."""
    dims = x.shape[1]
    if not len(y) or y.min() == y.max():
        share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if len(y) else 0.5
        return Network(np.zeros(dims), np.ones(dims), np.zeros((dims, 1)), np.zeros(1), np.zeros(1), np.log(share / (1 - share)))
    draw = np.random.default_rng(8)
    order = draw.permutation(len(y))
    fit, rest = order[len(y) // 5 :], order[: len(y) // 5]
    centre, scale = x[fit].mean(0), x[fit].std(0) + 1e-6
    net = Network(centre, scale, draw.normal(0, dims**-0.5, (dims, hidden)), np.zeros(hidden), draw.normal(0, hidden**-0.5, hidden), 0.0)
    z, t = (x[fit] - centre) / scale, y[fit]
    params = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    batch = max(64, len(t) // 8)
    for step in range(1, rounds + 1):
        i = draw.choice(len(t), min(batch, len(t)), replace=False)
        h = np.tanh(z[i] @ params[0] + params[1])
        gap = (1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -50, 50))) - t[i]) / len(i)
        back = gap[:, None] * params[2] * (1 - h * h)
        grads = [z[i].T @ back + decay * params[0], back.sum(0), h.T @ gap + decay * params[2], np.array([gap.sum()])]
        for p, g, m, v in zip(params, grads, first, second):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = params[0], params[1], params[2], float(params[3][0])
    held = net.logits(x[rest]) if len(rest) else np.zeros(0)
    choices = np.exp(np.linspace(-1.5, 2.5, 81))
    losses = [np.logaddexp(0, -np.where(y[rest] > 0.5, held, -held) / c).mean() if len(rest) else 0.0 for c in choices]
    net.temperature = float(choices[int(np.argmin(losses))])
    return net


@dataclass
class Model:
    words: dict[str, int]
    vectors: np.ndarray
    plain: np.ndarray
    network: Network | None = None


def _contexts(send):
    """Sums of the index vectors around each frequent word, one matrix per task."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = send.value
        numbers, total = Numbers(model.words), np.zeros((len(model.words), DIMS))
        columns = np.ascontiguousarray(model.plain.T)
        for batch in batches:
            for rows, _, sizes in _slices(batch.column("t").to_pylist(), numbers):
                text = np.repeat(np.arange(len(sizes)), sizes)
                inside = {k: text[k:] == text[:-k] for k in range(1, REACH + 1)}
                own = np.nonzero(rows < len(model.words))[0]
                words = rows[own]
                for d in range(DIMS):  # one at a time: all of a slice's index vectors at once are hundreds of MB
                    near = np.zeros(len(rows), np.float32)
                    for k, same in inside.items():
                        near[k:] += columns[d][rows[:-k]] * same
                        near[:-k] += columns[d][rows[k:]] * same
                    total[:, d] += np.bincount(words, near[own], len(model.words))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    return add


def _featurer(send):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = send.value
        numbers = Numbers(model.words)
        for batch in batches:
            x = features(batch.column("t").to_pylist(), numbers, model.vectors, model.plain)
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    return of


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = 6000, words: int = 10_000) -> Model:
    """Word vectors and network from at most ``rows`` labelled texts and at most ``words`` frequent words."""
    spark = docs.sparkSession
    known = labelled_rows(docs, labels, label, rows).coalesce(4)
    tokens = known.select(F.explode(F.array_distinct(F.expr(r"regexp_extract_all(lower(t), '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]+', 0)"))).alias("w"))
    top = tokens.where("length(w) < 40").groupBy("w").agg(F.count("*").alias("n")).where("n >= 5").orderBy(F.desc("n"), "w").limit(words)
    number = {r["w"]: i for i, r in enumerate(top.collect())}
    index = index_vectors()
    rows_of = [zlib.crc32(w.encode()) % BUCKETS for w in number]
    plain = np.concatenate((index[rows_of], index))
    model = Model(number, plain, plain)
    sums = known.select("t").mapInArrow(_contexts(Sent(spark, model)), "sums binary").collect()
    total = sum((np.frombuffer(r["sums"]).reshape(-1, DIMS) for r in sums), np.zeros((len(number), DIMS)))
    size = np.linalg.norm(total, axis=1, keepdims=True)
    vectors = plain.copy()
    vectors[: len(number)] += total / np.where(size > 0, size, 1)
    model = Model(number, vectors.astype(np.float32), plain)
    table = known.select("t", "y").mapInArrow(_featurer(Sent(spark, model)), "y double, x array<double>").collect()
    x = np.array([r["x"] for r in table]).reshape(len(table), WIDTH)
    model.network = train_network(x, np.array([r["y"] for r in table]))
    return model


def scorer(docs: DataFrame, model: Model):
    """A column function: the probability of label 1, from the whole text."""
    send = Sent(docs.sparkSession, model)

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        numbers = Numbers(send.value.words)
        for texts in batches:
            x = features(texts.to_pylist(), numbers, send.value.vectors, send.value.plain)
            yield pa.array(send.value.network.scores(x), pa.float64())

    of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(of, "double")


def with_score(docs: DataFrame, model: Model, column: str) -> DataFrame:
    """``docs`` and a column of scores; replaces a column of that name."""
    return docs.withColumn(column, scorer(docs, model)(F.col("text")))
