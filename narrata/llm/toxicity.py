"""Toxic spans and document scores from a linear-chain conditional random field.

Labels are of documents, so tokens are labelled from them first: a word, or a beginning of four to eight letters that words go beyond, which
occurs in at least ``SEEN`` toxic documents and hardly ever in others marks its tokens in toxic documents; all other
tokens are clean. The field has the tags clean and toxic, emissions from hashed forms of the word and transitions between neighbours. A
chain is a sentence, or ``CHAIN`` words of a longer one. Forward-backward marginals of all words of a document
(the largest, their sum, how many are offending, the number of words) give its score by a logistic regression on
labelled documents; words with a marginal of one half or more are the offending spans.

The fit uses at most ``rows`` labelled documents and ``chains`` sentences of them. Scores are of whole texts.
Null and empty texts have no words and a score like any other. Without labels of both
kinds every score is the share of toxic labels (0 without labels). Only the text is read;
repeated rows score alike.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrata.llm.base import Sent, labelled_rows
from narrata.shared import cut

CHAIN = 256
SLICE = 400_000  # words tagged at once
CACHE = 300_000
BUCKETS = 1 << 16
STEMS = (4, 5, 6, 7, 8)  # letters of a beginning
LONGEST = 40  # letters of a word that count
SEEN, PURE = 8, 0.6
TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
SPAN = re.compile(r"[^\W\d_]+")
BREAKS = frozenset(".!?\n")


def forms(word: str) -> list[str]:
    """What marks a word: itself, and each beginning that it goes beyond."""
    return ["=" + word[:LONGEST], *[word[:k] + "-" for k in STEMS if len(word) > k]]


def buckets(word: str) -> list[int]:
    """One bucket per form; forms that a short word lacks share the last bucket."""
    own = [zlib.crc32(f.encode("utf-8", "replace")) % (BUCKETS - 1) for f in forms(word)]
    return own + [BUCKETS - 1] * (len(STEMS) + 1 - len(own))


@dataclass
class Field:
    """Emission weights by bucket for the tag toxic over clean, transitions [from, to], and the start."""

    weights: np.ndarray
    moves: np.ndarray
    start: float
    document: np.ndarray | None = None  # logistic weights of _summary

    def emission(self, word: str) -> float:
        return float(sum(self.weights[b] for b in buckets(word)))


def chains_of(breaks: np.ndarray) -> np.ndarray:
    """Lengths of chains, given for each word whether a new sentence starts with it."""
    if not len(breaks):
        return np.zeros(0, np.int64)
    first = np.flatnonzero(breaks)
    since = np.arange(len(breaks)) - first[np.cumsum(breaks) - 1]
    return np.diff(np.append(np.flatnonzero(since % CHAIN == 0), len(breaks)))


def forward_backward(emission: np.ndarray, lengths: np.ndarray, moves: np.ndarray, start: float):
    """Ratios toxic to clean of the forward and backward sums, all chains side by side, one place at a time.

    ``emission`` has the chains one after the other. The marginal of a place is r b / (1 + r b).
    """
    e = np.exp(np.clip(emission, -30, 30))
    m = np.exp(moves)
    order = np.argsort(-lengths, kind="stable")
    begins = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    r, b = np.empty(len(e)), np.ones(len(e))
    longest = int(sizes[0]) if len(sizes) else 0
    alive = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains longer than t
    if longest:
        r[begins] = e[begins] * np.exp(start)
    for t in range(1, longest):
        at = begins[: alive[t]] + t
        before = r[at - 1]
        r[at] = np.clip(e[at] * (m[0, 1] + before * m[1, 1]) / (m[0, 0] + before * m[1, 0]), 1e-30, 1e30)
    for t in range(longest - 1, 0, -1):
        at = begins[: alive[t]] + t
        after = e[at] * b[at]
        b[at - 1] = (m[1, 0] + after * m[1, 1]) / (m[0, 0] + after * m[0, 1])
    return e, r, b


def marginals(emission: np.ndarray, lengths: np.ndarray, field: Field) -> np.ndarray:
    _, r, b = forward_backward(emission, lengths, field.moves, field.start)
    return r * b / (1 + r * b)


def train_field(words: list[list[str]], tags: list[np.ndarray], rounds: int = 60, rate: float = 0.3, decay: float = 1e-5) -> Field:
    """Adagrad on the conditional likelihood of whole chains."""
    field = Field(np.zeros(BUCKETS), np.zeros((2, 2)), 0.0)
    if not words:
        return field
    lengths = np.array([len(w) for w in words])
    known = {w: buckets(w) for w in {x for c in words for x in c}}
    at = np.array([known[x] for c in words for x in c])
    y = np.concatenate(tags).astype(np.float64)
    begins = np.cumsum(lengths) - lengths
    inner = np.ones(len(y), bool)
    inner[begins] = False
    now = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[now - 1].astype(int), y[now].astype(int)), 1)
    sums = [np.full(BUCKETS, 1e-8), np.full((2, 2), 1e-8), 1e-8]
    field.weights[:] = 0
    for _ in range(rounds):
        e, r, b = forward_backward(field.weights[at].sum(1), lengths, field.moves, field.start)
        p = r * b / (1 + r * b)
        m = np.exp(field.moves)
        before, after = r[now - 1], e[now] * b[now]
        parts = np.stack([np.full(len(now), m[0, 0]), m[0, 1] * after, before * m[1, 0], before * m[1, 1] * after])
        expected = (parts / parts.sum(0)).sum(1).reshape(2, 2)
        gap = y - p
        grads = [np.bincount(at.ravel(), np.repeat(gap, at.shape[1]), BUCKETS) - decay * len(y) * field.weights, seen - expected - 0.01 * field.moves, gap[begins].sum() - 0.01 * field.start]
        steps = []
        for i, g in enumerate(grads):
            sums[i] = sums[i] + g * g
            steps.append(rate * g / np.sqrt(sums[i]))
        field.weights += steps[0]
        field.moves += steps[1]
        field.start += float(steps[2])
    return field


class Emissions(dict):
    """Word -> emission; a sentence break -> NaN. Holds at most CACHE words."""

    def __init__(self, field: Field):
        self.field = field

    def __missing__(self, word: str) -> float:
        value = float("nan") if word in BREAKS else self.field.emission(word)
        if len(self) < CACHE and len(word) < 64:
            self[word] = value
        return value


def tagged(texts: list[str | None], emissions: Emissions) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(marginals of the words of all, number of words of each) of consecutive texts, about SLICE words at once."""
    field, held, n = emissions.field, [], 0
    for i, t in enumerate(texts):
        tokens = TOKEN.findall((t or "").lower())
        held.append(np.fromiter(map(emissions.__getitem__, tokens), np.float64, len(tokens)))
        n += len(tokens)
        if n < SLICE and i < len(texts) - 1:
            continue
        values = np.concatenate(held)
        text = np.repeat(np.arange(len(held)), [len(h) for h in held])
        word = ~np.isnan(values)
        place = np.flatnonzero(word)
        owner = text[place]
        new = np.ones(len(place), bool)
        new[1:] = (place[1:] != place[:-1] + 1) | (owner[1:] != owner[:-1])
        yield marginals(values[place], chains_of(new), field), np.bincount(owner, minlength=len(held))
        held, n = [], 0


def _summary(p: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each text: 1, logit of the largest marginal, logs of their sum, of the offending words and of all words."""
    full = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[full]
    largest, total, spans = np.full(len(sizes), 1e-9), np.zeros(len(sizes)), np.zeros(len(sizes))
    if len(starts):
        largest[full] = np.clip(np.maximum.reduceat(p, starts), 1e-9, 1 - 1e-9)
        total[full] = np.add.reduceat(p, starts)
        spans[full] = np.add.reduceat((p >= 0.5).astype(float), starts)
    return np.column_stack([np.ones(len(sizes)), np.log(largest / (1 - largest)) / 5, np.log1p(total), np.log1p(spans), np.log1p(sizes) / 10])


def _labelled_chains(marks):
    """Sentences of labelled texts with the tags their marks give them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = marks.value
        for batch in batches:
            rows = []
            for y, text in zip(batch.column("y").to_pylist(), batch.column("t").to_pylist()):
                for sentence in re.split(r"[.!?\n]", text.lower()):
                    words = SPAN.findall(sentence)
                    for k in range(0, len(words), CHAIN):
                        own = [w[:LONGEST] for w in words[k : k + CHAIN]]
                        tags = [int(y > 0.5 and not known.isdisjoint(forms(w))) for w in own]
                        rows.append((own, tags, max(tags), zlib.crc32(" ".join(own).encode("utf-8", "replace"))))
            columns = zip(*rows) if rows else [()] * 4
            kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["words", "tags", "toxic", "draw"])

    return of


def _forms_column(text):
    words = F.expr(r"array_distinct(regexp_extract_all(lower(t), '\\p{L}+', 0))")
    kinds = [F.transform(words, lambda w: F.concat(F.lit("="), F.substring(w, 1, LONGEST)))]
    for k in STEMS:
        longer = F.filter(words, lambda w, k=k: F.length(w) > k)
        kinds.append(F.transform(longer, lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("-"))))
    return F.array_distinct(F.concat(*kinds))


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(x.shape[1])
        w += np.linalg.solve(h, x.T @ (y - p) - 0.1 * w)
    return w


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = 8000, chains: int = 12_000) -> Field:
    """The field and the document regression from at most ``rows`` labelled texts and ``chains`` sentences."""
    spark = docs.sparkSession
    known = labelled_rows(docs, labels, label, rows)
    once = known.select("t", "y").dropDuplicates()
    counts = once.select("y", F.explode(_forms_column(F.col("t"))).alias("form")).groupBy("form").agg(F.sum("y").alias("bad"), F.count("*").alias("n"))
    marks = counts.where((F.col("bad") >= SEEN) & (F.col("bad") >= PURE * F.col("n"))).orderBy(F.desc("bad"), "form").limit(20_000)
    send = partial(Sent, spark)
    sentences = cut(known.select("t", "y").mapInArrow(_labelled_chains(send(frozenset(r["form"] for r in marks.collect()))), "words array<string>, tags array<int>, toxic int, draw bigint"), "sentences")
    chosen = [r for k in (1, 0) for r in sentences.where(F.col("toxic") == k).orderBy("draw").limit(chains // 2).collect()]
    field = train_field([r["words"] for r in chosen], [np.array(r["tags"]) for r in chosen])
    table = known.select("t", "y").mapInArrow(_summaries(send(field)), "y double, x array<double>").collect()
    x, y = np.array([r["x"] for r in table]).reshape(len(table), 5), np.array([r["y"] for r in table])
    if len(y) and y.min() < y.max():
        field.document = _logistic(x, y)
    else:
        share = float(np.clip(y.mean(), 1e-9, 1 - 1e-9)) if len(y) else 1e-9
        field.document = np.array([np.log(share / (1 - share)), 0.0, 0.0, 0.0, 0.0])
    return field


def _summaries(send):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emissions = Emissions(send.value)
        for batch in batches:
            x = np.concatenate([np.zeros((0, 5)), *[_summary(*s) for s in tagged(batch.column("t").to_pylist(), emissions)]])
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(list(x), pa.list_(pa.float64()))], names=["y", "x"])

    return of


def judged(field: Field, texts: list[str | None], emissions: Emissions) -> list[dict]:
    """Score and offending spans [begin, end) of each text, in characters of the text as it was given."""
    out = []
    for p, sizes in tagged(texts, emissions):
        scores = 1 / (1 + np.exp(-np.clip(_summary(p, sizes) @ field.document, -40, 40)))
        ends = np.cumsum(sizes)
        for k, (s, stop, n) in enumerate(zip(scores.tolist(), ends.tolist(), sizes.tolist())):
            bad = np.flatnonzero(p[stop - n : stop] >= 0.5)
            spans = []
            if len(bad):
                text = texts[len(out)]
                low = text.lower()
                places = [m.span() for m in SPAN.finditer(low)]
                # A few characters are longer in lower case.
                origin = range(len(text)) if len(low) == len(text) else [i for i, c in enumerate(text) for _ in c.lower()]
                spans = [{"begin": origin[places[i][0]], "end": origin[places[i][1] - 1] + 1} for i in bad.tolist()]
            out.append({"score": s, "spans": spans})
    return out


RESULT = "struct<score:double,spans:array<struct<begin:int,end:int>>>"


def scorer(docs: DataFrame, field: Field):
    """A column function: score and offending spans of the whole text."""
    send = Sent(docs.sparkSession, field)
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())])))])

    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        emissions = Emissions(send.value)
        for texts in batches:
            yield pa.array(judged(send.value, texts.to_pylist(), emissions), kind)

    of.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(of, RESULT)


def with_judgement(docs: DataFrame, field: Field, column: str) -> DataFrame:
    """``docs`` and a column of scores and spans; replaces a column of that name."""
    return docs.withColumn(column, scorer(docs, field)(F.col("text")))
