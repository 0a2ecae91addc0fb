"""Collocations: phrases whose words stand together more often than their parts would by chance.

Everything is counted per language. Documents are cut into shards of words that one task indexes:

1. One pass lower-cases, splits texts into pieces and words, and writes shards of encoded pieces with the words of each
   and their counts. Summed over shards these give every word its count and a number.
2. Each shard is sorted by its next words, forwards and backwards: two FM-indexes, written once, in a table bucketed by
   shard, so later rounds read them where they lie. A phrase is a pair of intervals of equal size, one in each. The symbols
   in its backward interval are what may follow it; the least place a symbol leads to and its count are the longer phrase's
   backward interval, and the smaller symbols' counts move the forward one.
3. One round per phrase length: shards extend the intervals of phrases that are frequent over all shards and send the local
   counts of (phrase, next word) to buckets of such pairs; a bucket sums them and replies to each shard which of its pairs
   are frequent. Messages are sorted, packed arrays, a few bytes a pair. The forward interval tells what precedes a phrase:
   a phrase that one same word always precedes or follows, in all shards, says less than the longer one.

Tables of frequent phrases hold ids: the phrase without its last word, the last word, the phrase without its first word.
Nothing that grows with the data is broadcast, and no task holds more than a shard (or a piece longer than one) or the
messages of a bucket. Shards and buckets are equally many, so a round has at most their product of messages; ``shard_words``
should grow with the square root of the corpus to keep messages worth their row.

Defined results: a null text is empty, a null language is ``und`` and counts together with that name. Repeated rows count
each time. Ties are settled by phrase. Only the text and the language are read of other columns. An empty table has no
phrase.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from narrata.shared import cut, new_folder, own_columns

SHARD_WORDS = 3 << 19
ROWS = 1 << 18  # rows of a shard's index that are worked on at once
MOST_WORDS = 5

# What divides pieces and words.
_FOLD = bytes.maketrans(bytes(range(65, 91)) + b"\t.,;:!?\x0a\x0b\x0c\x0d", bytes(range(97, 123)) + b" " + b"\n" * 10)
_BREAK = b"\n"


def pieces(text: bytes) -> list[bytes]:
    """Words in order, a break closing each piece; empty words between spaces."""
    return text.translate(_FOLD).replace(_BREAK, b" \n ").split(b" ") + [_BREAK]


def packed(symbols: np.ndarray) -> bytes:
    """Symbols in two or four bytes each, byte by byte of equal weight, compressed."""
    width = 4 if int(symbols.max(initial=0)) >= 1 << 16 else 2
    return bytes([width]) + zlib.compress(symbols.astype(f"<u{width}").view(np.uint8).reshape(len(symbols), width).T.tobytes(), 1)


def unpacked(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(data[0], -1)
    return np.ascontiguousarray(flat.T).view(f"<u{data[0]}").ravel().astype(np.int64)


class _Numbers(dict):
    """Numbers words as they come; the words of all languages of a shard share one count."""

    def __init__(self, listed: list, lang: str):
        self[_BREAK], self[b""], self.listed, self.lang = 0, -1, listed, lang

    def __missing__(self, word: bytes) -> int:
        self.listed.append((self.lang, word))
        self[word] = len(self.listed)
        return len(self.listed)


_SHARD = "shard bigint, symbols binary, words array<struct<lang:string,word:string,n:bigint>>"


def encode_shards(docs: DataFrame, text: str = "text", lang: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(shard, symbols, words): symbol 0 closes a piece, symbol i > 0 is ``words[i - 1]``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        listed: list[tuple] = []
        numbers: dict[str, _Numbers] = {}
        parts: list[np.ndarray] = []
        size, made, task = 0, 0, TaskContext.get().partitionId()

        def close() -> pa.RecordBatch:
            symbols = np.concatenate(parts)
            counts = np.bincount(symbols, minlength=len(listed) + 1)[1:]
            langs, words = zip(*listed) if listed else ((), ())
            entries = pa.StructArray.from_arrays(
                [pa.array(list(langs), pa.string()), pa.array(list(words), pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
                names=["lang", "word", "n"],
            )
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) + made], pa.int64()), pa.array([packed(symbols)], pa.binary()), pa.ListArray.from_arrays([0, len(entries)], entries)],
                names=["shard", "symbols", "words"],
            )

        for batch in batches:
            for value, of in zip(batch.column(0).cast(pa.large_binary()), batch.column(1).to_pylist()):
                if of not in numbers:
                    numbers[of] = _Numbers(listed, of)
                symbols = np.array(list(map(numbers[of].__getitem__, pieces(value.as_py()))), np.int64)
                parts.append(symbols[symbols >= 0])
                size += len(parts[-1])
                if size >= shard_words:
                    yield close()
                    listed, numbers, parts, size, made = [], {}, [], 0, made + 1
        if parts:
            yield close()

    asked = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    return asked.mapInArrow(encode, _SHARD)


def count_words(shards: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lang, word, f, id) of all words, and (lang, n) of all their occurrences."""
    words = shards.select(F.explode("words").alias("w")).select("w.lang", "w.word", "w.n")
    counts = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).withColumn("id", F.monotonically_increasing_id())
    counts = cut(counts, "words")
    return counts, cut(counts.groupBy("lang").agg(F.sum("f").alias("n")), "totals")


def sorting(keys: np.ndarray) -> np.ndarray:
    """Places in the order of not negative ``keys``, ties by place: a plain sort of (key, place) where both fit one number."""
    bits = int(len(keys)).bit_length()
    if int(keys.max(initial=0)).bit_length() + bits > 63:
        return np.argsort(keys, kind="stable")
    return np.sort(keys << bits | np.arange(len(keys))) & ((1 << bits) - 1)


_INDEX = "shard bigint, ids array<bigint>, forward binary, backward binary"


def _index(left: pa.Table, right: pa.Table) -> pa.Table:
    """The two transforms of a shard; symbol i > 0 is the word ``ids[i - 1]``."""
    numbers, names = right.column("nth").to_numpy(), right.column("id").to_numpy()
    order = np.argsort(numbers)
    symbols = unpacked(left.column("symbols")[0].as_py())
    dense = np.zeros(int(symbols.max(initial=0)) + 1, np.int64)
    dense[numbers[order]] = np.arange(1, len(order) + 1)
    text = dense[symbols]
    text = text[(text > 0) | (np.concatenate(([1], text[:-1])) > 0)]  # one break is enough
    columns = []
    for way in (text, text[::-1]):
        rows = suffix_order_to(way, MOST_WORDS)
        columns.append(pa.array([packed(way[rows - 1])], pa.binary()))
    return pa.table({
        "shard": left.column("shard"), "ids": pa.ListArray.from_arrays([0, len(order)], pa.array(names[order], pa.int64())),
        "forward": columns[0], "backward": columns[1],
    })


def suffix_order_to(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least, taken round the end; ties by place."""
    rank, width = text, 1
    while True:
        pairs = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -width)
        width *= 2
        if width >= depth:
            return sorting(pairs)
        order = sorting(pairs)
        rank = np.empty(len(pairs), np.int64)
        rank[order] = np.cumsum(np.diff(pairs[order], prepend=pairs[order[:1]]) != 0)


def build_index(shards: DataFrame, words: DataFrame, tasks: int) -> DataFrame:
    """The index of every shard."""
    listed = shards.select("shard", F.posexplode("words").alias("nth", "w")).select("shard", (F.col("nth") + 1).alias("nth"), "w.lang", "w.word")
    # Every word is one row, so a hash table of a partition of them is small and spares sorting the long side.
    named = listed.join(words.select("lang", "word", "id").hint("shuffle_hash"), ["lang", "word"]).select("shard", F.col("nth").cast("bigint").alias("nth"), "id")
    return _by_shard(shards.select("shard", "symbols").repartition(tasks, "shard"), named, tasks, _index, _INDEX)


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}


def bundled(*arrays: np.ndarray) -> bytes:
    """Equally long arrays of numbers, the first one as differences, byte by byte of equal weight, compressed."""
    table = np.stack([np.diff(arrays[0], prepend=0), *arrays[1:]]).astype("<i8")
    return len(arrays).to_bytes(1, "little") + zlib.compress(table.view(np.uint8).reshape(table.size, 8).T.tobytes(), 1)


def unbundled(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zlib.decompress(data[1:]), np.uint8).reshape(8, -1)
    table = np.ascontiguousarray(flat.T).view("<i8").reshape(data[0], -1).astype(np.int64)
    table[0] = np.cumsum(table[0])
    return table


def _by_shard(one: DataFrame, many: DataFrame, tasks: int, work: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``work`` on each shard's row of ``one`` and its rows of ``many``.

    Packed shards are small for the work they are, so the number of tasks is not left to their size.
    """
    nothing = pa.schema([(name, _TYPES[kind]) for name, kind in (c.split() for c in schema.split(", "))]).empty_table()

    def both(left: pa.Table, right: pa.Table) -> pa.Table:
        return work(left, right) if left.num_rows else nothing

    many = own_columns(many).repartition(tasks, "shard").groupBy("shard")
    return own_columns(one).groupBy("shard").cogroup(many).applyInArrow(both, schema)


def _kept_by_shard(df: DataFrame, tasks: int) -> tuple[DataFrame, str]:
    """``df`` as a table bucketed by shard, which is read without a shuffle, and its name."""
    spark, name = df.sparkSession, f"narrata_shards_{uuid.uuid4().hex}"
    df.write.bucketBy(tasks, "shard").option("path", new_folder(spark, "shards")).saveAsTable(name)
    return spark.table(name), name


def _inside(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(which interval, row) for all rows of all intervals."""
    which = np.repeat(np.arange(len(low)), size)
    first = np.cumsum(size) - size
    return which, np.arange(len(which)) - first[which] + low[which]


def _spans(size: np.ndarray) -> Iterator[slice]:
    """Neighbouring intervals of about ``ROWS`` rows together; one span at least."""
    ends = np.cumsum(size)
    cuts = np.unique(np.searchsorted(ends, np.arange(ROWS, int(size.sum()), ROWS)))
    for a, b in zip([0, *cuts], [*cuts, len(size)]):
        if a < b or len(size) == 0:
            yield slice(a, b)


class _Shard:
    """A shard's index, and the phrases that go through it as rows of (phrase, n, low, back)."""

    def __init__(self, row: pa.Table):
        self.ids = np.concatenate(([-1], row.column("ids").combine_chunks().flatten().to_numpy()))
        self.forward = unpacked(row.column("forward")[0].as_py()).astype(np.int32)
        backward = unpacked(row.column("backward")[0].as_py())
        # Where each row of the backward transform leads to: the place of its phrase, one word longer.
        self.leads = np.empty(len(backward), np.int32)
        self.leads[sorting(backward)] = np.arange(len(backward))
        self.backward = backward.astype(np.int32)

    def words(self) -> np.ndarray:
        starts = np.concatenate(([0], np.cumsum(np.bincount(self.forward, minlength=len(self.ids)))))
        return np.stack((self.ids[1:], np.diff(starts)[1:], starts[1:-1], starts[1:-1]))

    def longer(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(prefix, word) and (n, low, back) of all phrases one word longer than ``live``."""
        found = [self._longer(live[:, span]) for span in _spans(live[1])]
        return np.concatenate([k for k, _ in found], axis=1), np.concatenate([v for _, v in found], axis=1)

    def _longer(self, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        phrase, size, low, back = live
        which, rows = _inside(back, size)
        key = which * (len(self.ids) + 1) + self.backward[rows]
        order = sorting(key)
        heads = np.nonzero(np.diff(key[order], prepend=-1))[0]
        count = np.diff(np.append(heads, len(key)))
        of, first = which[order][heads], rows[order][heads]
        symbol = self.backward[first]
        # Rows of smaller symbols come first in the forward interval of the same phrase.
        smaller = np.cumsum(count) - count
        smaller -= smaller[np.searchsorted(of, np.arange(len(phrase)))][of]
        some = symbol > 0
        of, symbol, count, smaller, first = (x[some] for x in (of, symbol, count, smaller, first))
        return np.stack((phrase[of], self.ids[symbol])), np.stack((count, low[of] + smaller, self.leads[first]))

    def around(self, live: np.ndarray) -> np.ndarray:
        """(phrase, left, right): the one word that always stands there, or -1."""
        return np.concatenate([self._around(live[:, span]) for span in _spans(live[1])], axis=1)

    def _around(self, live: np.ndarray) -> np.ndarray:
        phrase, size, low, back = live
        sides, starts = [], np.cumsum(size) - size
        for symbols, at in ((self.forward, low), (self.backward, back)):
            seen = symbols[_inside(at, size)[1]]
            least, most = np.minimum.reduceat(seen, starts), np.maximum.reduceat(seen, starts)
            sides.append(np.where((least == most) & (least > 0), self.ids[least], -1))
        return np.stack((phrase, *sides))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    mixed = keys[0].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + keys[1].astype(np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((mixed ^ (mixed >> np.uint64(32))) % np.uint64(buckets)).astype(np.int64)


def _grouped(values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(value, places) for every value, places in order."""
    order = sorting(values)
    starts = np.nonzero(np.diff(values[order], prepend=-1))[0]
    for a, b in zip(starts, np.append(starts[1:], len(order))):
        yield int(values[order[a]]), order[a:b]


_MESSAGE = "shard bigint, bucket bigint, pairs binary, around binary"
_STATE = "shard bigint, bucket bigint, pairs binary"
_ID_BITS = 32  # a phrase's id is its bucket, then its number there


def _extend(left: pa.Table, right: pa.Table, buckets: int) -> pa.Table:
    """Messages of one shard; under bucket -1 the phrases they extend.

    ``right`` holds those of the last round and the buckets' replies; without it the shard's words are extended.
    """
    shard, messages = _Shard(left), {}
    state = dict(zip(right.column("bucket").to_pylist(), right.column("pairs").to_pylist()))
    if state:
        keys, values = shard.longer(unbundled(state[-1]))
        made = [np.empty((4, 0), np.int64)]
        for bucket, places in _grouped(_bucket(keys, buckets)):
            if bucket in state:
                place, number = unbundled(state[bucket])
                made.append(np.vstack(((bucket << _ID_BITS) + number, values[:, places[place]])))
        live = np.concatenate(made, axis=1)
        del keys, values, made
        for bucket, places in _grouped(live[0] >> _ID_BITS):
            messages[bucket] = [None, bundled(*shard.around(live[:, places]))]
    else:
        live = shard.words()
    keys, values = shard.longer(live)
    for bucket, places in _grouped(_bucket(keys, buckets)):
        messages.setdefault(bucket, [None, None])[0] = bundled(*keys[:, places], values[0, places])
    messages[-1] = [bundled(*live), None]
    of = left.column("shard")[0].as_py()
    rows = [(of, bucket, *parts) for bucket, parts in messages.items()]
    types = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else [()] * 4, types)], names=["shard", "bucket", "pairs", "around"])


_REPLY = "shard bigint, bucket bigint, pairs binary, prefix array<bigint>, word array<bigint>, f array<bigint>, bounds array<bigint>"


def _sum_bucket(table: pa.Table, least: int) -> pa.Table:
    """Replies of a bucket to its shards and, in a row without a shard, its frequent pairs and what bounds older phrases.

    A reply lists the places of frequent pairs in the shard's message and their numbers in the bucket. ``bounds`` has 1
    where one word always precedes a phrase, 2 where one always follows it, by the phrase's number.
    """
    bucket, shards = table.column("bucket")[0].as_py(), table.column("shard").to_pylist()
    rows, found, bounds = [], np.empty((3, 0), np.int64), np.empty(0, np.int64)
    around = [unbundled(m) for m in table.column("around").to_pylist() if m]
    if around:
        number, sides = np.concatenate([m[0] for m in around]) & ((1 << _ID_BITS) - 1), np.concatenate([m[1:] for m in around], axis=1)
        bounds = np.zeros(int(number.max()) + 1, np.int64)
        for bit, side in zip((1, 2), sides):
            low, high = np.full(len(bounds), np.iinfo(np.int64).max), np.full(len(bounds), -1)
            np.minimum.at(low, number, side)
            np.maximum.at(high, number, side)
            bounds += np.where((low == high) & (low >= 0), bit, 0)
    sent = [(of, unbundled(m)) for of, m in zip(shards, table.column("pairs").to_pylist()) if m]
    if sent:
        prefix, word, n = np.concatenate([m for _, m in sent], axis=1)
        order = np.lexsort((word, prefix))
        new = np.concatenate(([True], (np.diff(prefix[order]) != 0) | (np.diff(word[order]) != 0)))
        total = np.add.reduceat(n[order], np.nonzero(new)[0])
        number = np.where(total >= least, np.cumsum(total >= least) - 1, -1)
        pair = np.empty(len(order), np.int64)
        pair[order] = number[np.cumsum(new) - 1]
        firsts = order[new][total >= least]
        found = np.stack((prefix[firsts], word[firsts], total[total >= least]))
        ends = np.cumsum([m.shape[1] for _, m in sent])
        for (of, _), part in zip(sent, np.split(pair, ends[:-1])):
            places = np.nonzero(part >= 0)[0]
            if len(places):
                rows.append((of, bucket, bundled(places, part[places]), None, None, None, None))
    rows.append((None, bucket, None, *found.tolist(), bounds.tolist()))
    types = [_TYPES[c.split()[1]] for c in _REPLY.split(", ")]
    return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names=[c.split()[0] for c in _REPLY.split(", ")])


def _identified(replies: DataFrame, values: list[str]) -> DataFrame:
    """The buckets' lists as rows, each with the phrase's id."""
    rows = replies.where("shard is null").select("bucket", F.posexplode(F.arrays_zip(*values)).alias("nth", "v"))
    return rows.select((F.shiftleft("bucket", _ID_BITS) + F.col("nth")).alias("id"), *[F.col(f"v.{c}").alias(c) for c in values])


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 100, most_words: int = MOST_WORDS, shard_words: int = SHARD_WORDS) -> tuple[list[DataFrame], DataFrame]:
    """Tables of frequent phrases of 1, 2, ... words, and (lang, n).

    A table has id, lang, phrase, f, ``heads`` (counts of the phrase's first 1, 2, ... words), ``tails`` (counts of its last
    1, 2, ... words), and, between the shortest and the longest phrases, whether one same word always precedes
    (``left_bound``) or follows (``right_bound``) it.
    """
    if not 1 <= most_words <= MOST_WORDS:
        raise ValueError(f"most_words must be 1 to {MOST_WORDS}")
    spark = docs.sparkSession
    shards = cut(encode_shards(docs, text, lang, shard_words), "shards")
    words, totals = count_words(shards)
    tasks = max(1, shards.count())
    index, name = _kept_by_shard(build_index(shards, words, tasks), tasks)
    words = words.where(F.col("f") >= least)
    counts = F.array("f")
    nothing = F.lit(None).cast("bigint")
    table = words.select(
        "id", "lang", F.col("word").alias("phrase"), "f", nothing.alias("prefix"), F.col("id").alias("word"), nothing.alias("suffix"),
        counts.alias("heads"), counts.alias("tails"),
    )
    no_bounds = {"left_bound": F.lit(False), "right_bound": F.lit(False)}
    tables = [cut(table.withColumns(no_bounds), "phrases")]
    state = spark.createDataFrame([], _STATE)

    def extend(left: pa.Table, right: pa.Table) -> pa.Table:
        return _extend(left, right, tasks)

    def sum_bucket(table: pa.Table) -> pa.Table:
        return _sum_bucket(table, least)

    for length in range(2, most_words + 1):
        messages = cut(_by_shard(index, state, tasks, extend, _MESSAGE), "messages")
        replies = messages.where("bucket >= 0").repartition(tasks, "bucket").groupBy("bucket").applyInArrow(sum_bucket, _REPLY)
        replies = cut(replies, "replies")
        if length > 2:
            bounds = _identified(replies, ["bounds"])
            bounds = bounds.select("id", *[(F.col("bounds").bitwiseAND(bit) > 0).alias(b) for bit, b in ((1, "left_bound"), (2, "right_bound"))])
            tables[-1] = cut(tables[-1].drop(*no_bounds).join(bounds, "id"), "phrases")
        state = messages.where("bucket < 0").select("shard", "bucket", "pairs")
        state = state.unionByName(replies.where("shard is not null").select("shard", "bucket", "pairs"))
        table = _described(_identified(replies, ["prefix", "word", "f"]), tables[-1], tables[0])
        tables.append(cut(table.withColumns(no_bounds), "phrases"))
    spark.sql(f"drop table {name}")
    return tables, totals


def _described(found: DataFrame, shorter: DataFrame, words: DataFrame) -> DataFrame:
    """Text and counts of the parts of each phrase in ``found`` (id, prefix, word, f), from the phrases one word shorter."""
    head = shorter.select(F.col("id").alias("prefix"), "lang", F.col("phrase").alias("start"), F.col("heads").alias("head"), F.col("suffix").alias("inner"))
    end = words.select(F.col("id").alias("word"), F.col("phrase").alias("end"))
    rows = found.join(head, "prefix").join(end, "word")
    # Without its first word, the phrase ends in the same word after the suffix of its prefix.
    tail = shorter.select(F.col("prefix").alias("t_inner"), F.col("word").alias("t_word"), F.col("id").alias("suffix"), F.col("tails").alias("tail"))
    rows = rows.join(tail, F.col("inner").eqNullSafe(F.col("t_inner")) & (F.col("word") == F.col("t_word")))
    return rows.select(
        "id", "lang", F.concat_ws(" ", "start", "end").alias("phrase"), "f", "prefix", "word", "suffix",
        F.concat("head", F.array("f")).alias("heads"), F.concat("tail", F.array("f")).alias("tails"),
    )


def scored(tables: list[DataFrame], totals: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of phrases that no longer frequent one of the same count holds.

    A phrase is as rare as its least surprising cut. Products are decimals of 38 digits.
    """
    kept = []
    for length, table in enumerate(tables[1:], 2):
        longest = length == len(tables)
        kept.append(table if longest else table.where("not left_bound and not right_bound"))
    rows = kept[0]
    for more in kept[1:]:
        rows = rows.unionByName(more)
    rows = rows.join(totals, "lang").withColumn("top", F.expr("cast(f as decimal(18,0)) * cast(n as decimal(16,0)) * 1000"))
    l, r = "heads[k - 1]", "tails[size(heads) - k - 1]"
    score = f"top div (cast({l} as decimal(18,0)) * cast({r} as decimal(18,0)))"
    cuts = F.expr(f"array_min(transform(sequence(1, size(heads) - 1), k -> named_struct('score', {score}, 'k', k, 'l', {l}, 'r', {r})))")
    return rows.withColumn("cut", cuts).select("lang", "phrase", F.col("f").alias("a"), "cut.l", "cut.r", "n", "cut.score")


def top(scores: DataFrame, most: int) -> DataFrame:
    """The first ``most`` phrases of each language, by score, count, then phrase."""
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = scores.withColumn("rank", F.row_number().over(order).cast("bigint"))
    return ranked.where(F.col("rank") <= most)
