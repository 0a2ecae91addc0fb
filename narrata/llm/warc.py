"""Web captures as WARC archives, and one ordered capture history from the archives' own indexes.

``write_archives`` writes a record per page: a ``response`` with the payload, or a ``revisit`` that refers to the record
with the same payload and the largest id. ``capture_runs`` reads archives back and gives, for each, its captures sorted by
(URL key, time): a run. ``merge_runs`` merges all runs: ranges of the key are dealt to tasks, and a task merges the
pieces of the runs in its range by a loser tree, so the parts in turn hold all captures in order.

Defined results: a null payload is empty; a null URL has no target header and the empty key, which sorts first; a null
time is the epoch; line breaks, other control characters and spaces of a URL are written percent-encoded. Rows with the
largest id of a group of equal payloads are all responses, so a repeated row is; rows without an id revisit the largest
id of their group, or are responses if no row of the group has one. Other columns are not read. An empty table gives no
record. Archives are read record by record, so a record may be as long as memory holds; a record that is cut short or
whose payload has another digest than its header says stops the job with its archive's name.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from narrata.shared import cut, new_folder

LEAST_SHARED = 1000  # payloads of fewer bytes are never revisited
ARCHIVE_BYTES = 32 << 20  # an archive is closed once it holds this much
RANGE_ROWS = 100_000  # captures merged in one task
HOT_SHARE = 1000  # a payload held by more than one row in this many is broadcast, so at most this many are

# What the format prescribes.
END = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:narrata:capture:"


def _decided(pages: DataFrame) -> DataFrame:
    """``pages`` (id, url, at, payload) with digest, bytes and, for revisits, ``refers``.

    Only payloads that several rows hold are looked up. The frequent ones are few by definition and are broadcast; the
    rows that have one, and rows that can share nothing, get join keys of their own, so no key of the join is large.
    """
    known = pages.withColumns({"bytes": F.octet_length("payload"), "digest": F.sha1(F.col("payload").cast("binary"))})
    known = known.withColumn("same", F.when(F.col("bytes") >= LEAST_SHARED, F.sha2(F.col("payload").cast("binary"), 256)))
    groups = known.where("same is not null").groupBy("same").agg(F.max("id").alias("last"), F.count("*").alias("n"))
    groups = cut(groups.where("n > 1 and last is not null"), "payloads")
    bound = F.lit(max(1, pages.count() // HOT_SHARE))
    hot = groups.where(F.col("n") > bound).select("same", F.col("last").alias("hot_last"))
    rest = groups.where(F.col("n") <= bound).select(F.col("same").alias("key"), "last")
    known = known.join(F.broadcast(hot), "same", "left")
    alone = F.concat(F.lit("-"), F.xxhash64("id", "url", "at").cast("string"))
    known = known.withColumn("key", F.when(F.col("hot_last").isNull() & F.col("same").isNotNull(), F.col("same")).otherwise(alone))
    last = F.coalesce("hot_last", "last")
    return known.join(rest, "key", "left").withColumn("refers", F.when(F.col("id").isNull() | (F.col("id") < last), last))


def _records(decided: DataFrame) -> DataFrame:
    """(head, payload): the record up to its payload; a revisit has none."""
    revisit = F.col("refers").isNotNull()
    bytes_ = F.col("bytes").cast("string")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "), bytes_, F.lit(END + END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    blank = F.regexp_replace("url", "[\\x00-\\x20\\x7f]", "")
    uri = F.when(blank == F.col("url"), F.col("url")).otherwise(
        F.array_join(F.transform(F.split("url", ""), lambda c: F.when(c.rlike("[\\x00-\\x20\\x7f]"), F.concat(F.lit("%"), F.lpad(F.hex(F.ascii(c)), 2, "0"))).otherwise(c)), "")
    )

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))

    def name_of(key: Column) -> Column:
        return F.concat(F.lit(f"<{ID_PREFIX}"), F.coalesce(key.cast("string"), F.lit("")), F.lit(">"))

    at = F.concat(F.translate(F.substring(F.coalesce("at", F.lit("1970-01-01").cast("timestamp_ntz")).cast("string"), 1, 19), " ", "T"), F.lit("Z"))
    head = F.concat(
        F.lit(f"WARC/1.1{END}"),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", name_of(F.col("id"))),
        line("WARC-Date", at),
        line("WARC-Target-URI", uri),
        line("WARC-Refers-To", F.when(revisit, name_of(F.col("refers")))),
        line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(END),
        http,
    )
    return decided.select(head.alias("head"), F.when(~revisit, F.col("payload")).alias("payload"))


def write_archives(pages: DataFrame, folder: str, id: str, url: str, payload: str, at: Column | None = None, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages`` as gzipped WARC files under ``folder``; ``at`` is the time of capture (timestamp_ntz, UTC).

    Records are gathered into one row per archive, which Spark's text writer closes with the blank lines that end a record.
    """
    at = F.lit(None) if at is None else at
    pages = pages.select(
        F.col(id).cast("bigint").alias("id"), F.col(url).cast("string").alias("url"),
        at.cast("timestamp_ntz").alias("at"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    )

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            heads, payloads = (c.cast(pa.large_binary()) for c in batch.columns)
            for head, body in zip(heads, payloads):
                record = head.as_py() + (body.as_py() or b"")
                parts.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield pa.record_batch({"archive": pa.array([(2 * END).encode().join(parts)], pa.binary())})
                    parts, size = [], 0
        if parts:
            yield pa.record_batch({"archive": pa.array([(2 * END).encode().join(parts)], pa.binary())})

    archives = _records(_decided(pages)).mapInArrow(gather, "archive binary").select(F.col("archive").cast("string"))
    archives.write.options(lineSep=2 * END, compression="gzip", maxRecordsPerFile=1).text(folder)


def url_key(url: str | None) -> str:
    """Host labels from the last to the first, then what follows: captures of one site stand together."""
    if not url or "://" not in url:
        return (url or "").lower()
    rest = url.split("://", 1)[1]
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return (",".join(reversed(host.split("."))) + ")" + (rest[len(host):] or "/")).lower()


def read_records(data) -> Iterator[tuple[dict[str, str], int, int, bytes]]:
    """(header, offset, length, block) of every record of an archive opened for reading; offsets are of the unzipped archive."""
    offset = 0
    while True:
        line = data.readline()
        if not line:
            return
        if not line.strip():
            offset += len(line)  # blank lines between records
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record at byte {offset}")
        start, header = offset, {}
        offset += len(line)
        while (line := data.readline()).strip():
            offset += len(line)
            name, _, value = line.decode().partition(":")
            header[name.strip().lower()] = value.strip()
        offset += len(line)
        length = int(header["content-length"])
        block = data.read(length)
        if len(block) < length:
            raise ValueError(f"the record at byte {start} is cut short")
        offset += length
        yield header, start, offset - start, block


def _capture_id(name: str | None) -> int | None:
    digits = (name or "").strip("<>").removeprefix(ID_PREFIX)
    return int(digits) if digits else None


def _capture(header: dict[str, str], block: bytes) -> tuple:
    """What the index holds of one record, from what was stored."""
    http, _, body = block.partition((2 * END).encode())
    size = next(int(v) for n, _, v in (x.partition(b":") for x in http.split(END.encode())) if n.strip().lower() == b"content-length")
    digest = header["warc-payload-digest"].removeprefix("sha1:")
    if header["warc-type"] == "response" and (len(body) != size or hashlib.sha1(body).hexdigest() != digest):
        raise ValueError(f"the payload of {header['warc-record-id']} is damaged")
    uri = header.get("warc-target-uri")
    return (
        url_key(uri), header["warc-date"], _capture_id(header["warc-record-id"]), uri, header["warc-type"],
        _capture_id(header.get("warc-refers-to")), size, digest,
    )


CAPTURE = "url_key string, captured_at string, id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string"
PLACE = "archive string, offset bigint, length bigint"
_CAPTURE_TYPES = {
    "url_key": pa.string(), "captured_at": pa.string(), "id": pa.int64(), "url": pa.string(), "record_type": pa.string(),
    "refers_to": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
    "archive": pa.string(), "offset": pa.int64(), "length": pa.int64(), "nth": pa.int64(),
}


def _order(capture: tuple) -> tuple:
    """Sorting key of (url_key, captured_at, id, ..., archive, offset): missing ids come first."""
    return capture[0], capture[1], capture[2] is not None, capture[2] or 0, capture[8], capture[9]


def capture_runs(spark: SparkSession, folder: str) -> DataFrame:
    """One run per archive under ``folder``: its captures in order, ``nth`` being the place in the run."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column(0), batch.column(1)):
                path, content = path.as_py(), content.as_py()
                raw = io.BytesIO(content)
                data = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
                try:
                    run = [(*_capture(header, block), path, start, length) for header, start, length, block in read_records(data)]
                except (ValueError, KeyError, StopIteration, EOFError, OSError) as error:
                    raise ValueError(f"{path}: {error}") from error
                run.sort(key=_order)
                columns = list(zip(*run)) or [()] * 11
                arrays = [pa.array(list(c), t) for c, t in zip([*columns, range(len(run))], _CAPTURE_TYPES.values())]
                yield pa.RecordBatch.from_arrays(arrays, names=list(_CAPTURE_TYPES))

    files = spark.read.format("binaryFile").load(folder).select("path", "content")
    return files.mapInArrow(index, f"{CAPTURE}, {PLACE}, nth bigint")


class LoserTree:
    """Merges sorted lists: inner nodes keep the loser of their match, so a new head only plays the matches on its way up."""

    def __init__(self, lists: list[list]):
        self.lists = lists
        self.size = max(1, len(lists))
        self.at = [0] * self.size
        self.heads = [(not keys, keys[0] if keys else None, s) for s, keys in enumerate(lists)] or [(True, None, 0)]
        self.losers = [0] * self.size
        winners = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            first, second = (a, b) if self._before(a, b) else (b, a)
            winners[node], self.losers[node] = first, second
        self.best = winners[1] if self.size > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        left, right = self.heads[a], self.heads[b]
        if left[0] or right[0]:  # a list that has run out loses
            return right[0]
        return left < right

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(list, place in it) of all entries in order; equal entries by list."""
        while not self.heads[self.best][0]:
            source = self.best
            place = self.at[source]
            yield source, place
            place = self.at[source] = place + 1
            keys = self.lists[source]
            self.heads[source] = (False, keys[place], source) if place < len(keys) else (True, None, source)
            node, winner = (source + self.size) // 2, source
            while node:
                if self._before(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.best = winner


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in the order of (URL key, time, id): ``part`` counts the ranges, ``place`` the rows in one.

    The ranges are cut at the whole key with its archive and offset, so one URL captured without end is many ranges.
    """
    runs = cut(runs, "runs")
    ranges = max(1, -(-runs.count() // range_rows))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        del got
        columns = [rows.column(n).to_pylist() for n in ("url_key", "captured_at", "id", "archive", "offset")]
        lists, starts, before = [], [], None
        for i, (key, at, id_, archive, offset) in enumerate(zip(*columns)):
            if archive != before:
                lists.append([])
                starts.append(i)
                before = archive
            lists[-1].append((key, at, id_ is not None, id_ or 0, archive, offset))
        order = [starts[source] + place for source, place in LoserTree(lists)]
        merged = rows.take(pa.array(order)).drop_columns(["nth"]).combine_chunks()
        merged = merged.append_column("part", pa.array([TaskContext.get().partitionId()] * len(order), pa.int32()))
        yield from merged.append_column("place", pa.array(range(len(order)), pa.int64())).to_batches(10_000)

    dealt = runs.repartitionByRange(ranges, "url_key", "captured_at", F.asc_nulls_first("id"), "archive", "offset")
    return dealt.sortWithinPartitions("archive", "nth").mapInArrow(merge, f"{CAPTURE}, {PLACE}, part int, place bigint")


def capture_histories(pages: DataFrame, id: str, url: str, payload: str, at: Column | None = None) -> DataFrame:
    """Write ``pages`` as archives into the shared folder and give the merged index of what was written."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, folder, id, url, payload, at)
    return merge_runs(capture_runs(spark, folder))
