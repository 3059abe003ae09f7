"""WARC records in a chunked record table.

A record (header lines, block, two line ends, as in WARC 1.1) is stored as rows (record id, chunk number, bytes) of at most
``CHUNK`` bytes each, with the SHA-1 digest of the payload up to and including the chunk. Neither side holds a
record as a whole besides the payload it was given: the writer cuts views of it, the reader feeds chunk after
chunk to a running digest and keeps header lines only.

Records with equal payloads of ``MIN_BYTES`` or more: the one with the largest id is a response, the others are revisits
of it, whose block has the HTTP header only. Digests are grouped, with partial aggregates before the exchange; only
groups of several records are joined back to the pages.

Reading: chunks are read where they lie; only those of records that have several are dealt by record and put in order,
so a task's memory is bounded by one chunk.

Defined results: a null payload counts as empty; a null id is the record ``null``, and smaller than all others; rows that
repeat the response's id and payload are responses as well. Rows with one id and different payloads are kept apart. Extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.common import stored
from lorekeep.operators.common import broadcast_if_small

CHUNK = 1 << 20
MIN_BYTES = 0
_END = b"\r\n\r\n"
_ARCHIVE = "record string, chunk int, last boolean, data binary, digest string"
_URI = "urn:page:"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_header(page: str, url: str | None, kind: str, size: int, digest: str, refers_to: str | None) -> bytes:
    """Header lines of the record and of the HTTP answer in its block."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_URI}{page}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {len(http) + (size if kind == 'response' else 0)}",
    ]
    if url:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_URI}{refers_to}>"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def chunks_of(header: bytes, payload: memoryview, size: int = CHUNK):
    """(bytes, hexadecimal digest of the payload so far, last) of every chunk of a record."""
    digest, at = hashlib.sha1(), 0
    data = [header]
    room = max(0, size - len(header))
    while True:
        piece = payload[at : at + room]
        digest.update(piece)
        data.append(piece)
        at += len(piece)
        last = at >= len(payload)
        yield b"".join([*data, _END] if last else data), digest.hexdigest(), last
        if last:
            return
        data, room = [], size


def write_archive(df: DataFrame, key: str, url: str, payload: str, min_bytes: int = MIN_BYTES, chunk: int = CHUNK) -> DataFrame:
    """The written record table of all rows of ``df``."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    pages = df.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), body.alias("body"))
    hashed = pages.select("key", F.sha1("body").alias("sha1"), F.octet_length("body").alias("size")).where(F.col("size") >= min_bytes)
    groups = hashed.groupBy("sha1").agg(F.count("*").alias("n"), F.max("key").alias("response")).where(F.col("n") > 1).select("sha1", "response")
    groups, _ = broadcast_if_small(stored(groups, "warc-groups"))
    marked = pages.withColumn("sha1", F.sha1("body")).join(groups, "sha1", "left")
    revisit = F.col("response").isNotNull() & ~F.col("key").eqNullSafe(F.col("response")) & (F.octet_length("body") >= min_bytes)
    marked = marked.select("key", "url", "sha1", F.when(revisit, F.col("response")).alias("refers_to"), "body")

    def records(batches):
        task, number = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, held = [], 0
            keys, urls, digests, refers, bodies = (batch.column(i) for i in range(5))
            for i in range(batch.num_rows):
                page, target = keys[i].as_py(), refers[i].as_py()
                payload = memoryview(bodies[i].as_buffer())
                kind = "response" if target is None else "revisit"
                header = record_header("null" if page is None else str(page), urls[i].as_py(), kind, len(payload), base32(bytes.fromhex(digests[i].as_py())), None if target is None else str(target))
                body = payload if kind == "response" else payload[:0]
                for place, (data, digest, last) in enumerate(chunks_of(header, body, chunk)):
                    rows.append((f"{task}-{number}", place, last, data, digest))
                    held += len(data)
                    if held > 8 * CHUNK:
                        yield _batch(rows)
                        rows, held = [], 0
                number += 1
            if rows:
                yield _batch(rows)

    return stored(marked.mapInArrow(records, _ARCHIVE), "warc", compression="zstd")


_TABLE = pa.schema([("record", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary()), ("digest", pa.string())])


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist([dict(zip(_TABLE.names, row, strict=True)) for row in rows], schema=_TABLE)


class Reader:
    """Takes the chunks of one record after another and yields what the record says, checked against its payload."""

    def __init__(self):
        self.head, self.body, self.digest, self.size = b"", None, None, 0

    def feed(self, data: memoryview, last: bool) -> tuple | None:
        if self.body is None:
            self.head += bytes(data)
            if (end := self.head.find(_END, self.head.find(_END) + 1)) < 0:
                if last:
                    raise ValueError("a record without header lines")
                return None
            self.warc, self.http = (_fields(x) for x in self.head[:end].split(_END, 1))
            rest = int(self.warc["content-length"]) - (end + 4 - self.head.find(_END) - 4)
            data, self.head = memoryview(self.head)[end + 4 :], b""
            self.body, self.digest, self.size = rest, hashlib.sha1(), 0
        keep = data[: max(0, self.body - self.size)]
        self.digest.update(keep)
        self.size += len(keep)
        return self.ended(len(data) - len(keep)) if last else None

    def ended(self, behind: int) -> tuple:
        kind, claimed = self.warc["warc-type"], self.warc["warc-payload-digest"].removeprefix("sha1:")
        size = int(self.http["content-length"])
        if self.size != self.body or behind != len(_END) or (kind == "response" and (base32(self.digest.digest()) != claimed or size != self.size)):
            raise ValueError(f"record {self.warc['warc-record-id']} is damaged")
        ids = [x and x.removeprefix(f"<{_URI}").removesuffix(">") for x in (self.warc["warc-record-id"], self.warc.get("warc-refers-to"))]
        page, target = (None if x in (None, "null") else int(x) for x in ids)
        self.__init__()
        return page, size, claimed, kind, target


def _fields(block: bytes) -> dict[str, str]:
    return {k.lower(): v for k, _, v in (line.partition(": ") for line in block.decode().split("\r\n")[1:])}


_READ = pa.schema([("page", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_COLUMNS = "page long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archive(table: DataFrame, key: str) -> DataFrame:
    """``key``, ``payload_bytes``, ``payload_digest``, ``record_type`` and ``refers_to`` of every record, checked."""

    def whole(batches):
        """Reads records of one chunk; passes on the chunks of others."""
        for batch in batches:
            done, later = [], []
            places, lasts, data = batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3)
            for i in range(batch.num_rows):
                if places[i] == 0 and lasts[i]:
                    done.append(Reader().feed(memoryview(data[i].as_buffer()), True))
                else:
                    later.append(i)
            if done:
                read = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _READ, strict=True)], schema=_READ)
                blank = pa.RecordBatch.from_arrays([pa.nulls(len(done), f.type) for f in _CHUNKS], schema=_CHUNKS)
                yield pa.RecordBatch.from_arrays([*read.columns, *blank.columns], names)
            if later:
                blank = [pa.nulls(len(later), f.type) for f in _READ]
                chunks = batch.take(pa.array(later))
                yield pa.RecordBatch.from_arrays([*blank, *(chunks.column(n) for n in _CHUNKS.names)], names)

    def in_order(batches):
        reader, done = Reader(), []
        for batch in batches:
            lasts, data = batch.column(7).to_pylist(), batch.column(8)
            for i, record in enumerate(batch.column(5).to_pylist()):
                if record is not None and (row := reader.feed(memoryview(data[i].as_buffer()), lasts[i])):
                    done.append(row)
            ready = batch.filter(pa.compute.is_null(batch.column(5)))
            rows = pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], f.type) for k, f in enumerate(_READ)], schema=_READ)
            done = []
            yield from (pa.RecordBatch.from_arrays(ready.columns[:5], schema=_READ), rows)

    names = [*_READ.names, *_CHUNKS.names]
    first = table.mapInArrow(whole, f"{_COLUMNS}, record string, chunk int, last boolean, data binary")
    dealt = first.repartition(F.coalesce("record", F.col("page").cast("string"))).sortWithinPartitions("record", "chunk")
    return dealt.mapInArrow(in_order, _COLUMNS).withColumnRenamed("page", key)


_CHUNKS = pa.schema([("record", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("data", pa.binary())])
