"""WARC archives with a Zstandard dictionary.

Each task writes archives of about `ARCHIVE_BYTES` of records. An archive begins
with a skippable frame (magic 0x184D2A5D) that holds a dictionary built from pieces
of records all over the archive; each record is a frame of its own, compressed with
that dictionary, so a reader can start at any record. Too few or too small records to
train on give a dictionary of their plain content instead.

Of records with equal payloads that with the largest page_id is written whole, as
a response; the others are revisit records that name it and keep the HTTP header,
so the payload's length and digest are known from each record alone. Payloads
smaller than `dedup_from` bytes are all responses.

Null html is an empty payload, a null url is an empty target, and white space within
a url is read back as single blanks. A very long payload is one record, held whole by
its task; an archive closes once it is full. Other columns, whatever their names, are
not read. An empty table gives no archive. Rows equal to the response in payload and page_id are responses too. Rows with a null page_id come
after all others and are revisits if their payload has a response, else responses.
Null or not, a record's id holds its page_id.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamarisk.llm import common
from tamarisk.sources import storage

SKIPPABLE = 0x184D2A5D
ARCHIVE_BYTES = 32 << 20
DICTIONARY_BYTES = 64 << 10
#: Bytes that a dictionary is trained on, about: every n-th piece of the archive's
#: records, each `PIECE` bytes or a record's rest.
TRAINING_BYTES, PIECE = 4 << 20, 16 << 10
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
#: High half of the record ids that hold a page_id in the low half; and of those without.
_ID, _NO_ID = 0x7461_6D61_7269_8000, 0x7461_6D61_7269_8001


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    low = (page_id or 0) & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=(_NO_ID if page_id is None else _ID) << 64 | low)}>"


def page_of(name: str) -> int | None:
    value = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:")).int
    if value >> 64 == _NO_ID:
        return None
    low = value & (1 << 64) - 1
    return low - (1 << 64) if low >> 63 else low


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """refers_to: the response's page_id if this is a revisit."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    target = " ".join((url or "").split())
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest(payload)}"]
    if refers_to is None:
        block += payload
    else:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(head).encode() + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """A record's fields (names in lower case) and its block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError(f"not a WARC record: {first[:20]!r}")
    fields = {name.lower(): value for name, _, value in (x.partition(": ") for x in lines)}
    size = int(fields["content-length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length is wrong")
    return fields, rest[:size]


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few samples
        return zstandard.ZstdCompressionDict(b"".join(samples)[: DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def archive(records: list[bytes]) -> list[bytes]:
    """The archive's parts: the dictionary's frame, then each record's."""
    step = max(1, sum(map(len, records)) // TRAINING_BYTES)
    pieces = ((r, at) for r in records for at in range(0, len(r), PIECE))
    samples = [r[at : at + PIECE] for r, at in itertools.islice(pieces, 0, None, step)]
    known = dictionary(samples)
    own = known.as_bytes()
    press = zstandard.ZstdCompressor(level=3, dict_data=known)
    return [SKIPPABLE.to_bytes(4, "little") + len(own).to_bytes(4, "little") + own, *map(press.compress, records)]


def records(data: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    if not data:
        return
    if int.from_bytes(data[:4], "little") != SKIPPABLE:
        raise ValueError("the archive has no dictionary")
    at = 8 + int.from_bytes(data[4:8], "little")
    own = data[8:at]
    trained = own[:4] == b"\x37\xa4\x30\xec"
    known = zstandard.ZstdCompressionDict(own, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    expand = zstandard.ZstdDecompressor(dict_data=known)
    rest = memoryview(data)
    while at < len(data):
        frame = expand.decompressobj()
        parts = []
        while not frame.eof and at < len(data):  # a frame ends where the reader says
            step = min(64 << 10, len(data) - at)
            parts.append(frame.decompress(rest[at : at + step]))
            at += step
        at -= len(frame.unused_data)
        yield b"".join(parts)


def write(pages: DataFrame, path: str | None = None, dedup_from: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes archives below `path` and returns their list: path, n_records. A file
    is named anew by each attempt of its task and counts once the list names it."""
    path = storage.qualified(pages.sparkSession, path) if path else common.new_path(pages.sparkSession, "warc")
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload")).withColumn("sha", F.unhex(F.sha1("payload"))).withColumn("size", F.octet_length("payload"))
    # Only payloads that occur again; each task sums its own rows first.
    again = rows.filter(F.col("size") >= dedup_from).groupBy("sha", "size").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).filter("n > 1").drop("n")

    def archived(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            name = f"{path}/{uuid.uuid4().hex}.warc.zst"
            common.write_bytes(name, archive(held))
            return pa.RecordBatch.from_pydict({"path": [name], "n_records": [len(held)]})

        for batch in batches:
            for page_id, url, data, response in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(record(page_id, url, data, response if response != page_id else None))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield close()
                    held, size = [], 0
        if held:
            yield close()

    named = rows.join(again, ["sha", "size"], "left").select("page_id", "url", "payload", "response")
    return common.cut(named.mapInArrow(archived, "path string, n_records long"), "warc-list")


def read(listed: DataFrame, payloads: bool = False) -> DataFrame:
    """The records of the listed archives: page_id, url, payload_bytes,
    payload_digest, record_type, refers_to, and on request payload (null for
    revisits). A response whose payload doesn't give its digest is an error."""
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads
    schema = pa.schema(kinds)

    def rows_of(data: bytes) -> Iterator[tuple]:
        for one in records(data):
            fields, block = parse(one)
            head, _, payload = block.partition(b"\r\n\r\n")
            size = int(next(x for x in head.split(b"\r\n") if x.startswith(b"Content-Length: "))[16:])
            named, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
            if kind == "response" and (len(payload) != size or digest(payload) != named):
                raise ValueError(f"{fields['warc-record-id']}: the payload is not the one archived")
            refers = page_of(fields["warc-refers-to"]) if kind == "revisit" else None
            yield (page_of(fields["warc-record-id"]), fields["warc-target-uri"], size, named, kind, refers, payload if kind == "response" else None)[: len(kinds)]

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                some: list[tuple] = []
                for row in rows_of(common.read_bytes(name)):
                    some.append(row)
                    if len(some) >= 500:
                        yield common.batch_of(schema, dict(zip(schema.names, zip(*some, strict=True), strict=True)))
                        some = []
                if some:
                    yield common.batch_of(schema, dict(zip(schema.names, zip(*some, strict=True), strict=True)))

    return common.dealt(listed.select("path")).mapInArrow(parsed, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads)
