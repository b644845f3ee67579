"""WARC archives: one gzip member per record, written by Spark's text writer, read back by a sequential reader.

Writing. Payloads of at least ``min_revisit`` bytes that are equal get one response, that of the smallest key; the others
are revisits, which hold the HTTP header (with the payload's length) and the digests, but no payload. Which is which is
found on (key, url, digest) alone; texts move only to meet the repeated digests, and a digest that a third of all rows
share is one row of that side. Tasks compress records into archives of ``archive_bytes`` at most (a larger record is
alone), one file each, committed by Spark's output protocol in any file system that Spark writes to.

Reading. One task reads one archive from its start: ``zlib.decompressobj`` yields CHUNK bytes at a time, headers are
parsed as they come, and Content-Length frames the block, so memory holds the compressed file, one chunk and (where
payloads are asked for) one payload. Plain WARC and several records in one member are read too. Block and payload
digests are verified. A member that does not decompress, or a record that does not frame, gives one row with ``error``;
reading goes on at the next member that begins with a WARC record.

Defined results: a null html is an empty payload; a null url is an absent field; a null key comes last among equals and
is an absent field; of rows equal in key, url and payload, one counts as the first; an empty table writes no records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanrisk.llm.common import release, slices, staged
from spanrisk.session import scratch_path

MIN_REVISIT = 100
ARCHIVE_BYTES = 32 << 20
CHUNK = 1 << 16
#: A header longer than this does not frame a record.
HEADER_LIMIT = 1 << 20
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:warc:record")
_MAGIC = b"\x1f\x8b\x08"

RECORDS = ("archive string, offset bigint, record_id string, record_type string, key bigint, url string, "
           "payload_bytes bigint, payload_digest string, refers_to bigint, refers_to_record string, verified boolean, "
           "error string, payload binary")


def _uri(url: str | None) -> str | None:
    """``url`` on one line: header fields end at a line break, so control characters are percent-encoded."""
    return url and "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record_id(key: int | None, url: str | None, digest: str, place: tuple[int, int] | None = None) -> str:
    """A record's id. ``place``: task and number of the record, by which equal rows differ; none for a response that
    revisits name, as their tasks know only its key, url and digest."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, repr((key, url, digest, place)))}>"


def format_record(kind: str, rid: str, key: int | None, url: str | None, payload: bytes, digest: str,
                  refers: tuple[str, int | None, str | None] | None = None, date: str = DATE) -> bytes:
    """One record: WARC header, HTTP header, and the payload of a response. ``digest``: SHA-256 of the payload, in
    hexadecimal digits. ``refers``: record id, key and url of a revisit's response."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if kind == "response":
        block += payload
    fields = [("WARC-Type", kind), ("WARC-Record-ID", rid), ("WARC-Date", date), ("WARC-Target-URI", _uri(url)),
              ("WARC-Payload-Digest", f"sha256:{digest}"),
              ("WARC-Block-Digest", f"sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}"),
              ("Document-Key", key)]
    if refers:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", refers[0]), ("Refers-To-Key", refers[1]),
                   ("WARC-Refers-To-Target-URI", _uri(refers[2]))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", len(block))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def member(record: bytes) -> bytes:
    """``record`` as one gzip member, the same bytes for the same record."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(record) + z.flush()


def repeated_payloads(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Of ``pages`` (key, url, payload, digest): the digests of long payloads that occur more than once, with their
    ``head``, the key and url of the response and the number ``n`` of rows equal in both."""
    place = F.struct(F.col("key").isNull().alias("k0"), "key", F.col("url").isNull().alias("u0"), "url")
    long = pages.filter(F.length("payload") >= min_revisit)
    same = (long.groupBy("digest", "key", "url").agg(F.count(F.lit(1)).alias("n")).withColumn("place", place)
            .groupBy("digest").agg(F.sum("n").alias("rows"), F.min_by(F.struct("key", "url", "n"), "place").alias("head")))
    return same.filter("rows > 1").select("digest", "head")


def planned_records(pages: DataFrame, heads: DataFrame) -> DataFrame:
    """``pages`` with the head of a repeated payload (else null), the kind of record and ``times``, how many rows it
    stands for. Of rows equal to their head in all three, one is the response and the rest are revisits: these are
    merged to one row with a count, of which the writer makes as many records."""
    is_head = F.col("key").eqNullSafe(F.col("head.key")) & F.col("url").eqNullSafe(F.col("head.url"))
    rows = (pages.join(heads, "digest", "left").withColumn("times", F.lit(1).cast("bigint")).withColumn(
        "kind", F.when(F.col("head").isNull() | is_head, "response").otherwise("revisit")))
    cols = ("key", "url", "digest", "payload", "head", "kind", "times")
    if heads.filter("head.n > 1").isEmpty():
        return rows.select(*cols)
    several = F.col("head").isNotNull() & is_head & (F.col("head.n") > 1)
    merged = rows.filter(several).groupBy("digest").agg(
        *[F.first(c).alias(c) for c in ("key", "url", "payload", "head", "kind")], F.count(F.lit(1)).alias("times"))
    return rows.filter(~several).select(*cols).unionByName(merged.select(*cols))


def _archives(archive_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = n = 0
        task = TaskContext.get().partitionId()

        def row() -> pa.RecordBatch:
            whole = b"".join(held)
            # the writer ends the row with a zero byte: it stands for the member's last one, the top byte of its length;
            # behind a member of 16 MB or more it is padding, which gzip readers pass over
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1] if whole.endswith(b"\0") else whole], pa.binary())],
                                              names=["archive"])

        for batch in batches:
            for part in slices(batch, "payload"):
                for r in part.to_pylist():
                    payload, head = r["payload"], r["head"]
                    for copy in range(r["times"]):
                        kind = r["kind"] if copy == 0 else "revisit"
                        refers = (record_id(head["key"], head["url"], r["digest"]), head["key"],
                                  head["url"]) if kind == "revisit" else None
                        n += 1
                        rid = record_id(r["key"], r["url"], r["digest"], None if head and not refers else (task, n))
                        z = member(format_record(kind, rid, r["key"], r["url"], payload, r["digest"], refers))
                        if held and size + len(z) > archive_bytes:
                            yield row()
                            held.clear()
                            size = 0
                        held.append(z)
                        size += len(z)
        if held:
            yield row()

    return run


def write_archives(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", html: str = "html",
                   min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write a record for every row of ``pages`` into archives under ``path``."""
    rows = pages.select(F.col(key).cast("bigint").alias("key"), F.col(url).alias("url"),
                        F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    heads, narrow = staged(repeated_payloads(rows, min_revisit), "warc-heads")
    archives = planned_records(rows, heads).mapInArrow(_archives(archive_bytes), "archive binary")
    # a file for each row, and each row ends with the zero byte that its last member lacks
    archives.select(F.col("archive").cast("string")).write.option("lineSep", "\0").option(
        "maxRecordsPerFile", 1).text(path)
    release(pages.sparkSession, narrow)


class Damaged(Exception):
    """What stands at this place of an archive is no record."""


class _Stream:
    """Bytes of an archive, a chunk at a time; ``offset`` is where the current record's member (in a plain archive, the
    record) began."""

    def __init__(self, data: bytes, offset: int = 0) -> None:
        self.data, self.offset, self.next, self.held, self.z = data, offset, offset, b"", None
        self.plain = data.startswith(b"WARC/")

    def _more(self) -> bool:
        """Decompress up to CHUNK bytes more; False at the end of the archive."""
        if self.plain:
            piece = self.data[self.next:self.next + CHUNK]
            self.next += len(piece)
            self.held += piece
            return bool(piece)
        if self.z is None:
            while self.data.startswith(b"\0", self.next):  # padding between members
                self.next += 1
            if self.next >= len(self.data):
                return False
            if not self.held:
                self.offset = self.next
            self.z = zlib.decompressobj(31)
        fed = self.z.unconsumed_tail or self.data[self.next:self.next + CHUNK]
        if not self.z.unconsumed_tail:
            self.next += len(fed)
        try:
            out = self.z.decompress(fed, CHUNK)
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        if self.z.eof:
            self.next -= len(self.z.unused_data)
            self.z = None
        elif not fed and not out:
            raise Damaged("gzip: the member is cut short")
        self.held += out
        return True

    def begin(self) -> None:
        """A record begins with the next byte."""
        if self.plain:
            self.offset = self.next - len(self.held)

    def until(self, mark: bytes, limit: int) -> bytes | None:
        """Bytes up to and with ``mark``; None if the archive has ended."""
        while (at := self.held.find(mark)) < 0:
            if len(self.held) > limit:
                raise Damaged("header: too long")
            if not self._more():
                if self.held:
                    raise Damaged("header: cut short")
                return None
        out, self.held = self.held[:at + len(mark)], self.held[at + len(mark):]
        return out

    def take(self, n: int) -> Iterator[bytes]:
        """The next ``n`` bytes in pieces."""
        while n:
            if not self.held and not self._more():
                raise Damaged("block: cut short")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            if piece:
                yield piece

    def after(self) -> int:
        """Where the next record (of a plain archive) or the next member with one begins, or the end."""
        at, mark = self.offset, b"\r\n\r\nWARC/" if self.plain else _MAGIC
        while (at := self.data.find(mark, at + 1)) >= 0:
            if self.plain:
                return at + 4
            try:
                if zlib.decompressobj(31).decompress(self.data[at:at + 1024], 5) == b"WARC/":
                    return at
            except zlib.error:
                pass
        return len(self.data)


def _fields(head: bytes) -> dict[str, str]:
    """Named fields of a header, names in lower case; a line that begins with white space continues the last."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def _number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


class _Digest:
    """Checks a labelled digest (algorithm, then hexadecimal or base32 digits) against bytes as they come."""

    def __init__(self, label: str | None) -> None:
        name, _, self.want = (label or "").partition(":")
        name = name.lower().replace("-", "")
        self.hash = hashlib.new(name) if name in ("md5", "sha1", "sha256", "sha512") else None

    def holds(self) -> bool:
        raw = self.hash.digest()
        return self.want.lower() == raw.hex() or self.want.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def read_records(data: bytes, payloads: bool = False) -> Iterator[dict]:
    """Records of one archive in order: offset, record_id, record_type, key, url, payload_bytes, payload_digest (bare
    digits as in the record), refers_to, refers_to_record, verified, error, payload. ``verified``: whether the digests
    that the record names hold for what it holds (a revisit has no payload to hold), null if it names none."""
    stream = _Stream(data)
    while True:
        row: dict = dict.fromkeys(("record_id", "record_type", "key", "url", "payload_bytes", "payload_digest", "refers_to",
                                   "refers_to_record", "verified", "error", "payload"))
        stream.begin()
        try:
            head = stream.until(b"\r\n\r\n", HEADER_LIMIT)
            if head is None:
                return
            row["offset"] = stream.offset
            if not head.startswith(b"WARC/"):
                raise Damaged("header: no WARC version")
            f = _fields(head)
            length = _number(f.get("content-length"))
            if length is None or length < 0:
                raise Damaged("header: no Content-Length")
            kind = f.get("warc-type")
            row |= {"record_id": f.get("warc-record-id"), "record_type": kind, "key": _number(f.get("document-key")),
                    "url": f.get("warc-target-uri"), "payload_digest": f.get("warc-payload-digest", "").partition(":")[2] or None,
                    "refers_to": _number(f.get("refers-to-key")), "refers_to_record": f.get("warc-refers-to")}
            block, payload = _Digest(f.get("warc-block-digest")), _Digest(f.get("warc-payload-digest"))
            http: bytes | None = b"" if f.get("content-type", "").startswith("application/http") else None
            size, kept = 0, []
            for piece in stream.take(length):
                if block.hash:
                    block.hash.update(piece)
                if http is not None:  # the payload begins behind the HTTP header
                    http += piece
                    end = http.find(b"\r\n\r\n")
                    if end < 0:
                        http = http if len(http) <= HEADER_LIMIT else http[-3:]
                        continue
                    row["payload_bytes"] = _number(_fields(http[:end + 2]).get("content-length"))
                    piece, http = http[end + 4:], None
                size += len(piece)
                if payload.hash:
                    payload.hash.update(piece)
                if payloads:
                    kept.append(piece)
            if http is not None:
                row["error"] = "block: no end of the HTTP header"
            if stream.until(b"\r\n\r\n", 4) != b"\r\n\r\n":
                raise Damaged("block: not followed by two line breaks")
            checks = [d.holds() for d in (block, payload) if d.hash and (d is block or kind != "revisit")]
            row["verified"] = all(checks) if checks else None
            if kind != "revisit":
                row["payload_bytes"] = size
                row["payload"] = b"".join(kept) if payloads else None
            yield row
        except Damaged as e:
            yield row | {"offset": stream.offset, "error": str(e)}
            at = stream.after()
            stream = _Stream(stream.data, at)


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records of all archives under ``path`` (RECORDS). A task holds one archive at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(RECORDS))
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("path"), batch.column("content")):
                rows, held = [], 0
                for r in read_records(content.as_py(), payloads):
                    rows.append(r | {"archive": name.as_py()})
                    held += 1024 + len(r["payload"] or b"")
                    if held > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.mapInArrow(run, RECORDS)


def round_trip(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
               min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archive every row of ``pages`` in the shared folder, and give what the reader finds there. The archives are
    deleted once they are read."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path, key, url, html, min_revisit, archive_bytes)
    out, _ = staged(read_archives(spark, path), "warc-records")
    release(spark, path)
    return out
