"""WARC archives: written by one task each, read in sequence.

One gzip member a record. The reader inflates as it reads, takes blocks by
their Content-Length, and verifies digests; it takes any valid archive, plain or
with several records a member. Archives lie in the shared folder, so any
executor can read them. A file is named by its task's attempt, and the table of
archives lists the files that are whole; a task that runs again writes another.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, table, written

LEAST_REVISIT, DATE, CHUNK = 1000, "1970-01-01T00:00:00Z", 1 << 16
#: Up to so many repeated payloads (some 60 bytes each), their owners are sent to every task; beyond, they are joined.
SENT_OWNERS = 200_000
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


class Record(NamedTuple):
    kind: str
    page_id: int | None
    refers_to: int | None
    url: str | None
    digest: str
    payload_bytes: int
    payload: bytes
    record_id: str | None = None


def _urn(page_id) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    """The page of a record's name, if it is a name that member() gives."""
    x = (urn or "").strip("<>")
    number = x.removeprefix("urn:page:")
    return int(number) if number != x and number.removeprefix("-").isdecimal() else None


def _packed(lines: list[str], block: bytes) -> bytes:
    packer = zlib.compressobj(wbits=31)
    head = "\r\n".join(["WARC/1.0", *lines, f"Content-Length: {len(block)}"]).encode() + b"\r\n\r\n"
    return packer.compress(head) + packer.compress(block + b"\r\n\r\n") + packer.flush()


def opening(name: str, date: str = DATE) -> bytes:
    """The record that an archive begins with."""
    fields = b"software: terrane\r\nformat: WARC File Format 1.0\r\n"
    return _packed(["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:archive:{name}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"], fields)


def member(r: Record, date: str = DATE) -> bytes:
    """A record as a gzip member. A revisit has the head of its response and no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r.payload_bytes}\r\n\r\n".encode()
    block = head + (r.payload if r.kind == "response" else b"")
    lines = [f"WARC-Type: {r.kind}", f"WARC-Record-ID: {_urn(r.page_id)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(r.digest)).decode()}"]
    if r.url is not None:
        lines.append("WARC-Target-URI: " + r.url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if r.kind == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_urn(r.refers_to)}"]
    return _packed([*lines, "Content-Type: application/http; msgtype=response"], block)


def inflated(file: BinaryIO) -> Iterator[bytes]:
    """A file's bytes, inflated as it is read, through all its gzip members; a file that isn't gzip as it is."""
    rest = file.read(CHUNK)
    if rest[:2] != b"\x1f\x8b":
        while rest:
            yield rest
            rest = file.read(CHUNK)
        return
    while rest:
        inflater = zlib.decompressobj(wbits=31)
        while not inflater.eof:
            if not rest and not (rest := file.read(CHUNK)):
                raise ValueError("the archive ends inside a record")
            if out := inflater.decompress(rest):
                yield out
            rest = inflater.unused_data if inflater.eof else b""
        rest = rest or file.read(CHUNK)


class _Reader:
    """Takes lines and blocks off a stream of bytes."""

    def __init__(self, parts: Iterator[bytes]) -> None:
        self.parts, self.held, self.at = parts, b"", 0

    def _more(self) -> bool:
        more = next(self.parts, None)
        if more is None:
            return False
        self.held, self.at = self.held[self.at :] + more, 0
        return True

    def take(self, n: int) -> bytes:
        out, size = [self.held[self.at : self.at + n]], 0
        size = len(out[0])
        self.at += size
        while size < n:
            if not self._more():
                raise ValueError("the archive ends inside a record")
            out.append(self.held[: n - size])
            self.at = len(out[-1])
            size += self.at
        return b"".join(out)

    def head(self) -> list[str] | None:
        """The lines up to an empty one; None at the end of the stream. Empty lines before them are skipped."""
        while True:
            while self.held.startswith((b"\r\n", b"\n"), self.at):
                self.at += 2 if self.held[self.at : self.at + 1] == b"\r" else 1
            end = self.held.find(b"\r\n\r\n", self.at)
            if end >= 0 and end > self.at:
                lines, self.at = self.held[self.at : end].decode("utf-8", "replace").split("\r\n"), end + 4
                return lines
            if not self._more():
                if self.held[self.at :].strip():
                    raise ValueError("the archive ends inside a record")
                return None


def _fields(lines: list[str]) -> dict[str, str]:
    """Names in small letters and values; a line that begins with white space goes on with the one before. The first of equal names counts."""
    whole: list[str] = []
    for x in lines:
        if x[:1] in " \t" and whole:
            whole[-1] += " " + x.strip()
        else:
            whole.append(x)
    out: dict[str, str] = {}
    for k, _, v in (x.partition(":") for x in whole):
        out.setdefault(k.strip().lower(), v.strip())
    return out


def _digest(value: str | None) -> tuple[str, bytes] | None:
    """Name and bytes of a labelled digest, base 32 or hexadecimal; None if it isn't one that can be verified."""
    name, _, text = (value or "").partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("sha1", "sha256", "sha512", "md5"):
        return None
    size = hashlib.new(name).digest_size
    try:
        raw = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.strip().upper())
    except ValueError:
        return None
    return (name, raw) if len(raw) == size else None


def _verify(value: str | None, block: bytes, what: str) -> None:
    if (known := _digest(value)) and hashlib.new(known[0], block).digest() != known[1]:
        raise ValueError(f"the {what} differs from its digest")


def records(file: BinaryIO) -> Iterator[Record]:
    """Each record of an archive, of whatever kind. Wrong framing, or a block or payload that differs from its digest, raises ValueError.

    The payload of a response or request is its HTTP body (with a
    Content-Length, no longer than that); of other records it is the block. A revisit's size and digest are those of the
    response it stands for, as far as its heads tell. digest is a SHA-1 in hexadecimal, worked out where none is given.
    page_id and refers_to are null for names that aren't pages'.
    """
    reader = _Reader(inflated(file))
    while (head := reader.head()) is not None:
        version, *lines = head
        fields = _fields(lines)
        if not version.startswith("WARC/") or not fields.get("content-length", "").isdecimal():
            raise ValueError("no record begins where one should")
        block = reader.take(int(fields["content-length"]))
        if reader.take(4) != b"\r\n\r\n":
            raise ValueError("a record's block is not as long as its Content-Length")
        kind, name, url = fields.get("warc-type", "").lower(), fields.get("warc-record-id"), fields.get("warc-target-uri")
        _verify(fields.get("warc-block-digest"), block, f"block of {name}")
        payload, size = block, len(block)
        if fields.get("content-type", "").lower().startswith("application/http"):
            http, _, payload = block.partition(b"\r\n\r\n")
            length = _fields(http.decode("latin-1").split("\r\n")[1:]).get("content-length", "")
            size = int(length) if length.isdecimal() else len(payload)
            if kind != "revisit":
                if len(payload) < size:
                    raise ValueError(f"the payload of {name} is shorter than its Content-Length")
                payload = payload[:size]
        if kind != "revisit":
            _verify(fields.get("warc-payload-digest"), payload, f"payload of {name}")
        given = _digest(fields.get("warc-payload-digest"))
        sha1 = given[1].hex() if given and given[0] == "sha1" else hashlib.sha1(payload).hexdigest()
        url = url if url is None else url.strip("<>").replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")
        yield Record(kind, _page(name), _page(fields.get("warc-refers-to")), url, sha1, size, payload, name)


def _store(uri: str):
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def with_kinds(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, html, digest, payload_bytes and owner. owner is the page whose response a page revisits, null for responses.

    Only digests that are found twice meet the pages again; few of them are sent to every task, so that no page is moved.
    """
    html = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("payload_bytes"))
    sizes = keyed.where(F.col("payload_bytes") >= least).groupBy("digest")
    owners = written(sizes.agg(F.max("page_id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1 and largest is not null").select("digest", "largest"))
    joined = keyed.join(F.broadcast(owners) if owners.count() <= SENT_OWNERS else owners, "digest", "left")
    return joined.withColumn("owner", F.when(~F.col("page_id").eqNullSafe(F.col("largest")), F.col("largest"))).drop("largest")


def write_archives(pages: DataFrame, folder: str, least: int = LEAST_REVISIT) -> DataFrame:
    """Writes a record for each page into archives in folder, one a task; returns their paths and record counts.

    An archive begins with a warcinfo record, which is counted too. Of equal
    payloads of at least `least` bytes, the one with the largest page_id is the
    response and others revisit it; a repeated row of that page is a response
    too. A null html is an empty payload, a null page_id is named none and is
    never revisited (pages without any id are all responses).
    """

    def run(batches):
        store, base = _store(folder)
        store.create_dir(base, recursive=True)
        task = TaskContext.get()
        name, n = f"part-{task.partitionId():05d}-{task.taskAttemptId()}.warc.gz", 1
        with store.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(opening(name))
            for batch in batches:
                ids, urls, html, digests, sizes, owners = (batch.column(c) for c in ("page_id", "url", "html", "digest", "payload_bytes", "owner"))
                for i in range(batch.num_rows):
                    owner = owners[i].as_py()
                    kind = "response" if owner is None else "revisit"
                    out.write(member(Record(kind, ids[i].as_py(), owner, urls[i].as_py(), digests[i].as_py(), sizes[i].as_py(), html[i].as_py().encode() if owner is None else b"")))
                    n += 1
        yield pa.RecordBatch.from_pydict({"path": [name], "records": [n]})

    return written(with_kinds(pages, least).mapInArrow(run, "path string, records long"))


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """record_id, page_id, url, record_type, payload_bytes, payload_digest, refers_to and payload (null for revisits) of each record.

    archives: path in folder, and records, the number that must be found (null: any).
    """

    def rows(path: str):
        store, base = _store(folder)
        with store.open_input_stream(f"{base}/{path}", compression=None) as file:
            yield from records(file)

    def run(batches):
        names = ("page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "record_id")
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string())
        held, size = [], 0
        done = lambda: pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*held), kinds)], names)
        for batch in batches:
            for path, n in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                seen = 0
                for r in rows(path):
                    held.append((r.page_id, r.url, r.kind, r.payload_bytes, r.digest, r.refers_to, None if r.kind == "revisit" else r.payload, r.record_id))
                    size, seen = size + len(r.payload), seen + 1
                    if size > 1 << 23 or len(held) >= 4096:
                        yield done()
                        held, size = [], 0
                if n is not None and seen != n:
                    raise ValueError(f"{path} holds {seen} records of {n}")
        if held:
            yield done()

    n = max(1, archives.count())
    return archives.repartition(n).mapInArrow(run, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, record_id string")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    archives = write_archives(table(spark, sf_dir, "pages"), folder)
    pages = read_archives(archives, folder).where(F.col("record_type").isin("response", "revisit"))
    return pages.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
o AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest) END AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN largest IS NULL OR largest = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN largest <> page_id THEN largest END AS refers_to
FROM o
"""
