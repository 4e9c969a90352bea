"""WARC archives: written, normalised to one gzip member per record, and read back by offset.

``write_archives`` writes each task's records as whole-file gzip streams (one member for all records),
the form that crawlers without random access leave behind. ``normalise`` inflates each such stream
once, in pieces, and writes every record as a member of its own plus a sidecar index of offsets.
``read_archives`` opens the members named by the sidecar and returns what the records say.

Payloads of ``LEAST`` bytes or more that are equal are stored once: the record with the largest page id
is the response, the others are revisits that name it. Equal means equal SHA-1 and length.

Defined cases: a null html is an empty payload; a null URL has no target header; a null page id has no
id header and comes back null (it can be a revisit, never the one referred to, unless all are null,
when all are responses); rows that share the largest page id are all responses; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm import files
from millrace.llm.common import new_folder, partitions, stored

LEAST = 1000
ROLL = 32 << 20  # bytes of records after which a task begins another archive
_PIECE = 1 << 18
_DATE = "2020-01-01T00:00:00Z"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_MANIFEST = "archive string, records long"
_INDEX = "archive string, sidecar string, records long"
_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, bytes, refers_to (null for responses)."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html).alias("digest"), F.octet_length(html).cast("long").alias("bytes"))
    first = rows.where(F.col("bytes") >= LEAST).groupBy("digest", "bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1").select("digest", "bytes", "keeper")
    # Only groups of copies are left on the right; adaptive execution splits a hot digest on the left.
    rows = rows.join(first, ["digest", "bytes"], "left")
    revisit = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    return rows.select("page_id", "url", F.when(revisit, F.lit("")).otherwise(F.col("html")).alias("html"), "digest", "bytes", F.when(revisit, F.col("keeper")).alias("refers_to"))


def record(page_id: int | None, url: str | None, html: str, digest: str, size: int, refers_to: int | None) -> bytes:
    revisit = refers_to is not None
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {_DATE}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    block = _HTTP if revisit else _HTTP + html.encode()
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class _Monolith:
    """One gzip member over all records that are added."""

    def __init__(self, folder: str) -> None:
        self.out, self.uri = files.writer(folder, "warc.gz")
        self.gzip, self.size, self.records = zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0

    def add(self, data: bytes) -> None:
        self.out.write(self.gzip.compress(data))
        self.size, self.records = self.size + len(data), self.records + 1

    def close(self) -> pa.RecordBatch:
        self.out.write(self.gzip.flush())
        self.out.close()
        return pa.RecordBatch.from_pydict({"archive": [self.uri], "records": pa.array([self.records], pa.int64())})


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Write the records of ``plan_records``; one row per archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = None
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("page_id", "url", "html", "digest", "bytes", "refers_to")), strict=True):
                archive = archive or _Monolith(folder)
                archive.add(record(*row))
                if archive.size >= ROLL:
                    yield archive.close()
                    archive = None
        if archive:
            yield archive.close()

    return stored(records.mapInArrow(run, _MANIFEST), "warc-manifest")


def _records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from pieces of an inflated stream."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while (end := held.find(b"\r\n\r\n")) >= 0:
            whole = end + 4 + int(held[: end + 2].partition(b"\r\nContent-Length: ")[2].partition(b"\r\n")[0]) + 4
            if len(held) < whole:
                break
            yield bytes(held[:whole])
            del held[:whole]
    if held:
        raise ValueError(f"an archive ends within a record: {len(held)} bytes left")


def _inflated(uri: str) -> Iterator[bytes]:
    gunzip = zlib.decompressobj(31)
    with files.stream(uri) as source:
        while data := source.read(_PIECE):
            while data:
                yield gunzip.decompress(data, 4 * _PIECE)
                data = gunzip.unconsumed_tail
                if gunzip.eof and (data := gunzip.unused_data):
                    gunzip = zlib.decompressobj(31)
    yield gunzip.flush()
    if not gunzip.eof:
        raise ValueError("an archive is cut off")


def rewrite(source: str, folder: str) -> tuple[str, str, int]:
    """One pass over a whole-file stream: an archive with a member per record, and its sidecar of offsets."""
    out, uri = files.writer(folder, "warc.gz")
    index, sidecar = files.writer(folder, "offsets")
    at = records = 0
    for data in _records(_inflated(source)):
        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = packer.compress(data) + packer.flush()
        out.write(member)
        index.write(f"{at}\t{len(member)}\n".encode())
        at, records = at + len(member), records + 1
    out.close()
    index.close()
    return uri, sidecar, records


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite every archive of a manifest; one row per archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                uri, sidecar, n = rewrite(source, folder)
                yield pa.RecordBatch.from_pydict({"archive": [uri], "sidecar": [sidecar], "records": pa.array([n], pa.int64())})

    return stored(manifest.repartition(partitions(manifest.sparkSession)).mapInArrow(run, _INDEX), "warc-index")


def parse(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    number = lambda name: int(fields[name].removeprefix("<urn:page:").removesuffix(">")) if name in fields else None
    body = block[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response":
        return number("WARC-Record-ID"), len(body), hashlib.sha1(body).hexdigest(), "response", None
    return number("WARC-Record-ID"), int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", number("WARC-Refers-To")


def read_archives(index: DataFrame) -> DataFrame:
    """One row per record, found through the sidecars; size and digest of responses are those of the bytes read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in _READ.split(", ")]
        types = [pa.string() if f.endswith("string") else pa.int64() for f in _READ.split(", ")]
        rows: list[tuple] = []
        flush = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for batch in batches:
            for uri, sidecar in zip(batch.column("archive").to_pylist(), batch.column("sidecar").to_pylist(), strict=True):
                with files.stream(sidecar) as lines:
                    offsets = [tuple(map(int, x.split(b"\t"))) for x in lines.read().splitlines()]
                with files.reader(uri) as source:
                    for at, size in offsets:
                        source.seek(at)
                        rows.append(parse(zlib.decompress(source.read(size), 31)))
                        if len(rows) == 1000:
                            yield flush()
                            rows.clear()
        if rows:
            yield flush()

    return index.repartition(partitions(index.sparkSession)).mapInArrow(run, _READ)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write every page, normalise the archives, and read them back."""
    folder = new_folder(pages.sparkSession, "warc")
    manifest = write_archives(plan_records(pages), f"{folder}/streams")
    return read_archives(normalise(manifest, f"{folder}/members"))
