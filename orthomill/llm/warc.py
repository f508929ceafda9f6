"""WARC archives: writing, normalising monolithic gzip files to one member per record, and reading by offset.

A monolithic archive is one gzip stream that can only be read from its start. The normaliser inflates it once, piece by piece, rewrites every
record as a gzip member of its own and writes a sidecar with each member's offset and length, after which any record can be
read alone. Tasks write under a name of their own attempt and rename when done, so a repeated task leaves one file. The project has no page
records, so the interface is general.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orthomill.llm.tables import stored
from orthomill.session import scratch_path

#: Payloads below this many bytes are never revisits.
LEAST_REVISIT = 100
#: Fixed values of the format.
VERSION, PROFILE, PAGE_URN = b"WARC/1.1", b"http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"urn:page:"
_CHUNK = 1 << 20
_INDEX = "archive string, offset long, length long, record_type string, page_id string"


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One uncompressed record: a response, or where ``refers_to`` is given a revisit, with HTTP headers of the full payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    body = http if refers_to is not None else http + payload
    name = b"" if page_id is None else str(page_id).encode()
    head = [VERSION, b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <" + PAGE_URN + name + b">"]
    if url is not None:
        head.append(b"WARC-Target-URI: " + quote(url, safe=":/?#[]@!$&'()*+,;=%~-._").encode())
    head += [b"WARC-Date: " + date.encode(), b"WARC-Payload-Digest: sha256:" + digest.encode()]
    if refers_to is not None:
        head += [b"WARC-Refers-To: <" + PAGE_URN + str(refers_to).encode() + b">", b"WARC-Profile: " + PROFILE]
    head += [b"Content-Type: application/http; msgtype=response", b"Content-Length: %d" % len(body)]
    return b"\r\n".join(head) + b"\r\n\r\n" + body + b"\r\n\r\n"


def fields(head: bytes) -> dict[str, str]:
    """Header fields of a record or of its HTTP part, names in lower case."""
    out = {}
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        out[key.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


class _Sink:
    """A file under an attempt's own name that takes its place when closed."""

    def __init__(self, path: str):
        self.system, self.path = _opened(path)
        self.part = f"{self.path}.attempt-{TaskContext.get().taskAttemptId()}"
        self.stream, self.size = self.system.open_output_stream(self.part, compression=None), 0

    def write(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.part, self.path)


def with_revisits(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """``page_id``, ``url``, ``payload`` (binary), ``payload_digest`` and ``refers_to``: the smallest page of equal payloads, for the others.

    Only digests that occur twice or more are looked up, so the payloads move only if that table is large.
    """
    page = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload")).withColumn(
        "payload_digest", F.sha2("payload", 256))
    first = stored(page.filter(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                   .filter("n > 1 and first is not null").drop("n"), "warc-first")
    return page.join(first, "payload_digest", "left").withColumn(
        "refers_to", F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))).select(
        "page_id", "url", "payload", "payload_digest", "refers_to")


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", level: int = 1) -> DataFrame:
    """Write the rows of ``with_revisits`` as one monolithic gzip archive per partition; ``(archive, records)``, stored.

    Records are deflated as they come; a task holds one record and one batch of rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.gz"
        sink, deflate, n = None, zlib.compressobj(level, zlib.DEFLATED, 31), 0
        for batch in batches:
            for page_id, url, payload, digest, refers in zip(*(batch.column(i) for i in range(5))):
                sink = sink or _Sink(path)
                sink.write(deflate.compress(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers.as_py(), date)))
                n += 1
        if sink:
            sink.write(deflate.flush())
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], ["archive", "records"])

    system, base = _opened(folder)
    system.create_dir(base, recursive=True)
    return stored(pages.mapInArrow(run, "archive string, records long"), "warc-archives")


def inflated(stream) -> Iterator[bytes]:
    """The inflated pieces of a gzip file of one or many members; raises on one that is cut off."""
    member, any_data = zlib.decompressobj(31), False
    while data := stream.read(_CHUNK):
        while data:
            if member.eof:
                member = zlib.decompressobj(31)
            any_data = True
            yield member.decompress(data, _CHUNK * 4)
            while member.unconsumed_tail:
                yield member.decompress(member.unconsumed_tail, _CHUNK * 4)
            data = member.unused_data
    if any_data and not member.eof:
        raise ValueError("the gzip stream ends early")


def records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """``(header, whole record)`` of an inflated archive; holds one record at a time."""
    buffer = bytearray()

    def more() -> bool:
        for piece in pieces:
            if piece:
                buffer.extend(piece)
                return True
        return False

    while True:
        searched = 0
        while (end := buffer.find(b"\r\n\r\n", searched)) < 0:
            searched = max(0, len(buffer) - 3)
            if not more():
                if bytes(buffer).strip():
                    raise ValueError("the archive ends within a header")
                return
        head = bytes(buffer[:end])
        size = end + 8 + int(fields(head).get("content-length", "0"))
        while len(buffer) < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield head, bytes(buffer[:size])
        del buffer[:size]


def normalise_archives(archives: DataFrame, folder: str, level: int = 6, remove: bool = False) -> DataFrame:
    """Rewrite whole-file gzip archives as one member per record, with sidecars; the index as a stored table.

    ``archives`` has a column ``archive`` (paths or URIs in a folder all executors share). Of each, ``<folder>/<name>`` gets a member per record
    and ``<name>.idx`` a JSON line per record: offset, length, record_type, page_id (text; empty if the record names none). The same
    come back as rows ``archive, offset, length, record_type, page_id``, in the order of the archive. Files that
    have members per record already are taken too. A file that ends early raises. ``remove`` deletes an archive once its normal form is in place. No archives give no rows; columns beside ``archive``
    are not read. One task inflates one archive, once.
    """
    names = [c.split()[0] for c in _INDEX.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                target = f"{folder}/{path.rsplit('/', 1)[-1]}"
                sink, side, rows = _Sink(target), _Sink(f"{target}.idx"), []
                system, place = _opened(path)
                if system.get_file_info(place).type == fs.FileType.NotFound and remove and system.get_file_info(_opened(target)[1]).type == fs.FileType.File:
                    # A former attempt got as far as removing it.
                    place = _opened(target)[1]
                with system.open_input_stream(place, compression=None) as stream:
                    for head, whole in records(inflated(stream)):
                        about, deflate = fields(head), zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = deflate.compress(whole) + deflate.flush()
                        row = {"offset": sink.size, "length": len(member), "record_type": about.get("warc-type", ""),
                               "page_id": about.get("warc-record-id", "").removeprefix("<" + PAGE_URN.decode()).rstrip(">")}
                        sink.write(member)
                        side.write(json.dumps(row).encode() + b"\n")
                        rows.append([target, *row.values()])
                side.close()
                sink.close()
                if remove and place != _opened(target)[1]:
                    system.delete_file(place)
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    system, base = _opened(folder)
    system.create_dir(base, recursive=True)
    spread = int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # By name of archive, so that a task that runs again finds the same ones.
    return stored(archives.select("archive").repartition(spread, "archive").mapInArrow(run, _INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """Read the indexed records, each from its own offset.

    Returns ``page_id`` (long, null if the record names none), ``payload_bytes``, ``payload_digest`` (of a response worked out
    from its payload, of a revisit as its header has it), ``record_type``, ``refers_to``. A response whose payload doesn't match its header's digest raises.
    """
    import hashlib

    def number(text: str) -> int | None:
        text = text.removeprefix("<" + PAGE_URN.decode()).rstrip(">")
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            rows = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    system, place = _opened(archive)
                    name, file = archive, system.open_input_file(place)
                file.seek(offset)
                whole = zlib.decompress(file.read(length), 31)
                head, _, rest = whole.partition(b"\r\n\r\n")
                about = fields(head)
                http, _, payload = rest[:int(about["content-length"])].partition(b"\r\n\r\n")
                digest = about["warc-payload-digest"].removeprefix("sha256:")
                if about["warc-type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
                    raise ValueError(f"payload of {about.get('warc-record-id')} doesn't match its digest")
                rows.append((number(about["warc-record-id"]), int(fields(http)["content-length"]), digest, about["warc-type"],
                             number(about.get("warc-refers-to", ""))))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)],
                                             ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return index.select("archive", "offset", "length").mapInArrow(
        run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive_pages(spark: SparkSession, pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Write ``pages`` (``page_id`` integer, ``url``, ``html``) as archives, normalise them, and read them back by offset; one row per row.

    Of equal payloads of 100 bytes or more the smallest ``page_id`` is the response and the others are revisits of it; repeated rows of that page are responses each,
    and a null ``page_id`` revisits if any page has an id. A null html is an empty payload. ``folder`` must be one that all executors share; by default it is a
    new one in the shared folder. Monolithic archives are removed once normalised. No rows give no rows; extra columns are not written.
    """
    folder = folder or scratch_path(spark, "warc")
    if folder.startswith("/"):
        folder = f"file://{folder}"
    written = write_archives(with_revisits(pages), f"{folder}/whole")
    return read_records(normalise_archives(written, f"{folder}/members", remove=True))
