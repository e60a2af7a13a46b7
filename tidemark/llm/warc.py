"""Operator 11: WARC archives: written as one gzip stream a file, normalised to a member a record, read by a sidecar index.

``write`` makes monolithic archives: one gzip member holds all records of a file, as tools that compress whole files leave
them. ``normalise`` inflates each such stream once, from start to end and a piece at a time, and writes every record as a
gzip member of its own, with a sidecar ``.idx`` of one JSON line a record (offset, length, type, id, key, reference). What was
one unsplittable file can then be read at any record: ``read`` deals runs of index entries to tasks, which seek.

Of rows with equal payloads the one with the smallest key is a response, the others revisit it (equal keys: the row that comes
first in the table's files; null keys last). Equality is that of SHA-256 digests. A revisit keeps the HTTP head with the
payload's length, its SHA-1 digest, and refers to the response's record.

Files are written through the file system of their URI, under names that no other attempt of a task uses, and only those count
that a Parquet catalogue lists, which Spark commits once all tasks are done. So a lost executor leaves at most files that
nobody reads. Spark's own tasks hold one record and one buffer; archives hold ``MOST_BYTES`` of records or one more record.

A null payload is empty, a null URL has no target line, a null key is a record without one. Repeated rows are records of their
own. Other columns are left out. An empty table gives no archives and reads as no rows. A stream that ends early, or bytes that
are no WARC record, raise ``ValueError`` with the file's name; nothing of it is catalogued.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Uncompressed bytes after which a new archive begins; bytes that are read, inflated or written at once; records that a reading task gets.
MOST_BYTES, PIECE, READ_RECORDS = 256 << 20, 1 << 20, 4096
LEVEL = 6
#: Fixed values of the WARC 1.1 format.
VERSION, END = b"WARC/1.1", b"\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_NAMES = uuid.uuid5(uuid.NAMESPACE_URL, "urn:tidemark:warc-record")

CATALOGUE = "path string, records long, bytes long"
INDEX = "path string, offset long, length long, type string, record_id string, key long, refers_to string, refers_to_key long"
RECORD = "key long, record_id string, type string, url string, payload_bytes long, payload_digest string, refers_to string, refers_to_key long, payload binary"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(key: int | None, place: str) -> str:
    """A name that the same row always gets, and no other."""
    return f"<urn:uuid:{uuid.uuid5(RECORD_NAMES, f'{key}|{place}')}>"


def one_line(text: str) -> str:
    """Header values hold no line breaks."""
    return text.replace("\r", "%0D").replace("\n", "%0A")


def record(key: int | None, name: str, url: str | None, payload: bytes, date: str, refers_to: tuple[str, int | None] | None = None) -> tuple[bytes, bytes]:
    """(head, block) of a record. The block is an HTTP response; that of a revisit has no body."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    lines = [f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}"]
    lines += [f"WARC-Target-URI: {one_line(url)}"] if url is not None else []
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to:
        lines += [f"WARC-Profile: {SAME_PAYLOAD}", f"WARC-Refers-To: {refers_to[0]}"]
        lines += [f"X-Refers-To-Key: {refers_to[1]}"] if refers_to[1] is not None else []
    lines += [f"X-Record-Key: {key}"] if key is not None else []
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + END, block


def fields(head: bytes) -> dict[str, str]:
    """Header fields, names in lower case; the first line is the version."""
    first, _, rest = head.partition(b"\r\n")
    if not first.startswith(b"WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    found = {}
    for line in rest.decode("utf-8", "replace").split("\r\n"):
        if line[:1] in (" ", "\t") and found:  # a folded line
            found[next(reversed(found))] += " " + line.strip()
        elif line:
            name, _, value = line.partition(":")
            found[name.strip().lower()] = value.strip()
    return found


def inflated(stream) -> Iterator[bytes]:
    """What a gzip stream of one or more members holds, a piece at a time; plain bytes as they are."""
    first = stream.read(PIECE)
    if first[:2] != b"\x1f\x8b":
        while first:
            yield first
            first = stream.read(PIECE)
        return
    engine, data = zlib.decompressobj(31), first
    while True:
        while data:
            if engine.eof:
                data = data.lstrip(b"\0")  # padding between members
                if not data:
                    break
                engine = zlib.decompressobj(31)
            out = engine.decompress(data, PIECE)
            if out:
                yield out
            data = engine.unused_data if engine.eof else engine.unconsumed_tail
        data = stream.read(PIECE)
        if not data:
            break
    while not engine.eof:
        out = engine.decompress(b"", PIECE)
        if not out:
            raise ValueError("the gzip stream ends early")
        yield out


class Pieces:
    """Reads lines and lengths from an iterator of byte pieces."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, bytearray()

    def _more(self) -> bool:
        piece = next(self.pieces, b"")
        self.held += piece
        return bool(piece)

    def until(self, mark: bytes, most: int = 1 << 20) -> bytes | None:
        """All up to and with ``mark``; None at the end of the stream."""
        seen = 0
        while (at := self.held.find(mark, seen)) < 0:
            seen = max(0, len(self.held) - len(mark) + 1)
            if seen > most or not self._more():
                if self.held.strip(b"\r\n"):
                    raise ValueError("a WARC record ends early")
                return None
        found = bytes(self.held[: at + len(mark)])
        del self.held[: at + len(mark)]
        return found

    def take(self, length: int) -> Iterator[bytes]:
        while length:
            if not self.held and not self._more():
                raise ValueError("a WARC record ends early")
            piece = bytes(self.held[:length])
            del self.held[: len(piece)]
            length -= len(piece)
            yield piece


def records(pieces: Iterator[bytes]) -> Iterator[tuple[bytes, dict[str, str], Iterator[bytes]]]:
    """(head, fields, pieces of the block) of each record. The block's pieces have to be read before the next record."""
    reader = Pieces(pieces)
    while (head := reader.until(END)) is not None:
        head = head.lstrip(b"\r\n")
        found = fields(head)
        block = reader.take(int(found["content-length"]))
        yield head, found, block
        for _ in block:
            pass
        if b"".join(reader.take(len(END))) != END:
            raise ValueError("a WARC record is longer than it says")


class Archive:
    """A file that gzip members are written to. ``path`` is a URI or an absolute path; nothing is there before ``close``, or it is an orphan."""

    def __init__(self, folder: str, suffix: str):
        from pyarrow import fs

        self.path = f"{folder}/{uuid.uuid4().hex}{suffix}"
        system, inside = fs.FileSystem.from_uri(self.path)
        system.create_dir(inside.rpartition("/")[0], recursive=True)
        self.file, self.engine, self.raw, self.written, self.count = system.open_output_stream(inside, compression=None), None, 0, 0, 0

    def put(self, data: bytes) -> None:
        self.engine = self.engine or zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        self.raw += len(data)
        self._out(self.engine.compress(data))

    def _out(self, data: bytes) -> None:
        self.file.write(data)
        self.written += len(data)

    def end_member(self) -> None:
        if self.engine is not None:
            self._out(self.engine.flush())
            self.engine = None

    def close(self) -> tuple[str, int, int]:
        self.end_member()
        self.file.close()
        return self.path, self.count, self.written


def open_stream(path: str, at: int | None = None):
    """The raw bytes of a file; one that can seek if ``at`` is given."""
    from pyarrow import fs

    system, inside = fs.FileSystem.from_uri(path)
    if at is None:
        return system.open_input_stream(inside, compression=None, buffer_size=PIECE)
    file = system.open_input_file(inside)
    file.seek(at)
    return file


def _write(batches, folder: str, date: str):
    archive = None
    done = []
    for key, url, payload, place, first_key, first_place in common.batch_rows(batches):
        if archive is not None and archive.raw >= MOST_BYTES:
            done.append(archive.close())
            archive = None
        if archive is None:
            archive = Archive(folder, ".warc.gz")
        refers = None if first_place is None or first_place == place else (record_id(first_key, first_place), first_key)
        for part in (*record(key, record_id(key, place), url, payload.encode(), date, refers), END):
            archive.put(part)
        archive.count += 1
    if archive is not None:
        done.append(archive.close())
    yield from common.record_batches(done, CATALOGUE)


def _normalise(batches, folder: str):
    from pyarrow import fs

    def entries():
        for (path,) in common.batch_rows(batches):
            archive = Archive(folder, ".warc.gz")
            system, inside = fs.FileSystem.from_uri(archive.path + ".idx")
            try:
                with open_stream(path) as stream, system.open_output_stream(inside, compression=None) as sidecar:
                    for head, found, block in records(inflated(stream)):
                        start = archive.written
                        archive.put(head)
                        for piece in block:
                            archive.put(piece)
                        archive.put(END)
                        archive.end_member()
                        number = lambda name, found=found: int(found[name]) if name in found else None
                        entry = (start, archive.written - start, found.get("warc-type"), found.get("warc-record-id"), number("x-record-key"), found.get("warc-refers-to"), number("x-refers-to-key"))
                        sidecar.write(json.dumps(entry).encode() + b"\n")
                        yield archive.path, *entry
            except (ValueError, zlib.error) as error:
                raise ValueError(f"{path}: {error}") from error
            archive.close()

    yield from common.record_batches(entries(), INDEX)


def parsed(raw: bytes) -> tuple:
    """The columns of RECORD of one record."""
    ((_, found, block),) = [(head, f, b"".join(b)) for head, f, b in records(iter([raw]))]
    http, _, body = block.partition(END)
    number = lambda name: int(found[name]) if name in found else None
    lengths = [line.partition(b":")[2] for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    digest = found.get("warc-payload-digest", "").removeprefix("sha1:") or None
    if found["warc-type"] == "response" and payload_digest(body) != digest:
        raise ValueError(f"{found['warc-record-id']}: the payload does not have its digest")
    size = len(body) if found["warc-type"] == "response" else int(lengths[0])
    return number("x-record-key"), found["warc-record-id"], found["warc-type"], found.get("warc-target-uri"), size, digest, found.get("warc-refers-to"), number("x-refers-to-key"), body


def _read(batches, payloads: bool):
    def rows():
        path, file = None, None
        for name, offset, length in common.batch_rows(batches):
            if name != path:
                path, file = name, open_stream(name, offset)
            file.seek(offset)
            found = parsed(zlib.decompress(file.read(length), 31))
            yield found if payloads else (*found[:-1], None)

    yield from common.record_batches(rows(), RECORD, 256 if payloads else 4096)


def first_of_equals(rows: DataFrame, key: str, digest: str, place: str, first: str) -> DataFrame:
    """``rows`` with ``first``: key and place of the row that is a response, where others have the same digest; else null.

    Digests that many rows share are broadcast, of which there are at most ``common.HOT_SHARE``."""
    order = F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("key"), F.col(place).alias("place"))
    same, n = common.fresh(rows.columns, "first", "n")
    groups = rows.groupBy(digest).agg(F.min(order).alias(same), F.count("*").alias(n)).where(F.col(n) > 1)
    groups = common.written(groups, "equals")
    total = groups.agg(F.sum(n)).first()[0] or 0
    found = common.lookup(rows, groups, [digest], n, total)
    return found.withColumn(first, F.col(same)).drop(same, n)


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row of ``pages`` to monolithic archives in ``folder``; their catalogue (path, records, bytes)."""
    k, u, p = common.columns([key, url, payload])
    rows = common.with_row(pages.select(k.cast("long").alias("key"), u.alias("url"), F.coalesce(p, F.lit("")).alias("payload")), "row")
    rows = rows.select("key", "url", "payload", F.sha2("payload", 256).alias("digest"), F.concat_ws("#", F.col("row.file"), F.lpad(F.col("row.row").cast("string"), 20, "0")).alias("place"))
    rows = first_of_equals(rows, "key", "digest", "place", "first")
    asked = rows.select("key", "url", "payload", "place", F.col("first.key").alias("first_key"), F.col("first.place").alias("first_place"))
    return common.written(asked.mapInArrow(lambda batches: _write(batches, folder, date), CATALOGUE), "catalogue")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrite archives (column path) as a member a record, with sidecars; the index of all records. A task inflates one file at a time."""
    paths = archives.select("path")
    count = paths.count()
    spread = paths.repartition(max(1, min(count, 10_000)))
    return common.written(spread.mapInArrow(lambda batches: _normalise(batches, folder), INDEX), "warc-index")


def sidecar(spark: SparkSession, folder: str) -> DataFrame:
    """The index as the sidecars of a folder have it, for archives whose catalogue is not at hand."""
    names = ["offset", "length", "type", "record_id", "key", "refers_to", "refers_to_key"]
    kinds = dict(f.split() for f in INDEX.split(", "))
    lines = spark.read.text(f"{folder}/*.idx").select("value", F.regexp_replace("_metadata.file_path", r"\.idx$", "").alias("path"))
    # a line is an array of numbers and strings; as strings, which are then cast
    return lines.withColumn("e", F.from_json("value", "array<string>")).select("path", *[F.col("e")[i].cast(kinds[n]).alias(n) for i, n in enumerate(names)])


def read(index: DataFrame, payloads: bool = True) -> DataFrame:
    """The records that ``index`` lists, each from its own member; ``payloads`` says whether their bodies are wanted."""
    wanted = index.select("path", "offset", "length")
    parts = max(1, -(-wanted.count() // READ_RECORDS))
    dealt = wanted.repartitionByRange(parts, "path", "offset").sortWithinPartitions("path", "offset")
    return dealt.mapInArrow(lambda batches: _read(batches, payloads), RECORD)
