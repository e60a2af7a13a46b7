"""Operator 11: round trips, formats of others, faults."""

import base64
import gzip
import hashlib
import zlib

import pytest

from tidemark.llm import common, warc

PAGES = "page_id long, url string, html string, payload string"


def wanted(rows):
    """By plain rules: (page_id, payload) -> type and reference."""
    first = {}
    for i, _, html in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        first.setdefault(html or "", i)
    seen, found = set(), []
    for i, _, html in rows:
        h = (html or "").encode()
        is_first = first[html or ""] == i and html not in seen and (html or "") not in seen
        if is_first:
            seen.add(html or "")
        found.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "response" if is_first else "revisit", None if is_first else first[html or ""]))
    return found


def key(row):
    return tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in row)


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "READ_RECORDS", 37)
    long = "x\r\n\r\nWARC/1.1 é" * 200_000
    rows = [(i, f"http://h/{i}", f"<p>{i % 40}</p>") for i in range(100, 0, -1)]
    rows += [(i, None, None) for i in range(200, 280)] + [(300, "http://a\r\nWARC-Type: x", ""), (301, "u", long), (302, "u", long), (None, "n", "only null"), (None, "n", "<p>3</p>")]
    rows += [rows[0], (77, "u", "twice"), (77, "v", "twice"), (None, "n", "nulls"), (None, "n", "nulls")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], PAGES).repartition(5)
    folder = common.scratch_path(spark, "w")
    archives = warc.write(df, f"{folder}/mono")
    made = archives.collect()
    assert sum(r["records"] for r in made) == len(rows)
    for r in made:  # one member holds all records
        with warc.open_stream(r["path"]) as stream:
            engine = zlib.decompressobj(31)
            engine.decompress(stream.read())
            assert engine.eof and not engine.unused_data
    index = warc.normalise(archives, f"{folder}/one")
    for r in index.collect()[::17]:  # any record is read alone
        with warc.open_stream(r["path"], r["offset"]) as stream:
            raw = stream.read(r["length"])
        engine = zlib.decompressobj(31)
        assert warc.parsed(engine.decompress(raw))[1] == r["record_id"] and engine.eof and not engine.unused_data
    assert {tuple(r)[1:] for r in warc.sidecar(spark, f"{folder}/one").collect()} == {tuple(r)[1:] for r in index.collect()}
    found = warc.read(index).collect()
    assert sorted(((r["key"], r["payload_bytes"], r["payload_digest"], r["type"], r["refers_to_key"]) for r in found), key=key) == sorted(wanted(rows), key=key)
    texts = {r["record_id"]: bytes(r["payload"]) for r in found if r["type"] == "response"}
    assert all(texts[r["refers_to"]] is not None and not r["payload"] for r in found if r["type"] == "revisit")
    assert len({r["record_id"] for r in found}) == len(rows) and long.encode() in texts.values()
    assert {r["url"] for r in found} >= {None, "http://a%0D%0AWARC-Type: x"}


def test_empty(spark):
    df = spark.createDataFrame([], PAGES)
    folder = common.scratch_path(spark, "w")
    archives = warc.write(df, f"{folder}/mono")
    assert archives.count() == 0 and warc.read(warc.normalise(archives, f"{folder}/one")).collect() == []


def other_tool(n):
    """Records as others write them: folded lines, other cases, no key, long blocks."""
    found = b""
    for i in range(n):
        body = b"HTTP/1.1 200 OK\r\n\r\n" + bytes([65 + i % 26]) * (i * 1000)
        digest = warc.payload_digest(body[19:])
        found += f"WARC/1.0\r\nwarc-type: response\r\nWARC-RECORD-ID: <urn:{i}>\r\nX-Note: a\r\n  b\r\nWARC-Payload-Digest: sha1:{digest}\r\ncontent-length: {len(body)}\r\n\r\n".encode() + body + warc.END
    return found


@pytest.mark.parametrize("pack", [gzip.compress, bytes, lambda raw: gzip.compress(raw[:5000]) + gzip.compress(raw[5000:]) + b"\0" * 512], ids=["gzip", "plain", "members"])
def test_streams_of_others(spark, tmp_path, pack, monkeypatch):
    monkeypatch.setattr(warc, "PIECE", 777)
    (tmp_path / "a.warc.gz").write_bytes(pack(other_tool(30)))
    index = warc.normalise(spark.createDataFrame([(f"file://{tmp_path}/a.warc.gz",)], "path string"), f"{tmp_path}/one")
    found = warc.read(index).collect()
    assert sorted((r["record_id"], r["payload_bytes"], r["key"]) for r in found) == sorted((f"<urn:{i}>", i * 1000, None) for i in range(30))


def test_broken_streams(tmp_path):
    raw = other_tool(5)
    for bad in (gzip.compress(raw)[:-20], gzip.compress(raw[:-30]), gzip.compress(b"nothing of the kind" + warc.END), raw[:-1]):
        (tmp_path / "b").write_bytes(bad)
        with warc.open_stream(str(tmp_path / "b")) as stream, pytest.raises(ValueError):
            for _, _, block in warc.records(warc.inflated(stream)):
                b"".join(block)


def test_memory_follows_the_piece_not_the_record(tmp_path, monkeypatch):
    """A block of 200 MB in a stream of 0.2 MB is passed on in pieces."""
    monkeypatch.setattr(warc, "PIECE", 1 << 16)
    size = 200 << 20
    engine = zlib.compressobj(9, zlib.DEFLATED, 31)
    with (tmp_path / "c").open("wb") as out:
        out.write(engine.compress(f"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: {size}\r\n\r\n".encode()))
        for _ in range(200):
            out.write(engine.compress(bytes(1 << 20)))
        out.write(engine.compress(warc.END) + engine.flush())
    most, total = 0, 0
    with warc.open_stream(str(tmp_path / "c")) as stream:
        for _, _, block in warc.records(warc.inflated(stream)):
            for piece in block:
                most, total = max(most, len(piece)), total + len(piece)
    assert total == size and most <= 1 << 17

