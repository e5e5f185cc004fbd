"""WARC archives: round trip, checks, revisits."""

import io
import os
import struct

import pytest
import zstandard

from tidemark.llm import archives as A


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, sha long")


def test_round_trip_with_revisits(spark):
    rows = [(i, f"http://h/{i}", f"<p>{'é' * i} body {i % 40}</p>" if i % 3 else "<p>hot</p>", "x", 1) for i in range(300)]
    rows += [(1000, None, None, "x", 1), (1001, "http://a\r\nb", "", "x", 1), (None, "n", "<p>hot</p>", "x", 1), (0, "again", "<p>hot</p>", "x", 1)]
    manifest = A.written(pages_of(spark, rows).repartition(3))
    got = {(r["page_id"], r["url"]): r for r in A.records(manifest, payloads=True).collect()}
    assert len(got) == len(rows)
    for i, url, html, *_ in rows:
        r = got[i, (url or "about:blank").replace("\r\n", "%0D%0A")]
        same = [p for p, _, h, *_ in rows if (h or "") == (html or "") and p is not None]
        payload = (html or "").encode()
        assert (r["payload_bytes"], r["payload_digest"]) == (len(payload), A.digest(payload))
        if i == min(same):
            assert (r["record_type"], r["refers_to"], bytes(r["payload"])) == ("response", None, payload)
        else:
            assert (r["record_type"], r["refers_to"], r["payload"]) == ("revisit", min(same), None)
    head = open(manifest.first()["path"], "rb").read(4)
    assert struct.unpack("<I", head)[0] == A.MAGIC


def test_empty_table(spark):
    manifest = A.written(pages_of(spark, [(1, "u", "h", "", 1)]).limit(0))
    assert manifest.count() == 0 and A.records(manifest).count() == 0


def archive(tmp_path, n=60):
    w = A.Writer(f"file://{tmp_path}", "t")
    for i in range(n):
        p = f"<html>{i} some text that repeats {i % 7}</html>".encode()
        w.add(A.record(i, f"http://x/{i}", p, A.digest(p), None, False))
    path = w.close()[0][0]
    return open(path, "rb").read()


def test_dictionary_is_needed_and_frames_are_single(tmp_path):
    data = archive(tmp_path)
    n = struct.unpack("<I", data[4:8])[0]
    assert n > 0
    assert len(list(A.read_archive(io.BytesIO(data)))) == 60
    with pytest.raises(A.WarcError):
        list(A.read_archive(io.BytesIO(struct.pack("<II", A.MAGIC, 0) + data[8 + n :])))
    packed = zstandard.ZstdCompressor().compress(data[8 : 8 + n])
    assert len(list(A.read_archive(io.BytesIO(struct.pack("<II", A.MAGIC, len(packed)) + packed + data[8 + n :])))) == 60


@pytest.mark.parametrize("n", [1, 2, 5, 19, 20, 40])
def test_any_number_of_records_has_a_dictionary(tmp_path, n):
    data = archive(tmp_path, n)
    assert struct.unpack("<I", data[4:8])[0] > 0
    assert [r["page_id"] for r in A.read_archive(io.BytesIO(data))] == list(range(n))


def test_archives_are_read_by_several_tasks(spark):
    pages = pages_of(spark, [(i, "u", f"<p>{i}</p>", "", 1) for i in range(60)]).repartition(6)
    read = A.records(A.written(pages))
    assert read.rdd.getNumPartitions() >= 4 and read.count() == 60


@pytest.mark.parametrize("cut", [4, 100, -5])
def test_cut_archives_fail(tmp_path, cut):
    with pytest.raises(A.WarcError):
        list(A.read_archive(io.BytesIO(archive(tmp_path)[:cut])))


def test_no_dictionary_frame_fails():
    with pytest.raises(A.WarcError):
        list(A.read_archive(io.BytesIO(zstandard.ZstdCompressor().compress(b"x" * 100))))


@pytest.mark.parametrize(
    "old, new",
    [(b"WARC/1.1", b"WARK/1.1"), (b"WARC-Date: ", b"WARC-Dote: "), (b"Content-Length: 75", b"Content-Length: 74"), (b"hello", b"jello"), (b"WARC-Type: response", b"WARC-Type: resource"), (b"\r\n\r\nHTTP", b"\r\nbad\r\n\r\nHTTP")],
)
def test_broken_records_fail(old, new):
    data = A.record(1, "http://x", b"hello", A.digest(b"hello"), None, False)
    assert A.parsed(data)["payload"] == b"hello"
    n = data.index(b"\r\n\r\nHTTP")
    size = len(data) - n - 8
    data = data.replace(b"Content-Length: %d\r\n\r\nHTTP" % size, b"Content-Length: 75\r\n\r\nHTTP") if size == 75 else data
    assert old in data or old.startswith(b"Content-Length")
    broken = data.replace(old, new, 1) if old in data else data[:-5] + data[-4:]
    with pytest.raises(A.WarcError):
        A.parsed(broken)


def test_archives_roll_over(tmp_path, monkeypatch):
    monkeypatch.setattr(A, "ARCHIVE_BYTES", 4000)
    monkeypatch.setattr(A, "SAMPLE_RECORDS", 30)
    w = A.Writer(f"file://{tmp_path}", "r")
    for i in range(200):
        p = os.urandom(100).hex().encode()
        w.add(A.record(i, "u", p, A.digest(p), None, False))
    done = w.close()
    assert len(done) > 2 and sum(n for _, n, _ in done) == 200
    assert [r["page_id"] for path, *_ in done for r in A.read_archive(open(path, "rb"))] == list(range(200))
