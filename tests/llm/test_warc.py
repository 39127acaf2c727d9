import gzip
import random

import pytest

from graphloom.llm import warc as W


def test_arc_versions():
    for v in (1, 2):
        stream = W.arc_head(v, "x.arc", "20200101") + W.arc_record(v, "http://a/b c", "202001021530", b"HTTP/1.1 200 OK\r\nX: y\r\n\r\nbody\n\nmore") + W.arc_record(v, "", "20200102", b"")
        a, b = W.arc_records(stream)
        assert a["url"] == "http://a/b%20c" and a["block"].endswith(b"body\n\nmore") and b["block"] == b"" and b["url"] == "-"
        ((f, block),) = W.warc_records(W.convert(a))
        assert f["WARC-Type"] == "response" and f["WARC-Date"] == "2020-01-02T15:30:00Z" and f["WARC-Payload-Digest"] == "sha1:" + W.sha1_base32(b"body\n\nmore")
        assert block == a["block"]
        ((f, block),) = W.warc_records(W.convert(a, "7"))
        assert f["WARC-Type"] == "revisit" and block == b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n" and f["WARC-Refers-To"] == W.record_id("7")
    with pytest.raises(ValueError):
        list(W.arc_records(W.arc_head(1, "x", "2020") + b"http://a 0.0.0.0 2020 text/html 99\nshort\n"))


def test_round_trip(spark):
    rows = [(1, "http://a", "x\r\n\r\ny"), (2, None, None), (3, "http://c d", ""), (4, "http://e", "x\r\n\r\ny"), (None, "http://n", "x\r\n\r\ny"), (5, "u", "WARC/1.1\r\n\r\n"), (6, "é", "ü" * 100000), (7, "http://e", "x\r\n\r\ny"), (1, "http://a", "x\r\n\r\ny")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    got = W.round_trip(pages).collect()
    assert sorted((r.page_id or 0, r.record_type, r.refers_to or 0) for r in got) == [(0, "revisit", 1), (1, "response", 0), (1, "response", 0), (2, "response", 0), (3, "revisit", 2), (4, "revisit", 1), (5, "response", 0), (6, "response", 0), (7, "revisit", 1)]
    for r in got:
        html = next((h or "") for i, _, h in rows if i == r.page_id)
        assert r.payload_bytes == len(html.encode()) and r.payload_digest == W.sha1_base32(html.encode())
        assert r.payload is None if r.record_type == "revisit" else bytes(r.payload) == html.encode()
    assert W.round_trip(pages.limit(0)).count() == 0


BLOCKS = [b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=latin-1\r\n\r\ncaf\xe9 \xff\xfe\x00", b"HTTP/1.0 200 OK\r\n\r\n" + random.Random(3).randbytes(200_000), b"GIF89a\x00\x00\r\n\r\n"]


def records():
    return [W.convert({"url": f"http://x/{k}", "ip": "1.2.3.4", "date": "20010203040506", "type": "text/html", "block": b}) for k, b in enumerate(BLOCKS)]


def test_members_and_pieces(monkeypatch):
    plain = b"".join(records())
    for size in (1, 7, 1 << 16):
        monkeypatch.setattr(W, "INFLATE_BYTES", size)
        for data in (plain, gzip.compress(plain), b"".join(map(W.member, records()))):
            assert [b for _, b in W.warc_records(data)] == BLOCKS
        with pytest.raises(ValueError):
            list(W.warc_records(gzip.compress(plain)[:-3]))
    long = W.member(bytes(1 << 24))
    assert long[-1] == 0 and gzip.decompress(long) == bytes(1 << 24)


def test_legacy_archives(spark, tmp_path):
    (tmp_path / "arc").mkdir()
    for v in (1, 2):
        stream = W.arc_head(v, "x.arc", "20010101") + b"".join(W.arc_record(v, f"http://v{v}/{k}", "20010203040506", b) for k, b in enumerate(BLOCKS))
        (tmp_path / "arc" / f"{v}.arc").write_bytes(stream if v == 1 else gzip.compress(stream[:100]) + gzip.compress(stream[100:]))
    W.convert_archives(spark, f"{tmp_path}/arc", f"{tmp_path}/warc")
    got = {r.uri: r for r in W.read_warc(spark, f"{tmp_path}/warc").collect()}
    assert len(got) == 6
    for v in (1, 2):
        for k, b in enumerate(BLOCKS):
            r = got[f"http://v{v}/{k}"]
            assert bytes(r.payload) == W.http_split(b)[2] and r.record_type == ("response" if b.startswith(b"HTTP") else "resource") and r.page_id is None


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(W, "FILE_BYTES", 1000)
    rows = [(i, f"http://a/{i}", "".join(random.Random(i).choice("abcdefgh") for _ in range(900))) for i in range(30)]
    W.write_pages(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), f"{tmp_path}/warc")
    files = [f for f in (tmp_path / "warc").iterdir() if f.name.startswith("part-")]
    assert len(files) >= 10 and all(f.stat().st_size < 3000 for f in files)
    for f in files:  # any reader of gzip members reads them
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
    assert sorted(r.page_id for r in W.read_warc(spark, f"{tmp_path}/warc").collect()) == list(range(30))
