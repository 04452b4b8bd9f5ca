import gzip
import hashlib
import io
import struct
import zipfile
import zlib

import duckdb

from plyframe.llm import media as M


def png():
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def gif():
    return b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + bytes(6) + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"


def samples():
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("a.txt", "hello")
    bmp = b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + bytes(4)
    jpg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"ab" + b"\xff\xc0" + struct.pack(">H", 4) + b"cd" + b"\xff\xda" + struct.pack(">H", 4) + b"efdata\xff\xd9"
    ogg = b"OggS\0\x04" + bytes(20) + b"\x01\x03abc"
    mp4 = struct.pack(">I", 12) + b"ftypisom" + struct.pack(">I", 8) + b"moov"
    return {"image/png": png(), "image/gif": gif(), "image/bmp": bmp, "image/jpeg": jpg, "audio/ogg": ogg, "video/mp4": mp4, "application/zip": z.getvalue(), "application/gzip": gzip.compress(b"x" * 50), "application/pdf": b"%PDF-1.4\nstartxref\n0\n%%EOF", "audio/wav": M.wav(b"\1" * 64)}


def test_each_format_alone_embedded_and_broken():
    for kind, data in samples().items():
        assert M.found(data) == [(0, len(data), kind)], kind
        assert (7, len(data), kind) in M.found(b"BM PK\x03\x04"[:7] + data + b"tail RIFF BM GIF89a"), kind
        assert (0, len(data), kind) not in M.found(data[:-3]), kind
    assert M.found(b"RIFF BM GIF89a %PDF-x ftyp \x1f\x8b\x08 OggS \xff\xd8\xff " * 50) == [] == M.found(b"")


def test_sniff_and_carve(spark):
    inner = samples()["image/png"]
    rows = [(1, M.wav(inner + bytes(64 - len(inner) % 64)), "image/JPEG", "x"), (2, b"plain", None, "x"), (3, None, "a/b", None), (4, b"", "", "x"), (5, inner, " Image/PNG ", "x")]
    df = M.sniff(spark.createDataFrame(rows, "doc_id int, media binary, declared string, corrected string"))
    got = {r.doc_id: r for r in df.collect()}
    assert [(got[k].media_type, got[k].corrected) for k in (1, 2, 3, 4, 5)] == [("audio/wav", True), (M.UNKNOWN, False), (None, None), (M.UNKNOWN, False), ("image/png", False)]
    assert [(r.doc_id, bytes(r.carved), r.medium.offset) for r in M.carve(df).collect()] == [(1, inner, 44)]
    assert M.sniff(df.drop("embedded").limit(0)).count() == 0


def test_texts_come_back(spark):
    texts = ["a", "", None, "é" * 32, "x" * 65, "日本 BM RIFF %PDF-1 " * 20000, "a"]
    df = spark.createDataFrame([(i if i != 6 else 0, t, "m") for i, t in enumerate(texts)], "doc_id bigint, text string, media string")
    got = M.digests(M.sniff(M.stored(df).withColumn("declared", M.F.lit("image/png")))).collect()
    assert len(got) == 7
    want = []
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (64 if not raw else 0))
        want.append((i if i != 6 else 0, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(payload) + 44, hashlib.sha256(M.wav(payload)).hexdigest()))
    assert sorted((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in got) == sorted(want)
    assert all(r.corrected and r.media_type == "audio/wav" for r in got) and len({r.feature for r in got if r.doc_id == 0}) == 1


def test_query_carves_and_sql_gives_the_same(spark, tmp_path):
    texts = ["a", "", None, "ab", "abc" * 5, "tail " + pdf_text(), "é" * 33]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in M.op9_media_columns(spark, str(tmp_path)).collect()}
    assert {i: r.corrected for i, r in got.items()} == {i: len((t or "").encode()) % 2 != 0 for i, t in enumerate(texts)}
    raw = pdf_text().encode()
    assert [(c.offset, c.length, c.type, c.sha256) for c in got[5].carved] == [(49, len(raw), "application/pdf", hashlib.sha256(raw).hexdigest())]
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(map(tuple, M.media_payloads(spark, str(tmp_path)).collect())) == sorted(con.execute(M.MEDIA_PAYLOADS_SQL).fetchall())


def pdf_text():
    """The sample formats' only one that is text."""
    return samples()["application/pdf"].decode()
