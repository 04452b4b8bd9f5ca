"""Signature sniffing of binary columns, and texts stored as media.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass over a blob. At each
hit the format's validator walks the structure (chunk lengths, checksums, end marks) and returns
the length it proves, or nothing. The valid one at offset 0 corrects the declared type; valid ones
elsewhere are embedded media, which can be carved by offset and length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plyframe.llm.common import slices, table

UNKNOWN = "application/octet-stream"


class Blob:
    """Bytes, and the places of end marks, searched for once."""

    def __init__(self, data: bytes) -> None:
        self.data = data
        self.marks: dict[bytes, list[int]] = {}

    def after(self, mark: bytes, at: int) -> int:
        """First place of ``mark`` from ``at`` on, or -1."""
        if mark not in self.marks:
            found, i = [], self.data.find(mark)
            while i >= 0:
                found.append(i)
                i = self.data.find(mark, i + 1)
            self.marks[mark] = found
        k = bisect_left(self.marks[mark], at)
        return self.marks[mark][k] if k < len(self.marks[mark]) else -1


def riff(b: Blob, at: int) -> tuple[str, int] | None:
    d = b.data
    if at + 12 > len(d):
        return None
    size, kind = struct.unpack_from("<I4s", d, at + 4)
    kinds = {b"WAVE": ("audio/wav", b"fmt "), b"WEBP": ("image/webp", b"VP8"), b"AVI ": ("video/x-msvideo", b"LIST")}
    end = at + 8 + size
    if kind not in kinds or end > len(d) or size < 4:
        return None
    name, need = kinds[kind]
    i, seen = at + 12, False
    while i + 8 <= end:
        tag, n = struct.unpack_from("<4sI", d, i)
        if i + 8 + n > end:
            return None
        seen |= tag.startswith(need)
        i += 8 + n + n % 2
    return (name, end - at) if seen else None


def png(b: Blob, at: int) -> tuple[str, int] | None:
    d, i, first = b.data, at + 8, True
    while i + 12 <= len(d):
        n, tag = struct.unpack_from(">I4s", d, i)
        if i + 12 + n > len(d) or first and (tag, n) != (b"IHDR", 13):
            return None
        if zlib.crc32(d[i + 4 : i + 8 + n]) != struct.unpack_from(">I", d, i + 8 + n)[0]:
            return None
        i, first = i + 12 + n, False
        if tag == b"IEND":
            return "image/png", i - at
    return None


def gif(b: Blob, at: int) -> tuple[str, int] | None:
    d, i = b.data, at + 13
    if i > len(d):
        return None
    if d[at + 10] & 0x80:
        i += 3 << (d[at + 10] & 7) + 1
    images = 0
    while i < len(d):
        kind = d[i]
        if kind == 0x3B:
            return ("image/gif", i + 1 - at) if images else None
        if kind == 0x2C and i + 10 < len(d):
            packed = d[i + 9]
            i += 11 + (3 << (packed & 7) + 1 if packed & 0x80 else 0)
            images += 1
        elif kind == 0x21:
            i += 2
        else:
            return None
        while i < len(d) and d[i]:
            i += d[i] + 1
        i += 1
    return None


def bmp(b: Blob, at: int) -> tuple[str, int] | None:
    if at + 30 > len(b.data):
        return None
    size, spare, start, header = struct.unpack_from("<IIII", b.data, at + 2)
    planes, bits = struct.unpack_from("<HH", b.data, at + 26)
    ok = spare == 0 and header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return ("image/bmp", size) if ok and 14 + header <= start <= size <= len(b.data) - at else None


def jpeg(b: Blob, at: int) -> tuple[str, int] | None:
    d, i, frame = b.data, at + 2, False
    while i + 4 <= len(d) and d[i] == 0xFF:
        kind, n = d[i + 1], struct.unpack_from(">H", d, i + 2)[0]
        if n < 2:
            return None
        frame |= 0xC0 <= kind <= 0xC3
        i += 2 + n
        if kind == 0xDA:
            end = b.after(b"\xff\xd9", i)
            return ("image/jpeg", end + 2 - at) if frame and end >= 0 else None
    return None


def pdf(b: Blob, at: int) -> tuple[str, int] | None:
    if not b.data[at + 5 : at + 8].replace(b".", b"").isdigit():
        return None
    end, near = b.after(b"%%EOF", at), b.after(b"startxref", at)
    return ("application/pdf", end + 5 - at) if 0 <= near < end else None


def zipped(b: Blob, at: int) -> tuple[str, int] | None:
    d, end = b.data, b.after(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(d):
        return None
    size, offset, comment = struct.unpack_from("<IIH", d, end + 12)
    if at + offset + size != end or d[at + offset : at + offset + 4] != b"PK\x01\x02" or end + 22 + comment > len(d):
        return None
    return "application/zip", end + 22 + comment - at


def gzip(b: Blob, at: int) -> tuple[str, int] | None:
    engine = zlib.decompressobj(31)
    try:
        i = at
        while i < len(b.data) and not engine.eof:
            part = b.data[i : i + 65536]
            engine.decompress(part)
            i += len(part)
    except zlib.error:
        return None
    return ("application/gzip", i - len(engine.unused_data) - at) if engine.eof else None


def ogg(b: Blob, at: int) -> tuple[str, int] | None:
    d, i, last = b.data, at, False
    while i + 27 <= len(d) and d[i : i + 5] == b"OggS\0" and not last:
        last, n = bool(d[i + 5] & 4), d[i + 26]
        if i + 27 + n > len(d):
            return None
        i += 27 + n + sum(d[i + 27 : i + 27 + n])
    return ("audio/ogg", i - at) if last and i <= len(d) else None


def mp4(b: Blob, at: int) -> tuple[str, int] | None:
    d, i, kinds = b.data, at, []
    while i + 8 <= len(d):
        n, kind = struct.unpack_from(">I4s", d, i)
        if kind not in (b"ftyp", b"moov", b"mdat", b"free", b"skip", b"uuid", b"moof", b"mfra", b"sidx") or n < 8 or i + n > len(d):
            break
        kinds.append(kind)
        i += n
    return ("video/mp4", i - at) if kinds[:1] == [b"ftyp"] and b"moov" in kinds else None


#: Magic bytes, their offset in the format, and the format's validator.
SIGNATURES = (
    (b"RIFF", 0, riff),
    (b"\x89PNG\r\n\x1a\n", 0, png),
    (b"GIF87a", 0, gif),
    (b"GIF89a", 0, gif),
    (b"BM", 0, bmp),
    (b"\xff\xd8\xff", 0, jpeg),
    (b"%PDF-", 0, pdf),
    (b"PK\x03\x04", 0, zipped),
    (b"\x1f\x8b\x08", 0, gzip),
    (b"OggS", 0, ogg),
    (b"ftyp", 4, mp4),
)

_AUTOMATON = None


def found(data: bytes) -> list[tuple[int, int, str]]:
    """Offset, length and type of each valid medium, by offset."""
    global _AUTOMATON
    if _AUTOMATON is None:
        _AUTOMATON = ahocorasick.Automaton()
        for k, (magic, _, _) in enumerate(SIGNATURES):
            _AUTOMATON.add_word(magic.decode("latin-1"), k)
        _AUTOMATON.make_automaton()
    blob, out = Blob(data), {}
    for end, k in _AUTOMATON.iter(data.decode("latin-1")):
        magic, offset, valid = SIGNATURES[k]
        at = end + 1 - len(magic) - offset
        if at >= 0 and (got := valid(blob, at)) is not None:
            out[at] = (at, got[1], got[0])
    return [out[k] for k in sorted(out)]


def sniff(rows: DataFrame, blob_col: str = "media", declared_col: str = "declared") -> DataFrame:
    """``rows`` with ``media_type``, ``media_length``, ``corrected`` and ``embedded`` added.

    media_type is that of the valid medium at offset 0, else application/octet-stream with the
    blob's length; corrected says that the declared type (in any case, null like unknown) was
    another. embedded lists ``(offset, length, type)`` of valid media elsewhere. A null blob has null
    in all four. Columns with these names give way.
    """
    new = ("media_type", "media_length", "corrected", "embedded")
    kept = [c for c in rows.columns if c not in new]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                types, sizes, wrong, inner = [], [], [], []
                for data, declared in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                    if data is None:
                        types.append(None), sizes.append(None), wrong.append(None), inner.append(None)
                        continue
                    got = found(data)
                    own = got.pop(0) if got and got[0][0] == 0 else (0, len(data), UNKNOWN)
                    types.append(own[2])
                    sizes.append(own[1])
                    wrong.append((declared or UNKNOWN).strip().lower() != own[2])
                    inner.append([{"offset": o, "length": n, "type": t} for o, n, t in got])
                kind = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(types, pa.string()), pa.array(sizes, pa.int64()), pa.array(wrong, pa.bool_()), pa.array(inner, kind)], names=["row", *new])

    held = rows.select(F.struct(*kept).alias("row"), F.col(blob_col).alias("blob"), F.col(declared_col).cast("string").alias("declared"))
    out = held.mapInArrow(run, f"row {held.schema['row'].dataType.simpleString()}, media_type string, media_length bigint, corrected boolean, embedded array<struct<offset:bigint,length:bigint,type:string>>")
    return out.select(*(F.col("row")[c].alias(c) for c in kept), *new)


def carve(rows: DataFrame, blob_col: str = "media") -> DataFrame:
    """A row for each embedded medium of sniffed ``rows``: their columns, ``medium`` and ``carved`` bytes."""
    one = rows.withColumn("medium", F.explode("embedded"))
    return one.withColumn("carved", F.substring(F.col(blob_col), (F.col("medium.offset") + 1).cast("int"), F.col("medium.length").cast("int")))


def wav(payload: bytes) -> bytes:
    """8-bit mono PCM with a sample for each byte."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(payload), b"WAVE", b"fmt ", 16, 1, 1, 8000, 8000, 1, 8, b"data", len(payload)) + payload


def samples(media: bytes) -> bytes:
    """The data chunk of a wave file, found by walking its chunks."""
    i = 12
    while i + 8 <= len(media):
        tag, n = struct.unpack_from("<4sI", media, i)
        if tag == b"data":
            return media[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    return b""


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: int = 64) -> DataFrame:
    """``(id_col, n_bytes, media)``: whole texts as wave files, padded with 0 to a positive multiple of ``unit``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                raw = [t or b"" for t in b.column(1).cast(pa.large_binary()).to_pylist()]
                media = [wav(t.ljust(max(unit, -(-len(t) // unit) * unit), b"\0")) for t in raw]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def digests(sniffed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The payload read back from sniffed wave files, its checksums, features and the media carved out of it; null media give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in slices(whole, 1):
                rows = []
                for media, kind, inner in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()):
                    if media is None:
                        rows.append((None,) * 7)
                        continue
                    payload = samples(media) if kind == "audio/wav" else media
                    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
                    share = counts[counts > 0] / max(1, len(payload))
                    mean = float(counts @ np.arange(256)) / max(1, len(payload))
                    feature = f"{kind};samples={len(payload)};mean={mean:.4f};entropy={float(-(share * np.log2(share)).sum()) + 0.0:.4f};distinct={len(share)};embedded={len(inner)}"
                    cut_out = [{**m, "sha256": hashlib.sha256(media[m["offset"] : m["offset"] + m["length"]]).hexdigest()} for m in inner]
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, cut_out))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string()), ("sha256", pa.string())])))
                yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=["row", *names])

    names = ("payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "carved")
    held = sniffed.select(F.struct(id_col, "n_bytes", "media_type", "corrected", F.size("embedded").alias("n_embedded")).alias("row"), "media", "media_type", "embedded")
    out = held.mapInArrow(run, f"row {held.schema['row'].dataType.simpleString()}, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string, carved array<struct<offset:bigint,length:bigint,type:string,sha256:string>>")
    return out.select(F.col(f"row.{id_col}"), "row.n_bytes", *names, "row.media_type", "row.corrected", "row.n_embedded")


def declared_by_name(n_bytes: Column) -> Column:
    """What a careless store says of its media: texts of an even number of bytes are waves, those of a multiple of three images."""
    return F.when(n_bytes % 2 == 0, "audio/wav").when(n_bytes % 3 == 0, "image/png").otherwise(UNKNOWN)


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(table(spark, sf_dir, "documents")).withColumn("declared", declared_by_name(F.col("n_bytes")))
    return digests(sniff(media))


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What SQL can tell of the stored and re-read payloads."""
    return op9_media_columns(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "media_bytes", "corrected")


MEDIA_PAYLOADS_SQL = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
n AS (SELECT doc_id, raw, octet_length(raw)::BIGINT AS n_bytes, greatest(64, 64 * ((octet_length(raw) + 63) // 64))::BIGINT AS payload_bytes FROM d)
SELECT doc_id, n_bytes, payload_bytes, sha256(raw || unhex(repeat('00', (payload_bytes - n_bytes)::INT))) AS payload_sha256, payload_bytes + 44 AS media_bytes, n_bytes % 2 <> 0 AS corrected
FROM n
"""
