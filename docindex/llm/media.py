"""Media columns: payloads stored as real media files in a binary column, and a
sniffer that doesn't trust the declared type. One Aho-Corasick pass finds all
magic bytes of a blob, a validator for each format then follows its structure
and tells its length, so that types are corrected and media inside other data
are carved out.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import attach, load, materialize

#: Payloads are padded with bytes 255 to a positive multiple of so many bytes.
FRAME, RATE = 576, 8000


def wav(samples: bytes) -> bytes:
    """8-bit unsigned mono PCM; an odd number of samples gets RIFF's pad byte."""
    pad = len(samples) & 1
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples) + pad, b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples + bytes(pad)


def wav_samples(blob: bytes) -> bytes:
    return next((body for name, body in _riff(blob, 0) if name == b"data"), b"")


def _riff(b: bytes, at: int) -> Iterator[tuple[bytes, bytes]]:
    end = at + 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    p = at + 12
    while p + 8 <= end:
        n = int.from_bytes(b[p + 4 : p + 8], "little")
        yield b[p : p + 4], b[p + 8 : p + 8 + n]
        p += 8 + n + (n & 1)


def _riff_length(b: bytes, at: int, kind: bytes, needs: bytes) -> int:
    n = 8 + int.from_bytes(b[at + 4 : at + 8], "little")
    if b[at + 8 : at + 12] != kind or at + n > len(b) or n < 12:
        return 0
    p, seen = at + 12, False
    while p < at + n:
        size = int.from_bytes(b[p + 4 : p + 8], "little")
        seen |= b[p : p + 4].startswith(needs)
        p += 8 + size + (size & 1)
    return n if seen and p == at + n else 0


def _wav_length(b: bytes, at: int) -> int:
    return _riff_length(b, at, b"WAVE", b"fmt ")


def _webp_length(b: bytes, at: int) -> int:
    return _riff_length(b, at, b"WEBP", b"VP8")


def _png_length(b: bytes, at: int) -> int:
    p = at + 8
    first = True
    while p + 12 <= len(b):
        n = int.from_bytes(b[p : p + 4], "big")
        if first and (n != 13 or b[p + 4 : p + 8] != b"IHDR") or p + 12 + n > len(b) or not b[p + 4 : p + 8].isalpha():
            return 0
        body = b[p + 4 : p + 8 + n]
        if zlib.crc32(body) != int.from_bytes(b[p + 8 + n : p + 12 + n], "big"):
            return 0
        p, first = p + 12 + n, False
        if body[:4] == b"IEND":
            return p - at
    return 0


_walks: dict[str, tuple[bytes, dict[int, int]]] = {}


def _walk(b: bytes, kind: str, p: int, step: Callable[[int], tuple[bool, int]]) -> int:
    """Where a walk from ``p`` ends. ``step`` says of a place whether it is the end, and where that or the next place is. What
    comes after a place is the same whichever way led there, so each place of a blob is passed once, however many files seem to begin in it."""
    if kind not in _walks or _walks[kind][0] is not b:
        _walks[kind] = b, {}
    known, passed = _walks[kind][1], []
    while p not in known:
        passed.append(p)
        ended, q = step(p)
        if ended:
            known[p] = q
        else:
            p = q
    end = known[p]
    known.update(dict.fromkeys(passed, end))
    return end


def _colours(flags: int) -> int:
    return 3 << (flags & 7) + 1 if flags & 128 else 0


def _gif_length(b: bytes, at: int) -> int:
    def block(p: int) -> tuple[bool, int]:
        return (False, p + 1 + b[p]) if p < len(b) and b[p] else (True, p + 1)

    def part(p: int) -> tuple[bool, int]:
        if p >= len(b):
            return True, 0
        if b[p] == 0x3B:
            return True, p + 1
        if b[p] == 0x21:
            return False, _walk(b, "gif block", p + 2, block)
        if b[p] == 0x2C and p + 10 < len(b):
            return False, _walk(b, "gif block", p + 11 + _colours(b[p + 9]), block)
        return True, 0

    end = _walk(b, "gif", at + 13 + _colours(b[at + 10]), part) if at + 13 <= len(b) else 0
    return max(end - at, 0)


def _jpeg_length(b: bytes, at: int) -> int:
    def data(p: int) -> tuple[bool, int]:
        """Image data go up to a marker that is neither stuffing nor a restart."""
        k = bisect_left(marks, p)
        if k == len(marks):
            return True, -1
        p = marks[k]
        return (False, p + 2) if p + 1 < len(b) and (b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7) else (True, p)

    def segment(p: int) -> tuple[bool, int]:
        if p + 4 > len(b) or b[p] != 0xFF:
            return True, 0
        kind, n = b[p + 1], int.from_bytes(b[p + 2 : p + 4], "big")
        if not 0xC0 <= kind <= 0xFE or n < 2:
            return True, 0
        p += 2 + n
        if kind == 0xDA:
            p = _walk(b, "jpeg data", p, data)
            if p < 0 or b[p + 1 : p + 2] == b"\xd9":
                return True, p + 2 if p >= 0 else 0
        return False, p

    marks = _places_of(b, b"\xff")
    return max(_walk(b, "jpeg", at + 2, segment) - at, 0)


def _bmp_length(b: bytes, at: int) -> int:
    if at + 30 > len(b):
        return 0
    n, zero, start, header = struct.unpack_from("<IIII", b, at + 2)
    planes, bits = struct.unpack_from("<HH", b, at + 26)
    return n if zero == 0 and header >= 40 and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and 14 + header <= start <= n <= len(b) - at else 0


_seen: dict[bytes, tuple[bytes, list[int]]] = {}


def _places_of(b: bytes, mark: bytes) -> list[int]:
    if mark not in _seen or _seen[mark][0] is not b:
        _seen[mark] = b, [m.start() for m in re.finditer(re.escape(mark), b)]
    return _seen[mark][1]


def _pdf_length(b: bytes, at: int) -> int:
    """Up to the first end mark; marks are looked for once in a blob, however many files seem to begin in it."""
    if not (b[at + 5 : at + 6].isdigit() and b[at + 6 : at + 7] == b"."):
        return 0
    ends, tables = (_places_of(b, m) for m in (b"%%EOF", b"startxref"))
    k, j = bisect_left(ends, at), bisect_left(tables, at)
    return ends[k] + 5 - at if k < len(ends) and j < len(tables) and tables[j] < ends[k] else 0


def _gzip_length(b: bytes, at: int) -> int:
    """Header, deflated data and a trailer with their checksum and length. Where names in the
    header end is looked up, so that no header is read to the end of the blob."""
    if at + 18 > len(b) or (flags := b[at + 3]) & 0xE0:
        return 0
    p = at + 10
    if flags & 4:
        p += 2 + int.from_bytes(b[p : p + 2], "little")
    for named in (8, 16):
        if flags & named:
            zeros = _places_of(b, b"\0")
            k = bisect_left(zeros, p)
            if k == len(zeros):
                return 0
            p = zeros[k] + 1
    p += 2 if flags & 2 else 0
    one, view, crc, size = zlib.decompressobj(-15), memoryview(b), 0, 0
    try:
        for q in range(p, len(b), 1 << 16):
            out = one.decompress(view[q : q + (1 << 16)])
            crc, size = zlib.crc32(out, crc), size + len(out)
            if one.eof:
                end = min(q + (1 << 16), len(b)) - len(one.unused_data)
                return end + 8 - at if b[end : end + 8] == struct.pack("<II", crc, size % 2**32) else 0
    except zlib.error:
        pass
    return 0


#: Magic bytes of the formats.
MAGIC: dict[bytes, list[tuple[str, Callable[[bytes, int], int]]]] = {
    b"RIFF": [("audio/wav", _wav_length), ("image/webp", _webp_length)],
    b"\x89PNG\r\n\x1a\n": [("image/png", _png_length)],
    b"GIF87a": [("image/gif", _gif_length)],
    b"GIF89a": [("image/gif", _gif_length)],
    b"\xff\xd8\xff": [("image/jpeg", _jpeg_length)],
    b"BM": [("image/bmp", _bmp_length)],
    b"%PDF-": [("application/pdf", _pdf_length)],
    b"\x1f\x8b\x08": [("application/gzip", _gzip_length)],
}


def automaton():
    import ahocorasick

    out = ahocorasick.Automaton()
    for magic in MAGIC:
        out.add_word(magic.decode("latin-1"), magic)
    out.make_automaton()
    return out


def sniff(blob: bytes, find) -> list[tuple[str, int, int]]:
    """Media (type, start, length) in a blob, by start; those inside another
    follow it. A place where no validator agrees is not media."""
    out = []
    for last, magic in find.iter(blob.decode("latin-1")):
        at = last + 1 - len(magic)
        for kind, length in MAGIC[magic]:
            if n := length(blob, at):
                out.append((kind, at, n))
    return sorted(out, key=lambda x: (x[1], -x[2]))


def store_texts(docs: DataFrame, declared: str | Column = "application/octet-stream") -> DataFrame:
    """doc_id, n_bytes, declared type and the media file of each text (null: empty)."""
    attach(docs.sparkSession)
    said = F.lit(declared) if isinstance(declared, str) else declared

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [(t.as_py() or "").encode() for t in batch.column(1)]
            media = [wav(r + b"\xff" * (-len(r) % FRAME if r else FRAME)) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), batch.column(2), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "declared", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text", said.alias("said")).mapInArrow(encode, "doc_id long, n_bytes long, declared string, media binary")


def sniff_media(df: DataFrame) -> DataFrame:
    """Look into ``media`` (binary): ``type`` is that of the file the blob is (null
    if it is none or the blob is null), ``type_ok`` whether ``declared`` says so,
    ``embedded`` the media carved from inside, payload figures those of 8-bit
    samples (null for other types). Other columns stay, ``media`` gives way to its digest, and so do
    columns with the names of the new ones."""
    new = ("media_bytes", "media_sha256", "type", "type_ok", "embedded", "payload_bytes", "payload_sha256", "tail_crc32", "feature")
    df = df.select(*(c for c in df.columns if c.lower() not in new))
    kept = [c for c in df.columns if c != "media"]
    extra = "media_bytes long, media_sha256 string, type string, type_ok boolean, embedded array<struct<type:string,start:long,length:long>>, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != "media") + ", " + extra
    at, said = df.columns.index("media"), df.columns.index("declared")
    inner = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
    types = [pa.int64(), pa.string(), pa.string(), pa.bool_(), inner, pa.int64(), pa.string(), pa.int64(), pa.string()]
    names = [x.strip().split(" ")[0] for x in ("media_bytes", "media_sha256", "type", "type_ok", "embedded", "payload_bytes", "payload_sha256", "tail_crc32", "feature")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        for batch in batches:
            rows = []
            for value, declared in zip(batch.column(at), batch.column(said).to_pylist(), strict=True):
                blob = value.as_py()
                if blob is None:
                    rows.append((None,) * 9)
                    continue
                found = sniff(blob, find)
                kind = found[0][0] if found and found[0][1] == 0 else None
                inside = [dict(zip(("type", "start", "length"), f, strict=True)) for f in (found[1:] if kind else found)]
                row = (len(blob), hashlib.sha256(blob).hexdigest(), kind, declared == kind, inside)
                if kind == "audio/wav":
                    pcm = wav_samples(blob)
                    x = np.frombuffer(pcm, np.uint8)
                    mean = float(x.mean()) if len(x) else 0.0
                    feature = f"frames={len(pcm) // FRAME};mean={mean:.4f};rms={float(np.sqrt(np.mean((x - mean) ** 2))) if len(x) else 0.0:.4f};crossings={int(np.count_nonzero(np.diff((x > mean).view(np.int8))))}"
                    row += (len(pcm), hashlib.sha256(pcm).hexdigest(), zlib.crc32(pcm[-32:]), feature)
                else:
                    row += (None, None, None, None)
                rows.append(row)
            own = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 9, types, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *own], [*kept, *names])

    return df.mapInArrow(look, schema)


def carve_media(df: DataFrame) -> DataFrame:
    """The media inside ``media`` (binary) as files of their own: a row for each, with ``carved_type``,
    ``carved_start``, ``carved_length`` and ``carved`` (the bytes); the blob itself, where it is a media file, isn't
    repeated. Other columns stay; any with these names give way, ``media`` is dropped."""
    attach(df.sparkSession)
    new = ("carved_type", "carved_start", "carved_length", "carved")
    kept = [c for c in df.columns if c != "media" and c.lower() not in new]
    schema = ", ".join([*(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in kept), "carved_type string, carved_start long, carved_length long, carved binary"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = automaton()
        for batch in batches:
            owner, rows = [], []
            for k, value in enumerate(batch.column(len(kept))):
                blob = value.as_py()
                found = sniff(blob, find) if blob is not None else []
                for kind, at, n in found[1:] if found and found[0][1] == 0 else found:
                    owner.append(k)
                    rows.append((kind, at, n, blob[at : at + n]))
            cols = [*zip(*rows, strict=True)] if rows else [[]] * 4
            own = [pa.array(c, t) for c, t in zip(cols, [pa.string(), pa.int64(), pa.int64(), pa.binary()], strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(owner, pa.int64())) for c in range(len(kept))), *own], [*kept, *new])

    return df.select(*kept, "media").mapInArrow(cut, schema)


#: What the query declares its media as, in turn; two of three are wrong.
DECLARED = ("audio/wav", "image/png", "application/octet-stream")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = F.element_at(F.array(*(F.lit(x) for x in DECLARED)), (F.pmod("doc_id", F.lit(len(DECLARED))) + 1).cast("int"))
    stored = materialize(store_texts(load(spark, sf_dir, "documents"), declared), "media")
    seen = sniff_media(stored)
    return seen.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", F.concat(F.lit("type="), F.col("type"), F.lit(";"), F.col("feature"), F.lit(";embedded="), F.size("embedded").cast("string")).alias("feature"), "type", F.col("type_ok").alias("declared_ok"))
