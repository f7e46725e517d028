"""Media columns: payloads held as WAV samples, sniffed by signature when read.

Writing: bytes become 8-bit unsigned PCM samples of a RIFF/WAVE container.
Reading: an Aho-Corasick automaton over all known magic numbers finds where a
container may begin; a validator for each format confirms its structure and
declared lengths; the outermost valid container decides the type, whatever was
declared, and valid containers inside others are carved out as spans.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from surveyq.llm.common import give_back, tuned, with_text_batches

UNIT = 64
_RATE = 8000

#: Magic bytes of the formats that have a validator.
MAGIC = {
    b"RIFF": "wav",
    b"\x89PNG\r\n\x1a\n": "png",
    b"GIF87a": "gif",
    b"GIF89a": "gif",
    b"\xff\xd8\xff": "jpeg",
    b"BM": "bmp",
    b"%PDF-": "pdf",
    b"PK\x03\x04": "zip",
    b"OggS": "ogg",
    b"fLaC": "flac",
    b"\x1f\x8b\x08": "gzip",
}

#: Media types of those formats.
TYPES = {
    "wav": "audio/wav", "png": "image/png", "gif": "image/gif", "jpeg": "image/jpeg", "bmp": "image/bmp",
    "pdf": "application/pdf", "zip": "application/zip", "ogg": "audio/ogg", "flac": "audio/flac", "gzip": "application/gzip",
}


def to_wav(payload: bytes) -> bytes:
    """payload as mono 8-bit unsigned PCM; lengths of 2^32 - 64 bytes and more don't fit a RIFF header."""
    n = len(payload)
    if n >= (1 << 32) - 64:
        raise ValueError("payload is too long for one RIFF container")
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + n + n % 2, b"WAVE", b"fmt ", 16, 1, 1, _RATE, _RATE, 1, 8, b"data", n)
    return head + payload + b"\0" * (n % 2)


def _chunks(data: bytes, at: int, end: int) -> dict[bytes, tuple[int, int]] | None:
    """RIFF chunks by name, or None if their lengths don't end exactly at `end`."""
    out: dict[bytes, tuple[int, int]] = {}
    while at < end:
        if at + 8 > end:
            return None
        name, n = struct.unpack_from("<4sI", data, at)
        if at + 8 + n > end:
            return None
        out.setdefault(name, (at + 8, n))
        at += 8 + n + n % 2
    return out if at == end else None


def _wav(data: bytes, at: int, marks: Marks | None = None) -> int:
    if at + 12 > len(data) or data[at + 8 : at + 12] != b"WAVE":
        return -1
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data) or (chunks := _chunks(data, at + 12, end)) is None:
        return -1
    if b"fmt " not in chunks or b"data" not in chunks or chunks[b"fmt "][1] < 16:
        return -1
    _, channels, rate, per_second, block, bits = struct.unpack_from("<HHIIHH", data, chunks[b"fmt "][0])
    return end if channels and block == channels * bits // 8 and per_second == rate * block else -1


def _png(data: bytes, at: int, marks: Marks) -> int:
    i, first = at + 8, True
    while i + 12 <= len(data):
        n, name = struct.unpack_from(">I4s", data, i)
        if i + 12 + n > len(data) or first != (name == b"IHDR") or (first and n != 13):
            return -1
        if zlib.crc32(data[i + 4 : i + 8 + n]) != struct.unpack_from(">I", data, i + 8 + n)[0]:
            return -1
        i, first = i + 12 + n, False
        if name == b"IEND":
            return i
    return -1


class Marks:
    """What the validators of one payload share, so that many signatures cost no more than one pass.

    places: where an end mark stands, all found at once. ends: where a chain of
    blocks that starts at a place ends; chains run into each other, and each
    place is walked once.
    """

    def __init__(self, data: bytes):
        self.data = data
        self._places: dict[bytes, list[int]] = {}
        self._ends: dict[tuple[str, int], int] = {}

    def next(self, mark: bytes, at: int) -> int:
        """Where mark stands first, from at on; -1 if nowhere."""
        if mark not in self._places:
            found, i = [], self.data.find(mark)
            while i >= 0:
                found.append(i)
                i = self.data.find(mark, i + 1)
            self._places[mark] = found
        found = self._places[mark]
        k = bisect_left(found, at)
        return found[k] if k < len(found) else -1

    def chase(self, kind: str, at: int, step: Callable[[bytes, int], tuple[int, bool]]) -> int:
        """The end of the chain from at; step gives the next place, or with True the chain's end (-1: broken)."""
        seen = []
        while (end := self._ends.get((kind, at))) is None:
            seen.append(at)
            at, over = step(self.data, at)
            if over:
                end = at
                break
        for place in seen:
            self._ends[kind, place] = end
        return end


def _gif_step(data: bytes, i: int) -> tuple[int, bool]:
    """From one block's introducer to the next; places are doubled, odd ones are inside a chain of sub-blocks."""
    i, inside = i >> 1, i & 1
    if i >= len(data):
        return -1, True
    if inside:
        return ((i + 1 + data[i]) << 1) + (data[i] > 0), False
    if data[i] == 0x3B:
        return i + 1, True
    if data[i] == 0x2C and i + 10 <= len(data):
        table = 3 << ((data[i + 9] & 7) + 1) if data[i + 9] & 128 else 0
        return ((i + 11 + table) << 1) + 1, False
    return (((i + 2) << 1) + 1, False) if data[i] == 0x21 else (-1, True)


def _gif(data: bytes, at: int, marks: Marks) -> int:
    if at + 13 > len(data):
        return -1
    flags = data[at + 10]
    table = 3 << ((flags & 7) + 1) if flags & 128 else 0
    return marks.chase("gif", (at + 13 + table) << 1, _gif_step)


def _jpeg_step(data: bytes, i: int) -> tuple[int, bool]:
    """From one marker to the next."""
    if i + 2 > len(data) or data[i] != 0xFF:
        return -1, True
    kind = data[i + 1]
    if kind == 0xD9:
        return i + 2, True
    if i + 4 > len(data):
        return -1, True
    i += 2 + struct.unpack_from(">H", data, i + 2)[0]
    if kind == 0xDA:  # entropy-coded data runs to the next true marker
        while (i := data.find(b"\xff", i)) >= 0 and i + 1 < len(data) and (data[i + 1] == 0 or 0xD0 <= data[i + 1] <= 0xD7):
            i += 2
        if i < 0:
            return -1, True
    return i, False


def _jpeg(data: bytes, at: int, marks: Marks) -> int:
    return marks.chase("jpeg", at + 2, _jpeg_step)


def _bmp(data: bytes, at: int, marks: Marks) -> int:
    if at + 54 > len(data):
        return -1
    size, reserved, start, head = struct.unpack_from("<IIII", data, at + 2)
    good = not reserved and head in (40, 108, 124) and 14 + head <= start < size and at + size <= len(data)
    return at + size if good and struct.unpack_from("<H", data, at + 26)[0] == 1 else -1


def _pdf(data: bytes, at: int, marks: Marks) -> int:
    end = marks.next(b"%%EOF", at)
    return end + 5 if end >= 0 and at <= marks.next(b"startxref", at) < end else -1


def _zip(data: bytes, at: int, marks: Marks) -> int:
    end = marks.next(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return -1
    size, offset, note = struct.unpack_from("<IIH", data, end + 12)
    return end + 22 + note if at + offset + size == end and end + 22 + note <= len(data) else -1


def _ogg(data: bytes, at: int, marks: Marks) -> int:
    """A physical stream: pages on end from one that begins a logical stream to the last whole one."""
    if at + 27 > len(data) or not data[at + 5] & 2:
        return -1
    i, end = at, -1
    while data[i : i + 5] == b"OggS\0" and i + 27 <= len(data):
        n = data[i + 26]
        i += 27 + n + sum(data[i + 27 : i + 27 + n])
        if i > len(data):
            break
        end = i
    return end


def _flac_step(data: bytes, i: int) -> tuple[int, bool]:
    if i + 4 > len(data):
        return -1, True
    after = i + 4 + int.from_bytes(data[i + 1 : i + 4], "big")
    if data[i] & 128:
        return (len(data) if after <= len(data) else -1), True
    return after, False


def _flac(data: bytes, at: int, marks: Marks) -> int:
    i = at + 4
    if i + 38 > len(data) or data[i] & 127 or data[i + 1 : i + 4] != b"\0\0\x22":
        return -1
    return marks.chase("flac", i, _flac_step)


def _gzip(data: bytes, at: int, marks: Marks) -> int:
    if at + 18 > len(data) or data[at + 3] & 0xE0:
        return -1
    flags, i = data[at + 3], at + 10
    if flags & 4:
        i += 2 + int.from_bytes(data[i : i + 2], "little")
    for text in (8, 16):  # a name and a comment end with a zero byte
        if flags & text:
            if (i := marks.next(b"\0", i) + 1) == 0:
                return -1
    if flags & 2:
        i += 2
    unpack, step = zlib.decompressobj(-15), 512
    try:
        while not unpack.eof and i < len(data):
            unpack.decompress(data[i : i + step])
            i += step
            step = 65536
    except zlib.error:
        return -1
    end = min(i, len(data)) - len(unpack.unused_data) + 8
    return end if unpack.eof and end <= len(data) else -1


_VALIDATE = {"wav": _wav, "png": _png, "gif": _gif, "jpeg": _jpeg, "bmp": _bmp, "pdf": _pdf, "zip": _zip, "ogg": _ogg, "flac": _flac, "gzip": _gzip}


@dataclass(frozen=True)
class Span:
    kind: str
    start: int
    end: int


class Sniffer:
    """Finds containers by signature and keeps those that validate."""

    def __init__(self, magic: dict[bytes, str] = MAGIC):
        self.automaton = ahocorasick.Automaton()
        for mark, kind in magic.items():
            # bytes as characters of one byte each, so that offsets stay byte offsets
            self.automaton.add_word(mark.decode("latin-1"), (len(mark), kind))
        self.automaton.make_automaton()

    def spans(self, data: bytes) -> list[Span]:
        """All valid containers, by start; the longer first at one start.

        A signature inside a valid container of its own kind is content of it.
        """
        out, marks, covered = [], Marks(data), {}
        for last, (n, kind) in self.automaton.iter(data.decode("latin-1")):
            start = last + 1 - n
            if start >= covered.get(kind, 0) and (end := _VALIDATE[kind](data, start, marks)) > start:
                out.append(Span(kind, start, end))
                covered[kind] = end
        return sorted(out, key=lambda s: (s.start, -s.end, s.kind))


def sniff(data: bytes, declared: str | None, sniffer: Sniffer) -> tuple[str | None, bool, list[Span]]:
    """Media type as found (the declared one if no container fills the data), whether that corrects it, and the embedded spans."""
    spans = sniffer.spans(data)
    whole = next((s for s in spans if s.start == 0 and s.end == len(data)), None)
    found = TYPES[whole.kind] if whole else declared
    return found, found != declared, [s for s in spans if s is not whole]


def from_wav(data: bytes) -> bytes:
    """The samples of a validated container."""
    end = _wav(data, 0)
    if end < 0:
        raise ValueError("not a valid RIFF/WAVE container")
    at, n = _chunks(data, 12, end)[b"data"]
    return data[at : at + n]


def store_media(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: str = "text/plain", keep_media: bool = False, declared_col: str | None = None
) -> DataFrame:
    """Every text as a media value, read back and sniffed.

    The payload is the UTF-8 text and then zero bytes up to a positive multiple
    of 64; it is stored as 8-bit samples. Returns id, n_bytes, payload_bytes,
    payload_sha256 and tail_crc32 (of the bytes read back), media_bytes,
    media_sha256 (of the container), feature (type found, whether that
    corrected the declared one, samples, mean level and the carved spans), and
    with keep_media the container itself as `media`. The bytes read back are
    the samples of the container as it was made, found by its own headers. The
    declared type is that of declared_col, or `declared` where there is none.

    Null texts count as empty: 64 zero bytes. Equal texts give equal values. A
    null id is kept. Only id and text are read; an empty table gives no rows.
    A text of 2^32 - 64 bytes or more raises an error (Spark holds none).
    """
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sniffer = Sniffer()
        for batch, texts in with_text_batches(batches, "text"):
            rows, media = [], []
            said = [d or declared for d in batch.column(2).to_pylist()]
            for i in range(len(texts)):
                raw = texts.bytes_of(i)
                stored = to_wav(raw.ljust(max(UNIT, -(-len(raw) // UNIT) * UNIT), b"\0"))
                kind, corrected, inside = sniff(stored, said[i], sniffer)
                back = from_wav(stored)
                level = float(np.frombuffer(back, np.uint8).mean())
                carved = ",".join(f"{s.kind}@{s.start}+{s.end - s.start}" for s in inside)
                feature = f"{kind};corrected={int(corrected)};pcm_u8;samples={len(back)};mean={level:.6f};embedded={carved}"
                rows.append((len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature))
                if keep_media:
                    media.append(stored)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            extra = [pa.array(media, pa.binary())] if keep_media else []
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns, *extra], [id_col, *names, *["media"] * keep_media])

    kind = dict(docs.dtypes)[id_col]
    tuned(docs.sparkSession)
    stated = docs[declared_col].cast("string") if declared_col else F.lit(None).cast("string")
    return docs.select(docs[id_col], docs[text_col].alias("text"), stated.alias("declared")).mapInArrow(
        run,
        f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
        "media_bytes long, media_sha256 string, feature string" + ", media binary" * keep_media,
    )


def sniff_media(media: DataFrame, id_col: str, media_col: str, declared_col: str | None = None, keep_carved: bool = False) -> DataFrame:
    """What the bytes of a media column are, whatever they were declared as.

    Returns id, declared, media_type (by signature and structure; the declared
    one if no container fills the value), corrected (whether these differ),
    spans (kind, start and length of each valid container inside) and with
    keep_carved the bytes of these as `carved`.

    A null value is empty and has no type but the declared one; a null id or
    declared type is kept; equal values give equal results. Only the named
    columns are read; an empty table gives no rows.
    """
    names = ["declared", "media_type", "corrected", "spans"] + ["carved"] * keep_carved
    kinds = [pa.string(), pa.string(), pa.bool_(), pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("length", pa.int64())])), pa.list_(pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        sniffer = Sniffer()
        for batch in batches:
            rows = []
            for data, declared in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                data = data or b""
                kind, corrected, inside = sniff(data, declared, sniffer)
                spans = [{"kind": s.kind, "start": s.start, "length": s.end - s.start} for s in inside]
                rows.append((declared, kind, corrected, spans, [data[s.start : s.end] for s in inside])[: len(names)])
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds[: len(names)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [id_col, *names])

    kind = dict(media.dtypes)[id_col]
    tuned(media.sparkSession)
    stated = media[declared_col].cast("string") if declared_col else F.lit(None).cast("string")
    return media.select(media[id_col], media[media_col].alias("media"), stated.alias("declared")).mapInArrow(
        run,
        f"`{id_col}` {kind}, declared string, media_type string, corrected boolean, spans array<struct<kind:string,start:long,length:long>>"
        + ", carved array<binary>" * keep_carved,
    )
