"""Media columns: content-addressed payloads in tar shards, metadata from header-only range reads.

Rows keep no payload but the place (shard, offset, length) of its bytes in a tar file of the shared
folder, and ``digest``, the SHA-256 of those very bytes, which is also the member's name: any tar
reader can check it. Payloads that begin like text are stored as gzip files (``stored``), others as they
are; ``payload_digest`` and ``size`` are those of the payload itself. Payloads with equal digests have
one place. The row with the smallest id stores it; the rows that store nothing are broadcast where
their measured size allows, so that no payload is shuffled, and meet their rows in a shuffle beyond
that. Tasks write shards of about ``SHARD_BYTES`` under a temporary name and move them to one made
from their content, so a task that runs again after a lost executor leaves the same file.

Metadata is filled by a second pass in the order of places. It begins with ``CHUNK`` bytes of a payload
and follows the format's own structure by further range reads, so that the payload proper is never
read: JPEG segments up to the frame, RIFF chunks up to the samples, MP4 boxes, MP3 tags, HTML up to
the end of its head. It yields type, character set, language and title of documents, width and height
of PNG, GIF, JPEG, BMP, WebP and MP4, rate, channels and seconds of WAV, MP3 and MP4.

Defined cases: a null payload has null columns throughout; an empty one is stored with length 0 and
type ``application/x-empty``; payloads of any length are stored whole; a null id may own a digest, as
it sorts last; equal payloads share one place whatever their rows (rows equal in id and payload may
each store it, and still point at one place); equal rows stay equal rows; what the header doesn't show
is null; an empty table writes no shard; id, payload and the columns to keep are the only ones read; a
kept column, or an id, with the name of a media column gets ``_kept`` behind its name.
"""

from __future__ import annotations

import hashlib
import re
import struct
import tarfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm._small import small
from lectern.session import shared_dir

SHARD_BYTES, CHUNK = 256 << 20, 1024
META = "mime string, charset string, lang string, title string, width int, height int, sample_rate int, channels int, seconds double"
PLACE = "payload_digest string, digest string, shard string, offset bigint, length bigint, size bigint, stored string"
_FIELDS = [x.split()[0] for x in META.split(", ")]
_PLACE = [x.split()[0] for x in PLACE.split(", ")]
Read = Callable[[int, int], bytes]  # (where, how many): what is there of that


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def mime(head: bytes) -> str:
    """Type of a payload that begins so."""
    for mark, name in ((b"\x89PNG\r\n\x1a\n", "image/png"), (b"GIF87a", "image/gif"), (b"GIF89a", "image/gif"), (b"\xff\xd8\xff", "image/jpeg"), (b"%PDF-", "application/pdf"), (b"ID3", "audio/mpeg")):
        if head.startswith(mark):
            return name
    if head[:2] == b"BM" and head[6:10] == bytes(4):
        return "image/bmp"
    if head[:4] == b"RIFF" and head[8:12] in (b"WAVE", b"WEBP"):
        return "audio/wav" if head[8:12] == b"WAVE" else "image/webp"
    if head[4:8] == b"ftyp":
        return "audio/mp4" if head[8:12] in (b"M4A ", b"M4B ") else "video/mp4"
    if _mp3_frame(head[:4]):
        return "audio/mpeg"
    if head.lstrip(b"\xef\xbb\xbf \t\r\n").lower().startswith((b"<!doctype html", b"<html", b"<head", b"<body")):
        return "text/html"
    return "application/octet-stream" if b"\0" in head else "text/plain"


def _jpeg(read: Read) -> dict:
    at = 2
    while len(x := read(at, 9)) >= 4 and x[0] == 0xFF:
        mark = x[1]
        if mark == 0xFF:
            at += 1
        elif mark == 0x01 or 0xD0 <= mark <= 0xD7:
            at += 2
        elif 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            return {"height": int.from_bytes(x[5:7], "big"), "width": int.from_bytes(x[7:9], "big")} if len(x) == 9 else {}
        elif mark in (0xD9, 0xDA):
            break
        else:
            at += 2 + int.from_bytes(x[2:4], "big")
    return {}


def _wav(read: Read) -> dict:
    out, at, rate = {}, 12, 0
    while len(x := read(at, 24)) >= 8:
        size = int.from_bytes(x[4:8], "little")
        if x[:4] == b"fmt " and len(x) >= 20:
            out["channels"], out["sample_rate"], rate = struct.unpack("<HII", x[10:20])
        if x[:4] == b"data":
            return out | ({"seconds": size / rate} if rate else {})
        at += 8 + size + size % 2
    return out


def _webp(read: Read) -> dict:
    x = read(12, 18)
    if x[:4] == b"VP8X" and len(x) == 18:
        return {"width": 1 + int.from_bytes(x[12:15], "little"), "height": 1 + int.from_bytes(x[15:18], "little")}
    if x[:4] == b"VP8L" and len(x) >= 13 and x[8] == 0x2F:
        bits = int.from_bytes(x[9:13], "little")
        return {"width": 1 + (bits & 0x3FFF), "height": 1 + (bits >> 14 & 0x3FFF)}
    if x[:4] == b"VP8 " and x[11:14] == b"\x9d\x01\x2a":
        return {"width": int.from_bytes(x[14:16], "little") & 0x3FFF, "height": int.from_bytes(x[16:18], "little") & 0x3FFF}
    return {}


_RATES = ((11025, 12000, 8000), None, (22050, 24000, 16000), (44100, 48000, 32000))
_KBITS = {
    (3, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448), (3, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (3, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320), (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}


def _mp3_frame(x: bytes) -> tuple[int, int, int, int] | None:
    """(version bits, bits a second, rate, channels) of an MPEG audio frame header."""
    if len(x) < 4 or x[0] != 0xFF or x[1] & 0xE0 != 0xE0:
        return None
    version, layer, bits, rate = x[1] >> 3 & 3, 4 - (x[1] >> 1 & 3), x[2] >> 4, x[2] >> 2 & 3
    if version == 1 or layer == 4 or bits in (0, 15) or rate == 3:
        return None
    kbits = _KBITS[3 if version == 3 else 2, layer if version == 3 else min(layer, 2)][bits - 1]
    return version, kbits * 1000, _RATES[version][rate], 1 if x[3] >> 6 == 3 else 2


def _mp3(read: Read, length: int) -> dict:
    head, at = read(0, 10), 0
    if head[:3] == b"ID3" and len(head) == 10:
        at = 10 + sum((b & 0x7F) << s for b, s in zip(head[6:10], (21, 14, 7, 0), strict=True))
    if not (frame := _mp3_frame(read(at, 4))):
        return {}
    version, bits, rate, channels = frame
    seconds, x = 8 * (length - at) / bits, read(at, 64)
    for mark in (b"Xing", b"Info"):  # the number of frames, where it is stated
        if (p := x.find(mark)) >= 0 and len(x) >= p + 12 and x[p + 7] & 1:
            seconds = int.from_bytes(x[p + 8 : p + 12], "big") * (1152 if version == 3 else 576) / rate
    return {"sample_rate": rate, "channels": channels, "seconds": seconds}


def _mp4(read: Read, length: int) -> dict:
    out: dict = {}
    todo = [(0, length)]
    while todo:
        at, end = todo.pop()
        while at + 8 <= end and len(x := read(at, 16)) >= 8:
            size, kind, skip = int.from_bytes(x[:4], "big"), x[4:8], 8
            if size == 1 and len(x) == 16:
                size, skip = int.from_bytes(x[8:16], "big"), 16
            size = size or end - at
            if size < skip:
                return out
            body = at + skip
            if kind in (b"moov", b"trak", b"mdia", b"minf", b"stbl"):
                todo.append((body, at + size))
            elif kind == b"mvhd":
                y = read(body, 36)
                scale, span = (struct.unpack(">IQ", y[20:32]) if y[:1] == b"\1" else struct.unpack(">II", y[12:20])) if len(y) >= 32 else (0, 0)
                if scale:
                    out["seconds"] = span / scale
            elif kind == b"tkhd" and len(y := read(body + (88 if read(body, 1) == b"\1" else 76), 8)) == 8:
                w, h = struct.unpack(">II", y)
                if w and h:
                    out |= {"width": w >> 16, "height": h >> 16}
            elif kind == b"stsd":
                y = read(body + 8, 36)
                if y[4:8] in (b"mp4a", b"alac", b"Opus") and len(y) >= 34:
                    out |= {"channels": int.from_bytes(y[24:26], "big"), "sample_rate": int.from_bytes(y[32:34], "big")}
            at += size
    return out


def _html(read: Read, length: int) -> dict:
    """Read on until the head is over."""
    want = CHUNK
    while True:
        raw = read(0, want)
        text = re.sub(r"(?is)<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*>|\Z)", "", raw.decode("utf-8", "replace"))
        if len(raw) >= length or re.search(r"(?i)</head\s*>|<body[\s>]", text):
            break
        want *= 4
    out = {}
    for key, pattern in (("charset", r"<meta[^>]*charset=[\"']?([\w-]+)"), ("lang", r"<html[^>]*\slang=[\"']?([\w-]+)"), ("title", r"(?s)<title[^>]*>(.*?)</title>")):
        if m := re.search(pattern, text, re.I):
            out[key] = m[1].strip()
    return out


def metadata(read: Read | bytes, length: int) -> dict:
    """Metadata of a payload of ``length`` bytes, by as many reads of its header as it takes."""
    if isinstance(read, bytes):
        data = read
        read = lambda at, n: data[at : at + n]
    out: dict = dict.fromkeys(_FIELDS)
    if not length:
        return out | {"mime": "application/x-empty"}
    head = read(0, CHUNK)
    kind = out["mime"] = mime(head)
    if kind == "image/png" and head[12:16] == b"IHDR" and len(head) >= 24:
        out["width"], out["height"] = struct.unpack(">II", head[16:24])
    elif kind == "image/gif" and len(head) >= 10:
        out["width"], out["height"] = struct.unpack("<HH", head[6:10])
    elif kind == "image/bmp" and len(head) >= 26:
        w, h = struct.unpack("<ii", head[18:26])
        out["width"], out["height"] = w, abs(h)
    elif kind in (found := {"image/jpeg": _jpeg, "audio/wav": _wav, "image/webp": _webp}):
        out |= found[kind](read)
    elif kind in (found := {"audio/mpeg": _mp3, "video/mp4": _mp4, "audio/mp4": _mp4, "text/html": _html}):
        out |= found[kind](read, length)
    return {k: None if isinstance(v, int) and v >= 1 << 31 else v for k, v in out.items()}


class Reader:
    """Random access to a payload's bytes where they are stored: range reads, and of gzip files no more than what is asked for takes."""

    def __init__(self, file, offset: int, length: int, stored: str) -> None:
        self.file, self.offset, self.length, self.fetched = file, offset, length, 0
        self.raw, self.text, self.stream = b"", b"", zlib.decompressobj(31) if stored == "gzip" else None

    def _fetch(self, at: int, n: int) -> bytes:
        n = max(0, min(n, self.length - at))
        self.fetched += n
        return self.file.read_at(n, self.offset + at) if n else b""

    def __call__(self, at: int, n: int) -> bytes:
        if self.stream:
            step = CHUNK
            while len(self.text) < at + n and self.fetched < self.length:
                self.text += self.stream.decompress(self._fetch(self.fetched, step))
                step *= 2
            return self.text[at : at + n]
        if at + n <= CHUNK:  # most headers are there
            self.raw = self.raw or self._fetch(0, CHUNK)
            return self.raw[at : at + n]
        return self._fetch(at, n)


class _Shard:
    """A tar file in the making."""

    def __init__(self, folder: str) -> None:
        self.fs, self.folder = open_folder(folder)
        self.tmp = f"{self.folder}/.{uuid.uuid4().hex}.tmp"
        self.out, self.size, self.rows = self.fs.open_output_stream(self.tmp), 0, []
        self.name = hashlib.sha256()

    def add(self, payload_digest: str, payload: bytes) -> None:
        text = bool(payload) and mime(payload[:CHUNK]).startswith("text/")
        body, digest = payload, payload_digest
        if text:
            gzip = zlib.compressobj(6, zlib.DEFLATED, 31)  # without a time or a name, so equal payloads give equal files
            body = gzip.compress(payload) + gzip.flush()
            digest = hashlib.sha256(body).hexdigest()
        info = tarfile.TarInfo(digest)
        info.size = len(body)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT) + body + bytes(-len(body) % 512))
        self.rows.append((payload_digest, digest, self.size + 512, len(body), len(payload), "gzip" if text else "raw"))
        self.size += 512 + len(body) + -len(body) % 512
        self.name.update(digest.encode())

    def close(self) -> pa.RecordBatch:
        self.out.write(bytes(1024))
        self.out.close()
        shard = f"{self.name.hexdigest()[:32]}.tar"
        try:
            self.fs.move(self.tmp, f"{self.folder}/{shard}")
        except OSError:  # an earlier attempt left the same file
            if self.fs.get_file_info(f"{self.folder}/{shard}").type == fs.FileType.NotFound:
                raise
            self.fs.delete_file(self.tmp)
        payload, digest, offset, length, size, stored = zip(*self.rows, strict=True)
        numbers = [pa.array(x, pa.int64()) for x in (offset, length, size)]
        return pa.RecordBatch.from_arrays([pa.array(payload), pa.array(digest), pa.array([shard] * len(digest)), *numbers, pa.array(stored)], _PLACE)


def write_shards(payloads: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Columns ``PLACE`` of ``payloads`` (payload_digest, payload), written to tar files of ``folder``: a row for each digest."""

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, have = None, set()
        for b in batches:
            for digest, payload in zip(b.column("payload_digest").to_pylist(), b.column("payload"), strict=True):
                if digest in have:
                    continue
                have.add(digest)
                shard = shard or _Shard(folder)
                shard.add(digest, payload.as_py())
                if shard.size >= shard_bytes:
                    yield shard.close()
                    shard, have = None, set()
        if shard:
            yield shard.close()

    places = payloads.select("payload_digest", "payload").mapInArrow(go, PLACE).checkpoint()
    return places.groupBy("payload_digest").agg(F.min(F.struct("shard", "offset", "digest", "length", "size", "stored")).alias("p")).select("payload_digest", *[f"p.{c}" for c in _PLACE[1:]])


def fill_metadata(places: DataFrame, folder: str) -> DataFrame:
    """``places`` with the metadata columns, from range reads of the payloads' headers."""
    schema = pa.schema([pa.field(f, t) for f, t in zip(_FIELDS, [pa.string()] * 4 + [pa.int32()] * 4 + [pa.float64()], strict=True)])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = open_folder(folder)
        name, file = None, None
        for b in batches:
            rows = []
            for shard, offset, length, size, stored in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length", "size", "stored")), strict=True):
                if shard != name:
                    if file:
                        file.close()
                    name, file = shard, system.open_input_file(f"{root}/{shard}")
                rows.append(metadata(Reader(file, offset, length, stored), size))
            meta = pa.RecordBatch.from_pylist(rows, schema)
            yield pa.RecordBatch.from_arrays([*b.columns, *meta.columns], [*b.schema.names, *meta.schema.names])

    spread = places.select(*_PLACE).repartition("shard").sortWithinPartitions("shard", "offset")
    return spread.mapInArrow(go, f"{PLACE}, {META}")


def media_columns(table: DataFrame, id_column: str, payload_column: str, folder: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_column`` and ``keep`` of every row with digest, place and metadata of its payload."""
    own = [id_column, *keep]
    payload = F.col(payload_column).cast("binary")
    rows = table.select(*[F.col(c).alias(f"k{i}") for i, c in enumerate(own)], payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"))
    slim = rows.select("k0", "payload_digest").where("payload_digest is not null").distinct()
    ranked = slim.withColumn("n", F.row_number().over(Window.partitionBy("payload_digest").orderBy(F.col("k0").asc_nulls_last())))
    rest = small(ranked.where("n > 1").select(F.col("k0").alias("id"), F.col("payload_digest").alias("held")).checkpoint())
    owners = rows.where("payload_digest is not null").join(rest, F.col("k0").eqNullSafe(F.col("id")) & (F.col("payload_digest") == F.col("held")), "left_anti")
    filled = fill_metadata(write_shards(owners.select("payload_digest", "payload"), folder), folder)
    made = {c.lower() for c in [*_PLACE, *_FIELDS]}
    out = rows.drop("payload").join(filled, "payload_digest", "left")
    return out.select(*[F.col(f"k{i}").alias(f"{c}_kept" if c.lower() in made else c) for i, c in enumerate(own)], *_PLACE, *_FIELDS)


def new_folder(spark) -> str:
    """A fresh folder for shards in the shared folder."""
    uri = f"{shared_dir(spark).rstrip('/')}/media-{uuid.uuid4().hex}"
    system, path = open_folder(uri)
    system.create_dir(path, recursive=True)
    return uri


def read_payload(folder: str, shard: str, offset: int, length: int, stored: str) -> bytes:
    system, root = open_folder(folder)
    with system.open_input_file(f"{root}/{shard}") as f:
        body = f.read_at(length, offset)
    return zlib.decompress(body, 31) if stored == "gzip" else body
