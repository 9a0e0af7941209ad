"""Media columns: what a binary column really holds.

Magic byte strings of all known formats stand in one Aho-Corasick automaton (bytes mapped to
Latin-1). Each hit is only a hint: a validator walks the format's own structure, lengths and
checksums and gives the end of the file, or rejects the hit. A file that starts at 0 decides
the type, whatever type was declared; valid files elsewhere are carved as embedded media.

Defined cases: null bytes are the empty bytes (type ``unknown``); a file that is not whole, or of a type without
samples, has a null payload and null features and ends no job; repeated rows are looked at
each on their own; very long files take time in proportion for text, images and sound (a check ends at the next
file's start; only broken GZIP streams are unpacked as far as they go); an empty table gives no row; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, column, map_arrow, pick, portions, whole_text


def _png_end(data: bytes, at: int) -> int | None:
    here, first = at + 8, True
    while here + 12 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, here)
        end = here + 12 + size
        if end > len(data) or (first and (kind != b"IHDR" or size != 13)):
            return None
        if struct.unpack_from(">I", data, end - 4)[0] != zlib.crc32(memoryview(data)[here + 4 : end - 4]):
            return None
        if kind == b"IEND":
            return end
        here, first = end, False
    return None


def _wav_end(data: bytes, at: int) -> int | None:
    if data[at + 8 : at + 12] != b"WAVE" or at + 12 > len(data):
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    here, seen = at + 12, set()
    while here + 8 <= end:
        kind, size = struct.unpack_from("<4sI", data, here)
        here += 8 + size + size % 2
        if here > end:
            return None
        seen.add(kind)
    return end if here == end and {b"fmt ", b"data"} <= seen else None


def _bmp_end(data: bytes, at: int) -> int | None:
    if at + 54 > len(data):
        return None
    size, zero, offset, header = struct.unpack_from("<IIII", data, at + 2)
    planes, bits = struct.unpack_from("<HH", data, at + 26)
    sound = zero == 0 and header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32)
    return at + size if sound and 14 + header <= offset <= size <= len(data) - at else None


def _gif_end(data: bytes, at: int) -> int | None:
    if at + 13 > len(data):
        return None
    here = at + 13 + (3 << (data[at + 10] & 7) + 1 if data[at + 10] & 0x80 else 0)
    while here < len(data):
        mark = data[here]
        if mark == 0x3B:
            return here + 1
        if mark == 0x21:
            here += 2
        elif mark == 0x2C and here + 10 < len(data):
            flags = data[here + 9]
            here += 11 + (3 << (flags & 7) + 1 if flags & 0x80 else 0)
        else:
            return None
        while here < len(data) and data[here]:
            here += data[here] + 1
        here += 1
    return None


def _jpeg_end(data: bytes, at: int) -> int | None:
    here = at + 2
    while here + 4 <= len(data) and data[here] == 0xFF:
        mark = data[here + 1]
        if mark == 0xFF:  # a fill byte
            here += 1
            continue
        if mark == 0xD9:
            return here + 2
        if mark == 0xD8:  # another file begins
            return None
        here += 2 + struct.unpack_from(">H", data, here + 2)[0]
        if mark == 0xDA:
            while True:
                here = data.find(b"\xff", here)
                if here < 0 or here + 1 >= len(data):
                    return None
                if data[here + 1] and data[here + 1] != 0xFF and not 0xD0 <= data[here + 1] <= 0xD7:
                    break
                here += 1 if data[here + 1] == 0xFF else 2
            if data[here + 1] == 0xD9:
                return here + 2
    return None


def _gzip_end(data: bytes, at: int) -> int | None:
    unpack = zlib.decompressobj(31)
    try:
        rest = memoryview(data)[at:]
        while not unpack.eof and len(rest):
            unpack.decompress(rest[: 1 << 16], 1 << 20)
            used = min(1 << 16, len(rest)) - len(unpack.unconsumed_tail) - len(unpack.unused_data)
            if used <= 0 and not unpack.unconsumed_tail:
                break
            rest = rest[max(used, 0) :]
        return len(data) - len(rest) if unpack.eof else None
    except zlib.error:
        return None


def _pdf_end(data: bytes, at: int) -> int | None:
    """After the last end mark that has a cross-reference before it, up to the next file's head: a file that was added to has several."""
    bound = data.find(b"%PDF-", at + 5)
    bound = len(data) if bound < 0 else bound
    end = data.rfind(b"%%EOF", at, bound)
    return end + 5 if end >= 0 and data.find(b"startxref", at, end) >= 0 else None


def _webp_end(data: bytes, at: int) -> int | None:
    if data[at + 8 : at + 12] != b"WEBP" or data[at + 12 : at + 16] not in (b"VP8 ", b"VP8L", b"VP8X"):
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    return end if end <= len(data) else None


def _ogg_end(data: bytes, at: int) -> int | None:
    """After the page that ends the stream; each page has its own length."""
    here = at
    if data[at + 4 : at + 5] != b"\0" or at + 27 > len(data) or not data[at + 5] & 2:  # a stream's first page
        return None
    while data[here : here + 4] == b"OggS" and here + 27 <= len(data):
        flags, segments = data[here + 5], data[here + 26]
        end = here + 27 + segments + sum(data[here + 27 : here + 27 + segments])
        if end > len(data):
            return None
        if flags & 4:
            return end
        here = end
    return None


#: Type, magic bytes, validator.
FORMATS: tuple[tuple[str, bytes, Callable[[bytes, int], int | None]], ...] = (
    ("image/png", b"\x89PNG\r\n\x1a\n", _png_end),
    ("audio/wav", b"RIFF", _wav_end),
    ("image/webp", b"RIFF", _webp_end),
    ("audio/ogg", b"OggS", _ogg_end),
    ("image/bmp", b"BM", _bmp_end),
    ("image/gif", b"GIF87a", _gif_end),
    ("image/gif", b"GIF89a", _gif_end),
    ("image/jpeg", b"\xff\xd8\xff", _jpeg_end),
    ("application/gzip", b"\x1f\x8b\x08", _gzip_end),
    ("application/pdf", b"%PDF-", _pdf_end),
)


class Sniffer:
    def __init__(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        checks: dict[bytes, list] = {}
        for kind, magic, check in FORMATS:
            checks.setdefault(magic, []).append((kind, check))
        for magic, own in checks.items():
            self.automaton.add_word(magic.decode("latin-1"), (len(magic), own))
        self.automaton.make_automaton()

    def files(self, data: bytes) -> list[tuple[str, int, int]]:
        """Valid files as (type, start, end) by start; inside a carved file none is looked for, but for one that is the whole."""
        found, free = [], 0
        for last, (size, checks) in self.automaton.iter(data.decode("latin-1")):
            at = last + 1 - size
            if at < free:
                continue
            for kind, check in checks:
                end = check(data, at)
                if end is not None:
                    found.append((kind, at, end))
                    free = 1 if at == 0 else end
                    break
        return found

    def carved(self, data: bytes) -> list[tuple[str, int, int]]:
        """Valid files in the bytes, none inside another."""
        found, free = [], 0
        for kind, at, end in self.files(data):
            if at >= free:
                found.append((kind, at, end))
                free = end
        return found


def sniff(df: DataFrame, id_col: str, bytes_col: str, declared_col: str) -> DataFrame:
    """``id, declared, media_type, corrected, end, embedded`` of a binary column."""
    rows = pick(df, id=id_col, data=bytes_col, declared=declared_col).withColumn("data", F.coalesce("data", F.lit(b"")))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, declared string, media_type string, corrected boolean, end long, embedded array<struct<media_type:string,start:long,end:long>>"

    def start():
        sniffer = Sniffer()

        def step(batch: pa.RecordBatch):
            declared = column(batch, "declared").to_pylist()
            out: list[list] = [[], [], [], []]
            for data, said in zip(as_bytes(batch, "data"), declared):
                files = sniffer.files(data)
                kind, end = (files[0][0], files[0][2]) if files and files[0][1] == 0 else ("unknown", 0)
                row = (kind, kind != "unknown" and kind != said, end, [{"media_type": k, "start": s, "end": e} for k, s, e in files if s])
                for col, v in zip(out, row):
                    col.append(v)
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.struct([("media_type", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "declared"), *(pa.array(c, k) for c, k in zip(out, kinds))], names=["id", "declared", "media_type", "corrected", "end", "embedded"])

        return step

    return map_arrow(rows, schema, start)


def png_of(samples: bytes, width: int) -> bytes:
    """An 8-bit grey image, ``width`` samples a row."""
    grid = np.frombuffer(samples, dtype=np.uint8).reshape(-1, width)
    raw = np.zeros((len(grid), width + 1), dtype=np.uint8)
    raw[:, 1:] = grid

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, len(grid), 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw.tobytes(), 1)) + chunk(b"IEND", b"")


def wav_of(samples: bytes, rate: int = 8000) -> bytes:
    """8-bit mono sound."""
    head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, rate, rate, 1, 8, b"data", len(samples))
    return head + samples


def samples_of(kind: str, data: bytes) -> bytes:
    """The samples that ``png_of`` or ``wav_of`` stored."""
    if kind == "audio/wav":
        here = 12
        while data[here : here + 4] != b"data":
            here += 8 + struct.unpack_from("<I", data, here + 4)[0]
        size = struct.unpack_from("<I", data, here + 4)[0]
        return data[here + 8 : here + 8 + size]
    if kind != "image/png":
        raise ValueError(f"no samples in {kind}")
    here, packed, width = 8, [], 0
    while here < len(data):
        size, name = struct.unpack_from(">I4s", data, here)
        if name == b"IHDR":
            width = struct.unpack_from(">I", data, here + 8)[0]
        elif name == b"IDAT":
            packed.append(data[here + 8 : here + 8 + size])
        here += 12 + size
    grid = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(-1, width + 1)
    if grid[:, 0].any():
        raise ValueError("a filtered row")
    return grid[:, 1:].tobytes()


def store(df: DataFrame, unit: int = 576, width: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, media binary, declared``: each text's bytes, padded with 255 to a multiple of ``unit``, in a media file.

    An even number of units is stored as an image, an odd one as sound. Declared types are as crawls give them: by the text's
    checksum one of four is right, one generic, one another type, one missing.
    """
    rows = pick(df, id=id_col, text=text_col).withColumn("text", whole_text(F.col("text")))

    def start():
        def step(batch: pa.RecordBatch):
            texts = as_bytes(batch, "text")
            for lo, hi in portions(texts, 512):
                part = texts[lo:hi]
                media, declared = [], []
                for t in part:
                    units = max(1, -(-len(t) // unit))
                    payload = t + b"\xff" * (units * unit - len(t))
                    media.append(wav_of(payload) if units % 2 else png_of(payload, width))
                    true, other = ("audio/wav", "image/png") if units % 2 else ("image/png", "audio/wav")
                    declared.append((true, "application/octet-stream", other, None)[zlib.crc32(t) % 4])
                yield pa.RecordBatch.from_arrays([column(batch, "id").slice(lo, hi - lo), pa.array(map(len, part), pa.int64()), pa.array(media, pa.binary()), pa.array(declared, pa.string())], names=["id", "n_bytes", "media", "declared"])

        return step

    return map_arrow(rows, f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, media binary, declared string", start)


def describe(kind: str, samples: bytes) -> str:
    """Type, mean and a 64-bit difference hash of 8 x 9 averages."""
    grid = np.frombuffer(samples, dtype=np.uint8)
    means = grid.reshape(8, 9, -1).mean(axis=2)
    bits = np.packbits((means[:, 1:] > means[:, :-1]).ravel()).tobytes().hex()
    return f"{kind}:{len(samples)}:{grid.mean():.3f}:{bits}"


def read_back(stored: DataFrame) -> DataFrame:
    """Sniff each stored file, read its samples and compute features; the declared type is only compared.

    Takes and keeps ``id, n_bytes, declared``; adds the sniffed type, whether it corrects the declared one, the payload's and the file's
    digests, and the files that are carved out of the payload (as ``type:start:end``). What is no whole file of samples has nulls.
    """
    schema = f"id {stored.schema['id'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, declared string, media_type string, corrected boolean, carved string"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.bool_(), pa.string()]

    def start():
        sniffer = Sniffer()

        def payload_of(data: bytes) -> tuple[str, bytes | None]:
            files = sniffer.files(data)
            if not files or files[0][1] or files[0][2] != len(data):
                return "unknown", None
            try:
                return files[0][0], samples_of(files[0][0], data)
            except (ValueError, zlib.error, struct.error):  # no samples, filtered rows, a broken stream
                return files[0][0], None

        def step(batch: pa.RecordBatch):
            out: list[list] = [[] for _ in kinds]
            for data, said in zip(as_bytes(batch, "media"), column(batch, "declared").to_pylist()):
                kind, payload = payload_of(data)
                own: tuple = (None,) * 3
                feature = carved = None
                if payload is not None:
                    own = len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])
                    feature = describe(kind, payload) if len(payload) and len(payload) % 72 == 0 else None
                    carved = ",".join(f"{k}:{a}:{b}" for k, a, b in sniffer.carved(payload))
                row = (*own, len(data), hashlib.sha256(data).hexdigest(), feature, said, kind, kind != "unknown" and kind != said, carved)
                for col, v in zip(out, row):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "n_bytes"), *(pa.array(c, k) for c, k in zip(out, kinds))], names=names)

        return step

    return map_arrow(stored.select("id", "n_bytes", "media", "declared"), schema, start)
