from __future__ import annotations

import gzip
import hashlib
import struct
import zlib

import pytest

from quillspark.llm.media import Sniffer, png_of, read_back, samples_of, sniff, store, wav_of

from .conftest import frame

SAMPLES = bytes(range(256)) * 9
GIF = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0\0\0\xff\xff\xff" + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02D\x01\x00" + b"\x3b"
BMP = struct.pack("<2sIHHI", b"BM", 58, 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0" * 4
JPEG = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd\x12\xff\x00\x34\xff\xd9"
PDF = b"%PDF-1.4 ... startxref 9 %%EOF"
WEBP = b"RIFF" + struct.pack("<I", 16) + b"WEBPVP8L" + struct.pack("<I", 4) + b"data"
OGG = b"".join(b"OggS\0" + bytes([flags]) + b"\0" * 20 + b"\x02\x03\x04" + b"x" * 7 for flags in (2, 0, 4))
GOOD = {"image/png": png_of(SAMPLES, 24), "audio/wav": wav_of(SAMPLES), "image/gif": GIF, "image/bmp": BMP, "image/jpeg": JPEG, "application/gzip": gzip.compress(b"x" * 99), "application/pdf": PDF, "image/webp": WEBP, "audio/ogg": OGG}


@pytest.mark.parametrize("kind", GOOD)
def test_formats(kind):
    sniffer, data = Sniffer(), GOOD[kind]
    assert sniffer.files(data) == [(kind, 0, len(data))]
    assert (kind, 7, 7 + len(data)) in sniffer.files(b"BM RIFF" + data + b"tail")
    assert sniffer.files(data[:-3]) == []


@pytest.mark.parametrize("n", [1, 2, 7])
def test_samples_come_back(n):
    data = SAMPLES[:576] * n
    assert samples_of("image/png", png_of(data, 24)) == data and samples_of("audio/wav", wav_of(data)) == data


def test_sniff_corrects_and_carves(spark):
    rows = [(1, GOOD["image/png"], "image/jpeg"), (2, b"junk" + GIF + b"more" + GOOD["audio/wav"], "text/plain"), (3, None, None), (4, wav_of(GIF * 4), "audio/wav")]
    got = {r["id"]: r for r in sniff(spark.createDataFrame(rows, "k long, data binary, said string"), "k", "data", "said").collect()}
    assert (got[1]["media_type"], got[1]["corrected"]) == ("image/png", True)
    assert [e["media_type"] for e in got[2]["embedded"]] == ["image/gif", "audio/wav"] and got[2]["media_type"] == "unknown"
    assert (got[3]["media_type"], got[3]["corrected"]) == ("unknown", False)
    assert (got[4]["corrected"], len(got[4]["embedded"])) == (False, 4)


def test_round_trip(docs, pairs, none, spark):
    texts = [*pairs, (1000, "x" * 576), (1001, "x" * 577)]
    got = read_back(store(frame(spark, texts))).collect()
    want = []
    for _, t in texts:
        b = (t or "").encode()
        p = b + b"\xff" * (-len(b) % 576 if b else 576)
        want.append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:])))
    assert sorted((r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got) == sorted(want)
    assert len({(r["payload_sha256"], r["media_sha256"], r["feature"]) for r in got}) == len({r["payload_sha256"] for r in got})
    by_kind = {(r["media_type"], r["declared"]) for r in got}
    assert {d for _, d in by_kind} == {"audio/wav", "image/png", "application/octet-stream", None} and len(by_kind) == 8
    assert all(r["corrected"] == (r["declared"] != r["media_type"]) for r in got)
    assert read_back(store(none)).count() == 0


def test_broken_and_foreign_files_end_no_job(spark):
    good = wav_of(SAMPLES[:576])
    rows = [(1, 576, good, "image/png"), (2, 0, good[:-1], None), (3, 0, GIF, "image/gif"), (4, 0, None, None), (5, 0, good + b"x", "audio/wav"), (6, 1, png_of(SAMPLES[:576], 24)[:40] + b"?" * 30, "image/png")]
    got = {r["id"]: r for r in read_back(spark.createDataFrame(rows, "id long, n_bytes long, media binary, declared string")).collect()}
    assert (got[1]["payload_bytes"], got[1]["corrected"], got[1]["media_type"]) == (576, True, "audio/wav")
    assert got[3]["media_type"] == "image/gif" and all(got[i]["payload_sha256"] is None and got[i]["media_sha256"] for i in (2, 3, 4, 5, 6))


def test_payloads_are_carved(spark):
    text = "before GIF89a not one, %PDF-1.4 startxref 7 %%EOF after"
    r = read_back(store(frame(spark, [(1, text)]))).first()
    at = text.index("%PDF")
    assert r["carved"] == f"application/pdf:{at}:{text.index('%%EOF') + 5}"


def test_many_magics_take_time_in_proportion():
    import time

    sniffer = Sniffer()
    began = time.perf_counter()
    for magic in (b"%PDF-1.4 ", b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x04cd", b"RIFF\xff\xff\x00\x00WAVE", b"GIF89a" + b"\0" * 7, b"OggS"):
        assert sniffer.files(magic * 50_000) == []
    assert time.perf_counter() - began < 20


def test_fill_bytes():
    data = b"\xff\xd8\xff\xff\xff\xe0\x00\x04ab\xff\xff\xda\x00\x04cd\x12\xff\x00\x34\xff\xff\xd9"
    assert Sniffer().files(data) == [("image/jpeg", 0, len(data))]


def test_a_pdf_that_was_added_to_ends_at_its_last_mark():
    data = PDF + b" added startxref 20 %%EOF"
    assert Sniffer().files(data + PDF) == [("application/pdf", 0, len(data)), ("application/pdf", len(data), len(data) + len(PDF))]
