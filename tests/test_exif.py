"""EXIF of images that are built here, whole and broken, in both byte orders."""

import struct

import pytest

from lumen.operators import providers
from lumen.sources import exif

SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8, 12: 8}


def directory(order, at, entries, further=0):
    """A directory at an offset: (tag, type, count, packed value); large values follow it."""
    out, tail = struct.pack(order + "H", len(entries)), b""
    free = at + 2 + 12 * len(entries) + 4
    for tag, kind, n, value in entries:
        if len(value) <= 4:
            out += struct.pack(order + "HHI", tag, kind, n) + value.ljust(4, b"\0")
        else:
            out += struct.pack(order + "HHII", tag, kind, n, free + len(tail))
            tail += value
    return out + struct.pack(order + "I", further) + tail


def tiff(order):
    p = lambda f, *x: struct.pack(order + f, *x)
    main = lambda sub, place: directory(order, 8, [
        (0x010F, 2, 6, b"Canon\0"), (0x0112, 3, 1, p("H", 6)), (0x011A, 5, 1, p("II", 72, 1)), (0x8769, 4, 1, p("I", sub)), (0x8825, 4, 1, p("I", place)), (0xC0DE, 3, 3, p("HHH", 1, 2, 3)), (0x0102, 3, 2, p("HH", 8, 9))])
    size = 8 + len(main(0, 0))
    sub = lambda at: directory(order, at, [(0x829A, 5, 1, p("II", 1, 0)), (0x9204, 10, 1, p("ii", -1, 2)), (0x9003, 2, 20, b"2024:01:02 03:04:05\0"), (0x927C, 7, 5, b"\xff\xfe\x00ab"), (0x9000, 7, 4, b"0230"), (0xA005, 4, 1, p("I", 8))])
    last = size + len(sub(size))
    place = directory(order, last, [(1, 2, 2, b"N\0"), (2, 5, 3, p("IIIIII", 48, 1, 30, 1, 9, 2))])
    return (b"II*\0" if order == "<" else b"MM\0*") + p("I", 8) + main(size, last) + sub(size) + place


MAIN = {"Make": "Canon", "Orientation": "6", "XResolution": "72.0", "49374": "(1, 2, 3)", "BitsPerSample": "(8, 9)"}
DEEP = {"ExposureTime": "nan", "ExposureBiasValue": "-0.5", "DateTimeOriginal": "2024:01:02 03:04:05", "MakerNote": str(b"\xff\xfe\x00ab"), "ExifVersion": "0230", "GPSLatitudeRef": "N", "GPSLatitude": "(48.0, 30.0, 4.5)"}


def jpeg(block):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(block) + 8) + b"Exif\0\0" + block + b"\xff\xc0\x00\x0b\x08" + struct.pack(">HH", 9, 4) + b"\x01\x01\x11\x00\xff\xda"


def png(block):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"crc_"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">II", 7, 5) + b"\x08\x02\0\0\0") + chunk(b"eXIf", block) + chunk(b"IEND", b"")


@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("wrap", [jpeg, png, bytes])
def test_tags_in_both_byte_orders(order, wrap):
    got = exif.tags(wrap(tiff(order)))
    assert {k: v for k, v in got.items() if k not in ("ExifOffset", "GPSInfo")} == MAIN and got["ExifOffset"].isdigit()
    deep = exif.tags(wrap(tiff(order)), deep=True)
    assert {k: v for k, v in deep.items() if k not in ("ExifOffset", "GPSInfo", "ExifInteroperabilityOffset")} == MAIN | DEEP


def test_broken_blocks_give_what_is_left():
    whole = tiff("<")
    for cut in range(len(whole)):  # any truncation
        assert set(exif.tags(whole[:cut], deep=True).items()) <= set(exif.tags(whole, deep=True).items()) | {("ExifOffset", ""), ("GPSInfo", "")}
    far = bytearray(directory("<", 8, [(0x010F, 2, 9, b"123456789"), (0x0110, 2, 3, b"ab\0"), (0x8769, 4, 1, struct.pack("<I", 8))]))
    far[10:14] = struct.pack("<I", 1 << 31)  # the value of the first entry lies far outside
    assert exif.tags(b"II*\0\x08\0\0\0" + bytes(far), deep=True) == {"Model": "ab", "ExifOffset": "8"}
    for bad in (b"", b"II*\0", b"XX*\0aaaa", b"MM\0*\xff\xff\xff\xff", b"\xff\xd8\xff\xe1\xff\xff", jpeg(b""), png(b"II"), b"II*\0\x08\0\0\0" + struct.pack("<HHHI", 1, 0x010F, 99, 7)):
        assert exif.tags(bad) == {}


def test_images_of_a_table(spark):
    rows = [("a.jpg", jpeg(tiff(">"))), ("b.png", png(tiff("<"))), ("c.txt", b"no image"), ("d.jpg", None)]
    got = {r.path: (r.dimensions, dict(r.exif)) for r in providers.with_image_info(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert got["a.jpg"][0] == "4x9" and got["b.png"][0] == "7x5" and got["c.txt"] == got["d.jpg"] == ("", {})
    assert got["a.jpg"][1]["Make"] == got["b.png"][1]["Make"] == "Canon"
