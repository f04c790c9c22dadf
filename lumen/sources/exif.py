"""EXIF tags of JPEG, PNG and TIFF images: a reader of TIFF directories, without a library.

Every offset and count is checked against the block's size, so a broken entry is left out and a broken directory is empty;
what follows is still read. A directory is read once, whatever points to it.
"""

from __future__ import annotations

import struct

#: Bytes of a value and its format, by the number of its type (TIFF 6.0). Types 2 and 7 are bytes.
TYPES = {1: (1, "B"), 2: (1, None), 3: (2, "H"), 4: (4, "I"), 5: (8, "II"), 6: (1, "b"), 7: (1, None), 8: (2, "h"), 9: (4, "i"), 10: (8, "ii"), 11: (4, "f"), 12: (8, "d")}
#: Names of tags (TIFF 6.0, EXIF 2.3). Others go by their number.
NAMES = {
    0x0100: "ImageWidth", 0x0101: "ImageLength", 0x0102: "BitsPerSample", 0x0103: "Compression", 0x0106: "PhotometricInterpretation",
    0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0111: "StripOffsets", 0x0112: "Orientation", 0x0115: "SamplesPerPixel",
    0x0116: "RowsPerStrip", 0x0117: "StripByteCounts", 0x011A: "XResolution", 0x011B: "YResolution", 0x011C: "PlanarConfiguration",
    0x0128: "ResolutionUnit", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x013C: "HostComputer", 0x013E: "WhitePoint",
    0x013F: "PrimaryChromaticities", 0x0201: "JpegIFOffset", 0x0202: "JpegIFByteCount", 0x0211: "YCbCrCoefficients", 0x0212: "YCbCrSubSampling",
    0x0213: "YCbCrPositioning", 0x0214: "ReferenceBlackWhite", 0x8298: "Copyright", 0x8769: "ExifOffset", 0x8825: "GPSInfo",
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8822: "ExposureProgram", 0x8827: "ISOSpeedRatings", 0x9000: "ExifVersion",
    0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized", 0x9010: "OffsetTime", 0x9011: "OffsetTimeOriginal", 0x9012: "OffsetTimeDigitized",
    0x9101: "ComponentsConfiguration", 0x9102: "CompressedBitsPerPixel", 0x9201: "ShutterSpeedValue", 0x9202: "ApertureValue", 0x9203: "BrightnessValue",
    0x9204: "ExposureBiasValue", 0x9205: "MaxApertureValue", 0x9206: "SubjectDistance", 0x9207: "MeteringMode", 0x9208: "LightSource", 0x9209: "Flash",
    0x920A: "FocalLength", 0x927C: "MakerNote", 0x9286: "UserComment", 0x9290: "SubsecTime", 0x9291: "SubsecTimeOriginal", 0x9292: "SubsecTimeDigitized",
    0xA000: "FlashPixVersion", 0xA001: "ColorSpace", 0xA002: "ExifImageWidth", 0xA003: "ExifImageHeight", 0xA005: "ExifInteroperabilityOffset",
    0xA20E: "FocalPlaneXResolution", 0xA20F: "FocalPlaneYResolution", 0xA210: "FocalPlaneResolutionUnit", 0xA217: "SensingMethod", 0xA300: "FileSource",
    0xA301: "SceneType", 0xA401: "CustomRendered", 0xA402: "ExposureMode", 0xA403: "WhiteBalance", 0xA404: "DigitalZoomRatio",
    0xA405: "FocalLengthIn35mmFilm", 0xA406: "SceneCaptureType", 0xA420: "ImageUniqueID", 0xA432: "LensSpecification", 0xA433: "LensMake", 0xA434: "LensModel",
}
#: Names of the tags of the directory for places.
PLACES = {
    0: "GPSVersionID", 1: "GPSLatitudeRef", 2: "GPSLatitude", 3: "GPSLongitudeRef", 4: "GPSLongitude", 5: "GPSAltitudeRef", 6: "GPSAltitude", 7: "GPSTimeStamp",
    16: "GPSImgDirectionRef", 17: "GPSImgDirection", 18: "GPSMapDatum", 29: "GPSDateStamp",
}
#: Tags that point to further directories, with the names of the tags there.
FURTHER = {0x8769: NAMES, 0x8825: PLACES, 0xA005: NAMES}


def block(content: bytes) -> bytes | None:
    """The TIFF block of an image: a JPEG's segment, a PNG's chunk, or a TIFF file itself."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    if content[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(content):
            size, kind = struct.unpack(">I4s", content[at : at + 8])
            if kind == b"eXIf":
                return content[at + 8 : at + 8 + size]
            at += 12 + size
        return None
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF and content[at + 1] != 0xDA:
        size = struct.unpack(">H", content[at + 2 : at + 4])[0]
        if content[at + 1] == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return content[at + 10 : at + 2 + size]
        at += 2 + size
    return None


class _Directories:
    def __init__(self, data: bytes):
        self.data, self.seen = data, set()
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2], "")
        if not self.order or len(data) < 8 or self._read("H", 2) != 42:
            raise ValueError("no TIFF block")

    def _read(self, kind: str, at: int) -> int:
        return struct.unpack_from(self.order + kind, self.data, at)[0]

    def tags(self, at: int, names: dict[int, str], deep: bool) -> dict[str, str]:
        out: dict[str, str] = {}
        if at in self.seen or at + 2 > len(self.data):
            return out
        self.seen.add(at)
        for k in range(self._read("H", at)):
            entry = at + 2 + 12 * k
            if entry + 12 > len(self.data):
                break
            tag, kind, n = struct.unpack_from(self.order + "HHI", self.data, entry)
            size = TYPES.get(kind, (0, None))[0] * n
            place = entry + 8 if size <= 4 else self._read("I", entry + 8)
            if size == 0 or place + size > len(self.data):
                continue
            out[names.get(tag, str(tag))] = self._value(kind, n, place)
            if deep and tag in FURTHER and kind == 4:
                out |= self.tags(self._read("I", place), FURTHER[tag], deep)
        return out

    def _value(self, kind: int, n: int, at: int) -> str:
        if kind in (1, 2, 7):
            raw = self.data[at : at + n]
            if kind == 2:
                return raw.split(b"\0")[0].decode("utf-8", "replace")
            if kind == 1 and n == 1:
                return str(raw[0])
            try:
                return raw.decode()
            except UnicodeDecodeError:
                return str(raw)
        form = TYPES[kind][1]
        flat = struct.unpack_from(self.order + form * n, self.data, at)
        if len(form) == 2:  # a numerator and a denominator
            flat = tuple(a / b if b else float("nan") for a, b in zip(flat[::2], flat[1::2]))
        return str(flat[0] if n == 1 else flat)


def tags(content: bytes, deep: bool = False) -> dict[str, str]:
    """Tag names and values as text: those of the main directory, and of the directories it points to if `deep`.

    Numbers are decimal, several are in brackets, fractions are decimal numbers (denominator 0: nan), bytes that are no
    UTF-8 are shown as Python shows them. An image without tags, or with an unreadable block, has none.
    """
    data = block(content)
    try:
        found = _Directories(data or b"")
        return found.tags(found._read("I", 4), NAMES, deep)
    except (ValueError, struct.error):
        return {}
