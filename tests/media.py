"""Small media files made byte by byte: JPEG, PNG and TIFF-style RAW with the metadata asked for."""

from __future__ import annotations

import struct
import zlib


def tiff(make="Canon", model="EOS R5", date="2024:05:06 07:08:09", original="2024:05:06 07:08:09", gps=True, order="<") -> bytes:
    """A little TIFF: main directory, Exif directory, GPS directory at 23 30 0 S, 46 37 30 W."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8)
    texts = [(271, make), (272, model), (306, date)]
    n = len(texts) + bool(original) + bool(gps)
    data_at = 8 + 2 + 12 * n + 4
    entries, blob = [], b""

    def put(raw: bytes) -> int:
        nonlocal blob
        at = data_at + len(blob)
        blob += raw + b"\0" * (len(raw) % 2)
        return at

    def text(tag: int, value: str) -> bytes:
        raw = value.encode() + b"\0"
        where = raw.ljust(4, b"\0") if len(raw) <= 4 else struct.pack(order + "I", put(raw))
        return struct.pack(order + "HHI", tag, 2, len(raw)) + where

    entries += [text(t, v) for t, v in texts]
    if original:
        stamp = put(original.encode() + b"\0")
        at = put(struct.pack(order + "H", 1) + struct.pack(order + "HHII", 36867, 2, len(original) + 1, stamp) + b"\0\0\0\0")
        entries.append(struct.pack(order + "HHII", 34665, 4, 1, at))
    if gps:
        lat, lon = put(struct.pack(order + "6I", 23, 1, 30, 1, 0, 1)), put(struct.pack(order + "6I", 46, 1, 37, 1, 30, 1))
        body = struct.pack(order + "H", 4)
        body += struct.pack(order + "HHI", 1, 2, 2) + b"S\0\0\0" + struct.pack(order + "HHII", 2, 5, 3, lat)
        body += struct.pack(order + "HHI", 3, 2, 2) + b"W\0\0\0" + struct.pack(order + "HHII", 4, 5, 3, lon) + b"\0\0\0\0"
        entries.append(struct.pack(order + "HHII", 34853, 4, 1, put(body)))
    return head + struct.pack(order + "H", n) + b"".join(entries) + b"\0\0\0\0" + blob


def xmp(**fields: str) -> bytes:
    spaces = 'xmlns:xmp="http://ns.adobe.com/xap/1.0/" xmlns:exif="http://ns.adobe.com/exif/1.0/" xmlns:photoshop="http://ns.adobe.com/photoshop/1.0/" xmlns:rdf="http://www.w3.org/1999/02/22-rdf-syntax-ns#"'
    attributes = " ".join(f'{k.replace("_", ":")}="{v}"' for k, v in fields.items())
    return f'<x:xmpmeta xmlns:x="adobe:ns:meta/"><rdf:RDF {spaces}><rdf:Description {attributes}/></rdf:RDF></x:xmpmeta>'.encode()


def iptc(**values: str) -> bytes:
    number = {"date": 55, "time": 60, "city": 90, "state": 95, "country": 101}
    return b"".join(b"\x1c\x02" + bytes([number[k]]) + struct.pack(">H", len(v)) + v.encode() for k, v in values.items())


def jpeg(exif: bytes | None = None, extra: bytes = b"") -> bytes:
    segment = b"" if exif is None else b"\xff\xe1" + struct.pack(">H", len(exif) + 8) + b"Exif\0\0" + exif
    comment = b"" if not extra else b"\xff\xfe" + struct.pack(">H", len(extra) + 2) + extra
    return b"\xff\xd8" + segment + comment + b"\xff\xd9"


def png(*chunks: tuple[bytes, bytes]) -> bytes:
    made = b"".join(struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b)) for k, b in (*chunks, (b"IEND", b"")))
    return b"\x89PNG\r\n\x1a\n" + made
