"""Frames of the wire protocol: varint length, a tag byte, payload.

Client to server: Q (a statement), X (close). Server to client: S (names and types of columns), R (a row),
A (rows affected), E (an error's text), Z (end). Each response ends with Z, also after A and E. Varints are
little-endian base 128; a value is its kind byte and, but for NULL, its content.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Sequence
from typing import BinaryIO

QUERY, CLOSE, SCHEMA, ROW, AFFECTED, ERROR, END = b"QXSRAEZ"
#: A longer frame is refused.
MAX_FRAME = 1 << 30


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 0x7F) << shift
        if b < 0x80:
            return n, at
        shift += 7


def frame(tag: int, payload: bytes = b"") -> bytes:
    return varint(len(payload) + 1) + bytes([tag]) + payload


def read_frame(stream: BinaryIO) -> tuple[int, bytes] | None:
    """The next frame; None at the end of the stream."""
    head = b""
    while not head or head[-1] & 0x80:
        b = stream.read(1)
        if not b:
            return None
        head += b
        if len(head) > 5:
            raise ValueError("a frame's length is too long")
    size, _ = read_varint(head, 0)
    if not 0 < size <= MAX_FRAME:
        raise ValueError("a frame's length is out of range")
    body = stream.read(size)
    if len(body) < size:
        return None
    return body[0], body[1:]


def schema(columns: Sequence[tuple[str, str]]) -> bytes:
    out = varint(len(columns))
    for text in (x for pair in columns for x in pair):
        raw = text.encode()
        out += varint(len(raw)) + raw
    return out


def read_schema(data: bytes) -> list[tuple[str, str]]:
    n, at = read_varint(data, 0)
    texts = []
    for _ in range(2 * n):
        size, at = read_varint(data, at)
        texts.append(data[at : at + size].decode())
        at += size
    return list(zip(texts[::2], texts[1::2], strict=True))


def row(values: Sequence) -> bytes:
    out = bytearray()
    for v in values:
        if v is None:
            out += b"N"
        elif isinstance(v, bool):
            out += b"T" if v else b"F"
        elif isinstance(v, int):
            out += b"I" + struct.pack("<q", v)
        elif isinstance(v, float):
            out += b"D" + struct.pack("<d", v)
        else:
            kind, raw = (b"B", bytes(v)) if isinstance(v, bytes | bytearray) else (b"S", v.encode()) if isinstance(v, str) else (b"J", json.dumps(v, default=str).encode())
            out += kind + varint(len(raw)) + raw
    return bytes(out)


def read_row(data: bytes) -> list:
    out, at = [], 0
    while at < len(data):
        kind = data[at : at + 1]
        at += 1
        if kind in b"NTF":
            out.append({b"N": None, b"T": True, b"F": False}[kind])
        elif kind in b"ID":
            out.append(struct.unpack_from("<q" if kind == b"I" else "<d", data, at)[0])
            at += 8
        else:
            size, at = read_varint(data, at)
            raw = data[at : at + size]
            at += size
            out.append(bytes(raw) if kind == b"B" else raw.decode() if kind == b"S" else json.loads(raw))
    return out
