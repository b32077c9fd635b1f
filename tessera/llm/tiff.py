"""TIFF columns: a writer and a reader of 8-bit grey images, one row per page.

``pages`` walks the image directories of a file, decodes PackBits, LZW or deflate data in
strips or tiles, undoes horizontal predictors and yields each page's samples; ``page_rows`` makes rows of
them, and ``media_digests`` folds the rows of a file, which follow each other, without holding more than a page. ``write``
makes such files, with the layout of a page chosen by a checksum of its samples, so that
equal payloads give equal files and a corpus has all layouts, each as often as the others.

Defined results: null text counts as empty, which is a payload of 64 zero bytes; repeated
texts give equal values; a payload of any length is cut into pages of at most ``PAGE_ROWS``
rows of 64 samples, so decoding holds one page besides the file; columns other than
``doc_id`` and ``text`` are ignored; an empty table gives an empty result. A damaged file
raises ``ValueError`` in ``pages``, and no more is held than its data really decode to; ``page_rows`` gives such a file, and a null one, no rows
unless told to fail.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import STEP_BYTES, doc_text, ship, slices

WIDTH = 64
#: Rows of samples on a page at most: 64 KB of payload.
PAGE_ROWS = 1024
STRIP_ROWS, TILE_ROWS = 256, 128

# Fixed values of the TIFF 6.0 format: tags, field types and compression schemes.
IMAGE_WIDTH, IMAGE_LENGTH, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_COUNTS, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_COUNTS = 317, 322, 323, 324, 325
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
NAMES = {NONE: "none", LZW: "lzw", DEFLATE: "deflate", OLD_DEFLATE: "deflate", PACKBITS: "packbits"}
LZW_CLEAR, LZW_END, LZW_FIRST, LZW_MOST = 256, 257, 258, 4094


def packbits_encode(row: bytes) -> bytes:
    """One row: runs of three and more become repeats, the rest literals of up to 128 bytes."""
    a = np.frombuffer(row, np.uint8)
    edges = np.flatnonzero(np.diff(a)) + 1
    starts = np.concatenate(([0], edges))
    ends = np.concatenate((edges, [len(a)]))
    out, literal = bytearray(), 0  # literal: where the open literal run starts

    def flush(to: int) -> None:
        for k in range(literal, to, 128):
            part = row[k : min(to, k + 128)]
            out.append(len(part) - 1)
            out.extend(part)

    long = ends - starts >= 3
    for s, e in zip(starts[long].tolist(), ends[long].tolist(), strict=True):
        flush(s)
        for k in range(s, e, 128):
            n = min(e, k + 128) - k
            out.append(257 - n if n > 1 else 0)
            out.append(row[s])
        literal = e
    flush(len(row))
    return bytes(out)


def packbits_encode_rows(rows: np.ndarray) -> bytes:
    """Each row by itself; rows of up to 128 bytes without a run of three are one literal."""
    same = rows[:, 1:] == rows[:, :-1]
    runs = (same[:, 1:] & same[:, :-1]).any(axis=1) | (rows.shape[1] > 128)
    head = bytes([min(128, rows.shape[1]) - 1])
    return b"".join([packbits_encode(r.tobytes()) if run else head + r.tobytes() for r, run in zip(rows, runs.tolist(), strict=True)])


def packbits_decode(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while len(out) < size:
        if at >= len(data):
            raise ValueError("PackBits data end early")
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def lzw_widths(n: int) -> np.ndarray:
    """Bits of the k-th code after a clear code; the table gets an entry with each code but the first, and widths grow one entry early."""
    k = np.arange(n)
    return np.where(k < 254, 9, np.where(k < 766, 10, np.where(k < 1790, 11, 12)))


def lzw_encode(data: bytes) -> bytes:
    codes, widths = [], []
    table: dict[int, int] = {}
    most = LZW_MOST - LZW_FIRST
    run: list[int] = [LZW_CLEAR]
    prefix, known = -1, table.get
    for c in data:
        if prefix < 0:
            prefix = c
            continue
        if (code := known(prefix << 8 | c)) is not None:
            prefix = code
            continue
        run.append(prefix)
        if len(table) < most - 1:
            table[prefix << 8 | c] = LZW_FIRST + len(table)
        else:
            codes += run
            widths.append(len(run))
            run = [LZW_CLEAR]
            table = {}
            known = table.get
        prefix = c
    if prefix >= 0:
        run.append(prefix)
    run.append(LZW_END)
    codes += run
    widths.append(len(run))
    # a clear code is written with the width that the table before it has come to
    bits, last = [], 9
    for n in widths:
        w = lzw_widths(n - 1)
        bits += [np.array([last]), w]
        last = int(lzw_widths(n)[-1])
    return pack_codes(np.array(codes, np.int64), np.concatenate(bits))


def pack_codes(codes: np.ndarray, widths: np.ndarray) -> bytes:
    ends = np.cumsum(widths)
    out = np.zeros(int(ends[-1]) + 7, np.uint8)
    for k in range(12):
        on = widths > k
        out[ends[on] - 1 - k] = codes[on] >> k & 1
    return np.packbits(out[: int(ends[-1])]).tobytes()


def lzw_decode(data: bytes, size: int) -> bytes:
    """MSB-first codes of 9 to 12 bits, as TIFF has them."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, out, got = base[:], [], 0
    buffer = have = at = 0
    width, previous = 9, None
    n = len(data)
    while got < size:
        while have < width:
            if at >= n:
                raise ValueError("LZW data end early")
            take = data[at : at + 4]
            buffer = (buffer & (1 << have) - 1) << 8 * len(take) | int.from_bytes(take, "big")
            have += 8 * len(take)
            at += len(take)
        have -= width
        code = buffer >> have & (1 << width) - 1
        if code == LZW_CLEAR:
            table, width, previous = base[:], 9, None
            continue
        if code == LZW_END:
            break
        if previous is None:
            if code > LZW_END:
                raise ValueError("LZW code out of range")
            entry = table[code]
        else:
            if code < len(table):
                entry = table[code]
            elif code == len(table):
                entry = previous + previous[:1]
            else:
                raise ValueError("LZW code out of range")
            table.append(previous + entry[:1])
            size_now = len(table)
            if size_now >= 511:
                width = 10 if size_now < 1023 else 11 if size_now < 2047 else 12
        out.append(entry)
        got += len(entry)
        previous = entry
    return b"".join(out)[:size]


def compress(block: np.ndarray, how: int) -> bytes:
    raw = block.tobytes()
    if how == NONE:
        return raw
    if how == LZW:
        return lzw_encode(raw)
    if how == PACKBITS:
        return packbits_encode_rows(block)
    return zlib.compress(raw, 6)


def decompress(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        out = data[:size]
    elif how == LZW:
        out = lzw_decode(data, size)
    elif how == PACKBITS:
        out = packbits_decode(data, size)
    elif how in (DEFLATE, OLD_DEFLATE):
        try:
            out = zlib.decompressobj().decompress(data, size)
        except zlib.error as e:
            raise ValueError(str(e)) from None
    else:
        raise ValueError(f"compression {how} is not supported")
    if len(out) < size:
        raise ValueError("image data end early")
    return out


@dataclass
class Page:
    number: int
    width: int
    height: int
    compression: str
    predictor: int
    tiled: bool
    samples: bytes


def layout(samples: bytes) -> tuple[int, int, bool]:
    """Compression, predictor and whether tiled, by the page's checksum."""
    k = zlib.crc32(samples)
    k, scheme = divmod(k, 3)
    return (PACKBITS, LZW, (DEFLATE, OLD_DEFLATE)[k >> 2 & 1])[scheme], 1 + (k & 1), bool(k >> 1 & 1)


def write(payload: bytes) -> bytes:
    """A little-endian TIFF file of grey pages, 64 samples wide."""
    if not payload or len(payload) % WIDTH:
        raise ValueError("a payload is a positive multiple of 64 bytes")
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4  # where the offset of the next directory goes
    step = PAGE_ROWS * WIDTH
    for at in range(0, len(payload), step):
        samples = payload[at : at + step]
        how, predictor, tiled = layout(samples)
        rows = np.frombuffer(samples, np.uint8).reshape(-1, WIDTH)
        height = len(rows)
        block_rows = TILE_ROWS if tiled else min(STRIP_ROWS, height)
        if predictor == 2:
            rows = np.concatenate((rows[:, :1], np.diff(rows, axis=1)), axis=1)
        offsets, counts = [], []
        for r in range(0, height, block_rows):
            block = rows[r : r + block_rows]
            if tiled and len(block) < block_rows:
                block = np.concatenate((block, np.zeros((block_rows - len(block), WIDTH), np.uint8)))
            data = compress(block, how)
            offsets.append(len(out))
            counts.append(len(data))
            out += data
            if len(out) & 1:
                out.append(0)
        many = []
        for values in (offsets, counts):
            if len(values) > 1:
                many.append(len(out))
                out += struct.pack(f"<{len(values)}I", *values)
            else:
                many.append(values[0])
        entries = [(IMAGE_WIDTH, 4, 1, WIDTH), (IMAGE_LENGTH, 4, 1, height), (BITS, 3, 1, 8), (COMPRESSION, 3, 1, how), (PHOTOMETRIC, 3, 1, 1), (SAMPLES, 3, 1, 1), (PREDICTOR, 3, 1, predictor)]
        n = len(offsets)
        if tiled:
            entries += [(TILE_WIDTH, 4, 1, WIDTH), (TILE_LENGTH, 4, 1, block_rows), (TILE_OFFSETS, 4, n, many[0]), (TILE_COUNTS, 4, n, many[1])]
        else:
            entries += [(STRIP_OFFSETS, 4, n, many[0]), (ROWS_PER_STRIP, 4, 1, block_rows), (STRIP_COUNTS, 4, n, many[1])]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries))
        for tag, kind, count, value in sorted(entries):
            out += struct.pack("<HHII", tag, kind, count, value)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    def need(lo: int, n: int) -> bytes:
        if lo < 0 or lo + n > len(data):
            raise ValueError("a TIFF offset lies outside the file")
        return data[lo : lo + n]

    (n,) = struct.unpack(order + "H", need(at, 2))
    tags: dict[int, list[int]] = {}
    for k in range(n):
        tag, kind, count, _ = struct.unpack(order + "HHII", need(at + 2 + 12 * k, 12))
        size = FIELD_BYTES.get(kind, 0) * count
        where = at + 10 + 12 * k
        if size > 4:
            (where,) = struct.unpack(order + "I", need(where, 4))
        if kind in (1, 3, 4):
            tags[tag] = list(struct.unpack(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind] }", need(where, size)))
    (following,) = struct.unpack(order + "I", need(at + 2 + 12 * n, 4))
    return tags, following


def pages(data: bytes) -> Iterator[Page]:
    """All pages of a file with 8-bit samples, in the order of its directories."""
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None or len(data) < 8:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack(order + "I", data[4:8])
    number, seen = 0, set()
    while at:
        if at in seen:
            raise ValueError("the image directories form a ring")
        seen.add(at)
        tags, at = _directory(data, at, order)
        one = lambda tag, default, tags=tags: (tags.get(tag) or [default])[0]
        width, height, per = one(IMAGE_WIDTH, 0), one(IMAGE_LENGTH, 0), one(SAMPLES, 1)
        if set(tags.get(BITS, [1])) != {8} or one(PLANAR, 1) != 1 or not width or not height:
            raise ValueError("only 8-bit samples in one plane are supported")
        how, predictor = one(COMPRESSION, 1), one(PREDICTOR, 1)
        if predictor not in (1, 2):
            raise ValueError(f"predictor {predictor} is not supported")
        tiled = TILE_OFFSETS in tags
        if tiled:
            bw, bh, offsets, counts = one(TILE_WIDTH, 0), one(TILE_LENGTH, 0), tags[TILE_OFFSETS], tags.get(TILE_COUNTS, [])
        else:
            bw, bh, offsets, counts = width, min(one(ROWS_PER_STRIP, height), height), tags.get(STRIP_OFFSETS, []), tags.get(STRIP_COUNTS, [])
        across = -(-width // bw) if bw else 0
        if not bh or not across or len(offsets) != len(counts) or len(offsets) < across * -(-height // bh):
            raise ValueError("strips or tiles are missing")
        image = []  # bands of rows, which take memory only once their data are decoded
        for y in range(0, height, bh):
            band, rows = [], bh if tiled else min(bh, height - y)
            for k in range(y // bh * across, (y // bh + 1) * across):
                if offsets[k] + counts[k] > len(data):
                    raise ValueError("image data lie outside the file")
                block = np.frombuffer(decompress(data[offsets[k] : offsets[k] + counts[k]], how, rows * bw * per), np.uint8).reshape(rows, bw, per)
                band.append(np.cumsum(block, axis=1, dtype=np.uint8) if predictor == 2 else block)
            image.append(np.concatenate(band, axis=1)[: height - y, :width].tobytes())
        yield Page(number, width, height, NAMES[how], predictor, tiled, b"".join(image))
        number += 1


PAGE_SCHEMA = "page int, width int, height int, compression string, predictor int, tiled boolean, samples binary"


def page_rows(files: DataFrame, keys: list[str], media: str, strict: bool = True) -> DataFrame:
    """One row per page of the TIFF files in column ``media``: ``keys``, the page's properties and samples; a file's pages follow each other."""
    ship(files.sparkSession)
    types = (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.bool_(), pa.binary())
    names = [*keys, *(c.split()[0] for c in PAGE_SCHEMA.split(", "))]

    def run(batches):
        for batch in batches:
            which: list[int] = []
            found: list[tuple] = []
            size = 0

            def made(batch=batch, which=which, found=found) -> pa.RecordBatch:
                kept = batch.select(keys).take(pa.array(which, pa.int32()))
                return pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True))], names=names)

            for k, data in enumerate(batch.column(media)):
                try:
                    # a file that may be damaged gives all of its pages or none
                    read = pages(data.as_py()) if data.is_valid else []
                    for p in read if strict else list(read):
                        which.append(k)
                        found.append((p.number, p.width, p.height, p.compression, p.predictor, p.tiled, p.samples))
                        size += len(p.samples)
                        if size >= STEP_BYTES:
                            yield made()
                            which.clear()
                            found.clear()
                            size = 0
                except ValueError:
                    if strict:
                        raise
            if found:
                yield made()

    schema = T.StructType([*files.select(*keys).schema.fields, *T.StructType.fromDDL(PAGE_SCHEMA).fields])
    return files.select(*keys, media).mapInArrow(run, schema)


def payload_of(text: str) -> tuple[int, bytes]:
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + bytes(-len(raw) % WIDTH or (0 if raw else WIDTH))


def stored(docs: DataFrame) -> DataFrame:
    """``doc_id``, the unpadded length and the text as a TIFF file."""
    ship(docs.sparkSession)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                made = [(n, write(p)) for n, p in map(payload_of, batch.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return doc_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary")


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


class Reading:
    """What is gathered of a file's pages, one after another."""

    def __init__(self):
        self.sha, self.bytes, self.tail, self.kinds, self.pages, self.total, self.steps = hashlib.sha256(), 0, b"", set(), 0, 0, 0

    def add(self, page: dict) -> None:
        samples = page["samples"]
        rows = np.frombuffer(samples, np.uint8).reshape(-1, page["width"]).astype(np.int16)
        self.sha.update(samples)
        self.bytes += len(samples)
        self.tail = (self.tail + samples)[-64:]
        self.pages += 1
        self.kinds.add(f"{page['compression']}{'+diff' if page['predictor'] == 2 else ''}{'/tiles' if page['tiled'] else '/strips'}")
        self.total += int(rows.sum(dtype=np.int64))
        self.steps += int(np.abs(np.diff(rows, axis=1)).sum(dtype=np.int64))

    def feature(self) -> str:
        """Pages, layouts, mean sample and mean step along a row, both in thousandths."""
        return f"{self.pages}:{','.join(sorted(self.kinds))}:{self.total * 1000 // self.bytes}:{self.steps * 1000 // self.bytes}"


def media_digests(files: DataFrame) -> DataFrame:
    """Digests and features of stored texts (``doc_id``, ``n_bytes``, ``media``), folded from the rows of their pages."""
    own = ["doc_id", "n_bytes", "media_bytes", "media_sha256"]
    facts = files.select("doc_id", "n_bytes", F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "media")
    names = [c.split()[0] for c in DIGESTS.split(", ")]

    def run(batches):
        now, read, out = None, None, []

        def close() -> None:
            if read is not None:
                out.append((now["doc_id"], now["n_bytes"], read.bytes, read.sha.hexdigest(), zlib.crc32(read.tail), now["media_bytes"], now["media_sha256"], read.feature()))

        def batch() -> pa.RecordBatch:
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * 8, types, strict=True)], names=names)

        for pages_ in batches:
            for part in slices(pages_, "samples"):
                for row in part.to_pylist():
                    if row["page"] == 0:
                        close()
                        now, read = {c: row[c] for c in own}, Reading()
                    read.add(row)
                yield batch()
                out.clear()
        close()
        yield batch()

    return page_rows(facts, own, "media").mapInArrow(run, DIGESTS)
