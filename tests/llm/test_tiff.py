import hashlib
import random
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import tiff
from tests.llm.helpers import documents, empty, hard_texts


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=3000) | st.builds(lambda b, n: b * n, st.binary(min_size=1, max_size=3), st.integers(1, 2000)))
def test_codecs(data):
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data
    if data:
        assert tiff.packbits_decode(tiff.packbits_encode(data), len(data)) == data


def test_lzw_fills_its_table():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(40_000)) + b"ab" * 20_000
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_known_streams():
    # examples of the formats' definitions
    assert tiff.packbits_decode(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")
    assert tiff.lzw_encode(bytes([7, 7, 7, 8, 8, 7, 7, 6, 6])) == tiff.pack_codes(np.array([256, 7, 258, 8, 8, 258, 6, 6, 257]), np.full(9, 9))


def image(order, how, predictor, tiled, width=50, height=37, samples=3):
    """A file as another program would write it: any byte order, several samples, tiles that overlap the edge."""
    r = np.random.default_rng(3)
    a = r.integers(0, 40, (height, width, samples), np.uint8)
    bw, bh = (16, 32) if tiled else (width, 10)
    blocks = []
    for y in range(0, height, bh):
        for x in range(0, width, bw):
            b = np.zeros((bh if tiled else min(bh, height - y), bw, samples), np.uint8)
            part = a[y : y + bh, x : x + bw]
            b[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                b = np.concatenate((b[:, :1], np.diff(b, axis=1)), axis=1)
            blocks.append(tiff.compress(b.reshape(len(b), -1), how))
    body, offsets = bytearray(), []
    for b in blocks:
        offsets.append(8 + len(body))
        body += b
    o = "<" if order == "II" else ">"
    at = 8 + len(body)
    extra = struct.pack(f"{o}{len(blocks)}I", *offsets) + struct.pack(f"{o}{len(blocks)}I", *map(len, blocks)) + struct.pack(f"{o}3H", 8, 8, 8)
    n = len(blocks)
    tags = [(256, 3, 1, width), (257, 3, 1, height), (258, 3, 3, at + 8 * n), (259, 3, 1, how), (262, 3, 1, 2), (277, 3, 1, samples), (317, 3, 1, predictor)]
    tags += [(322, 3, 1, bw), (323, 3, 1, bh), (324, 4, n, at), (325, 4, n, at + 4 * n)] if tiled else [(273, 4, n, at), (278, 3, 1, bh), (279, 4, n, at + 4 * n)]
    first = at + len(extra)
    out = order.encode() + struct.pack(o + "HI", 42, first) + body + extra + struct.pack(o + "H", len(tags))
    for tag, kind, count, value in sorted(tags):
        out += struct.pack(o + "HHI", tag, kind, count) + (struct.pack(o + "HH", value, 0) if kind == 3 and count == 1 else struct.pack(o + "I", value))
    return bytes(out) + bytes(4), a


@pytest.mark.parametrize("order", ["II", "MM"])
@pytest.mark.parametrize("how", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor, tiled", [(1, False), (2, True), (1, True), (2, False)])
def test_reader(order, how, predictor, tiled):
    data, a = image(order, how, predictor, tiled)
    (page,) = tiff.pages(data)
    assert (page.width, page.height, page.tiled) == (50, 37, tiled) and page.samples == a.tobytes()


def test_all_layouts_are_written():
    r = random.Random(2)
    seen = set()
    for _ in range(60):
        n, payload = tiff.payload_of("".join(r.choice("abc é") for _ in range(r.randint(0, 900))))
        found = list(tiff.pages(tiff.write(payload)))
        assert b"".join(p.samples for p in found) == payload and len(payload) % 64 == 0 and n <= len(payload)
        seen |= {(p.compression, p.predictor, p.tiled) for p in found}
    assert {c for c, _, _ in seen} == {"lzw", "packbits", "deflate"} and len(seen) >= 8


def test_damaged_files(spark):
    _, payload = tiff.payload_of("text " * 50)
    good = tiff.write(payload)
    for bad in (b"", b"II*\0", good[:-20], b"XX" + good[2:], good[:4] + struct.pack("<I", 1 << 30) + good[8:]):
        with pytest.raises(ValueError):
            list(tiff.pages(bad))
    files = spark.createDataFrame([(1, bytearray(good)), (2, bytearray(b"no")), (3, None)], "id long, media binary")
    rows = tiff.page_rows(files, ["id"], "media", strict=False).collect()
    assert [(r.id, r.page, bytes(r.samples)) for r in rows] == [(1, 0, payload)]


def test_layouts_are_dealt_evenly():
    r = random.Random(4)
    seen = [tiff.layout(r.randbytes(64)) for _ in range(3000)]
    for scheme in ({tiff.PACKBITS}, {tiff.LZW}, {tiff.DEFLATE, tiff.OLD_DEFLATE}):
        assert 900 < sum(how in scheme for how, _, _ in seen) < 1100
    assert len(set(seen)) == 16 and 1400 < sum(p == 2 for _, p, _ in seen) < 1600 and 1400 < sum(t for _, _, t in seen) < 1600


def directory(tags, body=b""):
    out = b"II*\0" + struct.pack("<I", 8 + len(body)) + body + struct.pack("<H", len(tags))
    return out + b"".join(struct.pack("<HHII", *t) for t in tags) + bytes(4)


def test_damage_of_all_kinds_is_a_value_error():
    whole = [(256, 4, 1, 64), (257, 4, 1, 1), (258, 3, 1, 8), (259, 3, 1, tiff.LZW), (273, 4, 1, 8), (278, 4, 1, 1), (279, 4, 1, 8)]
    unassigned = tiff.pack_codes(np.array([256, 300, 5, 257]), np.full(4, 9)).ljust(8, b"\0")
    huge = [(256, 4, 1, 200_000), (257, 4, 1, 200_000), (258, 3, 1, 8), (273, 4, 1, 8), (278, 4, 1, 200_000), (279, 4, 1, 8)]
    none = [(t, kind, 0 if t == 256 else n, v) for t, kind, n, v in whole]
    files = [directory(whole, unassigned), directory(none, bytes(8)), *(directory([*huge, (259, 3, 1, how)], bytes(8)) for how in (1, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS))]
    r = random.Random(7)
    good = tiff.write(tiff.payload_of("some text " * 300)[1])
    for _ in range(400):  # any byte may be wrong
        bad = bytearray(good)
        for _ in range(r.randint(1, 4)):
            bad[r.randrange(len(bad))] = r.randrange(256)
        files.append(bytes(bad[: r.randint(8, len(bad))] if r.random() < 0.3 else bad))
    for k, data in enumerate(files):
        try:
            list(tiff.pages(data))
            assert k >= 6
        except ValueError:
            pass


def features(text):
    """Mean and mean step of the samples, from the text alone."""
    raw = text.encode()
    payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
    steps = sum(abs(payload[k] - payload[k - 1]) for k in range(len(payload)) if k % 64)
    return -(-len(payload) // 65_536), sum(payload) * 1000 // len(payload), steps * 1000 // len(payload)


@pytest.mark.parametrize("extra", [False, True])
def test_query_columns(spark, extra):
    texts = [*hard_texts(), "w " * 60_000]
    got = tiff.media_digests(tiff.stored(documents(spark, texts, extra))).collect()
    assert len(got) == len(texts) + 1
    for r in got:
        raw = (texts[r.doc_id] or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        data = tiff.write(payload)
        n, kinds, mean, step = r.feature.split(":")
        assert (int(n), int(mean), int(step)) == features(texts[r.doc_id] or "") and all(x.split("/")[1] in ("tiles", "strips") for x in kinds.split(","))
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
    assert len({r.feature for r in got if r.doc_id in (8, 9)}) == 1
    assert tiff.media_digests(tiff.stored(empty(spark))).count() == 0
