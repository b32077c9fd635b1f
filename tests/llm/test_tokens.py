"""BPE round trip and best-fit packing."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, packing
from tests.llm.helpers import documents, empty, hard_texts, words

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return {p: tokenizers.Tokenizer.from_file(p) for p in (WORD, BYTE)}


def test_encoder_is_the_library(library):
    tool = bpe.codec(WORD)

    @settings(max_examples=300, deadline=None)
    @given(st.text(max_size=60) | st.text("aeinrst hth'SΣé9\n", max_size=60))
    def same(text):
        want = library[WORD].encode(text, add_special_tokens=False).ids
        got = np.frombuffer(tool.encode(text), "<u4").tolist()
        assert got == want
        assert tool.decode(got) == library[WORD].decode(want, skip_special_tokens=False)

    same()


def test_a_long_word_takes_linear_time():
    tool = bpe.codec(WORD)
    assert len(tool.encode("ab" * 100_000)) > 0


def test_byte_encoder_is_the_library(library):
    tool = packing.encoder(BYTE)

    @settings(max_examples=200, deadline=None)
    @given(st.text(max_size=60) | st.text("ae \n\t'sé9\x1c\x85 .", max_size=60))
    def same(text):
        assert np.frombuffer(tool.encode(text), "<u4").tolist() == library[BYTE].encode(text, add_special_tokens=False).ids

    same()


@pytest.mark.parametrize("extra", [False, True])
def test_round_trip_digests(spark, library, extra):
    docs = documents(spark, extra=extra)
    got = bpe.roundtrip_digests(docs, WORD).collect()
    assert len(got) == len(hard_texts()) + 1
    for r in got:
        ids = library[WORD].encode(hard_texts()[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library[WORD].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert bpe.roundtrip_digests(empty(spark), WORD).count() == 0
    assert bpe.encoded(docs.limit(3), WORD).count() == 3


@pytest.mark.parametrize("extra", [False, True])
def test_packing_holds_every_piece_once(spark, library, extra):
    docs = documents(spark, hard_texts() + [words(k, k) for k in range(1, 60)], extra)
    rows = docs.collect()
    got = packing.packed_documents(docs, BYTE).collect()
    want = Counter()
    for r in rows:
        ids = [*library[BYTE].encode(r.text or "", add_special_tokens=False).ids, 2]
        cuts = list(range(len(ids) % 1024 or 1024, len(ids) + 1, 1024))
        for k, (a, b) in enumerate(zip([0, *cuts], cuts)):
            want[(r.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(r.length for r in got) // 1024)
    assert len(bins) <= least + 1
    assert packing.packed_documents(empty(spark), BYTE).count() == 0


def test_few_pieces_take_few_files(spark, tmp_path):
    """Whatever the number of shuffle partitions, a result is written in no more files than its rows need."""
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        docs = documents(spark, [words(k, k) for k in range(1, 60)])
        packing.packed_documents(docs, BYTE).write.parquet(f"{tmp_path}/out")
        assert len(list((tmp_path / "out").glob("*.parquet"))) == 1
        assert spark.read.parquet(f"{tmp_path}/out").count() == docs.count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=12))
def test_search_keeps_pieces_and_never_adds_bins(lengths):
    bins = packing.Bins(40)
    bins.best_fit_decreasing(lengths)
    before = sum(bins.count.values())
    square = sum(n * sum(x) ** 2 for x, n in bins.count.items())
    bins.search()
    held = Counter()
    for x, n in bins.count.items():
        assert n > 0 and sum(x) <= 40
        for size in x:
            held[size] += n
    assert held == Counter(lengths) and sum(bins.count.values()) <= before
    assert sum(n * sum(x) ** 2 for x, n in bins.count.items()) >= square


def test_search_empties_bins():
    bins = packing.Bins(10)
    bins.count.update({(6,): 1, (5, 2): 1, (4, 3): 1})
    assert bins.search() > 0 and sum(bins.count.values()) == 2


def test_search_ends_by_itself():
    """Millions of lengths of which two or three fill a sequence: the search goes on until no step is left."""
    r = np.random.default_rng(3)
    lengths = Counter(r.integers(250, 421, 5_000_000).tolist())
    bins = packing.plan(lengths)
    held = Counter()
    for x, n in bins.count.items():
        assert n > 0 and sum(x) <= 1024
        for size in x:
            held[size] += n
    assert held == lengths and bins.search() == 0
    assert sum(bins.count.values()) < 1_700_000  # best fit alone takes 1.81 million


def steps_left(bins):
    """Whether any move or exchange of one for one, two for one or one for two gives the fuller bin more, by trying all."""
    some = [x for x, n in bins.count.items() for _ in range(min(n, 2))]
    parts = lambda x, n: [()] if n == 0 else [(y,) for y in x] if n == 1 else [(x[i], y) for i in range(len(x)) for y in x[i + 1 :]]
    for i, a in enumerate(some):
        for j, b in enumerate(some):
            if i != j and sum(a) <= sum(b) < bins.capacity:
                for give, get in ((1, 0), (1, 1), (2, 1), (1, 2)):
                    if any(0 < sum(g) - sum(h) <= bins.capacity - sum(b) for g in parts(a, give) for h in parts(b, get)):
                        return True
    return False


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 5), max_size=10))
def test_no_step_is_left(lengths):
    assert not steps_left(packing.plan(lengths, 40))


def test_long_white_space_and_settled_characters(library):
    tool = packing.encoder(BYTE)
    for text in ("\n" * 1_000_000, " " * 1_000_000, "a " * 10 + "\n" * 200_000 + "b", " \t" * 100_000, "z" * 300_000):
        assert np.frombuffer(tool.encode(text), "<u4").tolist() == library[BYTE].encode(text, add_special_tokens=False).ids
    settled = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and not packing.UNSETTLED.search(chr(c))]
    assert len(settled) > 30_000
    for k in range(0, len(settled), 500):
        text = "".join(f"a{c}b 1{c}2 .{c}. {c}\n{c} x" for c in settled[k : k + 500])
        assert tool.ids(text) == tool.by_library(text)
