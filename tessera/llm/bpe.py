"""BPE by backtracking: exact merges in linear time, without a merge queue.

A sequence of tokens is the result of the merges if and only if each adjacent pair of it
is: no merge across the pair's border comes before the merges that made its two sides.
So the encoder walks a word from the left, takes the longest token that starts at a
position (an Aho-Corasick automaton over the vocabulary lists all of them in one pass),
checks the pair against a compatibility table, and steps back to the next shorter token
where the check or the rest of the word fails. A prefix has one encoding only, so a
position that was left once is never entered again: linear time.

Decoding copies bytes by an offset table: the strings of all tokens lie in one buffer,
and a token's bytes are found by two look-ups.

Defined results: null text counts as empty; empty text has no tokens and the digests of
the empty string; repeated rows give repeated results; columns other than ``doc_id`` and
``text`` are ignored; an empty table gives an empty result. Memory per worker is bounded
by the vocabulary and by caches of a fixed number of words.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.common import doc_text, ship, slices

#: Words kept in a worker's caches; a full cache is emptied.
CACHE_WORDS = 300_000
#: Longer words are encoded anew each time.
CACHE_CHARS = 64
#: From here on the library splits words, as Unicode versions differ in what is a letter.
BEYOND_LATIN = "\u0250"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_alphabet() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: printable Latin-1 as it is, the rest from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class OffsetTable:
    """Strings in one buffer; ``join`` lays out those of an id array, a space between them."""

    def __init__(self, strings: list[bytes]):
        self.data = np.frombuffer(b"".join(s + b" " for s in strings), np.uint8)
        self.length = np.array([len(s) + 1 for s in strings], np.int32)
        self.start = (np.cumsum(self.length) - self.length).astype(np.int32)

    def join(self, ids: np.ndarray, counts: np.ndarray) -> list[memoryview]:
        """One buffer for each of the consecutive runs of ``counts`` ids."""
        length = self.length[ids]
        ends = np.cumsum(length, dtype=np.int64)
        at = np.repeat(self.start[ids] - (ends - length), length)
        at += np.arange(len(at))
        out = memoryview(self.data[at])
        ends = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return [out[a : max(a, b - 1)] for a, b in pairwise(ends.tolist())]


class Backtracking:
    """Encoder and decoder of a byte-level vocabulary with word ends."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.alphabet = spec["model"], byte_alphabet()
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab: dict[str, int] = model["vocab"]
        self.ids = vocab
        n = max([*vocab.values(), *self.specials.values()]) + 1
        names = [b""] * n
        for s, i in [*vocab.items(), *self.specials.items()]:
            names[i] = s.encode()
        self.tokens, self.decimal = OffsetTable(names), OffsetTable([str(i).encode() for i in range(n)])
        #: What a merge joins, by the rank at which it does; a token of the alphabet has no parts.
        self.rank: dict[int, int] = {}
        self.made = [-1] * n
        self.left, self.right = [*range(n)], [*range(n)]
        for r, (a, b) in enumerate(m.split(" ") if isinstance(m, str) else m for m in model["merges"]):
            i = vocab[a + b]
            self.rank.setdefault(vocab[a] << 32 | vocab[b], r)
            if self.made[i] < 0:
                self.made[i], self.left[i], self.right[i] = r, vocab[a], vocab[b]
        #: Word ends are one character here, so that lengths count symbols of the text.
        self.end = "\ue000" if self.suffix else ""
        self.matches = ahocorasick.Automaton()
        for s, i in vocab.items():
            short = s.removesuffix(self.suffix) + self.end if self.suffix and s.endswith(self.suffix) and s != self.suffix else s
            self.matches.add_word(short, (len(short), i))
        self.matches.make_automaton()
        self.compatible: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.path, self._library = path, None

    @property
    def library(self):
        """The library's normalizer and splitter, whose Unicode version decides what newer characters are."""
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return self._library

    def fits(self, a: int, b: int) -> bool:
        """Whether the merges leave a border between ``a`` and ``b``.

        The merges of both sides are undone from the last to the first. At each state the two
        tokens at the border must not have a merge that comes before the one undone last.
        """
        key = a << 32 | b
        if (known := self.compatible.get(key)) is not None:
            return known
        if len(self.compatible) > 4 * CACHE_WORDS:
            self.compatible.clear()
        never = len(self.rank) + 1
        before, or_at = never, False  # on the left, a merge of the same rank happens first
        ok = True
        while True:
            r = self.rank.get(a << 32 | b)
            if r is not None and (r < before or or_at and r == before):
                ok = False
                break
            x, y = self.made[a], self.made[b]
            if x < 0 and y < 0:
                break
            if x > y:
                before, or_at, a = x, False, self.right[a]
            else:
                before, or_at, b = y, True, self.left[b]
        self.compatible[key] = ok
        return ok

    def merge(self, word: str) -> list[int]:
        """Ids of one word in the byte alphabet."""
        if (i := self.ids.get(word + self.suffix)) is not None:
            return [i]
        text = word + self.end
        starts: list[list[tuple[int, int]]] = [[] for _ in text]
        for at, match in self.matches.iter(text):
            starts[at - match[0] + 1].append(match)
        last, out, at, blocked = len(text), [], 0, set()
        options = [starts[0][:]]
        while at < last:
            here = options[-1]
            while here:
                size, i = here.pop()
                to = at + size
                if to not in blocked and (not out or self.fits(out[-1][1], i)):
                    out.append((at, i))
                    at = to
                    options.append(starts[at][:] if at < last else [])
                    break
            else:
                blocked.add(at)
                options.pop()
                if not out:
                    raise ValueError(f"no encoding of {word!r}")
                at = out.pop()[0]
        return [i for _, i in out]

    def word(self, word: str) -> bytes:
        if (known := self.words.get(word)) is not None:
            return known
        ids = np.array(self.merge("".join(map(self.alphabet.__getitem__, word.encode("utf-8", "surrogatepass")))), "<u4").tobytes()
        if len(word) <= CACHE_CHARS:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def plain(self, piece: str) -> bytes:
        if piece and max(piece) >= BEYOND_LATIN:
            words = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(piece))
            return np.array([i for w, _ in words for i in self.merge(w)], "<u4").tobytes()
        piece = unicodedata.normalize("NFC", piece)
        return b"".join(map(self.word, self.pattern.findall(piece.lower())))

    def piece(self, piece: str) -> bytes:
        """Ids of what stands between two spaces; no word of the pattern has a space."""
        if self.special is not None and "<" in piece and self.special.search(piece):
            ids = b"".join(self.specials[s].to_bytes(4, "little") if s in self.specials else self.plain(s) for s in self.special.split(piece))
        else:
            ids = self.plain(piece)
        if len(piece) <= CACHE_CHARS:
            if len(self.pieces) >= CACHE_WORDS:
                self.pieces.clear()
            self.pieces[piece] = ids
        return ids

    def encode(self, text: str) -> bytes:
        """Little-endian 32-bit ids."""
        known, get = self.pieces.get, self.piece
        return b"".join([x if (x := known(p)) is not None else get(p) for p in text.split(" ")])

    def decode(self, ids: list[int]) -> str:
        if not len(ids):
            return ""
        return bytes(self.tokens.join(np.asarray(ids, np.int64), np.array([len(ids)]))[0]).decode()


@lru_cache(maxsize=2)
def codec(path: str) -> Backtracking:
    return Backtracking(path)


def digests(path: str):
    def run(batches):
        tool = codec(path)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                coded = [tool.encode(t) for t in batch.column("text").to_pylist()]
                counts = np.array([len(c) // 4 for c in coded], np.int64)
                ids = np.frombuffer(b"".join(coded), "<u4")
                sha = lambda runs: pa.array([hashlib.sha256(r).hexdigest() for r in runs])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array(counts), sha(tool.decimal.join(ids, counts)), sha(tool.tokens.join(ids, counts))],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return run


def roundtrip_digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document: its number of tokens, the digest of its ids and that of what they decode to."""
    ship(docs.sparkSession)
    return doc_text(docs).mapInArrow(digests(path), SCHEMA)


def encoded(docs: DataFrame, path: str) -> DataFrame:
    """Per document its ids and the text they decode to."""
    ship(docs.sparkSession)

    def run(batches):
        tool = codec(path)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                ids = [np.frombuffer(tool.encode(t), "<u4") for t in batch.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").cast(pa.int64()), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array([tool.decode(i) for i in ids])],
                    names=["doc_id", "ids", "decoded"],
                )

    return doc_text(docs).mapInArrow(run, "doc_id long, ids array<int>, decoded string")
