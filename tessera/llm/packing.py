"""Best-fit packing with swap-based local search, planned on lengths and carried out on documents.

Sequences hold ``capacity`` tokens. What fits together depends on lengths alone, and there
are at most ``capacity`` of them, so the plan is made for the counts of each length: bins of
the same contents are one class with a multiplicity. The plan's size is bounded by the
capacity, not by the data, and the plan is as good as one made over all pieces at once.

1. Best-fit decreasing, from the longest length down, each into the fullest class that has room.
2. Local search over classes of underfull bins: move a piece to another bin, exchange one for
   one, or two for one, whenever the emptier one gives the fuller one more than it gets, which raises the sum of squared
   fills; emptied bins go. A step is applied to as many bins of the two classes as can be paired. What
   bins could give is indexed by length, and the search goes on until no step is left.
3. Pieces get their place by their rank among those of the same length. Ranks are counted in
   hash buckets with an offset for each bucket and length, so no task sees all pieces of a length.

Ids come from a faster encoder of the same vocabulary for texts in characters whose classes all
Unicode versions agree on (``SETTLED``) and without very long runs of white space, and from the library itself for all others.

Defined results: null text is a document of its end token alone; of repeated rows each is
packed; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are
ignored. Ranks are by bucket and then by all columns of a piece, so a task that runs again gives the same places.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right, insort
from collections import Counter, defaultdict
from heapq import heappop, heappush
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import FILE_ROWS, doc_text, ship, slices, stage

CAPACITY, END_ID = 1024, 2
#: Pieces in a hash bucket, about.
BUCKET_ROWS, LEAST_BUCKETS = 20_000, 64
CACHE_WORDS, CACHE_CHARS = 400_000, 64
#: Blocks and ranges that have been full for long, so that the class of each of their characters is the same in any table.
SETTLED = "\\x00-\u024f\u0391-\u03a1\u03a3-\u03ce\u0400-\u0481\u048a-\u04ff\u2010-\u2027\u2030-\u205e\u20a0-\u20b5\u2190-\u21ff\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3"
UNSETTLED = re.compile(f"[^{SETTLED}]")
#: White space in a run from which on a text is left to the library: the faster encoder's stack is bounded.
LONG_SPACE = 16384
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def has_long_space(text: str) -> bool:
    """Whether there may be a run of ``LONG_SPACE`` white space: such a run fills one of the places looked at."""
    return any(text[k : k + 64].isspace() for k in range(LONG_SPACE // 2, len(text) - LONG_SPACE // 2, LONG_SPACE // 2))


class ByteEncoder:
    """Byte-level BPE ids as little-endian bytes, with what stands between two spaces kept in a cache.

    A run without white space at its ends is split into words alike wherever it stands after a
    single space, so its ids can be kept. A text with other white space next to a space is encoded whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        from tessera.llm.bpe import byte_alphabet

        byte = {c: b for b, c in enumerate(byte_alphabet())}
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in s): i for s, i in spec["model"]["vocab"].items() if s not in self.specials}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.whole = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.kept: dict[str, bytes] = {}
        self.path, self._library = path, None

    def by_library(self, text: str) -> bytes:
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self.path)
        return np.array(self._library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def ids(self, text: str) -> bytes:
        return np.array(self.whole(text), "<u4").tobytes()

    def piece(self, piece: str) -> bytes:
        if not piece or piece[0].isspace() or piece[-1].isspace():
            raise LookupError
        ids = self.ids(" " + piece)
        if len(piece) <= CACHE_CHARS:
            if len(self.kept) >= CACHE_WORDS:
                self.kept.clear()
            self.kept[piece] = ids
        return ids

    def ordinary(self, text: str) -> bytes:
        first, *rest = text.split(" ")
        if not rest or not first or first[-1].isspace():
            return self.ids(text)
        known, get = self.kept.get, self.piece
        try:
            return self.ids(first) + b"".join([x if (x := known(p)) is not None else get(p) for p in rest])
        except LookupError:
            return self.ids(text)

    def encode(self, text: str) -> bytes:
        if not text.isascii() and UNSETTLED.search(text) or has_long_space(text):
            return self.by_library(text)
        if any(s in text for s in self.specials):
            return b"".join(self.specials[s].to_bytes(4, "little") if s in self.specials else self.ids(s) for s in self.special.split(text) if s)
        return self.ordinary(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteEncoder:
    return ByteEncoder(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids and the end id, cut into pieces of ``capacity``, of which the first may be shorter."""
    ship(docs.sparkSession)

    def run(batches):
        tool, tail = encoder(path), end_id.to_bytes(4, "little")
        for whole in batches:
            for batch in slices(whole, "text"):
                out = []
                for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    ids = tool.encode(text) + tail
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    at = 0
                    for k in range(-(-n // capacity)):
                        to = first + k * capacity
                        out.append((doc, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                        at = to
                cols = zip(*out, strict=True) if out else [[]] * 5
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return doc_text(docs).mapInArrow(run, PIECES)


class Bins:
    """Classes of bins: a sorted tuple of lengths and how many bins have it."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count: Counter[tuple[int, ...]] = Counter()

    def best_fit_decreasing(self, lengths: dict[int, int]) -> None:
        cap = self.capacity
        free: defaultdict[int, Counter] = defaultdict(Counter)
        open_: list[int] = []

        def put(bin_: tuple[int, ...], n: int, room: int) -> None:
            if n:
                if not free[room]:
                    insort(open_, room)
                free[room][bin_] += n

        for size in sorted(lengths, reverse=True):
            left = lengths[size]
            while left:
                k = bisect_left(open_, size)
                if k == len(open_):
                    each = cap // size
                    put((size,) * each, left // each, cap - each * size)
                    if rest := left % each:
                        put((size,) * rest, 1, cap - rest * size)
                    break
                room = open_[k]
                bin_, n = free[room].popitem()
                if not free[room]:
                    open_.pop(k)
                each = room // size
                full, rest = min(n, left // each), 0
                if full < n:
                    rest = left - full * each
                put(bin_ + (size,) * each, full, room - each * size)
                if rest:
                    put(bin_ + (size,) * rest, 1, room - rest * size)
                put(bin_, n - full - bool(rest), room)
                left -= full * each + rest
        for classes in free.values():
            self.count.update(classes)

    def search(self) -> int:
        """Raise the squared fill by moves and exchanges until none helps; the number of steps."""
        steps = 0
        while done := Search(self).run():
            steps += done
        return steps


class Search:
    """One pass of the local search: from the fullest underfull class down, each is filled up as far as emptier ones have what it takes.

    Donors are indexed by what they could give: each length, and each sum of two lengths. An
    entry of the index is a heap of classes, the emptiest on top; entries of classes that are gone are skipped.
    """

    def __init__(self, bins: Bins):
        self.bins, self.count, self.capacity = bins, bins.count, bins.capacity
        self.donors: tuple[dict[int, list], dict[int, list]] = ({}, {})
        self.sizes: tuple[list[int], list[int]] = ([], [])
        self.todo: list[tuple[int, tuple[int, ...]]] = []
        self.known: set[tuple[int, ...]] = set()
        for bin_ in sorted(self.count):
            self.offer(bin_)

    def offer(self, bin_: tuple[int, ...]) -> None:
        fill = sum(bin_)
        if fill == self.capacity:
            return
        heappush(self.todo, (-fill, bin_))
        if bin_ in self.known:
            return
        self.known.add(bin_)
        one = Counter(bin_)
        two = {x + y for x in one for y in one if x < y or x == y and one[x] > 1}
        for sums, donors, sizes in zip((one, two), self.donors, self.sizes, strict=True):
            for s in sums:
                if s not in donors:
                    donors[s] = []
                    insort(sizes, s)
                heappush(donors[s], (fill, bin_))

    def donor(self, which: int, total: int, bin_: tuple[int, ...], fill: int) -> tuple[int, ...] | None:
        """The emptiest class, no fuller than ``fill``, that could give ``total`` as one length or two; another bin than ``bin_``."""
        heap, aside, found = self.donors[which][total], [], None
        while heap:
            at, other = heap[0]
            if not self.count.get(other):
                heappop(heap)
                self.known.discard(other)  # to be offered anew if it comes back
                continue
            if at > fill:
                break
            if other != bin_ or self.count[bin_] > 1:
                found = other
                break
            aside.append(heappop(heap))
        for x in aside:
            heappush(heap, x)
        if not heap:
            del self.donors[which][total]
            sizes = self.sizes[which]
            sizes.pop(bisect_left(sizes, total))
        return found

    def step(self, bin_: tuple[int, ...]) -> tuple[tuple[int, ...], int, int, tuple[int, ...]] | None:
        """What fills ``bin_`` most: the donor, as how many lengths it gives how much, and what it gets back."""
        fill = sum(bin_)
        gap, best, most = self.capacity - fill, None, 0
        one = sorted(set(bin_))
        backs = [((), 0), *(((y,), y) for y in one)]
        pairs = sorted({x + y: (y, x) for i, x in enumerate(bin_) for y in bin_[i + 1 :]}.items())
        for which, given in ((0, backs), (0, [(b, t) for t, b in pairs]), (1, backs[1:])):
            sizes = self.sizes[which]
            for back, total in given:
                k = bisect_right(sizes, total + gap) - 1
                while k >= 0 and sizes[k] - total > most:
                    size = sizes[k]
                    if (other := self.donor(which, size, bin_, fill)) is not None:
                        most, best = size - total, (other, which + 1, size, back)
                        break
                    k = min(k, len(sizes)) - 1
                if most == gap:
                    return best
        return best

    def run(self) -> int:
        steps = 0
        while self.todo:
            _, bin_ = heappop(self.todo)
            while self.count.get(bin_) and (step := self.step(bin_)) is not None:
                other, pieces, size, back = step
                give = (size,) if pieces == 1 else next((x, size - x) for x in other if size - x in other and (x != size - x or other.count(x) > 1))
                n = self.count[bin_] // 2 if other == bin_ else min(self.count[bin_], self.count[other])
                for old in (bin_, other):
                    self.count[old] -= n
                    if not self.count[old]:
                        del self.count[old]
                for old, out, in_ in ((other, give, back), (bin_, back, give)):
                    new = list(old)
                    for x in out:
                        new.remove(x)
                    if new := tuple(sorted((*new, *in_), reverse=True)):
                        self.count[new] += n
                        self.offer(new)
                steps += 1
        return steps


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> Bins:
    bins = Bins(capacity)
    bins.best_fit_decreasing(lengths)
    bins.search()
    return bins


def places(bins: Bins) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks of its slots, the slots' first sequence, their offset."""
    slots, used, first = defaultdict(list), Counter(), 0
    for bin_, n in sorted(bins.count.items(), reverse=True):
        at = 0
        for size in bin_:
            slots[size].append((used[size], first, at))
            used[size] += n
            at += size
        first += n
    return {size: tuple(np.array(c, np.int64) for c in zip(*rows, strict=True)) for size, rows in slots.items()}


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that have a ``length`` of at most ``capacity``."""
    spark = pieces.sparkSession
    ship(spark)
    keys = [c for c in pieces.columns]
    total = pieces.count()
    buckets = max(LEAST_BUCKETS, total // BUCKET_ROWS)
    dealt = pieces.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)))
    counts = dealt.groupBy("_bucket", "length").agg(F.count("*").alias("_n"))
    # one row for each length, of which there are no more than the capacity
    lengths = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if lengths and not 0 < min(lengths) <= max(lengths) <= capacity:
        raise ValueError(f"lengths must lie between 1 and {capacity}")
    where = places(plan(lengths, capacity))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", "length", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bucket", "length").orderBy(*keys))
    ranked = dealt.withColumn("_rank", rank).join(offsets, ["_bucket", "length"]).select(*keys, (F.col("_rank") - 1 + F.col("_before")).alias("_rank"))

    def run(batches):
        for batch in batches:
            size = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy()
            seq, at = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
            for x in np.unique(size):
                mine = size == x
                starts, firsts, ats = where[int(x)]
                k = np.searchsorted(starts, rank[mine], side="right") - 1
                seq[mine], at[mine] = firsts[k] + rank[mine] - starts[k], ats[k]
            kept = [batch.column(c) for c in keys]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(seq), pa.array(at)], names=[*keys, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    # no more tasks, and files of whoever writes this, than so many rows need
    ranked = ranked.coalesce(max(1, -(-total // FILE_ROWS)))
    return ranked.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All documents as sequences of token pieces: one row a piece with its place."""
    return pack(stage(token_pieces(docs, path, capacity, end_id), "pieces"), capacity)
