"""Line dedup by content-defined chunks of lines.

Blank lines aside, a text is a list of lines. A rolling hash over the hashes of ``ROLL`` lines is
taken at each line; of each ``PICK`` neighbouring ones the least makes its line a boundary. So boundaries depend on
``ROLL + PICK - 1`` lines only: an insertion moves none but those beside it, and they are never farther apart
than ``PICK`` lines. A chunk reaches from a boundary to the line that the next one begins at, so it has
two lines or more. A second, plainer pass adds each line of ``LONG_WORDS`` words (or ``LONG_BYTES`` bytes) as
a chunk of its own, since a passage may be one line.

Of the chunks that occur more than once in all documents, the first occurrence, by document and
place, stays. Each other one is marked, and with it up to ``BESIDE`` shorter lines on either side that stand beside the first
occurrence too. All that is marked has been compared byte by byte: digests stand for bytes only where
all occurrences of the digest have the same. Marked lines go if they are several in a run, or one of ``PASSAGE_WORDS`` words: shorter
single lines, such as headings and notices, are no passages and stay wherever they repeat.

Every run of whole lines with more than 4 * (``LONG_WORDS`` - 1) words has a chunk in it: it has a long line, or it
has at least five lines, and of five lines two are boundaries whatever stands around them. What goes is always in an earlier
document, or earlier in the same one, in whole lines. A passage that begins or ends within a line isn't seen there.

Defined results: a null text stays null and an empty one empty; a text whose lines all repeat
becomes empty; a null id comes after all others; documents that share an id, or have none, come in the order of a
hash of their texts; rows with the same id and text are one document that is given several times, and
keep and lose the same lines; an empty table gives an empty result; other columns are passed through, whatever their names.

Occurrences are counted with partial sums; the few digests with very many occurrences are joined apart, from a
table of bounded size. No more than a document's own chunks come together in one row.
"""

from __future__ import annotations

import hashlib
from collections import OrderedDict
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import joined_by_count, ship, slices, stage, unstage

#: Lines in the rolling window, and neighbouring rolling hashes of which the least is a boundary.
ROLL, PICK = 2, 2
#: A line that is a chunk by itself; lines beside a chunk that are compared too; words of a single line that goes.
LONG_WORDS, LONG_BYTES, BESIDE, PASSAGE_WORDS = 13, 400, 3, 25
DIGEST_BYTES = 16
#: Bytes of bodies that a task remembers, so that it sends what repeats within it once.
REMEMBERED = 4 << 20
_TURN, _MIX, _MASK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, (1 << 64) - 1
_DROP = pow(_TURN, ROLL, 1 << 64)
LAST = (1 << 63) - 1
#: Bits of the filter that keeps untouched texts out of shuffles: for each document that is touched, and in all (8 MB at most).
BITS_EACH, LEAST_BITS, MOST_BITS, ROW_BITS = 16, 1 << 18, 1 << 26, 1 << 15


def boundaries(lines: list[bytes]) -> list[int]:
    """Lines at which a rolling hash is the least of ``PICK`` neighbouring ones."""
    import xxhash

    hashes = [xxhash.xxh3_64_intdigest(x) for x in lines]
    rolled, roll = [], 0
    for k, h in enumerate(hashes):
        roll = (roll * _TURN + h - (_DROP * hashes[k - ROLL] if k >= ROLL else 0)) & _MASK
        if k >= ROLL - 1:
            rolled.append((roll ^ roll >> 29) * _MIX & _MASK)
    out: list[int] = []
    for k in range(len(rolled) - PICK + 1):
        near = rolled[k : k + PICK]
        at = k + near.index(min(near))
        if not out or out[-1] != at:
            out.append(at)
    return out


def is_long(line: bytes) -> bool:
    return len(line) > LONG_BYTES or len(line) >= 2 * LONG_WORDS - 1 and len(line.split()) >= LONG_WORDS


def chunks(lines: list[bytes]) -> list[tuple[int, int]]:
    """(from, to) of each chunk: those between boundaries, which overlap by a line, and long lines."""
    return [(a, b + 1) for a, b in pairwise(boundaries(lines))] + [(k, k + 1) for k, x in enumerate(lines) if is_long(x)]


def filled(text: bytes) -> list[bytes]:
    """The lines that aren't blank."""
    return [x for x in text.split(b"\n") if x and not x.isspace()]


def digest(body: bytes, size: int = DIGEST_BYTES) -> bytes:
    return hashlib.blake2b(body, digest_size=size).digest()


def occurrences(rows: DataFrame, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """``id``, ``h``, ``a``, ``z`` and ``digest`` of each chunk, from ``id``, ``h`` and ``text``."""

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                which, starts, ends, digests = [], [], [], []
                for k, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
                    lines = filled(text)
                    for a, z in chunks(lines):
                        which.append(k)
                        starts.append(a)
                        ends.append(z)
                        digests.append(digest(b"\n".join(lines[a:z]), digest_bytes))
                which = pa.array(which, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").take(which), batch.column("h").take(which), pa.array(starts, pa.int32()), pa.array(ends, pa.int32()), pa.array(digests, pa.binary())],
                    names=["id", "h", "a", "z", "digest"],
                )

    return rows.mapInArrow(run, "id long, h long, a int, z int, digest binary")


SEEN = "id long, h long, a int, z int, digest binary, first boolean, before array<binary>, after array<binary>, body binary"


def looked_at(rows: DataFrame, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """For the repeated chunks in ``spots`` of each text: what stands beside them, and rows with the bytes of all digests."""

    def run(batches):
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.bool_(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.binary())
        names = [c.split()[0] for c in SEEN.split(", ")]
        sent: OrderedDict[bytes, bytes] = OrderedDict()
        size = 0
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                out: list[tuple] = []

                def known(body: bytes) -> bytes:
                    nonlocal size
                    key = digest(body, digest_bytes)
                    if sent.get(key) != body:
                        out.append((None, None, None, None, key, None, None, None, body))
                        size += len(body) - len(sent.get(key, b""))
                        sent[key] = body
                        while size > REMEMBERED:
                            size -= len(sent.popitem(last=False)[1])
                    return key

                ids, hs, spots = (batch.column(c).to_pylist() for c in ("id", "h", "spots"))
                for i, h, text, mine in zip(ids, hs, batch.column("text").cast(pa.binary()).to_pylist(), spots, strict=True):
                    lines = filled(text)

                    def beside(at: int, step: int) -> list[bytes]:
                        got: list[bytes] = []
                        while len(got) < BESIDE and 0 <= at < len(lines) and not is_long(lines[at]):
                            got.append(known(lines[at]))
                            at += step
                        return got

                    for s in mine:
                        a, z = s["a"], s["z"]
                        out.append((i, h, a, z, known(b"\n".join(lines[a:z])), s["first"], beside(a - 1, -1), beside(z, 1), None))
                cols = zip(*out, strict=True) if out else ((),) * len(types)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    return rows.mapInArrow(run, SEEN)


def without(text: bytes, cuts: list[tuple[int, int]]) -> bytes:
    """The text without the lines of ``cuts`` (from, to; blank lines don't count) where they are a passage, and without blank lines within one."""
    lines = text.split(b"\n")
    places = [k for k, x in enumerate(lines) if x and not x.isspace()]
    marked = bytearray(len(places))
    for a, z in cuts:
        marked[a:z] = b"\1" * (min(z, len(places)) - a)
    gone, at = bytearray(len(lines)), 0
    for out, run in groupby(marked):
        to = at + sum(1 for _ in run)
        if out and (to - at > 1 or len(lines[places[at]].split()) >= PASSAGE_WORDS):
            gone[places[at] : places[to - 1] + 1] = b"\1" * (places[to - 1] + 1 - places[at])
        at = to
    return b"\n".join(x for x, out in zip(lines, gone, strict=True) if not out) if any(gone) else text


def marked(rows: DataFrame, keys: DataFrame, n: int) -> DataFrame:
    """Adds ``_maybe``: false where (``id``, ``h``) is surely none of the ``n`` ``keys``. The filter grows with them to a bound; beyond, more rows pass."""
    size = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_EACH * n).bit_length()))
    place = lambda: F.pmod(F.xxhash64("id", "h"), F.lit(size))
    part, at = (lambda h: F.floor(h / ROW_BITS).cast("int")), (lambda h: (h % ROW_BITS).cast("long"))
    bits = keys.select(place().alias("_h")).groupBy(part(F.col("_h")).alias("_part")).agg(F.bitmap_construct_agg(at(F.col("_h"))).alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(F.col("_at") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = F.pmod(F.floor(byte / F.pow(F.lit(2), F.col("_at") % 8)), F.lit(2)) == 1
    names = rows.columns
    placed = rows.select("*", part(place()).alias("_part"), at(place()).alias("_at"))
    return placed.join(F.broadcast(bits), "_part", "left").select(*names, F.coalesce(bit, F.lit(False)).alias("_maybe"))


def beside_first(mine: str, first: str) -> Column:
    """How many of the digests beside a chunk are those beside the first occurrence, from the chunk outwards."""
    out = F.lit(0)
    for k in reversed(range(BESIDE)):
        out = F.when(F.get(F.col(mine), F.lit(k)) == F.get(F.col(first), F.lit(k)), out + 1).otherwise(0)
    return out


def cuts_of(rows: DataFrame, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """``id``, ``h`` and ``cuts`` of the documents (``id``, ``h``, ``text``) that lose lines."""
    found = stage(occurrences(rows, digest_bytes), "chunks")
    total = found.count()
    repeated = found.groupBy("digest").agg(F.count("*").alias("n"), F.min(F.struct("id", "h", "a")).alias("first")).filter("n > 1")
    repeated = stage(repeated, "repeated", total // 2)
    again = joined_by_count(found, repeated, "digest", total)
    spots = again.select("id", "h", "a", "z", (F.struct("id", "h", "a") == F.col("first")).alias("first"))
    # a document's own chunks; rows that are the same document give the same ones
    spots = stage(spots.groupBy("id", "h").agg(F.collect_set(F.struct("a", "z", "first")).alias("spots")), "spots", total)
    touched = spots.count()
    asked = marked(rows, spots, touched).filter("_maybe").drop("_maybe").join(spots, ["id", "h"])
    seen = stage(looked_at(asked, digest_bytes), "seen")
    bodies = seen.filter("body is not null").select("digest", "body").distinct()
    differing = stage(bodies.groupBy("digest").agg(F.count("*").alias("bodies")).filter("bodies > 1"), "differing")
    beside = differing.isEmpty()
    places = seen.filter("body is null")
    firsts = places.filter("first").groupBy("digest").agg(F.first("before").alias("b0"), F.first("after").alias("a0")).join(repeated.select("digest", "n"), "digest")
    later = places.filter("not first").select("id", "h", "a", "z", "digest", "before", "after")
    later = joined_by_count(later, stage(firsts, "firsts", total // 2), "digest", total)
    if not beside:  # two bodies of one digest: such chunks stay, and no line goes for what stands beside it
        later = later.join(differing.select("digest"), "digest", "left_anti")
    reach = lambda mine, first: beside_first(mine, first) if beside else F.lit(0)
    cut = F.struct((F.col("a") - reach("before", "b0")).alias("a"), (F.col("z") + reach("after", "a0")).alias("z"))
    cuts = stage(later.groupBy("id", "h").agg(F.collect_set(cut).alias("cuts")), "cuts", touched)
    for done in (found, spots, seen, differing):
        unstage(done)
    return cuts


def dedup_lines(docs: DataFrame, digest_bytes: int = DIGEST_BYTES) -> DataFrame:
    """The same rows and columns; ``text`` without the passages that an earlier document, or place, has."""
    ship(docs.sparkSession)
    names = docs.columns
    key = [F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"), F.xxhash64("text").alias("h")]
    cuts = cuts_of(docs.select(*key, "text").filter(F.col("text").isNotNull()), digest_bytes)
    # the columns under names that none of the table's clashes with; texts without a cut aren't dealt out
    packed = marked(docs.select(*key, "text", F.struct(*([F.col(f"`{c}`") for c in names if c != "text"] or [F.lit(0).alias("none")])).alias("row")), cuts, cuts.count())
    touched = packed.filter("_maybe").drop("_maybe").join(cuts, ["id", "h"], "left").select("text", "row", "cuts")
    back = [F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in names]

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text"):
                texts = batch.column("text").cast(pa.binary()).to_pylist()
                for k, cut in enumerate(batch.column("cuts").to_pylist()):
                    if cut and texts[k] is not None:
                        texts[k] = without(texts[k], [(c["a"], c["z"]) for c in cut])
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()).cast(pa.string()), batch.column("row")], names=["text", "row"])

    kind = touched.select("text", "row").schema
    return packed.filter("not _maybe").select(*back).union(touched.mapInArrow(run, kind).select(*back))
