"""MinHash near-deduplication with SetSketch registers.

A document's set are its distinct shingles of five words. Its sketch has ``REGISTERS`` registers of
two bytes: the least of exponentially distributed hashes of the set, on a scale of powers of
``BASE``, truncated to two bytes. The register of a union is the greater one, so sketches merge,
and two sets agree in a register at least as often as they have elements in common. Powers lie so close
that unlike sets hardly ever agree by chance.

1. Rows with equal sets are one class; one row of each, with the smallest id, stands for it.
2. Bands of ``ROWS`` registers are keys. In each bucket of the first ``FIRST_BANDS`` bands, the classes are paired with the bucket's
   smallest one: a star, not all pairs.
3. The Jaccard similarity of a pair is estimated by maximum likelihood from how many registers are
   less, equal and greater, with the sets' sizes known; pairs far below the limit go.
4. Pairs are verified on full sets, at first the likeliest one of each class, then those that
   still join different components. So most copies are in one component before the other bands are looked at.
5. Of the buckets of all bands, those with classes of several components are left. There, one class
   of each component is paired with the smallest one, as before.
6. In buckets that have several components still, all classes of different components are compared in blocks: by
   their sketches, and on full sets where those are near the limit. Classes of a bucket's largest component
   meet those of the others only. A pair is compared in the first
   band it shares; a block returns links that join components, fewer than its classes. So
   no pair that shares a bucket is left out unless its two documents are in one component anyway.

A pair at the limit shares no bucket with a probability below 1e-5; nothing is capped.

Defined results: a text that is null or without words has an empty set and is linked with nothing;
with fewer words than a shingle, the whole sequence is the one shingle; each row is a document, whatever its
id: rows that repeat an id are linked if their texts are alike, and only then; a null id
is a document like any other, but no ``component_id`` unless all of its component have none, and then that is null, and
not ``kept``; ``kept_documents`` keeps one row of each component, the first of the rows with the smallest id,
and all rows with empty sets; an empty table gives an empty result; columns other than ``doc_id``
and ``text`` are ignored. Sets are compared by 64-bit hashes of their shingles.
"""

from __future__ import annotations

import hashlib
import math
from collections import OrderedDict
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import joined_by_count, ship, slices, stage, unstage
from tessera.llm.components import components

WORDS, LIMIT = 5, 0.75
BANDS, ROWS = 32, 4
FIRST_BANDS = 8
BAND_BITS = 5
REGISTERS = BANDS * ROWS
#: The scale of the registers: minima of rate ``RATE`` in powers of ``BASE``, cut to 0..``MOST``.
BASE, RATE, MOST = 1.001, 20.0, 65_535
#: Pairs with a lower estimate are dropped: about five standard errors below the limit.
LEAST_ESTIMATE = 0.55
#: Classes of a block, and bytes of their compressed words; rows of small buckets that are compared in one call; bytes of full sets kept at a time.
BLOCK, BLOCK_BYTES, CALL_ROWS, SET_BYTES = 512, 8 << 20, 2000, 16 << 20
CACHE_WORDS = 100_000
#: Stands for a null id where ids are compared.
LAST = (1 << 63) - 1
_GRID = np.linspace(0.0, 1.0, 101)
_ODD = np.random.default_rng(20).integers(0, 1 << 64, REGISTERS, np.uint64, endpoint=False) | np.uint64(1)
_MIX = np.random.default_rng(21).integers(0, 1 << 64, WORDS, np.uint64, endpoint=False) | np.uint64(1)


class _Words(dict):
    """64-bit hashes of words, computed once while they are kept."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = h
        return h


@lru_cache(maxsize=1)
def word_hashes() -> _Words:
    return _Words()


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * np.uint64(0x7FB5D329728EA185)
    h = (h ^ h >> np.uint64(27)) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ h >> np.uint64(33)


def words_of(text: str) -> list[bytes]:
    """Runs without ASCII white space, A-Z in lower case; bytes.lower and bytes.split do just that."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingles(words: list[bytes]) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(word_hashes().__getitem__, words), np.uint64, len(words))
    if len(h) < WORDS:
        out = np.array([len(h)], np.uint64)
        for k in range(len(h)):
            out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : k + 1] * _MIX[k]
        return _stir(out)
    n = len(h) - WORDS + 1
    out = h[:n] * _MIX[0]
    for k in range(1, WORDS):
        out = _stir(out) + h[k : k + n] * _MIX[k]
    return np.unique(_stir(out))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """The sketches of sets that are not empty."""
    if not sets:
        return np.empty((0, REGISTERS), "<u2")
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    low = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    least = np.empty((REGISTERS, len(sets)), np.uint32)
    odd = (_ODD >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    for a in range(0, len(low), 1 << 15) if len(sets) == 1 else [None]:
        if a is None:
            work = np.empty_like(low)
            for k in range(REGISTERS):
                np.multiply(low, odd[k], out=work)
                np.minimum.reduceat(work, starts, out=least[k])
        else:  # a long text in parts: minima merge
            part = (low[a : a + (1 << 15), None] * odd).min(axis=0)
            least[:, 0] = part if a == 0 else np.minimum(least[:, 0], part)
    x = -np.log1p(-(least.T + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(x) / math.log(BASE)), 0, MOST).astype("<u2")


def estimates(k1: np.ndarray, n1: np.ndarray, k2: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Jaccard similarity of pairs of sketches by maximum likelihood over a grid, sizes known."""
    above, below = (k1 > k2).sum(axis=1)[:, None], (k1 < k2).sum(axis=1)[:, None]
    same = k1.shape[1] - above - below
    u = (n1 / (n1 + n2))[:, None]
    v = 1 - u
    j = _GRID[None, :]
    p = lambda x: -np.log1p(-np.maximum(x, 1e-12) * (BASE - 1) / BASE) / math.log(BASE)
    up, down = p(u - v * j), p(v - u * j)
    value = above * np.log(up) + below * np.log(down) + same * np.log(np.maximum(1e-12, 1 - up - down))
    value = np.where((j <= u / v + 1e-9) & (j <= v / u + 1e-9), value, -np.inf)
    return _GRID[value.argmax(axis=1)]


def sizes_fit(a: Column, b: Column) -> Column:
    """Sets of such sizes can be as similar as the limit."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * 75


def alike(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sorted sets are at least as similar as the limit."""
    if len(x) > len(y):
        x, y = y, x
    both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum())
    return 100 * both >= 75 * (len(x) + len(y) - both)


class Sets:
    """Full sets by key, from compressed words; those used last are kept, ``SET_BYTES`` in all."""

    def __init__(self):
        import zstandard

        self.unpack, self.kept, self.size = zstandard.ZstdDecompressor(), OrderedDict(), 0

    def get(self, key: int, words: bytes) -> np.ndarray:
        if (found := self.kept.pop(key, None)) is None:
            found = shingles(self.unpack.decompress(words).split(b" "))
            self.size += found.nbytes
            while self.size > SET_BYTES and self.kept:
                self.size -= self.kept.popitem(last=False)[1].nbytes
        self.kept[key] = found
        return found


SKETCHES = "uid long, doc_id long, m long, digest binary, sketch binary, words binary"


def sketches(rows: DataFrame) -> DataFrame:
    """For rows with ``uid``, ``doc_id`` and ``text``: set size, digest of the set, sketch, and the words, compressed, to get the set again."""
    ship(rows.sparkSession)

    def run(batches):
        import zstandard

        pack = zstandard.ZstdCompressor(level=1)
        for whole in batches:
            for batch in slices(whole, "text", 1 << 20):
                words = [words_of(t) for t in batch.column("text").to_pylist()]
                sets = [shingles(w) for w in words]
                some = [k for k, s in enumerate(sets) if len(s)]
                made = registers([sets[k] for k in some])
                sketch: list[bytes | None] = [None] * len(sets)
                for k, m in zip(some, made, strict=True):
                    sketch[k] = m.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("uid"),
                        batch.column("doc_id").cast(pa.int64()),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([hashlib.blake2b(s, digest_size=16).digest() if len(s) else None for s in sets], pa.binary()),
                        pa.array(sketch, pa.binary()),
                        pa.array([pack.compress(b" ".join(w)) if w else None for w in words], pa.binary()),
                    ],
                    names=["uid", "doc_id", "m", "digest", "sketch", "words"],
                )

    return rows.select("uid", "doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SKETCHES)


def _rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), -1)


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose estimate is near the limit or above it, with the estimate."""
    side = lambda x: nodes.select(F.col("id").alias(x), F.col("m").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").filter(sizes_fit(F.col("n_a"), F.col("n_b")))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                j = estimates(_rows_of(batch.column("s_a")), batch.column("n_a").to_numpy(), _rows_of(batch.column("s_b")), batch.column("n_b").to_numpy())
                keep = pa.array(j >= LEAST_ESTIMATE)
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep), pa.array(j).filter(keep)], names=["a", "b", "j"])

    return both.select("a", "b", "n_a", "s_a", "n_b", "s_b").mapInArrow(run, "a long, b long, j double")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs whose full sets are at least as similar as the limit."""
    side = lambda x: texts.select(F.col("id").alias(x), F.col("words").alias(f"w_{x}"))

    def run(batches):
        sets = Sets()
        for whole in batches:
            for batch in slices(whole, "w_b", 1 << 20):
                keep = []
                for a, wa, b, wb in zip(*(batch.column(c).to_pylist() for c in ("a", "w_a", "b", "w_b")), strict=True):
                    keep.append(alike(sets.get(a, wa), sets.get(b, wb)))
                kept = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_arrays([batch.column("a").filter(kept), batch.column("b").filter(kept)], names=["a", "b"])

    return pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a").select("a", "w_a", "b", "w_b").mapInArrow(run, "a long, b long")


def bucket_keys(nodes: DataFrame, bands: int = BANDS) -> DataFrame:
    """``key`` for each band of each class, besides its columns but the sketch; a key's lowest bits are its band's number."""
    hashed = lambda i: F.xxhash64(i, F.substring("sketch", i * 2 * ROWS + 1, F.lit(2 * ROWS)))
    band = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.shiftleft(hashed(i), BAND_BITS).bitwiseOR(i.cast("long")))
    return nodes.select("*", F.explode(band).alias("key")).drop("sketch", "m", "digest", "n", "first")


def labelled(df: DataFrame, column: str, labels: DataFrame) -> DataFrame:
    """Adds ``label``: the component of the node in ``column``."""
    return df.join(labels.select(F.col("id").alias(column), F.col("label").alias("_l")), column, "left").withColumn("label", F.coalesce("_l", column)).drop("_l")


def across(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose nodes are in different components, with these as ``la`` and ``lb``."""
    out = labelled(labelled(pairs, "a", labels).withColumnRenamed("label", "la"), "b", labels).withColumnRenamed("label", "lb")
    return out.filter(F.col("la") != F.col("lb"))


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: those of the components' labels, put in for the labels."""
    if not (n := links.count()):
        return labels
    between = across(links, labels).select(F.least("la", "lb").alias("a"), F.greatest("la", "lb").alias("b"))
    more = stage(components(between, n), "labels")
    moved = labels.join(more.select(F.col("id").alias("label"), F.col("label").alias("to")), "label", "left").select("id", F.coalesce("to", "label").alias("label"))
    return stage(moved.unionByName(more.join(labels.select("id"), "id", "left_anti")), "labels")


def linked_within(ids: np.ndarray, label: np.ndarray, n: np.ndarray, sketch: np.ndarray, words: list[bytes], pair: np.ndarray, band: int, sets: Sets) -> list[tuple[int, int]]:
    """Verified links between components of a block's classes; ``pair`` has the chunk of each, of which two different ones are compared if there are two."""
    two = bool((pair != pair[0]).any())
    rows = sketch.reshape(len(ids), BANDS, ROWS)
    label, out = label.copy(), []
    for i in range(len(ids)):
        k = np.flatnonzero((label != label[i]) & (ids > ids[i]) & (100 * np.minimum(n, n[i]) >= 75 * np.maximum(n, n[i])) & ((pair != pair[i]) | (not two)))
        if len(k):
            same = rows[k] == rows[i]
            whole = same.all(axis=2)
            # registers that agree are the larger part wherever the likelihood peaks near the limit
            k = k[(whole.argmax(axis=1) == band) & whole[:, band] & (same.mean(axis=(1, 2)) >= LEAST_ESTIMATE - 0.08)]
        if len(k):
            j = estimates(np.broadcast_to(sketch[i], (len(k), sketch.shape[1])), np.full(len(k), n[i]), sketch[k], n[k])
            for x in k[(j >= LEAST_ESTIMATE)][np.argsort(-j[j >= LEAST_ESTIMATE], kind="stable")].tolist():
                if label[x] != label[i] and alike(sets.get(int(ids[i]), words[i]), sets.get(int(ids[x]), words[x])):
                    out.append((int(ids[i]), int(ids[x])))
                    label[label == label[x]] = label[i]
    return out


def mixed_buckets(members: DataFrame) -> DataFrame:
    """``key`` and ``n``, its rows, of the buckets with several components, from ``key`` and ``label``."""
    return members.groupBy("key").agg(F.min("label").alias("x"), F.max("label").alias("y"), F.count("*").alias("n")).filter("x != y").select("key", "n")


def residual_links(members: DataFrame, classes: DataFrame) -> DataFrame:
    """Verified links between different components within buckets, found in blocks, from ``key``, ``id`` and ``label``."""
    rows = members.join(classes.select("id", "m", "sketch", "words", F.length("words").alias("size")), "id")
    each = rows.groupBy("key", "label").agg(F.count("*").alias("c"), F.sum("size").alias("b"))
    buckets = each.groupBy("key").agg(F.max(F.struct("c", "label", "b")).alias("top"), F.sum("c").alias("n"), F.sum("b").alias("b")).filter(F.col("n") > F.col("top.c"))
    parts = lambda n, b: F.greatest(F.lit(1), F.ceil(F.greatest(n / BLOCK, b / BLOCK_BYTES))).cast("int")
    small = (F.col("n") <= BLOCK) & (F.col("b") <= BLOCK_BYTES)
    top, rest = parts(F.col("top.c"), F.col("top.b")), parts(F.col("n") - F.col("top.c"), F.col("b") - F.col("top.b"))
    buckets = buckets.select("key", "n", "b", F.col("top.label").alias("largest"), F.when(small, 0).otherwise(top).alias("first"), F.when(small, 1).otherwise(rest).alias("others"))
    buckets = stage(buckets, "mixed")
    facts = buckets.agg(F.sum(F.when(small, F.col("n"))).alias("n"), F.sum(F.when(small, F.col("b"))).alias("b"), F.sum("n").alias("all")).first()
    calls = max(1, (facts["n"] or 0) // CALL_ROWS, (facts["b"] or 0) // BLOCK_BYTES)
    rows = joined_by_count(rows.drop("size"), buckets.drop("b"), "key", facts["all"] or 0)
    # a bucket's largest component has chunks of its own; a cell holds two chunks, or one of the others alone, and each of them is in a cell with each other one
    of = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    inner = (F.col("first") > 0) & (F.col("label") == F.col("largest"))
    rows = rows.withColumn("chunk", F.when(inner, of(F.greatest("first", F.lit(1)))).otherwise(F.col("first") + of(F.col("others"))))
    meets = F.sequence(F.when(inner, F.col("first")).otherwise(F.lit(0)), F.col("first") + F.col("others") - 1)
    cells = rows.withColumn("other", F.explode(meets)).withColumn("call", F.when(F.col("first") == 0, F.pmod(F.xxhash64("key"), F.lit(calls))).otherwise(F.lit(-1)))
    cells = cells.select(
        "call", F.when(F.col("call") < 0, F.col("key")).otherwise(F.lit(0)).alias("alone"), F.least("chunk", "other").alias("c1"), F.greatest("chunk", "other").alias("c2"),
        "key", "chunk", "id", "label", "m", "sketch", "words",
    )

    def run(cell: pa.Table) -> pa.Table:
        key, ids, label, n, chunk = (cell.column(c).to_numpy() for c in ("key", "id", "label", "m", "chunk"))
        sketch, words = _rows_of(cell.column("sketch").combine_chunks()), cell.column("words").to_pylist()
        out: list[tuple[int, int]] = []
        one = cell.column("c1")[0] == cell.column("c2")[0]
        order, sets = np.argsort(key, kind="stable"), Sets()
        for k in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if one or (chunk[k] != chunk[k[0]]).any():
                out += linked_within(ids[k], label[k], n[k], sketch[k], [words[x] for x in k], chunk[k], int(key[k[0]]) & (1 << BAND_BITS) - 1, sets)
        return pa.table([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])

    return cells.groupBy("call", "alone", "c1", "c2").applyInArrow(run, "a long, b long")


def grouped(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Classes of sketched rows (``digest``, ``n`` rows, set size ``m``, ``first``: the least of (doc_id, uid)), and (``id``, ``keeper``) of those in components of several classes."""
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("doc"), "uid")).alias("first")
    # equal sets have equal sizes and sketches
    nodes = rows.filter("m > 0").groupBy("digest").agg(first, F.count("*").alias("n"), F.max("m").alias("m"), F.first("sketch").alias("sketch"))
    nodes = stage(nodes.withColumn("id", F.col("first.uid")), "nodes", rows.count())
    labels = _components_of(nodes, rows.select(F.col("uid").alias("id"), "words"))
    # labels are the least of the ids, which are any numbers; a component's first row is that of the smallest doc_id
    whole = labels.select("id", "label").unionByName(labels.select(F.col("label").alias("id"), "label").distinct())
    whole = stage(whole.join(nodes.select("id", "first"), "id"), "whole")
    keepers = whole.groupBy("label").agg(F.min("first").alias("keeper"))
    return nodes, whole.join(keepers, "label").select("id", "keeper")


def numbered(docs: DataFrame) -> DataFrame:
    """Adds ``uid``, a number of each row; it holds once it is written."""
    return docs.withColumn("uid", F.monotonically_increasing_id())


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: ``doc_id``, ``n_shingles``, ``component_id`` and ``kept``."""
    rows = stage(sketches(numbered(docs.select("doc_id", "text"))), "sketches")
    nodes, keepers = grouped(rows)
    total = rows.count()
    classes = nodes.join(keepers, "id", "left").select("digest", "n", F.coalesce("keeper.doc", "first.doc").alias("least"))
    some = joined_by_count(rows.filter("m > 0").select("doc_id", "m", "digest"), stage(classes, "classes"), "digest", total).select("doc_id", "m", "least")
    out = some.unionByName(rows.filter("m = 0").select("doc_id", "m", F.col("doc_id").alias("least")))
    label = F.nullif(F.col("least"), F.lit(LAST))
    return out.select("doc_id", F.col("m").alias("n_shingles"), label.alias("component_id"), F.coalesce(F.col("doc_id") == label, F.lit(False)).alias("kept"))


def _components_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """Components of classes (id, m, sketch) with texts (id, words): ``id`` and ``label`` where they differ."""
    keys = bucket_keys(nodes.select("id", "sketch"))
    # texts of the classes that share a bucket with another; the only time that texts are dealt out by id
    shared = stage(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("a")).filter("n > 1"), "buckets", nodes.count() * BANDS // 2)
    total = shared.agg(F.sum("n")).first()[0] or 0
    asked = keys.join(shared.select("key"), "key", "left_semi").select("id").distinct()
    classes = stage(texts.join(asked, "id").join(nodes.select("id", "m", "sketch"), "id"), "texts")

    early = bucket_keys(classes.select("id", "sketch"), FIRST_BANDS)
    stars = joined_by_count(early, shared, "key", total).filter(F.col("id") != F.col("a")).select("a", F.col("id").alias("b")).distinct()
    likely = stage(estimated(stars, classes), "likely")
    first = likely.groupBy("b").agg(F.max_by("a", F.struct("j", -F.col("a"))).alias("a")).select("a", "b")
    labels = stage(components(verified(first, classes), likely.count()), "labels")
    rest = across(likely.join(first, ["a", "b"], "left_anti"), labels)
    labels = joined(labels, stage(verified(rest, classes), "links"))

    late = bucket_keys(labelled(classes.select("id", "sketch"), "id", labels))
    mixed = stage(mixed_buckets(late), "mixed", total // 2)
    each = late.groupBy("key", "label").agg(F.min("id").alias("b")).join(mixed, "key", "left_semi")
    stars = each.join(each.groupBy("key").agg(F.min("b").alias("a")), "key").filter("a != b").select("a", "b").distinct()
    labels = joined(labels, stage(verified(estimated(stars, classes), classes), "links"))

    members = stage(joined_by_count(late.select("key", "id"), mixed, "key", total).filter("n > 2").drop("n"), "members")
    members = labelled(members, "id", labels)
    members = members.join(mixed_buckets(members).select("key"), "key", "left_semi")
    more = stage(residual_links(members, classes), "residual")
    if not more.isEmpty():
        labels = joined(labels, more)
    for done in (shared, likely, classes, mixed, more):
        unstage(done)
    return labels


def kept_documents(docs: DataFrame) -> DataFrame:
    """One row of each group of near duplicates, with all its columns."""
    names = docs.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("row")
    whole = stage(numbered(docs.select("doc_id", "text", row)).select("uid", "row"), "documents")
    rows = stage(sketches(whole.select("uid", "row.doc_id", "row.text")), "sketches")
    nodes, keepers = grouped(rows)
    alone = nodes.join(keepers, "id", "left").filter("keeper is null or keeper.uid = id").select(F.col("id").alias("uid"))
    kept = alone.unionByName(rows.filter("m = 0").select("uid"))
    return whole.join(kept, "uid", "left_semi").select(*[F.col(f"row.`{c}`") for c in names])
