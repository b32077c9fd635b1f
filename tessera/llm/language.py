"""Language identification by cross-parsing entropy.

A suffix automaton per language accepts all substrings of a sample of its labelled text. A
text is parsed from the left, end to end, into longest matches of the automaton; the fewer phrases it
takes, the closer the text is to the sample. Phrases count as log2(sample length) bits each
over the length of the text (the cross-parsing estimate of entropy), and the language with the fewest bits wins.

Texts are lower-cased and other characters than letters become single spaces; a symbol is a code point, so
every letter keeps its identity. The moves of all automata are one hash table, whose size follows the samples
whatever the alphabet. For speed, many texts walk in step, and a long text is cut into segments that walk at the same
time: each is parsed as if a phrase began with it, and then again from where the phrase before it really
ends until both parses have a phrase begin at the same place, from where on they agree. So phrases are those of the whole text.

Learning reads all labels; the sample is bounded: in the order of a hash of the text, ``SAMPLE_TEXTS`` different whole texts of each language
make the automaton and ``CHECK_TEXTS`` more calibrate, all of at most ``ROW_CHARS`` characters; a language that has
only longer ones is learned from its shortest.

``in_known_language`` decides by the mean length of phrases for all samples together, so texts that mix languages stay. The limit lies a ``MARGIN``
of the way from what a language's calibration texts have when their letters are shuffled to what they have as they are, in the language where that is least. A text of fewer than ``ENOUGH`` symbols says
too little for that: it stays where at least half of its letters are in one language's sample.

Defined results: a text that is null or has no letter is ``und`` with score 0, and so is any
text where nothing was learned; letters that no sample has are phrases of their own; ties go
to the smaller label; repeated rows give repeated results; a row with a null ``doc_id`` is a text like any other, and not
held out, as an empty id wouldn't be; an empty table gives an empty result; columns other than ``doc_id`` and ``text`` are ignored, by
``in_known_language`` passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import ship, slices

#: The bound of the sample: whole texts for each language, those that calibrate, and their length.
SAMPLE_TEXTS, CHECK_TEXTS, ROW_CHARS = 24, 12, 1500
UNDETERMINED = "und"
#: How sharply bits a symbol turn into a score.
SHARPNESS = 6.0
#: Where the limit of the mean length lies between shuffled and real text.
MARGIN = 0.25
#: Letters and spaces from which on the mean can be judged.
ENOUGH = 128
#: Symbols of a segment, and bytes of text in a step; parts in which a language's texts are ranked at first.
SEGMENT, STEP, PARTS = 1024, 4 << 20, 64
SPACE, PAD, SYMBOL_BITS = 0x20, 0x1FFFFF, 21
_EMPTY, _ODD = np.uint64(0xFFFFFFFFFFFFFFFF), np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Sample:
    label: str
    text: str
    checks: tuple[str, ...] = ()


def held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3 == 1


def learn(labelled: DataFrame) -> tuple[Sample, ...]:
    """Samples of each value of ``lang`` from rows with ``text`` and ``lang``."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    rows = rows.select("lang", "text", F.xxhash64("text").alias("mix"), F.length("text").alias("size"))
    # short enough texts by hash, then longer ones by length, of which the first counts if it is the only one
    order = rows.select("lang", F.when(F.col("size") > ROW_CHARS, F.col("size")).otherwise(0).alias("over"), "mix").distinct()
    # the first of each part of a language, and then the first of those, so that no task sees what all others have found
    for by in (["lang", F.pmod("mix", F.lit(PARTS))], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("over", "mix"))
        order = order.withColumn("rank", rank).filter(F.col("rank") <= SAMPLE_TEXTS + CHECK_TEXTS)
    order = order.filter("over = 0 or rank = 1")
    # a few rows of some bytes for each label, so that no text but the sample's is dealt out
    few = rows.join(F.broadcast(order.select("lang", "mix", "rank")), ["lang", "mix"]).dropDuplicates(["lang", "mix"])
    texts: dict[str, list[str]] = {}
    for r in few.select("lang", "rank", "text").orderBy("lang", "rank").collect():
        texts.setdefault(r["lang"], []).append(r["text"])
    return tuple(Sample(k, "\n".join(v[:SAMPLE_TEXTS]), tuple(v[SAMPLE_TEXTS:])) for k, v in sorted(texts.items()))


_letters: list[np.ndarray] = []


def are_letters(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x10000)), bool, 0x10000))
    out = _letters[0][np.minimum(points, 0xFFFF)]
    for p in np.unique(points[points > 0xFFFF]):
        out[points == p] = chr(p).isalpha()
    return out


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The texts' symbols, each followed by ``PAD``, without runs of spaces and spaces at the ends; and where each text starts."""
    lower = [(t or "").lower() for t in texts]
    points = np.frombuffer("\0".join([*lower, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.where(are_letters(points), points, SPACE).astype(np.int32)
    out[np.cumsum([len(t) + 1 for t in lower], dtype=np.int64) - 1] = PAD
    gap = out == SPACE
    before = np.concatenate(([PAD], out[:-1]))
    out = out[~(gap & ((before == SPACE) | (before == PAD)))]
    out = out[~((out == SPACE) & (np.concatenate((out[1:], [PAD])) == PAD))]
    ends = np.flatnonzero(out == PAD)
    return out, np.concatenate(([0], ends[:-1] + 1)) if len(ends) else np.empty(0, np.int64)


def moves(sample: list[int]) -> list[dict[int, int]]:
    """The suffix automaton of a sequence: where each symbol leads from each state; 0 is the root."""
    out: list[dict[int, int]] = [{}]
    link, longest, last = [-1], [0], 0
    for c in sample:
        state = len(out)
        out.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in out[p]:
            out[p][c] = state
            p = link[p]
        if p >= 0:
            q = out[p][c]
            if longest[q] == longest[p] + 1:
                link[state] = q
            else:
                clone = len(out)
                out.append(dict(out[q]))
                longest.append(longest[p] + 1)
                link.append(link[q])
                while p >= 0 and out[p].get(c) == q:
                    out[p][c] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
    return out


class CrossParser:
    """The automata of some samples; states are numbered through, and moves are a hash table with open addresses."""

    def __init__(self, texts: list[str]):
        keys, values, roots, bits, base = [], [], [], [], 0
        for text in texts:
            own = symbols([text])[0][:-1].tolist()
            automaton = moves(own)
            roots.append(base)
            bits.append(float(np.log2(max(2, len(own)))))
            keys += [(base + s) << SYMBOL_BITS | c for s, m in enumerate(automaton) for c in m]
            values += [base + t for m in automaton for t in m.values()]
            base += len(automaton)
        self.roots, self.bits = np.array(roots, np.int32), np.array(bits)
        size = max(4, (2 * len(keys)).bit_length())
        self.shift = np.uint64(64 - size)
        self.keys, self.values = np.full(1 << size, _EMPTY), np.zeros(1 << size, np.int32)
        key, value = np.array(keys, np.uint64), np.array(values, np.int32)
        at = (key * _ODD >> self.shift).astype(np.int64)
        left = np.arange(len(key))
        while len(left):
            free = left[self.keys[at[left]] == _EMPTY]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = key[put], value[put]
            left = np.setdiff1d(left, put, assume_unique=True)
            at[left] = at[left] + 1 & len(self.keys) - 1

    def move(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """Where each symbol leads from each state, or -1."""
        key = (state.astype(np.int64) << SYMBOL_BITS | symbol).view(np.uint64)
        at = (key * _ODD >> self.shift).view(np.int64)
        found = self.keys[at]
        out = np.where(found == key, self.values[at], -1)
        more = np.flatnonzero((found != key) & (found != _EMPTY))
        while len(more):
            at[more] = at[more] + 1 & len(self.keys) - 1
            found = self.keys[at[more]]
            hit = found == key[more]
            out[more[hit]] = self.values[at[more[hit]]]
            more = more[~hit & (found != _EMPTY)]
        return out

    def walk(self, flat: np.ndarray, pos: np.ndarray, stop: np.ndarray, root: np.ndarray, base: np.ndarray, marks: np.ndarray, until: bool) -> tuple[np.ndarray, np.ndarray]:
        """Parse from ``pos`` until a phrase begins at ``stop`` or later, or, with ``until``, where one is marked.

        Gives where that is, and the marks (base + place) of all phrases that begin before; without ``until`` they are set as well.
        """
        ends, new = pos.copy(), [np.empty(0, np.int64)]
        lane, state, pos = np.arange(len(pos)), root.copy(), pos.copy()
        while len(lane):
            for _ in range(16):
                start = state == root
                place = base + pos
                over = start & (pos >= stop)
                if until:
                    over |= start & marks[place]
                begun = place[start & ~over]
                if until:
                    new.append(begun)
                else:
                    marks[begun] = True
                to = self.move(state, flat[pos])
                ok = (to >= 0) & ~over
                state = np.where(ok, to, root)
                pos += ok | start & ~over
            start = state == root
            over = start & (pos >= stop)
            if until:
                over |= start & marks[base + pos]
            ends[lane[over]] = pos[over]
            keep = ~over
            lane, state, pos, stop, root, base = (x[keep] for x in (lane, state, pos, stop, root, base))
        return ends, np.concatenate(new)

    def phrases(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """How many longest matches of each automaton (columns) each text (rows) is made of."""
        sizes = np.diff(np.concatenate((starts, [len(flat)]))) - 1
        many, langs = -(-sizes // SEGMENT), len(self.roots)
        if not langs or not many.sum():
            return np.zeros((len(starts), langs), np.int64)
        first = np.cumsum(many) - many
        number = np.arange(many.sum()) - np.repeat(first, many)
        begin = np.repeat(starts, many) + number * SEGMENT
        stop = np.minimum(begin + SEGMENT, np.repeat(starts + sizes, many))
        begin, stop, later = (np.tile(x, langs) for x in (begin, stop, number > 0))
        root, base = np.repeat(self.roots, len(number)), np.repeat(np.arange(langs) * len(flat), len(number))
        marks = np.zeros(langs * len(flat), bool)
        ends, _ = self.walk(flat, begin, stop, root, base, marks, False)
        while True:
            entry = np.where(later, np.roll(ends, 1), begin)
            todo = np.flatnonzero(entry != begin)
            if not len(todo):
                break
            met, new = self.walk(flat, entry[todo], stop[todo], root[todo], base[todo], marks, True)
            for k, to in zip(todo.tolist(), met.tolist(), strict=True):
                marks[base[k] + begin[k] : base[k] + min(to, stop[k])] = False
            marks[new] = True
            behind = met >= stop[todo]
            ends[todo[behind]] = met[behind]
            begin[todo] = entry[todo]
        counts = [np.add.reduceat(marks[k * len(flat) : (k + 1) * len(flat)].view(np.uint8), starts, dtype=np.int64) for k in range(langs)]
        return np.stack(counts, axis=1)


class Identifier:
    """``rejects``: with what ``known`` needs."""

    def __init__(self, samples: tuple[Sample, ...], rejects: bool = True):
        self.labels = [s.label for s in samples]
        self.parser = CrossParser([s.text for s in samples])
        self.letters = [{c for c in s.text.lower() if c.isalpha()} for s in samples]
        if not rejects or not samples:
            return
        self.every = CrossParser(["\n".join(s.text for s in samples)])
        self.least = min((x for s in samples if (x := self.limit(s.checks))), default=1.5)

    def limit(self, texts: tuple[str, ...]) -> float | None:
        """Mean symbols in a phrase that separates texts from their letters at random."""
        real = [t for t in texts if len(t) >= ENOUGH]
        if not real:
            return None
        r = np.random.default_rng(7)
        mixed = ["".join(np.array(list(t))[r.permutation(len(t))]) for t in real]
        a, b = (float(np.median(self.matches(*symbols(x)))) for x in (mixed, real))
        return a + MARGIN * (b - a)

    def matches(self, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Mean symbols in a phrase of each text for all samples together."""
        sizes = np.diff(np.concatenate((starts, [len(flat)]))) - 1
        return sizes / np.maximum(self.every.phrases(flat, starts)[:, 0], 1)

    def costs(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text (rows) for each language, and the texts' lengths in symbols."""
        if not texts:
            return np.zeros((0, len(self.labels)), np.int64), np.zeros(0, np.int64)
        flat, starts = symbols(texts)
        return self.parser.phrases(flat, starts), np.diff(np.concatenate((starts, [len(flat)]))) - 1

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Labels and scores."""
        phrases, sizes = self.costs(texts)
        if not self.labels or not texts:
            return [UNDETERMINED] * len(texts), [0.0] * len(texts)
        bits = phrases * self.parser.bits / np.maximum(sizes, 1)[:, None]
        odds = np.exp(-SHARPNESS * (bits - bits.min(axis=1, keepdims=True)))
        return [self.labels[b] if n else UNDETERMINED for b, n in zip(bits.argmin(axis=1), sizes, strict=True)], np.where(sizes > 0, 1 / odds.sum(axis=1), 0.0).tolist()

    def known(self, texts: list[str | None]) -> list[bool]:
        """Whether each text is in a known language; which one is left to ``predict``."""
        if not self.labels or not texts:
            return [False] * len(texts)
        plain = ["" if t is None else t for t in texts]
        flat, starts = symbols(plain)
        sizes = np.diff(np.concatenate((starts, [len(flat)]))) - 1
        out = (sizes > 0) & (self.matches(flat, starts) >= self.least)
        for k in np.flatnonzero((sizes > 0) & (sizes < ENOUGH)).tolist():
            letters = [c for c in plain[k].lower() if c.isalpha()]
            out[k] = any(2 * sum(c in known for c in letters) >= len(letters) for known in self.letters)
        return out.tolist()


def identify(docs: DataFrame, samples: tuple[Sample, ...]) -> DataFrame:
    """``doc_id``, ``lang_pred`` and ``score`` of each row."""
    ship(docs.sparkSession)
    tool = Identifier(samples, rejects=False)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", STEP):
                label, score = tool.predict(batch.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(label, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def in_known_language(docs: DataFrame, samples: tuple[Sample, ...]) -> DataFrame:
    """The rows whose text is in one of the learned languages; a null ``lang`` becomes the one found."""
    ship(docs.sparkSession)
    tool = Identifier(samples)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "text", STEP):
                batch = batch.filter(pa.array(tool.known(batch.column("text").to_pylist()), pa.bool_()))
                # only texts without a label are parsed for each language; the decision above doesn't need it
                if (at := batch.schema.get_field_index("lang")) >= 0 and batch.column(at).null_count:
                    given, texts = batch.column(at).to_pylist(), batch.column("text")
                    missing = [k for k, g in enumerate(given) if g is None]
                    for k, found in zip(missing, tool.predict(texts.take(pa.array(missing)).to_pylist())[0], strict=True):
                        given[k] = found
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(given, batch.schema.field(at).type))
                yield batch

    return docs.mapInArrow(run, docs.schema)
