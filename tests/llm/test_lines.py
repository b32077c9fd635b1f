import random
from collections import Counter, defaultdict

import pytest

from tessera.llm import lines as L
from tests.llm.helpers import documents, empty, hard_texts, words

SCHEMA = "doc_id long, text string"


def filled(text):
    return [x for x in (text or "").split("\n") if x.strip()]


def runs(before, after):
    """Runs of consecutive lines that went; what stays is in the same order."""
    out, k, run = [], 0, []
    for x in before:
        if k < len(after) and x == after[k]:
            k += 1
            if run:
                out.append(run)
            run = []
        else:
            run.append(x)
    assert k == len(after)
    return [*out, run] if run else out


def check(rows, got):
    """What holds whatever the chunks are: whole lines go, in passages; each one is there earlier, and stays somewhere."""
    stays, seen = Counter(), defaultdict(int)
    for k, t in rows:
        stays.update(filled(got[k]))
        gone = Counter(filled(t)) - Counter(filled(got[k]))
        for run in runs(filled(t), filled(got[k])):
            assert len(run) > 1 or len(run[0].split()) >= 25
        for x in filled(t):
            seen[x] += 1
        for x, n in gone.items():
            assert seen[x] > n
    assert set(stays) == set(seen)


def longest_shared(a, b):
    """Runs of lines that two texts share and that can't be made longer, by comparing all places."""
    for i in range(len(a)):
        for j in range(len(b)):
            if a[i] == b[j] and (i == 0 or j == 0 or a[i - 1] != b[j - 1]):
                n = 1
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n]:
                    n += 1
                yield a[i : i + n]


def test_boundaries_resist_shifts():
    r = random.Random(2)
    ls = [words(r.randint(1, 12), r.random()).encode() for _ in range(300)]
    chosen = {ls[k] for k in L.boundaries(ls)}
    again = [b"new", b"lines", *ls[:100], b"one more", *ls[100:]]
    assert len(chosen ^ {again[k] for k in L.boundaries(again)} - {b"new", b"lines", b"one more"}) <= 6
    places = L.boundaries(ls)
    assert all(1 <= b - a <= L.PICK for a, b in zip(places, places[1:]))
    assert all(z - a >= 2 or L.is_long(ls[a]) for a, z in L.chunks(ls))


def passages(r, n, least, most, low, high):
    """Texts in pairs that share a passage of over 50 words between different lines, and the passages."""
    texts, shared = [], []
    while len(shared) < n:
        ls = [words(r.randint(low, high), r.random()) for _ in range(r.randint(least, most))]
        if sum(len(x.split()) for x in ls) > 50:
            shared.append(ls)
            for _ in range(2):
                around = [[words(r.randint(low, high), r.random()) for _ in range(r.randint(0, 4))] for _ in range(2)]
                texts.append("\n".join([*around[0], *ls, *around[1]]))
    return texts, shared


def test_every_passage_of_over_50_words_goes(spark):
    r = random.Random(11)
    texts, shared = [], []
    for shape in ((1, 2, 20, 70), (3, 8, 6, 24), (2, 5, 3, 60), (5, 12, 2, 12), (15, 40, 1, 4), (6, 9, 8, 9)):
        t, s = passages(r, 120, *shape)
        texts, shared = texts + t, shared + s
    got = {x.doc_id: x.text for x in L.dedup_lines(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    for k, ls in enumerate(shared):
        before, after = texts[2 * k + 1].split("\n"), filled(got[2 * k + 1])
        assert got[2 * k] == texts[2 * k]
        # a line next to the passage may be a copy by chance where lines have a word or two
        assert not [x for x in after if x in ls and len(x.split()) > 2]
        assert [x for x in before if x not in ls and len(x.split()) > 2] == [x for x in after if x not in ls and len(x.split()) > 2]


def test_against_all_pairs(spark):
    """Texts of lines from a small pool, so that runs overlap in all ways."""
    r = random.Random(5)
    pool = [words(r.choice([1, 3, 6, 9, 14, 30]), k) for k in range(60)]
    rows = []
    for k in range(120):
        ls = [r.choice(pool) if r.random() < 0.5 else words(r.randint(1, 30), r.random()) for _ in range(r.randint(0, 12))]
        if rows and r.random() < 0.5:
            other = filled(rows[r.randrange(len(rows))][1])
            ls[2:2] = other[r.randint(0, 3) :][: r.randint(0, 8)]
        rows.append((k, "\n".join(ls)))
    got = {x.doc_id: x.text for x in L.dedup_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    check(rows, got)
    missed = 0
    for i, (_, a) in enumerate(rows):
        for k, b in rows[i + 1 :]:
            for run in longest_shared(filled(a), filled(b)):
                if len(run) > 1 and sum(len(x.split()) for x in run) > 50:
                    left = Counter(filled(got[k]))
                    missed += all(left[x] >= filled(b).count(x) for x in run)
    assert missed == 0


@pytest.mark.parametrize("ids", [[None] * 6, [7] * 6, [None, 7, 7, None, 3, 7]])
def test_null_and_shared_ids(spark, ids):
    passage = "\n".join(words(20, k) for k in range(4))
    docs = spark.createDataFrame([(i, f"{words(9, 100 + k)}\n{passage}\n{words(9, 200 + k)}") for k, i in enumerate(ids)], SCHEMA)
    got = L.dedup_lines(docs).collect()
    assert len(got) == 6 and sum(passage in x.text for x in got) == 1
    assert [x.doc_id for x in got if passage in x.text][0] == min((i for i in ids if i is not None), default=None)
    assert Counter(x.doc_id for x in got) == Counter(ids) and all(len(filled(x.text)) == 2 for x in got if passage not in x.text)


@pytest.mark.parametrize("extra", [False, True])
def test_hard_cases(spark, extra):
    texts = [*hard_texts(), "All rights reserved.", "All rights reserved.", words(3000, 7), words(3000, 7), "\n".join([words(6, 3)] * 50), words(60, 8) + "\n\n" + words(5, 9), words(60, 8) + "\n" + words(5, 9)]
    docs = documents(spark, texts, extra)
    out = L.dedup_lines(docs)
    assert out.schema == docs.schema
    rows = out.collect()
    assert len(rows) == len(texts) + 1
    got = {x.doc_id: x.text for x in rows}
    assert got[0] is None and got[1] == "" and got[3] == "\n\n"
    check([(k, t) for k, t in enumerate(texts)], got)
    n = len(hard_texts())
    assert got[n] == got[n + 1] == "All rights reserved." and got[n + 2] == texts[n + 2] and got[n + 3] == ""
    assert filled(got[n + 4]) == [words(6, 3)]  # a document that repeats its own line
    assert got[n + 5] == texts[n + 5] and got[n + 6] == ""  # blank lines make no difference
    assert L.dedup_lines(empty(spark)).count() == 0
    assert L.dedup_lines(docs.select("text", "doc_id")).columns == ["text", "doc_id"]


def test_a_row_that_is_given_twice(spark):
    text = "\n".join(words(20, k) for k in range(4))
    docs = spark.createDataFrame([(1, text), (1, text), (2, text)], SCHEMA)
    assert sorted((x.doc_id, x.text) for x in L.dedup_lines(docs).collect()) == [(1, text), (1, text), (2, "")]


def test_bytes_are_compared(spark):
    """With digests of one byte nearly all chunks share one with others; none goes that isn't really a copy."""
    r = random.Random(9)
    texts, _ = passages(r, 60, 1, 6, 9, 40)
    rows = list(enumerate(texts))
    got = {x.doc_id: x.text for x in L.dedup_lines(spark.createDataFrame(rows, SCHEMA), digest_bytes=1).collect()}
    check(rows, got)


def test_headings_with_blank_lines_stay(spark):
    texts = [f"{words(20, k)}\n\n{words(9, 1)}\n\n{words(20, 50 + k)}" for k in range(3)]
    got = L.dedup_lines(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert {x.text for x in got} == set(texts)
