import random
import re
from collections import defaultdict

import numpy as np
import pytest

from tessera.llm import components as components_module
from tessera.llm import near_duplicates as N
from tessera.llm.components import components
from tests.llm.helpers import documents, empty, hard_texts, words


def shingle_set(text):
    w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(texts):
    sets = {k: shingle_set(t) for k, t in texts.items()}
    root = {k: k for k in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [k for k in sorted(texts) if sets[k]]
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {k: (len(sets[k]), find(k)) for k in texts}


def edited(base, n, r):
    w = base.split()
    for _ in range(n):
        w[r.randrange(len(w))] = words(1, r.randrange(10**6))
    return " ".join(w)


@pytest.mark.parametrize("extra", [False, True])
def test_components_are_exact(spark, extra):
    r = random.Random(4)
    texts = [*hard_texts(), "Hi there", "hi \n THERE", "a b c d e f", "A B C D E F"]
    for g in range(6):
        base = words(120, 50 + g)
        texts += [edited(base, r.randint(0, 4), r) for _ in range(14)]
    docs = documents(spark, texts, extra)
    got = N.near_duplicates(docs).collect()
    want = brute(dict(enumerate(texts)))
    assert len(got) == len(texts) + 1
    for x in got:
        assert (x.n_shingles, x.component_id, x.kept) == (*want[x.doc_id], want[x.doc_id][1] == x.doc_id)
    kept = N.kept_documents(docs)
    assert kept.schema.names == docs.schema.names and {x.doc_id for x in kept.collect()} == {k for k, (_, c) in want.items() if c == k}


def test_blocks_find_what_stars_miss(spark, monkeypatch):
    """A chain of edits: its ends are unlike the first one, and blocks are smaller than the buckets."""
    monkeypatch.setattr(N, "BLOCK", 4)
    r = random.Random(8)
    texts, now = [], words(100, 77)
    for _ in range(40):
        texts.append(now)
        now = edited(now, 2, r)
    got = N.near_duplicates(documents(spark, texts)).collect()
    want = brute(dict(enumerate(texts)))
    assert all((x.n_shingles, x.component_id) == want[x.doc_id] for x in got)


def test_rows_that_share_an_id(spark):
    """Rows are documents of their own: an id links nothing, and one row of each group stays."""
    a, b = words(60, 1), words(60, 2)
    rows = [(7, a), (7, b), (9, a + " more"), (None, b + " x"), (None, words(40, 5)), (None, words(40, 6)), (4, ""), (4, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1, r.kept) for r in N.near_duplicates(docs).collect())
    assert got == sorted([(7, 56, 7, True), (7, 56, 7, True), (9, 57, 7, False), (-1, 57, 7, False), (-1, 36, -1, False), (-1, 36, -1, False), (4, 0, 4, True), (4, 0, 4, True), (-1, 0, -1, False)])
    kept = sorted((r.doc_id or -1, r.text or "") for r in N.kept_documents(docs).collect())
    assert kept == sorted([(7, a), (7, b), (-1, words(40, 5)), (-1, words(40, 6)), (4, ""), (4, ""), (-1, "")])


def test_repeated_rows_cost_no_pairs(spark):
    """Two near-alike documents, each given very often."""
    import time

    a = words(100, 3)
    took = []
    for n in (40, 2000):
        docs = spark.createDataFrame([(k % 2, a + " more" * (k % 2)) for k in range(n)], "doc_id long, text string")
        began = time.time()
        got = N.near_duplicates(docs).collect()
        took.append(time.time() - began)
        assert len(got) == n and {(r.doc_id, r.component_id) for r in got} == {(0, 0), (1, 0)}
        assert len(N.kept_documents(docs).collect()) == 1 if n == 40 else True
    assert took[1] < 3 * took[0] + 5


def test_a_large_component_and_many_others_in_a_bucket(spark, monkeypatch):
    """Near copies of one text beside texts that are just below the limit with it, in small blocks."""
    monkeypatch.setattr(N, "BLOCK", 8)
    r = random.Random(12)
    base = words(150, 3)
    texts = [edited(base, r.randint(0, 2), r) for _ in range(60)] + [edited(base, r.randint(4, 9), r) for _ in range(40)]
    got = N.near_duplicates(documents(spark, texts)).collect()
    want = brute(dict(enumerate(texts)))
    assert all((x.n_shingles, x.component_id) == want[x.doc_id] for x in got)


def test_empty_table_and_null_ids(spark):
    assert N.near_duplicates(empty(spark)).count() == 0
    docs = spark.createDataFrame([(None, "one two three four five six"), (3, "one two three four five six")], "doc_id long, text string")
    got = {r.doc_id: (r.component_id, r.kept) for r in N.near_duplicates(docs).collect()}
    assert got == {None: (3, False), 3: (3, True)}


def test_sketches_merge_and_estimate():
    r = np.random.default_rng(3)
    for share in (0.3, 0.75, 0.95):
        n = 800
        same = r.integers(0, 1 << 63, int(2 * n * share / (1 + share)), np.uint64)
        a, b = (np.unique(np.concatenate((same, r.integers(0, 1 << 63, n - len(same), np.uint64)))) for _ in range(2))
        ka, kb = (N.registers([x])[0] for x in (a, b))
        assert (N.registers([np.union1d(a, b)])[0] == np.maximum(ka, kb)).all()
        assert (N.registers([a, b]) == np.stack((ka, kb))).all()
        got = N.estimates(ka[None], np.array([len(a)]), kb[None], np.array([len(b)]))[0]
        assert abs(got - share) < 0.15


def test_connected_components(spark):
    r = random.Random(5)
    links = {tuple(sorted(r.sample(range(120), 2))) for _ in range(70)} | {(200, k) for k in range(201, 260)} | {(k, k + 1) for k in range(300, 340)}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    least = {}
    for start in sorted(near):
        todo = [start] if start not in least else []
        while todo:
            x = todo.pop()
            if x not in least:
                least[x] = start
                todo += near[x]
    got = {x.id: x.label for x in components(spark.createDataFrame(sorted(links), "a long, b long")).collect()}
    assert got == {k: v for k, v in least.items() if k != v}


def test_few_links_take_few_files(spark):
    """Whatever the number of shuffle partitions, rounds of components write no more files than their links need."""
    conf = {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        links = spark.createDataFrame([(k, k + 1) for k in range(200) if k % 10 != 9], "a long, b long")
        got = components(links)
        assert len(got.inputFiles()) == 1
        assert {(r.id, r.label) for r in got.collect()} == {(k, k // 10 * 10) for k in range(200) if k % 10}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("limit", [components_module.TASK_LINKS, -1])
def test_components_by_one_task_and_by_stars(spark, monkeypatch, limit):
    monkeypatch.setattr(components_module, "TASK_LINKS", limit)
    big = 1 << 40
    links = [(k, k + 1) for k in range(60) if k % 20 != 19] + [(70, 90), (80, 90), (75, 80)] + [(-5, 3), (big, big + 2), (big + 1, big + 2)] + [(100, k) for k in range(101, 130)]
    got = sorted((x.id, x.label) for x in components(spark.createDataFrame(links + links[:9], "a long, b long")).collect())
    want = [(k, k // 20 * 20 if k >= 20 else -5) for k in range(60) if k not in (20, 40)] + [(75, 70), (80, 70), (90, 70)]
    want += [(k, 100) for k in range(101, 130)] + [(big + 1, big), (big + 2, big)]
    assert got == sorted(want)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_few_links_take_few_jobs(spark):
    """Rounds of exchanges for a handful of links would each leave threads in the driver."""
    links = spark.createDataFrame([(k, k + 1) for k in range(200) if k % 50 != 49], "a long, b long")
    spark.sparkContext.setJobGroup("few", "components")
    try:
        assert components(links).count() == 196
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("few")) <= 8
    finally:
        spark.sparkContext._jsc.clearJobGroup()
