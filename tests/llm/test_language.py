import random
import zlib

import pytest
from pyspark.sql import functions as F

from tessera.llm import language as L
from tests.llm.helpers import documents, empty, hard_texts

SOUNDS = {"aa": "ba be bo tra stu", "bb": "ñi ló rra quez ión", "cc": "sch ung keit ü ver"}


def text(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice(SOUNDS[lang].split()) for _ in range(r.randint(1, 4))) for _ in range(n))


def table(spark, n=90):
    return spark.createDataFrame([(k, text(lang, 10 + k % 60, k), lang) for k in range(n) for lang in [sorted(SOUNDS)[k % 3]]], "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    docs = table(spark)
    got = L.identify(docs.filter(L.held_out()), L.learn(docs.filter(~L.held_out()))).collect()
    truth = {k: sorted(SOUNDS)[k % 3] for k in range(90)}
    assert len(got) > 20 and all(r.lang_pred == truth[r.doc_id] and 0 <= r.score <= 1 for r in got)


def test_fold(spark):
    got = spark.range(100).select(F.col("id").alias("doc_id")).withColumn("h", L.held_out()).collect()
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def brute(text, sample):
    """Greedy longest matches by substring search, from end to end."""
    plain = lambda t: " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split())
    text, sample, count, i = plain(text), plain(sample), 0, 0
    while i < len(text):
        j = i + 1
        while j <= len(text) and text[i:j] in sample:
            j += 1
        i, count = max(i + 1, j - 1), count + 1
    return count


def samples_of(n=200):
    return tuple(L.Sample(k, text(k, n, 9)) for k in sorted(SOUNDS))


@pytest.mark.parametrize("segment", [3, 64, L.SEGMENT])
def test_phrases_are_longest_matches(monkeypatch, segment):
    """Also where segments are shorter than phrases, and for texts that the samples hold whole."""
    monkeypatch.setattr(L, "SEGMENT", segment)
    samples = samples_of()
    tool = L.Identifier(samples)
    texts = [text(k, n, n) for k in SOUNDS for n in (1, 7, 300)] + [t or "" for t in hard_texts()] + [samples[0].text, samples[1].text[50:700] * 3, "ba" * 3000]
    phrases, sizes = tool.costs(texts)
    for i, t in enumerate(texts):
        assert phrases[i].tolist() == [brute(t, s.text) for s in samples]
    assert sizes[-1] == 6000 and tool.costs([])[0].shape == (0, 3)


@pytest.mark.parametrize("extra", [False, True])
def test_hard_cases(spark, extra):
    docs = documents(spark, extra=extra)
    samples = L.learn(table(spark))
    got = L.identify(docs, samples).collect()
    assert len(got) == len(hard_texts()) + 1
    for r in got:
        t = hard_texts()[r.doc_id]
        assert (r.lang_pred == "und") == (t is None or not any(c.isalpha() for c in t)) and 0 <= r.score <= 1
    kept = L.in_known_language(docs, samples)
    assert kept.schema.names == docs.schema.names and all(r.text for r in kept.collect())
    assert L.identify(empty(spark), samples).count() == 0
    assert {r.lang_pred for r in L.identify(docs, L.learn(empty(spark))).collect()} == {"und"}


def test_clean_documents_pass(spark):
    docs = table(spark)
    assert L.in_known_language(docs, L.learn(docs)).count() == docs.count()


def test_the_sample_is_bounded_and_whole(spark):
    """Whole texts, as many as the bound says whatever the copies; a language of long texts only is learned from its shortest."""
    rows = [(k, "copied text", "one") for k in range(3000)] + [(k, f"word {'x' * (k % 7)} {k} end", "one") for k in range(500)]
    rows += [(k, "long " * (400 + k), "two") for k in range(5)] + [(9, "..", "three"), (10, "text", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    one, two = L.learn(docs)
    assert (one.label, two.label) == ("one", "two") and two.text == "long " * 400 and not two.checks
    parts = one.text.split("\n")
    assert len(parts) == len(set(parts)) == L.SAMPLE_TEXTS and len(one.checks) == L.CHECK_TEXTS
    assert all(p == "copied text" or p.endswith(" end") for p in [*parts, *one.checks])
    assert L.learn(docs.withColumn("doc_id", F.col("doc_id") * 7)) == (one, two)  # ids don't count


def test_null_ids(spark):
    docs = spark.createDataFrame([(None, text("aa", 30, 1), None), (None, None, None), (1, text("bb", 30, 2), "zz")], "doc_id long, text string, lang string")
    samples = L.learn(table(spark))
    assert {(r.doc_id, r.lang_pred) for r in L.identify(docs, samples).collect()} == {(None, "aa"), (None, "und"), (1, "bb")}
    assert [r.h for r in docs.select(L.held_out().alias("h")).collect()] == [zlib.crc32(b"") % 3 == 1] * 2 + [zlib.crc32(b"1") % 3 == 1]
    assert {(r.doc_id, r.lang) for r in L.in_known_language(docs, samples).collect()} == {(None, "aa"), (1, "zz")}


def test_texts_in_no_language_go(spark):
    """Letters at random, the letters of a language shuffled, and another script, beside clean and mixed texts."""
    samples = L.learn(table(spark))
    r = random.Random(3)
    clean = [text(k, 60, 700 + j) for j, k in enumerate(sorted(SOUNDS) * 5)] + [text("aa", 40, 1) + " " + text("bb", 20, 2)]
    noise = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(400)) for _ in range(5)] + ["".join(r.sample(list(t), len(t))) for t in clean[:6]] + [script(0x4E00, 80, 1)]
    docs = spark.createDataFrame(list(enumerate(clean + noise)), "doc_id long, text string")
    assert [x.doc_id for x in L.in_known_language(docs, samples).orderBy("doc_id").collect()] == list(range(len(clean)))


def script(start, n, seed, letters=600):
    """Words over many letters from ``start``."""
    r = random.Random(seed)
    return " ".join("".join(chr(start + r.randrange(letters)) for _ in range(r.randint(1, 4))) for _ in range(n))


def test_languages_of_many_letters(spark):
    starts = {"aa": None, "ja": 0x4E00, "ko": 0xAC00, "zh": 0x6000}
    make = lambda k, n, seed: text(k, n, seed) if starts[k] is None else script(starts[k], n, seed)
    rows = [(k, make(sorted(starts)[k % 4], 40, k), sorted(starts)[k % 4]) for k in range(240)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = L.learn(docs)
    tool = L.Identifier(samples)
    fresh = [(k, make(sorted(starts)[k % 4], 30, 9000 + k)) for k in range(40)]
    label, _ = tool.predict([t for _, t in fresh])
    assert label == [sorted(starts)[k % 4] for k in range(40)]
    t = fresh[1][1] + " Ж " + fresh[0][1]
    assert tool.costs([t])[0].tolist() == [[brute(t, s.text) for s in samples]]
    # texts of one script with 800 letters each are told apart
    same = spark.createDataFrame([(k, script([0x4E00, 0x5200, 0x5600][k % 3], 60, k, 800), "abc"[k % 3]) for k in range(240)], docs.schema)
    tool = L.Identifier(L.learn(same))
    assert tool.predict([script([0x4E00, 0x5200, 0x5600][k % 3], 60, 5000 + k, 800) for k in range(60)])[0] == ["abc"[k % 3] for k in range(60)]
    other = spark.createDataFrame([(1, script(0xA000, 90, 1), "x"), (2, fresh[1][1], "x"), (3, "жзи " * 60, "x")], docs.schema)
    assert [r.doc_id for r in L.in_known_language(other, samples).collect()] == [2]


def test_short_documents_pass(spark):
    samples = L.learn(table(spark))
    short = ["b", "B.", "ñ", "ü!", "o", "ver", "quez", "rl\u00f3z", "bñ"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate([*short, "Ж", "жзи", "漢字", "1", None])], "doc_id long, text string")
    assert {r.text for r in L.in_known_language(docs, samples).collect()} == set(short)


def test_labels_are_looked_for_only_where_missing(spark):
    """Judging texts needs no parse for each language; labels go to the right rows between given ones and rows that go."""
    tool = L.Identifier(samples_of())
    tool.parser = None
    assert tool.known([text("aa", 60, 1), "жзи " * 60, None, "12", "b", "Ж", text("cc", 60, 2)]) == [True, False, False, False, True, False, True]
    langs = sorted(SOUNDS)
    rows = [(k, "жзи " * 60 if k % 5 == 0 else text(langs[k % 3], 40, 50 + k), None if k % 2 else "given") for k in range(40)]
    got = L.in_known_language(spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1), samples_of()).collect()
    assert {r.doc_id: (r.text, r.lang) for r in got} == {k: (t, g or langs[k % 3]) for k, t, g in rows if k % 5}
