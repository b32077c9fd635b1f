import hashlib
import random
import re
from pathlib import Path

import numpy as np
import pytest

from tessera.llm import pii
from tests.llm.helpers import documents, empty

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for k, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    counts, spans = [], []
    for kind, pattern in PATTERNS.items():
        n = 0
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            n += 1
            spans.append(f"{kind}:{m.start()}:{m.end()}")
        counts.append(n)
    return counts, ",".join(spans)


def texts():
    r = random.Random(5)
    bits = ["a@b.c", "a@b.c.d_e@f.g", "1.2.3.4", "300.1.1.1.5.6", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111111", "+1 (385) 555-1563", "+49 30", "é😀", "0255.1.1.1", ".1.2.3.4", "the of"]
    out = ["".join(r.choice("ab1 2.3-4+5@(6)7 89é😀\n0,") for _ in range(r.randint(0, 120))) for _ in range(400)]
    return out + [" ".join(r.choice(bits) for _ in range(r.randint(0, 12))) for _ in range(300)]


@pytest.mark.parametrize("extra", [False, True])
def test_base_spans(spark, extra):
    known = [None, "", *texts()]
    got = pii.find(documents(spark, known, extra)).collect()
    assert len(got) == len(known) + 1
    for r in got:
        counts, spans = brute(known[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        assert r.spans == spans or r.spans.startswith(spans + "," if spans else "")
    assert pii.find(empty(spark)).count() == 0


def test_long_texts_take_linear_time(spark):
    long = ["a" * 300_000, "1" * 300_000, "1." * 100_000, "a@" + "b." * 100_000, "+1" * 50_000, "+" + "1(" * 50_000, "1 " * 100_000, "a@b.c " * 20_000]
    got = {r.doc_id: r for r in pii.find(documents(spark, long)).collect()}
    assert got[2].n_ip == 25_000 and got[7].n_email == 20_000 and got[0].n_email == 0


def test_texts_with_very_many_spans_take_linear_time(spark):
    import time

    pair = lambda n: " ".join(f"jo{k}@mail.example.org or 555-01{k % 90 + 10}-{k % 9000 + 1000}, 10.0.{k % 200}.{k % 250}@x.y" for k in range(n))
    took = []
    for n in (500, 8000):
        docs = documents(spark, [pair(n)])
        began = time.time()
        found = {r.doc_id: r for r in pii.find(docs).collect()}
        clean = {r.doc_id: r.text for r in pii.redact(docs).collect()}
        took.append(time.time() - began)
        assert found[0].n_email == 2 * n and found[0].n_ip == n and clean[0].count("[EMAIL]") + clean[0].count("[IP]") >= 2 * n and "@" not in clean[0]
    assert took[1] < 16 * took[0] + 10


def test_proposed_spans_keep_off_base_spans(spark):
    some = ["mail to 555-123-4567@example.com or call 555-123-4567", "token = a1b2c3d4e5f6a7b8c9d0@example.com", "+1 (385) 555-1563-555-123-4567 phone 555-987-6543"]
    for r in pii.find(documents(spark, some)).collect():
        spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x)]
        base = [x for x in spans if x[0] in pii.BASE]
        assert r.n_spans == len(spans) and r.n_proposed == len(spans) - len(base)
        assert not [1 for k, a, b in spans if k in pii.PROPOSED for _, c, d in base if a < d and c < b]
        assert all(0 <= a < b <= len(some[r.doc_id]) for _, a, b in spans)


def test_trees_as_expressions_are_the_trees(spark):
    from pyspark.sql import functions as F

    model = pii.fit(spark)
    r = np.random.default_rng(5)
    x = r.integers(0, 45, (300, len(pii.FEATURES)))
    x[:, 5:] %= 3
    rows = spark.createDataFrame([(k, [int(v) for v in row]) for k, row in enumerate(x)], "k long, f array<int>")
    got = [row.s for row in rows.select("k", model.score(F.col("f")).alias("s")).orderBy("k").collect()]
    assert np.allclose(got, pii.predicted(model.start, model.trees, x.astype(float)))


def labelled():
    """Hand-written texts; personal data stand between « and », with nothing else marked."""
    with open(Path(__file__).parent / "labelled_pii.txt", encoding="utf-8") as f:
        return [x.rstrip("\n") for x in f if x.strip()]


def test_hand_labelled_texts(spark):
    """Precision and recall of proposed spans, and of all spans, on texts that the training rows don't hold."""
    marked = labelled()
    plain = [re.sub("[«»]", "", t) for t in marked]
    truth = set()
    for k, t in enumerate(marked):
        at = 0
        for part in re.split("(«[^»]*»)", t):
            n = len(part) - 2 * part.startswith("«")
            if part.startswith("«"):
                truth.add((k, at, at + n))
            at += n
    found, proposed = set(), set()
    for r in pii.find(documents(spark, plain)).dropDuplicates(["doc_id"]).collect():
        for x in filter(None, r.spans.split(",")):
            kind, a, b = x.split(":")
            found.add((r.doc_id, int(a), int(b)))
            if kind in pii.PROPOSED:
                proposed.add((r.doc_id, int(a), int(b)))
    hit = lambda x, those: any(k == x[0] and a < x[2] and x[1] < b for k, a, b in those)
    precision = sum(hit(x, truth) for x in proposed) / len(proposed)
    recall = sum(hit(x, found) for x in truth) / len(truth)
    print(f"texts {len(marked)}, spans {len(truth)}, proposed {len(proposed)}, precision {precision:.2f}, recall {recall:.2f}; false {[plain[k][a:b] for k, a, b in proposed if not hit((k, a, b), truth)]}; missed {[plain[k][a:b] for k, a, b in truth if not hit((k, a, b), found)]}")
    assert precision >= 0.85 and recall >= 0.8


def test_proposed_spans(spark):
    some = ["call me at 555-123-4567 today", 'token = "0a1b2c3d4e5f60718293a4b5c6d7e8f901234567" and', "write to jane (at) mail (dot) com now", "IBAN DE89 3704 0044 0532 0130 00 please"]
    clean = ["version 12.10.2019 of it", "the tionhation was the erthing and of reble", "on 24.12.1999 there", "order 1234 was fine", "of thanedble whereverthisthatgoes on"]
    got = {r.doc_id: r.spans for r in pii.find(documents(spark, some + clean)).collect()}
    assert all(got[k] for k in range(len(some))) and not any(got[k] for k in range(len(some), len(some) + len(clean)))


def test_no_python_in_the_plan(spark):
    plan = pii.find(documents(spark, ["x"]))._jdf.queryExecution().executedPlan().toString() + pii.redact(documents(spark, ["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan.replace("PythonRDD", "") and "Arrow" not in plan


@pytest.mark.parametrize("extra", [False, True])
def test_redaction(spark, extra):
    known = ["é mail a@b.c and +1 (385) 555-1563.", "nothing here", None, "", "4111 1111 1111 1111", "1.2.3.4 5.6.7.8", "😀 1.2.3.4@mail.org ü 9.8.7.6 -\x01ABC"]
    docs = documents(spark, known, extra)
    out = pii.redact(docs)
    assert out.schema.names == docs.schema.names
    assert {r.doc_id: r.text for r in out.collect()} == {0: "é mail [EMAIL] and [PHONE].", 1: "nothing here", 2: None, 3: "", 4: "[CARD]", 5: "[IP] [IP]", 6: "😀 [EMAIL] ü [IP] -\x01ABC"}
