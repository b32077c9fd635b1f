"""The pipeline's stages against brute-force versions of what each has to do, on a small corpus."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from tessera.llm import common
from tests.llm.helpers import CLASHING, SCHEMA
from tests.llm.test_language import SOUNDS, text
from tests.llm.test_lines import check, filled
from tests.llm.test_near_duplicates import brute
from tests.llm.test_pii import brute as personal

tokenizers = pytest.importorskip("tokenizers")


def corpus(extra):
    r = random.Random(6)
    passage = "\n".join(text("aa", 12, 900 + k) for k in range(6))
    rows = []
    for k in range(45):
        lang = sorted(SOUNDS)[k % 3]
        body = "\n".join(text(lang, r.randint(8, 20), 50 * k + j) for j in range(4))
        rows.append((k, body + (f"\n{passage}" if k % 9 == 0 else ""), lang, "s", len(body)))
    near = lambda k, n: " ".join(w for i, w in enumerate(rows[k][1].replace("\n", " ").split()) if i != n)
    rows += [
        (100, near(4, 9), "bb", "s", 1), (101, None, None, "s", 0), (102, "12 34 !!", "aa", "s", 8), (103, rows[7][1] + "\nmail a@b.c or 10.1.2.3", "bb", "s", 1),
        (104, "".join(r.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(600)), None, "s", 600), (105, rows[5][1], "cc", "s", 1),
        (None, text("aa", 30, 4000), None, "s", 2), (None, text("bb", 30, 4001) + " c@d.e", "bb", "s", 2), (None, near(8, 3), "cc", "s", 2), (106, text("cc", 30, 4002) + " call +1 (385) 555-1563.", "cc", "s", 3),
        (107, text("aa", 900, 4003), "aa", "s", 3), (107, text("aa", 900, 4003), "aa", "s", 3),
    ]
    return [(*x, 1, "r", "l", 2, 3, None, "d", "s") for x in rows] if extra else rows


@pytest.mark.parametrize("extra", [False, True])
def test_stages(spark, tmp_path, extra):
    docs = spark.createDataFrame(corpus(extra), CLASHING if extra else SCHEMA)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language ID", "line dedup", "MinHash near-dedup", "PII", "best-fit packing"]
    seen = [docs]
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = common.stage(step(spark, seen[-1], str(tmp_path)), "stage")
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        seen.append(out)
    whole = [d.collect() for d in seen]
    texts = [Counter((x.doc_id, x.text) for x in rows) for rows in whole]
    # language: what has no letters, and letters at random
    assert {k for k, _ in texts[0] - texts[1]} == {101, 102, 104} and not texts[1] - texts[0]
    assert {x.lang for x in whole[1] if x.doc_id is None} == {"aa", "bb", "cc"}
    # lines: each document's lines are those it had, and none of the passage but in the first; a copy goes
    before = {(x.doc_id, zlib.crc32(x.text.encode()) if x.doc_id is None else 0): x.text for x in whole[1]}
    kept = {x.doc_id: x.text for x in whole[2] if x.doc_id is not None}
    order = sorted((k for k in before if k[0] is not None), key=lambda k: k[0])
    check([(k[0], before[k]) for k in order], {k[0]: kept.get(k[0], "") for k in order})
    assert set(before) - {(k, 0) for k in kept} == {k for k in before if k[0] is None} | {(105, 0)}
    assert [k for k, t in kept.items() if text("aa", 12, 902) in t] == [0] and filled(kept[103]) == ["mail a@b.c or 10.1.2.3"]
    # near duplicates: one row of each group, the first by id
    rows = sorted(whole[2], key=lambda x: (x.doc_id is None, x.doc_id or 0))
    groups = brute(dict(enumerate(x.text for x in rows)))
    want = Counter((x.doc_id, x.text) for k, x in enumerate(rows) if groups[k][1] == k)
    assert texts[3] == want and sum(x.doc_id == 107 for x in whole[3]) == 1 and 100 not in {x.doc_id for x in whole[3]}
    # personal data: none of a base kind is left, and all else is as it was
    was = {(x.doc_id, x.lang): x.text for x in whole[3]}
    for x in whole[4]:
        assert personal(x.text)[0] == [0, 0, 0, 0] and x.n_chars == len(x.text)
        parts = [re.escape(p) for p in re.split(r"\[[A-Z]+\]", x.text)]
        assert re.fullmatch(".+".join(parts), was[(x.doc_id, x.lang)], re.DOTALL)
    assert sum("[EMAIL]" in x.text for x in whole[4]) == 2 and sum("[PHONE]" in x.text for x in whole[4]) == 1
    # packing: the library's ids, each once, without gaps
    library = tokenizers.Tokenizer.from_file(corpus_pipeline.vocabulary("byte_bpe_50k.json"))
    want = Counter()
    for x in whole[4]:
        ids = [*library.encode(x.text, add_special_tokens=False).ids, 2]
        cuts = list(range(len(ids) % 1024 or 1024, len(ids) + 1, 1024))
        want.update((x.doc_id, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip([0, *cuts], cuts)))
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((p.doc_id, p.piece, p.start, p.length, p.ids_crc32) for p in pieces) == want
    bins = defaultdict(list)
    for p in pieces:
        bins[p.sequence_id].append((p.offset, p.length))
    assert all(sum(n for _, n in sorted(v)[:k]) == v2[0] for v in bins.values() for k, v2 in enumerate(sorted(v))) and max(sum(n for _, n in v) for v in bins.values()) <= 1024
    assert len(bins) <= -(-sum(p.length for p in pieces) // 1024) + 1


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
