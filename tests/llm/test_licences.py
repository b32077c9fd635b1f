import pytest

from tessera.llm import licences as L
from tests.llm.helpers import documents, empty, hard_texts


@pytest.mark.parametrize("extra", [False, True])
def test_scan(spark, extra):
    texts = [
        "Copyright (c) 2020 Some One\n\n" + L.MIT.upper().replace(", ", ",\n"), "MIT Licence\n\nCopyright 2021 by X. All rights reserved.\n" + L.MIT.replace('"', "“"), L.MIT + " And more.",
        "intro\nReleased under the MIT Licence\nmore\n\tLICENSED under CC BY-NC 4.0", "All rights reserved.", *hard_texts(), *[v for v in L.ISC.split("\n")],
        *[t for all_ in L.all_licences().values() for t in all_],
    ]
    got = L.license_scan(documents(spark, texts, extra)).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(texts) + 1
    assert by[0].license == "MIT" and by[1].license == "MIT" and by[2].license is None
    assert by[3].notices == "CC-BY-NC-4.0,MIT" and by[4].license is None
    assert (by[5].digest, by[5].license, by[5].notices) == (None, None, None) and by[6].notices == ""
    names = [k for k, all_ in L.all_licences().items() for _ in all_]
    assert [by[len(texts) - len(names) + k].license for k in range(len(names))] == names
    assert L.license_scan(empty(spark)).count() == 0


def test_driver_and_engine_agree_on_the_form(spark):
    import hashlib

    texts = [t for t in hard_texts() if t is not None] + [t for all_ in L.all_licences().values() for t in all_]
    for r in L.license_scan(documents(spark, texts)).collect():
        assert r.digest == hashlib.sha256(L.canonical_text(texts[r.doc_id]).encode()).hexdigest()


def test_whole_texts_in_other_layouts(spark):
    """Wrapped anew, in capitals, with other punctuation and a holder's line."""
    import textwrap

    whole = {k: v[0] for k, v in L.all_licences().items()} | {k: L.all_licences()[k][-3] for k in ("Apache-2.0", "GPL-3.0")}
    names, texts = [], []
    for k, t in whole.items():
        names += [k, k]
        texts += ["\n\n".join(p if "copyright (c)" in p.lower() else textwrap.fill(p, 50, break_long_words=False, break_on_hyphens=False) for p in t.split("\n\n")), "Copyright (c) 2024 A. Holder\n" + t.upper().replace(",", ";").replace("\n", "\r\n")]
    got = {r.doc_id: r.license for r in L.license_scan(documents(spark, texts)).collect()}
    assert len(names) > 30 and [k for k, n in enumerate(names) if got[k] != n] == []


def test_lines_end_with_line_feeds_only(spark):
    import duckdb

    texts = [f"Some words{end}Copyright (c) 2020 Some One{end}and more" for end in ("\n", "\r", "\u0085", "\u2028", "\r\n")]
    docs = documents(spark, texts)
    got = {r.doc_id: r.digest for r in L.license_scan(docs).collect()}
    frame = docs.toPandas()
    con = duckdb.connect()
    con.register("documents", frame)
    assert got == {r[0]: r[1] for r in con.sql(L.oracle()).fetchall()}
