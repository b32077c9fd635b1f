"""Small document tables with the cases that every operator has to take."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns with names that operators might use themselves.
CLASHING = SCHEMA + ", key long, row string, label string, n long, length long, _kept long, digest string, start string"


def words(n: int, seed: int = 0) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def hard_texts() -> list[str | None]:
    return [None, "", " ", "\n\n", "x", "Ünï 漢字 😀 ﬁ İ ΑΣ", "a\x00b\tc\r\nd", "  two  spaces\n", words(50, 1), words(50, 1), words(6000, 2), "z" * 5000, "<|endoftext|> in <|startoftext|>text"]


def documents(spark, texts=None, extra: bool = False):
    texts = hard_texts() if texts is None else texts
    rows = [(k, t, ["en", "de", None][k % 3], "s", len(t or "")) for k, t in enumerate(texts)]
    rows.append(rows[-1])  # a repeated row
    if extra:
        rows = [(*r, 1, "r", "l", 2, 3, None, "d", "s") for r in rows]
    return spark.createDataFrame(rows, CLASHING if extra else SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
