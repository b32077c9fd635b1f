"""PII spans by candidate gradient boosting, with DataFrame functions only.

High-recall generators propose spans, which may overlap. Boosted trees score each candidate
by its format and by the text around it, and a threshold for each kind, calibrated on held-out
rows, selects. The trees are expressions, so scoring runs inside the engine like any other column.

Four base kinds (``BASE``) are found by pattern and check alone and always stay. Candidates of the other kinds
(``PROPOSED``) are looked for in what base spans leave of a text, so none overlaps one; they may overlap each other.

Positions are code points, ends exclusive. They come from the lengths of the pieces between
matches, summed in blocks; base spans are taken out, and texts redacted, by masks with one character for each of the text.
So a text with very many matches takes linear time. The
patterns give nothing back once matched, so no text takes quadratic time either.

Training rows are generated here from formats and carriers (``training_rows``), are bounded by
``TRAINING_ROWS``, and get their features from the same expressions as the documents.

Defined results: null text counts as empty and has no spans; empty span lists have the digest
of the empty string; repeated rows give repeated results; an empty table gives an empty result;
``find`` ignores other columns than ``doc_id`` and ``text``, ``redact`` passes them through. A null text stays null in ``redact``;
spans that overlap become one there, of the first one's kind.
"""

from __future__ import annotations

import json
import random
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL, OCTET = "[A-Za-z0-9._%+-]", "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
#: Kind, and pattern in a form that doesn't backtrack. Where a match must start with a whole
#: run, it starts where the run does or where the match before ended.
BASE = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?+[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]*(?<=[\x20().0-9-])[0-9]",
}
#: Before a pattern is tried: what each text with a match has.
HINTS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
PROPOSED = {
    "contact": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]{2,64}+\x20?[\[({]at[\])}]\x20?[A-Za-z0-9-]{1,64}+(?:\x20?[\[({]dot[\])}]\x20?[A-Za-z0-9-]{1,64}+)++",
    "number": r"(?:(?<![A-Za-z0-9.+-])|\G)\(?[0-9]{2,4}+\)?[\x20./-]{1,2}+[0-9]{2,4}+[\x20.-][0-9]{3,4}+(?![0-9A-Za-z-])",
    "account": r"(?:(?<![A-Za-z0-9])|\G)[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}+(?:\x20?[A-Z0-9]{1,3})?+(?![A-Za-z0-9])",
    "secret": r"(?:(?<![A-Za-z0-9_+/=-])|\G)(?=[A-Za-z_+/=-]*+[0-9])[A-Za-z0-9_+/=-]{16,}+",
}
PROPOSED_HINTS = {"contact": r"[\[({]at[\])}]", "number": r"[0-9]{2}\)?[\x20./-]{1,2}[0-9]{2}", "account": r"[A-Z]{2}[0-9]{2}", "secret": r"[A-Za-z0-9_+/=-]{16}"}
#: In a mask: no span, and a span beyond its first character, which has a letter for its kind. What stands for base spans where candidates are looked for.
CLEAR, INSIDE, TAKEN = "0", "-", "\x01"
#: Matches whose places are summed up together.
BLOCK = 512
BEFORE, AFTER = 32, 12
#: The bound of the training sample; a third calibrates.
TRAINING_ROWS = 1800
TREES, DEPTH, RATE, BINS = 24, 3, 0.3, 16
#: Of calibration candidates above a threshold, at least so many must be personal data.
PRECISION = 0.98


def located(text: Column, pattern: str, hint: str) -> tuple[Column, Column]:
    """Matches and the pieces around them; two columns, so that each is computed once."""
    some = text.rlike(hint)
    return (
        F.when(some, F.regexp_extract_all(text, F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")),
        F.when(some, F.split(text, pattern, -1)).otherwise(F.array(text)),
    )


def placed(matches: Column, pieces: Column) -> Column:
    """Array of (start, end, match, before, after), in order, from matches and the pieces around them."""
    n = F.size(matches)
    steps = F.zip_with(matches, F.slice(pieces, 1, n), lambda m, p: F.length(p) + F.length(m))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int")), lambda b: F.slice(steps, b * BLOCK + 1, F.lit(BLOCK)))
    total = lambda a: F.aggregate(a, F.lit(0), lambda x, y: x + y)
    running = lambda a, at: F.aggregate(a, F.array(at), lambda acc, x: F.concat(acc, F.array(F.element_at(acc, -1) + x)))
    firsts = running(F.transform(blocks, total), F.lit(0))
    ends = F.flatten(F.transform(blocks, lambda b, i: F.slice(running(b, F.element_at(firsts, i + 1)), 2, F.size(b))))
    rows = F.arrays_zip(matches.alias("m"), ends.alias("e"), F.slice(pieces, 1, n).alias("b"), F.slice(pieces, 2, n).alias("a"))
    made = F.transform(
        rows,
        lambda r: F.struct(
            (r["e"] - F.length(r["m"])).alias("start"), r["e"].alias("end"), r["m"].alias("match"),
            F.right(r["b"], F.lit(BEFORE)).alias("before"), F.left(r["a"], F.lit(AFTER)).alias("after"),
        ),
    )
    return F.when(n > 0, made).otherwise(F.array().cast("array<struct<start:int,end:int,match:string,before:string,after:string>>"))


def digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def passes(kind: str, m: Column) -> Column:
    """The check of a base kind."""
    if kind == "ip":
        return m.rlike(rf"^{OCTET}(?:\.{OCTET}){{3}}$")
    if kind == "card":
        return F.length(digits(m)).between(16, 19) & F.call_function("luhn_check", digits(m))
    if kind == "phone":
        return F.length(digits(m)).between(8, 15)
    return F.lit(True)


# Words around personal data, by what they speak of. Fixed values.
WORDS = {
    "talks_phone": "phone|tel|call|mobile|fax|cell|whatsapp|number",
    "talks_id": "ssn|social|passport|tax|licen|insured|patient|national",
    "talks_money": "iban|account|bank|konto|wire|transfer|payee",
    "talks_secret": "token|secret|key|passw|pwd|auth|bearer|credential|api",
    "talks_contact": "mail|contact|write|reach|address",
    "talks_else": "version|isbn|order|invoice|page|item|model|part|ref|commit|sha|build|checksum|hash|date|score|figure|lot|serial",
}
FORMATS = {
    "length": lambda c: F.length(c["match"]),
    "digits": lambda c: F.length(digits(c["match"])),
    "lower": lambda c: F.length(F.regexp_replace(c["match"], "[^a-z]", "")),
    "upper": lambda c: F.length(F.regexp_replace(c["match"], "[^A-Z]", "")),
    "marks": lambda c: F.length(F.regexp_replace(c["match"], "[^_+/=.-]", "")),
    "hex": lambda c: c["match"].rlike("^[0-9a-f]+$").cast("int"),
    "three_two_four": lambda c: c["match"].rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$").cast("int"),
    "three_three_four": lambda c: c["match"].rlike(r"^\(?[0-9]{3}\)?[\x20./-]{1,2}[0-9]{3}[\x20.-][0-9]{4}$").cast("int"),
    "like_date": lambda c: c["match"].rlike(r"(?:19|20)[0-9]{2}").cast("int"),
    "changes": lambda c: F.length(F.regexp_replace(c["match"], "[A-Za-z]+|[^0-9A-Za-z]+", "")) - F.length(F.regexp_replace(F.regexp_replace(c["match"], "[0-9]+", "0"), "[^0]", "")),
    "after_sign": lambda c: c["before"].rlike("[=:][\\x20\"']*$").cast("int"),
    "quoted": lambda c: c["before"].rlike("[\"'`]$").cast("int"),
    "in_path": lambda c: (c["before"].rlike("[/\\\\.@#]$") | c["after"].rlike("^[/\\\\@]")).cast("int"),
}
FEATURES = [*FORMATS, *WORDS, *(f"is_{k}" for k in PROPOSED)]


def features(kind: str, c: Column) -> Column:
    """A candidate's features as an array of ints, in the order of ``FEATURES``."""
    near = F.lower(c["before"])
    return F.array(
        *[f(c).cast("int") for f in FORMATS.values()],
        *[near.rlike(words).cast("int") for words in WORDS.values()],
        *[F.lit(int(kind == k)) for k in PROPOSED],
    )


@dataclass(frozen=True)
class Model:
    """Boosted trees (leaf value, or feature, threshold, left, right) and the least score of each kind."""

    start: float
    trees: tuple
    least: tuple[tuple[str, float], ...]

    def score(self, f: Column) -> Column:
        def walk(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            k, t, a, b = node
            return F.when(F.element_at(f, k + 1) <= t, walk(a)).otherwise(walk(b))

        out = F.lit(self.start)
        for tree in self.trees:
            out = out + walk(tree)
        return out


def boosted(x: np.ndarray, y: np.ndarray) -> tuple[float, tuple]:
    """Trees for logistic loss by Newton steps; splits at quantiles."""
    start = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    raw, trees = np.full(len(y), start), []
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[:-1])) for k in range(x.shape[1])]

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int):
        value = lambda r: float(RATE * g[r].sum() / (h[r].sum() + 1.0))
        if not depth or len(rows) < 8:
            return value(rows)
        gain = lambda r: g[r].sum() ** 2 / (h[r].sum() + 1.0)
        best, whole = (1e-6, None), gain(rows)
        for k in range(x.shape[1]):
            for t in cuts[k]:
                left = x[rows, k] <= t
                if 0 < left.sum() < len(rows) and (d := gain(rows[left]) + gain(rows[~left]) - whole) > best[0]:
                    best = d, (k, float(t), left)
        if best[1] is None:
            return value(rows)
        k, t, left = best[1]
        return k, t, grow(rows[left], g, h, depth - 1), grow(rows[~left], g, h, depth - 1)

    def run(tree, r: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(r), tree)
        k, t, a, b = tree
        return np.where(r[:, k] <= t, run(a, r), run(b, r))

    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        tree = grow(np.arange(len(y)), y - p, np.maximum(p * (1 - p), 1e-6), DEPTH)
        trees.append(tree)
        raw += run(tree, x)
    return start, tuple(trees)


def predicted(start: float, trees: tuple, x: np.ndarray) -> np.ndarray:
    def run(tree, r):
        if isinstance(tree, float):
            return np.full(len(r), tree)
        k, t, a, b = tree
        return np.where(r[:, k] <= t, run(a, r), run(b, r))

    return start + sum(run(t, x) for t in trees)


def training_rows(n: int = TRAINING_ROWS, seed: int = 11) -> list[dict]:
    """Texts with one span each that is personal data (label 1) or only looks like it (label 0)."""
    r = random.Random(seed)
    d = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    a = lambda k, s="abcdefghijklmnopqrstuvwxyz": "".join(r.choice(s) for _ in range(k))
    hexes, mixed, upper = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    sep = lambda: r.choice(["-", ".", " "])

    def phone() -> str:
        s = sep()
        return r.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}{s}{d(3)}{s}{d(4)}"])

    def iban() -> str:
        body = [d(4) for _ in range(r.randint(3, 6))]
        return a(2, upper) + d(2) + r.choice(["", " "]) + r.choice(["", " "]).join(body)

    def hidden() -> str:
        gap, name = r.choice(["", " "]), a(r.randint(2, 9)) + r.choice(["", "", "." + a(r.randint(2, 6)), d(2)])
        return gap.join([name, r.choice(["(at)", "[at]", "{at}"]), a(r.randint(3, 10)), r.choice(["(dot)", "[dot]", "{dot}"]), r.choice(["com", "org", "net", "de", "io"])])

    kinds = [
        (1, ["call me at ", "phone: ", "tel. ", "mobile ", "fax: ", "reach us on cell "], phone),
        (1, ["", "or ", "the "], lambda: f"({d(3)}) {d(3)}-{d(4)}"),
        (1, ["SSN ", "ssn: ", "social security number ", "tax id: "], lambda: f"{d(3)}-{d(2)}-{d(4)}"),
        (1, ["IBAN ", "account: ", "wire to ", "bank account "], iban),
        (1, ["mail me: ", "contact ", "write to ", ""], hidden),
        (1, ['token = "', "api_key: ", 'secret="', "password=", "Bearer ", "auth token "], lambda: a(r.choice([20, 24, 32, 40]), r.choice([hexes, mixed]))),
        (0, ["version ", "build ", "model ", "part ", "item ", "ref "], lambda: f"{d(2)}{(s := sep())}{d(2)}{s}{d(4)}"),
        (0, ["on ", "date ", "of ", "the "], lambda: f"{r.randint(10, 31)}{(s := sep())}{r.randint(10, 12)}{s}{r.choice(['19', '20'])}{d(2)}"),
        (0, ["order ", "invoice ", "score ", "lot ", "figure ", "the ", "of "], lambda: f"{d(r.randint(2, 4))} {d(r.randint(2, 4))} {d(r.randint(3, 4))}"),
        (0, ["commit ", "sha ", "checksum ", "hash ", "build "], lambda: a(r.choice([16, 32, 40]), hexes)),
        (0, ["the ", "file /usr/", "see ", "in ", "of "], lambda: f"{a(7)}-{a(5)}-{a(6)}{d(1)}"),
        (0, ["the ", "https://example.com/", "of ", "in "], lambda: f"{a(8)}_{a(8)}_{d(2)}"),
        (0, ["", "model ", "serial ", "lot "], lambda: a(2, upper) + d(2) + a(8, upper)),
        (0, ["the ", "with ", "of "], lambda: a(r.randint(17, 30)) + d(1)),
    ]
    filler = lambda: " ".join(a(r.randint(2, 8)) for _ in range(r.randint(2, 6)))
    rows = []
    for k in range(n):
        label, leads, make = kinds[k % len(kinds)]
        lead, span = r.choice(leads), make()
        head = f"{filler()}{r.choice(['. ', ', ', ' '])}{lead}"
        tail = ('"' if lead.endswith('"') else "") + r.choice([" ", ", ", ".\n"]) + filler()
        rows.append({"text": head + span + tail, "start": len(head), "end": len(head) + len(span), "label": label})
    return rows


def candidates(rows: DataFrame, kinds: dict[str, str], hints: dict[str, str], text: str = "text") -> DataFrame:
    """Adds for each kind ``_m_<kind>`` and ``_p_<kind>``, matches in the column ``text`` and the pieces around them, and ``_<kind>``, the placed matches."""
    parts: list[Column] = []
    for k, pattern in kinds.items():
        m, p = located(F.col(text), pattern, hints[k])
        parts += [m.alias(f"_m_{k}"), p.alias(f"_p_{k}")]
    return rows.select("*", *parts).select("*", *[placed(F.col(f"_m_{k}"), F.col(f"_p_{k}")).alias(f"_{k}") for k in kinds])


def mask(kind: str, sign: str) -> Column:
    """A character for each of the text: ``sign`` and then ``INSIDE`` in spans of the kind, ``CLEAR`` elsewhere; null where it has no span."""
    span = lambda r: F.when(r["ok"], F.concat(F.lit(sign), F.repeat(F.lit(INSIDE), F.length(r["m"]) - 1))).otherwise(F.repeat(F.lit(CLEAR), F.length(r["m"])))
    rows = F.arrays_zip(F.col(f"_m_{kind}").alias("m"), F.col(f"_ok_{kind}").alias("ok"))
    parts = F.zip_with(F.col(f"_p_{kind}"), rows, lambda p, r: F.concat(F.repeat(F.lit(CLEAR), F.length(p)), F.when(r.isNull(), F.lit("")).otherwise(span(r))))
    return F.when(F.exists(F.col(f"_ok_{kind}"), lambda x: x), F.array_join(parts, ""))


def overlaid(masks: list[Column]) -> Column:
    """One mask of several, null where all are; where spans overlap, the first one goes on."""
    pick = lambda x, y: F.when((x == INSIDE) | (y == INSIDE), F.lit(INSIDE)).when(x != CLEAR, x).otherwise(y)
    both = lambda a, b: F.when(a.isNull(), b).otherwise(F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), pick), ""))
    return F.aggregate(F.filter(F.array(*masks), lambda m: m.isNotNull()), F.lit(None).cast("string"), both)


def painted(text: Column, over: Column, signs: dict[str, str], inside: str) -> Column:
    """The text with what each sign of a mask stands for put in, and ``inside`` for what a span goes on with."""

    def put(c: Column, m: Column) -> Column:
        out = F.when(m == CLEAR, c).when(m == INSIDE, F.lit(inside))
        for sign, word in signs.items():
            out = out.when(m == sign, F.lit(word))
        return out

    return F.when(over.isNull(), text).otherwise(F.array_join(F.zip_with(F.split(text, ""), F.split(over, ""), put), ""))


def fit(spark: SparkSession) -> Model:
    """Train and calibrate on generated rows; the same model in each session."""
    if (known := getattr(fit, "known", None)) is not None:
        return known
    shape = "array<struct<text:string,start:int,end:int,label:int>>"
    rows = spark.range(0, 1, 1, 1).select(F.explode(F.from_json(F.lit(json.dumps(training_rows())), shape)).alias("r")).select("r.*")
    rows = candidates(rows.withColumn("n", F.monotonically_increasing_id()), PROPOSED, PROPOSED_HINTS)
    true = lambda c: F.col("label").cast("boolean") & (c["start"] < F.col("end")) & (c["end"] > F.col("start"))

    def each(k: str) -> Column:
        return F.transform(F.col(f"_{k}"), lambda c: F.struct(F.lit(k).alias("kind"), true(c).cast("int").alias("y"), features(k, c).alias("x")))

    got = rows.select("n", F.explode(F.concat(*map(each, PROPOSED))).alias("c")).select("n", "c.*").orderBy("n", "kind").collect()
    x, y = np.array([r["x"] for r in got], float), np.array([r["y"] for r in got], float)
    kind, hold = np.array([r["kind"] for r in got]), np.array([r["n"] // 14 % 3 == 2 for r in got])
    start, trees = boosted(x[~hold], y[~hold])
    raw, least = predicted(start, trees, x), []
    for k in PROPOSED:
        mine = hold & (kind == k)
        order = np.argsort(-raw[mine])
        right = np.cumsum(y[mine][order]) / np.arange(1, mine.sum() + 1)
        enough = np.flatnonzero(right >= PRECISION)
        # half-way between the last that counts and the next; even odds where all count, and never below
        s = raw[mine][order]
        last = enough[-1] if len(enough) else -1
        if last < 0:
            raise ValueError(f"no threshold gives {k} the precision asked for")
        least.append((k, max(0.0, float((s[last] + s[last + 1]) / 2)) if last + 1 < len(s) else 0.0))
    fit.known = Model(start, trees, tuple(least))
    return fit.known


#: The sign of each kind in masks.
SIGNS = {k: chr(ord("A") + i) for i, k in enumerate([*BASE, *PROPOSED])}


def with_spans(rows: DataFrame, model: Model) -> DataFrame:
    """Adds ``_base`` and ``_all``: arrays of (kind, start, end), by kind as listed and then by start; and ``_mask`` of all spans."""
    keep = [F.col(c) for c in rows.columns]

    def spans(k: str) -> Column:
        both = F.arrays_zip(F.col(f"_{k}").alias("c"), F.col(f"_ok_{k}").alias("ok"))
        return F.transform(F.filter(both, lambda r: r["ok"]), lambda r: F.struct(F.lit(k).alias("kind"), r["c"]["start"].alias("start"), r["c"]["end"].alias("end")))

    found = candidates(rows, BASE, HINTS)
    checked = lambda k: F.transform(F.col(f"_m_{k}"), lambda m: passes(k, m))
    found = found.select("*", *[checked(k).alias(f"_ok_{k}") for k in BASE])
    found = found.select("*", overlaid([mask(k, SIGNS[k]) for k in BASE]).alias("_taken"))
    rest = F.when(F.col("text").rlike("|".join(PROPOSED_HINTS.values())), painted(F.col("text"), F.col("_taken"), {SIGNS[k]: TAKEN for k in BASE}, TAKEN)).otherwise(F.lit(""))
    found = candidates(found.withColumn("_rest", rest), PROPOSED, PROPOSED_HINTS, "_rest")
    least = dict(model.least)

    def chosen(k: str) -> Column:
        scored = F.transform(F.col(f"_{k}"), lambda c: F.struct(features(k, c).alias("f")))
        return F.transform(scored, lambda c: model.score(c["f"]) >= least[k])

    found = found.select("*", *[chosen(k).alias(f"_ok_{k}") for k in PROPOSED])
    base = F.concat(*map(spans, BASE))
    return found.select(*keep, base.alias("_base"), F.concat(base, *map(spans, PROPOSED)).alias("_all"), overlaid([F.col("_taken"), *[mask(k, SIGNS[k]) for k in PROPOSED]]).alias("_mask"))


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find(docs: DataFrame) -> DataFrame:
    """Per document: counts of base spans, the digest of their list, and the list of all spans."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = with_spans(rows, fit(docs.sparkSession))

    def number(k: str) -> Column:
        return F.size(F.filter("_base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")

    size = F.size("_all").cast("long")
    return found.select(
        "doc_id", *map(number, BASE), F.sha2(listed(F.col("_base")).cast("binary"), 256).alias("base_sha256"), listed(F.col("_all")).alias("spans"),
        (size - F.size("_base")).alias("n_proposed"), size.alias("n_spans"),
    )


def redact(docs: DataFrame) -> DataFrame:
    """The same rows with each span of personal data in ``text`` replaced by its kind in brackets."""
    names = docs.columns
    # the text under a name of its own, so that no column of the table clashes with the working ones
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_row"), F.coalesce("text", F.lit("")).alias("text"))
    found = with_spans(rows, fit(docs.sparkSession))
    clean = painted(F.col("text"), F.col("_mask"), {SIGNS[k]: f"[{k.upper()}]" for k in SIGNS}, "")
    text = F.when(F.col("_row.text").isNotNull(), clean)
    return found.select(*[text.alias(c) if c == "text" else F.col(f"_row.`{c}`") for c in names])
