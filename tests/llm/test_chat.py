from tessera.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, idx string, p1 long, last string"


def table(spark, convs):
    rows = [(c, k, role, text, "x", 1, "y") for c, turns in convs for k, (role, text) in enumerate(turns)]
    return spark.createDataFrame(rows, SCHEMA)


def brute(convs):
    merged = {c: [(r or "unknown", t or "") for r, t in turns] for c, turns in convs}
    out = {}
    for c, t in merged.items():
        same = [d for d, u in merged.items() if u == t]
        if c == min(same) and not any(len(u) > len(t) and u[: len(t)] == t for u in merged.values()):
            out[c] = (len(t), len(same), "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in t))
    return out


def test_snapshots_collapse(spark):
    turns = [("user", f"q{k}") if k % 2 == 0 else ("assistant", f"a{k}") for k in range(200)]
    convs = [(k, turns[:k]) for k in range(1, 9)] + [(20, turns[:8]), (21, turns[:2] + [("user", "else")]), (22, [("user", "q0x")]), (23, [(None, None)]), (24, [("user", "")]), (30, [("user", "lone"), *turns]), (31, [("user", "lone")])]
    convs += [(100 + k, [("user", "common")]) for k in range(50)]
    got = {}
    for r in sorted(chat.rendered_conversations(table(spark, convs)).collect(), key=lambda r: (r.conv_id, r.part)):
        n, copies, text = got.get(r.conv_id, (r.n_turns, r.n_copies, ""))
        got[r.conv_id] = (n, copies, text + r.rendered)
    assert got == brute(convs)


def test_ties_repeats_and_nulls(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, "assistant", "c"), (1, 1, "assistant", "b"), (None, 0, "user", "z"), (2, None, "system", "first"), (2, 0, "user", "then")]
    got = {r.conv_id: (r.n_turns, r.rendered) for r in chat.rendered_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {
        1: (3, "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n<|im_start|>assistant\nc<|im_end|>\n"),
        2: (2, "<|im_start|>system\nfirst<|im_end|>\n<|im_start|>user\nthen<|im_end|>\n"),
    }
    assert chat.rendered_conversations(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conversations_of_many_blocks(spark):
    """More turns than a block has, in any order of rows; snapshots that end within and at the end of blocks; another numbering of the same turns."""
    import random

    n, size = 2600, 1 << chat.BLOCK_BITS
    turns = [("user" if k % 2 else "assistant", f"t{k}") for k in range(n)]
    rows = [(1, k, *t) for k, t in enumerate(turns)] + [(9, None, "system", "s"), *[(9, k - 1500, *t) for k, t in enumerate(turns)]]
    for c, end in ((2, size), (3, size + 1), (4, 2 * size - 1), (5, n)):
        rows += [(c, 7 * k - 5000, *t) for k, t in enumerate(turns[:end])]
    rows += [(6, k, *(t if k != 1500 else ("user", "else"))) for k, t in enumerate(turns[:1700])]
    random.Random(1).shuffle(rows)
    got = {}
    for r in sorted(chat.rendered_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect(), key=lambda r: (r.conv_id, r.part)):
        k, copies, text = got.get(r.conv_id, (r.n_turns, r.n_copies, ""))
        got[r.conv_id] = (k, copies, text + r.rendered)
    line = lambda ts: "".join(f"<|im_start|>{r}\n{x}<|im_end|>\n" for r, x in ts)
    other = [t if k != 1500 else ("user", "else") for k, t in enumerate(turns[:1700])]
    assert got == {1: (n, 2, line(turns)), 6: (1700, 1, line(other)), 9: (n + 1, 1, line([("system", "s"), *turns]))}
