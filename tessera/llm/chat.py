"""Chat formatting with collapse of cumulative snapshots.

Chat logs often hold a conversation once for each turn that was added. The hash of each
prefix of a conversation is a running sum over hashes of (place, role, text), in two
independent 64-bit hashes. A conversation whose last prefix is a proper prefix of another
one is dropped by an anti-join; of equal ones that with the smallest id stays. Only what stays is rendered.

Turns are ordered by turn, role and text. Defined results: rows without ``conv_id`` belong to
no conversation and are ignored; a repeated row counts once; a null role is "unknown", a null
text empty, a null turn comes first; an empty table gives an empty result; other columns are
ignored. A rendering is cut into parts of ``PART_TURNS`` turns, so that no row grows with the
length of a conversation; joined in the order of ``part`` they are the whole.

No task sees a conversation's texts: turns are numbered, and hashes summed up, in blocks of ``2 ** BLOCK_BITS`` values of ``turn``,
and only one row for each block is put in order for the whole conversation. Copies are counted with
partial sums before they are dealt out, and a part has a bounded number of turns. Prefixes
are equal where both sums and the number of turns agree; with 128 bits, texts aren't compared again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stage

PART_TURNS = 64
BLOCK_BITS = 10
BLOCK = ["conv_id", "block"]


def before(blocks: DataFrame, *sums: str) -> DataFrame:
    """For one row a block: what the blocks before it have of each sum, under the same names."""
    upto = Window.partitionBy("conv_id").orderBy("block")
    return blocks.select(*BLOCK, *[(F.sum(c).over(upto) - F.col(c)).alias(c) for c in sums])


def numbered_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``block``, ``idx`` from 1, ``role`` and ``text`` of each turn."""
    turns = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("unknown")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    ).filter(F.col("conv_id").isNotNull()).distinct()
    turns = turns.withColumn("block", F.coalesce(F.shiftright("turn", BLOCK_BITS), F.lit(-(1 << 62))))
    place = F.row_number().over(Window.partitionBy(*BLOCK).orderBy("turn", "role", "text")).cast("long")
    local = stage(turns.select(*BLOCK, place.alias("place"), "role", "text"), "turns")
    ahead = before(local.groupBy(*BLOCK).agg(F.count("*").alias("n")), "n")
    return local.join(ahead, BLOCK).select(*BLOCK, (F.col("place") + F.col("n")).alias("idx"), "role", "text")


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``idx``, prefix hashes ``p1`` and ``p2``, and whether the turn is the last."""
    mix = lambda seed: F.xxhash64(F.lit(seed), "idx", "role", "text").cast("decimal(20,0)")
    rows = stage(turns.select(*BLOCK, "idx", mix(1).alias("h1"), mix(2).alias("h2")), "hashes")
    ahead = before(rows.groupBy(*BLOCK).agg(F.sum("h1").alias("b1"), F.sum("h2").alias("b2")), "b1", "b2")
    sizes = rows.groupBy("conv_id").agg(F.max("idx").alias("n"))
    upto = Window.partitionBy(*BLOCK).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = rows.select(*BLOCK, "idx", F.sum("h1").over(upto).alias("w1"), F.sum("h2").over(upto).alias("w2"))
    total = lambda k: (F.col(f"w{k}") + F.col(f"b{k}")).cast("decimal(38,0)").alias(f"p{k}")
    return within.join(ahead, BLOCK).join(sizes, "conv_id").select("conv_id", "idx", (F.col("idx") == F.col("n")).alias("last"), total(1), total(2))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """Conversations that no other one continues: the smallest id of equal ones, its turns and how many are equal."""
    key = ["p1", "p2", "idx"]
    whole = prefixes.filter("last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    continued = prefixes.filter(~F.col("last")).select(*key).distinct()
    return whole.join(continued, key, "left_anti").select("conv_id", F.col("idx").alias("n_turns"), "n_copies")


def rendered_conversations(conversations: DataFrame) -> DataFrame:
    """The maximal conversations in ChatML, one row for each part."""
    turns = numbered_turns(conversations)
    kept = maximal_conversations(stage(turn_prefixes(turns), "prefixes"))
    line = F.concat(F.lit("<|im_start|>"), "role", F.lit("\n"), "text", F.lit("<|im_end|>\n"))
    parts = (
        turns.select("conv_id", "idx", line.alias("line"))
        .join(kept, "conv_id")
        .groupBy("conv_id", F.floor((F.col("idx") - 1) / PART_TURNS).cast("long").alias("part"))
        .agg(F.first("n_turns").alias("n_turns"), F.first("n_copies").alias("n_copies"), F.sort_array(F.collect_list(F.struct("idx", "line"))).alias("lines"))
    )
    return parts.select("conv_id", "part", "n_turns", "n_copies", F.array_join(F.col("lines.line"), "").alias("rendered"))


ORACLE = f"""
WITH t AS (
    SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), n AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS idx FROM t
), c AS (
    SELECT conv_id, count(*) AS n_turns, list(role || chr(31) || text ORDER BY idx) AS turns FROM n GROUP BY conv_id
), u AS (
    SELECT min(conv_id) AS conv_id, n_turns, turns, count(*) AS n_copies FROM c GROUP BY n_turns, turns
), k AS (
    SELECT a.conv_id, a.n_turns, a.n_copies FROM u a
    WHERE NOT EXISTS (SELECT 1 FROM u b WHERE b.n_turns > a.n_turns AND b.turns[1] = a.turns[1] AND b.turns[1:a.n_turns] = a.turns)
)
SELECT n.conv_id, CAST((idx - 1) // {PART_TURNS} AS BIGINT) AS part, any_value(n_turns) AS n_turns, any_value(n_copies) AS n_copies,
       string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY idx) AS rendered
FROM n JOIN k ON n.conv_id = k.conv_id
GROUP BY n.conv_id, (idx - 1) // {PART_TURNS}
"""
