"""Collapse of cumulative conversation logs, and rendering of those that remain."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def render(role: Column, text: Column) -> Column:
    """One turn in the chat markup; null parts are empty."""
    return F.concat(F.lit(BEGIN), F.coalesce(role, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END))


def positions(turns: DataFrame, chunk: int = 1024) -> DataFrame:
    """turns with `position`, gapless from 0 in each conversation, and two rolling hashes.

    Turns are ordered by (turn, role, text), nulls first; rows that repeat entirely are
    turns of their own. A conversation is ranked in chunks of `chunk` turn numbers and
    the chunks' counts and hashes are accumulated over chunk rows, so one conversation
    may hold any share of all rows. The hash of a prefix is the exclusive or of its
    turns' hashes, each taken with its position, with two seeds.
    """
    held = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    part = F.coalesce(F.floor(F.col("turn") / chunk), F.lit(-(1 << 53))).alias("chunk")
    inside = Window.partitionBy("conv_id", "chunk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    ranked = held.withColumn("chunk", part).withColumn("rank", F.row_number().over(inside) - 1)
    over_chunks = Window.partitionBy("conv_id").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranked.groupBy("conv_id", "chunk").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(over_chunks), F.lit(0))).select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), "before")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k"))
    placed = ranked.join(before, same).withColumn("position", F.col("before") + F.col("rank")).drop("c", "k", "rank", "before")
    own = F.concat_ws("\x00", F.col("position").cast("string"), F.sha2(render(F.col("role"), F.col("text")).cast("binary"), 256))
    hashed = placed.withColumn("h1", F.xxhash64(own)).withColumn("h2", F.xxhash64(F.lit(1), own))
    running = Window.partitionBy("conv_id", "chunk").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    sums = hashed.groupBy("conv_id", "chunk").agg(F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"))
    carried = sums.select(F.col("conv_id").alias("c"), F.col("chunk").alias("k"), *(F.coalesce(F.bit_xor(x).over(over_chunks), F.lit(0)).alias(f"c{x}") for x in ("x1", "x2")))
    rolled = hashed.select("*", F.bit_xor("h1").over(running).alias("r1"), F.bit_xor("h2").over(running).alias("r2")).join(carried, same)
    return rolled.select("conv_id", "position", "role", "text", F.col("r1").bitwiseXOR(F.col("cx1")).alias("p1"), F.col("r2").bitwiseXOR(F.col("cx2")).alias("p2"))


def maximal(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of conversations that are no strict prefix of another.

    Of conversations with equal turns the least conv_id stays. Prefixes are compared
    by length and two rolling hashes; they are made distinct before the anti-join, so a
    first turn or a log that many conversations share costs one row.
    """
    rolled = common.scratch(turns.select("conv_id", "position", "p1", "p2"), "prefixes")
    ends = rolled.groupBy("conv_id").agg(F.max(F.struct("position", "p1", "p2")).alias("e")).select("conv_id", "e.*")
    ends = common.scratch(ends, "ends")
    last = ends.withColumnRenamed("conv_id", "owner").withColumnRenamed("position", "length").select("owner", "length")
    inner = rolled.join(last, rolled.conv_id.eqNullSafe(last.owner)).filter("position < length").select("position", "p1", "p2").distinct()
    whole = ends.groupBy("position", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    kept = whole.join(inner, ["position", "p1", "p2"], "left_anti")
    return kept.select("conv_id", (F.col("position") + 1).alias("n_turns"))


def collapse_and_render(turns: DataFrame) -> DataFrame:
    """Rendered turns of the maximal conversations of turns(conv_id, turn, role, text, ...).

    Returns conv_id, n_turns, position, role and rendered, a row per turn: a
    conversation's training text is its rows' rendered parts in order of position, so
    one conversation is never gathered in one task. A null conv_id is one conversation
    like others. Null roles and texts are rendered as empty and equal the empty text.
    An empty table gives an empty result; further columns are ignored.
    """
    placed = common.scratch(positions(turns), "turns")
    kept = maximal(placed).withColumnRenamed("conv_id", "kept_id")
    told = placed.join(kept, placed.conv_id.eqNullSafe(kept.kept_id))
    return told.select("conv_id", "n_turns", "position", "role", render(F.col("role"), F.col("text")).alias("rendered"))


ORACLE = f"""
WITH o AS (
  SELECT conv_id, role, '{BEGIN}' || coalesce(role, '') || chr(10) || coalesce(text, '') || '{END.strip()}' || chr(10) AS rendered,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) - 1 AS position
  FROM conversations
), c AS (SELECT conv_id, count(*) AS n_turns, list(rendered ORDER BY position) AS turns FROM o GROUP BY conv_id
), k AS (
  SELECT a.conv_id, a.n_turns FROM c a WHERE NOT EXISTS (
    SELECT 1 FROM c b WHERE (b.n_turns > a.n_turns AND b.turns[1:a.n_turns] = a.turns) OR (b.turns = a.turns AND b.conv_id < a.conv_id))
)
SELECT o.conv_id, k.n_turns::BIGINT AS n_turns, o.position::BIGINT AS position, o.role, o.rendered FROM o JOIN k ON o.conv_id = k.conv_id"""
