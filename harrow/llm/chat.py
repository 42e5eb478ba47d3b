"""Chat formatting with cumulative-snapshot collapse, in DataFrame operations.

Logs often hold a conversation several times, each snapshot with more turns. A
rolling hash of each conversation's turns names all its prefixes; a conversation
whose whole equals a proper prefix of another is dropped by an anti-join, equal
conversations keep the smallest id, and the maximal ones are rendered.

The rolling hash is a running sum of two independent position-dependent 64-bit
hashes, kept exactly, so that no turns are gathered to compute it. Prefixes are
reduced to distinct ones before the anti-join, so that a very common first turn
is one row there.

Edge cases. A null text counts as empty and a null role as ``unknown``; a null turn
number comes first; turns that share a number are ordered by role and text; exact
repeats of a row are one turn; rows without a conversation id belong to no
conversation and are left out; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.common import table

START, END = "<|im_start|>", "<|im_end|>"


def _digest(n: Column, role: Column, text: Column, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), n, role, text).cast("decimal(20,0)")


def maximal(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns (conv_id, turn, role, text, n, size) of conversations that no other one extends or repeats."""
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col), F.lit("unknown")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    ).where("conv_id is not null").distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.withColumn("n", F.row_number().over(order))
    hashed = numbered.select("conv_id", "turn", "n", *[_digest(F.col("n"), F.col("role"), F.col("text"), s).alias(f"_d{s}") for s in (1, 2)])
    by_n = Window.partitionBy("conv_id").orderBy("n")
    rolled = hashed.select("conv_id", "n", *[F.sum(f"_d{s}").over(by_n.rowsBetween(Window.unboundedPreceding, 0)).alias(f"_h{s}") for s in (1, 2)], F.lead("n").over(by_n).isNull().alias("_last"))
    key = ["n", "_h1", "_h2"]
    whole = rolled.where("_last").groupBy(*key).agg(F.min("conv_id").alias("conv_id"))
    prefixes = rolled.where("not _last").select(*key).distinct()
    kept = whole.join(prefixes, key, "left_anti").select("conv_id", F.col("n").alias("size"))
    return numbered.join(kept, "conv_id")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns, text): one chat text for each conversation of :func:`maximal`."""
    said = F.array_sort(F.collect_list(F.struct("n", "role", "text")))
    lines = F.transform(said, lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(END)))
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.array_join(lines, "\n").alias("text"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All maximal ``conversations``, rendered."""
    return render(maximal(table(spark, sf_dir, "conversations")))


OP3_SQL = """
WITH r AS (
  SELECT DISTINCT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, count(*) AS n, list('<|im_start|>' || role || chr(10) || text || '<|im_end|>' ORDER BY turn NULLS FIRST, role, text) AS turns FROM r GROUP BY conv_id
), p AS (
  SELECT DISTINCT turns[1:k] AS turns FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)
), w AS (
  SELECT min(conv_id) AS conv_id, n, turns FROM c GROUP BY n, turns
)
SELECT conv_id, n AS n_turns, array_to_string(turns, chr(10)) AS text FROM w ANTI JOIN p ON w.turns = p.turns
"""
