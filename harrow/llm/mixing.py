"""Mixing sources to target weights, with DataFrame operations only.

Tokens are summed per source, the targets follow by water-filling, a source's
repetition rate is target / size, and each document is emitted ``floor(rate)``
times plus one hash-seeded Bernoulli copy with the fraction's probability.

Edge cases. A null or empty text has size 0; a source of size 0 has target 0 and
its documents are not emitted; a null source is a source of its own, last in
order; a null id is hashed as the empty string; repeated rows are mixed as rows
of their own but share their draw, since the draw depends on the id alone; an
empty table gives an empty mix; other columns are carried along untouched,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.common import attach, packed, staged, table, unpacked

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MAX_RATE = 3
SEED = "mix-1"
#: 13 hexadecimal digits make a fraction that a double holds exactly.
_UNIT = float(1 << 52)


def size_of(text: Column) -> Column:
    """Words in a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A join key that tells a null source from every string."""
    return F.when(source.isNull(), F.lit("-")).otherwise(F.concat(F.lit("+"), source.cast("string")))


def unit_draw(doc_id: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the id and the seed."""
    text = F.concat(F.lit(seed + "|"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(_UNIT)


def source_targets(sizes: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE) -> DataFrame:
    """(source, source_size) -> the same with ``target``; one row per source.

    Water-filling in closed form: with sources ordered by cap / weight, the level
    after the first i are capped is (total - their caps) / (weights left); the
    highest such level is the final one, and target = least(cap, level * weight).
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(int(w)) for w in weights])
    every = Window.partitionBy()
    ranked = (
        sizes.withColumn("_w", F.element_at(cycle, (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
        .withColumn("_cap", F.col("source_size") * max_rate)
    )
    before = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    filled = (
        ranked.withColumn("_total", F.sum("source_size").over(every))
        .withColumn("_weights", F.sum("_w").over(every))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0)))
        .withColumn("_gone", F.coalesce(F.sum("_w").over(before), F.lit(0)))
        .withColumn("_level", (F.col("_total") - F.col("_capped")) / (F.col("_weights") - F.col("_gone")))
        .withColumn("_level", F.max("_level").over(every))
    )
    return filled.select("source", "source_size", F.least(F.col("_cap").cast("double"), F.col("_level") * F.col("_w")).alias("target"))


def mix_plan(docs: DataFrame, weights=WEIGHTS, max_rate: int = MAX_RATE, seed: str = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Per row of ``docs``: ``_row`` (all its columns), size, source_size, target, copies."""
    base = docs.select(packed(docs), F.col(id_col).alias("doc_id"), source_key(F.col(source_col)).alias("_key"), F.col(source_col).cast("string").alias("source"), size_of(F.col(text_col)).alias("size"))
    sums = base.groupBy("_key").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    targets = source_targets(sums.select("source", "source_size"), weights, max_rate).select(source_key(F.col("source")).alias("_key"), "source_size", "target")
    targets = staged(targets, "mix-targets")  # one row per source, read twice below
    rate = F.coalesce(F.try_divide(F.col("target"), F.col("source_size")), F.lit(0.0))
    drawn = F.when(unit_draw(F.col("doc_id"), seed) < rate - F.floor(rate), 1).otherwise(0)
    return attach(base, targets, "_key").select("_row", "doc_id", "size", "source_size", "target", (F.floor(rate) + drawn).cast("long").alias("copies"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with each row emitted as often as the mix takes it."""
    plan = mix_plan(docs, **options).where("copies > 0")
    copied = plan.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return copied.select(*unpacked(copied, docs.columns))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all ``documents``: what it takes of each."""
    plan = mix_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT source, source_size, CAST(1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 AS BIGINT) AS w, source_size * 3 AS cap FROM s
), f AS (
  SELECT *, CAST(coalesce(sum(cap) OVER b, 0) AS BIGINT) AS capped, CAST(coalesce(sum(w) OVER b, 0) AS BIGINT) AS gone,
         CAST(sum(source_size) OVER () AS BIGINT) AS total, CAST(sum(w) OVER () AS BIGINT) AS weights
  FROM w WINDOW b AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT source, source_size, least(CAST(cap AS DOUBLE), max((total - capped) / (weights - gone)) OVER () * w) AS target FROM f
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, coalesce(t.target / nullif(t.source_size, 0), 0.0) AS rate,
         CAST('0x' || substr(md5('mix-1|' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""
