"""Mixing sources to target weights: token totals, repetition rates, and hash-seeded copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: What separates words: the blank and the controls from tab to carriage return.
WORDS = r"[^\x20\x09-\x0D]+"
SEED = "mix"
#: Targets that take no more bytes than this (names, and three numbers for each source) are broadcast.
BROADCAST_BYTES = 1 << 20


def size_of(text: str = "text"):
    return F.coalesce(F.expr(f"regexp_count({text}, r'{WORDS}')"), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), total: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of each source of ``sizes`` (source, size).

    Sources in order of code points, null last, weigh ``weights`` in turn and share ``total`` times all sizes.
    No target exceeds ``most`` times its source's size; the excess is shared again by weight until none does,
    which is the level at which min(most * size, weight * level) adds up. Sources with nothing have target 0. The
    windows run over one row for each source, after sizes were summed in the maps.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.row_number().over(order) - 1) % len(weights) + 1)
    per = per.withColumn("_w", w).withColumn("_cap", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    everyone = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(total) * F.sum("source_size").over(everyone) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (
        F.sum("_w").over(everyone) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))
    )
    per = per.withColumn("_level", level)
    fits = F.min(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.struct(F.col("_cap") / F.col("_w"), F.col("_level").alias("level")))).over(everyone)
    target = F.least(F.col("_cap"), F.coalesce(F.col("_w") * fits.getField("level"), F.col("_cap")))
    return per.select("source", "source_size", target.alias("target"))


def copies(documents: DataFrame, broadcast_bytes: int = BROADCAST_BYTES, **options) -> DataFrame:
    """``documents`` with size, source_size, target and copies, replacing columns so named; one row each.

    A source's rate is target / source_size. A document gets floor(rate) copies, and one more with probability
    rate - floor(rate), decided by the hash of its id alone, so reruns agree; repeated rows decide alike. A null
    text has size 0; null sources are one source. The targets (one row for each source) are written and measured:
    up to ``broadcast_bytes`` they are broadcast, so that no text is shuffled; beyond, both sides are shuffled by
    source, and AQE's skew join splits a hot one.
    """
    sized = documents.drop("size", "source_size", "target", "copies").withColumn("size", size_of())
    key = "_" * (1 + max(map(len, documents.columns)))  # a name that no column has
    goal = common.Written(targets(sized.select("source", "size"), **options).withColumnRenamed("source", key)).df
    held = goal.agg(F.coalesce(F.sum(F.coalesce(F.octet_length(F.col(key).cast("string")), F.lit(0)) + 32), F.lit(0)).alias("n")).first().n
    goal = F.broadcast(goal) if held <= broadcast_bytes else goal
    placed = sized.join(goal, F.col("source").eqNullSafe(F.col(key)), "left").drop(key)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    digits = F.conv(F.substring(F.md5(F.concat(F.lit(SEED + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10)
    draw = digits.cast("double") / F.lit(4294967296.0)
    return placed.withColumn("copies", (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int"))


def mix(documents: DataFrame, **options) -> DataFrame:
    """The mix itself: every document as often as `copies` says, with the columns of ``documents``."""
    names = documents.columns
    drawn = copies(documents.select("doc_id", "source", "text", F.struct(*names).alias("row")), **options).where("copies > 0")
    return drawn.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*[F.col("row")[c].alias(c) for c in names])


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    drawn = copies(documents)
    return drawn.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP4_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END)::DOUBLE AS w
  FROM per
), levelled AS (
  SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM per)::DOUBLE - coalesce(sum(cap) OVER before, 0))
            / ((SELECT sum(w) FROM weighed) - coalesce(sum(w) OVER before, 0)) AS lvl
  FROM weighed
  WINDOW before AS (ORDER BY cap / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), chosen AS (
  SELECT lvl FROM levelled WHERE lvl <= cap / w ORDER BY cap / w, lvl LIMIT 1
), goals AS (
  SELECT source, source_size, least(cap, coalesce(w * (SELECT lvl FROM chosen), cap)) AS target FROM weighed
), rated AS (
  SELECT s.doc_id, s.size, g.source_size, g.target,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         CAST('0x' || substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS draw
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
       (size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM rated
"""
