"""Mixing sources to target weights by capped water-filling.

Targets are ``min(epochs * size, level * weight)`` for the one level at which they add up to the wanted total: a
source clamped at its most epochs gives its excess to the others by weight, until none is above. A document is
then taken ``floor(target / size)`` whole times, and once more if it stands before its source's cut in the order
of a seeded hash; the cut is the prefix whose words come nearest to the fraction that is left.

The cut is found by narrowing: sums by the first hash digits, then by the next digits inside the one bucket that
holds the cut, then row by row inside that (a source's rows over 16 million). So a source with a third of all rows
is only ever summed with partial aggregation. What comes back to the documents is one row for each source; it is
broadcast only if it has no more than ``BROADCAST_SOURCES`` rows.

Defined results: a null source is a source of its own, the last; a null text has size 0; a source without words
has target 0; documents without words are taken 0 times; repeated rows are taken each by itself (the copies
that straddle a cut count as one row); an empty table gives an empty result; other columns are carried along by
``mix_documents`` and ignored by ``mix_rows``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from orderweave.llm.common import Scratch, column, table, word_count

BROADCAST_SOURCES = 10_000
SEED = 17


def _key(id_col: str, seed: int) -> Column:
    return F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))), 1, 16)


def by_code_point(sources: DataFrame, weights: list[int]) -> DataFrame:
    """A weight for each source: those given, repeating, in code point order, null last. One row a source goes through one task."""
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    return sources.withColumn("weight", F.get(F.array(*map(F.lit, weights)), (rank % len(weights)).cast("int")))


def water_fill(sources: DataFrame, share: float, epochs: float) -> DataFrame:
    """``sources(source, source_size, weight)`` with ``target``; the sources are ordered by the level at which each is clamped."""
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    a = sources.withColumn("cap", F.col("source_size") * F.lit(epochs))
    b = a.select(
        "*",
        F.row_number().over(order).alias("rn"),
        ((F.sum("source_size").over(every) * share - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0)))).alias("level"),
    )
    c = b.withColumn("first_free", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("rn", "level"))).over(every))
    target = F.when(F.col("rn") >= F.col("first_free.rn"), F.col("first_free.level") * F.col("weight")).otherwise(F.col("cap"))
    return c.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _narrow(rows: DataFrame, cuts: DataFrame, digits: int, at: int) -> DataFrame:
    """``cuts(source, left, ...)`` with the bucket of the next hash digits that holds the cut, and what is left inside it."""
    sums = rows.groupBy("source", F.substring("h", at, digits).alias("bucket")).agg(F.sum("size").alias("words"))
    w = W.partitionBy("source").orderBy("bucket")
    run = sums.withColumn("upto", F.sum("words").over(w))
    j = run.alias("r").join(cuts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")))
    j = j.where((F.col("upto") - F.col("words") <= F.col("left")) & (F.col("left") < F.col("upto")))
    return j.select("c.source", (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"), F.concat("prefix", "bucket").alias("prefix"))


def _inside(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    j = rows.alias("r").join(cuts.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")))
    return j.where(F.col("h").startswith(F.col("prefix"))).select("r.*", "left")


def plan_mix(scratch: Scratch, rows: DataFrame, weights: list[int], share: float, epochs: float) -> DataFrame:
    """One row a source: source_size, target, whole repetitions, and the hash and id up to which one more is taken."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    aims = water_fill(by_code_point(sizes, weights), share, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    aims = scratch.keep(aims.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size")), "aims")
    one = _narrow(rows, aims.where("left > 0").select("source", "left", F.lit("").alias("prefix")), 3, 1)
    one = scratch.keep(one, "one")
    two = scratch.keep(_narrow(_inside(rows, one).drop("left"), one, 3, 4), "two")
    last = _inside(rows, two)
    upto = F.sum("size").over(W.partitionBy("source").orderBy("h", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(W.unboundedPreceding, 0))
    near = last.withColumn("upto", upto).where(2 * F.col("upto") - F.col("size") <= 2 * F.col("left"))
    near = near.groupBy("source").agg(F.max(F.struct("h", "doc_id", "size")).alias("last"))
    cut = two.alias("t").join(near.alias("n"), F.col("t.source").eqNullSafe(F.col("n.source")), "left").select("t.source", "prefix", "last")
    out = aims.alias("a").join(cut.alias("c"), F.col("a.source").eqNullSafe(F.col("c.source")), "left")
    return scratch.keep(out.select("a.source", "source_size", "target", "whole", "prefix", "last"), "plan")


def _joined(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """``rows`` with what the plan takes of each; expects source, h, doc_id and size in ``rows``."""
    small = plan.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    p = (F.broadcast(plan) if small else plan).alias("p")
    # Below the bucket of the cut all are taken once more; inside it those up to the last row.
    inside = F.col("last").isNotNull() & (F.struct("r.h", "r.doc_id", "r.size") <= F.col("last"))
    extra = F.col("prefix").isNotNull() & ((F.substring("r.h", 1, 6) < F.col("prefix")) | ((F.substring("r.h", 1, 6) == F.col("prefix")) & inside))
    copies = F.when(F.col("r.size") > 0, F.col("whole") + F.coalesce(extra, F.lit(False)).cast("long")).otherwise(F.lit(0)).cast("long")
    return rows.alias("r").join(p, F.col("r.source").eqNullSafe(F.col("p.source"))).withColumn("copies", copies)


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _key("doc_id", seed).alias("h"))


def mix_rows(docs: DataFrame, weights: list[int], share: float = 1.5, epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """For each document: its size, its source's size and target, and the words that the mix takes of it."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(_sized(docs, seed), "sized")
    plan = plan_mix(scratch, rows, weights, share, epochs)
    return _joined(rows, plan).select("r.doc_id", "r.size", "source_size", "target", (F.col("r.size") * F.col("copies")).alias("taken"), "copies")


def mix_documents(docs: DataFrame, weights: list[int], share: float = 1.5, epochs: float = 2.0, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as many times as it is taken, with the columns of ``docs``."""
    scratch = Scratch(docs.sparkSession)
    rows = scratch.keep(_sized(docs, seed), "sized")
    plan = plan_mix(scratch, rows, weights, share, epochs)
    scratch.drop(rows)
    size = word_count(F.col("text")).alias("size")
    named = docs.select(F.struct(*map(column, docs.columns)).alias("row"), "doc_id", "source", size, _key("doc_id", seed).alias("h"))
    out = _joined(named, plan).where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return out.select("row.*")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: weights 3, 1, 2 repeating, 150 % of all words, at most two epochs."""
    return mix_rows(table(spark, sf_dir, "documents"), [3, 1, 2])


OP5_SQL = rf"""
WITH s AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
  substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 16) AS h FROM documents),
a AS (SELECT source, sum(size)::BIGINT AS source_size, [3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight FROM s GROUP BY source),
b AS (SELECT *, source_size * 2.0::DOUBLE AS cap FROM a),
c AS (SELECT *, row_number() OVER o AS rn,
  ((SELECT sum(source_size)::DOUBLE FROM b) * 1.5 - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / ((SELECT sum(weight)::DOUBLE FROM b) - coalesce(sum(weight) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE) AS level
  FROM b WINDOW o AS (ORDER BY cap / weight, source NULLS LAST)),
f AS (SELECT min(rn) AS rn FROM c WHERE level * weight <= cap),
t AS (SELECT source, source_size, CASE WHEN rn >= (SELECT rn FROM f) THEN (SELECT level FROM c WHERE c.rn = (SELECT rn FROM f)) * weight ELSE cap END AS target FROM c),
w AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
j AS (SELECT s.doc_id, s.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS need,
  sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id NULLS FIRST, s.size ROWS UNBOUNDED PRECEDING) AS upto FROM s JOIN w ON s.source IS NOT DISTINCT FROM w.source)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM
(SELECT *, CASE WHEN size = 0 THEN 0 ELSE whole + CASE WHEN need > 0 AND 2 * upto - size <= 2 * need THEN 1 ELSE 0 END END::BIGINT AS copies FROM j)
"""
