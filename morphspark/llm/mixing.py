"""Mixing sources to target weights by hash-threshold histograms.

A document's hash decides where it stands in its source; a budget of tokens
then is a threshold on the hash. Sums of tokens by source and hash bucket find
the bucket in which each threshold lies; only that bucket is split further,
12 bits at a time, until the threshold is exact. Nothing is sorted but sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._scratch import Scratch, fresh

HASH_BITS = 60
LEVEL_BITS = 12
FRACTIONS = (0.25, 0.5, 0.85)
POWER = 0.7


def doc_hash(column: Column) -> Column:
    """60 bits of the id's MD5; a null id hashes as the word null."""
    return F.conv(F.substring(F.md5(F.coalesce(column.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def n_words(column: Column) -> Column:
    """White-space separated words; 0 of a null text."""
    return F.coalesce(F.size(F.filter(F.split(column, "[ \\t\\n\\r\\f\\x0B]+"), lambda w: w != "")), F.lit(0)).cast("long")


def thresholds(slim: DataFrame, scratch: Scratch, fractions=FRACTIONS, power: float = POWER, weights: dict | None = None) -> DataFrame:
    """(source, tier, threshold): documents with hash <= threshold fit the tier's budget. slim: (source, h, n)."""
    spark = slim.sparkSession
    totals = slim.groupBy("source").agg(F.sum("n").alias("t"))
    if weights is None:
        share = totals.withColumn("w", F.pow(F.col("t").cast("double"), F.lit(power)))
    else:
        given = spark.createDataFrame(list(weights.items()), "name string, w double")
        share = totals.join(F.broadcast(given) if len(weights) < 10_000 else given, F.col("source").cast("string").eqNullSafe(F.col("name")), "left").select("source", "t", F.coalesce("w", F.lit(0.0)).alias("w"))
    every = Window.partitionBy(F.lit(0))
    tiers = F.explode(F.array(*[F.struct(F.lit(i).alias("tier"), F.lit(float(f)).alias("f")) for i, f in enumerate(fractions)]))
    state = share.withColumn("all_t", F.sum("t").over(every)).withColumn("all_w", F.sum("w").over(every)).select("source", tiers.alias("x"), "t", "w", "all_t", "all_w").select("source", "x.tier", F.coalesce(F.floor(F.col("x.f") * F.col("all_t") * F.col("w") / F.col("all_w") + 1e-6), F.lit(0)).alias("room"), F.lit(0).cast("long").alias("prefix"), F.lit(False).alias("whole"))
    state = scratch.table(state)
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        mine = slim.select(F.col("source").alias("s"), F.shiftright("h", shift + LEVEL_BITS).alias("p"), F.shiftright("h", shift).alias("bucket"), "n")
        open_ = state.where(~F.col("whole"))
        if level == 0:
            sums = mine.groupBy("s", "p", "bucket").agg(F.sum("n").alias("n"))
        else:
            edges = open_.select("source", "prefix").distinct()
            sums = mine.join(edges, F.col("s").eqNullSafe(F.col("source")) & (F.col("p") == F.col("prefix")), "left_semi").groupBy("s", "p", "bucket").agg(F.sum("n").alias("n"))
        sums = scratch.table(sums)
        upto = Window.partitionBy("source", "tier").orderBy("bucket")
        run = open_.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("prefix") == F.col("p"))).withColumn("cum", F.sum("n").over(upto))
        over = F.col("cum") > F.col("room")
        step = run.groupBy("source", "tier", "room", "prefix").agg(F.min(F.when(over, F.col("bucket"))).alias("edge"), F.max(F.when(~over, F.col("cum"))).alias("used"))
        new = step.select("source", "tier", (F.col("room") - F.coalesce("used", F.lit(0))).alias("room"), F.coalesce("edge", F.shiftleft(F.col("prefix") + 1, LEVEL_BITS)).alias("prefix"), F.col("edge").isNull().alias("whole"))
        done = state.where(F.col("whole")).select("source", "tier", "room", F.shiftleft("prefix", LEVEL_BITS).alias("prefix"), "whole")
        state = scratch.table(new.unionByName(done))
    return state.select("source", "tier", (F.col("prefix") - 1).alias("threshold"))


def mix_tiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", fractions=FRACTIONS, power: float = POWER, weights: dict | None = None) -> DataFrame:
    """(doc_id, source, n_tokens, tier) of every document within the largest budget; tier: the smallest of the nested budgets that holds it.

    A budget is a fraction of all tokens, shared out by weight: those given, by
    source, or tokens ** power. A source that has fewer tokens gives all it
    has. Documents come in the order of their hash while their tokens fit; the
    first that doesn't fit ends its source's share. Equal ids have one hash
    and stand or fall together. A null source is a source of its own; a null
    or empty text has no tokens and takes no room; a null id hashes as a word.
    """
    scratch = Scratch(docs.sparkSession, "mixing")
    slim = scratch.table(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("n"), doc_hash(F.col(f"`{id_col}`")).alias("h")))
    edge = thresholds(slim, scratch, fractions, power, weights).groupBy("source").agg(F.array_sort(F.collect_list(F.struct("tier", "threshold"))).alias("tiers"))
    edge = scratch.table(edge).withColumnRenamed("source", "s")
    return slim.join(edge, F.col("source").eqNullSafe(F.col("s"))).withColumn("tier", F.get(F.filter("tiers", lambda x: F.col("h") <= x["threshold"]), F.lit(0))["tier"]).where(F.col("tier").isNotNull()).select("doc_id", "source", F.col("n").alias("n_tokens"), "tier")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", fractions=FRACTIONS, power: float = POWER, weights: dict | None = None) -> DataFrame:
    """The rows of mix_tiers, with the columns of the input and no others."""
    scratch = Scratch(docs.sparkSession, "mixing")
    slim = scratch.table(docs.select(F.col(f"`{source_col}`").alias("source"), n_words(F.col(f"`{text_col}`")).alias("n"), doc_hash(F.col(f"`{id_col}`")).alias("h")))
    edge = scratch.table(thresholds(slim, scratch, fractions[-1:], power, weights))
    h, s, t = (fresh(docs, x) for x in ("_hash", "_source", "_threshold"))
    edge = edge.select(F.col("source").alias(s), F.col("threshold").alias(t))
    kept = docs.withColumn(h, doc_hash(F.col(f"`{id_col}`"))).join(edge, F.col(f"`{source_col}`").eqNullSafe(F.col(s)))
    return kept.where(F.col(h) <= F.col(t)).select(*[F.col(f"`{c}`") for c in docs.columns])


SQL = """
with d as (
  select row_number() over () as r, doc_id, source,
         case when text is null then 0 else len(regexp_extract_all(text, '[^ \\t\\n\\r\\f\\v]+')) end as n,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), 'null')), 1, 15))::bigint as h
  from documents),
t as (select source, sum(n)::double as t from d group by source),
b as (select source, tier, floor(f * (select sum(t) from t) * pow(t, 0.7) / (select sum(pow(t, 0.7)) from t) + 1e-6) as room
      from t, (values (0, 0.25), (1, 0.5), (2, 0.85)) v(tier, f)),
c as (select *, sum(n) over (partition by source order by h range unbounded preceding) as cum from d)
select doc_id, source, n as n_tokens, min(tier) as tier
from c join b using (source) where cum <= room group by r, doc_id, source, n
"""
