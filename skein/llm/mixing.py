"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Every source gets a target share of all tokens by its weight, but never more than `most`
times its own size; the excess goes to the others by weight.  The targets are turned into
whole blocks of equal token count by highest quotients (target / (2k + 1)), first among
sources, then within each source among its shards.  In a shard the documents stand in a
seeded order; whole passes over the shard come first, then single blocks in seeded order.

A document takes the tokens of the selected blocks that overlap it, so it never gives more
than `most` times its size.  Null or empty texts have size 0 and give nothing.  Repeated
rows are separate documents with the same id; they share the id's tokens in row order.
An empty table gives an empty result.  All steps are joins and windows; a shard holds about
`shard_tokens` tokens, so a hot source is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import cut, only

#: `[^\x20\x09-\x0D]+` are the words.
WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
BLOCKS = 1 << 18
SHARD_TOKENS = 1 << 18
MAX_SHARDS = 1 << 16
#: Sources are broadcast up to this number, and joined by a shuffle beyond it.
FEW_SOURCES = 100_000
#: Blocks that a source's target has at least, so that a small source comes near it at any size of the whole.
FEWEST = 64
SEED = 7


def size_of(col: str) -> Column:
    """Number of words: those after a separator, and one more if the text starts with a word."""
    return F.coalesce(F.regexp_count(F.col(col), F.lit(WORD)), F.lit(0)).cast("long")


def targets(sources: DataFrame, most: int = MOST) -> DataFrame:
    """sources(source, source_size) with its weight and target; sources in code point order, null last, weigh 1, 2, 3, repeating.

    With sources in order of size/weight, the ones at their limit are a prefix: source i is
    in it if its limit is below what the weight of it and of all later ones would give it."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sources.withColumn("weight", (F.pmod(F.row_number().over(order) - 1, F.lit(3)) + 1).cast("double"))
    s = s.withColumn("limit", most * F.col("source_size").cast("double"))
    by = Window.orderBy(F.col("limit") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by.rowsBetween(Window.unboundedPreceding, -1)
    rest = by.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy()
    s = s.withColumn("left", F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
    s = s.withColumn("fair", F.col("left") * F.col("weight") / F.sum("weight").over(rest))
    free = F.when(F.col("limit") > F.col("fair"), F.struct((F.col("left") / F.sum("weight").over(rest)).alias("level")))
    s = s.withColumn("free", free)
    level = F.first("free", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))["level"]
    s = s.withColumn("level", level)
    return s.select("source", "source_size", "weight", F.least(F.col("limit"), F.col("weight") * F.col("level")).alias("target"))


def apportion(votes: DataFrame, vote: str, seats: str, by: list[str], tie: list[str]) -> DataFrame:
    """`quota`: Sainte-Lague seats of each row, with `seats` seats in each group `by`.

    Divisors a little above and below total/seats bound each row's seats, since rounding
    errs by at most half a seat a row; only the quotients between are ranked."""
    group = Window.partitionBy(*by)
    v = votes.withColumn("_n", F.count(F.lit(1)).over(group)).withColumn("_all", F.sum(vote).over(group))
    share = F.col(vote) / F.col("_all")
    floor = F.greatest(F.lit(0), F.floor(share * (F.col(seats) - F.col("_n") / 2 - 1) + 0.5)).cast("long")
    ceil = F.floor(share * (F.col(seats) + F.col("_n") / 2 + 1) + 1.5).cast("long")
    v = v.withColumn("_low", F.when(F.col("_all") > 0, floor).otherwise(0)).withColumn("_high", F.when(F.col("_all") > 0, ceil).otherwise(0))
    v = v.withColumn("_open", F.col(seats) - F.sum("_low").over(group))
    q = v.where((F.col("_high") > F.col("_low")) & (F.col(vote) > 0)).withColumn("_k", F.explode(F.sequence("_low", F.col("_high") - 1)))
    rank = Window.partitionBy(*by).orderBy((F.col(vote) / (2 * F.col("_k") + 1)).desc(), *(F.col(c).asc_nulls_last() for c in tie))
    q = q.withColumn("_rank", F.row_number().over(rank)).where("_rank <= _open")
    keys = [*by, *tie]
    won = q.groupBy(*keys).agg(F.count(F.lit(1)).alias("_won"))
    return _same(v, won, keys).select(*votes.columns, (F.col("_low") + F.coalesce("_won", F.lit(0))).alias("quota"))


def mix(docs: DataFrame, most: int = MOST, blocks: int = BLOCKS, shard_tokens: int = SHARD_TOKENS, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target and taken of every row."""
    d = cut(only(docs, "doc_id", "source", "text").select("doc_id", "source", size_of("text").alias("size")))
    whole = Window.partitionBy()
    s = targets(d.groupBy("source").agg(F.sum("size").alias("source_size")), most)
    s = s.withColumn("block", F.greatest(F.lit(1), F.floor(F.sum("source_size").over(whole) / blocks)).cast("long"))
    s = s.withColumn("seats", F.round(F.sum("target").over(whole) / F.col("block")).cast("long")).withColumn("g", F.lit(0))
    s = apportion(s, "target", "seats", ["g"], ["source"])
    # A source whose target is a few blocks only gets its target in smaller ones.
    few = F.col("target") < FEWEST * F.col("block")
    fine = F.greatest(F.lit(1), F.floor(F.col("target") / FEWEST)).cast("long")
    s = s.withColumn("quota", F.when(few, F.round(F.col("target") / fine).cast("long")).otherwise(F.col("quota"))).withColumn("block", F.when(few, fine).otherwise(F.col("block")))
    n_shards = F.least(F.lit(MAX_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_tokens)))
    s = cut(s.select(F.col("source").alias("of"), "source_size", "target", "block", F.col("quota").alias("seats"), n_shards.alias("n_shards")))
    small = F.broadcast(s) if s.count() <= FEW_SOURCES else s
    d = d.join(small, d["source"].eqNullSafe(s["of"])).withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id", "size"), F.col("n_shards")))

    shards = d.groupBy("of", "shard", "block", "seats").agg(F.sum("size").alias("shard_size"))
    shards = apportion(shards, "shard_size", "seats", ["of"], ["shard"])
    want = F.least(F.col("quota") * F.col("block"), most * F.col("shard_size"))
    shards = shards.withColumn("passes", F.when(F.col("shard_size") > 0, F.floor(want / F.col("shard_size"))).otherwise(0))
    shards = cut(shards.withColumn("rest", want - F.col("passes") * F.col("shard_size")))

    n_blocks = F.ceil(F.col("shard_size") / F.col("block"))
    picks = shards.where("shard_size > 0").withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks - 1)))
    picks = picks.withColumn("tokens", F.least(F.col("block"), F.col("shard_size") - F.col("b") * F.col("block")))
    seeded = Window.partitionBy("of", "shard").orderBy(F.xxhash64(F.lit(seed), "shard", "b"), "b")
    before = F.coalesce(F.sum("tokens").over(seeded.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    picks = picks.withColumn("take", F.greatest(F.lit(0), F.least(F.col("tokens"), F.col("rest") - before)))
    ordered = Window.partitionBy("of", "shard").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    picks = picks.select("of", "shard", "b", "take", F.coalesce(F.sum("take").over(ordered), F.lit(0)).alias("taken_before"))

    # Tokens taken before a document's end, from the block in which it ends; the document has what this adds.
    place = Window.partitionBy("of", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("end", F.sum("size").over(place)).withColumn("b", F.floor((F.col("end") - 1) / F.col("block")))
    d = _same(d, picks, ["of", "shard", "b"])
    until = F.coalesce(F.col("taken_before") + F.least(F.col("take"), F.col("end") - F.col("b") * F.col("block")), F.lit(0))
    d = d.withColumn("until", until)
    by_end = Window.partitionBy("of", "shard").orderBy("end", F.col("size").desc())
    d = d.withColumn("part", F.col("until") - F.coalesce(F.lag("until").over(by_end), F.lit(0)))
    d = _same(d, shards.select("of", "shard", "passes"), ["of", "shard"])
    taken = F.when(F.col("size") > 0, F.col("passes") * F.col("size") + F.col("part")).otherwise(0).cast("long")
    return d.select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Left join on equal keys, where null equals null."""
    right = right.select(*(F.col(c).alias(f"_{c}") if c in keys else F.col(c) for c in right.columns))
    on = F.lit(True)
    for c in keys:
        on = on & left[c].eqNullSafe(right[f"_{c}"])
    return left.join(right, on, "left").drop(*(f"_{c}" for c in keys))
