"""Mixing sources to target weights by Sainte-Lague apportionment, in DataFrame functions only.

Targets: sources in code-point order (null last) weigh ``weights``, repeating, and share ``share`` of all words; a target stops at
``max_repeats`` times its source's size and the excess is reshared by weight. Blocks of ``block`` words go to sources by highest quotients
target/(2k+1), then, within each source, to its shards by highest quotients size/(2k+1). A shard is a hash-dealt part of a source of about
``shard_words`` words, so a source with a third of all rows is many shards and no window grows with it.

In a shard, documents stand in a seeded hash order and form an endless stream; its quota of equal blocks is read from a seeded block
onwards, which takes whole epochs and a last part. ``taken`` is how many of a document's words that covers, repeats counted.

Edge cases: null and empty texts have size 0 and are never taken; repeated rows stand next to each other in the order and may get different shares, so
the multiset of results is the same in every run; rows without an id are dealt by their texts, so many of them are many shards; a source without words has target 0; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from kgspark.llm._common import cut

WEIGHTS, MAX_REPEATS, SHARE, BLOCK, SHARD_WORDS, SEED = (5, 2, 1), 3, 1.0, 16, 1_000_000, 42


def _size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS, share: float = SHARE) -> DataFrame:
    """(source, source_size, weight, target) from (source, source_size): water-filling in closed form.

    In order of cap/weight a source is capped as long as its cap is below its weight's part of what earlier caps leave.
    The table has one row a source, so windows without a partition see sources only.
    """
    order = W.orderBy(F.col("source").isNull(), "source")
    everyone = W.partitionBy()
    cap_order = [F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source")]
    before = W.orderBy(*cap_order).rowsBetween(W.unboundedPreceding, -1)
    onward = W.orderBy(*cap_order).rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w).cast("bigint") for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.col("source_size") * F.lit(max_repeats)).withColumn("whole", F.sum("source_size").over(everyone) * F.lit(share))
    level = (F.col("whole") - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(onward)
    found = ranked.withColumn("level", level).withColumn("capped", F.col("cap") <= F.col("level") * F.col("weight"))
    # the level of the first source that isn't capped holds for all of them
    found = found.withColumn("free", F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), F.col("source").isNull(), F.col("source"), F.col("level")))).over(everyone))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("free.level") * F.col("weight"))
    return found.select("source", "source_size", "weight", target.cast("double").alias("target"))


def apportion(parts: DataFrame, group: list[str], weight: str, seats: str, order: list[Column]) -> DataFrame:
    """Add ``quota``: Sainte-Lague seats of each row within its group. ``seats`` is a column, the same in all rows of a group.

    Seats up to the divisor that can't overshoot are given at once; at most one a row remains on average, and these go
    to the highest quotients, of which each row offers no more than it can still win.
    """
    whole = W.partitionBy(*group)
    base = parts.withColumn("_w", F.sum(weight).over(whole).cast("double")).withColumn("_n", F.count("*").over(whole))
    got = F.when(F.col("_w") > 0, F.floor(F.col(weight) * F.greatest(F.col(seats) - F.col("_n") / 2, F.lit(0)) / F.col("_w") + 0.5)).otherwise(F.lit(0)).cast("bigint")
    got = F.when(F.col(seats) * 2 <= F.col("_n"), F.lit(0).cast("bigint")).otherwise(got)
    base = base.withColumn("_got", got).withColumn("_left", F.col(seats) - F.sum("_got").over(whole))
    more = F.when(F.col("_w") > 0, F.least(F.col("_left"), F.ceil(F.col("_n") * F.col(weight) / F.col("_w")) + 1)).otherwise(F.lit(0))
    offers = base.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(more, F.lit(0)).cast("bigint"))))
    quotient = F.when(F.col("_k") > 0, F.col(weight) / (2 * (F.col("_got") + F.col("_k") - 1) + 1))
    rank = F.row_number().over(W.partitionBy(*group).orderBy(quotient.desc_nulls_last(), *order, "_k"))
    won = offers.withColumn("_q", quotient).withColumn("_won", F.when(F.col("_k") > 0, (rank <= F.col("_left")) & (F.col("_q") > 0)).otherwise(F.lit(False)))
    return won.groupBy(*parts.columns, "_got").agg(F.sum(F.col("_won").cast("bigint")).alias("_more")).select(*parts.columns, (F.col("_got") + F.col("_more")).alias("quota"))


def mix(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, max_repeats: int = MAX_REPEATS,
    share: float = SHARE, block: int = BLOCK, shard_words: int = SHARD_WORDS, seed: int = SEED,
) -> DataFrame:
    """Per row: ``doc_id, source, size, source_size, target, taken`` and ``th`` (a hash of the text, to tell rows of one id apart)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), _size(F.col(text)).alias("size"), F.xxhash64(F.col(text)).alias("th"))
    rows = cut(rows.withColumn("key", F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null:"), F.col("th").cast("string")))))), "sized")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, weights, max_repeats, share)
    targets = targets.withColumn("seats", F.floor(F.sum("target").over(W.partitionBy()) / block).cast("bigint")).withColumn("all", F.lit(1))
    quotas = apportion(targets, ["all"], "target", "seats", [F.col("source").isNull(), F.col("source")])
    quotas = quotas.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("bigint"))
    quotas = cut(quotas.select(F.col("source").alias("s"), "source_size", "target", F.col("quota").alias("blocks"), "shards"), "quotas")
    dealt = rows.join(quotas, rows.source.eqNullSafe(quotas.s)).withColumn("shard", F.pmod(F.conv(F.substring("key", 1, 8), 16, 10).cast("bigint"), F.col("shards")))
    shards = dealt.groupBy("source", "shard", "blocks").agg(F.sum("size").alias("shard_size"))
    shards = apportion(shards, ["source"], "shard_size", "blocks", [F.col("shard")])
    # a shard's stream is read max_repeats times at most; where rounding would pass that, its last block is left out
    shards = shards.select(F.col("source").alias("s2"), F.col("shard").alias("n2"), "shard_size", F.least(F.col("quota"), F.floor(F.col("shard_size") * max_repeats / block)).alias("quota"))
    shards = cut(shards, "shards")
    inside = W.partitionBy("source", "shard").orderBy("key", "size", "th").rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = dealt.withColumn("stop", F.sum("size").over(inside)).join(shards, dealt.source.eqNullSafe(shards.s2) & (F.col("shard") == F.col("n2")))
    words = F.col("quota") * block
    start = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce("source", F.lit("")), F.col("shard").cast("string"))), 1, 8), 16, 10).cast("bigint"), F.greatest(F.floor(F.col("shard_size") / block), F.lit(1))) * block
    placed = placed.withColumn("first", F.col("stop") - F.col("size")).withColumn("a", start)
    placed = placed.withColumn("epochs", F.when(F.col("shard_size") > 0, F.floor(words / F.col("shard_size"))).otherwise(F.lit(0))).withColumn("z", F.col("a") + words - F.col("epochs") * F.col("shard_size"))
    overlap = lambda lo, hi: F.greatest(F.least(F.col("stop"), hi) - F.greatest(F.col("first"), lo), F.lit(0))
    taken = F.col("epochs") * F.col("size") + overlap(F.col("a"), F.least(F.col("z"), F.col("shard_size"))) + overlap(F.lit(0), F.col("z") - F.col("shard_size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", taken.cast("bigint").alias("taken"), "th")
