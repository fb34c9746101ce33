"""Mixing sources to target weights, with DataFrame functions only.

The words of a source, document after document in a hashed order, are packed into
blocks of a fixed length. A source's target (its weight's share of all words, at most
``cap`` times its own) makes a quota of blocks. Every output shard has the same number
of slots and draws how many of them each source gets from the multinomial
distribution of the quotas. A source numbers its slots through the shards; number r
stands for entry ``r mod n`` of a pseudorandom permutation of the source's n blocks,
a fresh one for every round through them. Joining slots and blocks by that index gives
the mix. Draws above a source's quota pass to the sources that drew too few, so
every quota is met exactly and no block is taken more than ``cap`` times, rounded up.

Everything is a function of the rows and the seed: reruns and lost tasks give the
same mix. Sums over a source run in two steps (parts, then within a part), so that a
source with a third of all rows is no single window. Only the list of sources, a row
of a few numbers each, is ordered as a whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cirrus.llm.storage import write_table

WORD = r"[^\x20\x09-\x0D]+"
#: Parts into which a source's documents are dealt for their running sums.
PARTS = 4096
#: Shards whose slots are summed together first.
SHARDS_TOGETHER = 1024
#: An interval of numbers is found by the stretch of so many numbers that it touches.
STRETCH = 64
#: Rounds of the swap-or-not shuffle.
ROUNDS = 24


@dataclass(frozen=True)
class Mix:
    """``documents`` (id, source_no, size, source_size, target, start): a row for each
    row of the input, ``start`` the place of its first word in its source.
    ``sources`` (source_no, source_size, target, quota, blocks, first).
    ``slots`` (shard, slot, source_no, epoch, block): the mix, a block a slot."""
    documents: DataFrame
    sources: DataFrame
    slots: DataFrame
    block_words: int


def n_words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _hash(*parts: Column | int) -> Column:
    return F.xxhash64(*[(p if isinstance(p, Column) else F.lit(p)).cast("long") for p in parts])


def _targets(sizes: DataFrame, weights: tuple[int, ...], cap: int, block_words: int) -> DataFrame:
    """Sources with their targets. In order of cap to weight, a source is full if its
    share of what the ones before leave is no less than its cap; the others divide
    the rest by weight, which is where resharing the excess again and again ends."""
    everything = Window.partitionBy()
    by_name = Window.orderBy("source_key")
    listed = sizes.select(
        "source_key", "source_size",
        (F.row_number().over(by_name) - 1).cast("long").alias("source_no"),
        F.sum("source_size").over(everything).cast("decimal(20,0)").alias("total"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    listed = listed.select("*", weight.cast("decimal(10,0)").alias("weight"),
                           (F.col("source_size") * cap).cast("decimal(20,0)").alias("most"))
    before = Window.orderBy(F.col("most") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    none = F.lit(0).cast("decimal(20,0)")
    left = F.col("total") - F.coalesce(F.sum("most").over(before), none)
    others = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), none)
    listed = listed.select("*", (F.col("most").cast("double") * others.cast("double")
                                 <= F.col("weight").cast("double") * left.cast("double")).alias("full"))
    rest = (F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))).over(everything), none)).cast("double")
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(everything).cast("double")
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(rest * F.col("weight").cast("double") / open_weight)
    blocks = F.ceil(F.col("source_size") / block_words)
    out = listed.select("source_key", "source_no", "source_size", target.alias("target"), blocks.cast("long").alias("blocks"))
    quota = F.when(F.col("source_size") > 0, F.round(F.col("target") / F.col("source_size") * F.col("blocks"))).otherwise(0)
    out = out.select("*", quota.cast("long").alias("quota"))
    return out.select("*", (F.sum("quota").over(Window.orderBy("source_no")) - F.col("quota")).alias("first"))


def _stretches(intervals: DataFrame, first: str, length: str) -> DataFrame:
    """``intervals`` once for each stretch of numbers that [first, first + length)
    touches, in two steps, so that no array is long."""
    wide = STRETCH << 14
    last = F.col(first) + F.col(length) - 1
    some = intervals.where(F.col(length) > 0).select("*", F.explode(F.sequence(
        (F.col(first) / wide).cast("long"), (last / wide).cast("long"))).alias("_wide"))
    low = F.greatest(F.col(first), F.col("_wide") * wide)
    high = F.least(last, F.col("_wide") * wide + (wide - 1))
    return some.select("*", F.explode(F.sequence((low / STRETCH).cast("long"), (high / STRETCH).cast("long")))
                       .alias("_stretch")).drop("_wide")


def _find(numbers: DataFrame, number: str, intervals: DataFrame, first: str, length: str) -> DataFrame:
    """``numbers`` joined with the interval that holds each."""
    sought = numbers.withColumn("_stretch", (F.col(number) / STRETCH).cast("long"))
    inside = (F.col(number) >= F.col(first)) & (F.col(number) < F.col(first) + F.col(length))
    return sought.join(_stretches(intervals, first, length), "_stretch").where(inside).drop("_stretch")


def _permuted(index: Column, n: Column, seed: int, *key: Column) -> Column:
    """Entry ``index`` of a pseudorandom permutation of 0 .. n - 1 (swap or not: a
    round pairs x with k - x mod n and swaps the pair by a bit that both see)."""
    def swap(x: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(_hash(seed, *key, r, 0), n) - x, n)
        flip = _hash(seed, *key, r, 1, F.greatest(x, other)).bitwiseAND(F.lit(1)) == 1
        return F.when(flip, other).otherwise(x)
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), index.cast("long"), swap)


def _draw(sources: DataFrame, quota: int, shard_slots: int, seed: int) -> DataFrame:
    """(source_no, shard, drawn, before): how many slots of each shard a source drew
    and how many it drew in the shards before."""
    spark = sources.sparkSession
    draws = spark.range(0, quota).select((F.col("id") / shard_slots).cast("long").alias("shard"),
                                         F.pmod(_hash(seed, F.col("id")), F.lit(quota)).alias("_pick"))
    counts = (_find(draws, "_pick", sources.select("source_no", "first", "quota"), "first", "quota")
              .groupBy("source_no", "shard").agg(F.count(F.lit(1)).alias("drawn")))
    counts, _ = write_table(counts, "mix-draws")
    counts = counts.withColumn("_part", (F.col("shard") / SHARDS_TOGETHER).cast("long"))
    parts = counts.groupBy("source_no", "_part").agg(F.sum("drawn").alias("_sum"))
    earlier = Window.partitionBy("source_no").orderBy("_part")
    parts = parts.select("source_no", "_part", (F.sum("_sum").over(earlier) - F.col("_sum")).alias("_before"))
    within = Window.partitionBy("source_no", "_part").orderBy("shard")
    return counts.join(parts, ["source_no", "_part"]).select(
        "source_no", "shard", "drawn",
        (F.col("_before") + F.sum("drawn").over(within) - F.col("drawn")).alias("before"))


def _slots(sources: DataFrame, quota: int, shard_slots: int, seed: int) -> DataFrame:
    """The slots with the source and the number in the source (``rank``) of each."""
    drawn = _draw(sources, quota, shard_slots, seed)
    all_drawn = drawn.groupBy("source_no").agg(F.sum("drawn").alias("all_drawn"))
    state = sources.join(all_drawn, "source_no", "left").select(
        "source_no", "quota", "blocks", F.coalesce("all_drawn", F.lit(0)).alias("all_drawn"))
    over, short = F.greatest(F.col("all_drawn") - F.col("quota"), F.lit(0)), F.greatest(F.col("quota") - F.col("all_drawn"), F.lit(0))
    running = Window.orderBy("source_no")
    state = state.select("*", over.alias("over"), short.alias("short"))
    state = state.select("*", (F.sum("over").over(running) - F.col("over")).alias("over_before"),
                         (F.sum("short").over(running) - F.col("short")).alias("short_before"))
    state, _ = write_table(state, "mix-state")
    each = drawn.select("source_no", "shard", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("drawn") - 1)).alias("rank"))
    each = each.join(state.select("source_no", "quota", "over_before"), "source_no")
    kept = each.where("rank < quota").select("shard", "source_no", "rank")
    passed = each.where("rank >= quota").select("shard", (F.col("over_before") + F.col("rank") - F.col("quota")).alias("_number"))
    taker = state.select("source_no", "all_drawn", "short", "short_before")
    found = _find(passed, "_number", taker, "short_before", "short").select(
        "shard", "source_no", (F.col("all_drawn") + F.col("_number") - F.col("short_before")).alias("rank"))
    blocks = state.select("source_no", "blocks")
    epoch, index = F.expr("rank div blocks"), F.col("rank") % F.col("blocks")
    placed = kept.unionByName(found).join(blocks, "source_no").select(
        "shard", "source_no", "rank", epoch.alias("epoch"),
        _permuted(index, F.col("blocks"), seed, F.col("source_no"), epoch).alias("block"))
    order = Window.partitionBy("shard").orderBy(_hash(seed, 2, F.col("source_no"), F.col("rank")), "source_no", "rank")
    return placed.select("shard", (F.row_number().over(order) - 1).cast("long").alias("slot"), "source_no", "epoch", "block")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
        weights: tuple[int, ...] = (5, 2, 1), cap: int = 3, block_words: int = 128, shard_slots: int = 4096,
        seed: int = 11) -> Mix:
    """The mix of ``docs``. Sources by code point, null last, take ``weights`` in turn;
    the target sum is the sum of all sizes. Null and empty texts have size 0 and are
    never taken; a null id is an id like any other; rows that repeat are rows of their
    own; an empty table gives no slots. Other columns are ignored."""
    key = F.when(F.col(source_col).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source_col)))
    rows = docs.select(F.col(id_col).alias("id"), key.alias("source_key"), n_words(F.col(text_col)).alias("size"),
                       F.xxhash64(F.col(id_col), F.col(text_col)).alias("_order"))
    rows, _ = write_table(rows.withColumn("_part", F.pmod("_order", F.lit(PARTS))), "mix-documents")
    parts, _ = write_table(rows.groupBy("source_key", "_part").agg(F.sum("size").alias("_sum")), "mix-parts")
    sources, _ = write_table(_targets(parts.groupBy("source_key").agg(F.sum("_sum").alias("source_size")), weights, cap,
                                      block_words), "mix-sources")
    earlier = Window.partitionBy("source_key").orderBy("_part")
    offsets = (parts.select("source_key", "_part", (F.sum("_sum").over(earlier) - F.col("_sum")).alias("_before"))
               .join(sources.select("source_key", "source_no", "source_size", "target"), "source_key"))
    within = Window.partitionBy("source_key", "_part").orderBy("_order", "id", "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(offsets, ["source_key", "_part"]).select(
        "id", "source_no", "size", "source_size", "target",
        (F.col("_before") + F.sum("size").over(within) - F.col("size")).alias("start"))
    placed, _ = write_table(placed, "mix-places")
    quota = sources.agg(F.coalesce(F.sum("quota"), F.lit(0)).alias("quota")).first()["quota"]
    return Mix(placed, sources, _slots(sources, quota, shard_slots, seed), block_words)


def spans(mixed: Mix) -> DataFrame:
    """(shard, slot, source_no, block, id, start, first_word, words): the stretch of
    each document in each slot. ``first_word`` counts from 0 within the document; the
    stretches of a slot, by ``start``, make up its block."""
    n = mixed.block_words
    first, last = F.expr(f"start div {n}"), F.expr(f"(start + size - 1) div {n}")
    pieces = mixed.documents.where("size > 0").select("id", "source_no", "start", "size", F.explode(F.sequence(first, last)).alias("block"))
    begin, end = F.greatest(F.col("start"), F.col("block") * n), F.least(F.col("start") + F.col("size"), (F.col("block") + 1) * n)
    pieces = pieces.select("id", "source_no", "start", "size", "block", (begin - F.col("start")).alias("first_word"),
                           (end - begin).alias("words"))
    return mixed.slots.join(pieces, ["source_no", "block"])


def taken(mixed: Mix) -> DataFrame:
    """(id, size, source_size, target, taken), a row for each row of the input."""
    words = (spans(mixed).groupBy("source_no", "start").agg(F.sum("words").alias("taken")))
    some = mixed.documents.where("size > 0").join(words, ["source_no", "start"], "left")
    none = mixed.documents.where("size = 0").withColumn("taken", F.lit(None).cast("long"))
    columns = ["id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken")]
    return some.select(columns).unionByName(none.select(columns))
