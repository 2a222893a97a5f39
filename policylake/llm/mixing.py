"""Mixing sources to target weights by Pfair scheduling.

Each source is put in a pseudo-random order and cut into blocks of about ``block_chars`` characters. With weight w,
block j (from 0) is released at slot floor(j / w) and due by slot ceil((j + 1) / w). Earliest deadline first over the
released blocks gives one block per slot, and after every slot each source is less than one block off its share. With
weights a / A for whole a, windows repeat every A slots, so one cycle is scheduled, by running sums over halves of it,
and every other block's slot follows by arithmetic: the schedule grows with the number of sources, not with their rows.

When a source has no more blocks its slots stay empty, and the others go on: no row is dropped or repeated.

Defined cases: a null source is a source of its own; null or empty text counts one character; a document longer than
a block fills the following blocks of its source too; sources without a target get the smallest share, as do weights
that are null, negative or not finite; weights given twice for a source add up; equal rows may swap places; an empty table gives no rows. Output columns replace input columns of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake.llm._links import stored

BLOCK_CHARS = 65536
CYCLE = 1000
#: Without given weights a source's weight is its size to this power.
POWER = 0.5
#: Ranks within a source are taken in so many parts at least, and in parts of about so many characters in larger sources.
BUCKETS = 1024
BUCKET_CHARS = 64_000_000
#: Halvings of the cycle between two stored steps.
LEVELS = 6


def natural_weights(docs: DataFrame, power: float = POWER, source: str = "source", text: str = "text") -> DataFrame:
    """(source, weight): the share of each source in characters, raised to ``power`` to flatten large ones."""
    return docs.groupBy(F.col(source).alias("source")).agg(F.sum(_chars(F.col(text))).alias("_n")) \
        .select("source", _flat("_n", power).alias("weight"))


def _flat(chars: str, power: float) -> Column:
    return F.pow(F.col(chars).cast("double"), F.lit(power))


def _chars(text: Column) -> Column:
    return F.greatest(F.coalesce(F.length(text), F.lit(0)), F.lit(1)).cast("long")


def pfair_cycle(weights: DataFrame, cycle: int = CYCLE) -> DataFrame:
    """(source, share, period, turn, slot): the slot of each source's turn-th block within one period.

    Weights are rounded to whole shares of about ``cycle`` slots, at least one each; the period is their sum.
    A block runs in the first slot from its release on that no block of higher rank takes, ranks being by deadline. So
    the slots of the higher half of ranks don't depend on the lower half: they are those at which a queue of the
    higher half's released blocks isn't empty. Ranks and slots are halved together until one block has one slot. Every
    halving is one running sum per part, so work is the period times its logarithm, and parts go to different tasks.
    """
    weight = F.col("weight").cast("double")
    sane = F.when((weight > 0) & (weight < float("inf")), weight).otherwise(F.lit(0.0))
    given = stored(weights.groupBy("source").agg(F.sum(sane).alias("weight")), "weights")
    total = given.agg(F.sum("weight")).first()[0] or 1.0
    share = F.greatest(F.lit(1), F.round(F.col("weight") / F.lit(total) * cycle).cast("long"))
    shares = given.select("source", share.cast("long").alias("share"))
    period = shares.agg(F.sum("share")).first()[0] or 0
    turn = F.col("turn").cast("long")
    blocks = shares.select("source", "share", F.explode(F.expr("sequence(0L, share - 1)")).alias("turn")).select(
        "source", "share", F.lit(period).cast("long").alias("period"), turn.alias("turn"),
        F.expr(f"turn * {period} div share").alias("release"),
        F.expr(f"((turn + 1) * {period} + share - 1) div share").alias("due"))
    rank = F.row_number().over(Window.orderBy("due", F.desc("share"), F.desc_nulls_last("source"), "turn")) - 1
    ranked = stored(blocks.withColumn("rank", rank.cast("long")), "blocks")
    # As many slots as blocks: every block also stands for the slot of its rank's number.
    rows = ranked.select(F.explode(F.array(
        F.struct(F.lit(True).alias("slot"), F.col("rank").alias("at"), F.lit(None).cast("long").alias("rank")),
        F.struct(F.lit(False).alias("slot"), F.col("release").alias("at"), F.col("rank"))
    )).alias("x")).select(F.lit(0).cast("long").alias("part"), "x.*")
    for bit in reversed(range(max(period - 1, 0).bit_length())):
        so_far = Window.partitionBy("part").orderBy("at", "slot").rowsBetween(Window.unboundedPreceding, 0)
        before = so_far.rowsBetween(Window.unboundedPreceding, -1)
        low = F.shiftright("rank", bit).bitwiseAND(F.lit(1))  # of a block: whether it is in the lower half
        rows = rows.withColumn("queue", F.sum(F.when(F.col("slot"), -1).otherwise(1 - low)).over(so_far)) \
            .withColumn("least", F.least(F.lit(0), F.min(F.when(F.col("slot"), F.col("queue"))).over(before)))
        idle = (F.col("queue") < F.col("least")).cast("long")
        rows = rows.select((F.col("part") * 2 + F.when(F.col("slot"), idle).otherwise(low)).alias("part"), "slot", "at", "rank")
        if bit % LEVELS == LEVELS - 1:
            rows = stored(rows, "halves")
    placed = rows.where("slot").select(F.col("part").alias("rank"), F.col("at").alias("slot"))
    return ranked.join(placed, "rank").select("source", "share", "period", "turn", "slot")


def mix_sources(docs: DataFrame, weights: DataFrame | None = None, block_chars: int = BLOCK_CHARS,
                cycle: int = CYCLE, buckets: int | None = None, source: str = "source", text: str = "text",
                key: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` with mix_block, mix_slot and mix_offset; reading by (mix_slot, mix_offset) is the mixture.

    Ranks within a source are taken in two steps, sums per hash bucket and a window inside a bucket, so a source that
    holds a third of all rows is spread over ``buckets`` windows; by default their number follows the largest source.
    """
    own = {"mix_block", "mix_slot", "mix_offset"}
    kept = [c for c in docs.columns if c not in own]
    sources = stored(docs.groupBy(F.col(source).alias("source")).agg(F.sum(_chars(F.col(text))).alias("_n")), "sources")
    if buckets is None:
        buckets = max(BUCKETS, (sources.agg(F.max("_n")).first()[0] or 0) // BUCKET_CHARS)
    order = F.xxhash64(F.coalesce(F.col(key).cast("string"), F.lit("")))
    bucket = F.pmod(order, F.lit(buckets))
    narrow = docs.select(F.col(source).alias("_s"), bucket.alias("_b"), _chars(F.col(text)).alias("_n"))
    sums = narrow.groupBy("_s", "_b").agg(F.sum("_n").alias("_n"))
    before = Window.partitionBy("_s").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("_s").alias("_os"), F.col("_b").alias("_ob"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    if weights is None:
        targets = sources.select("source", _flat("_n", POWER).alias("weight"))
    else:
        known = weights.select(F.col("source").alias("_w"), "weight")
        targets = sources.join(known, F.col("source").eqNullSafe(F.col("_w")), "left").select("source", "weight")
    plan = stored(pfair_cycle(targets, cycle), "cycle")
    inside = Window.partitionBy("_s", "_b").orderBy("_o", F.col(f"_row.`{key}`"), "_n") \
        .rowsBetween(Window.unboundedPreceding, -1)
    # The input's columns travel in a struct, where their names can't clash.
    placed = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("_row"), F.col(source).alias("_s"),
                         bucket.alias("_b"), order.alias("_o"), _chars(F.col(text)).alias("_n")) \
        .withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0))) \
        .join(offsets, F.col("_s").eqNullSafe(F.col("_os")) & (F.col("_b") == F.col("_ob"))) \
        .withColumn("_start", F.col("_base") + F.col("_inside")) \
        .withColumn("_block", F.floor(F.col("_start") / F.lit(block_chars)).cast("long"))
    sizes = plan.select(F.col("source").alias("_ps"), "share", "period").distinct()
    turns = plan.select(F.col("source").alias("_ts"), F.col("turn").alias("_turn"), F.col("slot").alias("_slot"))
    timed = placed.join(sizes, F.col("_s").eqNullSafe(F.col("_ps"))) \
        .join(turns, F.col("_s").eqNullSafe(F.col("_ts")) & (F.col("_block") % F.col("share") == F.col("_turn")))
    return timed.select(
        *(F.col(f"_row.`{c}`").alias(c) for c in kept), F.col("_block").alias("mix_block"),
        (F.floor(F.col("_block") / F.col("share")).cast("long") * F.col("period") + F.col("_slot")).alias("mix_slot"),
        (F.col("_start") % F.lit(block_chars)).alias("mix_offset"))


def in_order(mixed: DataFrame) -> DataFrame:
    """Ranges of the mixture, each sorted, ready to be written as ordered files."""
    return mixed.repartitionByRange("mix_slot", "mix_offset").sortWithinPartitions("mix_slot", "mix_offset")
