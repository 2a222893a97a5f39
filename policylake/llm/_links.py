"""Connected groups of items that share buckets, without all pairs of a bucket.

``grouped`` takes buckets (the candidates: two items may be linked only if they share one) and a function that tests
pairs. It works in rounds. Each round picks pivots in every bucket that still holds more than one group, tests them
against the members of *other* groups only, and merges groups along the links found. Pivots are the members whose hash
lies in a share of the hash space that grows sixteenfold per round, relative to the bucket's size, until every member has
been one; so all pairs of a bucket that aren't known to be connected get tested in the end, whatever its size, while a
bucket of thousands of alike items is settled by a few pivots. With ``foremost`` every member meets one pivot of a round
first, the one that meets most members over all buckets; its other pairs are tested after that, if still between groups.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from policylake.session import shared_dir


#: Growth of the number of pivots in a bucket per round.
GROWTH = 16


def stored(df: DataFrame, name: str = "step") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, and is there if an executor is lost."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """A stored narrow table, marked for broadcast if it is counted to be at most ``rows``; else joined by shuffles."""
    return F.broadcast(df) if df.count() <= rows else df


def partnered(shared: DataFrame, condition: str, few: int = 256) -> DataFrame:
    """Of rows (bucket, id, n, ...), those in a bucket of more than ``few``, and those with a partner by ``condition``.

    Chance meetings fill small buckets; there all pairs are looked at, as they are bounded. condition: on p and m.
    """
    little = shared.where(F.col("n") <= few)
    met = little.alias("p").join(little.alias("m"), F.expr(f"p.bucket = m.bucket and p.id <> m.id and {condition}"), "left_semi")
    return met.unionByName(shared.where(F.col("n") > few)).drop("n")


def _is_forest_of_stars(edges: DataFrame) -> bool:
    """Whether every u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("root")).union(
        edges.select("v", F.lit(0), F.lit(1)))
    return is_empty(ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("root").alias("root")).where(
        "out > 1 or (out = 1 and root = 1)"))


def connected(links: DataFrame) -> DataFrame:
    """(id, least): the least id reachable by links (a, b); ids that are least themselves are left out.

    Alternating stars: every node's larger neighbours are hung on its least neighbour, then its smaller ones, until
    the links are a forest of stars; a logarithmic number of rounds, each an aggregate and a join.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = stored(edges, "edges")
    while not _is_forest_of_stars(edges):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v")
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        hung = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v") \
            .union(down.select("u", F.col("m").alias("v"))).distinct()
        edges = stored(hung, "edges")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("least"))


def _apart(links: DataFrame, groups: DataFrame | None) -> DataFrame:
    """The links (a, b) between groups, with ga and gb, the groups of their ends."""
    if groups is None:
        return links.withColumns({"ga": F.col("a"), "gb": F.col("b")})
    left = small(groups).select(F.col("id").alias("a"), F.col("least").alias("ga"))
    right = small(groups).select(F.col("id").alias("b"), F.col("least").alias("gb"))
    return links.join(left, "a", "left").join(right, "b", "left").select(
        "a", "b", F.coalesce("ga", "a").alias("ga"), F.coalesce("gb", "b").alias("gb")).where("ga <> gb")


def _merged(groups: DataFrame | None, links: DataFrame) -> DataFrame | None:
    """The groups (id, least) after links between their members."""
    found = stored(_apart(links, groups).select(F.col("ga").alias("a"), F.col("gb").alias("b")).distinct(), "links")
    if is_empty(found):
        return groups
    moved = connected(found)
    if groups is None:
        return moved
    # Groups' heads that moved take their members along.
    heads = moved.select(F.col("id").alias("least"), F.col("least").alias("new"))
    kept = groups.join(small(heads), "least", "left").select("id", F.coalesce("new", "least").alias("least"))
    return stored(kept.unionByName(moved), "groups")


def grouped(spark: SparkSession, buckets: DataFrame, tested: Callable[[DataFrame], DataFrame],
            comparable: str = "true", hint: str | None = None, foremost: bool = False) -> DataFrame:
    """(id, least) for every id in a bucket with others that is linked to a smaller one, over any number of links.

    buckets: (bucket, id) and more, stored. tested: from stored pairs (a, b) to those that are linked. comparable: a
    condition on the columns of pivot p and member m, which linked pairs meet in a bucket they share. hint: a condition
    choosing a few buckets per id with which to begin; it decides the work, never the result.
    """
    groups: DataFrame | None = None
    rounds = 0
    first = hint is not None
    while True:
        level = buckets.where(hint) if first else buckets
        if groups is None:
            member = level.withColumn("g", F.col("id"))
        else:
            member = level.join(small(groups).withColumnRenamed("least", "g"), "id", "left") \
                .withColumn("g", F.coalesce("g", "id"))
        state = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head"),
                                             F.min("g").alias("low"), F.max("g").alias("high"))
        # A bucket of at most GROWTH ** (rounds - 1) members is settled: each has been a pivot.
        open_ = state.where("low <> high").where(F.col("n") > (GROWTH ** (rounds - 1) if rounds else 1))
        live = stored(member.join(open_.drop("low", "high"), "bucket"), "live")
        if is_empty(live):
            if not first:
                break
            first = False
            continue
        if rounds == 0:
            pivots = live.where("id = head")
        else:
            # The share of pivots grows; those of earlier rounds were tested against all other groups.
            spot = F.shiftrightunsigned(F.xxhash64("id"), 32).cast("double") / F.lit(float(2 ** 32))
            pivots = live.where((spot * F.col("n") < float(GROWTH ** rounds))
                                & (spot * F.col("n") >= (float(GROWTH ** (rounds - 1)) if rounds > 1 else 0.0)))
        p, m = pivots.alias("p"), live.alias("m")
        met = p.join(m, F.expr(f"p.bucket = m.bucket and p.g <> m.g and {comparable}")).select(
            F.col("p.id").alias("p"), F.col("m.id").alias("m")).distinct()
        met = stored(met, "met") if foremost else met
        if foremost and is_empty(met):
            first, rounds = False, rounds if first else rounds + 1
            continue
        others = met.select(F.least("p", "m").alias("a"), F.greatest("p", "m").alias("b")).distinct()
        if foremost:
            # What the first pivot links is one group, and its members' other pairs needn't be tested.
            busy = met.groupBy("p").agg(F.count(F.lit(1)).alias("n"))
            tried = stored(met.join(busy, "p").groupBy("m").agg(F.max(F.struct("n", "p")).alias("f")).select(
                F.least("m", "f.p").alias("a"), F.greatest("m", "f.p").alias("b")).distinct(), "pairs")
            groups = _merged(groups, tested(tried).select("a", "b"))
            others = _apart(others.join(tried, ["a", "b"], "left_anti"), groups).select("a", "b")
        rest = stored(others, "pairs")
        if not foremost or not is_empty(rest):
            groups = _merged(groups, tested(rest).select("a", "b"))
        if first:
            first = False
        else:
            rounds += 1
    if groups is None:
        kind = buckets.schema["id"].dataType.simpleString()
        return spark.createDataFrame([], f"id {kind}, least {kind}")
    return groups
