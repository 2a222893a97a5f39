"""Similar and duplicate texts without comparing everything with everything.

Word sets: candidates come from an exact prefix filter: with words ordered from rare to
common, two sets whose overlap reaches ``t`` must share one of their first
``n - ceil(t n) + 1`` words. Character ratios: candidates share a block key that no pair can do without
(``ratio_blocks``). Equal texts are folded first, so a group of copies
is one candidate. Greedy de-duplication then compares against a bounded front of
each block per round, never all pairs of a block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policylake.functions.extract import word_set
from policylake.functions.text import content_hash, let, similarity_text
from policylake.operators.ratio_blocks import GramCounts, histogram, may_match, ratio_blocks, ratio_kind
from policylake.session import checkpointed, computed_once, written


def ratio_from(new: Column, existing: Column, threshold: float) -> Column:
    """Matching-blocks ratio of two texts where it reaches ``threshold``, else null; not symmetric, so the newer text comes first.

    Texts with too few q-grams in common aren't aligned.
    """
    @F.pandas_udf(T.DoubleType())
    def ratios(news: pd.Series, olds: pd.Series) -> pd.Series:
        counts = GramCounts(threshold)
        found = (SequenceMatcher(None, a, b).ratio() if counts.may_reach(a, b) else None for a, b in zip(news, olds))
        return pd.Series([r if r is not None and r >= threshold else None for r in found], dtype="float64")

    return ratios(new, existing)


def jaccard(a: Column, b: Column) -> Column:
    """Word-set overlap; 0 when either set is empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(both / F.greatest(either, F.lit(1)))


def dedupe_rules(rules: Column, text_of: Callable[[Column], Column], threshold: float = 0.85) -> Column:
    """Keep a rule unless its words overlap a kept rule's by more than ``threshold``.

    ``rules`` is one document's array in order, so the scan stays inside the row.
    """
    paired = F.transform(rules, lambda r: F.struct(r.alias("rule"), word_set(text_of(r)).alias("words")))

    def scan(items: Column) -> Column:
        def step(kept: Column, item: Column) -> Column:
            seen = F.exists(kept, lambda k: jaccard(item["words"], k["words"]) > threshold)
            return F.when(seen, kept).otherwise(F.concat(kept, F.array(item)))
        return F.aggregate(items, F.slice(items, 1, 0), step)

    return F.transform(let(paired, scan), lambda k: k["rule"])


# --- candidate blocks --------------------------------------------------------------

#: Slots of word hashes that are counted for the order of words.
SLOT_BITS = 18
#: Longs of a set's parities: those that stand beside each key, and those that pairs are judged by afterwards.
SKETCH, PARITY = [f"s{i}" for i in range(4)], 32
#: Rows of a narrow table that are broadcast at most.
NARROW = 500_000


def _slot_counts(sets: DataFrame) -> np.ndarray:
    """How often words of each slot occur; a table of fixed size."""
    slot = F.shiftrightunsigned("word", 64 - SLOT_BITS).cast("int").alias("slot")
    seen = sets.select(F.explode("words").alias("word")).groupBy(slot).agg(F.count(F.lit(1)).alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[seen["slot"].to_numpy()] = seen["n"].to_numpy()
    return counts


def _parities(hashes: np.ndarray, longs: int) -> np.ndarray:
    """Whether the number of hashes in each of 64 slots a long is odd, a bit a slot; unlike set bits these never fill up."""
    odd = np.bincount((hashes & np.uint64(64 * longs - 1)).astype(np.int64), minlength=64 * longs) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _prefix_blocks(sets: DataFrame, overlap: float) -> DataFrame:
    """(set, size, pos, word, sketch) for the rarest words of each set, enough for ``overlap``; pos: place in the order."""
    counts = _slot_counts(sets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, words in zip(batch.column("set").to_pylist(), batch.column("words")):
                hashes = words.values.to_numpy().view(np.uint64)
                n = len(hashes)
                # A hair below the exact product, so rounding can only lengthen the prefix.
                first = n - ceil(n * overlap - 1e-9) + 1
                order = np.lexsort((hashes, counts[(hashes >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]))[:first]
                sketch = _parities(hashes, len(SKETCH))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(order), x)) for x in (name, n)] + [pa.array(np.arange(len(order))), pa.array(hashes[order].view(np.int64))]
                    + [pa.array(np.full(len(order), x)) for x in sketch], ["set", "size", "pos", "word", *SKETCH])

    return sets.select("set", "words").mapInArrow(run, "set long, size long, pos long, word long, " + ", ".join(f"{c} long" for c in SKETCH))


def _sketches(sets: DataFrame) -> DataFrame:
    """(set, size, parity): the long parities of each set."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [w.values.to_numpy().view(np.uint64) for w in batch.column("words")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("set"), pa.array([len(w) for w in held], pa.int64()),
                 pa.array([_parities(w, PARITY) for w in held], pa.list_(pa.int64()))], ["set", "size", "parity"])

    return sets.select("set", "words").mapInArrow(run, "set long, size long, parity array<long>")


def _may_overlap(differing: Column, na: Column, nb: Column, overlap: float) -> Column:
    """What sizes and sketches do not rule out.

    Sizes far apart cannot reach the overlap, and every bit in which the
    parities differ stands for a word that is not shared. Nothing that reaches
    the overlap is lost.
    """
    sized = (na >= nb * F.lit(overlap) - F.lit(1e-9)) & (nb >= na * F.lit(overlap) - F.lit(1e-9))
    return sized & (differing <= (na + nb) * F.lit((1 - overlap) / (1 + overlap)) + F.lit(1e-9))


def _both_sides(pairs: DataFrame, table: DataFrame, *columns: str) -> DataFrame:
    """The pairs (a, b, ...) with columns of the sets at both ends, named by the end."""
    def side(name: str) -> DataFrame:
        return table.select(F.col("set").alias(name), *[F.col(c).alias(f"{c}_{name}") for c in columns])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def jaccard_pairs(df: DataFrame, id_col: str, text: Column, threshold: float = 0.85,
                  scope: list[str] | None = None) -> DataFrame:
    """Pairs of distinct word sets overlapping by more than ``threshold``.

    One row per pair of sets, named by their smallest ids, with the number of
    members; the members of one set are equal and are not paired. Words are
    compared by 64-bit hashes, which hold the scope, so that sets of two scopes share none.
    Pairs stay narrow until the long parities have ruled out those that aren't alike.
    """
    scope = scope or []
    scoped = df.where(" and ".join(f"`{c}` is not null" for c in scope)) if scope else df
    hashes = F.array_sort(F.array_distinct(F.transform(word_set(text), lambda w: F.xxhash64(*scope, w))))
    worded = computed_once(scoped.withColumn("_set", F.monotonically_increasing_id()), "_words", hashes).where(F.size("_words") > 0)
    rows = written(worded.select(*scope, F.col(id_col).alias("_id"), F.col("_set").alias("set"), F.col("_words").alias("words"),
                                 F.md5(F.array_join(F.col("_words").cast("array<string>"), " ")).alias("key")), "words")
    named = written(rows.groupBy(*scope, "key").agg(
        F.min("_id").alias("sid"), F.min("set").alias("set"), F.count("*").alias("members")).drop("key"), "sets")
    kept = named.select("set")
    sets = written(rows.select("set", "words").join(F.broadcast(kept) if kept.count() <= NARROW else kept, "set", "left_semi"), "distinct")
    blocks = written(_prefix_blocks(sets, threshold), "blocks")

    def end(name: str) -> DataFrame:
        return blocks.select("word", *[F.col(c).alias(f"{c}_{name}") for c in ("set", "size", "pos", *SKETCH)])
    differing = F.lit(0)
    for c in SKETCH:
        differing = differing + F.bit_count(F.col(f"{c}_a").bitwiseXOR(F.col(f"{c}_b")))
    # The first common word leaves at most the shorter rest to be shared.
    rest = F.least(F.col("size_a") - F.col("pos_a"), F.col("size_b") - F.col("pos_b"))
    enough = rest >= (F.col("size_a") + F.col("size_b")) * F.lit(threshold / (1 + threshold)) - F.lit(1e-9)
    candidates = written(end("a").join(end("b"), "word").where(
        (F.col("set_a") < F.col("set_b")) & enough & _may_overlap(differing, F.col("size_a"), F.col("size_b"), threshold)).select(
        F.col("set_a").alias("a"), F.col("set_b").alias("b")).distinct(), "candidates")
    judged = _both_sides(candidates, written(_sketches(sets), "sketches"), "size", "parity")
    differing = F.expr(" + ".join(f"bit_count(parity_a[{i}] ^ parity_b[{i}])" for i in range(PARITY)))
    hopeful = written(judged.where(_may_overlap(differing, F.col("size_a"), F.col("size_b"), threshold)).select("a", "b", "size_a", "size_b"), "hopeful")
    met = _both_sides(hopeful, sets, "words").withColumn("both", F.size(F.array_intersect("words_a", "words_b")))
    scored = written(met.withColumn("similarity", F.col("both") / (F.col("size_a") + F.col("size_b") - F.col("both"))).where(
        F.col("similarity") > threshold).select("a", "b", "similarity"), "scored")
    ends = _both_sides(scored, named, "sid", "members", *scope).where("sid_a <> sid_b")
    first = F.col("sid_a") < F.col("sid_b")
    return ends.select(*[F.col(f"{c}_a").alias(c) for c in scope], F.least("sid_a", "sid_b").alias("a"), F.greatest("sid_a", "sid_b").alias("b"),
                       *[F.when(first, F.col(f"members_{x}")).otherwise(F.col(f"members_{y}")).alias(f"members_{n}")
                         for n, x, y in (("a", "a", "b"), ("b", "b", "a"))], "similarity")


# --- ratio of matching characters ------------------------------------------------------

def _live(rows: DataFrame) -> DataFrame:
    """The keys (word, sid, least) at which an earlier text meets another: not those of one text alone, or without an offer."""
    dealt = rows.repartition("word")  # one shuffle for the counts and the join
    shared = dealt.groupBy("word").agg(F.min("sid").alias("low"), F.max("sid").alias("high"), F.max("least").alias("offered")).where(
        "low <> high and offered is not null")
    return dealt.join(shared.select("word").hint("shuffle_hash"), "word")


def _fits(length: str, other: str, threshold: float) -> Column:
    """Whether the shorter text is long enough."""
    return F.least(length, other) * 2 >= (F.col(length) + F.col(other)) * F.lit(threshold) - F.lit(1e-9)


def _ratios(candidates: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(sid, earlier, similarity) of the pairs that reach the threshold. texts: sid, length, counts, plain."""
    def side(name: str, *columns: str) -> DataFrame:
        return texts.select(F.col("sid").alias(name), *[F.col(c).alias(f"{name}_{c}") for c in columns])

    # Pairs are settled on lengths and character counts; texts are fetched for the few that remain.
    measured = candidates.join(side("sid", "length", "counts"), "sid").join(side("earlier", "length", "counts"), "earlier")
    near = measured.where(_fits("sid_length", "earlier_length", threshold)).where(may_match(
        F.col("sid_counts"), F.col("earlier_counts"), F.col("sid_length"), F.col("earlier_length"), threshold)).select("sid", "earlier")
    return near.join(side("sid", "plain"), "sid").join(side("earlier", "plain"), "earlier").select(
        "sid", "earlier", ratio_from(F.col("sid_plain"), F.col("earlier_plain"), threshold).alias("similarity")).where(F.col("similarity") >= threshold)


def _greedy_rounds(rows: DataFrame, items: DataFrame, verify: Callable[[DataFrame], DataFrame], front: int, threshold: float) -> DataFrame:
    """(sid, dup_of, similarity) of the items that resemble an earlier kept one.

    rows(word, sid, least): an item is compared with what others offer (``least`` isn't null) at its keys, if at ``least`` of them. A round
    compares every open item only with the first ``front`` undecided offers of each of its keys; where an item isn't among these, its offers
    count as if met, so that no pair is lost. An item that no key has more of before
    it has met everything before it, so it is kept once none of that is both similar and undecided; what
    resembles a kept item is dropped. A dropped item stays open as long as something undecided before its match could turn out
    to be an earlier match. The first undecided item is always decided, and so is most of a crowded key. An item
    that is not ``eligible`` (in ``items``) is compared but never kept.
    """
    status = checkpointed(items.select("sid", "length", F.when(~F.col("eligible"), F.col("sid")).alias("bound")).join(
        rows.select("sid").distinct(), "sid", "left_semi"))
    hits = None
    while not status.isEmpty():
        undecided = status.where("bound is null").select("sid")
        asks = rows.join(status, "sid").select("word", "sid", "length", "bound")
        offers = rows.where("least is not null").join(status.where("bound is null").select("sid", F.col("length").alias("size")), "sid")
        by_order = Window.partitionBy("word").orderBy("sid")
        placed = offers.withColumn("rank", F.row_number().over(by_order)).withColumnRenamed("sid", "earlier")
        leaders = placed.where(F.col("rank") <= front)
        hidden = placed.where(F.col("rank") > front).groupBy("earlier").agg(F.count(F.lit(1)).alias("hidden"))
        last = leaders.where(F.col("rank") == front).select("word", F.col("earlier").alias("last"))
        late = asks.where("bound is null").join(last, "word").where(F.col("sid") > F.col("last")).select("sid").distinct()
        known = undecided.join(late, "sid", "left_anti")
        met = asks.join(leaders, "word").where((F.col("earlier") < F.coalesce("bound", "sid")) & _fits("length", "size", threshold))
        candidates = met.groupBy("sid", "earlier").agg(F.count(F.lit(1)).alias("n"), F.max("least").alias("least")).join(
            hidden, "earlier", "left").where("n + coalesce(hidden, 0) >= least").select("sid", "earlier")
        similar = checkpointed(verify(candidates))
        kept = checkpointed(known.join(similar.select("sid").distinct(), "sid", "left_anti"))
        found = checkpointed(
            similar.join(kept.select(F.col("sid").alias("earlier")), "earlier", "left_semi")
            .groupBy("sid").agg(F.min(F.struct("earlier", "similarity")).alias("hit"))
            .select("sid", F.col("hit.earlier").alias("dup_of"), F.col("hit.similarity").alias("similarity")))
        hits = found if hits is None else hits.unionByName(found)
        remaining = status.join(kept, "sid", "left_anti").join(found, "sid", "left").select(
            "sid", "length", F.least("bound", "dup_of").alias("bound"))
        # A dropped item is done when nothing undecided at its keys precedes its match.
        open_ = remaining.where("bound is null")
        first_open = rows.where("least is not null").join(open_, "sid", "left_semi").groupBy("word").agg(F.min("sid").alias("first_open"))
        bounded = rows.join(remaining.where("bound is not null"), "sid")
        waiting = bounded.join(first_open, "word").where("first_open < bound").select("sid").distinct()
        status = checkpointed(open_.unionByName(remaining.where("bound is not null").join(waiting, "sid", "left_semi")))
        if not status.isEmpty():
            rows = checkpointed(rows.join(status.select("sid"), "sid", "left_semi"))
    if hits is None:
        return items.select("sid", F.col("sid").alias("dup_of"), F.lit(0.0).alias("similarity")).limit(0)
    return hits.groupBy("sid").agg(F.min(F.struct("dup_of", "similarity")).alias("hit")).select(
        "sid", "hit.dup_of", "hit.similarity")


def near_duplicates(docs: DataFrame, id_col: str, text: str, threshold: float = 0.8, front: int = 128,
                    eligible: Column | None = None) -> DataFrame:
    """(id, dup_of, similarity): documents resembling an earlier kept one, in id order.

    Two documents are duplicates when the ratio of their normalised texts reaches ``threshold``; the block keys
    (``ratio_blocks``) lose no such pair. Others have a null ``dup_of``; of these the ``eligible`` ones
    (all, by default) are kept and are what later documents are compared with.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("id"), similarity_text(F.col(text)).alias("plain"),
                        (F.lit(True) if eligible is None else F.coalesce(eligible, F.lit(False))).alias("eligible"))
    hashed = checkpointed(plain.withColumn("hash", F.md5("plain")))
    # Equal eligible texts share one outcome. An ineligible copy may come before or after its original is kept.
    alone = F.when(~F.col("eligible"), F.col("id")).alias("alone")
    firsts = hashed.groupBy("hash", "eligible", alone).agg(F.min("id").alias("sid")).select("sid")
    first = hashed.join(firsts, F.col("id") == F.col("sid"), "left_semi").dropDuplicates(["id"]).fillna("", ["plain"])
    texts = checkpointed(first.select(
        F.col("id").alias("sid"), "eligible", "hash", "plain", F.length("plain").alias("length"), F.lit(0).cast("long").alias("scope"),
        ratio_kind(F.col("plain"), threshold).alias("kind"), histogram(F.col("plain")).alias("counts")))
    # What isn't eligible is never compared with.
    rows = checkpointed(_live(ratio_blocks(texts.withColumnRenamed("eligible", "offering"), threshold)))
    outcome = _greedy_rounds(rows, texts.select("sid", "length", "eligible"), lambda pairs: _ratios(pairs, texts, threshold), front, threshold)
    decided = texts.select("sid", "eligible", "hash").join(outcome, "sid", "left")
    originals = decided.where("eligible").drop("eligible")
    # A copy of a kept text repeats that text; a copy of a dropped one shares its match.
    copies = hashed.where("eligible").select("id", "hash").join(originals, "hash")
    copy = F.col("dup_of").isNull() & (F.col("id") != F.col("sid"))
    return copies.select(
        "id",
        F.when(copy, F.col("sid")).otherwise(F.col("dup_of")).alias("dup_of"),
        F.when(copy, F.lit(1.0)).otherwise(F.col("similarity")).alias("similarity"),
    ).unionByName(decided.where("not eligible").select(F.col("sid").alias("id"), "dup_of", "similarity"))


def similar_policies(policies: DataFrame, content: str, threshold: float = 0.85, payer: str = "payer_name") -> DataFrame:
    """Pairs of contents within a payer whose ratio reaches ``threshold``.

    Policies of one content are folded into a row with their number; a content
    that several policies share is paired with itself, once. Each other pair
    appears in both directions, because the ratio is not symmetric.
    """
    keyed = policies.select("policy_id", F.col(payer), F.col(content).alias("plain"), F.xxhash64(payer).alias("scope"),
                            F.md5(F.concat_ws("\x1f", F.col(payer), F.col(content))).alias("sid"))
    counted = keyed.where("plain is not null").groupBy("sid").agg(
        F.count_distinct("policy_id").alias("policies"), F.first(payer).alias(payer), F.first("scope").alias("scope"), F.first("plain").alias("plain"))
    texts = checkpointed(counted.withColumns({
        "length": F.length("plain"), "kind": ratio_kind(F.col("plain"), threshold), "counts": histogram(F.col("plain"))}))
    rows = checkpointed(_live(ratio_blocks(texts.withColumn("offering", F.lit(True)), threshold)))
    offers = rows.where("least is not null").select("word", F.col("sid").alias("earlier"), "least")
    candidates = rows.select("word", "sid").join(offers, "word").where(F.col("sid") != F.col("earlier")).groupBy("sid", "earlier").agg(
        F.count(F.lit(1)).alias("n"), F.max("least").alias("least")).where("n >= least").select("sid", "earlier")

    def side(name: str, key: str) -> DataFrame:
        return texts.select(F.col("sid").alias(key), F.col("plain").alias(f"content_{name}"), F.col("policies").alias(f"policies_{name}"))
    equal = texts.where("policies > 1").select(
        payer, F.col("plain").alias("content_a"), F.col("plain").alias("content_b"),
        F.col("policies").alias("policies_a"), F.col("policies").alias("policies_b"), F.lit(1.0).alias("similarity"))
    alike = _ratios(candidates, texts, threshold).join(side("a", "sid"), "sid").join(side("b", "earlier"), "earlier").join(
        texts.select("sid", payer), "sid").select(payer, "content_a", "content_b", "policies_a", "policies_b", "similarity")
    return alike.unionByName(equal)


def exact_duplicate_groups(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """Members of the groups with equal normalised text: hash, size, first member, member.

    Groups are counted before anything is joined, and members stay rows, so a
    group may be any size.
    """
    hashed = docs.select(F.col(id_col), content_hash(F.col(text)).alias("content_hash"))
    groups = hashed.groupBy("content_hash").agg(
        F.count("*").alias("group_size"), F.min(id_col).alias("first_member")).where("group_size > 1")
    return hashed.join(groups, "content_hash").select("content_hash", "group_size", "first_member", id_col)
