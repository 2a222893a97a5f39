"""N-gram Jaccard join by vertical partitioning.

All word n-grams stand in one global order: frequent ones last, by a count over all documents, ties by hash. The order
is cut into fragments; a document's set falls into one segment per fragment, segments of a pair are intersected
fragment by fragment, apart from each other, and the partial overlaps are summed per pair. The sums decide exactly.

Which pairs are counted: two sets with 100 * both >= percent * either share an n-gram among the first
size - ceil(percent * size / 100) + 1 of each in the global order, and their sizes differ by no more than percent. This
is applied twice: by the order of all documents to find candidates, and by the exact counts among these, where a set
whose n-grams are mostly its own drops out, before pairs are looked at.
Equal sets are folded into one node first. Links are then followed by pivots (``_links.grouped``), which tests every
candidate pair that isn't connected already and never lists all pairs of a group of copies. Before the segments of a pair
are met, the parities of its sets, a bit per slot, say how many n-grams they don't share at least; that alone rules out
most pairs that aren't linked, and no other.

The order's counts come from one pass in which every task counts hashed slots and reports those it saw at least
``NOTED`` times: a lossy count with a bounded table (2^22 slots), which can change the work but not the links.

Defined cases: null, empty or blank text has no n-grams and is linked with nothing; fewer than n words make one n-gram
of all words; repeated rows are rows of one node; n-grams and sets are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from policylake.llm._arrow import row_of, shingle_hashes, sliced, sorted_within
from policylake.llm._links import grouped, partnered, small, stored

SLOT_BITS = 22
NOTED = 8
FRAGMENTS = 16
#: Longs of a set's parity: 64 slots each.
PARITY = 16
#: Longs that stand beside a set's n-grams where they meet: the parities folded, which still never differ too often.
FOLDED = [f"k{i}" for i in range(2)]


def _bands(docs: DataFrame, text: str, words: int) -> np.ndarray:
    """Band of each slot of n-gram hashes, 0 for all that aren't frequent, else the magnitude of the count."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.int32)
        for part in sliced(batches):
            grams, _ = shingle_hashes(part.column(0), words)
            slots, seen = np.unique(grams >> np.uint64(64 - SLOT_BITS), return_counts=True)
            counts[slots.astype(np.int64)] += seen.astype(np.int32)
        noted = np.flatnonzero(counts >= NOTED)
        yield pa.RecordBatch.from_arrays([pa.array(noted, pa.int32()), pa.array(counts[noted], pa.int64())], ["slot", "n"])

    seen = docs.select(F.col(text).alias("text")).mapInArrow(run, "slot int, n long").groupBy("slot").agg(
        F.floor(F.log2(F.sum("n"))).cast("int").alias("band")).toArrow()
    bands = np.zeros(1 << SLOT_BITS, np.uint8)
    bands[seen["slot"].to_numpy()] = seen["band"].to_numpy()
    return bands


def _ordered(grams: np.ndarray, offsets: np.ndarray, bands: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, places in the global order), sorted: the band in the upper six bits, the hash below."""
    rows = row_of(offsets)
    band = bands[(grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)].astype(np.uint64)
    place = (band << np.uint64(57)) | (grams >> np.uint64(7))  # a positive long
    return rows, sorted_within(place, offsets)


def _parities(grams: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row per set: whether the number of its n-grams in a slot is odd, a bit per slot."""
    out = np.zeros((len(offsets) - 1, PARITY), np.uint64)
    slot = (grams >> np.uint64(8)) & np.uint64(64 * PARITY - 1)
    np.bitwise_xor.at(out, (row_of(offsets), (slot >> np.uint64(6)).astype(np.int64)), np.uint64(1) << (slot & np.uint64(63)))
    return out.view(np.int64)


def _node(grams: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(grams.tobytes()))))


def gram_sets(docs: DataFrame, key: str, text: str, words: int, percent: int, bands: np.ndarray) -> DataFrame:
    """(doc_id, copy, n, node, head, parity): hash of the text, size of its set, the set's hash (null if empty), its first n-grams.

    The head is the prefix in which linked sets meet.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            grams, offsets = shingle_hashes(part.column("text"), words)
            sizes = np.diff(offsets)
            _, place = _ordered(grams, offsets, bands)
            firsts = np.where(sizes > 0, sizes - -(-percent * sizes // 100) + 1, 0)
            keep = np.arange(len(place)) - np.repeat(offsets[:-1], sizes) < np.repeat(firsts, sizes)
            ends = np.concatenate([[0], np.cumsum(firsts)]).astype(np.int32)
            nodes = [_node(grams[a:b]) if b > a else None for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), part.column("copy"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(place[keep].astype(np.int64))),
                pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * PARITY),
                                         pa.array(_parities(grams, offsets).ravel()))],
                ["doc_id", "copy", "n", "node", "head", "parity"])

    rows = docs.select(F.col(key).alias("doc_id"), F.xxhash64(text).alias("copy"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, copy long, n long, node long, head array<long>, parity array<long>")


def _segments(docs: DataFrame, samples: DataFrame, words: int, bands: np.ndarray) -> DataFrame:
    """(node, fragment, grams): the segments of the sets that the sampled rows hold."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            grams, offsets = shingle_hashes(part.column("text"), words)
            own = part.column("node").to_numpy(zero_copy_only=False)
            place_rows, place = _ordered(grams, offsets, bands)
            band = (place >> np.uint64(57)).astype(np.int64)
            fragment = np.where(band == 0, (place >> np.uint64(53)).astype(np.int64) & (FRAGMENTS - 1),
                                FRAGMENTS - 1 + band)
            begin = np.ones(len(place), bool)
            begin[1:] = (place_rows[1:] != place_rows[:-1]) | (fragment[1:] != fragment[:-1])
            starts = np.flatnonzero(begin)
            ends = np.concatenate([starts, [len(place)]]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                pa.array(own[place_rows[starts]], pa.int64()), pa.array(fragment[starts], pa.int32()),
                pa.ListArray.from_arrays(pa.array(ends), pa.array(place.astype(np.int64)))], ["node", "fragment", "grams"])

    chosen = samples.select(F.col("doc_id").alias("_id"), "copy", "node")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("copy"))
    found = docs.join(chosen, same).select("text", "node")
    return found.mapInArrow(run, "node long, fragment int, grams array<long>")


def _folded() -> list[Column]:
    """A set's parities, folded to the longs of ``FOLDED``."""
    n = len(FOLDED)
    return [F.expr(" ^ ".join(f"parity[{j}]" for j in range(i, PARITY, n))).alias(name) for i, name in enumerate(FOLDED)]


def _alike(percent: int) -> str:
    """Whether the folded parities of p and m let their sets be linked."""
    apart = " + ".join(f"bit_count(p.{k} ^ m.{k})" for k in FOLDED)
    return f"{100 + percent} * ({apart}) <= {100 - percent} * (p.size + m.size)"


def _rare_buckets(segments: DataFrame, chosen: DataFrame, percent: int, may: str) -> DataFrame:
    """(bucket, id, size, pos, rank, folded parities): the n-grams in which linked sets meet, in the exact order among candidates.

    Among the candidates an n-gram's count can be taken exactly. A set that shares fewer than percent of its n-grams with
    any other candidate goes; the rest are ordered by their counts among what is left, those of no other set first.
    """
    def shared(rows: DataFrame) -> DataFrame:
        grams = rows.select("node", F.explode("grams").alias("gram")).repartition("gram").dropDuplicates(["gram", "node"])
        return grams.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("gram"))).where("n > 1")

    sizes, folded = chosen.select("node", "size"), chosen.select(F.col("node").alias("id"), *_folded())
    held = shared(segments).groupBy("node").agg(F.count(F.lit(1)).alias("held"))
    alive = stored(sizes.join(held, "node").where(100 * F.col("held") >= percent * F.col("size")).select("node", "size"), "alive")
    again = shared(segments.join(small(alive.select("node")), "node")).join(small(alive), "node")
    of_set = Window.partitionBy("node")
    placed = again.withColumns({"place": F.row_number().over(of_set.orderBy("n", "gram")), "held": F.count(F.lit(1)).over(of_set)}) \
        .withColumn("pos", F.col("size") - F.col("held") + F.col("place") - 1)
    prefix = placed.where(F.col("pos") <= F.col("size") - F.ceil(percent * F.col("size") / 100)).select(
        F.col("gram").alias("bucket"), F.col("node").alias("id"), "size", "pos", F.col("place").alias("rank"))
    met = prefix.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("n > 1")
    return stored(partnered(stored(met.join(small(folded), "id"), "met"), may), "buckets")


def jaccard_groups(docs: DataFrame, words: int = 5, percent: int = 80, key: str = "doc_id",
                   text: str = "text") -> DataFrame:
    """(doc_id, copy, n_shingles, node, group): one row per row of ``docs``; group is null where a set is linked with none.

    copy is the hash of the text, node names the set itself, group the least node reachable by links.
    """
    spark = docs.sparkSession
    bands = _bands(docs, text, words)
    sets = stored(gram_sets(docs, key, text, words, percent, bands), "sets")
    nodes = sets.where("node is not null").groupBy("node").agg(
        F.first("n").alias("size"), F.min(F.struct("doc_id", "copy")).alias("sample"), F.first("parity").alias("parity"))
    listed = sets.where("node is not null").groupBy("node").agg(F.first("n").alias("size"), F.first("head").alias("head")).select(
        "node", "size", F.posexplode("head").alias("pos", "bucket"))
    shared = listed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("bucket"))).where("n > 1") \
        .withColumnRenamed("node", "id")
    # A pair's first common n-gram leaves at most the shorter rest to be shared; it must do for the overlap needed.
    may = (f"100 * least(p.size, m.size) >= {percent} * greatest(p.size, m.size) and "
           f"{100 + percent} * least(p.size - p.pos, m.size - m.pos) >= {percent} * (p.size + m.size)")
    hopeful_sets = partnered(stored(shared, "shared"), may)
    # One row that holds each set is read again, only for sets that may have a partner.
    meant = hopeful_sets.select(F.col("id").alias("node")).distinct()
    chosen = stored(nodes.join(meant, "node").select("node", "size", "parity", "sample.*"), "chosen")
    parities, samples = chosen.select("node", "size", "parity"), chosen.select("node", "doc_id", "copy")
    segments = stored(_segments(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), small(samples), words, bands),
                      "segments")

    # The folded parities are met first, so that pairs of a crowd that can't be linked aren't listed at all.
    near = f"{may} and {_alike(percent)}"
    buckets = _rare_buckets(segments, chosen.select("node", "size", "parity"), percent, near)

    def sides(table: DataFrame, pairs: DataFrame, *columns: str) -> tuple[DataFrame, DataFrame]:
        meant = small(pairs)
        return tuple(table.join(meant, F.col("node") == F.col(x)).select(
            "a", "b", *(F.col(c) if c == "fragment" else F.col(c).alias(f"{c}_{x}") for c in columns)) for x in "ab")

    def tested(pairs: DataFrame) -> DataFrame:
        # A slot whose parities differ holds an n-gram that only one of the sets has.
        left, right = sides(parities, pairs, "size", "parity")
        apart = F.expr(" + ".join(f"bit_count(parity_a[{i}] ^ parity_b[{i}])" for i in range(PARITY)))
        hopeful = stored(left.join(right, ["a", "b"]).where(
            (100 + percent) * apart <= (100 - percent) * (F.col("size_a") + F.col("size_b"))).select("a", "b", "size_a", "size_b"), "hopeful")
        left, right = sides(segments, hopeful.select("a", "b"), "fragment", "grams")
        partial = left.join(right, ["a", "b", "fragment"]).select(
            "a", "b", "fragment", F.size(F.array_intersect("grams_a", "grams_b")).cast("long").alias("both"))
        # Repeated rows give a segment twice.
        once = partial.groupBy("a", "b", "fragment").agg(F.max("both").alias("both"))
        overlap = once.groupBy("a", "b").agg(F.sum("both").alias("both"))
        return overlap.join(small(hopeful), ["a", "b"]).where(
            100 * F.col("both") >= percent * (F.col("size_a") + F.col("size_b") - F.col("both"))).select("a", "b")

    groups = grouped(spark, buckets, tested, comparable=near, hint="rank <= 2", foremost=True)
    marked = groups.select(F.col("id").alias("node"), F.col("least").alias("group"))
    marked = marked.unionByName(marked.select(F.col("group").alias("node"), "group").distinct())
    return sets.select("doc_id", "copy", F.col("n").alias("n_shingles"), "node").join(marked, "node", "left") \
        .select("doc_id", "copy", "n_shingles", "node", "group")
