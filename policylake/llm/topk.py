"""Exact top-k search by inner product, with pivot-table elimination.

Pivots are chosen farthest-first from a bounded sample (``SAMPLE`` rows, the least hashes). The table holds every vector's angle to
every pivot, computed once. Angles are a metric, so the angle of two vectors is at least the greatest difference of
their angles to a pivot, and their inner product at most the product of their lengths and the cosine of that. A query looks
at candidates in the order of this bound and stops when the next bound is below its k-th score: nothing is missed, whatever the
pivots are. Scores are exact integers.

Every row lies in the cell of its nearest pivot; cells are cut into blocks of about ``BLOCK`` rows by a hash, so one of any
size is many tasks. Queries first meet a block of their own cell, which gives a k-th score to start with. Then packs of
queries meet the blocks of those cells that the bound over the cell's range of angles doesn't rule out: a join by
(cell, block). A query's best of every block are ranked at the end. What is sent to the driver are the sample and a row per
pair of pivots.

Defined cases: vectors that are null or hold null take no part, nor do rows without an id; shorter vectors end in zeros; a
zero vector scores 0 with all. Rows that repeat an id are rows of their own, each a candidate for the others; ties go to the
smaller id. Scores beyond a long are cut to its range after ranking within a block. Fewer than k candidates give fewer rows,
an empty table none. Extra columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from policylake.llm._links import stored

SAMPLE = 4096
PIVOTS = 32
BLOCK = 4096
PACK = 256
STEP = 256
#: Radians by which bounds are loosened, far above the rounding of the angles.
SLACK = 1e-5

PACKED = "rows binary, ids binary, vectors binary, wide boolean, floors binary"


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """The integer vectors, with zeros at the ends of shorter ones."""
    out = np.zeros((len(vectors), dim), np.int64)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = values
    return out


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(vectors of length one, lengths); a zero vector stays zero."""
    x = x.astype(np.float64)
    lengths = np.sqrt(np.square(x).sum(axis=1))
    return x / np.where(lengths > 0, lengths, 1)[:, None], lengths


def farthest_first(x: np.ndarray, count: int) -> np.ndarray:
    """Unit vectors of the sample, each as far as can be from those before it."""
    units, lengths = _units(x)
    units = units[lengths > 0]
    if not len(units):
        return np.eye(1, max(x.shape[1], 1))
    chosen, nearest = [0], units @ units[0]
    while len(chosen) < count and nearest.min() < 1 - 1e-9:
        chosen.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, units @ units[chosen[-1]])
    return units[chosen]


def angles(x: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(angle of each pivot to each vector, lengths): a row per pivot."""
    units, lengths = _units(x)
    return np.arccos(np.clip(pivots @ units.T, -1, 1)).astype(np.float32), lengths


def _narrow(x: np.ndarray) -> tuple[bytes, bool]:
    wide = bool(len(x)) and (int(x.max()) > 32767 or int(x.min()) < -32768)
    return x.astype("<i8" if wide else "<i2").tobytes(), wide


def _wide(data: bytes, wide: bool, dim: int) -> np.ndarray:
    return np.frombuffer(data, "<i8" if wide else "<i2").reshape(-1, dim).astype(np.int64)


def _scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products: in doubles where these hold all sums, else in Python's integers."""
    most = x.shape[1] * float(np.abs(x.astype(np.float64)).max(initial=0)) * float(np.abs(q.astype(np.float64)).max(initial=0))
    if most < 2 ** 53:
        return (x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return x.astype(object) @ q.astype(object)


def best(query: np.ndarray, row: int, floor: float, bounds: np.ndarray, x: np.ndarray, rows: np.ndarray, ids: np.ndarray,
         k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, scores) of the k best candidates of a block; those below ``floor``, a score the query has k of, may be left out.

    Candidates go in the order of their bounds, until the next bound is below the k-th score.
    """
    live = np.flatnonzero((bounds >= floor) & (rows != row))
    live = live[np.argsort(-bounds[live], kind="stable")]
    places, scores = live[:0], _scores(x[:0], query)
    at = 0
    while at < len(live):
        if len(places) == k:
            floor = max(floor, float(scores[-1]))
        if bounds[live[at]] < floor:
            break
        step = live[at:at + STEP]
        places = np.concatenate([places, step])
        scores = np.concatenate([scores, _scores(x[step], query)])
        keep = np.lexsort((rows[places], ids[places], -scores))[:k]
        places, scores = places[keep], scores[keep]
        at += STEP
    return places, scores


def _packs(table: DataFrame, keys: list[str], floors: bool = False) -> DataFrame:
    """One row per value of ``keys``, of a bounded number of rows each, with their vectors as bytes. table: row, id, vector."""
    first = table.schema

    def run(group: pa.Table) -> pa.Table:
        vectors = group.column("vector").combine_chunks()
        dim = int(np.max(vectors.value_lengths().to_numpy(zero_copy_only=False), initial=0))
        data, wide = _narrow(_matrix(vectors, dim))
        low = group.column("floor").to_numpy() if floors else np.zeros(0)
        cells = [pa.array([group.column(c)[0].as_py()], group.column(c).type) for c in keys]
        return pa.Table.from_arrays(
            [*cells, pa.array([group.column("row").to_numpy().astype("<i8").tobytes()]), pa.array([group.column("id").to_numpy().astype("<i8").tobytes()]),
             pa.array([data]), pa.array([wide]), pa.array([low.astype("<f8").tobytes()])],
            [*keys, "rows", "ids", "vectors", "wide", "floors"])

    kinds = ", ".join(f"{c} {first[c].dataType.simpleString()}" for c in keys)
    return table.groupBy(*keys).applyInArrow(run, f"{kinds}, {PACKED}")


class _Index:
    """The pivots and what is known of each cell; sizes are bounded by the number of pivots."""

    def __init__(self, dim: int, pivots: np.ndarray):
        self.dim, self.pivots = dim, pivots
        self.blocks: dict[int, int] = {}
        self.low = self.high = self.longest = np.zeros(0)

    def bounds(self, q: np.ndarray, cell: int) -> np.ndarray:
        """The greatest score that each query can reach in a cell."""
        own, lengths = angles(q, self.pivots)
        gap = np.maximum(own - self.high[cell][:, None], self.low[cell][:, None] - own).max(axis=0)
        return lengths * self.longest[cell] * np.cos(np.clip(gap - SLACK, 0, np.pi)) * (1 + 1e-9) + 1e-6


def _placed(rows: DataFrame, dim: int, pivots: np.ndarray) -> DataFrame:
    """rows with the cell, and their length."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, lengths = angles(_matrix(batch.column("vector"), dim), pivots)
            cell = found.argmin(axis=0) if batch.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(lengths, pa.float64())],
                                             ["row", "id", "asks", "vector", "cell", "length"])

    return rows.mapInArrow(run, "row long, id long, asks boolean, vector array<long>, cell int, length double")


def _ranges(table: DataFrame, dim: int, pivots: np.ndarray) -> DataFrame:
    """(cell, pivot, low, high, longest) per task; the caller takes the extremes."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(pivots)
        low, high, longest = np.full((n, n), np.inf), np.full((n, n), -np.inf), np.zeros(n)
        seen = np.zeros(n, np.int64)
        for batch in batches:
            found, lengths = angles(_matrix(batch.column("vector"), dim), pivots)
            cell = batch.column("cell").to_numpy()
            for c in np.unique(cell).tolist():
                mine = cell == c
                low[c] = np.minimum(low[c], found[:, mine].min(axis=1))
                high[c] = np.maximum(high[c], found[:, mine].max(axis=1))
                longest[c] = max(longest[c], lengths[mine].max())
                seen[c] += int(mine.sum())
        c, p = np.meshgrid(np.flatnonzero(seen), np.arange(n), indexing="ij")
        c, p = c.ravel(), p.ravel()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int32()), pa.array(p, pa.int32()), pa.array(low[c, p]), pa.array(high[c, p]), pa.array(longest[c]), pa.array(seen[c])],
            ["cell", "pivot", "low", "high", "longest", "n"])

    return table.select("vector", "cell").mapInArrow(run, "cell int, pivot int, low double, high double, longest double, n long")


def _index(table: DataFrame, dim: int, pivots: np.ndarray) -> _Index:
    index = _Index(dim, pivots)
    n = len(pivots)
    index.low, index.high, index.longest = np.zeros((n, n)), np.zeros((n, n)), np.zeros(n)
    for r in _ranges(table, dim, pivots).groupBy("cell", "pivot").agg(
            F.min("low").alias("low"), F.max("high").alias("high"), F.max("longest").alias("longest"), F.sum("n").alias("n")).collect():
        index.low[r.cell, r.pivot], index.high[r.cell, r.pivot], index.longest[r.cell] = r.low, r.high, r.longest
        index.blocks[r.cell] = -(-r.n // BLOCK)
    return index


def _met(pairs: DataFrame, index: _Index, k: int, finish: Callable, schema: str) -> DataFrame:
    """Packs and blocks side by side: the k best of the block for each query of the pack, handed to ``finish``."""
    dim = index.dim

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                pair = batch.slice(at, 1).to_pylist()[0]
                x = _wide(pair["vectors"], pair["wide"], dim)
                rows, ids = np.frombuffer(pair["rows"], "<i8"), np.frombuffer(pair["ids"], "<i8")
                table, lengths = angles(x, index.pivots)
                q = _wide(pair["q_vectors"], pair["q_wide"], dim)
                own, long = angles(q, index.pivots)
                asking, asked = np.frombuffer(pair["q_rows"], "<i8"), np.frombuffer(pair["q_ids"], "<i8")
                floors = np.frombuffer(pair["q_floors"], "<f8") if pair["q_floors"] else np.full(len(q), -np.inf)
                found = []
                for i in range(len(q)):
                    gap = np.zeros(len(x), np.float32)
                    for p in range(len(table)):
                        np.maximum(gap, np.abs(table[p] - own[p, i]), out=gap)
                    bounds = long[i] * lengths * np.cos(np.maximum(gap.astype(np.float64) - SLACK, 0)) * (1 + 1e-9) + 1e-6
                    found.append(best(q[i], int(asking[i]), float(floors[i]), bounds, x, rows, ids, k))
                yield finish(asking, asked, q, rows, ids, found)

    return pairs.mapInArrow(run, schema)


def _as_long(scores: list) -> pa.Array:
    return pa.array([min(max(int(s), -2 ** 63), 2 ** 63 - 1) for s in scores], pa.int64())


def top_k(rows: DataFrame, asks: Column, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): the k rows with the greatest inner products for every row for which ``asks`` holds.

    key: integer ids; vector: arrays of integers. A row is no candidate for itself.
    """
    spark = rows.sparkSession
    valid = rows.where(F.col(f"`{key}`").isNotNull() & F.col(f"`{vector}`").isNotNull() & F.forall(f"`{vector}`", lambda x: x.isNotNull()))
    # The number of a row is its identity; it is written once, before it is used.
    plain = stored(valid.select(F.monotonically_increasing_id().alias("row"), F.col(f"`{key}`").cast("long").alias("id"),
                                F.coalesce(asks, F.lit(False)).alias("asks"), F.col(f"`{vector}`").cast("array<long>").alias("vector")), "vectors")
    dim = max(plain.agg(F.max(F.size("vector"))).first()[0] or 0, 1)
    sample = plain.orderBy(F.xxhash64("id", "vector"), "row").limit(SAMPLE).select("vector").toArrow()
    pivots = farthest_first(_matrix(sample.column(0).combine_chunks(), dim), PIVOTS)
    padded = plain.withColumn("vector", F.concat("vector", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("vector"))))
    table = stored(_placed(padded, dim, pivots), "placed")
    index = _index(table, dim, pivots)
    if not index.blocks:
        return spark.createDataFrame([], "query_id long, rank int, id long, score long")
    count = F.create_map(*(F.lit(v).cast("int") for c, n in index.blocks.items() for v in (c, n)))
    blocked = table.withColumn("block", F.pmod(F.xxhash64("row"), count[F.col("cell")]).cast("int"))
    blocks = stored(_packs(blocked.select("cell", "block", "row", "id", "vector"), ["cell", "block"]), "blocks")

    # Every cell's queries in packs of a bounded number; each meets one block of its own cell.
    asking = table.where("asks").select("cell", "row", "id", "vector")
    of_cell = asking.groupBy("cell").agg(F.count(F.lit(1)).alias("queries"))
    dealt = asking.join(of_cell, "cell").withColumn("pack", F.pmod(F.xxhash64("row"), F.ceil(F.col("queries") / PACK)).cast("int"))
    first = _packs(dealt.select("cell", "pack", "row", "id", "vector"), ["cell", "pack"])

    def questions(packs: DataFrame) -> DataFrame:
        return packs.select("cell", *(["block"] if "block" in packs.columns else []),
                            *(F.col(c).alias(f"q_{c}") for c in ("rows", "ids", "vectors", "wide", "floors")))

    def seeded(asking: np.ndarray, asked: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, found: list) -> pa.RecordBatch:
        floors = [float(s[-1]) if len(s) == k else -np.inf for _, s in found]
        return pa.RecordBatch.from_arrays([pa.array(asking), pa.array(asked), pa.array(list(q), pa.list_(pa.int64())), pa.array(floors, pa.float64())],
                                          ["row", "id", "vector", "floor"])

    # Packs are copied for every block that they meet, which Spark doesn't see in their size: neither side may be broadcast.
    seeds = stored(_met(questions(first).hint("merge").join(blocks.where("block = 0"), "cell"), index, k, seeded,
                        "row long, id long, vector array<long>, floor double"), "seeds")
    packs = -(-seeds.count() // PACK)
    second = _packs(seeds.withColumn("pack", F.pmod(F.xxhash64("row"), F.lit(max(packs, 1))).cast("int")), ["pack"], floors=True)

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pack in batch.to_pylist():
                q = _wide(pack["vectors"], pack["wide"], dim)
                asking, asked = np.frombuffer(pack["rows"], "<i8"), np.frombuffer(pack["ids"], "<i8")
                floors = np.frombuffer(pack["floors"], "<f8")
                for cell, n in index.blocks.items():
                    may = index.bounds(q, cell) >= floors
                    if not may.any():
                        continue
                    data, wide = _narrow(q[may])
                    parts = [asking[may].tobytes(), asked[may].tobytes(), data, wide, floors[may].tobytes()]
                    for block in range(n):
                        yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([block], pa.int32()), *(pa.array([v]) for v in parts)],
                                                         ["cell", "block", "q_rows", "q_ids", "q_vectors", "q_wide", "q_floors"])

    wanted = second.mapInArrow(spread, "cell int, block int, q_rows binary, q_ids binary, q_vectors binary, q_wide boolean, q_floors binary")

    def listed(asking: np.ndarray, asked: np.ndarray, q: np.ndarray, rows: np.ndarray, ids: np.ndarray, found: list) -> pa.RecordBatch:
        sizes = [len(p) for p, _ in found]
        places = np.concatenate([p for p, _ in found]).astype(int)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(asking, sizes)), pa.array(np.repeat(asked, sizes)), pa.array(ids[places]), pa.array(rows[places]),
             _as_long([s for _, scores in found for s in scores])], ["row", "query_id", "id", "other", "score"])

    # A block is few bytes and much work, so each gets a task.
    tasks = sum(index.blocks.values())
    meeting = wanted.repartition(tasks, "cell", "block").hint("merge").join(blocks.repartition(tasks, "cell", "block"), ["cell", "block"])
    hits = _met(meeting, index, k, listed, "row long, query_id long, id long, other long, score long")
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "id", "other")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")
