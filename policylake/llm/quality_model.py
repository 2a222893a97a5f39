"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)): all pairwise interactions of
low rank in time linear in the features of a text. Features are hashed words (damped counts, unit length) and
standardised statistics of structure; the only metadata used is n_chars. Labels, lang, source and ids are never read
by a score.

It is fitted on a bounded sample of labelled rows, at most ``sample`` of them, those with the smallest hash of their
id; the sample's features, not its texts, come to the driver. Scoring is one pass without a shuffle.

Defined cases: an empty or null text is scored from its statistics; null n_chars counts 0; rows without a label or
with several are judged by the mean of their labels; without any label, or with one class only, every score is the
share of label 1 (1.0 without labels), so nothing is rejected for want of labels. Equal rows get equal scores.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from policylake.llm._arrow import row_of, sliced, sorted_within, split_words, text_bytes, word_hashes

SAMPLE = 6000
WORDS = 1 << 15
RANK = 4
N_STATS = 12


@dataclass
class Model:
    bias: float
    linear: np.ndarray  # hashed words, then statistics
    factors: np.ndarray
    center: np.ndarray
    scale: np.ndarray


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the third that is never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _class_counts(raw: np.ndarray, offsets: np.ndarray, members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    sums = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(table[raw], out=sums[1:])
    return (sums[offsets[1:]] - sums[offsets[:-1]]).astype(float)


def _features(texts: pa.Array, n_chars: pa.Array, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, word feature, value, statistics) of a slice."""
    raw, offsets = text_bytes(texts)
    words, bounds = split_words(texts)
    hashes = word_hashes(words)
    rows, n = row_of(bounds), np.diff(bounds).astype(float)
    again = np.zeros(len(hashes), bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1])
    repeats = np.bincount(rows, again, minlength=len(texts))
    hashes = sorted_within(hashes, bounds)
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    row, word = rows[first], hashes[first]
    counts = np.diff(np.flatnonzero(np.concatenate([first, [True]])))
    distinct = np.bincount(row, minlength=len(texts))
    bytes_, any_words = np.diff(offsets).astype(float), np.maximum(n, 1)
    some = np.maximum(bytes_, 1)

    def share(members: bytes) -> np.ndarray:
        return np.sqrt(_class_counts(raw, offsets, members) / some)

    stats = np.stack([
        np.log1p(n), np.log1p(bytes_ / any_words), share(bytes(range(65, 91))), share(b"0123456789"),
        share(b"#*$%&|<>"), share(b"!?"), share(b".,;:"), share(b"\n"), np.sqrt(repeats / any_words),
        distinct / any_words, share(bytes(range(128, 192))),
        np.log1p(np.maximum(pc.fill_null(n_chars, 0).cast(pa.float64()).to_numpy(zero_copy_only=False), 0)),
    ], axis=1)
    value = np.log1p(counts)
    length = np.sqrt(np.bincount(row, value * value, minlength=len(texts)))
    return row, (word % np.uint64(n_words)).astype(np.int64), value / length[row], stats


def _featured(sample: DataFrame) -> DataFrame:
    """(y, word, value, stats) of each row of a sample with columns text, n_chars, y."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            row, word, value, stats = _features(part.column("text"), part.column("n_chars"), WORDS)
            ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=part.num_rows))]), pa.int32())
            yield pa.RecordBatch.from_arrays([
                part.column("y"), pa.ListArray.from_arrays(ends, pa.array(word, pa.int32())),
                pa.ListArray.from_arrays(ends, pa.array(value, pa.float32())),
                pa.array(list(stats), pa.list_(pa.float64()))], ["y", "word", "value", "stats"])
    return sample.mapInArrow(run, "y double, word array<int>, value array<float>, stats array<double>")


def labelled(labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, y) of at most ``sample`` rows to learn from, none of them held out."""
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    return usable.groupBy("doc_id").agg(F.avg("quality").alias("y")) \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = 6, rate: float = 0.1) -> Model:
    """Adagrad on the logistic loss, over the features of the bounded sample."""
    rows = docs.select("doc_id", "text", "n_chars").join(labelled(labels, sample), "doc_id").select("text", "n_chars", "y")
    table = _featured(rows).toArrow().combine_chunks()
    y = table["y"].to_numpy()
    n = len(y)
    empty = Model(50.0, np.zeros(WORDS + N_STATS), np.zeros((WORDS + N_STATS, RANK)), np.zeros(N_STATS), np.ones(N_STATS))
    if not n or y.min() == y.max():
        return empty if not n or y[0] >= 0.5 else Model(-50.0, *list(vars(empty).values())[1:])
    stats = np.array(table["stats"].to_pylist(), float).reshape(n, N_STATS)
    center, scale = stats.mean(0), stats.std(0) + 1e-3
    scaled = _scaled(stats, center, scale)
    word, value = table["word"].combine_chunks(), table["value"].combine_chunks()
    ends = word.offsets.to_numpy()
    word, value = word.values.to_numpy(), value.values.to_numpy().astype(float)
    random = np.random.default_rng(7)
    size = WORDS + N_STATS
    bias, linear, factors = 0.0, np.zeros(size), random.normal(0, 0.05, (size, RANK))
    seen, seen_f, seen_b = np.full(size, 1e-6), np.full((size, RANK), 1e-6), 1e-6
    order = np.lexsort((np.arange(n), y, stats.sum(1)))  # the same order however the rows arrived
    for _ in range(epochs):
        random.shuffle(order)
        for at in range(0, n, 64):
            chosen = order[at:at + 64]
            idx = np.concatenate([*(word[ends[i]:ends[i + 1]] for i in chosen), np.tile(np.arange(WORDS, size), len(chosen))])
            val = np.concatenate([*(value[ends[i]:ends[i + 1]] for i in chosen), scaled[chosen].ravel()])
            row = np.concatenate([np.repeat(np.arange(len(chosen)), ends[chosen + 1] - ends[chosen]),
                                  np.repeat(np.arange(len(chosen)), N_STATS)])
            margin, sums = _margin(row, idx, val, len(chosen), bias, linear, factors)
            error = (1 / (1 + np.exp(-margin)) - (y[chosen] >= 0.5)) / len(chosen)
            uniq, place = np.unique(idx, return_inverse=True)
            step = error[row] * val
            grad = np.bincount(place, step, len(uniq)) + 1e-6 * linear[uniq]
            seen[uniq] += grad * grad
            linear[uniq] -= rate * grad / np.sqrt(seen[uniq])
            for f in range(RANK):
                grad = np.bincount(place, step * (sums[row, f] - factors[idx, f] * val), len(uniq)) + 1e-5 * factors[uniq, f]
                seen_f[uniq, f] += grad * grad
                factors[uniq, f] -= 0.3 * rate * grad / np.sqrt(seen_f[uniq, f])
            seen_b += error.sum() ** 2
            bias -= rate * error.sum() / np.sqrt(seen_b)
    return Model(float(bias), linear, factors, center, scale)


def _scaled(stats: np.ndarray, center: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((stats - center) / scale, -4, 4) / np.sqrt(N_STATS)


def _margin(row: np.ndarray, idx: np.ndarray, val: np.ndarray, n: int, bias: float, linear: np.ndarray,
            factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Margins by the sum-of-squares identity, and the factor sums they use."""
    margin = bias + np.bincount(row, linear[idx] * val, n)
    sums = np.empty((n, factors.shape[1]))
    for f in range(factors.shape[1]):
        part = factors[idx, f] * val
        sums[:, f] = np.bincount(row, part, n)
        margin += 0.5 * (sums[:, f] ** 2 - np.bincount(row, part * part, n))
    return margin, sums


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """All rows and columns of ``docs`` plus ``quality_score`` (0 to 1), which replaces a column so named."""
    kept = [c for c in docs.columns if c != "quality_score"]
    schema = docs.select(*(F.col(f"`{c}`") for c in kept)).withColumn("quality_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            row, word, value, stats = _features(part.column("text"), part.column("n_chars"), WORDS)
            n = part.num_rows
            every = np.arange(n)
            margin, _ = _margin(
                np.concatenate([row, np.repeat(every, N_STATS)]),
                np.concatenate([word, np.tile(np.arange(WORDS, WORDS + N_STATS), n)]),
                np.concatenate([value, _scaled(stats, model.center, model.scale).ravel()]),
                n, model.bias, model.linear, model.factors)
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "quality_score"])

    return docs.select(*(F.col(f"`{c}`") for c in kept)).mapInArrow(run, schema)
