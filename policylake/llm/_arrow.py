"""Small vectorised helpers over Arrow batches of texts, shared by the operators that work in tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 2 << 20


def sliced(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``most`` bytes of text, one row at least, so that working memory is bounded."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes + 16)
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most, "right")))
            # A copy, as list kernels don't all heed the offset of a slice.
            yield batch.take(pa.array(np.arange(start, stop)))
            start = stop


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all bytes, offsets of each text in them); a null text is empty."""
    plain = pc.fill_null(texts.cast(pa.large_binary()), b"")
    flat = pa.concat_arrays([plain])  # offsets of a slice begin at 0 again
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset:flat.offset + len(flat) + 1]
    data = flat.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """(words of all texts, offsets of each text in them); words are runs of other than x20 and x09 to x0D."""
    plain = pc.fill_null(texts.cast(pa.large_string()), "")
    pieces = pc.ascii_split_whitespace(pc.ascii_lower(plain) if lower else plain)
    flat, bounds = pieces.flatten(), np.zeros(len(texts) + 1, np.int64)
    bounds[1:] = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))
    real = pc.greater(pc.binary_length(flat), 0)
    before = np.zeros(len(flat) + 1, np.int64)
    np.cumsum(real.to_numpy(zero_copy_only=False), out=before[1:])
    return flat.filter(real), before[bounds]


LONG_WORD = 64


def word_hashes(words: pa.Array) -> np.ndarray:
    """64-bit hash of every word, eight bytes at a time; the few longer than ``LONG_WORD`` bytes are hashed one by one."""
    raw, offsets = text_bytes(words)
    starts, left = offsets[:-1], np.diff(offsets)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)]).tobytes()
    chunks = np.ndarray((len(raw) + 1,), "<u8", padded, 0, (1,))
    out = left.astype(np.uint64)
    live = np.flatnonzero((left > 0) & (left <= LONG_WORD))
    at, rest = starts[live], left[live]
    with np.errstate(over="ignore"):
        while len(live):
            few = np.minimum(rest, 8).astype(np.uint64)
            chunk = chunks[at] & (np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(64) - np.uint64(8) * few))
            out[live] = mixed(out[live] * np.uint64(0x9E3779B97F4A7C15) + chunk)
            more = rest > 8
            live, at, rest = live[more], at[more] + 8, rest[more] - 8
    for k in np.flatnonzero(left > LONG_WORD).tolist():
        out[k] = xxhash.xxh64_intdigest(raw[offsets[k]:offsets[k + 1]].tobytes())
    return out


def row_of(offsets: np.ndarray) -> np.ndarray:
    """The text each element belongs to."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sorted_within(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The values of each text sorted; short vector sorts beat one sort by two keys."""
    out = values.copy()
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a > 1:
            out[a:b].sort()
    return out


def shingle_hashes(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of each text, offsets); fewer words than n make one shingle of all."""
    words, bounds = split_words(texts, lower=True)
    values = word_hashes(words)
    counts = np.diff(bounds)
    sizes = np.maximum(counts - n + 1, np.minimum(counts, 1))
    ends = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=ends[1:])
    at = np.arange(ends[-1]) + np.repeat(bounds[:-1] - ends[:-1], sizes)
    short = np.repeat(counts < n, sizes)
    total = np.zeros(len(at), np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            # Linear in well mixed word hashes, with a factor for each place; words past the end count as zero.
            total *= np.uint64(0x9E3779B97F4A7C15)
            if not short.any():
                total += values[k:][at] if k else values[at]
            else:
                inside = ~short | (k < np.repeat(counts, sizes))
                total[inside] += values[at[inside] + k]
    total = sorted_within(total, ends)
    first = np.ones(len(total), bool)
    first[1:] = total[1:] != total[:-1]
    first[ends[:-1][sizes > 0]] = True
    kept = np.zeros(len(total) + 1, np.int64)
    np.cumsum(first, out=kept[1:])
    return total[first], kept[ends]
