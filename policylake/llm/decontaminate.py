"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Texts are compared as bytes with A-Z lower-cased and every run of blanks, controls and ASCII punctuation as one blank.
Every benchmark item is cut into overlapping windows of ``WINDOW`` bytes (half a window apart, the last at the end). A
window of m bytes that occurs with at most k edits shares at least m - Q + 1 - k * Q of its q-grams with the text, all
on diagonals no more than k apart. Texts are searched in overlapping segments. First the q-grams that a segment and a
window share are counted wherever they stand; pairs that reach the bound count them in bands of diagonals that overlap
by half, bands below the bound are dropped, and what is left is verified by a banded alignment of the window. A
document is contaminated by an item if one of its windows is found. Equal windows and equal segments are looked at
once, and places are paired a bounded number at a time, so repetitive texts cost neither time nor memory.

The benchmark is the stated query set: it is collected in blocks of about ``BLOCK_CHARS`` characters, and the
documents are scanned once per block, without a shuffle. Whole texts are searched.

Defined cases: null and empty texts are clean; an item shorter than a window is one window with a smaller budget; an
item of fewer than Q normalised bytes cannot be told from chance and is found nowhere; equal items and repeated rows
are each reported; without items everything is clean. Output columns replace none of the input's in ``clean``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from policylake.llm._arrow import sliced, text_bytes

Q = 10
WINDOW = 64
EDITS = 4
BLOCK_CHARS = 4_000_000
TABLE_BITS = 20
#: Texts are searched in segments of so many bytes, which go on for more than the longest occurrence.
SEGMENT = 512
OVERLAP = WINDOW + EDITS + 1
#: Pairs of places that are held at once.
PAIRS = 2_000_000

_CLASS = np.full(256, 32, np.uint8)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _CLASS[_c] = _c
for _c in range(65, 91):
    _CLASS[_c] = _c + 32


def _normal(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(normalised bytes, offsets of texts, place of each byte in ``raw``)."""
    x = _CLASS[raw]
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    starts = offsets[:-1]
    keep[starts[starts < len(x)]] = True
    kept = np.zeros(len(x) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return x[keep], kept[offsets], np.flatnonzero(keep)


def _grams(x: np.ndarray) -> np.ndarray:
    """Hash of the Q bytes (8 to 16) that begin at each place."""
    n = len(x) - Q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    buffer = np.ascontiguousarray(x).tobytes()
    first = np.ndarray((n,), "<u8", buffer, 0, (1,))
    last = np.ndarray((n,), "<u8", buffer, Q - 8, (1,))
    with np.errstate(over="ignore"):
        h = first * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return (h + last) * np.uint64(0xBF58476D1CE4E5B9)


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - TABLE_BITS)).astype(np.int64)


@dataclass
class Index:
    """The windows of one block's items, equal ones once, and their q-grams."""
    ids: list
    raw: np.ndarray  # normalised items, one after the other
    windows: np.ndarray  # windows of each item
    begin: np.ndarray  # where each different window stands in raw
    size: np.ndarray  # its bytes
    owners: np.ndarray  # (item, number) pairs packed as item << 32 | number, those of a window together
    owned: np.ndarray  # offsets of each window's owners
    grams: np.ndarray  # different q-grams, sorted
    maybe: np.ndarray  # which values the upper bits of a gram's hash can have
    posted: np.ndarray  # offsets of each gram's windows
    window: np.ndarray  # windows that hold a gram
    times: np.ndarray  # and how often
    keys: np.ndarray  # window * len(grams) + gram of every place in a window, sorted
    inner: np.ndarray  # that place


def build_index(ids: list, texts: list[str | None]) -> Index:
    raw, offsets = text_bytes(pa.array(texts, pa.string()))
    x, offsets, _ = _normal(raw, offsets)
    sizes, step = np.diff(offsets), WINDOW // 2
    windows = np.where(sizes > WINDOW, -(-(sizes - WINDOW) // step) + 1, 1)
    item = np.repeat(np.arange(len(sizes)), windows)
    number = np.arange(len(item)) - np.repeat(np.cumsum(windows) - windows, windows)
    size = np.minimum(sizes, WINDOW)[item]
    start = offsets[item] + np.minimum(number * step, sizes[item] - size)
    known: dict[bytes, int] = {}
    text = x.tobytes()
    which = np.array([known.setdefault(text[a:a + m], len(known)) if m >= Q else -1
                      for a, m in zip(start.tolist(), size.tolist())], np.int64)
    order = np.argsort(which, kind="stable")[int((which < 0).sum()):]
    first = order[np.searchsorted(which[order], np.arange(len(known)))]
    begin, size = start[first], size[first]
    owned = np.searchsorted(which[order], np.arange(len(known) + 1))
    places = np.maximum(size - Q + 1, 0)
    owner = np.repeat(np.arange(len(known)), places)
    inner = np.arange(len(owner)) - np.repeat(np.cumsum(places) - places, places)
    grams, gram = np.unique(_grams(x)[begin[owner] + inner], return_inverse=True) if len(owner) else (
        np.zeros(0, np.uint64), np.zeros(0, np.int64))
    keys = owner * max(len(grams), 1) + gram.reshape(-1)
    order_keys = np.argsort(keys, kind="stable")
    pairs, times = np.unique(gram.reshape(-1) * max(len(known), 1) + owner, return_counts=True)
    maybe = np.zeros(1 << TABLE_BITS, bool)
    maybe[_slot(grams)] = True
    posted = np.searchsorted(pairs, np.arange(len(grams) + 1) * max(len(known), 1))
    return Index(ids, x, windows, begin, size, item[order] << 32 | number[order], owned, grams, maybe, posted,
                 (pairs % max(len(known), 1)).astype(np.int32), times.astype(np.int32), keys[order_keys],
                 inner[order_keys].astype(np.int16))


def _budget(m: np.ndarray) -> np.ndarray:
    """Edits allowed in a window of m bytes, in proportion, and few enough that the lemma's bound stays positive."""
    return np.clip(np.minimum(EDITS * m // WINDOW, (m - Q) // Q), 0, None)


def _bound(m: np.ndarray) -> np.ndarray:
    """Q-grams that a window of m bytes surely shares with an occurrence."""
    return np.maximum(m - Q + 1 - Q * _budget(m), 1)


def _ranges(low: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(range number, value) of every value in the ranges that begin at ``low``."""
    of = np.repeat(np.arange(len(low)), count)
    return of, np.arange(len(of)) + np.repeat(low - (np.cumsum(count) - count), count)


def _parts(count: np.ndarray) -> Iterator[slice]:
    """Slices of work items whose counts sum up to about ``PAIRS``, one item at least."""
    ends, at = np.cumsum(count), 0
    while at < len(count):
        base = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, base + PAIRS, "right")))
        yield slice(at, stop)
        at = stop


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys, sorted, with the sum of their values."""
    different, group = np.unique(keys, return_inverse=True)
    return different, np.bincount(group.reshape(-1), values, len(different)).astype(np.int64)


def _banded(pattern: np.ndarray, text: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(edits, end) of the best occurrence of each pattern row in its text row, within the band the text allows.

    pattern: rows of bytes, ``lengths`` of them meant. text: rows of band width more; 0 stands for no byte.
    """
    n, m = pattern.shape
    width = text.shape[1] - m
    ramp = np.arange(width)
    row = np.zeros((n, width), np.int32)
    best, end = np.full(n, 1 << 20), np.zeros(n, np.int64)
    for i in range(m):
        same = row + (text[:, i:i + width] != pattern[:, i:i + 1])
        same[:, :-1] = np.minimum(same[:, :-1], row[:, 1:] + 1)
        row = np.minimum.accumulate(same - ramp, axis=1) + ramp
        over = lengths == i + 1
        if over.any():
            best[over] = row[over].min(axis=1)
            end[over] = row[over].argmin(axis=1) + i + 1
    return best, end


def _candidates(index: Index, segment: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment, window) pairs that share enough q-grams, wherever they stand, from the different grams of segments."""
    count = np.diff(index.posted)[gram]
    many = max(len(index.begin), 1)
    bound = _bound(index.size)
    carried, sums, found = np.zeros(0, np.int64), np.zeros(0, np.int64), []
    for part in _parts(count):
        of, posting = _ranges(index.posted[gram[part]], count[part])
        keys, values = segment[part][of] * many + index.window[posting], index.times[posting]
        carried, sums = _summed(np.concatenate([carried, keys]), np.concatenate([sums, values]))
        # The last segment may go on in the next part.
        over = len(carried) if part.stop == len(segment) else int(np.searchsorted(carried, segment[part.stop] * many))
        found.append(carried[:over][sums[:over] >= bound[carried[:over] % many]])
        carried, sums = carried[over:], sums[over:]
    pairs = np.concatenate(found) if found else carried
    return pairs // many, pairs % many


def _found(index: Index, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, item, windows found, windows, edits, first byte, byte past the last) of contaminated texts."""
    none = tuple(np.zeros(0, np.int64) for _ in range(7))
    x, offsets, origin = _normal(raw, offsets)
    hashes = _grams(x)
    if not len(index.grams) or not len(hashes):
        return none
    at = np.flatnonzero(index.maybe[_slot(hashes)])
    gram = np.minimum(np.searchsorted(index.grams, hashes[at]), len(index.grams) - 1)
    known = index.grams[gram] == hashes[at]
    at, gram = at[known], gram[known]
    rows = np.searchsorted(offsets, at, "right") - 1
    whole = at + Q <= offsets[rows + 1]
    at, gram, rows = at[whole], gram[whole], rows[whole]
    if not len(at):
        return none
    # Segments overlap by more than an occurrence: a place lies in its own and perhaps in the end of the one before.
    per_row = -(-np.diff(offsets) // SEGMENT)
    base = np.cumsum(per_row) - per_row
    own = (at - offsets[rows]) // SEGMENT
    tail = (own > 0) & ((at - offsets[rows]) % SEGMENT + Q <= OVERLAP)
    segment = np.concatenate([base[rows] + own, (base[rows] + own - 1)[tail]])
    at, gram, rows = np.concatenate([at, at[tail]]), np.concatenate([gram, gram[tail]]), np.concatenate([rows, rows[tail]])
    order = np.argsort(segment, kind="stable")
    segment, at, gram, rows = segment[order], at[order], gram[order], rows[order]
    different = np.unique(segment * len(index.grams) + gram)
    pair_segment, pair_window = _candidates(index, different // len(index.grams), different % len(index.grams))
    if not len(pair_segment):
        return none
    # Equal segments are looked at once.
    live, place = np.unique(pair_segment, return_inverse=True)
    first_hit = np.searchsorted(segment, live)
    live_row = rows[first_hit]
    low = offsets[live_row] + (live - base[live_row]) * SEGMENT
    high = np.minimum(low + SEGMENT + OVERLAP, offsets[live_row + 1])
    text, seen = x.tobytes(), {}
    twin = np.array([seen.setdefault(text[a:b], k) for k, (a, b) in enumerate(zip(low.tolist(), high.tolist()))])
    place = place.reshape(-1)
    only = twin[place] == place
    who, window = place[only], pair_window[only]
    hits = np.searchsorted(segment, live, "right") - first_hit
    verified = [_verified(index, x, who[p], window[p], low, high, *_bands(index, at, gram, who[p], window[p], first_hit, hits, low))
                for p in _parts(hits[who])]
    who, window, edits, start, end = np.concatenate(verified, axis=1)
    if not len(who):
        return none
    # Back to all segments of the same text, then to all items with the window.
    order = np.argsort(who, kind="stable")
    who, window, edits, start, end = (v[order] for v in (who, window, edits, start, end))
    left = np.searchsorted(who, twin)
    of, found = _ranges(left, np.searchsorted(who, twin, "right") - left)
    (row, window), (edits, start, end) = _folded(
        live_row[of], window[found], edits[found], origin[low[of] + start[found]], origin[low[of] + end[found] - 1] + 1)
    of, owner = _ranges(index.owned[window], np.diff(index.owned)[window])
    item = index.owners[owner] >> 32
    _, group = np.unique(row[of] * len(index.ids) + item, return_inverse=True)
    seen_windows = np.bincount(group.reshape(-1))
    (row, item), (edits, start, end) = _folded(row[of], item, edits[of], start[of], end[of])
    return row, item, seen_windows, index.windows[item], edits, start, end


def _folded(a: np.ndarray, b: np.ndarray, edits: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple:
    """((a, b), (least edits, lowest, highest)) per different pair, in the order of (a, b)."""
    many = int(b.max(initial=0)) + 1
    pairs, group = np.unique(a * many + b, return_inverse=True)
    group, n = group.reshape(-1), len(pairs)
    least, lowest, highest = np.full(n, 1 << 20), np.full(n, 1 << 60), np.zeros(n, np.int64)
    np.minimum.at(least, group, edits)
    np.minimum.at(lowest, group, low)
    np.maximum.at(highest, group, high)
    return (pairs // many, pairs % many), (least, lowest, highest)


def _bands(index: Index, at: np.ndarray, gram: np.ndarray, who: np.ndarray, window: np.ndarray, first_hit: np.ndarray,
           hits: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(pair, band) of diagonals in which a segment shares enough q-grams with a window.

    Diagonals of an occurrence with k edits lie within k of each other: bands of 2 (k + 1), overlapping by half.
    """
    half, many = EDITS + 1, -(-(SEGMENT + OVERLAP + 2 * WINDOW) // (EDITS + 1)) + 2
    pair, hit = _ranges(first_hit[who], hits[who])
    key = window[pair] * len(index.grams) + gram[hit]
    left = np.searchsorted(index.keys, key)
    count = np.searchsorted(index.keys, key, "right") - left
    found = []
    carried = np.zeros(0, np.int64)
    for part in _parts(count):
        of, entry = _ranges(left[part], count[part])
        inner = index.inner[entry].astype(np.int64)
        band = (at[hit[part]][of] - low[who[pair[part][of]]] - inner + WINDOW) // half
        # A q-gram of the window counts once, however often it stands in the band.
        cell = (pair[part][of] * many + band + 1) * WINDOW + inner
        carried = np.unique(np.concatenate([carried, cell, cell - WINDOW]))
        over = len(carried) if part.stop == len(pair) else int(np.searchsorted(carried, pair[part.stop] * many * WINDOW))
        cells, size = np.unique(carried[:over] // WINDOW, return_counts=True)
        found.append(cells[size >= _bound(index.size[window[cells // many]])])
        carried = carried[over:]
    cells = np.concatenate(found) if found else carried
    return cells // many, cells % many - 1


def _verified(index: Index, x: np.ndarray, who: np.ndarray, window: np.ndarray, low: np.ndarray, high: np.ndarray,
              pair: np.ndarray, band: np.ndarray) -> np.ndarray:
    """Rows of segment, window, least edits, first byte and byte past the last, from the segment's begin, of real pairs."""
    width = 2 * (EDITS + 1) + 2 * EDITS + 1

    def cut(source: np.ndarray, at: np.ndarray, low: np.ndarray, high: np.ndarray, span: int) -> np.ndarray:
        where = at[:, None] + np.arange(span)
        inside = (where >= low[:, None]) & (where < high[:, None])
        return np.where(inside, source[np.clip(where, 0, max(len(source) - 1, 0))], 0)

    found = [np.zeros((5, 0), np.int64)]
    for k in range(0, len(pair), 4096):
        p = pair[k:k + 4096]
        first, m = index.begin[window[p]], index.size[window[p]]
        begin = low[who[p]] + band[k:k + 4096] * (EDITS + 1) - WINDOW - EDITS
        left, right = low[who[p]], high[who[p]]
        pattern = cut(index.raw, first, first, first + m, WINDOW)
        edits, end = _banded(pattern, cut(x, begin, left, right, WINDOW + width), m)
        ok = np.flatnonzero(edits <= _budget(m))
        # The same alignment from the end gives where the occurrence begins.
        back = np.zeros((len(ok), WINDOW), np.uint8)
        for j in range(WINDOW):
            live = j < m[ok]
            back[live, j] = pattern[ok[live], m[ok[live]] - 1 - j]
        left, last = left[ok], (begin + end)[ok]
        mirrored = cut(x, last - WINDOW - width, left, np.minimum(last, right[ok]), WINDOW + width)[:, ::-1]
        _, length = _banded(back, mirrored, m[ok])
        start = np.clip(last - length, left, right[ok] - 1)
        stop = np.clip(last, start + 1, right[ok])
        (segment, which), rest = _folded(who[p][ok], window[p][ok], edits[ok], start - left, stop - left)
        found.append(np.stack([segment, which, *rest]))
    return np.concatenate(found, axis=1)


def _blocks(benchmark: DataFrame, item: str, text: str) -> Iterator[Index]:
    """Indexes of all items, a block of bounded size at a time."""
    rows = benchmark.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null")
    total = rows.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = -(-total // BLOCK_CHARS)
    for k in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k).orderBy("i", "t").collect()
        yield build_index([r.i for r in part], [r.t for r in part])


def contaminated(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, windows_found, windows, edits, start, end): code points of what matched, end exclusive."""
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    items = benchmark.select(F.col(item).alias("item_id"))
    kinds = [rows.schema["doc_id"].dataType.simpleString(), items.schema["item_id"].dataType.simpleString()]
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, windows_found long, windows long, edits long, start long, end long"
    arrow_item = _arrow_kind(items)

    def searched(index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in sliced(batches):
                raw, offsets = text_bytes(part.column("text"))
                row, which, seen, windows, edits, low, high = _found(index, raw, offsets)
                if not len(row):
                    continue
                points = [[int(((raw[offsets[r]:at] & 0xC0) != 0x80).sum()) for r, at in zip(row, places)]
                          for places in (low, high)]
                yield pa.RecordBatch.from_arrays([
                    part.column("doc_id").take(pa.array(row)), pa.array([index.ids[i] for i in which], arrow_item),
                    *(pa.array(x, pa.int64()) for x in (seen, windows, edits, *points))],
                    ["doc_id", "item_id", "windows_found", "windows", "edits", "start", "end"])
        return rows.mapInArrow(run, schema)

    found = [searched(index) for index in _blocks(benchmark, item, item_text)]
    return reduce(DataFrame.unionByName, found) if found else docs.sparkSession.createDataFrame([], schema)


def _arrow_kind(df: DataFrame) -> pa.DataType:
    return df.limit(0).toArrow().schema.field(0).type


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id",
          item_text: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, in which no window of any item is found."""
    def without(rows: DataFrame, index: Index) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in sliced(batches, text):
                keep = np.ones(part.num_rows, bool)
                keep[_found(index, *text_bytes(part.column(text)))[0]] = False
                yield part.filter(pa.array(keep))
        return rows.mapInArrow(run, rows.schema)
    return reduce(without, _blocks(benchmark, item, item_text), docs)
