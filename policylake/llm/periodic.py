"""Periodic runs of words: recursive frequency splitting, then a lag scan of the segments that survive.

A run is a longest possible stretch of consecutive words with smallest period q (words q apart are equal) and a length
of at least max(``LEAST``, ``TIMES`` * q). Every word of a run therefore occurs at least ``TIMES`` times in any segment that
holds the run. So a word that occurs less often within its segment is in no run and splits the segment; the parts are
counted anew until nothing splits any more, and parts shorter than ``LEAST`` go. All texts of a slice split in the same
vectorised rounds.

The lag scan of what is left goes by octaves of lags. For lags in [m, 2m) a run repeats over at least 3m words, so it
holds a window of 2m words that starts at a multiple of m and occurs again at the lag. Windows are named exactly, by
doubling: a name stands for one pair of shorter names. Of a window's later occurrences in that octave only the first is
looked at: two of them would make the window itself periodic, and their lags not the smallest. So every octave has at most
a lag per m words, and the scan takes n log n steps, also of a text that is one segment.

Defined cases: a null, empty or blank text has no words and no runs, and collapses to an empty text; runs of one text may
overlap and each counts; rows are judged one by one, so repeated rows and null ids need no care; extra columns pass
through, ``runs``, ``n_words`` and ``collapsed`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from policylake.llm._arrow import row_of, sliced, split_words

LEAST = 6
TIMES = 4
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def surviving(codes: np.ndarray, texts: np.ndarray, least: int = LEAST, times: int = TIMES) -> np.ndarray:
    """Places of the words that are left when no segment splits any more, in order.

    codes: the word at each place, texts: the text it is in. A round looks at the segments that the last one changed.
    """
    width = int(codes.max()) + 1 if len(codes) else 1
    at, segment, stable = np.arange(len(codes)), texts, []
    while len(at):
        _, which, seen = np.unique(segment * width + codes[at], return_inverse=True, return_counts=True)
        common = seen[which] >= times
        begins = np.ones(len(at), bool)
        begins[1:] = segment[1:] != segment[:-1]
        starts = np.flatnonzero(begins)
        whole = np.logical_and.reduceat(common, starts)
        sizes = np.diff(np.append(starts, len(at)))
        settled = np.repeat(whole & (sizes >= least), sizes)
        stable.append(at[settled])
        rest = common & ~np.repeat(whole, sizes)
        at, old = at[rest], segment[rest]
        fresh = np.ones(len(at), bool)
        fresh[1:] = (at[1:] != at[:-1] + 1) | (old[1:] != old[:-1])
        segment = np.cumsum(fresh) - 1
        long_enough = np.bincount(segment, minlength=1)[segment] >= least if len(at) else np.zeros(0, bool)
        at, segment = at[long_enough], segment[long_enough]
    return np.sort(np.concatenate(stable)) if stable else np.zeros(0, np.int64)


def _pair_names(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(names, counts): one name per distinct pair, and how often each place's pair occurs."""
    _, which, seen = np.unique(left * (int(right.max()) + 1) + right, return_inverse=True, return_counts=True)
    return which, seen[which]


def _lags(codes: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(lag, begin, end): stretches whose windows occur again at the lag, for all lags of runs, octave by octave."""
    n = len(codes)
    names = np.full(n + 1, -1, np.int64)  # of the windows of m words; -1 where a window occurs once
    _, which, seen = np.unique(codes, return_inverse=True, return_counts=True)
    names[:n][seen[which] > 1] = which[seen[which] > 1]
    m = 1
    while 4 * m <= n:
        held = np.flatnonzero(names[:n] >= 0)
        held = held[held + m < n]
        held = held[names[held + m] >= 0]
        if not len(held):
            return
        pair, seen = _pair_names(names[held], names[held + m])
        held, pair = held[seen > 1], pair[seen > 1]
        names[:] = -1
        names[held] = pair  # windows of 2m words
        key = np.sort(pair * (n + 1) + held)
        aligned = held % m == 0
        b, name = held[aligned], pair[aligned]
        after = np.searchsorted(key, name * (n + 1) + np.minimum(b + m, n))
        inside = after < len(key)
        b, found = b[inside], key[after[inside]] - name[inside] * (n + 1)
        near = found < np.minimum(b + 2 * m, n)  # else another name's, or too far
        b, lag = b[near], found[near] - b[near]
        order = np.lexsort((b, lag))
        b, lag = b[order], lag[order]
        first = np.ones(len(b), bool)
        first[1:] = (lag[1:] != lag[:-1]) | (b[1:] != b[:-1] + m)
        starts = np.flatnonzero(first)
        lasts = np.append(starts, len(b))[1:] - 1
        yield from zip(lag[starts].tolist(), b[starts].tolist(), (b[lasts] + 2 * m).tolist())
        m *= 2


def _same_until(codes: np.ndarray, i: int, lag: int, step: int) -> int:
    """How many words from i on (step 1) or before i (step -1) equal the word a lag later."""
    total, width = 0, 64
    while True:
        if step > 0:
            a, z = i + total, min(i + total + width, len(codes) - lag)
            differ = np.flatnonzero(codes[a:z] != codes[a + lag:z + lag]) if z > a else np.zeros(0, int)
            hit = int(differ[0]) if len(differ) else None
        else:
            z, a = i - total, max(i - total - width, 0)
            differ = np.flatnonzero(codes[a:z] != codes[a + lag:z + lag]) if z > a else np.zeros(0, int)
            hit = z - a - 1 - int(differ[-1]) if len(differ) else None
        if hit is not None:
            return total + hit
        if z - a < width:
            return total + max(z - a, 0)
        total, width = total + width, 2 * width


def _divisors(q: int) -> Iterator[int]:
    """q / r for every prime factor r of q."""
    rest, r = q, 2
    while r * r <= rest:
        if rest % r == 0:
            yield q // r
            while rest % r == 0:
                rest //= r
        r += 1
    if rest > 1:
        yield q // rest


def runs_of(codes: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    found = set()
    for lag, a, z in _lags(codes):
        a, z = a - _same_until(codes, a, lag, -1), z + _same_until(codes, z, lag, 1)
        if z - a + lag < max(least, times * lag):
            continue
        # A run that holds a smaller period is that one's.
        if not any(np.array_equal(codes[a:a + lag - p], codes[a + p:a + lag]) for p in _divisors(lag)):
            found.add((a, z - a + lag, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def _judged(texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    words, offsets = split_words(texts)
    codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    text = row_of(offsets)
    left = surviving(codes, text)
    # Segments stand apart by marks that equal nothing.
    gap = np.ones(len(left), bool)
    gap[1:] = (left[1:] != left[:-1] + 1) | (text[left[1:]] != text[left[:-1]])
    spot = np.arange(len(left)) + np.cumsum(gap)
    packed = -1 - np.arange(len(left) + int(gap.sum()) + 1, dtype=np.int64)
    packed[spot] = codes[left]
    place = np.zeros(len(packed), np.int64)
    place[spot] = left
    runs = np.array([(place[s], n, q) for s, n, q in runs_of(packed)], np.int64).reshape(-1, 3)
    owner = text[runs[:, 0]]
    counts = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(texts)))]).astype(np.int32)
    listed = pa.ListArray.from_arrays(pa.array(counts), pa.StructArray.from_arrays(
        [pa.array(runs[:, 0] - offsets[owner]), pa.array(runs[:, 1]), pa.array(runs[:, 2])], fields=list(RUN)))
    # A run's words after its first period go.
    change = np.zeros(len(codes) + 1, np.int64)
    np.add.at(change, runs[:, 0] + runs[:, 2], 1)
    np.add.at(change, runs[:, 0] + runs[:, 1], -1)
    stays = np.cumsum(change)[:-1] == 0
    before = np.concatenate([[0], np.cumsum(stays)])
    kept = pa.LargeListArray.from_arrays(pa.array(before[offsets]), words.filter(pa.array(stays)))
    collapsed = pc.binary_join(kept, pa.scalar(" ", words.type)).cast(pa.string())
    return pa.array(np.diff(offsets), pa.int64()), listed, collapsed


def with_periodic_runs(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, runs (start, length, period of each, in words) and collapsed, the text with one period of each run.

    The words of ``collapsed`` are joined by one space.
    """
    own = ("n_words", "runs", "collapsed")
    # The other columns travel in a struct, where their names can't clash.
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in own)).alias("others"),
                         F.col(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            yield pa.RecordBatch.from_arrays([part.column("others"), *_judged(part.column("text"))], ["others", *own])

    stretch = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
    schema = T.StructType([packed.schema["others"], T.StructField("n_words", T.LongType()),
                           T.StructField("runs", T.ArrayType(stretch)), T.StructField("collapsed", T.StringType())])
    return packed.mapInArrow(run, schema).select("others.*", *own)
