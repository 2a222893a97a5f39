"""Suffix arrays of byte strings by induced sorting, in whole-array steps, and their permuted common prefixes.

A suffix is S if it is smaller than the next one, else L; an S after an L is leftmost-smaller (LMS). Substrings from one
LMS place to the next are sorted by inducing and named; the reduced string of names is sorted recursively, each level
naming pairs of neighbours, until all names differ or stand for more than a match needs. From the sorted LMS suffixes
the L and then the S suffixes follow in one pass each over the buckets of first symbols; a bucket is handled as an
array, its entries' predecessors are dealt to their buckets by a stable sort of their first symbols.
"""

from __future__ import annotations

import numpy as np

SYMBOLS = 258  # 0: the end, 1: between segments, then bytes


def joined(segments: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(symbols of all segments, each followed by a separator, then the end; where each segment begins)."""
    lengths = np.fromiter((len(s) + 1 for s in segments), np.int64, len(segments))
    starts = np.concatenate([[0], np.cumsum(lengths)])
    text = np.frombuffer(b"\0".join(segments) + b"\0", np.uint8).astype(np.int16) + 2
    text[starts[1:] - 1] = 1
    return np.concatenate([text, np.zeros(1, np.int16)]), starts[:-1]


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are S; the last one, the end, is."""
    rises, falls = text[:-1] < text[1:], text[:-1] > text[1:]
    s_type = np.concatenate([rises, [True]])
    # Equal neighbours are of one type: that of the end of their run.
    flat = np.flatnonzero(~rises & ~falls)
    if len(flat):
        last = np.concatenate([np.diff(flat) > 1, [True]])
        end = np.flatnonzero(last)[np.cumsum(np.concatenate([[0], last[:-1]]))]
        s_type[flat] = s_type[flat[end] + 1]
    return s_type


def _dealt(text: np.ndarray, chunk: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """The places of a chunk by first symbol, in their order within each."""
    first = text[chunk].astype(np.uint16)
    order = np.argsort(first, kind="stable")
    first, chunk = first[order], chunk[order]
    cuts = np.flatnonzero(first[1:] != first[:-1]) + 1
    return list(zip(first[np.concatenate([[0], cuts])].tolist(), np.split(chunk, cuts))) if len(chunk) else []


def _induced(text: np.ndarray, s_type: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The suffix array that follows from LMS places in their order."""
    l_type = ~s_type
    larger: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    smaller: list[list[np.ndarray]] = [[] for _ in range(SYMBOLS)]
    begin: list[np.ndarray | None] = [None] * SYMBOLS
    for c, part in _dealt(text, lms):
        begin[c] = part
    for c in range(SYMBOLS):
        at = 0
        while at < len(larger[c]):  # a run of c appends to the bucket that is being read
            chunk = larger[c][at]
            before = chunk[chunk > 0] - 1
            for d, part in _dealt(text, before[l_type[before]]):
                larger[d].append(part)
            at += 1
        if begin[c] is not None:
            chunk = begin[c]
            before = chunk[chunk > 0] - 1
            for d, part in _dealt(text, before[l_type[before]]):
                larger[d].append(part)
    l_sorted = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in larger]
    for c in range(SYMBOLS - 1, -1, -1):  # from the greatest suffix down
        at = 0
        while at < len(smaller[c]):
            chunk = smaller[c][at]
            before = chunk[chunk > 0] - 1
            for d, part in _dealt(text, before[s_type[before]]):
                smaller[d].append(part)
            at += 1
        chunk = l_sorted[c][::-1]
        before = chunk[chunk > 0] - 1
        for d, part in _dealt(text, before[s_type[before]]):
            smaller[d].append(part)
    smaller[0].append(np.array([len(text) - 1]))
    out = []
    for c in range(SYMBOLS):
        out.append(l_sorted[c])
        out.extend(x[::-1] for x in reversed(smaller[c]))
    return np.concatenate(out)


def _names_sorted(names: np.ndarray, span: int = 1, order: np.ndarray | None = None, depth: int = 1) -> np.ndarray:
    """Order of the suffixes of a string of names, exact in the first ``depth`` names.

    Names that stand for ``span`` of the first names are paired with the name that follows them; where several suffixes
    still share a name the pairs are sorted and named anew, and so on recursively.
    """
    if order is None:
        order = np.argsort(names)
    # A name is the place of the first of its equals in the order.
    ranked = names[order]
    begins = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    names = names.copy()
    names[order] = np.maximum.accumulate(np.where(begins, np.arange(len(order)), 0)).astype(np.uint64)
    return _refined(names, order, np.flatnonzero(~(begins & np.concatenate([begins[1:], [True]]))), span, depth)


def _refined(names: np.ndarray, order: np.ndarray, tied: np.ndarray, span: int, depth: int) -> np.ndarray:
    if not len(tied) or span >= depth:
        return order
    who = order[tied]
    follow = np.zeros(len(who), np.uint64)
    inside = who + span < len(names)
    follow[inside] = names[who[inside] + span] + np.uint64(1)
    pair = (names[who] << np.uint64(32)) | follow
    sort = np.argsort(pair)
    who, pair = who[sort], pair[sort]
    order[tied] = who
    begins = np.concatenate([[True], pair[1:] != pair[:-1]])
    names[who] = np.maximum.accumulate(np.where(begins, tied, 0)).astype(np.uint64)
    alone = begins & np.concatenate([begins[1:], [True]])
    return _refined(names, order, tied[~alone], 2 * span, depth)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Places of all suffixes in order, exact in the first ``depth`` symbols."""
    s_type = smaller_than_next(text)
    lms = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    if len(lms) < 2:
        return _induced(text, s_type, lms)
    is_lms = np.zeros(len(text), bool)
    is_lms[lms] = True
    # Inducing from unsorted LMS places sorts their substrings.
    rough = _induced(text, s_type, lms)
    ordered = rough[is_lms[rough]]
    length = np.empty(len(text), np.int64)
    length[lms] = np.diff(np.concatenate([lms, [len(text) - 1]])) + 1
    same = _equal_substrings(text, ordered, length)
    rank = np.concatenate([[0], np.cumsum(~same)]).astype(np.uint64)
    name = np.empty(len(text), np.uint64)
    name[ordered] = rank
    names = name[lms]
    if int(rank[-1]) < len(lms) - 1:
        # An LMS substring moves on by two symbols at least.
        ordered = lms[_names_sorted(names, depth=depth // 2 + 1)]
    return _induced(text, s_type, ordered)


def _equal_substrings(text: np.ndarray, ordered: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether each LMS substring equals the next one in order."""
    a, b = ordered[:-1], ordered[1:]
    same = length[a] == length[b]
    live = np.flatnonzero(same)
    k = 0
    while len(live):
        off = text[a[live] + k] != text[b[live] + k]
        same[live[off]] = False
        live = live[~off]
        k += 1
        live = live[length[a[live]] > k]
    return same


def permuted_prefixes(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For every place, symbols its suffix shares with the suffix before it in order, up to the end of its segment.

    Only where the symbols before the two differ, or a segment begins, is a prefix compared; elsewhere it is that of the
    place before, less one.
    """
    n = len(text)
    previous = np.empty(n, np.int64)
    previous[order[1:]] = order[:-1]
    previous[order[0]] = -1
    at = np.arange(n)
    free = previous <= 0
    free[0] = True
    held = np.flatnonzero(~free)
    free[held] = (text[held - 1] != text[previous[held] - 1]) | (text[held - 1] == 1)
    live = np.flatnonzero(free & (previous >= 0))
    # A separator differs from every other, so that a prefix ends with its segment.
    left = np.concatenate([text, np.full(8, -1, np.int16)])
    right = np.where(left == 1, np.int16(-2), left)
    fours = [np.ndarray((n + 4,), "<u8", x.tobytes(), 0, (2,)) for x in (left, right)]
    shared = np.zeros(n, np.int64)
    a, b = live, previous[live]
    while len(live):
        equal = fours[0][a] == fours[1][b]
        ra, rb, rl = a[~equal], b[~equal], live[~equal]
        for _ in range(3):
            ok = left[ra] == right[rb]
            ra, rb, rl = ra[ok] + 1, rb[ok] + 1, rl[ok]
            shared[rl] += 1
        live, a, b = live[equal], a[equal] + 4, b[equal] + 4
        shared[live] += 4
    reach = np.maximum.accumulate(np.where(free, shared + at, 0))
    return np.maximum(reach - at, 0)
