"""Suffix-array de-duplication of byte strings across documents.

Every byte covered by a ``LENGTH``-byte string that also starts earlier (in a smaller document, or the same document at
an earlier start) is removed; strings are judged on the input and never cross documents.

Shards. The least of the ``GRAM``-byte hashes in a window of LENGTH bytes is its anchor. Equal windows have equal anchors
at equal places, so windows meet if they are dealt out by their anchor's hash. All windows of one anchor lie in one
segment of a text, LENGTH to about 1.7 LENGTH bytes long. Segments are first rows of hashes only: those whose anchor
stands nowhere else are dropped, those equal to another are folded to the first, and only segments that differ from
others at their anchor have their bytes cut out and dealt to shards.

A shard joins its segments (whole anchors, about ``SHARD_BYTES``) and builds their suffix array by induced sorting and
the permuted common prefixes (``suffixes``). Neighbours in order that share LENGTH bytes form classes; in each, all
windows but the earliest are repeats. Together with the segments folded before, they give the ranges to remove.

Texts meet small rows by document twice, to cut segments and to remove ranges; these two joins are all that moves texts.

Defined cases: null text is empty; texts shorter than LENGTH lose nothing; a null id is the smallest; rows of one id
are one document's, told apart by a 14-bit hash of their texts when ranges are applied; repeated rows are one row and
get equal results. Extra columns pass by.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from policylake.llm._arrow import mixed, row_of, sliced, text_bytes
from policylake.llm._links import stored
from policylake.llm.suffixes import joined, permuted_prefixes, suffix_array

LENGTH = 100
GRAM = 32
SHARD_BYTES = 2 << 20
_SPAN, _TAG = 7, 14  # bits: windows in a segment less one; hash of the text


def _grams(raw: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes at each place where they fit."""
    n = len(raw) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    buffer = np.ascontiguousarray(raw).tobytes()
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(0, GRAM, 8):
            total = (total ^ np.ndarray((n,), "<u8", buffer, k, (1,))) * np.uint64(0x9E3779B97F4A7C15)
            total ^= total >> np.uint64(32)
    return total


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    n = len(values) - width + 1
    padded = np.concatenate([values, np.full(-len(values) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[width - 1:width - 1 + n])


def _segments(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, windows less one, hash of the anchor, hash of the segment), places within the text."""
    width = LENGTH - GRAM + 1
    grams = _grams(raw)
    if len(grams) < width:
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    # The upper bits of the hash decide, then the place: the leftmost of equal anchors.
    bits = max(20, int(len(grams)).bit_length())
    least = _least((grams >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(grams), dtype=np.uint64), width)
    anchor = (least & np.uint64((1 << bits) - 1)).astype(np.int64)
    rows = row_of(offsets)[:len(anchor)]
    inside = np.arange(len(anchor)) + LENGTH <= offsets[rows + 1]
    at = np.flatnonzero(inside)
    if not len(at):
        return tuple(np.zeros(0, np.int64) for _ in range(3)) + tuple(np.zeros(0, np.uint64) for _ in range(2))
    begins = np.concatenate([[True], (anchor[at[1:]] != anchor[at[:-1]]) | (rows[at[1:]] != rows[at[:-1]])])
    first = at[begins]
    last = at[np.concatenate([begins[1:], [True]])]
    with np.errstate(over="ignore"):
        # The grams read cover the segment from end to end, so its hash speaks for all its bytes.
        whole = (last - first).astype(np.uint64) + np.uint64(1)
        for base in (first, last):
            for k in (0, GRAM, 2 * GRAM, LENGTH - GRAM):
                whole = mixed(whole * np.uint64(0x9E3779B97F4A7C15) + grams[base + k])
        key = mixed(grams[anchor[first]])
    return rows[first], first - offsets[rows[first]], last - first, key, whole


def _tag(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=2).digest(), "little") & ((1 << _TAG) - 1)


def _tags(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.array([_tag(raw[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:])], np.int64)


def _occurrences(docs: DataFrame, kind: str) -> DataFrame:
    """(anchor, segment, doc, at): hashes and place of every segment; ``at`` packs first window, windows, text hash."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            raw, offsets = text_bytes(part.column("text"))
            row, first, span, anchor, whole = _segments(raw, offsets)
            if not len(row):
                continue
            at = (first << (_SPAN + _TAG)) | (span << _TAG) | _tags(raw, offsets)[row]
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), part.column("doc").take(pa.array(row)),
                pa.array(at, pa.int64())], ["anchor", "segment", "doc", "at"])
    return docs.select("doc", "text").mapInArrow(run, f"anchor long, segment long, doc {kind}, at long")


def _cut(texts: DataFrame, wanted: DataFrame, kind: str) -> DataFrame:
    """(anchor, doc, at, bytes) of the wanted places (key, list of (anchor, at))."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            raw, offsets = text_bytes(part.column("text"))
            tags = _tags(raw, offsets)
            lists = part.column("places")
            rows = np.repeat(np.arange(part.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            flat = lists.flatten()
            anchor, at = (flat.field(k).to_numpy(zero_copy_only=False) for k in (0, 1))
            own = tags[rows] == at & ((1 << _TAG) - 1)
            rows, anchor, at = rows[own], anchor[own], at[own]
            first = offsets[rows] + (at >> (_SPAN + _TAG))
            size = ((at >> _TAG) & ((1 << _SPAN) - 1)) + LENGTH
            pieces = [raw[a:a + n].tobytes() for a, n in zip(first.tolist(), size.tolist())]
            yield pa.RecordBatch.from_arrays([pa.array(anchor), part.column("doc").take(pa.array(rows)), pa.array(at),
                                              pa.array(pieces, pa.binary())], ["anchor", "doc", "at", "bytes"])
    return texts.join(wanted, "key").select("doc", "text", "places").mapInArrow(
        run, f"anchor long, doc {kind}, at long, bytes binary")


def _ranges(text: np.ndarray, starts: np.ndarray, spans: np.ndarray, document: np.ndarray, place: np.ndarray
            ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, first, last): runs of windows, by number in their segment, that also start earlier.

    document and place order the segments; windows of a segment follow its place.
    """
    order = suffix_array(text, LENGTH + (1 << _SPAN))
    shared = permuted_prefixes(text, order)
    windows = np.zeros(len(text), bool)
    counts = spans + 1
    segment = np.repeat(np.arange(len(starts)), counts)
    number = np.arange(len(segment)) - np.repeat(np.cumsum(counts) - counts, counts)
    at = starts[segment] + number
    windows[at] = True
    when = np.zeros(len(text), np.int64)
    when[at] = (document[segment] << 36) + place[segment] + number
    classes = np.cumsum(shared[order] < LENGTH)
    held = windows[order]
    listed, classes = order[held], classes[held]
    if not len(listed):
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    begins = np.flatnonzero(np.concatenate([[True], classes[1:] != classes[:-1]]))
    earliest = np.repeat(np.minimum.reduceat(when[listed], begins), np.diff(np.concatenate([begins, [len(listed)]])))
    repeat = np.zeros(len(text), bool)
    repeat[listed[when[listed] > earliest]] = True
    flag = repeat[at]
    begins = flag & ~np.concatenate([[False], flag[:-1] & (segment[1:] == segment[:-1])])
    ends = flag & ~np.concatenate([flag[1:] & (segment[1:] == segment[:-1]), [False]])
    return segment[begins], number[begins], number[ends]


def _shards(cut: DataFrame, kind: str) -> DataFrame:
    """(doc, tag, first, past): byte ranges that repeat an earlier string, of segments dealt out by their anchor."""
    def solved(rows: pa.Table) -> pa.RecordBatch:
        at = rows["at"].to_numpy()
        docs = rows["doc"].combine_chunks().dictionary_encode()
        names = docs.dictionary.to_pylist()
        ranks = {d: k for k, d in enumerate(sorted(names, key=lambda d: (d is not None, d)))}
        rank = np.array([ranks[d] + 1 for d in names] or [0], np.int64)
        document = rank[np.nan_to_num(docs.indices.to_numpy(zero_copy_only=False).astype(float)).astype(np.int64)]
        document[rows["doc"].is_null().to_numpy()] = 0
        text, starts = joined(rows["bytes"].to_pylist())
        first = at >> (_SPAN + _TAG)
        segment, low, high = _ranges(text, starts, (at >> _TAG) & ((1 << _SPAN) - 1), document, first)
        return pa.RecordBatch.from_arrays([
            rows["doc"].combine_chunks().take(pa.array(segment)), pa.array(at[segment] & ((1 << _TAG) - 1)),
            pa.array(first[segment] + low), pa.array(first[segment] + high + LENGTH)], ["doc", "tag", "first", "past"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size >= SHARD_BYTES:
                table = pa.Table.from_batches(held)
                anchors = table["anchor"].to_numpy()
                done = int(np.searchsorted(anchors, anchors[-1], "left"))  # the last anchor may go on
                if done:
                    yield from solved_parts(table.slice(0, done))
                    held = table.slice(done).combine_chunks().to_batches()
                    size = sum(b.nbytes for b in held)
        if held:
            yield from solved_parts(pa.Table.from_batches(held))

    def solved_parts(table: pa.Table) -> Iterator[pa.RecordBatch]:
        """Parts of whole anchors, of about SHARD_BYTES."""
        anchors = table["anchor"].to_numpy()
        sizes = np.cumsum((table["at"].to_numpy() >> _TAG & ((1 << _SPAN) - 1)) + LENGTH)
        ends = np.concatenate([np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, [len(anchors)]])
        start, base = 0, 0
        while start < len(anchors):
            past = int(np.searchsorted(sizes[ends - 1], base + SHARD_BYTES, "right"))
            end = int(ends[min(max(past - 1, np.searchsorted(ends, start, "right")), len(ends) - 1)])
            yield solved(table.slice(start, end - start))
            start, base = end, int(sizes[end - 1])

    return cut.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(
        run, f"doc {kind}, tag long, first long, past long")


def repeated_ranges(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(texts, ranges): texts (key, doc, text), and per key its byte ranges (tag, first, past)."""
    plain = docs.select(F.xxhash64(key).alias("key"), F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    kind = plain.schema["doc"].dataType.simpleString()
    place = F.struct("doc", F.shiftright("at", _SPAN + _TAG).alias("start"))
    by_anchor, by_segment = Window.partitionBy("anchor"), Window.partitionBy("anchor", "segment")
    met = _occurrences(plain, kind).withColumn("n", F.count(F.lit(1)).over(by_anchor)).where("n > 1") \
        .withColumn("differ", F.min("segment").over(by_anchor) != F.max("segment").over(by_anchor)) \
        .withColumn("first", F.min(place).over(by_segment) == place)
    # A segment that stands alone and differs, or the first of equal ones, is searched; equal later ones go whole.
    met = stored(met.where("differ or not first").select("anchor", "doc", "at", "differ", "first"), "segments")
    wanted = met.where("differ and first").dropDuplicates(["anchor", "doc", "at"]).groupBy(F.xxhash64("doc").alias("key")).agg(
        F.collect_list(F.struct("anchor", "at")).alias("places"))
    found = _shards(_cut(plain, wanted, kind), kind)
    start = F.shiftright("at", _SPAN + _TAG)
    folded = met.where("not first").select(
        "doc", F.col("at").bitwiseAND((1 << _TAG) - 1).alias("tag"), start.alias("first"),
        (start + F.shiftright("at", _TAG).bitwiseAND((1 << _SPAN) - 1) + LENGTH).alias("past"))
    ranges = found.unionByName(folded).groupBy(F.xxhash64("doc").alias("key")).agg(
        F.collect_set(F.struct("tag", "first", "past")).alias("ranges"))
    return plain, ranges


def _merged(ranges: np.ndarray) -> np.ndarray:
    """Maximal runs of the union of (first, past) rows."""
    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
    reach = np.maximum.accumulate(ranges[:, 1])
    begins = np.concatenate([[True], ranges[1:, 0] > reach[:-1]])
    return np.stack([ranges[begins, 0], reach[np.concatenate([begins[1:], [True]])]], axis=1)


def without_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_bytes, removed, kept): per row its maximal removed runs (first, past) and the bytes that stay."""
    texts, ranges = repeated_ranges(docs, key, text)
    kind = texts.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches):
            raw, offsets = text_bytes(part.column("text"))
            lists = part.column("ranges").to_pylist()
            removed, kept = [], []
            for a, b, listed in zip(offsets[:-1].tolist(), offsets[1:].tolist(), lists):
                body = raw[a:b]
                own = []
                if listed:
                    tag = _tag(body.tobytes())
                    own = [(r["first"], r["past"]) for r in listed if r["tag"] == tag and r["past"] <= b - a]
                if own:
                    runs = _merged(np.array(own, np.int64))
                    edge = np.zeros(b - a + 1, np.int8)
                    edge[runs[:, 0]] += 1
                    edge[runs[:, 1]] -= 1
                    kept.append(body[np.cumsum(edge[:-1]) == 0].tobytes())
                    removed.append([{"first": int(x), "past": int(y)} for x, y in runs])
                else:
                    kept.append(body.tobytes())
                    removed.append([])
            spans = pa.list_(pa.struct([("first", pa.int64()), ("past", pa.int64())]))
            yield pa.RecordBatch.from_arrays([
                part.column("doc"), pa.array(np.diff(offsets), pa.int64()), pa.array(removed, spans),
                pa.array(kept, pa.binary())], ["doc", "n_bytes", "removed", "kept"])

    return texts.join(ranges, "key", "left").select("doc", "text", "ranges").mapInArrow(
        run, f"doc {kind}, n_bytes long, removed array<struct<first:bigint,past:bigint>>, kept binary")
