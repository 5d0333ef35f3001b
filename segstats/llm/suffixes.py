"""Removal of repeated 100-byte strings with sharded suffix arrays.

Every byte that lies in a ``length``-byte string which also starts earlier in the corpus is removed. The steps:

1. Exact copies of a whole text are set aside; all but the smallest id are removed whole.
2. Every window of ``length`` bytes belongs to the smallest of its k-gram hashes (its anchor), so equal windows have equal
   anchors. Neighbouring windows with one anchor form a segment. Segments are dealt out by anchor hash, once.
3. A segment with the same bytes as an earlier one is removed. Anchors with a single segment are dropped.
4. What is left, first segments whose anchor has other segments too, is gathered in shards of bounded size. Each shard
   gets a suffix array by induced sorting (``suffix_array``). The common prefix of each window with its predecessor, kept in
   text order, tells runs of equal windows, and all but the earliest window of a run are removed.
5. An anchor with more than ``group_limit`` segments does not fit a shard; its windows are compared by grouping them.

Texts are shuffled only where they have segments to compare or bytes to remove.

Defined cases: a null or empty text has no bytes; rows with equal id and equal text are one document (none is earlier); rows with
equal id and other text are compared by start; a null id comes before all others; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segstats.llm.common import as_bytes, bounded_batches, map_rows, merge_spans, small, texts
from segstats.session import materialize

LENGTH = 100
GRAM = 32
#: Bytes of text that are scanned at a time; positions in such a piece fit 20 bits.
PIECE = 1 << 19
SHARD_BYTES = 1 << 19
#: Segments of one anchor that may go to one shard.
GROUP_LIMIT = 2000
LOW_BITS = np.uint64((1 << 20) - 1)
RANDOM = np.random.default_rng(20).integers(1, 2**64 - 1, 256, dtype=np.uint64)
PRIME = np.uint64(0x9E3779B97F4A7C15)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the GRAM bytes from each position on, by doubling."""
    h = {1: RANDOM[data]}
    size = 1
    while 2 * size <= GRAM:
        h[2 * size] = h[size][:-size] + h[size][size:] * PRIME ** np.uint64(size)
        size *= 2
    out, done = None, 0
    for size in sorted(h, reverse=True):
        if GRAM & size:
            n = len(data) - GRAM + 1
            part = h[size][done:done + n] * PRIME ** np.uint64(done)
            out = part if out is None else out + part
            done += size
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ out >> np.uint64(29)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    rest = width - size
    return np.minimum(values[:len(values) - rest], values[rest:]) if rest else values


def segments(data: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(anchor hash, first window, last window)`` of every segment in texts that are laid end to end."""
    none = np.array([], dtype=np.int64)
    if len(data) < length:
        return none.view(np.uint64), none, none
    hashes = gram_hashes(data)
    keyed = (hashes & ~LOW_BITS) | np.arange(len(hashes), dtype=np.uint64)
    anchor = (sliding_min(keyed, length - GRAM + 1) & LOW_BITS).astype(np.int64)
    starts = np.concatenate(([0], ends[:-1]))
    left = np.repeat(ends, ends - starts)[:len(anchor)] - np.arange(len(anchor))
    window = np.flatnonzero(left >= length)  # those that do not leave their text
    if not len(window):
        return none.view(np.uint64), none, none
    own = anchor[window]
    new = np.flatnonzero(np.diff(own, prepend=-1) != 0)
    last = np.append(new[1:], len(own)) - 1
    return hashes[own[new]], window[new], window[last]


def pieces(source: Iterator[tuple], length: int) -> Iterator[list[tuple]]:
    """Groups of ``(id, text hash, offset, bytes)`` of about PIECE bytes; long texts are cut with windows kept whole."""
    some, size = [], 0
    for doc, text_hash, raw in source:
        for at in range(0, max(1, len(raw) - length + 1), PIECE):
            part = raw[at:at + PIECE + length - 1]
            if size and size + len(part) > 2 * PIECE - length:
                yield some
                some, size = [], 0
            some.append((doc, text_hash, at, part))
            size += len(part)
    if some:
        yield some


def anchors(docs: DataFrame, length: int) -> DataFrame:
    """``(anchor, content, doc_id, text_hash, start, size, known)``: one row per segment of every text.

    A segment whose bytes a piece has already had, in a smaller id or further up in the text, is ``known`` to be a repeat.
    It needs no comparison and gets a number of its own as anchor, so that frequent lines do not gather anywhere.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns]))
        for some in pieces(source, length):
            data = b"".join(p[3] for p in some)
            ends = np.cumsum([len(p[3]) for p in some])
            anchor, first, last = segments(np.frombuffer(data, dtype=np.uint8), ends, length)
            which = np.searchsorted(ends, first, side="right")
            shift = np.array([p[2] for p in some]) - np.concatenate(([0], ends[:-1]))
            digest = xxhash.xxh3_64_intdigest
            view = memoryview(data)
            content = np.array([digest(view[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())], dtype=np.uint64)
            doc = np.array([p[0] for p in some], dtype=np.int64)[which]
            start = first + shift[which]
            order = np.lexsort((start, doc, content, anchor))
            same = (np.diff(anchor[order]) == 0) & (np.diff(content[order]) == 0)
            moved = (np.diff(doc[order]) != 0) | (np.diff(start[order]) != 0)
            # a run of equal segments begins with its earliest; those at the same place in a repeated row are no repeats
            run = np.cumsum(np.append(True, ~same)[:len(order)])
            later = np.cumsum(np.append(False, moved)[:len(order)])
            known = np.zeros(len(order), dtype=bool)
            known[order] = later > later[np.flatnonzero(np.append(True, ~same)[:len(order)])[run - 1]]
            lone = content ^ (doc.view(np.uint64) * PRIME + start.astype(np.uint64)) * RANDOM[0]
            anchor = np.where(known, lone, anchor)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(anchor.view(np.int64)), pa.array(content.view(np.int64)), pa.array(doc),
                    pa.array(np.array([p[1] for p in some], dtype=np.int32)[which]),
                    pa.array(start.astype(np.int32)), pa.array((last - first + length).astype(np.int32)), pa.array(known),
                ],
                names=["anchor", "content", "doc_id", "text_hash", "start", "size", "known"],
            )

    return bounded_batches(docs.select("doc_id", "text_hash", "text")).mapInArrow(
        run, "anchor bigint, content bigint, doc_id bigint, text_hash int, start int, size int, known boolean"
    )


def pick(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join on ``(doc_id, text_hash)``, with the keys broadcast if they are counted to be few."""
    return docs.join(small(keys), ["doc_id", "text_hash"], how)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` (uint16, ending in a unique 0) in the order of at least their first ``depth`` symbols.

    Suffixes are smaller (S) or larger (L) than their successors. Leftmost S substrings are sorted by one induction and named;
    names that are not unique are sorted as a string of their own; a second induction from them orders all suffixes.
    """
    step = np.sign(np.diff(text.astype(np.int32)))
    place = np.where(step != 0, np.arange(len(step)), len(step) - 1)
    small = np.append(step[np.minimum.accumulate(place[::-1])[::-1]] > 0, True)
    leftmost = np.flatnonzero(small[1:] & ~small[:-1]).astype(np.int32) + 1
    order = induce(text, small, leftmost)
    is_leftmost = np.zeros(len(text), dtype=bool)
    is_leftmost[leftmost] = True
    by_substring = order[is_leftmost[order]]
    names = name_substrings(text, leftmost, by_substring)
    return induce(text, small, leftmost[sort_names(names, depth)])


def induce(text: np.ndarray, small: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """All suffixes from the leftmost S suffixes in ``seeds``, which are in order inside each bucket.

    A bucket hands the predecessors of its suffixes on to their buckets, in order: L ones upwards, then S ones downwards.
    """
    width = int(text.max()) + 1
    seeds = seeds[np.argsort(text[seeds], kind="stable")]
    edges = np.searchsorted(text[seeds], np.arange(width + 1))

    def sweep(buckets: range, of_type: bool, last: list[np.ndarray]) -> list[np.ndarray]:
        waiting: list[list[np.ndarray]] = [[] for _ in range(width)]
        done = [seeds[:0]] * width
        if of_type:
            waiting[0].append(np.array([len(text) - 1], dtype=np.int32))  # nothing induces the end
        for c in buckets:
            own, front = [], np.concatenate(waiting[c]) if waiting[c] else seeds[:0]
            while len(front):
                own.append(front)
                front = hand_on(front, of_type, c, waiting)
            hand_on(last[c], of_type, c, waiting)
            done[c] = np.concatenate(own) if own else seeds[:0]
        return done

    def hand_on(front: np.ndarray, of_type: bool, c: int, waiting: list) -> np.ndarray:
        """Predecessors of one type to their buckets; those in bucket ``c`` itself are returned."""
        before = front[front > 0] - 1
        before = before[small[before] == of_type]
        if not len(before):
            return before
        symbol = text[before]
        order = np.argsort(symbol, kind="stable")
        before, symbol = before[order], symbol[order]
        cuts = np.flatnonzero(np.diff(symbol)) + 1
        same = before[:0]
        for part, k in zip(np.split(before, cuts), symbol[np.concatenate(([0], cuts))].tolist()):
            if k == c:
                same = part
            else:
                waiting[k].append(part)
        return same

    large = sweep(range(width), False, [seeds[edges[c]:edges[c + 1]] for c in range(width)])
    small_ = sweep(range(width - 1, -1, -1), True, [x[::-1] for x in large])
    return np.concatenate([x for c in range(width) for x in (large[c], small_[c][::-1])])


def name_substrings(text: np.ndarray, leftmost: np.ndarray, ordered: np.ndarray) -> np.ndarray:
    """A number for every leftmost S substring (to the next one's first symbol), in text order; equal ones share it."""
    size = np.diff(np.append(leftmost, len(text) - 1)) + 1
    place = np.searchsorted(leftmost, ordered)
    length = size[place]
    equal = np.append(False, length[1:] == length[:-1])
    active = np.flatnonzero(equal)
    offset = 0
    while len(active):
        a, b = ordered[active], ordered[active - 1]
        differ = text[a + offset] != text[b + offset]
        equal[active[differ]] = False
        offset += 1
        active = active[~differ]
        active = active[length[active] > offset]
    names = np.empty(len(leftmost), dtype=np.int64)
    names[place] = np.cumsum(~equal)
    return names


def sort_names(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of ``names``: doubling until all differ or ``depth`` symbols are covered.

    Bucket-wise induction pays for small alphabets only; here there are nearly as many names as places, and a name
    stands for two symbols at least, so the rounds are few.
    """
    rank, reach = names, 1
    while reach < depth and len(np.unique(rank)) < len(rank):
        following = np.zeros_like(rank)
        following[:-reach] = rank[reach:]
        key = rank * (len(rank) + 2) + following
        rank = np.unique(key, return_inverse=True)[1] + 1
        reach *= 2
    return np.argsort(rank, kind="stable")


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    out = np.zeros(len(data) - 7, dtype=np.uint64)
    for k in range(8):
        out |= data[k:len(data) - 7 + k].astype(np.uint64) << np.uint64(8 * k)
    return out


def common_prefix_runs(data: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """For window positions in suffix order: a run number; windows of one run have a common prefix of ``length`` or more."""
    words = words_at(np.append(data, np.zeros(8, dtype=np.uint8)))
    before = np.full(len(data), -1, dtype=np.int64)  # the permuted array: each window's predecessor, by place in the text
    before[order[1:]] = order[:-1]
    at = np.flatnonzero(before >= 0)
    offsets = [*range(0, length - 7, 8), length - 8]
    for k in offsets:
        at = at[words[at + k] == words[before[at] + k]]
    long_prefix = np.zeros(len(data), dtype=bool)
    long_prefix[at] = True
    return np.cumsum(~long_prefix[order])


def repeats(docs: np.ndarray, starts: np.ndarray, parts: list[bytes], length: int) -> list[tuple[int, int, int]]:
    """``(segment, first byte, end)`` of windows that also start earlier, as ``(doc, start)`` goes; bytes inside segments."""
    sizes = np.array([len(p) for p in parts])
    ends = np.cumsum(sizes + 1)
    data = np.frombuffer(b"\0".join(parts) + b"\0", dtype=np.uint8)
    text = data.astype(np.uint16) + 2
    text[ends - 1] = 1  # between segments
    which = np.repeat(np.arange(len(parts), dtype=np.int32), sizes + 1)
    inside = np.arange(len(data), dtype=np.int32) - (ends - sizes - 1).astype(np.int32)[which]
    order = suffix_array(np.append(text, np.uint16(0)), length)
    order = order[order < len(data)]
    order = order[sizes[which[order]] - inside[order] >= length]
    if not len(order):
        return []
    run = common_prefix_runs(data, order, length)
    doc, start = docs[which[order]], starts[which[order]] + inside[order]
    age = np.lexsort((start, doc))
    place = np.empty(len(age), dtype=np.int64)
    place[age] = np.cumsum(np.append(0, (np.diff(doc[age]) != 0) | (np.diff(start[age]) != 0)))
    first = np.minimum.reduceat(place, np.flatnonzero(np.append(True, np.diff(run) != 0)))
    later = order[place > first[run - run[0]]]
    hit = np.zeros(len(data), dtype=bool)
    hit[later] = True
    found = np.flatnonzero(hit)
    if not len(found):
        return []
    new = np.flatnonzero((np.diff(found, prepend=-2) != 1) | (np.diff(which[found], prepend=-1) != 0))
    last = np.append(new[1:], len(found)) - 1
    return [
        (int(which[a]), int(inside[a]), int(inside[b]) + length) for a, b in zip(found[new].tolist(), found[last].tolist())
    ]


KEY = ["doc_id", "text_hash"]
RANGE = "doc_id bigint, text_hash int, start bigint, end bigint"


def array_ranges(cut: DataFrame, shards: int, length: int) -> DataFrame:
    """Ranges of segments that a shard's suffix array finds to start earlier too."""

    def run(shard: pa.Table) -> pa.Table:
        docs, hashes, starts = (shard.column(c).to_numpy() for c in ("doc_id", "text_hash", "start"))
        found = repeats(docs, starts.astype(np.int64), shard.column("bytes").to_pylist(), length)
        k = np.array([f[0] for f in found], dtype=np.int64)
        base = starts[k].astype(np.int64)
        return pa.table({
            "doc_id": docs[k], "text_hash": hashes[k], "start": base + np.array([f[1] for f in found], dtype=np.int64),
            "end": base + np.array([f[2] for f in found], dtype=np.int64),
        })

    shard = F.pmod(F.xxhash64("anchor"), F.lit(shards))
    return cut.select(shard.alias("shard"), *KEY, "start", "bytes").groupBy("shard").applyInArrow(run, RANGE)


def window_ranges(cut: DataFrame, length: int) -> DataFrame:
    """The same for anchors with too many segments: windows are grouped by 128 bits of their SHA-256."""
    each = cut.select(*KEY, "start", "bytes", F.explode(F.sequence(F.lit(0), F.octet_length("bytes") - length)).alias("k"))
    window = F.substring("bytes", F.col("k") + 1, length)
    at = (F.col("start") + F.col("k")).cast("bigint")
    each = each.select(*KEY, at.alias("start"), F.unhex(F.substring(F.sha2(window, 256), 1, 32)).alias("window"))
    place = F.struct("doc_id", "start")
    first = each.groupBy("window").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    later = each.join(first, "window").filter(place > F.col("first"))
    return later.select(*KEY, "start", (F.col("start") + length).alias("end"))


def cut_segments(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """Bytes of the segments in ``wanted``, each text being read once."""
    per_doc = wanted.groupBy(*KEY).agg(F.collect_list(F.struct("anchor", "start", "size", "segments")).alias("wanted"))
    per_doc = materialize(per_doc, "wanted")
    joined = pick(docs, per_doc.select(*KEY), "left_semi").join(per_doc, KEY)

    def rows(source):
        for doc, text_hash, raw, some in source:
            for w in some:
                yield w["anchor"], w["segments"], doc, text_hash, w["start"], raw[w["start"]:w["start"] + w["size"]]

    schema = "anchor bigint, segments bigint, doc_id bigint, text_hash int, start int, bytes binary"
    return map_rows(joined.select(*KEY, "text", "wanted"), schema, rows)


def repeated_ranges(docs: DataFrame, length: int, shard_bytes: int, group_limit: int) -> DataFrame:
    """``(doc_id, text_hash, ranges)`` of the texts ``docs (doc_id, text_hash, text)`` in which bytes are to be removed."""
    same = Window.partitionBy("anchor", "content").orderBy("doc_id", "start")
    own = Window.partitionBy("anchor")
    placed = (
        anchors(docs, length)
        .repartition("anchor")  # one exchange for both windows
        .withColumn("place", F.when(F.col("known"), 2).otherwise(F.rank().over(same)))
        .withColumn("segments", F.sum((F.col("place") == 1).cast("int")).over(own))
        .filter("place > 1 OR segments > 1")
    )
    placed = materialize(placed.select("anchor", *KEY, "start", "size", "place", "segments"), "segments")
    first = placed.filter("place = 1")
    total, most = first.agg(F.sum(F.when(F.col("segments") <= group_limit, F.col("size"))), F.max("segments")).first()
    ranges = placed.filter("place > 1").select(*KEY, F.col("start").cast("bigint").alias("start"), (F.col("start") + F.col("size")).cast("bigint").alias("end"))
    if most is not None:
        cut = materialize(cut_segments(docs, first), "cut")
        ranges = ranges.unionByName(array_ranges(cut.filter(F.col("segments") <= group_limit), max(1, -(-(total or 0) // shard_bytes)), length))
        if most > group_limit:
            ranges = ranges.unionByName(window_ranges(cut.filter(F.col("segments") > group_limit), length))
    return materialize(ranges.groupBy(*KEY).agg(F.collect_list(F.struct("start", "end")).alias("ranges")), "ranges")


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, shard_bytes: int = SHARD_BYTES,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """``(doc_id, n_bytes, removed, kept)``: maximal removed byte ranges and the remaining bytes of every text.

    Ids are integers.
    """
    null_id = -(2**63)
    base = as_bytes(texts(docs, id_col, text_col)).select(
        F.coalesce(F.col("doc_id").cast("bigint"), F.lit(null_id)).alias("doc_id"), "text", F.hash("text").alias("text_hash")
    )
    digests = base.select(*KEY, F.sha2("text", 256).alias("digest")).filter(F.octet_length("text") >= length)
    shared = digests.groupBy("digest").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last")
    copies = materialize(digests.join(shared, "digest").filter("doc_id > first").select(*KEY).distinct(), "copies")
    found = repeated_ranges(pick(base, copies, "left_anti"), length, shard_bytes, group_limit)
    kind = "array<struct<start:bigint,end:bigint>>"

    def rows(source):
        for doc, raw, ranges in source:
            merged, kept, at = merge_spans([(r["start"], r["end"]) for r in ranges]), [], 0
            for start, end in merged:
                kept.append(raw[at:start])
                at = end
            yield doc, len(raw), merged, b"".join([*kept, raw[at:]])

    changed = map_rows(
        pick(base, found.select(*KEY), "left_semi").join(found, KEY).select("doc_id", "text", "ranges"),
        f"doc_id bigint, n_bytes bigint, removed {kind}, kept binary", rows, per_batch=256,
    )
    size = F.octet_length("text").cast("bigint")
    gone = pick(base, copies, "left_semi").select(
        "doc_id", size.alias("n_bytes"), F.array(F.struct(F.lit(0).cast("bigint").alias("start"), size.alias("end"))).alias("removed"),
        F.lit(b"").alias("kept"),
    )
    rest = pick(base, found.select(*KEY).unionByName(copies), "left_anti").select(
        "doc_id", size.alias("n_bytes"), F.array().cast(kind).alias("removed"), F.col("text").alias("kept")
    )
    every = changed.unionByName(gone).unionByName(rest)
    return every.withColumn("doc_id", F.when(F.col("doc_id") != null_id, F.col("doc_id")))
