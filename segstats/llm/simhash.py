"""SimHash near-duplicates with vantage-point trees.

A text's fingerprint has a bit set where more than half of its 3-word shingles' hashes have it. Fingerprints that differ in
``radius`` bits or fewer are linked; documents linked directly or through others form a component.

Equal fingerprints are one point from the start, whatever their number. A tree of vantage points, fitted on a bounded
sample of fingerprints, cuts the points into shards: the nearer half of a node goes in, the farther out. By the triangle
inequality a link across the cut needs a distance of at most cut + radius from the vantage point, so only such outer points
also visit the inner side. Inside a shard the same cuts go on until a few points are left, which are compared. So every
linked pair meets in one shard. A shard of too many points is compared in blocks of bounded size. Each block reports a
spanning forest of its links, never all pairs, and the forests are joined by star contraction.

64-bit fingerprints of unrelated texts lie 32 bits apart, give or take 4, so with radius 3 about half of the points stand near
a cut: pruning is exact but modest, and comparisons grow as points to the power of about 1.6.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; repeated rows share a component; a null
id is never a component's name unless all its ids are null; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import LOWER_BYTES, as_bytes, map_rows, small, texts
from segstats.operators.components import union_edges
from segstats.session import materialize

RADIUS = 3
SEED = 42
#: Fingerprints that the vantage points are taken from; every fingerprint is indexed.
SAMPLE = 8192
#: Points of a shard (8 bytes each) and of one block of an overfull shard.
SHARD_POINTS = 1 << 16
BLOCK_POINTS = 1 << 18
#: Points that are compared without a further cut.
LEAF = 64
CHUNK = 1 << 15


def fingerprint(raw: bytes) -> int:
    words = raw.translate(LOWER_BYTES).split()
    if not words:
        return 0
    joined, hash64 = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) < 3:
        hashes = [hash64(joined, SEED)]
    else:
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = [0, *ends[:-3].tolist()]
        hashes = [hash64(joined[a:b], SEED) for a, b in zip(starts, (ends[2:] - 1).tolist())]
    return majority(np.array(hashes, dtype="<u8"))


def majority(hashes: np.ndarray) -> int:
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at:at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_hash: bool = False) -> DataFrame:
    """``(doc_id, fp[, text_hash])`` with the 64 bits in a BIGINT."""
    kind = docs.schema[id_col].dataType.simpleString()
    if not with_hash:
        return map_rows(
            as_bytes(texts(docs, id_col, text_col)), f"doc_id {kind}, fp bigint",
            lambda rows: ((d, fingerprint(raw)) for d, raw in rows),
        )
    hashed = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))
    return map_rows(
        as_bytes(hashed, "text_hash"), f"doc_id {kind}, fp bigint, text_hash bigint",
        lambda rows: ((d, fingerprint(raw), h) for d, raw, h in rows),
    )


def distance(points: np.ndarray, one: int) -> np.ndarray:
    return np.bitwise_count(points ^ np.uint64(one))


class Tree:
    """Cuts ``(vantage, cut, inner, outer)``; a negative child ``-1 - k`` is shard k."""

    def __init__(self, sample: np.ndarray, shards: int):
        self.nodes: list[list[int]] = []
        self.shards = 0
        self.root = self._grow(sample, max(1, len(sample) // max(1, shards)), np.random.default_rng(7))

    def _grow(self, points: np.ndarray, least: int, rng) -> int:
        if len(points) > least:
            vantage = int(points[rng.integers(len(points))])
            d = distance(points, vantage)
            cut = int(np.median(d))
            if 0 < np.count_nonzero(d <= cut) < len(points):
                node = len(self.nodes)
                self.nodes.append([vantage, cut, 0, 0])
                self.nodes[node][2] = self._grow(points[d <= cut], least, rng)
                self.nodes[node][3] = self._grow(points[d > cut], least, rng)
                return node
        self.shards += 1
        return -self.shards

    def route(self, points: np.ndarray, radius: int):
        """``(shard, home points, visiting points)``; every pair within ``radius`` meets with one of the two at home."""
        stack = [(self.root, points, points[:0])]
        while stack:
            node, home, away = stack.pop()
            if not len(home) and not len(away):
                continue
            if node < 0:
                yield -1 - node, home, away
                continue
            vantage, cut, inner, outer = self.nodes[node]
            dh, da = distance(home, vantage), distance(away, vantage)
            near = home[(dh > cut) & (dh <= cut + radius)]
            stack.append((inner, home[dh <= cut], np.concatenate([near, away[da <= cut + radius]])))
            stack.append((outer, home[dh > cut], away[da.astype(np.int16) > cut - radius]))


def links(home: np.ndarray, away: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among ``home`` points and between them and ``away`` points."""
    out_a, out_b = [], []
    rng = np.random.default_rng(len(home))
    stack = [(home, away, 0)]
    while stack:
        h, v, failed = stack.pop()
        if not len(h) or len(h) + len(v) < 2:
            continue
        if len(h) > LEAF and failed < 3:
            vantage = int(h[rng.integers(len(h))])
            dh, dv = distance(h, vantage), distance(v, vantage)
            cut = int(np.median(dh))
            inside = dh <= cut
            if inside.all():  # all at one distance; another vantage point may tell them apart
                stack.append((h, v, failed + 1))
                continue
            near = h[~inside & (dh <= cut + radius)]
            stack.append((h[inside], np.concatenate([near, v[dv <= cut + radius]]), 0))
            stack.append((h[~inside], v[dv.astype(np.int16) > cut - radius], 0))
            continue
        a, b = _compare(h, v, radius)
        out_a.append(a)
        out_b.append(b)
    none = np.array([], dtype=np.uint64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _compare(h: np.ndarray, v: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    every = np.concatenate([h, v])
    root = np.arange(len(every))
    found = False
    for row in range(0, len(h), LEAF):
        part = h[row:row + LEAF]
        for at in range(row, len(every), CHUNK):
            close = np.bitwise_count(part[:, None] ^ every[None, at:at + CHUNK]) <= radius
            i, j = np.nonzero(close)
            i, j = i + row, j + at
            new = (i < j) & (root[i] != root[j])
            if new.any():
                found = True
                old = root
                joined = union_edges(len(every), old[i[new]], old[j[new]])
                root = joined[old]
    if not found:
        return h[:0], h[:0]
    apart = root != np.arange(len(every))
    return every[apart], every[root[apart]]


def link_forest(points: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, shard_points: int = SHARD_POINTS,
                block_points: int = BLOCK_POINTS) -> DataFrame:
    """``(a, b)``: links that join all of ``points`` (distinct ``fp``) that are within ``radius`` of each other."""
    spark, n = points.sparkSession, points.count()
    chosen = points.orderBy(F.xxhash64("fp"), "fp").limit(sample).collect()
    wanted = max(-(-n // shard_points), min(2 * spark.sparkContext.defaultParallelism, n // 4096))
    tree = Tree(np.array(sorted(r.fp for r in chosen), dtype=np.int64).view(np.uint64), wanted)

    def place(batches):
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for shard, home, away in tree.route(fps, radius):
                both = np.concatenate([home, away])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(both), shard, dtype=np.int32)), pa.array(both.view(np.int64)),
                        pa.array(np.arange(len(both)) < len(home)),
                    ],
                    names=["shard", "fp", "home"],
                )

    placed = materialize(points.select("fp").mapInArrow(place, "shard int, fp bigint, home boolean"), "shards")
    # a shard with more points than fit one task is a grid of blocks of home and of all points
    load = placed.groupBy("shard").agg(F.count_if("home").alias("h"), F.count("*").alias("n"))
    over = {r.shard: (-(-r.h // block_points), -(-r.n // block_points)) for r in load.filter(F.col("n") > block_points).collect()}
    cuts = spark.createDataFrame([(k, *v) for k, v in over.items()], "shard int, rows int, columns int")
    spread = placed.join(F.broadcast(cuts), "shard", "left").select(
        "shard", "fp", "home", F.coalesce("rows", F.lit(1)).alias("rows"), F.coalesce("columns", F.lit(1)).alias("columns")
    )
    part = lambda k: F.pmod(F.xxhash64("fp"), F.col(k)).cast("int")
    span = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    one = (F.col("rows") == 1) & (F.col("columns") == 1)
    as_home = spread.filter("home").select("shard", part("rows").alias("row"), F.explode(span("columns")).alias("column"), "fp", F.lit(True).alias("home"))
    # in a shard of one block the home points are compared among themselves
    as_query = spread.filter(~F.col("home") | ~one).select("shard", F.explode(span("rows")).alias("row"), part("columns").alias("column"), "fp", F.lit(False).alias("home"))

    def compare(cell: pa.Table) -> pa.Table:
        fps = cell.column("fp").to_numpy().view(np.uint64)
        home = cell.column("home").to_numpy(zero_copy_only=False)
        a, b = links(fps[home], fps[~home], radius)
        differ = a != b
        return pa.table({"a": a[differ].view(np.int64), "b": b[differ].view(np.int64)})

    cells = as_home.unionByName(as_query)
    return cells.groupBy("shard", "row", "column").applyInArrow(compare, "a bigint, b bigint").distinct()


def contract(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges``: the smallest node that it is connected with.

    Large-star and small-star steps in turn; each is a join with the nodes' smallest neighbours. Written every round.
    """
    edges = materialize(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = None
    while mark != (mark := tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).filter("a <> b").distinct()
        # now b is smaller than a in every edge
        least = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b"))
        )).alias("e")).select("e.*").filter("a <> b").distinct()
        edges = materialize(small, "links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def components(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``(fp, root, component_id)`` for every fingerprint in ``marked (doc_id, fp)``."""
    points = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("low")), "points")
    roots = contract(link_forest(points.select("fp"), radius)).withColumnRenamed("node", "fp")
    named = points.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return named.join(lowest, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``(doc_id, fp, component_id)``: fingerprint and the smallest id that a document is linked with, itself included."""
    marked = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    return marked.join(components(marked, radius), "fp").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each component: the smallest id (null last), of equal ids the smallest text hash, of
    equal rows any one.

    Only ids and hashes of the rows that go are joined with the texts.
    """
    marked = materialize(fingerprints(docs, id_col, text_col, with_hash=True), "fingerprints")
    return first_of_groups(docs, marked, components(marked, radius), id_col, text_col)


def first_of_groups(docs: DataFrame, marked: DataFrame, named: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each ``root`` in ``named (fp, root)``; ``marked (doc_id, fp, text_hash)`` has a row for each of ``docs``."""
    rows = marked.join(named, "fp").groupBy("root", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    rank = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    first = rows.groupBy("root").agg(F.min(rank).alias("first"))
    judged = materialize(rows.join(first, "root").select("doc_id", "text_hash", "n", (rank == F.col("first")).alias("stays")), "judged")
    judged = judged.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"})
    own = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    same = F.col(id_col).eqNullSafe(F.col("__id")) & (own == F.col("__hash"))
    repeated = judged.filter("stays AND n > 1")
    if repeated.isEmpty():
        return docs.join(small(judged.filter("NOT stays")), same, "left_anti")
    single = docs.join(small(judged.filter("NOT stays OR n > 1")), same, "left_anti")
    once = docs.join(small(repeated), same, "left_semi").withColumn("__hash", own).dropDuplicates([id_col, "__hash"])
    return single.unionByName(once.select(*docs.columns))
