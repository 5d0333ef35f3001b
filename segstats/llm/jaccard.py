"""Exact Jaccard join of shingle sets by a token-group matrix.

Two texts are linked if the Jaccard similarity of their sets of word shingles is ``percent`` / 100 or more; documents linked directly
or through others are one component. Equal sets are one point from the start, so copies cost no comparisons.

* **Shared blocks.** Tokens are dealt by hash into one more block than similar sets of that size can differ in tokens, so that two
  similar sets have a block in which they agree in every token (about nine and a half tokens at 90 %). Only points that share such a
  block can be linked: no link is lost, and a common word or passage alone makes no candidate.
* **Groups.** A point's home is its most shared block; points of one home form groups of at most ``GROUP``, so similar texts lie together.
  The matrix has a row per group: the union of its tokens, as a bitmap of ``BITS`` token classes.
* **Order of opening.** First every point meets the leader of its home, then that of one other group with which it shares a block, which
  joins the bulk of large clusters with one comparison a point; found links are contracted after each round.
* **Rare tokens.** What is left is dealt anew by each point's rarest tokens, of which similar sets share one (prefix filter); tokens that
  only one component has are lost to its points, and points that have lost too many go. So points beside a large cluster of near
  copies no longer meet all of it over what they have in common, but those that share their own changes.
* **Cells and bound.** A cell is a query group and a group that share such a token and are not one component. Tokens of a query whose class is not
  in a group's union are in none of its members; if the rest cannot reach the overlap that a link needs, the group is not opened
  for this query. In opened groups the members' own bitmaps bound the same way, and what remains is compared by whole sets in the same
  task, which gives out a forest of links: no more rows than the cell has points, however many pairs are similar or nearly so.

Tokens are 64-bit hashes (two tokens of a pair are equal by chance once in
10^13 pairs or so), as are components where tokens are counted; points are named by 128 bits.

Defined cases: a null or empty text, or one without words, has an empty set, which is linked with nothing, not even with others of its
kind; with fewer words than a shingle has the whole sequence is one; repeated rows and ids are rows of their own in one component,
whose id is the least that is not null; an empty table gives no rows. Only id and text are read, so other columns cannot clash.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstats.llm.common import LOWER_BYTES, as_bytes, map_rows, small, texts
from segstats.llm.simhash import contract
from segstats.operators.components import union_edges
from segstats.operators.grouped import changes, stream_groups
from segstats.session import materialize

WORDS, PERCENT = 3, 90
#: Points of a group, token classes of a bitmap, rounds in which leaders of other groups are compared, and in which some of the cells
#: are opened before all that are left.
GROUP, BITS, HUBS, PICKS = 64, 4096, 1, 2
#: Ratio of the sizes in a class.
SIZE_CLASS = 1.02
#: Of two groups with their least and greatest components: not all in one component.
APART = "ga <= gb AND (low <> high OR low_b <> high_b OR low <> low_b)"
#: Links (some 40 bytes each) that one task joins.
LINKS_PER_TASK = 1_000_000
SEED = 42
MIX_A, MIX_B, MIX_C = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_A
    x = (x ^ (x >> np.uint64(27))) * MIX_B
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """Hashes of the words met, for as many as stay in memory."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 200_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, SEED)
        return value


HASHES = WordHashes()


def shingle_set(raw: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles; with fewer words the whole sequence is one, without any there is none."""
    own = raw.translate(LOWER_BYTES).split()
    if not own:
        return np.empty(0, dtype=np.uint64)
    each = np.fromiter(map(HASHES.__getitem__, own), dtype=np.uint64, count=len(own))
    wide = min(words, len(own))
    out = np.full(len(own) - wide + 1, wide, dtype=np.uint64)
    for k in range(wide):
        out = mix(out + MIX_C) + each[k:len(own) - wide + 1 + k]
    return np.unique(mix(out))


class Bands:
    """Sizes in bands such that similar sets lie in one band or in neighbours, and the number of blocks for each band."""

    def __init__(self, percent: int):
        self.percent, self.starts = percent, [1]

    def of(self, n: int) -> int:
        while self.starts[-1] <= n:
            low = self.starts[-1]
            self.starts.append(max(low + 1, -(-low * 100 // self.percent)))
        return bisect_right(self.starts, n) - 1

    def blocks(self, band: int) -> int:
        """One more than the tokens by which similar sets can differ, the larger of which lies in ``band``."""
        while len(self.starts) <= band + 1:
            self.of(self.starts[-1])
        return 2 * (self.starts[band + 1] - 1) * (100 - self.percent) // (100 + self.percent) + 1


def block_keys(hashes: np.ndarray, bands: Bands) -> np.ndarray:
    """Keys of a set's blocks of tokens. Two similar sets share at least one, as fewer tokens differ than there are blocks."""
    mixed = mix(hashes)
    again = mix(mixed + MIX_C)
    out = []
    band = bands.of(len(hashes))
    for scheme in (band, band + 1):
        blocks = bands.blocks(scheme)
        if blocks == 1:  # only equal sets are similar
            continue
        sums = np.zeros(blocks, dtype=np.uint64)
        np.add.at(sums, (mixed % np.uint64(blocks)).astype(np.int64), again)
        place = np.arange(blocks, dtype=np.uint64) + np.uint64(scheme << 40)
        out.append(mix(sums + mix(place + MIX_C)))
    return np.concatenate(out) if out else np.empty(0, dtype=np.uint64)


def token_classes(hashes: np.ndarray) -> np.ndarray:
    """A set's bitmap of token classes."""
    bits = np.zeros(BITS, dtype=bool)
    bits[(hashes >> np.uint64(20)).astype(np.int64) % BITS] = True
    return np.packbits(bits).view(np.uint64)


def similar(both: Column, m: Column, n: Column, percent: int) -> Column:
    return 100 * both >= percent * (m + n - both)


def marks(docs: DataFrame, id_col: str, text_col: str, words: int, keys_of: Callable[[np.ndarray], np.ndarray],
          print_of: Callable[[np.ndarray], int] | None = None) -> DataFrame:
    """``(doc_id, text_hash, name, n, keys, fp)``: name and size of every text's set; keys and fingerprint where a task meets it first.

    An empty set has no name.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    hashed = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text"))

    def rows(source) -> Iterator[tuple]:
        met = set()
        for doc, raw, text_hash in source:
            own = shingle_set(raw, words)
            if not len(own):
                yield doc, text_hash, None, 0, None, None
                continue
            name = xxhash.xxh3_128_digest(own.tobytes())
            fresh = name not in met
            met.add(name)
            yield (
                doc, text_hash, name, len(own), keys_of(own).view(np.int64) if fresh else None, print_of(own) if fresh and print_of else None
            )

    return materialize(map_rows(
        as_bytes(hashed, "text_hash"), f"doc_id {kind}, text_hash bigint, name binary, n bigint, keys array<bigint>, fp bigint", rows, per_batch=1024
    ), "shingles")


def points_of(marked: DataFrame) -> DataFrame:
    """One row per different set: ``(name, low, one)``, with the least id and one row that has the set."""
    return materialize(marked.filter("name IS NOT NULL").groupBy("name").agg(
        F.min("doc_id").alias("low"), F.min(F.struct("doc_id", "text_hash")).alias("one")
    ), "points")


def shared_keys(marked: DataFrame, points: DataFrame) -> DataFrame:
    """``(key, name, size)`` for the keys that several points have."""
    each = marked.select(F.xxhash64("name").alias("id"), F.explode("keys").alias("key")).repartition("key").dropDuplicates(["key", "id"])
    several = each.withColumn("size", F.count("*").over(Window.partitionBy("key"))).filter("size > 1")
    names = points.select(F.xxhash64("name").alias("id"), "name")  # an id that two names had would only add candidates
    return materialize(materialize(several, "keys").join(names, "id").select("key", "name", "size"), "members")


def sets_of(docs: DataFrame, points: DataFrame, members: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    """``(name, n, hashes)`` of the points in ``members``, from their texts."""
    chosen = points.join(members.select("name").distinct(), "name", "left_semi").select(F.col("one.doc_id").alias("__id"), F.col("one.text_hash").alias("__hash"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    some = texts(docs, id_col, text_col).join(small(materialize(chosen, "chosen")), same, "left_semi")

    def rows(source) -> Iterator[tuple]:
        for _, raw in source:
            own = shingle_set(raw, words)
            yield xxhash.xxh3_128_digest(own.tobytes()), len(own), own.view(np.int64)

    sets = materialize(map_rows(as_bytes(some), "name binary, n bigint, hashes array<bigint>", rows, per_batch=256), "sets")
    repeated = sets.groupBy("name").count().filter("count > 1")
    return sets if repeated.isEmpty() else materialize(sets.dropDuplicates(["name"]), "sets")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs (a, b)`` whose whole sets are similar: the set of each ``a`` goes to its ``b``."""
    pairs = materialize(pairs, "pairs")
    first = sets.select(F.col("name").alias("a"), F.col("n").alias("m"), F.col("hashes").alias("x")).join(small(pairs), "a")
    needed = sets.join(small(pairs.select(F.col("b").alias("name")).distinct()), "name", "left_semi")
    met = first.join(needed.select(F.col("name").alias("b"), F.col("n").alias("k"), F.col("hashes").alias("y")), "b")
    fits = met.filter(similar(F.least("m", "k"), F.col("m"), F.col("k"), percent))
    return materialize(fits.filter(similar(F.size(F.array_intersect("x", "y")), F.col("m"), F.col("k"), percent)).select("a", "b"), "similar")


def in_groups(members: DataFrame, apart: list[str] | None = None) -> DataFrame:
    """``(name, grp, leader)``: points by their most shared key (and the columns ``apart``), in groups of bounded size."""
    homes = members.groupBy("name", *(apart or ())).agg(F.max(F.struct("size", F.xxhash64("key").alias("h"), "key"))["key"].alias("home"))
    own = ["home", *(apart or ())]
    load = homes.groupBy(*own).agg(F.ceil(F.count("*") / GROUP).alias("parts"), F.min(F.struct(F.xxhash64("name").alias("h"), "name"))["name"].alias("leader"))
    part = F.pmod(F.xxhash64("name", F.lit(1)), F.col("parts"))
    return materialize(homes.join(load, own).select("name", F.xxhash64(*own, part).alias("grp"), "leader"), "groups")


def apart_at(rows: DataFrame, *also: Column) -> DataFrame:
    """The keys of ``rows (key, root)`` at which components meet."""
    ends = rows.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("size"), *also)
    return ends.filter("a <> b").drop("a", "b")


def open_tokens(rows: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(name, n)`` of the points in ``rows (name, root)``; ``(name, token, many)`` for their tokens that several components have."""
    here = rows.select("name", "root").distinct().join(sets, "name")
    tokens = here.select("name", F.xxhash64("root").alias("of"), F.explode("hashes").alias("token"))
    met = tokens.groupBy("token").agg(F.min("of").alias("a"), F.max("of").alias("b"), F.count("*").alias("many")).filter("a <> b")
    return here.select("name", "n"), tokens.select("name", "token").join(met.select("token", "many"), "token")


def narrowed(places: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(key, name, root, n, reach, own, size)``: what is left of ``places (key, name)``, by keys that part hot ones.

    A token that only one component has is lost to all links of its points; the rest bounds the size ``reach`` of the greatest set with
    which a point can be similar. A point goes where no size fits. The others are dealt anew by their rarest tokens: two similar sets,
    in the order of how many points have a token, share one of those before which neither has lost more than a link may lose. How many
    these are depends on the smaller of the two sizes, hence a key is a token and a class of sizes, ``own`` tells a point's own class,
    and of two that meet one must have it. Common tokens are no keys of points that lie apart from what they are common to.
    """
    left = with_root(places.select("key", "name"), roots, "name", "root")
    left = materialize(left.join(apart_at(left).select("key"), "key", "left_semi"), "left")
    each, shared = open_tokens(left, sets)
    # an id that two names had would only raise the bound
    both = shared.select(F.xxhash64("name").alias("id")).groupBy("id").agg(F.count("*").alias("both"))
    reach = F.expr(f"both * {100 + percent} div {percent} - n").alias("reach")
    bound = each.withColumn("id", F.xxhash64("name")).join(both, "id").filter(100 * F.col("both") >= percent * F.col("n")).select("name", "n", reach)
    left = left.join(materialize(bound, "bound"), "name")
    fits = left.groupBy("key").agg(F.min("n").alias("least"), F.max("reach").alias("most"))
    left = left.join(fits, "key").filter("least <= reach AND n <= most").select("key", "name", "root")
    left = materialize(left.join(apart_at(left).select("key"), "key", "left_semi").select("name", "root").distinct(), "left")

    each, shared = open_tokens(left, sets)
    rarest = shared.groupBy("name").agg(F.transform(F.sort_array(F.collect_list(F.struct("many", "token"))), lambda x: x["token"]).alias("open"))
    size_class = lambda n: f"CAST(floor(ln({n}) / ln({SIZE_CLASS})) AS INT)"
    low = f"greatest(ceil(pow({SIZE_CLASS}, c) - 0.001), ceil({percent} * n / 100))"
    take = f"CAST(both + 1 - ceil({percent} * (n + {low}) / {100 + percent}) AS INT)"
    keys = F.expr(f"""explode(flatten(transform(sequence({size_class(f"ceil({percent} * n / 100)")}, {size_class("n")}),
        c -> transform(slice(open, 1, greatest({take}, 0)), t -> struct(xxhash64(t, c) AS key, c = {size_class("n")} AS own)))))""").alias("at")
    dealt = each.join(rarest, "name").withColumn("both", F.size("open").cast("bigint")).select("name", "n", reach, keys).select("name", "n", "reach", "at.*")
    dealt = materialize(dealt.join(left, "name"), "dealt")
    return materialize(dealt.join(apart_at(dealt, F.max("own").alias("met")).filter("met").drop("met"), "key"), "left")


def meetings(left: DataFrame, groups: DataFrame) -> DataFrame:
    """``(ga, gb)``, once for each key where two groups have different components whose sizes are within reach of each other."""
    # a row for each key and group, whatever the number of points: the least and greatest component there
    live = materialize(left.join(groups.select("name", "grp"), "name").groupBy("key", "grp").agg(
        F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("least"), F.max("reach").alias("most"), F.max("own").alias("own")
    ), "live")
    other = live.select("key", F.col("grp").alias("gb"), *[F.col(c).alias(f"{c}_b") for c in ("low", "high", "least", "most", "own")])
    fit = f"{APART} AND (own OR own_b) AND least <= most_b AND least_b <= most"
    return live.withColumnRenamed("grp", "ga").join(other, "key").filter(fit).select("ga", "gb")


def _open(table: pa.Table, percent: int) -> pa.Table:
    """Links between a cell's two groups, as a forest over the components they lie in.

    Pairs that the bitmaps do not rule out are compared by whole sets, unless the cell's earlier links have joined them.
    """
    starts = np.append(np.flatnonzero(changes(table, ["ga", "gb"])), table.num_rows)
    sizes, side = table["n"].to_numpy(), table["side"].to_numpy()
    lists = table["hashes"].combine_chunks()
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy().view(np.uint64)
    sets = [values[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]
    bits = np.array([token_classes(own) for own in sets])
    root = np.unique(np.array(table["root"].to_pylist(), dtype=object), return_inverse=True)[1]
    left, right = [], []

    def reach(size, lost, other) -> np.ndarray:
        """Whether a set of ``size`` that has lost some tokens can still be similar to one of size ``other`` or more."""
        both = size - lost
        return 100 * both >= percent * (size + other - both)

    for lo, hi in zip(starts[:-1], starts[1:]):
        a, b = lo + np.flatnonzero(side[lo:hi] == 0), lo + np.flatnonzero(side[lo:hi] == 1)
        alone = not len(b)  # a group with itself
        b = a if alone else b
        own = root[lo:hi].copy()
        union = np.bitwise_or.reduce(bits[b], axis=0)
        least = np.maximum(sizes[b].min(), -(-sizes[a] * percent // 100))
        outside = np.bitwise_count(bits[a] & ~union).sum(axis=1, dtype=np.int64)
        a = a[reach(sizes[a], outside, least)]
        for q in a.tolist():
            s = b[(own[b - lo] != own[q - lo]) & ((b > q) | (not alone))]
            lost_q = np.bitwise_count(bits[q] & ~bits[s]).sum(axis=1, dtype=np.int64)
            lost_s = np.bitwise_count(bits[s] & ~bits[q]).sum(axis=1, dtype=np.int64)
            s = s[reach(sizes[q], lost_q, sizes[s]) & reach(sizes[s], lost_s, sizes[q])]
            for r in s.tolist():
                if own[r - lo] == own[q - lo]:
                    continue
                both = len(np.intersect1d(sets[q], sets[r], assume_unique=True))
                if 100 * both >= percent * (sizes[q] + sizes[r] - both):
                    own[own == own[r - lo]] = own[q - lo]
                    left.append(q)
                    right.append(r)
    pick = lambda rows: table["name"].take(pa.array(rows, pa.int64()))
    return pa.table({"a": pick(left), "b": pick(right)})


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = pa.Table.from_batches(batches)
    ends = [table[c].to_pylist() for c in ("a", "b")]
    names = sorted(set(ends[0]).union(ends[1]))
    place = {name: k for k, name in enumerate(names)}
    root = union_edges(len(names), *[np.array([place[x] for x in end], dtype=np.int64) for end in ends])
    yield pa.RecordBatch.from_pydict({"node": pa.array(names, pa.binary()), "root": pa.array([names[k] for k in root], pa.binary())})


def joined(links: DataFrame) -> DataFrame:
    """``(node, root)`` of all ends of ``links (a, b)``: in one task if they are counted to fit one, else by star contraction."""
    links = materialize(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "links")
    if not 0 < links.count() <= LINKS_PER_TASK:
        return materialize(contract(links), "roots")
    return materialize(links.repartition(1).mapInArrow(_finish, "node binary, root binary"), "roots")


def linked(members: DataFrame, sets: DataFrame, percent: int, links: DataFrame | None = None) -> DataFrame:
    """``(node, root)`` for all points of ``members (key, name, size)`` that are linked with another; ``sets`` as from ``sets_of``.

    ``links`` are those that are known already.
    """
    groups = in_groups(members)
    led = verified(groups.filter("name <> leader").select(F.col("name").alias("a"), F.col("leader").alias("b")), sets, percent)
    links = led if links is None else links.unionByName(led)
    places = materialize(members.join(groups, "name").select("key", "name", "grp", "leader"), "places")
    for step in range(HUBS):
        roots = joined(links)
        here = with_root(with_root(places, roots, "name", "root"), roots, "leader", "top")
        hub = F.min(F.struct(F.xxhash64("leader", F.lit(step)).alias("h"), "leader", "top")).alias("hub")
        met = here.select("key", "name", "root").join(here.groupBy("key").agg(hub), "key").filter("root <> hub.top")
        one = met.groupBy("name").agg(F.min("hub")["leader"].alias("b"))
        links = links.unionByName(verified(one.select(F.col("name").alias("a"), "b"), sets, percent))
    roots = joined(links)
    left = narrowed(places, roots, sets, percent)
    # large components get groups of their own, so that the few points beside them do not bring all of their groups together
    large = left.select("name", "root").distinct().groupBy("root").count().filter(F.col("count") >= GROUP).select("root", F.col("root").alias("crowd"))
    groups = in_groups(left.join(small(large), "root", "left").select("key", "name", "size", F.coalesce("crowd", F.lit(b"")).alias("crowd")), ["crowd"])
    cells = materialize(meetings(left, groups).distinct(), "cells")
    part = F.pmod(F.xxhash64("ga", "gb"), F.lit(2**PICKS))
    for step in range(PICKS + 1):  # some cells join most components, so that the others need not be opened
        here = with_root(groups.select("name", "grp"), roots, "name", "root")
        whole = here.groupBy("grp").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        whole_b = whole.select(F.col("grp").alias("gb"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
        now = cells.filter(part == step if step < PICKS else part >= step)
        now = now.join(whole.withColumnRenamed("grp", "ga"), "ga").join(whole_b, "gb").filter(APART).select("ga", "gb")
        now = materialize(now, "now")
        if now.isEmpty():
            continue
        inside = here.join(sets.select("name", "n", "hashes"), "name")
        rows = [
            c.join(inside.withColumnRenamed("grp", end), end).select("ga", "gb", F.lit(k).alias("side"), "name", "n", "hashes", "root")
            for k, (c, end) in enumerate(((now, "ga"), (now.filter("ga <> gb"), "gb")))
        ]
        found = stream_groups(rows[0].unionByName(rows[1]), ["ga", "gb"], ["side"], partial(_open, percent=percent), "a binary, b binary", chunk_rows=1024)
        links = links.unionByName(materialize(found, "found"))
        roots = joined(links)
    return roots


def with_root(df: DataFrame, roots: DataFrame, of: str, name: str) -> DataFrame:
    """``df`` with the component of a point; one without links is its own."""
    return df.join(roots.select(F.col("node").alias(of), F.col("root").alias(name)), of, "left").withColumn(name, F.coalesce(name, of))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``(doc_id, n_shingles, component_id)``, a row per document: size of its set, smallest id that it is linked with."""
    bands = Bands(percent)
    marked = marks(docs, id_col, text_col, words, lambda own: block_keys(own, bands))
    points = points_of(marked)
    members = shared_keys(marked, points)
    roots = linked(members, sets_of(docs, points, members, id_col, text_col, words), percent)
    named = with_root(points.select("name", "low"), roots, "name", "root")
    named = named.join(named.groupBy("root").agg(F.min("low").alias("component_id")), "root").select("name", "component_id")
    found = marked.select("doc_id", "n", "name").join(named, "name", "left")
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
