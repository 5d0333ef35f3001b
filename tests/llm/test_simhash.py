import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from segstats.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def plain_fingerprint(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    shingles = [" ".join(w[k:k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps, radius=3):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    points = np.array(fps, dtype=np.uint64)
    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(points ^ points[i]) <= radius):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    return [find(k) for k in range(len(fps))]


def clustered(rng, groups, each):
    """Random points, each with others a few bits away, also in chains."""
    out = []
    for base in rng.integers(0, 2**63, groups):
        point = int(base)
        for _ in range(each):
            out.append(point)
            for b in rng.integers(0, 64, rng.integers(1, 5)):
                point ^= 1 << int(b)
    return np.unique(np.array(out, dtype=np.uint64))


def test_fingerprints_match_a_plain_count():
    for text in ["", "  \n", "One", "one TWO", "a b c", "É a\tb\nc d e f\x0bg", "x " * 1000, "w1 w2 w3 w4 w5 w6 w7 " * 9000]:
        assert simhash.fingerprint(text.encode()) % 2**64 == plain_fingerprint(text)


@pytest.mark.parametrize("shards", [1, 7, 60])
def test_tree_and_shard_search_lose_no_link(shards):
    rng = np.random.default_rng(3)
    points = clustered(rng, 400, 5)
    tree = simhash.Tree(points[::3], shards)
    edges, homes = [], 0
    for _, home, away in tree.route(points, 3):
        homes += len(home)
        a, b = simhash.links(home, away, 3)
        assert (np.bitwise_count(a ^ b) >= 0).all()
        edges += list(zip(a.tolist(), b.tolist()))
    assert homes == len(points)
    place = {int(p): k for k, p in enumerate(points)}
    root = simhash.union_edges(len(points), np.array([place[a] for a, _ in edges]), np.array([place[b] for _, b in edges]))
    assert root.tolist() == brute_components(points)


def test_points_that_no_vantage_point_can_cut():
    rng = np.random.default_rng(4)
    base = int(rng.integers(0, 2**63))
    points = np.unique(np.array([base ^ (1 << a) ^ (1 << b) for a in range(64) for b in range(64)], dtype=np.uint64))
    a, b = simhash.links(points, points[:0], 3)
    assert len(a) == len(points) - 1  # a spanning tree, not all pairs


def test_forest_in_blocks(spark):
    points = clustered(np.random.default_rng(5), 150, 4)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    got = {r.node: r.root for r in simhash.contract(simhash.link_forest(df, sample=64, shard_points=100, block_points=30)).collect()}
    root = brute_components(points)
    groups = {}
    for p, r in zip(points.view(np.int64).tolist(), root):
        groups.setdefault(r, []).append(p)
    for members in groups.values():
        assert {got.get(m, m) for m in members} == {min(members)}


def test_components_of_documents(spark):
    base = "the quick brown fox jumps over one lazy dog and then runs far away from here again today " * 6
    docs = [(9, base), (3, base.upper()), (5, None), (7, ""), (None, base), (4, "short"), (4, "short"), (8, "other words entirely in this one text here"), (None, None)]
    docs += [(100 + k, base) for k in range(40)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit("x")).withColumn("root", F.lit(1))
    got = {(r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()}
    assert {(9, 3), (3, 3), (None, 3), (5, 5), (7, 5), (None, 5), (4, 4), (8, 8), (139, 3)} <= got
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_first(df.limit(0)).count() == 0


def test_registered_query_matches_brute_force(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    fps = [plain_fingerprint(t) for _, t in docs]
    root = brute_components(fps)
    expected = [(d, f"{f:016x}", docs[r][0]) for (d, _), f, r in zip(docs, fps, root)]
    rows = queries.QUERIES["op3_simhash"](spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == expected
    assert any(d != c for d, _, c in expected)
