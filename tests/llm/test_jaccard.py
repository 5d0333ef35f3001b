import re

import numpy as np
import pyarrow as pa
import pytest

from segstats.llm import jaccard, queries

SF = "/root/testdata/sf0.001"


def plain_set(text, words=3):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))} if w else set()


def brute(docs, words=3, percent=90):
    """All pairs; documents in order of id."""
    sets, root = [plain_set(t, words) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return {(d, len(s), docs[r][0]) for (d, _), s, r in zip(docs, sets, root)}


def copies(seed, percent):
    """Texts of many lengths with chains of copies around the limit."""
    rng = np.random.default_rng(seed)
    docs = []
    for size in [*range(3, 40, 3), 60, 100, 150, 300, 500, 700]:
        w = [f"w{k}" for k in rng.integers(0, 5000, size)]
        for _ in range(9):
            docs.append(" ".join(w).upper() if rng.random() < 0.3 else "  ".join(w))
            for k in rng.integers(0, len(w), int(rng.integers(0, 2 + size * (100 - percent) // 500))):
                w[k] = f"new{rng.integers(0, 10**6)}"
            if rng.random() < 0.3:
                w = w[: max(1, len(w) - int(rng.integers(0, 3)))]
            if rng.random() < 0.2:
                w += ["more", f"at{rng.integers(0, 9)}"]
    return list(enumerate(docs))


def found(frame, **more):
    rows = [tuple(r) for r in jaccard.jaccard_components(frame, **more).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


@pytest.mark.parametrize("words,percent", [(3, 90), (5, 80)])
def test_components_match_all_pairs(spark, words, percent):
    docs = copies(words, percent)
    expected = brute(docs, words, percent)
    assert len(docs) // 9 <= len({c for *_, c in expected}) < len(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS name", "2 AS n", "3 AS root")
    assert found(frame, words=words, percent=percent) == expected


def test_query_matches_all_pairs(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    rows = queries.op11_jaccard_join(spark, SF)
    assert rows.columns == ["doc_id", "n_shingles", "component_id"]
    assert {tuple(r) for r in rows.collect()} == brute(docs)


def test_small_groups_and_no_rounds_of_leaders(spark, monkeypatch):
    docs = copies(8, 90)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for name, value in (("GROUP", 2), ("HUBS", 0), ("PICKS", 0), ("LINKS_PER_TASK", 0)):
        monkeypatch.setattr(jaccard, name, value)
    assert found(frame) == brute(docs)


def test_large_cluster_opens_few_cells(spark):
    """A thousand near copies of one text; most links follow from those with leaders."""
    rng = np.random.default_rng(3)
    base, docs = [f"w{k}" for k in range(400)], []
    for k in range(1000):
        w = list(base)
        for at in rng.integers(0, 400, int(rng.integers(0, 5))):
            w[at] = f"x{rng.integers(0, 10**6)}"
        docs.append((k, " ".join(w)))
    assert {c for *_, c in found(spark.createDataFrame(docs, "doc_id long, text string"))} == {0}


def test_blocks_lose_no_pair():
    rng = np.random.default_rng(4)
    for percent in (90, 80, 50):
        bands = jaccard.Bands(percent)
        for _ in range(400):
            n = int(rng.integers(1, 200))
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            most = len(a) * (100 - percent) // (100 + percent)
            k = int(rng.integers(0, most + 1))
            b = np.unique(np.concatenate([a[k:], rng.integers(0, 2**63, int(rng.integers(0, k + 1))).astype(np.uint64)]))
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both) and not np.array_equal(a, b):
                assert set(jaccard.block_keys(a, bands).tolist()) & set(jaccard.block_keys(b, bands).tolist())


def test_odd_rows(spark):
    docs = [(3, "one two"), (1, "ONE  two"), (None, "one\ttwo"), (5, None), (4, ""), (7, "one two three"), (1, "ONE  two"), (8, " \n"), (9, "one")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = sorted((tuple(r) for r in jaccard.jaccard_components(frame).collect()), key=repr)
    assert rows == sorted([(3, 1, 1), (1, 1, 1), (None, 1, 1), (5, 0, 5), (4, 0, 4), (7, 1, 7), (1, 1, 1), (8, 0, 8), (9, 1, 9)], key=repr)
    assert jaccard.jaccard_components(frame.limit(0)).count() == 0
    long = [(1, "a b c d e f g " * 20_000), (2, "a b c d e f g " * 20_000 + "z"), (3, "lone")]
    assert found(spark.createDataFrame(long, "doc_id long, text string")) == brute(long)


def test_a_cell_gives_out_a_forest():
    """A group with itself whose sets are all similar in two families: links are fewer than points, not pairs of them."""
    rng = np.random.default_rng(6)
    rows = []
    for family in range(2):
        base = rng.integers(0, 2**63, 100).astype(np.uint64)
        for k in range(30):
            own = np.unique(np.append(base, rng.integers(0, 2**63, 2).astype(np.uint64)))
            rows.append((b"%d-%02d" % (family, k), own))
    names = [name for name, _ in rows]
    table = pa.table({
        "ga": [1] * 60, "gb": [1] * 60, "side": [0] * 60, "name": pa.array(names, pa.binary()), "n": [len(own) for _, own in rows],
        "bits": pa.array([jaccard.token_classes(own).tobytes() for _, own in rows], pa.binary()),
        "hashes": pa.array([own.view(np.int64) for _, own in rows], pa.list_(pa.int64())), "root": pa.array(names, pa.binary()),
    })
    links = jaccard._open(table, 90).to_pylist()
    assert len(links) == 58 and all(r["a"][:1] == r["b"][:1] for r in links)
