import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from segstats.llm import jaccard, shingles

SF = "/root/testdata/sf0.001"


def plain_set(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", lower)
    return {" ".join(w[k:k + 5]) for k in range(max(1, len(w) - 4))}


def plain_kept(docs):
    """Ids that stay, by comparing all pairs."""
    docs = sorted(docs)
    sets, root = [plain_set(t) for _, t in docs], list(range(len(docs)))
    for i in range(len(docs)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return {d for k, (d, _) in enumerate(docs) if root[k] == k}


def test_stage_drops_all_documents_with_similar_shingles(spark):
    rng = np.random.default_rng(12)
    docs = []
    for base in range(12):  # copies of one text, of which ever more words are changed, also in chains
        w = [f"w{k}" for k in rng.integers(0, 3000, 60 + 40 * base)]
        for _ in range(8):
            docs.append((len(docs), " ".join(w)))
            for k in rng.integers(0, len(w), rng.integers(1, 2 + len(w) // 40)):
                w[k] = f"new{rng.integers(0, 10**6)}"
    docs += [(r.doc_id + 1000, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("fp", F.lit(1))
    got = corpus_pipeline.near_dedup(spark, frame, SF)
    assert got.columns == frame.columns
    kept = plain_kept(docs)
    assert sorted(r.doc_id for r in got.collect()) == sorted(kept) and 12 < len([d for d in kept if d < 1000]) < 96


def test_odd_rows(spark):
    docs = [(3, "one two"), (1, "ONE  two"), (None, "one two"), (5, None), (4, ""), (7, "one two three"), (1, "ONE  two")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.keep_first(frame).collect()) == [1, 4, 7]
    assert shingles.keep_first(frame.limit(0)).count() == 0


def test_bands_find_similar_pairs():
    """Of pairs at the limit all share a band; unrelated ones share none."""
    rng = np.random.default_rng(2)
    for n in (12, 60, 400):
        for _ in range(60):
            both = rng.integers(0, 2**63, n).astype(np.uint64)
            k = n // 10  # each has k of its own: 8 in 10 of the union are shared
            a, b = (np.unique(np.concatenate([both[2 * k:], rng.integers(0, 2**63, k).astype(np.uint64)])) for _ in "ab")
            assert set(shingles.band_keys(a).tolist()) & set(shingles.band_keys(b).tolist())
            other = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            assert not set(shingles.band_keys(a).tolist()) & set(shingles.band_keys(other).tolist())


def test_hot_bucket_opens_few_cells(spark):
    """Near copies of one text in two families that are too far apart to be linked."""
    rng = np.random.default_rng(5)
    docs = []
    for family in range(2):
        base = [f"w{k}" if k > 45 * family else f"f{k}" for k in range(400)]
        for _ in range(300):
            w = list(base)
            for at in rng.integers(50, 400, int(rng.integers(0, 6))):
                w[at] = f"x{rng.integers(0, 10**6)}"
            docs.append((len(docs), " ".join(w)))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = sorted(r.doc_id for r in shingles.keep_first(frame).collect())
    assert kept == sorted(plain_kept(docs))


def test_meetings_of_groups_grow_with_the_points(spark, monkeypatch):
    """Copies of one text, a part of which lie beyond the limit from all others: groups meet as often as there are more points."""
    def made(n):
        rng, docs, met = np.random.default_rng(7), [], []
        base = [f"w{k}" for k in range(140)]
        for doc in range(n):
            w = list(base)
            for at in rng.integers(0, 140, int(rng.integers(0, 8))):
                w[at] = f"x{rng.integers(0, 300)}"
            docs.append((doc, " ".join(w)))
        keep = jaccard.materialize

        def seen(df, name="cut"):
            out = keep(df, name)
            if name == "live":  # (key, grp, low, high): groups at a key, least and greatest component
                other = out.select("key", F.col("grp").alias("gb"), F.col("low").alias("low_b"), F.col("high").alias("high_b"))
                met.append(out.join(other, "key").filter("grp <= gb AND (low <> high OR low_b <> high_b OR low <> low_b)").count())
            return out

        monkeypatch.setattr(jaccard, "materialize", seen)
        kept = sorted(r.doc_id for r in shingles.keep_first(spark.createDataFrame(docs, "doc_id long, text string")).collect())
        monkeypatch.setattr(jaccard, "materialize", keep)
        return docs, kept, sum(met)

    docs, kept, few = made(300)
    assert kept == sorted(plain_kept(docs)) and 20 < len(kept) < 280
    _, _, many = made(1500)
    assert many < 20 * 1500 and many < 12 * max(few, 300), (few, many)
