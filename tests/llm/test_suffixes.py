import random
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from segstats.llm import queries, suffixes

SF = "/root/testdata/sf0.001"


def brute(docs, length=100):
    """docs: (id, text); a null id comes first."""
    rows = [(-(2**63) if d is None else d, (t or "").encode()) for d, t in docs]
    first = {}
    for d, raw in rows:
        for k in range(len(raw) - length + 1):
            w = raw[k:k + length]
            first[w] = min(first.get(w, (d, k)), (d, k))
    out = []
    for (name, _), (d, raw) in zip(docs, rows):
        hit = bytearray(len(raw))
        for k in range(len(raw) - length + 1):
            if first[raw[k:k + length]] < (d, k):
                hit[k:k + length] = b"\1" * length
        spans = sum(1 for k in range(len(raw)) if hit[k] and (k == 0 or not hit[k - 1]))
        kept = bytes(b for b, h in zip(raw, hit) if not h)
        out.append((name, len(raw), sum(hit), spans, sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def digest(df):
    return sorted(
        ((r.doc_id, r.n_bytes, sum(s.end - s.start for s in r.removed), len(r.removed), sha256(bytes(r.kept)).hexdigest()) for r in df.collect()),
        key=repr,
    )


@pytest.mark.parametrize("alphabet", ["a", "ab", "abracd", "xyz\x01\xff"])
def test_suffix_array_is_sorted(alphabet):
    rng = random.Random(len(alphabet))
    for n in (1, 2, 3, 10, 100, 1000):
        raw = "".join(rng.choice(alphabet) for _ in range(n)).encode("latin-1")
        text = np.append(np.frombuffer(raw, dtype=np.uint8).astype(np.uint16) + 2, np.uint16(0))
        order = suffixes.suffix_array(text, n + 1).tolist()
        assert order[1:] == sorted(range(n), key=lambda k: raw[k:])


def corpus(seed, n=60):
    rng = random.Random(seed)
    words = ["alpha", "beta", "gamma", "delta", "ä", "eps"]
    text = lambda k: " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(k))
    passages = [text(rng.randint(12, 60)) for _ in range(6)]
    docs = []
    for k in range(n):
        parts = [text(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            parts += [rng.choice(passages)[rng.randint(0, 9):], text(rng.randint(0, 20))]
        docs.append((rng.randint(0, 500), "\n".join(parts)))
    docs += [(501, docs[3][1]), (2, docs[3][1]), (502, docs[3][1][:99]), (503, docs[3][1][:99]), (504, None), (505, ""), (None, docs[4][1])]
    docs += [(506, "ab" * 400), (507, "a" * 350), (508, "a" * 99 + "b" + "a" * 100), docs[5], docs[5], (docs[6][0], docs[7][1] + docs[6][1])]
    docs += [(560, "same line over and over, " * 60)] * 2 + [(561, "same line over and over, " * 50)]
    docs += [(600 + k, f"{k} " + "very common line that every one of these documents holds " * 2 + f" {k * 7}") for k in range(40)]
    return docs


@pytest.mark.parametrize("options", [{}, {"shard_bytes": 3000}, {"group_limit": 3}])
def test_removed_bytes_match_brute_force(spark, options):
    docs = corpus(len(options))
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("anchor", F.lit(1))
    assert digest(suffixes.remove_repeats(df, **options)) == brute(docs)


def test_texts_longer_than_a_piece(spark, monkeypatch):
    rng = random.Random(8)
    body = "".join(rng.choice("abcdefgh ") for _ in range(30_000))
    docs = [(1, body), (2, "x" + body[5000:25_000] + "y" + body[:7000]), (3, "zz" + body[29_000:])]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    # the cut of pieces is tested in this process, tasks see the module's own value
    cuts = [p for some in suffixes.pieces(iter([(1, 0, body.encode())]), 100) for p in some]
    assert b"".join(c[3] for c in cuts) == body.encode()
    monkeypatch.setattr(suffixes, "PIECE", 1000)
    cuts = [p for some in suffixes.pieces(iter([(1, 0, body.encode())]), 100) for p in some]
    assert all(c[3] == body.encode()[c[2]:c[2] + 1099] for c in cuts) and len(cuts) == 30
    monkeypatch.undo()
    assert digest(suffixes.remove_repeats(df)) == brute(docs)


def test_empty_table(spark):
    assert suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_registered_query_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.QUERIES["op10_suffix_dedup"](spark, SF).collect()
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows), key=repr)
    assert got == brute(docs)
    assert sum(r.n_removed for r in rows) > 0
