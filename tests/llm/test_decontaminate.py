import random
import re
from hashlib import sha256

import pytest

from segstats.llm import decontaminate as dc
from segstats.llm import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SF = "/root/testdata/sf0.001"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return WORD.findall(lower)


def brute(docs, items, window=10):
    windows = {}
    for name, text in items:
        w = words_of(text)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[k:k + window]), set()).add(name)
    sizes = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, names = words_of(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                found = windows.get(tuple(w[k:k + n]))
                if found:
                    hit.update(range(k, k + n))
                    names |= found
        names = sorted(str(n) for n in names - {None})
        out.append((doc, len(w), len(hit), len(names), sha256(",".join(names).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def result(df):
    cols = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_overlap_matches_brute_force(spark, block_bytes, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["a", "b", "c", "Dé", "e1"]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", " - "]) for _ in range(n))

    items = [(k, text(rng.choice([0, 1, 3, 4, 9, 10, 11, 15, 40]))) for k in range(2, 40) if k % 7]
    items = [i for i in items if len(words_of(i[1])) not in (1, 3)] + [(40, None), (None, text(12)), (3, items[0][1]), (3, items[0][1])]
    docs = [(k, text(rng.randint(0, 60))) for k in range(60)] + [(60, None), (61, ""), (None, items[5][1]), (5, items[6][1]), (5, items[6][1])]
    docs += [(70, "x " * 30000 + (items[4][1] or ""))]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS spans")
    b = spark.createDataFrame(items, "item_id long, text string")
    found = dc.find_overlap(d, b, block_bytes=block_bytes)
    got = sorted(
        ((r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), len(r.item_ids),
          sha256(",".join(sorted(r.item_ids)).encode()).hexdigest(), bool(r.spans)) for r in found.collect()), key=repr)
    assert got == brute(docs, items)


def test_registered_query_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    expected = brute(docs, items)
    assert result(queries.QUERIES["op5_decontamination"](spark, SF)) == expected
    assert any(r[-1] for r in expected)


def test_cleaning_removes_passages_and_keeps_the_rest(spark):
    item = " ".join(f"w{k}" for k in range(12))
    docs = [
        (1, "clean text stays, as it is.", 9), (2, f"Before it {item.upper()}! After it {' pad' * 30}", 9), (3, item, 9), (4, None, 9),
        # closing the gap makes a new window
        (5, "y " * 40 + "w0 w1 w2 w3 " + item + " w4 w5 w6 w7 w8 w9 w10 w11", 9),
    ]
    d = spark.createDataFrame(docs, "doc_id long, text string, n_chars long")
    b = spark.createDataFrame([(1, item)], "item_id long, text string")
    out = {r.doc_id: r.text for r in dc.decontaminate(d, b).collect()}
    assert out.keys() == {1, 2, 4, 5}
    assert out[1] == docs[0][1] and out[4] is None
    assert out[2].startswith("Before it ") and out[2].count("pad") == 30 and "W3" not in out[2]
    assert "w5" not in out[5]
    assert dc.decontaminate(d, b.limit(0)).count() == 5
    assert dc.decontaminate(d.limit(0), b).count() == 0
