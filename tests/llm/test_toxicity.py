import math
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from segstats.llm import queries, toxicity

SF = "/root/testdata/sf0.01"


def make(spark, seed=3, n=1200):
    rng = random.Random(seed)
    words = ["table", "river", "green", "cloud", "letter", "window", "stone", "paper", "walk", "slow"]
    bad = ["idiot", "zorblatt", "zorbling", "zorbic", "zorbane"]
    docs, labels = [], []
    for k in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.2
        if toxic:
            for _ in range(2):
                text.insert(rng.randint(0, len(text)), rng.choice(bad[k % 2:]) + rng.choice(["", "er", "ish", "um"]))
        docs.append((k, " ".join(text)))
        labels.append((k, int(toxic)))
    return docs, labels


def test_scores_held_out_rows_well(spark):
    docs, labels = make(spark)
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("label", F.lit("x")).withColumn("raw", F.lit(1))
    y = spark.createDataFrame(labels, "doc_id long, toxic int")
    rows = toxicity.score_toxicity(d, y).collect()
    truth = dict(labels)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    assert toxicity.area_under_curve(np.array([r.score for r in held]), np.array([truth[r.doc_id] for r in held])) > 0.95
    assert all(0 <= r.score <= 1 for r in rows)
    # flipping held-out labels changes nothing: they are never read
    flipped = spark.createDataFrame([(k, 1 - v if zlib.crc32(str(k).encode()) % 3 == 1 else v) for k, v in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score_toxicity(d, flipped).collect()}
    assert again == {r.doc_id: r.score for r in rows}


def test_odd_rows_and_missing_labels(spark):
    docs = [(1, None), (2, ""), (None, "you idiot"), (3, "fine words"), (3, "fine words"), (4, "x " * 100_000 + "moron")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(d, none).collect()
    score = {r.doc_id: r.score for r in rows}
    assert len(rows) == 6 and score[1] == score[2] == score[3] == 0 and score[None] > score[4] > 0
    assert {r.held_out for r in rows if r.doc_id is None} == {True}
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 1), (2, 0), (2, 1)], "doc_id long, toxic int")
    assert toxicity.score_toxicity(d, odd).count() == 6
    assert toxicity.score_toxicity(d.limit(0), none).count() == 0


def test_terms_of_copied_texts_count_once(spark):
    docs, labels = make(spark)
    rows = [(t.encode(), y) for (_, t), (_, y) in zip(docs, labels)] + [(b"unique copied words here", 1)] * 50
    sample = spark.createDataFrame(rows, "text binary, label int")
    lexicon = toxicity.learn_lexicon(sample, sum(y for _, y in rows), sum(1 - y for _, y in rows))
    assert b"zorb*" in lexicon.weights and b"copied" not in lexicon.weights and b"table" not in lexicon.weights


def test_registered_query(spark):
    rows = queries.QUERIES["op8_toxicity"](spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in held])
    assert toxicity.area_under_curve(np.array([r.score for r in held]), y) > 0.8
    assert np.mean([r.predicted for r in held if labels[r.doc_id] == 0]) < 0.05
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)


def plain_words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def plain_terms(word):
    raw = word.encode()
    return {raw} | {raw[:k] + b"*" for k in (4, 5, 6) if len(raw) > k}


def plain_features(text, weights):
    w = plain_words(text)
    insults = [x.encode() in toxicity.INSULTS for x in w]
    learned = [max([weights.get(t, 0.0) for t in plain_terms(x)] + [0.0]) for x in w]
    person = [x.encode() in toxicity.SECOND_PERSON for x in w]
    hits = [k for k in range(len(w)) if insults[k] or learned[k] > 0]
    near = [k for k in hits if any(person[j] for j in range(len(w)) if abs(j - k) <= 5)]
    n, size = max(1, len(w)), max(1, len(text.encode()))
    letter, stand_in = "[a-zA-Z]", "[0-9@$*]"
    hidden = len(re.findall(f"{letter}{stand_in}{letter}", text)) + len(re.findall(f"{letter}{stand_in}{{2}}{letter}", text))
    return [
        sum(insults), sum(insults) / n, sum(x > 0 for x in learned), sum(learned), sum(learned) / n, max(learned, default=0.0), len(near), sum(person) / n,
        sum("A" <= c <= "Z" for c in text) / size, (text.count("!") + text.count("?")) / n, hidden / n, math.log1p(len(w)),
    ]


def plain_lexicon(rows):
    contexts, others = {}, {}
    toxic, rest = sum(label for _, label in rows), sum(not label for _, label in rows)
    for text, label in rows:
        w = plain_words(text)
        if label:
            for before, word in zip(["", *w], w):
                for t in plain_terms(word):
                    contexts.setdefault(t, set()).add(before)
        else:
            for t in {t for word in w for t in plain_terms(word)}:
                others[t] = others.get(t, 0) + 1
    out = {}
    for t, seen in contexts.items():
        rate, base = len(seen) / max(1, toxic), (others.get(t, 0) + 0.5) / max(1, rest)
        if len(seen) >= toxicity.LEAST_CONTEXTS and rate >= toxicity.LEAST_RATIO * base:
            out[t] = math.log(rate / base)
    best = sorted(out, key=lambda t: (-len(contexts[t]) * out[t], t))[:toxicity.LEARNED_TERMS]
    return {t: out[t] for t in best}


def test_lexicon_and_features_match_plain_versions(spark):
    """Brute force over whole labelled texts, odd ones too."""
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.001/labels.parquet").collect()}
    rows = [(texts[d], int(k)) for d, k in labels.items() if d in texts and k is not None]
    rows += [("you absolute zorblax zorblaxen, zorblaxes!", 1), ("a zorblax b zorblax c zorblax", 1), ("", 1), ("", 0)]
    frame = spark.createDataFrame([(t.encode(), k) for t, k in rows], "text binary, label int")
    toxic = sum(k for _, k in rows)
    lexicon = toxicity.learn_lexicon(frame, toxic, len(rows) - toxic)
    expected = plain_lexicon(rows)
    assert lexicon.weights.keys() == expected.keys() and all(abs(lexicon.weights[t] - x) < 1e-9 for t, x in expected.items()) and expected
    odd = ["", "you idiot, f00l! 1d1ot $h1t a$$hole", "YOU YOUé Ü moron?!", "x@y a0a0a a00b", "idiot " * 50 + "you", "zorblax du zorblaxen"]
    for text in [t for t, _ in rows] + odd:
        got, plain = toxicity.features(text.encode(), lexicon), plain_features(text, expected)
        assert np.allclose(got, plain, atol=1e-9), text[:60]
