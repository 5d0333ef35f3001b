import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from segstats.llm import quality, queries

SF = "/root/testdata/sf0.001"


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(w[k:k + 8]) for k in range(len(w) - 7))
    hit = {i for k in range(len(w) - 7) if windows[tuple(w[k:k + 8])] > 1 for i in range(k, k + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, rep = len(w), len(hit)
    return (
        n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), rep,
        n < 20 or 100 * rep > 30 * n,
    )


COLUMNS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
PLAIN = " ".join(f"word{k} näher" for k in range(60))


def check(rows, docs):
    got = sorted((r.doc_id if r.doc_id is not None else -1, *[r[c] for c in COLUMNS]) for r in rows)
    assert got == sorted((d if d is not None else -1, *brute(t)) for d, t in docs)
    assert all(not r.kept for r in rows if r.base_failed)


def test_base_measures_match_brute_force(spark):
    phrase = "one two three four five six seven eight nine"
    docs = [
        (1, PLAIN), (2, None), (3, ""), (4, " \n\t \x0b"), (5, f"{phrase} x {phrase} y\n{PLAIN}"), (6, "a " * 300), (7, "a\x00b c  d " * 9),
        (8, "\n".join([phrase, phrase, "", "  ", phrase + " ", "#*$ %&|<>"] * 3)), (9, "😀 é" * 40), (None, PLAIN), (1, PLAIN),
        (10, " ".join(f"w{k}" for k in range(200_000)) + " " + phrase + " " + phrase), (11, "x" * 500_000), (12, "q1 q2 q3 q4 q5 q6 q7 q8 " * 20_000),
        (13, " ".join("abcabcab")), (14, " ".join("abcdefgh" * 2)), (15, "\r\n".join(["l one", "l one"])),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("w", F.lit(1)).withColumn("n_words", F.lit("x"))
    check(quality.assess(df).collect(), docs)
    assert quality.assess(df.limit(0)).count() == 0


def test_registered_query_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    rows = queries.QUERIES["op4_quality_rules"](spark, SF).collect()
    check(rows, docs)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(r.kept, r.base_failed, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert not any(kept for kept, _, good in judged if good == 0)
    assert all(kept for kept, base, good in judged if good == 1 and not base)


def test_order_changes_no_verdict_and_keep_good_agrees(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("n_symbols", F.lit(3))
    kept = {r.doc_id for r in quality.assess(docs).filter("kept").collect()}
    good = quality.keep_good(docs)
    assert good.columns == docs.columns and {r.doc_id for r in good.collect()} == kept
    m = quality.metrics(F.col("text"), F.col("w"))
    split = docs.withColumn("w", quality.words(F.col("text")))
    for order in (list(quality.RULES), list(quality.RULES)[::-1]):
        assert {r.doc_id for r in split.filter(quality.cascade(m, order).isNull()).collect()} == kept
    assert set(quality.rule_order(docs)) == set(quality.RULES)
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_different_words_are_judged_alike_at_any_length(spark):
    rng = np.random.default_rng(6)
    simple = [f"w{k}" for k in rng.integers(0, 1500, 60_000)]
    few = [f"w{k}" for k in rng.integers(0, 60, 60_000)]
    docs = [(n, " ".join(simple[:n])) for n in (500, 1000, 1001, 15_000, 60_000)] + [(-n, " ".join(few[:n])) for n in (1000, 1001, 15_000, 60_000)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.failed_rule for r in quality.assess(df).collect()} == {d: "few_different_words" if d < 0 else None for d, _ in docs}
    assert {r.doc_id for r in quality.keep_good(df).collect()} == {d for d, _ in docs if d > 0}
    w = quality.words(F.col("text"))
    plain = {d: sum(len(set(t.split()[k:k + 1000])) for k in range(0, len(t.split()), 1000)) for d, t in docs}
    assert {r.doc_id: r.n for r in df.select("doc_id", quality.block_distinct(w).alias("n")).collect()} == plain
