"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features are counted in one pass over every whole text: densities of a fixed lexicon and of one learned from labelled rows,
distances of hits to second-person words, capitals, punctuation and obfuscated spellings. Labelled rows that may be learned from
are sampled once, by hash, at most ``train_rows`` of them, and dealt into three parts: the first gives the learned lexicon
(words and word beginnings that stand in clearly more toxic than other texts, counted once for each preceding word, so
that copies of one text do not count again), the second the trees, the third the calibration. Only the sample's ids are
broadcast, only counts of terms shuffled.

Defined cases: a null or empty text has zero features and is scored like any other; repeated rows each get their score; a null id
is held out; a label that repeats counts once, as toxic if any row says so; without some labels of both kinds the score is a
fixed function of the lexicon hits; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import WORD_BYTES, as_bytes, map_rows, texts
from segstats.session import materialize

#: Labelled rows that are learned from, at most.
TRAIN_ROWS = 24_000
#: Learned terms, at most; each must follow so many different words in toxic texts.
LEARNED_TERMS = 2000
LEAST_CONTEXTS = 3
LEAST_RATIO = 8.0
TREES, DEPTH = 20, 4
#: With fewer rows of either kind for the trees, a fixed function of the hits is used.
LEAST_ROWS = 8
THRESHOLD = 0.7

INSULTS = frozenset(
    w.encode() for w in (
        "idiot idiots idiotic stupid moron morons moronic imbecile loser losers pathetic worthless disgusting scum trash clown "
        "clowns garbage filth filthy vermin retard retarded dumbass asshole bastard bitch bullshit crap damn fuck fucking "
        "fucker shit shitty slut whore jerk freak creep pig cretin dimwit halfwit bonehead numbskull parasite"
    ).split()
)
SECOND_PERSON = frozenset(
    w.encode() for w in "you your yours yourself u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos ti tú usted ustedes".split()
)
NEAR = 5
CAPITALS = bytes(range(65, 91))
#: Letters, characters that stand in for letters, and the rest.
SHAPE = bytes(
    97 if chr(b).isascii() and chr(b).isalpha() else 48 if chr(b) in "0123456789@$*" else 46 for b in range(256)
)
FEATURES = [
    "insults", "insult_density", "learned", "learned_weight", "learned_density", "learned_best", "near_person", "person_density",
    "capitals", "marks", "obfuscated", "log_words",
]


def terms_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings marked by an asterisk."""
    return [word, *[word[:k] + b"*" for k in (4, 5, 6) if len(word) > k]]


class Lexicon:
    def __init__(self, weights: dict[bytes, float]):
        self.weights = weights
        self.heads = {t.rstrip(b"*")[:4] for t in weights}

    def weight(self, word: bytes) -> float:
        get = self.weights.get
        return max(get(t, 0.0) for t in terms_of(word))


def features(raw: bytes, lexicon: Lexicon) -> list[float]:
    words = raw.translate(WORD_BYTES).split()
    n, size = max(1, len(words)), max(1, len(raw))
    insults = [i for i, w in enumerate(words) if w in INSULTS]
    heads = lexicon.heads
    found = [(i, lexicon.weight(w)) for i, w in enumerate(words) if w[:4] in heads]
    found = [(i, x) for i, x in found if x > 0]
    hits = {*insults, *(i for i, _ in found)}
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR):i + NEAR + 1]) for i in hits)
    person = sum(map(SECOND_PERSON.__contains__, words))
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    shape = raw.translate(SHAPE)
    total = sum(x for _, x in found)
    return [
        len(insults), len(insults) / n, len(found), total, total / n, max((x for _, x in found), default=0.0), near, person / n,
        capitals / size, (raw.count(b"!") + raw.count(b"?")) / n, (shape.count(b"a0a") + shape.count(b"a00a")) / n, math.log1p(len(words)),
    ]


def term_counts(sample: DataFrame) -> DataFrame:
    """``(term, contexts, others)`` from ``sample (text, label)``: preceding words in toxic texts, other texts with the term."""

    def rows(source):
        others: Counter = Counter()
        for raw, label in source:
            words = raw.translate(WORD_BYTES).split()
            if label:
                seen = {(t, zlib.crc32(p)) for p, w in zip([b"", *words], words) for t in terms_of(w)}
                yield from ((t, p, 0) for t, p in seen)
            else:
                others.update({t for w in set(words) for t in terms_of(w)})
                if len(others) > 200_000:
                    yield from ((t, None, k) for t, k in others.items())
                    others.clear()
        yield from ((t, None, k) for t, k in others.items())

    counted = map_rows(sample, "term binary, context bigint, n bigint", rows)
    per_context = counted.groupBy("term", "context").agg(F.sum("n").alias("n"))
    return per_context.groupBy("term").agg(F.count("context").alias("contexts"), F.sum("n").alias("others"))


def learn_lexicon(sample: DataFrame, toxic: int, other: int) -> Lexicon:
    """Terms that are at least LEAST_RATIO times as frequent in toxic texts, the most telling first."""
    rate = (F.col("contexts") + 0.0) / max(1, toxic)
    base = (F.col("others") + 0.5) / max(1, other)
    best = (
        term_counts(sample).filter((F.col("contexts") >= LEAST_CONTEXTS) & (rate >= LEAST_RATIO * base))
        .withColumn("weight", F.log(rate / base)).orderBy(F.desc(F.col("contexts") * F.col("weight")), "term").limit(LEARNED_TERMS)
    )
    return Lexicon({bytes(r.term): float(r.weight) for r in best.collect()})


def held_out(doc_id: Column) -> Column:
    """Rows whose label is never learned from: CRC-32 of the id's text leaves 1 when divided by 3; or there is no id."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(True))


def training_ids(labels: DataFrame, id_col: str, label_col: str, rows: int) -> DataFrame:
    """``(doc_id, label, part)`` of at most ``rows`` labelled rows, chosen by hash."""
    usable = labels.filter(~held_out(F.col(id_col)) & F.col(label_col).isNotNull())
    one = usable.groupBy(F.col(id_col).alias("doc_id")).agg(F.max(F.col(label_col).cast("int")).alias("label"))
    deal = F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(20))
    part = F.when(deal < 8, 0).when(deal < 16, 1).otherwise(2)
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumn("part", part)


def score_toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id",
    label_col: str = "toxic", train_rows: int = TRAIN_ROWS,
) -> DataFrame:
    """``(doc_id, held_out, score)`` for every row of ``docs``."""
    base = as_bytes(texts(docs, id_col, text_col))
    chosen = materialize(training_ids(labels, label_id, label_col, train_rows), "training")
    counts = {(r.part, r.label): r.n for r in chosen.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    learn = base.join(F.broadcast(chosen.filter("part = 0")), "doc_id").select("text", "label")
    lexicon = learn_lexicon(learn, counts.get((0, 1), 0), counts.get((0, 0), 0)) if counts.get((0, 1)) else Lexicon({})
    kind = docs.schema[id_col].dataType.simpleString()
    measured = materialize(
        map_rows(
            base, f"doc_id {kind}, {', '.join(f'{c} double' for c in FEATURES)}",
            lambda rows: ((doc, *map(float, features(raw, lexicon))) for doc, raw in rows),
        ),
        "features",
    )
    known = measured.join(F.broadcast(chosen), "doc_id")
    fit, hold = known.filter("part = 1"), known.filter("part = 2")
    kinds = [r["count"] for r in fit.groupBy("label").count().collect()]
    out = held_out(F.col("doc_id")).alias("held_out")
    if len(kinds) < 2 or min(kinds) < LEAST_ROWS:
        hits = F.col("insults") + F.col("near_person") + F.col("learned")
        return measured.select("doc_id", out, (hits / (hits + 1.0)).alias("score"))
    assemble = VectorAssembler(inputCols=FEATURES, outputCol="dense")
    # the sample is small: few partitions make quick rounds
    rows = assemble.transform(fit).select("dense", F.col("label").cast("double").alias("label")).coalesce(2)
    model = GBTClassifier(featuresCol="dense", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, minInstancesPerNode=3, seed=11).fit(rows)

    def raw_score(df: DataFrame) -> DataFrame:
        return model.transform(assemble.transform(df)).withColumn("raw", vector_to_array("probability")[1])

    calibration = raw_score(hold if not hold.isEmpty() else fit).select("raw", F.col("label").cast("double").alias("label"))
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(calibration.coalesce(2))
    scored = isotonic.transform(raw_score(measured).select("doc_id", "raw"))
    # calibrated scores have steps; the raw one orders rows inside a step
    mixed = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.999 * F.col("calibrated") + 0.001 * F.col("raw")))
    return scored.select("doc_id", out, mixed.alias("score"))


def area_under_curve(scores: np.ndarray, labels: np.ndarray) -> float:
    """Chance that a toxic row scores higher than another one, ties counting half; for tests and reports."""
    _, place, n = np.unique(scores, return_inverse=True, return_counts=True)
    rank = (np.cumsum(n) - (n - 1) / 2)[place]
    pos = labels == 1
    return float((rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / max(1, pos.sum() * (~pos).sum()))
