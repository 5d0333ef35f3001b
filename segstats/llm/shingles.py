"""Near-duplicates by exact similarity of 5-word shingle sets: the pipeline's rule.

Two texts are linked if their sets of 5-word shingles (A-Z lower-cased) have a Jaccard similarity of 0.8 or more; documents linked
directly or through others are one group. Equal sets are one point from the start.

1. Fingerprints of the sets meet in the tree of vantage points (``simhash.link_forest``, 3 bits); of what it links, those pairs whose
   whole sets are similar are the first links.
2. Fingerprints of texts of similarity 0.8 differ by up to 18 bits, where the tree cuts nothing off (unrelated ones differ by 32,
   give or take 4), so further candidates come from 96 bands of six minimum hashes: a pair of similarity 0.8 shares none with a
   chance of 2e-13, one of 0.3 shares one with a chance of 7 %.
3. Candidates are linked as in ``jaccard``: leaders first, then groups of points that still lie in different components, cell by cell inside
   a task, by bitmaps that never rule out a similar pair, and there by whole sets. No bucket is joined with itself pair by pair, and a
   cell gives out a forest of links, not its pairs.

Defined cases: a text of fewer words is one shingle, null and empty texts are one group; repeated rows share a group.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm import jaccard
from segstats.llm.simhash import first_of_groups, link_forest, majority
from segstats.session import materialize

WORDS, PERCENT = 5, 80
BANDS, BAND_ROWS = 96, 6
_rng = np.random.default_rng(11)
FLIP = _rng.integers(0, 2**32, BANDS * BAND_ROWS, dtype=np.uint32)
FACTOR = _rng.integers(0, 2**32, BANDS * BAND_ROWS, dtype=np.uint32) | np.uint32(1)
CHUNK = 256


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One key a band, from the least of the permuted hashes."""
    low = (hashes >> np.uint64(32)).astype(np.uint32)
    least = np.full(len(FLIP), 2**32 - 1, dtype=np.uint32)
    for at in range(0, len(low), CHUNK):
        part = low[at:at + CHUNK, None] ^ FLIP
        part *= FACTOR
        np.minimum(least, part.min(axis=0), out=least)
    key = np.arange(BANDS, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T.astype(np.uint64):
        key = jaccard.mix(key + jaccard.MIX_C) + column
    return jaccard.mix(key)


def fingerprint_pairs(marked: DataFrame, members: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of points whose fingerprints the tree of vantage points links, as a forest, and stars of equal ones."""
    points = materialize(
        marked.filter("fp IS NOT NULL").groupBy("name").agg(F.first("fp").alias("fp")).join(members.select("name").distinct(), "name", "left_semi"), "prints"
    )
    heads = materialize(points.groupBy("fp").agg(F.min("name").alias("head")), "heads")
    near = link_forest(heads.select("fp"))
    head = lambda end: heads.select(F.col("fp").alias(end), F.col("head").alias(f"{end}_head"))
    across = near.join(head("a"), "a").join(head("b"), "b").select(F.col("a_head").alias("a"), F.col("b_head").alias("b"))
    return points.join(heads, "fp").filter("name <> head").select(F.col("name").alias("a"), F.col("head").alias("b")).unionByName(across)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group, chosen as in ``simhash.keep_first``."""
    marked = jaccard.marks(docs, id_col, text_col, WORDS, band_keys, majority)
    points = jaccard.points_of(marked)
    members = jaccard.shared_keys(marked, points)
    sets = jaccard.sets_of(docs, points, members, id_col, text_col, WORDS)
    first = jaccard.verified(fingerprint_pairs(marked, members), sets, PERCENT)
    roots = jaccard.linked(members, sets, PERCENT, first)
    nothing = F.lit(b"")
    named = jaccard.with_root(points.select("name"), roots, "name", "root").select(F.col("name").alias("fp"), "root")
    named = named.unionByName(docs.sparkSession.range(1).select(nothing.alias("fp"), nothing.alias("root")))
    return first_of_groups(docs, marked.select("doc_id", F.coalesce("name", nothing).alias("fp"), "text_hash"), named, id_col, text_col)
