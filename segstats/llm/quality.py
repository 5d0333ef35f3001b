"""Quality rules as a short-circuit cascade, in DataFrame expressions only.

Rules are boolean expressions over a text's words, lines and characters. On a bounded sample the cascade measures what each rule
costs and how many texts it rejects, then orders the rules by rejections per cost; a text that one rule rejects is not
tried on the next. The order changes the work, never the verdict. Nothing is shuffled.

Repeated 8-word windows are found inside each text: word hashes are combined to window hashes by doubling (two 64-bit values
are equal by chance once in 2**64), a text without an equal pair stops there, and others sort their windows once.

Different words are counted in consecutive blocks of 1000 words over the whole text, since their share of all words falls as a
text grows; in a text of one block it is the plain share.

Defined cases: a null text has no words and fails ``too_short``, like an empty one; repeated rows give repeated rows; an empty
table an empty result. Only the named columns are read, so others may have any name.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import partial
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import texts
from segstats.session import materialize

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 8
#: Words of a block in which different words are counted.
BLOCK_WORDS = 1000
#: Rows that costs and selectivities are measured on; verdicts do not depend on them.
SAMPLE_ROWS = 500
SAMPLE_FRACTION = 0.1
SAMPLE_BYTES = 1 << 16
REPEATS = 3

def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SPACES))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, and only where this expression is."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def word_chars(w: Column) -> Column:
    return F.length(F.array_join(w, "")).cast("bigint")


def symbol_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(SYMBOLS)).cast("bigint")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda line: F.rlike(line, F.lit(r"[^\x20\x09-\x0D]")))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint")


def joined(start: int, h: Column) -> Column:
    """Each hash with the one that comes ``start - 1`` places later."""
    return F.zip_with(h, F.slice(h, start, F.greatest(F.size(h), F.lit(1))), lambda x, y: F.xxhash64(x, y))


def window_hashes(w: Column, n: Column) -> Column:
    """Hash of every window of 8 words, by doubling."""
    h = F.transform(w, lambda x: F.xxhash64(x))
    for gap in (1, 2, 4):
        h = let(h, partial(joined, gap + 1))
    # tails that lack a partner are no windows
    return F.slice(h, 1, F.greatest(n - WINDOW + 1, F.lit(0)).cast("int"))


def repeated_words(hashes: Column) -> Column:
    """Words inside windows whose hash occurs twice or more."""
    some = F.size(F.array_distinct(hashes)) < F.size(hashes)
    placed = F.sort_array(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(1), F.size(hashes)).alias("at")))

    def starts(sorted_: Column) -> Column:
        same = lambda x, k: F.coalesce(x["h"] == F.get(sorted_, k)["h"], F.lit(False))
        twice = F.filter(sorted_, lambda x, k: same(x, k - 1) | same(x, k + 1))
        return F.sort_array(F.transform(twice, lambda x: x["at"]))

    covered = F.aggregate(
        let(placed, starts), F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(-WINDOW).alias("last")),
        lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n"), s.alias("last")),
        lambda a: a["n"],
    )
    return F.when(some, covered).otherwise(F.lit(0).cast("bigint"))


def doubled(w: Column) -> Column:
    return F.size(F.filter(w, lambda x, k: F.coalesce(x == F.get(w, k - 1), F.lit(False))))


def block_distinct(w: Column) -> Column:
    """Different words of each block of ``BLOCK_WORDS`` words, summed over the text's blocks."""
    last = F.floor(F.greatest(F.size(w) - 1, F.lit(0)) / BLOCK_WORDS).cast("int")
    counts = F.transform(
        F.sequence(F.lit(0), last), lambda k: F.size(F.array_distinct(F.slice(w, k * BLOCK_WORDS + 1, F.lit(BLOCK_WORDS))))
    )
    return F.aggregate(counts, F.lit(0), lambda n, x: n + x)


def metrics(text: Column, w: Column) -> dict[str, Column]:
    """Measures that rules are made of, each evaluated only where it is asked for."""
    n = F.size(w)
    return {
        "n_words": n.cast("bigint"),
        "word_chars": word_chars(w),
        "n_symbols": symbol_count(text),
        "n_dup_lines": duplicate_lines(text),
        "n_repeat_words": let(window_hashes(w, n), repeated_words),
        "n_lines": F.size(F.split(text, "\n")),
        "n_capitals": F.regexp_count(text, F.lit(r"\p{Lu}")),
        "n_exclamations": F.length(text) - F.length(F.replace(text, F.lit("!"), F.lit(""))),
        "n_block_words": let(w, block_distinct),
        "n_doubled_words": let(w, doubled),
    }


#: A text goes when one of these holds. The first two are fixed by the result's definition.
RULES: dict[str, Callable[[dict[str, Column]], Column]] = {
    "too_short": lambda m: m["n_words"] < 20,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 30 * m["n_words"],
    "symbols": lambda m: 4 * m["n_symbols"] > m["n_words"],
    "exclamations": lambda m: 10 * m["n_exclamations"] > 3 * m["n_words"],
    "capitals": lambda m: 2 * m["n_capitals"] > m["word_chars"],
    "doubled_words": lambda m: 20 * m["n_doubled_words"] > 3 * m["n_words"],
    "few_different_words": lambda m: 10 * m["n_block_words"] < m["n_words"],
    "duplicate_lines": lambda m: 2 * m["n_dup_lines"] > m["n_lines"],
    "odd_word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 25 * m["n_words"]),
}
BASE_RULES = ("too_short", "repeated_windows")


def rule_order(docs: DataFrame, text_col: str = "text", names: tuple[str, ...] = tuple(RULES), rows: int = SAMPLE_ROWS) -> list[str]:
    """``names`` by rejections per cost, both measured on a sample of at most ``rows`` texts of at most ``SAMPLE_BYTES`` each.

    Taking rows stops after the first partitions that have enough; the sample is bounded and goes back as a local table. A rule's
    cost is the median of ``REPEATS`` timings.
    """
    short = texts(docs, text_col, text_col).select("text").filter(F.octet_length("text") <= SAMPLE_BYTES)
    taken = short.sample(SAMPLE_FRACTION, seed=1).take(rows)
    sample = docs.sparkSession.createDataFrame(taken, "text string").coalesce(1)
    sample = materialize(sample.withColumn("w", words(F.col("text"))), "sample")
    m = metrics(F.col("text"), F.col("w"))

    def seconds(rule: Column) -> tuple[float, int]:
        took, counted = [], sample.agg(F.count_if(rule))
        for _ in range(REPEATS):
            start = time.perf_counter()
            n = counted.first()[0]
            took.append(time.perf_counter() - start)
        return median(took), n

    seconds(F.lit(False))
    idle, _ = seconds(F.lit(False))
    worth = {}
    for name in names:
        took, rejected = seconds(RULES[name](m))
        worth[name] = rejected / max(took - idle, 0.001)
    return sorted(names, key=lambda name: -worth[name])


def cascade(m: dict[str, Column], order: list[str]) -> Column:
    """Name of the first rule in ``order`` that rejects, else null; later rules are not evaluated."""
    out = F.when(RULES[order[0]](m), F.lit(order[0]))
    for name in order[1:]:
        out = out.when(RULES[name](m), F.lit(name))
    return out


def assess(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, failed_rule)``.

    ``failed_rule`` is the first rule, in the order of ``RULES``, that rejects a text, whatever order the cascade has.
    """
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    more = [n for n in RULES if n not in BASE_RULES]
    order = rule_order(docs, text_col, tuple(more))
    split = texts(docs, id_col, text_col).withColumn("w", words(F.col("text")))
    m = metrics(F.col("text"), F.col("w"))
    measured = split.select("*", *[m[c].alias(c) for c in base])
    m |= {c: F.col(c) for c in base}
    base_failed = RULES["too_short"](m) | RULES["repeated_windows"](m)
    # only a text that the cascade rejects is tried in the fixed order too
    failed = F.when(base_failed, F.lit("base")).when(cascade(m, order).isNotNull(), cascade(m, more))
    return measured.select("doc_id", *base, base_failed.alias("base_failed"), failed.alias("failed_rule")).withColumn(
        "kept", F.col("failed_rule").isNull()
    )


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that a rule rejects; all rules, the base ones too, are ordered by the sample."""
    order = rule_order(docs, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    failed = let(words(text), lambda w: cascade(metrics(text, w), order))
    return docs.filter(failed.isNull())
