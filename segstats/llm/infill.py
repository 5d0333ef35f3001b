r"""Fill-in-middle transformation by counted quantifiers, in SQL functions only.

A text is cut into units (lines by default), matched from left to right: ``regexp_count`` gives their number n. Two cuts a <= b
among the n + 1 places between units come from a hash of the seed and the id. The row's own pattern
``\A((?:unit){a}+)((?:unit){b-a}+)(.*)\z`` captures prefix, middle and suffix in one match, and the replacement puts them into their
order. Possessive counts run as a loop in the pattern engine, so that a text of a million lines needs no deeper stack.

``psm`` writes prefix, suffix, middle, ``spm`` suffix, prefix, middle, each after its sentinel; the middle is always last, for
that is what a model is to predict. ``restore`` gives back the exact text from output and form alone.

Defined cases: a null text is an empty one; an empty text and one that has a sentinel in it stay ``plain``, as do the texts that
``percent`` leaves out; a null id is hashed as an empty one; repeated rows are cut alike, as the cuts come from the id; an empty
table gives no rows. Only the id and the text are read, so other columns cannot clash.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import texts

#: A line with its end, or a last line without one; possessive, so that nothing is tried twice.
LINE = r"[^\n]*+\n|[^\n]++"
SENTINELS = ("<P>", "<S>", "<M>")
SEED = 7


def check_sentinels(sentinels: tuple[str, str, str]) -> None:
    """Sentinels must tell their places apart: none may hold, start or end with a part of another."""
    for a in sentinels:
        for b in sentinels:
            inside = a in b if a != b else False
            overlap = any(a[-k:] == b[:k] for k in range(1, min(len(a), len(b)) + (a != b)))
            if not a or inside or overlap or len(set(sentinels)) < 3:
                raise ValueError(f"sentinels {a!r} and {b!r} can overlap in an output")


def draw(seed: int, doc_id: Column, k: int) -> Column:
    """The k-th 8-digit group of the hash of seed and id, as a number."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("bigint")


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = LINE, seed: int = SEED,
                   percent: int = 100, spm_percent: int = 50, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``(doc_id, n, form, output)``: number of units, ``plain``, ``psm`` or ``spm``, and the rearranged text.

    ``percent`` of the texts are transformed, ``spm_percent`` of those as ``spm``. ``unit`` is a Java pattern without capturing groups
    that matches no empty string and leaves no character of a text out.
    """
    check_sentinels(sentinels)
    p, s, m = sentinels
    rows = texts(docs, id_col, text_col).withColumn("n", F.regexp_count("text", F.lit(unit)).cast("bigint"))
    marked = F.lit(False)
    for sentinel in sentinels:
        marked = marked | F.contains("text", F.lit(sentinel))
    plain = (F.col("text") == "") | marked | (draw(seed, F.col("doc_id"), 2) % 100 >= percent)
    form = F.when(plain, "plain").when(draw(seed, F.col("doc_id"), 3) % 100 < spm_percent, "spm").otherwise("psm")
    cut = lambda k: draw(seed, F.col("doc_id"), k) % (F.col("n") + 1)
    rows = rows.select("*", form.alias("form"), F.least(cut(0), cut(1)).alias("a"), F.greatest(cut(0), cut(1)).alias("b"))
    times = lambda k: F.concat(F.lit(f"((?:{unit}){{"), k.cast("string"), F.lit("}+)"))
    pattern = F.concat(F.lit(r"\A"), times(F.col("a")), times(F.col("b") - F.col("a")), F.lit(r"([\s\S]*+)\z"))
    quoted = [re.sub(r"([\\$])", r"\\\1", x) for x in (p, s, m)]
    psm, spm = (f"{quoted[0]}$1{quoted[1]}$3{quoted[2]}$2", f"{quoted[1]}$3{quoted[0]}$1{quoted[2]}$2")
    order = F.when(F.col("form") == "spm", spm).otherwise(psm)
    output = F.when(F.col("form") == "plain", F.col("text")).otherwise(F.regexp_replace("text", pattern, order))
    return rows.select("doc_id", "n", "form", output.alias("output"))


def parts(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """Prefix, middle and suffix of an output, each null if the form is ``plain``."""
    check_sentinels(sentinels)
    pieces = F.split(output, "|".join(re.sub(r"(\W)", r"\\\1", x) for x in sentinels))
    turned = form == "spm"
    prefix, suffix = F.when(turned, pieces[2]).otherwise(pieces[1]), F.when(turned, pieces[1]).otherwise(pieces[2])
    return F.when(form != "plain", F.struct(prefix.alias("prefix"), pieces[3].alias("middle"), suffix.alias("suffix")))


def restore(transformed: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """``transformed`` with ``prefix``, ``middle``, ``suffix`` and the ``text`` that they came from, from ``output`` and ``form``."""
    cut = transformed.withColumn("cut", parts(F.col("output"), F.col("form"), sentinels))
    text = F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat("cut.prefix", "cut.middle", "cut.suffix"))
    return cut.select(*transformed.columns, "cut.*", text.alias("text"))
