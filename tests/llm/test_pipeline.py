import importlib.util
import re

import pytest

import __spark_entry__
from segstats.llm import decontaminate, pieces
from test_decontaminate import brute as plain_overlap
from test_decontaminate import words_of
from test_pieces import expect, library
from test_quality import brute as plain_measures
from test_secrets import BASE
from test_shingles import plain_kept

SF = "/root/testdata/sf0.001"

corpus_pipeline = pytest.importorskip("corpus_pipeline") if importlib.util.find_spec("corpus_pipeline") else None
pytestmark = pytest.mark.skipif(corpus_pipeline is None, reason="the pipeline is not here")


def plain_keep(text):
    n, chars, symbols, dup_lines, repeated, base = plain_measures(text)
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    return not (
        base or 4 * symbols > n or 10 * text.count("!") > 3 * n or 2 * sum(c.isupper() for c in text) > chars
        or 20 * sum(a == b for a, b in zip(w, w[1:])) > 3 * n or 10 * len(set(w)) < n or 2 * dup_lines > len(lines)
        or chars < 2 * n or chars > 25 * n
    )


def plain_cut(text, items):
    """Words of the text without contaminated ones; None if there are too many."""
    windows = set()
    for item in items:
        w = words_of(item)
        windows.update(tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9)) if w)
    sizes = {len(w) for w in windows}
    whole = w = words_of(text)
    while True:
        hit = {i for n in sizes for k in range(len(w) - n + 1) if tuple(w[k:k + n]) in windows for i in range(k, k + n)}
        if w is whole and 2 * len(hit) > len(w):
            return None
        if not hit:
            return w
        w = [x for k, x in enumerate(w) if k not in hit]


def plain_redact(text):
    spans = sorted(
        (m.start(), rank, m.end(), kind) for rank, (kind, pattern) in enumerate(BASE) for m in re.finditer(pattern, text)
        if len(m[2] if rank == 0 else m[0]) >= (8, 16, 32)[rank]
    )
    out, at = [], 0
    for start, _, end, kind in spans:
        if start >= at:
            out += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def test_pipeline_matches_a_plain_version(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    state, frame = dict(docs), spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        frame = corpus_pipeline.materialize(stage(spark, frame, SF), name)
        seen[name] = frame
    names = [n for n, _ in corpus_pipeline.STAGES]
    for name in names[:-1]:
        assert seen[name].columns == columns
    after = {n: {r.doc_id: r.text for r in seen[n].collect()} for n in names[:-1]}
    state = {d: t for d, t in state.items() if plain_keep(t)}
    assert after[names[0]] == state and len(state) < len(docs)
    state = {d: state[d] for d in plain_kept(sorted(state.items()))}
    assert after[names[1]] == state
    cut = {d: plain_cut(t, items) for d, t in state.items()}
    assert {d: words_of(t) for d, t in after[names[2]].items()} == {d: w for d, w in cut.items() if w is not None}
    assert all(after[names[2]][d] == t for d, t in state.items() if cut[d] == words_of(t))
    clean = plain_overlap(list(after[names[2]].items()), list(enumerate(items)))
    assert not any(r[-1] for r in clean)
    state = {d: plain_redact(t) for d, t in after[names[2]].items()}
    assert after[names[3]] == state
    lib = library()
    last = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in seen[names[4]].collect()}
    assert last == {d: expect(lib, t) for d, t in state.items()}
    chars = {r.doc_id: r.n_chars for r in seen[names[3]].collect()}
    assert chars == {d: len(t) for d, t in state.items()}


def test_odd_rows_pass_through_every_stage(spark):
    good = " ".join(f"word{k} and more text" for k in range(30))
    rows = [(1, good, None, None, None), (None, good + " x", "en", "s", 5), (2, None, "en", "s", 0), (3, "", "en", "s", 0), (1, good, None, None, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", "9 AS w", "'x' AS fp")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        empty = stage(spark, frame.limit(0), SF)
        assert empty.columns == frame.columns and empty.count() == 0
        frame = corpus_pipeline.materialize(stage(spark, frame, SF), "t")
        assert frame.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    assert [r.doc_id for r in frame.collect()] == [1]
    assert corpus_pipeline.STAGES[-1][1](spark, frame, SF).count() == 1


def test_registered(spark):
    assert "pipeline" in __spark_entry__.queries()
    assert decontaminate.WINDOW == 10 and pieces.default_model().endswith(".model")
    assert [k.split("_")[0] for k in __spark_entry__.queries() if re.match(r"op\d+_", k)].__len__() == 13
