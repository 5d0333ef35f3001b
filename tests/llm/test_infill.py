import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from segstats.llm import infill, queries


def brute(doc_id, text):
    units = re.findall(r"[^\n]*\n|[^\n]+", text or "")
    text, n = text or "", len(units)
    digest = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", text
    if h[3] % 100 < 50:
        return n, "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"


ODD = [
    (1, "one\ntwo\nthree\nfour"), (2, "one\ntwo\n"), (3, ""), (4, None), (5, "\n\n\n"), (6, "no end"), (7, "a <S> in it\nb"),
    (8, "dollar $1 and \\2\nback\\slash\n$"), (9, "ä\U0001F600ß\r\n\u2028x\u0085y\n\x0bz"), (None, "null id\nline\n"), (10, "<\nP>\n<"), (11, "S>\n<M"),
    (12, "x" * 200_000 + "\n" + "y" * 200_000), (13, "l\n" * 100_000), (14, "\n" * 70_000 + "end"), (1, "same id\nother\ntext\n"), (1, "one\ntwo\nthree\nfour"),
]


def test_matches_brute_force_and_restores(spark):
    frame = spark.createDataFrame([(*r, k, "x") for k, r in enumerate(ODD)], "doc_id long, text string, n int, form string")
    rows = infill.restore(infill.fill_in_middle(frame)).collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    got = sorted(((r.doc_id, r.n, r.form, r.output, r.text) for r in rows), key=key)
    assert got == sorted(((d, *brute(d, t), t or "") for d, t in ODD), key=key)
    assert {r.form for r in rows} == {"plain", "psm", "spm"}
    assert infill.fill_in_middle(frame.limit(0)).count() == 0


def test_other_units_shares_and_sentinels(spark):
    rows = [(k, f"w{k} has six words here now " * (k % 7)) for k in range(400)]
    frame = spark.createDataFrame(rows, "id long, body string")
    mine = ("[pre$]", "[suf\\]", "[mid.]")
    cut = infill.fill_in_middle(frame, "id", "body", unit=r"\S++\s*+|\s++", seed=9, percent=30, spm_percent=25, sentinels=mine)
    got = {r.doc_id: r for r in infill.restore(cut, mine).collect()}
    assert {d: r.text for d, r in got.items()} == dict(rows)
    assert all(r.n == len(t.split()) for (d, t), r in zip(rows, (got[d] for d, _ in rows)))
    forms = [r.form for r in got.values()]
    assert 60 < len(forms) - forms.count("plain") < 150 and 0 < forms.count("spm") < forms.count("psm")
    for r in got.values():
        if r.form == "psm":
            assert r.output == mine[0] + r.prefix + mine[1] + r.suffix + mine[2] + r.middle
    for bad in (("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("a", "xay", "z"), ("", "s", "m")):
        with pytest.raises(ValueError):
            infill.fill_in_middle(frame, "id", "body", sentinels=bad)


def test_query_matches_sql_on_odd_texts(spark, tmp_path):
    frame = spark.createDataFrame([r for r in ODD if r[0] is not None], "doc_id long, text string")
    frame.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    cursor = con.execute(queries.SQL["op13_fill_in_middle"])
    names = [d[0] for d in cursor.description]
    got = queries.op13_fill_in_middle(spark, str(tmp_path))
    assert sorted(got.columns) == sorted(names)
    assert sorted(map(repr, (tuple(r) for r in got.select(*names).collect()))) == sorted(map(repr, cursor.fetchall()))


def test_plan_has_no_exchange_and_no_python(spark):
    plan = infill.fill_in_middle(spark.range(5).select(F.col("id").alias("doc_id"), F.lit("a\nb").alias("text")))
    said = plan._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in said and "Python" not in said and "Arrow" not in said
