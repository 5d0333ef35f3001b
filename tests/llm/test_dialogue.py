import hashlib
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from segstats.llm import dialogue, queries

COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def brute_conversation(rows):
    """Forward over all edit strings, keeping the cheapest and least of each state."""
    grammar = {"": "su", "s": "u", "u": "a", "a": "u"}
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, said) in list(best.items()):
                for new in set(grammar[state]) & set("ua"):
                    option = (cost + 5, audit + "I", said + [("user" if new == "u" else "assistant") + ":"])
                    if new not in best or option[:2] < best[new][:2]:
                        best[new] = option
        return best

    best = inserted({"": (0, "", [])})
    for (_, role, text), fault in zip(rows, faults):
        new = {}

        def offer(state, option):
            if state not in new or option[:2] < new[state][:2]:
                new[state] = option

        late = 5 * (fault == "truncated")
        for state, (cost, audit, said) in best.items():
            offer(state, (cost + 2, audit + "D", said))
            if fault in ("blank", "duplicate"):
                continue
            if role[:1] and role[:1] in grammar[state]:
                offer(role[0], (cost + late, audit + "K", said + [f"{role}:{text}"]))
            for other in ("user", "assistant"):
                if other[0] in grammar[state]:
                    offer(other[0], (cost + 1 + late, audit + "R", said + [f"{other}:{text}"]))
        best = inserted(new)
    cost, audit, said = min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])
    initials = [r[:1] for _, r, _ in rows]
    turns = {t for t, _, _ in rows if t is not None}
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, "\n".join(said),
    )


def brute(rows):
    by = defaultdict(list)
    for conv, turn, role, text, present in rows:
        by[conv]
        if present:
            by[conv].append((turn, " " if role is None else role, " " if text is None else text))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        *counts, said = brute_conversation(own)
        out[conv] = (*counts, hashlib.sha256(said.encode()).hexdigest())
    return out


def made_up(seed, n):
    rng = np.random.default_rng(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "ä", "umpire"]
    texts = ["Yes.", "No!", "Why?  \n", "cut off", "", " \t\x0b\r\n", None, "same.", "ü. ", "...", "x"]
    rows = []
    for conv in range(n):
        size = int(rng.integers(1, 4)) if conv % 3 else int(rng.integers(1, 60))
        for k in range(size):
            role = roles[k % 2] if rng.random() < 0.6 else roles[rng.integers(len(roles))]
            text = f"Text {k}." if rng.random() < 0.6 else texts[rng.integers(len(texts))]
            turn = None if rng.random() < 0.05 else int(k + (rng.random() < 0.1) * rng.integers(-2, 3))
            rows.append((None if conv == 4 else conv, turn, role, text, bool(rng.random() < 0.9)))
    return rows + [(10_000, 3, "user", "gone", False)]


@pytest.mark.parametrize("long,chunk", [(256, 128), (5, 3), (0, 1)])
def test_matches_brute_force_in_chunks_of_any_size(spark, long, chunk):
    rows = made_up(chunk, 60)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, present boolean").selectExpr("*", "1 AS part", "'x' AS audit")
    got = dialogue.repair(frame, present=F.col("present"), with_turns=True, long=long, chunk=chunk)
    found = {r.conv_id: tuple(r)[1:] for r in got.reports.select(COLUMNS).collect()}
    assert found == brute(rows)
    said = defaultdict(list)
    for r in got.turns.orderBy("part", "i", "n").collect():
        said[r.conv_id].append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(said[c]).encode()).hexdigest() for c in found} == {c: v[-1] for c, v in found.items()}
    for lines in said.values():
        assert re.fullmatch("(s?(ua)+)?", "".join(line[0] for line in lines))


def test_one_long_conversation_over_many_partitions(spark):
    rng = np.random.default_rng(5)
    rows = [("c", k, ["user", "assistant"][(k + int(rng.random() < 0.1)) % 2], f"t{k}" + "." * int(rng.random() < 0.95), rng.random() < 0.95) for k in range(3000)]
    rows = [(*r[:4], bool(r[4])) for r in rows]
    frame = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string, present boolean").repartition(6)
    got = dialogue.repair(frame, present=F.col("present"), chunk=64).reports.select(COLUMNS).collect()
    assert {r.conv_id: tuple(r)[1:] for r in got} == brute(rows)


def test_vectors_converge_to_constants():
    rng = np.random.default_rng(1)
    for _ in range(200):
        codes = [int(c) for c in rng.integers(0, 12, 60)]
        ends = [dialogue.backward(codes, tuple(int(x) for x in rng.integers(0, 20, 4))) for _ in range(3)]
        true = dialogue.backward(codes, dialogue.END)
        assert dialogue.fix_up(codes, ends[0], dialogue.END, dialogue.backward(codes, ends[0])) == true


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        lot = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if lot == 1 else re.sub("[.!?]", "", text) if lot == 2 else text
        out += [(conv, turn, "user" if lot == 4 else role, text, lot != 0)] * (2 if lot == 3 else 1)
    return out


def test_query_matches_brute_force_and_damage(spark, tmp_path):
    rows = [r[:4] for r in made_up(77, 300)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op12_conversation_repair(spark, str(tmp_path)).select(COLUMNS).collect()
    assert len(got) == len({r[0] for r in rows}) and {r.conv_id: tuple(r)[1:] for r in got} == brute(damaged(rows))
    assert dialogue.repair(frame.limit(0)).reports.count() == 0


def test_sql_matches_brute_force(spark, tmp_path):
    rows = [r[:4] for r in made_up(78, 80)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/c")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/c/*.parquet'")
    cursor = con.execute(queries.SQL["op12_conversation_repair"])
    names = [d[0] for d in cursor.description]
    assert names == COLUMNS
    assert {r[0]: r[1:] for r in cursor.fetchall()} == brute(damaged(rows))
