"""Repair of conversation structure: cheapest edits that give the roles ``(system? (user assistant)+)?``, by parallel Viterbi.

Rows of a conversation in order of turn (null first; rows of one turn by role and text) are kept (0), given the other role (1),
deleted (2; blank rows and duplicates must be), or preceded by an inserted empty row (5); a truncated row that stays costs 5.
Of the cheapest edits those whose initials are least in ASCII order are taken: D, I, K, R.

Costs to the end run backwards through four states (nothing yet, after system, user, assistant), one step of the min-plus product a row.

1. One range shuffle sorts all rows by conversation and turn. A conversation that lies whole in a task and has at most ``LONG``
   rows is one chunk with a known end and is settled there; others, at the edges of partitions or longer, go on as chunks of
   ``CHUNK`` rows, however many.
2. Every chunk starts at once, from a speculative cost vector at its end. Fix-up passes give a chunk the vector that its
   successor really begins with; it runs again only until old and new vectors differ by a constant, from where on nothing changes.
   Passes end when no chunk's vector changes; mostly that is the second.
3. The stitched vectors drive the trace. A chunk maps each state at its begin to one at its end; maps are composed by doubling
   (log2 of the chunks, as joins), so that every chunk knows its first state and writes its part of the audit alone.

Only the audit and the digest of a conversation, being one value, are put together in one place; the digest reads rows as a stream.

Defined cases: null roles and texts count as one space, so such a text is blank; a null id is a conversation of its own; roles are
told apart by their first character, and one that is not s, u or a can be given another role or deleted; repeated rows of a turn
are duplicates; a conversation without rows has zeros, an empty audit and the digest of the empty string; an empty table gives no rows.
Only the four named columns (and ``present``) are read, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from segstats.llm.common import map_rows
from segstats.session import materialize

#: Rows of a conversation that one task settles alone, and of a chunk of longer ones.
LONG, CHUNK = 256, 128
DELETE, INSERT, REROLE, TRUNCATED = 2, 5, 1, 5
SPACE = " \t\n\x0b\x0c\r"
INITIALS = "sua"
LEGAL = {(0, 1), (1, 2), (2, 1)}
#: States: 0 nothing yet, 1 after system, 2 after user, 3 after assistant. The state that an inserted or re-roled row leads to.
NEXT = (2, 2, 3, 2)
KEEP = {(0, 0): 1, (0, 1): 2, (1, 1): 2, (2, 2): 3, (3, 1): 2}
ROLE = ("user", "user", "assistant", "user")
#: Costs from the end of a conversation, by state, and the edits that they stand for.
END = (0, 2 * INSERT, INSERT, 0)
END_EDITS = ("", "II", "I", "")


class Repaired(NamedTuple):
    reports: DataFrame
    turns: DataFrame | None


@lru_cache(maxsize=1 << 16)
def step(after: tuple, code: int) -> tuple[tuple, tuple]:
    """Costs before a row from those after it, less their least, and for each state ``(edits, state after, cost)``.

    ``code`` is three times the initial (s, u, a, other) plus 0, 1 if truncated, 2 if blank or duplicate.
    """
    initial, fault = divmod(code, 3)
    stays = TRUNCATED * (fault == 1)

    def ways(s: int) -> Iterator[tuple[str, int, int]]:
        yield "D", s, DELETE
        if fault != 2:
            if (s, initial) in KEEP:
                yield "K", KEEP[s, initial], stays
            yield "R", NEXT[s], REROLE + stays

    here = [min(cost + after[to] for _, to, cost in ways(s)) for s in range(4)]
    best = here
    for _ in range(2):  # two inserted rows lead to every state that any number leads to
        best = [min(here[s], INSERT + best[NEXT[s]]) for s in range(4)]
    moves = []
    for s in range(4):
        edits, total = "", 0
        while True:
            options = [(op, to, cost) for op, to, cost in ways(s) if cost + after[to] == best[s]]
            if INSERT + best[NEXT[s]] == best[s] and not (options and options[0][0] == "D"):
                edits, total, s = edits + "I", total + INSERT, NEXT[s]
                continue
            op, to, cost = options[0]
            moves.append((edits + op, to, total + cost))
            break
    low = min(best)
    return tuple(b - low for b in best), tuple(moves)


def backward(codes: list[int], end: tuple) -> tuple:
    """The cost vector before a chunk, from the one after it."""
    for code in reversed(codes):
        end = step(end, code)[0]
    return end


def fix_up(codes: list[int], old_end: tuple, new_end: tuple, old_begin: tuple) -> tuple:
    """As ``backward(codes, new_end)``, stopping where the vector no longer differs from that of the last pass."""
    for code in reversed(codes):
        if old_end == new_end:
            return old_begin
        old_end, new_end = step(old_end, code)[0], step(new_end, code)[0]
    return new_end


def trace(codes: list[int], end: tuple, state: int) -> tuple[list[str], int, int]:
    """Edits of each row from ``state`` on, the state after them and their cost."""
    moves = []
    for code in reversed(codes):
        end, move = step(end, code)
        moves.append(move)
    edits, total = [], 0
    for move in reversed(moves):
        edit, state, cost = move[state]
        edits.append(edit)
        total += cost
    return edits, state, total


def initial_of(role: str) -> int:
    at = INITIALS.find(role[:1]) if role else -1
    return at if at >= 0 else 3


def rewrite(edits: str, state: int, role: str, text: str) -> tuple[list[tuple[str, str, str]], int]:
    """The rows ``(edit, role, text)`` that stand for one row after its edits, and the state after them."""
    out = []
    for op in edits:
        if op == "I":
            out.append((op, ROLE[state], ""))
            state = NEXT[state]
        elif op == "R":
            out.append((op, ROLE[state], text))
            state = NEXT[state]
        elif op == "K":
            out.append((op, role, text))
            state = KEEP[state, initial_of(role)]
    return out, state


class Digest:
    """Hash of ``role:text`` lines joined by line breaks."""

    def __init__(self):
        self.hash, self.started = hashlib.sha256(), False

    def add(self, rows: list[tuple[str, str, str]]) -> None:
        for _, role, text in rows:
            self.hash.update(("\n" if self.started else "").encode() + f"{role}:{text}".encode())
            self.started = True


def settle(rows: list[tuple]) -> tuple[list[tuple], tuple]:
    """Repaired rows and the report of one whole conversation of ``(turn, role, text)``."""
    codes, seen, counts = [], set(), [0, 0, 0]
    for _, role, text in rows:
        said = text.rstrip(SPACE)
        fault = 1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0
        seen.add((role, text))
        if fault:
            counts[fault - 1] += 1
        codes.append(3 * initial_of(role) + (0, 2, 2, 1)[fault])
    initials = [c // 3 for c in codes]
    illegal = sum(pair not in LEGAL for pair in zip(initials, initials[1:]))
    edits, state, cost = trace(codes, END, 0)
    tail, cost = END_EDITS[state], cost + END[state]
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    out, state, digest = [], 0, Digest()
    for k, (edit, (_, role, text)) in enumerate(zip(edits, rows)):
        new, state = rewrite(edit + (tail if k == len(rows) - 1 else ""), state, role, text)
        out += new
    digest.add(out)
    return out, (gaps, *counts, illegal, cost, "".join(edits) + tail, digest.hash.hexdigest())


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def sorted_pass(rows: DataFrame, id_type: str, turn_type: str, long: int, with_turns: bool) -> DataFrame:
    """Reports (no ``part``) of whole conversations, their repaired rows if asked for (with ``edit``), and the rows of all others.

    The others are the first and last conversation of a partition, which may go on beyond it, and those of over ``long`` rows.
    A conversation of which only absent rows are here leaves a row without ``i``.
    """
    nothing = (None,) * 8

    def run(source) -> Iterator[tuple]:
        conv, first, opened, n, gone, kept = None, True, False, 0, False, []

        def open_rows():
            nonlocal n, kept
            for turn, role, text in kept:
                yield conv, part, n, turn, role, text, None, *nothing
                n += 1
            kept = []

        def closed():
            if opened:
                yield from open_rows()
                if gone and not n:
                    yield conv, part, None, None, None, None, None, *nothing
                return
            out, report = settle(kept)
            yield conv, None, None, None, None, None, None, *report
            if with_turns:
                for k, (edit, role, text) in enumerate(out):
                    yield conv, part, k, None, role, text, edit, *nothing

        part = None
        for part, this, turn, role, text, present in source:
            if first or this != conv:
                if not first:
                    yield from closed()
                opened = first  # the first may have begun before
                conv, first, n, gone, kept = this, False, 0, False, []
            if not present:
                gone = True
                continue
            kept.append((turn, role, text))
            if opened or len(kept) > long:
                opened = True
                yield from open_rows()
        if not first:
            opened = True  # the last may go on
            yield from closed()

    spread = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 64)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_rows(
        spread.select(F.spark_partition_id().alias("part"), "conv_id", "turn", "role", "text", "present"),
        f"conv_id {id_type}, part int, i bigint, turn {turn_type}, role string, text string, edit string, {REPORT}", run,
    )


def code_of(fault: Column, role: Column) -> Column:
    first = F.substring(role, 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    return (3 * initial + F.when(fault.isin("blank", "duplicate"), 2).when(fault == "truncated", 1).otherwise(0)).cast("int")


def number_chunks(rows: DataFrame, chunk: int) -> DataFrame:
    """``rows`` with the number ``k`` of their chunk in the conversation, ``at`` in the chunk, and the number ``of`` chunks."""
    pieces = rows.groupBy("conv", "part").agg((F.floor(F.max("i") / chunk) + 1).alias("chunks"))
    # a row for each conversation and partition, not for each chunk or turn
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(
        "conv", "part", F.coalesce(F.sum("chunks").over(before), F.lit(0)).alias("base"), F.sum("chunks").over(Window.partitionBy("conv")).alias("of")
    )
    return rows.join(pieces, ["conv", "part"]).withColumn("k", F.col("base") + F.floor(F.col("i") / chunk)).withColumn("at", (F.col("i") % chunk).cast("int"))


def converge(chunks: DataFrame, id_type: str) -> DataFrame:
    """``(conv, k, end)``: for every chunk of ``(conv, k, of, codes)`` the costs after it, less their least.

    Backward passes over all chunks at once, from a speculative vector each, until no chunk's vector changes.
    """
    kind = f"conv struct<conv_id:{id_type}>, k bigint, end array<int>, begin array<int>"

    def start(source) -> Iterator[tuple]:
        for conv, k, codes in source:
            yield conv, k, list(END), list(backward(codes, END))

    def again(source) -> Iterator[tuple]:
        for conv, k, codes, end, begin, true_end in source:
            yield conv, k, true_end, list(fix_up(codes, tuple(end), tuple(true_end), tuple(begin)))

    state = materialize(map_rows(chunks.select("conv", "k", "codes"), kind, start), "costs")
    while True:
        follows = state.select("conv", (F.col("k") - 1).alias("k"), F.col("begin").alias("true_end"))
        wrong = materialize(state.join(follows, ["conv", "k"]).filter(F.col("end") != F.col("true_end")), "wrong")
        if wrong.isEmpty():
            return state.select("conv", "k", "end")
        fixed = map_rows(wrong.join(chunks.select("conv", "k", "codes"), ["conv", "k"]).select("conv", "k", "codes", "end", "begin", "true_end"), kind, again)
        state = materialize(state.join(wrong.select("conv", "k"), ["conv", "k"], "left_anti").unionByName(fixed), "costs")


def first_states(maps: DataFrame) -> DataFrame:
    """``(conv, k, state)`` at the begin of every chunk, from ``(conv, k, of, leads)``: the state after it, by the one before it.

    Prefix composition by doubling: after j rounds a map leads through 2**j chunks.
    """
    span, most = 1, maps.agg(F.max("of")).first()[0] or 0
    while span < most:
        earlier = maps.select("conv", (F.col("k") + span).alias("k"), F.col("leads").alias("before"))
        leads = F.when(F.col("before").isNull(), F.col("leads")).otherwise(F.transform("before", lambda s: F.element_at("leads", s + 1)))
        maps = materialize(maps.join(earlier, ["conv", "k"], "left").select("conv", "k", "of", leads.alias("leads")), "states")
        span *= 2
    after = maps.filter("k + 1 < of").select("conv", (F.col("k") + 1).alias("k"), F.element_at("leads", 1).alias("state"))
    return maps.select("conv", "k").join(after, ["conv", "k"], "left").select("conv", "k", F.coalesce("state", F.lit(0)).alias("state"))


def in_chunks(rows: DataFrame, id_type: str, chunk: int, with_turns: bool) -> Repaired:
    """Reports and repaired rows of conversations of any length: ``rows`` as the sorted pass leaves them open."""
    rows = rows.withColumn("conv", F.struct("conv_id"))  # a struct with a null in it is equal to itself
    here = rows.filter("i IS NOT NULL")
    said = F.rtrim(F.translate("text", SPACE[1:], " " * (len(SPACE) - 1)))
    name = F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    marked = here.select(
        "conv", "part", "i", "turn", "role", name.alias("name"), (said == "").alias("blank"), F.substring(said, -1, 1).isin(".", "!", "?").alias("whole")
    )
    first = marked.groupBy("conv", "name").agg(F.min(F.struct("part", "i")).alias("first")).select("conv", "first.*", F.lit(True).alias("fresh"))
    fault = F.when(F.col("blank"), "blank").when(F.col("fresh").isNull(), "duplicate").when(~F.col("whole"), "truncated")
    faults = marked.join(first, ["conv", "part", "i"], "left").withColumn("fault", fault)
    faults = faults.select("conv", "part", "i", "turn", "fault", code_of(F.col("fault"), F.col("role")).alias("code"))
    faults = materialize(number_chunks(faults, chunk), "faults")
    codes = F.transform(F.array_sort(F.collect_list(F.struct("at", "code"))), lambda x: x["code"])
    chunks = materialize(faults.groupBy("conv", "k", "of").agg(codes.alias("codes")), "chunks")
    ends = converge(chunks, id_type)
    held = f"conv struct<conv_id:{id_type}>, k bigint, of bigint"

    def leads(source) -> Iterator[tuple]:
        for conv, k, of, codes, end in source:
            yield conv, k, of, [trace(codes, tuple(end), s)[1] for s in range(4)]

    whole = chunks.join(ends, ["conv", "k"])
    maps = materialize(map_rows(whole.select("conv", "k", "of", "codes", "end"), f"{held}, leads array<int>", leads), "states")
    before = chunks.select("conv", (F.col("k") + 1).alias("k"), F.element_at("codes", -1).alias("before"))
    whole = whole.join(first_states(maps), ["conv", "k"]).join(before, ["conv", "k"], "left")

    def edit(source) -> Iterator[tuple]:
        for conv, k, of, codes, end, state, before in source:
            edits, last, cost = trace(codes, tuple(end), state)
            if k == of - 1:
                edits[-1] += END_EDITS[last]
                cost += END[last]
            states = [state]
            for code, ops in zip(codes, edits):
                for op in ops:
                    state = KEEP[state, code // 3] if op == "K" else NEXT[state] if op in "IR" else state
                states.append(state)
            initials = ([before // 3] if before is not None else []) + [c // 3 for c in codes]
            yield conv, k, of, edits, states[:-1], cost, sum(p not in LEGAL for p in zip(initials, initials[1:]))

    plans = materialize(map_rows(
        whole.select("conv", "k", "of", "codes", "end", "state", "before"), f"{held}, edits array<string>, states array<int>, cost bigint, illegal bigint", edit
    ), "plans")
    each = plans.select("conv", "k", F.posexplode(F.arrays_zip("edits", "states")).alias("at", "e")).select("conv", "k", "at", "e.*")
    lines = faults.select("conv", "part", "i", "k", "at").join(each, ["conv", "k", "at"]).drop("at")
    lines = lines.join(here.select("conv", "part", "i", "role", "text"), ["conv", "part", "i"])

    def digests(source) -> Iterator[tuple]:
        conv, digest = None, None
        for this, ops, state, role, text in source:
            if digest is None or this != conv:
                if digest:
                    yield conv, digest.hash.hexdigest()
                conv, digest = this, Digest()
            digest.add(rewrite(ops, state, role, text)[0])
        if digest:
            yield conv, digest.hash.hexdigest()

    kind = f"conv struct<conv_id:{id_type}>"
    in_order = lines.repartition("conv").sortWithinPartitions("conv", "part", "i").select("conv", "edits", "states", "role", "text")
    hashed = map_rows(in_order, f"{kind}, repaired_sha256 string", digests)
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.array_join("edits", "").alias("a")))), lambda x: x["a"]), "")
    sums = plans.groupBy("conv").agg(F.sum("cost").alias("cost"), F.sum("illegal").alias("illegal"), audit.alias("audit"))
    counts = faults.groupBy("conv", "turn").agg(*[F.count_if(F.col("fault") == f).alias(f) for f in ("blank", "duplicate", "truncated")])
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("bigint")
    counts = counts.groupBy("conv").agg(gaps.alias("gaps"), *[F.sum(f).alias(f) for f in ("blank", "duplicate", "truncated")])
    ids = rows.select("conv").distinct()
    found = ids.join(sums, "conv", "left").join(counts, "conv", "left").join(hashed, "conv", "left")
    empty = {"audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    reports = found.select(
        "conv.conv_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS], *[F.coalesce(c, F.lit(v)).alias(c) for c, v in empty.items()]
    )
    if not with_turns:
        return Repaired(reports, None)

    def expand(source) -> Iterator[tuple]:
        for conv, part, i, ops, state, role, text in source:
            for n, (op, new_role, new_text) in enumerate(rewrite(ops, state, role, text)[0]):
                yield conv, part, i, n, op, new_role, new_text

    turns = map_rows(
        lines.select("conv", "part", "i", "edits", "states", "role", "text"), f"{kind}, part int, i bigint, n int, edit string, role string, text string", expand
    )
    return Repaired(reports, turns.select("conv.conv_id", "part", "i", "n", "edit", "role", "text"))


def repair(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           present: Column | None = None, with_turns: bool = False, long: int = LONG, chunk: int = CHUNK) -> Repaired:
    """``reports (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one row per conversation.

    ``with_turns`` also gives ``turns (conv_id, part, i, n, edit, role, text)``: the repaired rows, in order of ``part, i, n``.
    Rows for which ``present`` is false are not there, but their conversation is reported. ``gaps`` are turns that are missing between
    the least and the largest; ``illegal`` neighbours whose initials are not su, ua or au.
    """
    types = rows.schema[id_col].dataType.simpleString(), rows.schema[turn_col].dataType.simpleString()
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(
        F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), text(role_col).alias("role"), text(text_col).alias("text"),
        (F.lit(True) if present is None else present).alias("present"),
    )
    found = materialize(sorted_pass(own, *types, long, with_turns), "conversations")
    settled = found.filter("part IS NULL").select("conv_id", *COUNTS, "audit", "repaired_sha256")
    rest = in_chunks(found.filter("part IS NOT NULL AND edit IS NULL").select("conv_id", "part", "i", "turn", "role", "text"), types[0], chunk, with_turns)
    if not with_turns:
        return Repaired(settled.unionByName(rest.reports), None)
    turns = found.filter("edit IS NOT NULL").select("conv_id", "part", "i", F.lit(0).alias("n"), "edit", "role", "text")
    return Repaired(settled.unionByName(rest.reports), turns.unionByName(rest.turns))


def damage(rows: DataFrame) -> DataFrame:
    """Conversations with faults put in by the hash of ``conv_id:turn``: ``(conv_id, turn, role, text, present)``.

    Of 20 rows one is dropped (not ``present``), one emptied, one loses its sentence ends, one is repeated, one gets the role user. Nulls
    in the hash, the role and the text are one space.
    """
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    lot = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn"))) % 20
    own = rows.select("conv_id", "turn", known("role").alias("role"), known("text").alias("text"), lot.alias("lot"))
    copies = F.explode(F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("lot") == 4, "user").otherwise(F.col("role"))
    return own.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("lot") != 0).alias("present"), copies.alias("copy")).drop("copy")
