"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton holds every run of consecutive words of every item. A document's words are streamed through it once; after each
word it knows the longest run ending there that some item contains. From ``window`` words on, that run is contaminated.
An item of fewer words counts where it occurs whole. Words: A-Z lower-cased, then runs of other characters than ASCII
controls, spaces and punctuation.

Items are taken in blocks of about ``block_bytes`` of text (one block as a rule; an item is held whole), so that a worker's
automaton is bounded however large the benchmark is. Documents are not shuffled.

Defined cases: null or empty texts have no words and no spans; items without words match nothing; items with a null id mark
words but are not listed; repeated item rows count once, repeated documents each; an empty benchmark leaves documents clean.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import WORD_BYTES, as_bytes, bounded_batches, map_rows, merge_spans, texts

WINDOW = 10
BLOCK_BYTES = 1 << 20
#: A document of which more than this share of words is contaminated is dropped whole.
MAX_COVERAGE = 0.5
#: Rows that are matched against one block before the next block is taken.
ROWS = 512


class Automaton:
    """Suffix automaton of several word sequences, with the items that each window occurs in."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.words: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        coded = [(name, [self.words.setdefault(w, len(self.words)) for w in words]) for name, words in items if words]
        for _, codes in coded:
            last = 0
            for c in codes:
                last = self._extend(last, c)
        self._name(coded)
        #: Fewer consecutive known words than this cannot match anything.
        self.least = min((min(window, len(codes)) for _, codes in coded), default=window)

    def _new(self, size: int, link: int, following: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.next.append(following)
        return len(self.size) - 1

    def _split(self, p: int, c: int, q: int) -> int:
        """The state for the suffixes of ``q`` that are no longer than state ``p`` plus ``c``."""
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._new(self.size[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, c, self.next[last][c])
        new = self._new(self.size[last] + 1, 0, {})
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.next[p][c])
        return new

    def _name(self, coded: list[tuple[str | None, list[int]]]) -> None:
        """Which items each window state (and each whole short item) stands for."""
        self.top = [0] * len(self.size)  # the shortest state above that still has a whole window
        self.marked = [False] * len(self.size)  # a short item ends here or at a suffix of it
        self.inside: dict[int, set] = {}
        self.short: dict[int, dict[int, set]] = {}
        order = sorted(range(1, len(self.size)), key=self.size.__getitem__)
        for s in order:
            self.top[s] = s if self.size[self.link[s]] < self.window else self.top[self.link[s]]
        for name, codes in coded:
            state = 0
            for k, c in enumerate(codes, 1):
                state = self.next[state][c]
                if k >= self.window:
                    self.inside.setdefault(self.top[state], set()).add(name)
            if len(codes) < self.window:
                self.short.setdefault(state, {}).setdefault(len(codes), set()).add(name)
        for s in order:
            self.marked[s] = s in self.short or self.marked[self.link[s]]

    def match(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Contaminated word intervals and the names of the items behind them."""
        known = self.words.get
        codes = [known(w, -1) for w in words]
        spans: list[tuple[int, int]] = []
        names: set = set()
        for start, end in self._runs(codes):
            self._stream(codes, start, end, spans, names)
        return merge_spans(spans), names - {None}

    def _runs(self, codes: list[int]) -> Iterator[tuple[int, int]]:
        """Stretches of known words that are long enough to match."""
        edges = np.flatnonzero(np.diff(np.concatenate(([0], np.asarray(codes, dtype=np.int64) >= 0, [0])).astype(np.int8)))
        for start, end in edges.reshape(-1, 2)[np.diff(edges.reshape(-1, 2), axis=1)[:, 0] >= self.least].tolist():
            yield start, end

    def _stream(self, codes: list[int], start: int, end: int, spans: list, names: set) -> None:
        follow, link, size, window = self.next, self.link, self.size, self.window
        state = length = 0
        for i in range(start, end):
            c = codes[i]
            while state and c not in follow[state]:
                state = link[state]
                length = size[state]
            if c in follow[state]:
                state = follow[state][c]
                length += 1
            if length >= window:
                first = i + 1 - length
                if spans and spans[-1][0] >= first and spans[-1][1] == i:
                    spans.pop()
                spans.append((first, i + 1))
                names |= self.inside[self.top[state]]
            if self.marked[state]:
                above = state
                while above > 0 and self.marked[above]:
                    for k, ids in self.short.get(above, {}).items():
                        if k <= length:
                            spans.append((i + 1 - k, i + 1))
                            names |= ids
                    above = link[above]


@lru_cache(maxsize=4)
def _automaton(block: Broadcast, window: int) -> Automaton:
    """Built once per Python worker, in which a broadcast variable stays the same object."""
    return Automaton([(n, split_words(t)) for n, t in block.value], window)


def split_words(raw: bytes) -> list[bytes]:
    return raw.translate(WORD_BYTES).split()


class Matcher:
    """Blocks of items as broadcast variables; automata are built in the workers, a few at a time."""

    def __init__(self, items: DataFrame, id_col: str, text_col: str, window: int, block_bytes: int):
        rows = texts(items, id_col, text_col).select(F.col("doc_id").cast("string").alias("name"), F.encode("text", "UTF-8").alias("text"))
        rows = rows.filter(F.octet_length("text") > 0).distinct()
        total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = -(-total // block_bytes)
        block = F.pmod(F.xxhash64("name", "text"), F.lit(max(n, 1)))
        sc = items.sparkSession.sparkContext
        # every collected block has about block_bytes of text
        self.blocks = [sc.broadcast([tuple(r) for r in rows.filter(block == k).collect()]) for k in range(n)]
        self.window = window

    def _matches(self, words: list[list[bytes]]) -> list[tuple[list, set]]:
        found: list[tuple[list, set]] = [([], set()) for _ in words]
        for b in self.blocks:
            own = _automaton(b, self.window)
            for k, w in enumerate(words):
                spans, names = own.match(w)
                found[k] = (merge_spans(found[k][0] + spans), found[k][1] | names)
        return found

    def rows(self, source: Iterator[tuple]) -> Iterator[tuple]:
        while some := list(islice(source, ROWS)):
            words = [split_words(raw) for _, raw in some]
            for (doc, _), w, (spans, names) in zip(some, words, self._matches(words)):
                yield doc, len(w), spans, sorted(names)

    def clean(self, texts: list[str], max_coverage: float) -> list[str | None]:
        """Texts without their contaminated spans; None for one that has too many. Untouched texts are the same objects."""
        words = [split_words(t.encode()) for t in texts]
        out: list[str | None] = list(texts)
        for k, (spans, _) in enumerate(self._matches(words)):
            if sum(e - s for s, e in spans) > max_coverage * len(words[k]):
                out[k] = None
                continue
            while spans:  # what closes up may make another window
                out[k] = cut_words(out[k], spans)
                spans = self._matches([split_words(out[k].encode())])[0][0]
        return out


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    raw = text.encode()
    at = [m.span() for m in re.finditer(rb"[^ ]+", raw.translate(WORD_BYTES))]
    pieces, last = [], 0
    for start, end in spans:
        pieces.append(raw[last:at[start][0]])
        last = at[end - 1][1]
    return b"".join([*pieces, raw[last:]]).decode()


def find_overlap(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``(doc_id, n_words, spans, item_ids)``: merged word intervals (end exclusive) that items contain."""
    matcher = Matcher(items, item_id, item_text, window, block_bytes)
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        as_bytes(texts(docs, id_col, text_col)),
        f"doc_id {kind}, n_words bigint, spans array<struct<start:bigint,end:bigint>>, item_ids array<string>",
        matcher.rows,
    )


def decontaminate(
    docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    window: int = WINDOW, max_coverage: float = MAX_COVERAGE, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with contaminated spans cut out of the text; documents with more than ``max_coverage`` of them go."""
    matcher = Matcher(items, item_id, item_text, window, block_bytes)
    place, kind = docs.columns.index(text_col), docs.schema[text_col].dataType

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                old = part.column(place).to_pylist()
                new = matcher.clean([t or "" for t in old], max_coverage)
                keep = pa.array([t is not None for t in new])
                text = pa.array([o if o is None else n for o, n in zip(old, new)], part.schema.field(place).type)
                columns = [*part.columns[:place], text, *part.columns[place + 1:]]
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema).filter(keep)

    assert kind.simpleString() == "string"
    return bounded_batches(docs).mapInArrow(run, docs.schema)
