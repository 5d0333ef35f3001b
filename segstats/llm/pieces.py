"""SentencePiece encoding and decoding for merge-type vocabularies.

Every text is cut where no piece can reach across: before space symbols, at line ends, behind letters. The parts are encoded by an agenda
of adjacent symbol pairs, best score first and leftmost on ties; a merged pair puts its two new neighbours on the
agenda. Symbols outside the vocabulary fall back to their UTF-8 bytes. Parts recur, so a task keeps a bounded table of
those it has met. Each part is checked against the library when it enters that table; where they ever differ, the library's
ids are taken and counted in ``n_corrected`` (0 in all tests).

Defined cases: a null or empty text has no tokens and decodes to an empty text; repeated rows give repeated rows; an empty
table an empty one. The vocabulary is loaded once per Python worker.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, islice

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import map_rows, texts

SPACE = "▁"
#: Up to this many symbols the agendas of many parts are kept in one array; above, each is a heap.
SHORT = 40
#: Above every symbol, to make one number of two; above every rank.
SYMBOLS, NEVER = 1 << 22, 1 << 40
#: Parts that a task remembers (about 220 bytes each) in each of two generations.
REMEMBERED = 250_000
#: Characters whose parts are looked up together, and parts at a time.
GROUP = 400_000
CHUNK = 1 << 20


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Agenda:
    """Merge vocabulary: ``ids`` of pieces and ``cost`` (negated score) of those that merging may make."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        self.ids: dict[str, int] = {}
        self.cost: dict[str, float] = {}
        self.byte = [0] * 256
        for i in range(lib.vocab_size()):
            piece = lib.id_to_piece(i)
            if lib.is_byte(i):
                self.byte[int(piece[3:5], 16)] = i
            elif not (lib.is_control(i) or lib.is_unknown(i) or lib.is_unused(i)):
                self.ids[piece] = i
                self.cost[piece] = -lib.get_score(i)
        if any(SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError("pieces with an inner space symbol cannot be cut at spaces")
        self.cut = re.compile(self._cut_pattern())
        self._pair_table()

    def _cut_pattern(self) -> str:
        """Parts that merging cannot join: they start at space symbols, at line ends and behind a run of letters.

        ``letters`` is closed: whatever follows one of them inside some piece is one of them too.
        """
        after: dict[str, set[str]] = {}
        for piece in self.ids:
            for a, b in zip(piece, piece[1:]):
                after.setdefault(a, set()).add(b)
        if any("\n" in p for p in self.ids):  # the check of a part needs a line end that stands alone
            return " *[^ ]+| +"
        letters = {c for c in after.keys() | set().union(*after.values()) if c.isalpha()}
        while more := set().union(*(after.get(c, set()) for c in letters)) - letters - {SPACE}:
            letters |= more
        known = "".join(map(re.escape, sorted(letters)))
        other = f"[^{known} \n]"
        return f"\n+| *{other}*[{known}]+| *{other}+| +" if known else f"\n+| *{other}+| +"

    def parts(self, text: str) -> list[str]:
        """Parts with plain spaces for space symbols, which the library takes for the same and which need less memory."""
        return self.cut.findall(" " + text.replace(SPACE, " ")) if text else []

    def _pair_table(self) -> None:
        """Arrays for merging many parts at once: rank and result of every pair of pieces, ids of characters."""
        order = np.unique(np.array(list(self.cost.values())), return_inverse=True)[1]
        rank = dict(zip(self.cost, order.tolist()))
        pairs = {}
        for piece, r in rank.items():
            for k in range(1, len(piece)):
                a, b = self.ids.get(piece[:k]), self.ids.get(piece[k:])
                if a is not None and b is not None:
                    pairs[a * SYMBOLS + b] = (r, self.ids[piece])
        keys = np.array(sorted(pairs), dtype=np.int64)
        self.pairs = np.append(keys, -1)  # never equal to a key, so that a place behind the last is no match
        self.rank = np.array([pairs[k][0] for k in keys.tolist()] + [NEVER], dtype=np.int64)
        self.made = np.array([pairs[k][1] for k in keys.tolist()] + [0], dtype=np.int64)
        # a character that is no piece is its code point above all ids; it merges with nothing
        self.first_unknown = self.lib.vocab_size()
        self.chars = np.arange(0x110000, dtype=np.int32) + self.first_unknown
        for piece, i in self.ids.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = i

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * SYMBOLS + right
        at = np.minimum(np.searchsorted(self.pairs[:-1], key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, at, len(self.pairs) - 1)

    def merge_many(self, parts: list[str]) -> list[list[int]]:
        """Symbols of each part after merging, as ids.

        Every part keeps its agenda as a stretch of one array with the rank of each adjacent pair. A round takes the best
        pair of every part, the leftmost on ties, merges it and ranks its two neighbours anew; finished parts leave.
        """
        out: list[list[int]] = [[] for _ in parts]
        symbols = self.chars[np.frombuffer("".join(parts).encode("utf-32-le"), dtype=np.uint32)].astype(np.int64)
        part = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        pair = np.full(len(symbols), len(self.pairs) - 1)
        inner = np.flatnonzero(part[1:] == part[:-1])
        pair[inner] = self._ranks(symbols[inner], symbols[inner + 1])
        while len(symbols):
            first = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            size = np.diff(np.append(first, len(part)))
            rank = self.rank[pair]
            best = np.minimum.reduceat(rank, first)
            ends = best == NEVER
            if ends.any():
                done = np.repeat(ends, size)
                flat, where = symbols[done].tolist(), np.cumsum(np.append(0, size[ends])).tolist()
                for k, a, b in zip(part[first[ends]].tolist(), where, where[1:]):
                    out[k] = flat[a:b]
                stay = ~done
                symbols, part, pair, rank = symbols[stay], part[stay], pair[stay], rank[stay]
                best, size = best[~ends], size[~ends]
                if not len(symbols):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, size))
            hit = hit[np.append(True, part[hit[1:]] != part[hit[:-1]])]
            symbols[hit] = self.made[pair[hit]]
            keep = np.ones(len(symbols), dtype=bool)
            keep[hit + 1] = False
            at = hit - np.arange(len(hit))  # one symbol has gone before each later hit
            symbols, part, pair = symbols[keep], part[keep], pair[keep]
            pair[at] = len(self.pairs) - 1
            for k in (at[at > 0] - 1, at[at < len(symbols) - 1]):
                k = k[part[k] == part[k + 1]]
                pair[k] = self._ranks(symbols[k], symbols[k + 1])
        return out

    def merge(self, part: str) -> list[str]:
        """Pieces of one part by score-ordered merging."""
        return self._merge_long(list(part))

    def _merge_long(self, symbols: list[str]) -> list[str]:
        get = self.cost.get
        before = list(range(-1, len(symbols) - 1))
        after = list(range(1, len(symbols))) + [-1]
        agenda = [
            (get(a + b), i, a + b) for i, (a, b) in enumerate(zip(symbols, symbols[1:])) if a + b in self.cost
        ]
        heapq.heapify(agenda)
        while agenda:
            _, i, piece = heapq.heappop(agenda)
            j = after[i]
            if not symbols[i] or j < 0 or symbols[i] + symbols[j] != piece:
                continue  # one of the two has been merged otherwise
            symbols[i], symbols[j] = piece, ""
            after[i] = k = after[j]
            if k >= 0:
                before[k] = i
                if piece + symbols[k] in self.cost:
                    heapq.heappush(agenda, (get(piece + symbols[k]), i, piece + symbols[k]))
            h = before[i]
            if h >= 0 and symbols[h] + piece in self.cost:
                heapq.heappush(agenda, (get(symbols[h] + piece), h, symbols[h] + piece))
        return [s for s in symbols if s]

    def encode_parts(self, parts: list[str]) -> list[list[int]]:
        """Ids of each part; short ones are merged together, each long one with a heap."""
        own = [p.replace(" ", SPACE) for p in parts]
        short = [k for k, p in enumerate(own) if len(p) <= SHORT]
        out: list[list[int]] = [[] for _ in own]
        for k, symbols in zip(short, self.merge_many([own[k] for k in short]) if short else []):
            out[k] = symbols if max(symbols) < self.first_unknown else self._fall_back(symbols)
        for k, p in enumerate(own):
            if len(p) > SHORT:
                pieces = self.merge(p)
                known = [self.ids.get(s) for s in pieces]
                out[k] = known if None not in known else [
                    i for s, one in zip(pieces, known) for i in ([one] if one is not None else [self.byte[b] for b in s.encode()])
                ]
        return out

    def _fall_back(self, symbols: list[int]) -> list[int]:
        out: list[int] = []
        for i in symbols:
            if i < self.first_unknown:
                out.append(i)
            else:
                out.extend(self.byte[b] for b in chr(i - self.first_unknown).encode())
        return out

    def checked(self, parts: list[str]) -> list[tuple[list[int], bool]]:
        """Ids of each part, with the library's where they differ, and whether they did.

        The library puts a space symbol before every text, so a part that starts with a space goes without it, and any
        other goes behind a line end, whose ids are known.
        """
        lead = len(self.lib.encode("\n"))
        bare = [len(p) > 1 and p[0] == " " for p in parts]
        theirs = self.lib.encode([p[1:] if b else "\n" + p for p, b in zip(parts, bare)], num_threads=1)
        theirs = [ids if b else ids[lead:] for ids, b in zip(theirs, bare)]
        own = self.encode_parts(parts)
        return [(ids if (wrong := mine != ids) else mine, wrong) for mine, ids in zip(own, theirs)]

    def decode(self, ids: list[int]) -> str:
        return self.lib.decode(ids)


class Memory:
    """Bounded table of encoded parts; ``corrected`` names those whose ids are the library's."""

    def __init__(self, agenda: Agenda, size: int = REMEMBERED):
        self.agenda, self.size = agenda, size
        self.new: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.corrected: set[str] = set()
        self.decimal = [str(i) for i in range(agenda.lib.vocab_size())]

    def look_up(self, parts: list[str]) -> list[tuple[int, ...]]:
        hits = list(map(self.new.get, parts))
        if None not in hits:
            return hits
        if len(self.new) > self.size:
            self.old, self.new = self.new, {}
        new, old = self.new, self.old
        gaps = [k for k, hit in enumerate(hits) if hit is None]
        missing = dict.fromkeys([parts[k] for k in gaps])
        unknown = [p for p in missing if p not in old]
        new.update((p, old[p]) for p in missing if p in old)
        for p, (ids, corrected) in zip(unknown, self.agenda.checked(unknown)):
            new[p] = tuple(ids)
            if corrected:
                self.corrected.add(p)
        for k in gaps:
            hits[k] = new[parts[k]]
        return hits


@lru_cache(maxsize=2)
def agenda(path: str) -> Agenda:
    return Agenda(path)


@lru_cache(maxsize=2)
def memory(path: str) -> Memory:
    return Memory(agenda(path))


def encode_texts(texts: list[str], path: str) -> list[tuple[list[int], str, int]]:
    """Per text: ids, their decimal form joined by commas, and the number of corrected parts."""
    known = memory(path)
    parts = [known.agenda.parts(t) for t in texts]
    flat = list(chain.from_iterable(parts))
    hits = iter([h for at in range(0, len(flat), CHUNK) for h in known.look_up(flat[at:at + CHUNK])])
    out = []
    for some in parts:
        ids = list(chain.from_iterable(islice(hits, len(some))))
        wrong = sum(p in known.corrected for p in some) if known.corrected else 0
        out.append((ids, ",".join(map(known.decimal.__getitem__, ids)), wrong))
    return out


def in_groups(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows whose texts (second value) have about GROUP characters together; a longer text is a group of its own."""
    some, size = [], 0
    for row in rows:
        if some and size + len(row[1]) > GROUP:
            yield some
            some, size = [], 0
        some.append(row)
        size += len(row[1])
    if some:
        yield some


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None) -> DataFrame:
    """``(doc_id, ids)``: token ids of every whole text, as the library gives them without begin or end ids."""
    path = model or default_model()
    kind = docs.schema[id_col].dataType.simpleString()
    return map_rows(
        texts(docs, id_col, text_col), f"doc_id {kind}, ids array<int>",
        lambda rows: (
            (d, ids) for some in in_groups(rows) for (d, _), (ids, _, _) in zip(some, encode_texts([t for _, t in some], path))
        ),
        per_batch=256,
    )


def decode(tokens: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """``(doc_id, text)``; null ids give an empty text."""
    path = model or default_model()
    kind = tokens.schema[id_col].dataType.simpleString()
    return map_rows(
        tokens.select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")), f"doc_id {kind}, text string",
        lambda rows: ((d, agenda(path).decode(list(i or []))) for d, i in rows), per_batch=256,
    )


def token_digests(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str | None = None
) -> DataFrame:
    """Per text: number of ids, SHA-256 of the ids and of the decoded text; nothing is shuffled."""
    path = model or default_model()
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(source):
        for some in in_groups(source):
            for (doc, _), (ids, said, wrong) in zip(some, encode_texts([t for _, t in some], path)):
                back = agenda(path).decode(ids) if ids else ""
                yield doc, len(ids), sha256(said.encode()).hexdigest(), sha256(back.encode()).hexdigest(), wrong

    return map_rows(
        texts(docs, id_col, text_col),
        f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_corrected bigint", rows,
    )
