"""Personal data: base patterns, and a semi-Markov conditional random field over candidate segments.

Base spans (email, ip, card, phone) come from fixed patterns and always stay. Around tokens that could begin or end an entity, the
field scores every candidate segment of at most ``MAX_TOKENS`` tokens as a whole: shape, digits, check sum, octets, clean
borders, a cue word before it. Dynamic programming over segments picks boundaries and types together. Weights are
fitted by gradient ascent on the likelihood of the base spans in a bounded sample of texts, around prior weights that say what a
feature should mean; with no sample the prior stays. Found segments that overlap no base span are added.

Time is linear in the length of a text: the fixed patterns never try a character twice, and candidate segments, at most ``MAX_TOKENS``
tokens, are matched on copies in which a long token or gap counts as its first ``SHADOW`` characters (no form depends on more). Texts
without a digit or an at-sign, also a spelled one, are passed over. Nothing is shuffled but the sample.

Defined cases: a null or empty text has no spans; repeated rows give repeated rows; an empty table an empty result. Positions are code
points, ends exclusive.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import as_bytes, map_rows, texts

KINDS = ("email", "ip", "card", "phone")
#: Texts that weights are fitted on, at most, and stretches of each.
SAMPLE_TEXTS = 300
SAMPLE_STRETCHES = 20
ROUNDS, RATE, PRIOR_WIDTH = 12, 0.5, 1.0
MAX_TOKENS = 24
#: Characters of a token or gap that decide whether a segment has a form; longer than any number's form.
SHADOW = 64
#: Tokens to either side of a trigger that belong to its stretch.
AROUND = 8

LOCAL = r"[A-Za-z0-9._%+-]"
#: A local part starts where no character of one precedes, or right behind the match before it.
EMAIL = re.compile(rf"(?<!{LOCAL}){LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
EMAIL_HERE = re.compile(rf"{LOCAL}++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.([0-9]+)\.([0-9]+)\.([0-9]+)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: A text without these has no base span and no spelled address but one in words: `` at `` next to a trigger that is no sign.
PROBE = re.compile(rb"[0-9@]|[\[(]at")
WORD_TRIGGER = re.compile(rb"(?<![a-z])dot(?![a-z])|\+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def octets(s: str) -> bool:
    """All four parts at most 255; leading zeros do not matter, and a part may be very long."""
    return all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in s.split("."))


def emails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while at <= len(text):
        m = EMAIL_HERE.match(text, at) if at else None
        m = m or EMAIL.search(text, at)
        if m is None:
            return
        yield m.span()
        at = m.end()


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("email", *s) for s in emails(text)] if "@" in text else []
    out += [("ip", *m.span()) for m in IP.finditer(text) if octets(m[0])]
    for m in CARD.finditer(text):
        digits = only_digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return out


# ---- the field ---------------------------------------------------------------------------

TOKEN = re.compile(r"[^\W_]+|\S")
#: Where tokens that candidate segments lie around can begin.
TRIGGER = re.compile(r"[@+]|[0-9]+|at|dot")
AT = r"(?:@|\x20?\[at\]\x20?|\x20?\(at\)\x20?|\x20at\x20)"
DOT = r"(?:\.|\x20?\[dot\]\x20?|\x20?\(dot\)\x20?|\x20dot\x20)"
SPELLED = r"\x20?\[dot\]\x20?|\x20?\(dot\)\x20?|\x20dot\x20"
LOOSE = {
    # one way to read each character of the local part
    "email": re.compile(rf"[A-Za-z0-9%+-](?:[A-Za-z0-9%+._-]|{SPELLED})*{AT}[A-Za-z0-9-]+(?:{DOT}[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    "card": re.compile(r"[0-9](?:[\x20-]?[0-9]){11,18}"),
    "phone": re.compile(r"[+(]?[0-9][0-9\x20().-]{5,22}[0-9]"),
}
CUES = {
    "email": {"email", "mail", "contact", "write", "reach", "correo", "courriel"},
    "ip": {"ip", "host", "address", "server", "addr"},
    "card": {"card", "visa", "mastercard", "amex", "payment", "tarjeta", "carte", "karte"},
    "phone": {"phone", "tel", "telephone", "call", "mobile", "fax", "cell", "telefon", "teléfono", "téléphone", "whatsapp"},
}
#: What each feature should mean, before any text is seen.
PRIOR = {
    "email": {"bias": -6.0, "at_sign": 5.0, "spelled": 2.0, "top_level": 2.0, "clean": 1.0, "cue": 3.0},
    "ip": {"bias": -6.0, "octets": 4.0, "clean": 3.0, "cue": 2.0},
    "card": {"bias": -6.0, "luhn": 5.0, "length": 2.0, "clean": 1.0, "cue": 2.0, "one_issuer": 0.5},
    "phone": {"bias": -6.0, "plus": 4.0, "length": 3.0, "clean": 1.0, "cue": 3.0, "groups": 1.0},
}
NAMES = [(k, f) for k in KINDS for f in PRIOR[k]]
PLACE = {name: n for n, name in enumerate(NAMES)}
DIGITISH = re.compile(r"[0-9\x20().+-]*")


def prior_weights() -> np.ndarray:
    return np.array([PRIOR[k][f] for k, f in NAMES])


def segment_features(kind: str, text: str, start: int, end: int, cues: set[str]) -> list[int]:
    """Places of the features that a whole segment has."""
    s = text[start:end]
    before, after = text[start - 1:start], text[end:end + 1]
    has = {
        "bias": True, "clean": not (before.isalnum() or after.isalnum() or (kind != "email" and before in ("+", "."))) and s.count("(") == s.count(")"),
        "cue": bool(cues & CUES[kind]),
    }
    if kind == "email":
        has |= {"at_sign": "@" in s, "spelled": "@" not in s, "top_level": s[-2:].isalpha()}
    elif kind == "ip":
        has["octets"] = octets(s)
    elif kind == "card":
        digits = only_digits(s)
        has |= {"luhn": luhn(digits), "length": 13 <= len(digits) <= 19, "one_issuer": digits[0] in "3456"}
    else:
        digits = only_digits(s)
        has |= {"plus": s[0] == "+", "length": 9 <= len(digits) <= 15, "groups": len(re.findall(r"[0-9]+", s)) > 2}
    return [PLACE[kind, f] for f, on in has.items() if on]


def shorter(text: str, start: int, end: int) -> str:
    """A token for matching: a long one as its first characters, or as one that is in no form if it has any of that kind."""
    if end - start <= SHADOW:
        return text[start:end]
    token = text[start:end]
    return token[:SHADOW] if token.isascii() else "\u00e9"


class Stretch:
    """Tokens around triggers, and their candidate segments ``(first, last + 1, kind, features)``."""

    def __init__(self, text: str, tokens: list[tuple[int, int]]):
        self.tokens = tokens
        self.edges: list[tuple[int, int, str, list[int]]] = []
        marks = [i for i, (a, b) in enumerate(tokens) if text[a:b] in ("@", "at")]
        following = np.append(marks, len(tokens) + MAX_TOKENS)[np.searchsorted(marks, np.arange(len(tokens)))]
        mark_near = (following < np.arange(len(tokens)) + MAX_TOKENS).tolist()
        # each token with the gap before it, cut short
        shadow = []
        for (_, gap), (a, b) in zip([(0, tokens[0][0]), *tokens], tokens):
            between = text[gap:a]
            shadow.append(("\n" if "\n" in between else between[:SHADOW], text[a:b] if b - a <= SHADOW else shorter(text, a, b)))
        for i, (a, b) in enumerate(tokens):
            first = text[a]
            numeric = first in "+(" or "0" <= first <= "9"
            mailish = mark_near[i] and first.isalnum()
            if not (numeric or mailish):
                continue
            cues = {text[x:y].lower() for x, y in tokens[max(0, i - 3):i] if y - x <= SHADOW}
            s = ""
            for j in range(i, min(len(tokens), i + MAX_TOKENS)):
                end = tokens[j][1]
                gap, token = shadow[j]
                if j > i and gap == "\n":
                    break
                s = s + gap + token if j > i else token
                if numeric and not DIGITISH.fullmatch(s):
                    numeric = False
                if not (numeric or mailish):
                    break
                for kind in KINDS:
                    if (mailish if kind == "email" else numeric) and LOOSE[kind].fullmatch(s):
                        self.edges.append((i, j + 1, kind, segment_features(kind, text, a, end, cues)))

    def span(self, edge: tuple) -> tuple[str, int, int]:
        return edge[2], self.tokens[edge[0]][0], self.tokens[edge[1] - 1][1]


def stretches(text: str) -> Iterator[Stretch]:
    tokens = list(map(re.Match.span, TOKEN.finditer(text)))
    triggers = []
    for m in TRIGGER.finditer(text):  # few of a long text's tokens, so they are not all looked at
        i = bisect_left(tokens, (m.start(),))
        if i == len(tokens) or tokens[i][0] != m.start():
            continue  # within a token
        a, b = tokens[i]
        if text[a] in "@+" or ("0" <= text[a] <= "9" and text[a:b].isdigit()) or (text[a:b] == "at" and text[a - 1:a] in ("[", "(")) or text[a:b] == "dot":
            triggers.append(i)
    low = high = None
    for i in triggers:
        if high is not None and i - AROUND > high:
            yield Stretch(text, tokens[low:high + 1])
            low = None
        if low is None:
            low = max(0, i - MAX_TOKENS if text[tokens[i][0]] == "@" else i - AROUND)
        high = min(len(tokens) - 1, i + AROUND)
    if low is not None:
        yield Stretch(text, tokens[low:high + 1])


def scores(stretch: Stretch, weights: np.ndarray) -> list[float]:
    return [float(weights[f].sum()) for _, _, _, f in stretch.edges]


def best_segments(stretch: Stretch, weights: np.ndarray) -> list[tuple[str, int, int]]:
    """Viterbi over segments; a token outside all of them scores 0. On ties fewer and earlier segments win."""
    ending: dict[int, list[int]] = {}
    for e, (_, j, _, _) in enumerate(stretch.edges):
        ending.setdefault(j, []).append(e)
    if not ending:
        return []
    value = scores(stretch, weights)
    n = len(stretch.tokens)
    best, choice = [0.0] * (n + 1), [-1] * (n + 1)
    for j in range(1, n + 1):
        best[j] = best[j - 1]
        for e in ending.get(j, ()):
            total = best[stretch.edges[e][0]] + value[e]
            if total > best[j]:
                best[j], choice[j] = total, e
    out, j = [], n
    while j > 0:
        e = choice[j]
        if e < 0:
            j -= 1
        else:
            out.append(stretch.span(stretch.edges[e]))
            j = stretch.edges[e][0]
    return out[::-1]


def gradient(stretch: Stretch, gold: set[tuple[str, int, int]], weights: np.ndarray) -> np.ndarray:
    """Observed minus expected features of one stretch, by the forward and backward sums over segmentations."""
    n, value = len(stretch.tokens), scores(stretch, weights)
    ahead, back = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
    ahead[0] = back[n] = 0.0
    by_end: dict[int, list[int]] = {}
    by_start: dict[int, list[int]] = {}
    for e, (i, j, _, _) in enumerate(stretch.edges):
        by_end.setdefault(j, []).append(e)
        by_start.setdefault(i, []).append(e)
    for j in range(1, n + 1):
        ahead[j] = ahead[j - 1]
        for e in by_end.get(j, ()):
            ahead[j] = np.logaddexp(ahead[j], ahead[stretch.edges[e][0]] + value[e])
    for i in range(n - 1, -1, -1):
        back[i] = back[i + 1]
        for e in by_start.get(i, ()):
            back[i] = np.logaddexp(back[i], back[stretch.edges[e][1]] + value[e])
    out = np.zeros(len(weights))
    for e, (i, j, _, f) in enumerate(stretch.edges):
        out[f] -= np.exp(ahead[i] + value[e] + back[j] - ahead[n])
        out[f] += stretch.span(stretch.edges[e]) in gold
    return out


def fit(samples: list[str]) -> np.ndarray:
    """Weights by gradient ascent on the likelihood of base spans in ``samples``, with a normal prior."""
    prior = prior_weights()
    known = []
    for text in samples:
        gold = set(base_spans(text))
        known += [(s, gold) for s in stretches(text) if s.edges]
    weights = prior.copy()
    for _ in range(ROUNDS):
        total = (prior - weights) / PRIOR_WIDTH**2
        for stretch, gold in known:
            total += gradient(stretch, gold, weights)
        weights = weights + RATE * total / max(1, len(known))
    return weights


def near_triggers(raw: bytes) -> Iterator[str]:
    """Short pieces of a text around its triggers, for the sample."""
    text = raw.decode()
    for count, s in enumerate(stretches(text)):
        if count == SAMPLE_STRETCHES:
            return
        yield text[s.tokens[0][0]:s.tokens[-1][1]][:2000]


def sample(base: DataFrame, rows: int = SAMPLE_TEXTS) -> list[str]:
    """Stretches of at most ``rows`` different texts with a trigger, those with the smallest hashes.

    Only hashes are sorted; the texts themselves are read once their hashes are chosen.
    """
    hashed = base.select("text", F.xxhash64("text").alias("hash")).filter(
        F.rlike(F.col("text").cast("string"), F.lit("[0-9][0-9]|@"))
    )
    last = hashed.select("hash").distinct().orderBy("hash").limit(rows).agg(F.max("hash")).first()[0]
    if last is None:
        return []
    chosen = hashed.filter(F.col("hash") <= last).groupBy("hash").agg(F.first("text").alias("text")).select("text")
    some = map_rows(chosen, "piece string", lambda source: ((p,) for (raw,) in source for p in near_triggers(raw)))
    return sorted(r.piece for r in some.collect())


def find_spans(raw: bytes, weights: np.ndarray) -> tuple[list, list]:
    """Base spans, and base and added spans, each by kind and start."""
    if not PROBE.search(raw) and not (b" at " in raw and WORD_TRIGGER.search(raw)):
        return [], []
    text = raw.decode()
    base = base_spans(text)
    taken = sorted((s, e) for _, s, e in base)
    starts, longest = [s for s, _ in taken], np.maximum.accumulate([e for _, e in taken]) if taken else []
    added = []
    for stretch in stretches(text):
        for kind, s, e in best_segments(stretch, weights):
            k = int(np.searchsorted(starts, e)) if starts else 0  # base spans that start before this one's end
            if k == 0 or longest[k - 1] <= s:
                added.append((kind, s, e))
    order = lambda x: (KINDS.index(x[0]), x[1], x[2])
    return sorted(base, key=order), sorted(base + added, key=order)


def said(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, found)``; ``found`` has all spans by kind and start."""
    base = as_bytes(texts(docs, id_col, text_col))
    weights = fit(sample(base))
    kind = docs.schema[id_col].dataType.simpleString()

    def rows(source):
        for doc, raw in source:
            own, every = find_spans(raw, weights)
            count = [sum(s[0] == k for s in own) for k in KINDS]
            yield doc, *count, sha256(said(own).encode()).hexdigest(), [{"kind": k, "start": s, "end": e} for k, s, e in every]

    counts = ", ".join(f"n_{k} bigint" for k in KINDS)
    return map_rows(
        base, f"doc_id {kind}, {counts}, base_sha256 string, found array<struct<kind:string,start:bigint,end:bigint>>", rows
    )
