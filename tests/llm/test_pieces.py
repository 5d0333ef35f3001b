import random
from hashlib import sha256

import sentencepiece

from segstats.llm import pieces, queries

SF = "/root/testdata/sf0.001"
ODD = [
    "", " ", "  ", "\n", " \n ", "a\nb", "\n a", "x" * 5000, " " * 1000, "a▁b ▁", "<s></s><0x41><unk>", "\x00a\x00", "😀\n😀",
    "é̀ ｈ ﬁ", "\r\n\t", "ab  cd   ef    ", "▁▁\n▁", "\n" * 50, "supercalifragilistic" * 40,
]


def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


def test_agenda_equals_the_library_without_correction():
    path, lib, rng = pieces.default_model(), library(), random.Random(1)
    noise = ["".join(rng.choice(" ab\n▁é😀<>0x1.,\t　theing") for _ in range(rng.randint(1, 200))) for _ in range(1500)]
    for text in ODD + noise:
        ids, said, corrected = pieces.encode_texts([text], path)[0]
        assert ids == lib.encode(text) and corrected == 0
        assert said == ",".join(map(str, ids))


def test_shared_and_single_agenda_agree():
    agenda, rng = pieces.agenda(pieces.default_model()), random.Random(2)
    parts = ["▁" + "".join(rng.choice("theingaron▁é😀0.") for _ in range(n)) for n in (0, 1, 2, 5, 30, 39, 39) for _ in range(40)]
    together = agenda.merge_many(parts)
    for part, symbols in zip(parts, together):
        expected = [agenda.ids.get(s, agenda.first_unknown + ord(s[0])) for s in agenda.merge(part)]
        assert symbols == expected, part
    assert agenda.encode_parts(["▁" + "ab" * 500, " x"])[1] == library().encode("x")


def test_small_memory_changes_nothing():
    known = pieces.Memory(pieces.agenda(pieces.default_model()), size=3)
    parts = [" the", " a", " of", " thing", "\n", " the", " and", " of"] * 3
    assert [list(h) for h in known.look_up(parts)] == known.agenda.encode_parts(parts)
    assert [list(h) for h in known.look_up(parts[::-1])] == known.agenda.encode_parts(parts[::-1])
    assert not known.corrected


def test_parts_that_differ_take_the_library_and_are_counted(monkeypatch):
    known = pieces.memory(pieces.default_model())
    fresh = pieces.Memory(known.agenda)
    monkeypatch.setattr(pieces, "memory", lambda path: fresh)
    monkeypatch.setattr(pieces.Agenda, "encode_parts", lambda self, parts: [[5] for _ in parts])
    ids, _, wrong = pieces.encode_texts(["even odd odd"], pieces.default_model())[0]
    assert ids == library().encode("even odd odd") and wrong == 3


def expect(lib, text):
    ids = lib.encode(text or "")
    back = lib.decode(ids) if ids else ""
    return len(ids), sha256(",".join(map(str, ids)).encode()).hexdigest(), sha256(back.encode()).hexdigest()


def test_digests_and_round_trip(spark):
    lib = library()
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "null id"), (90, None), (1, "again"), (1, "again")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "5 AS n_tokens")
    got = sorted((r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces.token_digests(docs).collect())
    assert got == sorted((d or -1, *expect(lib, t)) for d, t in rows)
    tokens = pieces.encode(docs)
    back = sorted((r.doc_id or -1, r.text) for r in pieces.decode(tokens).collect())
    assert back == sorted((d or -1, lib.decode(lib.encode(t)) if t else "") for d, t in rows)
    assert pieces.token_digests(docs.limit(0)).count() == 0


def test_registered_query(spark):
    lib = library()
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.QUERIES["op9_sentencepiece"](spark, SF).collect()
    assert len(rows) == len(text)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expect(lib, text[r.doc_id]) and r.n_corrected == 0
