import re

from pyspark.sql import functions as F

from segstats.llm import licenses, queries

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    places = [
        (k, label) for phrase, label in licenses.BASE for k in range(len(w))
        if w[k:k + len(phrase.split())] == phrase.split()
    ]
    at = [k for k, _ in places]
    return len(w), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places}))


def brute_labels(text):
    """Every rule over the whole text, then plain containment."""
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    line = f" {' '.join(WORD.findall(lower))} "
    spans = sorted(
        (m.start(), -m.end(), -priority, label)
        for label, pattern, literal, priority, _ in licenses.rules() if literal in line
        for m in re.finditer(pattern, line)
    )
    end, out = 0, set()
    for s, e, _, label in spans:
        if -e > end:
            out.add(label)
        end = max(end, -e)
    return out


TEXTS = [
    "Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "mit ein Wort", "", None, " \n",
    "This work is licensed under the GNU General Public License, version 3.", "Licensed under CC BY-NC 4.0.", "GNU\nLesser General-Public License v2.1",
    "SPDX-License-Identifier: GPL-2.0-or-later\nall rights reserved", "MIT license MIT License mit licenses", "cc by cc by, CC BY é cc by",
    "released under the terms of the Mozilla Public License Version 2.0 and the BSD 3-Clause License", "In the public domain we trust",
    "dedicated to the public domain. CC0 1.0 Universal", "x " * 50_000 + "Apache License 2.0 " * 300, "gnu general public", "licencié ☃ mit license",
    "Creative Commons Attribution-ShareAlike 4.0 and Attribution", "Boost Software License 1.0; Unlicense; zlib license; ISC License",
]


def test_base_and_method_match_brute_force(spark):
    docs = [(k, t) for k, t in enumerate(TEXTS)] + [(None, TEXTS[0]), (1, TEXTS[1])]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("line", F.lit("x")).withColumn("labels", F.lit(1))
    rows = licenses.summarize(licenses.scan_licences(df)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=repr)
    assert got == sorted(((d, *brute(t)) for d, t in docs), key=repr)
    text = dict(docs)
    for r in rows:
        expected = set(filter(None, brute(text[r.doc_id])[-1].split(","))) | brute_labels(text[r.doc_id])
        assert set(filter(None, r.labels.split(","))) == expected, text[r.doc_id]
        assert 0 <= r.score <= 1 and (r.score > 0) == bool(expected)
    label = {r.doc_id: r.labels for r in rows}
    assert label[0] == "apache,apache-2.0" and label[7] == "cc-by,cc-by-nc" and label[8] == "lgpl-2.1" and label[13] == ""
    assert licenses.scan_licences(df.limit(0)).count() == 0


def test_spans_are_word_intervals(spark):
    text = "One two. Licensed under the Apache License, Version 2.0. End; mit license"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    found = licenses.scan_licences(df).first().detections
    words = WORD.findall(text.lower())
    assert [(" ".join(words[d.start:d.end]), d.label) for d in found] == [
        ("licensed under the apache license version 2 0", "apache-2.0"), ("mit license", "mit"),
    ]


def test_there_are_hundreds_of_rules_and_each_has_an_anchor():
    own = licenses.rules()
    assert len(own) > 200
    for label, pattern, literal, *_ in own:
        re.compile(pattern)
    for label, title, literal, spdx in licenses.LICENCES:
        assert any(a in title.replace("[cs]", "s") for a in licenses.ANCHORS), label


def test_registered_query_matches_brute_force_and_is_native(spark):
    text = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    df = queries.QUERIES["op2_licenses"](spark, SF)
    rows = df.collect()
    assert len(rows) == len(text)
    for r in rows:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(text[r.doc_id])
    assert any(r.n_base for r in rows)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def alternatives(parsed):
    """Every string that a title's regular expression matches, with one digit for any."""
    out = [""]
    for op, value in parsed:
        kind = str(op)
        if kind == "LITERAL":
            more = [chr(value)]
        elif kind == "SUBPATTERN":
            more = alternatives(value[-1])
        elif kind == "BRANCH":
            more = [x for part in value[1] for x in alternatives(part)]
        elif kind == "MAX_REPEAT":
            assert value[:2] == (0, 1)
            more = ["", *alternatives(value[2])]
        elif kind == "IN":
            more = ["4" if str(o) == "CATEGORY" else chr(v) for o, v in value]
        else:
            raise AssertionError(kind)
        out = [x + y for x in out for y in more]
    return set(out)


def test_every_alternative_of_a_title_has_its_literal_a_keyword_and_an_anchor():
    assert alternatives(re._parser.parse(r"a(?:b|c d)?[ef]\d")) == {"ae4", "af4", "abe4", "abf4", "ac de4", "ac df4"}
    for label, title, literal in [r[:3] for r in licenses.LICENCES] + list(licenses.BODIES):
        for name in alternatives(re._parser.parse(title)):
            assert literal in f" {name} ", (label, name)
            assert any(k in name for k in licenses.KEYWORDS), (label, name)
            assert set(name.split()) & set(licenses.ANCHORS), (label, name)


def test_creative_commons_zero_by_its_long_name(spark):
    docs = [(1, "licensed under Creative Commons Zero 1.0 Universal"), (2, "Creative Commons Zero"), (3, "Creative Commons Zero (CC0) 1.0"), (4, "creative commons zeroes")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.labels, r.score) for r in licenses.summarize(licenses.scan_licences(df)).collect()}
    assert got == {1: ("cc0-1.0", 0.95), 2: ("cc0-1.0", 0.7), 3: ("cc0-1.0", 0.7), 4: ("", 0.0)}


def test_sentences_of_licences_public_domain_and_both_spellings(spark):
    docs = [
        (1, "Permission is hereby granted, free of charge, to any person obtaining a copy of this"), (2, "Redistribution and use in source and binary forms, with or without modification, are permitted"),
        (3, "Neither the name of X nor the names of its contributors may be used to endorse or promote products"), (4, "you may not use this file except in compliance with the License."),
        (5, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"), (6, "in no event will the authors be held liable for any damages arising from the use of this software"),
        (7, "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"), (8, "this is free and unencumbered software released into the public domain"),
        (9, "dedicated to the public domain"), (10, "placed in the public domain"), (11, "donated into the public domain"), (12, "the MIT Licence"), (13, "Apache Licence version 2.0"),
        (14, "permission is hereby granted to redistribute"), (15, "held liable"), (16, "this source code form is subject to the terms of the Mozilla Public License"),
    ]
    expected = {1: "mit", 2: "bsd", 3: "bsd-3-clause", 4: "apache-2.0", 5: "gpl", 6: "zlib", 7: "isc", 8: "unlicense", 9: "public-domain", 10: "public-domain",
                11: "public-domain", 12: "mit", 13: "apache-2.0", 14: "", 15: "", 16: "mpl-2.0"}
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id: r.labels for r in licenses.summarize(licenses.scan_licences(df)).collect()} == expected
