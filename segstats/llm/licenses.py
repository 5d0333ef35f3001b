"""Licence scan by ordered signature rules, in DataFrame expressions only.

A text is reduced to its words (A-Z lower-cased, ASCII punctuation dropped), joined by single spaces. A few keywords decide
whether a text is looked at; each rule has a literal of its own that must occur before its regular expression runs. Matches are
intervals with the rule's priority. Sorted by start, longest and highest priority first, an interval that lies within
an earlier one is suppressed, so that "GNU Lesser General Public License v2.1" does not also count as a plain title. Rules run
in windows around anchor words, so the work grows with a text's length and with nothing else. Nothing is shuffled.

Defined cases: a null or empty text has no words and no labels; repeated rows give repeated rows; an empty table an empty result.
Only the named columns are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from segstats.llm.common import lower_ascii, texts
from segstats.llm.quality import let

#: Phrases of the base result and their labels.
BASE = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)
NO_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

V = r"(?: (?:v|ver|version) ?| v?)"
#: label, title as a regular expression over words, literal that the title contains, SPDX name in words.
LICENCES = (
    ("agpl-3.0", rf"(?:gnu )?affero general public licen[cs]e(?:{V}3(?: 0)?)?", "affero general public", "agpl 3 0"),
    ("lgpl-2.0", rf"gnu library general public licen[cs]e(?:{V}2(?: 0)?)?", "library general public", "lgpl 2 0"),
    ("lgpl-2.1", rf"gnu lesser general public licen[cs]e{V}2 1", "lesser general public", "lgpl 2 1"),
    ("lgpl-3.0", rf"gnu lesser general public licen[cs]e{V}3(?: 0)?", "lesser general public", "lgpl 3 0"),
    ("lgpl", r"(?:gnu )?lesser general public licen[cs]e", "lesser general public", "lgpl"),
    ("gpl-1.0", rf"gnu general public licen[cs]e{V}1(?: 0)?", "general public licen", "gpl 1 0"),
    ("gpl-2.0", rf"gnu general public licen[cs]e{V}2(?: 0)?", "general public licen", "gpl 2 0"),
    ("gpl-3.0", rf"gnu general public licen[cs]e{V}3(?: 0)?", "general public licen", "gpl 3 0"),
    ("gpl", r"(?:gnu )?general public licen[cs]e", "general public licen", "gpl"),
    ("gfdl-1.2", rf"gnu free documentation licen[cs]e{V}1 2", "free documentation licen", "gfdl 1 2"),
    ("gfdl-1.3", rf"gnu free documentation licen[cs]e{V}1 3", "free documentation licen", "gfdl 1 3"),
    ("gfdl", r"(?:gnu )?free documentation licen[cs]e", "free documentation licen", "gfdl"),
    ("apache-1.0", rf"apache (?:software )?licen[cs]e{V}1 0", "apache", "apache 1 0"),
    ("apache-1.1", rf"apache (?:software )?licen[cs]e{V}1 1", "apache", "apache 1 1"),
    ("apache-2.0", rf"apache (?:software )?licen[cs]e{V}2(?: 0)?", "apache", "apache 2 0"),
    ("apache", r"apache (?:software )?licen[cs]e", "apache", "apache"),
    ("mit-0", r"mit no attribution(?: licen[cs]e)?", "mit no attribution", "mit 0"),
    ("mit", r"(?:mit|expat|x11) licen[cs]e", " licen", "mit"),
    ("mit-modern-variant", r"mit modern variant(?: licen[cs]e)?", "mit modern variant", "mit modern variant"),
    ("bsd-0-clause", r"(?:bsd )?zero clause bsd(?: licen[cs]e)?", "zero clause bsd", "0bsd"),
    ("bsd-1-clause", r"(?:bsd (?:1|one) clause|(?:1|one) clause bsd)(?: licen[cs]e)?", "clause", "bsd 1 clause"),
    ("bsd-2-clause", r"(?:bsd (?:2|two) clause|(?:2|two) clause bsd|simplified bsd)(?: licen[cs]e)?", "bsd", "bsd 2 clause"),
    ("bsd-3-clause", r"(?:bsd (?:3|three) clause|(?:3|three) clause bsd|(?:new|modified|revised) bsd)(?: licen[cs]e)?", "bsd", "bsd 3 clause"),
    ("bsd-4-clause", r"(?:bsd (?:4|four) clause|(?:4|four) clause bsd|original bsd)(?: licen[cs]e)?", "bsd", "bsd 4 clause"),
    ("bsd", r"bsd (?:style )?licen[cs]e", "bsd", "bsd"),
    ("isc", r"(?:isc|internet (?:software|systems) consortium) licen[cs]e", " licen", "isc"),
    ("mpl-1.0", rf"mozilla public licen[cs]e{V}1 0", "mozilla public licen", "mpl 1 0"),
    ("mpl-1.1", rf"mozilla public licen[cs]e{V}1 1", "mozilla public licen", "mpl 1 1"),
    ("mpl-2.0", rf"mozilla public licen[cs]e{V}2(?: 0)?", "mozilla public licen", "mpl 2 0"),
    ("mpl", r"mozilla public licen[cs]e", "mozilla public licen", "mpl"),
    ("epl-1.0", rf"eclipse public licen[cs]e{V}1(?: 0)?", "eclipse public licen", "epl 1 0"),
    ("epl-2.0", rf"eclipse public licen[cs]e{V}2(?: 0)?", "eclipse public licen", "epl 2 0"),
    ("edl-1.0", rf"eclipse distribution licen[cs]e(?:{V}1(?: 0)?)?", "eclipse distribution licen", "edl 1 0"),
    ("cpl-1.0", rf"common public licen[cs]e(?:{V}1(?: 0)?)?", "common public licen", "cpl 1 0"),
    ("cpal-1.0", rf"common public attribution licen[cs]e(?:{V}1(?: 0)?)?", "public attribution licen", "cpal 1 0"),
    ("cddl-1.0", rf"common development and distribution licen[cs]e(?:{V}1(?: 0)?)?", "development and distribution licen", "cddl 1 0"),
    ("cddl-1.1", rf"common development and distribution licen[cs]e{V}1 1", "development and distribution licen", "cddl 1 1"),
    ("eupl-1.1", rf"european union public licen[cs]e{V}1 1", "european union public", "eupl 1 1"),
    ("eupl-1.2", rf"european union public licen[cs]e{V}1 2", "european union public", "eupl 1 2"),
    ("eupl", r"european union public licen[cs]e", "european union public", "eupl"),
    ("artistic-1.0", rf"artistic licen[cs]e{V}1(?: 0)?", "artistic licen", "artistic 1 0"),
    ("artistic-2.0", rf"artistic licen[cs]e{V}2(?: 0)?", "artistic licen", "artistic 2 0"),
    ("artistic", r"artistic licen[cs]e", "artistic licen", "artistic"),
    ("bsl-1.0", rf"boost software licen[cs]e(?:{V}1(?: 0)?)?", "boost software licen", "bsl 1 0"),
    ("busl-1.1", rf"business source licen[cs]e(?:{V}1 1)?", "business source licen", "busl 1 1"),
    ("sspl-1.0", rf"server side public licen[cs]e(?:{V}1(?: 0)?)?", "server side public licen", "sspl 1 0"),
    ("elastic-2.0", rf"elastic licen[cs]e(?:{V}2(?: 0)?)?", "elastic licen", "elastic 2 0"),
    ("zlib", r"zlib(?: libpng)? licen[cs]e", "zlib", "zlib"),
    ("libpng", r"libpng licen[cs]e", "libpng", "libpng"),
    ("unlicense", r"(?:the )?unlicense", "unlicense", "unlicense"),
    ("wtfpl", r"do what the fuck you want to public licen[cs]e", "you want to public licen", "wtfpl"),
    ("cc0-1.0", r"cc0(?: 1 0)?(?: universal)?", "cc0", "cc0 1 0"),
    ("cc0-1.0", r"creative commons zero(?: 1 0)?(?: universal)?", "creative commons zero", "cc0 1 0"),
    ("cc-by-nc-nd", r"cc by nc nd(?: \d 0)?", "cc by nc nd", "cc by nc nd"),
    ("cc-by-nc-sa", r"cc by nc sa(?: \d 0)?", "cc by nc sa", "cc by nc sa"),
    ("cc-by-nc", r"cc by nc(?: \d 0)?", "cc by nc", "cc by nc"),
    ("cc-by-nd", r"cc by nd(?: \d 0)?", "cc by nd", "cc by nd"),
    ("cc-by-sa", r"cc by sa(?: \d 0)?", "cc by sa", "cc by sa"),
    ("cc-by", r"cc by(?: \d 0)?", "cc by", "cc by"),
    ("cc-by-nc-sa", r"creative commons attribution non ?commercial share ?alike(?: \d 0)?", "creative commons attribution", "cc by nc sa 4 0"),
    ("cc-by-nc", r"creative commons attribution non ?commercial(?: \d 0)?", "creative commons attribution", "cc by nc 4 0"),
    ("cc-by-sa", r"creative commons attribution share ?alike(?: \d 0)?", "creative commons attribution", "cc by sa 4 0"),
    ("cc-by-nd", r"creative commons attribution no ?deriv(?:ative)?s?(?: \d 0)?", "creative commons attribution", "cc by nd 4 0"),
    ("cc-by", r"creative commons attribution(?: \d 0)?", "creative commons attribution", "cc by 4 0"),
    ("odbl-1.0", rf"open (?:data commons open )?database licen[cs]e(?:{V}1(?: 0)?)?", "database licen", "odbl 1 0"),
    ("odc-by-1.0", r"open data commons attribution licen[cs]e", "open data commons attribution", "odc by 1 0"),
    ("pddl-1.0", r"(?:open data commons )?public domain dedication and licen[cs]e", "public domain dedication", "pddl 1 0"),
    ("ofl-1.1", rf"(?:sil )?open font licen[cs]e(?:{V}1 1)?", "open font licen", "ofl 1 1"),
    ("osl-3.0", rf"open software licen[cs]e(?:{V}3(?: 0)?)?", "open software licen", "osl 3 0"),
    ("afl-3.0", rf"academic free licen[cs]e(?:{V}3(?: 0)?)?", "academic free licen", "afl 3 0"),
    ("ecl-2.0", rf"educational community licen[cs]e(?:{V}2(?: 0)?)?", "educational community licen", "ecl 2 0"),
    ("ms-pl", r"microsoft public licen[cs]e", "microsoft public licen", "ms pl"),
    ("ms-rl", r"microsoft reciprocal licen[cs]e", "microsoft reciprocal licen", "ms rl"),
    ("ncsa", r"(?:university of illinois )?ncsa(?: open source)? licen[cs]e", "ncsa", "ncsa"),
    ("postgresql", r"postgresql licen[cs]e", "postgresql", "postgresql"),
    ("psf-2.0", rf"(?:python software foundation|psf) licen[cs]e(?:{V}2(?: 0)?)?", " licen", "psf 2 0"),
    ("php-3.01", rf"php licen[cs]e(?:{V}3(?: 01?)?)?", "php licen", "php 3 01"),
    ("openssl", r"openssl licen[cs]e", "openssl", "openssl"),
    ("vim", r"vim licen[cs]e", "vim licen", "vim"),
    ("w3c", r"w3c software (?:notice and )?licen[cs]e", "w3c software", "w3c"),
    ("upl-1.0", rf"universal permissive licen[cs]e(?:{V}1(?: 0)?)?", "universal permissive licen", "upl 1 0"),
    ("rail", r"(?:creative ml )?open ?rail(?: m)?(?: licen[cs]e)?", "rail", "openrail"),
    ("llama", r"llama ?\d? community licen[cs]e", "community licen", "llama2"),
    ("beerware", r"(?:beerware|beer ware) licen[cs]e", "ware licen", "beerware"),
    ("naumen", r"naumen public licen[cs]e", "naumen public licen", "naumen"),
    ("qpl-1.0", rf"q public licen[cs]e(?:{V}1(?: 0)?)?", "q public licen", "qpl 1 0"),
    ("sleepycat", r"sleepycat licen[cs]e", "sleepycat", "sleepycat"),
    ("watcom-1.0", r"sybase open watcom public licen[cs]e", "watcom public licen", "watcom 1 0"),
    ("ipl-1.0", rf"ibm public licen[cs]e(?:{V}1(?: 0)?)?", "ibm public licen", "ipl 1 0"),
    ("apsl-2.0", rf"apple public source licen[cs]e(?:{V}2(?: 0)?)?", "apple public source licen", "apsl 2 0"),
    ("cecill-2.1", rf"cecill(?: free software)? licen[cs]e(?: agreement)?(?:{V}2 1)?", "cecill", "cecill 2 1"),
    ("mulan-2.0", rf"mulan (?:psl|permissive software licen[cs]e)(?:{V}2)?", "mulan", "mulanpsl 2 0"),
    ("public-domain", r"(?:released|placed|dedicated|donated) (?:into|to|in) the public domain", "the public domain", "public domain"),
    ("proprietary", r"all rights reserved", "all rights reserved", "proprietary"),
)
#: Sentences of licence texts: label, pattern over words, literal that it contains.
BODIES = (
    ("mit", r"permission is hereby granted free of charge to any person obtaining a copy", "any person obtaining a copy"),
    ("bsl-1.0", r"permission is hereby granted free of charge to any person or organization obtaining a copy", "any person or organization obtaining"),
    ("bsd", r"redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source"),
    ("bsd-3-clause", r"nor the names of (?:its|the) contributors may be used to endorse or promote products", "to endorse or promote products"),
    ("apache-2.0", r"you may not use this file except in compliance with the licen[cs]e", "except in compliance with the licen"),
    ("gpl", r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e", "this program is free software"),
    ("lgpl", r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e", "this library is free software"),
    ("mpl-2.0", r"this source code form is subject to the terms of the mozilla public licen[cs]e", "this source code form is subject"),
    ("isc", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted", "with or without fee is hereby granted"),
    ("zlib", r"in no event will the authors be held liable for any damages arising from the use of this software", "in no event will the authors be held liable"),
    ("unlicense", r"this is free and unencumbered software released into the public domain", "free and unencumbered software"),
    ("epl", r"this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e", "terms of the eclipse public licen"),
)
BODY_PRIORITY, BODY_CONFIDENCE = 60, 0.9
#: Formulas that turn a title into a rule: name, pattern with the title in it, literal (null: the title's), priority, confidence.
GRANT = r"(?:licen[cs]ed|released|distributed|available|published|provided) (?:to you )?(?:under|in accordance with|according to)(?: the)?(?: terms of)?(?: the)? (?:{title})"
FORMS = (
    ("spdx", r"spdx license identifier {spdx}(?: (?:only|or later))?", "spdx license identifier", 90, 1.0),
    ("grant", GRANT, None, 70, 0.95),
    ("title", r"{title}", None, 50, 0.7),
)
#: A text with none of these has no licence rule to run.
KEYWORDS = ("licen", "cc by", "cc0", "creative commons", "the public domain", "spdx", "bsd", "openrail", "all rights reserved", "open rail", "mulan", "mit no", "mit modern", "cecill", "hereby granted", "redistribution and use", "to endorse or promote", "held liable")
#: One of these words is in every match of every rule.
ANCHORS = (
    "license", "licence", "identifier", "mit", "bsd", "zlib", "libpng", "unlicense", "cc0", "cc", "commons", "domain", "reserved", "ncsa",
    "rail", "openrail", "mulan", "cecill", "gpl", "affero", "library", "lesser", "general",
    "hereby", "redistribution", "endorse", "liable",
)
#: Words to either side of an anchor; no rule matches more than this many words.
REACH = 24


def rules() -> list[tuple[str, str, str, int, float]]:
    """``(label, pattern, literal, priority, confidence)``; longer forms have priority over the title that they contain."""
    out = []
    for label, title, literal, spdx in LICENCES:
        for _, form, own, priority, confidence in FORMS:
            pattern = form.replace("{title}", title).replace("{spdx}", spdx)
            out.append((label, f" {pattern}(?= )", own or literal, priority, confidence))
    out += [(label, f" {pattern}(?= )", literal, BODY_PRIORITY, BODY_CONFIDENCE) for label, pattern, literal in BODIES]
    return sorted(set(out), key=lambda r: (-r[3], r[0], r[1]))


def word_line(text: Column) -> Column:
    """Words of a text, joined by single spaces."""
    return F.btrim(F.regexp_replace(lower_ascii(text), NO_WORDS, " "))


def base_places(line: Column) -> Column:
    """Where base phrases stand: ``(at, label)`` with the index of the first word."""
    words = F.split(line, " ")

    def of(phrase: str, label: str) -> Column:
        first, *rest = phrase.split(" ")

        def here(w: Column, all_: Column, k: Column) -> Column:
            hit = w == first
            for step, word in enumerate(rest, 1):
                hit = hit & (F.coalesce(F.get(all_, k + step), F.lit("")) == word)
            return hit

        def places(all_: Column) -> Column:
            at = F.transform(all_, lambda w, k: F.when(here(w, all_, k), k))
            return F.transform(F.filter(at, lambda k: k.isNotNull()), lambda k: F.struct(k.cast("bigint").alias("at"), F.lit(label).alias("label")))

        nothing = F.array().cast("array<struct<at:bigint,label:string>>")
        return F.when(F.contains(line, F.lit(phrase)), let(words, places)).otherwise(nothing)

    return F.concat(*[of(p, label) for p, label in BASE])


def rule_table(own_rules: list[tuple]) -> Column:
    return F.array(*[
        F.struct(
            F.lit(label).alias("label"), F.lit(pattern).alias("pattern"), F.lit(literal).alias("literal"),
            F.lit(-priority).alias("neg_priority"), F.lit(confidence).alias("confidence"),
        )
        for label, pattern, literal, priority, confidence in own_rules
    ])


def matches(rule: Column, text: Column) -> Column:
    """``(start, neg_end, neg_priority, label, confidence)`` of one rule in a window; positions are characters.

    Matches and what stands between them, side by side, give the positions.
    """
    pairs = F.arrays_zip(
        F.regexp_extract_all(text, rule["pattern"], F.lit(0)).alias("hit"),
        F.transform(F.split(text, rule["pattern"]), lambda x: F.length(x)).alias("gap"),
    )

    def placed(zipped: Column) -> Column:
        hits = F.filter(zipped, lambda x: x["hit"].isNotNull())
        starts = F.aggregate(
            hits, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts")),
            lambda a, x: F.struct(
                (a["at"] + x["gap"] + F.length(x["hit"])).alias("at"), F.array_append(a["starts"], a["at"] + x["gap"]).alias("starts")
            ),
            lambda a: a["starts"],
        )
        return F.zip_with(
            starts, hits,
            lambda s, x: F.struct(
                s.alias("start"), (-(s + F.length(x["hit"]))).alias("neg_end"), rule["neg_priority"].alias("neg_priority"),
                rule["label"].alias("label"), rule["confidence"].alias("confidence"),
            ),
        )

    return let(pairs, placed)


def unsuppressed(sorted_matches: Column) -> Column:
    """Matches (at most a few rules at one place) that lie in no earlier one; start, end and priority order them."""
    start = F.struct(F.lit(0).alias("end"), F.slice(sorted_matches, 1, 0).alias("stays"))
    return F.aggregate(
        sorted_matches, start,
        lambda a, x: F.struct(
            F.greatest(a["end"], -x["neg_end"]).alias("end"),
            F.when(-x["neg_end"] > a["end"], F.array_append(a["stays"], x)).otherwise(a["stays"]).alias("stays"),
        ),
        lambda a: a["stays"],
    )


def detections(line: Column, table: Column) -> Column:
    """Distinct ``(start, end, label, confidence)`` by word index (end exclusive) over a whole text.

    Every rule matches at least one anchor word. Around each anchor a window wide enough for any rule is searched, and
    only matches that cover the anchor count there; whatever contains them covers it too.
    """

    def around(w: Column, k: Column) -> Column:
        low = F.greatest(k - REACH, F.lit(0))
        before = F.array_join(F.slice(w, low + 1, k - low), " ")
        anchor = F.length(before) + F.when(k > low, 2).otherwise(1)  # characters of the padded window before it
        text = F.concat(F.lit(" "), F.array_join(F.slice(w, low + 1, F.lit(2 * REACH + 1)), " "), F.lit(" "))
        return F.struct(low.alias("low"), anchor.alias("anchor"), text.alias("text"))

    def search(window: Column) -> Column:
        due = F.filter(table, lambda r: F.contains(window["text"], r["literal"]))
        found = F.filter(
            F.flatten(F.transform(due, lambda r: matches(r, window["text"]))),
            lambda m: (m["start"] < window["anchor"]) & (-m["neg_end"] > window["anchor"]),
        )
        spaces = lambda n: F.size(F.split(F.substr(window["text"], F.lit(1), n), " ")) - 1
        return F.transform(
            let(F.sort_array(found), unsuppressed),
            lambda m: F.struct(
                (window["low"] + spaces(m["start"] + 1) - 1).cast("bigint").alias("start"),
                (window["low"] + spaces(-m["neg_end"])).cast("bigint").alias("end"), m["label"].alias("label"), m["confidence"].alias("confidence"),
            ),
        )

    def run(w: Column) -> Column:
        anchors = F.filter(F.transform(w, lambda x, k: F.when(x.isin(*ANCHORS), k)), lambda k: k.isNotNull())
        return F.array_distinct(F.flatten(F.transform(anchors, lambda k: let(around(w, k), search))))

    return let(F.split(line, " "), run)


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_words, base_places, detections)``: base phrases by first word, unsuppressed rule matches by word interval."""
    lines = texts(docs, id_col, text_col).select("doc_id", word_line(F.col("text")).alias("line"))
    line = F.col("line")
    spaces = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit("")))
    hit = F.contains(line, F.lit(KEYWORDS[0]))
    for word in KEYWORDS[1:]:
        hit = hit | F.contains(line, F.lit(word))
    nothing = F.array().cast("array<struct<start:bigint,end:bigint,label:string,confidence:double>>")
    return lines.select(
        "doc_id", F.when(line == "", 0).otherwise(spaces + 1).cast("bigint").alias("n_words"),
        F.when(hit, base_places(line)).otherwise(F.array().cast("array<struct<at:bigint,label:string>>")).alias("base_places"),
        F.when(hit, detections(line, rule_table(rules()))).otherwise(nothing).alias("detections"),
    )


def summarize(found: DataFrame) -> DataFrame:
    """Counts, first and last place and label lists of ``scan_licences``."""
    at = F.transform("base_places", lambda p: p["at"])
    base = F.array_distinct(F.transform("base_places", lambda p: p["label"]))
    more = F.array_distinct(F.transform("detections", lambda d: d["label"]))
    sure = F.coalesce(F.array_max(F.transform("detections", lambda d: d["confidence"])), F.lit(0.0))
    return found.select(
        "doc_id", "n_words", F.size("base_places").cast("bigint").alias("n_base"), F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"), F.array_join(F.sort_array(base), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.array_union(base, more)), ",").alias("labels"),
        F.greatest(sure, F.when(F.size("base_places") > 0, 0.6).otherwise(0.0)).alias("score"),
        F.size("detections").cast("bigint").alias("n_detections"),
    )
