"""License scan by ordered signature rules. DataFrame functions only.

A text is folded to words in lower case with single spaces. Texts without any of the few gate words go no further;
in the others a rule's regex runs only where the rule's keyword stands. Detections carry their rule's priority (1 is
the strongest). One that lies within another's interval of the same or a stronger priority is suppressed; of equal
intervals the stronger, then the earlier rule stays. Besides, three base phrases are found word by word and always stay.
"""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditlake.llm.common import fold

#: Base phrases and their labels.
BASE = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]

# (label, keyword, name in running text, identifier), each as folded words; a name holds its keyword at the start of a word
_FAMILIES = [
    ("mit", "mit", "(?:mit|mit expat|mit x11)", "mit"),
    ("mit", "expat", "expat", "mit"),
    ("mit-0", "mit", "mit no attribution", "mit 0"),
    ("apache-2", "apache", "apache(?: software)?(?: license)?(?: version| v)? ?2(?: 0)?", "apache 2 0"),
    ("apache-1-1", "apache", "apache(?: software)?(?: license)?(?: version)? 1 1", "apache 1 1"),
    ("bsd-2-clause", "bsd", "(?:simplified bsd|bsd 2 clause|2 clause bsd|two clause bsd)", "bsd 2 clause"),
    ("bsd-2-clause", "freebsd", "freebsd", "bsd 2 clause"),
    ("bsd-3-clause", "bsd", "(?:new bsd|modified bsd|revised bsd|bsd 3 clause|3 clause bsd|three clause bsd)", "bsd 3 clause"),
    ("bsd-4-clause", "bsd", "(?:original bsd|bsd 4 clause|4 clause bsd)", "bsd 4 clause"),
    ("0bsd", "bsd", "(?:zero clause bsd|bsd zero clause)", "0bsd"),
    ("0bsd", "0bsd", "0bsd", "0bsd"),
    ("gpl-2", "gpl", "(?:gnu )?gpl(?: version| v)? ?2(?: 0)?", "gpl 2 0"),
    ("gpl-2", "general public", "(?:gnu )?general public license(?: version| v)? ?2(?: 0)?", "gpl 2 0"),
    ("gpl-3", "gpl", "(?:gnu )?gpl(?: version| v)? ?3(?: 0)?", "gpl 3 0"),
    ("gpl-3", "general public", "(?:gnu )?general public license(?: version| v)? ?3(?: 0)?", "gpl 3 0"),
    ("lgpl-2-1", "lgpl", "(?:gnu )?lgpl(?: version| v)? ?2 1", "lgpl 2 1"),
    ("lgpl-2-1", "lesser general", "(?:gnu )?lesser general public license(?: version| v)? ?2 1", "lgpl 2 1"),
    ("lgpl-3", "lgpl", "(?:gnu )?lgpl(?: version| v)? ?3(?: 0)?", "lgpl 3 0"),
    ("lgpl-3", "lesser general", "(?:gnu )?lesser general public license(?: version| v)? ?3(?: 0)?", "lgpl 3 0"),
    ("agpl-3", "agpl", "(?:gnu )?agpl(?: version| v)? ?3(?: 0)?", "agpl 3 0"),
    ("agpl-3", "affero", "(?:gnu )?affero general public license(?: version| v)? ?3(?: 0)?", "agpl 3 0"),
    ("gfdl-1-3", "fdl", "(?:gnu )?fdl(?: version| v)? ?1 3", "gfdl 1 3"),
    ("gfdl-1-3", "gfdl", "(?:gnu )?gfdl(?: version| v)? ?1 3", "gfdl 1 3"),
    ("mpl-1-1", "mpl", "mpl(?: version| v)? ?1 1", "mpl 1 1"),
    ("mpl-1-1", "mozilla", "mozilla public license(?: version| v)? ?1 1", "mpl 1 1"),
    ("mpl-2", "mpl", "mpl(?: version| v)? ?2(?: 0)?", "mpl 2 0"),
    ("mpl-2", "mozilla", "mozilla public license(?: version| v)? ?2(?: 0)?", "mpl 2 0"),
    ("epl-1", "epl", "epl(?: version| v)? ?1(?: 0)?", "epl 1 0"),
    ("epl-1", "eclipse", "eclipse public license(?: version| v)? ?1(?: 0)?", "epl 1 0"),
    ("epl-2", "epl", "epl(?: version| v)? ?2(?: 0)?", "epl 2 0"),
    ("epl-2", "eclipse", "eclipse public license(?: version| v)? ?2(?: 0)?", "epl 2 0"),
    ("cddl-1", "cddl", "cddl(?: version| v)? ?1(?: 0)?", "cddl 1 0"),
    ("cc-by", "cc by", "cc by(?: [1-4] [05])?", "cc by 4 0"),
    ("cc-by", "creative", "creative commons attribution(?: [1-4] [05])?", "cc by 4 0"),
    ("cc-by-sa", "cc by", "cc by sa(?: [1-4] [05])?", "cc by sa 4 0"),
    ("cc-by-sa", "creative", "creative commons attribution share ?alike(?: [1-4] [05])?", "cc by sa 4 0"),
    ("cc-by-nd", "cc by", "cc by nd(?: [1-4] [05])?", "cc by nd 4 0"),
    ("cc-by-nd", "creative", "creative commons attribution no ?deriv(?:ative)?s(?: [1-4] [05])?", "cc by nd 4 0"),
    ("cc-by-nc", "cc by", "cc by nc(?: [1-4] [05])?", "cc by nc 4 0"),
    ("cc-by-nc", "creative", "creative commons attribution non ?commercial(?: [1-4] [05])?", "cc by nc 4 0"),
    ("cc-by-nc-sa", "cc by", "cc by nc sa(?: [1-4] [05])?", "cc by nc sa 4 0"),
    ("cc-by-nc-sa", "creative", "creative commons attribution non ?commercial share ?alike(?: [1-4] [05])?", "cc by nc sa 4 0"),
    ("cc-by-nc-nd", "cc by", "cc by nc nd(?: [1-4] [05])?", "cc by nc nd 4 0"),
    ("cc-by-nc-nd", "creative", "creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: [1-4] [05])?", "cc by nc nd 4 0"),
    ("cc0", "cc0", "cc0(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("cc0", "creative", "creative commons zero(?: 1 0)?(?: universal)?", "cc0 1 0"),
    ("isc", "isc", "isc", "isc"),
    ("zlib", "zlib", "zlib(?: libpng)?", "zlib"),
    ("boost-1", "boost", "boost software(?: license)?(?: version)?(?: 1 0)?", "bsl 1 0"),
    ("unlicense", "unlicense", "unlicense", "unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("artistic-2", "artistic", "artistic(?: license)?(?: version)? 2 0", "artistic 2 0"),
    ("postgresql", "postgresql", "postgresql", "postgresql"),
    ("python-2", "psf", "psf(?: license)?(?: version)?(?: 2)?", "psf 2 0"),
    ("python-2", "python", "python software foundation(?: license)?(?: version)?(?: 2)?", "python 2 0"),
    ("openssl", "openssl", "openssl", "openssl"),
    ("eupl-1-2", "eupl", "eupl(?: version| v)? ?1 2", "eupl 1 2"),
    ("eupl-1-2", "european", "european union public licence(?: version| v)? ?1 2", "eupl 1 2"),
    ("odbl-1", "odbl", "odbl(?: version| v)?(?: 1 0)?", "odbl 1 0"),
    ("odbl-1", "database", "open database license(?: version| v)?(?: 1 0)?", "odbl 1 0"),
    ("ofl-1-1", "ofl", "(?:sil )?ofl(?: version)?(?: 1 1)?", "ofl 1 1"),
    ("ofl-1-1", "font", "(?:sil )?open font license(?: version)?(?: 1 1)?", "ofl 1 1"),
]
# priority, score, regex around a family's name {n} or identifier {i}
_FORMS = [
    (1, 0.99, "spdx license identifier {i}(?: or later| only)?"),
    (2, 0.95, "(?:licensed|released|distributed|available|published|provided|redistributed) under (?:the )?(?:terms of )?(?:the )?{n}(?: licen[sc]e)?"),
    (2, 0.9, "this (?:file|work|text|software|program|library|project|article|document) is (?:licensed |released |governed |covered )?(?:under|by) (?:the )?(?:terms of )?(?:the )?{n}(?: licen[sc]e)?"),
    (2, 0.9, "(?:subject to|in accordance with|permitted by|see) (?:the )?(?:terms of )?(?:the )?{n} licen[sc]e"),
    (3, 0.8, "licen[sc]e {n}"),
    (3, 0.7, "{n} licen[sc]e"),
]
# full-text signatures: label, keyword, regex
_TEXTS = [
    ("mit", "permission", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("isc", "permission", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("apache-2", "apache", "www apache org licenses license 2 0"),
    ("apache-2", "unless required", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "free software", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free software", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "free software", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("mpl-2", "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", "(?:released|dedicated|placed|is) (?:in|into|to) the public domain"),
    ("zlib", "altered source", "altered source versions must be plainly marked as such and must not be misrepresented"),
    ("all-rights-reserved", "all rights", "all rights reserved"),
    ("cc", "creativecommons", "creativecommons org licenses (?:by|by sa|by nd|by nc|by nc sa|by nc nd) [1-4] [05]"),
    ("proprietary", "proprietary", "(?:proprietary|confidential) and (?:proprietary|confidential)"),
    ("terms-of-use", "terms of", "(?:subject to|governed by) (?:the |our )?terms of (?:use|service)"),
]

#: (priority, score, label, keyword, regex), earlier rules first.
RULES = list(
    dict.fromkeys(
        [(1, 0.97, label, keyword, regex) for label, keyword, regex in _TEXTS]
        + [(priority, score, label, keyword if "{n}" in form else "spdx", form.format(n=name, i=ident)) for priority, score, form in _FORMS for label, keyword, name, ident in _FAMILIES]
    )
)
LEVELS = 3
#: A text with none of these goes no further: one of them stands in whatever a rule or a base phrase can match.
_SIGNS = ["licen", "spdx", "permission", "redistribution", "unencumbered", "domain", "misrepresented", "reserved", "creativecommons", "proprietary", "confidential", "terms"]
_CC = r"cc[\x00-/:-@\[-`{-\x7F]+by"


def gate(low: Column) -> Column:
    """Whether a text may hold anything; ``low``: the text in lower case, as a column of its own, for it is looked at many times."""
    any_of = lambda words: reduce(or_, [F.contains(low, F.lit(w)) for w in words])
    names = sorted({k.split(" ")[0] for _, k, _, _ in _FAMILIES})
    return any_of(_SIGNS) | ((F.contains(low, F.lit("under")) | F.contains(low, F.lit("by"))) & any_of(names)) | (F.contains(low, F.lit("cc")) & low.rlike(_CC))


def n_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z in lower case: the pieces between the other characters, but for empty ones at the ends."""
    pieces = F.split(text, r"[\x00-/:-@\[-`{-\x7F]+", -1)
    first, last = (lambda p: F.get(p, F.lit(0)) == ""), (lambda p: (F.size(p) > 1) & (F.element_at(p, -1) == ""))
    return F.get(F.transform(F.array(pieces), lambda p: F.size(p) - first(p).cast("int") - last(p).cast("int")), F.lit(0)).cast("long")


def folded(text: Column) -> Column:
    """The text's words in lower case with single spaces between."""
    return F.btrim(F.regexp_replace(fold(text), r"[\x00-/:-`{-\x7F]+", " "))


def _whole(regex: str) -> str:
    return f"(?<![^ ]){regex}(?![^ ])"


def _spans(text: Column, rule: Column) -> Column:
    """Detections of one rule: array of struct(start, minus_end, priority, rule, label, score), in characters of the folded text."""
    found = F.regexp_extract_all(text, rule["regex"], F.lit(0))
    gaps = F.split(text, rule["regex"], -1)
    kind = "struct<at:int,out:array<struct<start:int,minus_end:int,priority:int,rule:int,label:string,score:double>>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().alias("out")).cast(kind)

    def step(state, pair):
        start = state["at"] + F.char_length(pair["g"])
        end = start + F.char_length(pair["m"])
        one = F.struct(start.alias("start"), (-end).alias("minus_end"), rule["priority"].alias("priority"), rule["rule"].alias("rule"), rule["label"].alias("label"), rule["score"].alias("score"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    def placed(m: Column) -> Column:
        pairs = F.zip_with(m, F.slice(gaps, F.lit(1), F.size(m)), lambda m, g: F.struct(m.alias("m"), g.alias("g")))
        return F.when(F.size(m) > 0, F.aggregate(pairs, begin, step, lambda s: s["out"]))

    # the matches are made once; the text is cut at them only where there are any
    return F.coalesce(F.get(F.transform(F.array(found), placed), F.lit(0)), begin["out"])


def _resolved(found: Column) -> Column:
    """Detections that no interval of the same or a stronger priority holds. ``found`` in order of start, then of longest, strongest, earliest rule."""
    kind = "struct<reach:array<int>,out:array<struct<start:int,end:int,priority:int,label:string,score:double>>>"
    begin = F.struct(F.array(*[F.lit(-1)] * LEVELS).alias("reach"), F.array().alias("out")).cast(kind)

    def step(state, d):
        end = -d["minus_end"]
        held = F.exists(F.slice(state["reach"], F.lit(1), d["priority"]), lambda r: r >= end)
        reach = F.transform(state["reach"], lambda r, i: F.when(i + 1 == d["priority"], F.greatest(r, end)).otherwise(r))
        one = F.struct(d["start"].alias("start"), end.alias("end"), d["priority"].alias("priority"), d["label"].alias("label"), d["score"].alias("score"))
        return F.struct(reach.alias("reach"), F.when(held, state["out"]).otherwise(F.concat(state["out"], F.array(one))).alias("out"))

    return F.aggregate(found, begin, step, lambda s: s["out"])


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_words``, ``base`` (array of struct(word, label): where base phrases stand), ``found`` (detections left).

    A null text is empty: no words, nothing found. A null ``doc_id`` stays, repeated rows stay; an empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("low", F.lower("text"))
    rows = rows.select("doc_id", n_words(F.col("text")).alias("n_words"), F.when(gate(F.col("low")), folded(F.col("text"))).alias("norm"))
    rows = rows.withColumn("padded", F.concat(F.lit(" "), "norm"))
    norm, padded, groups = F.col("norm"), F.col("padded"), {}
    for i, (priority, score, label, keyword, regex) in enumerate(RULES):
        groups.setdefault(keyword, []).append(F.struct(F.lit(priority).alias("priority"), F.lit(score).alias("score"), F.lit(i).alias("rule"), F.lit(label).alias("label"), F.lit(_whole(regex)).alias("regex")))
    rules = F.array(*[F.struct(F.lit(" " + keyword).alias("keyword"), F.array(*own).alias("rules")) for keyword, own in groups.items()])
    none = F.array().cast("array<struct<priority:int,score:double,rule:int,label:string,regex:string>>")
    live = F.flatten(F.transform(F.filter(rules, lambda g: F.contains(padded, g["keyword"])), lambda g: g["rules"]))
    rows = rows.withColumn("live", F.when(norm.isNull(), none).otherwise(live))
    found = F.sort_array(F.flatten(F.transform("live", lambda r: _spans(norm, r))))
    return rows.select("doc_id", "n_words", _base(norm).alias("base"), _resolved(found).alias("found"))


def _places(norm: Column, phrase: str, label: str) -> Column:
    parts = phrase.split(" ")

    def starts(words: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: reduce(and_, [F.get(words, i + k) == p for k, p in enumerate(parts)]))

    # the words are bound once, as the variable of a lambda over an array of one
    spots = F.get(F.transform(F.array(F.split(norm, " ")), starts), F.lit(0))
    placed = F.transform(spots, lambda i: F.struct(i.cast("long").alias("word"), F.lit(label).alias("label")))
    return F.when(F.contains(norm, F.lit(phrase)), placed).otherwise(F.array().cast("array<struct<word:bigint,label:string>>"))


def _base(norm: Column) -> Column:
    """Places of the base phrases: array of struct(word, label), by word."""
    return F.sort_array(F.concat(*[_places(norm, phrase, label) for phrase, label in BASE]))
