"""Licence scans by sentence rules, with DataFrame functions only.

Texts are cut into sentences and normalised; sentences that are known licence sentences are replaced by their
identifiers, references to licences by the licences they name, and any other sentence by a mark of its own; the sequence
is matched against ordered rules, the longest first, each of which takes its identifiers out of the sequence. Everything happens within a row, so nothing is shuffled: a pattern
tells texts that can have a licence sentence at all, and a set intersection those that have one.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Identifiers of the SPDX list that an expression may name as they are.
SPDX = (
    "0BSD AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-NC-ND-4.0"
    " CC-BY-NC-SA-4.0 CC-BY-ND-4.0 CC-BY-SA-3.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0-only"
    " GPL-3.0-or-later ISC LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib"
).split()
# Full names, normalised, and the licence meant. These count without words before them as well.
FULL_NAMES = {
    "apache license version 2 0": "Apache-2.0",
    "apache license 2 0": "Apache-2.0",
    "apache 2 0 license": "Apache-2.0",
    "mit license": "MIT",
    "expat license": "MIT",
    "isc license": "ISC",
    "zlib license": "Zlib",
    "bsd 2 clause license": "BSD-2-Clause",
    "simplified bsd license": "BSD-2-Clause",
    "bsd 3 clause license": "BSD-3-Clause",
    "new bsd license": "BSD-3-Clause",
    "gnu general public license": "GPL",
    "mozilla public license version 2 0": "MPL-2.0",
    "mozilla public license 2 0": "MPL-2.0",
    "mozilla public license v 2 0": "MPL-2.0",
    "eclipse public license version 2 0": "EPL-2.0",
    "eclipse public license 2 0": "EPL-2.0",
    "eclipse public license v 2 0": "EPL-2.0",
    "boost software license version 1 0": "BSL-1.0",
    "cc by 4 0": "CC-BY-4.0",
    "cc by sa 4 0": "CC-BY-SA-4.0",
    "cc by nc 4 0": "CC-BY-NC-4.0",
    "cc by nd 4 0": "CC-BY-ND-4.0",
    "cc by nc sa 4 0": "CC-BY-NC-SA-4.0",
    "cc by nc nd 4 0": "CC-BY-NC-ND-4.0",
    "cc by sa 3 0": "CC-BY-SA-3.0",
    "cc0 1 0": "CC0-1.0",
    "creative commons attribution 4 0 international license": "CC-BY-4.0",
    "creative commons attribution sharealike 4 0 international license": "CC-BY-SA-4.0",
    "creative commons attribution noncommercial 4 0 international license": "CC-BY-NC-4.0",
}
# The GNU licences: name, short name, versions.
GNU = (("gnu general public license", "GPL", ("2", "3")), ("gnu lesser general public license", "LGPL", ("2 1", "3")),
       ("gnu affero general public license", "AGPL", ("3",)))
LATER = ("or later", "or any later version", "or at your option any later version")


def _normal(name: str) -> str:
    return re.sub("[^a-z0-9]+", " ", name.lower()).strip()


def _gnu_id(short: str, version: str, later: bool) -> str:
    number = version.replace(" ", ".") if " " in version else f"{version}.0"
    return f"{short}-{number}-{'or-later' if later else 'only'}"


def full_names() -> dict[str, str]:
    """Full names with those of the GNU licences in each version."""
    names = dict(FULL_NAMES)
    for name, short, versions in GNU:
        for v in versions:
            for number in (v, f"{v} 0") if " " not in v else (v,):
                for mark in ("version ", "v", "v "):
                    base = f"{name} {mark}{number}"
                    names |= {base: _gnu_id(short, v, False)} | {f"{base} {x}": _gnu_id(short, v, True) for x in LATER}
    return names


def all_names() -> dict[str, str]:
    """Full names, identifiers and the usual short forms of the GNU licences."""
    names = {_normal(x): x for x in SPDX} | {"apache 2": "Apache-2.0", "apache2": "Apache-2.0", "bsd 3": "BSD-3-Clause", "bsd 2": "BSD-2-Clause"}
    for _, short, versions in GNU:
        for v in versions:
            low = short.lower()
            for form in (f"{low} {v}", f"{low}{v}", f"{low}v{v}", f"{low} v{v}", f"{low} version {v}", f"{low} {v} 0", f"{low}v{v} 0"):
                names |= {form: _gnu_id(short, v, False)} | {f"{form} {x}": _gnu_id(short, v, True) for x in LATER}
    return names | full_names()


# Sentences of licence texts, normalised, and their identifiers.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
    " documentation files the software to deal in the software without restriction including without limitation the"
    " rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit"
    " persons to whom the software is furnished to do so subject to the following conditions": "MITperm",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of"
    " the software": "MITnotice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the"
    " warranties of merchantability fitness for a particular purpose and noninfringement": "MITasis",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the"
    " following conditions are met": "BSDpre",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following"
    " disclaimer": "BSDsource",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following"
    " disclaimer in the documentation and or other materials provided with the distribution": "BSDbinary",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"
    " provided that the above copyright notice and this permission notice appear in all copies": "ISCperm",
    "licensed under the apache license version 2 0 the license": "ApacheRef",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "http www apache org licenses license 2 0": "ApacheUrl",
    "https www apache org licenses license 2 0": "ApacheUrl",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "ApacheCopy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on"
    " an as is basis without warranties or conditions of any kind either express or implied": "ApacheAsis",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied"
    " warranty of merchantability or fitness for a particular purpose": "GPLnoWarranty",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied"
    " warranty of merchantability or fitness for a particular purpose": "GPLnoWarranty",
    "this program is free software": "FreeSoftware",
    "this library is free software": "FreeSoftware",
    "this file is free software": "FreeSoftware",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "MPL2Ref",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which"
    " is available at https www eclipse org legal epl 2 0": "EPL2Ref",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it"
    " and redistribute it freely subject to the following restrictions": "ZlibPerm",
    "this software is provided as is without any express or implied warranty": "ZlibAsis",
    "in no event will the authors be held liable for any damages arising from the use of this software": "ZlibLiable",
    "this is free and unencumbered software released into the public domain": "Unlicense",
    "all rights reserved": "AllRights",
}
# Sentences that name a holder; the first pattern that fits gives the identifier. The mark "+" is for the
# beginning of a sentence that an abbreviated name cuts in two: it neither counts nor parts its neighbours.
PATTERNS = (
    (r"(?:^|^neither the names? .* )nor the names of (?:its|their|any) contributors may be used to endorse or promote products"
     r" derived from this software without (?:specific )?prior written permission$", "BSDendorse"),
    (r"as is and any express or implied warranties including but not limited to the implied warranties of merchantability"
     r" and fitness for a particular purpose are disclaimed$", "BSDasis"),
    (r"^neither the names? of .*$", "+"),
    (r"^(?:[0-9]{1,2}|[a-z]|[ivx]{2,4})$", "+"),  # marks of a list
    (r"^this software is provided by (?:the )?(?:copyright holders?|authors?|[a-z0-9 ]{1,60})$", "+"),
)

# Which sequences of identifiers mean which licence, the longest first; `+` joins identifiers.
FIRST_RULES = (
    ("BSDpre+BSDsource+BSDbinary+BSDendorse+BSDasis", "BSD-3-Clause"),
    ("BSDpre+BSDsource+BSDbinary+BSDendorse", "BSD-3-Clause"),
    ("BSDpre+BSDsource+BSDbinary+BSDasis", "BSD-2-Clause"),
    ("ApacheRef+ApacheUse+ApacheCopy+ApacheUrl+ApacheAsis", "Apache-2.0"),
    ("ApacheRef+ApacheUse+ApacheCopy+ApacheAsis", "Apache-2.0"),
    ("MITperm+MITnotice+MITasis", "MIT"),
    ("ZlibAsis+ZlibLiable+ZlibPerm", "Zlib"),
)
LAST_RULES = (
    ("ISCperm+MITasis", "ISC"),
    ("ISCperm", "ISC"),
    ("ApacheRef", "Apache-2.0"),
    ("MPL2Ref", "MPL-2.0"),
    ("EPL2Ref", "EPL-2.0"),
    ("Unlicense", "Unlicense"),
)


def _gnu_texts() -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Sentences and rules of the GNU notices: terms and version in one sentence, or in two."""
    texts, rules = {}, []
    grant = "you can redistribute it and or modify it under the terms of the {} as published by the free software foundation"
    for name, short, versions in GNU:
        texts[grant.format(name)] = f"{short}terms"
        for v in versions:
            for later in (True, False):
                end = f"either version {v} of the license or at your option any later version" if later else f"version {v} of the license"
                mark = f"V{v.replace(' ', '.')}{'later' if later else ''}"
                texts[end] = mark
                texts[f"{grant.format(name)} {end}"] = f"{short}{mark}"
                rules += [(f"{short}{mark}", _gnu_id(short, v, later)), (f"{short}terms+{mark}", _gnu_id(short, v, later))]
    return texts, rules


RULES = (*FIRST_RULES, *_gnu_texts()[1], *LAST_RULES)
LICENCE_WORD = (
    r"(?i)licen[sc]|copyright|permission|redistribut|provided|rights\s+reserved|free\s+software|you\s+may|cc0|cc[\s_-]+by"
    r"|unless\s+required|distributed|(?:released|published|available)\s+under|neither\s+the\s+name"
)
UNKNOWN = r"\blicen[sc]ed? under\b|\blicense\b|all rights reserved|\bcopyright\b"
# A colon after these words ends no sentence: what follows is the licence.
LABEL = r"(?i)(licen[sc]e(?:-identifier)?)[\"']?\s*:[ \t\"']*"

# How sentences refer to licences: who is licensed how, names joined by and or or, where to read on.
_HOW = (
    r"(?:(?:this|the|all) [a-z]+(?: [a-z]+)? (?:is|are) )?(?:also )?(?:dual |multi )?(?:licen[sc]ed|released|distributed|available|published|provided"
    r"|made available) (?:under|with)(?: either)?(?: of)?(?: the)?(?: terms(?: and conditions)? of)?(?: the| a| an)?"
)
_JOIN = r"(?: or| and| and or)(?: at your option)?(?: under)?(?: the)?(?: terms of the)?"
_MORE = r"(?: at your option)?(?: the license)?(?: see (?:the )?(?:licen[sc]e|copying)(?: file)?(?: for (?:more )?(?:details|information))?(?: txt| md)?)?"


def _either(names: Iterable[str]) -> str:
    return "(?:" + "|".join(sorted(names, key=lambda n: (-len(n), n))) + ")"


NAME = rf"\b{_either(all_names())}\b"
_ONE = rf"{_either(all_names())}(?: licen[sc]e)?"
REFERENCE = (
    rf"^(?:(?:{_HOW}|spdx licen[sc]e identifier|licen[sc]e(?: identifier)?) {_ONE}(?:{_JOIN} {_ONE}){{0,4}}{_MORE}"
    rf"|(?:the |a )?{_either(full_names())})$"
)


def sentence_table() -> dict[str, str]:
    """Normalised sentence → identifier, for sentences that are always the same."""
    return TEXTS | _gnu_texts()[0]


def without_comment_signs(text: Column) -> Column:
    bare = F.regexp_replace(text, r"(?m)^[ \t]*(?://+|/\*+|\*+/|\*+|#+|;+|--+|<!--|%+|>+|\d+\.|-)[ \t]+", "")
    return F.regexp_replace(bare, LABEL, "$1 ")


def joined_lines(text: Column) -> Column:
    """The text with the lines of each paragraph on one line."""
    return F.regexp_replace(text, r"[ \t]*\r?\n(?!\s*\n)[ \t]*", " ")


def sentences(text: Column) -> Column:
    """Normalised sentences: they end at a line break, or at . ! ? ; or : before white space.

    What is left of a sentence are its lower-case letters and digits, with single spaces.
    """
    cut = F.split(text, r"(?<=[.!?;:])[\"')\]]*\s+|\n")
    return F.transform(cut, lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}]+", " ")))


def _licences(ids: Column) -> Column:
    """Licences of a sequence of identifiers: each rule in turn takes out what it matches; references stand alone.

    Identifiers of a rule are next to each other: an unknown sentence between them, or what an earlier rule has taken
    out there, keeps a rule from matching.
    """
    rules = F.array(*[F.struct(F.lit(",".join(s.split("+"))).alias("ids"), F.lit(x).alias("licence")) for s, x in RULES])
    start = F.struct(F.concat(F.lit(","), F.array_join(ids, ","), F.lit(",")).alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(acc: Column, rule: Column) -> Column:
        meant = F.concat(F.lit(","), rule["ids"], F.lit(","))
        hit = acc["rest"].contains(meant)
        return F.struct(
            F.when(hit, F.replace(acc["rest"], meant, F.lit(",?,"))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit, F.array_append(acc["found"], rule["licence"])).otherwise(acc["found"]).alias("found"),
        )

    done = F.aggregate(rules, start, step, lambda acc: acc["found"])
    named = F.transform(F.filter(ids, lambda i: i.startswith("ref:")), lambda i: F.substr(i, F.lit(5)))
    return F.concat(done, named)


def license_scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """doc_id, licenses (distinct, sorted), sentence_ids (in text order) and n_unknown, one row per document.

    n_unknown counts sentences that speak of a licence or of reserved rights but are not known. Null and empty
    texts, and texts without a licence sentence, have empty lists. Ids may be null or repeat; only the named
    columns are read; whole texts are scanned.
    """
    table, names = sentence_table(), all_names()
    known, ids = list(table), F.map_from_arrays(F.lit(list(table)), F.lit(list(table.values())))
    licences = F.map_from_arrays(F.lit(list(names)), F.lit([f"ref:{x}" for x in names.values()]))
    none = F.array().cast("array<string>")
    text = F.col(text_column).cast("string")
    plain = docs.select(F.col(id_column).alias("doc_id"), F.when(text.rlike(LICENCE_WORD), without_comment_signs(text)).alias("plain"))
    # Sentences are looked for twice: within lines, and in paragraphs whose lines are joined.
    cut = plain.select(
        "doc_id", F.coalesce(sentences(F.col("plain")), none).alias("lines"),
        F.coalesce(sentences(joined_lines(F.col("plain"))), none).alias("joined"),
    )
    lists = cut.select("doc_id", "lines", "joined", F.array_intersect(F.concat("lines", "joined"), F.lit(known)).alias("hits"))

    def marks(s: Column) -> Column:
        """The identifiers of a sentence; `?` for one that is not known."""
        found = F.when(F.array_contains("hits", s), F.array(F.element_at(ids, s))).when(s == "", none)
        found = found.when(s.rlike(REFERENCE), F.transform(F.regexp_extract_all(s, F.lit(NAME), F.lit(0)), lambda n: F.element_at(licences, n)))
        for pattern, mark in PATTERNS:
            found = found.when(s.rlike(pattern), F.array(F.lit(mark)) if mark != "+" else none)
        return found.otherwise(F.array(F.lit("?")))

    marked = lists.select(
        "doc_id", *[F.flatten(F.transform(c, marks)).alias(c) for c in ("lines", "joined")],
        F.size(F.filter("lines", lambda s: s.rlike(UNKNOWN) & (F.array_contains(marks(s), "?")))).cast("long").alias("n_unknown"),
    )

    def told(c: str) -> Column:
        return F.filter(c, lambda i: i != "?")

    return marked.select(
        "doc_id", F.array_sort(F.array_distinct(F.concat(_licences(F.col("lines")), _licences(F.col("joined"))))).alias("licenses"),
        F.when(F.size(told("joined")) > F.size(told("lines")), told("joined")).otherwise(told("lines")).alias("sentence_ids"), "n_unknown",
    )
