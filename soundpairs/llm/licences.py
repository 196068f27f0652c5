"""Licence recognition by sentences and rules, in column expressions only.

A text is lower-cased and reduced to letters, digits and single blanks, with bounds between them. Blank lines
and ``.``, ``!`` or ``?`` with a blank end a sentence. A line feed inside a paragraph, or ``;`` or ``:`` with a
blank, may end one, and may as well lie within: a known sentence is found wrapped at any width, and on a line
of its own, but not where the word before it negates it. Comment and list marks at the start of a line don't count.
Known sentences become identifiers, all others are skipped, so a document is a short sequence of identifiers. Rules are
tried in order, longer ones first; a rule fits where its identifiers follow each other, and takes them out of the sequence.

Covered are MIT, ISC, BSD (two and three clauses), Apache-2.0, MPL-2.0, GPL, LGPL and AGPL, Zlib, Unlicense, CC0, CC BY and
CC BY-NC, by their texts, headers or notices, and lines with an SPDX identifier. Only texts with one of ``MARKS`` are cut
at all; every known sentence holds one of them. Null and empty texts have no identifiers. Repeated rows are scanned like
any others.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Sentences of well-known public licences and notices, reduced as above.
SENTENCES = {
    "mit-notice": "released under the mit license",
    "mit-notice-2": "licensed under the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and "
                 "associated documentation files the software to deal in the software without restriction including "
                 "without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
                 "copies of the software and to permit persons to whom the software is furnished to do so subject to "
                 "the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or "
                     "substantial portions of the software",
    "mit-warranty": "the software is provided as is without warranty of any kind express or implied including but not "
                    "limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-2": "licensed under the apache license version 2 0 the license",
    "apache-use": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the "
                        "gnu general public license as published by the free software foundation either version 3 of "
                        "the license or at your option any later version",
    "gpl2-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the "
                         "gnu general public license as published by the free software foundation either version 2 of "
                         "the license or at your option any later version",
    "gpl-warranty": "this program is distributed in the hope that it will be useful but without any warranty without "
                    "even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-details": "see the gnu general public license for more details",
    "cc-by-nc-notice": "licensed under cc by nc 4 0",
    "cc-by-notice": "licensed under cc by 4 0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4 0 international license",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided "
                 "that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the "
                  "following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and "
                  "the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote "
                 "products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
                 "granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license v",       # "v. 2.0" is cut
    "mpl-notice-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-copy": "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    "mpl-copy-2": "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    "lgpl21-redistribute": "this library is free software you can redistribute it and or modify it under the terms of the "
                           "gnu lesser general public license as published by the free software foundation either version "
                           "2 1 of the license or at your option any later version",
    "lgpl3-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the "
                          "gnu lesser general public license as published by the free software foundation either version 3 "
                          "of the license or at your option any later version",
    "lgpl-warranty": "this library is distributed in the hope that it will be useful but without any warranty without "
                     "even the implied warranty of merchantability or fitness for a particular purpose",
    "lgpl-details": "see the gnu lesser general public license for more details",
    "agpl-redistribute": "this program is free software you can redistribute it and or modify it under the terms of the "
                         "gnu affero general public license as published by the free software foundation either version 3 "
                         "of the license or at your option any later version",
    "agpl-details": "see the gnu affero general public license for more details",
    "zlib-warranty": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and "
                  "to alter it and redistribute it freely subject to the following restrictions",
    "unlicense-notice": "this is free and unencumbered software released into the public domain",
    "unlicense-grant": "anyone is free to copy modify publish use compile sell or distribute this software either in source "
                       "code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    "cc0-notice": "to the extent possible under law the author s have dedicated all copyright and related and neighboring "
                  "rights to this software to the public domain worldwide",
}
#: Identifiers that a line of a source file can name.
SPDX = ["MIT", "ISC", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only",
        "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only",
        "AGPL-3.0-or-later", "Zlib", "Unlicense", "CC0-1.0", "CC-BY-4.0", "CC-BY-NC-4.0"]
SENTENCES |= {f"spdx-{x.lower()}": "spdx license identifier " + re.sub("[^a-z0-9]", " ", x.lower()) for x in SPDX}
#: What a known sentence must hold one of.
MARKS = ["license", "permission", "permitted", "warranty", "redistribut", "licensed", "copyright", "distributed", "unencumbered",
         "distribute"]
#: Words after which a line can't begin a sentence.
NEGATIONS = ["not", "never", "nor", "isn t", "aren t", "wasn t", "weren t", "cannot be", "not be"]
#: (licence, identifiers in order); tried from top to bottom.
RULES = [
    ("MIT", ["mit-grant", "mit-condition", "mit-warranty"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-names"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("AGPL-3.0-or-later", ["agpl-redistribute", "gpl-warranty", "agpl-details"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute", "lgpl-warranty", "lgpl-details"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute", "gpl-warranty", "lgpl-details"]),
    ("GPL-3.0-or-later", ["gpl-redistribute", "gpl-warranty", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute", "gpl-warranty", "gpl-details"]),
    ("Apache-2.0", ["apache-notice-2", "apache-use", "apache-copy"]),
    ("Apache-2.0", ["apache-notice-2", "apache-use"]),
    ("Apache-2.0", ["apache-notice-2"]),
    ("Apache-2.0", ["apache-notice"]),
    ("MPL-2.0", ["mpl-notice", "mpl-copy-2"]),
    ("MPL-2.0", ["mpl-notice", "mpl-copy"]),
    ("Unlicense", ["unlicense-notice", "unlicense-grant"]),
    ("Zlib", ["zlib-warranty", "zlib-grant"]),
    ("AGPL-3.0-or-later", ["agpl-redistribute"]),
    ("LGPL-2.1-or-later", ["lgpl21-redistribute"]),
    ("LGPL-3.0-or-later", ["lgpl3-redistribute"]),
    ("MPL-2.0", ["mpl-notice-2"]),
    ("MPL-2.0", ["mpl-notice"]),
    ("ISC", ["isc-grant"]),
    ("Zlib", ["zlib-grant"]),
    ("Unlicense", ["unlicense-notice"]),
    ("CC0-1.0", ["cc0-notice"]),
    ("GPL-3.0-or-later", ["gpl-redistribute"]),
    ("GPL-2.0-or-later", ["gpl2-redistribute"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-notice"]),
    ("CC-BY-4.0", ["cc-by-work"]),
    ("CC-BY-4.0", ["cc-by-notice"]),
    ("MIT", ["mit-grant"]),
    ("MIT", ["mit-notice-2"]),
    ("MIT", ["mit-notice"]),
    *[(x, [f"spdx-{x.lower()}"]) for x in SPDX],
]
_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bounds that a sentence can't and can cross.
_HARD, _SOFT = "\x01", "\x02"


def small(text: Column) -> Column:
    return F.translate(text, _UPPER, _SMALL)


def _steps() -> list[tuple[str, str]]:
    """(pattern, replacement) that turn a small text into words with bounds, one after the other; ``$1`` is the first group."""
    h, b = _HARD, _SOFT
    return [
        ("([.!?])[ \\t\\r\\n]+", h),
        (f"\n[^a-z0-9\n{h}]*(?:(?:[0-9]{{1,2}}|[a-z])\\)[ \t]+)?", "\n"),        # comment and list marks
        ("[;:][ \t]+\r?\n?|\n", b),
        (f"[^a-z0-9{h}{b}]+", " "),
        (f" ?([{h}{b}]) ?", "$1"),
        (f"{b}*{h}[{h}{b}]*|{b}{{2,}}", h),
        (f"\\b({'|'.join(NEGATIONS)}){b}", "$1 "),
        (f"([{h}{b}])", "$1$1"),                   # each bound serves the sentence before it and the one behind it
    ]


def _known_pattern() -> str:
    """A known sentence between two bounds."""
    longest = sorted(SENTENCES.values(), key=len, reverse=True)
    any_of = "|".join(s.replace(" ", f"(?: |{_SOFT}{_SOFT})") for s in longest)
    return f"[{_HARD}{_SOFT}]({any_of})[{_HARD}{_SOFT}]"


def sequence(text: Column) -> Column:
    """``<id><id>...`` of the known sentences, in text order."""
    h, b = _HARD, _SOFT
    known = F.create_map(*[F.lit(x) for name, s in SENTENCES.items() for x in (s, f"<{name}>")])
    out = F.concat(F.lit(h), F.translate(small(text), h + b, "  "), F.lit(h))
    for pattern, by in _steps():
        out = F.regexp_replace(out, pattern, by)
    found = F.regexp_extract_all(out, F.lit(_known_pattern()), F.lit(1))
    return F.array_join(F.transform(found, lambda s: known[F.replace(s, F.lit(b + b), F.lit(" "))]), "")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, identifiers (``<id><id>...``), licences (in the order of the rules, joined by commas), n_rules."""
    text = F.coalesce("text", F.lit(""))
    marked = F.lit(False)
    for m in MARKS:
        marked = marked | F.contains(F.col("_low"), F.lit(m))
    out = docs.select("doc_id", text.alias("_raw"), small(text).alias("_low")).select(
        "doc_id", F.when(marked, sequence(F.col("_raw"))).otherwise("").alias("identifiers"))
    out = out.withColumn("_left", F.col("identifiers"))
    found = []
    for i, (licence, ids) in enumerate(RULES):
        rule = "".join(f"<{x}>" for x in ids)
        fits = F.contains(F.col("_left"), F.lit(rule))
        out = out.withColumn(f"_rule{i}", F.when(fits, F.lit(licence))).withColumn(
            "_left", F.replace("_left", F.lit(rule), F.lit("<>")))
        found.append(F.col(f"_rule{i}"))
    hits = F.filter(F.array(*found), lambda x: x.isNotNull())
    return out.select("doc_id", "identifiers", F.array_join(F.array_distinct(hits), ",").alias("licences"),
                      F.size(hits).alias("n_rules"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def scan_sql() -> str:
    """The same in SQL, over ``documents``."""
    marks = " or ".join(f"contains(low, {_quoted(m)})" for m in MARKS)
    known = "map {" + ", ".join(f"{_quoted(s)}: {_quoted(f'<{n}>')}" for n, s in SENTENCES.items()) + "}"
    steps, left = [], "identifiers"
    cols = []
    for i, (licence, ids) in enumerate(RULES):
        rule = _quoted("".join(f"<{x}>" for x in ids))
        steps.append(f"s{i} as (select *, case when contains(l{i}, {rule}) then {_quoted(licence)} end as r{i}, "
                     f"replace(l{i}, {rule}, '<>') as l{i + 1} from {'cut' if not i else f's{i - 1}'})")
        cols.append(f"r{i}")
    n = len(RULES) - 1
    h, b = _HARD, _SOFT
    out = f"translate(low, {_quoted(h + b)}, '  ')"
    out = f"{_quoted(h)} || {out} || {_quoted(h)}"
    for pattern, by in _steps():
        out = f"regexp_replace({out}, {_quoted(pattern)}, {_quoted(by.replace('$1', chr(92) + '1'))}, 'g')"
    return f"""
with low as (
  select doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_SMALL}') as low from documents),
found as (
  select doc_id, case when {marks} then regexp_extract_all({out}, {_quoted(_known_pattern())}, 1) else [] end as parts
  from low),
cut as (
  select doc_id, identifiers, identifiers as l0 from (
    select doc_id, coalesce(array_to_string([{known}[replace(s, {_quoted(b + b)}, ' ')] for s in parts], ''), '')
      as identifiers from found)),
{', '.join(steps)},
hits as (select doc_id, identifiers, [x for x in [{', '.join(cols)}] if x is not null] as hits from s{n}),
firsts as (select *, [x for x, i in hits if list_position(hits, x) = i] as names from hits)
select doc_id, identifiers, coalesce(array_to_string(names, ','), '') as licences, cast(len(hits) as integer) as n_rules
from firsts"""
