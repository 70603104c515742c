"""License scans by sentence rules, in DataFrame operations only.

A text is normalised to lower-case words with one sign between two of them: `|` where a sentence mark before white
space or an empty line parts them, `/` where a line ends, else a space; comment marks and other signs vanish. A known
licence sentence starts a line or follows a `|`, ends at a line's end or at a `|`, and may be wrapped over lines. So a
text becomes the sequence of the identifiers of its known sentences, in order; of two that start at one place the
longer one counts. Ordered rules, each a sequence of identifiers, are then matched against that sequence from the
most specific to the least; what a rule matches is consumed, so a general rule can't claim it again.

Scale: everything happens in the row that holds the text, so nothing is shuffled. Each pattern takes time in
proportion to the text, whatever it holds. The tables of sentences and rules are parameters that grow with the number
of licences, not with the data; they stand in the plan as literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, table

_GPL = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation either version {} of the license or at your option any later version"
_GPL_ONLY = "you can redistribute it and or modify it under the terms of the gnu {} as published by the free software foundation version {}"
_WARRANTY = "the software is provided as is without warranty of any kind express or implied"
_CC = "this work is licensed under a creative commons {} 4 0 international license"
#: normalised sentence: identifier (fixed values: the wording of public licences and their usual notices)
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-notice",
    "licensed under the apache license version 2 0 the license": "apache2-notice",
    "you may not use this file except in compliance with the license": "apache2-comply",
    "you may obtain a copy of the license at": "apache2-copy",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-include",
    _WARRANTY: "mit-warranty",
    _WARRANTY + " including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "bsd0-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this work is licensed under the gnu general public license version 3": "gpl3-notice",
    "this work is licensed under the gnu general public license version 2": "gpl2-notice",
    "you should have received a copy of the gnu general public license along with this program": "gpl-copy",
    "you should have received a copy of the gnu lesser general public license along with this library": "lgpl-copy",
    "you should have received a copy of the gnu lesser general public license along with this program": "lgpl-copy",
    "you should have received a copy of the gnu affero general public license along with this program": "agpl-copy",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "this library is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    **{form.format(name, version): i for form in (_GPL, _GPL_ONLY) for name, version, i in (
        ("general public license", "3", "gpl3-notice"), ("general public license", "2", "gpl2-notice"), ("lesser general public license", "3", "lgpl3-notice"),
        ("lesser general public license", "2 1", "lgpl21-notice"), ("affero general public license", "3", "agpl3-notice"))},
    "licensed under cc by 4 0": "ccby-notice",
    "licensed under cc by sa 4 0": "ccbysa-notice",
    "licensed under cc by nc 4 0": "ccbync-notice",
    "licensed under cc by nd 4 0": "ccbynd-notice",
    "licensed under cc by nc sa 4 0": "ccbyncsa-notice",
    "licensed under cc by nc nd 4 0": "ccbyncnd-notice",
    **{_CC.format(name): i for name, i in (("attribution", "ccby-notice"), ("attribution sharealike", "ccbysa-notice"), ("attribution noncommercial", "ccbync-notice"),
        ("attribution noderivatives", "ccbynd-notice"), ("attribution noncommercial sharealike", "ccbyncsa-notice"), ("attribution noncommercial noderivatives", "ccbyncnd-notice"))},
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-name",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advertising",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-notice",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-notice",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl1-grant",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "zlib-origin",
    "the origin of this software must not be misrepresented": "zlib-origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "this notice may not be removed or altered from any source distribution": "zlib-notice",
    "this is free and unencumbered software released into the public domain": "unlicense-domain",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-free",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waived",
    "do what the fuck you want to public license": "wtfpl-title",
    "all rights reserved": "reserved",
}
#: and the notices of a licence with what they speak of
SENTENCES |= {
    f"this {what} is {said}": i
    for said, i in list(SENTENCES.items()) if said.startswith(("licensed under", "released under"))
    for what in ("file", "program", "software", "work", "project", "code", "library")
}
#: SPDX licence name: identifier
SPDX = {
    name: f"spdx-{name}"
    for name in (
        "0BSD", "AGPL-3.0", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0",
        "CC-BY-ND-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0", "GPL-2.0", "GPL-3.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0", "Unlicense", "WTFPL", "Zlib",
    )
}
#: (licence, its sequence of identifiers), the most specific first
RULES = (
    ("Apache-2.0", ("apache2-notice", "apache2-comply", "apache2-copy", "apache2-warranty")),
    ("Apache-2.0", ("apache2-notice", "apache2-comply", "apache2-copy")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advertising", "bsd-name")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name")),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("MIT", ("mit-grant", "mit-include", "mit-warranty")),
    ("MIT", ("mit-include", "mit-warranty")),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("0BSD", ("bsd0-grant", "isc-warranty")),
    ("LGPL-3.0", ("lgpl3-notice", "gpl-warranty", "lgpl-copy")),
    ("LGPL-2.1", ("lgpl21-notice", "gpl-warranty", "lgpl-copy")),
    ("AGPL-3.0", ("agpl3-notice", "gpl-warranty", "agpl-copy")),
    ("GPL-3.0", ("gpl3-notice", "gpl-warranty", "gpl-copy")),
    ("GPL-2.0", ("gpl2-notice", "gpl-warranty", "gpl-copy")),
    ("Zlib", ("zlib-warranty", "zlib-origin", "zlib-altered", "zlib-notice")),
    ("Unlicense", ("unlicense-domain", "unlicense-free")),
    ("Apache-2.0", ("apache2-notice",)),
    ("MIT", ("mit-notice",)),
    ("MIT", ("mit-grant",)),
    ("ISC", ("isc-grant",)),
    ("LGPL-3.0", ("lgpl3-notice",)),
    ("LGPL-2.1", ("lgpl21-notice",)),
    ("AGPL-3.0", ("agpl3-notice",)),
    ("GPL-3.0", ("gpl3-notice",)),
    ("GPL-2.0", ("gpl2-notice",)),
    ("CC-BY-4.0", ("ccby-notice",)),
    ("CC-BY-SA-4.0", ("ccbysa-notice",)),
    ("CC-BY-NC-4.0", ("ccbync-notice",)),
    ("CC-BY-ND-4.0", ("ccbynd-notice",)),
    ("CC-BY-NC-SA-4.0", ("ccbyncsa-notice",)),
    ("CC-BY-NC-ND-4.0", ("ccbyncnd-notice",)),
    ("MPL-2.0", ("mpl2-notice",)),
    ("EPL-2.0", ("epl2-notice",)),
    ("BSL-1.0", ("bsl1-grant",)),
    ("Unlicense", ("unlicense-domain",)),
    ("CC0-1.0", ("cc0-waived",)),
    ("WTFPL", ("wtfpl-title",)),
    ("proprietary", ("reserved",)),
    *((name, (i,)) for name, i in SPDX.items()),
)
_SPACE = r"\x20\x09-\x0D"
#: (regex, replacement) that normalise a text, in this order. A run is only entered at its first sign and never given
#: back, and no group is repeated, so each takes time in proportion to the text. U+0001 stands for `|` on the way.
STEPS = (
    (r"\x01", " "),
    (rf"(?<![.!?;:])[.!?;:]++(?=[{_SPACE}]|\z)", "\x01"),
    (r"\n[^A-Za-z0-9]*\n", "\x01"),
    (r"[^A-Za-z0-9\x01\n]++", " "),
    (r"[ \n]*+\x01[ \n\x01]*+", "|"),
    (r" ?\n ?", "/"),
)
_SPDX_HEAD = "spdx license identifier[| ]"
#: What follows a licence name without changing the licence, and what joins two names
SPDX_SUFFIX, SPDX_JOIN = " (only|or later)( |$)", " (?:or|and|with) "


def _plain(name: str) -> str:
    return "".join(c if c.isalnum() else " " for c in name.lower())


def normalised(text: Column) -> Column:
    """Lower-case words, each followed by a space, `/` or `|`."""
    for regex, new in STEPS:
        text = F.regexp_replace(text, regex, new)
    return ascii_lower(F.trim(text))


def _pattern(rule: tuple[str, ...]) -> str:
    return "".join(f"<{i}>" for i in rule)


def matched(sequence: Column, rules: tuple[tuple[str, tuple[str, ...]], ...]) -> Column:
    """array<string>: the licences of the rules that match the sequence (`<id><id>...`), in the order of the rules."""
    # `#` stands for what is consumed, so that its neighbours don't become one sequence
    step = lambda acc, r: F.when(
        F.contains(acc["left"], r["seq"]),
        F.struct(F.replace(acc["left"], r["seq"], F.lit("#")).alias("left"), F.array_union(acc["found"], F.array(r["name"])).alias("found")),
    ).otherwise(acc)
    table_of = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(_pattern(s)).alias("seq")) for n, s in rules))
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(table_of, start, step, lambda acc: acc["found"])


def _sentence_regex(sentences: dict[str, str]) -> str:
    """All known sentences, those that begin with the same words under one branch; the longest way first."""
    end = "(?![a-z0-9 ])"

    def branch(tails: list[tuple[str, ...]]) -> str:
        heads: dict[str, list[tuple[str, ...]]] = {}
        for tail in tails:
            heads.setdefault(tail[0], []).append(tail[1:])
        return "|".join(word + after(rest) for word, rest in heads.items())

    def after(rest: list[tuple[str, ...]]) -> str:
        longer = [t for t in rest if t]
        go_on = f"[ /](?:{branch(longer)})" if longer else ""
        return go_on if () not in rest else f"(?:{go_on}|{end})" if go_on else end

    return f"(?<![a-z0-9 ])(?:{branch([tuple(k.split()) for k in sentences])})"


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, sentences: dict[str, str] = SENTENCES, rules: tuple = RULES) -> DataFrame:
    """(doc_id, sentence_ids, licenses): arrays of the licence sentences in a text's order, and of its licences.

    An SPDX line gives an identifier for each licence that it names. Null and empty texts have none; a text of any
    length is read to its end. Rows are judged one by one, so null and repeated ids keep their rows and equal rows get
    equal results. An empty table gives an empty result; df's other columns are ignored.
    """
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), normalised(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("_text"))
    ids = F.create_map(*(F.lit(x) for pair in sentences.items() for x in pair))
    spdx = F.create_map(*(F.lit(x) for name, i in SPDX.items() for x in (_plain(name), i)))
    found = F.regexp_extract_all("_text", F.lit(f"(?<![a-z0-9]){_SPDX_HEAD}[a-z0-9 ]++|{_sentence_regex(sentences)}"), F.lit(0))

    def of(m: Column) -> Column:
        names = F.split(F.regexp_replace(F.regexp_replace(m, "^" + _SPDX_HEAD, ""), SPDX_SUFFIX, "$2"), SPDX_JOIN, -1)
        named = F.filter(F.transform(names, lambda n: F.element_at(spdx, F.trim(n))), lambda i: i.isNotNull())
        return F.when(m.startswith("spdx license identifier"), named).otherwise(F.array(F.element_at(ids, F.replace(m, F.lit("/"), F.lit(" ")))))

    rows = rows.withColumn("_found", found).select("doc_id", F.flatten(F.transform("_found", of)).alias("sentence_ids"))
    sequence = F.array_join(F.transform("sentence_ids", lambda s: F.concat(F.lit("<"), s, F.lit(">"))), "")
    none = F.array().cast("array<string>")
    return rows.withColumn("licenses", F.when(F.size("sentence_ids") > 0, matched(sequence, rules)).otherwise(none))


def op7_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def _oracle() -> str:
    """The same in SQL without look-around: each sign between words that isn't a space is doubled, so that a sentence
    can take the one before it and the one after it."""
    text = "coalesce(text, '')"
    for regex, new in (
        (r"\x01", " "), (rf"[.!?;:]+([{_SPACE}]|\z)", "\x01\\1"), (r"\n[^A-Za-z0-9]*\n", "\x01"),
        (r"[^A-Za-z0-9\x01\n]+", " "), (r"[ \n]*\x01[ \n\x01]*", "|"), (r" ?\n ?", "/"),
    ):
        text = f"regexp_replace({text}, '{regex}', " + ("chr(1) || '\\1'" if new.startswith("\x01\\") else "chr(1)" if new == "\x01" else f"'{new}'") + ", 'g')"
    known = "|".join(k.replace(" ", "(?: |//)") for k in sorted(SENTENCES, key=lambda k: -len(k)))
    find = f"[|/ ]spdx license identifier(?:[|][|]| )[a-z0-9 ]+|[|/](?:{known})[|/]"
    ids = "MAP {" + ", ".join(f"'{k}': '{i}'" for k, i in SENTENCES.items()) + "}"
    spdx = "MAP {" + ", ".join(f"'{_plain(n)}': '{i}'" for n, i in SPDX.items()) + "}"
    names = f"string_split_regex(regexp_replace(regexp_replace(m, '^.spdx license identifier(?:[|][|]| )', ''), '{SPDX_SUFFIX}', '\\2', 'g'), '{SPDX_JOIN}')"
    of = f"CASE WHEN contains(m, 'spdx license identifier') THEN list_transform({names}, lambda n: {spdx}[trim(n)]) ELSE [{ids}[replace(m[2:length(m)-1], '//', ' ')]] END"
    # each rule takes what the rules before have left
    steps, found = [], []
    for k, (name, rule) in enumerate(RULES):
        steps.append(f"s{k + 1} AS (SELECT * EXCLUDE (rest), contains(rest, '{_pattern(rule)}') AS r{k}, replace(rest, '{_pattern(rule)}', '#') AS rest FROM s{k})")
        found.append(f"CASE WHEN r{k} THEN '{name}' END")
    ordered = "list_filter([" + ", ".join(found) + "], lambda x: x IS NOT NULL)"
    unique = "list_filter(f, lambda x, i: list_position(f, x) = i)"
    return f"""
WITH p AS (SELECT doc_id, translate(trim({text}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
q AS (SELECT doc_id, regexp_extract_all('|' || replace(replace(t, '|', '||'), '/', '//') || '|', '{find}') AS ms FROM p),
k AS (SELECT doc_id, list_filter(flatten(list_transform(ms, lambda m: {of})), lambda x: x IS NOT NULL) AS ids FROM q),
s0 AS (SELECT doc_id, ids, coalesce(list_aggregate(list_transform(ids, lambda x: '<' || x || '>'), 'string_agg', ''), '') AS rest FROM k),
{", ".join(steps)},
n AS (SELECT doc_id, ids, {ordered} AS f FROM s{len(RULES)})
SELECT doc_id, CAST(len(ids) AS BIGINT) AS n_sentences, coalesce(list_aggregate(ids, 'string_agg', ','), '') AS sentence_ids, coalesce(list_aggregate({unique}, 'string_agg', ','), '') AS licenses FROM n
"""


QUERIES = {"op7_licenses": op7_licenses}
ORACLES = {"op7_licenses": _oracle()}
