"""Licence recognition by sentence rules. DataFrame functions only.

Texts are cut into pieces at sentence ends and line breaks, and normalised (lower case,
everything but a-z and 0-9 turned into single blanks, so comment markers go). A known licence
sentence is found where it equals a piece or a run of pieces that only single line breaks part,
as in wrapped text; sentence ends and blank lines are never crossed, and of known sentences that
start together the longest counts. The numbers of those found, in text order, form the
document's identifier sequence; a licence is reported when all identifiers of one of its rules
occur in that sequence in the rule's order.

``OP5_SQL`` has the sentences of one line in ``SENTENCES`` and ``RULES`` only; neither joined
lines nor ``NOTICES`` and ``NOTICE_RULES`` are in it, so it finds less in wrapped texts.

Defined results: ``n_sentences`` counts pieces that are not empty; null text has none; repeated rows each get a row; a sentence that is
repeated counts each time in ``sentence_ids``; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let

CUT = r"[.!?;:]+[ \t]+|[\r\n]+"
#: A run of sentence ends for Java: taken whole and from its beginning only, so that a long run is read once.
ENDS = r"(?<![.!?;:])[.!?;:]++"
CUT_ONCE = CUT.replace("[.!?;:]+", ENDS)
#: Known sentences, normalised. Wording of public licences.
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "you may not use this file except in compliance with the license",
    3: "you may obtain a copy of the license at",
    4: "http www apache org licenses license 2 0",
    5: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    6: "see the license for the specific language governing permissions and limitations under the license",
    10: "released under the mit license",
    11: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    12: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    13: "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    20: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    21: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    22: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    23: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    30: "this work is licensed under the gnu general public license version 3",
    31: "this program is free software",
    32: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    33: "either version 3 of the license or at your option any later version",
    34: "either version 2 of the license or at your option any later version",
    35: "this program is distributed in the hope that it will be useful but without any warranty",
    40: "licensed under cc by nc 4 0",
    41: "licensed under cc by 4 0",
    42: "licensed under cc by sa 4 0",
    43: "this work is licensed under a creative commons attribution 4 0 international license",
    44: "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    50: "this source code form is subject to the terms of the mozilla public license v 2 0",
    51: "all rights reserved",
    60: "spdx license identifier apache 2 0",
    61: "spdx license identifier mit",
    62: "spdx license identifier gpl 3 0 only",
    63: "spdx license identifier bsd 3 clause",
}
#: Licence: ordered identifier sequences, any of which is enough.
RULES = {
    "Apache-2.0": ((1,), (2, 3, 5, 6), (60,)),
    "MIT": ((10,), (11, 12, 13), (61,)),
    "BSD-2-Clause": ((20, 21, 22),),
    "BSD-3-Clause": ((20, 21, 22, 23), (63,)),
    "GPL-3.0": ((30,), (31, 32, 33, 35), (62,)),
    "GPL-2.0": ((31, 32, 34, 35),),
    "CC-BY-NC-4.0": ((40,), (44,)),
    "CC-BY-4.0": ((41,), (43,)),
    "CC-BY-SA-4.0": ((42,),),
    "MPL-2.0": ((50,),),
}
#: Wording of notices as distributed, beyond ``SENTENCES``.
NOTICES = {
    7: "licensed under the apache license version 2 0 the license",
    36: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    37: "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    52: "this source code form is subject to the terms of the mozilla public license v",
    53: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    54: "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    55: "this is free and unencumbered software released into the public domain",
    56: "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means",
    57: "boost software license version 1 0",
    58: "this software is provided as is without any express or implied warranty",
    59: "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    64: "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0",
    65: "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    66: "to the extent possible under law",
    67: "has waived all copyright and related or neighboring rights to this work",
    68: "this work is dedicated to the public domain under the cc0 1 0 universal license",
    69: "spdx license identifier bsd 2 clause",
    70: "spdx license identifier mpl 2 0",
    71: "spdx license identifier isc",
    72: "spdx license identifier gpl 2 0 only",
    73: "spdx license identifier gpl 3 0 or later",
    74: "spdx license identifier gpl 2 0 or later",
    75: "spdx license identifier lgpl 2 1 or later",
    76: "spdx license identifier agpl 3 0 or later",
    77: "spdx license identifier cc0 1 0",
    78: "spdx license identifier unlicense",
    79: "spdx license identifier bsl 1 0",
    80: "spdx license identifier epl 2 0",
    81: "spdx license identifier zlib",
    82: "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    83: "this library is free software",
    84: "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    85: "this library is distributed in the hope that it will be useful but without any warranty",
    86: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission this software is provided by the copyright holders and contributors as is",
    87: "gnu general public license version 3 29 june 2007",
    88: "gnu general public license version 2 june 1991",
    89: "mozilla public license version 2 0",
    90: "apache license version 2 0 january 2004",
    91: "mit license",
    92: "the mit license mit",
    93: "creative commons attribution 4 0 international public license",
}
NOTICE_RULES = {
    "Apache-2.0": ((7,), (90,)), "GPL-3.0": ((31, 36, 35), (73,), (87,)), "GPL-2.0": ((31, 37, 35), (72,), (74,), (88,)), "MPL-2.0": ((52,), (70,), (89,)), "MIT": ((91, 11), (92, 11)),
    "ISC": ((53, 54), (71,)), "Unlicense": ((55, 56), (78,)), "BSL-1.0": ((57,), (79,)), "Zlib": ((58, 59), (81,)), "EPL-2.0": ((64,), (80,)), "CC-BY-SA-4.0": ((65,),), "CC-BY-4.0": ((93,),),
    "CC0-1.0": ((66, 67), (68,), (77,)), "BSD-2-Clause": ((69,),), "BSD-3-Clause": ((20, 21, 22, 86),), "AGPL-3.0": ((31, 82, 35), (76,)), "LGPL-2.1": ((83, 84, 85), (75,)),
}
#: Every known sentence holds one of these.
ANCHORS = ("licen", "permission", "copyright", "redistribut", "warrant", "free software", "rights reserved", "version", "public domain", "anyone is free", "extent possible under law")


def _pattern(rule: tuple[int, ...]) -> str:
    """Of a rule for ``OP5_SQL``, over ',1,2,3,'. Identifiers between those of the rule are skipped."""
    return "," + "(?:[0-9]+,)*".join(f"{i}," for i in rule)


KNOWN = SENTENCES | NOTICES
#: Comment markers that start a line, before ``;;`` is taken for a sentence end.
MARKER = r"(?m)^[ \t]*;+"
#: A sentence end, also before a line break, or a blank line; comment markers alone are blank.
STOP = ENDS + r"(?:[ \t]+|[ \t]*(?=[\r\n]))|(?>\r\n|\r|\n)(?=[^a-zA-Z0-9\r\n]*[\r\n])"


def _sentence_pattern() -> str:
    """Over words parted by single blanks or ``|`` (a line break), with ``||`` for a hard end."""
    known = sorted(KNOWN.values(), key=len, reverse=True)
    return "(?<=[|])(?:" + "|".join(s.replace(" ", "[ |]") for s in known) + ")(?=[|])"


def _sentence_ids(text: Column) -> Column:
    t = F.regexp_replace(F.translate(text, "|\x01\x02", "   "), MARKER, "")
    t = F.regexp_replace(F.regexp_replace(t, STOP, "\x02"), r"[\r\n]+", "\x01")
    t = F.regexp_replace(F.lower(t), "[^a-z0-9\x01\x02]+", " ")
    t = F.regexp_replace(t, "(?<![ \x01])[ \x01]*+\x02[ \x01\x02]*", "||")
    t = F.regexp_replace(t, " *\x01[ \x01]*", "|")
    t = F.concat(F.lit("||"), F.trim(t), F.lit("||"))
    return let(t, _known_in)


def _known_in(t: Column) -> Column:
    """Numbers of the known sentences in a normalised text; one without any of ``ANCHORS`` has none."""
    known = F.create_map(*(F.lit(x) for i, s in KNOWN.items() for x in (s, i)))
    found = F.transform(F.regexp_extract_all(t, F.lit(_sentence_pattern()), F.lit(0)), lambda s: F.try_element_at(known, F.translate(s, "|", " ")))
    return F.when(t.rlike("|".join(a.replace(" ", "[ |]") for a in ANCHORS)), found).otherwise(F.expr("cast(array() as array<int>)"))


def _in_order(ids: Column, rule: tuple[int, ...]) -> Column:
    """Whether a rule's identifiers occur in this order among ``ids``, others between them or not: each is looked for
    behind the place of the one before, so the sequence is read once a rule."""
    if len(rule) == 1:
        return F.array_contains(ids, rule[0])

    def next_place(at: Column, i: Column) -> Column:
        step = F.array_position(F.slice(ids, at + 1, F.size(ids)), i).cast("int")
        return let(step, lambda p: F.when((at < 0) | (p == 0), -1).otherwise(at + p))

    return F.aggregate(F.array(*map(F.lit, rule)), F.lit(0), lambda at, i: F.when(at < 0, -1).otherwise(next_place(at, i))) > 0


def _licences_of(ids: Column) -> Column:
    """Licences of which a rule fits, by name."""
    fits = lambda name: reduce(lambda a, b: a | b, [_in_order(ids, r) for r in RULES.get(name, ()) + NOTICE_RULES.get(name, ())])
    return F.concat_ws(",", *(F.when(fits(name), F.lit(name)) for name in sorted(RULES.keys() | NOTICE_RULES.keys())))


def licenses(docs: DataFrame) -> DataFrame:
    """doc_id, n_sentences, n_known, sentence_ids, licenses: a row per row of ``docs``."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.size(F.filter(F.split(text, CUT_ONCE, -1), lambda s: s != "")).cast("long").alias("n_sentences"), _sentence_ids(text).alias("ids"))

    def told(ids: Column) -> Column:
        names = F.when(F.size(ids) > 0, _licences_of(ids)).otherwise("")
        return F.struct(F.size(ids).cast("long").alias("n_known"), F.array_join(ids, ",").alias("sentence_ids"), names.alias("licenses"))

    return rows.select("doc_id", "n_sentences", let(F.col("ids"), told).alias("x")).select("doc_id", "n_sentences", "x.n_known", "x.sentence_ids", "x.licenses")


def op5_licenses(spark, sf_dir: str) -> DataFrame:
    return licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _known_sql() -> str:
    return ", ".join(f"({i}, '{s}')" for i, s in SENTENCES.items())


_FOUND_SQL = ", ".join(f"CASE WHEN regexp_matches(seq, '{'|'.join(map(_pattern, rules))}') THEN '{name}' END" for name, rules in sorted(RULES.items()))
OP5_SQL = rf"""
WITH known(id, s) AS (VALUES {_known_sql()}), cut AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{CUT}'), lambda s: s <> '') AS ss FROM documents
), n AS (
  SELECT doc_id, generate_subscripts(ss, 1) AS pos, trim(regexp_replace(lower(unnest(ss)), '[^a-z0-9]+', ' ', 'g')) AS s FROM cut
), k AS (
  SELECT doc_id, count(*) AS n_known, string_agg(id::VARCHAR, ',' ORDER BY pos) AS ids FROM n JOIN known USING (s) GROUP BY doc_id
), q AS (
  SELECT doc_id, len(ss)::BIGINT AS n_sentences, coalesce(n_known, 0) AS n_known, coalesce(ids, '') AS sentence_ids, ',' || coalesce(ids, '') || ',' AS seq
  FROM cut LEFT JOIN k USING (doc_id)
)
SELECT doc_id, n_sentences, n_known, sentence_ids, concat_ws(',', {_FOUND_SQL}) AS licenses FROM q
"""
