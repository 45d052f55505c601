"""License scans by sentence rules: known sentences become identifiers, and ordered rules match the identifiers in sequence.

Sentences end at sentence ends, table bars and blank lines. A line end, semicolon or colon can end one as well, but a known
sentence may also go on over it, so that wrapped texts are whole. Comment marks vanish; ASCII letters are lower-cased and
everything but letters and digits becomes one space. What equals a known sentence stands for its identifier, after one of
a few lead-ins such as "This software is"; all else vanishes. Rules are tried in their order at each place of the
identifier sequence, leftmost first; a rule's identifiers have to be adjacent there. Only DataFrame functions are used,
and no row leaves its task. The SQL knows unwrapped sentences of ``SENTENCES`` only.

Null and empty texts have no identifiers and no licences. Repeated rows and sentences are each reported.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Normalised licence sentences and their identifiers.
SENTENCES = {
    "licensed under the apache license version 2 0": "apache2-short",
    "licensed under the apache license version 2 0 the license": "apache2-grant",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at": "apache2-copy",
    "released under the mit license": "mit-short",
    "licensed under the mit license": "mit-short",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied": "as-is",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this work is licensed under the gnu general public license version 3": "gpl3-short",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "licensed under cc by 4 0": "ccby4-short",
    "licensed under cc by sa 4 0": "ccbysa4-short",
    "licensed under cc by nc 4 0": "ccbync4-short",
    "this work is dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}
# Ordered rules, a licence and the identifiers that state it.
RULES = [
    ("Apache-2.0", ["apache2-grant", "apache2-use", "apache2-copy"]),
    ("Apache-2.0", ["apache2-short", "apache2-use", "apache2-copy"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-endorse", "as-is"]),
    ("BSD-2-Clause", ["bsd-grant", "as-is"]),
    ("GPL-3.0-or-later", ["gpl3-grant", "gpl-warranty"]),
    ("GPL-3.0-or-later", ["gpl3-grant"]),
    ("Apache-2.0", ["apache2-short"]),
    ("MIT", ["mit-short"]),
    ("GPL-3.0-only", ["gpl3-short"]),
    ("CC-BY-NC-4.0", ["ccbync4-short"]),
    ("CC-BY-SA-4.0", ["ccbysa4-short"]),
    ("CC-BY-4.0", ["ccby4-short"]),
    ("Public-Domain", ["public-domain"]),
    ("All-Rights-Reserved", ["reserved"]),
]
CUT = r"[.!?]+[ \t]+|[.!?]*[\r\n]+"  #: ends of sentences and lines
OTHER = "[^A-Za-z0-9|]+"


# What the licences' own texts have besides.
WHOLE = SENTENCES | {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "as-is",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-disclaimer",
}
WHOLE_RULES = [*RULES[:3], ("BSD-3-Clause", ["bsd-grant", "bsd-endorse", "bsd-disclaimer"]), ("BSD-2-Clause", ["bsd-grant", "bsd-disclaimer"]), *RULES[3:]]
#: Names that stand in the place of the copyright holder's, and what they become.
NAMES = [("^neither the name of .* nor the names of", "neither the name of the copyright holder nor the names of"), ("^this software is provided by .* and contributors as is", "this software is provided by the copyright holders and contributors as is")]
MARKS = [
    (r"[.!?]+[ \t]+|[.!?]+[\r\n]+", "|"), (r"(?i)[\r\n]+[ \t]*(?:dnl|rem)(?![A-Za-z0-9])", "\n"), (r"\r\n?|[;:]+(?=\s)", "\n"),
    (r"[^A-Za-z0-9|\n]+", " "), (r" ?\n ?", "\n"), (r" ?\| ?", "|"), (r"\n(?:\n)+", "|"),
]
LEAD = "(?:(?:this|the|all)[ \n](?:work|software|project|code|source[ \n]code|file|library|program|package|document|repository)[ \n](?:is|are)[ \n](?:also[ \n]|hereby[ \n])?|copyright(?:[ \n][a-z0-9]+){1,8}?[ \n](?=all[ \n]rights))?"


def pairs(mapping: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])


def _named(sentence: Column) -> Column:
    for pattern, name in NAMES:
        sentence = F.regexp_replace(sentence, pattern, name)
    return sentence


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document: id, n_sentences (recognised), sentence_ids and licences, each joined by ';' in order."""
    marks = F.concat(F.lit("|"), F.coalesce(text_col, F.lit("")), F.lit("|"))
    for pattern, mark in MARKS:
        marks = F.regexp_replace(marks, pattern, mark)
    name = r"[a-z0-9]+(?:[ \n][a-z0-9]+){0,7}"
    form = lambda x: x.replace("of the copyright holder nor", "of @ nor").replace("by the copyright holders and", "by @ and").replace(" ", r"[ \n]").replace("@", name)
    forms = [form(x) for x in sorted(WHOLE, key=len, reverse=True)]
    known = F.regexp_extract_all(F.lower(marks), F.lit(r"(?<=[|\n])" + LEAD + "(" + "|".join(forms) + r")(?=[|\n]|[ \n]https? )"), F.lit(1))
    known = F.transform(known, lambda s: _named(F.translate(s, "\n", " ")))
    row = docs.select(F.col(id_col).alias("id"), known.alias("known"))
    # few texts have any: only then are maps and rules looked at
    ids = F.when(F.size("known") > 0, F.transform("known", lambda s: F.element_at(pairs(WHOLE), s))).otherwise(F.array().cast("array<string>"))
    row = row.select("id", ids.alias("ids"))
    sequence = F.concat(F.array_join("ids", ";"), F.lit(";"))
    rules = {"".join(f"{x};" for x in ids): name for name, ids in WHOLE_RULES}
    found = F.when(F.size("ids") > 0, F.regexp_extract_all(sequence, F.lit("(" + "|".join(rules) + ")"), F.lit(1))).otherwise(F.array().cast("array<string>"))
    names = F.transform(found, lambda m: F.element_at(pairs(rules), m))
    return row.select(F.col("id").alias(id_col), F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ";").alias("sentence_ids"), F.array_join(names, ";").alias("licences"))


def oracle(table: str = "documents") -> str:
    """The same in DuckDB SQL."""
    quoted = lambda m: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in m.items()) + "}"
    rules = {"".join(f"{x};" for x in ids): name for name, ids in RULES}
    return f"""
WITH marked AS (
  SELECT doc_id, lower(regexp_replace(regexp_replace(coalesce(text, ''), '{CUT}', '|', 'g'), '{OTHER}', ' ', 'g')) AS marks FROM {table}
), known AS (
  SELECT doc_id, list_filter(list_transform(string_split(marks, '|'), lambda s: trim(s)), lambda s: s IN ({", ".join(f"'{s}'" for s in SENTENCES)})) AS sentences FROM marked
), ids AS (
  SELECT doc_id, list_transform(sentences, lambda s: {quoted(SENTENCES)}[s]) AS ids FROM known
)
SELECT doc_id, len(ids) AS n_sentences, array_to_string(ids, ';') AS sentence_ids,
  array_to_string(list_transform(regexp_extract_all(array_to_string(ids, ';') || ';', '{"|".join(rules)}'), lambda m: {quoted(rules)}[m]), ';') AS licences
FROM ids"""
