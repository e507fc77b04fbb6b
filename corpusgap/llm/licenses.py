"""License scans by sentence rules: sentences become identifiers, identifier sequences become licenses.

A text is cut into sentences at line breaks, and at `.`, `!` or `?` before white space. A sentence is
normalised (lower case, punctuation but inner dots and hyphens as blanks, single blanks) and looked
up in SENTENCES; a sentence that is not listed but speaks of a license is `UNKNOWN`, any other `-`.
RULES are then tried in their order on the document's identifier sequence: each match is consumed,
so a longer rule wins over the shorter ones below it. Identifiers that no rule takes are reported as
unmatched.

Cases: null, empty and blank texts have no sentence and no license; repeated license lines count each
time; an empty table gives an empty table; other columns are ignored. Everything happens inside the
row: no shuffle, whatever source or text is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of well-known license notices, normalised, with their identifiers.
SENTENCES = {
    "licensed under the apache license version 2.0": "Apache2",
    "licensed under the apache license version 2.0 the license": "Apache2The",
    "you may not use this file except in compliance with the license": "ApacheUse",
    "you may obtain a copy of the license at": "ApacheCopy",
    "released under the mit license": "MitRef",
    "licensed under the mit license": "MitRef",
    "this project is licensed under the mit license": "MitRef",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "MitGrant",
    "the software is provided as is without warranty of any kind": "AsIs",
    "this work is licensed under the gnu general public license version 3": "Gpl3Ref",
    "this program is free software you can redistribute it and or modify it": "GplFree",
    "under the terms of the gnu general public license version 3": "GplTerms3",
    "under the terms of the gnu general public license version 2": "GplTerms2",
    "this program is distributed in the hope that it will be useful": "GplHope",
    "licensed under cc by-nc 4.0": "CcByNc4",
    "licensed under cc by-sa 4.0": "CcBySa4",
    "licensed under cc by 4.0": "CcBy4",
    "this work is licensed under a creative commons attribution 4.0 international license": "CcBy4",
    "redistribution and use in source and binary forms with or without modification are permitted": "BsdGrant",
    "neither the name of the copyright holder nor the names of its contributors may be used": "BsdName",
    "all rights reserved": "AllRights",
}
# Rules in the order in which they are tried: identifiers in sequence, license.
RULES = [
    (["Apache2The", "ApacheUse", "ApacheCopy"], "Apache-2.0"),
    (["GplFree", "GplTerms3", "GplHope"], "GPL-3.0"),
    (["GplFree", "GplTerms3"], "GPL-3.0"),
    (["GplFree", "GplTerms2", "GplHope"], "GPL-2.0"),
    (["GplFree", "GplTerms2"], "GPL-2.0"),
    (["MitGrant", "AsIs"], "MIT"),
    (["BsdGrant", "BsdName"], "BSD-3-Clause"),
    (["BsdGrant"], "BSD-2-Clause"),
    (["Apache2"], "Apache-2.0"),
    (["Apache2The"], "Apache-2.0"),
    (["MitRef"], "MIT"),
    (["MitGrant"], "MIT"),
    (["Gpl3Ref"], "GPL-3.0"),
    (["CcByNc4"], "CC-BY-NC-4.0"),
    (["CcBySa4"], "CC-BY-SA-4.0"),
    (["CcBy4"], "CC-BY-4.0"),
    (["AllRights"], "Proprietary"),
]
LICENSE_WORDS = r"\b(licen[sc]e[ds]?|licensing|copyright|spdx)\b"
CUT = r"[.!?]+(?=[ \t\r\n]|$)|[\r\n]+"


def sentences(text: Column) -> Column:
    """The normalised sentences of a text, in order."""
    plain = lambda s: F.trim(F.regexp_replace(F.lower(s), r"[^\p{L}\p{N}.\-]+", " "))
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), CUT), plain), lambda s: s != "")


def _identifiers(normal: Column, known: dict[str, str]) -> Column:
    """The identifier of every normalised sentence. Only sentences with a word of the licenses are
    looked up: each known sentence has one of these words or stands in the list itself."""
    lookup = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    keys = F.array(*[F.lit(k) for k in known])
    return F.transform(normal, lambda s: F.when(F.array_contains(keys, s), F.try_element_at(lookup, s))
                       .when(F.rlike(s, F.lit(LICENSE_WORDS)), F.lit("UNKNOWN")).otherwise(F.lit("-")))


def scan(docs: DataFrame, known: dict[str, str] | None = None, rules: list | None = None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_sentences, sentence_ids, licenses, main_license, n_unmatched.

    sentence_ids: identifiers of license sentences in order, other sentences between them as `-`
    (runs of these once). licenses: one entry per match, by rule order. main_license: the license of
    the first rule that matched; UNKNOWN if only unmatched license sentences are there; else null.
    """
    known, rules = known or SENTENCES, rules or RULES
    found = docs.select("doc_id", sentences(F.col("text")).alias("normal")).select(
        "doc_id", F.size("normal").cast("bigint").alias("n_sentences"),
        _identifiers(F.col("normal"), known).alias("ids"))
    # ' a b c ' with single blanks on both sides of each identifier
    sequence = F.when(F.exists("ids", lambda i: i != "-"), F.regexp_replace(
        F.concat(F.lit(" "), F.array_join("ids", "  "), F.lit(" ")), r"(?: - )+", " - ")).otherwise(F.lit(""))
    state = found.select("doc_id", "n_sentences", sequence.alias("sequence"))
    matches, rest = [], F.col("sequence")
    for ids, license_name in rules:
        pattern = "".join(f" {i} " for i in ids)
        after = F.replace(rest, F.lit(pattern), F.lit(" - "))
        n = (F.length(rest) - F.length(after)) / (len(pattern) - 3)
        matches.append(F.array_repeat(F.lit(license_name), n.cast("int")))
        rest = after
    scanned = state.withColumn("unmatched", F.filter(F.split(rest, " +"), lambda i: (i != "") & (i != "-")))
    scanned = scanned.withColumn(
        "licenses", F.when(F.col("sequence") == "", F.array().cast("array<string>")).otherwise(F.concat(*matches)))
    return scanned.select(
        "doc_id", "n_sentences",
        F.trim(F.regexp_replace("sequence", " +", " ")).alias("sentence_ids"),
        F.array_join("licenses", ",").alias("licenses"),
        F.when(F.size("licenses") > 0, F.get("licenses", F.lit(0)))
        .when(F.size("unmatched") > 0, F.lit("UNKNOWN")).alias("main_license"),
        F.size("unmatched").cast("bigint").alias("n_unmatched"),
    )
