"""License texts and mentions by ordered signature rules.

The text becomes ``" w1 w2 ... "``: lower-cased words with single spaces. One cheap pattern over it decides whether any
rule can fit; only then does each rule's own keyword decide whether its regular expression runs. A place that lies within
another one of a rule of higher priority (or, of equal priority, a longer or earlier one) is suppressed. Rules come from the
table of license families below; everything is a DataFrame expression and stays within its row.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import NON_WORD_CLASS, ascii_lower, table
from ._spans import blocks_of, let, match_places

#: Fixed values of the contract: phrase and label.
BASE_PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: label: names; versions, as words. Fixed names of public licenses.
FAMILIES = (
    ("gpl", ("gnu general public license", "gnu gpl", "gpl"), ("1", "2", "3", "2 0", "3 0")),
    ("lgpl", ("gnu lesser general public license", "gnu library general public license", "lgpl"), ("2", "2 1", "3", "3 0")),
    ("agpl", ("gnu affero general public license", "agpl"), ("1", "3", "3 0")),
    ("gfdl", ("gnu free documentation license", "gfdl"), ("1 1", "1 2", "1 3")),
    ("apache", ("apache license", "apache software license", "apache"), ("1 0", "1 1", "2 0")),
    ("mpl", ("mozilla public license", "mpl"), ("1 0", "1 1", "2 0")),
    ("epl", ("eclipse public license", "epl"), ("1 0", "2 0")),
    ("cddl", ("common development and distribution license", "cddl"), ("1 0", "1 1")),
    ("cpl", ("common public license",), ("1 0",)),
    ("eupl", ("european union public licence", "eupl"), ("1 1", "1 2")),
    ("osl", ("open software license",), ("2 1", "3 0")),
    ("afl", ("academic free license",), ("2 1", "3 0")),
    ("artistic", ("artistic license",), ("1 0", "2 0")),
    ("boost", ("boost software license",), ("1 0",)),
    ("bsd", ("bsd license", "bsd 2 clause", "bsd 3 clause", "bsd 4 clause", "new bsd license", "simplified bsd license"), ()),
    ("mit", ("mit license", "expat license", "x11 license"), ()),
    ("isc", ("isc license",), ()),
    ("zlib", ("zlib license", "zlib libpng license"), ()),
    ("unlicense", ("the unlicense", "unlicense org"), ()),
    ("wtfpl", ("do what the fuck you want to public license", "wtfpl"), ()),
    ("psf", ("python software foundation license", "psf license"), ("2",)),
    ("php", ("php license",), ("3 0", "3 01")),
    ("openssl", ("openssl license",), ()),
    ("postgresql", ("postgresql license",), ()),
    ("ruby", ("ruby license",), ()),
    ("ofl", ("sil open font license", "open font license"), ("1 0", "1 1")),
    ("odbl", ("open database license", "odbl"), ("1 0",)),
    ("pddl", ("public domain dedication and license",), ("1 0",)),
    ("qpl", ("q public license",), ("1 0",)),
    ("ms-pl", ("microsoft public license",), ()),
    ("ms-rl", ("microsoft reciprocal license",), ()),
    ("cc0", ("cc0", "creative commons zero"), ("1 0",)),
    ("cc-by", ("cc by", "creative commons attribution"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-sa", ("cc by sa", "creative commons attribution sharealike", "creative commons attribution share alike"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nd", ("cc by nd", "creative commons attribution noderivatives", "creative commons attribution no derivatives"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc", ("cc by nc", "creative commons attribution noncommercial", "creative commons attribution non commercial"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-sa", ("cc by nc sa", "creative commons attribution noncommercial sharealike"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
    ("cc-by-nc-nd", ("cc by nc nd", "creative commons attribution noncommercial noderivatives"), ("1 0", "2 0", "2 5", "3 0", "4 0")),
)
#: Short names that are written with the version attached, as in GPLv3 and LGPLv2.1, also as the last word of a longer name.
SHORT = ("gpl", "lgpl", "agpl", "gfdl", "mpl", "epl", "cddl", "eupl")
#: label, keyword, pattern over the spaced words, confidence. Texts of the licenses themselves.
TEXT_RULES = (
    ("mit", "permission is hereby granted", r" permission is hereby granted free of charge to any person obtaining a copy(?= )", 1.0),
    ("isc", "permission to use copy", r" permission to use copy modify and or distribute this software for any purpose(?= )", 1.0),
    ("bsd", "redistribution and use", r" redistribution and use in source and binary forms with or without modification(?= )", 1.0),
    ("bsd", "neither the name of", r" neither the name of (?:\S+ ){1,8}nor the names of its contributors(?= )", 0.9),
    ("zlib", "this software is provided", r" this software is provided as is without any express or implied warranty(?= )", 0.7),
    ("apache", "you may not use this file", r" you may not use this file except in compliance with the license(?= )", 0.9),
    ("gpl", "free software you can", r" free software you can redistribute it and or modify it under the terms of the gnu general public license(?= )", 1.0),
    ("lgpl", "free software you can", r" free software you can redistribute it and or modify it under the terms of the gnu lesser general public license(?= )", 1.0),
    ("mpl", "this source code form", r" this source code form is subject to the terms of the mozilla public license(?= )", 1.0),
    ("unlicense", "free and unencumbered", r" this is free and unencumbered software released into the public domain(?= )", 1.0),
    ("boost", "boost software license", r" distributed under the boost software license(?= )", 1.0),
    ("mit", "the above copyright notice", r" the above copyright notice and this permission notice shall be included in all copies(?= )", 0.9),
    ("mit", "without restriction including", r" deal in the software without restriction including without limitation the rights to use(?= )", 0.9),
    ("bsd", "redistributions of source code", r" redistributions of source code must retain the (?:above|accompanying) copyright notice(?= )", 0.9),
    ("bsd", "redistributions in binary form", r" redistributions in binary form must reproduce the (?:above|accompanying) copyright notice(?= )", 0.9),
    ("bsd", "all advertising materials", r" all advertising materials mentioning features or use of this software must display(?= )", 0.9),
    ("apache", "licensed to the apache", r" licensed to the apache software foundation asf under one or more contributor license agreements(?= )", 1.0),
    ("apache", "unless required by applicable", r" unless required by applicable law or agreed to in writing software distributed under the license(?= )", 0.9),
    ("apache", "www apache org licenses", r" www apache org licenses license (?:1 1|2 0)(?= )", 0.9),
    ("gpl", "everyone is permitted to copy", r" everyone is permitted to copy and distribute verbatim copies of this license document(?= )", 0.6),
    ("gpl", "you should have received", r" you should have received a copy of the gnu general public license(?= )", 1.0),
    ("gpl", "www gnu org licenses", r" www gnu org licenses (?:old licenses )?gpl \d(?: \d)?(?= )", 0.9),
    ("lgpl", "you should have received", r" you should have received a copy of the gnu (?:lesser|library) general public license(?= )", 1.0),
    ("lgpl", "www gnu org licenses", r" www gnu org licenses (?:old licenses )?lgpl \d(?: \d)?(?= )", 0.9),
    ("agpl", "you should have received", r" you should have received a copy of the gnu affero general public license(?= )", 1.0),
    ("agpl", "remote network interaction", r" remote network interaction use with the gnu general public license(?= )", 0.9),
    ("gfdl", "permission is granted to copy", r" permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license(?= )", 1.0),
    ("mpl", "a copy of the mpl", r" if a copy of the mpl was not distributed with this file(?= )", 1.0),
    ("epl", "the accompanying materials", r" this program and the accompanying materials are made available under the terms of the eclipse public license(?= )", 1.0),
    ("cddl", "the contents of this file", r" the contents of this file are subject to the terms of the common development and distribution license(?= )", 1.0),
    ("isc", "provided that the above", r" provided that the above copyright notice and this permission notice appear in all copies(?= )", 0.9),
    ("zlib", "the origin of this software", r" the origin of this software must not be misrepresented(?= )", 0.9),
    ("zlib", "altered source versions", r" altered source versions must be plainly marked as such(?= )", 0.9),
    ("boost", "permission is hereby granted", r" permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation(?= )", 1.0),
    ("unlicense", "anyone is free to copy", r" anyone is free to copy modify publish use compile sell or distribute this software(?= )", 1.0),
    ("artistic", "the intent of this document", r" the intent of this document is to state the conditions under which a package may be copied(?= )", 1.0),
    ("ofl", "this font software is licensed", r" this font software is licensed under the sil open font license(?= )", 1.0),
    ("ofl", "reserved font name", r" (?:with|no modified version of the font software may use the) reserved font name(?= )", 0.8),
    ("openssl", "this product includes software", r" this product includes software developed by the openssl project(?= )", 1.0),
    ("php", "this product includes php", r" this product includes php software freely available from(?= )", 1.0),
    ("wtfpl", "you just do what the fuck", r" you just do what the fuck you want to(?= )", 1.0),
    ("cc0", "waived all copyright", r" (?:has|have) waived all copyright and related or neighboring rights(?= )", 1.0),
    ("cc-by", "creativecommons org licenses by", r" creativecommons org licenses by \d(?= )", 0.9),
    ("cc-by-sa", "creativecommons org licenses by sa", r" creativecommons org licenses by sa(?: \d)?(?= )", 0.9),
    ("cc-by-nd", "creativecommons org licenses by nd", r" creativecommons org licenses by nd(?: \d)?(?= )", 0.9),
    ("cc-by-nc", "creativecommons org licenses by nc", r" creativecommons org licenses by nc \d(?= )", 0.9),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", r" creativecommons org licenses by nc sa(?: \d)?(?= )", 0.9),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", r" creativecommons org licenses by nc nd(?: \d)?(?= )", 0.9),
    ("mit", "mit licensed", r" mit licensed(?= )", 0.8),
    ("apache", "apache licensed", r" apache licensed(?= )", 0.8),
    ("bsd", "bsd licensed", r" bsd licensed(?= )", 0.8),
    ("public-domain", "public domain", r" (?:released into|dedicated to|placed in) the public domain(?= )", 0.7),
    ("proprietary", "all rights reserved", r" all rights reserved(?= )", 0.4),
    ("proprietary", "proprietary and confidential", r" proprietary and confidential(?= )", 0.8),
)
#: Words of which every rule's text holds at least one.
ROOTS = r" (?:licen[sc]e|licensed|unlicense|(?:[al]?gpl|mpl|epl|cddl|eupl|gfdl)v?\d?|wtfpl|odbl|apache|bsd|cc0?|creative commons|psf|spdx|licenses|permission|permitted|redistributions?|waived|copyright|software without restriction|advertising materials|accompanying materials|remote network|contents of this file|origin of this software|altered source|free to copy|intent of this document|font|this product includes|do what the fuck|neither the name|software you|source code form|unencumbered|software is provided|public domain|rights reserved|proprietary)(?= )"


@dataclass(frozen=True)
class Signature:
    """A rule: ``keyword`` must occur for ``pattern`` to run; higher ``priority`` suppresses lower within its place."""

    label: str
    keyword: str
    pattern: str
    priority: int
    confidence: float


def signatures() -> list[Signature]:
    """The rules in order: license texts, identifiers, grants, names with versions, names."""
    out = [Signature(label, keyword, pattern, 5, sure) for label, keyword, pattern, sure in TEXT_RULES]
    for label, names, versions in FAMILIES:
        depth = max(len(label.split("-")), 1) if label.startswith("cc-") else 1
        out.append(Signature(label, "spdx license identifier", f" spdx license identifier {label.replace('-', ' ')}(?= )", 40 + depth, 1.0))
        for name in names:
            short = name.split()[-1] in SHORT
            granted = rf"{name}v?\d?" if short else name
            whole = rf"{name}(?:v\d?)?" if short else name
            dated = rf"{name} ?(?:version )?v? ?" if short else rf"{name} (?:version )?v?"
            out.append(Signature(label, name, rf" (?:licen[sc]ed|released|distributed|available) under (?:the )?(?:terms of the )?{granted}(?= )", 30 + depth, 1.0))
            out += [Signature(label, name, rf" {dated}{v}(?= )", 20 + depth, 0.9) for v in versions]
            out.append(Signature(label, name, f" {whole}(?= )", 10 + depth, 0.6))
    return out


def spaced_words(text: Column) -> Column:
    """Lower-cased words, each with one space before it, and a space at the end; ``" "`` without words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), NON_WORD_CLASS, " ")), F.lit(" "))


def _spaces(col: Column) -> Column:
    return (F.length(col) - F.length(F.replace(col, F.lit(" "), F.lit("")))).cast("long")


def phrase_places(spaced: Column, phrase: str) -> Column:
    """(n, first, last): places of a phrase of words, and the word index of the smallest and largest start."""
    parts = F.split(spaced, f" {phrase}(?= )", -1)
    n = (F.size(parts) - 1).cast("long")
    first = _spaces(F.element_at(parts, 1))
    last = _spaces(spaced) - 1 - len(phrase.split()) - _spaces(F.element_at(parts, -1)) + 1
    return F.when(
        F.contains(spaced, F.lit(f" {phrase} ")),
        F.struct(n.alias("n"), first.alias("first"), last.alias("last")),
    ).otherwise(F.struct(F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("first"), F.lit(None).cast("long").alias("last")))


def detections(spaced: Column, rules: list[Signature]) -> Column:
    """Array of (start, end, priority, label, confidence), in characters of ``spaced``, that no other detection suppresses."""
    kind = "array<struct<start:int,end:int,priority:int,label:string,confidence:double>>"
    listed = F.array(
        *[
            F.struct(
                F.lit(r.label).alias("label"), F.lit(f" {r.keyword}").alias("keyword"), F.lit(r.pattern).alias("pattern"), F.lit(r.priority).alias("priority"), F.lit(float(r.confidence)).alias("confidence")
            )
            for r in rules
        ]
    )
    gated = F.filter(listed, lambda r: F.contains(spaced, r["keyword"]))
    found = F.flatten(
        F.transform(
            gated,
            lambda r: F.transform(
                match_places(spaced, r["pattern"]),
                lambda m: F.struct(
                    m["start"].alias("start"), m["end"].alias("end"), r["priority"].alias("priority"), r["label"].alias("label"), r["confidence"].alias("confidence")
                ),
            ),
        )
    )
    return F.when(spaced.rlike(ROOTS), found).otherwise(F.expr(f"CAST(array() AS {kind})"))


_DETECTION = "array<struct<start:int,end:int,priority:int,label:string,confidence:double>>"


def unsuppressed(found: Column, priorities: list[int]) -> Column:
    """Drops what lies within a detection of higher priority, or of equal priority and greater length.

    A sweep by start, longer and higher ones first. For each priority it keeps the furthest end (of equal ends the earliest start) of those
    seen of that priority or a higher one, as one number. Whatever was seen began no later, so a number says whether something holds the
    next one. Blocks are swept by themselves, from what the blocks before them leave.
    """
    levels = sorted(set(priorities))
    top, width = len(levels), 1 << 31
    place = F.array(*[F.lit(p) for p in levels])
    nothing = F.array(*[F.lit(0).cast("long")] * (top + 1))
    code = lambda d: d["end"].cast("long") * width + (width - 1 - d["start"])
    rank = lambda d: (F.array_position(place, d["priority"]) - 1).cast("int")

    def seen(reach, d):
        return F.transform(reach, lambda v, k: F.when(k <= rank(d), F.greatest(v, code(d))).otherwise(v))

    def inside(reach, d):
        above = F.element_at(reach, rank(d) + 2)
        return (F.shiftright(above, 31) >= d["end"]) & (above > 0) | (F.element_at(reach, rank(d) + 1) > code(d))

    def sweep(block, before):
        start = F.struct(before.alias("reach"), F.expr(f"CAST(array() AS {_DETECTION})").alias("kept"))
        step = lambda acc, d: F.struct(
            seen(acc["reach"], d).alias("reach"), F.when(inside(acc["reach"], d), acc["kept"]).otherwise(F.concat(acc["kept"], F.array(d))).alias("kept")
        )
        return F.aggregate(block, start, step)["kept"]

    def swept(blocks):
        furthest = F.transform(blocks, lambda b: F.aggregate(b, nothing, seen))
        start = F.struct(nothing.alias("reach"), F.expr("CAST(array() AS array<array<bigint>>)").alias("before"))
        step = lambda acc, r: F.struct(
            F.zip_with(acc["reach"], r, lambda x, y: F.greatest(x, y)).alias("reach"), F.concat(acc["before"], F.array(acc["reach"])).alias("before")
        )
        return F.flatten(F.zip_with(blocks, F.aggregate(furthest, start, step)["before"], sweep))

    order = lambda d: F.struct(d["start"], (-d["end"]).alias("e"), (-d["priority"]).alias("p"), d["label"], d["confidence"])
    back = lambda d: F.struct(
        d["start"].alias("start"), (-d["e"]).alias("end"), (-d["p"]).alias("priority"), d["label"].alias("label"), d["confidence"].alias("confidence")
    )
    ordered = lambda f: F.transform(F.array_sort(F.transform(f, order)), back)
    return let(found, lambda f: F.when(F.size(f) < 2, f).otherwise(let(ordered(f), lambda o: let(blocks_of(o), swept))))


def scan_licenses(docs: DataFrame, text_col: str = "text", rules: list[Signature] | None = None) -> DataFrame:
    """``docs`` with spaced words, the base phrases' places and the rules' detections.

    New columns (called alike, they are replaced): ``n_words``, ``phrases`` (struct by label of n, first, last) and
    ``licenses`` (detections by start). Null and empty texts have no words and no detections. Each row stands for itself. Time goes with the text's
    length and, with a small factor, its number of detections, so very long texts full of them are no worse than many short ones.
    """
    rules = signatures() if rules is None else rules
    docs = docs.drop("n_words", "phrases", "licenses", "_spaced", "_found")
    out = docs.withColumn("_spaced", spaced_words(F.col(text_col)))
    spaced = F.col("_spaced")
    out = out.withColumns(
        {
            "n_words": F.when(spaced == "  ", F.lit(0).cast("long")).otherwise(_spaces(spaced) - 1),
            "phrases": F.struct(*[phrase_places(spaced, p).alias(label) for p, label in BASE_PHRASES]),
            "_found": detections(spaced, rules),
        }
    )
    return out.withColumn("licenses", unsuppressed(F.col("_found"), [r.priority for r in rules])).drop("_spaced", "_found")


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = [label for _, label in BASE_PHRASES]
    at = {label: F.col("phrases")[label] for label in labels}
    base = F.array_compact(F.array(*[F.when(at[x]["n"] > 0, F.lit(x)) for x in labels]))
    return scan_licenses(docs).select(
        "doc_id",
        "n_words",
        sum((at[x]["n"] for x in labels[1:]), at[labels[0]]["n"]).alias("n_base"),
        F.least(*[at[x]["first"] for x in labels]).alias("first_word"),
        F.greatest(*[at[x]["last"] for x in labels]).alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.transform("licenses", lambda d: d["label"]))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("licenses", lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
