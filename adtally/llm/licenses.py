"""License scans: ordered signature rules with a keyword prefilter, in DataFrame operations only.

A text is brought to its words, lower-cased and joined by single spaces.  A
signature is a regular expression over that form.  It is tried only on texts
that hold the keyword of its license and the keyword of its kind.  Of
overlapping detections, one that lies within another of the same or a stronger
kind is dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from adtally.llm.staging import staged

WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Phrases of the base rules and their labels.
BASE = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: Licenses: label, keyword (a word that all its signatures hold), and its name as a pattern over words.
LICENSES = [
    ("apache-2.0", "apache", r"apache(?: software)?(?: license)?(?: version| v)? v?2(?: 0)?"),
    ("apache-1.1", "apache", r"apache(?: software)?(?: license)?(?: version| v)? v?1 1"),
    ("apache", "apache", r"apache(?: software)?"),
    ("mit", "mit", r"mit(?: x11| expat)?"),
    ("mit-0", "mit", r"mit(?: no attribution| 0)"),
    ("gpl-2.0", "gpl", r"(?:gnu )?gpl(?: version| v)? v?2(?: 0)?"),
    ("gpl-3.0", "gpl", r"(?:gnu )?gpl(?: version| v)? v?3(?: 0)?"),
    ("gpl", "gpl", r"(?:gnu )?gpl"),
    ("gpl-2.0", "gnu", r"gnu general public license(?: version| v) 2(?: 0)?"),
    ("gpl-3.0", "gnu", r"gnu general public license(?: version| v) 3(?: 0)?"),
    ("gpl", "gnu", r"gnu general public"),
    ("lgpl-2.1", "lgpl", r"(?:gnu )?lgpl(?: version| v)? v?2 1"),
    ("lgpl-3.0", "lgpl", r"(?:gnu )?lgpl(?: version| v)? v?3(?: 0)?"),
    ("lgpl", "lesser", r"gnu lesser general public"),
    ("agpl-3.0", "agpl", r"(?:gnu )?agpl(?: version| v)? v?3(?: 0)?"),
    ("agpl", "affero", r"gnu affero general public"),
    ("bsd-2-clause", "bsd", r"(?:bsd 2 clause|2 clause bsd|simplified bsd)"),
    ("bsd-3-clause", "bsd", r"(?:bsd 3 clause|3 clause bsd|new bsd|modified bsd|revised bsd)"),
    ("bsd", "bsd", r"bsd(?: style)?"),
    ("mpl-1.1", "mpl", r"mpl(?: version| v)? 1 1"),
    ("mpl-2.0", "mpl", r"mpl(?: version| v)? 2(?: 0)?"),
    ("mpl", "mozilla", r"mozilla public"),
    ("epl-1.0", "eclipse", r"eclipse public license(?: version| v) 1(?: 0)?"),
    ("epl-2.0", "eclipse", r"eclipse public license(?: version| v) 2(?: 0)?"),
    ("epl", "eclipse", r"eclipse public"),
    ("cddl", "cddl", r"cddl(?: 1 0| 1 1)?"),
    ("cddl", "distribution", r"common development and distribution"),
    ("isc", "isc", r"isc"),
    ("unlicense", "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl"),
    ("zlib", "zlib", r"zlib(?: libpng)?"),
    ("boost-1.0", "boost", r"boost(?: software)?(?: license)?(?: version| v)?(?: 1 0)?"),
    ("artistic-2.0", "artistic", r"artistic(?: license)?(?: version| v)? v?2 0"),
    ("artistic", "artistic", r"artistic"),
    ("postgresql", "postgresql", r"postgresql"),
    ("python-2.0", "python", r"python(?: software foundation)?"),
    ("php-3.01", "php", r"php(?: license)?(?: version| v)? 3 01"),
    ("ofl-1.1", "ofl", r"(?:sil )?ofl(?: 1 1)?"),
    ("ofl-1.1", "sil", r"sil open font"),
    ("eupl-1.2", "eupl", r"eupl(?: version| v)?(?: 1 1| 1 2)?"),
    ("ms-pl", "microsoft", r"microsoft public"),
    ("cc0-1.0", "cc0", r"cc0(?: 1 0)?"),
    ("cc-by-4.0", "cc", r"cc by 4 0"),
    ("cc-by-3.0", "cc", r"cc by 3 0"),
    ("cc-by-sa", "cc", r"cc by sa(?: 2 0| 2 5| 3 0| 4 0)?"),
    ("cc-by-nc", "cc", r"cc by nc(?: 2 0| 2 5| 3 0| 4 0)?"),
    ("cc-by-nd", "cc", r"cc by nd(?: 2 0| 2 5| 3 0| 4 0)?"),
    ("cc-by-nc-sa", "cc", r"cc by nc sa(?: 2 0| 2 5| 3 0| 4 0)?"),
    ("cc-by-nc-nd", "cc", r"cc by nc nd(?: 2 0| 2 5| 3 0| 4 0)?"),
    ("cc-by", "creative", r"creative commons attribution(?: 4 0| 3 0)?(?: international| unported)?"),
    ("cc-by-sa", "creative", r"creative commons attribution share ?alike(?: 4 0| 3 0)?(?: international| unported)?"),
    ("cc-by-nc", "creative", r"creative commons attribution non ?commercial(?: 4 0| 3 0)?(?: international| unported)?"),
    ("odbl-1.0", "odbl", r"odbl(?: 1 0)?"),
    ("odbl-1.0", "database", r"open database"),
    ("gfdl", "gnu", r"gnu free documentation"),
    ("public-domain", "domain", r"public domain"),
    ("proprietary", "proprietary", r"proprietary"),
]

#: Kinds of signatures, the strongest first: keyword (part of a word), confidence, pattern around the name.
KINDS = [
    ("identifier", 1.0, r"spdx license identifier {}(?: only| or later)?"),
    (" under ", 0.95, r"(?:is |are )?(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{}(?: public)?(?: license| licence)?(?: (?:version|v) [0-9]+(?: [0-9]+)?)?"),
    ("licens", 0.9, r"{} license(?: (?:version|v) [0-9]+(?: [0-9]+)?)?"),
    ("licenc", 0.9, r"{} licence(?: (?:version|v) [0-9]+(?: [0-9]+)?)?"),
    ("licens", 0.8, r"license[sd]? {}"),
    (" under ", 0.7, r"under (?:the )?(?:terms of (?:the )?)?{}"),
    (" terms ", 0.6, r"(?:subject to|see|according to) (?:the )?terms (?:and conditions )?of (?:the )?{}"),
]

#: Rules of a wording of their own: label, keyword, confidence, pattern.  Grant texts, notices and joined forms.
GRANTS = [
    ("mit", "hereby", 0.95, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", "substantial", 0.9, r"the above copyright notice and this permission notice (?:including the next paragraph )?shall be included in all copies or substantial portions of the software"),
    ("mit-0", "hereby", 0.95, r"permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("isc", "hereby", 0.95, r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted provided"),
    ("0bsd", "hereby", 0.95, r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee is hereby granted the software"),
    ("bsd", "redistribution", 0.9, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", 0.8, r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", "redistributions", 0.8, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", "neither", 0.9, r"neither the names? of (?:[^ ]+ ){1,12}?may be used to endorse or promote products derived from this software"),
    ("bsd-4-clause", "advertising", 0.9, r"all advertising materials mentioning features or use of this software must display the following acknowledge?ment"),
    ("apache-2.0", "compliance", 0.95, r"you may not use this file except in compliance with the license"),
    ("apache-2.0", "applicable", 0.8, r"unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis"),
    ("gpl", "program", 0.95, r"this program is free software(?: you can redistribute it and or modify it)? under the terms of the gnu general public license"),
    ("gpl", "program", 0.9, r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "library", 0.95, r"this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("lgpl", "lesser", 0.8, r"you should have received a copy of the gnu lesser general public license along with"),
    ("gpl", "received", 0.8, r"you should have received a copy of the gnu general public license along with"),
    ("agpl", "affero", 0.8, r"you should have received a copy of the gnu affero general public license along with"),
    ("mpl-2.0", "mozilla", 0.95, r"this source code form is subject to the terms of the mozilla public license v(?:ersion)? 2 0"),
    ("mpl-1.1", "contents", 0.9, r"the contents of this file are subject to the mozilla public license version 1 1"),
    ("epl", "accompanying", 0.9, r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("cddl", "contents", 0.9, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("unlicense", "unencumbered", 0.95, r"this is free and unencumbered software released into the public domain"),
    ("zlib", "altered", 0.9, r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", "warranty", 0.8, r"this software is provided as is without any express or implied warranty in no event (?:will|shall) the authors? be held liable"),
    ("wtfpl", "verbatim", 0.9, r"everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
    ("boost-1.0", "boost", 0.95, r"distributed under the boost software license version 1 0"),
    ("cc0-1.0", "waived", 0.9, r"has waived all copyright and related or neighboring rights"),
    ("cc0-1.0", "extent", 0.7, r"to the extent possible under law the (?:author|person|associating)"),
    ("postgresql", "hereby", 0.9, r"permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("artistic", "perl", 0.8, r"under the same terms as perl itself"),
    ("artistic", "artistic", 0.9, r"the artistic license preamble"),
    ("gfdl", "document", 0.9, r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("ofl-1.1", "font", 0.95, r"this font software is licensed under the sil open font license"),
    ("ms-pl", "microsoft", 0.9, r"this license governs use of the accompanying software (?:[^ ]+ ){1,40}?microsoft"),
    ("proprietary", "reserved", 0.5, r"all rights reserved"),
    ("proprietary", "confidential", 0.7, r"(?:proprietary and confidential|confidential and proprietary)"),
    ("proprietary", "unauthorized", 0.7, r"unauthorized copying of this file via any medium is strictly prohibited"),
    ("public-domain", "domain", 0.8, r"(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("cc-by", "adapt", 0.7, r"free to share and adapt (?:[^ ]+ ){0,12}?attribution"),
    ("mit", "mit", 0.9, r"mit licensed"),
    ("bsd", "bsd", 0.9, r"bsd licensed"),
    ("apache", "apache", 0.9, r"apache licensed"),
    ("gpl", "gpl", 0.9, r"gpl licensed"),
    ("isc", "isc", 0.9, r"isc licensed"),
    ("gpl-2.0", "gplv2", 0.9, r"gplv2(?: only| or later)?"),
    ("gpl-3.0", "gplv3", 0.9, r"gplv3(?: only| or later)?"),
    ("gpl-2.0", "gpl2", 0.8, r"gpl2"),
    ("gpl-3.0", "gpl3", 0.8, r"gpl3"),
    ("lgpl-2.0", "lgplv2", 0.9, r"lgplv2(?: only| or later)?"),
    ("lgpl-2.1", "lgplv2", 0.95, r"lgplv2 1(?: only| or later)?"),
    ("lgpl-3.0", "lgplv3", 0.9, r"lgplv3(?: only| or later)?"),
    ("agpl-3.0", "agplv3", 0.9, r"agplv3(?: only| or later)?"),
    ("apache-2.0", "alv2", 0.8, r"alv2"),
    ("apache-2.0", "asl", 0.7, r"asl 2 0"),
    ("mpl-2.0", "mplv2", 0.9, r"mplv2(?: 0)?"),
    ("bsd-3-clause", "bsd3", 0.8, r"bsd3"),
    ("cc-by-sa", "ccbysa", 0.8, r"ccbysa"),
]

RULE = "array<struct<number:int,keyword:string,kind:string,strength:int,label:string,confidence:double,pattern:string>>"


def signatures() -> list[dict]:
    """All rules in order: the base phrases, the wordings, and each kind of signature for each license.

    ``strength`` is 0 for the strongest kind, which the wordings are of; -1 marks a base rule.
    """
    rules = [
        {"keyword": phrase.split()[0], "kind": " ", "strength": -1, "label": label, "confidence": 0.5, "pattern": phrase} for phrase, label in BASE
    ]
    rules += [
        {"keyword": keyword, "kind": " ", "strength": 0, "label": label, "confidence": confidence, "pattern": f"(?:{pattern})"} for label, keyword, confidence, pattern in GRANTS
    ]
    for strength, (kind, confidence, around) in enumerate(KINDS):
        for label, keyword, name in LICENSES:
            rules.append({"keyword": keyword, "kind": kind, "strength": strength, "label": label, "confidence": confidence, "pattern": around.replace("{}", f"(?:{name})")})
    return [{"number": i, **rule} for i, rule in enumerate(rules)]


def _rules_column(rules: list[dict]) -> Column:
    """The rules as one constant; they are few and fixed by this file."""
    return F.array(
        *[
            F.struct(
                F.lit(r["number"]).alias("number"), F.lit(r["keyword"]).alias("keyword"), F.lit(r["kind"]).alias("kind"),
                F.lit(r["strength"]).alias("strength"), F.lit(r["label"]).alias("label"), F.lit(r["confidence"]).alias("confidence"),
                F.lit(f"(?<= ){r['pattern']}(?= )").alias("pattern"),
            )
            for r in rules
        ]
    )


def word_form(text: Column) -> Column:
    """`` word word `` with one space around each word; A-Z are lower-cased, other letters are as they are.

    The Kelvin sign and the dotted capital I are the only other letters whose
    lower case holds an ASCII letter; they are put out of the way first.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131"))
    return F.regexp_replace(F.concat(F.lit(" "), F.lower(plain), F.lit(" ")), WORD_BREAK, " ")


def _words(form: Column) -> Column:
    """Words of a part that starts and ends with a space."""
    return F.length(form) - F.length(F.replace(form, F.lit(" "), F.lit(""))) - 1


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", rules: list[dict] | None = None) -> DataFrame:
    """Per document: id, ``n_words`` and ``detections``, an array of structs in the order of their places.

    A detection has the rule's number, label, strength and confidence, its
    first word, its number of words, and whether it was ``kept``.  Base rules
    are always kept and suppress nothing.  Null and empty texts have no word
    and no detection.  Rows that repeat an id are scanned each.
    """
    rules = signatures() if rules is None else rules
    table = _rules_column(rules)
    form = F.col("form")
    keywords = F.array(*[F.lit(k) for k in sorted({r["keyword"] for r in rules})])
    kinds = F.array(*[F.lit(k) for k in sorted({r["kind"] for r in rules})])
    held = docs.select(F.col(id_column).alias("id"), word_form(F.col(text_column).cast("string")).alias("form"))
    held = held.withColumn("keywords", F.filter(keywords, lambda k: F.contains(form, F.concat(F.lit(" "), k, F.lit(" ")))))
    held = held.withColumn("kinds", F.when(F.size("keywords") > 0, F.filter(kinds, lambda k: F.contains(form, k))).otherwise(F.array().cast("array<string>")))
    tried = F.filter(
        table,
        lambda r: F.array_contains(F.col("keywords"), r["keyword"]) & F.array_contains(F.col("kinds"), r["kind"]) & F.regexp_like(form, r["pattern"]),
    )
    places = F.transform(
        tried,
        lambda r: F.struct(
            r["number"].alias("number"),
            F.transform(F.split(form, r["pattern"], -1), _words).alias("between"),
            F.transform(F.regexp_extract_all(form, r["pattern"], F.lit(0)), lambda m: _words(m) + 2).alias("sizes"),
        ),
    )
    empty = "array<struct<number:int,between:array<int>,sizes:array<int>>>"
    found = F.when(F.size("keywords") > 0, places).otherwise(F.array().cast(empty))
    read = staged(held.select("id", _words(form).cast("long").alias("n_words"), found.alias("found"), F.monotonically_increasing_id().alias("row")))

    hit = read.where(F.size("found") > 0).select("row", F.explode("found").alias("f"))
    each = hit.select("row", "f.number", F.posexplode(F.arrays_zip("f.between", "f.sizes")).alias("place", "z"))
    each = each.select("row", "number", "place", F.col("z.between").alias("between"), F.col("z.sizes").alias("size")).repartition("row")
    along = Window.partitionBy("row", "number").orderBy("place")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    first = F.sum("between").over(along) + F.coalesce(F.sum("size").over(before), F.lit(0))
    each = each.withColumn("first", first).where("size is not null").withColumn("end", F.col("first") + F.col("size"))
    rule = F.element_at(table, F.col("number") + 1)
    each = each.withColumns({"label": rule["label"], "strength": rule["strength"], "confidence": rule["confidence"]})

    order = Window.partitionBy("row").orderBy("first", F.desc("end"), "strength", "number")
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    strengths = sorted({r["strength"] for r in rules if r["strength"] >= 0})
    reach = F.lit(None).cast("long")
    for strength in strengths:
        furthest = F.max(F.when(F.col("strength").between(0, strength), F.col("end"))).over(ahead)
        reach = F.when(F.col("strength") == strength, furthest).otherwise(reach)
    each = each.withColumn("reach", reach)
    kept = (F.col("strength") < 0) | F.col("reach").isNull() | (F.col("reach") < F.col("end"))
    detection = F.struct(
        F.col("first").cast("long").alias("first"), F.col("size").cast("long").alias("size"), "number", "label", "strength", "confidence", kept.alias("kept")
    )
    lists = each.groupBy("row").agg(F.sort_array(F.collect_list(detection)).alias("detections"))
    none = F.array().cast(lists.schema["detections"].dataType)
    joined = read.select("row", "id", "n_words").join(lists, "row", "left")
    return joined.select(F.col("id").alias(id_column), "n_words", F.coalesce("detections", none).alias("detections"))


def digest(scanned: DataFrame) -> DataFrame:
    """``scan``'s result with counts and labels in place of the detections.

    ``score`` is the confidence of the strongest detection that was kept, 0
    without any.
    """
    base = F.filter("detections", lambda d: d["strength"] < 0)
    kept = F.filter("detections", lambda d: d["kept"])
    label = lambda found: F.array_join(F.array_sort(F.array_distinct(F.transform(found, lambda d: d["label"]))), ",")
    first = lambda found: F.transform(found, lambda d: d["first"])
    return scanned.select(
        *[c for c in scanned.columns if c != "detections"],
        F.size(base).cast("long").alias("n_base"),
        F.array_min(first(base)).alias("first_word"),
        F.array_max(first(base)).alias("last_word"),
        label(base).alias("base_labels"),
        label(kept).alias("labels"),
        F.coalesce(F.array_max(F.transform(kept, lambda d: d["confidence"])), F.lit(0.0)).alias("score"),
    )
