"""Base places, detections and suppression against plain versions."""

import random
import re

import pytest

from adtally.llm import licenses
from adtally.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_base(text):
    words = WORD.findall((text or "").translate(LOWER))
    places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    starts = [i for i, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


def plain_labels(text):
    """All rules tried on the whole text, then dropped one by one if they lie within another."""
    form = " " + " ".join(WORD.findall((text or "").translate(LOWER))) + " "
    found = []
    for rule in licenses.signatures():
        for m in re.finditer(rf"(?<= ){rule['pattern']}(?= )", form):
            first = form[: m.start()].count(" ") - 1
            found.append((first, first + m.group().count(" ") + 1, rule["strength"], rule["number"], rule["label"], rule["confidence"]))
    kept = []
    for x in found:
        inside = [
            y for y in found
            if y is not x and x[2] >= 0 and 0 <= y[2] <= x[2] and y[0] <= x[0] and y[1] >= x[1] and ((y[1] - y[0], -y[2], -y[3]) > (x[1] - x[0], -x[2], -x[3]))
        ]
        if not inside:
            kept.append(x)
    return ",".join(sorted({x[4] for x in kept})), max((x[5] for x in kept), default=0.0)


def digest(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.digest(licenses.scan(rows)).collect()}


def compare(found, texts):
    for i, text in enumerate(texts):
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(text), text[:100]
        assert (r.labels, r.score) == plain_labels(text), text[:100]


TEXTS = [
    "Licensed under the Apache License, Version 2.0.",
    "MIT license mit License MIT\nLICENSE; cc by cc by cc-by-nc-sa 4.0",
    "SPDX-License-Identifier: GPL-3.0-or-later and the GNU General Public License version 2",
    "released under the terms of the GNU Lesser General Public License, see the terms of the BSD 3-clause license",
    "Mit freundlichen Grüßen, der Apache", "apaсhe license", "the mitlicense", "", None, "Apache\x00License", "É license MİT License K",
    "The Unlicense licence. Creative Commons Attribution ShareAlike 4.0 International License",
    "mit license " * 400,
]


def test_hand_made(spark):
    compare(digest(spark, TEXTS), TEXTS)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_texts(spark, seed):
    draw = random.Random(seed)
    words = "the mit license licence apache gnu general public gpl version 2 0 3 cc by nc sa under terms of licensed released spdx identifier bsd clause lesser x".split()
    texts = [draw.choice([" ", ", ", "-"]).join(draw.choice(words) for _ in range(draw.randrange(0, 60))) for _ in range(250)]
    compare(digest(spark, texts), texts)


def test_small_table(spark, root, texts):
    found = {r.doc_id: r for r in QUERIES["op10_license_scan"](spark, root).collect()}
    assert len(found) == len(texts)
    for doc, text in texts.items():
        r = found[doc]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == plain_base(text)
        assert (r.labels, r.score) == plain_labels(text)


def test_odd_rows(odd_docs, no_docs):
    rows = licenses.digest(licenses.scan(odd_docs)).collect()
    assert len(rows) == odd_docs.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[None].base_labels == "mit" and by_id[9].base_labels == "gpl,mit"
    assert by_id[3].n_words == by_id[4].n_words == by_id[5].n_words == 0 and by_id[3].labels == ""
    assert licenses.scan(no_docs).count() == 0


def test_no_python_in_the_plan(spark, root):
    plan = QUERIES["op10_license_scan"](spark, root)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "CartesianProduct", "NestedLoop"))


def test_hundreds_of_rules():
    rules = licenses.signatures()
    assert len(rules) > 300 and len({r["number"] for r in rules}) == len(rules)
    for rule in rules:
        re.compile(rule["pattern"])


WORDINGS = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\")": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that": "bsd",
    "This module is MIT-licensed.": "mit", "Licence: GPLv2 or later": "gpl-2.0", "under LGPLv3": "lgpl-3.0", "you may not use this file except in compliance with the License.": "apache-2.0",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that": "isc",
    "This is free and unencumbered software released into the public domain.": "unlicense", "All rights reserved.": "proprietary",
}


def test_wordings_have_their_labels(spark):
    docs = spark.createDataFrame(list(enumerate(WORDINGS)), "doc_id long, text string")
    found = {r.doc_id: r.labels.split(",") for r in licenses.digest(licenses.scan(docs)).collect()}
    for i, label in enumerate(WORDINGS.values()):
        assert label in found[i], (i, found[i])


def test_every_wording_holds_its_keyword():
    """The prefilter may not pass over a text that the rule would match: each alternative has the keyword as a word."""
    import re

    for _, keyword, _, pattern in licenses.GRANTS:
        for part in pattern.split("|") if "(" not in pattern else [pattern]:
            assert re.search(rf"(?<![a-z0-9]){keyword}(?![a-z0-9])", part), (keyword, part)
