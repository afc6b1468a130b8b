"""Ranked search against scoring every document, and the bounds themselves."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from adtally.llm import pair_maxscore
from adtally.llm.queries import QUERIES
from adtally.llm.sql import SQL
from tests.oracle import differences

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x.group().lower(), text or ""))


def plain_ranking(docs, items, k):
    """Rows ``(item, rank, doc, score)`` by scoring all documents."""
    counts = [(i, Counter(words(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    many, length = len(counts), sum(c.total() for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        terms, scores = set(words(text)), []
        for i, c in counts:
            m = 50 + 50 * c.total() * many // length
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in terms if t in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, rank, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out, key=str)


def frames(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def found(spark, docs, items, k, **options):
    return sorted((tuple(r) for r in pair_maxscore.ranked(*frames(spark, docs, items), k=k, **options).collect()), key=str)


def random_case(seed, many, repeats=0):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["é1", "日本", "ÄB", "x²"]
    text = lambda n: " ".join(vocabulary[min(int(draw.expovariate(0.08)), len(vocabulary) - 1)] for _ in range(n))
    docs = [(i, text(draw.randrange(1, 60))) for i in range(many)]
    docs += [(many + i, docs[0][1]) for i in range(repeats)]
    return docs, [(i, text(draw.randrange(1, 25))) for i in range(12)]


@pytest.mark.parametrize(("seed", "many", "repeats", "k"), [(1, 700, 0, 10), (2, 300, 300, 50), (3, 40, 0, 50)])
def test_equals_scoring_all_documents(spark, monkeypatch, seed, many, repeats, k):
    docs, items = random_case(seed, many, repeats)
    assert found(spark, docs, items, k) == plain_ranking(docs, items, k)


def test_several_passes(spark):
    docs, items = random_case(4, 200)
    assert found(spark, docs, items, 7, terms_per_pass=30) == plain_ranking(docs, items, 7)


@pytest.mark.parametrize("block", [4, 32])
def test_groups_pruning_and_pair_bounds(monkeypatch, block):
    """Bounds hold for every document, pairs are tighter than terms, and pruned search finds what full search does."""
    monkeypatch.setattr(pair_maxscore, "BLOCK", block)
    draw = np.random.default_rng(block)
    many, terms = 500, 40
    tf = draw.poisson(0.4, (many, terms)) * (draw.random((many, terms)) < np.linspace(0.9, 0.02, terms))
    doc, term = np.nonzero(tf)
    weights = draw.integers(1, 6000, terms)
    m = draw.integers(50, 300, many)
    queries = [draw.choice(terms, draw.integers(1, 20), replace=False).tolist() for _ in range(25)]
    pairs, units = pair_maxscore.paired(queries, (tf > 0).sum(axis=0))
    own = pair_maxscore.Pass(tuple(queries), pairs, tuple(units), weights, np.zeros(25, np.int64), 10)
    group = pair_maxscore.Group(own, np.arange(many), m, doc, term, tf[doc, term])
    impact = weights * (10**9 * tf // (1000 * tf + 20 * m[:, None]))
    tighter = 0
    for number, (a, b) in enumerate(pairs, terms):
        both = (impact[:, a] + impact[:, b]).max()
        assert group.pair_most[number].max() == both
        tighter += both < impact[:, a].max() + impact[:, b].max()
    assert tighter
    for query, unit in zip(queries, units, strict=True):
        scores = impact[:, query].sum(axis=1)
        _, bounds = group.bounds_of(unit)
        assert (bounds.sum(axis=0)[np.arange(many) // block] >= scores).all()
        kth = np.sort(scores)[-10]
        for least in (1, int(kth), int(kth) + 1):
            docs, got = group.best(unit, least, 10)
            assert (got == scores[docs]).all()
            must = np.flatnonzero(scores >= max(least, int(kth), 1))
            assert set(must) <= set(docs.tolist())


def test_long_texts_are_counted_whole(monkeypatch):
    monkeypatch.setattr(pair_maxscore, "WINDOW", 10)
    for text in ("Abc déf " * 50, "x" * 300, "", " ,", "a" * 11 + " b"):
        assert pair_maxscore.term_counts(text.encode()) == Counter(w.encode() for w in words(text))


def test_odd_tables(spark, odd_docs, no_docs):
    docs = [(r.doc_id, r.text) for r in odd_docs.collect()]
    items = [(1, "The MIT license, of a long text!"), (1, "lazy DOG"), (None, "word17 word18 nothing"), (2, None), (3, ""), (4, "absent")]
    asked = spark.createDataFrame([(*x, "clash", 1) for x in items], "item_id long, text string, score string, rank int")
    got = sorted((tuple(r) for r in pair_maxscore.ranked(odd_docs, asked, k=3).collect()), key=str)
    assert got == plain_ranking(docs, items, 3)
    assert pair_maxscore.ranked(no_docs, asked).collect() == []
    assert pair_maxscore.ranked(odd_docs, asked.limit(0)).collect() == []


def test_query_equals_sql(spark):
    assert differences(spark, QUERIES["op13_pair_maxscore"], SQL["op13_pair_maxscore"], "/root/testdata/sf0.01") is None
