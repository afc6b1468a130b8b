"""Fill-in-the-middle against a plain version on odd and random texts."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from adtally.llm import fill_middle
from adtally.llm.queries import QUERIES
from adtally.llm.sql import SQL
from tests.oracle import differences

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.DOTALL)
ODD = [None, "", "a", "<", "<P", "a<P>b", "x<S>", "<M>", "ab<", "S>cd ef", "é", "日本 語x", "a\x00b\nc", "🙂🙂 ok 🙂", " \t\n", "abc", "P> <S <", "1234567890"]


def plain_version(doc_id, text, seed=1):
    text = text or ""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
    units = UNIT.findall(text)
    n = len(units)
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h4 % 100 < 20:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def rows_of(df):
    return [(r.doc_id, (r.n, r.form, r.prefix_chars, r.middle_chars, r.output), r.restored) for r in df.collect()]


def test_odd_and_random_texts(spark):
    draw = random.Random(3)
    given = [*ODD * 12, *("".join(draw.choice("abZ<PS>M é🙂\n1") for _ in range(draw.randrange(40))) for _ in range(400))]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(given)], "doc_id long, text string, form string")
    made = fill_middle.restored(fill_middle.transformed(docs))
    found = rows_of(made)
    assert len(found) == len(given) and {f[1] for _, f, _ in found} == {"plain", "psm", "spm"}
    for doc_id, got, back in found:
        assert got == plain_version(doc_id, given[doc_id])
        assert back == (given[doc_id] or "")


@pytest.mark.parametrize(("chunk", "block", "most"), [(7, 16, 1), (64, 4096, 50), (1 << 20, 8, 1 << 20)])
def test_small_chunks_and_slices(monkeypatch, chunk, block, most):
    monkeypatch.setattr(fill_middle, "CHUNK", chunk)
    monkeypatch.setattr(fill_middle, "BLOCK", block)
    draw = random.Random(5)
    given = ["".join(draw.choice("abZ é🙂\n1") for _ in range(draw.randrange(90))) for _ in range(60)]
    texts = pa.array(["skipped", *given], pa.string()).slice(1)  # a slice of a longer column
    draws = np.array([[draw.randrange(1 << 32) for _ in range(4)] for _ in given])
    spans = list(fill_middle.slices(texts, most))
    assert [a for a, _ in spans[1:]] == [b for _, b in spans[:-1]] and spans[-1][1] == len(given)
    for a, b in spans:
        part = texts.slice(a, b - a)
        made = fill_middle._made(part, draws[a:b], 90, 20)
        bounds, data, bad = fill_middle.regained(*fill_middle.text_bytes(made.field("output")), made.field("form").to_pylist())
        assert not bad.any() and fill_middle.as_texts(bounds, data).to_pylist() == given[a:b]


def test_a_long_text_in_several_chunks(spark):
    long = "word é, <x> " * 400_000
    docs = spark.createDataFrame([(i, long) for i in range(3)], "doc_id long, text string")
    for doc_id, got, back in rows_of(fill_middle.restored(fill_middle.transformed(docs))):
        assert got == plain_version(doc_id, long) and back == long


def test_outputs_that_fit_no_form_give_null(spark):
    rows = [("psm", "<P>a<S>b"), ("psm", "x<P>a<S>b<M>c"), ("spm", "<P>a<S>b<M>c"), (None, "a"), ("odd", "a"), ("plain", None), ("psm", "<P>a<S>b<M>c<M>"), ("psm", "<P>a<S>b<M>c")]
    made = fill_middle.restored(spark.createDataFrame(rows, "form string, output string"))
    assert [r.restored for r in made.collect()] == [None, None, None, None, None, "", None, "acb"]


def test_odd_tables(spark, odd_docs, no_docs):
    made = fill_middle.transformed(odd_docs)
    assert set(odd_docs.columns) < set(made.columns)
    texts = {(r.doc_id, r.text) for r in odd_docs.collect()}
    for r in fill_middle.restored(made).collect():
        assert (r.doc_id, r.text) in texts
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_version(r.doc_id, r.text) and r.restored == (r.text or "")
    assert fill_middle.restored(fill_middle.transformed(no_docs)).collect() == []


def test_query_equals_sql(spark):
    assert differences(spark, QUERIES["op11_fill_middle"], SQL["op11_fill_middle"], "/root/testdata/sf0.01") is None
