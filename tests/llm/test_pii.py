"""Personal data: fixed patterns against the regular expressions, decoding against brute force, held-out accuracy."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from adtally.llm import pii_crf
from adtally.llm.pii_examples import KINDS, examples
from adtally.llm.queries import QUERIES

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(x) <= 255 for x in span.split("."))
    if kind == "card":
        each = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(x - 9 * (x > 9) for x in each) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def plain_base(text):
    spans = [(m.start(), KINDS.index(kind), m.end()) for kind, p in PATTERNS.items() for m in re.finditer(p, text or "") if valid(kind, m.group())]
    return [(KINDS[k], a, b) for a, k, b in sorted(spans)]


@pytest.fixture(scope="module")
def field():
    return pii_crf.fitted(examples())


def spans_of(field, texts):
    return [[(KINDS[k], a, b, known) for a, k, b, known in sorted(row)] for row in pii_crf._spans_of(field, [t.encode() for t in texts])]


ODD = [
    "", "@", "a@b.c", "a@b@c.de.", "a@@b.c", "x@-.-", "a.b@c..d", "1.2.3", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "0001.0.0.0255 1.1.1.1", "9999999.1.1.1",
    "4111 1111 1111 1111", "4111-1111 1111-1111 4111 1111 1111 1111", "4111  1111 1111 1111", "+1 (743) 555-3824", "++1 23-", "+12", "+1 2 +3456789012",
    "+1 (826) 555-4081 190.137.223.20", "é+49 30 1234567é", "ü@x.y z🙂a@b.cd", "1" * 5000, "1." * 3000, "a" * 3000 + "@" + "b" * 3000, "+" + "1 " * 2000, "a@b.c\n@d.e f@g.h@i.j",
]


def test_fixed_patterns_equal_the_expressions(field):
    draw = random.Random(7)
    pieces = ["a", "@", ".", "1", "22", "333", "4444", " ", "-", "+", "(", ")", "é", "\n", "4111 1111 1111 1111", "x@y.z", "1.2.3.4", "+1 (743) 555-3824", "256"]
    given = [*ODD, *("".join(draw.choice(pieces) for _ in range(draw.randrange(40))) for _ in range(2500))]
    for text, found in zip(given, spans_of(field, given), strict=True):
        assert [(k, a, b) for k, a, b, known in found if known] == plain_base(text), text
    for text in given[:40]:  # alone as among others
        assert spans_of(field, [text]) == [spans_of(field, given)[given.index(text)]]


def test_decoding_equals_brute_force(field):
    draw = np.random.default_rng(2)
    sizes = np.array([1, 4, 3, 4, 2])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    scores = draw.normal(0, 3, (int(sizes.sum()), pii_crf.LABELS)).astype(np.float32)
    scores[:, 0] = 0
    labels = field.decoded(scores, starts, sizes)
    for start, size in zip(starts, sizes, strict=True):
        def value(path, start=start):
            moves = sum(float(field.steps[a, b]) for a, b in itertools.pairwise(path))
            return float(field.first[path[0]]) + moves + sum(float(scores[start + i, y]) for i, y in enumerate(path))

        best = max(itertools.product(range(pii_crf.LABELS), repeat=int(size)), key=value)
        assert tuple(labels[start : start + size]) == best


def test_chains_passed_over_hold_nothing(field, texts):
    data = np.frombuffer("\n".join(t or "" for t in texts.values()).encode(), np.uint8)
    found = pii_crf.tokens(data)
    codes = found.codes(field.cues)
    scores = field.scores(codes)
    starts = pii_crf._chain_starts(found, codes)
    sizes = np.diff(np.append(starts, len(codes)))
    live = field.open_chains(scores, starts)
    assert 0 < live.sum() < len(live)
    assert not field.decoded(scores, starts[~live], sizes[~live]).any()


def test_likelihood_rises(field):
    """Trained weights must prefer the given labels: their score is near the best one's for nearly all rows."""
    right = 0
    rows = examples()
    for text, spans in rows:
        found, labels = pii_crf._tagged(text, spans)
        got = field.decoded(field.scores(found.codes(field.cues)), np.array([0]), np.array([len(labels)]))
        right += (got == labels).all()
    assert right >= 0.95 * len(rows)


def test_held_out_examples(field):
    good = missed = extra = 0
    for text, spans in examples(2, seed=99):
        got = {(k, a, b) for k, a, b, _ in spans_of(field, [text])[0]}
        good, missed, extra = good + len(got & set(spans)), missed + len(set(spans) - got), extra + len(got - set(spans))
    assert good / (good + missed) >= 0.85 and good / (good + extra) >= 0.95


def test_what_the_field_adds(field):
    added = lambda text: [(k, text[a:b]) for k, a, b, known in spans_of(field, [text])[0] if not known]
    assert added("call (743) 555-3824 now") == [("phone", "(743) 555-3824")]
    assert added("write to anna (at) heron (dot) com today") == [("email", "anna (at) heron (dot) com")]
    assert added("card 4111.1111.1111.1111 was charged") == [("card", "4111.1111.1111.1111")]
    assert added("card 4111.1111.1111.1112 was charged") == []
    assert added("the server 10 . 0 . 200 . 7 was down") == [("ip", "10 . 0 . 200 . 7")]


def test_clean_texts_stay_clean(field, texts):
    clean = [t for t in texts.values() if t and not plain_base(t) and not re.search(r"[0-9]{4}", t)]
    assert len(clean) > 50
    assert not any(spans_of(field, clean))


def test_long_texts_are_cut_between_spans(spark, field, monkeypatch):
    monkeypatch.setattr(pii_crf, "SLICE_BYTES", 200)
    lines = "some é words here and there call (743) 555-3824 now. Mail x@y.zz\n" * 30
    flat = "some é words here and more words call (743) 555-3824 now mail x@y.zz then " * 30
    for text in (lines, flat):
        raw = text.encode()
        spans = list(pii_crf.pieces(raw))
        assert len(spans) > 3 and b"".join(raw[a:b] for a, b in spans) == raw
        import pyarrow as pa

        found = pii_crf._of_batch(field, pa.array([None, text, "a@b.c"])).to_pylist()
        assert found[0] == [] and len(found[2]) == 1
        assert [(x["kind"], x["start"], x["end"]) for x in found[1] if x["base"]] == plain_base(text)
        assert sum(not x["base"] for x in found[1]) == 30


def test_odd_tables(spark, odd_docs, no_docs, field):
    docs = odd_docs.withColumnRenamed("label", "pii")  # a column of the result's name is replaced
    rows = pii_crf.found(docs, field).collect()
    assert len(rows) == odd_docs.count() and rows[0].asDict().keys() == set(docs.columns)
    for r in rows:
        assert [(x["kind"], x["start"], x["end"]) for x in r["pii"] if x["base"]] == plain_base(r["text"])
    assert pii_crf.found(no_docs, field).collect() == []


def test_training_tables(spark):
    table = pii_crf.labelled_table(spark)
    assert table.count() == len(examples())
    nothing = pii_crf.train(table.limit(0))
    assert not any(spans_of(nothing, ["call (743) 555-3824 now"])[0])
    odd = spark.createDataFrame([(None, None), ("", []), ("a b", None), ("Tel 12", [None, ("other", 0, 3)])], pii_crf.LABELLED)
    assert not any(spans_of(pii_crf.train(odd), ["Tel 12"])[0])


def test_query(spark, root, texts):
    rows = QUERIES["op12_pii_crf"](spark, root).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain_base(texts[r.doc_id])
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in KINDS]
        written = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r.base_sha256 == hashlib.sha256(",".join(written).encode()).hexdigest()
        assert set(written) <= set(r.spans.split(",")) | {""}
