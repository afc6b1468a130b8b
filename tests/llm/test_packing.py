"""Packing against the tokenizer itself, and the plan against best fit piece by piece."""

import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from adtally.llm import packing
from adtally.llm.tokens import WordEncoder, encoded

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


ODD = [
    None, "", " ", "Don't STOP it's 'tis we'll d'a", "a<|endoftext|>b <|ENDOFTEXT|>", "İstanbul ΣΑΣ naïve—x, “q” ét́, x y \x1c z\x85w",
    "123 4a5 a1 a1! café! é? 中文字 字! ñ.", "≮ a≠ ǅ ß ẞ ﬁ ª º² K Å", "́a b́ ,́ a,́", "a\x00b \x01 c", "x " * 300,
]


def test_word_encoder_equals_the_tokenizer(tokenizer, texts):
    encoder = WordEncoder(PATH)
    given = [*ODD, *list(texts.values())[:120]]
    for _ in range(2):  # the second time all words are known
        ids, bounds = encoder.encode(pa.array(given, pa.string()))
        for i, text in enumerate(given):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == ids_of(tokenizer, text)[:-1]
    for start in (1, 20, 77):  # slices of a longer column
        ids, bounds = encoder.encode(pa.array(given, pa.string()).slice(start, 30))
        for i, text in enumerate(given[start : start + 30]):
            assert ids[bounds[i] : bounds[i + 1]].tolist() == ids_of(tokenizer, text)[:-1]


def test_words_are_encoded_once(monkeypatch):
    """A task with very many different words gives each to the tokenizer once."""
    words = ["".join(chr(97 + i // 26**k % 26) for k in range(4)) for i in range(160_000)]
    given, plain = [], WordEncoder._ids
    monkeypatch.setattr(WordEncoder, "_ids", lambda self, new, letters: given.extend(new) or plain(self, new, letters))
    texts = [" ".join(words[i : i + 1000]) for i in range(0, len(words), 1000)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])] * 3
    found = [ids for _, ids, _ in encoded(iter(batches), PATH)]
    assert len(given) == len(set(given)) == len(words)
    assert np.array_equal(found[0], found[-1])


def check(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_small_table(spark, root, tokenizer, texts):
    capacity = 512
    rows = packing.pack(spark.read.parquet(f"{root}/documents.parquet"), PATH, capacity).collect()
    used = check(rows, capacity)
    assert used <= -(-sum(r.length for r in rows) // capacity) * 1.02 + 1
    pieces = {}
    for r in rows:
        pieces.setdefault(r.doc_id, {})[r.piece] = r
    for doc, text in texts.items():
        ids = ids_of(tokenizer, text)
        assert sorted(pieces[doc]) == list(range(-(-len(ids) // capacity)))
        for n, r in pieces[doc].items():
            own = ids[n * capacity : (n + 1) * capacity]
            assert (r.start, r.length, r.ids_crc32) == (n * capacity, len(own), zlib.crc32(np.array(own, "<u4").tobytes()))


def test_sequences_hold_the_ids(spark, tokenizer, texts):
    rows = spark.createDataFrame(list(texts.items())[:40], "doc_id long, text string")
    found = packing.sequences(rows, PATH, 256).collect()
    got = {}
    for r in found:
        assert len(r.ids) <= 256
        for p in r["pieces"]:
            got.setdefault(p.doc_id, {})[p.piece] = r.ids[p.offset : p.offset + p.length]
    for doc, text in list(texts.items())[:40]:
        assert [i for _, piece in sorted(got[doc].items()) for i in piece] == ids_of(tokenizer, text)


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_best_fit(seed):
    """As many sequences as best fit that places piece by piece, the longest first."""
    draw = random.Random(seed)
    counts = {}
    for _ in range(600):
        n = draw.randrange(1, 65)
        counts[n] = counts.get(n, 0) + draw.randrange(1, 5)
    rooms = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [i for i, free in enumerate(rooms) if free >= length]
            if fits:
                rooms[min(fits, key=lambda i: rooms[i])] -= length
            else:
                rooms.append(64 - length)
    used = set()
    spans = {}
    for length, rank, ranks, sequence, each, offset in packing.plan(counts, 64):
        for k in range(ranks):
            spans.setdefault(sequence + k // each, []).append((offset + k % each * length, length))
        used |= {sequence + k // each for k in range(ranks)}
    for places in spans.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) == len(rooms)


def test_odd_rows(odd_docs, no_docs):
    rows = packing.pack(odd_docs, PATH).collect()
    check(rows, 4096)
    short = {r.doc_id: r for r in rows if r.doc_id in (3, 4, 5)}
    assert all(r.length == 1 for r in short.values()) and len(short) == 3
    assert sum(r.doc_id == 2 for r in rows) == 2 and sum(r.doc_id is None for r in rows) == 1
    assert packing.pack(no_docs, PATH).count() == 0


def test_hot_length_is_cut_into_slices(spark):
    """One length with all rows: ranks are gapless although no task numbers them all."""
    rows = spark.range(5000).selectExpr("id", "cast(0 as int) piece", "0L start", "10L length", "7L ids_crc32")
    found = packing.packed(rows, 4096, rows_per_slice=300).collect()
    assert check(found, 4096) == -(-5000 // 409)
