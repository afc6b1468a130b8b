"""Token ids of whole texts by a public tokenizer file, with a store of word encodings in each task."""

from __future__ import annotations

import functools
import itertools
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from adtally.llm.staging import release_unused, trim

#: ASCII signs that never continue a word in front of them; the apostrophe may.
_SIGNS = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'
_WORD_END = "</w>"
#: Words kept during a task; beyond it the store starts anew.
KEPT_WORDS = 300_000


class WordEncoder:
    """Ids of a tokenizer that drops white space, lower-cases and never merges across words.

    Such a tokenizer gives a text the ids of its white-space-separated chunks
    in a row.  Chunks repeat, so each distinct one is encoded once and kept.
    A chunk made of letters and ASCII signs after them is split there, as the
    tokenizer does.  Texts that may hold a special token go to the tokenizer
    whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # words come here once; the model's own cache would only cost time
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(_WORD_END)]] = True
        self.specials = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self._clear()

    def _clear(self) -> None:
        self.place: dict[str, int] = {"": 0}
        self.first, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.store = np.zeros(1 << 18, "<u4")
        self.used, self.filled = 1, 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")

    def _ids(self, words: list[str], letters: bool) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words in a row, and how many each has.

        Words of letters are encoded as one text, where each ends with the one
        token that marks a word's end.
        """
        if letters:
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(words) and ends[-1] == len(ids):
                return ids, np.diff(ends, prepend=0)
        each = [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]
        return np.array([i for x in each for i in x], "<u4"), np.fromiter(map(len, each), np.int64, len(each))

    def _known(self, words: pa.Array, letters: np.ndarray) -> np.ndarray:
        """Places of distinct words in the store, which takes in the new ones."""
        names = words.to_numpy(zero_copy_only=False).tolist()
        places = np.fromiter(map(self.place.get, names, itertools.repeat(-1)), np.int64, len(names))
        for kind in (True, False):
            new = np.flatnonzero((places < 0) & (letters == kind))
            for start in range(0, len(new), 1000):
                part = new[start : start + 1000]
                words_ = [names[i] for i in part.tolist()]
                ids, lengths = self._ids(words_, kind)
                places[part] = np.arange(self.used, self.used + len(part))
                self.place.update(zip(words_, places[part].tolist(), strict=True))
                self._put(ids, lengths)
        return places

    def _put(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(lengths) > len(self.first):
            self.first, self.length = np.resize(self.first, 2 * len(self.first)), np.resize(self.length, 2 * len(self.length))
        while self.filled + len(ids) > len(self.store):
            self.store = np.resize(self.store, 2 * len(self.store))
        span = slice(self.used, self.used + len(lengths))
        self.first[span] = self.filled + np.cumsum(lengths) - lengths
        self.length[span] = lengths
        self.store[self.filled : self.filled + len(ids)] = ids
        self.used, self.filled = self.used + len(lengths), self.filled + len(ids)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and the bounds of each text's ids."""
        texts = texts.take(pa.array(np.arange(len(texts))))  # a copy without offset: some functions misread slices
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        special = np.zeros(len(texts), bool)
        for content in self.specials:
            special |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        direct = {int(i): self.whole(texts[int(i)].as_py()) for i in np.flatnonzero(special)}
        if direct:
            texts = pc.if_else(pa.array(special), "", texts)
        if len(self.place) > KEPT_WORDS:
            self._clear()
        parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        bounds = parts.offsets.to_numpy().astype(np.int64)
        chunks = parts.flatten().dictionary_encode()
        at, distinct = chunks.indices.to_numpy().astype(np.int64), chunks.dictionary
        core = pc.ascii_rtrim(distinct, characters=_SIGNS)
        letters = pc.utf8_is_alpha(core).to_numpy(zero_copy_only=False)
        core = pc.if_else(pa.array(letters), core, distinct)
        tail = _tails(distinct, core)
        words, signs = core.dictionary_encode(), tail.dictionary_encode()
        own = np.zeros(len(words.dictionary), bool)
        own[words.indices.to_numpy()] = letters
        first = self._known(words.dictionary, own)[words.indices.to_numpy()]
        second = self._known(signs.dictionary, np.zeros(len(signs.dictionary), bool))[signs.indices.to_numpy()]
        # Segments in the order of the texts: a word's letters, then its signs.
        segments = np.stack([first[at], second[at]], axis=1).ravel()
        sizes = self.length[segments]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.store[np.repeat(self.first[segments] - ends[:-1], sizes) + np.arange(ends[-1])]
        bounds = ends[2 * bounds]
        if direct:
            pieces = [direct.get(i, ids[bounds[i] : bounds[i + 1]]) for i in range(len(texts))]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in pieces])]).astype(np.int64)
            ids = np.concatenate(pieces)
        return ids, bounds


def _text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)


def _tails(whole: pa.Array, core: pa.Array) -> pa.Array:
    """What follows ``core`` in ``whole``."""
    at, data = _text_bytes(whole)
    sizes = np.diff(at) - np.diff(_text_bytes(core)[0])
    ends = np.concatenate([[0], np.cumsum(sizes)])
    out = data[np.repeat(at[1:] - ends[1:], sizes) + np.arange(ends[-1])]
    return pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(out)))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def encoded(batches: Iterator[pa.RecordBatch], path: str, rows: int = 500) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each slice of a batch (text in its last column) with the ids of its texts.

    Words of a slice are looked up once; Arrow batches are bounded by bytes (``staging.ship``), and slices by rows.
    The store of words goes at the end: workers live on, and the memory is other tasks' then.
    """
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield part, *encoder(path).encode(part.column(part.num_columns - 1))
            trim()  # the tokenizer leaves many small holes
    encoder.cache_clear()
    release_unused()
