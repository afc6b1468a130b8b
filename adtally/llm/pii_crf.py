"""Personal data: fixed patterns, and a linear-chain conditional random field over word shapes that adds to them.

1. Texts are cut into tokens (runs of letters, runs of digits, single signs)
   on the bytes of a batch.  A token is known by its shape, by whether white
   space stands before it, and by itself if it is one of the model's cue words.
2. The field scores a chain of labels (none, or begin and inside of each
   kind) by the shapes up to three tokens around and by neighbouring labels.
   It is trained by its likelihood, with forward and backward sums, on a small
   labelled table.
3. Chains are lines, cut at sentence ends.  A bound tells which of them can't hold
   anything; the others are decoded by Viterbi, a step for all chains at once.
4. Spans of the fixed patterns stay as they are.  A span of the field is added
   if it overlaps none of them and passes its kind's check.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from adtally.llm.fill_middle import slices, text_bytes
from adtally.llm.pii_examples import KINDS, examples
from adtally.llm.staging import ship

#: Bound of the labelled rows that a model is trained from.
TRAIN_ROWS = 5_000
#: Bytes of texts that are handled together, and from which on a long text is cut at a line's end.
SLICE_BYTES = 1 << 20
#: Tokens from which on a chain is cut between two plain words.
CHAIN = 256
REACH, MOST_CUES = 3, 64
ROUNDS, RATE, DECAY = 150, 0.15, 2e-4

LABELS = 1 + 2 * len(KINDS)  # 0 is none, 2k + 1 begins kind k, 2k + 2 continues it
SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"
LABELLED = "text string, spans array<struct<kind:string,start:int,end:int>>"

_SPACE, _LINE, _LOWER, _UPPER, _DIGIT, _HIGH, _SIGN = range(7)
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[[*range(33), 127]] = _SPACE
_CLASS[10] = _LINE
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = _LOWER, _UPPER, _DIGIT, _HIGH
_RUN = np.array([0, 1, 2, 2, 3, 2, 4], np.uint8)  # classes of one run
#: Shapes: 0 nothing, 1 line end, 2-17 letters by case and length, 18-31 digits by length, from 32 on signs; cues follow.
_WORD_SIZES, _NUMBER_SIZES = np.array([2, 4, 8]), np.array([2, 3, 4, 5, 6, 7, 9, 11, 12, 13, 16, 17, 20])
_SHAPES = 32 + 96
_CODES = 2 * (_SHAPES + MOST_CUES)

_LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_GLUED = re.compile(rb"[A-Za-z0-9\x80-\xff]")
_NAME, _OPEN, _CLOSE = rb"[a-z0-9\x80-\xff_%+-]+", rb" ?[\[({<] ?", rb" ?[\])}>] ?"
_DOT = rb"(?:\.| \. | dot |" + _OPEN + rb"(?:dot|\.)" + _CLOSE + rb")"
#: How a span of the field has to be written, by kind.
_WRITTEN = (
    re.compile(
        _NAME + rb"(?:" + _DOT + _NAME + rb")*(?:(?:@| @ |" + _OPEN + rb"(?:at|@)" + _CLOSE + rb")(?:" + _NAME + _DOT + rb")+| at (?:" + _NAME + rb" dot )+)[a-z]{2,}",
        re.IGNORECASE,
    ),
    re.compile(rb"[0-9]+(?:(?: \. [0-9]+){3}|(?:" + _OPEN + rb"\." + _CLOSE + rb"[0-9]+){3}|(?: dot [0-9]+){3}|(?:\.[0-9]+){3})", re.IGNORECASE),
    re.compile(rb"[0-9](?:[ ./_-]{0,3}[0-9])+"),
    re.compile(rb"[+(]?[0-9]+(?:[ ()./-]{1,3}[0-9]+)+"),
)
_NOT_DIGIT = bytes(c for c in range(256) if not 48 <= c <= 57)


# ---------------------------------------------------------------- fixed patterns


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(span: bytes) -> bytes:
    return span.translate(None, _NOT_DIGIT)


def _emails(text: bytes, at: np.ndarray) -> Iterator[tuple[int, int]]:
    done = 0
    for place in at.tolist():
        width = 64
        while True:
            floor = max(done, place - width)
            low = floor + len(text[floor:place].rstrip(_LOCAL))
            if low > floor or floor == done:
                break
            width *= 2
        found = _DOMAIN.match(text, place + 1) if low < place else None
        if found:
            done = found.end()
            yield low, done


def _chains(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last number of each run of neighbours that are linked."""
    edges = np.flatnonzero(~linked)
    return np.concatenate([[0], edges + 1]), np.append(edges, len(linked))


def base_spans(text: bytes, data: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in bytes, of texts joined by line ends: leftmost matches of each kind that pass its check."""
    out = [(a, 0, b) for a, b in _emails(text, np.flatnonzero(data == 64))]
    digits = np.flatnonzero((data >= 48) & (data <= 57))
    if not len(digits):
        return out
    gap = np.diff(digits)
    between = data[np.minimum(digits[:-1] + 1, len(data) - 1)]
    first, last = _chains(gap == 1)
    starts, ends = digits[first], digits[last] + 1
    dotted = (starts[1:] == ends[:-1] + 1) & (data[np.minimum(ends[:-1], len(data) - 1)] == 46)
    for a, b in zip(*(x.tolist() for x in _chains(dotted)), strict=True):
        for i in range(a, b - 2, 4):
            parts = [text[starts[j] : ends[j]].lstrip(b"0") for j in range(i, i + 4)]
            if all(len(x) <= 3 and int(x or b"0") <= 255 for x in parts):
                out.append((int(starts[i]), 1, int(ends[i + 3])))
    first, last = _chains((gap == 1) | ((gap == 2) & ((between == 32) | (between == 45))))
    fits = (last - first >= 11) & (last - first <= 18)
    for a, b in zip(digits[first[fits]].tolist(), digits[last[fits]].tolist(), strict=True):
        if luhn(_digits(text[a : b + 1])):
            out.append((a, 2, b + 1))
    for place in np.flatnonzero(data == 43).tolist():
        found = _PHONE.match(text, place)
        if found and 9 <= len(_digits(found.group())) <= 15:
            out.append((place, 3, found.end()))
    return out


# ---------------------------------------------------------------- tokens


@dataclass
class Tokens:
    """Tokens of some bytes: where they begin and end, their shapes, whether one is glued to the token before it."""

    start: np.ndarray
    end: np.ndarray
    shape: np.ndarray
    glued: np.ndarray
    word: np.ndarray  # of runs of at most 8 ASCII letters: their bytes, lower-cased, as a number; else 0

    def codes(self, cues: np.ndarray) -> np.ndarray:
        shape = self.shape.copy()
        if len(cues):
            place = np.minimum(np.searchsorted(cues, self.word), len(cues) - 1)
            cue = (cues[place] == self.word) & (self.word > 0)
            shape[cue] = _SHAPES + place[cue]
        return shape * 2 + self.glued


def tokens(data: np.ndarray) -> Tokens:
    kind = _CLASS[data]
    run = _RUN[kind]
    begins = (run > 0) & ((run == 1) | (run == 4))
    begins[:1] |= run[:1] > 0
    begins[1:] |= (run[1:] > 0) & (run[1:] != run[:-1])
    start = np.flatnonzero(begins)
    if not len(start):
        none = np.empty(0, np.int64)
        return Tokens(none, none, none, none, none.astype(np.uint64))
    size = np.add.reduceat((run > 0).astype(np.int32), start)  # white space may follow a token, nothing else
    upper = np.add.reduceat((kind == _UPPER).astype(np.int32), start)
    end, first = start + size, kind[start]
    glued = np.zeros(len(start), np.int64)
    glued[1:] = end[:-1] == start[1:]
    case = np.where(upper == 0, 0, np.where(upper == size, 2, np.where((upper == 1) & (first == _UPPER), 1, 3)))
    shape = 2 + 4 * case + np.searchsorted(_WORD_SIZES, size, side="right")
    shape = np.where(first == _DIGIT, 18 + np.searchsorted(_NUMBER_SIZES, size, side="right"), shape)
    shape = np.where(first == _SIGN, 32 + data[start].astype(np.int64) - 32, shape)
    shape = np.where(first == _LINE, 1, shape)
    word = np.zeros(len(start), np.uint64)
    short = np.flatnonzero((size <= 8) & ((first == _LOWER) | (first == _UPPER)))
    for i in range(8):
        here = short[size[short] > i]
        word[here] |= (data[start[here] + i] | 0x20).astype(np.uint64) << np.uint64(8 * i)
    return Tokens(start, end, shape.astype(np.int64), glued, word)


def packed_word(word: str) -> int:
    return int.from_bytes(word.lower().encode()[:8], "little")


def _around(codes: np.ndarray) -> Iterator[np.ndarray]:
    """Codes of the tokens at distance -REACH to REACH; 0 beyond the ends."""
    padded = np.concatenate([np.zeros(REACH, np.int64), codes, np.zeros(REACH, np.int64)])
    for i in range(2 * REACH + 1):
        yield padded[i : i + len(codes)]


# ---------------------------------------------------------------- the field


def _allowed() -> np.ndarray:
    """Which label may follow which: an inside one follows its own kind only."""
    ok = np.ones((LABELS, LABELS), bool)
    for k in range(len(KINDS)):
        ok[:, 2 * k + 2] = False
        ok[[2 * k + 1, 2 * k + 2], 2 * k + 2] = True
    return ok


@dataclass(frozen=True)
class Field:
    """Weights of a trained field; those of label 0 are taken off the others."""

    cues: np.ndarray
    unary: np.ndarray  # distance, code, label
    steps: np.ndarray  # label, next label
    first: np.ndarray

    def scores(self, codes: np.ndarray) -> np.ndarray:
        out = np.zeros((len(codes), LABELS), np.float32)
        for weights, around in zip(self.unary, _around(codes), strict=True):
            out += weights[around]
        return out

    def open_chains(self, scores: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Chains in which some other labelling may beat the empty one.

        A span's gain is at most that of its first token, the best in the chain,
        plus the gains of all tokens inside that are above 0.  Where that is
        below 0 no span pays.
        """
        begin, inside = [2 * k + 1 for k in range(len(KINDS))], [2 * k + 2 for k in range(len(KINDS))]
        none = self.steps[0, 0]
        into = max(float((self.steps[:, begin] - none).max()), float((self.first[begin] - self.first[0]).max()))
        out = max(0.0, float((self.steps[1:, 0] - none).max()))
        on = float((self.steps[:, inside] - none).max())
        best = np.maximum.reduceat(scores[:, begin].max(axis=1), starts) + into + out
        more = np.add.reduceat(np.maximum(scores[:, inside].max(axis=1) + on, 0), starts)
        return best + more >= 0

    def decoded(self, scores: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Best labels of all tokens by Viterbi, one step for all chains; tokens of no chain get 0."""
        order = np.argsort(-sizes, kind="stable")
        starts, sizes = starts[order], sizes[order]
        longest = int(sizes[0]) if len(sizes) else 0
        live = np.searchsorted(-sizes, -np.arange(longest), side="left")  # chains with more than so many tokens
        back = np.zeros(scores.shape, np.uint8)
        best = self.first + scores[starts] if longest else np.empty((0, LABELS))
        ended = []
        for step in range(1, longest):
            many = live[step]
            ended.append(best[many:])
            best = best[:many]
            reached, by = best[:, :1] + self.steps[0], np.zeros((many, LABELS), np.uint8)
            for i in range(1, LABELS):
                other = best[:, i : i + 1] + self.steps[i]
                better = other > reached
                reached = np.where(better, other, reached)
                by[better] = i
            here = starts[:many] + step
            back[here] = by
            best = reached + scores[here]
        final = np.concatenate([best, *reversed(ended)]) if longest else best
        labels, now = np.zeros(len(scores), np.uint8), final.argmax(axis=1).astype(np.uint8)
        for step in range(longest - 1, -1, -1):
            many = live[step]
            here = starts[:many] + step
            labels[here] = now[:many]
            now[:many] = back[here, now[:many]]
        return labels


def _tagged(text: str, spans: list[tuple[str, int, int]]) -> tuple[Tokens, np.ndarray]:
    """Tokens of a text and their labels; spans are in code points."""
    raw = text.encode()
    found = tokens(np.frombuffer(raw, np.uint8))
    labels = np.zeros(len(found.start), np.int64)
    for kind, start, end in spans:
        if kind in KINDS:
            a, b = len(text[:start].encode()), len(text[:end].encode())
            inside = np.flatnonzero((found.start >= a) & (found.end <= b))
            labels[inside] = 2 * KINDS.index(kind) + 2
            labels[inside[:1]] -= 1
    return found, labels


def fitted(rows: list[tuple[str, list[tuple[str, int, int]]]], rounds: int = ROUNDS) -> Field:
    """A field of greatest likelihood, with decaying weights, by Adam; the same rows give the same field."""
    tagged = [x for x in (_tagged(*row) for row in rows) if len(x[1])]
    words, counts = np.unique(np.concatenate([[np.uint64(0)], *(np.unique(t.word) for t, _ in tagged)]), return_counts=True)
    often = np.lexsort((words, -counts))
    cues = np.sort(words[[i for i in often if counts[i] >= 4 and words[i]][:MOST_CUES]])
    longest, many = max((len(y) for _, y in tagged), default=0), len(tagged)
    codes = np.zeros((2 * REACH + 1, many, longest), np.int64)
    truth, inside = np.zeros((many, longest), np.int64), np.zeros((many, longest), bool)
    for i, (found, labels) in enumerate(tagged):
        for d, around in enumerate(_around(found.codes(cues))):
            codes[d, i, : len(labels)] = around
        truth[i, : len(labels)], inside[i, : len(labels)] = labels, True
    ok = _allowed()
    weights = [np.zeros((2 * REACH + 1, _CODES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros(LABELS)]
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in weights]
    can_begin = np.array([1.0, *[1.0, 0.0] * len(KINDS)])
    seen = np.eye(LABELS)[truth] * inside[..., None]
    pairs = inside[:, 1:]
    seen_steps = np.zeros((LABELS, LABELS))
    np.add.at(seen_steps, (truth[:, :-1][pairs], truth[:, 1:][pairs]), 1)
    for at in range(1, rounds + 1 if many else 1):
        unary, steps, first = weights
        scores = sum(unary[d][codes[d]] for d in range(2 * REACH + 1))
        local = np.exp(scores - scores.max(axis=2, keepdims=True))
        move = np.exp(steps) * ok
        ahead, behind, scale = np.zeros_like(local), np.ones_like(local), np.ones((many, longest))
        now = local[:, 0] * np.exp(first) * can_begin
        for t in range(longest):
            if t:
                now = np.where(inside[:, t, None], (ahead[:, t - 1] @ move) * local[:, t], ahead[:, t - 1])
            scale[:, t] = now.sum(axis=1)
            ahead[:, t] = now / scale[:, t, None]
        for t in range(longest - 2, -1, -1):
            back = (behind[:, t + 1] * local[:, t + 1]) @ move.T / scale[:, t + 1, None]
            behind[:, t] = np.where(inside[:, t + 1, None], back, 1.0)
        share = ahead * behind * inside[..., None]
        share /= np.maximum(share.sum(axis=2, keepdims=True), 1e-300)
        share *= inside[..., None]
        carried = behind[:, 1:] * local[:, 1:] / scale[:, 1:, None] * pairs[..., None]
        expected_steps = np.einsum("nti,ntj->ij", ahead[:, :-1], carried) * move
        wrong = (share - seen).reshape(-1, LABELS)
        slope = np.zeros_like(unary)
        for d in range(2 * REACH + 1):
            np.add.at(slope[d], codes[d].ravel(), wrong)
        for k, grad in enumerate((slope, expected_steps - seen_steps, (share - seen)[:, 0].sum(axis=0))):
            grad = grad / many + DECAY * weights[k]
            a, b = moments[k]
            a *= 0.9
            a += 0.1 * grad
            b *= 0.99
            b += 0.01 * grad * grad
            weights[k] = weights[k] - RATE * (a / (1 - 0.9**at)) / (np.sqrt(b / (1 - 0.99**at)) + 1e-8)
    unary, steps, first = weights
    never = np.float32(-1e4)
    return Field(cues, (unary - unary[:, :, :1]).astype(np.float32), np.where(ok, steps, never).astype(np.float32), np.where(can_begin > 0, first, never).astype(np.float32))


def labelled_table(spark: SparkSession) -> DataFrame:
    """The library's own small labelled table."""
    return spark.createDataFrame(examples(), LABELLED)


def train(labelled: DataFrame, most_rows: int = TRAIN_ROWS) -> Field:
    """A field from ``text, spans`` (kind, start and end in code points); rows without a text are passed over.

    Of more than ``most_rows`` rows, those with the smallest hashes of their texts are
    taken.  Without any row nothing is ever found.
    """
    rows = labelled.where("text is not null").select("text", "spans").orderBy(F.xxhash64("text"), "text").limit(most_rows).collect()
    return fitted([(r["text"], [(s["kind"], s["start"], s["end"]) for s in r["spans"] or [] if s]) for r in rows])


# ---------------------------------------------------------------- spans


def _chain_starts(found: Tokens, codes: np.ndarray) -> np.ndarray:
    """First tokens of chains: behind line ends, at words with a capital behind the end of a sentence, and between plain words of long chains."""
    many = len(codes)
    begins = np.zeros(many, bool)
    begins[:1] = True
    line = found.shape == 1
    begins[1:] |= line[:-1]
    mark = np.isin(found.shape, [32 + ord(c) - 32 for c in ".!?"])
    capital = (found.shape >= 6) & (found.shape < 18)
    begins[1:] |= mark[:-1] & (found.glued[:-1] == 1) & capital[1:] & (found.glued[1:] == 0)
    starts = np.flatnonzero(begins)
    sizes = np.diff(np.append(starts, many))
    if (sizes > CHAIN).any():
        plain = (codes >= 2 * 3) & (codes < 2 * 6) & (found.glued == 0)
        between = np.flatnonzero(plain[1:] & plain[:-1]) + 1
        more = []
        for start, size in zip(starts[sizes > CHAIN].tolist(), sizes[sizes > CHAIN].tolist(), strict=True):
            at = start + CHAIN
            while (i := int(np.searchsorted(between, at))) < len(between) and between[i] < start + size:
                more.append(int(between[i]))
                at = more[-1] + CHAIN
        starts = np.union1d(starts, np.array(more, np.int64))
    return starts


def _passes(kind: int, text: bytes, start: int, end: int) -> bool:
    """A span of the field has to be written in full: nothing but its kind's parts, and no letter or digit glued to it."""
    span = text[start:end]
    if not _WRITTEN[kind].fullmatch(span) or _GLUED.match(text[start - 1 : start]) or _GLUED.match(text[end : end + 1]):
        return False
    digits = _digits(span)
    if kind == 1:
        return all(len(x) <= 3 and int(x) <= 255 for x in re.findall(rb"[0-9]+", span))
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    return kind == 0 or 9 <= len(digits) <= 15


def field_spans(field: Field, text: bytes, data: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in bytes of what the field finds and its kind's check lets pass."""
    found = tokens(data)
    if not len(found.start):
        return []
    codes = found.codes(field.cues)
    scores = field.scores(codes)
    starts = _chain_starts(found, codes)
    sizes = np.diff(np.append(starts, len(codes)))
    scores[found.shape == 1, 1:] = -1e4
    live = field.open_chains(scores, starts)
    labels = field.decoded(scores, starts[live], sizes[live])
    out = []
    begin = np.flatnonzero(labels % 2 == 1)
    apart = np.append(np.flatnonzero((labels == 0) | (labels % 2 == 1)), len(labels))
    after = apart[np.searchsorted(apart, begin, side="right")]
    for label, a, b in zip(labels[begin].tolist(), found.start[begin].tolist(), found.end[after - 1].tolist(), strict=True):
        if _passes((label - 1) // 2, text, a, b):
            out.append((a, (label - 1) // 2, b))
    return out


_PLAIN_GAP = re.compile(rb"[a-z] (?=[a-z])")


def pieces(text: bytes) -> Iterator[tuple[int, int]]:
    """Spans of a long text that are handled apart: cut behind a line's end, or between two words in lower case."""
    start = 0
    while len(text) - start > 2 * SLICE_BYTES:
        line = text.find(b"\n", start + SLICE_BYTES, start + 2 * SLICE_BYTES)
        gap = None if line >= 0 else _PLAIN_GAP.search(text, start + SLICE_BYTES)
        stop = line + 1 if line >= 0 else gap.end() if gap else len(text)
        yield start, stop
        start = stop
    yield start, len(text)


def _spans_of(field: Field, texts: list[bytes]) -> list[list[tuple[int, int, int, bool]]]:
    """``(start, kind, end, fixed)`` in code points for each text, in order."""
    held = b"\n".join(texts)
    data = np.frombuffer(held, np.uint8)
    bounds = np.cumsum([0, *(len(x) + 1 for x in texts)])
    fixed = base_spans(held, data)
    busy = sorted((a, b) for a, _, b in fixed)
    firsts, ends = np.array([a for a, _ in busy], np.int64), np.maximum.accumulate(np.array([b for _, b in busy], np.int64)) if busy else np.empty(0, np.int64)
    more = []
    for a, kind, b in field_spans(field, held, data):
        before = int(np.searchsorted(firsts, b))  # patterns that begin before the span's end
        if not before or ends[before - 1] <= a:
            more.append((a, kind, b))
    out: list[list[tuple[int, int, int, bool]]] = [[] for _ in texts]
    if fixed or more:
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        for spans, known in ((fixed, True), (more, False)):
            for a, kind, b in spans:
                row = int(np.searchsorted(bounds, a, side="right")) - 1
                zero = points[bounds[row]]
                out[row].append((int(points[a] - zero), kind, int(points[b] - zero), known))
    return out


def _of_batch(field: Field, texts: pa.Array) -> pa.Array:
    rows: list[list[tuple[int, int, int, bool]]] = []
    for low, high in slices(texts, SLICE_BYTES):
        bounds, data = text_bytes(texts.slice(low, high - low))
        raw = [data[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        if len(raw) > 1 or len(raw[0]) <= 2 * SLICE_BYTES:
            rows += _spans_of(field, raw)
            continue
        spans, zero = [], 0
        for a, b in pieces(raw[0]):
            part = raw[0][a:b]
            spans += [(s + zero, kind, e + zero, known) for s, kind, e, known in _spans_of(field, [part])[0]]
            zero += len(part.decode("utf-8", "replace"))
        rows.append(spans)
    flat = [x for row in rows for x in sorted(row)]
    columns = [pa.array([KINDS[k] for _, k, _, _ in flat], pa.string()), pa.array([a for a, _, _, _ in flat], pa.int64())]
    columns += [pa.array([b for _, _, b, _ in flat], pa.int64()), pa.array([known for *_, known in flat], pa.bool_())]
    spans = pa.StructArray.from_arrays(columns, ["kind", "start", "end", "base"])
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), spans)


def found(docs: DataFrame, field: Field, text_column: str = "text", name: str = "pii") -> DataFrame:
    """``docs`` with the personal data of each whole text: kind, start, end (code points) and whether a fixed pattern gave it.

    Spans are in order of start and kind.  A null or empty text has an empty list.  A
    column of that name is replaced; other columns and repeated rows stay.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(field)  # weights of a fixed number of codes

    @F.arrow_udf(SPANS)
    def spans(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _of_batch(model.value, texts)

    kept = [F.col(f"`{c}`") for c in docs.columns if c != name]
    return docs.select(*kept, spans(F.col(f"`{text_column}`").cast("string")).alias(name))


def written(spans: Column) -> Column:
    """Spans as ``kind:start:end``, joined by commas."""
    return F.concat_ws(",", F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
