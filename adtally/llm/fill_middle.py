"""Fill-in-the-middle examples by displacement: every byte of a batch moves by a shift found with difference arrays.

1. A scan over the bytes of a batch marks where units begin (a run of A-Z and
   a-z, or any other single character); counts by block find the two cuts.
2. A difference array holds the changes of the shift at the starts of prefix,
   middle and suffix.  Its running sum is each byte's way to its place in the
   output, and one scatter builds the outputs of all texts of the batch.
3. To restore, the marks of an output are found again, and a gather along the
   inverse shifts gives the text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.llm.staging import ship

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes of texts that are handled together (a longer text alone), and bytes whose shifts are held at a time.
SLICE_BYTES, CHUNK = 4 << 20, 1 << 20
#: Units are counted in blocks of so many bytes.
BLOCK = 4096

RESULT = "n long, form string, prefix_chars long, middle_chars long, output string"

_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123)]] = True


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of the texts and their UTF-8 bytes; null counts as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, bounds, data = texts.buffers()
    at = np.frombuffer(bounds, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and data.size else np.empty(0, np.uint8)
    return at - at[0], held


def as_texts(bounds: np.ndarray, data: np.ndarray) -> pa.Array:
    made = pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(np.ascontiguousarray(bounds, np.int64)), pa.py_buffer(data))
    return made.cast(pa.string())


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Spans of rows whose texts have about ``most`` bytes together, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
        yield start, stop
        start = stop


class Units:
    """Where units begin in the bytes of some texts: rank and selection by counts of blocks."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray):
        letter = _LETTER[data]
        self.starts = (data & 0xC0) != 0x80
        self.starts[1:] &= ~(letter[1:] & letter[:-1])
        self.starts[bounds[:-1][np.diff(bounds) > 0]] = True
        counts = np.add.reduceat(self.starts, np.arange(0, len(data), BLOCK), dtype=np.int64) if len(data) else np.empty(0, np.int64)
        self.before = np.concatenate([[0], np.cumsum(counts)])

    def rank(self, at: int) -> int:
        """Units that begin before the byte."""
        block = at // BLOCK
        return int(self.before[block]) + int(np.count_nonzero(self.starts[block * BLOCK : at]))

    def place(self, rank: int) -> int:
        """Byte at which the unit of that rank begins."""
        block = int(np.searchsorted(self.before, rank, side="right")) - 1
        own = self.starts[block * BLOCK : (block + 1) * BLOCK]
        return block * BLOCK + int(np.flatnonzero(own)[rank - int(self.before[block])])


def shifts(points: np.ndarray, values: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """The shift of each byte, in chunks ``(start, stop, shift)``: ``values`` hold from ``points`` on, which ascend.

    Of values at one point the last one holds.
    """
    steps = np.diff(values, prepend=0)
    carry, low = 0, 0
    for start in range(0, size, CHUNK):
        stop = min(start + CHUNK, size)
        high = int(np.searchsorted(points, stop))
        change = np.zeros(stop - start, np.int64)
        np.add.at(change, points[low:high] - start, steps[low:high])
        change[0] += carry
        shift = np.cumsum(change)
        carry, low = int(shift[-1]), high
        yield start, stop, shift


def displaced(bounds: np.ndarray, data: np.ndarray, forms: list[str], cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds and bytes of the outputs; ``cuts`` are the bytes at which middle and suffix of each text begin."""
    start, end = bounds[:-1], bounds[1:]
    form = np.array(forms, object)
    plain, spm = form == PLAIN, form == SPM
    sizes = end - start + np.where(plain, 0, 9)
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    base = out_bounds[:-1]
    prefix, middle, suffix = cuts[:, 0] - start, cuts[:, 1] - cuts[:, 0], end - cuts[:, 1]
    to_prefix = np.where(plain, base, np.where(spm, base + 6 + suffix, base + 3))
    to_middle = np.where(plain, base + prefix, base + 9 + prefix + suffix)
    to_suffix = np.where(plain, base + prefix + middle, np.where(spm, base + 3, base + 6 + prefix))
    points = np.stack([start, cuts[:, 0], cuts[:, 1]], axis=1)
    values = np.stack([to_prefix, to_middle, to_suffix], axis=1) - points
    out = np.empty(out_bounds[-1], np.uint8)
    for low, high, shift in shifts(points.ravel(), values.ravel(), len(data)):
        out[np.arange(low, high) + shift] = data[low:high]
    for mark, at in ((PREFIX, to_prefix), (MIDDLE, to_middle), (SUFFIX, to_suffix)):
        out[(at[~plain, None] - 3) + np.arange(3)] = np.frombuffer(mark, np.uint8)
    return out_bounds, out


def regained(bounds: np.ndarray, data: np.ndarray, forms: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds and bytes of the texts behind outputs, and which of them aren't outputs of their form."""
    form = np.array(forms, object)
    plain, spm = form == PLAIN, form == SPM
    rows = len(form)
    marks = np.zeros((rows, 3), np.int64)  # bytes behind the marks of prefix, suffix and middle
    seen = np.zeros((rows, 3), np.int64)
    hits = np.flatnonzero((data[:-2] == 60) & (data[2:] == 62)) if len(data) > 2 else np.empty(0, np.int64)
    of = np.searchsorted(bounds, hits, side="right") - 1
    for kind, mark in enumerate((PREFIX, SUFFIX, MIDDLE)):
        own = (data[hits + 1] == mark[1]) & ~plain[of] & (hits + 3 <= bounds[of + 1])
        np.add.at(seen[:, kind], of[own], 1)
        marks[of[own], kind] = hits[own] + 3
    first, second = np.where(spm, marks[:, 1], marks[:, 0]), np.where(spm, marks[:, 0], marks[:, 1])
    good = plain | (((form == PSM) | spm) & (seen == 1).all(axis=1) & (first == bounds[:-1] + 3) & (first + 3 <= second) & (second + 3 <= marks[:, 2]))
    first_size, second_size, middle = second - 3 - first, marks[:, 2] - 3 - second, bounds[1:] - marks[:, 2]
    prefix, suffix = np.where(spm, second_size, first_size), np.where(spm, first_size, second_size)
    whole = bounds[1:] - bounds[:-1]
    sizes = np.where(good, np.where(plain, whole, prefix + middle + suffix), 0)
    out_bounds = np.concatenate([[0], np.cumsum(sizes)])
    base, moved = out_bounds[:-1], good & ~plain
    points = np.stack([base, base + np.where(moved, prefix, 0), base + np.where(moved, prefix + middle, 0)], axis=1)
    origin = np.where(moved[:, None], marks[:, [0, 2, 1]], bounds[:-1, None])
    origin[:, 1:] = np.where(moved[:, None], origin[:, 1:], origin[:, :1] + points[:, 1:] - points[:, :1])
    out = np.empty(out_bounds[-1], np.uint8)
    for low, high, shift in shifts(points.ravel(), (origin - points).ravel(), len(out)):
        out[low:high] = data[np.arange(low, high) + shift]
    return out_bounds, out, ~good


def _made(texts: pa.Array, draws: np.ndarray, plain_from: int, spm_below: int) -> pa.StructArray:
    bounds, data = text_bytes(texts)
    held = texts.cast(pa.large_string())
    marked = np.diff(bounds) == 0
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= pc.fill_null(pc.match_substring(held, mark.decode()), False).to_numpy(zero_copy_only=False)
    units = Units(data, bounds)
    ranks = [units.rank(int(x)) for x in bounds]
    counts, forms, sizes = np.diff(ranks), [], np.zeros((len(texts), 2), np.int64)
    cuts = np.repeat(bounds[:-1, None], 2, axis=1)
    for i, (count, draw) in enumerate(zip(counts.tolist(), draws.tolist(), strict=True)):
        if marked[i] or draw[2] % 100 >= plain_from:
            forms.append(PLAIN)
            continue
        forms.append(SPM if draw[3] % 100 < spm_below else PSM)
        for k, cut in enumerate(sorted((draw[0] % (count + 1), draw[1] % (count + 1)))):
            cuts[i, k] = units.place(ranks[i] + cut) if cut < count else bounds[i + 1]
        for k, (low, high) in enumerate(((bounds[i], cuts[i, 0]), (cuts[i, 0], cuts[i, 1]))):
            sizes[i, k] = np.count_nonzero((data[low:high] & 0xC0) != 0x80)
    outputs = as_texts(*displaced(bounds, data, forms, cuts))
    plain = np.array(forms, object) == PLAIN
    chars = [pa.array(sizes[:, k], pa.int64(), mask=plain) for k in (0, 1)]
    return pa.StructArray.from_arrays([pa.array(counts, pa.int64()), pa.array(forms, pa.string()), *chars, outputs], ["n", "form", "prefix_chars", "middle_chars", "output"])


def _joined(parts: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def _draws(id_column: str, seed: int) -> list[Column]:
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def transformed(docs: DataFrame, text_column: str = "text", id_column: str = "doc_id", seed: int = 1, plain_percent: int = 10, spm_percent: int = 20) -> DataFrame:
    """``docs`` with ``n, form, prefix_chars, middle_chars, output``; columns of those names are replaced.

    The draws are the first four 8-digit groups of the SHA-256 of seed and id:
    two cuts, whether the text stays plain, and the order of the parts.  A
    null text counts as empty; empty texts and those that hold a mark stay
    plain.  A null id is drawn like an empty one; repeated rows and rows of
    one id get the same draws.  The whole text is in the output.
    """
    ship(docs.sparkSession)

    @F.arrow_udf(RESULT)
    def made(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, *draws in batches:
            drawn = np.stack([x.to_numpy(zero_copy_only=False) for x in draws], axis=1)
            parts = [_made(texts.slice(a, b - a), drawn[a:b], 100 - plain_percent, spm_percent) for a, b in slices(texts)]
            yield _joined(parts, pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())]))

    new = [x.split()[0] for x in RESULT.split(", ")]
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    rows = docs.select(*kept, made(F.col(f"`{text_column}`").cast("string"), *_draws(f"`{id_column}`", seed)).alias("__made"))
    return rows.select(*kept, *[F.col(f"__made.{c}").alias(c) for c in new])


def restored(outputs: DataFrame, output_column: str = "output", form_column: str = "form", name: str = "restored") -> DataFrame:
    """``outputs`` with the text behind each output, from output and form alone; a column ``name`` is replaced.

    Null where the output hasn't the marks of its form once each and in
    order, or the form isn't known; a null output counts as empty.
    """
    ship(outputs.sparkSession)

    @F.arrow_udf("string")
    def texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for made, forms in batches:
            parts = []
            for a, b in slices(made):
                bounds, data, bad = regained(*text_bytes(made.slice(a, b - a)), forms.slice(a, b - a).to_pylist())
                found = as_texts(bounds, data)
                parts.append(pc.if_else(pa.array(bad), pa.scalar(None, pa.string()), found) if bad.any() else found)
            yield _joined(parts, pa.string())

    kept = [F.col(f"`{c}`") for c in outputs.columns if c != name]
    return outputs.select(*kept, texts(F.col(f"`{output_column}`").cast("string"), F.col(f"`{form_column}`")).alias(name))
