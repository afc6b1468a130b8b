"""Language identification with hyperdimensional profiles.

A letter is a random vector of +1 and -1 drawn from its code point.  An n-gram
binds its letters: each vector is rotated by the letter's place, and they are
multiplied.  A text is the bundle (sum) of its n-gram vectors, a language the
bundle of its training texts, each scaled to length one.  A text has the
language whose profile has the largest cosine with it.
"""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from adtally.llm.staging import free_names, release_unused, sent_if_small, ship, staged

DIMENSIONS = 1024
LETTERS = 3
UNKNOWN = "und"
#: A text is told if its cosine reaches half of what all but a hundredth of the held-out texts of its language and length reach.
LOW_QUANTILE, MARGIN = 0.01, 0.5
#: Texts are of like length up to so many characters, or beyond the last.
LENGTHS = (16, 32, 64, 128, 256, 1024)
#: So many held-out texts are needed for a bound of a language and length, of a length, and of all texts.
LEAST_HELD, LEAST_OF_LENGTH = 30, 5
#: Code points are handled in runs of this length, so that a long text needs bounded memory.
RUN = 1 << 20
#: n-grams, and texts, that are looked up together.
TOGETHER, TEXTS_TOGETHER = 1 << 18, 256
#: n-gram vectors kept during a task; beyond it the store starts anew.
KEPT_VECTORS = 1 << 16


@functools.cache
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


@functools.lru_cache(maxsize=4096)
def _letter_vector(code: int, dimensions: int) -> np.ndarray:
    return np.random.default_rng([code, dimensions]).integers(0, 2, dimensions, np.int8) * np.int8(2) - np.int8(1)


@functools.lru_cache(maxsize=4096)
def _placed_vector(code: int, place: int, dimensions: int) -> np.ndarray:
    return np.roll(_letter_vector(code, dimensions), place)


class Space:
    """n-gram vectors, made where they are first needed."""

    def __init__(self, dimensions: int, letters: int):
        self.dimensions, self.letters = dimensions, letters
        self.codes = np.empty(0, np.int64)
        self.vectors = np.empty((0, dimensions), np.int8)

    def bound(self, code: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for place in range(self.letters):
            out = out * _placed_vector((code >> 21 * place) & 0x1FFFFF, place, self.dimensions)
        return out

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Vectors of sorted distinct n-grams."""
        new = codes[~self._held(codes)]
        if len(new):
            if len(self.codes) + len(new) > KEPT_VECTORS:
                self.codes, self.vectors = np.empty(0, np.int64), np.empty((0, self.dimensions), np.int8)
                new = codes
            fresh = np.stack([self.bound(int(x)) for x in new])
            at = np.searchsorted(self.codes, new)
            self.codes = np.insert(self.codes, at, new)
            self.vectors = np.insert(self.vectors, at, fresh, axis=0)
        return self.vectors[np.searchsorted(self.codes, codes)]

    def _held(self, codes: np.ndarray) -> np.ndarray:
        if not len(self.codes):
            return np.zeros(len(codes), bool)
        at = np.searchsorted(self.codes, codes)
        return self.codes[np.minimum(at, len(self.codes) - 1)] == codes

    def grams(self, text: str) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
        """Distinct n-grams of each run of the text, how often they occur, and whether the run has a letter.  All of the text counts."""
        carry = np.array([32], np.int64)
        for start in range(0, len(text), RUN):
            points = np.frombuffer(text[start : start + RUN].lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            letter = _is_letter()[points]
            any_letter = bool(letter.any())
            points = np.concatenate([carry, np.where(letter, points, 32)])
            last = start + RUN >= len(text)
            points = np.append(points, 32) if last else points
            points = points[np.r_[True, (points[1:] != 32) | (points[:-1] != 32)]]
            carry = points[-(self.letters - 1) :]
            codes = sum(points[i : max(0, len(points) - self.letters + 1) + i] << 21 * i for i in range(self.letters))
            yield *np.unique(codes, return_counts=True), any_letter

    def bundles(self, texts: Iterable[str | None]) -> Iterator[np.ndarray | None]:
        """The texts' vectors in order; None for a text without any letter.  Texts are handled some at a time, as most n-grams are common to them."""
        totals, letters, runs, size = [], [], [], 0
        for text in texts:
            totals.append(np.zeros(self.dimensions, np.float64))
            letters.append(False)
            for codes, counts, any_letter in self.grams(text or ""):
                letters[-1] |= any_letter
                runs.append((len(totals) - 1, codes, counts))
                size += len(codes)
                if size >= TOGETHER:
                    self._add(totals, runs)
                    runs, size = [], 0
            if not runs or len(totals) >= TEXTS_TOGETHER:
                self._add(totals, runs)
                yield from (total if any_letter else None for total, any_letter in zip(totals, letters, strict=True))
                totals, letters, runs, size = [], [], [], 0
        self._add(totals, runs)
        yield from (total if any_letter else None for total, any_letter in zip(totals, letters, strict=True))

    def _add(self, totals: list[np.ndarray], runs: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        """Adds the runs' n-grams to the totals.  Sums of whole numbers below 2^24 are exact in any order."""
        if not runs:
            return
        distinct, place = np.unique(np.concatenate([codes for _, codes, _ in runs]), return_inverse=True)
        row = np.repeat(np.arange(len(runs)), [len(codes) for _, codes, _ in runs])
        counts = np.concatenate([counts for _, _, counts in runs])
        for i in range(0, len(distinct), 4096):
            part = distinct[i : i + 4096]
            own = (place >= i) & (place < i + len(part))
            table = np.zeros((len(runs), len(part)), np.float32)
            table[row[own], place[own] - i] = counts[own]
            for (text, _, _), total in zip(runs, table @ self.of(part).astype(np.float32), strict=True):
                totals[text] += total

    def bundle(self, text: str | None) -> np.ndarray | None:
        """One text's vector."""
        return next(self.bundles([text]))


@functools.lru_cache(maxsize=2)
def space(dimensions: int, letters: int) -> Space:
    return Space(dimensions, letters)


@dataclass(frozen=True)
class Profiles:
    """Unit vectors of the languages, in order of their names."""

    languages: tuple[str, ...]
    vectors: np.ndarray
    dimensions: int
    letters: int

    def judged(self, texts: Iterator[str | None]) -> tuple[list[str], np.ndarray]:
        own = space(self.dimensions, self.letters)
        names, scores = [], []
        vectors = own.bundles(texts) if self.languages else (None for _ in texts)
        for vector in vectors:
            length = 0.0 if vector is None else float(np.linalg.norm(vector))
            if not length:
                names.append(UNKNOWN if vector is None else self.languages[0])
                scores.append(0.0)
                continue
            cosines = self.vectors @ vector / length
            best = int(cosines.argmax())
            names.append(self.languages[best])
            scores.append(min(1.0, max(0.0, float(cosines[best]))))
        return names, np.array(scores)


def labelled_texts(labelled: DataFrame, text_column: str, language_column: str, id_column: str) -> DataFrame:
    """``id, text, lang`` of the rows that have a language."""
    names = {id_column: "id", text_column: "text", language_column: "lang"}
    return labelled.select(*[F.col(f"`{name}`").cast("string").alias(new) for name, new in names.items()]).where("lang is not null")


def drawn_texts(rows: DataFrame, texts: int) -> DataFrame:
    """About ``texts`` rows of each language, drawn by a hash of the id."""
    rates = rows.groupBy(F.col("lang").alias("of")).agg((F.lit(float(texts)) / F.count(F.lit(1))).alias("rate"))
    draw = F.pmod(F.xxhash64(F.coalesce("id", F.lit("")), F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.join(sent_if_small(staged(rates)), F.col("lang") == F.col("of")).where(draw < F.col("rate"))


def learn(
    labelled: DataFrame,
    text_column: str = "text",
    language_column: str = "lang",
    id_column: str = "doc_id",
    train_texts: int | None = None,
    dimensions: int = DIMENSIONS,
    letters: int = LETTERS,
) -> Profiles:
    """Profiles from all texts that have a language; from about ``train_texts`` of each, drawn by a hash of the id, if that is given.

    What reaches the driver is one vector for each language.
    """
    ship(labelled.sparkSession)
    rows = labelled_texts(labelled, text_column, language_column, id_column)
    if train_texts is not None:
        rows = drawn_texts(rows, train_texts)

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, sums = space(dimensions, letters), {}
        for batch in batches:
            vectors = own.bundles(text.as_py() for text in batch.column(1))
            for lang, vector in zip(batch.column(0).to_pylist(), vectors, strict=True):
                if vector is not None and (length := np.linalg.norm(vector)):
                    sums[lang] = sums.get(lang, 0) + vector / length
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array(list(sums.values()), pa.list_(pa.float64()))], ["lang", "vector"]
        )
        space.cache_clear()
        release_unused()

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        vector = np.sum(np.stack(rows["vector"].to_list()), axis=0)
        return pd.DataFrame({"lang": rows["lang"].iloc[:1], "vector": [vector / np.linalg.norm(vector)]})

    kind = "lang string, vector array<double>"
    found = rows.select("lang", "text").mapInArrow(bundles, kind).groupBy("lang").applyInPandas(added, kind).orderBy("lang").collect()
    vectors = np.array([x["vector"] for x in found]) if found else np.empty((0, dimensions))
    return Profiles(tuple(x["lang"] for x in found), vectors, dimensions, letters)


def identify(docs: DataFrame, profiles: Profiles, text_column: str = "text", language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with its language and the cosine behind it (0 where it is negative); columns of those names are replaced.

    A text that is null or has no letter gets ``und`` and 0, and so does every
    text if no language was learnt.  Ties go to the first name in order.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(profiles)  # one vector for each language

    @F.arrow_udf("lang string, score double")
    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            names, scores = model.value.judged(text.as_py() for text in texts)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang", "score"])
        space.cache_clear()
        release_unused()

    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (language, score)]
    judged = docs.select(*kept, judge(F.col(f"`{text_column}`").cast("string")).alias("__judged"))
    names = [F.col(f"`{c}`") for c in judged.columns[:-1]]
    return judged.select(*names, F.col("__judged.lang").alias(language), F.col("__judged.score").alias(score))


def held_out(id_column: str = "doc_id", folds: int = 5) -> Column:
    """Whether the CRC-32 of the id's text is divisible by ``folds``; rows without an id are held out."""
    return F.coalesce(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")) % folds == 0, F.lit(True))


def length_class(text_column: str = "text") -> Column:
    size = F.char_length(F.col(f"`{text_column}`").cast("string"))
    return sum(((size > x).cast("int") for x in LENGTHS), F.lit(0))


def least_scores(held: DataFrame, profiles: Profiles, text_column: str = "text", language_column: str = "lang", id_column: str = "doc_id", language: str = "lang_pred") -> Column:
    """The least cosine with which a text's language (column ``language``) counts as told, from labelled texts that weren't learnt from.

    It is taken from the texts of the language and length class, where those
    are too few from all of the length class, then from all, and is 0 where
    those are too few as well.  All those texts are scored; the rank of the
    quantile is exact to a ten-thousandth of a cell's texts.
    """
    texts = labelled_texts(held, text_column, language_column, id_column)
    told = identify(texts, profiles, language="__lang", score="__score").where("lang = __lang").withColumn("class", length_class())
    cells = told.cube("lang", "class").agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__score", F.lit(LOW_QUANTILE)).alias("low")).collect()
    bounds = {(x["lang"], x["class"]): (x["n"], x["low"]) for x in cells}
    nothing = (0, 0.0)

    def least(lang: str, kind: int) -> float:
        asked = (((lang, kind), LEAST_HELD), ((None, kind), LEAST_OF_LENGTH), ((None, None), LEAST_HELD))
        found = ((*bounds.get(key, nothing), least) for key, least in asked)
        return next((MARGIN * low for n, low, least in found if n >= least), 0.0)

    table = [F.lit(x) for lang in profiles.languages for kind in range(len(LENGTHS) + 1) for x in (f"{kind} {lang}", float(least(lang, kind)))]
    return F.create_map(*table)[F.concat_ws(" ", length_class(text_column), language)]


def accepted(docs: DataFrame, least_score: float | None = None, text_column: str = "text", language_column: str = "lang", id_column: str = "doc_id") -> DataFrame:
    """``docs`` without the documents whose language can't be told: no letter, no text, or too small a cosine.

    Profiles are learnt from the rows that aren't held out, and the least
    cosine from those that are (``least_scores``), unless ``least_score`` gives it.  The columns stay.
    Where no language is learnt, as no row that isn't held out has one, every text with a letter stays.
    """
    out = held_out(id_column)
    profiles = learn(docs.where(~out), text_column, language_column, id_column)
    if not profiles.languages:
        return docs.where(F.regexp_like(F.col(f"`{text_column}`").cast("string"), F.lit(r"\p{L}")))
    language, score = free_names(docs, "lang", "score")
    judged = identify(docs, profiles, text_column, language, score)
    if least_score is not None:
        least = F.lit(least_score)
    else:
        least = least_scores(docs.where(out), profiles, text_column, language_column, id_column, language)
    return judged.where((F.col(language) != UNKNOWN) & (F.col(score) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])
