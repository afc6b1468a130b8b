"""Ranked lexical search: MaxScore whose bounds come from lists of term pairs.

1. One pass over the texts counts each document's terms and keeps the counts
   of those that the queries name.  Document frequencies give the weights.
2. Documents are searched in groups, each in one task's memory: postings by
   term with their impacts, cut into blocks of documents with each block's
   largest impact.
3. Terms that queries name together are paired.  The pair's list holds the
   blocks in which both occur with the largest impact they have jointly in one
   document.  It is at most the sum of both maxima, and mostly far below it.
4. A query's bound of a block is the sum over its pairs and single terms.
   Blocks below the k-th best score so far are passed over.  In the others the
   units with the largest bounds find candidates, as long as what is left could
   still lift a new document to that score; the rest only adds to candidates.
5. A sixteenth of the documents is searched first.  Its k-th best scores are
   lower bounds for the others, so that few documents leave their tasks.

All arithmetic is exact in 64-bit integers, and every document is searched.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from adtally.llm.staging import ship, staged

#: Queries are searched in passes that name about so many terms, which each task holds.
TERMS_PER_PASS = 200_000
#: Postings of a group, which a task holds in memory (one document at least), and documents of a block.
GROUP_POSTINGS, BLOCK = 2_000_000, 128
#: One document in so many is searched first.
FIRST_SHARE = 16
#: Bytes of a text that are cut into words at a time.
WINDOW = 1 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TERM = r"([^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+)"
_TO_WORDS = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)
_NO_ID = np.iinfo(np.int64).max


def term_counts(text: bytes) -> Counter:
    """How often each term stands in the whole UTF-8 text."""
    clean, counts, start = text.translate(_TO_WORDS), Counter(), 0
    while start < len(clean):
        stop = clean.find(b" ", start + WINDOW)
        stop = len(clean) if stop < 0 else stop
        counts.update(clean[start:stop].split())
        start = stop
    return counts


@dataclass(frozen=True)
class Pass:
    """Queries that are searched together; terms and pairs are numbers."""

    terms: tuple[list[int], ...]
    pairs: list[tuple[int, int]]
    units: tuple[list[int], ...]  # of each query: numbers below len(weights) are terms, the others pairs
    weights: np.ndarray
    least: np.ndarray  # of each query: the score that a document has to reach
    k: int


def paired(terms: list[list[int]], frequencies: np.ndarray) -> tuple[list[tuple[int, int]], list[list[int]]]:
    """Pairs of terms that are next to each other by frequency in a query, and each query's pairs and single terms."""
    number: dict[tuple[int, int], int] = {}
    units = []
    for own in terms:
        ordered = sorted((t for t in own if frequencies[t]), key=lambda t: (-frequencies[t], t))
        both = [(min(p), max(p)) for p in zip(ordered[::2], ordered[1::2], strict=False)]
        alone = ordered[len(both) * 2 :]
        units.append([*(len(frequencies) + number.setdefault(p, len(number)) for p in both), *alone])
    return list(number), units


class Group:
    """Postings of some documents, with the bounds of blocks by term and by pair."""

    def __init__(self, own: Pass, ids: np.ndarray, m: np.ndarray, doc: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.ids, self.size = ids, len(ids)
        self.blocks = -(-self.size // BLOCK)
        impact = own.weights[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        order = np.argsort(term, kind="stable")  # documents stay in order
        order = order[impact[order] > 0]
        self.doc, self.impact, term = doc[order], impact[order], term[order]
        self.present, first = np.unique(term, return_index=True)
        self.bounds = np.append(first, len(term))
        self.row = {int(t): i for i, t in enumerate(self.present)}
        key = np.repeat(np.arange(len(self.present)), np.diff(self.bounds)) * self.blocks + self.doc // BLOCK
        singles = np.zeros((len(self.present), self.blocks), np.int64)
        cuts = np.flatnonzero(np.diff(key, prepend=-1))
        if len(key):
            singles.ravel()[key[cuts]] = np.maximum.reduceat(self.impact, cuts)
        self.most = singles
        self.pair_most: dict[int, np.ndarray] = {}
        joint = np.zeros(self.size, np.int64)
        for number, (a, b) in enumerate(own.pairs, len(own.weights)):
            if a in self.row and b in self.row:
                self.pair_most[number] = self._joint(joint, a, b)
        self.terms_of = lambda unit: (unit,) if unit < len(own.weights) else own.pairs[unit - len(own.weights)]

    def postings(self, term: int) -> tuple[np.ndarray, np.ndarray]:
        span = slice(self.bounds[self.row[term]], self.bounds[self.row[term] + 1])
        return self.doc[span], self.impact[span]

    def _joint(self, held: np.ndarray, a: int, b: int) -> np.ndarray:
        """By block the largest impact of both terms in one document, whether it holds one or both; ``held`` is all 0 before and after."""
        (docs_a, of_a), (docs_b, of_b) = self.postings(a), self.postings(b)
        out = np.maximum(self.most[self.row[a]], self.most[self.row[b]])
        held[docs_a] = of_a
        there = held[docs_b]
        held[docs_a] = 0
        inside = np.flatnonzero(there)
        if len(inside):
            block = docs_b[inside] // BLOCK
            cuts = np.flatnonzero(np.diff(block, prepend=-1))
            both = np.maximum.reduceat(there[inside] + of_b[inside], cuts)
            out[block[cuts]] = np.maximum(out[block[cuts]], both)
        return out

    def bounds_of(self, units: list[int]) -> tuple[list[tuple[int, ...]], np.ndarray]:
        """Terms and bounds by block of what is here of the query, the largest bound first."""
        found: list[tuple[tuple[int, ...], np.ndarray]] = []
        for unit in units:
            if unit in self.pair_most:
                found.append((self.terms_of(unit), self.pair_most[unit]))
            else:
                found += [((t,), self.most[self.row[t]]) for t in self.terms_of(unit) if t in self.row]
        found.sort(key=lambda x: -int(x[1].max()))
        return [x for x, _ in found], np.array([x for _, x in found], np.int64).reshape(len(found), self.blocks)

    def best(self, units: list[int], least: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents that reach ``least``, at least the k best of them, and their scores."""
        terms, bounds = self.bounds_of(units)
        nothing = np.empty(0, np.int64), np.empty(0, np.int64)
        rest = np.concatenate([np.cumsum(bounds[::-1], axis=0)[::-1], np.zeros((1, self.blocks), np.int64)])
        alive = rest[0] >= least
        if not alive.any():
            return nothing
        essential = int(np.argmax(rest[:, alive].max(axis=1) < least))
        total = np.zeros(self.size, np.int64)
        for unit in terms[:essential]:
            for term in unit:
                docs, impact = self.postings(term)
                if not alive.all():
                    inside = alive[docs // BLOCK]
                    docs, impact = docs[inside], impact[inside]
                total[docs] += impact
        found = np.flatnonzero(total)
        for at in range(essential, len(terms) + 1):
            scores = total[found]
            if len(found) > k:
                least = max(least, int(np.partition(scores, len(found) - k)[len(found) - k]))
            found = found[scores + rest[at][found // BLOCK] >= least]
            if at < len(terms):
                for term in terms[at]:
                    docs, impact = self.postings(term)
                    place = np.minimum(np.searchsorted(docs, found), len(docs) - 1)
                    total[found] += np.where(docs[place] == found, impact[place], 0)
        return found, total[found]


def _groups(batches: Iterator[pa.RecordBatch], own: Pass) -> Iterator[Group]:
    """Batches ``id, m, terms, tfs``, cut where a group would have too many postings."""
    for batch in batches:
        sizes = batch.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        ends, start = np.cumsum(sizes), 0
        while start < len(sizes):
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + GROUP_POSTINGS, side="right")))
            ids, m, terms, tfs = (batch.column(i).slice(start, stop - start) for i in range(4))
            ids = ids.fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(stop - start), sizes[start:stop])
            yield Group(own, ids, m.to_numpy(), doc, *(x.flatten().to_numpy().astype(np.int64) for x in (terms, tfs)))
            start = stop


def _search(batches: Iterator[pa.RecordBatch], own: Pass) -> Iterator[pa.RecordBatch]:
    least = np.maximum(own.least, 1)
    held = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(own.units)
    for group in _groups(batches, own):
        for query, units in enumerate(own.units):
            docs, scores = group.best(units, int(least[query]), own.k)
            if len(docs):
                ids, scores = np.concatenate([held[query][0], group.ids[docs]]), np.concatenate([held[query][1], scores])
                order = np.lexsort((ids, -scores))[: own.k]
                held[query] = ids[order], scores[order]
                if len(order) == own.k:
                    least[query] = max(least[query], scores[order[-1]])
    queries = np.repeat(np.arange(len(held)), [len(x) for x, _ in held])
    if len(queries):
        ids = np.concatenate([x for x, _ in held])
        yield pa.RecordBatch.from_arrays(
            [pa.array(queries, pa.int64()), pa.array(ids, pa.int64(), mask=ids == _NO_ID), pa.array(np.concatenate([x for _, x in held]), pa.int64())],
            ["query", "doc_id", "score"],
        )


def _counted(docs: DataFrame, id_column: str, text_column: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """``id, n, terms, tfs`` of documents with a term; ``terms`` are numbers of the vocabulary."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)  # at most about TERMS_PER_PASS terms

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = known.value
        for batch in batches:
            sizes, terms, tfs = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                counts = term_counts(text.as_py())
                found = [(number[word], tf) for word, tf in counts.items() if word in number]
                sizes.append(counts.total())
                terms.append(np.array([t for t, _ in found], np.int32))
                tfs.append(np.array([tf for _, tf in found], np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["id", "n", "terms", "tfs"]
            )

    texts = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text")).where("text is not null")
    found = texts.mapInArrow(count, "id long, n long, terms array<int>, tfs array<long>").where("n > 0")
    return staged(found.withColumn("row", F.monotonically_increasing_id()))


def _weights(rows: DataFrame, vocabulary: int, documents: int) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and weights of the numbered terms."""
    frequencies = np.zeros(vocabulary, np.int64)
    for row in rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).toLocalIterator():
        frequencies[row["term"]] = row["df"]
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) if df else 0 for df in frequencies]
    return frequencies, np.array(weights, np.int64).reshape(vocabulary)


def _best(rows: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _of_pass(docs: DataFrame, id_column: str, text_column: str, queries: list, k: int) -> DataFrame:
    """``query, doc_id, score, rank``: query is the number in ``queries``, rows with ``terms``."""
    vocabulary = {term: i for i, term in enumerate(sorted({t.encode() for q in queries for t in q["terms"]}))}
    rows = _counted(docs, id_column, text_column, vocabulary)
    documents, length = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("n").cast("decimal(20,0)")), F.lit(0))).first()
    frequencies, weights = _weights(rows, len(vocabulary), documents)
    terms = [[vocabulary[t.encode()] for t in q["terms"]] for q in queries]
    pairs, units = paired(terms, frequencies)
    m = F.expr(f"50 + (cast(50 * n as decimal(20, 0)) * {documents}BD) div {max(1, int(length))}BD")
    posted = rows.where(F.size("terms") > 0).select("id", m.cast("long").alias("m"), "terms", "tfs", "row")

    def found(part: DataFrame, least: np.ndarray) -> DataFrame:
        own = docs.sparkSession.sparkContext.broadcast(Pass(tuple(terms), pairs, tuple(units), weights, least, k))  # at most about TERMS_PER_PASS terms
        return part.drop("row").mapInArrow(lambda batches: _search(batches, own.value), "query long, doc_id long, score long")

    ahead = F.pmod(F.xxhash64("row"), F.lit(FIRST_SHARE)) == 0
    first = staged(_best(found(posted.where(ahead), np.zeros(len(queries), np.int64)), k))
    least = np.zeros(len(queries), np.int64)
    for row in first.where(F.col("rank") == k).select("query", "score").collect():  # one row for each query of the pass
        least[row["query"]] = row["score"]
    return _best(first.drop("rank").unionByName(found(posted.where(~ahead), least)), k)


def ranked(docs: DataFrame, queries: DataFrame, k: int = 50, id_column: str = "doc_id", text_column: str = "text", query_id: str = "item_id", query_text: str = "text", terms_per_pass: int = TERMS_PER_PASS) -> DataFrame:
    """``query_id, rank, doc_id, score``: the ``k`` best documents of each query with a score above 0, ties by smaller id.

    Null and empty texts have no term: such documents aren't counted, such
    queries have no result.  Rows that repeat a document or its id are
    documents of their own, and so are queries.  A document without an id is counted
    and ranked behind equal scores; a query without an id has results under null.  Other
    columns aren't read.  An empty table gives no row.
    """
    spark = docs.sparkSession
    ship(spark)
    words = F.regexp_extract_all(F.translate(F.col(f"`{query_text}`").cast("string"), UPPER, LOWER), F.lit(TERM), 1)
    asked = queries.select(F.col(f"`{query_id}`").alias("item"), F.array_distinct(words).alias("terms")).where(F.size("terms") > 0)
    asked = staged(asked.withColumn("row", F.monotonically_increasing_id()))
    passes = max(1, math.ceil((asked.agg(F.sum(F.size("terms"))).first()[0] or 0) / terms_per_pass))
    kind = dict(asked.dtypes)["item"]
    out = spark.createDataFrame([], f"item {kind}, rank int, doc_id long, score long")
    for i in range(passes):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(passes)) == i).collect()  # about terms_per_pass terms
        if own:
            found = _of_pass(docs, id_column, text_column, own, k)
            names = spark.createDataFrame([(n, q["item"]) for n, q in enumerate(own)], f"query long, item {kind}")
            out = out.unionByName(found.join(F.broadcast(names), "query").select("item", "rank", "doc_id", "score"))
    return out.select(F.col("item").alias(query_id), F.col("rank").cast("int").alias("rank"), F.col("doc_id").alias(id_column), "score")
