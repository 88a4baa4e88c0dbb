"""Benchmark decontamination by latent semantic retrieval.

1. Passages of ``PASSAGE`` words of every document are weighted by TF-IDF over the
   benchmark's words, with passage frequencies counted over all documents. Words in
   over ``COMMON`` of the passages weigh nothing, unless an item has fewer than
   ``RARE_WORDS`` others.
2. A randomised SVD of the passage matrix A, without building it: the tasks add up
   A'A times a random matrix, and then the Gram matrix of A times its orthonormal
   basis. Only matrices of (benchmark words x rank) and (rank x rank) are gathered.
3. Overlapping passages are projected and compared with the projected items; those
   with a cosine of ``COSINE`` are retrieved. The projection keeps a part of each
   passage only, so other passages are candidates too if their region, the passage
   and an item's length on both sides, holds as many of the item's words as the
   verification asks for; words that weigh nothing count as held. Documents that
   hold fewer as a whole have no candidates.
4. Candidates are verified on the words: the longest common subsequence with the
   item, in the text around the passage, and the same for the item's answer, its
   last sentence. A large common subsequence is a copy; a smaller one together
   with the answer is a paraphrase. All candidates of a document and an item are
   verified, and the largest cosine and shares of those that hold are given.

Texts are read once for a block of items and written as the numbers of the words
that items hold; every later pass reads these numbers.

Items are processed in blocks of ``BLOCK_BYTES`` of text, which bounds the model
that tasks get. Items longer than a passage are cut up; any part counts. Items of
fewer than ``SHORTEST`` words name nothing and are left out. Words are runs of
letters and digits without case. Null and empty texts hold nothing; repeated items
and documents give a row each; an empty benchmark contaminates nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ..session import stage
from .common import LETTERS, fresh_name, hashed_words, query, table, text_batches, utf8

PASSAGE = 64
STEP = PASSAGE // 2
RANK, EXTRA = 128, 16
SEED = 11
COSINE = 0.3
COMMON, RARE_WORDS = 0.1, 5
COPY, PARAPHRASE, ANSWER = 0.8, 0.65, 0.8
SHORTEST = 8
BLOCK_BYTES = 2_000_000
BATCH_CHARS = 1_000_000
BATCH_WORDS = 200_000
ROWS = 64  # terms in a row of a gathered matrix
PIECE = 2048
CELLS = 4_000_000  # pairs of region and item that are counted at once
SLACK = 1e-9  # of a bound, for rounding
NEAR = 1e-4  # of a cosine, for rounding

HITS = "key long, item_id long, cosine double, lcs_share double, answer_share double"


def words_of(text: str | None) -> np.ndarray:
    return hashed_words(np.frombuffer(utf8(text.lower() if text else ""), np.uint8), LETTERS)[2]


def longest_common_subsequence(item: list[int], text: list[int]) -> int:
    """Its length, with the item's positions as the bits of one number."""
    where: dict[int, int] = {}
    for i, word in enumerate(item):
        where[word] = where.get(word, 0) | 1 << i
    full = (1 << len(item)) - 1
    left = full
    for word in text:
        match = left & where.get(word, 0)
        if match:
            left = ((left + match) | (left - match)) & full
    return len(item) - left.bit_count()


def answer_words(text: str) -> np.ndarray:
    """The words of the last sentence; of the last quarter, if that is too short or most of the item."""
    words = words_of(text)
    sentences = [s for s in re.split(r"[.!?\n]+", text) if len(words_of(s))]
    last = words_of(sentences[-1]) if sentences else words
    return last if 3 <= len(last) <= len(words) // 2 else words[-max(1, -(-len(words) // 4)) :]


@dataclass
class Items:
    """The passages of a block of benchmark items."""

    ids: list[int | None]
    words: list[np.ndarray]
    answers: list[np.ndarray]
    terms: np.ndarray  # all words in them and in their answers, sorted
    weighs: np.ndarray  # which of the terms count in the vectors

    @classmethod
    def of(cls, rows: list[tuple[int | None, str | None]]) -> Items:
        ids, parts, answers = [], [], []
        for item, text in rows:
            words = words_of(text)
            if len(words) < SHORTEST:
                continue
            pieces = -(-len(words) // PASSAGE)
            for part in np.array_split(words, pieces):
                ids.append(item)
                parts.append(part)
                answers.append(answer_words(text) if pieces == 1 else part[-max(1, len(part) // 4) :])
        terms = np.unique(np.concatenate([*parts, *answers])) if parts else np.empty(0, np.uint64)
        return cls(ids, parts, answers, terms, np.ones(len(terms), bool))

    def without_common(self, share: np.ndarray) -> Items:
        """Words in a large share of all passages no longer weigh, but where an item has little else."""
        weighs = share <= COMMON
        for words in self.words:
            own = np.unique(self.number(words))
            if weighs[own].sum() < RARE_WORDS:
                weighs[own] = True
        return replace(self, weighs=weighs)

    @cached_property
    def lists(self) -> list[list[int]]:
        return [self.number(w).tolist() for w in self.words]

    @cached_property
    def answer_lists(self) -> list[list[int]]:
        return [self.number(w).tolist() for w in self.answers]

    @cached_property
    def holders(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the items of each term start, the items, and how often they hold it."""
        n = len(self.words)
        own = [np.searchsorted(self.terms, w) * n + i for i, w in enumerate(self.words)]
        pair, times = np.unique(np.concatenate(own), return_counts=True)
        return np.searchsorted(pair // n, np.arange(len(self.terms) + 1)), pair % n, times

    @cached_property
    def needed(self) -> np.ndarray:
        """How many words that weigh a text must hold to be a paraphrase of each item."""
        light = [len(w) - int(self.weighs[self.number(w)].sum()) for w in self.words]
        return np.ceil(PARAPHRASE * np.array([len(w) for w in self.words]) - SLACK) - light

    def number(self, words: np.ndarray) -> np.ndarray:
        """The term number of each word, -1 for others."""
        at = np.searchsorted(self.terms, words)
        at[at == len(self.terms)] = 0
        return np.where(self.terms[at] == words, at, -1)


def _distinct(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, ascending, and how often each occurs."""
    pairs = np.sort(pairs)
    start = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.empty(0, int)
    return pairs[start], np.diff(np.append(start, len(pairs)))


def numbered(texts: list[str], items: Items) -> list[bytes]:
    """Of each text, the words as numbers: 0 for words in no item, else the term's number from 1."""
    data = [utf8(t.lower()) for t in texts]
    starts, _, words = hashed_words(np.frombuffer(b"\n".join(data) + b"\n", np.uint8), LETTERS)
    edges = np.searchsorted(starts, np.cumsum([0] + [len(d) + 1 for d in data])).tolist()
    numbers = (items.number(words) + 1).astype(_width(items))
    return [numbers[a:b].tobytes() for a, b in zip(edges, edges[1:])]


def _width(items: Items) -> str:
    return "<u2" if len(items.terms) < 1 << 16 else "<u4"


class Steps:
    """The words of some texts (``numbered``) in steps of ``STEP``; a passage is two steps of one document, or its only one."""

    def __init__(self, texts: list[bytes], items: Items):
        width = np.dtype(_width(items))
        #: The term number of each word, -1 for words in no item.
        self.words = np.frombuffer(b"".join(texts), width).astype(np.int64) - 1
        count = np.array([len(t) // width.itemsize for t in texts], np.int64)
        self.first = np.cumsum(count) - count
        steps = -(-count // STEP)
        self.step_doc = np.repeat(np.arange(len(texts)), steps)
        self.step_of_doc = np.cumsum(steps) - steps
        known = np.flatnonzero((self.words >= 0) & items.weighs[self.words])
        self.term = self.words[known]
        doc = np.repeat(np.arange(len(texts)), count)[known]
        self.step = self.step_of_doc[doc] + (known - self.first[doc]) // STEP
        self.count = count
        self.steps = int(steps.sum())

    def passages(self) -> np.ndarray:
        """Of each step, the passage without overlap that it is in."""
        number = (np.arange(self.steps) - self.step_of_doc[self.step_doc]) // 2
        per_doc = np.bincount(self.step_doc, minlength=len(self.first))
        before = np.cumsum(-(-per_doc // 2)) - -(-per_doc // 2)
        return before[self.step_doc] + number

    def weighted(self, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(passage, term, weight) by passage; the weights of a passage have length 1."""
        passage = self.passages()[self.step]
        pair, times = _distinct(passage * len(idf) + self.term)
        passage, term = pair // len(idf), pair % len(idf)
        weight = times * idf[term]
        length = np.sqrt(np.bincount(passage, weights=weight**2))
        return passage, term, (weight / np.maximum(length[passage], 1e-12)).astype("f4")


def _sum_rows(
    rows: np.ndarray, index: np.ndarray, group: np.ndarray, n: int, weight: np.ndarray | None = None
) -> np.ndarray:
    """Sums of ``rows[index]``, weighted if wanted, by ascending ``group``; a piece at a time, which fits the cache."""
    out = np.zeros((n, rows.shape[1]), rows.dtype)
    for at in range(0, len(index), PIECE):
        part = rows[index[at : at + PIECE]]
        if weight is not None:
            part *= weight[at : at + PIECE, None]
        own = group[at : at + PIECE]
        start = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
        out[own[start]] += np.add.reduceat(part, start)
    return out


def _matrix_rows(matrix: np.ndarray) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(matrix), ROWS):
        part = matrix[at : at + ROWS].astype("<f8")
        if part.any():
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([at // ROWS], pa.int32()), "cells": pa.array([part.tobytes()], pa.binary())}
            )


def _add(parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, "<f8") for c in parts["cells"].to_pylist())
    return pa.table({"part": parts["part"].slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})


def _batches(batches: Iterator[pa.RecordBatch], column: str, items: Items) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose numbered texts have about ``BATCH_WORDS`` words together."""
    for batch, texts in text_batches(batches, column, BATCH_WORDS * np.dtype(_width(items)).itemsize):
        yield batch, [t or b"" for t in texts]


def _gather(docs: DataFrame, terms: str, shape: tuple[int, int], held, add) -> np.ndarray:
    """The sum over tasks of a matrix of the given shape; ``add(total, steps)`` adds the steps of a batch to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for _, texts in _batches(batches, terms, held.value):
            add(total, Steps(texts, held.value))
        yield from _matrix_rows(total)

    sums = docs.select(terms).mapInArrow(run, "part int, cells binary").groupBy("part").applyInArrow(_add, "part int, cells binary")
    out = np.zeros(shape)
    for row in sums.collect():
        cells = np.frombuffer(row["cells"], "<f8").reshape(-1, shape[1])
        out[row["part"] * ROWS :][: len(cells)] = cells
    return out


@dataclass
class Model:
    items: Items
    project: np.ndarray  # (terms, rank): a word's weighted coordinates
    coordinates: np.ndarray  # (item passages, rank)


def with_terms(docs: DataFrame, items: Items) -> tuple[DataFrame, str]:
    """``docs`` (text and any others), written once with each text as term numbers, and that column's name."""
    name = fresh_name(docs, "terms")
    held = docs.sparkSession.sparkContext.broadcast(items)  # bounded by BLOCK_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text", BATCH_CHARS):
            terms = pa.array(numbered(texts, held.value), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, terms], [*batch.schema.names, name])

    schema = StructType([*docs.schema.fields, StructField(name, BinaryType())])
    return stage(docs.mapInArrow(run, schema), "terms"), name


def fit(docs: DataFrame, terms: str, items: Items, rank: int = RANK) -> Model:
    """Latent coordinates of the benchmark's words, from the passages of all documents (their column ``terms``)."""
    spark, n = docs.sparkSession, len(items.terms)
    held = spark.sparkContext.broadcast(items)  # bounded by BLOCK_BYTES

    def count(total: np.ndarray, steps: Steps) -> None:
        passage = steps.passages()
        pair, _ = _distinct(passage[steps.step] * n + steps.term)
        total[:n, 0] += np.bincount(pair % n, minlength=n)
        total[n, 0] += int(passage.max()) + 1 if len(passage) else 0

    counts = _gather(docs, terms, (n + 1, 1), held, count)[:, 0]
    idf = np.log((1 + counts[n]) / (1 + counts[:n])) + 0.01
    items = items.without_common(counts[:n] / max(1, counts[n]))
    idf[~items.weighs] = 0
    held = spark.sparkContext.broadcast(items)
    width = min(rank + EXTRA, n)
    random = np.random.default_rng(SEED).standard_normal((n, width)).astype("f4")

    def spread(total: np.ndarray, steps: Steps) -> None:
        passage, term, weight = steps.weighted(idf)
        if len(term):
            rows = _sum_rows(random, term, passage, int(passage[-1]) + 1, weight)
            order = np.argsort(term, kind="stable")
            total += _sum_rows(rows, passage[order], term[order], n, weight[order])

    basis = np.linalg.qr(_gather(docs, terms, (n, width), held, spread))[0].astype("f4")

    def gram(total: np.ndarray, steps: Steps) -> None:
        passage, term, weight = steps.weighted(idf)
        if len(term):
            rows = _sum_rows(basis, term, passage, int(passage[-1]) + 1, weight)
            total += rows.T @ rows

    _, turn = np.linalg.eigh(_gather(docs, terms, (width, width), held, gram))
    project = (basis @ turn[:, ::-1][:, :rank] * idf[:, None]).astype("f4")
    coordinates = np.stack([project[items.number(w)].sum(axis=0) for w in items.words])
    return Model(items, project, coordinates)


def _held(row: np.ndarray, term: np.ndarray, rows: int, items: Items) -> np.ndarray:
    """How many of each item's words each row holds; (row, term) are distinct and known."""
    start, item, times = items.holders
    size = start[term + 1] - start[term]
    at = np.arange(size.sum()) + np.repeat(start[term] - (np.cumsum(size) - size), size)
    cell = np.repeat(row, size) * len(items.words) + item[at]
    return np.bincount(cell, weights=times[at], minlength=rows * len(items.words)).reshape(rows, -1)


def _able(row: np.ndarray, term: np.ndarray, rows: int, items: Items) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, item) where a row holds enough of the item's words, some rows at a time; (row, term) ascend."""
    some = max(1, CELLS // len(items.words))
    for low in range(0, rows, some):
        high = min(low + some, rows)
        a, b = np.searchsorted(row, [low, high])
        able, which = np.nonzero(_held(row[a:b] - low, term[a:b], high - low, items) >= items.needed)
        yield able + low, which


def _holding(steps: Steps, items: Items) -> np.ndarray:
    """Ascending document * items + item where the document as a whole holds enough of the item; no region holds more."""
    n = len(items.terms)
    pair, _ = _distinct(steps.step_doc[steps.step] * n + steps.term)
    found = [doc * len(items.words) + which for doc, which in _able(pair // n, pair % n, len(steps.first), items)]
    return np.concatenate(found) if found else np.empty(0, np.int64)


def _projected(model: Model, steps: Steps) -> np.ndarray:
    """The latent vector of the passage that starts in each step."""
    out = _sum_rows(model.project, steps.term, steps.step, steps.steps)
    follows = steps.step_doc[1:] == steps.step_doc[:-1]
    out[:-1][follows] += out[1:][follows].copy()
    return out


def _unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1; null vectors stay."""
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
    return vectors / np.maximum(length, 1e-12)[:, None]


def _retrieved(passages: np.ndarray, wanted: np.ndarray, steps: Steps, holding: np.ndarray) -> Iterator[tuple[int, int]]:
    """(step, item) where the passage is close to the item (rows of length 1), in documents that hold enough of it."""
    count = len(wanted)
    some = max(1, CELLS // count)
    for low in range(0, steps.steps, some):
        step, item = np.nonzero(passages[low : low + some] @ wanted.T >= COSINE)
        step += low
        pair = steps.step_doc[step] * count + item
        at = np.searchsorted(holding, pair)
        real = at < len(holding)
        real[real] = holding[at[real]] == pair[real]
        yield from zip(step[real].tolist(), item[real].tolist())


def _candidates(steps: Steps, items: Items, around: range, holding: np.ndarray) -> Iterator[tuple[int, int]]:
    """(step, item) where the region of the steps ``around`` it may hold the item."""
    n = len(items.terms)
    doc = steps.step_doc[steps.step]
    hopeful = np.zeros(len(steps.first), bool)
    hopeful[holding // len(items.words)] = True
    chosen = np.flatnonzero(hopeful[steps.step_doc])  # the steps looked at, numbered anew
    number = np.full(steps.steps, -1)
    number[chosen] = np.arange(len(chosen))
    inside = hopeful[doc]
    pair, _ = _distinct(number[steps.step[inside]] * n + steps.term[inside])
    step, term = pair // n, pair % n
    of_doc = steps.step_doc[chosen]
    found = []
    for off in around:
        region = step - off
        real = (region >= 0) & (region < len(chosen))
        real[real] = of_doc[region[real]] == of_doc[step[real]]
        found.append(region[real] * n + term[real])
    pair, _ = _distinct(np.concatenate(found))
    for able, which in _able(pair // n, pair % n, len(chosen), items):
        yield from zip(chosen[able].tolist(), which.tolist())


def _search(model: Model, texts: list[bytes]) -> Iterator[tuple[int, int | None, float, float, float]]:
    """(text, item, cosine, LCS share, answer share) of every text and item with a verified candidate; texts are ``numbered``."""
    items = model.items
    steps = Steps(texts, items)
    if not steps.steps:
        return
    longest = max(map(len, items.words))
    around = range(-longest // STEP, -(-(PASSAGE + longest) // STEP))
    passages, wanted = _unit(_projected(model, steps)), _unit(model.coordinates)
    holding = _holding(steps, items)
    retrieved = _retrieved(passages, wanted, steps, holding)
    others = (c for c in _candidates(steps, items, around, holding) if passages[c[0]] @ wanted[c[1]] < COSINE + NEAR)
    begin, begin_step = steps.first[steps.step_doc], steps.step_of_doc[steps.step_doc]
    own = begin + (np.arange(steps.steps) - begin_step) * STEP
    starts = np.maximum(begin, own - longest).tolist()
    ends = np.minimum(begin + steps.count[steps.step_doc], own + PASSAGE + longest).tolist()
    all_words, lists, answers = steps.words.tolist(), items.lists, items.answer_lists
    best: dict[tuple[int, int], tuple[float, ...]] = {}
    last, text, present = -1, [], frozenset()
    for at, item in chain(retrieved, others):
        if at != last:
            text = all_words[starts[at] : ends[at]]
            last, present = at, frozenset(text)
        words = lists[item]
        if sum(map(present.__contains__, words)) < PARAPHRASE * len(words):  # no subsequence can be longer
            continue
        share = longest_common_subsequence(words, text) / len(words)
        if share < PARAPHRASE:
            continue
        answered = longest_common_subsequence(answers[item], text) / len(answers[item])
        if share >= COPY or answered >= ANSWER:
            doc = int(steps.step_doc[at])
            end_step = begin_step[at] - (-steps.count[doc] // STEP)
            region = passages[max(begin_step[at], at + around[0]) : min(end_step, at + around[-1] + 1)]
            found = (float((region @ wanted[item]).max()), share, answered)
            best[doc, item] = tuple(map(max, best.get((doc, item), found), found))
    for (doc, item), found in best.items():
        yield doc, items.ids[item], *found


def blocks_of_items(benchmark: DataFrame) -> Iterator[Items]:
    """The items, ``BLOCK_BYTES`` of text at a time."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").isNotNull())
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-int(total) // BLOCK_BYTES)
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).orderBy("item_id", "text")
        items = Items.of([(r["item_id"], r["text"]) for r in part.collect()])
        if items.ids:
            yield items


def contaminated(docs: DataFrame, key: str, benchmark: DataFrame) -> DataFrame:
    """key, item_id, cosine, lcs_share and answer_share of the documents that hold benchmark items."""
    spark = docs.sparkSession
    found = spark.createDataFrame([], HITS)
    for items in blocks_of_items(benchmark):
        rows, terms = with_terms(docs.select(F.col(key).alias("key"), "text"), items)
        held = spark.sparkContext.broadcast(fit(rows, terms, items))

        def run(batches: Iterator[pa.RecordBatch], held=held, terms=terms) -> Iterator[pa.RecordBatch]:
            for batch, texts in _batches(batches, terms, held.value.items):
                keys = batch.column("key").to_pylist()
                hits = [(keys[doc], *rest) for doc, *rest in _search(held.value, texts)]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                columns = [pa.array([h[i] for h in hits], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays(columns, ["key", "item_id", "cosine", "lcs_share", "answer_share"])

        found = found.union(rows.select("key", terms).mapInArrow(run, HITS))
    best = [F.max(c).alias(c) for c in ("cosine", "lcs_share", "answer_share")]
    return found.groupBy("key", "item_id").agg(*best).withColumnRenamed("key", key)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` (text and any others) that hold no benchmark item."""
    wanted = docs.columns
    for items in blocks_of_items(benchmark):
        rows, terms = with_terms(docs, items)
        held = docs.sparkSession.sparkContext.broadcast(fit(rows, terms, items))

        def run(batches: Iterator[pa.RecordBatch], held=held, terms=terms) -> Iterator[pa.RecordBatch]:
            for batch, texts in _batches(batches, terms, held.value.items):
                hit = {doc for doc, *_ in _search(held.value, texts)}
                yield batch.select(wanted).filter(pa.array([i not in hit for i in range(len(texts))], pa.bool_()))

        docs = rows.mapInArrow(run, docs.schema)
    return docs


@query("op3_contaminated")
def op3_contaminated(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return contaminated(docs, "doc_id", table(spark, sf_dir, "benchmark"))
