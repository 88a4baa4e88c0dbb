"""Repeated passages by relative Lempel-Ziv parsing.

A chunk of documents is a reference block. Its index holds the hashes of its
windows of ``width`` consecutive words. Every document is parsed against the
indexes of all blocks, its own among them: a position whose window starts
somewhere else, too, begins a factor, which grows word by word for as long as the
same source goes on; other words are literals. The parse goes on behind a factor,
so windows that cross the factor's end are checked there. Factors and the windows
found at their ends are the duplicate passages.

Looking up every window would shuffle a hash for each word. A first round asks
only for the smallest hash of eight words within each window. Equal windows have
equal smallest hashes, so windows whose smallest hash occurs once in all
documents need no lookup. The second round looks up the others. In both, a block
asks for each hash once, whatever the number of its documents.

Windows are told apart by 64-bit hashes. Null texts have no words; rows with
equal or null ids are documents of their own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .chunks import U64, Chunked, answer, answers, bits, bucket_edges, questions, replies_in_order, unpack
from .common import SliceHash, group_equal, hashed_words, mix, query, table, utf8, window_minima

CHUNK_BYTES = 16_000_000
GRAM = 8
WIDTH = 35
FIRST, SECOND = 1, 2

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
FACTORS = "doc_id long, start long, n_words long, source_chunk long, source_start long, at_boundary boolean"


class Block:
    """The words of a chunk, one document after another in row order."""

    def __init__(self, rows: pa.Table, width: int):
        rows = rows.sort_by("row_id")
        self.number = rows["chunk"][0].as_py()
        self.doc_ids = rows["doc_id"].to_pylist()
        self.texts = [utf8(t) for t in rows["text"].to_pylist()]
        data = np.frombuffer(b"\n".join(self.texts) + b"\n", np.uint8)
        starts, _, self.hashes = hashed_words(data)
        ends = np.cumsum([len(t) + 1 for t in self.texts])
        self.first = np.searchsorted(starts, np.concatenate([[0], ends]))  # a document's first word
        n = max(0, len(starts) - width + 1)
        self.width = width
        self.valid = np.ones(n, bool)  # windows that lie in one document
        for edge in self.first[1:-1].tolist():
            self.valid[max(0, edge - width + 1) : edge] = False
        gram = min(GRAM, width)
        at = np.arange(max(0, len(starts) - gram + 1))
        self.grams = SliceHash(self.hashes).slices(at, at + gram)
        low = window_minima(self.grams, width - gram + 1)
        change = np.ones(n, bool)
        change[1:] = (low[1:] != low[:-1]) | (self.valid[1:] != self.valid[:-1])
        start = np.flatnonzero(change)
        length = np.diff(np.append(start, n))
        kept = self.valid[start] if n else np.empty(0, bool)
        #: Runs of windows with the same smallest hash.
        # Smallest hashes are small; mixed again, they spread evenly over the buckets.
        self.run_start, self.run_length, self.run_low = start[kept], length[kept], mix(low[start[kept]])
        self.lows = np.unique(self.run_low)

    def repeated_here(self) -> np.ndarray:
        """Which of ``lows`` occur more than once in this block."""
        grams = np.sort(mix(self.grams))
        return np.searchsorted(grams, self.lows, "right") - np.searchsorted(grams, self.lows, "left") > 1

    def look_up(self, repeated: np.ndarray) -> None:
        """Take the windows whose smallest hash is among the ``repeated`` ones of ``lows``."""
        chosen = repeated[np.searchsorted(self.lows, self.run_low)]
        start, length = self.run_start[chosen], self.run_length[chosen]
        before = np.cumsum(length) - length
        self.windows = np.repeat(start - before, length) + np.arange(int(length.sum()))
        self.first_of, self.group = group_equal(SliceHash(self.hashes).slices(self.windows, self.windows + self.width))
        self.keys = SliceHash(self.hashes).slices(self.windows[self.first_of], self.windows[self.first_of] + self.width)

    def sources(self, elsewhere: np.ndarray) -> np.ndarray:
        """For each window taken, another place where it starts (-1: none); ``elsewhere`` has those of other blocks."""
        found = elsewhere[self.group]
        times = np.bincount(self.group, minlength=len(self.keys))
        first = self.windows[self.first_of]
        last = np.zeros(len(self.keys), np.int64)
        last[self.group] = self.windows  # windows ascend, so the last one stays
        here = np.where(self.windows == first[self.group], last[self.group], first[self.group])
        own = (found < 0) & (times[self.group] > 1)
        found[own] = self.number << 32 | here[own]
        return found

    def factors(self, sources: np.ndarray) -> list[tuple[int, int, int, int, bool]]:
        """(document, first word, words, source, found at a boundary) of the greedy parse."""
        matched = sources >= 0
        at, source = self.windows[matched], sources[matched]
        if not len(at):
            return []
        doc = np.searchsorted(self.first, at, side="right") - 1
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1] + 1) | (source[1:] != source[:-1] + 1) | (doc[1:] != doc[:-1])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(at)) - 1
        out, behind = [], -1
        for d, a, b, s in zip(doc[start].tolist(), at[start].tolist(), at[stop].tolist(), source[start].tolist()):
            crosses = a < behind  # starts inside the factor before, so it crosses that factor's end
            out.append((d, a - int(self.first[d]), b + self.width - a, s, crosses))
            behind = max(behind, b + self.width)
        return out


def _ask_first(width: int, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        block = Block(rows, width)
        return questions(block.number, block.lows, buckets, block.repeated_here().astype(np.uint8))

    return run


def _answer_first(asked: pa.Table) -> pa.Table:
    """Whether a smallest hash occurs in two blocks or twice in one."""
    keys, twice = unpack(asked["keys"], U64), unpack(asked["extra"], np.uint8)
    distinct, group, blocks = np.unique(keys, return_inverse=True, return_counts=True)
    repeated = blocks > 1
    repeated |= np.bincount(group, weights=twice, minlength=len(distinct)) > 0
    return answers(asked, repeated[group], FIRST, packed_bits=True)


def _ask_second(width: int, buckets: int):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return questions(0, np.empty(0, U64), buckets)
        block = Block(rows, width)
        block.look_up(bits(replies, FIRST, block.lows, buckets))
        return questions(block.number, block.keys, buckets, block.windows[block.first_of].astype("<u4"))

    return run


def _answer_second(asked: pa.Table) -> pa.Table:
    """For each window of a block, where another block has it: the first such block, by number."""
    asked = asked.sort_by("chunk")
    keys, at = unpack(asked["keys"], U64), unpack(asked["extra"], "<u4").astype(np.int64)
    sizes = np.array(asked["size"], np.int64)
    place = np.repeat(np.array(asked["chunk"], np.int64), sizes) << 32 | at
    order = np.argsort(keys, kind="stable")
    ordered, places = keys[order], place[order]
    first = np.ones(len(keys), bool)
    first[1:] = ordered[1:] != ordered[:-1]
    starts = np.flatnonzero(first)
    count = np.diff(np.append(starts, len(keys)))
    head = np.repeat(places[starts], count)
    second = np.repeat(places[np.minimum(starts + 1, len(keys) - 1)], count) if len(keys) else places
    source = np.where(np.repeat(count, count) < 2, -1, np.where(first, second, head))
    out = np.empty(len(keys), np.int64)
    out[order] = source
    return answers(asked, out.astype("<i8"), SECOND)


def _parsed(rows: pa.Table, replies: pa.Table, width: int, buckets: int) -> tuple[Block, list]:
    block = Block(rows, width)
    block.look_up(bits(replies, FIRST, block.lows, buckets))
    edges = bucket_edges(block.keys, buckets)
    elsewhere = np.full(len(block.keys), -1, np.int64)
    for b, got in replies_in_order(replies, SECOND):
        elsewhere[edges[b] : edges[b + 1]] = np.frombuffer(got, "<i8")
    return block, block.factors(block.sources(elsewhere))


def _remove(width: int, buckets: int):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return _results([], [], [], [])
        block, factors = _parsed(rows, replies, width, buckets)
        spans: dict[int, list[tuple[int, int]]] = {}
        for doc, start, n, *_ in factors:
            spans.setdefault(doc, []).append((start, start + n))
        n_words, n_removed, digests = [], [], []
        for doc, text in enumerate(block.texts):
            words = text.split()
            total = len(words)
            if doc in spans:
                keep = np.ones(total, bool)
                for a, b in spans[doc]:
                    keep[a:b] = False
                words = [words[i] for i in np.flatnonzero(keep).tolist()]
            n_words.append(total)
            n_removed.append(total - len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return _results(block.doc_ids, n_words, n_removed, digests)

    return run


def _results(doc_ids: list, n_words: list, n_removed: list, digests: list) -> pa.Table:
    return pa.table(
        {
            "doc_id": pa.array(doc_ids, pa.int64()),
            "n_words": pa.array(n_words, pa.int64()),
            "n_removed": pa.array(n_removed, pa.int64()),
            "kept_sha256": pa.array(digests, pa.string()),
        }
    )


def _list_factors(width: int, buckets: int):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        block, found = _parsed(rows, replies, width, buckets) if rows.num_rows else (None, [])
        columns = {
            "doc_id": pa.array([block.doc_ids[f[0]] for f in found], pa.int64()),
            "start": pa.array([f[1] for f in found], pa.int64()),
            "n_words": pa.array([f[2] for f in found], pa.int64()),
            "source_chunk": pa.array([f[3] >> 32 for f in found], pa.int64()),
            "source_start": pa.array([f[3] & 0xFFFFFFFF for f in found], pa.int64()),
            "at_boundary": pa.array([f[4] for f in found], pa.bool_()),
        }
        return pa.table(columns)

    return run


def _parse(docs: DataFrame, width: int, chunk_bytes: int, finish, schema: str) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = Chunked(rows, chunk_bytes, "blocks")
    buckets = chunks.buckets
    first = answer(chunks.ask(_ask_first(width, buckets)), _answer_first)
    first = chunks.staged(first)
    second = answer(chunks.with_replies(first, _ask_second(width, buckets), chunks.asked), _answer_second)
    return chunks.with_replies(first.union(second), finish(width, buckets), schema)


def remove_repeated_passages(docs: DataFrame, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of what is left of each document.

    A word goes if a window of ``width`` words covers it that also starts elsewhere.
    """
    return _parse(docs, width, chunk_bytes, _remove, RESULT)


def repeated_factors(docs: DataFrame, width: int = WIDTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The factors of ``width`` words or more: where they start, how long they are and where they are copied from."""
    return _parse(docs, width, chunk_bytes, _list_factors, FACTORS)


@query("op4_repeated_passages")
def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_passages(table(spark, sf_dir, "documents"))
