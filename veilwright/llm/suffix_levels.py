"""Repeated byte strings by a logarithmic family of suffix arrays.

A suffix that starts in one document is looked up among the suffixes of smaller
documents. Suffixes matter as far as ``length`` bytes; an array holds them in the
order of a 64-bit hash of those bytes, and matches are compared byte by byte.
Batches of documents come in ascending id order. Each batch gets an array of its
suffixes, which is merged against every level for long matches; then the array
joins the family, and levels of similar size merge, so a family of n suffixes
has about log2(n / batch) levels.

Families work side by side. The smallest hash of 16 bytes within a suffix's first
``length`` bytes names its family, and equal suffixes have equal smallest hashes.
Before that, a round of questions finds the smallest hashes that occur in two
documents; only the suffixes under those travel, as runs of text, each distinct
suffix once for a chunk. So a passage in a third of all documents reaches its
family once for each chunk.

Texts are UTF-8 bytes; null texts are empty. Documents with equal ids do not
remove from each other, and null ids count as larger than any id.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .chunks import U64, Chunked, answer, answers, bits, questions, replies_in_order, unpack
from .common import BYTE_SYMBOLS, SliceHash, group_equal, mix, query, table, utf8, window_minima

CHUNK_BYTES = 3_000_000
PIECE = 1 << 16
GRAM = 16
LENGTH = 50
BATCH = 1 << 16
NO_ID = np.iinfo(np.int64).max
FIRST, SECOND = 1, 2

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
HEAD = np.dtype([("doc", "<i8"), ("n", "<u4")])  # of a run of suffixes: its document and number


def run_positions(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All positions of runs, one run after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


def window_hashes(data: np.ndarray, length: int) -> np.ndarray:
    """The hash of every ``length`` consecutive bytes."""
    return SliceHash(BYTE_SYMBOLS[data]).windows(length)


def suffix_hashes(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, length: int) -> np.ndarray:
    """The hash of the first ``length`` bytes of each suffix in runs of consecutive suffixes."""
    out = np.empty(int(lengths.sum()), U64)
    done = np.cumsum(lengths)
    at = 0
    while at < len(starts):  # some runs at a time, which bounds the memory
        before = done[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(done, before + PIECE, side="right")))
        count = lengths[at:to]
        spans = count + (length - 1)
        joined = data[run_positions(starts[at:to], spans)]
        out[before : done[to - 1]] = window_hashes(joined, length)[run_positions(np.cumsum(spans) - spans, count)]
        at = to
    return out


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Whether the ``length`` bytes at ``a`` equal those at ``b``."""
    out = np.ones(len(a), bool)
    width = 8 if length >= 8 else 1
    words = np.ndarray(max(0, len(data) - width + 1), f"<u{width}", data, strides=(1,))  # one at every byte
    steps = [*range(0, length - width, width), length - width]
    for at in range(0, len(a), BATCH):
        i, j = a[at : at + BATCH], b[at : at + BATCH]
        for step in steps:
            out[at : at + BATCH] &= words[i + step] == words[j + step]
    return out


class SuffixFamily:
    """Suffixes of one byte array, added in batches of ascending documents."""

    def __init__(self, data: np.ndarray, length: int):
        self.data, self.length = data, length
        #: (hashes in order, place in ``data`` and document of the first suffix with each).
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, hashes: np.ndarray, places: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """Add a batch; which of its suffixes also start in a smaller document."""
        first, group = group_equal(hashes)
        keys, at, low = hashes[first], places[first], docs[first]
        source, smallest = at.copy(), low.copy()
        for level_keys, level_at, level_docs in self.levels:
            i = np.searchsorted(level_keys, keys)
            i[i == len(level_keys)] = 0
            better = (level_keys[i] == keys) & (level_docs[i] < smallest)
            source[better], smallest[better] = level_at[i[better]], level_docs[i[better]]
        found = smallest[group] < docs
        hit = np.flatnonzero(found)
        found[hit] = same_bytes(self.data, places[hit], source[group[hit]], self.length)
        self.levels.append((keys, at, low))
        while len(self.levels) > 1 and len(self.levels[-2][0]) <= 2 * len(self.levels[-1][0]):
            self.levels[-2:] = [self._merge(*self.levels[-2:])]
        return found

    @staticmethod
    def _merge(old: tuple, new: tuple) -> tuple:
        keys, at, docs = (np.concatenate(x) for x in zip(old, new))
        order = np.argsort(keys, kind="stable")  # two sorted runs; the older suffix stays first
        keys = keys[order]
        kept = np.ones(len(keys), bool)
        kept[1:] = keys[1:] != keys[:-1]
        order = order[kept]
        return keys[kept], at[order], docs[order]


class Texts:
    """The bytes of a chunk's documents, in ascending id order."""

    def __init__(self, rows: pa.Table, length: int):
        doc_ids = rows["doc_id"].to_pylist()
        numbers = rows["row_id"].to_pylist()
        order = sorted(range(len(doc_ids)), key=lambda i: (doc_ids[i] is None, doc_ids[i] or 0, numbers[i]))
        texts = rows["text"].to_pylist()
        self.number = rows["chunk"][0].as_py()
        self.doc_ids = [doc_ids[i] for i in order]
        self.rank = np.array([NO_ID if d is None else d for d in self.doc_ids], np.int64)
        self.texts = [utf8(texts[i]) for i in order]
        self.data = np.frombuffer(b"".join(self.texts), np.uint8)
        self.ends = np.cumsum([len(t) for t in self.texts])
        self.length = length
        runs = [self._runs(at) for at in range(0, len(self.data), PIECE)] or [(np.empty(0, int),) * 2 + (np.empty(0, U64),)]
        #: Runs of suffixes of one document with the same smallest hash.
        self.start, self.count, self.low = (np.concatenate(x) for x in zip(*runs))
        self.doc = np.searchsorted(self.ends, self.start, side="right")

    def _runs(self, at: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        gram = min(GRAM, self.length)
        part = self.data[at : at + PIECE + self.length - 1]
        low = window_minima(window_hashes(part, gram), self.length - gram + 1)
        if not len(low):
            return np.empty(0, int), np.empty(0, int), low
        change = np.ones(len(low), bool)
        change[1:] = low[1:] != low[:-1]
        whole = np.ones(len(low), bool)  # suffixes that have ``length`` bytes in their document
        for end in self.ends[np.searchsorted(self.ends, at) : np.searchsorted(self.ends, at + len(part))].tolist():
            whole[max(0, end - self.length + 1 - at) : max(0, end - at)] = False
            change[max(0, end - self.length + 1 - at) : end - at + 1] = True
        start = np.flatnonzero(change)
        count = np.diff(np.append(start, len(low)))
        kept = whole[start]
        # Smallest hashes are small; mixed again, they spread evenly over the buckets.
        return start[kept] + at, count[kept], mix(low[start[kept]])

    def lows(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct smallest hashes, and which of them two documents have."""
        order = np.argsort(self.low)
        low, doc = self.low[order], self.doc[order]
        first = np.ones(len(low), bool)
        first[1:] = low[1:] != low[:-1]
        starts = np.flatnonzero(first)
        self.low_number = np.empty(len(low), np.int64)  # of each run
        self.low_number[order] = np.cumsum(first) - 1
        if not len(starts):
            return low, np.empty(0, bool)
        return low[starts], np.minimum.reduceat(doc, starts) != np.maximum.reduceat(doc, starts)

    def _hashes(self, wanted: np.ndarray) -> np.ndarray:
        """The hashes of the suffixes at the ascending places ``wanted``; neighbours share their bytes."""
        out = [np.empty(0, U64)]
        for at in range(0, len(self.data), PIECE):
            a, b = np.searchsorted(wanted, [at, at + PIECE])
            if a < b:
                low, high = int(wanted[a]), int(wanted[b - 1]) + self.length
                out.append(window_hashes(self.data[low:high], self.length)[wanted[a:b] - low])
        return np.concatenate(out)

    def take(self, repeated: np.ndarray) -> None:
        """Work with the suffixes whose smallest hash (by number in ``lows``) is repeated; find what this chunk itself can tell."""
        chosen = repeated[self.low_number]
        start, count, low = self.start[chosen], self.count[chosen], self.low[chosen]
        self.at = run_positions(start, count)
        self.of_low = np.repeat(low, count)
        hashes = self._hashes(self.at)
        first, self.group = group_equal(hashes)
        doc = np.repeat(self.doc[chosen], count)
        rank = self.rank[doc]
        self.found = rank[first][self.group] < rank
        hit = np.flatnonzero(self.found)
        self.found[hit] = same_bytes(self.data, self.at[hit], self.at[first][self.group[hit]], self.length)
        #: Asked: each distinct suffix, where it starts first.
        once = np.zeros(len(hashes), bool)
        once[first] = True
        self.first = np.flatnonzero(once)
        self.asked_at, self.asked_low, self.asked_rank = self.at[self.first], self.of_low[self.first], rank[self.first]
        self.rank_of, self.same = rank, first

    def runs_asked(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(bucket, start, count, rank) of runs of asked suffixes, by bucket."""
        if not len(self.asked_at):
            return (np.empty(0, np.int64),) * 4
        change = np.ones(len(self.asked_at), bool)
        change[1:] = (np.diff(self.asked_at) != 1) | (self.asked_low[1:] != self.asked_low[:-1])
        start = np.flatnonzero(change)
        count = np.diff(np.append(start, len(change)))
        bucket = np.searchsorted(np.array([(i << 64) // buckets for i in range(1, buckets)], U64), self.asked_low[start], "right")
        order = np.argsort(bucket, kind="stable")
        self.run_order = order, start, count
        return bucket[order], self.asked_at[start[order]], count[order], self.asked_rank[start[order]]

    def removed(self, answers_: np.ndarray) -> np.ndarray:
        """Which suffixes taken start in a smaller document, with the answers in the order asked."""
        if not len(self.at):
            return np.empty(0, np.int64)
        order, start, count = self.run_order
        asked = np.zeros(len(self.asked_at), bool)
        asked[run_positions(start[order], count[order])] = answers_
        elsewhere = np.zeros(int(self.group.max()) + 1, bool)
        elsewhere[self.group[self.first]] = asked
        return self.at[self.found | elsewhere[self.group]]


def _ask_first(length: int, buckets: int):
    def run(rows: pa.Table) -> pa.Table:
        texts = Texts(rows, length)
        lows, twice = texts.lows()
        return questions(texts.number, lows, buckets, twice.astype(np.uint8))

    return run


def _answer_first(asked: pa.Table) -> pa.Table:
    keys, twice = unpack(asked["keys"], U64), unpack(asked["extra"], np.uint8)
    distinct, group, chunks = np.unique(keys, return_inverse=True, return_counts=True)
    repeated = (chunks > 1) | (np.bincount(group, weights=twice, minlength=len(distinct)) > 0)
    return answers(asked, repeated[group], FIRST, packed_bits=True)


def _ask_second(length: int, buckets: int):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return questions(0, np.empty(0, U64), buckets)
        texts = Texts(rows, length)
        lows, _ = texts.lows()
        texts.take(bits(replies, FIRST, lows, buckets))
        bucket, start, count, rank = texts.runs_asked(buckets)
        cuts = np.searchsorted(bucket, np.arange(buckets + 1))
        used = np.flatnonzero(np.diff(cuts))
        keys, extra, size = [], [], []
        for b in used.tolist():
            a, z = cuts[b], cuts[b + 1]
            head = np.empty(z - a, HEAD)
            head["doc"], head["n"] = rank[a:z], count[a:z]
            extra.append(head.tobytes())
            keys.append(texts.data[run_positions(start[a:z], count[a:z] + (length - 1))].tobytes())
            size.append(int(count[a:z].sum()))
        return pa.table(
            {
                "bucket": pa.array(used, pa.int32()),
                "chunk": pa.array([texts.number] * len(used), pa.int64()),
                "size": pa.array(size, pa.int32()),
                "keys": pa.array(keys, pa.binary()),
                "extra": pa.array(extra, pa.binary()),
            }
        )

    return run


def _answer_second(length: int):
    def run(asked: pa.Table) -> pa.Table:
        """A family of suffix arrays over all chunks' runs, by ascending document."""
        data, head = unpack(asked["keys"], np.uint8), unpack(asked["extra"], HEAD)
        count = head["n"].astype(np.int64)
        spans = count + (length - 1)
        start = np.cumsum(spans) - spans
        answer_at = np.cumsum(count) - count
        order = np.argsort(head["doc"], kind="stable")
        found = np.zeros(int(count.sum()), bool)
        family = SuffixFamily(data, length)
        done = np.cumsum(count[order])
        at = 0
        while at < len(order):
            to = max(at + 1, int(np.searchsorted(done, (done[at - 1] if at else 0) + BATCH, side="right")))
            part = order[at:to]
            places = run_positions(start[part], count[part])
            hashes = suffix_hashes(data, start[part], count[part], length)
            docs = np.repeat(head["doc"][part], count[part])
            found[run_positions(answer_at[part], count[part])] = family.add(hashes, places, docs)
            at = to
        return answers(asked, found, SECOND, packed_bits=True)

    return run


def _remove(length: int, buckets: int):
    def run(rows: pa.Table, replies: pa.Table) -> pa.Table:
        columns: dict[str, list] = {name: [] for name in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")}
        if rows.num_rows:
            texts = Texts(rows, length)
            lows, _ = texts.lows()
            texts.take(bits(replies, FIRST, lows, buckets))
            bucket, _, count, _ = texts.runs_asked(buckets)
            totals = np.bincount(bucket, weights=count, minlength=buckets).astype(np.int64)
            got = [np.unpackbits(np.frombuffer(a, np.uint8), count=totals[b]) for b, a in replies_in_order(replies, SECOND)]
            removed = texts.removed(np.concatenate(got).astype(bool) if got else np.empty(0, bool))
            apart = np.flatnonzero(np.diff(removed) > length) + 1
            gone = np.zeros(len(texts.data), bool)
            if len(removed):
                begin, end = removed[np.append(0, apart)], removed[np.append(apart, len(removed)) - 1] + length
                gone[run_positions(begin, end - begin)] = True
            begin = 0
            for doc_id, text, end in zip(texts.doc_ids, texts.texts, texts.ends.tolist()):
                own = gone[begin:end]
                n = int(own.sum())
                spans = int(own[0]) + int((own[1:] & ~own[:-1]).sum()) if n else 0
                kept = texts.data[begin:end][~own].tobytes() if n else text
                for name, value in zip(columns, (doc_id, end - begin, n, spans, hashlib.sha256(kept).hexdigest())):
                    columns[name].append(value)
                begin = end
        kinds = [pa.int64()] * 4 + [pa.string()]
        return pa.table({name: pa.array(v, kind) for (name, v), kind in zip(columns.items(), kinds)})

    return run


def remove_repeated_bytes(docs: DataFrame, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of what is left of each document.

    A byte goes if a string of ``length`` bytes covers it that also starts in a
    document with a smaller id.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    chunks = Chunked(rows, chunk_bytes, "texts")
    buckets = chunks.buckets
    first = chunks.staged(answer(chunks.ask(_ask_first(length, buckets)), _answer_first))
    second = answer(chunks.with_replies(first, _ask_second(length, buckets), chunks.asked), _answer_second(length))
    return chunks.with_replies(first.union(second), _remove(length, buckets), RESULT)


@query("op9_suffix_levels")
def op9_suffix_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))
