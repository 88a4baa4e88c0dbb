"""Token ids of two tokenizers aligned by the bytes they cover, with corpus-wide link counts.

A is a byte-level tokenizer of the tokenizers library, given a blank and the
text; B is a sentencepiece model, which adds that blank itself.

1. Each task encodes its texts with both. The cumulative ends of a text's A tokens
   and of its B tokens become two dictionaries from end to index; the keys that
   both hold, sorted, cut the id lists into groups of equal bytes. Tokens have
   at least one byte, so each such key is the end of one A and one B token: the
   link of its group.
2. A chunk of texts keeps a dictionary of its distinct links. The dictionaries,
   at most one row for each chunk and link, are summed over the corpus, and each
   B id's largest count is found. (A link is a pair of vocabulary entries.)
3. The counts go back to the chunks and are summed for each document.

The library encodes each distinct piece of a batch once: B's segments are a run
of blanks and what follows it, which no piece of the model crosses (checked when
the model is loaded), A's are its pre-tokens.

Texts that are null or empty, or whose tokens do not spell their bytes (a text
with the model's own blank sign, say), have no tokens: zeros and an empty
column. Special strings inside texts are plain text. Rows with equal or null ids
stay rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .common import query, table, text_batches, utf8
from .piece_text import SYMBOLS, Pieces, load_tokenizer, piece_ids

BATCH_CHARS = 1_000_000
CHUNK_CHARS = 16_000_000
CACHED_PIECES = 700_000

DOCS, LINKS = 0, 1
PARTS = (
    "kind int, chunk long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "links binary, times binary, a int, b int, n long"
)
RESULT = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)

#: A run of blanks and what follows it.
SEGMENT = re.compile(" +[^ ]*")
BLANK_SIGN = "▁"


class _Vocabulary:
    """The bytes of each id, and its decimal text before each separator."""

    SEPARATORS = (",", "|", ";", "")

    def __init__(self, tokens: list[bytes]):
        self.tokens = tokens
        self.size = len(tokens)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.written = [f"{i}{s}" for s in self.SEPARATORS for i in range(self.size)]


@lru_cache(4)
def _byte_level(path: str):
    """(vocabulary, tokenizer that takes special strings as plain text)."""
    tokenizer = type(load_tokenizer(path)).from_file(path)  # not the one that others use with its default
    tokenizer.encode_special_tokens = True
    back = {s: b for b, s in SYMBOLS.items()}
    entries = tokenizer.get_vocab(with_added_tokens=True)
    tokens = [b""] * (max(entries.values()) + 1)
    for entry, i in entries.items():
        tokens[i] = bytes(back[c] for c in entry)
    return _Vocabulary(tokens), tokenizer


@lru_cache(4)
def _sentence_pieces(path: str):
    """(vocabulary, model)."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    tokens = []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if BLANK_SIGN in piece.lstrip(BLANK_SIGN):
            raise ValueError(f"{path}: piece {piece!r} goes on after a blank")
        plain = b"" if model.is_control(i) else piece.replace(BLANK_SIGN, " ").encode("utf-8")
        tokens.append(bytes([int(piece[3:5], 16)]) if model.is_byte(i) else plain)
    return _Vocabulary(tokens), model


class _Ids:
    """The ids of strings as packed int32, or None where the ids do not spell the string's bytes.

    ``encode`` gets several strings at once; pieces are encoded once each.
    """

    def __init__(self, vocabulary: _Vocabulary, encode):
        self.vocabulary, self.encode = vocabulary, encode
        self.known: dict[str, bytes | None] = {}

    def spelled(self, texts: list[str]) -> list[bytes | None]:
        token = self.vocabulary.tokens.__getitem__
        return [
            np.array(ids, np.int32).tobytes() if b"".join(map(token, ids)) == utf8(text) else None
            for text, ids in zip(texts, self.encode(texts))
        ]

    def of(self, pieces: list[str]) -> list[bytes | None]:
        new = list(set(pieces).difference(self.known))
        if len(self.known) + len(new) > CACHED_PIECES:
            self.known.clear()
            new = list(set(pieces))
        self.known.update(zip(new, self.spelled(new)))
        return list(map(self.known.__getitem__, pieces))


def _joined(parts: list[bytes | None]) -> np.ndarray | None:
    return None if None in parts else np.frombuffer(b"".join(parts), np.int32)


@lru_cache(4)
def _encoders(path_a: str, path_b: str) -> tuple[_Ids, _Ids]:
    vocabulary_a, _ = _byte_level(path_a)
    vocabulary_b, model = _sentence_pieces(path_b)
    blank = model.piece_to_id(BLANK_SIGN)

    def segment_ids(segments: list[str]) -> list[list[int]]:
        # the model puts a blank before what it gets, but gives an empty string no token
        return [ids or [blank] for ids in model.encode([s[1:] for s in segments], num_threads=1)]

    return _Ids(vocabulary_a, lambda pieces: [piece_ids(path_a, p) for p in pieces]), _Ids(vocabulary_b, segment_ids)


def both_ids(path_a: str, path_b: str, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
    """The A and B ids of a blank and each text; None for texts without tokens."""
    of_a, of_b = _encoders(path_a, path_b)
    vocabulary, tokenizer = _byte_level(path_a)
    plain = _Ids(vocabulary, lambda some: [tokenizer.encode(t, add_special_tokens=False).ids for t in some])
    whole = [" " + t if t else "" for t in texts]
    pieces = Pieces(whole)
    ids = of_a.of(pieces.distinct)
    edges = np.searchsorted(pieces.doc, np.arange(len(texts) + 1)).tolist()
    of, hard = pieces.of.tolist(), set(pieces.hard)
    segments = list(map(SEGMENT.findall, whole))
    b_parts = of_b.of([s for own in segments for s in own])
    out, at = [], 0
    for i, text in enumerate(texts):
        own = b_parts[at : at + len(segments[i])]
        at += len(segments[i])
        if not text:
            out.append(None)
            continue
        a = _joined(plain.spelled([whole[i]]) if i in hard else [ids[k] for k in of[edges[i] : edges[i + 1]]])
        b = _joined(own)
        out.append(None if a is None or b is None else (a, b))
    return out


def align(a: np.ndarray, b: np.ndarray, length_a: np.ndarray, length_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group of equal bytes, in order, the index of its last A token and of its last B token.

    ``length_a`` and ``length_b``: bytes of the tokens of ``a`` and ``b``, each at least one.
    """
    index_a = dict(zip(np.cumsum(length_a).tolist(), range(len(a))))
    index_b = dict(zip(np.cumsum(length_b).tolist(), range(len(b))))
    common = sorted(index_a.keys() & index_b.keys())
    n = len(common)
    return np.fromiter(map(index_a.__getitem__, common), np.int64, n), np.fromiter(map(index_b.__getitem__, common), np.int64, n)


def written_groups(a, b, last_a, last_b, vocabulary_a: _Vocabulary, vocabulary_b: _Vocabulary) -> str:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group in decimal."""
    size_a, size_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
    group_a, group_b = np.repeat(np.arange(len(last_a)), size_a), np.repeat(np.arange(len(last_b)), size_b)
    before_b = np.concatenate([[0], last_b[:-1] + 1])  # B tokens of all groups before
    place_a = np.arange(len(a)) + before_b[group_a]
    place_b = np.arange(len(b)) + last_a[group_b] + 1
    comma, bar, semicolon, nothing = range(4)
    after_a, after_b = np.full(len(a), comma), np.full(len(b), comma)
    after_a[last_a] = bar
    after_b[last_b] = semicolon
    after_b[-1] = nothing
    code = np.empty(len(a) + len(b), np.int64)
    code[place_a] = after_a * vocabulary_a.size + a
    shift = len(vocabulary_a.written)
    code[place_b] = shift + after_b * vocabulary_b.size + b
    return "".join(map(_both_written(vocabulary_a, vocabulary_b).__getitem__, code.tolist()))


_written: dict[tuple[int, int], list[str]] = {}


def _both_written(a: _Vocabulary, b: _Vocabulary) -> list[str]:
    key = id(a), id(b)
    if key not in _written:
        _written[key] = a.written + b.written
    return _written[key]


class _Chunk:
    """Documents and the distinct links among them."""

    def __init__(self, number: int):
        self.number = number
        self.codes: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []
        self.docs: list[tuple] = []
        self.chars = 0

    def add(self, doc_id: int | None, ids, vocabulary_a: _Vocabulary, vocabulary_b: _Vocabulary) -> None:
        if ids is None:
            self.docs.append((doc_id, 0, 0, 0, 0, ""))
            own, times = np.empty(0, np.int64), np.empty(0, np.int64)
        else:
            a, b = ids
            last_a, last_b = align(a, b, vocabulary_a.length[a], vocabulary_b.length[b])
            text = written_groups(a, b, last_a, last_b, vocabulary_a, vocabulary_b)
            n = len(last_a)
            self.docs.append((doc_id, len(a), len(b), n, n, hashlib.sha256(text.encode()).hexdigest()))
            own, times = np.unique(a[last_a].astype(np.int64) << 32 | b[last_b], return_counts=True)
        self.codes.append(own)
        self.counts.append(times)

    def rows(self) -> Iterator[pa.RecordBatch]:
        every = np.concatenate(self.codes)
        distinct, place = np.unique(every, return_inverse=True)
        total = np.bincount(place, np.concatenate(self.counts), len(distinct)).astype(np.int64)
        yield _batch(
            len(distinct), kind=LINKS, chunk=self.number, a=distinct >> 32, b=distinct & 0xFFFFFFFF, n=total
        )
        ends = np.cumsum([len(c) for c in self.codes]).tolist()
        place = place.astype("<u4")
        links = [place[e - len(c) : e].tobytes() for e, c in zip(ends, self.codes)]
        times = [t.astype("<u4").tobytes() for t in self.counts]
        names = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
        for at in range(0, len(self.docs), 2000):
            part = slice(at, at + 2000)
            columns = dict(zip(names, map(list, zip(*self.docs[part]))))
            yield _batch(len(links[part]), kind=DOCS, chunk=self.number, links=links[part], times=times[part], **columns)


_SCHEMA = pa.schema(
    [
        ("kind", pa.int32()), ("chunk", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
        ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("links", pa.binary()),
        ("times", pa.binary()), ("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64()),
    ]
)


def _batch(rows: int, **columns) -> pa.RecordBatch:
    def column(field: pa.Field) -> pa.Array:
        value = columns.get(field.name)
        if value is None:
            return pa.nulls(rows, field.type)
        return pa.array(np.full(rows, value) if isinstance(value, int) else value, field.type)

    return pa.RecordBatch.from_arrays([column(f) for f in _SCHEMA], schema=_SCHEMA)


def _split(path_a: str, path_b: str):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary_a, vocabulary_b = _byte_level(path_a)[0], _sentence_pieces(path_b)[0]
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number)
        for batch, texts in text_batches(batches, "text", BATCH_CHARS):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), both_ids(path_a, path_b, texts)):
                chunk.add(doc_id, ids, vocabulary_a, vocabulary_b)
            chunk.chars += sum(map(len, texts))
            if chunk.chars >= CHUNK_CHARS:
                yield from chunk.rows()
                number += 1
                chunk = _Chunk(number)
        if chunk.docs:
            yield from chunk.rows()

    return split


def _sum(docs: pa.Table, links: pa.Table) -> pa.Table:
    """The documents of a chunk with the counts of their links."""
    order = np.lexsort([links["b"].to_numpy(), links["a"].to_numpy()])
    total = links["total"].to_numpy()[order]
    best = links["is_best"].to_numpy().astype(bool)[order]
    n_best, count_sum = [], []
    for own, times in zip(docs["links"].to_pylist(), docs["times"].to_pylist()):
        place, n = np.frombuffer(own, "<u4"), np.frombuffer(times, "<u4").astype(np.int64)
        n_best.append(int(n[best[place]].sum()))
        count_sum.append(int(total[place] @ n))
    out = docs.select(["doc_id", "n_a", "n_b", "n_groups", "n_links"])
    out = out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64()))
    return out.append_column("groups_sha256", docs["groups_sha256"])


def _read(spark: SparkSession, where: str, kind: int) -> DataFrame:
    return spark.read.schema(PARTS).parquet(where).where(F.col("kind") == kind)


def align_tokens(docs: DataFrame, path_a: str, path_b: str) -> tuple[DataFrame, DataFrame]:
    """(a row for each document, a row for each linked pair of ids: a, b, total and is_best)."""
    spark = docs.sparkSession
    where = scratch_path(spark, "links")
    parts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_split(path_a, path_b), PARTS)
    parts.write.partitionBy("kind").option("compression", "zstd").parquet(where)
    links = _read(spark, where, LINKS).select("chunk", "a", "b", "n")
    totals = links.groupBy("a", "b").agg(F.sum("n").alias("total"))
    highest = totals.groupBy("b").agg(F.max("total").alias("highest"))
    pairs = totals.join(highest, "b").select("a", "b", "total", (F.col("total") == F.col("highest")).alias("is_best"))
    told = links.select("chunk", "a", "b").join(pairs, ["a", "b"])
    of_docs = _read(spark, where, DOCS).drop("kind", "a", "b", "n")
    per_doc = of_docs.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_sum, RESULT)
    return per_doc, pairs


def aligned_groups(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """The groups themselves: doc_id, group, byte_end, and the A and B ids of each."""

    def groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary_a, vocabulary_b = _byte_level(path_a)[0], _sentence_pieces(path_b)[0]
        for batch, texts in text_batches(batches, "text", BATCH_CHARS):
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), both_ids(path_a, path_b, texts)):
                if ids is None:
                    continue
                a, b = ids
                ends = np.cumsum(vocabulary_a.length[a])
                last_a, last_b = align(a, b, vocabulary_a.length[a], vocabulary_b.length[b])
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": pa.array([doc_id] * len(last_a), pa.int64()),
                        "group": pa.array(range(len(last_a)), pa.int64()),
                        "byte_end": pa.array(ends[last_a], pa.int64()),
                        "a": pa.ListArray.from_arrays(pa.array(np.append(0, last_a + 1), pa.int32()), pa.array(a, pa.int32())),
                        "b": pa.ListArray.from_arrays(pa.array(np.append(0, last_b + 1), pa.int32()), pa.array(b, pa.int32())),
                    }
                )

    schema = "doc_id long, group long, byte_end long, a array<int>, b array<int>"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(groups, schema)


@query("op11_aligned_tokens")
def op11_aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path
    return align_tokens(table(spark, sf_dir, "documents"), path("byte_bpe_50k.json"), path("piece_bpe_32k.model"))[0]
