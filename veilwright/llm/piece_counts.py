"""Token counts of documents, with each distinct pre-token counted once.

1. Each task cuts its texts into pre-tokens and keeps, for a chunk of them, a
   dictionary of the distinct pieces and, for each document, (piece, frequency).
   Both are written once to the shared folder.
2. The chunks' dictionaries meet by a hash of the piece. There the tokenizer's
   model counts every distinct piece of the corpus once.
3. The counts go back to the chunks and are summed with the frequencies.

Token ids are never stored. Texts with the special string, or with characters
newer than this Python's tables, are counted whole by the library in step 1.
Null and empty texts have no tokens; rows with equal or null ids stay rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path
from .common import query, table, text_batches, utf8
from .piece_text import Pieces, piece_ids, whole_ids

CHUNK_CHARS = 24_000_000
BATCH_CHARS = 2_000_000
BUCKET_BYTES = 4_000_000

PIECES, DOCS = 0, 1
PARTS = (
    "kind int, chunk long, bucket int, pieces array<string>, "
    "doc_id long, n_bytes long, counted long, ids binary, times binary"
)
RESULT = "doc_id long, n_bytes long, n_tokens long"


def _planes(values: np.ndarray) -> bytes:
    """Small numbers by byte plane: the upper planes are zeros, which shuffles compress away."""
    return np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(4, -1).T).view("<u4").ravel()


class _Chunk:
    def __init__(self, number: int, buckets: int):
        self.number, self.buckets = number, buckets
        self.index: dict[str, int] = {}
        self.docs: list[tuple] = []  # (doc_id, bytes, tokens counted already, piece numbers, times)
        self.chars = 0

    def add(self, ids: list, texts: list[str], path: str) -> None:
        pieces = Pieces(texts)
        known = self.index
        number = np.array([known.setdefault(p, len(known)) for p in pieces.distinct], np.int64)
        edges = np.searchsorted(pieces.doc, np.arange(len(texts) + 1))
        hard = set(pieces.hard)
        for i, text in enumerate(texts):
            own, times = np.unique(pieces.of[edges[i] : edges[i + 1]], return_counts=True)
            counted = len(whole_ids(path, text)) if i in hard else 0
            self.docs.append((ids[i], len(utf8(text)), counted, number[own], times))
        self.chars += sum(map(len, texts))

    def rows(self) -> Iterator[pa.RecordBatch]:
        words = list(self.index)
        bucket = np.array([xxhash.xxh64_intdigest(utf8(w)) % self.buckets for w in words], np.int64)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        used, first = np.unique(bucket[order], return_index=True)
        ends = [*first[1:].tolist(), len(words)]
        n = len(used)
        yield _batch(
            kind=[PIECES] * n,
            chunk=[self.number] * n,
            bucket=used.tolist(),
            pieces=[[words[j] for j in order[a:b].tolist()] for a, b in zip(first.tolist(), ends)],
        )
        for at in range(0, len(self.docs), 2000):
            part = self.docs[at : at + 2000]
            ids, times = [], []
            for *_, own, count in part:
                own = place[own]
                by_place = np.argsort(own)
                ids.append(_planes(np.diff(own[by_place], prepend=0)))
                times.append(_planes(count[by_place]))
            yield _batch(
                kind=[DOCS] * len(part),
                chunk=[self.number] * len(part),
                doc_id=[d[0] for d in part],
                n_bytes=[d[1] for d in part],
                counted=[d[2] for d in part],
                ids=ids,
                times=times,
            )


_SCHEMA = pa.schema(
    [
        ("kind", pa.int32()), ("chunk", pa.int64()), ("bucket", pa.int32()), ("pieces", pa.list_(pa.string())),
        ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("counted", pa.int64()), ("ids", pa.binary()),
        ("times", pa.binary()),
    ]
)


def _batch(**columns: list) -> pa.RecordBatch:
    n = len(columns["kind"])
    return pa.RecordBatch.from_arrays(
        [pa.array(columns.get(f.name) or [None] * n, f.type) for f in _SCHEMA], schema=_SCHEMA
    )


def _split(path: str, buckets: int):
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        chunk = _Chunk(number, buckets)
        for batch, texts in text_batches(batches, "text", BATCH_CHARS):
            chunk.add(batch.column("doc_id").to_pylist(), texts, path)
            if chunk.chars >= CHUNK_CHARS:
                yield from chunk.rows()
                number += 1
                chunk = _Chunk(number, buckets)
        if chunk.docs:
            yield from chunk.rows()

    return split


def _count(path: str):
    def count(asked: pa.Table) -> pa.Table:
        """How many tokens each piece has, for every chunk that asks."""
        lists = asked["pieces"].combine_chunks()
        words = lists.flatten().dictionary_encode()
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        each = np.array([len(piece_ids(path, w)) for w in words.dictionary.to_pylist()], np.uint32)
        counts = each[words.indices.to_numpy()]
        sizes = np.diff(np.asarray(lists.offsets))
        cut = np.split(counts, np.cumsum(sizes)[:-1])
        return pa.table({"chunk": asked["chunk"], "bucket": asked["bucket"], "counts": [_planes(c) for c in cut]})

    return count


def _sum(docs: pa.Table, replies: pa.Table) -> pa.Table:
    order = np.argsort(np.array(replies["bucket"].to_pylist(), np.int64))
    parts = replies["counts"].to_pylist()
    counts = np.concatenate([_from_planes(parts[i]) for i in order] or [np.empty(0, np.uint32)]).astype(np.int64)
    totals = []
    for ids, times, counted in zip(*(docs[c].to_pylist() for c in ("ids", "times", "counted"))):
        own = np.cumsum(_from_planes(ids), dtype=np.int64)
        totals.append(counted + int(counts[own] @ _from_planes(times).astype(np.int64)))
    return pa.table({"doc_id": docs["doc_id"], "n_bytes": docs["n_bytes"], "n_tokens": pa.array(totals, pa.int64())})


def count_tokens(docs: DataFrame, path: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of each document, without special tokens added.

    ``path``: a byte-level BPE file of the tokenizers library.
    """
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(8, -(-int(size) // BUCKET_BYTES))
    where = scratch_path(spark, "pieces")
    parts = source.mapInArrow(_split(path, buckets), PARTS)
    parts.write.partitionBy("kind").option("compression", "zstd").parquet(where)
    staged = spark.read.schema(parts.schema).parquet(where)
    counts = (
        staged.where(F.col("kind") == PIECES)
        .select("bucket", "chunk", "pieces")
        .groupBy("bucket")
        .applyInArrow(_count(path), "chunk long, bucket int, counts binary")
    )
    per_doc = staged.where(F.col("kind") == DOCS).select("chunk", "doc_id", "n_bytes", "counted", "ids", "times")
    summed = per_doc.groupBy("chunk").cogroup(counts.groupBy("chunk")).applyInArrow(_sum, RESULT)
    return summed.withColumn("over_limit", F.col("n_tokens") > limit)


@query("op5_token_counts")
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
