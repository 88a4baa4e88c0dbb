"""Documents in chunks, and questions that chunks put to each other.

A chunk is a bounded set of documents whose texts lie in one task. What a chunk
knows is a sorted array of 64-bit keys, each once. The key range is cut into
buckets; a bucket's task gets every chunk's keys of that range and answers each
chunk with one record for each of its keys, in the same order. A key that a
third of all rows hold therefore arrives once for each chunk, not once for each
row, and answers find their rows without carrying row ids.

The chunk table is written once, bucketed by chunk, so the passes over the
texts need no further shuffle of them.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path, stage

U64 = np.uint64

ASKED = "bucket int, chunk long, size int, keys binary, extra binary"
REPLIED = "round int, bucket int, chunk long, answer binary"


class Chunked:
    """The rows of ``df`` (which must have a column ``text``) as a table bucketed by ``chunk``."""

    def __init__(self, df: DataFrame, chunk_bytes: int, label: str):
        spark = df.sparkSession
        total = df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.chunks = max(1, -(-int(total) // chunk_bytes))
        self.buckets = max(1, self.chunks // 2)
        files = max(1, min(self.chunks, 4096))
        rows = df.withColumn("row_id", F.monotonically_increasing_id())
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("row_id"), F.lit(self.chunks)))
        name = f"chunks_{uuid.uuid4().hex}"
        (
            rows.repartition(files, "chunk")
            .write.bucketBy(files, "chunk")
            .sortBy("chunk")
            .option("path", scratch_path(spark, label))
            .saveAsTable(name)
        )
        self.table = spark.table(name)
        self.schema = self.table.schema

    asked = ASKED

    def staged(self, replies: DataFrame) -> DataFrame:
        """Answers that more than one pass needs, written once."""
        return stage(replies, "answers")

    def ask(self, fn: Callable[[pa.Table], pa.Table]) -> DataFrame:
        """Questions (ASKED) from each chunk alone."""
        return self.table.groupBy("chunk").applyInArrow(fn, ASKED)

    def with_replies(self, replies: DataFrame, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
        """``fn`` over each chunk's rows and the answers it got."""
        return self.table.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(fn, schema)


def answer(asked: DataFrame, fn: Callable[[pa.Table], pa.Table]) -> DataFrame:
    """Answers (REPLIED) of each bucket."""
    return asked.groupBy("bucket").applyInArrow(fn, REPLIED)


def bucket_edges(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each of ``buckets`` equal ranges of 64-bit keys starts and ends in sorted ``keys``."""
    cuts = [(i << 64) // buckets for i in range(1, buckets)]
    return np.concatenate([[0], np.searchsorted(keys, np.array(cuts, U64)), [len(keys)]]).astype(np.int64)


def questions(chunk: int, keys: np.ndarray, buckets: int, extra: np.ndarray | None = None) -> pa.Table:
    """One row per bucket that gets any of the sorted keys, with ``extra`` (same length) beside them."""
    edges = bucket_edges(keys, buckets)
    used = np.flatnonzero(np.diff(edges))
    return pa.table(
        {
            "bucket": pa.array(used, pa.int32()),
            "chunk": pa.array(np.full(len(used), chunk), pa.int64()),
            "size": pa.array(np.diff(edges)[used], pa.int32()),
            "keys": pa.array([keys[edges[b] : edges[b + 1]].tobytes() for b in used], pa.binary()),
            "extra": pa.array(
                [None if extra is None else extra[edges[b] : edges[b + 1]].tobytes() for b in used], pa.binary()
            ),
        }
    )


def unpack(column: pa.ChunkedArray, dtype) -> np.ndarray:
    """The arrays of a binary column, joined."""
    parts = [np.frombuffer(x, dtype) for x in column.to_pylist() if x]
    return np.concatenate(parts) if parts else np.empty(0, dtype)


def answers(asked: pa.Table, records: np.ndarray, round_: int, packed_bits: bool = False) -> pa.Table:
    """``records`` follow the order of all keys in ``asked``; cut them up again by row."""
    ends = np.cumsum(np.array(asked["size"], np.int64))
    cut = np.split(records, ends[:-1])
    return pa.table(
        {
            "round": pa.array(np.full(asked.num_rows, round_), pa.int32()),
            "bucket": asked["bucket"].cast(pa.int32()),
            "chunk": asked["chunk"].cast(pa.int64()),
            "answer": pa.array([(np.packbits(c) if packed_bits else c).tobytes() for c in cut], pa.binary()),
        }
    )


def replies_in_order(replies: pa.Table, round_: int) -> list[tuple[int, bytes]]:
    """(bucket, answer) of one round by ascending bucket."""
    rows = zip(replies["round"].to_pylist(), replies["bucket"].to_pylist(), replies["answer"].to_pylist())
    return sorted((b, a) for r, b, a in rows if r == round_)


def bits(replies: pa.Table, round_: int, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The yes/no answers of one round for the sorted keys that were asked."""
    edges = bucket_edges(keys, buckets)
    out = np.zeros(len(keys), bool)
    for b, a in replies_in_order(replies, round_):
        n = edges[b + 1] - edges[b]
        out[edges[b] : edges[b + 1]] = np.unpackbits(np.frombuffer(a, np.uint8), count=n).astype(bool)
    return out
