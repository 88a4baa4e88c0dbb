"""Token ids in files, with frequency-ranked byte-aligned codes.

The file format is a Parquet container with one row for each block of documents
in ascending id order (null ids first, ties by a hash of the text):

======== ========================================================================
part     the range of ids that the block is in; ranges ascend
block    the block's number in its range
doc_ids  int64 little-endian, one for each document; ``doc_null`` marks null ids
lengths  uint32, ids of each document with the end id
ranked   uint32, the block's distinct ids, the most frequent first
control  two bits for each id, four ids a byte, low bits first: bytes used less 1
data     the rank of each id, in 1 to 4 little-endian bytes
======== ========================================================================

A block carries its own table of ranks, so blocks are written in one pass over
the texts, and a lost or damaged file affects no other.

Null and empty texts have only the end id. Repeated rows stay rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import scratch_path
from .common import query, table, text_batches
from .piece_text import Pieces, piece_ids, whole_ids

BATCH_CHARS = 1_000_000
BLOCK_IDS = 4_000_000
CACHED_PIECES = 200_000  # in each of two parts, about 200 bytes each
END_ID = 0

BLOCKS = (
    "part int, block int, n_ids long, doc_ids binary, doc_null binary, lengths binary, "
    "ranked binary, control binary, data binary"
)
DECODED = "part int, block int, doc_id long, start_in_block long, n_tokens long, ids_crc32 long"

# --- the codes ----------------------------------------------------------------


def encode_ids(ids: np.ndarray) -> tuple[bytes, bytes, bytes]:
    """(ranked, control, data) of an array of ids."""
    if not len(ids):
        return b"", b"", b""
    times = np.bincount(ids)
    used = np.flatnonzero(times)
    ranked = used[np.argsort(-times[used], kind="stable")]
    rank_of = np.zeros(len(times), np.uint32)
    rank_of[ranked] = np.arange(len(ranked), dtype=np.uint32)
    ranks = rank_of[ids]
    size = np.ones(len(ids), np.uint8)
    for limit in (1 << 8, 1 << 16, 1 << 24):
        size += ranks >= limit
    ends = np.cumsum(size, dtype=np.int64)
    data = np.empty(int(ends[-1]), np.uint8)
    starts = ends - size
    data[starts] = ranks & 0xFF
    for k in range(1, int(size.max())):
        wide = np.flatnonzero(size > k)
        data[starts[wide] + k] = (ranks[wide] >> (8 * k)) & 0xFF
    codes = np.zeros(-(-len(ids) // 4) * 4, np.uint8)
    codes[: len(ids)] = size - 1
    codes = codes.reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    return ranked.astype("<u4").tobytes(), control.tobytes(), data.tobytes()


#: The four sizes that each control byte stands for.
SIZES = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3).astype(np.uint8) + np.uint8(1)


def decode_ids(n: int, ranked: bytes, control: bytes, data: bytes) -> np.ndarray:
    size = SIZES[np.frombuffer(control, np.uint8)].ravel()[:n]
    ends = np.cumsum(size, dtype=np.int64)
    starts = ends - size
    raw = np.frombuffer(data, np.uint8)
    ranks = raw[starts].astype(np.uint32)
    for k in range(1, int(size.max()) if n else 0):
        wide = np.flatnonzero(size > k)
        ranks[wide] |= raw[starts[wide] + k].astype(np.uint32) << np.uint32(8 * k)
    return np.frombuffer(ranked, "<u4")[ranks]


# --- writing ------------------------------------------------------------------

class PieceCache:
    """The ids of pieces met lately: a full part replaces the one before it, and what is met again moves on."""

    def __init__(self, path: str):
        self.path = path
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ids(self, piece: str) -> bytes:
        got = self.young.get(piece)
        if got is None:
            got = self.old.get(piece)
            if got is None:
                got = np.array(piece_ids(self.path, piece), "<u4").tobytes()
            if len(self.young) >= CACHED_PIECES:
                self.old, self.young = self.young, {}
            self.young[piece] = got
        return got


@lru_cache(1)
def _cache(path: str) -> PieceCache:
    return PieceCache(path)


def token_arrays(path: str, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
    """The ids of each text, with ``end_id`` after them if given."""
    pieces = Pieces(texts)
    coded = [*map(_cache(path).ids, pieces.distinct)]
    length = np.array([len(c) // 4 for c in coded], np.int64)
    pool = np.frombuffer(b"".join(coded), "<u4")
    first = np.cumsum(length) - length
    n = length[pieces.of]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    source = np.repeat(first[pieces.of] - (ends - n), n) + np.arange(total)
    ids = pool[source]
    cuts = np.concatenate([[0], ends])[np.searchsorted(pieces.doc, np.arange(len(texts) + 1))]
    hard = set(pieces.hard)
    tail = np.array([] if end_id is None else [end_id], np.uint32)
    return [
        np.concatenate([np.array(whole_ids(path, t), np.uint32) if i in hard else ids[cuts[i] : cuts[i + 1]], tail])
        for i, t in enumerate(texts)
    ]


def _block_row(part: int, block: int, doc_ids: list, arrays: list[np.ndarray]) -> pa.RecordBatch:
    ranked, control, data = encode_ids(np.concatenate(arrays))
    row = {
        "part": pa.array([part], pa.int32()),
        "block": pa.array([block], pa.int32()),
        "n_ids": pa.array([sum(map(len, arrays))], pa.int64()),
        "doc_ids": np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
        "doc_null": np.array([d is None for d in doc_ids], np.uint8).tobytes(),
        "lengths": np.array([len(a) for a in arrays], "<u4").tobytes(),
        "ranked": ranked,
        "control": control,
        "data": data,
    }
    return pa.RecordBatch.from_pydict({k: pa.array([v], pa.binary()) if isinstance(v, bytes) else v for k, v in row.items()})


def _write(path: str, end_id: int, block_ids: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, block = TaskContext.get().partitionId(), 0
        doc_ids: list = []
        arrays: list[np.ndarray] = []
        held = 0
        for batch, texts in text_batches(batches, "text", BATCH_CHARS):
            for doc_id, array in zip(batch.column("doc_id").to_pylist(), token_arrays(path, texts, end_id)):
                if arrays and held + len(array) > block_ids:
                    yield _block_row(part, block, doc_ids, arrays)
                    doc_ids, arrays, held, block = [], [], 0, block + 1
                doc_ids.append(doc_id)
                arrays.append(array)
                held += len(array)
        if arrays:
            yield _block_row(part, block, doc_ids, arrays)

    return write


def write_token_files(
    docs: DataFrame, path: str, where: str, end_id: int = END_ID, block_ids: int = BLOCK_IDS
) -> None:
    """Encode every text and write the blocks to the folder ``where``.

    ``path``: a byte-level BPE file of the tokenizers library.
    """
    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .drop("tie")
    )
    blocks = ordered.mapInArrow(_write(path, end_id, block_ids), BLOCKS)
    blocks.write.option("compression", "zstd").parquet(where)


# --- reading ------------------------------------------------------------------


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, np.ndarray, list, np.ndarray]]:
    for batch in batches:
        for row in range(batch.num_rows):
            r = batch.slice(row, 1).to_pylist()[0]
            ids = decode_ids(r["n_ids"], r["ranked"], r["control"], r["data"])
            nulls = np.frombuffer(r["doc_null"], np.uint8)
            doc_ids = [None if z else d for d, z in zip(np.frombuffer(r["doc_ids"], "<i8").tolist(), nulls)]
            ends = np.cumsum(np.frombuffer(r["lengths"], "<u4"), dtype=np.int64)
            yield r, ids, doc_ids, ends


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for r, ids, doc_ids, ends in _documents(batches):
        raw = ids.astype("<u4")
        starts = np.concatenate([[0], ends[:-1]])
        n = len(doc_ids)
        yield pa.RecordBatch.from_pydict(
            {
                "part": pa.array([r["part"]] * n, pa.int32()),
                "block": pa.array([r["block"]] * n, pa.int32()),
                "doc_id": pa.array(doc_ids, pa.int64()),
                "start_in_block": pa.array(starts, pa.int64()),
                "n_tokens": pa.array(ends - starts, pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(raw[a:b].tobytes()) for a, b in zip(starts, ends)], pa.int64()),
            }
        )


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for _, ids, doc_ids, ends in _documents(batches):
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(doc_ids, pa.int64()),
                "ids": pa.array([x.tolist() for x in np.split(ids, ends[:-1])], pa.list_(pa.int64())),
            }
        )


def read_token_files(spark: SparkSession, where: str) -> DataFrame:
    """doc_id and ids of every document in the folder."""
    return spark.read.schema(BLOCKS).parquet(where).mapInArrow(_ids, "doc_id long, ids array<long>")


def token_file_index(spark: SparkSession, where: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the files."""
    blocks = spark.read.schema(BLOCKS).parquet(where)
    in_part = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    sizes = blocks.select("part", "block", "n_ids")
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))
    parts = parts.select("part", F.coalesce(F.sum("n_ids").over(by_part), F.lit(0)).alias("part_start"))
    before = sizes.select("part", "block", F.coalesce(F.sum("n_ids").over(in_part), F.lit(0)).alias("block_start"))
    found = blocks.mapInArrow(_digest, DECODED)
    return found.join(before, ["part", "block"]).join(parts, "part").select(
        "doc_id",
        (F.col("part_start") + F.col("block_start") + F.col("start_in_block")).alias("start"),
        "n_tokens",
        "ids_crc32",
    )


def token_files(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Write the files to the shared folder and return their index."""
    where = scratch_path(docs.sparkSession, "tokens")
    write_token_files(docs, path, where, end_id)
    return token_file_index(docs.sparkSession, where)


@query("op10_token_files")
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
