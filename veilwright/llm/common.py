"""The registry of this subpackage, and helpers that several operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import stage

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: ASCII white space, which separates words; everything else is part of a word.
WORD = r"[^\x20\x09-\x0D]+"

U64 = np.uint64


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted += "_"
    return wanted


NUMBERED_FILES = 20_000
FILE_BITS = 40  # rows of a file


def with_row_id(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    """``df`` with a number for each row, and that column's name.

    The numbers tell rows apart where ids repeat or are null, and stay the same
    between two reads whatever executors are lost: in a table read from Parquet,
    they are the row's place in its file. Other tables, and tables of very many
    files, are written once with numbers.
    """
    name = fresh_name(df, "row_id")
    placed = _by_place(df, name)
    return (stage(df.withColumn(name, F.monotonically_increasing_id()), label) if placed is None else placed), name


def _by_place(df: DataFrame, name: str) -> DataFrame | None:
    path, place = fresh_name(df, "path_of_row"), fresh_name(df, "place_of_row")
    try:
        placed = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place))
    except AnalysisException:  # not read from Parquet files
        return None
    paths = sorted(r[0] for r in placed.select(path).distinct().limit(NUMBERED_FILES + 1).collect())
    if not paths or len(paths) > NUMBERED_FILES:
        return None
    first = fresh_name(placed, "first_of_file")
    numbers = df.sparkSession.createDataFrame([(p, i << FILE_BITS) for i, p in enumerate(paths)], f"{path} string, {first} long")
    numbered = placed.join(F.broadcast(numbers), path)  # at most NUMBERED_FILES rows
    return numbered.withColumn(name, F.col(first) + F.col(place)).drop(path, place, first)


def utf8(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


def text_batches(
    batches: Iterator[pa.RecordBatch], column: str, limit: int
) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches whose texts have about ``limit`` characters together (one text at least).

    Null texts come as empty ones.
    """
    for batch in batches:
        texts = batch.column(column).to_pylist()
        start, size = 0, 0
        for i, text in enumerate(texts):
            n = len(text) if text else 0
            if i > start and size + n > limit:
                yield batch.slice(start, i - start), [t or "" for t in texts[start:i]]
                start, size = i, 0
            size += n
        if texts:
            yield batch.slice(start), [t or "" for t in texts[start:]]


# --- hashes of slices of a byte or code point array ---------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of each element (a bijection)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(31)
    x *= U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


class SliceHash:
    """Hashes of slices of one array by differences of a running polynomial sum modulo 2^64."""

    BASE = 0x2545F4914F6CDD1D  # odd, so it has an inverse
    _powers = _inverse = np.ones(1, U64)

    def __init__(self, symbols: np.ndarray):
        n = len(symbols)
        cls = SliceHash
        if len(cls._powers) <= n:
            size = 1 << int(n).bit_length()
            cls._powers = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size, cls.BASE, U64)]))
            inverse = pow(cls.BASE, -1, 1 << 64)
            cls._inverse = np.multiply.accumulate(np.concatenate([[U64(1)], np.full(size, inverse, U64)]))
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(symbols * cls._powers[:n], out=self.sums[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * SliceHash._inverse[starts])

    def windows(self, length: int) -> np.ndarray:
        """Hashes of all slices of ``length`` symbols, which are not mixed."""
        if len(self.sums) <= length:
            return np.empty(0, U64)
        out = self.sums[length:] - self.sums[:-length]
        out *= SliceHash._inverse[: len(out)]
        return out


BYTE_SYMBOLS = mix(np.arange(1, 257, dtype=U64))


#: Bytes of a word: all but ASCII white space.
NOT_BLANK = np.array([b not in b" \t\n\x0b\x0c\r" for b in range(256)])
#: Bytes of a word without punctuation: ASCII letters and digits, and all of other alphabets.
LETTERS = np.array([chr(b).isalnum() and b < 128 or b >= 128 for b in range(256)])


def word_bounds(data: np.ndarray, of_word: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of every word in a byte array."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = of_word[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def _sliding(values: np.ndarray, width: int, pick) -> np.ndarray:
    span, out = 1, values
    while span * 2 <= width:
        out = pick(out[:-span], out[span:])
        span *= 2
    rest = width - span
    return pick(out[: len(out) - rest], out[rest:]) if rest else out


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The smallest value of every run of ``width`` consecutive values."""
    return _sliding(values, width, np.minimum) if len(values) >= width else values[:0]


def group_equal(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the first element of each distinct hash, in order of the hashes; group of each element)."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shift = U64(max(1, int(n).bit_length()))
    low = (U64(1) << shift) - U64(1)
    packed = hashes & ~low
    packed |= np.arange(n, dtype=U64)
    packed.sort()
    index = (packed & low).astype(np.int64)
    packed >>= shift
    new = np.empty(n, bool)
    new[0] = True
    np.not_equal(packed[1:], packed[:-1], out=new[1:])
    representative = index[new]
    group = np.empty(n, np.int32)
    group[index] = np.cumsum(new, dtype=np.int32) - 1
    if (hashes[representative][group] != hashes).any():  # different hashes with equal upper bits
        _, representative, group = np.unique(hashes, return_index=True, return_inverse=True)
    return representative, group


def rolling_hash(symbols: np.ndarray, length: int) -> np.ndarray:
    """A 64-bit hash of every run of ``length`` consecutive symbols, by doubling."""
    if len(symbols) < length:
        return np.empty(0, U64)
    out, taken, power, span = None, 0, symbols, 1
    while True:
        if length & span:
            out = power if out is None else _join(out[: len(power) - taken], power[taken:])
            taken += span
        if span * 2 > length:
            return out[: len(symbols) - length + 1]
        power = _join(power[:-span], power[span:])
        span *= 2


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * U64(0x9E3779B97F4A7C15)
    x ^= x >> U64(29)
    x += b[: len(x)] if len(b) >= len(x) else b
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(32)
    return x


def hashed_words(
    data: np.ndarray, of_word: np.ndarray = NOT_BLANK, piece: int = 1 << 20
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word in a byte array, hashed about ``piece`` bytes at a time."""
    starts, ends = word_bounds(data, of_word)
    hashes = np.empty(len(starts), U64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + piece, side="right")))
        low = starts[at]
        part = SliceHash(BYTE_SYMBOLS[data[low : ends[to - 1]]])
        hashes[at:to] = part.slices(starts[at:to] - low, ends[at:to] - low)
        at = to
    return starts, ends, hashes
