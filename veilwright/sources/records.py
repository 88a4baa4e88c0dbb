"""CSV records whose cells may hold line breaks, read by several tasks a file.

A file is read in byte ranges that start at a line. Whether a range starts inside
quotes depends on all ranges before it, so:

1. ``file_heads`` reads the first lines of every file, and no more of it.
2. For files of more than one range, each range is summed up for both cases, that
   it starts outside or inside quotes: how it ends, and whether a record ends in
   it. The summaries of a file, one row for each range, compose to where each
   range really starts.
3. Tasks parse the records that lie in their range, with the columns in the order
   of that file's own header. A record that crosses into other ranges is put
   together from its pieces, grouped by the range in which it starts.

A quote opens a cell only at the cell's start; two quotes inside stand for one.
"""

from __future__ import annotations

import csv
import io
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyarrow import compute as pc, csv as arrow_csv, fs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators.ordered import PLACE
from ..session import stage

QUOTE = b'"'
CELL_STARTS = b",\n\r"
BOM = b"\xef\xbb\xbf"
MOST_HEADERS = 1000  # different orders of columns in one read
BLOCK = 1 << 14
PART = 1 << 21  # bytes of lines that a task parses at once, whatever the length of lines
FEW_LINES = 1000  # of a file that only Spark opens; a header has fewer
FILES_AT_ONCE = 100
PLACED = T.StructType().add("file", "string").add("start", "long").add("row", "long")

HEADS = "file string, file_key long, size long, mark string, header binary, opened boolean"


class Quotes:
    """Follows quotes through whole lines."""

    def __init__(self, inside: bool = False):
        self.inside = inside

    def feed(self, data: bytes) -> tuple[int, int]:
        """Where the first and the last record that ends in ``data`` end (-1: none does). ``data`` ends with a line."""
        at, first, last = 0, -1, -1
        while True:
            if self.inside:
                quote = data.find(QUOTE, at)
                if quote < 0:
                    return first, last
                if data[quote + 1 : quote + 2] == QUOTE:
                    at = quote + 2
                    continue
                self.inside, at = False, quote + 1
            quote = data.find(QUOTE, at)
            while quote > 0 and data[quote - 1] not in CELL_STARTS:  # a quote in the middle of a cell
                quote = data.find(QUOTE, quote + 1)
            to = len(data) if quote < 0 else quote
            newline = data.rfind(b"\n", at, to)
            if newline >= 0:
                last = newline + 1
                if first < 0:
                    first = data.find(b"\n", at) + 1
            if quote < 0:
                return first, last
            self.inside, at = True, quote + 1


def _without_mark(data: bytes, mark: bytes) -> bytes:
    """The first lines of a file without its mark."""
    data = data.removeprefix(BOM)
    return data[data.index(b"\n") + 1 :] if mark and data.startswith(mark) else data


def _parts(lines: pa.Array) -> Iterator[list[bytes]]:
    """The lines in parts of about ``PART`` bytes (one line at least)."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(lines), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at, before = 0, 0
    while at < len(ends):
        to = max(at + 1, int(np.searchsorted(ends, before + PART, side="right")))
        yield lines.slice(at, to - at).to_pylist()
        at, before = to, int(ends[to - 1])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, list[bytes]]]:
    """((all columns but the line), lines) of each run of rows of one range in a batch, in parts of bounded size."""
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [c.to_numpy(zero_copy_only=False) for c in batch.select(["file_key", "start"]).columns]
        changed = (keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1])
        cuts = [0, *(changed.nonzero()[0] + 1).tolist(), batch.num_rows]
        lines = batch.column("value")
        for a, b in zip(cuts, cuts[1:]):
            first = {n: batch.column(n)[a].as_py() for n in batch.schema.names if n != "value"}
            for part in _parts(lines.slice(a, b - a)):
                yield first, part


def _lines(spark: SparkSession, path: str | Sequence[str], recursive: bool = False) -> DataFrame:
    """The lines of all files with the range they are in."""
    texts = spark.read.option("lineSep", "\n").option("recursiveFileLookup", str(recursive).lower()).text(path)
    where = F.col("_metadata.file_path")
    return texts.select(
        F.col("value").cast("binary").alias("value"),
        where.alias("file"),
        F.xxhash64(where).alias("file_key"),
        F.col("_metadata.file_block_start").alias("start"),
        F.col("_metadata.file_size").alias("size"),
    )


# --- the first lines of files --------------------------------------------------


def head_of(file, mark: bytes, header: bool) -> tuple[bytes | None, bytes | None]:
    """(mark, header record) at the start of an open file; no more of it is read than they need.

    Without ``header``, what follows the mark is not read, and of a file without one
    only as many bytes as show it.
    """
    data, ended = b"", False

    def more() -> None:
        nonlocal data, ended
        block = file.read(BLOCK)
        ended = not block
        data += block

    while not ended and len(data) < len(BOM + mark):
        more()
    found, data = None, data.removeprefix(BOM)
    if mark and data.startswith(mark):
        while not ended and b"\n" not in data:
            more()
        found, _, data = data.partition(b"\n")
    if not header:
        return found, None
    quotes, fed = Quotes(), 0
    while True:
        whole = data.rfind(b"\n") + 1
        first, _ = quotes.feed(data[fed:whole]) if whole > fed else (-1, -1)
        if first >= 0:
            return found, data[: fed + first]
        fed = max(fed, whole)
        if ended:
            return found, data + b"\n" if data else None
        more()


def _open(path: str):
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path[5:].lstrip("/"))
    store, place = fs.FileSystem.from_uri(path)
    return store.open_input_file(place)


def _heads(mark: bytes, header: bool):
    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                path = row.pop("path")
                try:
                    with _open(path) as file:
                        first, record = head_of(file, mark, header)
                    row |= {"mark": None if first is None else first.decode("utf-8", "replace"), "header": record, "opened": True}
                except (OSError, pa.ArrowException):  # a store that only Spark reaches
                    row |= {"mark": None, "header": None, "opened": False}
                out.append(row)
            yield pa.RecordBatch.from_pylist(out, _HEADS)

    return heads


_HEADS = pa.schema(
    [
        ("file", pa.string()), ("file_key", pa.int64()), ("size", pa.int64()), ("mark", pa.string()), ("header", pa.binary()),
        ("opened", pa.bool_()),
    ]
)


def _limited_head(spark: SparkSession, files: Sequence[str], mark: bytes) -> DataFrame:
    """The first lines of files by Spark's own reader, which stops at a limit."""
    parts = []
    for file in files:
        parts.append(_lines(spark, file).limit(FEW_LINES))
    lines = reduce(DataFrame.unionAll, parts)

    def heads(rows: pa.Table) -> pa.Table:
        first = rows.slice(0, 1).to_pylist()[0]
        found, record = head_of(io.BytesIO(b"\n".join(rows["value"].to_pylist()) + b"\n"), mark, True)
        row = {k: first[k] for k in ("file", "file_key", "size")}
        row |= {"mark": None if found is None else found.decode("utf-8", "replace"), "header": record, "opened": True}
        return pa.Table.from_pylist([row], _HEADS)

    return lines.groupBy("file").applyInArrow(heads, HEADS)


def file_heads(
    spark: SparkSession, path: str | Sequence[str], mark: str, header: bool = True, recursive: bool = False
) -> DataFrame:
    """file, file_key, size, mark (the first line if it starts with ``mark``) and header of every file that is not empty.

    Tasks open the listed files and read up to the end of the header, so a file costs
    the same whatever its size. Files in stores that only Spark reaches are read by
    Spark up to a few lines, ``FILES_AT_ONCE`` in a job.
    """
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    where = F.col("_metadata.file_path")
    files = listed.select("path", where.alias("file"), F.xxhash64(where).alias("file_key"), F.col("length").alias("size"))
    heads = stage(files.where("size > 0").mapInArrow(_heads(mark.encode(), header), HEADS), "heads")
    closed = [r[0] for r in heads.where("NOT opened").select("file").orderBy("file").toLocalIterator()]
    if closed:
        parts = [
            stage(_limited_head(spark, closed[i : i + FILES_AT_ONCE], mark.encode()), "heads")
            for i in range(0, len(closed), FILES_AT_ONCE)
        ]
        heads = reduce(DataFrame.unionAll, parts, heads.where("opened"))
    return heads


# --- headers -------------------------------------------------------------------


def header_names(header: bytes) -> list[str]:
    """The column names of a header record; repeated and empty names get a number."""
    cells = next(csv.reader(io.StringIO(header.decode("utf-8", "replace"), newline="")), [])
    names: list[str] = []
    for i, cell in enumerate(cells):
        name = cell or f"Unnamed: {i}"
        number = 0
        while name in names:
            number += 1
            name = f"{cell or f'Unnamed: {i}'}.{number}"
        names.append(name)
    return names


class HeaderMismatch(ValueError):
    """Files of one read do not have the same columns."""


@dataclass
class Headers:
    """The orders in which files have their columns; ``names`` is the order of the result."""

    names: list[str]
    texts: list[bytes]  # each different header
    orders: list[list[int]]  # for each, where the file has each of ``names``
    largest: int  # bytes of the largest file

    @classmethod
    def of(cls, heads: DataFrame, wanted: Sequence[str] | None, path) -> Headers:
        found = (
            heads.where("header IS NOT NULL").groupBy("header")
            .agg(F.min("file").alias("file"), F.count(F.lit(1)).alias("files"), F.max("size").alias("size"))
            .orderBy("file").limit(MOST_HEADERS + 1).collect()
        )
        if not found:
            raise ValueError(f"no header in {path}")
        if len(found) > MOST_HEADERS:
            raise HeaderMismatch(f"more than {MOST_HEADERS} different headers in {path}")
        names = list(wanted) if wanted is not None else header_names(found[0]["header"])
        orders = []
        for r in found:
            own = header_names(r["header"])
            unknown, missing = sorted(set(own) - set(names)), sorted(set(names) - set(own))
            if unknown or missing:
                raise HeaderMismatch(
                    f"{r['file']} ({r['files']} files with this header): columns not expected {unknown}, columns missing {missing}"
                )
            orders.append([own.index(n) for n in names])
        return cls(names, [bytes(r["header"]) for r in found], orders, max(r["size"] for r in found))


# --- where ranges start --------------------------------------------------------

SUMMARIES = (
    "file_key long, start long, outside_ends_inside boolean, outside_cuts boolean, "
    "inside_ends_inside boolean, inside_cuts boolean"
)
STARTS = "file_key long, start long, inside boolean, opener long"


def _summaries(mark: bytes):
    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cases, cut = None, [], []

        def row() -> pa.RecordBatch:
            (out, into), names = cases, [c.split()[0] for c in SUMMARIES.split(", ")]
            values = [*key, out.inside, cut[0], into.inside, cut[1]]
            return pa.RecordBatch.from_pylist([dict(zip(names, values))])

        for of, lines in _runs(batches):
            data = b"\n".join(lines) + b"\n"
            if (of["file_key"], of["start"]) != key:
                if key:
                    yield row()
                key, cases, cut = (of["file_key"], of["start"]), [Quotes(False), Quotes(True)], [False, False]
                if of["start"] == 0:
                    data = _without_mark(data, mark)
            for i, case in enumerate(cases):
                cut[i] |= case.feed(data)[1] >= 0
        if key:
            yield row()

    return summaries


def _composed(ranges: pa.Table) -> pa.Table:
    """Where each range of one file really starts, and in which range the record begins that is open there."""
    inside, opener, out = False, 0, []
    for r in sorted(ranges.to_pylist(), key=lambda r: r["start"]):
        case = "inside" if inside else "outside"
        out.append({"file_key": r["file_key"], "start": r["start"], "inside": inside, "opener": opener})
        if r[f"{case}_cuts"] or not inside:
            opener = r["start"]
        inside = r[f"{case}_ends_inside"]
    if inside:
        raise ValueError(f"a quote stays open, in the record that starts in the bytes from {opener} of a file")
    return pa.Table.from_pylist(out, pa.schema([("file_key", pa.int64()), ("start", pa.int64()), ("inside", pa.bool_()), ("opener", pa.int64())]))


def _uncut(spark: SparkSession) -> int:
    """Files up to this size are one range, whatever else is read."""
    sizes = [spark.conf.get(f"spark.sql.files.{k}") for k in ("maxPartitionBytes", "openCostInBytes")]
    parse = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    return min(int(parse(s)) for s in sizes)


def range_starts(lines: DataFrame, mark: bytes) -> DataFrame:
    """(file_key, start, inside, opener) of every range that has lines."""
    summed = lines.select("value", "file_key", "start").mapInArrow(_summaries(mark), SUMMARIES)
    return stage(summed.groupBy("file_key").applyInArrow(_composed, STARTS), "starts")


# --- records -------------------------------------------------------------------


def parse_cells(data: bytes, width: int) -> list[pa.Array]:
    """The text columns of whole records. Missing cells at a row's end are nulls, surplus cells raise."""
    if not data:
        return [pa.array([], pa.string()) for _ in range(width)]
    names = [str(i) for i in range(width)]
    try:
        table = arrow_csv.read_csv(
            pa.BufferReader(data),
            arrow_csv.ReadOptions(use_threads=False, column_names=names, block_size=max(len(data) + 1, 1 << 16)),
            arrow_csv.ParseOptions(newlines_in_values=True),
            arrow_csv.ConvertOptions(column_types={n: pa.string() for n in names}, strings_can_be_null=False),
        )
        return [c.combine_chunks() if c.num_chunks != 1 else c.chunk(0) for c in table.columns]
    except pa.ArrowInvalid:  # short or long rows, or bytes that are no text
        return _parse_rows(data, width)


def _parse_rows(data: bytes, width: int) -> list[pa.Array]:
    csv.field_size_limit(sys.maxsize)
    columns: list[list[str | None]] = [[] for _ in range(width)]
    for row in csv.reader(io.StringIO(data.decode("utf-8", "replace"), newline="")):
        if not row:
            continue  # an empty line
        if len(row) > width:
            raise ValueError(f"a row has more than {width} cells, from {row[0][:200]} on: {','.join(row)[:200]}")
        for i in range(width):
            columns[i].append(row[i] if i < len(row) else None)
    return [pa.array(c, pa.string()) for c in columns]


class _Range:
    """The records of one range, fed line by line."""

    def __init__(self, of: dict, mark: bytes):
        self.of, self.mark = of, mark if of["start"] == 0 else None  # None: the first lines are behind
        self.quotes = Quotes(bool(of["inside"]))
        self.head = bool(of["inside"])  # still in a record of an earlier range
        self.lead = of["start"] == 0  # the mark and the header are still to come
        self.pieces: list[bytes] = []  # of the record that is open
        self.opener = of["opener"] if self.head else of["start"]
        self.rows = 0

    def feed(self, data: bytes) -> tuple[bytes, bytes]:
        """(whole records, the end of a record of an earlier range) in more lines of the range."""
        if self.mark is not None:
            data, self.mark = _without_mark(data, self.mark), None
        ended = b""
        first, last = self.quotes.feed(data)
        if first < 0:
            self.pieces.append(data)
            return b"", b""
        joined = b"".join([*self.pieces, data[:first]])
        self.pieces = [data[last:]] if last < len(data) else []
        records = [data[first:last]]
        if self.head:
            self.head, ended = False, joined
        elif not self.lead:
            records.insert(0, joined)
        self.lead = False
        self.opener = self.of["start"]
        return b"".join(records), ended


PIECES = "file_key long, opener long, seq long, header_no int, piece binary, row long"
_PIECES = pa.schema(
    [("file_key", pa.int64()), ("opener", pa.int64()), ("seq", pa.int64()), ("header_no", pa.int32()), ("piece", pa.binary()), ("row", pa.int64())]
)


def _ranges(batches: Iterator[pa.RecordBatch], mark: bytes) -> Iterator[tuple[_Range, bytes, bytes, bool]]:
    """(range, whole records, end of an earlier record, whether the range is over) in order."""
    now: _Range | None = None
    for of, lines in _runs(batches):
        if now is None or (of["file_key"], of["start"]) != (now.of["file_key"], now.of["start"]):
            if now:
                yield now, b"", b"", True
            if of["inside"] is None:
                raise ValueError("files or the size of ranges changed since the read was planned; read them again")
            now = _Range(of, mark)
        yield now, *now.feed(b"\n".join(lines) + b"\n"), False
    if now:
        yield now, b"", b"", True


def _file_columns(cells: list[pa.Array], order: list[int]) -> list[pa.Array]:
    return [cells[i] for i in order]


def _places(of: dict, start: int, first: int, n: int) -> pa.Array:
    return pa.StructArray.from_arrays(
        [pa.array([of["file"]] * n, pa.string()), pa.array([start] * n, pa.int64()), pa.array(range(first, first + n), pa.int64())],
        ["file", "start", "row"],
    )


def _rows(orders: list[list[int]], names: list[str], mark: bytes, placed: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for now, records, _, over in _ranges(batches, mark):
            if over:
                if now.pieces and now.of["cut"] is False:
                    raise ValueError("a quote stays open in the record: " + b"".join(now.pieces)[:200].decode("utf-8", "replace"))
                continue
            if records:
                order = orders[now.of["header_no"]]
                columns = _file_columns(parse_cells(records, len(order)), order)
                n = len(columns[0])
                if placed:
                    columns.append(_places(now.of, now.of["start"], now.rows, n))
                now.rows += n
                yield pa.RecordBatch.from_arrays(columns, [*names, PLACE] if placed else names)

    return rows


def _loose_pieces(mark: bytes):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The parts of records that lie in more than one range."""

        def part(now: _Range, opener: int, data: bytes) -> pa.RecordBatch:
            row = (now.of["file_key"], opener, now.of["start"], now.of["header_no"], data, now.rows)
            return pa.RecordBatch.from_pylist([dict(zip(_PIECES.names, row))], _PIECES)

        for now, records, ended, over in _ranges(batches, mark):
            if ended:
                yield part(now, now.of["opener"], ended)
            if over and now.pieces:
                yield part(now, now.opener, b"".join(now.pieces))

    return pieces


def _crossing_rows(orders: list[list[int]], names: list[str], placed: bool):
    def rows(pieces: pa.Table) -> pa.Table:
        parts = sorted(zip(pieces["seq"].to_pylist(), pieces["piece"].to_pylist()))
        order = orders[pieces["header_no"][0].as_py()]
        columns = _file_columns(parse_cells(b"".join(p for _, p in parts), len(order)), order)
        if placed:
            of = {"file": pieces["file"][0].as_py()}
            columns.append(_places(of, pieces["opener"][0].as_py(), sys.maxsize - 1, len(columns[0])))  # the last of its range
        return pa.Table.from_arrays(columns, [*names, PLACE] if placed else names)

    return rows


def read_records(
    spark: SparkSession,
    path: str | Sequence[str],
    names: Sequence[str] | None,
    mark: str,
    skip_mark: bool,
    multiline: bool = True,
    place: bool = False,
) -> DataFrame:
    """All cells as text, in the columns ``names`` (default: those of the first file).

    Every file has a header of its own, which may order the columns otherwise;
    other columns raise ``HeaderMismatch``. With ``skip_mark``, a first line that
    starts with ``mark`` is left out. ``place`` adds the column ``PLACE``, which
    sorts as the rows do by file path and place in the file. ``multiline=False``
    spares the pass over large files that finds quoted line breaks.
    """
    heads = file_heads(spark, path, mark if skip_mark else "")
    headers = Headers.of(heads, names, path)
    lines = _lines(spark, path)
    if not place:
        lines = lines.drop("file")
    skipped = mark.encode() if skip_mark else b""
    uncut = _uncut(spark)
    cut = F.col("size") > F.lit(uncut)
    # Names the line, too, so that Spark does not leave out files by it: the size of
    # ranges depends on all files of a scan, and each scan must have the same ranges.
    of_cut_file = F.when(cut, F.col("value")).isNotNull()
    several = multiline and headers.largest > uncut
    crossing = False
    if several:
        starts = range_starts(_lines(spark, path).where(of_cut_file), skipped)
        crossing = not starts.where("inside").limit(1).isEmpty()
        # One row for each range, as in Spark's own list of them.
        lines = lines.join(F.broadcast(starts), ["file_key", "start"], "left")
        inside = F.when(cut, F.col("inside")).otherwise(F.lit(False))
    else:
        inside, lines = F.lit(False), lines.withColumn("opener", F.lit(0).cast("long"))
    if len(headers.texts) > 1:
        known = spark.createDataFrame(list(enumerate(headers.texts)), "header_no int, header binary")
        of_file = heads.join(F.broadcast(known), "header").select("file_key", "header_no")  # at most MOST_HEADERS headers
        lines = lines.join(F.broadcast(of_file), "file_key")  # one row for each file
    else:
        lines = lines.withColumn("header_no", F.lit(0))
    keys = ["value", *(["file"] if place else []), "file_key", "start", "header_no", "opener"]
    lines = lines.select(*keys, inside.alias("inside"), (cut if several else F.lit(False)).alias("cut"))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in headers.names])
    if place:
        schema = schema.add(PLACE, PLACED)
    rows = lines.mapInArrow(_rows(headers.orders, headers.names, skipped, place), schema)
    if crossing:
        pieces = lines.where(F.when(F.col("cut"), F.col("value")).isNotNull()).mapInArrow(_loose_pieces(skipped), PIECES)
        if place:
            pieces = pieces.join(F.broadcast(heads.select("file_key", "file")), "file_key")
        rows = rows.unionAll(
            pieces.groupBy("file_key", "opener").applyInArrow(_crossing_rows(headers.orders, headers.names, place), schema)
        )
    return rows
