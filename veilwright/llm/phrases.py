"""Phrase collocations by direct-address tiling, a word more at each level.

1. Tasks cut texts into words and write, for a chunk of texts of one language,
   its distinct words with their counts and the sequence of their numbers. Words
   are counted over the corpus; those that occur ``LEAST`` times are ranked by
   frequency, and the rank is a word's id. (A rarer word is in no candidate.)
2. The plane of (left id, right id) is cut into tiles of ``SIDE`` x ``SIDE``. Chunks
   send their distinct pairs to the tiles. A tile with many pairs for its size is
   counted in a dense array (bincount); the others in sorted coordinate form.
3. Frequent pairs are ranked by frequency again, and a chunk's sequence becomes
   the ids of the pairs that start at each place. Two neighbours in it are a phrase
   of three words, and so on up to ``WORDS``: a phrase occurs often only if both
   phrases that it is short of one word do.

Tiles meet in buckets. Chunks of a bucket merge as a tree with ``FAN`` children,
and ids go down the same tree to the chunks, so a tile that every text uses is
never in one task: a task gets the pairs of at most ``FAN`` chunks, each once, packed.
What is read twice is written to the shared folder.

Null texts count as empty, null languages as ``und``. Counts are exact below 2^53.
Ids and columns other than text and lang are not read; repeated rows count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ..operators.ordered import with_position
from ..session import scratch_path, stage
from .common import query, table, text_batches, utf8

LEAST = 30
WORDS = 4
TOP = 2000
SCALE = 2_000_000
INSIDE = 80  # percent of a phrase's occurrences that lie in a longer one

BATCH_CHARS = 2_000_000
CHUNK_CHARS = 16_000_000
SIDE = 512
DENSE = 16  # a tile is counted densely if it has at least one pair for so many cells
FAN = 512
AT_ONCE = 32  # chunks that a task unpacks together
BUCKET_WORDS = 6_000_000
SPREAD = 1_000_003

WORD_ROWS, SEQUENCES, PAIRS = 0, 1, 2
PARTS = "kind int, chunk long, lang string, no int, word string, n long, sequence binary"
STEP = "kind int, chunk long, bucket long, sequence binary, left binary, right binary, n binary"
MERGED = "bucket long, node long, left binary, right binary, n binary"

BREAK = b"."
_MAP = bytearray(range(256))
for _b in b".,;:!?\n\x0b\x0c\r":
    _MAP[_b] = BREAK[0]
_MAP[9] = 32
_MAP = bytes(_MAP)


def pack(numbers: np.ndarray) -> bytes:
    """Numbers from -1 on by byte plane, as many planes as the largest needs, after a byte that says how many.

    Ranks by frequency are mostly small: the upper planes are nearly all zeros, which shuffles compress away.
    """
    shifted = (numbers + 1).astype("<u8")
    width = max(1, -(-int(shifted.max()).bit_length() // 8)) if len(numbers) else 1
    return bytes([width]) + np.ascontiguousarray(shifted.view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros(planes.shape[1], np.int64)
    for k, plane in enumerate(planes):
        out |= plane.astype(np.int64) << (8 * k)
    return out - 1


class _Numbers(dict):
    """A number for each word, in order of appearance; 0 is the end of a piece."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def cut(text: str) -> list[bytes]:
    """The words of a text, with ``BREAK`` between its pieces (and around them)."""
    # bytes.lower() changes A-Z only; no other byte of UTF-8 text is white space to split()
    return utf8(text).lower().translate(_MAP).replace(BREAK, b" . ").split()


class _Chunk:
    """The words of texts of one language."""

    def __init__(self):
        self.numbers = _Numbers({BREAK: 0})
        self.parts: list[np.ndarray] = []

    def add(self, text: str) -> None:
        words = cut(text)
        words.append(BREAK)
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))

    def rows(self, chunk: int, lang: str) -> Iterator[pa.RecordBatch]:
        sequence = np.concatenate(self.parts)
        n = np.bincount(sequence, minlength=len(self.numbers))[1:]
        words = [w.decode("utf-8", "surrogatepass") for w in self.numbers][1:]
        yield _batch(_PARTS, len(words), kind=WORD_ROWS, chunk=chunk, lang=lang, no=range(1, len(words) + 1), word=words, n=n)
        yield _batch(_PARTS, 1, kind=SEQUENCES, chunk=chunk, lang=lang, sequence=[pack(sequence)])


def _fields(schema: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in schema.split(", "))])


_PARTS, _STEP, _MERGED = map(_fields, (PARTS, STEP, MERGED))


def _batch(schema: pa.Schema, rows: int, **columns) -> pa.RecordBatch:
    def column(field: pa.Field) -> pa.Array:
        value = columns.get(field.name)
        if value is None:
            return pa.nulls(rows, field.type)
        return pa.array([value] * rows if isinstance(value, (int, str)) else value, field.type)

    return pa.RecordBatch.from_arrays([column(f) for f in schema], schema=schema)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    chunks: dict[str, _Chunk] = {}
    held = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal number
        for lang, chunk in chunks.items():
            yield from chunk.rows(number, lang)
            number += 1
        chunks.clear()

    for batch, texts in text_batches(batches, "text", BATCH_CHARS):
        for lang, text in zip(batch.column("lang").to_pylist(), texts):
            chunks.setdefault(lang, _Chunk()).add(text)
        held += sum(map(len, texts))
        if held >= CHUNK_CHARS:
            yield from flush()
            held = 0
    yield from flush()


# --- pairs of ids --------------------------------------------------------------

Triple = tuple[np.ndarray, np.ndarray, np.ndarray]  # left ids, right ids, and a number for each pair


def _locals(ids: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The index of each id in the sorted ``known``, or -1."""
    if not len(known):
        return np.full(len(ids), -1, np.int64)
    at = np.minimum(np.searchsorted(known, ids), len(known) - 1)
    return np.where(known[at] == ids, at, -1)


def summed(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> Triple:
    """Each distinct pair once, sorted, with its numbers added up (sorted coordinate form)."""
    lefts, l = np.unique(left, return_inverse=True)
    rights, r = np.unique(right, return_inverse=True)
    code, place = np.unique(l.astype(np.int64) * len(rights) + r, return_inverse=True)
    total = np.bincount(place, n, len(code)).astype(np.int64)
    if not len(code):
        return left[:0], right[:0], total
    return lefts[code // len(rights)], rights[code % len(rights)], total


def tile_counts(left: np.ndarray, right: np.ndarray, n: np.ndarray) -> Triple:
    """``summed``, tile by tile: dense tiles by bincount, all others in coordinate form."""
    if not len(left):
        return left, right, n
    _, tile = np.unique(left // SIDE * (1 << 31) + right // SIDE, return_inverse=True)
    pairs = np.bincount(tile)
    dense = np.flatnonzero(pairs * DENSE >= SIDE * SIDE)
    order = np.argsort(tile, kind="stable")
    edges = np.concatenate([[0], np.cumsum(pairs)])
    out = []
    for t in dense.tolist():
        own = order[edges[t] : edges[t + 1]]
        a, b = left[own] // SIDE * SIDE, right[own] // SIDE * SIDE
        cells = np.bincount((left[own] - a) * SIDE + right[own] - b, n[own], SIDE * SIDE)
        used = np.flatnonzero(cells)
        out.append((a[0] + used // SIDE, b[0] + used % SIDE, cells[used].astype(np.int64)))
    rest = ~np.isin(tile, dense)
    out.append(summed(left[rest], right[rest], n[rest]))
    return tuple(np.concatenate(x) for x in zip(*out))


def looked_up(left: np.ndarray, right: np.ndarray, known: Triple) -> np.ndarray:
    """The number that ``known`` (each pair once) has for each pair, or -1."""
    kl, kr, number = known
    lefts, rights = np.unique(kl), np.unique(kr)
    code = _locals(kl, lefts) * max(1, len(rights)) + _locals(kr, rights)
    order = np.argsort(code)
    l, r = _locals(left, lefts), _locals(right, rights)
    at = _locals(np.where((l < 0) | (r < 0), -1, l * max(1, len(rights)) + r), code[order])
    return np.where(at < 0, -1, number[order][at] if len(number) else -1)


def _merged(rows: pa.Table) -> Triple:
    """The pairs of many chunks added up, ``AT_ONCE`` chunks after another, so that memory follows the distinct pairs."""
    total: Triple = (np.empty(0, np.int64),) * 3
    for at in range(0, rows.num_rows, AT_ONCE):
        part = _unpacked(rows.slice(at, AT_ONCE))
        total = tile_counts(*(np.concatenate([a, b]) for a, b in zip(total, part)))
    return total


def _unpacked(rows: pa.Table) -> Triple:
    def joined(name: str) -> np.ndarray:
        return np.concatenate([np.empty(0, np.int64), *map(unpack, rows[name].to_pylist())])

    return joined("left"), joined("right"), joined("n")


def _bucket(left, right, buckets: int):
    """Where a pair's tile is counted; the same for numpy arrays and for columns."""
    if isinstance(left, Column):
        tile = F.floor(left / SIDE).cast("long") * F.lit(SPREAD) + F.floor(right / SIDE).cast("long")
        return F.pmod(tile, F.lit(buckets))
    return (left // SIDE * SPREAD + right // SIDE) % buckets


def _step_rows(chunk: int, sequence: np.ndarray, buckets: int) -> pa.Table:
    """A sequence of ids (-1: none) and its pairs, by bucket."""
    rows = [_batch(_STEP, 1, kind=SEQUENCES, chunk=chunk, sequence=[pack(sequence)])]
    both = np.flatnonzero((sequence[:-1] >= 0) & (sequence[1:] >= 0))
    left, right, n = summed(sequence[both], sequence[both + 1], np.ones(len(both)))
    bucket = _bucket(left, right, buckets)
    order = np.argsort(bucket, kind="stable")
    used, first = np.unique(bucket[order], return_index=True)
    if len(used):
        columns = {k: [pack(x) for x in np.split(v[order], first[1:])] for k, v in (("left", left), ("right", right), ("n", n))}
        rows.append(_batch(_STEP, len(used), kind=PAIRS, chunk=chunk, bucket=used, **columns))
    return pa.Table.from_batches(rows)


def _named_words(buckets: int):
    def fn(sequences: pa.Table, words: pa.Table) -> pa.Table:
        if not sequences.num_rows:
            return _STEP.empty_table()
        own = unpack(sequences["sequence"][0].as_py())
        ids = np.full(int(own.max()) + 1, -1, np.int64)
        ids[words["no"].to_numpy()] = words["id"].to_numpy()
        return _step_rows(sequences["chunk"][0].as_py(), ids[own], buckets)

    return fn


def _named_pairs(buckets: int):
    def fn(sequences: pa.Table, pairs: pa.Table) -> pa.Table:
        if not sequences.num_rows:
            return _STEP.empty_table()
        own = unpack(sequences["sequence"][0].as_py())
        ids = looked_up(own[:-1], own[1:], _unpacked(pairs))
        return _step_rows(sequences["chunk"][0].as_py(), ids, buckets)

    return fn


def _merge(rows: pa.Table) -> pa.Table:
    left, right, n = _merged(rows)
    packed = {"left": [pack(left)], "right": [pack(right)], "n": [pack(n)]}
    return pa.Table.from_batches([_batch(_MERGED, 1, bucket=rows["bucket"][0].as_py(), node=rows["parent"][0].as_py(), **packed)])


def _frequent(least: int):
    def fn(rows: pa.Table) -> pa.Table:
        left, right, n = _merged(rows)
        keep = n >= least
        return pa.table({"left": left[keep], "right": right[keep], "total": n[keep]})

    return fn


def _down(rows: pa.Table, known: pa.Table) -> pa.Table:
    """For each row of a bucket, the pairs that it has of ``known``, with their ids."""
    out = []
    ids = _unpacked(known)
    for bucket, node, left, right in zip(*(rows[c].to_pylist() for c in ("bucket", "node", "left", "right"))):
        left, right = unpack(left), unpack(right)
        found = looked_up(left, right, ids)
        has = found >= 0
        if has.any():
            packed = {k: [pack(v[has])] for k, v in (("left", left), ("right", right), ("n", found))}
            out.append(_batch(_MERGED, 1, bucket=bucket, node=node, **packed))
    return pa.Table.from_batches(out, _MERGED)


def _pack(rows: pa.Table) -> pa.Table:
    packed = {k: [pack(rows[c].to_numpy())] for k, c in (("left", "left"), ("right", "right"), ("n", "id"))}
    return pa.Table.from_batches([_batch(_MERGED, 1, bucket=rows["bucket"][0].as_py(), node=0, **packed)])


class _Tree:
    """Pairs of chunks (bucket, node, left, right, n), merged by bucket up to one node each."""

    def __init__(self, pairs: DataFrame, chunks: int, buckets: int):
        self.buckets = buckets
        nodes = max(1, -(-chunks // FAN))
        self.levels = [pairs.withColumn("parent", F.pmod(F.xxhash64("node"), F.lit(nodes)))]
        while nodes > 1:
            merged = self.levels[-1].groupBy("bucket", "parent").applyInArrow(_merge, MERGED)
            self.levels.append(stage(merged, "tiles").withColumn("parent", F.floor(F.col("node") / FAN).cast("long")))
            nodes = -(-nodes // FAN)

    def frequent(self, least: int) -> DataFrame:
        """left, right and total of every pair that occurs ``least`` times."""
        top = self.levels[-1].groupBy("bucket").applyInArrow(_frequent(least), "left long, right long, total long")
        return stage(top, "pairs")

    def give(self, ranked: DataFrame) -> DataFrame:
        """The ids of ``ranked`` (left, right, id) for the pairs of each chunk: rows by (bucket, node)."""
        placed = ranked.select("left", "right", "id", _bucket(F.col("left"), F.col("right"), self.buckets).alias("bucket"))
        known = placed.groupBy("bucket").applyInArrow(_pack, MERGED)
        for level in reversed(self.levels):
            own = level.drop("n").groupBy("bucket", "parent")
            known = own.cogroup(known.groupBy("bucket", "node")).applyInArrow(_down, MERGED)
        return known


# --- phrases -------------------------------------------------------------------


def _longer(frequent: DataFrame, shorter: DataFrame) -> DataFrame:
    """Ranked phrases of a word more: two phrases that overlap in all but a word."""
    left = shorter.select(
        F.col("id").alias("left"), "lang", F.col("phrase").alias("start"), F.col("total").alias("left_n"), "first_n", "head_n"
    )
    right = shorter.select(
        F.col("id").alias("right"), "last_word", F.col("total").alias("right_n"), "last_n", "tail_n"
    )
    wide = frequent.join(left, "left").join(right, "right").select(
        "left", "right", "lang", F.concat_ws(" ", "start", "last_word").alias("phrase"), "last_word", "total",
        "first_n", "last_n", "left_n", "right_n",
        F.coalesce("head_n", "total").alias("head_n"), F.coalesce("tail_n", "total").alias("tail_n"),
    )
    return stage(with_position(wide, [F.col("total").desc(), F.col("left"), F.col("right")], "id"), "phrases")


def _candidates(level: int, phrases: DataFrame, longer: DataFrame | None) -> DataFrame:
    """lang, phrase, a, l, r and score of the phrases of ``level`` words that no longer one covers."""
    kept = phrases
    if longer is not None:
        inside = longer.select(F.col("left").alias("id"), "total").unionAll(longer.select(F.col("right").alias("id"), "total"))
        most = inside.groupBy("id").agg(F.max("total").alias("most"))
        covered = F.expr(f"100BD * CAST(most AS DECIMAL(20, 0)) >= {INSIDE}BD * CAST(total AS DECIMAL(20, 0))")
        kept = phrases.join(most, "id", "left").where(F.col("most").isNull() | ~covered)
    cuts = {
        2: [("first_n", "last_n")],
        3: [("first_n", "right_n"), ("left_n", "last_n")],
        4: [("first_n", "right_n"), ("head_n", "tail_n"), ("left_n", "last_n")],
    }[level]

    def score(left: str, right: str) -> Column:
        parts = f"CAST({left} AS DECIMAL(20, 0)) + CAST({right} AS DECIMAL(20, 0))"
        return F.expr(f"({SCALE}BD * CAST(total AS DECIMAL(20, 0))) div ({parts})")

    scored = [
        F.struct(score(left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
        for k, (left, right) in enumerate(cuts)
    ]
    lowest = F.least(*scored) if len(scored) > 1 else scored[0]
    return kept.select("lang", "phrase", F.col("total").alias("a"), lowest.alias("cut")).select(
        "lang", "phrase", "a", "cut.l", "cut.r", F.col("cut.score").cast("long").alias("score")
    )


def _read(spark: SparkSession, schema: str, where: str, kind: int) -> DataFrame:
    return spark.read.schema(schema).parquet(where).where(F.col("kind") == kind)


def collocations(docs: DataFrame, least: int = LEAST, top: int | None = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of the ``top`` (None: all) phrases of each language."""
    spark = docs.sparkSession
    where = scratch_path(spark, "words")
    source = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    source.mapInArrow(_split, PARTS).write.partitionBy("kind").option("compression", "zstd").parquet(where)
    words = _read(spark, PARTS, where, WORD_ROWS).select("chunk", "lang", "no", "word", "n")
    sequences = _read(spark, PARTS, where, SEQUENCES).select("chunk", "sequence")
    of_lang = words.groupBy("lang").agg(F.sum("n").alias("n"))
    chunks, total = sequences.count(), words.agg(F.sum("n")).first()[0] or 0
    buckets = max(8, -(-int(total) // BUCKET_WORDS))

    everywhere = F.sum("n").over(Window.partitionBy("lang", "word"))  # a row for each chunk at most
    often = stage(words.withColumn("total", everywhere).where(F.col("total") >= least).drop("n"), "often")
    counted = often.select("lang", "word", "total").distinct()
    none = F.lit(None).cast("long")
    symbols = with_position(counted, [F.col("total").desc(), F.col("lang"), F.col("word")], "id").select(
        "id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last_word"), "total",
        F.col("total").alias("first_n"), F.col("total").alias("last_n"), none.alias("head_n"), none.alias("tail_n"),
    )
    ids = symbols.select("lang", F.col("phrase").alias("word"), "id")
    names = often.select("chunk", "no", "lang", "word").join(ids, ["lang", "word"]).select("chunk", "no", "id")
    step = sequences.groupBy("chunk").cogroup(names.groupBy("chunk")).applyInArrow(_named_words(buckets), STEP)
    levels = []
    while len(levels) < WORDS - 1:
        where = scratch_path(spark, "pairs")
        step.write.partitionBy("kind").option("compression", "zstd").parquet(where)
        pairs = _read(spark, STEP, where, PAIRS).select("bucket", F.col("chunk").alias("node"), "left", "right", "n")
        tree = _Tree(pairs, chunks, buckets)
        symbols = _longer(tree.frequent(least), symbols)
        levels.append(symbols)
        sequences = _read(spark, STEP, where, SEQUENCES).select("chunk", "sequence")
        ids = tree.give(symbols).select(F.col("node").alias("chunk"), "left", "right", "n")
        step = sequences.groupBy("chunk").cogroup(ids.groupBy("chunk")).applyInArrow(_named_pairs(buckets), STEP)

    found = [_candidates(k + 2, p, levels[k + 1] if k + 1 < len(levels) else None) for k, p in enumerate(levels)]
    every = found[0]
    for more in found[1:]:
        every = every.unionAll(more)
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), F.col("phrase"))
    ranked = every.withColumn("rank", F.row_number().over(order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.join(of_lang, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PHRASES_SQL = f"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, w[i:i + k - 1] AS p, k FROM starts, (SELECT unnest(range(1, 5)) AS k) WHERE i + k - 1 <= len(w)),
f AS MATERIALIZED (SELECT lang, k, array_to_string(p, ' ') AS phrase, any_value(p) AS p, count(*) AS a FROM grams GROUP BY lang, k, phrase),
total AS (SELECT lang, sum(a)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
candidates AS (SELECT * FROM f WHERE k > 1 AND a >= {LEAST}),
halves AS MATERIALIZED (SELECT lang, phrase, a, cut, array_to_string(p[1:cut], ' ') AS first, array_to_string(p[cut + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, k)) AS cut FROM candidates)),
cuts AS (SELECT h.lang, h.phrase, h.a, cut, l.a AS l, r.a AS r, ({SCALE}::HUGEINT * h.a) // (l.a::HUGEINT + r.a) AS score
  FROM halves h JOIN f l ON l.lang = h.lang AND l.phrase = h.first JOIN f r ON r.lang = h.lang AND r.phrase = h.rest),
lowest AS (SELECT lang, phrase, a, arg_min({{'l': l, 'r': r, 'score': score}}, (score, cut)) AS c FROM cuts GROUP BY ALL),
inner_parts AS MATERIALIZED (SELECT lang, array_to_string(p[i:i + size - 1], ' ') AS phrase, max(a) AS most
  FROM (SELECT *, unnest(range(1, k - size + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS size FROM candidates)) GROUP BY ALL),
kept AS (SELECT lowest.* FROM lowest LEFT JOIN inner_parts USING (lang, phrase)
  WHERE most IS NULL OR 100::HUGEINT * most < {INSIDE}::HUGEINT * a),
named AS (SELECT lang, phrase, a::BIGINT AS a, c.l::BIGINT AS l, c.r::BIGINT AS r, c.score::BIGINT AS score FROM kept),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM named)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= {TOP}
"""


@query("op13_collocations", PHRASES_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
