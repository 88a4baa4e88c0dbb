"""Near copies by SimHash fingerprints and meet-in-the-middle ball hashing.

Two 64-bit fingerprints at distance d <= 2r share a value within distance r of
both. So every distinct fingerprint emits all values within distance r, and
fingerprints that emit the same value collide; each collision is verified.

The variants of one fingerprint share prefixes. Only the prefixes are shuffled
(37 rows instead of 2,081 for r = 2 and an 8-bit prefix); a task extends the
variants of its prefix range bit group by bit group and drops every value that
only one fingerprint can still reach, so hardly any variant is spelled out. The
prefix grows with the number of fingerprints, which bounds what a task holds.

Equal fingerprints are one fingerprint, so exact copies cost nothing. A task
links fingerprints as a forest (never all pairs of a group), and components are
found by star contraction over joins, with each round written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stage
from .common import U64, hashed_words, query, rolling_hash, table, text_batches, utf8, with_row_id

WIDTH = 64
RADIUS = 2  # half of the largest distance that links
SEED = 42
IN_MEMORY = 6_000_000  # variants that a task holds at once
PER_CELL = 1 << 16

# --- fingerprints ---------------------------------------------------------------

#: For each byte, its eight bits as the bytes of one number.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).view(U64).ravel()


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes, as an unsigned number."""
    n = len(hashes)
    if not n:
        return 0
    lanes = SPREAD[hashes.astype(">u8").view(np.uint8).reshape(n, 8)]
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 255):  # a byte counts to 255
        counts += lanes[at : at + 255].sum(axis=0).view(np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of every run of ``size`` words of a lower-cased text (of all its words, if fewer)."""
    words = text.lower().split()  # bytes: A-Z and ASCII white space only
    if not words:
        return np.empty(0, U64)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], U64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(words) - size + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())], U64)


def _signed(values: Sequence[int]) -> pa.Array:
    return pa.array(np.array(values, U64).view(np.int64), pa.int64())


def shingle_fingerprints(docs: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """``keys`` (longs) and a 64-bit fingerprint of the word shingles of each text; zero where there are no words."""
    keys = list(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text", 4_000_000):
            found = [majority(shingle_hashes(utf8(t), size)) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.select(keys).columns, _signed(found)], [*keys, "fingerprint"])

    longs = docs.select(*[F.col(k).cast("long").alias(k) for k in keys], "text")
    return longs.mapInArrow(run, ", ".join(f"`{k}` long" for k in [*keys, "fingerprint"]))


# --- collisions -------------------------------------------------------------------


def _patterns(bits: int, most: int) -> list[tuple[int, int]]:
    """(mask, flips) of every way to flip up to ``most`` of ``bits`` bits."""
    found = [(0, 0)]
    for flips in range(1, most + 1):
        found += [(m | 1 << i, flips) for m, f in found if f == flips - 1 for i in range(m.bit_length(), bits)]
    return found


def _copies(bits: int, most: int) -> int:
    return len(_patterns(bits, most))


def _low(bits: int) -> np.uint64:
    return U64((1 << bits) - 1)


def _repeated(prefixes: np.ndarray) -> np.ndarray:
    """Which elements of a sorted array occur more than once."""
    same = prefixes[1:] == prefixes[:-1]
    out = np.zeros(len(prefixes), bool)
    out[1:] |= same
    out[:-1] |= same
    return out


def collisions(values: np.ndarray, owner: np.ndarray, prefix: np.ndarray, depth: int, radius: int) -> Iterator[tuple]:
    """Groups of fingerprints that share a variant.

    ``prefix``: the first ``depth`` bits of variants (left-aligned), sorted;
    ``owner``: the fingerprint in ``values`` each belongs to. Yields arrays
    (owners, starts of groups in them).
    """
    if not len(owner):
        return
    if depth == WIDTH:
        yield owner, np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        return
    step = next((s for s in (16, 8, 4, 2) if len(owner) * _copies(s, radius) <= IN_MEMORY or s == 2))
    step = min(step, WIDTH - depth)
    if len(owner) * _copies(step, radius) > IN_MEMORY:
        starts = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
        if len(starts) > 1:  # halve at a change of prefix; the parts share no variant
            cut = starts[np.argmin(np.abs(starts[1:] - len(owner) // 2)) + 1]
            yield from collisions(values, owner[:cut], prefix[:cut], depth, radius)
            yield from collisions(values, owner[cut:], prefix[cut:], depth, radius)
            return
    deeper = depth + step
    shift = U64(WIDTH - deeper)
    spent = np.bitwise_count((values[owner] ^ prefix) & ~_low(WIDTH - depth))
    own = (values[owner] >> shift) & _low(step)
    heads, owners = [], []
    for mask, flips in _patterns(step, radius):
        able = np.flatnonzero(spent + flips <= radius)
        heads.append(prefix[able] | (own[able] ^ U64(mask)) << shift)
        owners.append(owner[able])
    head, owner = np.concatenate(heads), np.concatenate(owners)
    del heads, owners
    room = WIDTH - deeper
    if len(values) <= 1 << min(room, 31):  # number and prefix fit into one sortable value
        packed = head | owner.astype(U64)
        packed.sort()
        head, owner = packed & ~_low(room), (packed & _low(room)).astype(np.int64)
    else:
        order = np.argsort(head)
        head, owner = head[order], owner[order]
    kept = _repeated(head)
    yield from collisions(values, owner[kept], head[kept], deeper, radius)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index connected to each of ``n`` indices by links a-b."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
        a, b = a[label[a] != label[b]], b[label[a] != label[b]]
    return label


def spanning(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the links a-b form a spanning forest, early ones preferred."""
    chosen = np.zeros(len(a), bool)
    label = np.arange(n)
    while True:
        cross = np.flatnonzero(label[a] != label[b])
        if not len(cross):
            return chosen
        best = np.full(n, len(a))
        np.minimum.at(best, label[a[cross]], cross)
        np.minimum.at(best, label[b[cross]], cross)
        chosen[best[best < len(a)]] = True
        label = forest(n, a[chosen], b[chosen])


def _link_values(
    values: np.ndarray, owner: np.ndarray, prefix: np.ndarray, depth: int, radius: int, forests: int = 0
) -> tuple:
    """Links (a, b) that connect all ``values`` at distance 2 * radius or less.

    Without ``forests``, each value and the smallest value it is connected to.
    With it, only pairs that are themselves at that distance: a spanning forest
    of them, then one of the pairs left, and so on.
    """
    firsts, others = [], []
    for owners, starts in collisions(values, owner, prefix, depth, radius):
        head = np.repeat(np.minimum.reduceat(owners, starts), np.diff(np.append(starts, len(owners))))
        pair = np.unique(head.astype(U64) << U64(32) | owners.astype(U64))
        a, b = (pair >> U64(32)).astype(np.int64), (pair & _low(32)).astype(np.int64)
        near = (a != b) & (np.bitwise_count(values[a] ^ values[b]) <= 2 * radius)
        firsts.append(a[near])
        others.append(b[near])
    if not firsts:
        return values[:0], values[:0]
    a, b = np.concatenate(firsts), np.concatenate(others)
    if forests:
        pair = np.unique(a.astype(U64) << U64(32) | b.astype(U64))
        a, b = (pair >> U64(32)).astype(np.int64), (pair & _low(32)).astype(np.int64)
        left = np.ones(len(a), bool)
        for _ in range(forests):
            own = np.flatnonzero(left)
            left[own[spanning(len(values), a[own], b[own])]] = False
        return values[b[~left]], values[a[~left]]
    label = forest(len(values), a, b)
    moved = np.flatnonzero(label != np.arange(len(values)))
    return values[moved], values[label[moved]]


def _emit_prefixes(bits: int, radius: int):
    patterns = np.array([m for m, _ in _patterns(bits, radius)], U64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Fingerprints by the prefix of their variants; those of a batch with equal prefix share a row."""
        for batch in batches:
            value = batch.column("fingerprint").to_numpy().view(U64)
            cell = ((value >> U64(WIDTH - bits))[:, None] ^ patterns).ravel()
            source = np.repeat(np.arange(len(value)), len(patterns))
            order = np.argsort(cell, kind="stable")
            cell, packed = cell[order], value[source[order]]
            starts = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.empty(0, int)
            ends = np.append(starts[1:], len(cell))
            yield pa.RecordBatch.from_pydict(
                {
                    "cell": pa.array(cell[starts].astype(np.int64), pa.int64()),
                    "packed": pa.array([packed[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                }
            )

    return run


def _link_cells(bits: int, radius: int, forests: int):
    def run(cell: pa.Table) -> pa.Table:
        values = np.unique(np.concatenate([np.frombuffer(p, U64) for p in cell["packed"].to_pylist()]))
        prefix = np.full(len(values), U64(cell["cell"][0].as_py()) << U64(WIDTH - bits), U64)
        other, first = _link_values(values, np.arange(len(values)), prefix, bits, radius, forests)
        return pa.table({"a": _signed(first), "b": _signed(other)})

    return run


def ball_links(values: DataFrame, radius: int = RADIUS, forests: int = 0) -> DataFrame:
    """Links (a, b) that connect all ``fingerprint`` values at distance 2 * radius or less, and no others.

    Every two such values are connected through links, not each by its own. With
    ``forests``, each link is itself such a pair.
    """
    distinct = stage(values.select("fingerprint").distinct(), "fingerprints")
    n = distinct.count()
    bits = next((b for b in range(8, 33, 2) if n * _copies(b, radius) >> b <= PER_CELL), 32)
    cells = distinct.mapInArrow(_emit_prefixes(bits, radius), "cell long, packed binary")
    return cells.groupBy("cell").applyInArrow(_link_cells(bits, radius, forests), "a long, b long").distinct()


# --- components -------------------------------------------------------------------


def components(links: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of every node in ``links`` (a, b).

    Each round points every neighbour of a node at the smallest neighbour, larger
    and smaller ones in turn, until every node points at its root.
    """

    def low(edges: DataFrame) -> DataFrame:
        return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    def signature(edges: DataFrame):
        return edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = signature(edges)
    while True:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
        large = both.join(low(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage(large.where("u <> v").distinct(), "links")
        small = large.join(low(large), "u")
        small = small.select("v", "m").union(small.select("u", "m")).toDF("a", "b").where("a <> b").distinct()
        edges = stage(small, "links")
        after = signature(edges)
        if after == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = after


def _rooted(prints: DataFrame, radius: int, low: Column) -> DataFrame:
    """fingerprint, low and root (the smallest fingerprint reachable) of every fingerprint."""
    found = components(ball_links(prints, radius)).withColumnRenamed("node", "fingerprint")
    rooted = prints.groupBy("fingerprint").agg(low).join(found, "fingerprint", "left")
    return rooted.withColumn("root", F.coalesce("root", "fingerprint"))


def near_copies(docs: DataFrame, shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of each document.

    Null and empty texts have fingerprint zero. ``component_id`` is the smallest
    id reachable over links; null ids do not count, and a component without any
    id has null.
    """
    prints = stage(shingle_fingerprints(docs, ["doc_id"], shingle), "prints")
    rooted = _rooted(prints, radius, F.min("doc_id").alias("low"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    named = rooted.join(lowest, "root").select("fingerprint", "component_id")
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return prints.join(named, "fingerprint").select("doc_id", digits.alias("fingerprint"), "component_id")


def _first_row(key: str) -> Column:
    """The smallest id (null ids last), then the first row."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col(key).alias("key"))


def one_of_each_component(docs: DataFrame, shingle: int = 4, radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without copies and near copies.

    Of each component that ``near_copies`` finds, the row with the smallest id
    stays (null ids last, then in row order).
    """
    rows, key = with_row_id(docs, "near")
    prints = stage(shingle_fingerprints(rows, ["doc_id", key], shingle), "prints")
    rooted = _rooted(prints, radius, F.min(_first_row(key)).alias("low"))
    kept = rooted.groupBy("root").agg(F.min("low").alias("low")).select(F.col("low.key").alias(key))
    return rows.join(kept, key, "left_semi").drop(key)


@query("op1_near_copies")
def op1_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


# --- one document of each group, by the similarity of shingle sets ---------------------

SHINGLE, SIMILARITY = 5, 0.8
ORDER_BITS = 20  # counters of shingles, which order them
ORDER_ROW = 1 << 12  # counters in a row
MORE_HEADS = 4  # so many times more heads of a group in each round
SLACK = 1e-9  # of bounds, for rounding


def shingle_sets(texts: list[str], size: int) -> list[np.ndarray]:
    """The distinct hashes of every run of ``size`` words of each lower-cased text, sorted."""
    data = [utf8(t).lower() for t in texts]
    starts, _, words = hashed_words(np.frombuffer(b"\n".join(data) + b"\n", np.uint8))
    edges = np.searchsorted(starts, np.cumsum([0] + [len(d) + 1 for d in data])).tolist()
    runs = rolling_hash(words, size)
    found = []
    for a, b in zip(edges, edges[1:]):
        own = runs[a : b - size + 1] if b - a >= size else rolling_hash(words[a:b], b - a) if b > a else words[:0]
        found.append(np.unique(own))
    return found


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> U64(64 - ORDER_BITS)).astype(np.int64)


def _set_digests(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text", 4_000_000):
            digests = [xxhash.xxh3_128_digest(s.tobytes()) for s in shingle_sets(texts, size)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("key"), pa.array(digests, pa.binary())], ["doc_id", "key", "digest"]
            )

    return run


def _add_counts(parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.int64) for c in parts["cells"].to_pylist())
    return pa.table({"part": parts["part"].slice(0, 1), "cells": pa.array([total.tobytes()], pa.binary())})


def shingle_counts(texts: DataFrame, size: int) -> np.ndarray:
    """How often shingles occur, by the first ``ORDER_BITS`` bits of their hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << ORDER_BITS, np.int64)
        for _, part in text_batches(batches, "text", 4_000_000):
            total += np.bincount(_bucket(np.concatenate(shingle_sets(part, size))), minlength=len(total))
        for at in range(0, len(total), ORDER_ROW):
            own = total[at : at + ORDER_ROW]
            if own.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([at // ORDER_ROW], pa.int32()), "cells": pa.array([own.tobytes()], pa.binary())})

    out = np.zeros(1 << ORDER_BITS, np.int64)
    kind = "part int, cells binary"
    for row in texts.select("text").mapInArrow(run, kind).groupBy("part").applyInArrow(_add_counts, kind).collect():
        out[row["part"] * ORDER_ROW :][:ORDER_ROW] = np.frombuffer(row["cells"], np.int64)
    return out


def _prefixes(size: int, least: float, held):
    """The first shingles of each text, rare ones first: two sets as similar as ``least`` share one of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches, "text", 1_000_000):
            firsts, n = [], []
            for own in shingle_sets(texts, size):
                wanted = len(own) - int(np.ceil(least * len(own) - SLACK)) + 1 if len(own) else 0
                firsts.append(own[np.lexsort((own, held.value[_bucket(own)]))[:wanted]])
                n.append(len(own))
            count = np.array([len(f) for f in firsts])
            begin = np.cumsum(count) - count
            yield pa.RecordBatch.from_arrays(
                [
                    _signed(np.concatenate(firsts)),
                    pa.array(np.repeat(batch.column("key").to_numpy(), count), pa.int64()),
                    pa.array(np.repeat(n, count), pa.int32()),
                    pa.array(np.arange(count.sum()) - np.repeat(begin, count), pa.int32()),
                ],
                ["shingle", "node", "n", "place"],
            )

    return run


def shingle_set(text: str | None, size: int) -> set[bytes]:
    words = utf8(text).lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def _similar(size: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for one, other in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist()):
                x, y = shingle_set(one, size), shingle_set(other, size)
                either = len(x | y)
                kept.append(not either or len(x & y) >= least * either)
            mask = pa.array(kept, pa.bool_())
            yield batch.select(["a", "b"]).filter(mask)

    return run


def similar_components(texts: DataFrame, size: int, least: float) -> DataFrame:
    """node and root (a node) of every text (key, text) that is connected to others over pairs as similar as ``least``.

    Texts that share one of their first shingles are a group. In each round, some
    members of each group, its heads, are compared with all others that are not
    connected to them yet, and leave it. Rounds end when each group is connected
    or spent, so every similar pair was compared or is connected without.
    """
    held = texts.sparkSession.sparkContext.broadcast(shingle_counts(texts, size))
    members = "shingle long, node long, n int, place int"
    firsts = stage(texts.select("key", "text").mapInArrow(_prefixes(size, least, held), members), "first-shingles")
    shared = firsts.groupBy("shingle").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    left = stage(firsts.join(shared, "shingle", "left_semi").withColumn("root", F.col("node")), "groups")
    roots = stage(left.select("node", "root").distinct(), "roots")
    done = None
    heads = 1
    while not left.isEmpty():
        part = F.pmod(F.xxhash64("node"), F.lit(heads))
        first = left.groupBy("shingle", part.alias("part")).agg(F.min(F.struct("node", "n", "place", "root")).alias("h"))
        first = stage(first.select("shingle", *[F.col(f"h.{c}").alias(f"head_{c}") for c in ("node", "n", "place", "root")]), "heads")
        both = F.col("n") + F.col("head_n")
        shares = F.least(F.col("n") - F.col("place"), F.col("head_n") - F.col("head_place"))  # at most, if this is their first
        able = (F.col("root") != F.col("head_root")) & (shares >= least / (1 + least) * both - SLACK)
        able &= F.least("n", "head_n") >= least * F.greatest("n", "head_n") - SLACK
        pairs = left.join(first, "shingle").where(able)
        pairs = pairs.select(F.least("node", "head_node").alias("a"), F.greatest("node", "head_node").alias("b")).distinct()
        pairs = stage(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        done = pairs if done is None else done.union(pairs)
        ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).distinct()
        needed = texts.join(ends, "key", "left_semi").select("key", "text")
        compared = pairs.join(needed.toDF("a", "text_a"), "a").join(needed.toDF("b", "text_b"), "b")
        links = compared.mapInArrow(_similar(size, least), "a long, b long")
        own, other = roots.toDF("a", "root_a"), roots.toDF("b", "root_b")
        links = links.join(own, "a").join(other, "b").select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
        moved = components(links).toDF("root", "new_root")
        renew = lambda rows: rows.join(moved, "root", "left").withColumn("root", F.coalesce("new_root", "root")).drop("new_root")
        roots = stage(renew(roots).select("node", "root"), "roots")
        spent = first.select("shingle", F.col("head_node").alias("node"))
        left = left.join(spent, ["shingle", "node"], "left_anti").drop("root").join(roots, "node")
        left = stage(left.select("shingle", "node", "n", "place", "root"), "groups")
        apart = left.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
        left = stage(left.join(apart, "shingle", "left_semi"), "groups")
        heads *= MORE_HEADS
    return roots.where("node <> root")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and any others) without copies and near copies.

    Texts are near copies if the Jaccard similarity of their word shingles is
    ``similarity`` or more, or if such pairs connect them. All such pairs are
    found (see ``similar_components``) and verified on the texts. Of each group
    the row with the smallest id stays (null ids last, then in row order). Texts
    with the same shingles are one text, and texts without words are one group.
    """
    rows, key = with_row_id(docs, "near")
    own = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(key).alias("key"), "text")
    prints = stage(own.mapInArrow(_set_digests(shingle), "doc_id long, key long, digest binary"), "prints")
    texts = prints.groupBy("digest").agg(F.min(_first_row("key")).alias("first"))
    texts = stage(texts.select(F.col("first.key").alias("node"), "first"), "texts")
    distinct = own.join(texts.select(F.col("node").alias("key")), "key", "left_semi").select("key", "text")
    found = similar_components(distinct, shingle, similarity)
    rooted = texts.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.key").alias(key))
    return rows.join(kept, key, "left_semi").drop(key)
