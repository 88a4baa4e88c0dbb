"""Approximate nearest neighbours by cosine, on a graph built by NN-descent.

The graph holds, for each distinct vector, its ``degree`` nearest found so far.
It starts from vectors that are neighbours in the order of random hyperplane
codes. Each round then compares, around every vector, its neighbours with each
other: neighbours of neighbours are likely neighbours. A round gathers the edges,
both ways, by centre, joins them with the vectors, and merges what it finds into
the list of each vector, which is one row. Pairs that were compared before are
left out, and rounds end when few edges change.

A query walks the graph greedily from a vector of the graph, its own: the best
candidates not yet visited are expanded by a join with the graph until the best
``beam`` are all visited. Its beam is one row; a vector that fell out of it and is
met again is compared again and falls out again, as the beam only gets better.
Most of a result comes from the graph itself, whose work is in proportion to the
vectors; a walk mends it and visits hardly more vectors than ``beam``, however
many there are.

Equal vectors are one vector of the graph; of each, the smallest ids are kept as
many as a result can need, so a vector that a third of all rows share costs no
more than another. Ids that are null, vectors that are null, zero, or hold nulls,
infinities or NaN, and vectors whose length is not the most common one take no
part. Rows that repeat both id and vector are one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import stage
from .common import query, table

DEGREE = 30
REVERSE = 30
TREES = 4
BLOCK = 128
FEW = 0.01  # changed edges, as a share of all, that end the rounds
BEAM, EXPAND = 80, 40
SMALL = 10_000  # vectors; above, degree and beam grow with the logarithm of their number
DEGREE_GROWTH, BEAM_GROWTH = 0.15, 0.05  # for each factor of e
SALTS = 64
CELLS = 2_000_000  # similarities that a task holds at once
LEAST_VECTORS, LEAST_WALKS = 256, 8  # of a task; it costs more than to work on fewer

GRAPH = "node long, unit binary, edges array<struct<other:long,sim:float,fresh:int>>, worst float"
FOUND = "node long, found array<struct<other:long,sim:float>>"
WALKS = "query long, wanted binary, beam array<struct<node:long,sim:float,visited:int>>"


def _matrix(column: pa.Array | pa.ChunkedArray, dtype="<f4") -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype).reshape(len(rows), -1)


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return (wide / np.linalg.norm(wide, axis=1, keepdims=True)).astype("<f4")


def best(node: np.ndarray, other: np.ndarray, sim: np.ndarray, most: int) -> np.ndarray:
    """Indices of the ``most`` best distinct others of every node."""
    order = np.lexsort((other, -sim, node))
    n, o = node[order], other[order]
    first = np.ones(len(order), bool)  # equal pairs have equal sims, so they lie together
    first[1:] = (n[1:] != n[:-1]) | (o[1:] != o[:-1])
    order = order[first]
    n = node[order]
    start = np.flatnonzero(np.concatenate([[True], n[1:] != n[:-1]])) if len(n) else np.empty(0, int)
    place = np.arange(len(n)) - np.repeat(start, np.diff(np.append(start, len(n))))
    return order[place < most]


def _lists(lengths: np.ndarray, **values: np.ndarray) -> pa.ListArray:
    """Lists of structs of ``values``, which lie in the order of the lists."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<i4")
    arrays = [pa.array(v, {"sim": pa.float32(), "fresh": pa.int32(), "visited": pa.int32()}.get(k, pa.int64())) for k, v in values.items()]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(arrays, list(values)))


def _found(node: np.ndarray, other: np.ndarray, sim: np.ndarray) -> pa.RecordBatch:
    """A row for each run of equal nodes."""
    start = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    lists = _lists(np.diff(np.append(start, len(node))), other=other, sim=sim)
    return pa.RecordBatch.from_arrays([pa.array(node[start], pa.int64()), lists], ["node", "found"])


# --- distinct vectors ---------------------------------------------------------------


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id and embedding (doubles) of the rows that take part."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)
    rows = rows.where(F.exists("embedding", lambda x: x != 0.0))
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("embedding") == (common["n"] if common else 0))


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column("embedding")
        if not batch.num_rows:
            continue
        flat = lists.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) + 0.0  # no negative zero
        packed = pa.array([r.tobytes() for r in flat.astype("<f8")], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("vec_id"), packed], ["vec_id", "raw"])


def _add_unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            unit = _unit(_matrix(batch.column("raw"), "<f8"))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([r.tobytes() for r in unit], pa.binary())], [*batch.schema.names, "unit"]
            )


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """node (the smallest id), the ``keep`` smallest ids, the vector's bytes and its unit vector."""
    packed = rows.mapInArrow(_pack, "vec_id long, raw binary").distinct()
    salted = packed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS)))
    inside = Window.partitionBy("raw", "salt").orderBy("vec_id")
    low = salted.withColumn("place", F.row_number().over(inside)).where(F.col("place") <= keep)
    ids = low.groupBy("raw").agg(F.slice(F.sort_array(F.collect_list("vec_id")), 1, keep).alias("ids"))
    named = ids.select(F.col("ids")[0].alias("node"), "ids", "raw")
    return named.mapInArrow(_add_unit, "node long, ids array<long>, raw binary, unit binary")


def _fewer_tasks(df: DataFrame, tasks: int) -> DataFrame:
    """``df`` in at most so many partitions, or as many as there are cores. Rows of a former one stay together, in order."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, tasks))


# --- the graph ------------------------------------------------------------------------


def _planes(size: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((size, 32)).astype("<f4")


def _codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each vector once for each tree, with its code there."""
    for batch in batches:
        for tree in range(TREES if batch.num_rows else 0):
            unit = _matrix(batch.column("unit"))
            code = (unit @ _planes(unit.shape[1], tree) > 0) @ (np.int64(1) << np.arange(32))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(len(code), tree), pa.int32()), pa.array(code, pa.int64())],
                [*batch.schema.names, "tree", "code"],
            )


def _compare_blocks(degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best pairs among about ``BLOCK`` consecutive vectors of a tree."""
        for batch in batches:
            if not batch.num_rows:
                continue
            node, unit, tree = batch.column("node").to_numpy(), _matrix(batch.column("unit")), batch.column("tree").to_numpy()
            cuts = [0, *(np.flatnonzero(tree[1:] != tree[:-1]) + 1).tolist(), len(node)]
            for low, high in zip(cuts, cuts[1:]):
                ends = np.linspace(low, high, max(1, round((high - low) / BLOCK)) + 1).astype(int)
                for at, to in zip(ends, ends[1:]):
                    own = node[at:to]
                    sims = unit[at:to] @ unit[at:to].T
                    np.fill_diagonal(sims, -2)
                    most = min(degree, len(own) - 1)
                    if most:
                        top = np.argpartition(-sims, most - 1, axis=1)[:, :most]
                        yield _found(np.repeat(own, most), own[top].ravel(), np.take_along_axis(sims, top, 1).ravel())

    return run


def _keep_best(degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best ``degree`` distinct edges of each node, best first; those that it had are not fresh."""
        for batch in batches:
            if not batch.num_rows:
                continue
            lists = [batch.column(c) for c in ("edges", "found")]
            had, new = (x.flatten() for x in lists)
            row = np.concatenate([np.repeat(np.arange(batch.num_rows), x.value_lengths().fill_null(0).to_numpy()) for x in lists])
            other, sim = (np.concatenate([had.field(k).to_numpy(), new.field(k).to_numpy()]) for k in ("other", "sim"))
            fresh = np.repeat([0, 1], [len(had), len(new)])
            order = np.lexsort((-sim, fresh, other, row))
            first = np.ones(len(order), bool)
            first[1:] = (row[order[1:]] != row[order[:-1]]) | (other[order[1:]] != other[order[:-1]])
            order = order[first]
            order = order[best(row[order], other[order], sim[order], degree)]
            size = np.bincount(row[order], minlength=batch.num_rows)
            worst = np.full(batch.num_rows, -2.0)
            full = size >= degree
            worst[full] = sim[order][np.cumsum(size)[full] - 1]
            edges = _lists(size, other=other[order], sim=sim[order], fresh=fresh[order])
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("unit"), edges, pa.array(worst, pa.float32())], ["node", "unit", "edges", "worst"]
            )

    return run


def _merged(graph: DataFrame, found: DataFrame, degree: int, tasks: int) -> DataFrame:
    lists = found.groupBy("node").agg(F.flatten(F.collect_list("found")).alias("found"))
    rows = graph.join(lists, "node", "left").select("node", "unit", "edges", "found")
    return stage(_fewer_tasks(rows, tasks).mapInArrow(_keep_best(degree), GRAPH), "graph")


def _compare_around(degree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by centre; compare the vectors around each centre and emit what beats their worst edge."""
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            centre = batch.column("centre").to_numpy()
            change = np.flatnonzero(centre[1:] != centre[:-1])
            if not len(change):
                held.append(batch)
                continue
            cut = int(change[-1]) + 1
            yield from compare(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield from compare(pa.Table.from_batches(held))

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        centre, node = rows["centre"].to_numpy(), rows["node"].to_numpy()
        worst, fresh = rows["worst"].to_numpy(), rows["fresh"].to_numpy().astype(bool)
        unit = _matrix(rows["unit"])
        start = np.flatnonzero(np.concatenate([[True], centre[1:] != centre[:-1]]))
        size = np.diff(np.append(start, len(centre)))
        found = []
        step = max(1, min(512, CELLS // int(size.max()) ** 2))
        for at in range(0, len(start), step):
            s, c = start[at : at + step], size[at : at + step]
            place = s[:, None] + np.minimum(np.arange(c.max()), c[:, None] - 1)
            real = np.arange(c.max()) < c[:, None]
            block = unit[place]
            sims = block @ block.transpose(0, 2, 1)
            new = fresh[place] & real
            use = real[:, :, None] & real[:, None, :] & (new[:, :, None] | new[:, None, :])
            use &= sims > worst[place][:, :, None]
            use &= node[place][:, :, None] != node[place][:, None, :]
            i, a, b = np.nonzero(use)
            found.append((node[place[i, a]], node[place[i, b]], sims[i, a, b]))
        one, other, sim = (np.concatenate(x) for x in zip(*found))
        kept = best(one, other, sim, degree)
        if len(kept):
            yield _found(one[kept], other[kept], sim[kept])

    return run


def effort(n: int) -> tuple[int, int]:
    """Degree and beam for ``n`` vectors."""
    grown = math.log(max(1.0, n / SMALL))
    return round(DEGREE * (1 + DEGREE_GROWTH * grown)), round(BEAM * (1 + BEAM_GROWTH * grown))


def neighbour_graph(vectors: DataFrame, degree: int = DEGREE) -> DataFrame:
    """node, other, sim: about the ``degree`` nearest others of each vector (node, unit)."""
    tasks = vectors.count() // LEAST_VECTORS
    coded = vectors.select("node", "unit").mapInArrow(_codes, "node long, unit binary, tree int, code long")
    ordered = coded.repartitionByRange("tree", "code", "node").sortWithinPartitions("tree", "code", "node").drop("code")
    bare = vectors.select("node", "unit", F.array().cast("array<struct<other:long,sim:float,fresh:int>>").alias("edges"))
    graph = _merged(bare, _fewer_tasks(ordered, tasks).mapInArrow(_compare_blocks(degree), FOUND), degree, tasks)
    total = graph.agg(F.sum(F.size("edges"))).first()[0] or 0
    for number in count():  # ends, as edges only get better
        edges = graph.select("node", F.inline("edges"))
        forth = edges.select(F.col("node").alias("centre"), F.col("other").alias("node"), "fresh", F.lit(0).alias("back"))
        forth = forth.withColumn("drawn", F.lit(0).cast("long"))
        drawn = F.xxhash64("node", "other", F.lit(number))
        back = edges.select(F.col("other").alias("centre"), "node", "fresh", F.lit(1).alias("back"), drawn.alias("drawn"))
        # All that lead from the centre, and enough of those that lead to it; each task sends no more than that on.
        order = Window.partitionBy("centre").orderBy("back", F.desc("fresh"), "drawn")
        around = forth.union(back).withColumn("place", F.row_number().over(order))
        around = around.where(F.col("place") <= degree + max(REVERSE, degree))
        around = around.groupBy("centre", "node").agg(F.max("fresh").alias("fresh"))
        rows = around.join(graph.select("node", "worst", "unit"), "node").select("centre", "node", "fresh", "worst", "unit")
        rows = _fewer_tasks(rows.repartition("centre").sortWithinPartitions("centre"), tasks)
        graph = _merged(graph, rows.mapInArrow(_compare_around(degree), FOUND), degree, tasks)
        changed = graph.select(F.inline("edges")).agg(F.sum("fresh")).first()[0] or 0
        if changed <= FEW * total:
            break
    return graph.select("node", F.inline("edges")).drop("fresh")


# --- search -----------------------------------------------------------------------------


def _walk(beam: int):
    def run(walk: pa.Table, offered: pa.Table) -> pa.Table:
        """A walk after a turn: its best unvisited are visited, and what they led to is in the beam if it is good enough."""
        held = walk["beam"].combine_chunks().flatten()
        node, sim, visited = (held.field(k).to_numpy().copy() for k in ("node", "sim", "visited"))
        visited[np.flatnonzero(visited == 0)[:EXPAND]] = 1  # best first
        if offered.num_rows:
            new = offered["node"].to_numpy()
            sims = _matrix(offered["unit"]) @ _matrix(walk["wanted"])[0]
            add = ~np.isin(new, node)
            node, sim = np.concatenate([node, new[add]]), np.concatenate([sim, sims[add]])
            visited = np.concatenate([visited, np.zeros(add.sum(), visited.dtype)])
        order = np.lexsort((node, -sim))[:beam]
        lists = _lists(np.array([len(order)]), node=node[order], sim=sim[order], visited=visited[order])
        return pa.table({"query": walk["query"], "wanted": walk["wanted"], "beam": lists})

    return run


def greedy_search(
    graph: DataFrame, vectors: DataFrame, queries: DataFrame, beam: int = BEAM, reverse: int = REVERSE
) -> DataFrame:
    """query, node, sim: the best ``beam`` vectors found for each query (query, wanted: its unit vector, start: a node)."""
    units = vectors.select("node", "unit")
    back = graph.select(F.col("other").alias("node"), F.col("node").alias("other"), "sim")
    order = Window.partitionBy("node").orderBy(F.desc("sim"), "other")
    back = back.withColumn("place", F.row_number().over(order)).where(F.col("place") <= reverse)  # each task sends no more on
    links = graph.select("node", "other").union(back.select("node", "other"))
    links = stage(links.groupBy("node").agg(F.collect_set("other").alias("links")), "links")

    tasks = queries.count() // LEAST_WALKS
    walks = queries.select("query", "wanted", F.array().cast("array<struct<node:long,sim:float,visited:int>>").alias("beam"))
    offered = queries.select("query", F.col("start").alias("node"))
    while True:  # ends, as each turn visits vectors for good
        rows = offered.join(units, "node").select(F.col("query").alias("walk"), "node", "unit")
        after = walks.groupBy("query").cogroup(rows.groupBy("walk")).applyInArrow(_walk(beam), WALKS)
        walks = stage(_fewer_tasks(after, tasks), "walks")
        if walks.where(F.exists("beam", lambda x: x["visited"] == 0)).isEmpty():
            break
        turn = F.slice(F.filter("beam", lambda x: x["visited"] == 0), 1, EXPAND)
        expanded = walks.select("query", F.explode(turn["node"]).alias("node")).join(links, "node")
        offered = expanded.groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("links"))).alias("nodes"))
        offered = offered.select("query", F.explode("nodes").alias("node"))
    return walks.select("query", F.inline("beam")).drop("visited")


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            a, b = _matrix(batch.column("wanted"), "<f8"), _matrix(batch.column("raw"), "<f8")
            score = np.einsum("ij,ij->i", a, b) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id"), batch.column("ids"), pa.array(score, pa.float64())], ["query_id", "ids", "score"]
            )


def nearest(vectors: DataFrame, every: int = 50, k: int = 5) -> DataFrame:
    """The ``k`` nearest rows of each row whose vec_id is divisible by ``every``."""
    rows = usable(vectors)
    nodes = stage(distinct_vectors(rows, k + 1), "vectors")
    degree, beam = effort(nodes.count())
    graph = neighbour_graph(nodes, degree)
    asking = rows.where(F.col("vec_id") % every == 0).mapInArrow(_pack, "vec_id long, raw binary").distinct()
    asking = stage(asking.join(nodes, "raw").select(F.col("vec_id").alias("query_id"), "node"), "asking")
    walks = asking.select("node").distinct().join(nodes, "node").select(
        F.col("node").alias("query"), F.col("unit").alias("wanted"), F.col("node").alias("start")
    )
    found = greedy_search(graph, nodes, walks, beam, max(REVERSE, degree))
    raw = nodes.select("node", "raw")
    hits = (
        asking.join(raw.toDF("node", "wanted"), "node")
        .withColumnRenamed("node", "query")
        .join(found.select("query", "node"), "query")
        .join(nodes.select("node", "ids", "raw"), "node")
        .select("query_id", "ids", "wanted", "raw")
        .mapInArrow(_exact, "query_id long, ids array<long>, score double")
    )
    each = hits.select("query_id", F.explode("ids").alias("vec_id"), "score").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


@query("op8_neighbours")
def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
