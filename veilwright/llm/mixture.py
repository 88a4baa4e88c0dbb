"""Mixing sources to target weights by Pareto order sampling.

A source's target is its weight's share of the wanted words; no target exceeds
``max_copies`` times its source, and what that leaves over is shared again.
A document of a source with target t and n words is due t / n copies. The whole
part is certain. For the rest p, documents are ranked by the odds of a random
number divided by the odds of p (Pareto order sampling), and taken in that order
until the source's remaining words are filled: a sample of fixed size with
unequal probabilities, without replacement. Unequal ``preference`` values make
p differ inside a source, too.

A document that no longer fits ends the order; ``ROUNDS`` passes fill what is
left with the next documents that fit, in the same order.

The random numbers are digests of the document ids, so reruns agree. Running
sums go over about sqrt(rows) slices of the order and then inside each slice,
so a source that holds a third of all rows is never sorted in one task.

Each pass takes a first part of its source's order, so what it left to fill and
the last row that it took (``source_cuts``) decide for every row by itself.
``mix_documents`` counts words twice and shuffles no text.

Null texts and texts without words have size 0. Null sources are a source, the
last one. Rows with equal ids get equal numbers and are taken in order of size,
then of ``key``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.numbers import keyed_uniform
from ..operators.ordered import with_position
from ..session import stage
from .common import WORD, query, table, with_row_id

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_COPIES = 2
ROUNDS = 3
SEED = "mix"
ORDER = ("rank", "doc_id", "size", "key")
FEW_SOURCES = 10_000  # sources whose cuts, a row of about 200 bytes each, go to every task


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, max_copies: int = MAX_COPIES
) -> DataFrame:
    """source, source_no, source_size and target of every source; ``sizes`` has source and size."""
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    numbered = with_position(sums, [F.col("source").asc_nulls_last()], "source_no")
    sources = (
        numbered.withColumn("weight", F.get(cycle, F.pmod("source_no", F.lit(len(weights))).cast("int")))
        .withColumn("most", F.col("source_size").cast("double") * float(max_copies))
    )
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    wanted = (total or 0) * share
    rate, above = (wanted / weight if weight else 0.0), -1
    while True:  # each pass caps the sources that the last rate would put above their most
        over = F.col("most") < F.col("weight") * F.lit(rate)
        capped, n, free = sources.agg(
            F.coalesce(F.sum(F.when(over, F.col("most"))), F.lit(0.0)),
            F.count(F.when(over, F.lit(1))),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == above or not free:
            break
        rate, above = (wanted - capped) / free, n
    target = F.least("most", F.col("weight") * F.lit(rate))
    return sources.select("source", "source_no", "source_size", target.alias("target"))


def _fill(rows: DataFrame, slices: int, number: int, label: str) -> DataFrame:
    """Take, in rank order, the documents that fit into what is left of each source, in round ``number``."""
    left = rows.groupBy("source_no").agg(
        (F.first("target") - F.sum((F.col("whole") + F.col("extra")) * F.col("size"))).alias("left")
    )
    fits = F.coalesce((F.col("extra") == 0) & (F.col("size") <= F.col("left")), F.lit(False)) & F.col("rank").isNotNull()
    slice_no = F.floor(F.col("rank") / (F.col("rank") + 1.0) * slices)
    spread = F.pmod(F.xxhash64("key"), F.lit(slices))
    wide = rows.join(left, "source_no").withColumn("fits", fits)
    wide = wide.withColumn("slice", F.when(F.col("fits"), slice_no).otherwise(spread).cast("long"))
    so_far = Window.partitionBy("source_no").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        wide.where("fits")
        .repartition("source_no", "slice")  # else the window below would deal all rows out by source
        .groupBy("source_no", "slice")
        .agg(F.sum("size").alias("words"))
        .select("source_no", "slice", F.lit(True).alias("fits"), F.coalesce(F.sum("words").over(so_far), F.lit(0)).alias("before"))
    )
    inside = Window.partitionBy("source_no", "fits", "slice").orderBy(*ORDER).rowsBetween(
        Window.unboundedPreceding, 0
    )
    taken = F.col("fits") & (F.col("before") + F.sum("size").over(inside) <= F.col("left"))
    done = wide.join(before, ["source_no", "fits", "slice"], "left").withColumn("taken", F.coalesce(taken, F.lit(False)))
    done = done.withColumn("round", F.when(F.col("taken"), F.lit(number)).otherwise(F.col("round")))
    done = done.withColumn("extra", F.col("extra") + F.col("taken").cast("int"))
    return stage(done.select(*rows.columns), label)


def _ranked(rows: DataFrame, seed: str, max_copies: int) -> DataFrame:
    """whole and rank of rows that know their source's target and liked."""
    due = F.col("target") / F.col("liked") * F.col("preference")
    chance = F.col("due") - F.col("whole")
    random = keyed_uniform(seed, "pareto", F.col("doc_id"))
    return (
        rows.withColumn("due", F.when(F.col("liked") > 0, F.least(due, F.lit(float(max_copies)))).otherwise(F.lit(0.0)))
        .withColumn("whole", F.floor("due").cast("int"))
        .withColumn("u", F.coalesce(random, F.lit(0.5)))
        .withColumn("rank", F.when(chance > 0, F.col("u") / (1.0 - F.col("u")) / (chance / (1.0 - chance))))
        .drop("u", "due")
    )


def _filled(
    rows: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = SHARE,
    max_copies: int = MAX_COPIES,
    seed: str = SEED,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, DataFrame]:
    """The rows of ``mix_copies`` with the round that took them, and the sources."""
    if "preference" not in rows.columns:
        rows = rows.withColumn("preference", F.lit(1.0))
    rows = stage(rows.select("key", "doc_id", "source", "size", "preference"), "sizes")
    sources = source_targets(rows, weights, share, max_copies)
    liked = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("preference")).alias("liked"))
    sources = sources.join(liked, sources["source"].eqNullSafe(liked["source"])).drop(liked["source"])
    sources = stage(sources, "sources")  # one sum of the preferences for all who read it
    named = sources.withColumnRenamed("source", "source_name")
    ranked = _ranked(rows.join(named, rows["source"].eqNullSafe(named["source_name"])).drop("source_name"), seed, max_copies)
    ranked = ranked.withColumn("extra", F.lit(0)).withColumn("round", F.lit(None).cast("int"))
    ranked = stage(ranked.drop("preference", "liked"), "ranked")
    slices = max(1, math.isqrt(ranked.count()))
    for number in range(rounds):
        ranked = _fill(ranked, slices, number, "filled")
    return ranked, sources


def mix_copies(rows: DataFrame, **options) -> DataFrame:
    """``rows`` (key, doc_id, source, size and, if wanted, preference > 0) with source_size, target and copies.

    ``options``: weights, share, max_copies, seed and rounds.
    """
    filled, _ = _filled(rows, **options)
    return filled.drop("round").withColumn("copies", F.col("whole") + F.col("extra"))


def source_cuts(filled: DataFrame, sources: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``sources`` with what each round had left to fill (left0, ...) and the last row that it took (cut0, ...)."""
    sums = []
    for k in range(rounds):
        before = F.coalesce(F.col("round") < k, F.lit(False)).cast("int")
        sums.append((F.first("target") - F.sum((F.col("whole") + before) * F.col("size"))).alias(f"left{k}"))
        sums.append(F.max(F.when(F.col("round") == k, F.struct(*ORDER))).alias(f"cut{k}"))
    cuts = filled.groupBy("source_no").agg(*sums) if sums else filled.select("source_no").distinct()
    return sources.join(cuts, "source_no").drop("source_no", "source_size")


def mix_documents(
    docs: DataFrame, max_copies: int = MAX_COPIES, seed: str = SEED, rounds: int = ROUNDS, **options
) -> DataFrame:
    """The rows of ``docs`` (doc_id, text, source and any others), each as often as the mix takes it."""
    rows, key = with_row_id(docs, "mix")
    own = [F.col(f"`{c}`") for c in docs.columns]
    named = rows.select(F.struct(*own).alias("row"), F.col(key).alias("key"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    filled, sources = _filled(named.drop("row"), max_copies=max_copies, seed=seed, rounds=rounds, **options)
    if sources.limit(FEW_SOURCES + 1).count() <= FEW_SOURCES:
        cuts = stage(source_cuts(filled, sources, rounds).withColumnRenamed("source", "source_name"), "cuts")
        wide = named.join(F.broadcast(cuts), named["source"].eqNullSafe(cuts["source_name"]))
        wide = _ranked(wide.withColumn("preference", F.lit(1.0)), seed, max_copies)
        taken = F.lit(False)
        for k in range(rounds):
            taken = taken | F.coalesce((F.col("size") <= F.col(f"left{k}")) & (F.struct(*ORDER) <= F.col(f"cut{k}")), F.lit(False))
        taken = F.col("rank").isNotNull() & taken
        counted = wide.select("row", (F.col("whole") + taken.cast("int")).alias("copies"))
    else:
        copies = filled.select("key", (F.col("whole") + F.col("extra")).alias("copies"))
        counted = named.drop("doc_id", "source", "size").join(copies.where("copies > 0"), "key")
    times = F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")
    return counted.where("copies > 0").select("row", times).select("row.*")


def _round_sql(k: int) -> str:
    before = f"r{k - 1}" if k else "ranked"
    return f"""
l{k} AS (SELECT source_no, min(target) - sum((whole + extra) * size) AS room FROM {before} GROUP BY ALL),
f{k} AS (SELECT {before}.*, coalesce(extra = 0 AND size <= room AND rank IS NOT NULL, false) AS fits, room
  FROM {before} JOIN l{k} USING (source_no)),
r{k} AS (SELECT * EXCLUDE (fits, room, extra), extra + CASE WHEN fits AND sum(size) OVER (
    PARTITION BY source_no, fits ORDER BY rank, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) <= room THEN 1 ELSE 0 END AS extra
  FROM f{k})"""


MIX_SQL = f"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
sources AS (SELECT source, sum(size)::BIGINT AS source_size,
    [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS weight,
    row_number() OVER (ORDER BY source NULLS LAST) AS source_no FROM sized GROUP BY source),
ordered AS (SELECT *, 2.0::DOUBLE * source_size AS most, 2.0::DOUBLE * source_size / weight AS level,
    1.5::DOUBLE * sum(source_size) OVER () AS wanted FROM sources),
running AS (SELECT *, (wanted - coalesce(sum(most) OVER (ORDER BY level, source_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY level, source_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rate FROM ordered),
final AS (SELECT (max(wanted) - coalesce(sum(most) FILTER (level < rate), 0)) / sum(weight) FILTER (NOT level < rate) AS rate FROM running),
targets AS (SELECT source, source_no, source_size,
    CASE WHEN running.level < running.rate THEN most ELSE least(most, weight * final.rate) END AS target FROM running, final),
due AS (SELECT doc_id, size, source_no, source_size, target,
    CASE WHEN source_size > 0 THEN least(target / source_size, 2.0::DOUBLE) ELSE 0 END AS due,
    coalesce((('0x' || substr(sha256('{SEED}|pareto|' || doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE, 0.5::DOUBLE) AS u
  FROM sized JOIN targets ON sized.source IS NOT DISTINCT FROM targets.source),
ranked AS (SELECT * EXCLUDE (due, u), floor(due)::INT AS whole, 0 AS extra,
    CASE WHEN due - floor(due) > 0 THEN u / (1.0::DOUBLE - u) / ((due - floor(due)) / (1.0::DOUBLE - (due - floor(due)))) END AS rank FROM due),
{",".join(_round_sql(k) for k in range(ROUNDS))}
SELECT doc_id, size, source_size, target, (whole + extra)::BIGINT * size AS taken FROM r{ROUNDS - 1}
"""


@query("op2_mixture", MIX_SQL)
def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    sized = docs.select(F.col("doc_id").alias("key"), "doc_id", "source", word_count(F.col("text")).alias("size"))
    mixed = mix_copies(sized)
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
