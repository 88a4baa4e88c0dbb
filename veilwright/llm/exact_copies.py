"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame functions only.

Two texts are equal when they are identical without ASCII white space. A row's
digest is a 64-bit hash of what is left; rows whose digests collide are told
apart by SHA-256 and length, so no row is taken for another's copy by the
64 bits alone.

1. Each scan task's rows are a run. A run keeps one line for each distinct text:
   the best row (most code points, then smallest id) and how many rows it stands for.
2. Runs meet in binomial rounds: in round r, run i goes to the run with the last
   r digits of i, base ``FAN``, set to zero. Up to ``FAN`` sorted runs merge, and the
   better row of each text stays. After log(runs) rounds run 0 knows every text.
3. The result goes down the same tree to the rows, for texts with copies only. A
   key is (run, text) on each level, so however many rows hold one text, no task
   gets more of them than one run or ``FAN`` lines.

Runs are written sorted by digest to the shared folder, so a lost executor costs
no more than its task. Texts never travel: a row is about 70 bytes.

Null texts count as empty, and empty texts equal each other. Null ids come last.
Rows with equal ids and equally long texts are told apart by their place in the
table: one of them stays. Other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stage
from .common import fresh_name, query, table, with_row_id

FAN = 16
TEXT = ("digest", "sha", "size")  # what tells texts apart

#: ASCII white space, as Java and DuckDB write the class.
BLANK = r"[\x20\x09-\x0D]"


def _rows(docs: DataFrame, row: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.regexp_replace(text, f"{BLANK}+", "")
    doc_id = F.col("doc_id")
    best = F.struct(
        (-F.length(text)).alias("shorter"), doc_id.isNull().alias("nameless"), doc_id.alias("doc_id"), F.col(row).alias("row")
    )
    return docs.select(
        F.spark_partition_id().alias("run"),
        F.xxhash64(bare).alias("digest"),
        F.unhex(F.sha2(bare, 256)).alias("sha"),
        F.octet_length(bare).alias("size"),
        best.alias("best"),
    )


def _merged(lines: DataFrame, run: Column, rows: Column) -> DataFrame:
    """One line for each run and text, sorted by digest within each run."""
    merged = lines.groupBy(run.alias("run"), *TEXT).agg(F.min("best").alias("best"), F.sum(rows).alias("rows"))
    return stage(merged.sortWithinPartitions("run", "digest"), "run")


def _parent(level: int) -> Column:
    return F.col("run") - F.pmod(F.col("run"), F.lit(FAN ** (level + 1)))


def copy_groups(named: DataFrame, key: str) -> DataFrame:
    """For each row of ``named`` (doc_id, text and any others; ``key`` numbers its rows) its number, doc_id,
    keep_id (the id of the row that stays), group_size, kept and text_sha256 (of the text without white space).
    """
    rows = stage(_rows(named, key), "digests")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    levels = [_merged(rows, F.col("run"), F.lit(1))]
    while FAN ** (len(levels) - 1) < runs:
        levels.append(_merged(levels[-1], _parent(len(levels) - 1), F.col("rows")))
    # Down the tree, texts with copies only.
    known = levels[-1].where("rows > 1").select("run", *TEXT, F.col("best").alias("keep"), F.col("rows").alias("group_size"))
    for level in range(len(levels) - 2, -1, -1):
        lines = levels[level].select(F.col("run").alias("own"), _parent(level).alias("run"), *TEXT)
        found = lines.join(known, ["run", *TEXT])
        known = stage(found.select(F.col("own").alias("run"), *TEXT, "keep", "group_size"), "known")
    told = rows.join(known, ["run", *TEXT], "left")
    single = F.col("keep").isNull()
    return told.select(
        F.col("best.row").alias(key),
        F.col("best.doc_id").alias("doc_id"),
        F.when(single, F.col("best.doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("keep.row") == F.col("best.row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one of each group of equal texts, with all their columns."""
    named, key = with_row_id(docs, "copies")
    gone = fresh_name(named, "row_of_copy")
    dropped = copy_groups(named, key).where("NOT kept").select(F.col(key).alias(gone))
    return named.join(dropped, F.col(key) == F.col(gone), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


COPIES_SQL = f"""
WITH rows AS (SELECT doc_id, length(coalesce(text, '')) AS points,
    sha256(regexp_replace(coalesce(text, ''), '{BLANK}', '', 'g')) AS text_sha256 FROM documents),
best AS (SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY points DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size FROM rows)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM best
"""


@query("op12_exact_copies", COPIES_SQL)
def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    named, key = with_row_id(table(spark, sf_dir, "documents"), "copies")
    return copy_groups(named, key).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
