"""Secret scan with a random forest that removes false positives.

Candidates are long runs of key characters with a digit, and any values of four
characters or more behind a credential's name and = or :, found in whole texts by
two patterns, each place with the two words before and the word behind it. Each gets
features: its length, shares of digits, capitals and hexadecimal digits, changes
between kinds of neighbouring characters, entropy, how much of it the corpus's
frequent words cover, what the path says, and what its neighbours are. A random
forest trained on labelled findings then scores every place; a candidate has its
largest score in the document.

``label_findings`` labels the clear cases by rule (issued key formats and values
assigned to a credential's name against numbers and text); a bounded number of
them, at most ``TRAIN`` for each label, trains the forest. A user's own reviewed
findings can be given instead. Where findings of one label only exist, nothing
can be learned and every candidate stays, with score 1.

All of it is DataFrame, SQL and MLlib expressions. Null and empty texts have no
candidates; a candidate that repeats in a text is one finding with its count.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..session import stage
from .common import query, table

#: Whole runs of 16 key characters or more.
RUN = r"(?<![A-Za-z0-9+/_\-])[A-Za-z0-9+/_\-]{16,}+={0,2}"
BEFORE, BEHIND = 60, 30  # characters around a candidate that are looked at

NAMES = "token|secret|password|passwd|pwd|api_?key|apikey|access|auth|credential|private"
#: What comes before a value and the value that a credential's name is given, up to a blank or quote; then the word behind.
ASSIGNED = (
    rf"(?i)((?:{NAMES})[A-Za-z0-9_\-]{{0,16}}[\"']?\s{{0,3}}[=:]\s{{0,3}}[\"']?)"
    r"([^\s\"']{3,}[^\s\"',;.])(?=[\s\"',;.]{0,3}([^\s]{0,24}))"
)
HARMLESS = "example|sample|dummy|test|placeholder|sha|md5|commit|uuid|checksum|order|invoice|card|phone"
TEST_PATH = "test|example|sample|fixture|mock|doc"
ISSUED = r"^(AKIA|ASIA)[A-Z0-9]{16}$|^gh[pousr]_[A-Za-z0-9]{36}$|^xox[abprs]-[A-Za-z0-9\-]{10,}$|^AIza[A-Za-z0-9_\-]{35}$"

DICTIONARY = 1500  # frequent words of four letters or more
TRAIN = 4000
TREES, DEPTH, SEED = 30, 6, 3
LEAST = 0.5
SALTS = 16

FEATURES = (
    "length digits capitals hexadecimal changes entropy covered named assigned harmless neighbours_known quoted "
    "test_path path_depth"
).split()


def _share(text: Column, chars: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{chars}]")) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits a character."""
    chars = F.split(text, "")
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    times = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.filter(chars, lambda c: c != "")), F.lit(0.0), lambda a, c: a - times(c) * F.log2(times(c)))


def frequent_words(docs: DataFrame, most: int = DICTIONARY) -> list[str]:
    """The ``most`` frequent words of four to twelve letters, over all texts."""
    words = docs.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(?<![\p{L}\d])(\p{L}{4,12})(?![\p{L}\d])"), 1)).alias("word"))
    top = words.groupBy("word").count().orderBy(F.desc("count"), "word").limit(most)
    return [r["word"] for r in top.collect()]


def find_candidates(docs: DataFrame, key: str, path: str) -> DataFrame:
    """row, key, path, candidate, before (up to two words), behind (a word) and times; a row for each different context."""
    pattern = F.lit(ASSIGNED)
    given = F.arrays_zip(
        F.regexp_extract_all("text", pattern, 2).alias("candidate"),
        F.regexp_extract_all("text", pattern, 1).alias("before"),
        F.regexp_extract_all("text", pattern, 3).alias("behind"),
    )
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(key).alias("key"),
        F.coalesce(F.col(path), F.lit("")).alias("path"),
        "text",
        F.regexp_extract_all("text", F.lit(RUN), 0).alias("runs"),
        given.alias("given"),
    )
    rows = rows.withColumn("given", F.filter("given", lambda g: ~F.array_contains("runs", g["candidate"]) | ~g["candidate"].rlike("[0-9]")))
    rows = rows.where(F.exists("runs", lambda run: run.rlike("[0-9]")) | (F.size("given") > 0))
    rows = rows.withColumn("between", F.split("text", RUN, -1))  # one more than runs; all of a place's context is in five parts

    def near(i: Column) -> Column:
        part = lambda name, j: F.coalesce(F.get(F.col(name), j), F.lit(""))
        left = F.concat(part("runs", i - 2), part("between", i - 1), part("runs", i - 1), part("between", i))
        right = F.concat(part("between", i + 1), part("runs", i + 1))
        return F.struct(
            F.get(F.col("runs"), i).alias("candidate"),
            F.regexp_extract(F.right(left, F.lit(BEFORE)), r"((?:[^\s\"'=:]{1,24}[\s\"'=:]{1,4}){0,2})$", 1).alias("before"),
            F.regexp_extract(F.left(right, F.lit(BEHIND)), r"^[\s\"',;.]{0,3}([^\s]{0,24})", 1).alias("behind"),
        )

    numbers = F.filter(F.sequence(F.lit(0), F.greatest(F.size("runs") - 1, F.lit(0))), lambda i: F.get(F.col("runs"), i).rlike("[0-9]"))
    places = F.concat(F.transform(numbers, near), F.col("given"))
    each = rows.select("row", "key", "path", places.alias("places"))
    each = each.select("row", "key", "path", "places", F.explode(F.array_distinct("places")).alias("place"))
    return each.select(
        "row",
        "key",
        "path",
        "place.*",
        F.size(F.expr("filter(places, p -> p.candidate = place.candidate)")).alias("times"),
    )


def add_features(found: DataFrame, words: list[str]) -> DataFrame:
    text, before = F.col("candidate"), F.lower("before")
    listed = "|".join(re.escape(w) for w in sorted(words, key=lambda w: (-len(w), w))) or "(?!)"
    near = F.filter(F.split(F.concat_ws(" ", before, F.lower("behind")), r"[^\p{L}]+"), lambda w: F.length(w) > 3)
    known = F.filter(near, lambda w: w.rlike(f"^(?:{listed})$"))
    path = F.lower("path")
    return found.withColumns(
        {
            "length": F.length(text).cast("double"),
            "digits": _share(text, "0-9"),
            "capitals": _share(text, "A-Z"),
            "hexadecimal": _share(text, "0-9a-f"),
            "changes": F.regexp_count(text, F.lit(r"[0-9](?=[A-Za-z])|[A-Za-z](?=[0-9])|[a-z](?=[A-Z])|[A-Z](?=[a-z])"))
            / F.length(text),
            "entropy": _entropy(text),
            "covered": 1.0 - F.length(F.regexp_replace(F.lower(text), listed, "")) / F.length(text),
            "named": before.rlike(NAMES).cast("double"),
            "assigned": before.rlike(r"[=:][\s\"']*$").cast("double"),
            "harmless": F.concat_ws(" ", before, F.lower("behind")).rlike(HARMLESS).cast("double"),
            "neighbours_known": F.size(known) / F.greatest(F.size(near), F.lit(1)),
            "quoted": before.rlike(r"[\"']$").cast("double"),
            "test_path": path.rlike(TEST_PATH).cast("double"),
            "path_depth": (F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit("")))).cast("double"),
        }
    )


def label_findings(found: DataFrame) -> DataFrame:
    """``found`` with label 1.0 (secret), 0.0 (none) or null (to be judged by the forest)."""
    secret = F.col("candidate").rlike(ISSUED) | ((F.col("named") == 1) & (F.col("assigned") == 1) & (F.col("entropy") >= 2.5))
    number = F.col("candidate").rlike(r"^[0-9\-+/]+$")
    harmless = number | (F.col("covered") >= 0.5) | ((F.col("harmless") == 1) & (F.col("named") == 0))
    plain = (F.col("named") == 0) & (F.col("assigned") == 0) & (F.col("digits") < 0.1) & (F.col("entropy") < 3.5)
    return found.withColumn("label", F.when(secret, 1.0).when(harmless | plain, 0.0))


def train_forest(labelled: DataFrame, most: int = TRAIN):
    """A forest from at most ``most`` findings of each label, or None if a label is missing."""
    drawn = labelled.where(F.col("label").isNotNull()).withColumn("draw", F.xxhash64("candidate", "before", "key"))
    drawn = drawn.withColumn("salt", F.pmod("draw", F.lit(SALTS)))
    order = Window.partitionBy("label", "salt").orderBy("draw", "candidate")
    small = drawn.withColumn("place", F.row_number().over(order)).where(F.col("place") <= -(-most // SALTS))
    small = stage(small.select("label", "draw", "candidate", *FEATURES), "labelled")
    if small.select("label").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(small.coalesce(1).sort("draw", "candidate"))
    return RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def scan_secrets(
    docs: DataFrame, key: str = "doc_id", path: str = "source", least: float = LEAST, labelled: DataFrame | None = None
) -> DataFrame:
    """key, candidate, times, label, score and is_secret of every candidate.

    ``labelled``: reviewed findings with key, path, candidate, before, behind and label, in place of the rules'.
    """
    words = frequent_words(docs)
    found = stage(label_findings(add_features(find_candidates(docs, key, path), words)), "candidates")
    forest = train_forest(add_features(labelled, words) if labelled is not None else found)
    if forest is None:
        scored = found.withColumn("score", F.lit(1.0))
    else:
        rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
        scored = forest.transform(rows).withColumn("score", vector_to_array("probability")[1])
    label = F.when(F.max("label") == 1.0, 1.0).when(F.count("label") == F.count(F.lit(1)), 0.0)
    firsts = [F.first(c).alias(c) for c in ("key", "times")]
    best = scored.groupBy("row", "candidate").agg(*firsts, label.alias("label"), F.max("score").alias("score"))
    return best.select("key", "candidate", "times", "label", "score", (F.col("score") >= least).alias("is_secret"))


@query("op6_secrets")
def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("long"))
    return scan_secrets(docs).select(
        F.col("key").alias("doc_id"),
        F.sha2("candidate", 256).alias("candidate_sha256"),  # the result must not publish what it finds
        F.length("candidate").alias("length"),
        "times",
        F.round("score", 6).alias("score"),
        "is_secret",
    )
