"""From raw documents to token files: language, near copies, benchmark leaks, mixture, token ids.

Each stage takes all that the one before kept, as Parquet, and all but the last
return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilwright.llm.common import table
from veilwright.llm.decontaminate import drop_contaminated
from veilwright.llm.language import drop_unknown_language
from veilwright.llm.mixture import mix_documents
from veilwright.llm.near_copies import one_of_each_component
from veilwright.llm.token_files import token_files
from veilwright.session import stage

TOKENIZER = "byte_bpe_50k.json"


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language go."""
    return drop_unknown_language(docs)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays, by the fingerprints of op1."""
    return one_of_each_component(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight takes it."""
    return mix_documents(docs)


def tokenized(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files in the shared folder; their index is the result."""
    import public_tokenizers

    return token_files(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", known_language),
    ("near_copies", one_of_each),
    ("decontamination", without_benchmark),
    ("mixture", mixed),
    ("tokens", tokenized),
]

#: No SQL: a trained network, word fingerprints, a randomised SVD and a tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
SQL: dict[str, str] = {}
