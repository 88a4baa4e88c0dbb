"""From input files to a watermarked result: the whole workflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.batch import batch_classify
from ..operators.classify import classify_columns, validate_classification
from ..operators.generalize import non_negative
from ..operators.watermark import extract_dataset_info, make_watermark
from ..session import owned_scratch, stage
from ..sources.tables import dataset_name, input_files, read_csv, read_parquet, write_csv
from ..sources.watermarked import read_watermarked, refuse_marked, write_watermarked
from .anonymize import ROW_KEY, AnonymizedTable, anonymize_table
from .policy import Policy
from .report import quality_report


def read_input(spark: SparkSession, path: str, fmt: str = "csv", force: bool = False, **options) -> DataFrame:
    """Read original data; input that is already anonymized is refused."""
    if fmt == "parquet":
        refuse_marked(spark, path, force, lines=False)
        return read_parquet(spark, path)
    refuse_marked(spark, path, force)
    return read_watermarked(spark, path, **options) if force else read_csv(spark, path, **options)


def write_classification(classification: DataFrame, path: str) -> None:
    """One CSV file; a classification has a row for each column."""
    write_csv(classification.coalesce(1), path)


def anonymize_files(
    spark: SparkSession,
    path: str,
    output: str,
    policy: Policy,
    row_key: str,
    fmt: str = "csv",
    classification: DataFrame | str | None = None,
    with_report: bool = True,
    plain_output: str | None = None,
    force: bool = False,
    **options,
) -> AnonymizedTable:
    """Classify, anonymize, assess and write. Returns the anonymized table.

    ``classification`` is a table or the path of a CSV file as
    ``write_classification`` leaves it. Columns on one side only are noted in the
    result; the run goes on with the others. ``options`` go to the reader (schema,
    na_tokens, multiline).

    CSV input is parsed once and the result computed once; report, mark and outputs
    read what was staged. All of it is deleted at the end but the result, which
    ``AnonymizedTable.release`` deletes.
    """
    with owned_scratch(spark, keep=True) as kept:
        with owned_scratch(spark):
            df = read_input(spark, path, fmt, force, **options)
            if fmt == "csv":
                df = stage(df, "input")
            if isinstance(classification, str):
                classification = read_csv(spark, classification)
            tiers = classification if classification is not None else classify_columns(df)
            tiers = spark.createDataFrame(tiers.collect(), tiers.schema)  # one row per column
            notes = {
                f"Classification: {r['problem']}": ", ".join(r["names"])
                for r in validate_classification(tiers, df)
                .groupBy("problem")
                .agg(F.sort_array(F.collect_list("column_name")).alias("names"))
                .collect()
            }
            result = anonymize_table(df, tiers, policy, row_key, keep_row_key=True)
            result.notes |= notes
            result.df = stage(result.df, "result", kept)
            published = non_negative(result.df.drop(ROW_KEY))
            quality = {}
            if with_report:
                original = df.withColumn(ROW_KEY, df[row_key])
                report = quality_report(original, result.df, ROW_KEY)
                report.write(f"{output.rstrip('/')}_report")
                quality = report.scalar_metrics()
            mark = make_watermark(policy.watermark_params(), quality, extract_dataset_info(df))
            write_watermarked(published, output, mark)
            if plain_output:
                write_csv(published, plain_output)
    result.scratch = kept
    return result


def anonymize_folder(
    spark: SparkSession, path: str, output: str, policy: Policy, row_key: str, fmt: str = "csv", **options
) -> DataFrame:
    """A run for each file of a folder: (dataset, output, k_met, utility_score, privacy_score).

    The files are classified together, in passes over all of them; then each is
    anonymized, assessed and written to its own folder below ``output``.
    """
    refuse_marked(spark, path, lines=fmt == "csv")
    with owned_scratch(spark):
        names = [r["file"] for r in input_files(spark, path).orderBy("file").toLocalIterator()]
        datasets = {dataset_name(path, f): f for f in names}
        tables = {d: stage(read_input(spark, f, fmt, **options), "input") for d, f in datasets.items()}
        classified = stage(batch_classify(tables), "tiers")
        done = []
        for dataset, df in tables.items():
            tiers = classified.where(F.col("dataset") == dataset).drop("dataset")
            own = f"{output.rstrip('/')}/{dataset.rsplit('.', 1)[0]}"
            with owned_scratch(spark):
                result = anonymize_table(df, tiers, policy, row_key, keep_row_key=True)
                result.df = stage(result.df, "result")
                report = quality_report(df.withColumn(ROW_KEY, df[row_key]), result.df, ROW_KEY)
                quality = report.scalar_metrics()
                report.write(f"{own}_report")
                mark = make_watermark(policy.watermark_params(), quality, extract_dataset_info(df))
                write_watermarked(non_negative(result.df.drop(ROW_KEY)), own, mark)
            done.append((dataset, own, result.k_met, quality["utility_score"], quality["privacy_score"]))
    return spark.createDataFrame(done, "dataset string, output string, k_met boolean, utility_score double, privacy_score double")
