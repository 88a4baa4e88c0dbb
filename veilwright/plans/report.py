"""The quality report as tables, JSON and text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ..operators import quality as q


@dataclass
class QualityReport:
    """All metrics of one original/anonymized pair, each computed once."""

    comparison: q.Comparison

    @cached_property
    def metrics(self) -> DataFrame:
        return q.all_metrics(self.comparison)

    def summary(self) -> DataFrame:
        """One row: metrics, scores, assessment and dashboard verdict."""
        return q.quality_verdict(q.quality_scores(self.metrics))

    def scalar_metrics(self) -> dict[str, float]:
        """What may be embedded in a watermark: no row-level values."""
        return self.summary().first().asDict()

    def text(self) -> DataFrame:
        """Readable report lines in order."""
        row = self.summary().first().asDict()
        lines = ["Anonymization quality report", ""]
        lines += [
            f"Top {r['component']} components: {r['original_percent']:.1f}% -> {r['anonymized_percent']:.1f}% "
            f"(retained {r['retention_percent']:.1f}%)"
            for r in q.variance_retention(self.comparison).orderBy("component").collect()
        ]
        lines += [f"{name}: {value:.3f}" if isinstance(value, float) else f"{name}: {value}" for name, value in row.items()]
        spark = self.comparison.spark
        return spark.createDataFrame(list(enumerate(lines)), "line_number int, value string")

    def write(self, path: str) -> None:
        """``<path>/metrics`` (JSON), ``<path>/columns`` (JSON per column), ``<path>/text``."""
        self.summary().coalesce(1).write.json(f"{path}/metrics")
        q.nmse_by_column(self.comparison).coalesce(1).write.json(f"{path}/columns")
        self.text().coalesce(1).orderBy("line_number").select("value").write.text(f"{path}/text")


def quality_report(original: DataFrame, anonymized: DataFrame, row_key: str, **options) -> QualityReport:
    return QualityReport(q.Comparison(original, anonymized, row_key, **options))


def align_by_position(original: DataFrame, anonymized: DataFrame, row_key: str = "row_number", scan_order: bool = False):
    """Both tables with a row number in file order, for pairs without a common key; see ``with_file_position``."""
    from ..operators.ordered import with_file_position

    return with_file_position(original, row_key, scan_order), with_file_position(anonymized, row_key, scan_order)
