"""Spark-native table anonymization and privacy assessment."""

from .operators.classify import classify_columns, tier_distribution, validate_classification
from .operators.privacy import delta_presence, k_anonymity, l_diversity, privacy_status, t_closeness
from .plans.anonymize import AnonymizedTable, anonymize_table
from .plans.policy import Policy
from .plans.report import QualityReport, quality_report
from .plans.run import anonymize_files, anonymize_folder
from .session import build_session

__all__ = [
    "AnonymizedTable",
    "Policy",
    "QualityReport",
    "anonymize_files",
    "anonymize_folder",
    "anonymize_table",
    "build_session",
    "classify_columns",
    "delta_presence",
    "k_anonymity",
    "l_diversity",
    "privacy_status",
    "quality_report",
    "t_closeness",
    "tier_distribution",
    "validate_classification",
]
