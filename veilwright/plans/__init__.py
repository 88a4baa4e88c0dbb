"""Compositions of operators: policies, the anonymization run, reports."""
