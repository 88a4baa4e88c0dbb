"""The whole anonymization of a table, driven by its classification."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.columns import data_type, is_numeric, ref
from ..functions.text import as_text
from ..operators.classify import NAME_COLUMN, tier_column
from ..operators.generalize import (
    generalize_numeric,
    laplace_column,
    microaggregate,
    rule_generalize_5,
    rule_hash,
    rule_noise_10pct,
    top_category_columns,
    with_redacted_words,
)
from ..operators.ordered import check_row_key, with_scan_position
from ..operators.pca import PcaModel, fit_pca, reconstruct
from ..operators.privacy import enforce_k_anonymity, group_sizes, k_anonymity, privacy_status, suppress_groups
from ..session import ScratchOwner, stage
from .policy import Policy

ROW_KEY = "veilwright_row_key"

# Name fragments that choose a technique, and the parameters of each.
DIRECT_IDENTIFIER_NAMES = ("name", "email", "phone", "ssn", "id", "address", "credit", "card")
BINNED_NAMES = ("age", "salary", "income", "birth")
TIER_1_NAMED_KEEP, TIER_1_KEEP, TIER_3_KEEP = 0.1, 0.2, 0.9
TIER_1_SENSITIVITY, TIER_3_SENSITIVITY = 1.0, 0.1
BINS, CATEGORIES = 5, 10

# The technique labels a run reports.
TECHNIQUES = {
    "Tier 1": "Strong Tokenization/DP Noise",
    "Tier 2": "Generalization/Microaggregation",
    "Tier 3": "Light Noise/Minimal Tokenization",
}
DEFAULT_TECHNIQUE = "Default (Tier 3)"
UNLISTED_TECHNIQUE = "Default (Tier 3) - Not in classification"
UNCHANGED_NOTE = " - numeric identifier left unchanged"
BOOLEAN_NOTE, KEPT_NOTE = " - boolean left unchanged", " - left unchanged"
# The names of the rules that a policy may set for a column.
CUSTOM_RULES = {"hash": "Custom: salted hash", "generalize_5_years": "Custom: intervals of five", "add_noise_10percent": "Custom: noise of 10 percent"}
#: Types without a text form of their own cannot be published as anonymized.
NO_TEXT = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def _contains(name: str, fragments) -> bool:
    return any(f in name.lower() for f in fragments)


@dataclass
class ColumnRule:
    column: str
    level: str  # "Tier 1", "Tier 2" or "Tier 3"
    tier: str | None
    technique: str
    action: str  # redact, noise, bins, clusters, categories, keep
    amount: float = 0.0


def choose(df: DataFrame, name: str, level: str, strict: bool = False) -> tuple[str, float]:
    """The action for a column: decided from its name and type alone.

    Dates, timestamps and other types are read as text; booleans stay.
    """
    dtype = data_type(df, name)
    if isinstance(dtype, NO_TEXT):
        if level == "Tier 3":
            return "keep", 0.0
        raise ValueError(f"column {name!r} of type {dtype.simpleString()} is {level}: flatten or drop it first")
    numeric = is_numeric(dtype)
    text = not numeric and not isinstance(dtype, T.BooleanType)
    if level == "Tier 1":
        named = _contains(name, DIRECT_IDENTIFIER_NAMES)
        if numeric and not named:
            return "noise", TIER_1_SENSITIVITY
        if text or (strict and named and numeric):
            return "redact", TIER_1_NAMED_KEEP if named else TIER_1_KEEP
    elif level == "Tier 2":
        if numeric:
            return ("bins", BINS) if _contains(name, BINNED_NAMES) else ("clusters", 0)
        if text:
            return "categories", CATEGORIES
    elif numeric:
        return "noise", TIER_3_SENSITIVITY
    elif text:
        return "redact", TIER_3_KEEP
    return "keep", 0.0


def column_rules(
    df: DataFrame, tiers: Mapping[str, str], strict: bool = False, custom: Mapping[str, str] | None = None
) -> list[ColumnRule]:
    """``custom``: rules of CUSTOM_RULES by column, which go before the techniques of the tiers."""
    custom = custom or {}
    unknown = {f"{c}: {r}" for c, r in custom.items() if c not in df.columns or r not in CUSTOM_RULES}
    unknown |= {f"{c}: {r}, not numeric" for c, r in custom.items() if c in df.columns and r != "hash" and not is_numeric(data_type(df, c))}
    if unknown:
        raise ValueError(f"custom rules that cannot be applied: {', '.join(sorted(unknown))}")
    rules = []
    for name in df.columns:
        if name in custom:
            tier = tiers.get(name)
            level = next((t for t in TECHNIQUES if tier and t in tier), "Tier 3")
            rules.append(ColumnRule(name, level, tier, CUSTOM_RULES[custom[name]], custom[name]))
            continue
        tier = tiers.get(name)
        level = next((t for t in TECHNIQUES if tier and t in tier), None)
        if tier is None:
            technique = UNLISTED_TECHNIQUE
        else:
            technique = TECHNIQUES.get(level, DEFAULT_TECHNIQUE)
        action, amount = choose(df, name, level or "Tier 3", strict)
        if level == "Tier 1" and action == "keep" and is_numeric(data_type(df, name)):
            technique += UNCHANGED_NOTE
        elif action == "keep" and level:
            technique += BOOLEAN_NOTE if isinstance(data_type(df, name), T.BooleanType) else KEPT_NOTE
        rules.append(ColumnRule(name, level or "Tier 3", tier, technique, action, amount))
    return rules


def tier_map(classification: DataFrame | Mapping[str, str]) -> dict[str, str]:
    """Column to tier. A classification has one row per column, so it fits the driver."""
    if isinstance(classification, Mapping):
        return dict(classification)
    column = tier_column(classification)
    return {r[NAME_COLUMN]: r[column] for r in classification.select(f"`{NAME_COLUMN}`", f"`{column}`").collect()}


@dataclass
class AnonymizedTable:
    df: DataFrame
    rules: list[ColumnRule]
    policy: Policy
    quasi: list[str]
    sensitive: list[str]
    k_met: bool | None = None
    pca: PcaModel | None = None
    notes: dict[str, str] = field(default_factory=dict)
    scratch: ScratchOwner | None = None

    def release(self) -> None:
        """Delete what was staged for this table; it cannot be read afterwards."""
        if self.scratch is not None:
            self.scratch.release()

    def techniques(self) -> DataFrame:
        """(column_name, tier, technique), as many rows as columns and notes."""
        rows = [(r.column, r.tier or "Not classified", r.technique) for r in self.rules]
        rows += [(name, "", note) for name, note in self.notes.items()]
        return self.df.sparkSession.createDataFrame(rows, "column_name string, tier string, technique string")

    def status(self) -> DataFrame:
        """The four privacy models on the result.

        They read the table several times, so the columns concerned are written
        once beforehand instead of being anonymized again for every check.
        """
        p = self.policy
        checked = list(dict.fromkeys(self.quasi + self.sensitive))
        narrow = stage(self.df.select(*[ref(c) for c in checked]), "status") if checked else self.df
        return privacy_status(narrow, self.quasi, self.sensitive, p.k, p.l, p.t, p.delta, p.population)


def transform_columns(df: DataFrame, rules: list[ColumnRule], policy: Policy, row_key: str) -> DataFrame:
    """Every per-column technique. Statistics come in one job per technique."""
    texts = [r.column for r in rules if r.action == "categories" and not isinstance(data_type(df, r.column), T.StringType)]
    df = df.withColumns({c: as_text(df, c) for c in texts}) if texts else df

    def named(action: str) -> list[str]:
        return [r.column for r in rules if r.action == action]

    values: dict[str, Column] = {}
    for r in rules:
        if r.action == "noise":
            values[r.column] = laplace_column(df, r.column, row_key, policy.secret, r.amount, policy.epsilon)
    values |= top_category_columns(df, named("categories"), CATEGORIES) if named("categories") else {}
    changed = generalize_numeric(df, named("bins"), BINS) if named("bins") else df
    changed = changed.withColumns(values) if values else changed
    ratios = {r.column: r.amount for r in rules if r.action == "redact"}
    changed = with_redacted_words(changed, ratios) if ratios else changed
    for name in named("hash"):
        changed = rule_hash(changed, name, policy.secret)
    for name in named("generalize_5_years"):
        changed = rule_generalize_5(changed, name)
    for name in named("add_noise_10percent"):
        changed = rule_noise_10pct(changed, name, row_key, policy.secret)
    clusters = named("clusters")
    return microaggregate(changed, clusters, row_key, policy.k, checked=False) if clusters else changed


def anonymize_table(
    df: DataFrame,
    classification: DataFrame | Mapping[str, str],
    policy: Policy,
    row_key: str | None = None,
    keep_row_key: bool = False,
) -> AnonymizedTable:
    """Transform by tier, optionally reconstruct through PCA, then bring the classes to size k.

    Rows stay lazy: the driver sees per-column statistics and a small matrix.
    ``row_key`` must be unique and not null (else this raises); it keys the noise and is itself
    anonymized like any column. Without one, rows are numbered in scan order.
    ``keep_row_key`` keeps the unchanged key in an extra column for a quality
    report; drop it before publishing.
    """
    columns = df.columns
    rules = column_rules(df, tier_map(classification), policy.strict, policy.custom_rules)
    quasi = [r.column for r in rules if r.level == "Tier 2"]
    sensitive = [r.column for r in rules if r.level == "Tier 1"]
    if row_key is None:
        keyed = with_scan_position(df, ROW_KEY)
    else:
        check_row_key(df, row_key)
        keyed = df.withColumn(ROW_KEY, ref(row_key))
    out = transform_columns(keyed, rules, policy, ROW_KEY)
    if any(r.action == "clusters" for r in rules):
        # Sorting and joining are behind these columns; the PCA fit, the checks
        # and the result all read them again.
        out = stage(out, "transformed")
    result = AnonymizedTable(out, rules, policy, quasi, sensitive)

    modelled = quasi + [r.column for r in rules if r.level == "Tier 3"]
    modelled = [c for c in modelled if c not in policy.custom_rules]  # a rule says what a column becomes
    if policy.use_pca and len(modelled) >= 2:
        result.pca = fit_pca(out, modelled, policy.pca_threshold)
        if result.pca is not None:
            out = reconstruct(out, result.pca, ROW_KEY, policy.secret, policy.epsilon)
        result.notes["PCA"] = f"Applied to {len(modelled)} Tier 2/3 columns"

    result.k_met = k_anonymity(out, quasi, policy.k).first()["satisfied"]
    if not result.k_met:
        out = enforce_k_anonymity(out, quasi, policy.k)
        if policy.guarantee:
            # Read twice below; and the labels should be computed before the join
            # that compares them, not inside its condition.
            out = stage(out, "enforced")
            small = group_sizes(out, quasi).where(F.col("group_size") < policy.k)
            out = suppress_groups(out, small, quasi)
            result.k_met = True
    result.df = out.select(*[ref(c) for c in columns], *([ROW_KEY] if keep_row_key else []))
    return result
