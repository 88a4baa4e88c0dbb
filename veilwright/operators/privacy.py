"""k-anonymity, l-diversity, t-closeness and delta-presence: checks and enforcement.

All four read one table of counts per (quasi-identifiers, attribute, value).
Every step is a grouping with map-side combination or an equi-join left to the
planner, so a group holding a third of the rows is spread by its values and
never gathered in one task. Rows with a null quasi-identifier belong to no
group, unless ``null_as_group``.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..functions.columns import as_number, data_type, is_numeric, melt, ref
from ..functions.numbers import bin_edge, fixed_point_1, right_closed_bin, right_closed_guess, tenths
from ..functions.text import as_text, group_token
from ..session import stage
from .frequency import look_up
from .ranges import ColumnRange, column_ranges
from .spread import spread_join

OTHER = "Other"  # fixed value: the label rare values are merged under


def _keys(quasi: Sequence[str]) -> list[str]:
    return [f"qi_{i}" for i in range(len(quasi))]


def _grouped_rows(df: DataFrame, quasi: Sequence[str], extra: Sequence[Column] = (), null_as_group: bool = False):
    keyed = df.select(*[ref(c).alias(k) for c, k in zip(quasi, _keys(quasi))], *extra)
    if null_as_group:
        return keyed
    return keyed.dropna(subset=_keys(quasi))


def _named(df: DataFrame, quasi: Sequence[str]) -> DataFrame:
    return df.withColumnsRenamed(dict(zip(_keys(quasi), quasi)))


def group_sizes(df: DataFrame, quasi: Sequence[str], null_as_group: bool = False) -> DataFrame:
    """One row per equivalence class: the quasi-identifiers and its size."""
    rows = _grouped_rows(df, quasi, null_as_group=null_as_group)
    return _named(rows.groupBy(*_keys(quasi)).agg(F.count(F.lit(1)).alias("group_size")), quasi)


def _one_row(df: DataFrame, **values: Column) -> DataFrame:
    return df.sparkSession.range(1).select(*[v.alias(k) for k, v in values.items()])


def k_anonymity(df: DataFrame, quasi: Sequence[str], k: int, null_as_group: bool = False) -> DataFrame:
    """(satisfied, min_group_size). Without quasi-identifiers: (true, 1)."""
    if not quasi:
        return _one_row(df, satisfied=F.lit(True), min_group_size=F.lit(1).cast("bigint"))
    smallest = group_sizes(df, quasi, null_as_group).agg(F.min("group_size").alias("min_group_size"))
    return smallest.select(F.coalesce(F.col("min_group_size") >= k, F.lit(False)).alias("satisfied"), "min_group_size")


def delta_presence(df: DataFrame, quasi: Sequence[str], delta: float, population: int, null_as_group: bool = False) -> DataFrame:
    """(satisfied, max_probability): largest class over the population size."""
    if not quasi:
        return _one_row(df, satisfied=F.lit(True), max_probability=F.lit(0.0))
    largest = group_sizes(df, quasi, null_as_group).agg(F.max("group_size").alias("largest"))
    share = F.col("largest") / F.lit(float(population)) if population > 0 else F.lit(0.0)
    return largest.select(
        F.coalesce(share <= delta, F.lit(False)).alias("satisfied"), share.alias("max_probability")
    )


def sensitive_counts(df: DataFrame, quasi: Sequence[str], sensitive: Sequence[str], null_as_group: bool = False) -> DataFrame:
    """Counts per (class, attribute, value); a null value keeps its class visible."""
    values = [group_token(as_text(df, s)).alias(f"s_{i}") for i, s in enumerate(sensitive)]
    rows = _grouped_rows(df, quasi, values, null_as_group)
    long = melt(
        rows,
        {s: F.col(f"s_{i}") for i, s in enumerate(sensitive)},
        [F.col(k) for k in _keys(quasi)],
        variable="attribute",
    )
    return long.groupBy(*_keys(quasi), "attribute", "value").agg(F.count(F.lit(1)).alias("cnt"))


def group_diversity(df: DataFrame, quasi: Sequence[str], sensitive: Sequence[str], null_as_group: bool = False) -> DataFrame:
    """Distinct non-null values per (class, attribute)."""
    counts = sensitive_counts(df, quasi, sensitive, null_as_group)
    return _named(
        counts.groupBy(*_keys(quasi), "attribute").agg(F.count("value").alias("diversity")), quasi
    )


def l_diversity(df: DataFrame, quasi: Sequence[str], sensitive: Sequence[str], l: int, null_as_group: bool = False) -> DataFrame:
    """(satisfied, min_diversity) over classes and attributes; infinite without either."""
    if not quasi or not sensitive:
        return _one_row(df, satisfied=F.lit(True), min_diversity=F.lit(math.inf))
    least = group_diversity(df, quasi, sensitive, null_as_group).agg(
        F.coalesce(F.min("diversity").cast("double"), F.lit(math.inf)).alias("min_diversity")
    )
    return least.select((F.col("min_diversity") >= l).alias("satisfied"), "min_diversity")


def group_distance(df: DataFrame, quasi: Sequence[str], sensitive: Sequence[str], null_as_group: bool = False) -> DataFrame:
    """Total variation distance of each (class, attribute) from the whole table.

    Only values present in a class are visited: absent ones contribute their
    overall share, and all shares sum to 1, so
    distance = (1 + sum over present v of (|p_class - p| - p)) / 2.

    The table is read once, into counts per (class, attribute, value), from which
    class totals and overall shares are added up. A class with many values, and a
    value in many classes, are spread over tasks when they look for theirs.
    """
    keys = _keys(quasi)
    # With all classes, since rows that are in none count for the overall shares.
    every = stage(sensitive_counts(df, quasi, sensitive, null_as_group=True), "counts")
    counts = every if null_as_group else every.dropna(subset=keys)
    rows = every.count()
    values = every.where(F.col("value").isNotNull()).groupBy("attribute", "value").agg(
        F.sum("cnt").alias("total"), F.count(F.lit(1)).alias("rows")
    )
    sums = values.groupBy("attribute").agg(F.sum("total").alias("all_rows"))  # one row per attribute
    shares = values.join(F.broadcast(sums), "attribute").select(
        "attribute", "value", (F.col("total") / F.col("all_rows")).alias("share")
    )
    classes = counts.groupBy(*keys, "attribute").agg(
        F.sum(F.when(F.col("value").isNotNull(), F.col("cnt"))).alias("class_total"), F.count(F.lit(1)).alias("rows")
    )
    of_class = spread_join(counts, classes.drop("rows"), [*keys, "attribute"], classes, rows)
    told = spread_join(of_class, shares, ["attribute", "value"], values, rows, "left")
    here = F.col("cnt") / F.col("class_total")
    term = F.abs(here - F.col("share")) - F.col("share")
    return _named(
        told.groupBy(*keys, "attribute")
        .agg(F.sum(F.coalesce(term, F.lit(0.0))).alias("change"))
        .join(F.broadcast(sums.select("attribute")), "attribute")  # for attributes without values no distance is defined
        .select(*keys, "attribute", ((F.lit(1.0) + F.col("change")) / 2).alias("distance")),
        quasi,
    )


def t_closeness(df: DataFrame, quasi: Sequence[str], sensitive: Sequence[str], t: float, null_as_group: bool = False) -> DataFrame:
    """(satisfied, max_distance) over classes and attributes."""
    if not quasi or not sensitive:
        return _one_row(df, satisfied=F.lit(True), max_distance=F.lit(0.0))
    worst = group_distance(df, quasi, sensitive, null_as_group).agg(
        F.coalesce(F.max("distance"), F.lit(0.0)).alias("max_distance")
    )
    return worst.select((F.col("max_distance") <= t).alias("satisfied"), "max_distance")


def l_violations(df: DataFrame, quasi: Sequence[str], sensitive: Sequence[str], l: int) -> DataFrame:
    """The (class, attribute) pairs with too few distinct values."""
    return group_diversity(df, quasi, sensitive).where(F.col("diversity") < l)


def t_violations(df: DataFrame, quasi: Sequence[str], sensitive: Sequence[str], t: float) -> DataFrame:
    """The (class, attribute) pairs too far from the whole table."""
    return group_distance(df, quasi, sensitive).where(F.col("distance") > t)


def suppress_groups(df: DataFrame, violating: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """Drop the rows of the violating classes: an opt-in stronger than the default report."""
    bad = violating.select(*[ref(c).alias(k) for c, k in zip(quasi, _keys(quasi))]).distinct()
    match = None
    for c, k in zip(quasi, _keys(quasi)):
        test = df[f"`{c}`"].eqNullSafe(bad[k])
        match = test if match is None else match & test
    return df.join(bad, match, "left_anti")


def privacy_status(
    df: DataFrame,
    quasi: Sequence[str],
    sensitive: Sequence[str],
    k: int = 5,
    l: int = 2,
    t: float = 0.2,
    delta: float = 0.01,
    population: int = 10000,
) -> DataFrame:
    """One row per model: (model, threshold, satisfied, value)."""

    def row(model: str, threshold: float, check: DataFrame) -> DataFrame:
        measured = [c for c in check.columns if c != "satisfied"][0]
        return check.select(
            F.lit(model).alias("model"),
            F.lit(float(threshold)).alias("threshold"),
            "satisfied",
            F.col(measured).cast("double").alias("value"),
        )

    return (
        row("k-anonymity", k, k_anonymity(df, quasi, k))
        .unionByName(row("l-diversity", l, l_diversity(df, quasi, sensitive, l)))
        .unionByName(row("t-closeness", t, t_closeness(df, quasi, sensitive, t)))
        .unionByName(row("delta-presence", delta, delta_presence(df, quasi, delta, population)))
    )


# --- enforcement -----------------------------------------------------------

LABEL_TABLE = 256  # up to this many bins the labels are literals


def value_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, ColumnRange]:
    return column_ranges(df, {c: as_number(df, c) for c in columns})


def with_interval_labels(df: DataFrame, bins: Mapping[str, tuple[ColumnRange, int]]) -> DataFrame:
    """Replace values by the ``"lo-hi"`` label of their right-closed equal-width bin.

    One decimal per edge. Bins narrower than a tenth can share a label; equal
    labels simply merge. Built in steps, so that each step reads the one before
    as a column instead of repeating its expression.
    """
    original = df.columns
    value = {c: as_number(df, c) for c in bins}
    span = {c: (r.low, r.high, n) for c, (r, n) in bins.items()}
    slot = {c: i for i, c in enumerate(bins)}
    guess = {c: F.col(f"bin_guess_{slot[c]}") for c in bins}
    index = {c: F.col(f"bin_index_{slot[c]}") for c in bins}
    df = df.withColumns({f"bin_guess_{slot[c]}": right_closed_guess(value[c], *span[c]) for c in bins})
    df = df.withColumns({f"bin_index_{slot[c]}": right_closed_bin(value[c], guess[c], *span[c]) for c in bins})
    labels: dict[str, Column] = {}
    edges: dict[str, Column] = {}
    in_tenths: dict[str, Column] = {}
    for c, (low, high, n) in span.items():
        if n <= LABEL_TABLE:
            step = (high - low) / n
            cuts = [low + i * step for i in range(n)] + [high]
            names = F.array(*[F.lit(f"{a:.1f}-{b:.1f}") for a, b in zip(cuts, cuts[1:])])
            labels[c] = F.element_at(names, index[c].cast("int"))
        else:
            ends = []
            for end, i in (("lower", index[c] - 1), ("upper", index[c])):
                edge, whole = f"bin_{end}_{slot[c]}", f"bin_{end}_tenths_{slot[c]}"
                edges[edge] = bin_edge(i, low, high, n)
                in_tenths[whole] = tenths(F.col(edge))
                ends.append(fixed_point_1(F.col(edge), F.col(whole)))
            labels[c] = F.concat(ends[0], F.lit("-"), ends[1])
        labels[c] = F.when(index[c].isNotNull(), labels[c])
    for step_columns in (edges, in_tenths, labels):
        df = df.withColumns(step_columns) if step_columns else df
    return df.select(*[ref(c) for c in original])


def enforce_k_numeric(df: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """Equal-width bins sized for about 2k values each; constants stay as they are."""
    ranges = value_ranges(df, columns)
    bins = {c: (r, max(2, r.count // (2 * k))) for c in columns if (r := ranges[c]).varies}
    return with_interval_labels(df, bins) if bins else df


KEPT_IN_MEMORY = 10_000
HEAVY_SHARE = 1000


def enforce_k_categorical(df: DataFrame, columns: Sequence[str], k: int, kept_in_memory: int = KEPT_IN_MEMORY) -> DataFrame:
    """Values seen fewer than k times become 'Other', if there are more than 2k values.

    All columns are counted in one grouping of the table as it comes; each column
    then costs one lookup. Texts over 64 bytes are counted by their digest.
    """
    if not columns:
        return df
    tokens = {c: group_token(as_text(df, c)) for c in columns}
    counts = melt(df, tokens).where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("cnt"))
    counts = stage(counts, "categories")
    many = F.col("cnt") >= k
    sizes = counts.groupBy("column_name").agg(
        F.count(F.lit(1)).alias("values"), F.count_if(many).alias("kept"), F.sum("cnt").alias("n")
    )
    for size in sorted(sizes.collect(), key=lambda r: columns.index(r["column_name"])):
        name = size["column_name"]
        if size["values"] > 2 * k and size["kept"] < size["values"]:
            df = _merge_rare(df, name, tokens[name], counts.where(F.col("column_name") == name), size, k, kept_in_memory)
    return df


def _merge_rare(df: DataFrame, name: str, token: Column, counts: DataFrame, size: Row, k: int, kept_in_memory: int) -> DataFrame:
    text = as_text(df, name)
    kept = counts.where(F.col("cnt") >= k).select("value")
    if size["kept"] == 0:
        return df.withColumn(name, F.when(text.isNotNull(), F.lit(OTHER)))
    if size["kept"] <= kept_in_memory:  # tokens of 64 bytes at most
        known = F.broadcast(kept.toDF("kept_value"))
        found = df.join(known, token == F.col("kept_value"), "left").withColumn("kept_row", F.col("kept_value").isNotNull())
        found = found.drop("kept_value")
        stays = F.col("kept_row")
    else:
        # At most HEAVY_SHARE values can hold that share of the rows each. Their rows
        # and the nulls need no lookup, so no hot key reaches the shuffled join.
        heavy = [r["value"] for r in counts.where(F.col("cnt") > max(k, size["n"] // HEAVY_SHARE)).collect()]
        direct = token.isin(heavy) if heavy else F.lit(False)
        found = look_up(df, token, kept, text.isNull() | direct, "kept_row")
        stays = F.col("kept_row") | direct
    return found.withColumn(name, F.when(text.isNull() | stays, text).otherwise(F.lit(OTHER))).drop("kept_row")


def enforce_k_anonymity(df: DataFrame, quasi: Sequence[str], k: int) -> DataFrame:
    """Numeric quasi-identifiers are binned, the others lose their rare values."""
    numeric = [c for c in quasi if c in df.columns and is_numeric(data_type(df, c))]
    other = [c for c in quasi if c in df.columns and c not in numeric]
    return enforce_k_categorical(enforce_k_numeric(df, numeric, k), other, k)
