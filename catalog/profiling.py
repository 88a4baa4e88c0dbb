"""Column profiles and classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwright.functions import names as nm
from veilwright.functions import text as tx
from veilwright.functions.columns import melt, numeric_columns
from veilwright.operators import classify as cl
from veilwright.operators.association import profile_association
from veilwright.operators.batch import batch_classify, batch_profile, directory_profile
from veilwright.operators.compression import profile_compression
from veilwright.operators.frequency import profile_frequency
from veilwright.operators.ordered import profile_monotonic
from veilwright.operators.overview import column_info, dataset_overview, preview
from veilwright.operators.quality import fill_median
from veilwright.operators.shape import profile_shape
from veilwright.operators.strings import profile_strings, string_features
from veilwright.session import scratch_path
from veilwright.sources.tables import scan_directory

from .registry import long_sql, query, r, rounded, table

CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
SUPPLIER = ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
PART = ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
LINEITEM_NUMERIC = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]
LINEITEM = [*LINEITEM_NUMERIC, "l_returnflag", "l_linestatus", "l_shipdate"]
DOCUMENTS = ["doc_id", "text", "lang", "source", "n_chars"]


# --- frequency -----------------------------------------------------------------


def frequency_cte(long: str, keys: str = "column_name") -> str:
    """CTEs up to ``freq``: one row of frequency features per key."""
    return f"""
    long AS ({long}),
    vc AS (SELECT {keys}, v, count(*) AS c FROM long WHERE v IS NOT NULL GROUP BY {keys}, v),
    vt AS (SELECT *, sum(c) OVER (PARTITION BY {keys}) AS n,
                  row_number() OVER (PARTITION BY {keys} ORDER BY c DESC, v) AS place FROM vc),
    freq AS (
      SELECT {keys}, CAST(max(n) AS BIGINT) AS non_null, count(*) AS distinct_count,
             count(*)::DOUBLE / max(n) AS distinct_ratio, max(c)::DOUBLE / max(n) AS top1_freq,
             CASE WHEN count(*) < 5 THEN 1 ELSE sum(c) FILTER (WHERE place <= 5)::DOUBLE / max(n) END AS top5_freq,
             -sum(c::DOUBLE / n * log2(c::DOUBLE / n + 1e-10)) AS entropy,
             CASE WHEN count(*) > 1 THEN -sum(c::DOUBLE / n * log2(c::DOUBLE / n + 1e-10)) / log2(count(*))
                  ELSE 0 END AS norm_entropy,
             1 - sum((c::DOUBLE / n) * (c::DOUBLE / n)) AS gini,
             stddev_pop(c::DOUBLE / n) AS frequency_spread
      FROM vt GROUP BY {keys})"""


FREQUENCY_OUT = ", ".join(
    f"{r(c)} AS {c}" for c in ("distinct_ratio", "top1_freq", "top5_freq", "entropy", "norm_entropy", "gini")
)


def frequency_sql(name: str, columns: list[str], numeric: list[str]) -> str:
    listed = ", ".join(f"'{c}'" for c in numeric)
    return (
        f"WITH {frequency_cte(long_sql(name, columns))} SELECT column_name, non_null, distinct_count, "
        f"{FREQUENCY_OUT}, column_name IN ({listed}) AS is_numeric FROM freq"
    )


def _frequency(spark, sf_dir, name):
    return rounded(profile_frequency(table(spark, sf_dir, name)).drop("column_position", "frequency_spread"))


@query("profile_frequency", frequency_sql("lineitem", LINEITEM, LINEITEM_NUMERIC))
def _(spark, sf_dir):
    return _frequency(spark, sf_dir, "lineitem")


@query("profile_frequency_documents", frequency_sql("documents", DOCUMENTS, ["doc_id", "n_chars"]))
def _(spark, sf_dir):
    return _frequency(spark, sf_dir, "documents")


# --- shape -----------------------------------------------------------------------


def shape_sql(name: str, columns: list[str]) -> str:
    return f"""
    WITH long AS ({long_sql(name, columns, 'DOUBLE')}),
    stats AS (SELECT column_name, avg(v) AS m, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3
              FROM long GROUP BY column_name),
    central AS (SELECT column_name, avg((v - m) ** 2) AS m2, avg((v - m) ** 3) AS m3, avg((v - m) ** 4) AS m4,
                       avg(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END) AS o
                FROM long JOIN stats USING (column_name) GROUP BY column_name)
    SELECT column_name, {r('CASE WHEN m2 > 0 THEN m3 / m2 ** 1.5 ELSE 0 END')} AS skewness,
           {r('CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END')} AS kurtosis, {r('o')} AS outlier_ratio
    FROM central"""


@query("profile_shape", shape_sql("lineitem", LINEITEM_NUMERIC))
def _(spark, sf_dir):
    return rounded(profile_shape(table(spark, sf_dir, "lineitem"), LINEITEM_NUMERIC).drop("column_position"))


@query("profile_shape_refined", shape_sql("events", ["event_id", "user_id", "value"]))
def _(spark, sf_dir):
    """The quantile search meant for columns too large for one task."""
    events = table(spark, sf_dir, "events")
    return rounded(profile_shape(events, numeric_columns(events), small_rows=0).drop("column_position"))


HEAVY_SQL = """SELECT *, CASE WHEN l_linenumber = 7 THEN NULL WHEN l_linenumber = 6 THEN l_extendedprice * 1e290
    WHEN l_linenumber = 5 THEN -l_extendedprice * 1e-290 ELSE l_extendedprice END AS heavy FROM lineitem"""


@query("profile_shape_infinite", shape_sql(f"(SELECT l_orderkey, CASE WHEN isfinite(e) THEN e END AS e FROM ("
    "SELECT l_orderkey, CASE WHEN l_linenumber <> 7 THEN l_extendedprice END AS e FROM lineitem))", ["e"]))
def _(spark, sf_dir):
    """Infinities are missing values, in the search for large columns as in the direct way."""
    infinite = F.when(F.col("l_orderkey") % 2 == 0, float("inf")).otherwise(float("-inf"))
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.when(F.col("l_linenumber") == 7, infinite).otherwise(F.col("l_extendedprice")).alias("e")
    )
    return rounded(profile_shape(rows, ["e"], small_rows=0).drop("column_position"))


@query("fill_median_heavy_tail", f"""WITH t AS ({HEAVY_SQL}) SELECT l_orderkey, l_linenumber,
    {r('log10(abs(coalesce(heavy, (SELECT quantile_cont(heavy, 0.5) FROM t))))')} AS size FROM t""")
def _(spark, sf_dir):
    """The exact median of values over 580 orders of magnitude, by the search for large columns."""
    price, line = F.col("l_extendedprice"), F.col("l_linenumber")
    heavy = F.when(line == 6, price * 1e290).when(line == 5, -price * 1e-290).when(line < 5, price)
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", heavy.alias("heavy"))
    filled = fill_median(rows, ["heavy"], small_rows=0)
    return rounded(filled.select("l_orderkey", "l_linenumber", F.log10(F.abs("heavy")).alias("size")))


# --- strings -----------------------------------------------------------------------

WHITESPACE = r"\s\p{Z}\x{85}"


def string_cte(long: str, keys: str = "column_name") -> str:
    def share(pattern: str) -> str:
        return f"avg(CASE WHEN regexp_matches(v, '{pattern}') THEN 1.0 ELSE 0.0 END)"

    special = r"[^a-zA-Z0-9" + WHITESPACE + "]"
    return f"""
    texts AS ({long}),
    strings AS (
      SELECT {keys}, avg(length(v)) AS avg_length, coalesce(stddev_samp(length(v)), 0) AS std_length,
             {share(r'^\p{Nd}+$')} AS numeric_ratio, {share(special)} AS special_char_ratio,
             {share(tx.EMAIL)} AS email_ratio, {share(tx.PHONE)} AS phone_ratio, {share(tx.SSN)} AS ssn_ratio,
             {share(tx.CREDIT_CARD)} AS credit_card_ratio,
             avg(len(string_split_regex(v, '[{WHITESPACE}@_]'))) AS token_count,
             {share(tx.ALPHANUMERIC)} AS pattern_ratio
      FROM texts WHERE v IS NOT NULL GROUP BY {keys})"""


STRING_NAMES = (
    "avg_length", "std_length", "numeric_ratio", "special_char_ratio", "email_ratio", "phone_ratio", "ssn_ratio",
    "credit_card_ratio", "token_count", "pattern_ratio",
)
STRING_OUT = ", ".join(f"{r(c)} AS {c}" for c in STRING_NAMES)


@query("profile_strings", f"WITH {string_cte(long_sql('documents', DOCUMENTS))} SELECT column_name, {STRING_OUT} FROM strings")
def _(spark, sf_dir):
    return rounded(profile_strings(table(spark, sf_dir, "documents")).drop("column_position"))


@query(
    "profile_strings_customer",
    f"WITH {string_cte(long_sql('customer', CUSTOMER))} SELECT column_name, {STRING_OUT} FROM strings",
)
def _(spark, sf_dir):
    return rounded(profile_strings(table(spark, sf_dir, "customer")).drop("column_position"))


TOKENS = (
    r"SELECT 'token' AS column_name, unnest(list_filter(string_split_regex(text, '[\s\p{Z}\x{85}]+'), "
    "lambda w: w <> '')) AS v FROM documents"
)


@query("profile_strings_tokens", f"WITH {string_cte(TOKENS)} SELECT column_name, {STRING_OUT} FROM strings")
def _(spark, sf_dir):
    """Every whitespace-separated token of every document as one value."""
    tokens = F.explode(F.filter(F.split("text", r"(?U)\s+"), lambda w: w != ""))
    words = table(spark, sf_dir, "documents").select(tokens.alias("token"))
    return rounded(string_features(melt(words, {"token": F.col("token")})))


# --- order-dependent ---------------------------------------------------------------

MONOTONIC_SQL = f"""
WITH long AS ({long_sql('orders', ORDERS, ids='o_orderkey AS k')}),
numbers AS (SELECT column_name, k, try_cast(v AS DOUBLE) AS x FROM long),
steps AS (SELECT column_name, x - lag(x) OVER (PARTITION BY column_name ORDER BY k) AS step FROM numbers WHERE x IS NOT NULL),
verdict AS (SELECT column_name, count(*) AS n, coalesce(min(step) >= 0 OR max(step) <= 0, false) AS steady
            FROM steps GROUP BY column_name),
totals AS (SELECT column_name, count(v) AS non_null FROM long GROUP BY column_name)
SELECT column_name, {r('CASE WHEN n >= 2 AND steady THEN n::DOUBLE / non_null ELSE 0 END')} AS monotonic_ratio
FROM totals LEFT JOIN verdict USING (column_name)
"""


@query("profile_monotonic", MONOTONIC_SQL)
def _(spark, sf_dir):
    return rounded(profile_monotonic(table(spark, sf_dir, "orders"), "o_orderkey").drop("column_position"))


@query("profile_monotonic_pruned", MONOTONIC_SQL)
def _(spark, sf_dir):
    """With the bucket test that spares large tables most of the sort."""
    found = profile_monotonic(table(spark, sf_dir, "orders"), "o_orderkey", prune_rows=0)
    return rounded(found.drop("column_position"))


@query("profile_compression")
def _(spark, sf_dir):
    return rounded(profile_compression(table(spark, sf_dir, "documents")).select("column_name", "compression_ratio"))


@query(
    "profile_compression_keyed",
    f"""WITH long AS ({long_sql('documents', DOCUMENTS, ids='doc_id')}),
    placed AS (SELECT column_name, strlen(v) + 1 AS s, floor((sum(strlen(v) + 1) OVER (PARTITION BY column_name ORDER BY doc_id
        ROWS UNBOUNDED PRECEDING) - strlen(v) - 1) / 1048576) AS chunk FROM long WHERE v IS NOT NULL)
    SELECT column_name, (sum(s) - count(DISTINCT chunk))::BIGINT AS raw_bytes, true AS packed, column_name IN ('lang', 'source') AS by_half
    FROM placed GROUP BY column_name""",
)
def _(spark, sf_dir):
    """Chunks by row key: gzip has no SQL form, but the bytes it gets have one, and its ratio has bounds."""
    ratio = F.col("compression_ratio")
    found = profile_compression(table(spark, sf_dir, "documents"), row_key="doc_id")
    return found.select("column_name", "raw_bytes", ((ratio > 0) & (ratio < 1)).alias("packed"), (F.col("column_name").isin("lang", "source") & (ratio < 0.5)).alias("by_half"))


# --- association -------------------------------------------------------------------


def pair_corr_cte(name: str, columns: list[str], alias: str = "pairs") -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, corr({a}::DOUBLE, {b}::DOUBLE) AS r FROM {name}"
        for a in columns
        for b in columns
        if a != b
    )
    return f"{alias} AS ({rows})"


def association_cte(name: str, columns: list[str], numeric: list[str]) -> str:
    listed = ", ".join(f"'{c}'" for c in numeric)
    return f"""{pair_corr_cte(name, numeric)},
    linear AS (SELECT column_a AS column_name, avg(abs(r)) AS score FROM pairs WHERE NOT isnan(r) GROUP BY column_a),
    assoc AS (SELECT column_name, CASE WHEN non_null < 2 THEN 0 WHEN column_name IN ({listed}) THEN coalesce(score, 0)
                     ELSE frequency_spread END AS association
              FROM freq LEFT JOIN linear USING (column_name))"""


@query(
    "association",
    f"WITH {frequency_cte(long_sql('lineitem', LINEITEM))}, {association_cte('lineitem', LINEITEM, LINEITEM_NUMERIC)} "
    f"SELECT column_name, {r('association')} AS association FROM assoc",
)
def _(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    return rounded(profile_association(lineitem, profile_frequency(lineitem)).drop("column_position"))


# --- classification ------------------------------------------------------------------


def keyword_sql(words: list[str]) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return (
        f"list_max(list_transform([{listed}], lambda k: CASE WHEN regexp_matches(label, '\\b' || k || '\\b') THEN 1.0::DOUBLE "
        "WHEN contains(label, k) THEN 0.7::DOUBLE ELSE 0.0::DOUBLE END))"
    )


def score_cte(name: str, columns: list[str], numeric: list[str]) -> str:
    """CTEs up to ``decided``.

    gzip has no SQL form. It enters the scores only as pattern_ratio * (1 - ratio)
    with a ratio above 0, so the tier is decided at both ends of that range and
    must come out the same.
    """
    return f"""{frequency_cte(long_sql(name, columns))}, {string_cte(long_sql(name, columns))},
    {association_cte(name, columns, numeric)},
    hints AS (SELECT *, replace(replace(lower(column_name), '_', ' '), '-', ' ') AS label FROM freq),
    feats AS (
      SELECT h.*, s.*, a.association, greatest(email_ratio, phone_ratio, ssn_ratio, credit_card_ratio) AS pii,
             {keyword_sql(nm.IDENTIFIER_KEYWORDS)} AS kid, {keyword_sql(nm.HIGH_RISK_KEYWORDS)} AS khigh,
             {keyword_sql(nm.LOW_RISK_KEYWORDS)} AS klow, {keyword_sql(nm.QUASI_KEYWORDS)} AS kquasi
      FROM hints h JOIN strings s USING (column_name) JOIN assoc a USING (column_name)),
    based AS (
      SELECT column_name, top1_freq, pattern_ratio,
        0.4 * distinct_ratio + 0.3 * norm_entropy + 0.15 * (1 - top1_freq) + 0.1 * numeric_ratio + 0.05 * pii + 0.1 * kid AS s1,
        0.3 * khigh + 0.25 * association + 0.2 * kid + 0.15 * norm_entropy + 0.1 * special_char_ratio AS s2,
        0.3 * klow + 0.25 * association + 0.2 * kquasi + 0.15 * norm_entropy + 0.1 * gini AS s3,
        0.25 * distinct_ratio + 0.15 * norm_entropy + 0.15 * (1 - top1_freq) + 0.15 * association + 0.15 * kquasi AS s4base
      FROM feats),
    ends AS (SELECT *, s4base + 0.15 * pattern_ratio * w AS s4 FROM based, (VALUES (0.0), (1.0)) AS ends(w)),
    five AS (SELECT *, 0.4 * (1 - greatest(s1, s4)) + 0.3 * (1 - greatest(s2, s3)) + 0.3 * top1_freq AS s5 FROM ends),
    tiers AS (
      SELECT *, CASE
        WHEN (s1 = greatest(s1, s2, s3, s4, s5) AND s1 >= 0.5) OR (s2 = greatest(s1, s2, s3, s4, s5) AND s2 >= 0.45)
          THEN 'Tier 1 (Highest Risk)'
        WHEN (s4 = greatest(s1, s2, s3, s4, s5) AND s4 >= 0.35) OR (s3 = greatest(s1, s2, s3, s4, s5) AND s3 >= 0.35)
          THEN 'Tier 2 (Medium/High Risk)'
        ELSE 'Tier 3 (Low Risk)' END AS tier FROM five),
    decided AS (
      SELECT column_name, any_value(s1) AS s1, any_value(s2) AS s2, any_value(s3) AS s3,
             CASE WHEN min(s4) = max(s4) THEN min(s4) END AS s4, CASE WHEN min(s5) = max(s5) THEN min(s5) END AS s5,
             CASE WHEN min(tier) = max(tier) THEN min(tier) ELSE 'depends on gzip' END AS risk_tier
      FROM tiers GROUP BY column_name)"""


@query(
    "classify_columns",
    f"WITH {score_cte('customer', CUSTOMER, ['c_custkey', 'c_nationkey', 'c_acctbal'])} "
    f"SELECT column_name, risk_tier, {r('s1')} AS identifier_score, {r('s2')} AS high_risk_sensitive_score, "
    f"{r('s3')} AS low_risk_sensitive_score, {r('s4')} AS quasi_identifier_score, {r('s5')} AS non_identifying_score FROM decided",
)
def _(spark, sf_dir):
    """Scores that gzip enters, those of a column with a pattern, are left out on both sides."""
    scores = cl.column_scores(table(spark, sf_dir, "customer"))
    packed = {"quasi_identifier_score", "non_identifying_score"}
    shown = [F.when(F.col("pattern_ratio") == 0, F.col(c)).alias(c) if c in packed else c for c in cl.SCORES]
    return rounded(scores.select("column_name", "risk_tier", *shown))


@query(
    "classify_supplier",
    f"WITH {score_cte('supplier', SUPPLIER, ['s_suppkey', 's_nationkey', 's_acctbal'])} "
    f"SELECT column_name, risk_tier, {r('s1')} AS identifier_score, {r('s2')} AS high_risk_sensitive_score, "
    f"{r('s3')} AS low_risk_sensitive_score, {r('s4')} AS quasi_identifier_score, {r('s5')} AS non_identifying_score FROM decided",
)
def _(spark, sf_dir):
    """No column of this table has a pattern, so all five scores are exact."""
    return rounded(cl.column_scores(table(spark, sf_dir, "supplier")).select("column_name", "risk_tier", *cl.SCORES))


@query(
    "classify_part",
    f"WITH {score_cte('part', PART, ['p_partkey', 'p_size', 'p_retailprice'])} "
    'SELECT column_name AS "Column Name", risk_tier AS "Risk Tier" FROM decided',
)
def _(spark, sf_dir):
    return cl.classify_columns(table(spark, sf_dir, "part"))


@query(
    "tier_distribution",
    f"WITH {score_cte('orders', ORDERS, ['o_orderkey', 'o_custkey', 'o_totalprice'])} "
    f"SELECT risk_tier, count(*) AS column_count, {r('100.0 * count(*) / sum(count(*)) OVER ()')} AS percent "
    "FROM decided GROUP BY risk_tier",
)
def _(spark, sf_dir):
    return rounded(cl.tier_distribution(cl.classify_columns(table(spark, sf_dir, "orders"))))


@query(
    "validate_classification",
    f"""WITH {score_cte('customer', CUSTOMER, ['c_custkey', 'c_nationkey', 'c_acctbal'])},
    data AS (SELECT unnest([{', '.join(f"'{c}'" for c in SUPPLIER)}]) AS column_name)
    SELECT column_name, 'missing' AS problem FROM data WHERE column_name NOT IN (SELECT column_name FROM decided)
    UNION ALL
    SELECT column_name, 'extra' AS problem FROM decided WHERE column_name NOT IN (SELECT column_name FROM data)""",
)
def _(spark, sf_dir):
    """The classification of one table held against the columns of another."""
    classification = cl.with_long_tier_name(cl.classify_columns(table(spark, sf_dir, "customer")))
    return cl.validate_classification(classification, table(spark, sf_dir, "supplier"))


# --- overview and batch ----------------------------------------------------------------


@query(
    "dataset_overview",
    "SELECT count(*) AS total_rows, 11 AS total_columns, "
    + "CAST("
    + " + ".join(f"count(*) FILTER (WHERE {c} IS NULL)" for c in LINEITEM)
    + " AS BIGINT) AS null_values FROM lineitem",
)
def _(spark, sf_dir):
    return dataset_overview(table(spark, sf_dir, "lineitem"))


@query(
    "column_info",
    " UNION ALL ".join(
        f"SELECT {i} AS column_position, '{c}' AS column_name, CASE any_value(typeof({c})) WHEN 'BIGINT' THEN 'bigint' "
        f"WHEN 'INTEGER' THEN 'int' ELSE 'string' END AS data_type, count({c}) AS non_null, count(*) - count({c}) AS nulls "
        "FROM documents LEFT JOIN labels USING (doc_id)"
        for i, c in enumerate([*DOCUMENTS, "quality", "toxic"])
    ),
)
def _(spark, sf_dir):
    """Every column of the documents with their labels."""
    return column_info(table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left"))


@query("preview", "SELECT * FROM customer ORDER BY c_custkey LIMIT 10")
def _(spark, sf_dir):
    return preview(table(spark, sf_dir, "customer"), "c_custkey", 10)


BATCH_LONG = (
    long_sql("customer", CUSTOMER, ids="'customer' AS dataset")
    + " UNION ALL "
    + long_sql("supplier", SUPPLIER, ids="'supplier' AS dataset")
)


@query(
    "batch_profile",
    f"WITH {frequency_cte(BATCH_LONG, 'dataset, column_name')}, {string_cte(BATCH_LONG, 'dataset, column_name')} "
    f"SELECT dataset, column_name, non_null, distinct_count, {FREQUENCY_OUT}, {STRING_OUT} "
    "FROM freq JOIN strings USING (dataset, column_name)",
)
def _(spark, sf_dir):
    names = ("customer", "supplier")
    profile = batch_profile({n: table(spark, sf_dir, n) for n in names})
    return rounded(profile.drop("skewness", "kurtosis", "outlier_ratio", "association", "compression_ratio"))


SEGMENT_COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal"]
SEGMENT_NUMERIC = ["c_custkey", "c_nationkey", "c_acctbal"]


def directory_sql() -> str:
    """Every family of features by segment."""
    long = long_sql("customer", SEGMENT_COLUMNS, ids="c_mktsegment AS dataset")
    numbers = long_sql("customer", SEGMENT_NUMERIC, "DOUBLE", ids="c_mktsegment AS dataset")
    keys = "dataset, column_name"
    pairs = " UNION ALL ".join(
        f"SELECT c_mktsegment AS dataset, '{a}' AS column_name, abs(corr({a}::DOUBLE, {b}::DOUBLE)) AS r FROM customer GROUP BY ALL"
        for a in SEGMENT_NUMERIC
        for b in SEGMENT_NUMERIC
        if a != b
    )
    return f"""
    WITH {frequency_cte(long, keys)}, {string_cte(long, keys)}, numbers AS ({numbers}),
    stats AS (SELECT {keys}, avg(v) AS m, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.75) AS q3 FROM numbers GROUP BY {keys}),
    central AS (SELECT {keys}, avg((v - m) ** 2) AS m2, avg((v - m) ** 3) AS m3, avg((v - m) ** 4) AS m4,
                  avg(CASE WHEN v < q1 - 1.5 * (q3 - q1) OR v > q3 + 1.5 * (q3 - q1) THEN 1.0 ELSE 0.0 END) AS o
                FROM numbers JOIN stats USING ({keys}) GROUP BY {keys}),
    linear AS (SELECT {keys}, avg(r) AS score FROM ({pairs}) WHERE NOT isnan(r) GROUP BY {keys})
    SELECT dataset, column_name, non_null, distinct_count, {FREQUENCY_OUT}, {STRING_OUT},
      {r('coalesce(CASE WHEN m2 > 0 THEN m3 / m2 ** 1.5 ELSE 0 END, 0)')} AS skewness,
      {r('coalesce(CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END, 0)')} AS kurtosis, {r('coalesce(o, 0)')} AS outlier_ratio,
      {r("CASE WHEN non_null < 2 THEN 0 WHEN column_name = 'c_name' THEN frequency_spread ELSE coalesce(score, 0) END")} AS association
    FROM freq JOIN strings USING ({keys}) LEFT JOIN central USING ({keys}) LEFT JOIN linear USING ({keys})"""


def _segments(spark, sf_dir):
    """A folder with a file or more for each segment, in one scan."""
    path = scratch_path(spark, "folder")
    table(spark, sf_dir, "customer").repartition("c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    files = scan_directory(spark, path)
    return files.withColumn("dataset", F.regexp_extract("dataset", "c_mktsegment=([^/]*)/", 1)).drop("c_mktsegment")


@query("scan_directory", directory_sql())
def _(spark, sf_dir):
    """All features of every dataset of a folder."""
    return rounded(directory_profile(_segments(spark, sf_dir)).drop("compression_ratio"))


@query("scan_directory_refined", directory_sql())
def _(spark, sf_dir):
    """The quantile search for datasets too large for one task."""
    return rounded(directory_profile(_segments(spark, sf_dir), small_rows=0).drop("compression_ratio"))


CLASSIFIED = {
    "customer": (CUSTOMER, ["c_custkey", "c_nationkey", "c_acctbal"]),
    "orders": (ORDERS, ["o_orderkey", "o_custkey", "o_totalprice"]),
    "part": (PART, ["p_partkey", "p_size", "p_retailprice"]),
    "supplier": (SUPPLIER, ["s_suppkey", "s_nationkey", "s_acctbal"]),
}


@query(
    "batch_classify",
    " UNION ALL ".join(
        f"""SELECT * FROM (WITH {score_cte(name, columns, numeric)}
        SELECT '{name}' AS dataset, column_name AS "Column Name", risk_tier AS "Risk Tier" FROM decided)"""
        for name, (columns, numeric) in CLASSIFIED.items()
    ),
)
def _(spark, sf_dir):
    """Tiers of four tables of different shapes at once."""
    return batch_classify({name: table(spark, sf_dir, name) for name in CLASSIFIED})
