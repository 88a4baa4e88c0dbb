"""Column anonymizers, PCA reconstruction and the whole run."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwright import Policy, anonymize_table, classify_columns
from veilwright.operators import generalize as gz
from veilwright.operators.overview import before_after_sample
from veilwright.operators.pca import pca_anonymize
from veilwright.plans.anonymize import column_rules, transform_columns

from .privacy import delta_sql, distance_sql, diversity_sql, interval_sql, k_sql
from .registry import INTERVAL_LABEL, laplace_sql, query, r, redact_sql, right_bin_sql, rounded, table, uniform_sql
from .rotations import eigen_cte

SECRET = "catalog"


def noisy_sql(column: str, key: str, sensitivity: float, purpose: str | None = None) -> str:
    noise = laplace_sql(SECRET, purpose or column, key, sensitivity)
    return r(f"abs({column}::DOUBLE + {noise})")


@query("laplace_noise", f"SELECT c_custkey, {noisy_sql('c_acctbal', 'c_custkey', 1.0)} AS c_acctbal FROM customer")
def _(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(gz.laplace_noise(customer, ["c_acctbal"], "c_custkey", SECRET))


@query(
    "generalize_numeric",
    f"SELECT p_partkey, a.p_size AS p_size, b.p_retailprice AS p_retailprice FROM "
    f"({interval_sql('part', 'p_partkey', 'p_size', '5')}) a JOIN "
    f"({interval_sql('part', 'p_partkey', 'p_retailprice', '5')}) b USING (p_partkey)",
)
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    return gz.generalize_numeric(part, ["p_size", "p_retailprice"])


def top_sql(name: str, column: str, most: int = 10) -> str:
    counts = f"SELECT {column} AS v, count(*) AS c FROM {name} WHERE {column} IS NOT NULL GROUP BY {column}"
    return (
        f"CASE WHEN (SELECT count(*) FROM ({counts})) <= {most} THEN {column} WHEN {column} IN "
        f"(SELECT v FROM ({counts}) ORDER BY c DESC, v LIMIT {most - 1}) THEN {column} ELSE 'Other' END"
    )


@query(
    "generalize_categorical",
    f"SELECT p_partkey, {top_sql('part', 'p_name')} AS p_name, {top_sql('part', 'p_brand')} AS p_brand, "
    f"{top_sql('part', 'p_type')} AS p_type FROM part",
)
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type")
    return gz.generalize_categorical(part, ["p_name", "p_brand", "p_type"])


@query("generalize_categorical_ties", f"SELECT doc_id, {top_sql('documents', 'source')} AS source FROM documents")
def _(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select("doc_id", "source")
    return gz.generalize_categorical(documents, ["source"])


RARE_SQL = """
SELECT p_partkey, CASE WHEN c / n < {0} THEN 'SUPPRESSED' ELSE p_brand END AS p_brand FROM (
  SELECT p_partkey, p_brand, count(*) OVER (PARTITION BY p_brand)::DOUBLE AS c, count(p_brand) OVER () AS n FROM part)
"""


@query("suppress_rare", RARE_SQL.format(0.04))
def _(spark, sf_dir):
    return gz.suppress_rare(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", 0.04)


@query("suppress_rare_shuffled", RARE_SQL.format(0.00004))
def _(spark, sf_dir):
    """A threshold so low that the frequent values may not fit in memory."""
    return gz.suppress_rare(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_brand", 0.00004)


def cluster_sql(name: str, key: str, column: str, k: int = 5) -> str:
    return (
        f"SELECT {key}, avg(x) OVER (PARTITION BY place // {k}) AS m FROM (SELECT {key}, {column}::DOUBLE AS x, "
        f"row_number() OVER (ORDER BY {column}, {key}) - 1 AS place FROM {name} WHERE {column} IS NOT NULL)"
    )


@query(
    "microaggregate",
    f"SELECT o_orderkey, {r('m')} AS o_totalprice FROM ({cluster_sql('orders', 'o_orderkey', 'o_totalprice')})",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(gz.microaggregate(orders, ["o_totalprice"], "o_orderkey"))


@query(
    "microaggregate_file_order",
    f"""SELECT o_orderkey, {r('m')} AS o_totalprice
    FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders)
    JOIN (SELECT place // 5 AS c, avg(x) AS m FROM
           (SELECT o_totalprice AS x, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS place FROM orders)
          GROUP BY ALL) ON c = place // 5""",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return rounded(gz.microaggregate(orders, ["o_totalprice"], "o_orderkey", align="file_order"))


@query("redact_text", f"SELECT doc_id, {redact_sql('text', 0.5)} AS text FROM documents")
def _(spark, sf_dir):
    return gz.redact_text(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"])


@query("redact_conversations", f"SELECT conv_id, turn, role, {redact_sql('text', 0.9)} AS text FROM conversations")
def _(spark, sf_dir):
    return gz.redact_text(table(spark, sf_dir, "conversations"), ["text"], 0.9)


@query(
    "non_negative",
    "SELECT abs(c_custkey) AS c_custkey, c_name, abs(c_nationkey) AS c_nationkey, abs(c_acctbal) AS c_acctbal, "
    "c_mktsegment FROM customer",
)
def _(spark, sf_dir):
    return gz.non_negative(table(spark, sf_dir, "customer"))


# --- tiers ---------------------------------------------------------------------------


def _transformed(df, row_key, tier, **options):
    """Every column treated as ``tier``; the key keeps a copy to draw noise from."""
    keyed = df.withColumn("key", F.col(row_key))
    rules = column_rules(df, {c: tier for c in df.columns})
    return rounded(transform_columns(keyed, rules, Policy(secret=SECRET, **options), "key"))


@query(
    "tier1_transform",
    f"""SELECT c_custkey AS key, {noisy_sql('c_custkey', 'c_custkey', 1.0)} AS c_custkey,
    {redact_sql('c_name', 0.1)} AS c_name, {noisy_sql('c_nationkey', 'c_custkey', 1.0)} AS c_nationkey,
    {noisy_sql('c_acctbal', 'c_custkey', 1.0)} AS c_acctbal, {redact_sql('c_mktsegment', 0.2)} AS c_mktsegment
    FROM customer""",
)
def _(spark, sf_dir):
    return _transformed(table(spark, sf_dir, "customer"), "c_custkey", "Tier 1 (Highest Risk)")


@query(
    "tier2_transform",
    f"""SELECT p_partkey AS key, {r('a.m')} AS p_partkey, {top_sql('part', 'p_name')} AS p_name,
    {top_sql('part', 'p_brand')} AS p_brand, {top_sql('part', 'p_type')} AS p_type, b.p_size AS part_age,
    {r('c.m')} AS p_retailprice
    FROM part JOIN ({cluster_sql('part', 'p_partkey', 'p_partkey')}) a USING (p_partkey)
    JOIN ({cluster_sql('part', 'p_partkey', 'p_retailprice')}) c USING (p_partkey)
    JOIN ({interval_sql('part', 'p_partkey', 'p_size', '5')}) b USING (p_partkey)""",
)
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part").withColumnRenamed("p_size", "part_age")
    return _transformed(part, "p_partkey", "Tier 2 (Medium/High Risk)")


@query(
    "tier3_transform",
    f"""SELECT o_orderkey AS key, {noisy_sql('o_orderkey', 'o_orderkey', 0.1)} AS o_orderkey,
    {noisy_sql('o_custkey', 'o_orderkey', 0.1)} AS o_custkey, {redact_sql('o_orderstatus', 0.9)} AS o_orderstatus,
    {noisy_sql('o_totalprice', 'o_orderkey', 0.1)} AS o_totalprice,
    {redact_sql('CAST(o_orderdate AS VARCHAR)', 0.9)} AS o_orderdate,
    {redact_sql('o_orderpriority', 0.9)} AS o_orderpriority FROM orders""",
)
def _(spark, sf_dir):
    return _transformed(table(spark, sf_dir, "orders"), "o_orderkey", "Tier 3 (Low Risk)")


# --- PCA ---------------------------------------------------------------------------------


def pca_sql(threshold: float) -> str:
    """Two columns: the axes of a 2 x 2 correlation matrix are (1, s)/sqrt(2) and (1, -s)/sqrt(2)."""
    noise = [laplace_sql(SECRET, f"pca:{i}", "p_partkey", 2.0) for i in (0, 1)]
    return f"""
    WITH stats AS (SELECT avg(p_partkey) AS m1, stddev_pop(p_partkey) AS d1, avg(p_retailprice) AS m2,
                          stddev_pop(p_retailprice) AS d2, corr(p_partkey, p_retailprice) AS c FROM part),
    scored AS (SELECT p_partkey, m1, d1, m2, d2, CASE WHEN c < 0 THEN -1 ELSE 1 END AS s,
                      CASE WHEN (1 + abs(c)) / 2 > {threshold} THEN 0 ELSE 1 END AS second,
                      (p_partkey - m1) / d1 AS z1, (p_retailprice - m2) / d2 AS z2 FROM part, stats),
    axes AS (SELECT *, (z1 + s * z2) / sqrt(2) + {noise[0]} AS t1,
                    second * ((z1 - s * z2) / sqrt(2) + {noise[1]}) AS t2 FROM scored)
    SELECT p_partkey AS key, {r('abs(m1 + d1 * (t1 + t2) / sqrt(2))', 4)} AS p_partkey,
           {r('abs(m2 + d2 * s * (t1 - t2) / sqrt(2))', 4)} AS p_retailprice FROM axes"""


def _pca(spark, sf_dir, threshold):
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), "p_partkey", "p_retailprice")
    return rounded(
        pca_anonymize(part, ["p_partkey", "p_retailprice"], "key", SECRET, threshold=threshold), 4
    )


@query("pca_anonymize", pca_sql(0.85))
def _(spark, sf_dir):
    return _pca(spark, sf_dir, 0.85)


@query("pca_anonymize_reduced", pca_sql(0.5))
def _(spark, sf_dir):
    """A threshold that the first component alone exceeds."""
    return _pca(spark, sf_dir, 0.5)


WIDE = {
    "o_custkey": "o_custkey", "o_totalprice": "CASE WHEN o_custkey % 10 <> 3 THEN o_totalprice END",
    "o_month": "month(o_orderdate)", "o_day": "day(o_orderdate)", "o_year": "year(o_orderdate)",
}


def pca_wide_sql(threshold: float, digits: int) -> str:
    """Nulls are filled with the mean; as many components as pass the threshold together."""
    d, names = len(WIDE), list(WIDE)
    grid = f"(SELECT unnest(range({d})) AS i), (SELECT unnest(range({d})) AS j)"
    cells = f"SELECT 's' AS side, i, j, corr(z[i + 1], z[j + 1]) AS x FROM standard, {grid} GROUP BY i, j"
    noise = ", ".join(laplace_sql(SECRET, f"pca:{k}", "o_orderkey", 2.0) for k in range(d))
    outputs = ", ".join(
        r(f"abs(m[{j + 1}] + s[{j + 1}] * list_sum(list_transform(range(kept), lambda k: ax[k + 1][{j + 1}] * t[k + 1])))", digits)
        + f" AS {c}"
        for j, c in enumerate(names)
    )
    return f"""
    WITH raw AS (SELECT o_orderkey, {', '.join(f'({sql})::DOUBLE AS {c}' for c, sql in WIDE.items())} FROM orders),
    means AS (SELECT {', '.join(f'avg({c}) AS m_{c}' for c in names)} FROM raw),
    filled AS (SELECT o_orderkey, {', '.join(f'coalesce({c}, m_{c}) AS {c}' for c in names)} FROM raw, means),
    scales AS (SELECT [{', '.join(f'avg({c})' for c in names)}] AS m, [{', '.join(f'stddev_pop({c})' for c in names)}] AS s FROM filled),
    standard AS (SELECT o_orderkey, m, s, [{', '.join(f'({c} - m[{j + 1}]) / s[{j + 1}]' for j, c in enumerate(names))}] AS z FROM filled, scales),
    {eigen_cte('e', cells, d)},
    axes AS (SELECT list(axis ORDER BY component) AS ax FROM e),
    running AS (SELECT sum(value) OVER (ORDER BY component) / sum(value) OVER () AS c FROM e),
    chosen AS (SELECT least({d}, 1 + count(*) FILTER (c <= {threshold})) AS kept FROM running),
    noisy AS (SELECT *, [{noise}] AS noise FROM standard, axes, chosen),
    scored AS (SELECT *, list_transform(range(kept), lambda k: list_dot_product(ax[k + 1], z) + noise[k + 1]) AS t FROM noisy)
    SELECT o_orderkey, {outputs}, 7 AS constant FROM scored"""


@query("pca_anonymize_wide", pca_wide_sql(0.85, 4))
def _(spark, sf_dir):
    """Five numeric columns, one with nulls, and a constant that is left out: as many components as the data ask for."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", *[F.expr(sql).alias(c) for c, sql in WIDE.items()], F.lit(7).alias("constant"))
    return rounded(pca_anonymize(orders, [*WIDE, "constant"], "o_orderkey", SECRET), 4)


# --- the whole run --------------------------------------------------------------------------

TIERS = {
    "c_custkey": "Tier 3 (Low Risk)",
    "c_name": "Tier 1 (Highest Risk)",
    "c_nationkey": "Tier 2 (Medium/High Risk)",
    "c_acctbal": "Tier 1 (Highest Risk)",
    "c_mktsegment": "Tier 2 (Medium/High Risk)",
}

RUN_SQL = f"""
WITH clustered AS ({cluster_sql('customer', 'c_custkey', 'c_nationkey')}),
merged AS (SELECT customer.*, m FROM customer JOIN clustered USING (c_custkey)),
smallest AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM merged GROUP BY m, c_mktsegment)),
span AS (SELECT min(m) AS lo, max(m) AS hi, greatest(2, count(m) // 10) AS b FROM merged),
binned AS ({right_bin_sql('SELECT *, m AS x FROM merged, span, smallest')})
SELECT {noisy_sql('c_custkey', 'c_custkey', 0.1)} AS c_custkey, {redact_sql('c_name', 0.1)} AS c_name,
       CASE WHEN least >= 5 THEN CAST(m AS VARCHAR) ELSE {INTERVAL_LABEL} END AS c_nationkey,
       {noisy_sql('c_acctbal', 'c_custkey', 1.0)} AS c_acctbal, c_mktsegment
FROM binned
"""


@query("anonymize_table", RUN_SQL)
def _(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    result = anonymize_table(customer, TIERS, Policy(secret=SECRET, use_pca=False), "c_custkey")
    return rounded(result.df)


@query("anonymize_table_pca")
def _(spark, sf_dir):
    """Classified by its own profile, with PCA: the default run."""
    orders = table(spark, sf_dir, "orders")
    return anonymize_table(orders, classify_columns(orders), Policy(secret=SECRET), "o_orderkey").df


RUN_PCA_SQL = f"""
WITH clustered AS ({cluster_sql('customer', 'c_custkey', 'c_nationkey')}),
merged AS (SELECT customer.*, m, abs(c_custkey + {laplace_sql(SECRET, 'c_custkey', 'c_custkey', 0.1)}) AS ck
           FROM customer JOIN clustered USING (c_custkey)),
stats AS (SELECT avg(m) AS m1, stddev_pop(m) AS d1, avg(ck) AS m2, stddev_pop(ck) AS d2, corr(m, ck) AS c FROM merged),
scored AS (SELECT *, CASE WHEN c < 0 THEN -1 ELSE 1 END AS s, CASE WHEN (1 + abs(c)) / 2 > 0.85 THEN 0 ELSE 1 END AS second,
             (m - m1) / d1 AS z1, (ck - m2) / d2 AS z2 FROM merged, stats),
axes AS (SELECT *, (z1 + s * z2) / sqrt(2) + {laplace_sql(SECRET, 'pca:0', 'c_custkey', 2.0)} AS t1,
           second * ((z1 - s * z2) / sqrt(2) + {laplace_sql(SECRET, 'pca:1', 'c_custkey', 2.0)}) AS t2 FROM scored),
rebuilt AS (SELECT *, abs(m1 + d1 * (t1 + t2) / sqrt(2)) AS nk, abs(m2 + d2 * s * (t1 - t2) / sqrt(2)) AS pk FROM axes),
smallest AS (SELECT min(c) AS least FROM (SELECT count(*) AS c FROM rebuilt GROUP BY nk, c_mktsegment)),
span AS (SELECT min(nk) AS lo, max(nk) AS hi, greatest(2, count(nk) // 10) AS b FROM rebuilt),
binned AS ({right_bin_sql('SELECT *, nk AS x FROM rebuilt, span, smallest')})
SELECT {r('pk')} AS c_custkey, {redact_sql('c_name', 0.1)} AS c_name,
       CASE WHEN least >= 5 THEN CAST(nk AS VARCHAR) ELSE {INTERVAL_LABEL} END AS c_nationkey,
       {noisy_sql('c_acctbal', 'c_custkey', 1.0)} AS c_acctbal, c_mktsegment
FROM binned
"""


@query("anonymize_table_pca_tiers", RUN_PCA_SQL)
def _(spark, sf_dir):
    """With PCA over the Tier 2 and 3 numbers, and the classes that it breaks up brought back to k."""
    customer = table(spark, sf_dir, "customer")
    return rounded(anonymize_table(customer, TIERS, Policy(secret=SECRET), "c_custkey").df)


QUASI, SENSITIVE = ["c_nationkey", "c_mktsegment"], ["c_name", "c_acctbal"]
NOISY_BALANCE = f"abs(c_acctbal + {laplace_sql(SECRET, 'c_acctbal', 'c_custkey', 1.0)}) AS c_acctbal"
STATUS_SQL = f"""
WITH sized AS (SELECT *, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS class_size
               FROM ({RUN_SQL.replace(noisy_sql('c_acctbal', 'c_custkey', 1.0) + ' AS c_acctbal', NOISY_BALANCE)})),
kept AS (SELECT * FROM sized WHERE class_size >= 5)
SELECT 'k-anonymity' AS model, 5::DOUBLE AS threshold, satisfied, {r('min_group_size')} AS value FROM ({k_sql('kept', QUASI)})
UNION ALL
SELECT 'l-diversity', 2::DOUBLE, min(diversity) >= 2, {r('min(diversity)')} FROM ({diversity_sql('kept', QUASI, SENSITIVE)})
UNION ALL
SELECT 't-closeness', 0.2::DOUBLE, max(distance) <= 0.2, {r('max(distance)')} FROM ({distance_sql('kept', QUASI, SENSITIVE)})
UNION ALL
SELECT 'delta-presence', 0.01::DOUBLE, satisfied, {r('max_probability')} FROM ({delta_sql('kept', QUASI)})
"""


@query("anonymize_table_status", STATUS_SQL)
def _(spark, sf_dir):
    """The four models on a run that must leave no class below k."""
    customer = table(spark, sf_dir, "customer")
    policy = Policy(secret=SECRET, use_pca=False, guarantee=True)
    return rounded(anonymize_table(customer, TIERS, policy, "c_custkey").status())


TECHNIQUE_SQL = """
SELECT column_name, tier, technique FROM (VALUES
  ('c_custkey', 'Tier 3 (Low Risk)', 'Light Noise/Minimal Tokenization'),
  ('c_name', 'Tier 1 (Highest Risk)', 'Strong Tokenization/DP Noise'),
  ('c_nationkey', 'Tier 2 (Medium/High Risk)', 'Generalization/Microaggregation'),
  ('c_acctbal', 'Not classified', 'Default (Tier 3) - Not in classification'),
  ('c_mktsegment', 'Public', 'Default (Tier 3)'),
  ('PCA', '', 'Applied to 4 Tier 2/3 columns')) AS t(column_name, tier, technique)
"""


@query("techniques", TECHNIQUE_SQL)
def _(spark, sf_dir):
    """The techniques a run on the customers reports, with an unlisted column and an unknown tier."""
    tiers = {c: t for c, t in TIERS.items() if c != "c_acctbal"} | {"c_mktsegment": "Public"}
    customer = table(spark, sf_dir, "customer")
    return anonymize_table(customer, tiers, Policy(secret=SECRET), "c_custkey").techniques()


SAMPLE_COLUMNS = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]


def sample_sql() -> str:
    parts = []
    for c in SAMPLE_COLUMNS:
        after = redact_sql("p_name", 0.5) if c == "p_name" else c
        parts.append(
            f"SELECT '{c}' AS column_name, row_number() OVER (ORDER BY p_partkey) AS place, "
            f"CAST({c} AS VARCHAR) AS original, CAST({after} AS VARCHAR) AS anonymized FROM part"
        )
    return f"SELECT * FROM ({' UNION ALL '.join(parts)}) WHERE place <= 2"


@query("before_after_sample", sample_sql())
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return before_after_sample(part, gz.redact_text(part, ["p_name"], 0.5), "p_partkey")


# --- documented rules -------------------------------------------------------------------------


@query("rule_hash", "SELECT c_custkey, sha256('salt' || c_name) AS c_name FROM customer")
def _(spark, sf_dir):
    return gz.rule_hash(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", "salt")


@query(
    "rule_generalize_5",
    "SELECT p_partkey, CAST(p_size // 5 * 5 AS VARCHAR) || '-' || CAST(p_size // 5 * 5 + 4 AS VARCHAR) AS p_size FROM part",
)
def _(spark, sf_dir):
    return gz.rule_generalize_5(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size")


@query(
    "rule_noise_10pct",
    "SELECT c_custkey, "
    + r(f"c_acctbal * (1 + 0.1 * (2 * {uniform_sql(SECRET, 'c_acctbal', 'c_custkey')} - 1))")
    + " AS c_acctbal FROM customer",
)
def _(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return rounded(gz.rule_noise_10pct(customer, "c_acctbal", "c_custkey", SECRET))
