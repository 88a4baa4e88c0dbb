"""Privacy model checks and enforcement."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilwright.operators import privacy as pv

from .registry import INTERVAL_LABEL, query, r, right_bin_sql, rounded, table

K, L, T, DELTA, POPULATION = 5, 2, 0.2, 0.01, 10000


def groups_sql(name: str, quasi: list[str]) -> str:
    keys = ", ".join(quasi)
    present = " AND ".join(f"{q} IS NOT NULL" for q in quasi)
    return f"SELECT {keys}, count(*) AS c FROM {name} WHERE {present} GROUP BY {keys}"


def k_sql(name: str, quasi: list[str], k: int = K) -> str:
    return f"SELECT min(c) >= {k} AS satisfied, min(c) AS min_group_size FROM ({groups_sql(name, quasi)})"


def delta_sql(name: str, quasi: list[str]) -> str:
    return (
        f"SELECT max(c) / {POPULATION}.0 <= {DELTA} AS satisfied, {r(f'max(c) / {POPULATION}.0')} AS max_probability "
        f"FROM ({groups_sql(name, quasi)})"
    )


def diversity_sql(name: str, quasi: list[str], sensitive: list[str]) -> str:
    keys = ", ".join(quasi)
    return " UNION ALL ".join(
        f"SELECT {keys}, '{s}' AS attribute, count(DISTINCT {s}) AS diversity FROM {name} GROUP BY {keys}"
        for s in sensitive
    )


def distance_sql(name: str, quasi: list[str], sensitive: list[str]) -> str:
    """Over every class and every value of the table, present in the class or not."""
    keys = ", ".join(quasi)
    parts = []
    for s in sensitive:
        parts.append(
            f"""SELECT {keys}, '{s}' AS attribute, 0.5 * sum(abs(p - coalesce(c::DOUBLE / total, 0))) AS distance
            FROM (SELECT {keys}, count({s}) AS total FROM {name} GROUP BY {keys}) classes
            CROSS JOIN (SELECT {s} AS v, count(*)::DOUBLE / sum(count(*)) OVER () AS p FROM {name}
                        WHERE {s} IS NOT NULL GROUP BY {s}) overall
            LEFT JOIN (SELECT {keys}, {s} AS v, count(*) AS c FROM {name} GROUP BY {keys}, {s}) local
            USING ({keys}, v) GROUP BY {keys}"""
        )
    return " UNION ALL ".join(parts)


CUSTOMER_QUASI = ["c_nationkey", "c_mktsegment"]
ORDER_QUASI = ["o_orderpriority", "o_orderstatus"]


@query("k_anonymity", k_sql("customer", CUSTOMER_QUASI))
def _(spark, sf_dir):
    return pv.k_anonymity(table(spark, sf_dir, "customer"), CUSTOMER_QUASI, K)


@query("k_anonymity_lineitem", k_sql("lineitem", ["l_shipdate", "l_returnflag"]))
def _(spark, sf_dir):
    return pv.k_anonymity(table(spark, sf_dir, "lineitem"), ["l_shipdate", "l_returnflag"], K)


@query("delta_presence", delta_sql("customer", CUSTOMER_QUASI))
def _(spark, sf_dir):
    return rounded(pv.delta_presence(table(spark, sf_dir, "customer"), CUSTOMER_QUASI, DELTA, POPULATION))


@query(
    "l_diversity",
    f"SELECT min(diversity) >= {L} AS satisfied, min(diversity)::DOUBLE AS min_diversity "
    f"FROM ({diversity_sql('orders', ORDER_QUASI, ['o_custkey', 'o_orderdate'])})",
)
def _(spark, sf_dir):
    return pv.l_diversity(table(spark, sf_dir, "orders"), ORDER_QUASI, ["o_custkey", "o_orderdate"], L)


@query(
    "t_closeness",
    f"SELECT max(distance) <= {T} AS satisfied, {r('max(distance)')} AS max_distance FROM "
    f"({distance_sql('customer', ['c_nationkey'], ['c_mktsegment'])})",
)
def _(spark, sf_dir):
    return rounded(pv.t_closeness(table(spark, sf_dir, "customer"), ["c_nationkey"], ["c_mktsegment"], T))


@query(
    "t_closeness_many",
    f"SELECT max(distance) <= {T} AS satisfied, {r('max(distance)')} AS max_distance FROM "
    f"({distance_sql('lineitem', ['l_returnflag', 'l_linestatus'], ['l_shipdate', 'l_quantity', 'l_discount'])})",
)
def _(spark, sf_dir):
    lineitem = table(spark, sf_dir, "lineitem")
    sensitive = ["l_shipdate", "l_quantity", "l_discount"]
    return rounded(pv.t_closeness(lineitem, ["l_returnflag", "l_linestatus"], sensitive, T))


@query(
    "l_violations",
    f"SELECT * FROM ({diversity_sql('orders', ['o_custkey'], ['o_orderpriority', 'o_orderstatus'])}) WHERE diversity < 3",
)
def _(spark, sf_dir):
    return pv.l_violations(table(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderpriority", "o_orderstatus"], 3)


@query(
    "t_violations",
    f"SELECT o_custkey, attribute, {r('distance')} AS distance FROM "
    f"({distance_sql('orders', ['o_custkey'], ['o_orderpriority', 'o_orderstatus'])}) WHERE distance > 0.5",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    return rounded(pv.t_violations(orders, ["o_custkey"], ["o_orderpriority", "o_orderstatus"], 0.5))


@query(
    "suppress_groups",
    "SELECT * FROM orders WHERE o_custkey NOT IN "
    "(SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) < 3)",
)
def _(spark, sf_dir):
    """The stronger reaction to violations: leave the violating classes out."""
    orders = table(spark, sf_dir, "orders")
    return pv.suppress_groups(orders, pv.l_violations(orders, ["o_custkey"], ["o_orderpriority"], 3), ["o_custkey"])


STATUS_SQL = f"""
SELECT 'k-anonymity' AS model, {K}::DOUBLE AS threshold, satisfied, {r('min_group_size')} AS value
FROM ({k_sql('customer', ['c_nationkey'])})
UNION ALL
SELECT 'l-diversity', {L}::DOUBLE, min(diversity) >= {L}, {r('min(diversity)')}
FROM ({diversity_sql('customer', ['c_nationkey'], ['c_mktsegment', 'c_name'])})
UNION ALL
SELECT 't-closeness', {T}::DOUBLE, max(distance) <= {T}, {r('max(distance)')}
FROM ({distance_sql('customer', ['c_nationkey'], ['c_mktsegment', 'c_name'])})
UNION ALL
SELECT 'delta-presence', {DELTA}::DOUBLE, satisfied, {r('max_probability')} FROM ({delta_sql('customer', ['c_nationkey'])})
"""


@query("privacy_status", STATUS_SQL)
def _(spark, sf_dir):
    customer = table(spark, sf_dir, "customer")
    return rounded(
        pv.privacy_status(customer, ["c_nationkey"], ["c_mktsegment", "c_name"], K, L, T, DELTA, POPULATION)
    )


# --- enforcement ---------------------------------------------------------------------


def interval_sql(name: str, key: str, column: str, bins: str) -> str:
    """Labels of right-closed equal-width bins; ``bins`` may use ``n``."""
    rows = f"""
      SELECT {key}, {column}::DOUBLE AS x, lo, hi, {bins} AS b FROM {name},
        (SELECT min({column})::DOUBLE AS lo, max({column})::DOUBLE AS hi, count({column}) AS n FROM {name})"""
    return f"SELECT {key}, {INTERVAL_LABEL} AS {column} FROM ({right_bin_sql(rows)})"


@query("enforce_k_numeric", interval_sql("orders", "o_orderkey", "o_totalprice", f"greatest(2, n // {2 * K})"))
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return pv.enforce_k_numeric(orders, ["o_totalprice"], K)


@query("enforce_k_numeric_signed", interval_sql("customer", "c_custkey", "c_acctbal", "greatest(2, n // 40)"))
def _(spark, sf_dir):
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return pv.enforce_k_numeric(customer, ["c_acctbal"], 20)


LARGE = "(SELECT o_orderkey, o_totalprice * 4e12 + o_custkey AS o_totalprice FROM orders)"


@query("enforce_k_numeric_large", interval_sql(LARGE, "o_orderkey", "o_totalprice", f"greatest(2, n // {2 * K})"))
def _(spark, sf_dir):
    """Edges beyond 64-bit integers in tenths, with more bins than literal labels."""
    large = (F.col("o_totalprice") * 4e12 + F.col("o_custkey")).alias("o_totalprice")
    return pv.enforce_k_numeric(table(spark, sf_dir, "orders").select("o_orderkey", large), ["o_totalprice"], K)


def rare_sql(k: int) -> str:
    return f"""
    SELECT p_partkey, CASE WHEN (SELECT count(DISTINCT p_name) FROM part) > {2 * k} AND c < {k} THEN 'Other'
                           ELSE p_name END AS p_name
    FROM (SELECT p_partkey, p_name, count(*) OVER (PARTITION BY p_name) AS c FROM part)"""


@query("enforce_k_categorical", rare_sql(30))
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return pv.enforce_k_categorical(part, ["p_name"], 30)


@query("enforce_k_categorical_shuffled", rare_sql(30))
def _(spark, sf_dir):
    """With the join meant for more kept values than a broadcast should hold."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return pv.enforce_k_categorical(part, ["p_name"], 30, kept_in_memory=0)
