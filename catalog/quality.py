"""Quality metrics of an anonymized table against its original.

The pair compared here is built from the orders: five numeric columns, and a
coarsened copy, both with nulls.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilwright.operators import quality as q
from veilwright.operators.association import numeric_association
from veilwright.plans.report import quality_report

from .profiling import pair_corr_cte
from .rotations import eigen_cte
from .registry import long_sql, query, r, rounded, table

KEY = "o_orderkey"
COLUMNS = ["custkey", "price", "month", "day", "year"]

ORIGINAL_SQL = """
SELECT o_orderkey, o_custkey::DOUBLE AS custkey, CASE WHEN o_custkey % 10 <> 3 THEN o_totalprice END AS price,
       month(o_orderdate)::DOUBLE AS month, day(o_orderdate)::DOUBLE AS day, year(o_orderdate)::DOUBLE AS year FROM orders"""
ANONYMIZED_SQL = """
SELECT o_orderkey, (o_custkey // 10 * 10 + 5)::DOUBLE AS custkey,
       CASE WHEN o_custkey % 7 <> 2 THEN floor(o_totalprice / 5000) * 5000 + 2500 END AS price,
       ((month(o_orderdate) - 1) // 3 * 3 + 2)::DOUBLE AS month, ((day(o_orderdate) - 1) // 10 * 10 + 5)::DOUBLE AS day,
       year(o_orderdate)::DOUBLE AS year FROM orders"""


def original(spark, sf_dir) -> DataFrame:
    date = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        KEY,
        F.col("o_custkey").cast("double").alias("custkey"),
        F.when(F.col("o_custkey") % 10 != 3, F.col("o_totalprice")).alias("price"),
        F.month(date).cast("double").alias("month"),
        F.dayofmonth(date).cast("double").alias("day"),
        F.year(date).cast("double").alias("year"),
    )


def anonymized(spark, sf_dir) -> DataFrame:
    date = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        KEY,
        (F.floor(F.col("o_custkey") / 10) * 10 + 5).cast("double").alias("custkey"),
        F.when(F.col("o_custkey") % 7 != 2, F.floor(F.col("o_totalprice") / 5000) * 5000.0 + 2500.0).alias("price"),
        (F.floor((F.month(date) - 1) / 3) * 3 + 2).cast("double").alias("month"),
        (F.floor((F.dayofmonth(date) - 1) / 10) * 10 + 5).cast("double").alias("day"),
        F.year(date).cast("double").alias("year"),
    )


def comparison(spark, sf_dir, columns=None, **options) -> q.Comparison:
    return q.Comparison(original(spark, sf_dir), anonymized(spark, sf_dir), KEY, columns, **options)


def pair_cte(columns=COLUMNS) -> str:
    """``orig`` and ``anon`` with nulls replaced by each table's own medians."""

    def filled(raw: str) -> str:
        medians = ", ".join(f"quantile_cont({c}, 0.5) AS med_{c}" for c in columns)
        values = ", ".join(f"coalesce({c}, med_{c}) AS {c}" for c in columns)
        return f"(SELECT o_orderkey, {values} FROM ({raw}), (SELECT {medians} FROM ({raw})))"

    return f"orig AS {filled(ORIGINAL_SQL)}, anon AS {filled(ANONYMIZED_SQL)}"


def error_cte(columns=COLUMNS) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, avg((o.{c} - a.{c}) ** 2) / "
        f"CASE WHEN var_samp(o.{c}) > 0 THEN var_samp(o.{c}) ELSE 1 END AS nmse, avg(o.{c}) AS mo, avg(a.{c}) AS ma, "
        f"stddev_samp(o.{c}) AS so, stddev_samp(a.{c}) AS sa, var_pop(o.{c}) AS vo, var_pop(a.{c}) AS va "
        f"FROM orig o JOIN anon a USING (o_orderkey)"
        for c in columns
    )
    return f"per_column AS ({rows})"


def ks_cte(columns=COLUMNS) -> str:
    return f"""
    pooled AS (SELECT *, 1 AS o, 0 AS a FROM ({long_sql('orig', columns, 'DOUBLE')})
             UNION ALL SELECT *, 0, 1 FROM ({long_sql('anon', columns, 'DOUBLE')})),
    counted AS (SELECT column_name, v, sum(o) AS o, sum(a) AS a FROM pooled GROUP BY column_name, v),
    cdf AS (SELECT column_name, o, a, sum(o) OVER w / sum(o) OVER (PARTITION BY column_name)
                   - sum(a) OVER w / sum(a) OVER (PARTITION BY column_name) AS gap
            FROM counted WINDOW w AS (PARTITION BY column_name ORDER BY v)),
    ks AS (SELECT column_name, max(abs(gap)) AS ks, count(*) FILTER (WHERE o > 0)::DOUBLE / sum(o) AS uo,
                  count(*) FILTER (WHERE a > 0)::DOUBLE / sum(a) AS ua FROM cdf GROUP BY column_name)"""


def preservation_sql(columns=COLUMNS) -> str:
    """0 where the correlations of either table do not vary. Each pair once: the matrices are symmetric."""
    pairs = f"{pair_corr_cte('orig', columns, 'po')}, {pair_corr_cte('anon', columns, 'pa')}"
    return (
        f"(WITH {pairs} SELECT CASE WHEN stddev_pop(po.r) > 0 AND stddev_pop(pa.r) > 0 THEN corr(po.r, pa.r) ELSE 0 END "
        "FROM po JOIN pa USING (column_a, column_b) WHERE column_a < column_b)"
    )


def stats_select(columns=COLUMNS) -> str:
    return f"""
    SELECT (SELECT corr(mo, ma) FROM per_column) AS mean_correlation,
           (SELECT corr(so, sa) FROM per_column) AS std_correlation,
           {preservation_sql(columns)} AS correlation_preservation,
           (SELECT avg(nmse) FROM per_column) AS mean_mse, (SELECT max(nmse) FROM per_column) AS max_mse,
           (SELECT avg(ks) FROM ks) AS mean_ks_statistic"""


PRIVACY_SELECT = """
    SELECT greatest(0, least(1, 1 - (SELECT avg(ua) / avg(uo) FROM ks))) AS uniqueness_reduction,
           greatest(0, least(2, (SELECT sum(va) / sum(vo) FROM per_column))) AS variance_preservation"""

STATS = ("mean_correlation", "std_correlation", "correlation_preservation", "mean_mse", "max_mse", "mean_ks_statistic")
PRIVACY = ("uniqueness_reduction", "variance_preservation")


def out(names) -> str:
    return ", ".join(f"{r(n)} AS {n}" for n in names)


@query("quality_stats", f"WITH {pair_cte()}, {error_cte()}, {ks_cte()} SELECT {out(STATS)} FROM ({stats_select()})")
def _(spark, sf_dir):
    return rounded(q.quality_stats(comparison(spark, sf_dir)))


@query("privacy_metrics", f"WITH {pair_cte()}, {error_cte()}, {ks_cte()} SELECT {out(PRIVACY)} FROM ({PRIVACY_SELECT})")
def _(spark, sf_dir):
    return rounded(q.privacy_metrics(comparison(spark, sf_dir)))


@query("ks_statistic", f"WITH {pair_cte()}, {ks_cte()} SELECT column_name, {r('ks')} AS ks_statistic FROM ks")
def _(spark, sf_dir):
    pair = comparison(spark, sf_dir)
    return rounded(q.ks_statistic(pair.original, pair.anonymized, COLUMNS))


LINES = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
]


@query(
    "ks_statistic_lineitem",
    f"""WITH orig AS (SELECT {', '.join(LINES)} FROM lineitem WHERE l_returnflag = 'A'),
    anon AS (SELECT {', '.join(LINES)} FROM lineitem WHERE l_returnflag <> 'A'),
    {ks_cte(LINES)} SELECT column_name, {r('ks')} AS ks_statistic FROM ks""",
)
def _(spark, sf_dir):
    """Two parts of one table, returned and other lines, in all numeric columns."""
    lines = table(spark, sf_dir, "lineitem")
    returned, other = (lines.where(c).select(*LINES) for c in ("l_returnflag = 'A'", "l_returnflag <> 'A'"))
    return rounded(q.ks_statistic(returned, other, LINES))


@query(
    "nmse_by_column",
    f"WITH {pair_cte()}, {error_cte()} SELECT column_name, {r('nmse')} AS normalized_mse FROM per_column",
)
def _(spark, sf_dir):
    return rounded(q.nmse_by_column(comparison(spark, sf_dir)).drop("column_position"))


@query(
    "corr_diff",
    f"WITH {pair_cte()}, {pair_corr_cte('orig', COLUMNS, 'po')}, {pair_corr_cte('anon', COLUMNS, 'pa')} "
    f"SELECT column_a, column_b, {r('abs(po.r - pa.r)')} AS difference FROM po JOIN pa USING (column_a, column_b)",
)
def _(spark, sf_dir):
    pair = comparison(spark, sf_dir)
    return rounded(q.corr_diff(pair.original, pair.anonymized, COLUMNS))


@query(
    "association_nulls",
    f"WITH orig AS ({ORIGINAL_SQL}), {pair_corr_cte('orig', COLUMNS)} "
    f"SELECT column_a AS column_name, {r('avg(abs(r))')} AS association FROM pairs GROUP BY column_a",
)
def _(spark, sf_dir):
    """Pairwise-complete correlations of columns with nulls."""
    return rounded(numeric_association(original(spark, sf_dir), COLUMNS))


@query("fill_median", f"WITH {pair_cte()} SELECT o_orderkey, {out(COLUMNS)} FROM orig")
def _(spark, sf_dir):
    return rounded(q.fill_median(original(spark, sf_dir), COLUMNS))


@query("fill_median_refined", f"WITH {pair_cte()} SELECT o_orderkey, {out(COLUMNS)} FROM anon")
def _(spark, sf_dir):
    """With the quantile search meant for columns too large for one task."""
    return rounded(q.fill_median(anonymized(spark, sf_dir), COLUMNS, small_rows=0))


@query(
    "common_numeric",
    "SELECT c_custkey, c_acctbal FROM customer",
)
def _(spark, sf_dir):
    """The columns that stayed numeric, of a table whose other numbers became labels."""
    customer = table(spark, sf_dir, "customer")
    labelled = customer.withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    return customer.select(*q.common_numeric(customer, labelled))


# --- PCA -------------------------------------------------------------------------------


def pca_cte(columns=COLUMNS) -> str:
    """Axes of both tables, scaled by the original's quartiles, and how their scores go together."""
    d = len(columns)
    spread = ", ".join(
        f"coalesce(nullif(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 0), 1)::DOUBLE" for c in columns
    )

    def scaled(side: str) -> str:
        return "[" + ", ".join(f"{side}.{c} / spread[{i + 1}]" for i, c in enumerate(columns)) + "]"

    def cells(x: str, y: str) -> str:
        grid = f"(SELECT unnest(range({d})) AS i), (SELECT unnest(range({d})) AS j)"
        return f"SELECT i, j, covar_samp({x}[i + 1], {y}[j + 1]) AS x FROM scaled, {grid} GROUP BY i, j"

    both = f"SELECT 'o' AS side, * FROM ({cells('xo', 'xo')}) UNION ALL SELECT 'a', * FROM ({cells('xa', 'xa')})"
    return f"""{pair_cte(columns)},
    scaled AS (SELECT o_orderkey, {scaled('o')} AS xo, {scaled('a')} AS xa
               FROM orig o JOIN anon a USING (o_orderkey), (SELECT [{spread}] AS spread FROM orig)),
    {eigen_cte('axes', both, d)},
    crossed AS ({cells('xo', 'xa')}),
    ratios AS (SELECT *, value / sum(value) OVER (PARTITION BY side) AS ratio,
                 sum(value) OVER (PARTITION BY side ORDER BY component) / sum(value) OVER (PARTITION BY side) AS running FROM axes),
    together AS (SELECT o.component, sum(o.axis[i + 1] * x * a.axis[j + 1]) / sqrt(any_value(o.value) * any_value(a.value)) AS cc
                 FROM axes o JOIN axes a USING (component), crossed WHERE o.side = 'o' AND a.side = 'a' GROUP BY o.component),
    pca AS (SELECT component, o.ratio AS ro, a.ratio AS ra, o.running AS co, a.running AS ca, cc
            FROM ratios o JOIN ratios a USING (component) JOIN together USING (component) WHERE o.side = 'o' AND a.side = 'a')"""


@query(
    "pca_metrics",
    f"WITH {pca_cte()} SELECT component, {r('ro')} AS original_ratio, {r('ra')} AS anonymized_ratio, "
    f"{r('co')} AS original_cumulative, {r('ca')} AS anonymized_cumulative, {r('cc')} AS component_correlation FROM pca",
)
def _(spark, sf_dir):
    return rounded(q.pca_metrics(comparison(spark, sf_dir)))


@query(
    "variance_retention",
    f"WITH {pca_cte()} SELECT component, {r('co * 100')} AS original_percent, {r('ca * 100')} AS anonymized_percent, "
    f"{r('ca / co * 100')} AS retention_percent FROM pca WHERE component IN (2, 5, 10)",
)
def _(spark, sf_dir):
    return rounded(q.variance_retention(comparison(spark, sf_dir)))


METRICS_CTE = (
    f"{pca_cte()}, {error_cte()}, {ks_cte()}, metrics AS (SELECT * FROM ({stats_select()}), "
    f"({PRIVACY_SELECT}), (SELECT avg(cc) AS comp FROM pca))"
)

POINTS_CTE = f"""{METRICS_CTE},
points AS (SELECT *, least(100, greatest(0, comp * 25) + greatest(0, correlation_preservation * 25)
                  + greatest(0, (1 - mean_ks_statistic) * 25) + least(25, variance_preservation * 12.5)) AS utility,
                  least(100, uniqueness_reduction * 50 + (1 - abs(correlation_preservation)) * 50) AS privacy FROM metrics),
assessed AS (SELECT *, CASE
  WHEN utility >= 80 AND privacy >= 70 THEN 'EXCELLENT - Strong privacy with high utility'
  WHEN utility >= 70 AND privacy >= 60 THEN 'GOOD - Balanced privacy-utility tradeoff'
  WHEN utility >= 50 AND privacy >= 50 THEN 'FAIR - Acceptable with room for improvement'
  WHEN utility >= 30 THEN 'POOR - Significant utility loss or weak privacy'
  ELSE 'VERY POOR - Consider re-evaluating anonymization approach' END AS assessment FROM points)"""

SCORES = f"{r('utility')} AS utility_score, {r('privacy')} AS privacy_score, assessment"


@query("quality_scores", f"WITH {POINTS_CTE} SELECT {SCORES} FROM assessed")
def _(spark, sf_dir):
    metrics = q.all_metrics(comparison(spark, sf_dir))
    return rounded(q.quality_scores(metrics).select("utility_score", "privacy_score", "assessment"))


VERDICT = """CASE WHEN correlation_preservation > 0.8 AND uniqueness_reduction > 0.3 THEN 'EXCELLENT'
           WHEN correlation_preservation > 0.6 THEN 'GOOD' ELSE 'FAIR' END"""


@query(
    "quality_verdict",
    f"""WITH {pair_cte()}, {error_cte()}, {ks_cte()}
    SELECT {out(('correlation_preservation', 'uniqueness_reduction'))},
      {VERDICT} AS verdict
    FROM ({stats_select()}), ({PRIVACY_SELECT})""",
)
def _(spark, sf_dir):
    metrics = q.all_metrics(comparison(spark, sf_dir))
    verdict = q.quality_verdict(metrics)
    return rounded(verdict.select("correlation_preservation", "uniqueness_reduction", "verdict"))


REPORT_SQL = f"""WITH {POINTS_CTE} SELECT {out((*STATS, *PRIVACY))}, {r('comp')} AS mean_component_correlation, {SCORES},
    {VERDICT} AS verdict FROM assessed"""


@query("quality_report", REPORT_SQL)
def _(spark, sf_dir):
    """The whole report over five columns, one row."""
    return rounded(quality_report(original(spark, sf_dir), anonymized(spark, sf_dir), KEY).summary())


def _score_sql(side: str, k: int) -> str:
    alias = side[0]
    return (
        f"(SELECT list_dot_product(axis, list_transform(range({len(COLUMNS)}), lambda e: x{alias}[e + 1] - m{alias}[e + 1])) "
        f"FROM axes WHERE side = '{alias}' AND component = {k})"
    )


@query(
    "pc_sample",
    f"""WITH {pca_cte()},
    means AS (SELECT [{', '.join(f'avg(xo[{i + 1}])' for i in range(len(COLUMNS)))}] AS mo,
                     [{', '.join(f'avg(xa[{i + 1}])' for i in range(len(COLUMNS)))}] AS ma FROM scaled),
    chosen AS (SELECT o_orderkey FROM orders ORDER BY sha256('sample|' || o_orderkey), o_orderkey LIMIT 1000)
    SELECT o_orderkey AS row_key, {', '.join(f'{r(_score_sql(side, k))} AS {side}_pc{k}' for side in ('original', 'anonymized') for k in (1, 2))}
    FROM scaled JOIN chosen USING (o_orderkey), means""",
)
def _(spark, sf_dir):
    return rounded(q.pc_sample(comparison(spark, sf_dir)))


# --- histograms --------------------------------------------------------------------------


def histogram_sql(name: str, columns) -> str:
    step = "((hi - lo) / 20)"

    def edge(i: str) -> str:
        return f"(CASE WHEN {i} >= 20 THEN hi ELSE {i}::DOUBLE * {step} + lo END)"

    return f"""
    WITH long AS ({long_sql(name, columns, 'DOUBLE')}),
    span AS (SELECT column_name, CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
                    CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi, count(v) AS n
             FROM long GROUP BY column_name),
    guessed AS (SELECT column_name, v, lo, hi, least(greatest(CAST(floor((v - lo) / {step}) AS BIGINT), 0), 19) AS g
                FROM long JOIN span USING (column_name) WHERE v IS NOT NULL),
    placed AS (SELECT column_name, CASE WHEN g > 0 AND v < {edge('g')} THEN g - 1
                      WHEN g < 19 AND v >= {edge('(g + 1)')} THEN g + 1 ELSE g END AS bin FROM guessed),
    counted AS (SELECT column_name, bin, count(*) AS c FROM placed GROUP BY column_name, bin),
    grid AS (SELECT *, unnest(range(20)) AS bin FROM span)
    SELECT column_name, bin, {r(edge('bin'))} AS lower_edge, {r(edge('(bin + 1)'))} AS upper_edge,
           coalesce(c, 0) AS rows_in_bin, {r(f'coalesce(c, 0) / (n * {step})', 9)} AS density
    FROM grid LEFT JOIN counted USING (column_name, bin)"""


@query("histogram_20", histogram_sql("customer", ["c_custkey", "c_acctbal", "c_nationkey"]))
def _(spark, sf_dir):
    found = q.histogram_20(table(spark, sf_dir, "customer"), ["c_custkey", "c_acctbal", "c_nationkey"])
    density = (F.round("density", 9) + F.lit(0.0)).alias("density")
    return rounded(found.drop("density").join(found.select("column_name", "bin", density), ["column_name", "bin"]), 9)
