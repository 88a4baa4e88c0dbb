"""Scans, sinks and watermarks.

Files are written from the given tables into the shared scratch folder first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from veilwright import Policy
from veilwright.operators import watermark as wm
from veilwright.operators.classify import classify_columns, validate_classification
from veilwright.plans.report import align_by_position, quality_report
from veilwright.plans.run import write_classification
from veilwright.session import scratch_path, stage
from veilwright.sources import tables as src
from veilwright.sources.watermarked import (
    AlreadyAnonymized,
    read_watermarked,
    refuse_marked,
    watermarks,
    write_marked_parquet,
    write_watermarked,
)

from . import quality as pair
from .profiling import PART, score_cte
from .registry import query, rounded, table

MARK = wm.make_watermark(Policy(secret="").watermark_params(), timestamp="2024-01-02T03:04:05")


# --- scans and sinks -------------------------------------------------------------------


@query("scan_table", "SELECT * FROM events")
def _(spark, sf_dir):
    return src.read_parquet(spark, f"{sf_dir}/events.parquet")


CSV_SCAN_SQL = """
SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus,
       CASE WHEN o_custkey % 10 <> 3 THEN o_totalprice END AS o_totalprice, o_custkey % 2 = 0 AS even,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders
"""


@query("scan_csv", CSV_SCAN_SQL)
def _(spark, sf_dir):
    """Types found by the scan; missing-value markers and empty cells read as null."""
    path = scratch_path(spark, "csv")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        "o_custkey",
        F.when(F.col("o_orderstatus") == "P", F.lit("N/A")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(F.col("o_custkey") % 10 != 3, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("True")).otherwise(F.lit("False")).alias("even"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority",
    )
    src.write_csv(rows, path)
    return src.read_csv(spark, path)


@query("write_plain", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf_dir):
    """Whole texts with line breaks and quotes, written and read back."""
    path = scratch_path(spark, "plain")
    src.write_csv(table(spark, sf_dir, "documents"), path)
    return src.read_csv(spark, path, multiline=True)


@query("write_watermarked", "SELECT * FROM customer")
def _(spark, sf_dir):
    """Written with a watermark, read back without it."""
    path = scratch_path(spark, "marked")
    write_watermarked(table(spark, sf_dir, "customer"), path, MARK)
    return read_watermarked(spark, path)


@query(
    "read_watermarked",
    "SELECT conv_id, turn, '# ' || role AS role, text FROM conversations",
)
def _(spark, sf_dir):
    """Data lines that start like a comment, and texts with line breaks, stay whole."""
    path = scratch_path(spark, "marked")
    rows = table(spark, sf_dir, "conversations")
    marked = rows.select(F.concat(F.lit("# "), "role").alias("role"), "conv_id", "turn", "text")
    write_watermarked(marked, path, MARK)
    schema = "role string, conv_id long, turn long, text string"
    return read_watermarked(spark, path, schema, multiline=True)


LOOKALIKES_SQL = f"""
SELECT CASE WHEN conv_id % 7 = 0 THEN 'role' WHEN conv_id % 7 = 1 THEN '{wm.PREFIX} {{}}' ELSE role END AS role,
       CASE WHEN conv_id % 7 = 0 THEN 'text' ELSE text END AS text, conv_id FROM conversations
"""


@query("read_watermarked_lookalikes", LOOKALIKES_SQL)
def _(spark, sf_dir):
    """Data rows that equal the header or start like a mark stay, in every file."""
    path = scratch_path(spark, "marked")
    seventh = F.col("conv_id") % 7
    rows = table(spark, sf_dir, "conversations").select(
        F.when(seventh == 0, "role").when(seventh == 1, wm.PREFIX + " {}").otherwise(F.col("role")).alias("role"),
        F.when(seventh == 0, "text").otherwise(F.col("text")).alias("text"),
        "conv_id",
    )
    write_watermarked(rows.repartition(5), path, MARK)
    return read_watermarked(spark, path, "role string, text string, conv_id long")


@query("scan_csv_multiline", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf_dir):
    """Quoted line breaks are part of a cell by default, in a scan that finds the types."""
    path = scratch_path(spark, "lines")
    src.write_csv(table(spark, sf_dir, "documents"), path)
    return src.read_csv(spark, path)


@query("scan_csv_split", "SELECT doc_id, text, lang, source, n_chars FROM documents")
def _(spark, sf_dir):
    """Files cut into ranges that start inside quoted cells, whatever task reads them."""
    path = scratch_path(spark, "split")
    docs = table(spark, sf_dir, "documents")
    src.write_csv(docs, path)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in keys]
    try:
        for key in keys:
            spark.conf.set(key, str(max(4096, size // 50)))
        return stage(src.read_csv(spark, path), "split")  # while the ranges are small
    finally:
        for key, value in zip(keys, before):
            spark.conf.set(key, value)


def _permuted(df: DataFrame, write) -> str:
    """The rows of a table in three folders of files with their columns in different orders."""
    path = scratch_path(df.sparkSession, "permuted")
    names = df.columns
    for i, order in enumerate((names, names[::-1], names[2:] + names[:2])):
        write(df.where(F.pmod(F.hash(*names), F.lit(3)) == i).select(*order), f"{path}/part{i}")
    return f"{path}/*"


@query("scan_csv_permuted", "SELECT * FROM customer")
def _(spark, sf_dir):
    """Each file's own header says which column is which."""
    path = _permuted(table(spark, sf_dir, "customer"), src.write_csv)
    return src.read_csv(spark, path, table(spark, sf_dir, "customer").schema)


@query("read_watermarked_permuted", "SELECT * FROM customer")
def _(spark, sf_dir):
    path = _permuted(table(spark, sf_dir, "customer"), lambda df, to: write_watermarked(df, to, MARK))
    back = read_watermarked(spark, path)  # columns and types as in the first file
    return back.select(*[F.col(n).cast(t) for n, t in table(spark, sf_dir, "customer").dtypes])


@query(
    "scan_csv_ragged",
    """SELECT c_custkey % 4 AS rest, CASE WHEN c_custkey % 4 = 3 THEN 'refused' ELSE 'read' END AS outcome,
       CASE WHEN c_custkey % 4 < 3 THEN count(*) ELSE 0 END AS row_count,
       CASE WHEN c_custkey % 4 < 3 THEN count(*) FILTER (c_custkey % 4 <> 1) ELSE 0 END AS names,
       CASE WHEN c_custkey % 4 < 3 THEN max(length(c_name) + CASE WHEN c_custkey % 1000 < 4 THEN 1000002 ELSE 2 END) ELSE 0 END AS longest
       FROM customer GROUP BY c_custkey % 4""",
)
def _(spark, sf_dir):
    """Rows with missing cells are read with nulls, whatever the length of a cell; a file with surplus cells is refused."""
    customer = table(spark, sf_dir, "customer").withColumn("rest", F.col("c_custkey") % 4)
    # With remainder 1 the last cell is missing, with 3 there is one too many; quoted commas and line breaks are no cells.
    filler = F.when(F.col("c_custkey") % 1000 < 4, F.expr("repeat('a', 1000000)")).otherwise(F.lit(""))
    note = F.concat(F.lit('",'), filler, F.lit("\n"), F.col("c_name"), F.lit('"'))
    name = F.when(F.col("rest") != 1, F.col("c_name"))
    line = F.concat_ws(",", F.col("c_custkey").cast("string"), note, name, F.when(F.col("rest") == 3, F.lit("x")))
    found = None
    for rest in range(4):
        path = scratch_path(spark, "ragged")
        part = customer.where(F.col("rest") == rest)
        header = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
        lines = F.when(header, F.array(F.lit("key,note,name"), "line")).otherwise(F.array("line"))
        part.select(line.alias("line")).select(F.explode(lines).alias("value")).write.text(path)
        try:
            rows = src.read_csv(spark, path, "key long, note string, name string")
            counted = rows.agg(F.count(F.lit(1)), F.count("name"), F.max(F.length("note"))).first()
            outcome = "read"
        except Exception as error:
            if "more than 3 cells" not in str(error):
                raise
            counted, outcome = (0, 0, 0), "refused"
        one = spark.createDataFrame([(rest, outcome, *counted)], "rest long, outcome string, row_count long, names long, longest long")
        found = one if found is None else found.unionByName(one)
    return found


@query(
    "classification_round_trip",
    f"""WITH {score_cte('part', PART, ['p_partkey', 'p_size', 'p_retailprice'])}
    SELECT column_name, risk_tier, CASE WHEN column_name = 'p_size' THEN 'extra' END AS problem FROM decided
    UNION ALL SELECT 'p_weight', NULL, 'missing'""",
)
def _(spark, sf_dir):
    """A classification written as a file, read back, and held against a table with a column less and one more."""
    part = table(spark, sf_dir, "part")
    path = scratch_path(spark, "tiers")
    write_classification(classify_columns(part), path)
    back = src.read_csv(spark, path)
    problems = validate_classification(back, part.drop("p_size").withColumn("p_weight", F.lit(1)))
    named = back.select(F.col("Column Name").alias("column_name"), F.col("Risk Tier").alias("risk_tier"))
    return named.join(problems, "column_name", "full")


@query("write_report", pair.REPORT_SQL)
def _(spark, sf_dir):
    """The quality report as JSON files, read back."""
    path = scratch_path(spark, "report")
    quality_report(pair.original(spark, sf_dir), pair.anonymized(spark, sf_dir), pair.KEY).write(path)
    return rounded(spark.read.json(f"{path}/metrics"))


# --- watermarks ----------------------------------------------------------------------------

FOLDERS = {"customer": True, "supplier": False, "part": True}


def _folders(spark, sf_dir) -> dict[str, str]:
    """Each table as CSV files, some of them marked."""
    paths = {}
    for name, marked in FOLDERS.items():
        paths[name] = scratch_path(spark, name)
        if marked:
            write_watermarked(table(spark, sf_dir, name), paths[name], MARK)
        else:
            src.write_csv(table(spark, sf_dir, name), paths[name])
    return paths


@query(
    "detect_watermark",
    " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, {str(marked).lower()} AS is_watermarked, {str(marked).lower()} AS is_valid, "
        f"{repr('5') if marked else 'NULL'} AS k_anonymity, count(*) AS data_rows FROM {n}"
        for n, marked in FOLDERS.items()
    ),
)
def _(spark, sf_dir):
    """Marks found in the files of several folders, next to the rows those files hold."""
    found = []
    for name, path in _folders(spark, sf_dir).items():
        marks = watermarks(spark, path).agg(
            F.bool_and("is_watermarked").alias("is_watermarked"),
            F.bool_and("is_valid").alias("is_valid"),
            F.max(F.get_json_object("watermark", "$.anonymization_params.k_anonymity")).alias("k_anonymity"),
        )
        rows = read_watermarked(spark, path).agg(F.count(F.lit(1)).alias("data_rows"))
        found.append(
            marks.withColumn("dataset", F.lit(name)).join(rows.withColumn("dataset", F.lit(name)), "dataset")
        )
    return reduce(DataFrame.unionByName, found)


@query(
    "reanonymize_guard",
    " UNION ALL ".join(
        f"SELECT '{n}' AS dataset, '{'refused' if marked else 'accepted'}' AS decision, "
        f"{'0 * count(*)' if marked else 'count(*)'} AS rows_read FROM {n}"
        for n, marked in FOLDERS.items()
    ),
)
def _(spark, sf_dir):
    """Marked input is refused before any of it is read as data."""
    decisions = []
    for name, path in _folders(spark, sf_dir).items():
        try:
            refuse_marked(spark, path)
            rows = src.read_csv(spark, path)
            decision = "accepted"
        except AlreadyAnonymized:
            rows = spark.createDataFrame([], "c int")
            decision = "refused"
        counted = rows.agg(F.count(F.lit(1)).alias("rows_read"))
        decisions.append(counted.select(F.lit(name).alias("dataset"), F.lit(decision).alias("decision"), "rows_read"))
    return reduce(DataFrame.unionByName, decisions)


#: What stands after the prefix in the files of a nation, by its key; and what is found there.
BODIES = (
    ('{"anonymized": true, "anonymization_timestamp": "t", "anonymization_params": {}, "version": "1.0"}', True, wm.VALID),
    ("{'anonymized': true}", False, wm.NOT_AN_OBJECT),
    ('{"anonymized": true} trailing', False, wm.NOT_AN_OBJECT),
    ("[1, 2]", True, wm.NOT_AN_OBJECT),
    ('"text"', True, wm.NOT_AN_OBJECT),
    ("null", False, wm.NOT_AN_OBJECT),
    ('{"anonymized": 0, "anonymization_timestamp": null, "anonymization_params": {}, "version": 1}', True, wm.NOT_ANONYMIZED),
    ('{"anonymized": "false", "anonymization_timestamp": "t", "anonymization_params": [], "version": ""}', True, wm.VALID),
    ('{"anonymized": [], "anonymization_timestamp": "t", "anonymization_params": [], "version": ""}', True, wm.NOT_ANONYMIZED),
    ('{"anonymized": true, "anonymization_timestamp": "t", "anonymization_params": {}}', True, wm.MISSING + "version"),
    ("{", False, wm.NOT_AN_OBJECT),
)
_BODY_CASES = " ".join(f"WHEN {i} THEN {{'marked': {marked}, 'reason': '{reason}'}}" for i, (_, marked, reason) in enumerate(BODIES))


@query(
    "detect_watermark_strict",
    f"""SELECT c_nationkey, count(*) AS customers, b.marked AS is_watermarked, b.reason AS reason FROM (
        SELECT c_nationkey, CASE c_nationkey % {len(BODIES)} {_BODY_CASES} END AS b FROM customer) GROUP BY ALL""",
)
def _(spark, sf_dir):
    """Files of each nation start with some JSON or nearly JSON; only strict JSON is a mark, and only an object a good one."""
    path = scratch_path(spark, "strict")
    customer = table(spark, sf_dir, "customer")
    lines = customer.select("c_nationkey", F.lit(1).alias("place"), F.to_csv(F.struct(*customer.columns)).alias("value"))
    body = F.element_at(F.array(*[F.lit(f"{wm.PREFIX} {b}") for b, _, _ in BODIES]), F.pmod("c_nationkey", F.lit(len(BODIES))) + 1)
    marks = customer.select("c_nationkey").distinct().select("c_nationkey", F.lit(0).alias("place"), body.alias("value"))
    ordered = lines.unionAll(marks).repartition("c_nationkey").sortWithinPartitions("c_nationkey", "place")
    ordered.drop("place").write.partitionBy("c_nationkey").text(path)
    nation = F.regexp_extract("file", "c_nationkey=([0-9]+)", 1).cast("int")
    found = watermarks(spark, path).select(nation.alias("c_nationkey"), "is_watermarked", "reason")
    rows = spark.read.text(path).where(~F.col("value").startswith(wm.PREFIX)).groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return found.join(rows, "c_nationkey")


def _order_marks(spark, sf_dir) -> DataFrame:
    """A watermark per order, its fields taken from the order; some are broken."""
    params = F.map_from_arrays(
        F.array(F.lit("k_anonymity"), F.lit("epsilon"), F.concat(F.lit("status_"), "o_orderstatus")),
        F.array(
            (F.col("o_custkey") % 3 + 2).cast("string"),
            F.when(F.col("o_custkey") % 2 == 0, F.lit("1.0")).otherwise(F.lit("0.5")),
            F.lit("on"),
        ),
    )
    priority = F.col("o_orderpriority")
    stamp = F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss")
    body = wm.watermark_json(
        F.when(~priority.startswith("2"), params),
        F.when(~priority.startswith("3"), stamp),
        anonymized=~priority.startswith("5"),
        version=F.when(~priority.startswith("4"), F.lit("1.0")),
    )
    broken = F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("["), body)).otherwise(body)
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", broken.alias("watermark"))


@query(
    "validate_watermark",
    """SELECT o_orderkey, reason, reason = 'Watermark is valid' AS is_valid FROM (SELECT o_orderkey, CASE
      WHEN o_orderstatus = 'P' THEN 'Watermark must be a dictionary'
      WHEN o_orderpriority LIKE '3%' THEN 'Missing required field: anonymization_timestamp'
      WHEN o_orderpriority LIKE '2%' THEN 'Missing required field: anonymization_params'
      WHEN o_orderpriority LIKE '4%' THEN 'Missing required field: version'
      WHEN o_orderpriority LIKE '5%' THEN 'Watermark indicates data is not anonymized'
      ELSE 'Watermark is valid' END AS reason FROM orders)""",
)
def _(spark, sf_dir):
    return wm.validate_watermark(_order_marks(spark, sf_dir)).select("o_orderkey", "reason", "is_valid")


COMPARE_SQL = """
WITH marks AS (
  SELECT o_orderkey, o_custkey, o_orderstatus <> 'P' AS ok, o_orderpriority NOT LIKE '3%' AS has_time,
         o_orderpriority NOT LIKE '2%' AS has_params, o_orderdate AS stamp,
         CAST(o_custkey % 3 + 2 AS VARCHAR) AS k, CASE WHEN o_custkey % 2 = 0 THEN '1.0' ELSE '0.5' END AS e,
         'status_' || o_orderstatus AS st FROM orders),
pairs AS (
  SELECT a.o_orderkey, a.ok AND a.has_params AS pa, b.ok AND b.has_params AS pb, a.k AS ka, b.k AS kb, a.e AS ea, b.e AS eb,
         a.st AS sa, b.st AS sb, CASE WHEN a.ok AND b.ok AND a.has_time AND b.has_time THEN
           date_diff('day', a.stamp, b.stamp) END AS days
  FROM marks a JOIN (SELECT o_orderkey, lag(o_orderkey) OVER (ORDER BY o_orderkey) AS previous FROM marks) p
    ON a.o_orderkey = p.previous JOIN marks b ON b.o_orderkey = p.o_orderkey),
listed AS (
  SELECT *, CASE WHEN pa THEN [{'p': 'epsilon', 'v': ea}, {'p': 'k_anonymity', 'v': ka}, {'p': sa, 'v': 'on'}] ELSE [] END AS la,
            CASE WHEN pb THEN [{'p': 'epsilon', 'v': eb}, {'p': 'k_anonymity', 'v': kb}, {'p': sb, 'v': 'on'}] ELSE [] END AS lb
  FROM pairs)
"""
ELAPSED = (
    "CASE WHEN days IS NULL THEN 'Unknown' WHEN days = 0 THEN '0:00:00' WHEN abs(days) = 1 THEN days || ' day, 0:00:00' "
    "ELSE days || ' days, 0:00:00' END"
)


def _neighbours(spark, sf_dir) -> DataFrame:
    """Each order's watermark beside the one of the order with the next key."""
    marks = _order_marks(spark, sf_dir)
    keys = marks.select("o_orderkey")
    after = keys.select((F.col("o_orderkey") - 1).alias("o_orderkey"), F.col("o_orderkey").alias("next_key"))
    new = marks.select(F.col("o_orderkey").alias("next_key"), F.col("watermark").alias("new"))
    return (
        marks.select("o_orderkey", F.col("watermark").alias("original")).join(after, "o_orderkey").join(new, "next_key")
    )


@query(
    "compare_watermarks",
    f"{COMPARE_SQL} SELECT o_orderkey, la = lb AS same_anonymization, {ELAPSED} AS timestamp_difference FROM listed",
)
def _(spark, sf_dir):
    compared = wm.compare_watermarks(_neighbours(spark, sf_dir))
    return compared.select("o_orderkey", "same_anonymization", "timestamp_difference")


@query(
    "watermark_changes",
    f"""{COMPARE_SQL}, old AS (SELECT o_orderkey, unnest(la, recursive := true) FROM listed),
    new AS (SELECT o_orderkey, unnest(lb, recursive := true) FROM listed)
    SELECT o_orderkey, p AS parameter, old.v AS original, new.v AS new
    FROM old FULL OUTER JOIN new USING (o_orderkey, p) WHERE old.v IS DISTINCT FROM new.v""",
)
def _(spark, sf_dir):
    return wm.parameter_changes(wm.compare_watermarks(_neighbours(spark, sf_dir)), "o_orderkey")


@query(
    "make_watermark",
    """SELECT c_nationkey, '1.0' AS version, 'true' AS anonymized, CAST(min(c) AS VARCHAR) AS k_anonymity,
       CAST(sum(c) AS VARCHAR) AS total_rows FROM (SELECT c_nationkey, c_mktsegment, count(*) AS c FROM customer GROUP BY ALL)
       GROUP BY c_nationkey""",
)
def _(spark, sf_dir):
    """A watermark per nation holding the k its customers reach, read back from its JSON."""
    groups = table(spark, sf_dir, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count(F.lit(1)).alias("c"))
    marks = groups.groupBy("c_nationkey").agg(F.min("c").alias("k"), F.sum("c").alias("n")).select(
        "c_nationkey",
        wm.watermark_json(
            F.create_map(F.lit("k_anonymity"), F.col("k").cast("string")),
            F.lit("2024-01-02T03:04:05"),
            info=F.create_map(F.lit("rows"), F.col("n").cast("string")),
        ).alias("watermark"),
    )
    return marks.select(
        "c_nationkey",
        F.get_json_object("watermark", "$.version").alias("version"),
        F.get_json_object("watermark", "$.anonymized").alias("anonymized"),
        F.get_json_object("watermark", "$.anonymization_params.k_anonymity").alias("k_anonymity"),
        F.get_json_object("watermark", "$.dataset_info.rows").alias("total_rows"),
    )


@query(
    "reanonymize_guard_parquet",
    """SELECT 'marked' AS dataset, 'refused' AS decision, 0 * count(*) AS rows_read FROM customer
       UNION ALL SELECT 'forced', 'accepted', count(*) FROM customer UNION ALL SELECT 'plain', 'accepted', count(*) FROM customer""",
)
def _(spark, sf_dir):
    """Parquet carries its mark beside the files; a mark counts by its ``anonymized`` field alone."""
    customer = table(spark, sf_dir, "customer")
    marked, plain = scratch_path(spark, "marked"), scratch_path(spark, "plain")
    write_marked_parquet(customer, marked, {"anonymized": True, "by": "another tool"})
    src.write_parquet(customer, plain)
    out = []
    for name, path, force in (("marked", marked, False), ("forced", marked, True), ("plain", plain, False)):
        try:
            refuse_marked(spark, path, force, lines=False)
            rows, decision = src.read_parquet(spark, path), "accepted"
        except AlreadyAnonymized:
            rows, decision = customer.where("false"), "refused"
        out.append(rows.agg(F.count(F.lit(1)).alias("rows_read")).select(F.lit(name).alias("dataset"), F.lit(decision).alias("decision"), "rows_read"))
    return reduce(DataFrame.unionByName, out)


@query(
    "align_by_position",
    "SELECT o_orderkey, o_orderkey AS other, o_totalprice - o_totalprice AS apart FROM orders WHERE o_orderkey IS NOT NULL",
)
def _(spark, sf_dir):
    """The same rows in Parquet files and in CSV files of other sizes, matched by their place."""
    orders, paths = table(spark, sf_dir, "orders"), [scratch_path(spark, "some"), scratch_path(spark, "others")]
    for path, parts, write in ((paths[0], 3, src.write_parquet), (paths[1], 7, src.write_csv)):
        write(orders.repartitionByRange(parts, "o_orderkey").sortWithinPartitions("o_orderkey"), path)
    left, right = align_by_position(spark.read.parquet(paths[0]), src.read_csv(spark, paths[1], place=True), "place")
    other = right.select("place", F.col("o_orderkey").alias("other"), F.col("o_totalprice").alias("price"))
    return left.join(other, "place").select("o_orderkey", "other", (F.col("o_totalprice") - F.col("price")).alias("apart"))
