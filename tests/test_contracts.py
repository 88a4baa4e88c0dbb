"""What inputs must hold, and what happens at the edges of numbers and types."""

import datetime
import gzip

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilwright import Policy, anonymize_table
from veilwright.functions.numbers import fixed_point_1, tenths
from veilwright.operators import quantiles
from veilwright.operators.generalize import microaggregate
from veilwright.operators.ordered import NoFileOrder, with_file_position
from veilwright.operators.privacy import enforce_k_numeric
from veilwright.operators.quality import Comparison
from veilwright.plans.report import align_by_position


def test_quantiles_of_any_data_take_seven_passes(spark, monkeypatch):
    draw = np.random.default_rng(0)
    n = 20_000
    data = {
        "even": draw.uniform(-1, 1, n),
        "wide": np.exp(draw.normal(0, 60, n)),
        "mixed": np.concatenate([draw.normal(0, 1, n - 1001), draw.normal(0, 1e300, 500), draw.normal(0, 1e-300, 500), [1e18]]),
        "equal": np.repeat([1.0, 2.0], n // 2),
        "infinite": np.concatenate([draw.normal(0, 1, n - 10), [np.inf] * 5, [-np.inf] * 5]),
        "nan": np.concatenate([draw.normal(0, 1, n - 10), [np.nan] * 10]),
    }
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*data.values())], ", ".join(f"{c} double" for c in data))
    passes, narrow = [], quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: passes.append(narrow(*a)))
    probs = (0, 0.01, 0.25, 0.5, 0.999, 1)
    exprs = {c: F.col(c) for c in data}
    searched = quantiles.exact_quantiles(df, exprs, probs, small_rows=0, few_rows=2)
    direct = quantiles.exact_quantiles(df, exprs, probs)
    assert passes and max(passes) <= 7
    for c, values in data.items():
        want = np.quantile(values[np.isfinite(values)], probs)
        assert searched[c] == pytest.approx(direct[c], rel=1e-12)
        assert searched[c] == pytest.approx(want.tolist(), rel=1e-9)


def test_one_decimal_of_large_numbers(spark):
    values = [0.05, 0.25, -0.25, 5e14 + 0.125, 1e15 + 0.5, 2.0**52 - 0.5, 2.0**52, 9.3e17, -9.3e18, 1.2345678901234567e25, 9.9e36]
    rows = spark.createDataFrame([(v,) for v in values], "v double").withColumn("t", tenths(F.col("v")))
    assert [r.s for r in rows.select(fixed_point_1(F.col("v"), F.col("t")).alias("s")).collect()] == [f"{v:.1f}" for v in values]


def test_bins_of_64_bit_keys(spark):
    df = spark.range(4000).select(F.xxhash64("id").alias("x"))
    labels = [r.x for r in enforce_k_numeric(df, ["x"], 5).collect()]
    assert len(labels) == 4000 and all(label.count(".") == 2 for label in labels)


def people(spark):
    rows = [(i, datetime.date(1950 + i % 40, 1, 1 + i % 28), i % 2 == 0, float(i)) for i in range(60)]
    return spark.createDataFrame(rows, "person_id int, birth_date date, flag boolean, salary double")


@pytest.mark.parametrize("tier", ["Tier 1", "Tier 2", "Tier 3"])
def test_dates_are_not_published_as_they_were(spark, tier):
    result = anonymize_table(people(spark), {"birth_date": tier, "flag": tier}, Policy(secret="s", use_pca=False), "person_id")
    dates = {r.birth_date for r in result.df.collect()}
    assert all(d == "REDACTED" or d == "Other" or tier == "Tier 2" for d in dates)
    assert len(dates) <= 10
    notes = {r.column_name: r.technique for r in result.techniques().collect()}
    assert notes["flag"].endswith("boolean left unchanged")
    assert "unchanged" not in notes["birth_date"]


def test_nested_identifiers_are_refused(spark):
    df = people(spark).withColumn("parts", F.array("salary"))
    with pytest.raises(ValueError, match="parts"):
        anonymize_table(df, {"parts": "Tier 1"}, Policy(secret="s"), "person_id")


@pytest.mark.parametrize("key", ["CAST(id % 50 AS INT)", "IF(id < 3, NULL, id)"])
def test_row_keys_must_name_rows(spark, key):
    df = spark.range(100).select(F.expr(key).alias("k"), F.col("id").cast("double").alias("x"))
    with pytest.raises(ValueError, match="row key 'k'"):
        microaggregate(df, ["x"], "k")
    with pytest.raises(ValueError, match="row key 'k'"):
        anonymize_table(df, {"x": "Tier 2"}, Policy(secret="s"), "k")
    with pytest.raises(ValueError, match="row key 'k'"):
        Comparison(df, df, "k")


def test_positions_follow_the_files(spark, tmp_path):
    """Two files against one: the same rows get the same numbers."""
    whole = spark.range(3000).select("id", (F.col("id") * 2.0).alias("x"))
    whole.coalesce(1).write.parquet(str(tmp_path / "one"))
    for name, condition in (("two/a", "id < 100"), ("two/b", "id >= 100")):
        whole.where(condition).coalesce(1).write.parquet(str(tmp_path / name))
    two = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "two"))
    left, right = align_by_position(spark.read.parquet(str(tmp_path / "one")), two, "n")
    pairs = left.join(right.select("n", F.col("id").alias("other")), "n")
    assert pairs.count() == 3000 and pairs.where("id <> other").count() == 0
    assert with_file_position(whole, scan_order=True).where("position = id").count() == 3000
    with pytest.raises(NoFileOrder):
        with_file_position(whole)


def test_surplus_cells_and_unknown_booleans_raise(spark, tmp_path):
    from veilwright.sources.tables import read_csv

    (tmp_path / "surplus.csv").write_text('a,b\n1,"x,y"\n2\n3,4,5\n')
    with pytest.raises(Exception, match="more than 2 cells"):
        read_csv(spark, str(tmp_path / "surplus.csv"))
    with pytest.raises(Exception, match="more than 2 cells"):
        read_csv(spark, str(tmp_path / "surplus.csv"), "a long, b string").agg(F.count("b")).collect()
    (tmp_path / "short.csv").write_text('a,b\n1,"x,y"\n2\n')
    assert [tuple(r) for r in read_csv(spark, str(tmp_path / "short.csv")).collect()] == [(1, "x,y"), (2, None)]
    (tmp_path / "flags.csv").write_text("a,b\n1,True\n2,\n3,yes\n")
    with pytest.raises(Exception, match="not a boolean"):
        read_csv(spark, str(tmp_path / "flags.csv"), "a long, b boolean").collect()


def test_every_file_is_marked(spark, tmp_path):
    from veilwright.operators.watermark import make_watermark
    from veilwright.sources.watermarked import read_watermarked, watermarks, write_watermarked

    spark.conf.set("spark.sql.files.maxRecordsPerFile", 10)
    try:
        write_watermarked(spark.range(100).repartition(3), str(tmp_path / "m"), make_watermark({"k": 5}))
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    assert watermarks(spark, str(tmp_path / "m")).where("NOT is_watermarked").count() == 0
    assert read_watermarked(spark, str(tmp_path / "m")).agg(F.sum("id")).first()[0] == 4950


def test_header_that_starts_like_a_comment(spark, tmp_path):
    from veilwright.sources.watermarked import read_watermarked

    (tmp_path / "h.csv").write_text('# ANONYMIZATION_WATERMARK: {"anonymized": true}\n#id,b\n1,2\n3,4\n')
    back = read_watermarked(spark, str(tmp_path / "h.csv"))
    assert back.columns == ["#id", "b"] and back.count() == 2


def test_a_mark_needs_only_its_flag(spark, tmp_path):
    from veilwright.sources.watermarked import AlreadyAnonymized, refuse_marked

    for name, flag in (("yes", "true"), ("no", "false")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text(f'# ANONYMIZATION_WATERMARK: {{"anonymized": {flag}}}\na\n1\n')
    with pytest.raises(AlreadyAnonymized):
        refuse_marked(spark, str(tmp_path / "yes"))
    refuse_marked(spark, str(tmp_path / "no"))


def test_classification_file_in_a_run(spark, tmp_path):
    from veilwright import anonymize_files

    rows = "\n".join(f"{i},{'red' if i % 2 else 'blue'},{i * 3}" for i in range(40))
    (tmp_path / "in.csv").write_text("id,colour,amount\n" + rows + "\n")
    (tmp_path / "tiers.csv").write_text("Column Name,Risk Tier\nid,Tier 1\ncolour,Tier 2\ngone,Tier 3\n")
    result = anonymize_files(
        spark, str(tmp_path / "in.csv"), str(tmp_path / "out"), Policy(secret="s", use_pca=False), "id",
        classification=str(tmp_path / "tiers.csv"), with_report=False,
    )
    assert result.notes == {"Classification: missing": "amount", "Classification: extra": "gone"}


def test_workers_get_the_code_wherever_the_driver_starts(tmp_path):
    import os
    import subprocess
    import sys

    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {repo!r})\n"
        "from veilwright.session import build_session\n"
        "from veilwright.operators.ordered import profile_monotonic\n"
        "spark = build_session('away', master='local[2]', spark__ui__enabled='false', spark__driver__host='127.0.0.1')\n"
        "print('ratio', profile_monotonic(spark.range(50), 'id').first()['monotonic_ratio'])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ratio 1.0" in out.stdout, out.stderr[-2000:]


def test_rare_categories_of_many_columns_take_one_grouping(spark):
    from veilwright.operators.privacy import enforce_k_categorical

    rows = [(i, "hot" if i % 3 else f"v{i}", None if i % 2 else f"w{i % 40}", f"{'long' * 30}{i % 50}") for i in range(600)]
    df = spark.createDataFrame(rows, "id int, a string, b string, c string")
    want = None
    for memory in (10_000, 0):
        out = enforce_k_categorical(df, ["a", "b", "c"], 9, memory)
        got = sorted(map(tuple, out.collect()))
        assert want is None or got == want
        want = got
        plan = out._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Union") == 0 and plan.count("LogicalRDD") + plan.count("LocalRelation") == 1
    assert {r[1] for r in want} == {"hot", "Other"}
    assert sum(r[2] is None for r in want) == 300
    assert {r[2] for r in want} == {None, *(f"w{i}" for i in range(0, 40, 2))}  # 15 rows each
    assert len({r[3] for r in want}) == 50  # long texts, 12 rows each


def test_rare_values_beyond_memory(spark, monkeypatch):
    from veilwright.operators import generalize

    rows = [("hot",)] * 500 + [(None,)] * 300 + [(f"v{i % 60}",) for i in range(300)] + [("x" * 100,)]
    df = spark.createDataFrame(rows, "a string")
    want = sorted(map(str, (r.a for r in generalize.suppress_rare(df, "a", 0.005).collect())))
    monkeypatch.setattr(generalize, "FREQUENT_IN_MEMORY", 1)
    got = sorted(map(str, (r.a for r in generalize.suppress_rare(df, "a", 0.005).collect())))
    assert got == want and got.count("None") == 300 and got.count("hot") == 500 and "SUPPRESSED" in got


def test_spread_join_equals_a_plain_one(spark):
    """Hot keys, null keys and keys without a partner; a task gets no more than a split of a hot key."""
    from veilwright.operators.spread import spread_join

    left = spark.range(6000).select(
        F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise((F.col("id") % 700).cast("string")).alias("k"),
        "id",
    )
    weights = left.groupBy("k").agg(F.count(F.lit(1)).alias("rows"))
    right = weights.where("k IS NULL OR k <> '5'").select("k", (F.col("rows") * 2).alias("x"))
    for how in ("inner", "left"):
        got = spread_join(left, right, ["k"], weights, 6000, how, heavy=100)
        want = left.alias("l").join(right.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")), how).select("l.k", "id", "x")
        assert sorted(map(tuple, got.select("k", "id", "x").collect()), key=str) == sorted(map(tuple, want.collect()), key=str)


def test_t_closeness_with_a_hot_class(spark, monkeypatch):
    """A class with a third of the rows, an attribute of unique values and one of two values, rows without a class."""
    from veilwright.operators import privacy, spread

    df = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, F.lit(0)).when(F.col("id") % 100 == 1, F.lit(None)).otherwise(F.col("id") % 97).cast("int").alias("g"),
        F.concat(F.lit("v"), "id").alias("own"),
        F.when(F.col("id") % 7 > 0, F.col("id") % 2).alias("two"),
        F.lit(None).cast("string").alias("none"),
    )
    plain = {(r["g"], r["attribute"]): r["distance"] for r in privacy.group_distance(df, ["g"], ["own", "two", "none"]).collect()}
    monkeypatch.setattr(privacy, "spread_join", lambda *a, **k: spread.spread_join(*a, **k, heavy=50))
    hot = {(r["g"], r["attribute"]): r["distance"] for r in privacy.group_distance(df, ["g"], ["own", "two", "none"]).collect()}
    assert hot.keys() == plain.keys() and all(abs(hot[k] - plain[k]) < 1e-12 for k in hot)
    rows = [r.asDict() for r in df.collect()]
    for attribute in ("own", "two"):
        seen = [r[attribute] for r in rows if r[attribute] is not None]
        share = {v: seen.count(v) / len(seen) for v in set(seen)} if attribute == "two" else dict.fromkeys(seen, 1 / len(seen))
        mine = [r[attribute] for r in rows if r["g"] == 0 and r[attribute] is not None]
        held = {v: mine.count(v) / len(mine) for v in set(mine)}
        want = sum(abs(held.get(v, 0) - p) for v, p in share.items()) / 2
        assert abs(plain[0, attribute] - want) < 1e-9
    assert not any(k[1] == "none" or k[0] is None for k in plain)


def test_long_categories_are_counted_by_digest(spark):
    """Texts of a kilobyte are told apart, kept whole, and not shuffled."""
    from veilwright.operators.generalize import generalize_categorical, top_tokens, top_values

    long = F.concat(F.expr("repeat('same start ', 100)"), (F.col("id") % 30).cast("string"))
    df = spark.range(900).select(F.when(F.col("id") % 30 < 25, long).otherwise(F.concat(F.lit("s"), F.col("id") % 3)).alias("t"))
    counts = {r["t"]: r["count"] for r in df.groupBy("t").count().collect()}
    top = top_values(df, ["t"], 4)["t"]
    assert [counts[t] for t in top] == sorted(counts.values(), reverse=True)[:4]
    assert top[:3] == ["s1", "s2", "s0"] and len(top[3]) > 1000
    assert all(len(t) <= 71 for t in top_tokens(df, ["t"], 30)["t"])
    kept = {r["t"]: r["count"] for r in generalize_categorical(df, ["t"], 5).groupBy("t").count().collect()}
    assert len(kept) == 5 and sum(kept.values()) == 900 and all(kept[t] == counts[t] for t in kept if t != "Other")


def test_keyed_compression_does_not_depend_on_partitions(spark):
    from veilwright.operators import compression as cp

    df = spark.range(4000).select(
        "id", F.concat(F.lit("value "), F.col("id") * 7919 % 1013).alias("v"), F.when(F.col("id") % 3 > 0, F.sha2(F.col("id").cast("string"), 256)).alias("h"),
        F.lit(None).cast("string").alias("n"),
    )

    def run(parts):
        found = cp.compression_by_key(df.repartition(parts), "id", ["v", "h", "n"], chunk_bytes=9000)
        return sorted(map(tuple, found.collect()))

    want = []
    texts = sorted((r.id, r.v, r.h) for r in df.collect())
    for i in (0, 1):
        chunks, before = {}, 0
        for row in texts:
            if row[i + 1] is not None:
                chunks.setdefault(before // 9000, []).append(row[i + 1].encode())
                before += len(row[i + 1]) + 1
        joined = [b" ".join(c) for c in chunks.values()]
        want.append((i, sum(map(len, joined)), sum(len(gzip.compress(j)) for j in joined)))
    assert run(1) == run(8) == want
    assert cp.profile_compression(df, row_key="id").where("column_name = 'n'").first()["compression_ratio"] == 1.0
