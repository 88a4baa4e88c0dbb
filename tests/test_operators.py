"""Operators on small handmade tables with known answers, and against NumPy."""

import gzip
import math
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilwright.functions.columns import as_number
from veilwright.operators import classify as cl
from veilwright.operators import generalize as gz
from veilwright.operators import privacy as pv
from veilwright.operators import quality as q
from veilwright.operators.association import correlations, pair_sums, with_correlation
from veilwright.operators.compression import profile_compression
from veilwright.operators.frequency import profile_frequency
from veilwright.operators.ordered import profile_monotonic, with_position, with_scan_position
from veilwright.operators.overview import column_info, dataset_overview
from veilwright.operators.pca import fit_pca, kept_components, oriented, reconstruct
from veilwright.operators.quantiles import exact_quantiles
from veilwright.operators import quantiles
from veilwright.operators.shape import profile_shape
from veilwright.operators.strings import profile_strings


def rows(df, *columns):
    return {r[columns[0]]: tuple(r[c] for c in columns[1:]) for r in df.collect()}


def frame(spark, values, schema="id long, x double"):
    return spark.createDataFrame(list(enumerate(values)), schema)


# --- profiles ------------------------------------------------------------------


def test_frequency_edges(spark):
    data = [(None, 1, "a", True, float("nan")), (None, 1, "b", False, 0.0), (None, 1, "b", None, -0.0)]
    df = spark.createDataFrame(data, "empty string, same int, two string, flag boolean, x double")
    got = rows(profile_frequency(df), "column_name", "distinct_ratio", "top1_freq", "top5_freq", "norm_entropy", "gini", "is_numeric")
    assert got["empty"] == (0, 0, 0, 0, 0, False)
    assert got["same"][:4] == (pytest.approx(1 / 3), 1.0, 1.0, 0.0) and got["same"][4] == pytest.approx(0)
    assert got["two"][:3] == (pytest.approx(2 / 3), pytest.approx(2 / 3), 1.0)
    assert got["two"][4] == pytest.approx(4 / 9)
    assert got["flag"][0] == 1.0 and got["flag"][5] is True
    assert got["x"][0] == 0.5 and got["x"][1] == 1.0  # NaN is missing, -0.0 equals 0.0


def test_top5_counts_the_five_most_frequent(spark):
    values = [v for v, n in zip("abcdefg", (9, 5, 4, 4, 4, 4, 1)) for _ in range(n)]
    df = frame(spark, values, "id long, v string")
    assert rows(profile_frequency(df, ["v"]), "column_name", "top5_freq")["v"][0] == pytest.approx(26 / 31)


def test_frequency_of_one_value_in_a_third_of_all_rows(spark):
    df = spark.range(30000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("v"))
    got = rows(profile_frequency(df), "column_name", "distinct_count", "top1_freq")["v"]
    assert got == (20001, pytest.approx(1 / 3))


@pytest.mark.parametrize("small_rows", [10**6, 0])
def test_shape(spark, small_rows):
    df = frame(spark, [1.0, 2.0, 3.0, 10.0]).withColumn("same", F.lit(1)).withColumn("t", F.lit("x"))
    got = rows(profile_shape(df, small_rows=small_rows), "column_name", "skewness", "kurtosis", "outlier_ratio")
    assert got["x"] == (pytest.approx(1.018234, abs=1e-6), pytest.approx(-0.7696, abs=1e-4), 0.25)
    assert got["same"] == (0, 0, 0) and got["t"] == (0, 0, 0)


@pytest.mark.parametrize("factor,shift", [(1e200, 0.0), (1e-200, 0.0), (1.0, 1e9)])
def test_shape_does_not_depend_on_unit_and_origin(spark, factor, shift):
    df = frame(spark, [x * factor + shift for x in (1.0, 2.0, 3.0, 10.0)])
    got = rows(profile_shape(df), "column_name", "skewness", "kurtosis", "outlier_ratio")["x"]
    assert got == (pytest.approx(1.018234, abs=1e-6), pytest.approx(-0.7696, abs=1e-4), 0.25)


def test_two_passes_find_the_quartiles_of_keys(spark, monkeypatch):
    passes, narrow = [], quantiles._narrow
    monkeypatch.setattr(quantiles, "_narrow", lambda *a: passes.append(narrow(*a)))
    df = spark.range(1, 400_001, numPartitions=4)
    found = quantiles.exact_quantiles(df, {"id": F.col("id")}, (0.25, 0.75), small_rows=0, few_rows=100)
    assert found["id"] == [100_000.75, 300_000.25] and passes[0] <= 2


def test_shape_of_one_value(spark):
    assert rows(profile_shape(frame(spark, [4.0, None]), ["x"]), "column_name", "skewness", "outlier_ratio")["x"] == (0, 0)


@pytest.mark.parametrize("few_rows", [0, 40, 20_000])
def test_refined_quantiles_equal_numpy(spark, few_rows):
    rng = np.random.default_rng(1)
    columns = {
        "normal": rng.normal(size=999),
        "heavy": np.where(rng.random(999) < 0.4, 7.0, rng.integers(0, 50, 999)).astype(float),
        "skewed": np.exp(rng.normal(scale=20, size=999)),
        "wide": rng.choice([-1.7e308, 0.0, 1.7e308, 5.0], 999),
        "same": np.full(999, 3.25),
    }
    df = spark.createDataFrame(pd.DataFrame(columns)).repartition(5)
    probs = (0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0)
    exprs = {c: F.col(c) for c in columns}
    refined, direct = exact_quantiles(df, exprs, probs, small_rows=0, few_rows=few_rows), exact_quantiles(df, exprs, probs)
    for name, values in columns.items():
        if name != "wide":
            assert refined[name] == pytest.approx(list(np.quantile(values, probs)), rel=1e-12)
            assert direct[name] == pytest.approx(refined[name], rel=1e-12)
        assert refined[name][0] == values.min() and refined[name][-1] == values.max()


def test_strings_edges(spark):
    df = spark.createDataFrame([(None, "ab"), (None, None)], "empty string, one string")
    got = rows(profile_strings(df), "column_name", "avg_length", "std_length", "token_count")
    assert got == {"empty": (0, 0, 0), "one": (2, 0, 1)}


@pytest.mark.parametrize("prune_rows", [10**9, 0])
def test_monotonic(spark, prune_rows):
    n = 2000
    data = [
        (i, float(i // 3), -i, str(i) if i % 2 else "x", float(i if i != 700 else 0), None, "t") for i in range(n)
    ]
    schema = "id long, up double, down int, half string, broken double, empty double, text string"
    df = spark.createDataFrame(data, schema).repartition(7)
    got = rows(profile_monotonic(df, "id", prune_rows=prune_rows), "column_name", "monotonic_ratio")
    assert got == {
        "id": (1,), "up": (1,), "down": (1,), "half": (0.5,), "broken": (0,), "empty": (0,), "text": (0,),
    }


def test_compression_of_one_chunk_is_the_whole_column(spark):
    values = [f"item {i % 7}" for i in range(500)]
    df = frame(spark, values, "id long, v string").coalesce(1).withColumn("empty", F.lit(None).cast("string"))
    got = rows(profile_compression(df, ["v", "empty"]), "column_name", "compression_ratio")
    data = " ".join(values).encode()
    assert got == {"v": (len(gzip.compress(data)) / len(data),), "empty": (1.0,)}


def correlated(spark, n=400, nulls=True):
    rng = np.random.default_rng(3)
    base = rng.normal(size=n)
    data = pd.DataFrame(
        {"a": base * 5 + 1e6, "b": base + rng.normal(size=n), "c": rng.integers(0, 5, n).astype(float), "d": 0.1}
    )
    if nulls:
        data.loc[rng.random(n) < 0.2, "a"] = np.nan
        data.loc[rng.random(n) < 0.3, "c"] = np.nan
    df = spark.createDataFrame(data).repartition(4)
    return data, df.select(*[as_number(df, c).alias(c) for c in df.columns])


@pytest.mark.parametrize("nulls", [True, False])
@pytest.mark.parametrize("max_aggregates", [1000, 0])
def test_correlations_equal_pandas(spark, nulls, max_aggregates):
    data, df = correlated(spark, nulls=nulls)
    want = data.corr()
    for r in correlations(df, data.columns, max_aggregates=max_aggregates).collect():
        expected = want.loc[r["column_a"], r["column_b"]]
        assert r["r"] is None if math.isnan(expected) else r["r"] == pytest.approx(expected, abs=1e-9)


def test_constant_within_the_shared_rows_has_no_correlation(spark):
    df = spark.createDataFrame([(1.1, 5.0), (1.1, 6.0), (9.0, None)], "a double, b double")
    got = with_correlation(pair_sums(df, {"a": F.col("a"), "b": F.col("b")})).where("i < j").first()
    assert got["r"] is None


# --- classification --------------------------------------------------------------


def test_tier_thresholds(spark):
    scores = [
        (0.6, 0.1, 0.1, 0.1, 0.2, "1"), (0.49, 0.1, 0.1, 0.1, 0.2, "3"), (0.1, 0.45, 0.1, 0.1, 0.2, "1"),
        (0.1, 0.1, 0.1, 0.35, 0.2, "2"), (0.1, 0.1, 0.36, 0.1, 0.2, "2"), (0.1, 0.1, 0.34, 0.1, 0.2, "3"),
        (0.6, 0.1, 0.1, 0.1, 0.7, "3"), (0.5, 0.1, 0.1, 0.5, 0.1, "1"),
    ]
    df = spark.createDataFrame(scores, [*cl.SCORES, "want"])
    labels = {"1": cl.TIER_1, "2": cl.TIER_2, "3": cl.TIER_3}
    assert all(r["got"] == labels[r["want"]] for r in df.withColumn("got", cl.tier()).collect())


def test_classification_finds_identifiers_and_reads_both_spellings(spark):
    data = [(f"user{i}@mail.org", f"{i:09d}"[:3] + "-12-" + f"{i:04d}", 30 + i % 2) for i in range(200)]
    df = spark.createDataFrame(data, "email string, ssn string, age int")
    got = cl.classify_columns(df)
    tiers = rows(got, "Column Name", "Risk Tier")
    assert list(tiers) == df.columns
    assert tiers["email"] == tiers["ssn"] == (cl.TIER_1,)
    assert cl.tier_column(got) == "Risk Tier"
    assert cl.tier_column(cl.with_long_tier_name(got)) == "Risk Tier Classification"
    assert cl.classification_is_valid(got, df)
    assert not cl.classification_is_valid(got, df.withColumn("new", F.lit(1)))


# --- privacy models -----------------------------------------------------------------


def test_null_keys_belong_to_no_group(spark):
    df = frame(spark, ["a", None, "a"], "id long, g string")
    assert pv.k_anonymity(df, ["g"], 2).first().asDict() == {"satisfied": True, "min_group_size": 2}
    assert pv.k_anonymity(df, ["g"], 2, null_as_group=True).first()["min_group_size"] == 1


def test_checks_without_quasi_identifiers(spark):
    df = frame(spark, [1.0])
    assert pv.k_anonymity(df, [], 5).first() == (True, 1)
    assert pv.l_diversity(df, [], ["x"], 2).first() == (True, math.inf)
    assert pv.t_closeness(df, ["x"], [], 0.1).first() == (True, 0.0)
    assert pv.delta_presence(df, [], 0.1, 10).first() == (True, 0.0)
    assert pv.delta_presence(df, ["x"], 0.1, 0).first() == (True, 0.0)


def brute_distance(data, quasi, s):
    overall = data[s].value_counts(normalize=True)
    found = {}
    for key, group in data.groupby(quasi):
        local = group[s].value_counts(normalize=True)
        values = set(overall.index) | set(local.index)
        found[key] = sum(abs(overall.get(v, 0) - local.get(v, 0)) for v in values) / 2
    return found


def test_distance_and_diversity_equal_brute_force(spark):
    rng = np.random.default_rng(4)
    data = pd.DataFrame({"g": rng.choice(["a", "b", "c", None], 300), "h": rng.integers(0, 3, 300)})
    data["s"] = [None if g == "b" and h == 1 else str(v) for g, h, v in zip(data.g, data.h, rng.integers(0, 6, 300))]
    df = spark.createDataFrame(data.astype(object).where(data.notna(), None), "g string, h int, s string")
    want = brute_distance(data, ["g", "h"], "s")
    got = {(r["g"], r["h"]): r["distance"] for r in pv.group_distance(df, ["g", "h"], ["s"]).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()}
    assert got["b", 1] == pytest.approx(0.5)  # no sensitive value at all
    diversity = {(r["g"], r["h"]): r["diversity"] for r in pv.group_diversity(df, ["g", "h"], ["s"]).collect()}
    assert diversity == data.groupby(["g", "h"])["s"].nunique().to_dict()


def test_enforce_k_numeric_uses_arithmetic_labels_for_many_bins(spark):
    rng = np.random.default_rng(5)
    values = rng.uniform(-50, 50, 4000)
    df = frame(spark, [float(v) for v in values])
    got = rows(pv.enforce_k_numeric(df, ["x"], 5), "id", "x")
    bins = np.linspace(values.min(), values.max(), 401)
    places = np.searchsorted(bins, values, side="left").clip(1)
    assert got == {i: (f"{bins[p - 1]:.1f}-{bins[p]:.1f}",) for i, p in enumerate(places)}


def test_enforce_k_leaves_constants_and_few_categories(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "x int, c string")
    assert pv.enforce_k_anonymity(df, ["x", "c"], 2).collect() == df.collect()


@pytest.mark.parametrize("kept_in_memory", [10_000, 0])
def test_rare_categories_merge_and_nulls_stay(spark, kept_in_memory):
    values = ["a"] * 50 + ["b"] * 3 + list("cdefg") + [None] * 4
    df = frame(spark, values, "id long, c string").repartition(3)
    got = rows(pv.enforce_k_categorical(df, ["c"], 3, kept_in_memory=kept_in_memory), "id", "c")
    assert Counter(v for v, in got.values()) == {"a": 50, "b": 3, "Other": 5, None: 4}


# --- column rewrites -----------------------------------------------------------------


def test_bins_fixture(spark):
    got = rows(gz.generalize_numeric(frame(spark, [1.0, 2.0, 3.0, 10.0, None]), ["x"]), "id", "x")
    assert [v for v, in got.values()] == ["1.0-2.8", "1.0-2.8", "2.8-4.6", "8.2-10.0", None]


def test_top_categories_break_ties_by_value_and_take_nulls(spark):
    df = frame(spark, ["b", "b", "a", "a", "c", "d", None], "id long, v string")
    got = rows(gz.generalize_categorical(df, ["v"], 3), "id", "v")
    assert [v for v, in got.values()] == ["b", "b", "a", "a", "Other", "Other", "Other"]
    assert gz.generalize_categorical(df, ["v"], 4).collect() == df.collect()


@pytest.mark.parametrize("min_frequency", [0.3, 0.00001])
def test_rare_suppression(spark, min_frequency):
    df = frame(spark, ["a", "a", "b", None], "id long, v string")
    got = rows(gz.suppress_rare(df, "v", min_frequency), "id", "v")
    assert [got[i][0] for i in range(4)] == ["a", "a", "b", None]
    assert rows(gz.suppress_rare(df, "v", 0.5), "id", "v")[2] == ("SUPPRESSED",)


def test_microaggregation_fixture(spark):
    df = frame(spark, [9.0, 1.0, 5.0, 3.0, None])
    assert rows(gz.microaggregate(df, ["x"], "id", 2), "id", "x") == {0: (7,), 1: (2,), 2: (7,), 3: (2,), 4: (None,)}
    in_order = gz.microaggregate(df, ["x"], "id", 2, align="file_order")
    assert rows(in_order, "id", "x") == {0: (2,), 1: (2,), 2: (7,), 3: (7,), 4: (None,)}
    assert rows(gz.microaggregate(df, ["x"], "id", 5), "id", "x")[0] == (9,)


def test_microaggregation_of_a_hot_value_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    x = np.where(rng.random(3000) < 0.4, 50.0, rng.integers(0, 100, 3000)).astype(float)
    y = rng.normal(size=3000)
    data = [(int(i), float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(data, "id long, x double, y double").repartition(6)
    got = rows(gz.microaggregate(df, ["x", "y"], "id", 7), "id", "x", "y")
    for values, at in ((x, 0), (y, 1)):
        order = np.argsort(values, kind="stable")
        for start in range(0, 3000, 7):
            run = order[start : start + 7]
            assert [got[i][at] for i in run] == pytest.approx([values[run].mean()] * len(run))
    assert np.mean([v[1] for v in got.values()]) == pytest.approx(y.mean())


def test_laplace_keeps_nulls_and_is_never_negative(spark):
    df = frame(spark, [None, *[0.0] * 500]).withColumn("t", F.lit("x"))
    got = gz.laplace_noise(df, ["x", "t"], "id", "s")
    values = [r["x"] for r in got.orderBy("id").collect()]
    assert values[0] is None and min(values[1:]) >= 0 and len(set(values[1:])) == 500
    assert got.select("t").distinct().count() == 1


def test_positions(spark):
    df = frame(spark, [3.0, 1.0, 2.0, 1.0]).repartition(3)
    assert rows(with_position(df, [F.col("x"), F.col("id")]), "id", "position") == {0: (3,), 1: (0,), 2: (2,), 3: (1,)}
    assert sorted(r["position"] for r in with_scan_position(df).collect()) == [0, 1, 2, 3]


# --- PCA -----------------------------------------------------------------------------------


def test_kept_components_must_exceed_the_threshold():
    ratios = np.array([0.6, 0.25, 0.15])
    assert [kept_components(ratios, t) for t in (0.5, 0.6, 0.84, 0.86, 1.0)] == [1, 2, 2, 3, 3]


def test_orientation_is_stable_under_rounding():
    v = np.array([[1.0, -1.0], [1.0 + 1e-15, 1.0 + 1e-15]]) / math.sqrt(2)
    assert np.sign(oriented(v)[0]).tolist() == [1, 1]


def pca_table(spark, d=5, n=300):
    rng = np.random.default_rng(7)
    data = rng.normal(size=(n, d)) @ rng.normal(size=(d, d)) * 10 - 3
    names = [f"x{i}" for i in range(d)]
    pdf = pd.DataFrame(data, columns=names)
    pdf.loc[rng.random(n) < 0.1, "x1"] = np.nan
    pdf.insert(0, "id", range(n))
    df = spark.createDataFrame(pdf)
    return pdf, df.select("id", *[as_number(df, c).alias(c) for c in names]), names


def test_pca_without_noise_and_with_all_components_gives_absolute_values(spark):
    pdf, df, names = pca_table(spark)
    model = fit_pca(df, names, 1.0)
    out = reconstruct(df, model, "id", "s", epsilon=math.inf).orderBy("id").toPandas()
    want = pdf[names].fillna(pdf[names].mean()).abs()
    assert np.allclose(out[names], want)


def test_pca_expression_and_vectorized_paths_agree(spark):
    pdf, df, names = pca_table(spark)
    model = fit_pca(df, names, 0.8)
    assert 1 <= model.kept < 5
    a = reconstruct(df, model, "id", "s").orderBy("id").toPandas()
    b = reconstruct(df, model, "id", "s", max_expression_columns=0).orderBy("id").toPandas()
    assert np.allclose(a[names], b[names]) and list(a.columns) == list(b.columns)


def test_pca_needs_two_varying_columns(spark):
    df = frame(spark, [1.0, 2.0]).withColumn("same", F.lit(1.0)).withColumn("t", F.lit("x"))
    assert fit_pca(df, ["x", "same", "t"]) is None


# --- quality --------------------------------------------------------------------------------


def quality_pair(spark):
    rng = np.random.default_rng(9)
    n = 500
    base = rng.normal(size=n)
    original = pd.DataFrame(
        {"id": range(n), "a": base * 3 + 100, "b": base + rng.normal(size=n), "c": rng.integers(0, 9, n) * 1.0, "k": 4.0}
    )
    anonymized = original.copy()
    anonymized["a"] = original["a"] + rng.normal(scale=2, size=n)
    anonymized["b"] = original["b"].round()
    anonymized.loc[rng.random(n) < 0.1, "b"] = np.nan
    original.loc[rng.random(n) < 0.1, "c"] = np.nan
    frames = []
    for pdf in (original, anonymized):
        df = spark.createDataFrame(pdf.sample(frac=1, random_state=1))
        frames.append(df.select("id", *[as_number(df, c).alias(c) for c in "abck"]))
    return original, anonymized, frames


def brute_ks(x, y):
    at = np.union1d(x, y)
    cdf = lambda v: np.searchsorted(np.sort(v), at, side="right") / len(v)
    return np.abs(cdf(x) - cdf(y)).max()


def pearson(x, y):
    ok = np.isfinite(x) & np.isfinite(y)
    return np.corrcoef(x[ok], y[ok])[0, 1]


@pytest.mark.parametrize("small_rows", [10**6, 0])
def test_quality_equals_numpy(spark, small_rows):
    original, anonymized, (left, right) = quality_pair(spark)
    columns = list("abck")
    o, a = (p[columns].fillna(p[columns].median()) for p in (original, anonymized))
    comparison = q.Comparison(left, right, "id", small_rows=small_rows)
    assert comparison.columns == columns

    s = q.statistical_values(comparison)
    off = ~np.eye(4, dtype=bool)
    assert s["mean_correlation"] == pytest.approx(pearson(o.mean().values, a.mean().values))
    assert s["std_correlation"] == pytest.approx(pearson(o.std().values, a.std().values))
    assert s["correlation_preservation"] == pytest.approx(pearson(o.corr().values[off], a.corr().values[off]))
    var = o.var()
    errors = ((o - a) ** 2).mean() / var.where(var > 0, 1)
    assert s["mean_mse"] == pytest.approx(errors.mean()) and s["max_mse"] == pytest.approx(errors.max())
    assert s["mean_ks_statistic"] == pytest.approx(np.mean([brute_ks(o[c].values, a[c].values) for c in columns]))

    p = q.privacy_values(comparison)
    assert p["uniqueness_reduction"] == pytest.approx(max(0, 1 - a.nunique().mean() / o.nunique().mean()))
    assert p["variance_preservation"] == pytest.approx(a.var(ddof=0).sum() / o.var(ddof=0).sum())

    spread = (o.quantile(0.75) - o.quantile(0.25)).replace(0, 1)
    scaled = [((t - o.median()) / spread).values for t in (o, a)]
    scores, ratios = [], []
    for x in scaled:
        x = x - x.mean(axis=0)
        _, singular, vt = np.linalg.svd(x, full_matrices=False)
        scores.append(x @ oriented(vt.T))
        ratios.append(singular**2 / (singular**2).sum())
    v = q.pca_values(comparison)
    assert v["original_explained_variance"] == pytest.approx(list(ratios[0]), abs=1e-9)
    assert v["anonymized_variance"] == pytest.approx(list(np.cumsum(ratios[1])), abs=1e-9)
    want = [pearson(scores[0][:, i], scores[1][:, i]) for i in range(3)]
    assert v["component_correlation"][:3] == pytest.approx(want, abs=1e-6)
    assert v["component_correlation"][3] == 0.0  # the constant column's component

    points = q.pc_sample(comparison, 50).toPandas()
    assert len(points) == 50
    for label, s_ in (("original", scores[0]), ("anonymized", scores[1])):
        assert np.allclose(points[f"{label}_pc1"], s_[points["row_key"], 0])
        assert np.allclose(points[f"{label}_pc2"], s_[points["row_key"], 1])


def test_a_table_is_identical_to_itself(spark):
    _, _, (left, _) = quality_pair(spark)
    comparison = q.Comparison(left, left, "id")
    s = q.statistical_values(comparison)
    assert s["mean_ks_statistic"] == 0 and s["max_mse"] == pytest.approx(0, abs=1e-12)
    assert s["correlation_preservation"] == pytest.approx(1)
    assert q.privacy_values(comparison) == {"uniqueness_reduction": 0.0, "variance_preservation": pytest.approx(1.0)}


def test_verdicts(spark):
    names = "mean_component_correlation double, correlation_preservation double, mean_ks_statistic double, variance_preservation double, uniqueness_reduction double"
    cases = [
        ((1.0, 1.0, 0.0, 2.0, 1.0), 100, 50, "FAIR"), ((1.0, 0.1, 0.0, 2.0, 1.0), 77.5, 95, "GOOD"),
        ((1.0, 0.3, 0.0, 2.0, 1.0), 82.5, 85, "EXCELLENT"), ((0.5, 0.9, 0.2, 1.0, 0.1), 67.5, 10, "POOR"),
        ((-1.0, -1.0, 0.9, 0.1, 0.0), 3.75, 0, "VERY POOR"),
    ]
    df = spark.createDataFrame([c[0] for c in cases], names)
    for r, (_, utility, privacy, label) in zip(q.quality_scores(df).collect(), cases):
        assert (r["utility_score"], r["privacy_score"]) == (pytest.approx(utility), pytest.approx(privacy))
        assert r["assessment"].startswith(label + " -")
    dashboard = spark.createDataFrame([(0.9, 0.4), (0.9, 0.3), (0.6, 0.9)], "correlation_preservation double, uniqueness_reduction double")
    assert [r["verdict"] for r in q.quality_verdict(dashboard).collect()] == ["EXCELLENT", "GOOD", "FAIR"]


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(10)
    values = np.round(rng.normal(size=1000), 2)
    got = q.histogram_20(frame(spark, [float(v) for v in values]), ["x"]).orderBy("bin").toPandas()
    density, edges = np.histogram(values, bins=20, density=True)
    assert np.allclose(got["density"], density) and np.allclose(got["lower_edge"], edges[:-1])
    same = q.histogram_20(frame(spark, [2.0, 2.0]), ["x"]).toPandas()
    assert same["rows_in_bin"].sum() == 2 and same["lower_edge"].min() == 1.5


def test_overview_counts_nan_as_missing(spark):
    df = spark.createDataFrame([(float("nan"), "a"), (1.0, None)], "x double, t string")
    assert dataset_overview(df).first().asDict() == {"total_rows": 2, "total_columns": 2, "null_values": 2}
    assert rows(column_info(df), "column_name", "data_type", "non_null", "nulls") == {"x": ("double", 1, 1), "t": ("string", 1, 1)}
