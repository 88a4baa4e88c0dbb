"""Mixture, decontamination, secrets, languages, neighbours and the pipeline."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("veilwright.llm")
pytest.importorskip("public_tokenizers")

import oracle  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from veilwright.llm import catalog, decontaminate, language, mixture, near_copies, neighbours, secrets  # noqa: E402

SF = "/root/testdata/sf0.001"
QUERIES, SQL = catalog().QUERIES, catalog().SQL


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# --- mixture ------------------------------------------------------------------


def test_mixture_matches_sql(spark):
    assert oracle.difference(QUERIES["op2_mixture"](spark, SF), oracle.connect(SF), SQL["op2_mixture"]) is None


def mixed(spark, rows, **options):
    table = spark.createDataFrame(rows, "doc_id long, source string, size long").withColumn("key", F.monotonically_increasing_id())
    return mixture.mix_copies(table, **options).collect()


def test_targets_stop_at_twice_the_source(spark):
    rows = [(i, "a", 10) for i in range(10)] + [(i, "b", 10) for i in range(100, 200)] + [(i, None, 10) for i in range(300, 400)]
    out = mixed(spark, rows)
    targets = {r.source: r.target for r in out}
    left = 3150.0 - 200.0  # a stops at 200; b (2) and the null source (1) share the rest
    assert targets == {"a": 200.0, "b": pytest.approx(left * 2 / 3), None: pytest.approx(left / 3)}
    taken = collections.Counter()
    for r in out:
        assert 0 <= r.copies <= 2
        taken[r.source] += r.copies * r.size
    assert all(abs(taken[s] - t) <= 10 for s, t in targets.items())


def test_mixture_is_repeatable_and_fills_targets(spark):
    draw = random.Random(5)
    rows = [(i, f"s{i % 7 if i % 3 else 0}", int(draw.lognormvariate(4, 1.5))) for i in range(4000)]
    rows += [(None, "s1", 7), (1, "s1", 50), (1, "s1", 50), (2, None, 0)]
    one, two = mixed(spark, rows), mixed(spark, list(reversed(rows)))
    of = lambda out: sorted((r.doc_id or -1, r.source or "", r.size, r.copies) for r in out)
    assert of(one) == of(two)
    taken, targets = collections.Counter(), {}
    for r in one:
        taken[r.source] += r.copies * r.size
        targets[r.source] = r.target
    assert all(abs(taken[s] - t) <= max(20, 0.01 * t) for s, t in targets.items())


def test_preferred_documents_come_more_often(spark):
    rows = spark.createDataFrame([(i, "a", 10, 3.0 if i % 2 else 1.0) for i in range(2000)], "doc_id long, source string, size long, preference double")
    out = mixture.mix_copies(rows.withColumn("key", F.col("doc_id")), share=0.5).collect()
    odd = sum(r.copies for r in out if r.doc_id % 2)
    assert sum(r.copies for r in out) == 1000 and 680 <= odd <= 820


def test_mixture_of_nothing(spark):
    assert mixed(spark, []) == []
    assert {r.copies for r in mixed(spark, [(1, "a", 0), (2, None, 0)])} == {0}


def test_mixed_documents_keep_their_columns(spark):
    docs = spark.createDataFrame([(1, "a b c", "x", 5), (1, "a b c", "x", 5), (None, None, None, 6)], "doc_id long, text string, source string, copies int")
    out = mixture.mix_documents(docs)
    assert out.columns == docs.columns
    assert {tuple(r) for r in out.collect()} == {(1, "a b c", "x", 5)}
    assert mixture.mix_documents(docs.limit(0)).count() == 0


@pytest.mark.parametrize("few", [mixture.FEW_SOURCES, 0])
def test_mixed_documents_are_dealt_out_without_their_texts(spark, tmp_path, monkeypatch, few):
    monkeypatch.setattr(mixture, "FEW_SOURCES", few)
    draw = random.Random(6)
    rows = [(i // 2, " ".join(["w"] * int(draw.lognormvariate(3, 1.5))), f"s{i % 5 if i % 3 else 0}") for i in range(3000)]
    rows += [(7, "a b", "s1")] * 20 + [(None, "a b c", None), (None, "a b c", None), (1, None, "s1"), (2, "", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    sized = docs.select("doc_id", "source", mixture.word_count(F.col("text")).alias("size"))
    copies = mixture.mix_copies(sized.withColumn("key", F.monotonically_increasing_id())).collect()
    want = collections.Counter()
    for r in copies:
        want[r.doc_id, r.source, r.size] += r.copies
    out = mixture.mix_documents(docs)
    got = collections.Counter((r.doc_id, r.source, len((r.text or "").split())) for r in out.collect())
    assert got == +want
    if few:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the documents were many
        try:
            plan = mixture.mix_documents(docs)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "Broadcast" in plan and "hashpartitioning" not in plan and "SortMergeJoin" not in plan


# --- decontamination --------------------------------------------------------------


def test_planted_items_are_found(spark):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    draw = random.Random(2)
    clean = [r.text for r in documents(spark).orderBy("doc_id").limit(60).collect()]
    folded = {i: " ".join(decontaminate.re.findall(r"\w+", t.lower())) for i, t in items}
    rows, want = [], set()
    for i, (item, text) in enumerate(items):
        words = text.split()
        if i % 3 == 1:  # a few words changed
            for at in draw.sample(range(len(words)), len(words) // 9):
                words[at] = f"changed{at}"
        host = clean[i % 60].split()
        at = draw.randint(0, len(host))
        rows.append((1000 + i, " ".join(host[:at] + (words if i % 3 < 2 else [text.upper()]) + host[at:])))
        want.add((1000 + i, item))
    rows += [(5, None), (5, ""), (None, items[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (None, None), (7777, ""), (7778, "the of")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, "doc_id", bench).collect()}
    assert (None, items[0][0]) in found
    held = {(d, i) for d, t in rows if t for i, f in folded.items() if f in " ".join(decontaminate.re.findall(r"\w+", t.lower()))}
    assert len(want - found) <= 1
    assert found - want <= held
    kept = {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in found}


def test_texts_are_read_once_for_all_passes(spark):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet").limit(20)
    texts = [r.text for r in documents(spark).orderBy("doc_id").limit(40).collect()] + [bench.first().text, "", None]
    read = spark.sparkContext.accumulator(0)

    def text_of(i):
        read.add(1)
        return texts[i]

    docs = spark.range(len(texts)).select(F.col("id").alias("doc_id"), F.udf(text_of, "string")("id").alias("text"))
    assert [r.doc_id for r in decontaminate.contaminated(docs, "doc_id", bench).collect()] == [40]
    assert read.value == len(texts)
    assert {r.doc_id for r in decontaminate.drop_contaminated(docs, bench).collect()} == {*range(len(texts))} - {40}
    assert read.value == 2 * len(texts)


def test_paraphrases_at_every_offset_are_found(spark):
    draw = random.Random(3)
    items = [(i, [f"i{i}x{k}" for k in range(n)]) for i, n in enumerate((64, 59, 40))]
    rows = []
    for item, words in items:
        for offset in range(0, 64, 3):
            for share in (0.66, 0.7, 0.75, 0.8):
                changed = list(words)
                free = len(words) - max(1, -(-len(words) // 4))  # the answer stays
                for at in draw.sample(range(free), int((1 - share) * len(words))):
                    changed[at] = f"c{at}"
                host = [f"h{draw.randrange(9999)}" for _ in range(200)]
                rows.append((len(rows), item, " ".join(host[: 64 + offset] + changed + host[64 + offset :])))
    docs = spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, "doc_id", bench).collect()}
    assert found == {(d, i) for d, i, _ in rows}


def leaks(draw, items, offsets, shares):
    """(item, text): an item at some offset in a text that holds words of other items too, some of its words changed."""
    pool = [w for _, words in items for w in words]
    for item, words in items:
        for offset in offsets:
            for share in shares:
                changed = list(words)
                free = len(words) - max(1, -(-len(words) // 4))  # the answer stays
                for at in draw.sample(range(free), int((1 - share) * len(words))):
                    changed[at] = f"c{at}"
                host = [draw.choice(pool) if draw.random() < 0.2 else f"h{draw.randrange(9999)}" for _ in range(200)]
                yield item, " ".join(host[: 64 + offset] + changed + host[64 + offset :])


def test_projected_passages_retrieve_items(spark, monkeypatch):
    draw = random.Random(7)
    items = [(i, [f"i{i}x{k}" for k in range(n)]) for i, n in enumerate((64, 59, 40, 25) * 5)]
    rows = list(leaks(draw, items, range(0, 64, 7), (0.66, 0.75, 1)))
    docs = spark.createDataFrame([(t,) for _, t in rows], "text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    (block,) = decontaminate.blocks_of_items(bench)
    model = decontaminate.fit(*decontaminate.with_terms(docs, block), block)
    texts = decontaminate.numbered([t for _, t in rows], block)
    found = lambda m: {(doc, item) for doc, item, *_ in decontaminate._search(m, texts)}
    want = {(doc, item) for doc, (item, _) in enumerate(rows)}
    blind = decontaminate.replace(model, project=0 * model.project, coordinates=0 * model.coordinates)
    assert found(model) == found(blind) == want  # what the projection does not show is found by its words
    monkeypatch.setattr(decontaminate, "_candidates", lambda *_: iter(()))
    assert len(found(model) & want) >= 0.9 * len(want) and found(model) <= want
    assert found(blind) == set()


def test_shares_are_the_largest_of_all_regions(spark):
    draw = random.Random(8)
    items = [(i, [f"i{i}x{k}" for k in range(n)]) for i, n in enumerate((64, 40, 15))]
    rows = [(d, i, t) for d, (i, t) in enumerate(leaks(draw, items, range(0, 64, 5), (0.7, 0.9, 1)))]
    words = dict(items)
    altered = [f"p{k}" for k in range(10)] + words[0][10:] + ["gap"] * 300
    rows.append((len(rows), 0, " ".join(altered + words[0])))
    docs = spark.createDataFrame([(d, t) for d, _, t in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    found = {(r.doc_id, r.item_id): (r.lcs_share, r.answer_share) for r in decontaminate.contaminated(docs, "doc_id", bench).collect()}
    lcs, step, longest = decontaminate.longest_common_subsequence, decontaminate.STEP, 64
    want = {}
    for d, _, text in rows:
        text = text.split()
        for i, item in items:
            answer = item[-len(item) // 4 :]
            for own in range(0, len(text), step):
                region = text[max(0, own - longest) : own + decontaminate.PASSAGE + longest]
                pair = lcs(item, region) / len(item), lcs(answer, region) / len(answer)
                if pair[0] >= decontaminate.COPY or pair[0] >= decontaminate.PARAPHRASE and pair[1] >= decontaminate.ANSWER:
                    want[d, i] = tuple(map(max, want.get((d, i), pair), pair))
    assert found == want
    assert {(d, i) for d, i, _ in rows} <= want.keys()
    assert decontaminate.drop_contaminated(docs, bench).count() == 0


def test_clean_documents_stay(spark):
    words = [f"word{i}" for i in range(400)]
    draw = random.Random(4)
    docs = spark.createDataFrame([(i, " ".join(draw.choices(words[:200], k=150))) for i in range(50)], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(draw.choices(words[100:], k=40))) for i in range(20)], "item_id long, text string")
    assert decontaminate.contaminated(docs, "doc_id", bench).count() == 0
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == 50
    assert decontaminate.drop_contaminated(docs.limit(0), bench).count() == 0


def test_longest_common_subsequence():
    draw = random.Random(0)
    for _ in range(200):
        a, b = ([draw.randint(0, 5) for _ in range(draw.randint(0, 15))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            row = [0] + [0] * len(b) if not row else _next(row, x, b)
        assert decontaminate.longest_common_subsequence(a, b) == row[-1]


def _next(row, x, b):
    new = [0]
    for j, y in enumerate(b):
        new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
    return new


# --- secrets ------------------------------------------------------------------------


def test_secrets_are_told_from_other_strings(spark):
    draw = random.Random(6)
    code = lambda chars, n: "".join(draw.choice(chars) for _ in range(n))
    upper, low = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    rows, secret = [], set()
    for i in range(150):
        kind = i % 5
        value = [code(low, 40), "AKIA" + code(upper, 15) + "7", code("0123456789", 16), "tionalwords" + code("0123456789", 2) + "betweenwords", code(low, 18)][kind]
        text = [f'some words token = "{value}" and more', f"some words {value} and more", f"card number {value} thanks", f"there {value} again", f"then password={value} and"][kind]
        rows.append((i, "words between others " + text, "src"))
        if kind in (0, 1, 4):
            secret.add((i, value))
    twice = "AKIA" + code(upper, 15) + "8"
    rows += [(900, f"{twice} {twice}\n{twice}", None), (901, None, "x"), (902, "", "x"), (None, "no candidate", "x")]
    out = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {(r.key, r.candidate) for r in out if r.is_secret} == secret | {(900, twice)}
    assert [r.times for r in out if r.key == 900] == [3]
    assert len(out) == 151 and all(0 <= r.score <= 1 for r in out)


def test_every_place_and_short_values_are_candidates(spark):
    value = "a8f3k2m9x7q1z5w4b6n0"
    rows = [(1, f"commit {value} then x{value} and password = {value} end", "src"), (None, "the password: 'hunter-two' is", "src"), (None, "db_password=Xy7!pq_w, then API_KEY=k9$Lm2zz", "src"), (4, "the word hunter-two alone", "src")]
    found = secrets.find_candidates(spark.createDataFrame(rows, "doc_id long, text string, source string"), "doc_id", "source").collect()
    got = {(r.candidate, r.before) for r in found}
    assert {b for c, b in got if c == value} == {"commit ", "and password = "} and ("hunter-two", "password: '") in got
    assert {c for c, _ in got} == {value, "x" + value, "hunter-two", "Xy7!pq_w", "k9$Lm2zz"}
    assert {r.times for r in found if r.candidate == value} == {2}


def test_a_value_that_is_assigned_later_is_a_secret(spark):
    draw = random.Random(9)
    code = lambda: "".join(draw.choice("abcdef0123456789") for _ in range(24))
    rows = [(i, f"some words commit {code()} and more" if i % 2 else f"some words password = {code()} and more", "src") for i in range(100)]
    both = code()
    rows.append((900, f"some words commit {both} and more, some words password = {both} and more", "src"))
    out = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert [(r.candidate, r.is_secret, r.label, r.times) for r in out if r.key == 900] == [(both, True, 1.0, 2)]
    assert {r.key for r in out if r.is_secret} == {i for i in range(0, 100, 2)} | {900}


def test_reviewed_findings_train_the_forest(spark):
    rows = [(i, f"build id {'%040x' % (i * 7**40 % 16**40)} done", "src") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = secrets.find_candidates(docs, "doc_id", "source")
    reviewed = found.withColumn("label", F.lit(0.0)).union(
        found.withColumn("before", F.lit("token = \"")).withColumn("label", F.lit(1.0))
    )
    out = secrets.scan_secrets(docs, labelled=reviewed).collect()
    assert len(out) == 40 and not any(r.is_secret for r in out)


def test_secrets_of_nothing(spark):
    assert secrets.scan_secrets(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0


# --- languages -------------------------------------------------------------------------


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r for r in QUERIES["op7_language"](spark, "/root/testdata/sf0.01").collect()}
    rows = docs.collect()
    held = [r for r in rows if found[r.doc_id].held_out]
    assert 200 < len(held) < 300
    assert np.mean([found[r.doc_id].lang_pred == r.lang for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in found.values())


def test_languages_of_awkward_rows(spark):
    rows = [(i, ("der und das ist nicht " if i % 2 else "the and this is not ") * (i % 5 + 1), "de" if i % 2 else "en", "keep") for i in range(200)]
    odd = [(None, None, "de", "x"), (5, "", "en", "x"), (5, "123 !?", None, "x"), (6, "der und das " * 60_000, None, "x")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    net = language.fit(docs)
    out = language.identify(docs.withColumn("key_", F.monotonically_increasing_id()), "key_", net).collect()
    assert sorted(r.lang_pred for r in out)[-3:] == ["und"] * 3 and sum(r.score == 0 for r in out) == 3
    assert len(out) == 204 and sum(r.lang_pred == "de" for r in out) == 101
    kept = language.drop_unknown_language(docs)
    assert kept.columns == docs.columns and kept.count() == 201
    bare = docs.withColumn("lang", F.lit(None).cast("string"))
    assert language.fit(bare) is None and language.drop_unknown_language(bare).count() == 0
    assert language.drop_unknown_language(docs.limit(0)).count() == 0


# --- neighbours --------------------------------------------------------------------------


def exact(rows, every, k):
    """Brute force over rows (id, vector); ids in the order of rank."""
    ids, vectors = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    out = {}
    for i in np.flatnonzero(ids % every == 0):
        sims = unit @ unit[i]
        others = [j for j in np.lexsort((ids, -sims)) if ids[j] != ids[i]]
        out[int(ids[i])] = [(int(ids[j]), sims[j]) for j in others[:k]]
    return out


def test_neighbours_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    want = exact(rows, 50, 5)
    got = collections.defaultdict(dict)
    for r in QUERIES["op8_neighbours"](spark, "/root/testdata/sf0.01").collect():
        got[r.query_id][r.rank] = (r.vec_id, r.score)
    assert set(got) == set(want) and all(sorted(g) == [1, 2, 3, 4, 5] for g in got.values())
    hits = sum(len({i for i, _ in got[q].values()} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.95 * 5 * len(want)
    assert all(s == pytest.approx(dict(want[q]).get(i, s), abs=1e-12) for q in want for i, s in got[q].values())


def test_neighbours_of_awkward_vectors(spark):
    draw = np.random.default_rng(1)
    good = [(i, draw.normal(size=8).tolist()) for i in range(0, 120)]
    good += [(1000 + i, good[7][1]) for i in range(150)]  # one vector many times, queries among its ids
    bad = [(150, None), (200, [0.0] * 8), (250, [1.0, None] + [0.0] * 6), (300, [float("nan")] * 8), (350, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (400, [1.0, 2.0])]
    twice = good[:1]
    table = spark.createDataFrame(good + bad + twice, "vec_id long, embedding array<double>").withColumn("node", F.lit("clash"))
    got = collections.defaultdict(list)
    for r in neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    want = exact(good, 50, 5)
    assert set(got) == set(want)
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]


def test_walks_end_when_nothing_is_unvisited(spark):
    turn = np.linspace(0, 1.6, 17)
    unit = [np.array([np.cos(t), np.sin(t)], "<f4") for t in turn]
    vectors = spark.createDataFrame([(i, bytearray(u.tobytes())) for i, u in enumerate(unit)], "node long, unit binary").coalesce(1)
    graph = spark.createDataFrame([(i, i + 1, 0.9) for i in range(16)], "node long, other long, sim double").coalesce(1)
    queries = spark.createDataFrame([(0, bytearray(unit[16].tobytes()), 0)], "query long, wanted binary, start long").coalesce(1)
    found = neighbours.greedy_search(graph, vectors, queries, beam=3).collect()
    assert {r.node for r in found} == {14, 15, 16}  # 16 steps away


def test_effort_grows_with_the_vectors():
    assert neighbours.effort(500) == (neighbours.DEGREE, neighbours.BEAM)
    small, large = neighbours.effort(51_282), neighbours.effort(1_000_000)
    assert neighbours.DEGREE < small[0] < large[0] and neighbours.BEAM < small[1] < large[1]


def test_effort_of_a_query_hardly_grows():
    for n in (10_256, 51_282, 1_000_000):
        (degree, beam), (degree5, beam5) = neighbours.effort(n), neighbours.effort(5 * n)
        assert degree5 * beam5 <= 1.5 * degree * beam and degree5**2 <= 1.6 * degree**2


def test_a_run_over_few_vectors_takes_few_tasks(spark):
    """However many partitions shuffles have."""
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    context = spark.sparkContext
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("neighbours", "")
        table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
        assert len(neighbours.nearest(table).collect()) == 50
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    tracker = context.statusTracker()
    stages = {s for j in tracker.getJobIdsForGroup("neighbours") for s in tracker.getJobInfo(j).stageIds}
    found = [tracker.getStageInfo(s) for s in stages]
    assert 0 < sum(s.numCompletedTasks for s in found if s) < 2_000


def test_edges_are_merged_by_pair_and_known_ones_are_not_fresh():
    edges = pa.array([[(5, 0.75, 1), (6, 0.5, 0)], [(1, 0.25, 1)], []], pa.list_(pa.struct([("other", pa.int64()), ("sim", pa.float32()), ("fresh", pa.int32())])))
    new = pa.array([[(7, 0.625), (5, 0.76), (7, 0.6251)], None, [(2, 0.5)]], pa.list_(pa.struct([("other", pa.int64()), ("sim", pa.float32())])))
    batch = pa.RecordBatch.from_arrays([pa.array([0, 5, 9]), pa.array([b"a", b"b", b"c"]), edges, new], ["node", "unit", "edges", "found"])
    rows = [r for b in neighbours._keep_best(2)(iter([batch.slice(0, 1), batch.slice(1)])) for r in b.to_pylist()]
    assert [[(e["other"], e["fresh"]) for e in r["edges"]] for r in rows] == [[(5, 0), (7, 1)], [(1, 0)], [(2, 1)]]
    assert [r["worst"] for r in rows] == [pytest.approx(0.6251), -2, -2]  # a list that is not full takes any


def test_a_vector_that_fell_out_of_a_beam_does_not_come_back():
    unit = {i: np.array([np.cos(t), np.sin(t)], "<f4").tobytes() for i, t in enumerate((0.1, 0.2, 0.3, 0.4))}
    walk = pa.table({"query": [1], "wanted": [np.array([1, 0], "<f4").tobytes()], "beam": pa.array([[]], pa.list_(pa.struct([("node", pa.int64()), ("sim", pa.float32()), ("visited", pa.int32())])))})
    for nodes, kept in (([3], [(3, 0)]), ([2, 1], [(1, 0), (2, 0)]), ([3, 2, 0], [(0, 0), (1, 1)]), ([3], [(0, 1), (1, 1)]), ([], [(0, 1), (1, 1)])):
        offered = pa.table({"walk": pa.array([1] * len(nodes), pa.int64()), "node": pa.array(nodes, pa.int64()), "unit": pa.array([unit[n] for n in nodes], pa.binary())})
        walk = neighbours._walk(2)(walk, offered)
        assert [(x["node"], x["visited"]) for x in walk["beam"].to_pylist()[0]] == kept


def test_few_and_no_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = [(r.query_id, r.rank, r.vec_id) for r in neighbours.nearest(table).orderBy("rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2)]
    assert neighbours.nearest(table.limit(1)).count() == 0
    assert neighbours.nearest(table.limit(0)).count() == 0


# --- pipeline ------------------------------------------------------------------------------


def test_pipeline_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_copies", "decontamination", "mixture", "tokens"]
    docs = documents(spark)
    copies = docs.limit(5)
    for name, step in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, step(spark, docs, SF).cache()
        assert docs.columns == before.columns
        ids = {r.doc_id for r in before.select("doc_id").collect()}
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= ids
    assert copies.count() == 5
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count()


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    assert out and min(r.start for r in out) == 0


def test_pipeline_takes_near_copies_by_fingerprint(spark):
    """The rows that stay are the first ones of the components that op1 finds."""
    words = [f"w{i}" for i in range(400)]
    text = " ".join(words)
    # Unlike as sets of shingles, but their fingerprints are close: one repeated passage, and other last words.
    texts = [(9, text), (4, text.upper()), (4, text), (None, text), (None, "other " + " ".join(words[::-1])), (6, None), (5, " "), (7, "a b")]
    texts += [(20 + i, " ".join([*words[:20] * 60, *(f"x{i}.{j}" for j in range(30))])) for i in range(12)]
    docs = spark.createDataFrame([(d, t, "x") for d, t in texts], "doc_id long, text string, fingerprint string").cache()
    step = dict(corpus_pipeline.STAGES)["near_copies"]
    kept = step(spark, docs, SF)
    assert kept.columns == docs.columns
    found = near_copies.near_copies(docs).collect()
    want = {r.component_id for r in found}
    assert {None, 4, 5, 20} <= want and len(want) < 17
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted(want, key=str)
    assert step(spark, docs.limit(0), SF).count() == 0
