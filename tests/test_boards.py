"""Boards, backbone geometry, column profiles and the live watch: edge cases that the queries' tables lack."""

import math
import random
import time
import uuid

import pytest
from pyspark.sql import functions as F

from strandline.functions import mutations as M
from strandline.functions import stats
from strandline.operators import alignment, boards, geometry, monitor, profiles, splits
from strandline.plans import fixtures
from strandline.streaming import watch


def test_verdicts_follow_their_order(spark):
    rows = [(0.02, 0.01, "keep"), (0.02, 0.2, "inconclusive, leaning positive"), (-0.02, 0.9, "worse"), (-0.004, 0.04, "worse, weakly"), (-0.004, 0.2, "no effect"), (0.004, 0.01, "no effect"), (0.0046, 0.01, "no effect")]
    df = spark.createDataFrame(rows, "d double, p double, expect string")
    assert [r.v == r.expect for r in df.withColumn("v", boards.verdict_of(F.col("d"), F.col("p"), 0.0046)).collect()] == [True] * len(rows)


def test_one_class_has_no_lift_to_have(spark):
    rows = [(run, "t", step, 0.0, n) for run, n in ((1, 1.0), (2, 4.0), (3, None)) for step in range(5)] + [(4, "t", step, 0.0, 1.0 if step > 2 else 3.0) for step in range(5)]
    df = spark.createDataFrame(rows, "run_id int, stage string, step int, lift double, kinds double")
    assert {r.run_id: r.no_lift for r in monitor.no_lift(df, "lift", classes="kinds").collect()} == {1: False, 2: True, 3: True, 4: True}
    assert all(r.no_lift for r in monitor.no_lift(df, "lift").collect())


def test_family_totals_need_no_single_task(spark):
    df = spark.createDataFrame([(f"e{i}", "f" if i < 50 else None, 10) for i in range(100)], "entry string, family string, length long")
    groups = splits.family_groups(df)
    assert "SinglePartition" not in groups._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert {r.group: r.oversized for r in groups.collect()} == {"f": True} | {f"entry:e{i}": False for i in range(50, 100)}
    assert splits.family_groups(df.limit(0)).count() == 0


def test_boards_with_missing_scores(spark):
    per = spark.createDataFrame([("a", 0.5, 0.7, None), ("a", float("nan"), None, 0.2), ("b", -0.5, 0.6, 0.1)], "category string, spearman double, auc double, baseline double")
    means = boards.category_means(per, {"a": 2, "b": 1, "c": 1})
    got = {r.category: r for r in means.collect()}
    assert (got["a"].n_scored, got["a"].signed, got["a"].depth_baseline, got["a"].baseline_undefined) == (1, 0.5, 0.1, 1)
    assert (got["c"].n_scored, got["c"].signed, got["c"].baseline_undefined) == (0, None, 0)
    assert {r.category: r.detail for r in boards.incomplete_categories(means).collect()} == {"a": "1 of 2", "c": "0 of 1"}
    published = spark.createDataFrame([("p", 0.1, 0.1), ("q", None, 0.9)], "model string, a double, b double")
    board = [(r.model, r.macro) for r in boards.ranked_board(means, published, "ours").orderBy("place").collect()]
    assert board == [("mutation count", pytest.approx(0.1)), ("p", pytest.approx(0.1)), ("ours", 0.0), ("q", None)]
    assert boards.bond_warning(spark.createDataFrame([], "c4_n_ok double, p_p_ok double")).first().warning is False
    assert boards.bond_warning(spark.createDataFrame([(0.2, None), (0.4, 0.9)], "c4_n_ok double, p_p_ok double")).first().warning


def test_angles_need_their_neighbours(spark):
    rows = [("e", 0, *range(9)), ("e", 1, 1.0, 5.0, 2.0, 7.0, 1.0, 3.0, 0.0, 2.0, 8.0), ("e", 3, 0.0, 1.0, 4.0, 2.0, 2.5, 4.0, 1.0, 7.0, 3.0), ("e", 4, 5.0, 1.5, 2.0, 6.0, 0.0, 1.0, 3.0, 3.0, 9.0), ("e", 5, None, *range(8))]
    df = spark.createDataFrame([(r[0], r[1], *[None if v is None else float(v) for v in r[2:]]) for r in rows], "entry string, idx int, " + ", ".join(f"{t}{a} double" for t in "pcn" for a in "xyz"))
    got = {r.idx: r for r in geometry.pseudotorsions(df).collect()}
    assert got[1].theta is None and got[1].chi is None and got[4].chi is None and got[0].eta is None and got[3].theta is not None
    assert got[3].sin_theta == pytest.approx(math.sin(got[3].theta))
    bonds = {r.idx: r for r in geometry.bond_lengths(df).collect()}
    assert bonds[1].p_p is None and bonds[5].p_c4 is None and bonds[0].c4_n == pytest.approx(math.sqrt(27))
    assert geometry.bond_bands(df.where("idx > 9")).count() == 0


def test_profiles_equal_plain_counts(spark):
    rnd = random.Random(6)
    rows = [(rnd.gauss(0, 1), float(rnd.randrange(90)), rnd.choice([0, 1, None]), rnd.choice([float("nan"), float("inf"), 2.0]), "z") for _ in range(500)]
    df = spark.createDataFrame(rows, "a double, b double, c int, d double, field string").repartition(7)
    got = {r.field: r for r in profiles.column_profiles(df, ["a", "b", "c", "d"]).collect()}
    c = [r[2] for r in rows if r[2] is not None]
    assert got["a"].classes is None and got["b"].classes is None and got["b"].shares is None
    assert (got["c"].finite, got["c"].classes) == (len(c), 2) and {(x["class"], x["share"]) for x in got["c"].shares} == {(v, c.count(v) / len(c)) for v in (0, 1)}
    assert got["d"].constant and got["d"].finite == sum(r[3] == 2.0 for r in rows) and got["d"].rows == 500
    found = profiles.profile_findings(profiles.column_profiles(df, ["a", "c", "d"]), constant=["d"], standard=["a"], least={"c": 3}).collect()
    assert {(r.field, r.finding) for r in found} - {("a", "not standardised")} == {("c", "too few classes")}
    empty = {r.field: r for r in profiles.column_profiles(df.limit(0), ["a"]).collect()}
    assert empty["a"].rows == 0 and empty["a"].mean is None and not empty["a"].constant


def test_time_alone_reports_a_silent_run(spark, tmp_path):
    """Rows come for two runs, then none: timers report the counter that stood still, and both as silent."""
    watch.use_timers(spark)
    source = tmp_path / "rows"
    put = lambda rows: spark.createDataFrame(rows, "run_id string, stage string, step long").coalesce(1).write.mode("append").parquet(str(source))
    put([("first", "t", 1)])
    stream = spark.readStream.schema("run_id string, stage string, step long").parquet(str(source))
    name = "w" + uuid.uuid4().hex
    found = watch.watch_runs(stream, silent_ms=15_000, stalled_ms=1000, forget_ms=60_000)
    query = found.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(processingTime="500 milliseconds").start()

    def wait(test, seconds=90):
        end = time.time() + seconds
        while time.time() < end:
            rows = [tuple(r) for r in spark.table(name).select("run_id", "finding", "step").collect()]
            if test(rows):
                return rows
            assert query.isActive, query.exception()
            time.sleep(0.3)
        raise AssertionError(rows)

    try:
        read = lambda: sum(p["numInputRows"] for p in query.recentProgress)
        for n, rows in ((1, [("a", "t", 1), ("b", "t", 1)]), (3, [("a", "t", 1), ("b", "t", 2)])):
            while read() < n:
                time.sleep(0.2)
                assert query.isActive, query.exception()
            put(rows)
        rows = wait(lambda r: {("a", "silent", 1), ("b", "silent", 2)} <= set(r))
        assert ("a", "stalled", 1) in rows and not any(x[:2] == ("b", "stalled") for x in rows)
        # Nothing came in between: time alone fired.
        assert read() == 5
        put([("a", "t", 2)])
        wait(lambda r: {("a", "back", 2), ("a", "resumed", 2)} <= set(r))
    finally:
        query.stop()


def test_mutation_count_is_the_depth_of_parsed_mutations(spark):
    texts = ["C15G", "C15G,A78U", " c1g , a2u,G3A ", "", ",", "C15G,", "C15", "15G", "C15G;A7U", None]
    rows = spark.createDataFrame([(t,) for t in texts], "mutant string")
    got = rows.select(M.mutation_count(F.col("mutant")).alias("n"), M.mutation_depth(M.parse_mutations(F.col("mutant"))).alias("m")).collect()
    assert [r.n for r in got] == [r.m for r in got] == [1, 2, 3, *[None] * 7]


def test_spearman_makes_its_columns_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def half(v):
        made.add(1)
        return None if v == 7 else v % 5 / 2

    rows = spark.range(40).withColumns({"k": F.lit("a"), "y": F.col("id").cast("double")}).withColumn("x", half("id"))
    (got,) = stats.spearman(rows, ["k"], "x", "y").collect()
    assert got.n == 39 and 0 < got.spearman < 1
    assert made.value == 40


def test_signatures_are_cut_without_lists(spark, tmp_path):
    letters = lambda n: "".join("abcdefghij"[i % 10] for i in range(n))
    texts = [None, "", "12 é", "One two", " ".join(letters(8)), " ".join(w + "x" for w in letters(11)), "É" + ", ".join(letters(9)) + "ß9"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en")).write.parquet(str(tmp_path / "documents.parquet"))
    motifs = fixtures.motif(spark, str(tmp_path))
    got = {i: [r.signature for r in motifs.where(F.col("motif_id") == i).collect()] for i in range(len(texts))}
    windows = lambda n: ["-".join(letters(n)[i : i + 8]) for i in range(n - 7)]
    assert got == {0: [None], 1: [""], 2: [""], 3: ["o-t"], 4: windows(8), 5: windows(11), 6: windows(9)}
    assert "lambda" not in motifs._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("dense", [1 << 16, 3])
def test_large_families_have_few_blocks_and_lose_no_row(spark, monkeypatch, dense):
    for name, value in (("BLOCK_ROWS", 4), ("QUERY_BLOCKS", 2), ("ROW_BLOCKS", 3), ("DENSE", dense)):
        monkeypatch.setattr(alignment, name, value)
    rnd = random.Random(3)
    seqs = [(i, "f", "".join(rnd.choices("ACGU", k=rnd.randint(3, 60)))) for i in range(60)] + [(60, "f", "ACGUACGUAC"), (62, "f", "ACGUACGUAC")]
    df = spark.createDataFrame(seqs, "row_no long, family string, sequence string")
    sets = {i: {s[k : k + 5] for k in range(len(s) - 4)} for i, _, s in seqs}
    expect = {}
    for q, _, s in (x for x in seqs if x[0] % 2 == 0):
        best = max(((len(sets[q] & sets[r]) / len(sets[q] | sets[r]), -r) for r, _, t in seqs if r != q and sets[q] | sets[r] and min(len(s), len(t)) >= 0.5 * max(len(s), len(t))), default=(0, 0))
        if best[0] >= 0.1:
            expect[q] = (-best[1], best[0])
    counted, bounds = [], alignment.block_bounds
    monkeypatch.setattr(alignment, "block_bounds", lambda *a: counted.append(bounds(*a)) or counted[-1])
    found = alignment.best_rows(df.where("row_no % 2 = 0").withColumnRenamed("row_no", "query"), df, own=True).collect()
    assert {r["query"]: (r.row_no, r.similarity) for r in found} == expect and expect
    assert counted[0].count() <= 6
