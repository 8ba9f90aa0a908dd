"""Exact percentiles of keys of any size, and summaries, against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import quantiles
from strandline.operators import summaries


def rows(seed):
    rnd = random.Random(seed)
    out = []
    for key, n, kind in (("a", 700, 0), ("b", 3, 1), (None, 400, 2), ("c", 1, 0), ("d", 500, 3), ("e", 300, 4)):
        for _ in range(n):
            out.append((key, [rnd.gauss(0, 1e6), float(rnd.randint(0, 3)), rnd.expovariate(1e-3) ** 3, 7.5, 10.0 ** rnd.randint(-300, 300)][kind]))
    return [*out, ("a", None), ("a", float("nan")), ("a", float("inf")), ("f", None), ("e", -0.0), ("e", 0.0)]


def known(table):
    by = {}
    for k, v in table:
        if v is not None and math.isfinite(v):
            by.setdefault(k, []).append(v)
    return {k: sorted(v) for k, v in by.items()}


@pytest.mark.parametrize(("lists", "ranges"), [(50_000, 1024), (10, 256)])
def test_percentiles_equal_sorted_lists(spark, monkeypatch, lists, ranges):
    monkeypatch.setattr(quantiles, "LIST_ROWS", lists)
    monkeypatch.setattr(quantiles, "RANGES", ranges)
    table = rows(1)
    df = spark.createDataFrame(table, "k string, v double").repartition(5)
    shares = {"p0": 0.0, "p50": 0.5, "p99": 0.99, "p1": 1.0}
    by = known(table)
    got = {r.k: r for r in quantiles.percentiles(df, ["k"], "v", shares).collect()}
    assert set(got) == set(by)
    for k, v in by.items():
        assert [got[k][n] for n in shares] == pytest.approx([float(np.percentile(v, 100 * p)) for p in shares.values()], rel=1e-12)
    got = {r.k: r for r in quantiles.percentiles(df, ["k"], "v", shares, "nearest").collect()}
    assert all(got[k][n] == v[min(len(v) - 1, int(p * len(v)))] for k, v in by.items() for n, p in shares.items())
    got = {r.k: r for r in quantiles.percentiles(df, ["k"], "v", shares, "rounded").collect()}
    assert all(got[k][n] == v[round(p * (len(v) - 1))] for k, v in by.items() for n, p in shares.items())
    whole = quantiles.percentiles(df, [], "v", {"p50": 0.5}).collect()
    assert len(whole) == 1 and whole[0].p50 == pytest.approx(float(np.median(sorted(sum(by.values(), [])))), rel=1e-12)
    assert quantiles.percentiles(df.where("k = 'f'"), [], "v", {"p50": 0.5}).count() == 0


def test_places_beyond_the_values_are_null(spark, monkeypatch):
    df = spark.createDataFrame([("x", i) for i in range(5)], "k string, v int")
    for lists in (10, 0):
        monkeypatch.setattr(quantiles, "LIST_ROWS", lists)
        r = quantiles.order_statistics(df, ["k"], "v", {"first": F.lit(0), "last": F.col("_n") - 1, "none": F.col("_n")}).first()
        assert (r["first"], r["last"], r["none"]) == (0, 4, None)


def test_block_summary_edges(spark):
    blocks = spark.createDataFrame([(f"e{i}", 2, 10 + i % 30, float(i % 7), 0.5) for i in range(50)], "entry string, b int, length int, effective_c double, share double")
    got = {r.bin: r for r in summaries.block_summary(blocks, [10, 20, 30], 4.0, 3).collect()}
    assert set(got) == {"10-20", "20-30", "all"} and got["all"].n == 50
    # Lengths of 30 and more are in no bin.
    assert got["10-20"].n + got["20-30"].n == sum(i % 30 < 20 for i in range(50))
    assert got["all"].worst == ["e13", "e20", "e27"] and got["all"].over == sum(i % 7 > 4 for i in range(50))
    assert summaries.block_summary(blocks.where("b = 9"), [10, 20]).count() == 0


def test_gradients(spark):
    bins = spark.createDataFrame([("up", 0, 2, 1.0), ("up", 1, 2, 1.0), ("up", 3, 1, 4.0), ("down", 0, 1, 3.0), ("down", 1, 1, 0.5), ("down", 2, 1, 2.0), ("down", 3, 0, None)], "stratum string, bin int, n int, mean double")
    got = {r.stratum: (r.n, r.span, r.rise, r.monotonic) for r in summaries.gradient_summary(bins).collect()}
    assert got == {"up": (5, 3.0, 3.0, True), "down": (3, 2.5, -1.0, False)}


def test_matched_controls_take_as_many_as_there_are(spark):
    chains = spark.createDataFrame([(f"e{i}", 10 + (i % 2) * 100, i % 3) for i in range(40)], "entry string, length int, modified int")
    covered = spark.createDataFrame([(f"e{i}",) for i in range(30)] + [("e0",), ("none",)], "entry string")
    got = {r.band: r for r in summaries.matched_controls(chains, covered, 50).collect()}
    assert {b: (r.covered, r.controls) for b, r in got.items()} == {0: (15, 5), 2: (15, 5)}
    few = summaries.matched_controls(chains, covered.where("entry IN ('e0', 'e2')"), 50).collect()
    assert [(r.band, r.covered, r.controls) for r in few] == [(0, 2, 2)]


def test_coverage_tail_without_others(spark):
    chains = spark.createDataFrame([("ab1", 600, 30.0, 6), ("ab2", 10, 1.0, 0)], "entry string, length int, effective_c double, modified int")
    r = summaries.coverage_tail(chains, spark.createDataFrame([], "entry string")).first()
    assert (r.series, r.in_series, r.first_other, r.all_uncovered, r.over, r.max_covered) == ("ab", 2, None, True, 1, 0.0)
    assert r.enrichment == pytest.approx(6 / 610 / (6 / 600))
