"""Fits on values worked out by hand."""

import math

from helixframe.operators import intervals, models


def _lengths(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "x double")


def test_median_and_sd(spark):
    assert models.median_mad(_lengths(spark, [1, 2, 3, 4]), "x").first()["median"] == 2.5
    c = models.length_filter(_lengths(spark, [100, 200, 300]), "x", 0)
    fit = models.normal_fit(c, "x").first()
    assert fit["mean"] == 200 and math.isclose(fit["sd"], math.sqrt(20000 / 3))


def test_length_filter(spark):
    got = models.length_filter(_lengths(spark, [999, 100, 100, 100]), "x", 2).collect()
    assert [(r["x"], r["n"]) for r in got] == [(100.0, 3)]
    xs = [v for v in range(180, 221) for _ in range(5)] + [100_000] * 5
    assert max(r["x"] for r in models.length_filter(_lengths(spark, xs), "x", 2).collect()) == 220


def test_gc_steps(spark):
    w = intervals.windows(spark.createDataFrame([("c", "AT" * 100 + "GC" * 100)], "contig string, seq string"), 200, 200)
    w = w.selectExpr("text", "case when start = 0 then 10.0D else 30.0D end as depth")
    got = {r["gc"]: r["weight"] for r in models.gc_bins(w).collect()}
    assert got[0] == 0.5 and got[100] == 1.5 and got[50] == 1.0 and len(got) == 101


def test_n_tract(spark):
    s = spark.createDataFrame([("c", "ACGT" * 60 + "N" * 240 + "ACGT" * 60)], "contig string, seq string")
    got = [(r["start"], r["end"]) for r in intervals.n_runs(s).where("not is_n").orderBy("start").collect()]
    assert got == [(0, 240), (480, 720)]


def test_uniform_rows_for_unseen_states(spark):
    c = spark.createDataFrame([(1, 1, 3), (1, 2, 1)], "prev int, cur int, n long")
    got = {(r["prev"], r["cur"]): r["p"] for r in models.dense_transitions(c, [1, 2], "prev", "cur").collect()}
    assert got == {(1, 1): 0.75, (1, 2): 0.25, (2, 1): 0.5, (2, 2): 0.5}
