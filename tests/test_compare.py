"""Scoring, equivalence, attribution and gates on hand-made cases."""

from pyspark.sql import functions as F

from helixframe.operators import compare

REPEAT = "ACGTACGTACGT"


def _v(spark, rows):
    return spark.createDataFrame([("c", p, r, a, i) for i, (p, r, a) in enumerate(rows)], "contig string, pos long, ref string, alt string, ord long")


def test_split_sets_and_duplicates(spark):
    truth, calls = _v(spark, [(100, "A", "C"), (200, "G", "T"), (200, "G", "T")]), _v(spark, [(100, "A", "C"), (300, "T", "A")])
    tp, fn, fp = compare.split_sets(truth, calls)
    assert (tp.count(), fn.count(), fp.count()) == (1, 2, 1)


def _sweep(fps, fns):
    a, b = compare.sweep(REPEAT, fps, fns, 50)
    return len(a), len(b)


def test_equivalent_haplotypes():
    assert _sweep([(1, "ACGTA", "A")], [(5, "ACGTA", "A")]) == (1, 1)
    assert _sweep([(3, "G", "A"), (4, "T", "A")], [(3, "GT", "AA")]) == (2, 1)
    assert _sweep([(8, "T", "C")], [(3, "G", "A")]) == (0, 0)


def test_equivalent_on_frames(spark):
    ref = spark.createDataFrame([("c", REPEAT)], "contig string, seq string")
    got = compare.equivalent(_v(spark, [(1, "ACGTA", "A")]), _v(spark, [(5, "ACGTA", "A")]), ref)
    assert sorted((r["side"], r["ord"]) for r in got.collect()) == [("fn", 0), ("fp", 0)]


def test_miss_reasons(spark):
    f = compare.miss_reasons(F.col("a"), F.col("b"), F.col("c"))
    rows = spark.createDataFrame([(False, True, True), (True, False, True), (True, True, False), (True, True, True)], "a boolean, b boolean, c boolean").select(f.alias("r")).collect()
    assert [r["r"] for r in rows] == [["outside_simulated_contigs"], ["outside_target_bed"], ["outside_mutation_bed"], []]


def test_gate(spark):
    m = spark.createDataFrame([("a", "1"), ("b", "0.9"), ("c", "x"), ("d", "11")], "metric string, value string")
    b = spark.createDataFrame([("a", "1", None, "exact"), ("b", "1.0", "0.05", "ge2sd"), ("c", "1", "1", "band"), ("d", "10", None, "lepct20"), ("e", "1", None, "exact")], "metric string, value string, sd string, gate string")
    assert {r["metric"]: r["status"] for r in compare.regression_gate(m, b).collect()} == {"a": "PASS", "b": "PASS", "c": "FAIL", "d": "PASS", "e": "SKIP"}
