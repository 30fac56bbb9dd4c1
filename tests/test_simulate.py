"""Laws and determinism of the generative operators."""

import random

from pyspark.sql import functions as F

from helixframe.functions import randomness as R
from helixframe.functions import sequence as S
from helixframe.operators import simulate


def _fasta(spark, n=4000):
    rng = random.Random(1)
    return spark.createDataFrame([(c, "".join(rng.choice("ACGT") for _ in range(n))) for c in ("a", "b")], "contig string, seq string")


def test_normal_quantile_and_poisson(spark):
    df = spark.range(20_000).select(R.uniform("id", seed=1).alias("u"))
    r = df.select(R.normal_quantile(F.col("u")).alias("z"), R.poisson(F.col("u"), 4.0).alias("k")).agg(F.avg("z").alias("m"), F.stddev("z").alias("s"), F.avg("k").alias("k"), F.var_pop("k").alias("v")).first()
    assert abs(r["m"]) < 0.03 and abs(r["s"] - 1) < 0.03 and abs(r["k"] - 4) < 0.1 and abs(r["v"] - 4) < 0.25


def test_variants_do_not_depend_on_partitions(spark):
    f = _fasta(spark)
    mix = {"SNP": 0.7, "INS": 0.15, "DEL": 0.15}
    a = sorted(map(tuple, simulate.draw_variants(f, 0.01, mix, 0.2, 5).collect()))
    b = sorted(map(tuple, simulate.draw_variants(f.repartition(7), 0.01, mix, 0.2, 5).collect()))
    assert a == b and 70 <= len(a) <= 80
    seqs = {r["contig"]: r["seq"] for r in f.collect()}
    assert all(seqs[c][p - 1 : p - 1 + len(ref)] == ref for c, p, ref, *_ in a)


def test_fragments_and_reads(spark):
    f = _fasta(spark)
    regions = f.select("contig", F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("end"))
    frags = simulate.fragments(regions, 10, 50, 200, 20, seed=2)
    s = frags.agg(F.count("*").alias("n"), F.avg(F.col("end") - F.col("start")).alias("m"), F.min("start").alias("lo"), F.max("end").alias("hi")).first()
    assert s["n"] == 800 and abs(s["m"] - 200) < 4 and s["lo"] >= 0 and s["hi"] <= 4000
    v = simulate.draw_variants(f, 0.005, {"SNP": 1.0, "INS": 0.0, "DEL": 0.0}, 0.0, 5)
    reads = simulate.emit_reads(frags, f, v, 50, seed=2, error_quality=90)
    ad = simulate.allele_counts(reads, v).agg(F.sum("alt_count").alias("a"), F.sum("ref_count").alias("r")).first()
    assert 0.4 < ad["a"] / (ad["a"] + ad["r"]) < 0.6


def test_sv_places_do_not_overlap(spark):
    c = spark.createDataFrame([("a", 100_000), ("b", 50_000)], "contig string, length long")
    rows = simulate.place_svs(c, 0.0004, {"DEL": 0.5, "DUP": 0.3, "INV": 0.2}, 5.5, 0.5, 9).orderBy("contig", "pos").collect()
    assert len(rows) > 30
    assert all(x["contig"] != y["contig"] or x["end"] < y["pos"] for x, y in zip(rows, rows[1:]))


def test_quality_chain(spark):
    q = simulate.quality_string([(31, 1.0)], {30: [(40, 1.0)], 31: [(40, 0.5), (2, 0.5)], 40: [(40, 1.0)], 2: [(2, 1.0)]}, F.lit(10), ["id"], 1)
    rows = [r["q"] for r in spark.range(50).select(q.alias("q")).collect()]
    assert all(len(r) == 10 and r[0] == 30 and set(r[1:]) in ({40}, {2}) for r in rows) and len({r[1] for r in rows}) == 2


def test_edits(spark):
    df = spark.createDataFrame([("ACGTACGTACGT", [(3, "GT", "AA"), (5, "ACGTA", "A"), (12, "T", "TTT")])], "s string, e array<struct<pos:int,ref:string,alt:string>>")
    assert df.select(S.apply_edits("s", "e").alias("x")).first()["x"] == "ACAAACGTTT"


def test_coverage_split():
    assert simulate.split_coverage(30, 0.6) == (12, 18) and simulate.split_coverage(5, 0.5) == (3, 3)
