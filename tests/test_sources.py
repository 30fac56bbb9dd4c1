"""Round trips of formats through files."""

import gzip

import pytest
from pyspark.sql import functions as F

from helixframe.functions import variants as V
from helixframe.sources import alignments, bed, model_files, sequences, tables, vcf


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">c1 some words\nACGT\nAC\n>c2\nNNNNNNNNTTCT")
    got = {r["contig"]: r["seq"] for r in sequences.read_fasta(spark, str(tmp_path / "a.fa")).collect()}
    assert got == {"c1": "ACGTAC", "c2": "NNNNNNNNTTCT"}
    df = spark.createDataFrame(list(got.items()), "contig string, seq string")
    sequences.write_fasta(df, str(tmp_path / "out"), width=5, compression="gzip")
    assert {r["contig"]: r["seq"] for r in sequences.read_fasta(spark, str(tmp_path / "out")).collect()} == got


def test_iupac(spark):
    df = spark.createDataFrame([("c", "ACGTRYMKSWHBVDN" * 8)], "contig string, seq string")
    r = sequences.resolve(df, 3).first()
    assert set(r["seq"]) <= set("ACGTN") and r["resolved"] == 80 and r["seq"] == sequences.resolve(df.repartition(3), 3).first()["seq"]


def test_chunks_own_each_base_once(spark):
    df = spark.createDataFrame([("c", "ACGT" * 25)], "contig string, seq string")
    rows = sequences.chunked(df, 30, 2).orderBy("start").collect()
    assert "".join(r["seq"][r["start"] - r["seq_start"] :][: r["own"]] for r in rows) == "ACGT" * 25


def test_fastq(spark, tmp_path):
    reads = spark.createDataFrame([("r1", "ACGT", [31, 0, 40, 2]), ("r2", "GG", [31, 93])], "name string, seq string, quals array<int>")
    sequences.write_fastq(reads, str(tmp_path / "fq"))
    got = sequences.read_fastq(spark, str(tmp_path / "fq")).orderBy("name").collect()
    assert [(r["name"], r["seq"], r["quals"]) for r in got] == [("r1", "ACGT", [31, 0, 40, 2]), ("r2", "GG", [31, 93])]


def test_multi_member_gzip(spark, tmp_path):
    one = gzip.compress(b"@a\nAC\n+\nII\n")
    (tmp_path / "x.fq.gz").write_bytes(one + gzip.compress(b"") + gzip.compress(b"@b\nGT\n+\nII\n"))
    assert sequences.read_fastq(spark, str(tmp_path / "x.fq.gz")).count() == 2
    assert sequences.read_fastq(spark, str(tmp_path / "x.fq.gz"), max_reads=1).first()["name"] == "a"


def test_vcf(spark, tmp_path):
    lines = ["##x", "#CHROM", "c\t22\t.\tC\tT\t.\tPASS\tAF=0.25\tDP\t3", "c\t30\t.\tA\t<DEL>\t9\tPASS\tEND=40;SVTYPE=DEL\tGT\t1/1", "c\t31\t.\tA\tC,G\t9\tPASS\t.\tGT\t0/1"]
    (tmp_path / "a.vcf").write_text("\n".join(lines))
    got = vcf.read(spark, str(tmp_path / "a.vcf")).orderBy("pos").collect()
    assert [(r["pos"], r["qual"], r["gt"], r["vtype"]) for r in got] == [(22, 0, "0/1", "SNP"), (30, 9, "1/1", None)]
    assert got[1]["sv"]["end"] == 40 and got[0]["allele_fraction"] == 0.25
    with pytest.raises(ValueError):
        vcf.read(spark, "x.bcf")


def test_truth_vcf(spark, tmp_path):
    v = spark.createDataFrame([("b", 4, "A", "C", "0/1", "denovo", 3, 1), ("a", 9, "A", "C", "1/1", "input", 0, 0), ("a", 9, "A", "C", "1/1", "input", 0, 0)], "contig string, location long, ref string, alt string, gt string, provenance string, ref_count int, alt_count int")
    vcf.write_truth(v, [("a", 100), ("b", 50)], str(tmp_path / "t"))
    body = [r["value"] for r in spark.read.text(str(tmp_path / "t")).collect() if not r["value"].startswith("#")]
    assert sorted(body) == ["a\t10\t.\tA\tC\t37\tPASS\tORIGIN=input\tGT:AD:DP:AF\t1/1:0,0:0:.", "b\t5\t.\tA\tC\t37\tPASS\tORIGIN=denovo\tGT:AD:DP:AF\t0/1:3,1:4:0.2500"]
    with pytest.raises(Exception):
        vcf.write_truth(v, [("a", 100), ("b", 50)], str(tmp_path / "t"))


def test_bed_and_aliases(spark):
    lines = spark.createDataFrame([("c 5 9 mut_rate=0.5;x",), ("c\t-1\t4",), ("# no",)], "value string")
    assert [tuple(r) for r in bed.parse(lines).collect()] == [("c", 5, 9, 0.5)]
    with pytest.raises(Exception):
        bed.parse(spark.createDataFrame([("c\t9\t9",)], "value string")).collect()
    with pytest.raises(Exception):
        tables.parse_aliases(spark.createDataFrame([("one",)], "value string")).collect()


def test_matrix(spark, tmp_path):
    (tmp_path / "m.tsv").write_text("A\tC\tG\tT\n9\t1\t1\t2\n1\t0\t1\t0\n0\t0\t0\t5\n0\t1\t0\t0\n")
    got = {(r["ref"], r["alt"]): r["p"] for r in tables.read_matrix(spark, str(tmp_path / "m.tsv")).collect()}
    assert got["A", "A"] == 0 and got["A", "T"] == 0.5 and got["G", "T"] == 1 and got["T", "C"] == 1
    (tmp_path / "n.tsv").write_text("1\t2\t3\t4\n")
    with pytest.raises(ValueError):
        tables.read_matrix(spark, str(tmp_path / "n.tsv"))


RECORDS = [("r1", 99, "c", 11, 60, "4M2D3M1I2M", "c", 31, 30, "ACGTACGTAC", "IIIIIIIIII", "4^AC2A2"), ("r2", 16, "c", 3, 60, "5M", "*", 0, 0, "ACGTA", "IIIII", "1A3")]


def test_bam_and_sam(spark, tmp_path):
    contigs = [("c", 100)]
    (tmp_path / "a.bam").write_bytes(alignments.encode_bam("@HD\tVN:1.6\n", contigs, RECORDS))
    got = sorted(tuple(r) for r in alignments.read_bam(spark, str(tmp_path / "a.bam")).collect())
    assert got == sorted(RECORDS)
    spark.dataSource.register(alignments.BamDataSource)
    assert spark.read.format("bam").load(str(tmp_path / "*.bam")).count() == 2
    df = spark.createDataFrame(RECORDS, alignments.SCHEMA)
    alignments.write_sam(df, contigs, str(tmp_path / "sam"))
    back = alignments.read_sam(spark, str(tmp_path / "sam")).select("name", "pos", "cigar").collect()
    assert sorted(tuple(r) for r in back) == [("r1", 11, "4M2D3M1I2M"), ("r2", 3, "5M")]
    with pytest.raises(Exception):
        alignments.write_sam(df, [("other", 5)], str(tmp_path / "bad"))


def test_coverage_and_mismatches(spark):
    df = spark.createDataFrame(RECORDS, alignments.SCHEMA)
    got = sorted((r["start"], r["end"]) for r in alignments.covered(df).collect())
    assert got == [(2, 7), (10, 14), (16, 19), (19, 21)]
    assert alignments.mismatches_of("ACGTA", "5M", "1A3")[1] == ("A", "C")
    counts = {(r["ref"], r["alt"]): r["n"] for r in alignments.mismatch_counts(df).collect()}
    assert counts["A", "C"] == 1 and sum(counts.values()) == 14


def test_model_files(spark, tmp_path):
    a = spark.createDataFrame([("x", 1.5)], "k string, v double")
    model_files.save({"a": a}, str(tmp_path / "m"))
    assert model_files.load(spark, str(tmp_path / "m"), {"a": "k string, v double"})["a"].first()["v"] == 1.5


def test_four_digits_as_printf(spark):
    # every share of 160 and of 32, 20000ths that end on a half, and shares of odd counts
    shares = [(a, n) for n in (32, 160, 2000, 20000) for a in range(n + 1)] + [(a, 977) for a in range(978)]
    df = spark.createDataFrame(shares, "a long, n long").select("a", "n", V.four_digits(F.col("a") / F.col("n").cast("double")).alias("x"))
    assert [r for r in df.collect() if r["x"] != "%.4f" % (r["a"] / r["n"])] == []
    v = spark.createDataFrame([("a", 9, "A", "C", "0/1", "input", 7, 153)], "contig string, location long, ref string, alt string, gt string, provenance string, ref_count int, alt_count int")
    assert v.select(vcf.truth_line()).first()[0].endswith("0/1:7,153:160:0.9563")
