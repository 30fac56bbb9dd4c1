"""Commands end to end on small files."""

import random

import pytest
from pyspark.sql import functions as F

from helixframe import commands, config
from helixframe.sources import alignments


@pytest.fixture(scope="module")
def reference(tmp_path_factory):
    rng = random.Random(3)
    d = tmp_path_factory.mktemp("ref")
    seqs = {c: "".join(rng.choice("ACGT") for _ in range(3000)) for c in ("chr1", "chr2")}
    (d / "ref.fa").write_text("".join(f">{c}\n{s}\n" for c, s in seqs.items()))
    return str(d / "ref.fa"), seqs


def _vcf(path, rows):
    path.write_text("#CHROM\n" + "".join(f"{c}\t{p}\t.\t{r}\t{a}\t9\tPASS\t.\tGT\t0/1\n" for c, p, r, a in rows))
    return str(path)


def _flip(b):
    return {"A": "C", "C": "G", "G": "T", "T": "A"}[b]


def test_compare(spark, reference, tmp_path):
    ref, seqs = reference
    s = seqs["chr1"]
    v = [("chr1", p, s[p - 1], _flip(s[p - 1])) for p in (100, 200, 500)]
    golden = _vcf(tmp_path / "g.vcf", [*v, ("other", 5, "A", "C")])
    called = _vcf(tmp_path / "c.vcf", [v[0], ("chr1", 300, s[299], _flip(s[299]))])
    (tmp_path / "mut.bed").write_text("chr1\t0\t250\n")
    c = config.CompareVcfs(ref, golden, called, str(tmp_path / "out"), mutation_bed=str(tmp_path / "mut.bed"))
    got = commands.compare_vcfs(spark, c)
    total = next(r for r in got["scores"].collect() if r["contig"] == "TOTAL")
    assert (total["tp"], total["fn"], total["fp"]) == (1, 2, 1)
    assert sorted((r["pos"], r["reasons"]) for r in got["fn"].collect()) == [(200, []), (500, ["outside_mutation_bed"])]
    assert {r["skip"]: r["n"] for r in got["skipped"].collect()} == {"outside_simulated_contigs": 1}
    assert '"schema_version": "1.3.0"' in spark.read.text(f"{tmp_path}/out.report.json", wholetext=True).first()["value"]
    with pytest.raises(Exception):
        commands.compare_vcfs(spark, c)


def test_simulate_fit_and_filter(spark, reference, tmp_path):
    ref, seqs = reference
    c = config.GenReads(ref, str(tmp_path / "r"), read_length=50, coverage=3, paired=True, fragment_mean=150, fragment_sd=10, mutation_rate=0.01, produce_vcf=True, produce_bam=True, seed="1")
    got = commands.gen_reads(spark, c)
    assert got["reads"].count() == 2 * 2 * 90
    model = commands.gen_mut_model(spark, config.MutationModel(ref, f"{tmp_path}/r.vcf", str(tmp_path / "mut")))
    mix = model["mix"].first()
    assert mix["n"] == got["variants"].count() and mix["p_snp"] > 0.6
    opp = {r["context"]: r["opportunities"] for r in model["mutability"].collect()}
    assert sum(opp.values()) == sum(len(s) - 2 for s in seqs.values())
    err = commands.gen_seq_error_model(spark, config.ErrorModel(f"{tmp_path}/r.fastq", str(tmp_path / "err")))
    assert abs(err["error_rate"].first()["rate"] - 0.001) < 1e-9
    (tmp_path / "t.bed").write_text("chr1\t0\t700\n")
    commands.filter_reads(spark, config.FilterReads(str(tmp_path / "t.bed"), str(tmp_path / "f"), vcf=f"{tmp_path}/r.vcf"))
    kept = [r["value"].split("\t") for r in spark.read.text(f"{tmp_path}/f.vcf").collect() if not r["value"].startswith("#")]
    assert kept and all(k[0] == "chr1" and int(k[1]) < 700 for k in kept)


def test_bam_models(spark, reference, tmp_path):
    ref, seqs = reference
    rows = [(f"r{k}", 99, "chr1", 1 + 20 * k, 60, "50M", "chr1", 120 + 20 * k, 200 + k % 3, seqs["chr1"][20 * k : 20 * k + 50], "I" * 50, "50") for k in range(100)]
    (tmp_path / "a.bam").write_bytes(alignments.encode_bam("@HD\n", [("chr1", 3000), ("chr2", 3000)], rows))
    got = commands.gen_bam_models(spark, config.BamModels(str(tmp_path / "a.bam"), ref, str(tmp_path / "m")))
    assert abs(got["fragment"].first()["mean"] - 200.99) < 0.02
    assert got["gc"].agg(F.sum("windows")).first()[0] == 60


def test_cancer(spark, reference, tmp_path):
    got = commands.gen_cancer_reads(spark, config.CancerReads(reference[0], str(tmp_path / "c"), purity=0.5, coverage=2, normal_rate=0.005, tumor_rate=0.002, read_length=100, seed="4"))
    origins = {r["origin"]: r["n"] for r in got["truth"].groupBy("origin").agg(F.count("*").alias("n")).collect()}
    assert origins["shared"] > 20
    assert origins["somatic"] > 5
    assert {r["t"] for r in got["reads"].select(F.substring("name", 1, 2).alias("t")).distinct().collect()} == {"N_", "T_"}


@pytest.mark.parametrize("field", [{"mutation_model": "m"}, {"error_model": "m"}, {"gc_model": "m"}, {"fragment_model": "m"}, {"adapter": "ACGT"}, {"ploidy": 4}])
def test_unsupported_fields_raise(spark, reference, tmp_path, field):
    with pytest.raises(NotImplementedError, match=next(iter(field))):
        commands.gen_reads(spark, config.GenReads(reference[0], str(tmp_path / "u"), **field))


def test_unsupported_input_variants_raise(spark, reference, tmp_path):
    s = reference[1]["chr1"]
    plain = _vcf(tmp_path / "p.vcf", [("chr1", 100, s[99], _flip(s[99]))])
    got = commands.gen_reads(spark, config.GenReads(reference[0], str(tmp_path / "p"), input_vcf=plain, coverage=1))
    assert got["variants"].where("provenance = 'input'").count() == 1
    for k, alt in enumerate(("<DEL>", _flip(s[199]) + _flip(s[200]) + "AAA")):
        bad = _vcf(tmp_path / f"b{k}.vcf", [("chr1", 100, s[99], _flip(s[99])), ("chr1", 200, s[199:201], alt)])
        with pytest.raises(NotImplementedError):
            commands.gen_reads(spark, config.GenReads(reference[0], str(tmp_path / f"b{k}"), input_vcf=bad, coverage=1))


def test_config():
    c = config.parse("reference: a.fa\noutput_prefix: x\ncoverage: .\nread_length: 100 # note\npaired: false\n", config.GenReads)
    assert c.coverage == 10.0 and c.read_length == 100
    for bad in ("output_prefix: x\n", "reference: a\noutput_prefix: x\nnope: 1\n", "reference: a\noutput_prefix: x\npaired: true\n", "reference: a\noutput_prefix: x\nadapter: XYZ\n"):
        with pytest.raises(ValueError):
            config.parse(bad, config.GenReads)
    with pytest.raises(ValueError):
        config.parse("reference: a\noutput_prefix: x\npurity: 1\ncoverage: 3\n", config.CancerReads)
    assert config.filtered_name("d/x.vcf") == "d/x.filtered.vcf" and config.filtered_name("x.fq.gz") == "x.filtered.fq.gz"
