"""The nine commands as functions of a session and a configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import config as C
from .functions import sequence as S
from .functions import variants as V
from .operators import compare, intervals, models, simulate
from .sources import alignments, bed, model_files, sequences, tables, vcf


def _alignments(spark: SparkSession, path: str) -> DataFrame:
    return alignments.read_sam(spark, path) if path.endswith(".sam") else alignments.read_bam(spark, path)


def gen_mut_model(spark: SparkSession, c: C.MutationModel) -> dict[str, DataFrame]:
    """SNP contexts, variant mix, indel lengths, structural variants and opportunities of k-mers."""
    fasta, v = sequences.read_fasta(spark, c.reference), vcf.read(spark, c.vcf)
    if c.bed:
        v = intervals.points_in(v, bed.read(spark, c.bed))
    lit = v.where("not is_symbolic")
    snp = lit.where("vtype = 'SNP'").join(sequences.chunked(fasta, flank=2).select("contig", "start", "own", "seq_start", F.col("seq").alias("_seq")), "contig").where("pos - 1 >= start and pos - 1 < start + own")
    context = F.upper(F.substr("_seq", (F.col("pos") - F.col("seq_start") - 1).cast("int"), F.lit(3)))
    snp = snp.withColumn("context", context).where((F.length("context") == 3) & (F.substring("context", 2, 1) == F.upper("ref")))
    trinuc = models.shares(snp.groupBy("context", F.upper("alt").alias("alt")).agg(F.count("*").alias("n")), ["context"])
    # each k-mer belongs to the chunk that owns its first base
    pieces = sequences.chunked(fasta, 1 << 16, 2).withColumn("b", S.bases(F.substr("seq", (F.col("start") - F.col("seq_start") + 1).cast("int"), (F.col("own") + 2).cast("int"))))
    opportunity = pieces.select(F.explode(S.kmers("b")).alias("context")).groupBy("context").agg(F.count("*").alias("opportunities"))
    seen = snp.groupBy("context").agg(F.count("*").alias("mutations"))
    parts = {
        "trinuc": trinuc,
        "mutability": opportunity.join(seen, "context", "left").select("context", "opportunities", F.coalesce(F.col("mutations") / F.col("opportunities"), F.lit(0.0)).alias("mutability")),
        "changes": models.base_changes(snp.groupBy(F.upper("ref").alias("ref"), F.upper("alt").alias("alt")).agg(F.count("*").alias("n"))),
        "mix": models.variant_mix(lit.withColumn("hom", F.col("genotype") == "HOM"), "vtype", "hom"),
        "indels": models.shares(lit.where("vtype in ('INS', 'DEL')").groupBy("vtype", F.abs(F.length("alt") - F.length("ref")).alias("length")).agg(F.count("*").alias("n")), ["vtype"]),
        "sv": models.sv_fit(v.where("is_symbolic").select(F.col("sv.sv_type").alias("kind"), V.sv_span("sv.sv_type", "pos", "sv.end", "sv.svlen").alias("span")), "kind", "span"),
    }
    model_files.save(parts, c.output, C.mode(c.overwrite))
    return parts


def gen_seq_error_model(spark: SparkSession, c: C.ErrorModel) -> dict[str, DataFrame]:
    reads = sequences.read_fastq(spark, c.fastq, c.max_reads)
    if c.bins:
        bins = [int(x) for x in c.bins.split(",")]
        reads = reads.withColumn("quals", F.transform("quals", lambda q: S.snap_to_bin(q, bins)))
    counts = models.quality_counts(reads, "name", "quals")
    hist = counts.groupBy(F.col("cur").alias("q")).agg(F.sum("n").alias("n"))
    parts = {
        "seed": models.shares(counts.where("prev = -1").select(F.col("cur").alias("q"), "n"), []),
        "transitions": models.shares(counts.where("prev >= 0"), ["pos", "prev"]),
        "error_rate": hist.agg((F.sum(S.error_probability("q") * F.col("n")) / F.sum("n")).alias("rate")),
    }
    if c.transitions:
        parts["changes"] = tables.read_matrix(spark, c.transitions)
    model_files.save(parts, c.output, C.mode(c.overwrite))
    return parts


def fragment_fit(reads: DataFrame, min_reads: int) -> DataFrame:
    x = reads.where(V.alignment_filter("fragment")).select(V.template_length("tlen").cast("double").alias("length")).where("length is not null")
    return models.normal_fit(models.length_filter(x, "length", min_reads), "length")


def gc_fit(reads: DataFrame, fasta: DataFrame, window: int, stride: int, min_windows: int) -> DataFrame:
    depth = intervals.depth(alignments.covered(reads.where(V.alignment_filter("coverage"))))
    w = intervals.windows(fasta, window, stride).withColumn("end", F.col("start") + window)
    mean = intervals.overlaps(w.select("contig", "start", "end"), depth).groupBy("contig", "start").agg(F.sum((F.least("end", "b_end") - F.greatest("start", "b_start")) * F.col("b_depth")).alias("bases"))
    return models.gc_bins(w.join(mean, ["contig", "start"], "left").withColumn("depth", F.coalesce("bases", F.lit(0)) / window), min_windows=min_windows)


def gen_frag_length_model(spark: SparkSession, c: C.FragmentModel) -> DataFrame:
    fit = fragment_fit(_alignments(spark, c.bam), c.min_reads)
    model_files.save({"fragment": fit}, c.output, C.mode(c.overwrite))
    return fit


def gen_gc_bias_model(spark: SparkSession, c: C.GcModel) -> DataFrame:
    fit = gc_fit(_alignments(spark, c.bam), sequences.read_fasta(spark, c.reference), c.window, c.stride, c.min_windows)
    model_files.save({"gc": fit}, c.output, C.mode(c.overwrite))
    return fit


def gen_bam_models(spark: SparkSession, c: C.BamModels) -> dict[str, DataFrame]:
    """Both models from one read of the alignments."""
    reads = _alignments(spark, c.bam).persist()
    try:
        parts = {"fragment": fragment_fit(reads, c.min_reads), "gc": gc_fit(reads, sequences.read_fasta(spark, c.reference), c.window, c.stride, c.min_windows)}
        for k, df in parts.items():
            model_files.save({k: df}, f"{c.output_prefix}.{k}", C.mode(c.overwrite))
        return parts
    finally:
        reads.unpersist()


def filter_reads(spark: SparkSession, c: C.FilterReads) -> None:
    b = bed.read(spark, c.bed)
    if c.fastq:
        reads = sequences.read_fastq(spark, c.fastq).withColumn("at", S.parse_read_name("name"))
        spots = reads.select("*", F.col("at.contig").alias("contig"), F.col("at.start").alias("start"), F.col("at.end").alias("end")).drop("at")
        inside = intervals.overlaps(spots.select("contig", "start", "end").distinct(), b, "semi")
        sequences.write_fastq(spots.join(inside, ["contig", "start", "end"], "left_semi"), f"{c.output_prefix}.fastq", ["file", "ord"], C.mode(c.overwrite))
    if c.vcf:
        vcf.filter_to_bed(spark.read.text(c.vcf), b).write.mode(C.mode(c.overwrite)).option("compression", "gzip").text(f"{c.output_prefix}.vcf")


def compare_vcfs(spark: SparkSession, c: C.CompareVcfs) -> dict[str, DataFrame]:
    """scores (TP, FN, FP by contig and in total), fn (with reasons), fp, skipped."""
    fasta = sequences.read_fasta(spark, c.reference)
    target, mutation = (bed.read(spark, p) if p else None for p in (c.target_bed, c.mutation_bed))
    if c.aliases:
        alias = tables.read_aliases(spark, c.aliases)
        target, mutation = (compare.rename_contigs(x, alias) if x is not None else None for x in (target, mutation))
    names = fasta.select("contig").withColumn("known", F.lit(True))

    def flagged(df, b, name):
        if b is None:
            return df.withColumn(name, F.lit(True))
        hit = intervals.points_in(df.select("contig", "pos").distinct(), b).withColumn(name, F.lit(True))
        return df.join(hit, ["contig", "pos"], "left").withColumn(name, F.coalesce(name, F.lit(False)))

    def prepared(path):
        v = flagged(vcf.read(spark, path), target, "in_target").join(names, "contig", "left")
        hom_ref = F.lit(False) if c.include_homs else ~F.exists(F.split("gt", "[/|]"), lambda x: x.try_cast("int") > 0)
        skip = compare.skip_reason(F.coalesce("known", F.lit(False)), F.col("is_symbolic"), hom_ref, ~F.col("filter").isin("PASS", "."), F.col("in_target"))
        # each side is parsed once and read by every set below
        return v.withColumn("skip", skip).select("contig", "pos", "id", "ref", "alt", "qual", "filter", "info", "gt", "in_target", "skip").persist()

    golden, called = prepared(c.golden), prepared(c.called)
    skipped = golden.select("skip").unionByName(called.select("skip")).where("skip is not null").groupBy("skip").agg(F.count("*").alias("n"))
    g, q = (x.where("skip is null").withColumn("ord", F.monotonically_increasing_id()) for x in (golden, called))
    tp, fn, fp = compare.split_sets(g, q)
    if not c.fast:
        same = compare.equivalent(fp, fn, fasta, c.window)
        promoted = fn.join(same.where("side = 'fn'").select("contig", "ord"), ["contig", "ord"], "left_semi")
        fn = fn.join(same.where("side = 'fn'").select("contig", "ord"), ["contig", "ord"], "left_anti")
        fp = fp.join(same.where("side = 'fp'").select("contig", "ord"), ["contig", "ord"], "left_anti")
        tp = tp.unionByName(promoted.select(*compare.KEY))
    fn = flagged(fn, mutation, "in_mutation").withColumn("reasons", compare.miss_reasons(F.lit(True), F.col("in_target"), F.col("in_mutation"))).persist()
    fp, tp = fp.persist(), tp.persist()
    count = lambda d, k: d.select("contig", *[F.lit(int(x == k)).alias(x) for x in ("tp", "fn", "fp")])
    every = count(tp, "tp").unionByName(count(fn, "fn")).unionByName(count(fp, "fp"))
    scores = every.rollup("contig").agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("tp", "fn", "fp")]).withColumn("contig", F.coalesce("contig", F.lit("TOTAL")))
    scores = scores.withColumns({"precision": F.expr("try_divide(tp, tp + fp)"), "recall": F.expr("try_divide(tp, tp + fn)"), "f1": F.expr("try_divide(2 * tp, 2 * tp + fp + fn)")})
    m = C.mode(c.overwrite)
    fn.select(vcf.annotated_line(F.col("reasons")).alias("value")).write.mode(m).text(f"{c.output_prefix}.fn.vcf")
    fp.select(vcf.annotated_line().alias("value")).write.mode(m).text(f"{c.output_prefix}.fp.vcf")
    scores = scores.persist()
    # one row a contig
    rows = [r.asDict() for r in scores.collect()]
    reasons = {r["r"]: r["n"] for r in fn.select(F.explode("reasons").alias("r")).groupBy("r").agg(F.count("*").alias("n")).collect()}
    text = model_files.report(rows, {r["skip"]: r["n"] for r in skipped.collect()}, reasons, [], {"golden": c.golden, "called": c.called})
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode(m).text(f"{c.output_prefix}.report.json")
    return {"scores": scores, "fn": fn, "fp": fp, "skipped": skipped}


def _supported(c: C.GenReads) -> None:
    """Raises on fields that read simulation does not carry out, instead of ignoring them."""
    unread = [k for k in ("mutation_model", "error_model", "gc_model", "fragment_model", "adapter") if getattr(c, k) is not None]
    if c.ploidy != 2:
        unread.append("ploidy")
    if unread:
        raise NotImplementedError(f"read simulation does not support: {', '.join(unread)}")


def gen_reads(spark: SparkSession, c: C.GenReads, rate: float = 0.001, given: DataFrame | None = None) -> dict[str, DataFrame]:
    """Reads and truth of a reference; writes FASTQ, SAM and truth VCF as asked.  ``given`` variants are carried too."""
    _supported(c)
    seed = c.seed or "0"
    fasta = sequences.resolve(sequences.read_fasta(spark, c.reference), seed).select("contig", "seq")
    regions = intervals.n_runs(fasta).where("not is_n").select("contig", "start", "end")
    if c.target_bed:
        regions = intervals.intersect(regions, bed.read(spark, c.target_bed).select("contig", "start", "end"))
    mix = {"SNP": 0.85, "INS": 0.07, "DEL": 0.08}
    new = simulate.draw_variants(fasta, c.mutation_rate if c.mutation_rate is not None else rate, mix, 0.3, seed).withColumn("provenance", F.lit("denovo"))
    if c.input_vcf:
        known = vcf.read(spark, c.input_vcf)
        # nothing of the input is left out silently
        if not known.where("is_symbolic or vtype = 'COMPLEX'").isEmpty():
            raise NotImplementedError("read simulation does not support symbolic and complex variants of an input VCF")
        known = known.select("contig", "pos", "ref", "alt", "vtype", "gt", F.lit("input").alias("provenance"))
        given = known if given is None else given.unionByName(known)
    if given is not None:
        # given variants come first at their place
        new = given.dropDuplicates(["contig", "pos"]).unionByName(new.join(given, ["contig", "pos"], "left_anti"))
    frags = simulate.fragments(regions, c.coverage, c.read_length, c.fragment_mean or 400.0, c.fragment_sd or 50.0, seed, c.paired)
    reads = simulate.emit_reads(frags, fasta, new, c.read_length, seed, paired=c.paired)
    m = C.mode(c.overwrite)
    if c.produce_fastq:
        sequences.write_fastq(reads, f"{c.output_prefix}.fastq", ["contig", "pos"], m)
    # one row a contig
    lengths = [(r["contig"], r["length"]) for r in sequences.contig_lengths(fasta).collect()]
    if c.produce_bam:
        n = F.length("seq")
        rows = reads.select("name", V.flags(F.lit(c.paired), F.col("mate") == 2, F.col("mate") == 1).alias("flag"), F.col("contig").alias("ref"), "pos", F.lit(60).alias("mapq"), F.concat(n, F.lit("M")).alias("cigar"), F.lit("*").alias("mate_ref"), F.lit(0).alias("mate_pos"), F.lit(0).alias("tlen"), F.when(F.col("mate") == 2, S.reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"), S.phred_string("quals").alias("qual"))
        alignments.write_sam(rows, lengths, f"{c.output_prefix}.sam", m)
    if c.produce_vcf:
        ad = simulate.allele_counts(reads, new)
        truth = new.join(ad, ["contig", "pos"], "left").fillna(0, ["ref_count", "alt_count"]).withColumn("location", F.col("pos") - 1)
        vcf.write_truth(truth, lengths, f"{c.output_prefix}.vcf", m)
    return {"variants": new, "reads": reads}


def gen_cancer_reads(spark: SparkSession, c: C.CancerReads) -> dict[str, DataFrame]:
    """Tumor and normal reads, tagged and mixed by purity; truth labelled by origin."""
    normal_cov, tumor_cov = simulate.split_coverage(c.coverage, c.purity)
    m, common = C.mode(c.overwrite), {"reference": c.reference, "read_length": c.read_length, "produce_fastq": False, "produce_vcf": True, "overwrite": c.overwrite}
    normal = gen_reads(spark, C.GenReads(output_prefix=f"{c.output_prefix}.normal", coverage=normal_cov, mutation_rate=c.normal_rate, seed=f"{c.seed or 0}-n", **common))
    # the tumor carries the germline as given variants and its own on top
    germline = normal["variants"].withColumn("provenance", F.lit("input"))
    tumor = gen_reads(spark, C.GenReads(output_prefix=f"{c.output_prefix}.tumor", coverage=tumor_cov, mutation_rate=c.tumor_rate, seed=f"{c.seed or 0}-t", **common), given=germline)
    truth = compare.origin_merge(tumor["variants"], germline, compare.KEY)
    reads = normal["reads"].withColumn("name", F.concat(F.lit("N_"), "name")).unionByName(tumor["reads"].withColumn("name", F.concat(F.lit("T_"), "name")))
    sequences.write_fastq(reads, f"{c.output_prefix}.fastq", ["contig", "pos"], m)
    return {"reads": reads, "truth": truth}
