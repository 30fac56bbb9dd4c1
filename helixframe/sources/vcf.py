"""VCF as DataFrames: tolerant parser, truth lines, annotated and merged files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import variants as V


def parse(lines: DataFrame) -> DataFrame:
    """Records of text lines (column value); only columns that are used are computed.

    Headers and multi-allelic rows are skipped, a QUAL that is no number is 0,
    FORMAT fields that the sample lacks are '.', and no GT means 0/1.  More
    sample fields than FORMAT keys raise.
    """
    f = F.split("value", "\t")
    get = lambda k: F.get(f, F.lit(k))
    x = lines.where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(
        get(0).alias("contig"), get(1).try_cast("long").alias("pos"), get(2).alias("id"), get(3).alias("ref"), get(4).alias("alt"),
        F.coalesce(get(5).try_cast("int"), F.lit(0)).alias("qual"), get(6).alias("filter"), get(7).alias("info"),
        F.split(F.coalesce(get(8), F.lit("")), ":").alias("_k"), F.split(F.coalesce(get(9), F.lit("")), ":").alias("_v"),
    )
    x = x.where(F.col("pos").isNotNull() & ~F.col("alt").contains(","))
    at = F.array_position("_k", "GT")
    gt = F.when(at > 0, F.coalesce(F.get("_v", (at - 1).cast("int")), F.lit("."))).otherwise("0/1")
    gt = F.when(F.size("_v") > F.size("_k"), F.raise_error(F.lit("more sample fields than FORMAT keys")).cast("string")).otherwise(gt)
    kind, symbolic = V.allele_class("ref", "alt"), V.symbolic_class("alt")
    info, mate = V.info_fields("info", "pos"), V.breakend("alt")
    sv = F.when(
        kind.isNull(),
        F.struct(symbolic.alias("sv_type"), info["end"].alias("end"), info["svlen"].alias("svlen"), info["cn"].alias("cn"), mate["mate_contig"].alias("mate_contig"), mate["mate_pos"].alias("mate_pos"), mate["join_after"].alias("join_after"), mate["mate_right"].alias("mate_right")),
    )
    return x.select(
        "contig", "pos", "id", "ref", "alt", "qual", "filter", "info", gt.alias("gt"), kind.alias("vtype"), V.genotype_label(gt).alias("genotype"),
        V.allele_fraction("info").alias("allele_fraction"), kind.isNull().alias("is_symbolic"), sv.alias("sv"),
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith((".bcf", ".bcf.gz")):
        raise ValueError("binary call files are not read: convert to text first")
    return parse(spark.read.text(path))


def truth_line(tag: str = "ORIGIN") -> Column:
    """A truth record of (contig, location 0-based, ref, alt, gt, provenance, ref_count, alt_count)."""
    dp = F.col("ref_count") + F.col("alt_count")
    af = F.when(dp > 0, V.four_digits(F.col("alt_count") / dp.cast("double"))).otherwise(".")
    sample = F.concat_ws(":", "gt", F.concat_ws(",", "ref_count", "alt_count"), dp, af)
    return F.concat_ws("\t", "contig", F.col("location") + 1, F.lit("."), "ref", "alt", F.lit("37"), F.lit("PASS"), F.concat(F.lit(f"{tag}="), "provenance"), F.lit("GT:AD:DP:AF"), sample)


def header(contigs: list[tuple[str, int]], info: list[str] = (), sample: str = "SAMPLE") -> list[str]:
    lines = ["##fileformat=VCFv4.2", *[f"##contig=<ID={c},length={n}>" for c, n in contigs], *info]
    lines += [f'##FORMAT=<ID={k},Number={n},Type={t},Description="{d}">' for k, n, t, d in (("GT", 1, "String", "Genotype"), ("AD", "R", "Integer", "Reads of each allele"), ("DP", 1, "Integer", "Depth"), ("AF", "A", "Float", "Share of the alternate allele"))]
    return [*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", sample])]


def write_truth(variants: DataFrame, contigs: list[tuple[str, int]], path: str, mode: str = "error") -> None:
    """Sorted by (contig as listed, position), one row a (contig, location, ref, alt); gzip text with a header."""
    spark = variants.sparkSession
    order = F.create_map(*[F.lit(x) for k, (c, _) in enumerate(contigs) for x in (c, k)])[F.col("contig")]
    rows = variants.dropDuplicates(["contig", "location", "ref", "alt"]).select(F.lit(1).alias("part"), order.alias("c"), "location", truth_line().alias("value"))
    head = spark.createDataFrame([(0, 0, k, x) for k, x in enumerate(header(contigs))], "part int, c int, location long, value string")
    head.unionByName(rows).orderBy("part", "c", "location", "value").select("value").write.mode(mode).option("compression", "gzip").text(path)


def annotated_line(reasons: Column | None = None, tag: str = "REASON") -> Column:
    info = F.col("info") if reasons is None else F.when(F.size(reasons) > 0, V.append_info("info", F.concat(F.lit(f"{tag}="), F.array_join(reasons, ",")))).otherwise(F.col("info"))
    return F.concat_ws("\t", "contig", "pos", F.coalesce("id", F.lit(".")), "ref", "alt", "qual", "filter", info, F.lit("GT"), "gt")


def filter_to_bed(lines: DataFrame, bed: DataFrame) -> DataFrame:
    """Headers and the records whose position lies in an interval."""
    from ..operators.intervals import points_in

    head = lines.where(F.col("value").startswith("#"))
    f = F.split("value", "\t")
    body = lines.where(~F.col("value").startswith("#")).select("value", f[0].alias("contig"), f[1].try_cast("long").alias("pos"))
    return head.unionByName(points_in(body, bed).select("value"))
