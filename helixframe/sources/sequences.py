"""FASTA and FASTQ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import randomness as R
from ..functions import sequence as S


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """contig (first word of the header), seq (white space removed); plain or gzip."""
    # a record starts at a header: the separator ends the one before it
    raw = spark.read.option("lineSep", "\n>").text(path)
    text = F.regexp_replace("value", "^>", "")
    head = F.regexp_extract(text, r"^([^\n]*)", 1)
    body = F.when(F.contains(text, F.lit("\n")), F.regexp_replace(text, r"^[^\n]*\n", "")).otherwise("")
    out = raw.select(F.regexp_extract(head, r"^(\S+)", 1).alias("contig"), F.regexp_replace(body, r"\s", "").alias("seq"))
    return out.where(F.length("contig") > 0)


def contig_lengths(fasta: DataFrame) -> DataFrame:
    return fasta.select("contig", F.length("seq").cast("long").alias("length"))


def resolve(fasta: DataFrame, seed: int = 0) -> DataFrame:
    """IUPAC codes replaced by a keyed random choice; adds the number of them."""
    chars = fasta.withColumn("_b", S.bases("seq"))
    picked = F.transform("_b", lambda c, i: S.resolve_iupac(c, R.uniform("contig", i, seed=seed, stream="iupac")))
    n = F.regexp_count(F.upper("seq"), F.lit("[RYMKSWHBVD]"))
    return chars.select("contig", F.array_join(picked, "").alias("seq"), n.cast("long").alias("resolved"))


def chunked(fasta: DataFrame, size: int = 1 << 20, flank: int = 2) -> DataFrame:
    """contig, start, own (bases that the chunk owns), seq (with flank bases on both sides): no row holds a whole contig."""
    n = F.length("seq")
    x = fasta.where(n > 0).withColumn("start", F.explode(F.sequence(F.lit(0), n - 1, F.lit(size))))
    first = F.greatest(F.col("start") - flank, F.lit(0))
    return x.select("contig", F.col("start").cast("long").alias("start"), F.least(F.lit(size), n - F.col("start")).cast("long").alias("own"), first.cast("long").alias("seq_start"), F.substr("seq", first + 1, F.col("start") + size + flank - first).alias("seq"))


def write_fasta(fasta: DataFrame, path: str, width: int = 60, mode: str = "error", compression: str = "none") -> None:
    wrapped = F.trim(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"))
    fasta.select(F.concat(F.lit(">"), "contig", F.lit("\n"), wrapped).alias("value")).write.mode(mode).option("compression", compression).text(path)


def read_fastq(spark: SparkSession, path: str, max_reads: int | None = None) -> DataFrame:
    """name, seq, quals (array<int>), ord (place in its file), file.

    Lines are numbered within a file in two levels, so a large plain file splits
    between tasks.
    """
    raw = spark.read.text(path).withColumn("file", F.input_file_name()).withColumn("_id", F.monotonically_increasing_id())
    # ids ascend within a task, tasks within a file
    part = F.shiftright("_id", 33)
    raw = raw.withColumn("_part", part)
    sizes = raw.groupBy("file", "_part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("file", "_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    rows = raw.join(sizes, ["file", "_part"])
    line = F.row_number().over(Window.partitionBy("file", "_part").orderBy("_id")) - 1 + F.col("_before")
    rows = rows.withColumn("line", line)
    rec = rows.groupBy("file", F.floor(F.col("line") / 4).alias("ord")).agg(*[F.max(F.when(F.col("line") % 4 == k, F.col("value"))).alias(c) for k, c in enumerate(("name", "seq", "plus", "qual"))])
    bad = ~F.col("name").startswith("@") | F.col("qual").isNull() | (F.length("seq") != F.length("qual"))
    name = F.when(bad, F.raise_error(F.concat(F.lit("broken FASTQ record in "), "file")).cast("string")).otherwise(F.substr("name", F.lit(2)))
    rec = rec.select(name.alias("name"), "seq", F.transform(S.bases("qual"), lambda c: S.phred_score(c)).alias("quals"), "ord", "file")
    return rec.where(F.col("ord") < max_reads) if max_reads is not None else rec


def fastq_record(prefix: str = ""):
    return F.concat_ws("\n", F.concat(F.lit(f"@{prefix}"), "name"), "seq", F.lit("+"), S.phred_string("quals"))


def write_fastq(reads: DataFrame, path: str, order: list[str] | None = None, mode: str = "error", prefix: str = "") -> None:
    """Gzip members, one a part file: they may be concatenated in order of their names."""
    rows = reads.repartitionByRange(*order).sortWithinPartitions(*order) if order else reads
    rows.select(fastq_record(prefix).alias("value")).write.mode(mode).option("compression", "gzip").text(path)
