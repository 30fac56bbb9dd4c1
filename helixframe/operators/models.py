"""Model fits as aggregations: all statistics in one or two shuffles with map-side combination."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BASES = ["A", "C", "G", "T"]


def shares(counts: DataFrame, given: list[str], n: str = "n", out: str = "p") -> DataFrame:
    """Conditional probability of each row within its group."""
    total = F.sum(n).over(Window.partitionBy(*given)) if given else F.sum(n).over(Window.partitionBy())
    return counts.withColumn(out, F.col(n) / total)


def cdf(counts: DataFrame, given: list[str], order: list[str], n: str = "n") -> DataFrame:
    """Adds cum_lo and cum_hi of a discrete distribution; a draw u picks cum_lo < u <= cum_hi."""
    w = Window.partitionBy(*given).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = F.sum(n).over(Window.partitionBy(*given))
    hi = F.sum(n).over(w)
    return counts.withColumns({"cum_hi": hi / total, "cum_lo": (hi - F.col(n)) / total})


def draw(samples: DataFrame, table: DataFrame, given: list[str], u: str = "u") -> DataFrame:
    """Inverse-CDF sample: the row of ``table`` (from cdf) whose interval holds u; u = 0 takes the first."""
    t = table.withColumnsRenamed({g: f"_{g}" for g in given})
    on = (F.greatest(F.col(u), F.lit(1e-12)) > F.col("cum_lo")) & (F.greatest(F.col(u), F.lit(1e-12)) <= F.col("cum_hi"))
    for g in given:
        on = on & (F.col(g) == F.col(f"_{g}"))
    return samples.join(F.broadcast(t), on).drop(*[f"_{g}" for g in given])


def density(table: DataFrame, given: list[str], order: list[str], cum: str = "cum_hi") -> DataFrame:
    """Differences of neighbouring cumulative values, not below 0."""
    w = Window.partitionBy(*given).orderBy(*order)
    return table.withColumn("density", F.greatest(F.col(cum) - F.lag(cum, 1, 0.0).over(w), F.lit(0.0)))


def median_mad(df: DataFrame, x: str) -> DataFrame:
    """One row: exact median, and the median of the rounded absolute deviations."""
    m = df.agg(F.median(x).alias("median"))
    return df.crossJoin(F.broadcast(m)).groupBy("median").agg(F.median(F.round(F.abs(F.col(x) - F.col("median")))).alias("mad"))


def length_filter(df: DataFrame, x: str, min_reads: int, spread: float = 10.0) -> DataFrame:
    """(x, n): lengths in (0, median + spread * MAD] seen at least min_reads times; all of them if that is 0."""
    counts = df.groupBy(x).agg(F.count("*").alias("n"))
    if not min_reads:
        return counts
    # the scalars are one row
    return counts.crossJoin(F.broadcast(median_mad(df, x))).where((F.col(x) > 0) & (F.col(x) <= F.col("median") + spread * F.col("mad")) & (F.col("n") >= min_reads)).select(x, "n")


def normal_fit(counts: DataFrame, x: str, n: str = "n") -> DataFrame:
    """Weighted mean and population standard deviation."""
    sums = counts.agg(F.sum(n).alias("w"), F.sum(F.col(x) * F.col(n)).alias("s"), F.sum(F.col(x) * F.col(x) * F.col(n)).alias("q"))
    mean = F.col("s") / F.col("w")
    return sums.select(mean.alias("mean"), F.sqrt(F.greatest(F.col("q") / F.col("w") - mean * mean, F.lit(0.0))).alias("sd"), F.col("w").alias("n"))


def sv_fit(variants: DataFrame, kind: str, span: str, min_span: int = 50, min_count: int = 2) -> DataFrame:
    """Per type: count, share, mean and population sd of ln(span); spans of breakends are not asked for."""
    known = variants.where((F.col(kind) == "BND") | (F.col(span) >= min_span))
    per = known.groupBy(kind).agg(F.count("*").alias("n"), F.avg(F.log(span)).alias("mu"), F.stddev_pop(F.log(span)).alias("sigma")).where(F.col("n") >= min_count)
    return shares(per, [])


def variant_mix(variants: DataFrame, kind: str, hom: str) -> DataFrame:
    """One row: shares of SNP, INS and DEL, share of homozygous ones (0.001 / n when there is none), insertion share."""
    c = lambda k: F.sum((F.col(kind) == k).cast("long"))
    a = variants.where(F.col(kind).isin("SNP", "INS", "DEL")).agg(F.count("*").alias("n"), c("SNP").alias("snp"), c("INS").alias("ins"), c("DEL").alias("del"), F.sum(F.col(hom).cast("long")).alias("hom"))
    none = F.col("n") == 0
    share = lambda k: F.when(none, F.lit(1 / 3)).otherwise(F.col(k) / F.col("n"))
    hom_share = F.when(none, F.lit(0.0)).when(F.col("hom") == 0, F.lit(0.001) / F.col("n")).otherwise(F.col("hom") / F.col("n"))
    indel = F.when((F.col("ins") == 0) | (F.col("del") == 0), F.lit(0.5)).otherwise(F.col("ins") / (F.col("ins") + F.col("del")))
    return a.select("n", share("snp").alias("p_snp"), share("ins").alias("p_ins"), share("del").alias("p_del"), hom_share.alias("p_hom"), indel.alias("insertion_share"))


def gc_bins(windows: DataFrame, text: str = "text", cover: str = "depth", min_windows: int = 1) -> DataFrame:
    """gc (0..100), windows, mean depth and weight: bin mean over overall mean of the bins with enough windows, else 1."""
    from pyspark.sql import SparkSession

    upper = lambda ch: F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))
    called = F.length(F.regexp_replace(text, "[^ACGTacgt]", ""))
    w = windows.withColumn("called", called).where("called > 0").withColumn("gc", F.round(F.lit(100.0) * (upper("G") + upper("C")) / F.col("called")).cast("int"))
    per = w.groupBy("gc").agg(F.count("*").alias("windows"), F.sum(cover).alias("total"))
    enough = F.col("windows") >= min_windows
    overall = per.where(enough).agg((F.sum("total") / F.sum("windows")).alias("overall"))
    spark = windows.sparkSession or SparkSession.active()
    grid = spark.range(101).select(F.col("id").cast("int").alias("gc"))
    mean = F.col("total") / F.col("windows")
    weight = F.when(enough & (F.col("overall") > 0), mean / F.col("overall")).otherwise(1.0)
    return grid.join(per, "gc", "left").crossJoin(F.broadcast(overall)).select("gc", F.coalesce("windows", F.lit(0)).alias("windows"), mean.alias("mean_depth"), F.coalesce(weight, F.lit(1.0)).alias("weight"))


def quality_counts(reads: DataFrame, id_: str, quals: str, places: int | None = None) -> DataFrame:
    """(pos, prev, cur, n) of all reads: prev is -1 at a read's start.  Array lag, so reads are never dealt out by base.

    With ``places`` the positions of a read of any length are scaled to that many.
    """
    q = F.col(quals)
    at = (lambda i: i) if places is None else (lambda i: F.least(F.floor(i * F.lit(places).cast("long") / F.size(q)), F.lit(places - 1)).cast("int"))
    steps = F.transform(F.sequence(F.lit(0), F.size(q) - 1), lambda i: F.struct(at(i).alias("pos"), F.coalesce(F.when(i > 0, F.get(q, i - 1)), F.lit(-1)).cast("int").alias("prev"), F.get(q, i).cast("int").alias("cur")))
    rows = reads.where(F.size(q) > 0).select(F.explode(steps).alias("s")).select("s.*")
    return rows.groupBy("pos", "prev", "cur").agg(F.count("*").alias("n"))


def dense_transitions(counts: DataFrame, states: list, given: str, to: str, n: str = "n") -> DataFrame:
    """Row-normalised matrix over all states; a row never seen is uniform."""
    spark = counts.sparkSession
    grid = spark.createDataFrame([(a, b) for a in states for b in states], f"{given} {counts.schema[given].dataType.simpleString()}, {to} {counts.schema[to].dataType.simpleString()}")
    got = grid.join(counts.groupBy(given, to).agg(F.sum(n).alias("n")), [given, to], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(given))
    return got.withColumn("p", F.when(total > 0, F.col("n") / total).otherwise(F.lit(1.0) / len(states)))


def base_changes(counts: DataFrame, ref: str = "ref", alt: str = "alt", n: str = "n") -> DataFrame:
    """4 x 4 changes with a zero diagonal; a base never seen is 1/3 to each other."""
    spark = counts.sparkSession
    grid = spark.createDataFrame([(a, b) for a in BASES for b in BASES], f"{ref} string, {alt} string")
    got = grid.join(counts.where(F.col(ref) != F.col(alt)).groupBy(ref, alt).agg(F.sum(n).alias("n")), [ref, alt], "left").fillna(0, ["n"])
    total = F.sum("n").over(Window.partitionBy(ref))
    return got.withColumn("p", F.when(F.col(ref) == F.col(alt), 0.0).when(total > 0, F.col("n") / total).otherwise(1 / 3))
