"""Joins and algebra on half-open intervals (contig, start, end).

Overlap joins are equi joins on (contig, bin): intervals are copied to the bins
they touch and a pair counts in one bin only, so a contig with most of the rows
spreads over its bins instead of landing in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.sequence(F.floor(start / width).cast("long"), F.floor(F.greatest(end - 1, start) / width).cast("long"))


def points_in(points: DataFrame, intervals: DataFrame, pos: str = "pos", how: str = "semi", width: int = 1024, one_based: bool = False) -> DataFrame:
    """Points of (contig, pos) with start <= p < end; how: semi, anti or inner (interval columns prefixed i_).

    By default positions are compared as they are, whatever their base; with
    ``one_based`` the comparison is shifted to the 0-based interval.
    """
    cols = points.columns
    p = F.col(pos) - 1 if one_based else F.col(pos)
    iv = intervals.select("contig", F.explode(_bins(F.col("start"), F.col("end"), width)).alias("_bin"), *[F.col(c).alias(f"i_{c}") for c in intervals.columns if c != "contig"])
    pts = points.withColumn("_p", p).withColumn("_bin", F.floor(p / width).cast("long"))
    on = (pts["contig"] == iv["contig"]) & (pts["_bin"] == iv["_bin"]) & (F.col("_p") >= F.col("i_start")) & (F.col("_p") < F.col("i_end"))
    if how == "inner":
        return pts.join(iv, on).select(*[pts[c] for c in cols], *[c for c in iv.columns if c.startswith("i_")])
    return pts.join(iv, on, f"left_{how}").select(*cols)


def overlaps(a: DataFrame, b: DataFrame, how: str = "inner", width: int = 1024) -> DataFrame:
    """Rows of a that overlap rows of b: a.start < b.end and b.start < a.end (columns of b prefixed b_)."""
    cols = a.columns
    x = a.withColumn("_bin", F.explode(_bins(F.col("start"), F.col("end"), width)))
    y = b.select(F.col("contig").alias("b_contig"), *[F.col(c).alias(f"b_{c}") for c in b.columns if c != "contig"]).withColumn("_b", F.explode(_bins(F.col("b_start"), F.col("b_end"), width)))
    hit = (F.col("start") < F.col("b_end")) & (F.col("b_start") < F.col("end"))
    on = (F.col("contig") == F.col("b_contig")) & (F.col("_bin") == F.col("_b")) & hit
    if how == "inner":
        # one bin of a pair counts: that of the later start
        once = F.floor(F.greatest("start", "b_start") / width).cast("long") == F.col("_bin")
        return x.join(y, on & once).select(*cols, *[c for c in y.columns if c not in ("_b", "b_contig")])
    if how == "semi":
        return x.join(y, on, "left_semi").select(*cols).distinct()
    raise ValueError(how)


def intersect(a: DataFrame, b: DataFrame, width: int = 1024) -> DataFrame:
    """Clipped pieces of a inside b: contig, start, end and both sides' other columns."""
    got = overlaps(a, b, width=width)
    return got.withColumns({"start": F.greatest("start", "b_start"), "end": F.least("end", "b_end")}).drop("b_start", "b_end")


def breakpoints(*frames: DataFrame) -> DataFrame:
    """Elementary segments between all starts and ends of a contig."""
    cuts = None
    for f in frames:
        c = f.select("contig", F.explode(F.array("start", "end")).alias("start"))
        cuts = c if cuts is None else cuts.unionByName(c)
    w = Window.partitionBy("contig").orderBy("start")
    return cuts.distinct().withColumn("end", F.lead("start").over(w)).where("end is not null")


def override(segments: DataFrame, overrides: DataFrame, value: str = "value", order: str = "ord") -> DataFrame:
    """Segments with values replaced inside overrides (later ones win); gaps between segments stay gaps."""
    atoms = breakpoints(segments, overrides)
    base = overlaps(atoms, segments.select("contig", "start", "end", value)).select("contig", "start", "end", F.col(f"b_{value}").alias("_v"))
    over = overlaps(atoms, overrides.select("contig", "start", "end", value, order)).groupBy("contig", "start", "end").agg(F.max_by(f"b_{value}", f"b_{order}").alias("_o"), F.lit(True).alias("_hit"))
    return base.join(over, ["contig", "start", "end"], "left").select("contig", "start", "end", F.when(F.col("_hit"), F.col("_o")).otherwise(F.col("_v")).alias(value))


def multiply(segments: DataFrame, factors: DataFrame, value: str = "value") -> DataFrame:
    """Segments with values multiplied by all factors that cover them."""
    atoms = breakpoints(segments, factors)
    base = overlaps(atoms, segments.select("contig", "start", "end", value)).select("contig", "start", "end", F.col(f"b_{value}").alias("_v"))
    f = overlaps(atoms, factors.select("contig", "start", "end", value)).groupBy("contig", "start", "end").agg(F.array_sort(F.collect_list(f"b_{value}")).alias("_f"))
    product = F.aggregate(F.coalesce("_f", F.array().cast("array<double>")), F.lit(1.0), lambda a, x: a * x)
    return base.join(f, ["contig", "start", "end"], "left").select("contig", "start", "end", (F.col("_v") * product).alias(value))


def exclude_points(segments: DataFrame, points: DataFrame, value: str = "value") -> DataFrame:
    """Segments split around points [p, p + 1)."""
    holes = points.select("contig", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), F.lit(None).cast("double").alias(value), F.lit(1).alias("ord"))
    return override(segments.select("contig", "start", "end", F.col(value).cast("double").alias(value)), holes, value).where(F.col(value).isNotNull())


def value_at(points: DataFrame, segments: DataFrame, value: str = "value", width: int = 1024) -> DataFrame:
    """The value of the segment that holds each point; null outside (segments are disjoint)."""
    got = points_in(points, segments, how="inner", width=width).groupBy(*points.columns).agg(F.max(f"i_{value}").alias(value))
    return points.join(got, points.columns, "left")


def chunks(regions: DataFrame, size: int) -> DataFrame:
    """Even split into ceil(length / size) chunks; the first length % n are one longer."""
    n = F.ceil((F.col("end") - F.col("start")) / size).cast("long")
    r = regions.withColumn("_n", n).where("_n > 0").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    length = F.col("end") - F.col("start")
    small, longer = F.expr("(end - start) div _n"), length % F.col("_n")
    first = F.col("start") + F.col("chunk") * small + F.least(F.col("chunk"), longer)
    return r.withColumn("_s", first).withColumn("_e", F.col("_s") + small + (F.col("chunk") < longer).cast("long")).drop("start", "end", "_n").withColumnsRenamed({"_s": "start", "_e": "end"})


def shards(contigs: DataFrame, stride: int) -> DataFrame:
    """Fixed windows of (contig, length), the last one clipped."""
    r = contigs.where("length > 0").withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(stride).cast("long"))))
    return r.withColumn("end", F.least(F.col("start") + stride, F.col("length")))


def depth(intervals: DataFrame) -> DataFrame:
    """Run-length coverage (contig, start, end, depth > 0) from +1 / -1 events, never a dense array."""
    events = intervals.select("contig", F.explode(F.array(F.struct(F.col("start").alias("p"), F.lit(1).alias("d")), F.struct(F.col("end").alias("p"), F.lit(-1).alias("d")))).alias("e"))
    at = events.groupBy("contig", F.col("e.p").alias("start")).agg(F.sum("e.d").alias("d"))
    w = Window.partitionBy("contig").orderBy("start")
    runs = at.withColumns({"end": F.lead("start").over(w), "depth": F.sum("d").over(w)})
    return runs.where("depth > 0").select("contig", "start", "end", "depth")


def band_pairs(a: DataFrame, b: DataFrame, w: int) -> DataFrame:
    """Pairs with |a.pos - b.pos| <= w on a contig: each b goes to its own bin and both neighbours of width w."""
    width = max(1, w)
    x = a.withColumn("_bin", F.floor(F.col("pos") / width).cast("long"))
    y = b.select(*[F.col(c).alias(f"b_{c}") for c in b.columns]).withColumn("_b", F.explode(F.sequence(F.floor(F.col("b_pos") / width).cast("long") - 1, F.floor(F.col("b_pos") / width).cast("long") + 1)))
    return x.join(y, (F.col("contig") == F.col("b_contig")) & (F.col("_bin") == F.col("_b")) & (F.abs(F.col("pos") - F.col("b_pos")) <= w)).drop("_bin", "_b", "b_contig")


def windows(seqs: DataFrame, size: int, stride: int) -> DataFrame:
    """(contig, start, text) of whole windows of a sequence."""
    n = F.length("seq")
    r = seqs.where(n >= size).withColumn("start", F.explode(F.sequence(F.lit(0), (n - size).cast("int"), F.lit(stride))))
    return r.select("contig", F.col("start").cast("long").alias("start"), F.substr("seq", F.col("start") + 1, F.lit(size)).alias("text"))


def n_runs(seqs: DataFrame, inside: str = "N") -> DataFrame:
    """(contig, start, end, is_n) of alternating runs, ascending; islands found without a row for each base."""
    r = seqs.select("contig", F.posexplode(F.regexp_extract_all("seq", F.lit(f"([{inside}]+|[^{inside}]+)"), F.lit(1))).alias("k", "run"))
    w = Window.partitionBy("contig").orderBy("k")
    end = F.sum(F.length("run")).over(w)
    return r.select("contig", (end - F.length("run")).alias("start"), end.alias("end"), F.col("run").rlike(f"^[{inside}]").alias("is_n"))
