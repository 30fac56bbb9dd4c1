"""Comparison of call sets: classification, equivalence of haplotypes, attribution of misses."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["contig", "pos", "ref", "alt"]


def split_sets(truth: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tp distinct keys, fn rows, fp rows)."""
    tp = truth.select(*KEY).intersect(calls.select(*KEY))
    return tp, truth.join(calls.select(*KEY), KEY, "left_anti"), calls.join(truth.select(*KEY), KEY, "left_anti")


def skip_reason(in_contigs: Column, symbolic: Column, hom_ref: Column, filtered: Column, in_target: Column) -> Column:
    """The first filter that a row fails, in fixed order; null for rows that stay."""
    return (
        F.when(~in_contigs, "outside_simulated_contigs")
        .when(symbolic, "symbolic")
        .when(hom_ref, "hom_ref")
        .when(filtered, "filtered")
        .when(~in_target, "outside_target_bed")
    )


def miss_reasons(in_contigs: Column, in_target: Column, in_mutation: Column) -> Column:
    """Why a truth variant could not be called; a variant off the contigs or the target has that reason alone."""
    return (
        F.when(~in_contigs, F.array(F.lit("outside_simulated_contigs")))
        .when(~in_target, F.array(F.lit("outside_target_bed")))
        .when(~in_mutation, F.array(F.lit("outside_mutation_bed")))
        .otherwise(F.array().cast("array<string>"))
    )


def naming_mismatch(a: DataFrame, b: DataFrame, sample: int = 5) -> DataFrame:
    """Contig names of a that b lacks: their number and the first few."""
    only = a.select("contig").distinct().join(b.select("contig").distinct(), "contig", "left_anti")
    return only.agg(F.count("*").alias("n"), F.slice(F.sort_array(F.collect_list("contig")), 1, sample).alias("sample"))


def rename_contigs(df: DataFrame, alias: DataFrame) -> DataFrame:
    """contig replaced where the alias table (bed_name, reference_name) knows it."""
    a = alias.select(F.col("bed_name").alias("contig"), "reference_name")
    return df.join(a, "contig", "left").withColumn("contig", F.coalesce("reference_name", "contig")).drop("reference_name")


def apply_all(seq: str, offset: int, edits: list[tuple[int, str, str]]) -> str | None:
    """seq (0-based from offset) with 1-based edits applied; null if they clash with each other or the sequence."""
    out, at = [], offset
    for pos, ref, alt in sorted(edits):
        p = pos - 1
        if p < at or seq[p - offset : p - offset + len(ref)].upper() != ref.upper():
            return None
        out += [seq[at - offset : p - offset], alt]
        at = p + len(ref)
    return "".join([*out, seq[at - offset :]])


def sweep(seq: str, fps: list[tuple], fns: list[tuple], window: int) -> tuple[set[int], set[int]]:
    """Indices of false calls and misses that spell the same haplotype.

    For each unconsumed false call in input order, all unconsumed calls and
    misses within the window are applied; equal strings consume both sides.
    """
    used_fp: set[int] = set()
    used_fn: set[int] = set()
    for i, (pos, *_rest) in enumerate(fps):
        if i in used_fp:
            continue
        lo, hi = max(0, pos - 1 - window), min(len(seq), pos + window)
        inside = lambda rows, used: [k for k, (p, r, _) in enumerate(rows) if k not in used and lo <= p - 1 and p - 1 + len(r) <= hi]  # noqa: B023, E731
        a, b = inside(fps, used_fp), inside(fns, used_fn)
        if not a or not b:
            continue
        x, y = (apply_all(seq[lo:hi], lo, [rows[k] for k in ks]) for rows, ks in ((fps, a), (fns, b)))
        if x is not None and y is not None and x.upper() == y.upper():
            used_fp |= set(a)
            used_fn |= set(b)
    return used_fp, used_fn


def equivalent(fp: DataFrame, fn: DataFrame, reference: DataFrame, window: int = 50) -> DataFrame:
    """(side fp|fn, contig, ord) of rows that the sweep matches; fp and fn carry ord, their input order.

    Greedy in input order, so it runs by cluster: rows farther apart than any
    window can reach start a new one, which bounds each group by local density.
    """
    from pyspark.sql import Window

    both = fp.withColumn("side", F.lit("fp")).unionByName(fn.withColumn("side", F.lit("fn"))).select("side", "contig", "pos", "ref", "alt", "ord")
    w = Window.partitionBy("contig").orderBy("pos", "side", "ord")
    reach = F.max(F.col("pos") + F.length("ref")).over(w.rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("new", (F.coalesce(F.col("pos") - reach > 4 * window, F.lit(True))).cast("long")).withColumn("cluster", F.sum("new").over(w)).drop("new")
    kinds = both.groupBy("contig", "cluster").agg(F.countDistinct("side").alias("k"), F.min("pos").alias("lo"), F.max(F.col("pos") + F.length("ref")).alias("hi")).where("k = 2")
    start = F.greatest(F.col("lo") - 1 - 2 * window, F.lit(0))
    regions = kinds.join(reference.select("contig", "seq"), "contig").select("contig", "cluster", start.alias("offset"), F.substr("seq", (start + 1).cast("int"), (F.col("hi") + 2 * window - start).cast("int")).alias("piece"))
    rows = both.join(regions, ["contig", "cluster"])

    def run(t: pa.Table) -> pa.Table:
        got = sorted(t.to_pylist(), key=lambda r: r["ord"])
        off = got[0]["offset"]
        out = []
        sides = {s: [r for r in got if r["side"] == s] for s in ("fp", "fn")}
        used = sweep(got[0]["piece"], *[[(r["pos"] - off, r["ref"], r["alt"]) for r in sides[s]] for s in ("fp", "fn")], window)
        for s, ks in zip(("fp", "fn"), used, strict=True):
            out += [{"side": s, "contig": sides[s][k]["contig"], "ord": sides[s][k]["ord"]} for k in sorted(ks)]
        return pa.Table.from_pylist(out, pa.schema([("side", pa.string()), ("contig", pa.string()), ("ord", pa.int64())]))

    return rows.groupBy("contig", "cluster").applyInArrow(run, "side string, contig string, ord long")


def origin_merge(tumor: DataFrame, normal: DataFrame, key: list[str], provenance: str = "provenance") -> DataFrame:
    """Tumor rows plus normal rows that tumor lacks, labelled somatic, shared or germline."""
    t = tumor.withColumn("origin", F.when(F.col(provenance) == "denovo", "somatic").otherwise("shared"))
    return t.unionByName(normal.join(tumor.select(*key), key, "left_anti").withColumn("origin", F.lit("germline")))


def regression_gate(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """PASS, FAIL or SKIP of each baseline metric by its gate: exact, ge2sd, band or lepct<n>."""
    m = metrics.select("metric", F.col("value").alias("now"))
    j = baseline.join(m, "metric", "left")
    now, want, sd = F.col("now").try_cast("double"), F.col("value").try_cast("double"), F.coalesce(F.col("sd").try_cast("double"), F.lit(0.0))
    pct = F.regexp_extract("gate", r"^lepct(\d+)$", 1).try_cast("double")
    ok = (
        F.when(F.col("gate") == "exact", F.col("now") == F.col("value"))
        .when(F.col("gate") == "ge2sd", now >= want - 2 * sd)
        .when(F.col("gate") == "band", F.abs(now - want) <= 2 * sd)
        .when(pct.isNotNull(), now <= want * (1 + pct / 100))
    )
    return j.withColumn("status", F.when(F.col("now").isNull(), "SKIP").when(F.coalesce(ok, F.lit(False)), "PASS").otherwise("FAIL"))
