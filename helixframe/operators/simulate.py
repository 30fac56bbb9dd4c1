"""Generative operators: variants, fragments, qualities, reads, junctions.

Every draw is a hash of (seed, stream, key), so results do not depend on
partitioning, cluster size or retries.  Only placement with rejection is
sequential; it runs by contig on the few structural variants that it has.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import randomness as R
from ..functions import sequence as S
from ..functions import variants as V
from . import intervals

BASES = ["A", "C", "G", "T"]


def draw_variants(fasta: DataFrame, rate: float, mix: dict[str, float], hom: float, seed: int, mean_indel: float = 3.0) -> DataFrame:
    """contig, pos (1-based), ref, alt, vtype, gt: floor(length * rate) draws a contig, the first a position wins.

    A deletion that would run off its contig becomes a SNP; N is never a reference base.
    """
    n = F.floor(F.length("seq") * rate).cast("int")
    d = fasta.where(n > 0).withColumn("k", F.explode(F.sequence(F.lit(1), n)))
    u = lambda stream: R.uniform("contig", "k", seed=seed, stream=stream)
    d = d.withColumn("pos", (F.floor(u("pos") * F.length("seq")) + 1).cast("int"))
    total = sum(mix.values())
    kind = F.when(u("kind") < mix["SNP"] / total, "SNP").when(u("kind") < (mix["SNP"] + mix["INS"]) / total, "INS").otherwise("DEL")
    size = (F.floor(-F.log(1 - u("size")) * (mean_indel - 1)) + 1).cast("int")
    d = d.withColumn("size", size).withColumn("kind", F.when((kind == "DEL") & (F.col("pos") + F.col("size") > F.length("seq")), "SNP").otherwise(kind))
    here = F.upper(F.substr("seq", F.col("pos"), F.lit(1)))
    d = d.withColumn("base", here).where(F.col("base").isin(BASES))
    others = F.array_remove(F.array(*[F.lit(b) for b in BASES]), F.col("base"))
    inserted = F.array_join(F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: R.choose(F.array(*[F.lit(b) for b in BASES]), R.uniform("contig", "k", i, seed=seed, stream="ins"))), "")
    ref = F.when(F.col("kind") == "DEL", F.upper(F.substr("seq", F.col("pos"), F.col("size") + 1))).otherwise(F.col("base"))
    alt = F.when(F.col("kind") == "SNP", R.choose(others, u("alt"))).when(F.col("kind") == "INS", F.concat("base", inserted)).otherwise(F.col("base"))
    v = d.select("contig", F.col("pos").cast("long").alias("pos"), ref.alias("ref"), alt.alias("alt"), F.col("kind").alias("vtype"), F.when(u("hom") < hom, "1/1").otherwise("0/1").alias("gt"), "k")
    first = v.groupBy("contig", "pos").agg(F.min_by(F.struct("ref", "alt", "vtype", "gt"), "k").alias("v"))
    return first.select("contig", "pos", "v.*")


def fragments(regions: DataFrame, coverage: float, read_length: int, mean: float, sd: float, seed: int, paired: bool = True) -> DataFrame:
    """contig, frag, start, end: ceil(length * coverage / bases a fragment) stratified starts a region (contig, start, end).

    Each start falls into a stratum of its own, which keeps the mean depth and evens it out.
    """
    length = F.col("end") - F.col("start")
    n = F.ceil(length * coverage / (read_length * (2 if paired else 1))).cast("int")
    r = regions.where((n > 0) & (length >= read_length)).withColumn("n", n).withColumn("frag", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    key = ("contig", "start", "frag")
    size = F.greatest(F.lit(read_length), R.normal(R.uniform(*key, seed=seed, stream="size"), mean, sd).cast("int")) if paired else F.lit(read_length)
    at = F.floor((F.col("frag") + R.uniform(*key, seed=seed, stream="start")) / F.col("n") * length).cast("long")
    r = r.withColumn("_size", F.least(size.cast("long"), length)).withColumn("_s", F.col("start") + F.least(at, length - F.col("_size")))
    return r.select("contig", F.concat_ws(":", "start", "frag").alias("frag"), F.col("_s").alias("start"), (F.col("_s") + F.col("_size")).alias("end"))


def suppress(fragments_: DataFrame, junctions: DataFrame, read_length: int, seed: int) -> DataFrame:
    """Drops pairs with probability the largest broken share among junctions inside either read's window."""
    win = fragments_.select("contig", "frag", F.explode(F.array(F.struct(F.col("start").alias("s"), (F.col("start") + read_length).alias("e")), F.struct((F.col("end") - read_length).alias("s"), F.col("end").alias("e")))).alias("w"))
    win = win.select("contig", "frag", F.col("w.s").alias("start"), F.col("w.e").alias("end"))
    hit = intervals.points_in(junctions, win, how="inner").groupBy("contig", F.col("i_frag").alias("frag")).agg(F.max("fraction").alias("broken"))
    u = R.uniform("contig", "frag", seed=seed, stream="suppress")
    return fragments_.join(hit, ["contig", "frag"], "left").where(u >= F.coalesce("broken", F.lit(0.0))).drop("broken")


def quality_string(seed_table: list[tuple[int, float]], transitions: dict[int, list[tuple[int, float]]], length: Column, key: list, seed: int) -> Column:
    """Array of qualities by a Markov chain: a fold over places; a first quality of 31 becomes 30."""
    def pick(rows, u):
        out, cum = F.lit(rows[-1][0]), 0.0
        expr = None
        for q, p in rows:
            cum += p
            expr = F.when(u <= cum, q) if expr is None else expr.when(u <= cum, q)
        return expr.otherwise(out)

    states = sorted(transitions)
    def step(acc, i):
        u = R.uniform(*key, i, seed=seed, stream="q")
        prev = F.element_at(acc, -1)
        expr = None
        for s in states:
            row = pick(transitions[s], u)
            expr = F.when(prev == s, row) if expr is None else expr.when(prev == s, row)
        return F.concat(acc, F.array(expr.otherwise(prev).cast("int")))

    first = pick(seed_table, R.uniform(*key, seed=seed, stream="q0")).cast("int")
    chain = F.aggregate(F.sequence(F.lit(1), length - 1), F.array(first), step)
    first_fixed = F.when(F.element_at(chain, 1) == 31, F.lit(30)).otherwise(F.element_at(chain, 1))
    return F.concat(F.array(first_fixed), F.slice(chain, F.lit(2), F.greatest(length - 1, F.lit(0))))


def emit_reads(frags: DataFrame, fasta: DataFrame, variants: DataFrame, read_length: int, seed: int, error_quality: int = 30, paired: bool = True) -> DataFrame:
    """name, contig, mate, pos, seq, quals, cigar-free reads of fragments: variants that they carry, then errors by quality.

    A fragment carries a heterozygous variant with probability 1/2.  Sequences
    are looked up by contig chunk, so no task holds more than a chunk's rows.
    """
    v = variants.select("contig", F.col("pos"), "ref", "alt", "gt")
    got = intervals.points_in(v.withColumn("_p0", F.col("pos")), frags, how="inner", one_based=True)
    carried = got.where((F.col("gt") == "1/1") | (R.uniform("contig", "i_frag", "pos", seed=seed, stream="allele") < 0.5))
    # inside the fragment as a whole, or it would be cut off
    carried = carried.where(F.col("pos") - 1 + F.length("ref") <= F.col("i_end"))
    edits = carried.groupBy("contig", F.col("i_frag").alias("frag")).agg(F.array_sort(F.collect_list(F.struct((F.col("pos") - F.col("i_start")).alias("pos"), "ref", "alt"))).alias("edits"))
    x = frags.join(edits, ["contig", "frag"], "left").join(fasta.select("contig", F.col("seq").alias("_seq")), "contig")
    piece = F.upper(F.substr("_seq", (F.col("start") + 1).cast("int"), (F.col("end") - F.col("start")).cast("int")))
    x = x.withColumn("piece", piece).withColumn("piece", F.when(F.col("edits").isNull(), F.col("piece")).otherwise(S.apply_edits("piece", drop_overlaps(F.col("edits")))))
    mates = F.array(F.struct(F.lit(1).alias("mate"), F.substring("piece", 1, read_length).alias("s"), F.col("start").alias("p")), *([F.struct(F.lit(2).alias("mate"), S.reverse_complement(F.substr("piece", F.greatest(F.length("piece") - read_length + 1, F.lit(1)), F.lit(read_length))).alias("s"), (F.col("end") - read_length).alias("p"))] if paired else []))
    r = x.select("contig", "frag", F.explode(mates).alias("m")).select("contig", "frag", "m.*").withColumn("b", S.bases("s"))
    p_err = 10 ** (-error_quality / 10)
    noisy = F.transform("b", lambda c, i: F.when(R.uniform("contig", "frag", "mate", i, seed=seed, stream="err") < p_err, R.choose(F.array_remove(F.array(*[F.lit(z) for z in BASES]), c), R.uniform("contig", "frag", "mate", i, seed=seed, stream="sub"))).otherwise(c))
    return r.select(F.concat_ws("_", F.lit("SIM_generated"), "contig", "p", F.col("p") + F.length("s"), F.md5("frag")).alias("name"), "contig", "mate", (F.col("p") + 1).alias("pos"), F.array_join(noisy, "").alias("seq"), F.array_repeat(F.lit(error_quality), F.length("s")).alias("quals"))


def drop_overlaps(edits: Column) -> Column:
    """Sorted edits without those that start inside an earlier one."""
    end = lambda e: e["pos"] + F.length(e["ref"])
    keep = lambda acc, e: F.when((F.size(acc) == 0) | (e["pos"] >= end(F.element_at(acc, -1))), F.concat(acc, F.array(e))).otherwise(acc)
    return F.aggregate(edits, F.slice(edits, 1, 0), keep)


def allele_counts(reads: DataFrame, variants: DataFrame) -> DataFrame:
    """contig, pos, ref_count, alt_count of SNPs from reads (first mates' forward bases): partial and final sums."""
    end = reads.where("mate = 1").select("contig", (F.col("pos") - 1).alias("start"), (F.col("pos") - 1 + F.length("seq")).alias("end"), "seq")
    hit = intervals.points_in(variants.where("vtype = 'SNP'"), end, how="inner", one_based=True)
    base = F.substr("i_seq", (F.col("pos") - F.col("i_start")).cast("int"), F.lit(1))
    return hit.groupBy("contig", "pos").agg(F.count_if(base == F.col("ref")).alias("ref_count"), F.count_if(base == F.col("alt")).alias("alt_count"))


def place_svs(contigs: DataFrame, rate: float, kinds: dict[str, float], mu: float, sigma: float, seed: int, tries: int = 50) -> DataFrame:
    """contig, pos, end, kind, gt of structural variants that do not overlap; contigs: contig, length.

    A Poisson number a contig; lengths are log-normal; a place that overlaps an
    earlier one is drawn again, up to ``tries`` times.
    """
    names, total = list(kinds), sum(kinds.values())
    schema = pa.schema([("contig", pa.string()), ("pos", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("gt", pa.string())])

    def uniform(*key) -> float:
        return int(hashlib.md5("|".join(map(str, (seed, *key))).encode()).hexdigest()[:8], 16) / 2**32

    def place(contig: str, length: int) -> list[dict]:
        mean, n, t = length * rate, 0, 0.0
        if mean < 30:
            while (t := t - math.log(1 - uniform("gap", contig, n))) < mean:
                n += 1
        else:
            n = max(0, round(NormalDist(mean, math.sqrt(mean)).inv_cdf(min(max(uniform("count", contig), 1e-9), 1 - 1e-9))))
        out, taken = [], []
        for k in range(n):
            u, cum, kind = uniform("kind", contig, k) * total, 0.0, names[-1]
            for name in names:
                cum += kinds[name]
                if u < cum:
                    kind = name
                    break
            z = NormalDist().inv_cdf(min(max(uniform("size", contig, k), 1e-9), 1 - 1e-9))
            size = min(max(50, round(math.exp(mu + sigma * z))), length)
            for i in range(tries):
                first = int(uniform("place", contig, k, i) * (length - size + 1)) + 1
                at = bisect.bisect(taken, (first, first + size))
                if (at == 0 or taken[at - 1][1] < first) and (at == len(taken) or first + size < taken[at][0]):
                    taken.insert(at, (first, first + size))
                    out.append({"contig": contig, "pos": first, "end": first + size - 1, "kind": kind, "gt": "1/1" if uniform("hom", contig, k) < 1 / 3 else "0/1"})
                    break
        return out

    def run(it):
        for b in it:
            rows = [r for c, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in place(c, n)]
            yield pa.RecordBatch.from_pylist(rows, schema)

    return contigs.select("contig", F.col("length").cast("long").alias("length")).mapInArrow(run, "contig string, pos long, end long, kind string, gt string")


def junction_reads(svs: DataFrame, fasta: DataFrame, coverage: float, read_length: int) -> DataFrame:
    """Reads across new junctions: round(coverage * share of broken copies) a junction, offsets balanced."""
    j = svs.select("contig", "pos", "kind", F.when(F.col("gt") == "1/1", 1.0).otherwise(0.5).alias("share"), F.posexplode(V.junction_pieces("kind", "pos", "end", F.lit(read_length))).alias("j", "p"))
    j = j.join(fasta.select("contig", "seq"), "contig")
    cut = lambda p: F.upper(F.substr("seq", F.col(f"{p}.start").cast("int"), F.greatest(F.col(f"{p}.end") - F.col(f"{p}.start") + 1, F.lit(0)).cast("int")))
    side = lambda p: F.when(F.col(f"{p}.reversed"), S.reverse_complement(cut(p))).otherwise(cut(p))
    j = j.withColumn("l", side("p.left")).withColumn("whole", F.concat("l", side("p.right")))
    n = F.round(F.lit(coverage) * F.col("share")).cast("int")
    j = j.where(n > 0).withColumn("n", n).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n"))))
    at = F.greatest(F.length("l") - F.floor(F.lit(read_length) * F.col("k") / (F.col("n") + 1)).cast("int"), F.lit(0))
    return j.select("contig", "pos", "kind", "j", "k", F.substr("whole", at + 1, F.lit(read_length)).alias("seq"))


def split_coverage(total: float, purity: float) -> tuple[int, int]:
    """(normal, tumor), rounded half away from zero."""
    half = lambda x: math.floor(x + 0.5)
    return half(total * (1 - purity)), half(total * purity)
