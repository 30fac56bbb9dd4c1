"""Variant, genotype, INFO and alignment-flag expressions (1-based positions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LITERAL = "^[ACGTNacgtn]+$"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def four_digits(x) -> Column:
    """A double from 0 to 1 with four digits as C's printf gives it: by the value it has in binary, halves to even.

    Java and Spark round the shortest decimal instead: 153/160 prints as 0.95625 but lies above it.
    """
    v = _c(x).cast("double")
    k = F.floor(v * 10000).cast("long")
    # v * 20000 - (2k + 1) to its sign: the upper 26 bits of v and the others multiply without rounding
    c = v * F.lit(134217729.0)
    high = c - (c - v)
    over = (high * 20000 - (2 * k + 1)) + (v - high) * 20000
    k = k + ((over > 0) | ((over == 0) & (k % 2 == 1))).cast("long")
    return F.when(v.isNotNull(), F.format_string("%d.%04d", F.floor(k / 10000), k % 10000))


def allele_class(ref, alt) -> Column:
    """SNP, INS, DEL or COMPLEX of literal alleles; null for any other."""
    r, a = _c(ref), _c(alt)
    one = lambda x: F.length(x) == 1
    kind = F.when(one(r) & one(a), "SNP").when(one(r), "INS").when(one(a), "DEL").otherwise("COMPLEX")
    return F.when(r.rlike(LITERAL) & a.rlike(LITERAL), kind)


def symbolic_class(alt) -> Column:
    """DEL, DUP, CNV, INS, INV, BND or UNKNOWN; null for literal alleles."""
    a = _c(alt)
    tag = F.regexp_extract(a, r"^<([^:>]+)", 1)
    return (
        F.when(a.rlike(LITERAL), F.lit(None))
        .when(tag.isin("DEL", "DUP", "CNV", "INS", "INV", "BND"), tag)
        .when(a.rlike(r"[\[\]][^:]+:\d+[\[\]]") | a.rlike(r"^\.[ACGTNacgtn]+$") | a.rlike(r"^[ACGTNacgtn]+\.$"), "BND")
        .otherwise("UNKNOWN")
    )


def breakend(alt) -> Column:
    """Mate contig and place, whether the mate joins after this base, and whether it extends right of its place."""
    a = _c(alt)
    pattern = r"[\[\]]([^:]+):(\d+)[\[\]]"
    hit = a.rlike(pattern)
    opening = F.regexp_extract(a, r"([\[\]])", 1)
    return F.when(
        hit,
        F.struct(
            F.regexp_extract(a, pattern, 1).alias("mate_contig"),
            F.regexp_extract(a, pattern, 2).cast("long").alias("mate_pos"),
            (~a.startswith("[") & ~a.startswith("]")).alias("join_after"),
            (opening == "[").alias("mate_right"),
        ),
    )


def info_value(info, key: str) -> Column:
    """Text of KEY=...; null if absent."""
    return F.nullif(F.regexp_extract(_c(info), f"(?:^|;){key}=([^;]*)", 1), F.lit(""))


def info_fields(info, pos) -> Column:
    """END, SVLEN, CN and SVTYPE; malformed numbers and an END before POS are null."""
    number = lambda k: info_value(info, k).try_cast("long")
    end = number("END")
    return F.struct(F.when(end >= _c(pos), end).alias("end"), number("SVLEN").alias("svlen"), number("CN").alias("cn"), info_value(info, "SVTYPE").alias("svtype"))


def svtype_agrees(svtype, kind) -> Column:
    """Case-insensitive; an unknown kind agrees with anything, as does no SVTYPE."""
    return _c(svtype).isNull() | (F.upper(_c(kind)) == "UNKNOWN") | (F.upper(_c(svtype)) == F.upper(_c(kind)))


def genotype_label(gt) -> Column:
    """HET if any called allele is the reference, else HOM."""
    called = F.filter(F.split(_c(gt), r"[/|]"), lambda x: x != ".")
    return F.when(F.exists(called, lambda x: x == "0"), "HET").otherwise("HOM")


def genotype_text(label, ploidy: int = 2) -> Column:
    """0/1-like text of a label: HOM has the alternate everywhere."""
    hom, het = "/".join(["1"] * ploidy), "/".join(["0"] * (ploidy - 1) + ["1"])
    return F.when(_c(label) == "HOM", hom).otherwise(het)


def allele_fraction(info, ad=None, forms=("info", "ad")) -> Column:
    """First value of AF= in INFO, else alternate share of AD; not positive or not finite is null, above 1 is 1."""
    af = F.split(info_value(info, "AF"), ",")[0].try_cast("double")
    parts = F.transform(F.split(_c(ad), ","), lambda x: x.try_cast("double")) if ad is not None else None
    total = F.aggregate(parts, F.lit(0.0), lambda a, x: a + x) if ad is not None else None
    from_ad = F.when(total > 0, F.get(parts, F.lit(1)) / total) if ad is not None else F.lit(None).cast("double")
    value = F.coalesce(*[{"info": af, "ad": from_ad}[k] for k in forms])
    return F.when((value > 0) & ~F.isnan(value) & (value < float("inf")), F.least(value, F.lit(1.0)))


def sv_span(kind, pos, end, svlen) -> Column:
    """Reference bases covered: END - POS + 1, else |SVLEN|; an insertion's inserted bases."""
    length = F.abs(_c(svlen))
    return F.when(_c(kind) == "INS", length).otherwise(F.coalesce(_c(end) - _c(pos) + 1, length))


def append_info(info, tag) -> Column:
    return F.when(_c(info).isin("", ".") | _c(info).isNull(), _c(tag)).otherwise(F.concat(_c(info), F.lit(";"), _c(tag)))


def sv_info(kind, end, svlen, cn) -> Column:
    """SVTYPE, END, SVLEN and CN, those that are known."""
    pair = lambda k, v: F.concat(F.lit(f"{k}="), _c(v).cast("string"))
    return F.concat_ws(";", F.concat(F.lit("SVTYPE="), _c(kind)), pair("END", end), pair("SVLEN", svlen), pair("CN", cn))


def copy_multiplier(kind, cn, hom, ploidy: int = 2) -> Column:
    """Coverage inside a structural variant relative to outside; null for a CNV without copy number."""
    by_cn = _c(cn) / ploidy
    return (
        F.when(_c(cn).isNotNull(), by_cn)
        .when(_c(kind) == "DEL", F.when(_c(hom), 0.0).otherwise((ploidy - 1) / ploidy))
        .when(_c(kind) == "DUP", F.when(_c(hom), 2.0).otherwise((ploidy + 1) / ploidy))
        .when(_c(kind) == "CNV", F.lit(None).cast("double"))
        .otherwise(1.0)
    )


def modulation_range(kind, pos, end, length) -> Column:
    """0-based half-open range whose coverage changes; a deletion's starts after its anchor base; clipped."""
    start = F.when(_c(kind) == "DEL", _c(pos)).otherwise(_c(pos) - 1)
    return F.struct(F.least(F.greatest(start, F.lit(0)), _c(length)).alias("start"), F.least(F.greatest(_c(end), F.lit(0)), _c(length)).alias("end"))


def junction_points(kind, pos, end) -> Column:
    """Places whose straddling pairs break: both ends of an inversion, else the start."""
    return F.when(_c(kind) == "INV", F.array(_c(pos), _c(end))).when(_c(kind).isin("BND", "DEL", "CNV"), F.array(_c(pos))).otherwise(F.array().cast("array<bigint>"))


def junction_pieces(kind, pos, end, flank) -> Column:
    """Two pieces (start, end, reversed) around each new junction of a variant; 1-based closed."""
    p, e, f = _c(pos), _c(end), _c(flank)
    piece = lambda a, b, rev: F.struct(F.greatest(a, F.lit(1)).alias("start"), b.alias("end"), F.lit(rev).alias("reversed"))
    two = lambda x, y: F.struct(x.alias("left"), y.alias("right"))
    deletion = F.array(two(piece(p - f + 1, p, False), piece(e + 1, e + f, False)))
    duplication = F.array(two(piece(e - f + 1, e, False), piece(p + 1, p + f, False)))
    inversion = F.array(two(piece(p - f + 1, p, False), piece(e - f + 1, e, True)), two(piece(p + 1, p + f, True), piece(e + 1, e + f, False)))
    return F.when(_c(kind) == "DEL", deletion).when(_c(kind) == "DUP", duplication).when(_c(kind) == "INV", inversion)


def scale_coverage(base, multiplier) -> Column:
    x = _c(base) * _c(multiplier)
    return F.when(F.isnan(x) | x.isNull() | (x <= 0) | (x == float("inf")), F.lit(0).cast("long")).otherwise(F.round(x).cast("long"))


#: fixed values: bits of alignment flags
PAIRED, PROPER, UNMAPPED, MATE_UNMAPPED, REVERSE, MATE_REVERSE, FIRST, LAST, SECONDARY, QC_FAIL, DUPLICATE, SUPPLEMENTARY = (1 << k for k in range(12))


def flags(paired, reverse, first) -> Column:
    """Flag of a proper pair's mate on a strand (99, 147, 83, 163), or of a single read (0, 16)."""
    pair = F.lit(PAIRED + PROPER) + F.when(_c(reverse), REVERSE).otherwise(MATE_REVERSE) + F.when(_c(first), FIRST).otherwise(LAST)
    return F.when(_c(paired), pair).otherwise(F.when(_c(reverse), REVERSE).otherwise(0))


def alignment_filter(preset: str, flag="flag", mapq="mapq", ref="ref", mate_ref="mate_ref", min_mapq: int = 10) -> Column:
    """Predicates of the shared scan: ``fragment`` (first mates of mapped pairs on one contig), ``bases`` and ``coverage``."""
    f = _c(flag)
    bad = SECONDARY | SUPPLEMENTARY | DUPLICATE | QC_FAIL | UNMAPPED
    clean = f.bitwiseAND(F.lit(bad)) == 0
    high = _c(mapq) > min_mapq
    if preset == "coverage":
        return clean
    if preset == "bases":
        return clean & high
    pair = (f.bitwiseAND(F.lit(PAIRED | FIRST)) == PAIRED | FIRST) & (f.bitwiseAND(F.lit(MATE_UNMAPPED)) == 0)
    return clean & high & pair & ((_c(mate_ref) == _c(ref)) | (_c(mate_ref) == "="))


def template_length(tlen) -> Column:
    return F.nullif(F.abs(_c(tlen)), F.lit(0))


def chromosome(name) -> Column:
    """With chr prefix, MT as M."""
    bare = F.regexp_replace(F.trim(_c(name)), "^(?i)chr", "")
    return F.concat(F.lit("chr"), F.when(F.upper(bare) == "MT", "M").otherwise(F.upper(bare)))


def chromosome_order(name) -> Column:
    """Numbers first, then X, Y, M, then the rest."""
    bare = F.regexp_replace(_c(name), "^chr", "")
    return F.when(bare.rlike(r"^\d+$"), bare.try_cast("int")).when(bare == "X", 1001).when(bare == "Y", 1002).when(bare == "M", 1003).otherwise(2000)


def mate_pair_key(a_contig, a_pos, b_contig, b_pos) -> Column:
    """One key for both directions of a breakend pair."""
    a, b = F.struct(_c(a_contig).alias("contig"), _c(a_pos).alias("pos")), F.struct(_c(b_contig).alias("contig"), _c(b_pos).alias("pos"))
    return F.struct(F.least(a, b).alias("low"), F.greatest(a, b).alias("high"))
