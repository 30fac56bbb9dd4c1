"""Sequence and quality expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def reverse_complement(s) -> Column:
    return F.reverse(F.translate(_c(s), "ACGTacgt", "TGCAtgca"))


def reverse_record(seq, cigar, quals) -> Column:
    """A read as seen from the other strand: sequence complemented, operations and qualities reversed."""
    return F.struct(reverse_complement(seq).alias("seq"), F.reverse(_c(cigar)).alias("cigar"), F.reverse(_c(quals)).alias("quals"))


def unmask(s) -> Column:
    return F.upper(_c(s))


def mask(s) -> Column:
    return F.lower(_c(s))


def canonical(s) -> Column:
    """Upper case, N as A."""
    return F.translate(F.upper(_c(s)), "N", "A")


def subsequence(s, start: int | Column, n: int | Column) -> Column:
    """From a 1-based position."""
    return F.substring(_c(s), start, n) if isinstance(start, int) and isinstance(n, int) else F.substr(_c(s), F.lit(start) if isinstance(start, int) else start, F.lit(n) if isinstance(n, int) else n)


def same_bases(a, b) -> Column:
    return F.upper(_c(a)) == F.upper(_c(b))


def bases(s) -> Column:
    """Array of characters (split once: repeated substring calls are quadratic)."""
    return F.when(F.length(_c(s)) > 0, F.split(_c(s), "")).otherwise(F.array().cast("array<string>"))


def kmers(chars, k: int = 3) -> Column:
    """All k-mers of an array of characters."""
    a = _c(chars)
    all_ = F.transform(F.sequence(F.lit(0), F.size(a) - k), lambda i: F.concat(*[F.get(a, i + j) for j in range(k)]))
    return F.when(F.size(a) >= k, all_).otherwise(F.array().cast("array<string>"))


def runs(s, inside: str = "N") -> Column:
    """Alternating runs of a character class and its complement, in order."""
    return F.regexp_extract_all(_c(s), F.lit(f"([{inside}]+|[^{inside}]+)"), F.lit(1))


def n_fraction(s) -> Column:
    return (F.length(_c(s)) - F.length(F.replace(_c(s), F.lit("N"), F.lit("")))) / F.length(_c(s))


def apply_edits(s, edits) -> Column:
    """Applies array<struct<pos, ref, alt>> (1-based, not overlapping), from the right so that places hold."""
    right_first = F.reverse(F.array_sort(_c(edits)))
    put = lambda acc, e: F.concat(F.substr(acc, F.lit(1), (e["pos"] - 1).cast("int")), e["alt"], F.substr(acc, (e["pos"] + F.length(e["ref"])).cast("int")))
    return F.aggregate(right_first, _c(s), put)


def stitch(*pieces: Column) -> Column:
    """Junction sequence: pieces concatenated, a null piece as nothing."""
    return F.concat(*[F.coalesce(p, F.lit("")) for p in pieces])


def pyrimidine_context(context, alt) -> Column:
    """(context, alt) on the strand whose middle base is C or T."""
    swap = F.substring(_c(context), 2, 1).isin("A", "G")
    return F.struct(F.when(swap, reverse_complement(context)).otherwise(_c(context)).alias("context"), F.when(swap, reverse_complement(alt)).otherwise(_c(alt)).alias("alt"))


def adapter_pad(s, adapter, length: int) -> Column:
    """A read that runs past its fragment goes on into the adapter, repeated as needed."""
    short = F.greatest(F.lit(0), F.lit(length) - F.length(_c(s)))
    times = F.ceil(F.lit(length) / F.length(_c(adapter))).cast("int")
    return F.concat(F.substring(_c(s), 1, length), F.substr(F.repeat(_c(adapter), times), F.lit(1), short.cast("int")))


def phred_char(q) -> Column:
    return F.chr(_c(q) + 33)


def phred_score(ch) -> Column:
    return F.least(F.greatest(F.ascii(_c(ch)) - 33, F.lit(0)), F.lit(93))


def phred_string(quals) -> Column:
    return F.array_join(F.transform(_c(quals), lambda q: F.chr(q + 33)), "")


def error_probability(q) -> Column:
    return F.pow(F.lit(10.0), -_c(q) / 10)


def snap_to_bin(q, bins: list[int]) -> Column:
    """The nearest bin, ties to the lower one."""
    return F.array_min(F.array(*[F.struct(F.abs(F.lit(b) - _c(q)).alias("d"), F.lit(b).alias("b")) for b in bins]))["b"]


def remap_index(i, length, to: int) -> Column:
    """Place of a read of one length in a model trained on another."""
    return F.least(F.greatest(F.floor(F.lit(to) * _c(i) / _c(length)), F.lit(0)), F.lit(to - 1))


def run_length(ops) -> Column:
    """CIGAR text of an array of operations, by a fold that closes a run when the operation changes."""
    step = lambda acc, o: F.when(acc["op"] == o, F.struct(acc["done"].alias("done"), acc["op"].alias("op"), (acc["n"] + 1).alias("n"))).otherwise(
        F.struct(F.when(acc["n"] > 0, F.concat(acc["done"], acc["n"].cast("string"), acc["op"])).otherwise(acc["done"]).alias("done"), o.alias("op"), F.lit(1).alias("n"))
    )
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("op"), F.lit(0).alias("n"))
    return F.aggregate(_c(ops), start, step, lambda acc: F.when(acc["n"] > 0, F.concat(acc["done"], acc["n"].cast("string"), acc["op"])).otherwise(acc["done"]))


def read_name(prefix: str, contig, start, end, unique) -> Column:
    return F.format_string("%s_%s_%010d_%010d_%016x", F.lit(prefix), _c(contig), _c(start), _c(end), _c(unique))


#: fixed format of simulated reads' names: prefix, contig (may hold underscores), start, end, unique/mate
READ_NAME = r"^@?[A-Za-z]+_generated_(.+)_(\d+)_(\d+)_([0-9a-f]+)(?:/\d)?$"


def parse_read_name(name) -> Column:
    part = lambda k: F.nullif(F.regexp_extract(_c(name), READ_NAME, k), F.lit(""))
    return F.struct(part(1).alias("contig"), part(2).cast("long").alias("start"), part(3).cast("long").alias("end"))


#: fixed values: one-letter codes of the twenty amino acids
AMINO_ACIDS = {
    "A": "Alanine", "C": "Cysteine", "D": "Aspartic acid", "E": "Glutamic acid", "F": "Phenylalanine",
    "G": "Glycine", "H": "Histidine", "I": "Isoleucine", "K": "Lysine", "L": "Leucine",
    "M": "Methionine", "N": "Asparagine", "P": "Proline", "Q": "Glutamine", "R": "Arginine",
    "S": "Serine", "T": "Threonine", "V": "Valine", "W": "Tryptophan", "Y": "Tyrosine",
}


def amino_acid(code) -> Column:
    return F.create_map(*[F.lit(x) for kv in AMINO_ACIDS.items() for x in kv])[F.upper(_c(code))]


#: fixed values: IUPAC codes and the bases that each stands for
IUPAC = {"R": "AG", "Y": "CT", "M": "AC", "K": "GT", "S": "CG", "W": "AT", "H": "ACT", "B": "CGT", "V": "ACG", "D": "AGT"}


def resolve_iupac(ch, u) -> Column:
    """A code's base by a uniform number in [0, 1); other characters stay."""
    options = F.create_map(*[F.lit(x) for kv in IUPAC.items() for x in kv])[F.upper(_c(ch))]
    return F.when(options.isNull(), _c(ch)).otherwise(F.substr(options, (F.floor(_c(u) * F.length(options)) + 1).cast("int"), F.lit(1)))
