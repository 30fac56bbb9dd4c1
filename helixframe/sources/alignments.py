"""Alignments: SAM text, a BAM data source, coverage, mismatches and SAM output."""

from __future__ import annotations

import gzip
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

COLUMNS = ("name", "flag", "ref", "pos", "mapq", "cigar", "mate_ref", "mate_pos", "tlen", "seq", "qual")
SCHEMA = "name string, flag int, ref string, pos long, mapq int, cigar string, mate_ref string, mate_pos long, tlen long, seq string, qual string, md string"


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    f = F.split("value", "\t")
    kinds = {"flag": "int", "pos": "long", "mapq": "int", "mate_pos": "long", "tlen": "long"}
    x = spark.read.text(path).where(~F.col("value").startswith("@") & (F.length("value") > 0))
    cols = [(F.get(f, F.lit(k)).try_cast(kinds[c]) if c in kinds else F.get(f, F.lit(k))).alias(c) for k, c in enumerate(COLUMNS)]
    return x.select(*cols, F.nullif(F.regexp_extract("value", r"\tMD:Z:([^\t]+)", 1), F.lit("")).alias("md"))


#: fixed values: letters of the BAM encodings of bases and operations
BAM_BASES, BAM_OPS = "=ACMGRSVTWYHKDBN", "MIDNSHP=X"


def decode_bam(data: bytes) -> Iterator[tuple]:
    """Records of a decompressed BAM stream."""
    if data[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", data, 4)[0]
    n = struct.unpack_from("<i", data, at)[0]
    at += 4
    refs = []
    for _ in range(n):
        size = struct.unpack_from("<i", data, at)[0]
        refs.append(data[at + 4 : at + 3 + size].decode())
        at += 8 + size
    while at < len(data):
        size, ref, pos, l_name, mapq, _, n_ops, flag, l_seq, mref, mpos, tlen = struct.unpack_from("<iiiBBHHHiiii", data, at)
        p, end = at + 36, at + 4 + size
        name = data[p : p + l_name - 1].decode()
        p += l_name
        ops = struct.unpack_from(f"<{n_ops}I", data, p)
        p += 4 * n_ops
        packed = data[p : p + (l_seq + 1) // 2]
        seq = "".join(BAM_BASES[b >> 4] + BAM_BASES[b & 15] for b in packed)[:l_seq]
        p += (l_seq + 1) // 2
        qual = bytes(min(q, 93) + 33 for q in data[p : p + l_seq]).decode()
        md = re.search(rb"MDZ([^\0]*)\0", data[p + l_seq : end])
        yield (
            name, flag, refs[ref] if ref >= 0 else "*", pos + 1, mapq, "".join(f"{o >> 4}{BAM_OPS[o & 15]}" for o in ops) or "*",
            refs[mref] if mref >= 0 else "*", mpos + 1, tlen, seq, qual, md[1].decode() if md else None,
        )
        at = end


def encode_bam(header: str, contigs: list[tuple[str, int]], records: list[tuple]) -> bytes:
    """A BAM file (gzip members are valid BGZF for readers that take any gzip) of rows like decode_bam's."""
    ids = {c: k for k, (c, _) in enumerate(contigs)} | {"*": -1}
    out = [b"BAM\1", struct.pack("<i", len(header)), header.encode(), struct.pack("<i", len(contigs))]
    for c, n in contigs:
        out.append(struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", n))
    for name, flag, ref, pos, mapq, cigar, mref, mpos, tlen, seq, qual, md in records:
        ops = [(int(n) << 4) | BAM_OPS.index(o) for n, o in re.findall(r"(\d+)([MIDNSHP=X])", cigar)]
        codes = [BAM_BASES.index(b) for b in seq] + [0] * (len(seq) % 2)
        packed = bytes(a << 4 | b for a, b in zip(codes[::2], codes[1::2], strict=True))
        tags = b"MDZ" + md.encode() + b"\0" if md else b""
        body = struct.pack("<iiBBHHHiiii", ids[ref], pos - 1, len(name) + 1, mapq, 4680, len(ops), flag, len(seq), ids[mref], mpos - 1, tlen)
        body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + packed + bytes(ord(c) - 33 for c in qual) + tags
        out.append(struct.pack("<i", len(body)) + body)
    return gzip.compress(b"".join(out))


class _File(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class _BamReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self):
        import glob

        return [_File(p) for p in sorted(glob.glob(self.path))]

    def read(self, partition):
        with open(partition.value, "rb") as f:
            yield from decode_bam(gzip.decompress(f.read()))


class BamDataSource(DataSource):
    """``spark.read.format("bam").load(glob)`` for files that workers see under the same path."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _BamReader(self.options["path"])


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """BAM from any Hadoop path: Spark lists and fetches the files, tasks decode them."""

    def run(it):
        for b in it:
            for raw in b.column(0):
                rows = list(decode_bam(gzip.decompress(raw.as_py())))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 12
                kinds = [pa.string(), pa.int32(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, SCHEMA)


def covered(reads: DataFrame) -> DataFrame:
    """contig, start, end (0-based) of aligned stretches: M, = and X cover, D and N skip."""
    ops = F.regexp_extract_all("cigar", F.lit(r"(\d+[MIDNSHP=X])"), F.lit(1))
    step = lambda acc, o: F.struct(
        (acc["at"] + F.when(F.substring(o, -1, 1).isin("M", "=", "X", "D", "N"), F.regexp_extract(o, r"^(\d+)", 1).cast("long")).otherwise(F.lit(0).cast("long"))).alias("at"),
        F.when(F.substring(o, -1, 1).isin("M", "=", "X"), F.concat(acc["out"], F.array(F.struct(acc["at"].alias("start"), (acc["at"] + F.regexp_extract(o, r"^(\d+)", 1).cast("long")).alias("end"))))).otherwise(acc["out"]).alias("out"),
    )
    start = F.struct((F.col("pos") - 1).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("out"))
    return reads.where("cigar is not null and cigar <> '*'").select(F.col("ref").alias("contig"), F.explode(F.aggregate(ops, start, step)["out"]).alias("s")).select("contig", "s.*")


def mismatches_of(seq: str, cigar: str, md: str) -> list[tuple[str, str]]:
    """(reference base, read base) of aligned bases, by walking CIGAR and MD together; A, C, G and T only."""
    aligned = []
    at = 0
    for n, op in re.findall(r"(\d+)([MIDNSHP=X])", cigar):
        if op in "M=X":
            aligned.append(seq[at : at + int(n)])
        if op in "MIS=X":
            at += int(n)
    read = "".join(aligned)
    ref, k = list(read), 0
    for n, deleted, base in re.findall(r"(\d+)|(\^[A-Za-z]+)|([A-Za-z])", md):
        if n:
            k += int(n)
        elif base and k < len(ref):
            ref[k] = base
            k += 1
    return [(a, b) for a, b in zip("".join(ref).upper(), read.upper(), strict=True) if a in "ACGT" and b in "ACGT"]


def mismatch_counts(reads: DataFrame) -> DataFrame:
    """(ref, alt, n) over all reads: each batch is counted before anything moves."""

    def run(it):
        from collections import Counter

        for b in it:
            c: Counter = Counter()
            for s, g, m in zip(*[b.column(k).to_pylist() for k in range(3)], strict=True):
                c.update(mismatches_of(s, g, m))
            rows = sorted(c.items())
            yield pa.RecordBatch.from_pydict({"ref": [k[0] for k, _ in rows], "alt": [k[1] for k, _ in rows], "n": pa.array([v for _, v in rows], pa.int64())}, schema=pa.schema([("ref", pa.string()), ("alt", pa.string()), ("n", pa.int64())]))

    rows = reads.where("md is not null and seq is not null").select("seq", "cigar", "md")
    return rows.mapInArrow(run, "ref string, alt string, n long").groupBy("ref", "alt").agg(F.sum("n").alias("n"))


def write_sam(reads: DataFrame, contigs: list[tuple[str, int]], path: str, mode: str = "error") -> None:
    """Coordinate-sorted SAM text with a header; a contig that the header lacks raises."""
    order = F.create_map(*[F.lit(x) for k, (c, _) in enumerate(contigs) for x in (c, k)])[F.col("ref")]
    order = F.coalesce(order, F.raise_error(F.concat(F.lit("unknown contig "), "ref")).cast("int"))
    rows = reads.select(F.lit(1).alias("part"), order.alias("c"), "pos", F.concat_ws("\t", *[F.col(x).cast("string") for x in COLUMNS]).alias("value"))
    head = ["@HD\tVN:1.6\tSO:coordinate", *[f"@SQ\tSN:{c}\tLN:{n}" for c, n in contigs]]
    h = reads.sparkSession.createDataFrame([(0, 0, k, x) for k, x in enumerate(head)], "part int, c int, pos long, value string")
    h.unionByName(rows).orderBy("part", "c", "pos", "value").select("value").write.mode(mode).text(path)
