"""Document fingerprints: threshold-scaled sketches, in Spark SQL functions only.

A fingerprint keeps every hash of the text's distinct five-word shingles that
lies below ``fraction`` of the hash range, whatever the text's length; so the
sketches of very unequal texts are samples of one kind, containment and likeness
are estimated by plain set operations, and fingerprints merge (``merge``) into
that of the union.  A tag, the hash of the whole text, stands beside it: it alone
tells texts apart that have no hash below the threshold.

Words are runs of anything but space and \\t..\\r; a text with fewer than five
words, but not none, has its whole sequence as its one shingle.  Nulls: a null
text is an empty one.  Texts without a hash in either sketch are alike (1.0) if
their tags are equal, else not (0.0).  A null doc_id comes first.  Repeated
doc_ids follow each other in order of their text.  An empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _shared

TOP = (1 << 63) - 1
SPACES = r"[\x20\x09-\x0D]+"


def _shingle_hashes(words, n: int):
    """Of an array of word hashes; 63 bits, so that order is that of unsigned numbers."""
    cut = lambda h: h.bitwiseAND(F.lit(TOP))
    long = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: cut(F.xxhash64(*[F.get(words, i + k) for k in range(n)])))
    return F.when(F.size(words) >= n, long).when(F.size(words) > 0, F.array(cut(F.xxhash64(words)))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(df: DataFrame, text: str, out: str, fraction: float = 1 / 4, n: int = 5) -> DataFrame:
    """Adds ``out``: struct<tag bigint, hashes array<bigint> (ascending)>."""
    limit = int(fraction * (1 << 63))
    # one step a projection: Catalyst keeps steps apart that are used more than once
    df = df.withColumn("_w", F.transform(F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), ""), lambda w: F.xxhash64(w)))
    df = df.withColumn("_s", _shingle_hashes(F.col("_w"), n)).drop("_w")
    low = F.array_sort(F.array_distinct(F.filter("_s", lambda h: h < limit)))
    return df.withColumn(out, F.struct(F.xxhash64(F.coalesce(text, F.lit(""))).alias("tag"), low.alias("hashes"))).drop("_s")


def as_text(fp: str):
    """tag:hash,hash,... in hexadecimal digits."""
    return F.concat(F.lower(F.hex(f"{fp}.tag")), F.lit(":"), F.lower(F.array_join(F.transform(f"{fp}.hashes", lambda h: F.hex(h)), ",")))


def merge(a: str, b: str):
    """The fingerprint of the union of both texts' shingles; its tag is theirs where they are equal, else 0."""
    tag = F.when(F.col(f"{a}.tag") == F.col(f"{b}.tag"), F.col(f"{a}.tag")).otherwise(F.lit(0).cast("long"))
    return F.struct(tag.alias("tag"), F.array_sort(F.array_union(f"{a}.hashes", f"{b}.hashes")).alias("hashes"))


def compare(df: DataFrame, a: str, b: str, likeness: str, containment: str | None = None) -> DataFrame:
    """Adds the estimated Jaccard likeness, and the share of the smaller one's shingles that the other has."""
    df = df.withColumn("_i", F.size(F.array_intersect(f"{a}.hashes", f"{b}.hashes"))).withColumn("_m", F.size(f"{a}.hashes")).withColumn("_n", F.size(f"{b}.hashes"))
    same = F.when(F.col(f"{a}.tag") == F.col(f"{b}.tag"), 1.0).otherwise(0.0)
    df = df.withColumn(likeness, F.when(F.col("_m") + F.col("_n") > 0, F.col("_i") / (F.col("_m") + F.col("_n") - F.col("_i"))).otherwise(same))
    if containment:
        least = F.least("_m", "_n")
        df = df.withColumn(containment, F.when(least > 0, F.col("_i") / least).otherwise(same))
    return df.drop("_i", "_m", "_n")


#: Ways that each of the three levels of ``_bucket`` divides.
FAN = 64


def _bucket(cuts: list[int]):
    """Number of cuts at or below doc_id, by three levels of lists (one literal each)."""
    lists = lambda x, kind: F.from_json(F.lit(json.dumps(x)), kind)
    below = lambda a: F.size(F.filter(a, lambda c: c <= F.col("doc_id")))
    if not cuts:
        return F.lit(0)
    step = FAN * FAN
    # level by level: the last cut at or below doc_id starts the list that goes on
    top = lists(cuts[::step], "array<bigint>")
    middle = lists([[]] + [cuts[i : i + step][FAN::FAN] for i in range(0, len(cuts), step)], "array<array<bigint>>")
    fine = lists([[]] + [cuts[i : i + FAN][1:] for i in range(0, len(cuts), FAN)], "array<array<bigint>>")
    i = below(top)
    j = below(F.get(middle, i))
    at = (i - 1) * FAN + j  # which list of FAN cuts
    return F.when(i == 0, 0).otherwise(at * FAN + 1 + below(F.get(fine, at + 1))).cast("int")


def with_next(docs: DataFrame, bucket_bytes: int = 8 << 20) -> tuple[DataFrame, object]:
    """(doc_id, text, flag) dealt by ranges of doc_id; flag 1 marks a copy of a row that follows the bucket's last one.

    Each range ends with a copy of its successor's first row, so that a window
    over the range, never over the table, finds the next document.  There is a range
    for each ``bucket_bytes`` of text, up to 64 ** 3 of them, beyond which ranges
    grow (to some 400 MB at 100 TB).
    """
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    a = src.agg(F.sum(F.octet_length("text")).alias("b"), F.min("doc_id").alias("lo"), F.max(F.col("doc_id").isNull()).alias("nulls")).first()
    n = int(min(FAN**3, max(1, (a["b"] or 0) // bucket_bytes)))
    cuts: list[int] = []
    if n > 1:
        # their error moves work between ranges, never a result
        found = src.agg(F.percentile_approx("doc_id", [k / n for k in range(1, n)], max(10_000, 16 * n))).first()[0]
        cuts = sorted({c for c in found or [] if c > a["lo"]})
    first = F.col("doc_id").isNull() if a["nulls"] else F.col("doc_id") == F.lit(a["lo"])
    at = _bucket(cuts)
    is_cut = F.array_contains(F.from_json(F.lit(json.dumps(cuts)), "array<bigint>"), F.col("doc_id")) if cuts else F.lit(False)
    put = lambda bucket, flag: F.struct(bucket.cast("int").alias("bucket"), F.lit(flag).alias("flag"))
    places = F.array(put(F.col("_at"), 0), F.when(F.coalesce(is_cut, F.lit(False)), put(F.col("_at") - 1, 1)), F.when(first, put(F.lit(len(cuts)), 2)))
    dealt = src.withColumn("_at", at).withColumn("_p", F.explode(F.filter(places, lambda x: x.isNotNull()))).select("doc_id", "text", "_p.bucket", "_p.flag")
    order = Window.partitionBy("bucket").orderBy("flag", "doc_id", "text")
    # ranges are dealt evenly, a few to a partition
    return dealt.repartitionByRange(len(cuts) + 1, "bucket"), order


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, order = with_next(_shared.read(spark, sf_dir, "documents"))
    rows = fingerprint(rows, "text", "fp")
    rows = rows.withColumn("next", F.lead(F.struct("text", "fp")).over(order)).where("flag = 0")
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    rows = rows.withColumn("n_chars", n.cast("long"))
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - quarter), F.substring(F.col("next.text"), F.lit(1), quarter)))
    rows = rows.select("doc_id", "n_chars", "edited", "fp", F.col("next.fp").alias("fp_next"))
    rows = fingerprint(rows, "edited", "fp_edited")
    rows = compare(rows, "fp", "fp_edited", "near_edited", "contained_edited")
    rows = compare(rows, "fp", "fp_next", "near_next", "contained_next")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), as_text("fp").alias("fingerprint"), as_text("fp_edited").alias("edited_fingerprint"),
        "near_edited", "near_next", "contained_edited", "contained_next",
    )
