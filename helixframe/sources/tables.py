"""Small text tables: contig aliases and 4 x 4 matrices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BASES = ("A", "C", "G", "T")


def parse_aliases(lines: DataFrame) -> DataFrame:
    """bed_name, reference_name; blank and # lines are skipped, others need two columns."""
    f = F.split("value", "\t")
    rows = lines.where(~F.trim("value").startswith("#") & (F.length(F.trim("value")) > 0))
    second = F.when(F.size(f) >= 2, f[1]).otherwise(F.raise_error(F.concat(F.lit("not two columns: "), "value")).cast("string"))
    return rows.select(F.trim(f[0]).alias("bed_name"), F.trim(second).alias("reference_name"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    return parse_aliases(spark.read.text(path))


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """ref, alt, p of a 4 x 4 table with rows A C G T and perhaps a header; the diagonal is 0, rows are shares."""
    # a file of five lines
    text = spark.read.text(path, wholetext=True).first()["value"]
    rows = []
    for line in text.splitlines():
        cells = line.split()
        try:
            rows.append([float(c) for c in cells[-4:]])
        except ValueError:
            continue
    rows = [r for r in rows if len(r) == 4]
    if len(rows) < 4:
        raise ValueError("a matrix needs four rows")
    out = []
    for i, row in enumerate(rows[:4]):
        row = [0.0 if i == j else x for j, x in enumerate(row)]
        total = sum(row)
        out += [(BASES[i], BASES[j], x / total if total else (0.0 if i == j else 1 / 3)) for j, x in enumerate(row)]
    return spark.createDataFrame(out, "ref string, alt string, p double")
