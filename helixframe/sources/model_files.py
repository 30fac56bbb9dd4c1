"""Fitted models as gzip JSON for interchange; Parquet is the primary form."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(parts: dict[str, DataFrame], path: str, mode: str = "error") -> None:
    """One JSON line a row: {"part": name, "row": {...}}."""
    out = None
    for name, df in sorted(parts.items()):
        rows = df.select(F.to_json(F.struct(F.lit(name).alias("part"), F.struct(*df.columns).alias("row"))).alias("value"))
        out = rows if out is None else out.unionByName(rows)
    out.write.mode(mode).option("compression", "gzip").text(path)


def load(spark: SparkSession, path: str, schemas: dict[str, str]) -> dict[str, DataFrame]:
    lines = spark.read.text(path)
    part = F.get_json_object("value", "$.part")
    return {n: lines.where(part == n).select(F.from_json(F.get_json_object("value", "$.row"), s).alias("r")).select("r.*") for n, s in schemas.items()}


def graft(model: dict[str, DataFrame], donor: dict[str, DataFrame], names: list[str]) -> dict[str, DataFrame]:
    """The model with the named parts of another."""
    return model | {n: donor[n] for n in names}


def report(counts: list[dict], skipped: dict[str, int], reasons: dict[str, int], warnings: list[str], paths: dict[str, str]) -> str:
    """The comparison report as JSON; ``counts`` are rows of the TP/FN/FP rollup."""
    total = next((c for c in counts if c["contig"] == "TOTAL"), {})
    skipped = {"multiallelic": 0} | skipped
    return json.dumps({"schema_version": "1.3.0", "summary": total, "per_contig": {c["contig"]: c for c in counts if c["contig"] != "TOTAL"}, "skipped": skipped, "fn_reasons": reasons, "warnings": warnings, "paths": paths}, indent=2, sort_keys=True)
