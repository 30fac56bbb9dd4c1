"""Simulation queries: no SQL can state them, tests check their laws and determinism."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import simulate
from ._registry import Registry

query = Registry()


def contigs(t):
    return t.documents.select(F.col("doc_id").cast("string").alias("contig"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq")).where(F.length("seq") > 0)


@query()
def read_emission(t):
    fasta = contigs(t)
    regions = fasta.select("contig", F.lit(0).cast("long").alias("start"), F.length("seq").cast("long").alias("end"))
    v = simulate.draw_variants(fasta, 0.01, {"SNP": 0.8, "INS": 0.1, "DEL": 0.1}, 0.3, seed=7)
    frags = simulate.fragments(regions, 2.0, 50, 120, 20, seed=7)
    return simulate.emit_reads(frags, fasta, v, 50, seed=7).select("name", "contig", "mate", "pos", "seq")


@query()
def sv_placement(t):
    c = contigs(t).select("contig", F.length("seq").cast("long").alias("length"))
    return simulate.place_svs(c, 0.004, {"DEL": 0.5, "DUP": 0.3, "INV": 0.2}, 4.2, 0.3, seed=7)


@query()
def chimeric_reads(t):
    return simulate.junction_reads(sv_placement(t), contigs(t), 10.0, 50)


QUERIES, ORACLE_SQL = query.queries, query.sql
