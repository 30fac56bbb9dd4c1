"""A corpus pipeline of five stages over ``documents``.

Each stage reads what its predecessor kept; all but the last return the columns
of ``documents``, whatever their names.  The mix may return a document twice (a
row for each pass) and a part of a document where a source's target ends inside it.

Nulls: a null text is scored like a text without lines, is near to nothing, holds
no benchmark and is not mixed (it has no words); rows of a null doc_id stay in
every stage that does not decide by content.  Rows that repeat a doc_id stay or go
together in the second and third stage and are mixed one by one.  Of documents
that are near duplicates the smallest doc_id stays.  An empty table passes
through every stage and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import _shared, decontaminate, mixing, near_dedup, quality, token_output


def _without(docs: DataFrame, found: DataFrame) -> DataFrame:
    """docs but for the rows with a doc_id in found; the key takes a name that docs does not have."""
    key = "_" * (1 + max(map(len, docs.columns)))
    gone = found.select(F.col("doc_id").alias(key)).distinct()
    return docs.join(gone, F.col("doc_id").cast("long") == F.col(key), "left_anti")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line CRF, fitted on the labelled ones among them, rejects go."""
    model = quality.fit(docs, _shared.read(spark, sf_dir, "labels"))
    return quality.keep_good(docs, model)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies stays."""
    return _without(docs, near_dedup.near_duplicates(docs).where(~F.col("kept")))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with at least a twentieth of their words in benchmark windows go."""
    found = decontaminate.report(decontaminate.find_benchmark(docs, _shared.read(spark, sf_dir, "benchmark")))
    return _without(docs, found.where("contaminated"))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights; a row for each pass over a document."""
    shards, _, _ = mixing.mix(docs)
    return mixing.take_text(docs, shards)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, and what they hold per row: doc_id, start, n_tokens, ids_crc32."""
    out = _shared.new_folder(spark, "pipeline-tokens")
    return token_output.decode_files(spark, out, token_output.encode_documents(docs, out, token_output.default_tokenizer()))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("source_mixing", source_mixing),
    ("token_files", token_files),
]

#: no SQL for a random field, MinHash, or a keyed mix: tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = _shared.store(docs, f"pipeline-{k}-{name}")
    return docs
