"""The pipeline's stages on the small tables: what each keeps and drops."""

import shutil
from collections import Counter

import corpus_pipeline
import numpy as np
import pytest
from conftest import SMALL
from test_operators import SPLIT, WORDS, brute_hits, brute_near

STAGES = dict(corpus_pipeline.STAGES)
NAMES = list(STAGES)


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.select("doc_id", "text").collect()}


def test_stages(spark):
    """Each stage against brute force on what its predecessor kept."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    good = STAGES[NAMES[0]](spark, docs, SMALL).cache()
    assert good.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    kept = texts(good)
    assert sum((d in kept) == bool(v) for d, v in labels.items()) > 0.95 * len(labels)
    one = STAGES[NAMES[1]](spark, good, SMALL).cache()
    assert texts(one) == {i: kept[i] for i, (_, c) in brute_near(kept.items()).items() if c == i}
    clean = STAGES[NAMES[2]](spark, one, SMALL).cache()
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    before = texts(one)
    assert texts(clean) == {i: before[i] for i, hit in brute_hits(before.items(), items).items() if not hit[4]}
    mixed = STAGES[NAMES[3]](spark, clean, SMALL).cache()
    assert mixed.columns == docs.columns and mixed.count() > 0
    whole, words = texts(clean), Counter()
    for r in mixed.collect():
        assert not Counter(SPLIT.findall(r["text"])) - Counter(SPLIT.findall(whole[r["doc_id"]]))
        words[r["doc_id"]] += len(SPLIT.findall(r["text"]))
    assert all(n <= 2 * len(SPLIT.findall(whole[i])) for i, n in words.items())
    tokens = STAGES[NAMES[4]](spark, mixed, SMALL).collect()
    assert len(tokens) == mixed.count()
    at = 0
    for r in sorted(tokens, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]


@pytest.mark.parametrize("rows", [True, False])
def test_any_columns_and_no_rows(spark, tmp_path, rows):
    rng = np.random.default_rng(9)
    base = " ".join(rng.choice(WORDS, 300))
    data = [(1, base, "a"), (2, base, "a"), (2, base, "b"), (None, base + " x", None), (None, None, "b"), (5, None, "a"), (6, "", "b"), (7, " ".join(rng.choice(WORDS, 900)), "b")]
    names = ["_id", "pass", "th", "_units", "_th", "row", "h", "c", "d", "copy", "shard", "id", "key", "doc", "kept", "score", "start", "sk", "units", "words", "a b"]
    schema = "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names)
    docs = spark.createDataFrame([(*r, *["q"] * len(names)) for r in data] if rows else [], schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        shutil.copy(f"{SMALL}/{t}.parquet", tmp_path / f"{t}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert len(got) > 0 if rows else not got
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name in NAMES[1:4]:
        out = STAGES[name](spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.collect()
