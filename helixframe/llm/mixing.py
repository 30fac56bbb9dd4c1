"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Sources share a budget of words by weight; a target stops at ``max_repeats``
times its source's size and the excess is shared anew by weight.  Documents are
cut into blocks of at most ``block_words`` words.  A source gives whole passes
over its blocks and then as many of them, in the order of a keyed hash, as meet
the target (the last block in part): its exact quota.

A tree over the output shards splits the quotas: at every node a
multivariate-hypergeometric draw decides how many blocks of each source go left.
So a shard has a run of each source's permuted deck, disjoint from all others,
and shards differ by one block at most.  ``mix`` writes the shards, each in the
order of another keyed hash (the local shuffle); what a mix takes is read from them.

Beyond ``max_decks`` sources, sources share decks by hash; a deck of several
sources is permuted as a whole, and a run of it holds each of them by the same
law.  All randomness comes from hashes of (seed, key) and generators seeded by
(seed, node), so reruns agree whatever the partitioning.

Nulls: a null source is a source of its own, ordered last; a null text has size
0.  Documents of size 0 have no blocks and are never taken.  Rows that repeat a
doc_id are mixed as separate rows, told apart by their text and, where that is
equal too, by a number (in order of source).  An empty table gives an empty mix.
Columns besides doc_id, text and source are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import _shared, _text

WORD = r"[^\x20\x09-\x0D]+"


def source_key(c="source"):
    """Code-point order, null last."""
    return F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("t"))


def _numbered(rows: DataFrame) -> DataFrame:
    """copy: 1, 2, ... of rows (doc_id, th, sk) that repeat doc_id and text hash."""
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy("doc_id", "th").orderBy("sk")))


def word_sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, sk: source key, th: hash of the text, copy, size) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return _numbered(docs.select("doc_id", source_key().alias("sk"), F.xxhash64(text).alias("th"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size")))


def targets(sizes: DataFrame, weights: list[float], share: float, max_repeats: float) -> DataFrame:
    """(sk, ord, source_size, weight, target) per source.

    Water filling without a loop: sources are capped in order of size / weight,
    the first one whose fair share fits ends it.  One row a source.
    """
    per = sizes.groupBy("sk").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("ord", F.row_number().over(Window.orderBy("sk")) - 1)
    w = F.array(*[F.lit(float(x)) for x in weights])
    per = per.withColumn("weight", F.element_at(w, (F.col("ord") % len(weights) + 1).cast("int")))
    per = per.withColumn("cap", F.lit(float(max_repeats)) * F.col("source_size"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "ord")
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    all_ = Window.partitionBy()
    per = per.withColumn("level", (F.lit(float(share)) * F.sum("source_size").over(all_) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after))
    # the level at the first source that it does not fill holds for all later ones
    per = per.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("ord"), F.col("level")))).over(all_)["level"])
    return per.select("sk", "ord", "source_size", "weight", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


class SplitTree:
    """Assigns (deck, place in it) to a shard; nodes are drawn when first asked for."""

    def __init__(self, counts: np.ndarray, n_shards: int, seed: int):
        self.n, self.seed, self.total = n_shards, seed, int(counts.sum())
        self.counts = {(0, n_shards): counts.astype(np.int64)}

    def size(self, lo: int, hi: int) -> int:
        """Shards differ by one unit at most."""
        return self.total * hi // self.n - self.total * lo // self.n

    def left(self, lo: int, hi: int) -> np.ndarray:
        mid = (lo + hi) // 2
        if (lo, mid) not in self.counts:
            have, m = self.counts[lo, hi], self.size(lo, mid)
            rng = np.random.Generator(np.random.PCG64([self.seed, lo, hi]))
            got, rest = np.zeros_like(have), int(have.sum())
            for s, c in enumerate(have.tolist()):  # conditional draws: the marginals of the multivariate law
                rest -= c
                got[s] = hypergeometric(rng, c, rest, m)
                m -= int(got[s])
            self.counts[lo, mid], self.counts[mid, hi] = got, have - got
        return self.counts[lo, mid]

    def assign(self, source: np.ndarray, pos: np.ndarray) -> np.ndarray:
        out = np.zeros(len(source), np.int64)
        todo = [(0, self.n, np.arange(len(source)), pos.astype(np.int64))]
        while todo:
            lo, hi, rows, p = todo.pop()
            if not len(rows):
                continue
            if hi - lo == 1:
                out[rows] = lo
                continue
            mid, q = (lo + hi) // 2, self.left(lo, hi)[source[rows]]
            go = p < q
            todo += [(lo, mid, rows[go], p[go]), (mid, hi, rows[~go], p[~go] - q[~go])]
        return out


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """numpy's sampler stops at 1e9; beyond it the law is inverted term by term around its mode."""
    n = good + bad
    if n < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, draws)) if n else 0
    lo, hi = max(0, draws - bad), min(good, draws)
    mode = min(max((draws + 1) * (good + 1) // (n + 2), lo), hi)
    sd = max(1.0, (draws * (good / n) * (bad / n) * ((n - draws) / (n - 1))) ** 0.5)
    # 40 standard deviations either way: what lies beyond is below the smallest double
    a, b = max(lo, mode - int(40 * sd) - 40), min(hi, mode + int(40 * sd) + 40)
    k = np.arange(a, b, dtype=np.float64)
    ratio = np.log((good - k) / (k + 1)) + np.log((draws - k) / (bad - draws + k + 1))
    log_p = np.concatenate([[0.0], np.cumsum(ratio)])
    p = np.cumsum(np.exp(log_p - log_p.max()))
    return a + int(np.searchsorted(p, rng.random() * p[-1], "right"))


def _bin(n: int):
    """Range of the unsigned hash h."""
    return F.floor(F.shiftrightunsigned("h", 32) * F.lit(n) / F.lit(float(1 << 32))).cast("long")


def _ranked(units: DataFrame, key: str, order: list[str], n_bins: int) -> DataFrame:
    """rank: place of each unit among those of its key in the given order (pass, then hash), by two-level counts.

    No task sees a whole key: bins are ranges of the hash.
    """
    units = units.withColumn("bin", _bin(n_bins))
    bins = units.groupBy(key, "pass", "bin").agg(F.count("*").alias("n"))
    before = Window.partitionBy(key).orderBy("pass", "bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select(key, "pass", "bin", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"))
    inside = Window.partitionBy(key, "pass", "bin").orderBy(*order)
    return units.join(bins, [key, "pass", "bin"]).withColumn("rank", F.col("n_before") + F.row_number().over(inside) - 1).drop("bin", "n_before")


def mix(docs: DataFrame, weights: list[float] = (3.0, 1.0, 2.0), share: float = 1.5, max_repeats: float = 2.0, block_words: int = 512, shard_blocks: int = 16_384, seed: int = 17, max_decks: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Returns (shards, sizes, targets).

    shards: shard, ord_in_shard, doc_id, th, copy, block, pass, words (taken from the
    block), a stored table with each shard in one file, in its order.  A shard has
    ``shard_blocks`` blocks at most, so their number grows with the mix.
    """
    spark = docs.sparkSession
    sizes = _shared.store(word_sizes(docs), "mix-sizes")
    per = _shared.store(targets(sizes, list(weights), share, max_repeats), "mix-targets")

    # blocks of a document differ by one word at most
    n_blocks = F.ceil(F.col("size") / block_words)
    total = sizes.agg(F.coalesce(F.sum(n_blocks), F.lit(0))).first()[0]
    n_bins = max(1, int(total**0.5))
    blocks = sizes.where("size > 0").withColumn("n", n_blocks).withColumn("block", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))))
    first, last = F.expr("block * size div n"), F.expr("(block + 1) * size div n")
    blocks = blocks.select("doc_id", "sk", "th", "copy", "block", (last - first).alias("words"), F.xxhash64(F.lit(seed), "doc_id", "th", "copy", "block").alias("h"))
    blocks = blocks.withColumn("bin", _bin(n_bins))

    # words before a block in its source's permuted deck, by two-level prefix sums: no task sees a whole source
    bins = blocks.groupBy("sk", "bin").agg(F.sum("words").alias("bin_words"))
    over = Window.partitionBy("sk").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.select("sk", "bin", F.coalesce(F.sum("bin_words").over(over), F.lit(0)).alias("words_before"))
    bins = bins.join(per, "sk").withColumn("passes", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    bins = bins.withColumn("rest", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))
    order = ["h", "doc_id", "th", "copy", "block"]
    in_bin = Window.partitionBy("sk", "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = blocks.join(bins.select("sk", "bin", "words_before", "ord", "passes", "rest"), ["sk", "bin"])
    placed = placed.withColumn("before", F.col("words_before") + F.sum("words").over(in_bin) - F.col("words"))
    part = F.greatest(F.lit(0), F.least(F.col("words"), F.col("rest") - F.col("before")))
    placed = placed.withColumn("part", part).withColumn("copies", F.col("passes") + (F.col("part") > 0).cast("long"))
    units = placed.where("copies > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))))
    deck = F.col("ord") if per.count() <= max_decks else F.pmod(F.xxhash64("sk"), F.lit(max_decks))
    units = units.select("doc_id", "th", "copy", "block", "pass", F.when(F.col("pass") < F.col("passes"), F.col("words")).otherwise(F.col("part")).alias("words"), "h", deck.cast("long").alias("deck"))
    units = _shared.store(units, "mix-units")

    # the exact quota of each deck: max_decks rows at most
    quota = units.groupBy("deck").agg(F.count("*").alias("n")).collect()
    counts = np.zeros(max([r["deck"] for r in quota], default=-1) + 1, np.int64)
    for r in quota:
        counts[r["deck"]] = r["n"]
    n_shards = max(1, -(-int(counts.sum()) // shard_blocks))

    def assign(it):
        tree = SplitTree(counts, n_shards, seed)
        for b in it:
            shard = tree.assign(*[b.column(b.schema.get_field_index(c)).to_numpy() for c in ("deck", "rank")])
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), *b.columns], names=["shard", *b.schema.names])

    ranked = _ranked(units, "deck", order, n_bins)
    kinds = dict(ranked.dtypes)
    out = ranked.mapInArrow(assign, "shard long, " + ", ".join(f"`{c}` {kinds[c]}" for c in ranked.columns))
    out = out.select("shard", F.xxhash64(F.lit(seed + 1), "h", "pass").alias("ord_in_shard"), "doc_id", "th", "copy", "block", "pass", "words")
    out = out.repartition(min(n_shards, 100_000), "shard").sortWithinPartitions("shard", "ord_in_shard", "doc_id", "th", "copy", "block", "pass")
    out = _shared.store(out, "mix-shards")
    _shared.drop(units)
    return out, sizes, per


def take_text(docs: DataFrame, shards: DataFrame, block_words: int = 512) -> DataFrame:
    """The rows of the mix with docs' columns: a row for each document and pass, its text the blocks that shards hold.

    A pass that takes every block returns the text as it is; otherwise blocks
    run from their first word to the next block's first word.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(row, F.col("doc_id").alias("d"), F.xxhash64(text).alias("h"), source_key().alias("sk"))
    keyed = keyed.withColumn("c", F.row_number().over(Window.partitionBy("d", "h").orderBy("sk")))
    per = shards.groupBy("doc_id", "th", "copy", "pass").agg(F.sort_array(F.collect_list(F.struct("block", "words"))).alias("units"))
    joined = keyed.join(per, F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("th")) & (F.col("c") == F.col("copy"))).select("row", F.col("row.text").cast("string").alias("text"), "units")

    def cut(it):
        for b in it:
            texts = []
            for t, us in zip(b.column(1), b.column(2).to_pylist(), strict=True):
                raw = np.frombuffer(t.as_buffer(), np.uint8)
                s, _, _ = _text.spans(raw, np.array([0, len(raw)]), _text.NOT_SPACE)
                n = -(-len(s) // block_words)
                edges = [k * len(s) // n for k in range(n + 1)]
                got = {u["block"]: u["words"] for u in us}
                if len(got) == n and all(w == edges[k + 1] - edges[k] for k, w in got.items()):
                    texts.append(t.as_py())
                    continue
                byte = np.append(s, len(raw))
                texts.append(b"".join(raw[byte[edges[k]] : byte[edges[k] + w]].tobytes() for k, w in sorted(got.items())).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["row", "text"])

    done = joined.mapInArrow(cut, StructType([joined.schema["row"], joined.schema["text"]]))
    return done.select(*[(F.col("text").cast(docs.schema["text"].dataType) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.read(spark, sf_dir, "documents")
    shards, sizes, per = mix(docs)
    taken = shards.groupBy("doc_id", "th", "copy").agg(F.sum("words").alias("taken")).withColumnsRenamed({"doc_id": "d", "th": "t", "copy": "c"})
    out = sizes.join(per.select("sk", "source_size", "target"), "sk")
    out = out.join(taken, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")) & (F.col("copy") == F.col("c")), "left")
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))
