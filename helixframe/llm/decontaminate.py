"""Benchmark decontamination with an FM-index per training shard.

A shard is a few megabytes of documents.  Its words become symbols: a word of
the benchmark has one of its own, all others are separators, and runs of
benchmark words too short for any window are left out, as nothing can occur
there.  Over the rest stands an FM-index: a suffix array, the BWT in a wavelet
matrix, and every 16th suffix position as a sample.  All windows of the
benchmark are searched backwards at once through the matrix's ranks; their rows
walk to sampled positions, and the located occurrences merge into removal spans.

A window is ``window`` consecutive words of an item; an item with fewer, but
not none, is one window.  Words are runs of digits, ASCII letters (lower-cased)
and anything beyond ASCII.

Nulls: a null text has no words; a null item_id counts as an empty string.
Repeated rows are each reported; items that repeat an id count once.  Empty
tables give no rows or no hits.  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, _text

SAMPLE = 16


def suffix_array(t: np.ndarray) -> np.ndarray:
    """By prefix doubling; t ends in a unique smallest symbol."""
    n = len(t)
    rank = np.unique(t, return_inverse=True)[1].astype(np.int64)
    k = 1
    while True:
        key = rank * (n + 1)
        key[: n - k] += rank[k:] + 1
        order = np.argsort(key, kind="stable")
        s = key[order]
        new = np.zeros(n, np.int64)
        new[order] = np.concatenate([[0], np.cumsum(s[1:] != s[:-1])])
        rank, k = new, 2 * k
        if rank[order[-1]] == n - 1 or k >= n:
            return order


class WaveletMatrix:
    """rank of any symbol before any row, for arrays of both at once."""

    def __init__(self, a: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.ones, self.zeros = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (a >> b) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int64))
            self.zeros.append(len(a) - int(bit.sum()))
            a = np.concatenate([a[bit == 0], a[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        base = np.zeros_like(i)
        for level in range(self.bits):
            ones, one = self.ones[level], (c >> (self.bits - 1 - level)) & 1 == 1
            ri, rb = ones[i], ones[base]
            i = np.where(one, self.zeros[level] + ri, i - ri)
            base = np.where(one, self.zeros[level] + rb, base - rb)
        return i - base


class FMIndex:
    def __init__(self, t: np.ndarray, n_symbols: int):
        sa = suffix_array(t)
        self.bwt = t[sa - 1]
        self.before = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=n_symbols))]).astype(np.int64)
        self.tree = WaveletMatrix(self.bwt, n_symbols)
        self.marked = sa % SAMPLE == 0
        self.sample_at = np.cumsum(self.marked) - 1
        self.samples = sa[self.marked]
        self.n = len(t)

    def search(self, symbols: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of the patterns symbols[at : at + length]."""
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64)
        for j in range(length - 1, -1, -1):
            c = symbols[at + j].astype(np.int64)
            lo, hi = self.before[c] + self.tree.rank(c, lo), self.before[c] + self.tree.rank(c, hi)
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, steps, left, row = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(left):
            hit = self.marked[row]
            out[left[hit]] = self.samples[self.sample_at[row[hit]]] + steps
            left, row = left[~hit], row[~hit]
            c = self.bwt[row]
            row = self.before[c] + self.tree.rank(c, row)
            steps += 1
        return out


class Patterns:
    """Distinct windows of the benchmark, by length, and the items that each belongs to.

    The benchmark stands here once, as symbols; a window is the place of its first word.
    Some 20 bytes a word: no more than 10 for each byte of text.
    """

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        data, offs = _text.buffers(pa.array(texts, pa.string()))
        data = _text.LOWER[data]
        s, e, ptr = _text.spans(data, offs, _text.ALNUM)
        h0, h1 = _text.range_digest(data, s, e)
        self.vocabulary, first, symbols = np.unique(h0, return_index=True, return_inverse=True)
        self.second = h1[first]
        if (self.second[symbols] != h1).any():
            raise ValueError("two words of the benchmark share a hash")
        symbols = (symbols + 2).astype(np.int32)  # 0 ends the text, 1 separates
        by_len: dict[int, list] = {}
        for i in range(len(ids)):
            n = min(window, int(ptr[i + 1] - ptr[i]))
            if n:
                at = np.arange(ptr[i], ptr[i + 1] - n + 1)
                by_len.setdefault(n, []).append((at, np.full(len(at), i, np.int32)))
        self.ids, self.symbols, self.groups = ids, symbols, []
        for n, parts in sorted(by_len.items()):
            at, item = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, one, inv = np.unique(np.lib.stride_tricks.sliding_window_view(symbols, n)[at], axis=0, return_index=True, return_inverse=True)
            order = np.argsort(inv.reshape(-1), kind="stable")
            self.groups.append((n, at[one].astype(np.int32), item[order], np.searchsorted(inv.reshape(-1)[order], np.arange(len(one) + 1)).astype(np.int32)))
        self.shortest = min(by_len, default=0)

    def known(self, h0: np.ndarray, h1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the vocabulary, whether it is that word) of words' digests."""
        at = np.minimum(np.searchsorted(self.vocabulary, h0), len(self.vocabulary) - 1)
        return at, (self.vocabulary[at] == h0) & (self.second[at] == h1)


def search_shard(p: Patterns, data: np.ndarray, offs: np.ndarray):
    """(words of each document, hit flag of each word, first word of each document, word starts, word ends, (doc, item) pairs)."""
    data = _text.LOWER[data]
    starts, ends, ptr = _text.spans(data, offs, _text.ALNUM)
    h, second = _text.range_digest(data, starts, ends)
    n_docs = len(offs) - 1
    hit = np.zeros(len(h) + 1, np.int64)
    pairs = np.zeros((0, 2), np.int64)
    if p.groups and len(h):
        at, known = p.known(h, second)
        first = np.zeros(len(h), bool)
        first[ptr[:-1][ptr[:-1] < len(h)]] = True
        begin = known & (first | ~np.concatenate([[False], known[:-1]]))
        run = np.cumsum(begin) - 1
        run_len = np.bincount(run[known], minlength=int(begin.sum()))
        keep = np.flatnonzero(known)
        keep = keep[run_len[run[keep]] >= p.shortest]
        if len(keep):
            head = np.flatnonzero(np.concatenate([[True], run[keep][1:] != run[keep][:-1]]))
            t = np.concatenate([np.insert(at[keep] + 2, head, 1), [1, 0]]).astype(np.int64)
            word = np.concatenate([np.insert(keep, head, -1), [-1, -1]])
            fm = FMIndex(t, len(p.vocabulary) + 2)
            doc_of = np.searchsorted(ptr, np.arange(len(h)), "right") - 1
            found = []
            for n, w, items, item_at in p.groups:
                lo, hi = fm.search(p.symbols, w, n)
                count = hi - lo
                which = np.repeat(np.arange(len(w)), count)
                if not len(which):
                    continue
                rows = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
                pos = word[fm.locate(rows)]
                np.add.at(hit, pos, 1)
                np.add.at(hit, pos + n, -1)
                dw = np.unique(doc_of[pos] * len(w) + which)
                d, x = dw // len(w), dw % len(w)
                k = item_at[x + 1] - item_at[x]
                at_item = np.repeat(item_at[x] - np.concatenate([[0], np.cumsum(k)[:-1]]), k) + np.arange(k.sum())
                found.append(np.stack([np.repeat(d, k), items[at_item]], axis=1))
            if found:
                pairs = np.unique(np.concatenate(found), axis=0)
    return np.diff(ptr), np.cumsum(hit)[:-1] > 0, ptr, starts, ends, pairs, n_docs


SCHEMA = "doc_id long, n_words long, spans array<struct<first:long,last:long,start:long,end:long>>, items array<string>"


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _find(docs: DataFrame, patterns, shard_bytes: int) -> DataFrame:
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))

    def run(it):
        p = patterns.value
        for b, data, offs in _text.batches(it, "text", shard_bytes):
            n_words, hit, ptr, starts, ends, pairs, n = search_shard(p, data, offs)
            spans, items = [[] for _ in range(n)], [[] for _ in range(n)]
            for d in np.unique(pairs[:, 0]).tolist():
                a, z = _runs(hit[ptr[d] : ptr[d + 1]])
                spans[d] = [{"first": i, "last": j, "start": int(starts[ptr[d] + i] - offs[d]), "end": int(ends[ptr[d] + j - 1] - offs[d])} for i, j in zip(a.tolist(), z.tolist(), strict=True)]
            for d, i in pairs.tolist():
                items[d].append(p.ids[i])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n_words, pa.int64()), pa.array(spans, kind), pa.array([sorted(set(x)) for x in items], pa.list_(pa.string()))], names=["doc_id", "n_words", "spans", "items"])

    return docs.mapInArrow(run, SCHEMA)


def _merge(found: DataFrame) -> DataFrame:
    """One row a document of several parts' rows (columns row, part, and those of SCHEMA)."""
    per = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")).drop("row")
    kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("first", "last", "start", "end")]))

    def run(it):
        for b in it:
            out = []
            for spans in b.column(2).to_pylist():
                merged: list[dict] = []
                for s in spans:
                    if merged and s["first"] <= merged[-1]["last"]:
                        if s["last"] > merged[-1]["last"]:
                            merged[-1] |= {"last": s["last"], "end": s["end"]}
                    else:
                        merged.append(dict(s))
                out.append(merged)
            yield b.set_column(2, "spans", pa.array(out, kind))

    return per.mapInArrow(run, SCHEMA)


def find_benchmark(docs: DataFrame, benchmark: DataFrame, window: int = 13, shard_bytes: int = 4 << 20, max_item_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, removal spans (words [first, last), bytes [start, end)) and the items found, per document.

    The benchmark is broadcast, so its size is checked: beyond ``max_item_bytes``
    (80 MB of patterns at most) it is searched in parts, each in a pass over the
    documents, and the parts' spans are merged.
    """
    bench = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("string").alias("text"))
    parts = max(1, -(-_shared.text_bytes(bench) // max_item_bytes))
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    if parts > 1:
        src = _shared.store(src.withColumn("row", F.monotonically_increasing_id()), "decontaminate")
    out = None
    for k in range(parts):
        own = bench.where(F.pmod(F.xxhash64("item_id"), F.lit(parts)) == k) if parts > 1 else bench
        rows = own.collect()
        p = docs.sparkSession.sparkContext.broadcast(Patterns([r["item_id"] for r in rows], [r["text"] for r in rows], window))
        if parts == 1:
            return _find(src, p, shard_bytes)
        # the row number stands in for doc_id on the way
        found = _find(src.select(F.col("row").alias("doc_id"), "text"), p, shard_bytes).withColumnRenamed("doc_id", "row").join(src.select("row", "doc_id"), "row")
        out = found if out is None else out.unionByName(found)
    return _merge(out)


def report(found: DataFrame, percent_of_words: int = 5) -> DataFrame:
    """n_hit, n_items, items_sha256 and whether at least that share of words is hit."""
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"])
    rows = found.withColumn("n_hit", n_hit)
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (100 * F.col("n_hit") >= percent_of_words * F.col("n_words"))).alias("contaminated"),
    )


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(find_benchmark(_shared.read(spark, sf_dir, "documents"), _shared.read(spark, sf_dir, "benchmark")))


OP7_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item_id, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item_id, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM bn)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, (len(w) - n + 2)::BIGINT)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, win)),
place AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY 1),
item AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM hit GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN place USING (doc_id) LEFT JOIN item USING (doc_id)
"""
