"""A quality classifier: a linear-chain conditional random field over lines.

Every non-blank line has features of its bytes and words; the unary potential
of a line is linear in its own features and its neighbours', the chain adds
transition potentials.  A document's label stands for its lines in training.
Forward-backward marginals, weighted by line length, give a document's quality.

The model is fitted on at most ``max_docs`` labelled documents (those with the
smallest hash of doc_id), as many of them as have ``max_lines`` lines together; a
document that alone has more is left out.  Lines are counted before their
features travel to the driver, so that no more than those come.  Scoring reads
every whole text.

Nulls and texts without a non-blank line score the share of good documents
among the training rows.  Labels that are null are ignored; conflicting labels
of a doc_id are decided by their mean.  Repeated rows are each scored.  Empty
tables give no rows; without labels, or with labels of one kind only, every
score is that kind's share (0.5 without any).  Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, _text

LINE = np.ones(256, bool)
LINE[10] = False


def _class(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars, np.uint8)] = True
    return t


BEYOND = np.zeros(256, bool)
BEYOND[0x80:] = True
CLASSES = [
    _class(bytes(range(65, 91))), _class(bytes(range(97, 123))), _class(b"0123456789"), _class(b" \t\r\x0b\x0c"), BEYOND,
    _class(b".,;:?"), _class(b"!"), _class(b"|"), _class(b"#$%&*@~^+=_\\/"), _class(b"<>{}[]()\"'`-"),
]
N_BASE = len(CLASSES) + 6
N_FEATURES = 3 * N_BASE + 3


def line_features(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of each non-blank line with its neighbours', line lengths, first line of each document)."""
    s, e, ptr = _text.spans(data, offs, LINE)
    ws, we, wptr, wh = _text.words(data, offs, _text.NOT_SPACE)
    first = np.searchsorted(ws, s)
    last = np.searchsorted(ws, e)
    full = last > first
    doc = (np.searchsorted(ptr, np.arange(len(s)), "right") - 1)[full]
    s, e, first, last = s[full], e[full], first[full], last[full]
    ptr = np.searchsorted(doc, np.arange(len(offs)))
    n = len(s)
    x = np.zeros((n, N_BASE), np.float32)
    size = (e - s).astype(np.float32)
    for k, table in enumerate(CLASSES):
        c = np.concatenate([[0], np.cumsum(table[data], dtype=np.int32)])
        x[:, k] = (c[e] - c[s]) / size
    k = len(CLASSES)
    n_words = (last - first).astype(np.float32)
    line_ptr = np.append(first, last[-1]) if n else np.zeros(1, np.int64)
    distinct = np.diff(_text.shingles(wh, line_ptr, 1)[2]) if n else np.zeros(0)
    same = np.concatenate([[0], np.cumsum(wh[1:] == wh[:-1])]) if len(wh) else np.zeros(1)
    length = np.concatenate([[0], np.cumsum(we - ws)])
    x[:, k] = distinct / n_words
    x[:, k + 1] = (same[last - 1] - same[first]) / n_words if n else 0
    x[:, k + 2] = (length[last] - length[first]) / n_words / 10
    x[:, k + 3] = np.log1p(size) / 10
    x[:, k + 4] = np.log1p(n_words) / 10
    x[:, k + 5] = 1.0 / n_words
    before, after = np.zeros_like(x), np.zeros_like(x)
    inner = np.ones(n, bool)
    inner[ptr[:-1][ptr[:-1] < n]] = False
    before[1:][inner[1:]] = x[:-1][inner[1:]]
    after[:-1][inner[1:]] = x[1:][inner[1:]]
    ends = np.stack([np.ones(n), ~inner, np.append(~inner[1:], True) if n else np.zeros(0)], axis=1).astype(np.float32)
    return np.concatenate([x, before, after, ends], axis=1), size, ptr


def forward_backward(u: np.ndarray, ptr: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(line is good), expected transitions (2, 2) and the sum of log partition functions.

    u: unary log potential of good over bad; a: transition log potentials.
    All chains advance together, longest first.
    """
    n = np.diff(ptr)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    start, n = ptr[:-1][order], n[order]
    active = np.searchsorted(-n, -np.arange(1, (n[0] if len(n) else 0) + 1), "right")
    unary = np.stack([np.zeros_like(u), u], axis=1)
    f, b = np.empty_like(unary), np.zeros_like(unary)
    if len(n):
        f[start] = unary[start]
    for t in range(1, len(active)):
        at = start[: active[t]] + t
        p = f[at - 1]
        f[at] = unary[at] + np.logaddexp(p[:, :1] + a[0], p[:, 1:] + a[1])
    for t in range(len(active) - 1, 0, -1):
        at = start[: active[t]] + t
        nxt = b[at] + unary[at]
        b[at - 1] = np.stack([np.logaddexp(a[0, 0] + nxt[:, 0], a[0, 1] + nxt[:, 1]), np.logaddexp(a[1, 0] + nxt[:, 0], a[1, 1] + nxt[:, 1])], axis=1)
    z = np.logaddexp(f[start + n - 1, 0], f[start + n - 1, 1])
    z_line = np.zeros(len(u))
    chain = np.repeat(np.arange(len(n)), n)
    at = np.repeat(start, n) + np.arange(len(chain)) - np.repeat(np.cumsum(n) - n, n)
    z_line[at] = z[chain]
    good = np.exp(np.minimum(f[:, 1] + b[:, 1] - z_line, 0))
    has = np.ones(len(u), bool)
    has[start] = False
    i = np.flatnonzero(has)
    pair = f[i - 1][:, :, None] + a[None] + (unary[i] + b[i])[:, None, :] - z_line[i][:, None, None]
    return good, np.exp(np.minimum(pair, 0)).sum(axis=0) if len(i) else np.zeros((2, 2)), float(z.sum())


class Crf:
    def __init__(self, share: float = 0.5):
        self.share, self.w, self.a, self.mean, self.sd = share, None, np.zeros((2, 2)), None, None

    def fit(self, x: np.ndarray, ptr: np.ndarray, y: np.ndarray, steps: int = 250, rate: float = 0.08, l2: float = 1e-3, chain: int = 64) -> Crf:
        """y: label of each document.  Long documents are trained on as several chains of all their lines."""
        cuts = [k for i, j in zip(ptr[:-1].tolist(), ptr[1:].tolist(), strict=True) for k in range(i, j, chain)]
        doc = np.repeat(np.arange(len(y)), np.diff(ptr))
        ptr = np.array([*cuts, len(x)], np.int64)
        line_y = y[doc].astype(float)
        self.mean, self.sd = x.mean(axis=0), x.std(axis=0) + 1e-3
        self.mean[-3:], self.sd[-3:] = 0, 1
        x = ((x - self.mean) / self.sd).astype(np.float64)
        inner = np.ones(len(x), bool)
        inner[ptr[:-1]] = False
        i = np.flatnonzero(inner)
        seen = np.zeros((2, 2))
        np.add.at(seen, (line_y[i - 1].astype(int), line_y[i].astype(int)), 1)
        theta, m, v = np.zeros(x.shape[1] + 4), 0.0, 0.0
        for t in range(1, steps + 1):
            w, a = theta[:-4], theta[-4:].reshape(2, 2)
            good, pairs, _ = forward_backward(x @ w, ptr, a)
            g = np.concatenate([x.T @ (line_y - good), (seen - pairs).reshape(-1)]) / len(x) - l2 * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        self.w, self.a = theta[:-4], theta[-4:].reshape(2, 2)
        return self

    def lines(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(P(good) of each line, line lengths, first line of each document)."""
        x, size, ptr = line_features(data, offs)
        if self.w is None:
            return np.full(len(size), self.share), size, ptr
        return forward_backward(((x - self.mean) / self.sd) @ self.w, ptr, self.a)[0], size, ptr

    def score(self, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        good, size, ptr = self.lines(data, offs)
        top, all_ = (np.concatenate([[0], np.cumsum(v, dtype=np.float64)]) for v in (good * size, size))
        n = all_[ptr[1:]] - all_[ptr[:-1]]
        return np.clip(np.where(n > 0, (top[ptr[1:]] - top[ptr[:-1]]) / np.maximum(n, 1), self.share), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, max_lines: int = 400_000) -> Crf:
    """On the labelled documents with the smallest hashes, up to ``max_docs`` and ``max_lines``."""
    marked = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("y"))
    rows = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs).collect()
    if not rows:
        return Crf()
    spark = docs.sparkSession
    y = {r["doc_id"]: r["y"] for r in rows}
    share = sum(y.values()) / len(y)
    only = lambda ids: F.broadcast(spark.createDataFrame([(k,) for k in ids], "doc_id long"))  # noqa: E731  max_docs rows at most
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(only(y), "doc_id", "left_semi")
    src = _shared.store(src, "labelled")

    def count(it):
        for b, data, offs in _text.batches(it, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(line_features(data, offs)[2]), pa.int64())], names=["doc_id", "n"])

    def run(it):
        for b, data, offs in _text.batches(it, "text"):
            x, _, ptr = line_features(data, offs)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x[i:j].tobytes() for i, j in zip(ptr[:-1], ptr[1:], strict=True)], pa.binary())], names=["doc_id", "x"])

    sizes = {r["doc_id"]: r["n"] for r in src.mapInArrow(count, "doc_id long, n long").groupBy("doc_id").agg(F.sum("n").alias("n")).collect()}
    chosen, total = [], 0
    for d in (r["doc_id"] for r in rows):
        n = sizes.get(d, 0)
        if n and n <= max_lines and total + n <= max_lines:
            chosen.append(d)
            total += n
    got = src.join(only(chosen), "doc_id", "left_semi").mapInArrow(run, "doc_id long, x binary").collect() if chosen else []
    place = {d: k for k, d in enumerate(chosen)}
    got = sorted((place[r["doc_id"]], r["doc_id"], bytes(r["x"])) for r in got if r["x"])
    xs = [np.frombuffer(raw, np.float32).reshape(-1, N_FEATURES) for _, _, raw in got]
    ys = [y[d] for _, d, _ in got]
    _shared.drop(src)
    if not ys or min(ys) == max(ys):
        return Crf(share)
    return Crf(share).fit(np.concatenate(xs), np.concatenate([[0], np.cumsum([len(x) for x in xs])]), np.array(ys))


def score(docs: DataFrame, model: Crf) -> DataFrame:
    """doc_id, score."""

    def run(it):
        for b, data, offs in _text.batches(it, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(data, offs), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Crf, at_least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose text scores at least that."""

    def run(it):
        for b, data, offs in _text.batches(it, "text"):
            yield b.filter(pa.array(model.score(data, offs) >= at_least))

    return docs.mapInArrow(run, docs.schema)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _shared.read(spark, sf_dir, "documents"), _shared.read(spark, sf_dir, "labels")
    fold = lambda: F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    rows = score(docs, fit(docs, labels.where(~fold())))
    return rows.select("doc_id", F.coalesce(fold(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
