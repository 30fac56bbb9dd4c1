"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of all orders up to ``order`` and a uniform one
are mixed by weights that depend on the longest context that was seen and how
often it was (one bucket for each length and power of two); estimates from
longer contexts have no weight there.  The weights come from expectation-maximisation on
counts held out of training: a fold of the training documents is deleted from
the counts, its events are binned by bucket and (quarter-octave) estimates, and
the bins' sums, whose number is bounded, are what the iterations run on.  Final
scores use the counts of all training documents.

n-grams never move as rows.  A pack of documents sends its distinct n-grams with
counts to ranges of the key space and gets totals back (``_packs.exchange``).
Documents of the deleted fold have packs of their own, so that the events of
expectation-maximisation read a tenth of the corpus.  A word's key has 62 bits
of its hash and a longer gram's 56, so that counts of the corpus can be those of
two grams together only where grams run into the thousands of millions.

Tokens are words (ASCII capitals lower-cased) and one end a document, which
counts as a token.  Words that training has not seen share the base's class of
unknown words, 1 / (V + 1) in the uniform part.

Nulls: a null text is one end; a null doc_id is never in training.  Repeated
rows count as often as they stand there.  Without any training document all
scores are those of the uniform part.  An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _packs, _shared, _text

U64 = np.uint64
END, BOS = U64(0xE4D0E4D0E4D0E4D1), U64(0xB05B05B05B05B053)
HELD_OUT, DELETED = 0, 1
NONE = -(1 << 14)
#: Low bits of a word's key, and of a longer gram's, that hold its order.
KEPT = (U64(3), U64(255))


def fold(doc_id: int | None, folds: int = 10) -> int:
    return HELD_OUT if doc_id is None else zlib.crc32(str(doc_id).encode()) % folds


def grams(data: np.ndarray, offs: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys of the 1-, 2-, ... grams that end at each token, a row an order; first token of each document)."""
    _, _, ptr, h = _text.words(data, offs, _text.NOT_SPACE)
    n = np.diff(ptr) + 1
    # order - 1 starts before and one end after each document's words
    size = n + order - 1
    first = np.concatenate([[0], np.cumsum(size)])[:-1]
    doc = np.repeat(np.arange(len(n)), size)
    where = np.arange(len(doc)) - first[doc]
    ext = np.where(where < order - 1, BOS, np.where(where == size[doc] - 1, END, U64(0)))
    ext[(where >= order - 1) & (where < size[doc] - 1)] = h
    token = np.flatnonzero(where >= order - 1)
    out = np.empty((order, len(token)), np.uint64)
    for k in range(1, order + 1):
        out[k - 1] = (_text.combine(ext, k)[token - k + 1] & ~KEPT[min(k, 2) - 1]) | U64(1 if k == 1 else 4 * k + 2)
    return out, np.concatenate([[0], np.cumsum(n)])


def slices(data: np.ndarray, offs: np.ndarray, limit: int = 2 << 20):
    """(first document, last + 1, bytes, offsets): a pack is worked on slice by slice, to bound memory."""
    for i, j in _text.pieces(np.diff(offs), limit):
        yield i, j, data[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


def merged_keys(parts: list[np.ndarray]) -> np.ndarray:
    """The distinct keys of slices that each have theirs in order (a merge of sorted runs)."""
    if len(parts) == 1:
        return parts[0]
    keys = np.sort(np.concatenate(parts), kind="stable")
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


#: Buckets of one context length.
SPAN = 65


def em(cells: np.ndarray, n: np.ndarray, p: np.ndarray, seen: np.ndarray, rounds: int = 60, prior: float = 20.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights per bucket (rows) of the estimates (columns of p), and the pooled ones.

    cells: bucket of each event class; n: its count.  Pooled weights act as
    ``prior`` events of each bucket.  Rows SPAN * c and up are those of contexts of c words.
    """
    k = p.shape[1]

    def run(w, rows, base):
        for _ in range(rounds):
            q = p[rows] * w
            s = q.sum(axis=1, keepdims=True)
            r = (q / np.maximum(s, 1e-300) * n[rows, None]).sum(axis=0) + base
            w = r / r.sum()
        return w

    pooled = run(np.full(k, 1 / k), np.arange(len(n)), np.full(k, 1e-3)) if len(n) else np.array([0.05, *[0.95 / (k - 1)] * (k - 1)])
    pooled = np.maximum(pooled, 1e-6)
    out = np.tile(pooled / pooled.sum(), (SPAN * (k - 1), 1))
    for c in range(k - 1):
        out[SPAN * c : SPAN * (c + 1), c + 2 :] = 0  # longer contexts were never seen
    out /= out.sum(axis=1, keepdims=True)
    for b in seen.tolist():
        out[b] = run(out[b], np.flatnonzero(cells == b), prior * out[b])
    out = np.where(out > 0, np.maximum(out, 1e-7), 0)
    return out / out.sum(axis=1, keepdims=True), pooled


def bucket(context: np.ndarray) -> np.ndarray:
    """0 for none, else 1 + floor(log2)."""
    return np.where(context > 0, np.floor(np.log2(np.maximum(context, 1))).astype(np.int64) + 1, 0)


def score_documents(docs: DataFrame, order: int = 3, folds: int = 10, pack_bytes: int = 8 << 20, **dealt: int) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of each row.

    dealt: arguments of ``_packs.exchange``.
    """
    packs = _packs.make(docs, pack_bytes, F.crc32(F.col("doc_id").cast("string")) % folds == DELETED)
    n_packs = packs.count()
    end_key = (_text.combine(np.array([END], np.uint64), 1)[0] & ~KEPT[0]) | U64(1)

    def ask(it):
        for pack, ids, null, offs, data in _packs.opened(it):
            parts = []
            for i, j, d, o in slices(data, offs):
                levels, ptr = grams(d, o, order)
                f = np.array([fold(None if z else x, folds) for x, z in zip(ids[i:j].tolist(), null[i:j].tolist(), strict=True)], np.int64)
                f = np.repeat(f, np.diff(ptr))
                u, inv = np.unique(levels, return_inverse=True)
                del levels
                inv = inv.reshape(order, -1)
                parts.append((u, *[np.bincount(inv[:, own].reshape(-1), minlength=len(u)).astype(np.uint32) for own in ((f != DELETED) & (f != HELD_OUT), f == DELETED)]))
            keys = merged_keys([p[0] for p in parts])
            main, deleted = np.zeros(len(keys), np.uint32), np.zeros(len(keys), np.uint32)
            for u, m, d in parts:
                at = np.searchsorted(keys, u)
                main[at] += m
                deleted[at] += d
            yield pack, _packs.Entries(keys, [], [main, deleted])

    def answer(e):
        main, deleted = (c.astype(np.int64) for c in e.counts)
        one = (e.keys & KEPT[0]) == 1
        end = np.flatnonzero(e.keys == end_key)
        note = [((main + deleted)[one] > 0).sum(), main[one].sum() + deleted[one].sum(), main[one].sum(), (main + deleted)[end].sum(), main[end].sum()]
        return [main + deleted, deleted], note

    replies = _shared.store(_packs.exchange(packs, ask, answer, n_packs, notes=True, **dealt), "ngram-counts")

    def unpack_stats(it):
        for r in it:
            x = np.array([np.frombuffer(v.as_py(), np.int64) for v in r.column(3)], np.int64).reshape(-1, 5)
            yield pa.RecordBatch.from_pydict({f"s{k}": pa.array(x[:, k]) for k in range(5)})

    sums = replies.where("kind = 9").mapInArrow(unpack_stats, ", ".join(f"s{k} long" for k in range(5))).agg(*[F.coalesce(F.sum(f"s{k}"), F.lit(0)) for k in range(5)]).first()
    v, n_all, n_main, d_all, d_main = (int(x) for x in sums)

    def counted(rows):
        """Slices of the pack: documents (ids, null) and, for every token, counts of its grams (all, deleted) by order."""
        ids, null, offs, data = _packs.expand(rows[0][2])
        parts = []
        for i, j, d, o in slices(data, offs):
            levels, ptr = grams(d, o, order)
            u, inv = np.unique(levels, return_inverse=True)
            parts.append((i, j, ptr, u, inv.reshape(order, -1).astype(np.int32)))
            del levels, inv
        keys = merged_keys([p[3] for p in parts])
        found = [c.astype(np.uint32) if c.max(initial=0) < 2**32 else c for c in _packs.replied([body for _, kind, body in rows if kind == 2])]
        for i, j, ptr, u, inv in parts:
            at = np.searchsorted(keys, u)
            yield ids[i:j], null[i:j], ptr, *[[c[at][inv[k]].astype(np.int64) for k in range(order)] for c in found]

    def estimates(counts, ptr, n_tokens, n_docs):
        """(row of the longest context that was seen, maximum-likelihood estimates of orders 1, 2, ...)."""
        first = ptr[:-1]
        ml = [counts[0] / max(n_tokens, 1)]
        row = np.zeros(len(counts[0]), np.int64)
        for k in range(1, order):
            context = np.concatenate([[0], counts[k - 1][:-1]]) if len(counts[0]) else counts[0]
            context[first] = n_docs
            ml.append(np.where(context > 0, counts[k] / np.maximum(context, 1), 0.0))
            row = np.where(context > 0, SPAN * k + bucket(context), row)
        return row, ml

    def events(pack, rows):
        for _, _, ptr, all_, deleted in counted(rows):
            b, ml = estimates([a - d for a, d in zip(all_, deleted, strict=True)], ptr, n_main, d_main)
            code = b
            for p in ml:
                code = (code << 15) | (np.where(p > 0, np.round(4 * np.log2(np.maximum(p, 1e-300))), NONE).astype(np.int64) + (1 << 14))
            cells, n = np.unique(code, return_counts=True)
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cells, pa.int64()), "n": pa.array(n.astype(np.int64))})

    asked = packs.unionByName(replies.where("kind = 1").withColumn("kind", F.lit(2)))
    # at most SPAN * order rows times the estimates' quarter octaves, however large the corpus
    binned = _packs.by_dest(asked.where("dest % 2 = 1"), events, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).orderBy("cell").toArrow()
    code, n = binned.column("cell").to_numpy(), binned.column("n").to_numpy().astype(float)
    q = np.stack([(code >> (15 * (order - 1 - k)) & 0x7FFF) - (1 << 14) for k in range(order)], axis=1) if len(code) else np.zeros((0, order), np.int64)
    uniform = 1 / (v + 1)
    p = np.concatenate([np.full((len(code), 1), uniform), np.where(q == NONE, 0.0, 2.0 ** (q / 4))], axis=1)
    cells = code >> (15 * order)
    weights, _ = em(cells, n, p, np.unique(cells))
    if not n_all:
        weights = np.tile(np.eye(1, order + 1), (SPAN * order, 1))

    def finish(pack, rows):
        for ids, null, ptr, all_, _ in counted(rows):
            b, ml = estimates(all_, ptr, n_all, d_all)
            prob = weights[b, 0] * uniform
            for k in range(order):
                prob += weights[b, k + 1] * ml[k]
            base = np.log10((all_[0] + 0.1) / (n_all + 0.1 * (v + 1)))
            per = lambda x, ptr=ptr: np.add.reduceat(x, ptr[:-1])
            mask = null.astype(bool)
            held = [not z and fold(i, folds) == HELD_OUT for i, z in zip(ids.tolist(), mask.tolist(), strict=True)]
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array(ids, pa.int64(), mask=mask), "held_out": pa.array(held), "n_tokens": pa.array(np.diff(ptr), pa.int64()),
                "n_known": pa.array(per((all_[0] > 0).astype(np.int64))), "train_tokens": pa.array(np.full(len(ids), n_all), pa.int64()),
                "base_score": pa.array(per(base)), "score": pa.array(per(np.log10(prob))),
            })

    return _packs.by_dest(asked, finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(_shared.read(spark, sf_dir, "documents"))
