"""Exact-substring deduplication by prefix-free parsing.

Removes each byte that lies in a ``length``-byte string which also starts
anywhere else in the corpus (same document included; matches stay within
documents and are judged on the input).

A rolling hash of 8 bytes triggers at the leftmost minimum of every 97
consecutive positions, so that every window of 200 bytes has a trigger among
its first 97 positions, the same one wherever it occurs.  Triggers cut texts
into phrases; a phrase runs 104 bytes (``Shape.right``) past the trigger that
ends it.  What makes a position a trigger lies within those bytes, so no phrase
is a proper prefix of another, and the order of texts is that of their parses:
sequences of phrases by rank in the sorted dictionary.

Windows with one trigger t form a group: its context is the text from the first
window's start to the last one's end.  Contexts with equal 104 bytes from t, which
all their windows hold, are a class.  Contexts that occur again as a whole are
repeats, and those alone in their class are not; nearly all of a text is settled
by that.  For the rest of a class, packs send their dictionary and parse: the
phrases once, and each context as phrases right of t and the phrase's end left
of t.  The suffix array of the parse orders the right sides and the sorted
reversed phrase ends the left ones, both with common-prefix lengths; a window
with a bytes left of t repeats if and only if another context lies with it in one
class of the left order (common prefix at least a) and in one of the right order
(at least length - a).

A class of more than ``hot`` contexts (a common passage in ever new
surroundings) is not brought together: the digests of its contexts' windows are
counted instead, which spreads by the windows' content.  Equality of contexts and
of windows is that of 128-bit hashes.

Nulls: a null text is empty.  Repeated rows count as repeats of each other and
are each reported.  An empty table gives no rows; other columns are ignored.
Texts are handled as UTF-8 bytes, so removal may cut characters.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _packs, _shared, _text
from .decontaminate import suffix_array

U64 = np.uint64
GRAM = 8
UNIQUE, REPEATED, OPEN, REPEATED_SENT, HOT, REPEATED_HOT = 0, 1, 2, 3, 4, 5
CHUNK = 2 << 20


def _window_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values."""
    k = 1
    while 2 * k <= w:
        v = np.minimum(v[:-k], v[k:])
        k *= 2
    return np.minimum(v[: len(v) - (w - k)], v[w - k :]) if w > k else v


class Shape:
    """Lengths that follow from the length of a match."""

    def __init__(self, length: int):
        self.length = length
        self.span = max(1, (length - GRAM) // 2 + 1)  # trigger positions of a window
        self.right = length - self.span + 1  # bytes from a trigger that all its windows hold


def anchors(data: np.ndarray, offs: np.ndarray, s: Shape):
    """Groups of windows with one trigger (first start, last start, trigger), ascending, and all triggers.

    Triggers that no window of full length has are among the latter: they end phrases.
    """
    lo_all, hi_all, t_all, every = [], [], [], []
    for i, j in _text.pieces(np.diff(offs), CHUNK):
        base, d = offs[i], data[offs[i] : offs[j]]
        if len(d) < s.length:
            continue
        gram = _text._loader(d)[: len(d) - GRAM + 1]
        v = (_text.mix(gram) & U64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
        t = (_window_min(v, s.span) & U64(0xFFFFFFFF)).astype(np.int64)
        o = offs[i : j + 1] - base

        def starts(size, o=o, n=len(d), m=len(t)):
            """Places from which so many bytes lie in one document."""
            ok = np.zeros(n + 1, np.int8)
            long = np.flatnonzero(np.diff(o) >= size)
            ok[o[long]] += 1
            np.subtract.at(ok, o[long + 1] - size + 1, 1)
            return np.flatnonzero(np.cumsum(ok[:m]) > 0)

        p = starts(s.span + GRAM - 1)
        every.append(np.unique(t[p]) + base)
        p = starts(s.length)
        if not len(p):
            continue
        doc = np.searchsorted(o, p, "right")
        new = np.concatenate([[True], (t[p][1:] != t[p][:-1]) | (doc[1:] != doc[:-1])])
        first = np.flatnonzero(new)
        lo_all.append(p[first] + base)
        hi_all.append(p[np.append(first[1:], len(p)) - 1] + base)
        t_all.append(t[p[first]] + base)
    z = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or z) for x in (lo_all, hi_all, t_all, every))


def context_entries(pack, data, offs, lo, hi, t, s: Shape) -> tuple[_packs.Entries, np.ndarray]:
    """Distinct (class, context) with their numbers, and the entry of each group of windows."""
    key, c0, c1 = (np.zeros(len(t), np.uint64) for _ in range(3))
    for i, j in _text.pieces(np.diff(offs), CHUNK):
        a, b = np.searchsorted(lo, [offs[i], offs[j]])
        if a == b:
            continue
        base = offs[i]
        d = data[base : offs[j]]
        x, y, z = lo[a:b] - base, hi[a:b] - base, t[a:b] - base
        key[a:b] = _text.range_hash(d, z, z + s.right)
        h0, h1 = _text.range_digest(d, x, y + s.length)
        c0[a:b] = _text.mix(h0 ^ (z - x).astype(np.uint64))
        c1[a:b] = _text.mix(h1 + (z - x).astype(np.uint64))
    return _packs.collapse(key, [c0, c1], [np.ones(len(t), np.uint64)], [np.full(len(t), pack, np.uint64)])


def judge(e: _packs.Entries, hot: int) -> np.ndarray:
    """Verdict of each context among all of its class."""
    n = len(e)
    if not n:
        return np.zeros(0, np.uint64)
    of = np.cumsum(np.concatenate([[True], e.keys[1:] != e.keys[:-1]])) - 1
    kinds = np.bincount(of)[of]
    again = e.counts[0] > 1
    # a class whose contexts all repeat has nothing open
    open_ = (np.bincount(of, ~again)[of] > 0) & (kinds > 1)
    far = kinds > hot
    return np.where(open_, np.where(again, np.where(far, REPEATED_HOT, REPEATED_SENT), np.where(far, HOT, OPEN)), np.where(again, REPEATED, UNIQUE)).astype(np.uint64)


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int((x != y).argmax())


def parse_order(dictionary: list[bytes], parses: list[list[int]], s: Shape) -> tuple[np.ndarray, np.ndarray]:
    """(contexts in the order of their right sides, bytes that each has in common with the one before).

    parses: phrases as places in the dictionary; phrases of a parse overlap by Shape.right bytes.
    """
    by = sorted(range(len(dictionary)), key=dictionary.__getitem__)
    rank = np.empty(len(by), np.int64)
    rank[by] = np.arange(len(by))
    n = len(parses)
    # the parse: ranks, a separator below all of them after each context, a unique end
    size = np.array([len(p) for p in parses])
    start = np.cumsum(size + 1) - size - 1
    text = np.ones(int((size + 1).sum()) + 1, np.int64)
    text[-1] = 0
    for k, p in enumerate(parses):
        text[start[k] : start[k] + size[k]] = rank[p] + 2
    place = np.empty(len(text), np.int64)
    place[suffix_array(text)] = np.arange(len(text))
    order = np.argsort(place[start], kind="stable")
    common = np.zeros(n, np.int64)
    seen: dict[tuple[int, int], int] = {}
    for k in range(1, n):
        p, q = parses[order[k - 1]], parses[order[k]]
        i = 0
        while i < len(p) and i < len(q) and p[i] == q[i]:
            common[k] += len(dictionary[p[i]]) - s.right
            i += 1
        if i < len(p) and i < len(q):
            pair = p[i], q[i]
            if pair not in seen:
                seen[pair] = _common(dictionary[pair[0]], dictionary[pair[1]])
            common[k] += seen[pair]
        else:  # one of them ends here: what its last phrase has past its trigger is the other's as well
            common[k] += s.right
    return order, common


def end_order(ends: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(contexts in the order of their reversed phrase ends, bytes that each has in common with the one before)."""
    order = sorted(range(len(ends)), key=ends.__getitem__)
    common = np.zeros(len(ends), np.int64)
    for k in range(1, len(order)):
        common[k] = _common(ends[order[k - 1]], ends[order[k]])
    return np.array(order, np.int64), common


def resolve(ends: list[bytes], dictionary: list[bytes], parses: list[list[int]], a_lo: np.ndarray, a_hi: np.ndarray, s: Shape) -> np.ndarray:
    """(contexts, span) flags: the window with a bytes left of the trigger occurs in another context.

    ends: reversed bytes before the trigger.  a_lo, a_hi: least and most bytes left of
    the trigger that a context's windows have.
    """
    n = len(parses)
    out = np.zeros((n, s.span), bool)
    if n < 2:
        return out
    lo_order, lo_common = end_order(ends)
    ro_order, ro_common = parse_order(dictionary, parses, s)
    lc, rc = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(s.span):
        valid = np.flatnonzero((a_lo <= a) & (a <= a_hi))
        if len(valid) < 2:
            continue
        lc[lo_order] = np.cumsum(lo_common < a)
        rc[ro_order] = np.cumsum(ro_common < s.length - a)
        pair = lc[valid] * (n + 1) + rc[valid]
        order = np.argsort(pair, kind="stable")
        same = pair[order][1:] == pair[order][:-1]
        out[valid[order[1:][same]], a] = True
        out[valid[order[:-1][same]], a] = True
    return out


def parse_context(raw: bytes, lo: int, hi: int, t: int, later: list[int], s: Shape) -> tuple[bytes, list[bytes]]:
    """(reversed phrase end left of the trigger, phrases right of it up to the last window's end).

    later: the triggers of the same document after t.
    """
    end, phrases, at = hi + s.length, [], t
    for nxt in later:
        if nxt + s.right >= end:
            break
        phrases.append(raw[at : nxt + s.right])
        at = nxt
    phrases.append(raw[at:end])
    return raw[lo:t][::-1], phrases


def _runs(flag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate([[0], flag.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeated_spans(docs: DataFrame, length: int = 200, with_kept: bool = False, hot: int = 4096, **dealt: int) -> DataFrame:
    """dealt: arguments of ``_packs.exchange``.

    doc_id, n_bytes, spans (byte ranges to remove), kept_sha256 (and the kept bytes) of each row."""
    s = Shape(length)
    packs = _packs.make(docs)
    n_packs = packs.count()
    shift = U64(64 - _packs.FAN_BITS * _packs.levels(n_packs))

    def ask(it):
        for pack, _, _, offs, data in _packs.opened(it):
            lo, hi, t, _ = anchors(data, offs, s)
            yield pack, context_entries(pack, data, offs, lo, hi, t, s)[0]

    def answer(e):
        verdict = judge(e, hot)
        # a repeated context is sent by one pack
        return [verdict, np.where(verdict == REPEATED_SENT, e.least[0] + U64(1), 0)], []

    verdicts = _shared.store(_packs.exchange(packs, ask, answer, n_packs, **dealt), "verdicts")
    asked = packs.unionByName(verdicts.withColumn("kind", F.lit(2)))

    def reopened(pack, rows):
        """The pack's documents, groups of windows, triggers, entries, and the entries' verdicts."""
        ids, null, offs, data = _packs.expand(rows[0][2])
        lo, hi, t, every = anchors(data, offs, s)
        e, entry = context_entries(pack, data, offs, lo, hi, t, s)
        verdict, sender = _packs.replied([body for _, kind, body in rows if kind == 2]) or (np.zeros(0, np.uint64), np.zeros(0, np.uint64))
        # entries that go out, by bucket, and windows whose digests are counted
        out = np.flatnonzero((verdict == OPEN) | (sender == U64(pack + 1)))
        far = np.flatnonzero((verdict == HOT) | (verdict == REPEATED_HOT))
        return ids, null, offs, data, lo, hi, t, every, e, entry, verdict, out, far

    def windows(data, lo, hi, entry, far):
        """(entries of the windows of hot contexts, the entry of each, its start)."""
        g = np.flatnonzero(np.isin(entry, far))
        n = hi[g] - lo[g] + 1
        start = np.repeat(lo[g] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        parts = [_text.range_digest(data, x, x + s.length) for x in np.array_split(start, max(1, len(start) >> 18))]
        h0, h1 = (np.concatenate(x) for x in zip(*parts, strict=True))
        return *_packs.collapse(h0, [h1], [np.ones(len(start), np.uint64)]), start

    def context(pack, rows):
        _, _, _, data, lo, hi, t, every, e, entry, verdict, out, far = reopened(pack, rows)
        if len(far):
            yield _packs.batch([(pack, pack, 4, windows(data, lo, hi, entry, far)[0].body())])
        first = np.zeros(len(e), np.int64)
        first[entry[::-1]] = np.arange(len(entry))[::-1]
        raw = data.tobytes()
        bucket = (e.keys[out] >> shift).astype(np.int64)
        sent = []
        for b in np.unique(bucket).tolist():
            own = out[bucket == b]
            places: dict[bytes, int] = {}
            ends: dict[bytes, int] = {}
            parse, size, left = [], [], []
            for g in first[own].tolist():
                i = np.searchsorted(every, t[g], "right")
                end, phrases = parse_context(raw, int(lo[g]), int(hi[g]), int(t[g]), every[i : i + s.length].tolist(), s)
                left.append(ends.setdefault(end, len(ends)))
                size.append(len(phrases))
                parse += [places.setdefault(p, len(places)) for p in phrases]
            g = first[own]
            texts = [np.frombuffer(b"".join(d), np.uint8) for d in (places, ends)]
            sizes = [np.array([len(x) for x in d], np.uint16) for d in (places, ends)]
            sent.append((b, pack, 3, _packs.squeeze(*texts, *sizes, np.array(parse, np.uint32), np.array(size, np.uint16), np.array(left, np.uint32), (t[g] - hi[g]).astype(np.int16), (t[g] - lo[g]).astype(np.int16), (verdict[own] == OPEN).astype(np.uint8))))
        yield _packs.batch(sent)

    sent = _shared.store(_packs.by_dest(asked, context), "contexts")

    def settle(bucket, rows):
        places: dict[bytes, int] = {}
        parses, ends, a_lo, a_hi, open_ = [], [], [], [], []
        for _, _, body in rows:
            text, end_text, n_text, n_end, parse, size, left, lo, hi, mine = _packs.expand(body)
            cut = lambda x, n: [x[j - k : j] for j, k in zip(np.cumsum(n, dtype=np.int64).tolist(), n.tolist(), strict=True)]
            own = np.array([places.setdefault(p, len(places)) for p in cut(text.tobytes(), n_text)], np.int64)
            parses += [x.tolist() for x in cut(own[parse], size)]
            e = cut(end_text.tobytes(), n_end)
            ends += [e[k] for k in left.tolist()]
            a_lo.append(lo)
            a_hi.append(hi)
            open_.append(mine.astype(bool))
        flags = resolve(ends, list(places), parses, np.concatenate(a_lo).astype(np.int64), np.concatenate(a_hi).astype(np.int64), s)
        at = np.cumsum([0, *map(len, open_)])
        yield _packs.batch([(src, bucket, 3, _packs.squeeze(np.packbits(flags[at[k] : at[k + 1]][open_[k]], axis=1).reshape(-1))) for k, (src, _, _) in enumerate(rows)])

    settled = _packs.by_dest(sent.where("kind = 3"), settle)
    far_ = sent.where("kind = 4")
    counted = _packs.exchange(far_, _packs.read_entries, lambda e: ([(e.counts[0] > 1).astype(np.uint64)], []), far_.count(), **dealt).withColumn("kind", F.lit(4))

    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(pack, rows):
        ids, null, offs, data, lo, hi, t, _, e, entry, verdict, out, far = reopened(pack, rows)
        flow = np.zeros(len(data) + 1, np.int32)
        again = verdict[entry]
        whole = (again == REPEATED) | (again == REPEATED_SENT) | (again == REPEATED_HOT)
        np.add.at(flow, lo[whole], 1)
        np.add.at(flow, hi[whole] + s.length, -1)
        bucket = (e.keys[out] >> shift).astype(np.int64)
        flags = np.zeros((len(e), s.span), bool)
        for src, k, body in rows:
            if k == 3:
                own = out[bucket == src]
                own = own[verdict[own] == OPEN]
                flags[own] = np.unpackbits(_packs.expand(body)[0].reshape(len(own), -1), axis=1, count=s.span).astype(bool) if len(own) else False
        i = np.flatnonzero(again == OPEN)
        g, a = np.nonzero(flags[entry[i]])
        np.add.at(flow, t[i[g]] - a, 1)
        np.add.at(flow, t[i[g]] - a + s.length, -1)
        if len(far):
            _, of, start = windows(data, lo, hi, entry, far)
            hit = start[_packs.replied([body for _, k, body in rows if k == 4])[0][of] > 0]
            np.add.at(flow, hit, 1)
            np.add.at(flow, hit + s.length, -1)
        gone = np.cumsum(flow[:-1]) > 0
        spans, sha, kept = [], [], []
        for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
            a, z = _runs(gone[i:j])
            rest = data[i:j][~gone[i:j]].tobytes() if len(a) else data[i:j].tobytes()
            spans.append([{"start": x, "end": y} for x, y in zip(a.tolist(), z.tolist(), strict=True)])
            sha.append(hashlib.sha256(rest).hexdigest())
            kept.append(rest)
        cols = {"doc_id": pa.array(ids, pa.int64(), mask=null.astype(bool)), "n_bytes": pa.array(np.diff(offs), pa.int64()), "spans": pa.array(spans, kind), "kept_sha256": pa.array(sha)}
        if with_kept:
            cols["kept"] = pa.array(kept, pa.binary())
        yield pa.RecordBatch.from_pydict(cols)

    schema = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept_sha256 string" + (", kept binary" if with_kept else "")
    return _packs.by_dest(asked.unionByName(settled).unionByName(counted), cut, schema)


def op10_exact_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeated_spans(_shared.read(spark, sf_dir, "documents"))
    n_removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return rows.select("doc_id", "n_bytes", n_removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
