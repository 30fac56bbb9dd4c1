"""Near-duplicate lines by a deletion-neighbourhood join.

Lines are compared as word sequences.  A line is dropped if an earlier one, by
(doc_id, line number), is its equal, or is within ``edit_bound`` word edits
(insertion, deletion, substitution): none where the longer of both has less than
5 words, one from there, a tenth of its words from 20.  Blank lines stay.

Packs of whole documents hold their distinct lines and ask, by a 128-bit BLAKE2b
digest, which is the earliest of its kind in the corpus (``_packs.exchange``).  A
distinct line below 20 words emits its deletion neighbourhood: itself and itself
without each of its words, as hashed keys; two lines within one edit share a
variant.  For larger bounds the neighbourhood explodes, so a longer line emits
what the edits within its bound cannot destroy altogether: k edits leave a run of
at least (n - k) / (k + 1) words, which is 6 for n = 20, 7 or more beyond, 8 or
more from 32 and 9 from 81.  Of the grams of five words (six for pairs from 32
words) that such a run holds, that with the smallest hash is a key; lines that
share the run share one.

Packs ask as well which of their keys another line has too; only lines with such
a key go on as rows.  Where the rows of a key meet, lengths, places and parities
of words rule most pairs out before a row is made of them; a line first tries the
earliest line of each key that they leave.  Only lines that this does not settle,
and that had more to try, try all: the earliest NAMED of a key are at hand then,
and where it had more, all rows of the key.  The edit distance is verified on the
words.

Nulls: a null text has no lines; a null doc_id sorts first.  Rows that repeat a
doc_id are told apart, and ordered, by a hash of their text; rows that repeat
both are kept or dropped alike.  An empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _packs, _shared, _text

U64 = np.uint64
#: Fewest words of the longer of two lines within one edit, and within more.
SHORT, LONG = 5, 20
#: Pairs of which the longer line has so many words at least leave runs of 8 words, and of 9.
MIDDLE, FULL = 32, 81
#: The bit of a key that tells grams from variants.
RUN = 1 << 16
#: Buckets of a line's words.
BUCKETS = 128
#: Likely lines that the rows of a key name for a line; beyond, all rows of the key stay at hand.
NAMED = 8


def edit_bound(n: int) -> int:
    """Word edits allowed between two lines of which the longer has n words."""
    return 0 if n < SHORT else max(1, n // 10)


def within_edits(a: list[bytes], b: list[bytes], k: int) -> bool:
    """Whether k word edits turn a into b: furthest places on each diagonal, edit by edit."""
    n, m = len(a), len(b)
    if abs(n - m) > k:
        return False
    if k > 1:
        ca, cb = Counter(a), Counter(b)
        if max((ca - cb).total(), (cb - ca).total()) > k:
            return False

    def slide(i, d):
        while i < n and i + d < m and a[i] == b[i + d]:
            i += 1
        return i

    far = {0: slide(0, 0)}
    for e in range(k + 1):
        if far.get(m - n, -1) >= n:
            return True
        step = {}
        for d in range(max(-e - 1, -n), min(e + 1, m) + 1):
            # a substitution, a word of b more, a word of a more
            i = max(far.get(d, -2) + 1, far.get(d - 1, -2), far.get(d + 1, -2) + 1)
            if i >= 0:
                i = min(i, n, m - d)
                step[d] = slide(i, d)
        far = step
    return False


def split_lines(text: bytes) -> list[tuple[int, bytes]]:
    """(line number, words with a space between) of the non-blank lines."""
    return [(k, w) for k, line in enumerate(text.split(b"\n")) if (w := b" ".join(line.split()))]


# ---------------------------------------------------------------------- keys


def _salted(wh: np.ndarray, place: np.ndarray) -> np.ndarray:
    """A value of each word at its place; a line's hash is their sum."""
    return _text.mix(wh ^ _text.mix(place.astype(np.uint64) + U64(1)))


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, np.uint64)
    np.cumsum(x, out=out[1:])
    return out


def variant_keys(wh: np.ndarray, ptr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, key) of the deletion neighbourhood of each line: the whole line (place -1) and it without the word at a place."""
    n = np.diff(ptr)
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(wh)) - ptr[:-1][row]
    own, moved = _sums(_salted(wh, place)), _sums(_salted(wh, place - 1))
    finish = lambda v, size: _text.mix(v + size.astype(np.uint64) * U64(0xD6E8FEB86659FD93))
    whole = finish(own[ptr[1:]] - own[ptr[:-1]], n)
    at = np.flatnonzero(n[row] >= SHORT)
    r = row[at]
    less = finish((own[at] - own[ptr[:-1][r]]) + (moved[ptr[1:][r]] - moved[at + 1]), n[r] - 1)
    return np.concatenate([np.arange(len(n)), r]), np.concatenate([np.full(len(n), -1), place[at]]), np.concatenate([whole, less])


def run_keys(wh: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line, place, key) of the smallest of consecutive grams of each line.

    Grams of five words for pairs below MIDDLE words, of six for the others; a
    window of grams spans the run that the edits of the pair leave.  The least of
    a window is that of any smaller one around it, so lines of a pair may have
    windows of two sizes.
    """
    n, found = last - first, [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    least = MIDDLE - MIDDLE // 10
    for gram, w, own in ((5, 2, n <= LONG), (5, 3, (n > LONG) & (n < MIDDLE)), (6, 3, (n >= least) & (n < FULL)), (6, 4, n >= FULL)):
        lines = np.flatnonzero(own & (n >= gram + w - 1))
        if not len(lines):
            continue
        ptr = np.concatenate([[0], np.cumsum(n[lines])])
        h = _text.combine(wh[np.repeat(first[lines] - ptr[:-1], n[lines]) + np.arange(ptr[-1])], gram)
        # windows by their first gram, those inside a line
        inside = np.zeros(len(h) + 1, np.int8)
        inside[ptr[:-1]] = 1
        inside[ptr[1:] - gram + 1 - w + 1] = -1
        best, off = h[: len(h) - w + 1], np.zeros(len(h) - w + 1, np.int8)
        for k in range(1, w):
            other = h[k : len(h) - w + 1 + k]
            np.maximum(off, (other < best).view(np.int8) * np.int8(k), out=off)
            best = np.minimum(best, other)
        i = np.flatnonzero(np.cumsum(inside, dtype=np.int8)[: len(off)].view(bool))
        picked = np.zeros(len(h), bool)
        picked[i + off[i]] = True
        at = np.flatnonzero(picked)
        row = np.repeat(np.arange(len(lines)), np.diff(np.searchsorted(at, ptr)))
        found.append((lines[row], at - ptr[row], h[at]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def line_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first word of each line, word hashes) of lines with a space between words."""
    space = np.flatnonzero(data == 32)
    ptr = np.searchsorted(space, offs) + np.arange(len(offs))
    inner = np.ones(len(space) + len(offs) - 1, bool)
    s, e = np.empty(len(inner), np.int64), np.empty(len(inner), np.int64)
    inner[ptr[:-1]] = False
    s[inner], s[~inner] = space + 1, offs[:-1]
    e[:-1][inner[1:]], e[ptr[1:] - 1] = space, offs[1:]
    return ptr, _text.range_hash(data, s, e)


def line_keys(data: np.ndarray, offs: np.ndarray):
    """(word hashes, first word of each line, line of each key, its place, key), by ascending key, then line.

    A key may come several times in a line.  48 bits of each key: lines that agree
    in them are candidates, no more.
    """
    ptr, wh = line_words(data, offs)
    n = np.diff(ptr)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
    short = np.flatnonzero((n >= SHORT - 1) & (n < LONG))
    if len(short):
        sp = np.concatenate([[0], np.cumsum(n[short])])
        at = np.repeat(ptr[:-1][short] - sp[:-1], n[short]) + np.arange(sp[-1])
        row, place, key = variant_keys(wh[at], sp)
        # wholes come before variants: by line
        by = np.argsort(row, kind="stable")
        found.append((short[row[by]], place[by], key[by] & ~U64(RUN)))
    long = np.flatnonzero(n >= LONG - LONG // 10)
    if len(long):
        row, place, key = run_keys(wh, ptr[:-1][long], ptr[1:][long])
        found.append((long[row], place, key | U64(RUN)))
    row, place, key = (np.concatenate(x) for x in zip(*found, strict=True))
    key = key & ~U64(0xFFFF)
    # a sort that keeps the order of equal keys is slower by far than one that does not and another of these
    by = np.argsort(key)
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = key[by[1:]] == key[by[:-1]]
    tied = np.flatnonzero(same[1:] | same[:-1])
    by[tied] = by[tied][np.lexsort((by[tied], key[by[tied]]))]
    return wh, ptr, row[by], place[by], key[by]


def repeats(row: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of keys as ``line_keys`` orders them: whether a key is new, and whether line and key are."""
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    own = new.copy()
    own[1:] |= row[1:] != row[:-1]
    return new, own


def word_counts(wh: np.ndarray, first: np.ndarray, last: np.ndarray, buckets: int) -> np.ndarray:
    """Of each line, how many of its words fall into each bucket of hashes, modulo 256."""
    n = last - first
    at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
    out = np.zeros(len(n) * buckets, np.uint8)
    np.add.at(out, np.repeat(np.arange(len(n)) * buckets, n) + (wh[at] & U64(buckets - 1)).astype(np.int64), np.uint8(1))
    return out.reshape(len(n), buckets)


# --------------------------------------------------------------------- packs


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("rk"), text.alias("text"))


def line_packs(docs: DataFrame, pack_bytes: int = 8 << 20) -> DataFrame:
    """Packs of whole documents and their distinct lines.

    Of documents: doc, whether null, rk, first line; of lines: number, distinct
    line; of distinct lines, by digest: digest, earliest line, offsets, words.
    """

    def run(it):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held, words, number, ptr, size = [], [], [], [0], 0

        def flush():
            t = pa.Table.from_batches(held)
            doc, rk = (t.column(c).fill_null(0).to_numpy() for c in ("doc", "rk"))
            null = np.asarray(t.column("doc").is_null()).astype(np.uint8)
            index: dict[bytes, int] = {}
            which = np.array([index.setdefault(w, len(index)) for w in words], np.int32)
            lh = np.frombuffer(b"".join(hashlib.blake2b(w, digest_size=16).digest() for w in index), np.uint64).reshape(-1, 2)
            by = np.lexsort((lh[:, 1], lh[:, 0]))
            at = np.empty(len(by), np.int32)
            at[by] = np.arange(len(by))
            which = at[which]
            by_place = np.lexsort((rk, doc, 1 - null))
            rank = np.empty(len(doc), np.int64)
            rank[by_place] = np.arange(len(doc))
            line = np.array(number, np.int32)
            by_line = np.lexsort((line, np.repeat(rank, np.diff(ptr)), which))
            first = by_line[np.searchsorted(which[by_line], np.arange(len(by)))].astype(np.int32)
            distinct = list(index)
            distinct = [distinct[k] for k in by.tolist()]
            offs = np.concatenate([[0], np.cumsum([len(w) for w in distinct])]).astype(np.int64)
            body = _packs.squeeze(doc, null, rk, np.array(ptr, np.int64), line, which, lh[by], first, offs, np.frombuffer(b"".join(distinct), np.uint8), level=3)
            return _packs.batch([(part << 15 | seq, len(by), 0, body)])

        for b, data, offs in _text.batches(it, "text", min(pack_bytes, 1 << 20)):
            if size and size + len(data) + b.num_rows > pack_bytes:
                yield flush()
                seq += 1
                held, words, number, ptr, size = [], [], [], [0], 0
            raw = data.tobytes()
            for i, j in zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True):
                for k, w in split_lines(raw[i:j]):
                    number.append(k)
                    words.append(w)
                ptr.append(len(words))
            held.append(b.select(["doc", "rk"]))
            size += len(data) + b.num_rows
        if held:
            yield flush()

    return _shared.store(_keyed(docs).mapInArrow(run, _packs.SCHEMA), "line-packs")


CANDIDATE = "id long, doc long, rk long, line long, n long, p0 long, p1 long, counts binary, keys array<long>, places array<long>, words binary"
#: Of a row of a document: its non-blank lines, and those equal to an earlier one.
SETTLED = CANDIDATE + ", n_lines long, equal array<long>"


def settled(packs: DataFrame, **dealt: int) -> DataFrame:
    """Two kinds of rows (SETTLED): of each document (no id), and of each line with a key that is not its own alone, with those keys (CANDIDATE).

    A line of several packs counts for its keys in each of them, so a key is of
    another line too if its count is above that of the packs that hold the line.
    """

    def opened(body):
        doc, null, rk, ptr, line, which, lh, first, offs, words = _packs.expand(body)
        return doc, null.astype(bool), rk, ptr, line, which, lh.reshape(-1, 2), first, offs, words

    def places(doc, null, rk, ptr, line, at):
        """(whether not null, doc, rk, number) of lines."""
        d = np.searchsorted(ptr, at, "right") - 1
        return (~null[d]).astype(np.uint8), doc[d], rk[d], line[at]

    def ask_lines(it):
        for b in it:
            for pack, body in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                doc, null, rk, ptr, line, _, lh, first, *_ = opened(body.as_py())
                yield pack, _packs.Entries(lh[:, 0], [lh[:, 1], *places(doc, null, rk, ptr, line, first), np.full(len(lh), pack)], [])
                _text.give_back()

    def answer_lines(e):
        """Of each pack's line: 2 for the earliest place, 1 for the same place in another pack (a repeated row), else 0; packs that hold the line."""
        lo, *place, _ = e.extra
        new = np.ones(len(e), bool)
        new[1:] = (e.keys[1:] != e.keys[:-1]) | (lo[1:] != lo[:-1])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        same = np.logical_and.reduce([x == x[start[group]] for x in place])
        return [same.astype(np.uint64) + new, np.diff(start, append=len(e)).astype(np.uint64)[group]], []

    def ask_keys(it):
        for b in it:
            for pack, body in zip(b.column(0).to_pylist(), b.column(3), strict=True):
                *_, offs, words = opened(body.as_py())
                _, _, row, _, key = line_keys(words, offs)
                new, own = repeats(row, key)
                lines_of = np.add.reduceat(own, np.flatnonzero(new), dtype=np.uint64) if len(key) else np.zeros(0, np.uint64)
                e = _packs.Entries(key[new], [], [lines_of])
                del words, row, key, new, own, lines_of
                _text.give_back()
                yield pack, e

    n_packs = packs.count()
    of_lines = _packs.exchange(packs, ask_lines, answer_lines, n_packs, **dealt)
    of_keys = _packs.exchange(packs, ask_keys, lambda e: ([e.counts[0]], []), n_packs, **dealt)
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}
    types = {c: kinds[kind] for c, kind in (x.split() for x in SETTLED.split(","))}

    def rows_of(columns):
        size = len(columns["doc"])
        return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, kind) for c, kind in types.items()], names=list(types))

    def lists(ends, values):
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, pa.int64()))

    def finish(pack, rows):
        doc, null, rk, ptr, line, which, _, first, offs, words = opened(rows[0][2])
        replies = lambda kind: _packs.replied([body for _, k, body in rows if k == kind])
        flag, held_by = replies(3) or [np.zeros(0, np.uint64)] * 2
        own = places(doc, null, rk, ptr, line, np.arange(len(line)))
        same = np.logical_and.reduce([x == x[first[which]] for x in own])
        equal = np.flatnonzero(~(same & (flag[which] > 0)))
        yield rows_of({"doc": pa.array(doc, mask=null), "rk": pa.array(rk), "n_lines": pa.array(np.diff(ptr)), "equal": lists(np.searchsorted(equal, ptr), line[equal].astype(np.int64))})

        wh, wptr, row, place, key = line_keys(words, offs)
        if not len(key):
            return
        new, once = repeats(row, key)
        # a key that a line has at several places has the place -1
        place = np.where(np.append(once[1:], True), place, -1)
        total = replies(2)[0][np.cumsum(new) - 1]
        use = np.flatnonzero(once & (total > held_by[row]) & (flag[row] == 2))
        use = use[np.argsort(row[use], kind="stable")]
        row, place, key = row[use], place[use], key[use].view(np.int64)
        own, at = np.unique(row, return_index=True)
        ends = np.append(at, len(row))
        counts = np.zeros((len(own), BUCKETS), np.uint8)
        for i in range(0, len(own), 4096):
            x = own[i : i + 4096]
            counts[i : i + 4096] = word_counts(wh, wptr[:-1][x], wptr[1:][x], BUCKETS)
        p0, p1 = np.packbits(counts & 1, axis=1).view(np.int64).T
        known, d, r, number = places(doc, null, rk, ptr, line, first[own])
        raw = words.tobytes()
        yield rows_of(
            {
                "id": pa.array(pack << 28 | own), "doc": pa.array(d, mask=known == 0), "rk": pa.array(r), "line": pa.array(number.astype(np.int64)), "n": pa.array(np.diff(wptr)[own]), "p0": pa.array(p0), "p1": pa.array(p1),
                "counts": pa.array([x.tobytes() for x in counts], pa.binary()), "keys": lists(ends, key), "places": lists(ends, place), "words": pa.array([raw[offs[k] : offs[k + 1]] for k in own.tolist()], pa.binary()),
            }
        )

    told = packs.unionByName(of_keys.withColumn("kind", F.lit(2))).unionByName(of_lines.withColumn("kind", F.lit(3)))
    return _packs.by_dest(told, finish, SETTLED)


def candidates(packs: DataFrame, **dealt: int) -> DataFrame:
    """Lines (CANDIDATE) with a key that is not theirs alone, and those keys."""
    return settled(packs, **dealt).where("id IS NOT NULL").drop("n_lines", "equal")


class Groups:
    """Rows of keys, in order of (key, place of the line in the corpus): which earlier lines of a key may be within the bound."""

    def __init__(self, key, n, place, p0, p1):
        self.key, self.n, self.place, self.p0, self.p1 = key, n, place, p0.view(np.uint64), p1.view(np.uint64)
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        self.start = np.flatnonzero(new)[np.cumsum(new) - 1]
        self.pos = np.arange(len(key)) - self.start

    def likely(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether lengths, places and parities of words of rows a and b allow the bound."""
        n, m, pa_, pb = self.n[a], self.n[b], self.place[a], self.place[b]
        longer, more, off = np.maximum(n, m), n - m, pa_ - pb
        bound = np.where(longer < SHORT, 0, np.maximum(1, longer // 10))
        # lines of one length that are one edit apart lack the same place of a variant that they share, and they share that one
        moved = np.where(self.key[a] & RUN, np.maximum(np.abs(off), np.abs(off - more)) <= bound, off == 0)
        odd = np.bitwise_count(self.p0[a] ^ self.p0[b]).astype(np.int64) + np.bitwise_count(self.p1[a] ^ self.p1[b])
        return (np.abs(more) <= bound) & ((pa_ < 0) | (pb < 0) | moved) & (odd <= 2 * bound)

    def first(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, likely row), by row, of the earliest NAMED ones; whether a row has more."""
        out, had = [(np.zeros(0, np.int64),) * 2], np.zeros(len(self.key), np.int64)
        k, at = 0, np.flatnonzero(self.pos > 0)
        while len(at):
            a = at[self.likely(at, self.start[at] + k)]
            had[a] += 1
            a = a[had[a] <= NAMED]
            out.append((a, self.start[a] + k))
            k += 1
            at = at[(self.pos[at] > k) & (had[at] <= NAMED)]
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        by = np.argsort(a, kind="stable")
        return a[by], b[by], had > NAMED

    def all(self, asked: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, likely row), by row, of each asked row and all earlier ones of its key; the counts of their words allow the bound too."""
        out = [(np.zeros(0, np.int64),) * 2]
        k, at = 0, np.flatnonzero(asked & (self.pos > 0))
        while len(at):
            a = at[self.likely(at, self.start[at] + k)]
            b = self.start[a] + k
            bound = np.maximum(1, np.maximum(self.n[a], self.n[b]) // 10)
            off = (counts[a] - counts[b]).view(np.int8).astype(np.int64)
            more, less = np.maximum(off, 0).sum(axis=1), np.maximum(-off, 0).sum(axis=1)
            # an edit takes one word and gives one; counts are modulo 256, so that beyond 127 signs may be wrong
            ok = np.where(bound < 128, np.maximum(more, less) <= bound, more + less <= 2 * bound)
            out.append((a[ok], b[ok]))
            k += 1
            at = at[self.pos[at] > k]
        a, b = (np.concatenate(x) for x in zip(*out, strict=True))
        by = np.argsort(a, kind="stable")
        return a[by], b[by]


LIKELY = "a long, bs array<long>, key long, open boolean, n int, place int, p0 long, p1 long, pos int"


def likely_pairs(keys: DataFrame, every: bool = False) -> DataFrame:
    """a, bs: lines and the likely lines of a key, a row a key (LIKELY).

    The earliest NAMED ones; a line that has more is open, and then all lines of
    the key have a row, with their places in it (pos).  every: all likely lines of
    those asked, of the rows of such keys (a, bs only).
    """
    order = ["key", "pos"] if every else ["key", "doc", "rk", "line"]
    rows = keys.repartition("key").sortWithinPartitions(*order).select("key", "id", "n", "place", "p0", "p1", *(["asked", "counts"] if every else []))

    def pairs(t: pa.Table):
        col = lambda c: t.column(c).to_numpy()
        g = Groups(*[col(c) for c in ("key", "n", "place", "p0", "p1")])
        ids = col("id")
        named = lambda a, b, own: pa.ListArray.from_arrays(pa.array(np.searchsorted(a, np.append(own, len(ids))).astype(np.int32)), pa.array(ids[b]))
        if every:
            a, b = g.all(col("asked"), np.frombuffer(b"".join(t.column("counts").to_pylist()), np.uint8).reshape(-1, BUCKETS))
            own = np.unique(a)
            yield pa.RecordBatch.from_arrays([pa.array(ids[own]), named(a, b, own)], names=["a", "bs"])
            return
        a, b, more = g.first()
        whole = np.zeros(len(ids), bool)
        whole[g.start[more]] = True
        whole = whole[g.start]
        keep = whole.copy()
        keep[a] = True
        own = np.flatnonzero(keep)
        of_key = [pa.array(c.astype(kind), mask=~whole[own]) for c, kind in ((g.n[own], np.int32), (g.place[own], np.int32), (col("p0")[own], np.int64), (col("p1")[own], np.int64), (g.pos[own], np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array(ids[own]), named(a, b, own), pa.array(g.key[own]), pa.array(more[own]), *of_key], names=[x.split()[0] for x in LIKELY.split(", ")])

    def run(it):
        held, size = [], 0
        for b in it:
            if not b.num_rows:
                continue
            held, size = [*held, b], size + b.num_rows
            last = b.column(0)[b.num_rows - 1]
            # whole keys only: the last one of these rows may go on
            if size >= 1 << 17 and held[0].column(0)[0] != last:
                t = pa.Table.from_batches(held)
                cut = int(np.searchsorted(t.column("key").to_numpy(), last.as_py()))
                yield from pairs(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                size = t.num_rows - cut
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a long, bs array<long>" if every else LIKELY)


def verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """id of the later line of each of the distinct pairs (a, b) within the bound."""
    side = lambda x: words.select(F.col("id").alias(x), F.col("words").alias(f"{x}_words"))
    p = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "a_words", "b_words")

    def run(it):
        for r in it:
            ok = []
            for x, y in zip(r.column(1), r.column(2), strict=True):
                a, b = x.as_py().split(), y.as_py().split()
                ok.append(within_edits(a, b, edit_bound(max(len(a), len(b)))))
            yield pa.RecordBatch.from_arrays([r.column(0).filter(pa.array(ok, pa.bool_()))], names=["id"])

    return p.mapInArrow(run, "id long").distinct()


def near_lines(cand: DataFrame) -> DataFrame:
    """id of the candidates that have an earlier line within the bound."""
    keys = cand.select("id", "doc", "rk", F.col("line").cast("int").alias("line"), F.col("n").cast("int").alias("n"), "p0", "p1", F.explode(F.arrays_zip("keys", "places")).alias("k"))
    keys = keys.select(F.col("k.keys").alias("key"), F.col("k.places").cast("int").alias("place"), "id", "doc", "rk", "line", "n", "p0", "p1")
    # tables that are written have a known size, and Spark sends them to the other side if they are small
    first = _shared.store(likely_pairs(keys), "near-likely")
    # few candidates have a likely line; their words are looked up once.  These tables are dealt out at any size, so that
    # disk grows with the input as it does on small ones
    met = first.select(F.explode(F.concat(F.array("a"), "bs")).alias("id")).distinct()
    words = _shared.store(cand.select("id", "counts", "words").join(met.hint("merge"), "id", "left_semi"), "near-words")
    found = _shared.store(verified(_shared.store(first.where("size(bs) > 0").select("a", F.element_at("bs", 1).alias("b")).distinct(), "near-pairs").hint("merge"), words), "near-first")
    # lines whose earliest likely line is not near, but which had more to try, try all
    left = _shared.store(first.where("size(bs) > 1").select("a", "bs", "key", "open").join(found, F.col("a") == F.col("id"), "left_anti"), "near-open")
    named = left.select("a", F.explode(F.slice("bs", 2, NAMED)).alias("b"))
    asked = left.where("open").select("key", F.col("a").alias("id"), F.lit(True).alias("asked"))
    # the rows of keys that name all their lines are few; the others are not dealt out again
    again = first.where("pos IS NOT NULL").select("key", F.col("a").alias("id"), "n", "place", "p0", "p1", "pos")
    again = again.join(asked.select("key").distinct(), "key", "left_semi").join(asked, ["key", "id"], "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    again = again.join(words.select("id", "counts"), "id")
    # lines share many keys: one list of lines to try for each, however many keys name them
    each = likely_pairs(again, every=True).groupBy("a").agg(F.array_distinct(F.flatten(F.collect_list("bs"))).alias("bs"))
    rest = verified(_shared.store(each.select("a", F.explode("bs").alias("b")).unionByName(named).distinct(), "near-rest"), words)
    return _shared.store(found.unionByName(rest).distinct(), "near-lines")


# ----------------------------------------------------------------- operators


def dropped_lines(docs: DataFrame, pack_bytes: int = 8 << 20, **dealt: int) -> DataFrame:
    """doc, rk (hash of the text), n_lines, equal and near (line numbers to drop), for each row.

    dealt: arguments of ``_packs.exchange``.
    """
    packs = line_packs(docs, pack_bytes)
    found = _shared.store(settled(packs, **dealt), "line-candidates")
    _shared.drop(packs)
    cand = found.where("id IS NOT NULL")
    near = near_lines(cand)
    close = near.join(cand.select("id", "doc", "rk", "line"), "id").groupBy(F.col("doc").alias("d"), F.col("rk").alias("r")).agg(F.array_sort(F.collect_list("line")).alias("near"))
    rows = found.where("id IS NULL").select("doc", "rk", "n_lines", "equal")
    rows = rows.join(close, F.col("doc").eqNullSafe(F.col("d")) & (F.col("rk") == F.col("r")), "left")
    return rows.select("doc", "rk", "n_lines", "equal", F.coalesce("near", F.array().cast("array<bigint>")).alias("near"))


def without_lines(docs: DataFrame, **options: int) -> DataFrame:
    """docs, all columns, with the lines dropped from their texts."""
    gone = dropped_lines(docs, **options).select("doc", "rk", F.concat("equal", "near").alias("gone")).dropDuplicates(["doc", "rk"])
    text = F.col("text").cast("string")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col("doc_id").cast("long").alias("d"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("r"), F.split(text, "\n", -1).alias("lines"))
    rows = rows.join(gone, F.col("d").eqNullSafe(F.col("doc")) & (F.col("r") == F.col("rk")), "left")
    kept = F.array_join(F.filter("lines", lambda _, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<bigint>")), i.cast("long"))), "\n")
    return rows.select(*[(F.when(F.col("lines").isNull(), F.lit(None)).otherwise(kept) if c == "text" else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its non-blank lines, those dropped as equals and as near duplicates, and which."""
    rows = dropped_lines(_shared.read(spark, sf_dir, "documents"))
    count = lambda c: F.size(c).cast("long")
    return rows.select(F.col("doc").alias("doc_id"), "n_lines", count("equal").alias("n_equal"), count("near").alias("n_near"), F.array_join(F.array_sort(F.concat("equal", "near")), ",").alias("dropped"))
