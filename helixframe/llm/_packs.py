"""Packs of whole documents, and the messages that tasks exchange about them.

Operators that look up every n-gram or every anchor of a corpus would move a
row for each; here a pack (some megabytes of texts) sends its distinct keys with
counts as compressed vectors and gets an answer for each key back.  Packs are a
table in the shared folder, so every pass sees the same ones whatever is retried.

``exchange`` deals keys by their upper bits, 256 ways at a level.  One level
serves ``most`` packs; beyond, groups of 256 packs merge their keys in a relay,
which takes part in the next level as a pack does.  So a pack or relay sends at
most 256 messages however large the corpus is, and messages grow with the input
times its logarithm to that base.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _shared, _text

SCHEMA = "dest long, src long, kind int, body binary"
_NAMES = ["dest", "src", "kind", "body"]
U64 = np.uint64


def squeeze(*arrays: np.ndarray, level: int = 1) -> bytes:
    """Arrays with their types, compressed."""
    head = [struct.pack("<H", len(arrays))]
    for a in arrays:
        t = a.dtype.str.encode()
        head.append(struct.pack("<BQ", len(t), a.nbytes) + t)
    return zstandard.ZstdCompressor(level=level).compress(b"".join([*head, *[np.ascontiguousarray(a).tobytes() for a in arrays]]))


def expand(body: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(body)
    n, at = struct.unpack_from("<H", raw)[0], 2
    kinds = []
    for _ in range(n):
        t, size = struct.unpack_from("<BQ", raw, at)
        kinds.append((raw[at + 9 : at + 9 + t].decode(), size))
        at += 9 + t
    out = []
    for t, size in kinds:
        dt = np.dtype(t)
        out.append(np.frombuffer(raw, dt, size // dt.itemsize, at))
        at += size
    return out


def ints(x: np.ndarray) -> np.ndarray:
    """Unsigned numbers as byte planes, as many as the largest one needs."""
    if not len(x):
        return np.zeros(0, np.uint8)
    b = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    k = max(1, -(-int(x.max()).bit_length() // 8))
    return np.ascontiguousarray(b[:, :k].T).reshape(-1)


def unints(flat: np.ndarray, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros((n, 8), np.uint8)
    out[:, : len(flat) // n] = flat.reshape(-1, n).T
    return out.view("<u8").reshape(-1)


def planes(sorted_keys: np.ndarray) -> list[np.ndarray]:
    """Ascending unsigned keys as byte planes of their differences (the upper planes compress away)."""
    d = np.diff(sorted_keys, prepend=U64(0))
    b = d.astype("<u8").view(np.uint8).reshape(-1, 8)
    return [np.ascontiguousarray(b[:, k]) for k in range(8)]


def unplanes(cols: list[np.ndarray]) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.stack(cols, axis=1)).view("<u8").reshape(-1), dtype=np.uint64)


def batch(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.binary())], names=_NAMES)


def make(docs: DataFrame, pack_bytes: int = 8 << 20, apart=None) -> DataFrame:
    """dest (the pack's id), src (its number of documents), kind 0, body (doc_ids, whether null, offsets, texts).

    apart: a condition; documents that meet it have packs of their own, with odd ids (others even).
    """

    def run(it):
        from pyspark import TaskContext

        part, seq = TaskContext.get().partitionId(), 0
        held = {k: ([], [], []) for k in (0, 1)}
        size = {0: 0, 1: 0}

        def flush(k):
            ids, lens, data = held[k]
            i = [x for xs in ids for x in xs]
            row = part << 32 | seq << 1 | k, len(i), 0, squeeze(np.array([x or 0 for x in i], np.int64), np.array([x is None for x in i], np.uint8), np.concatenate([[0], np.cumsum(np.concatenate(lens))]).astype(np.int64), np.concatenate(data), level=3)
            held[k], size[k] = ([], [], []), 0
            return batch([row])

        for b, d, o in _text.batches(it, "text", pack_bytes):
            kinds = b.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.diff(o)
            for k in np.unique(kinds).tolist():
                own = np.flatnonzero(kinds == k)
                total = int(n[own].sum())
                if size[k] and size[k] + total > pack_bytes:
                    yield flush(k)
                    seq += 1
                held[k][0].append(b.column(0).take(pa.array(own)).to_pylist())
                held[k][1].append(n[own])
                held[k][2].append(d[np.repeat(kinds == k, n)] if len(own) < len(n) else d.copy())
                size[k] += total
        for k in (0, 1):
            if held[k][0]:
                yield flush(k)
                seq += 1

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (F.lit(False) if apart is None else F.coalesce(apart, F.lit(False))).alias("apart"))
    return _shared.store(src.mapInArrow(run, SCHEMA), "packs")


def opened(it: Iterator[pa.RecordBatch]):
    """(pack id, doc_ids, null flags, offsets, bytes) of each pack."""
    for b in it:
        for dest, body in zip(b.column(0).to_pylist(), b.column(3), strict=True):
            ids, null, offs, data = expand(body.as_py())
            yield dest, ids, null, offs, data
            del ids, null, offs, data
            _text.give_back()


def by_dest(rows: DataFrame, f, schema: str = SCHEMA) -> DataFrame:
    """f(dest, rows sorted by (kind, src)) for all messages to one place; yields batches."""

    def run(t: pa.Table):
        t = t.sort_by([("kind", "ascending"), ("src", "ascending")])
        got = list(zip(t.column("src").to_pylist(), t.column("kind").to_pylist(), t.column("body").to_pylist(), strict=True))
        dest = t.column("dest")[0].as_py()
        del t
        parts = list(f(dest, got))
        del got
        _text.give_back()
        return pa.Table.from_batches(parts) if parts else None

    names = [x.strip().split(" ")[0] for x in schema.split(",")]

    def safe(t: pa.Table) -> pa.Table:
        out = run(t)
        return out if out is not None else pa.table({c: [] for c in names})

    return rows.groupBy("dest").applyInArrow(safe, schema)


# ------------------------------------------------------------------ exchange

#: Bits of a key that a level deals by.
FAN_BITS = 8


class Entries:
    """Distinct (key, extra columns), ascending, with counts, which add up, and other numbers, of which the least stays."""

    def __init__(self, keys: np.ndarray, extra: list[np.ndarray], counts: list[np.ndarray], least: list[np.ndarray] = ()):
        self.keys, self.extra, self.counts, self.least = keys, list(extra), list(counts), list(least)

    def __len__(self) -> int:
        return len(self.keys)

    def cut(self, i: int, j: int) -> Entries:
        return Entries(self.keys[i:j], *[[x[i:j] for x in c] for c in (self.extra, self.counts, self.least)])

    def body(self) -> bytes:
        return squeeze(np.array([len(self), len(self.extra), len(self.counts), len(self.least)], np.int64), *planes(self.keys), *self.extra, *[ints(c) for c in self.counts + self.least])


def collapse(keys: np.ndarray, extra: list[np.ndarray] = (), counts: list[np.ndarray] = (), least: list[np.ndarray] = ()) -> tuple[Entries, np.ndarray]:
    """Entries of rows, and the entry of each row."""
    order = np.lexsort((*extra[::-1], keys)) if len(extra) else np.argsort(keys, kind="stable")
    new = np.ones(len(keys), bool)
    if len(keys):
        new[1:] = False
        for x in (keys, *extra):
            x = x[order]
            new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    at = order[first]
    entry = np.empty(len(keys), np.int32)
    entry[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    by = lambda f, x: f.reduceat(x[order], first) if len(keys) else x
    return Entries(keys[at], [x[at] for x in extra], [by(np.add, x) for x in counts], [by(np.minimum, x) for x in least]), entry


def _entries(body: bytes) -> Entries:
    head, *rest = expand(body)
    n, n_extra, n_counts, n_least = head.tolist()
    numbers = [unints(x, n) for x in rest[8 + n_extra : 8 + n_extra + n_counts + n_least]]
    return Entries(unplanes(rest[:8]), rest[8 : 8 + n_extra], numbers[:n_counts], numbers[n_counts:])


def _merged(rows) -> tuple[Entries, np.ndarray, np.ndarray]:
    """All messages' entries as one, the entry of each row, and each message's first row."""
    parts = [_entries(body) for _, _, body in rows]
    join = lambda f: [np.concatenate(x) for x in zip(*[f(p) for p in parts], strict=True)]
    e, entry = collapse(np.concatenate([p.keys for p in parts]), join(lambda p: p.extra), join(lambda p: p.counts), join(lambda p: p.least))
    return e, entry, np.cumsum([0, *map(len, parts)])


def read_entries(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Entries]]:
    """What rows (dest, .., body) ask, for ``exchange``."""
    for b in it:
        for dest, body in zip(b.column(0).to_pylist(), b.column(3), strict=True):
            yield dest, _entries(body.as_py())


def levels(n_packs: int, most: int = 256, bits: int = FAN_BITS) -> int:
    """Levels of an exchange between so many packs."""
    n = 1
    while n_packs > most:
        n_packs, n = -(-n_packs >> bits), n + 1
    return n


def _deal(src: int, e: Entries, level: int, groups: int, bits: int) -> list[tuple[int, int, int, bytes]]:
    prefix = (e.keys >> U64(64 - bits * (level + 1))).astype(np.int64)
    at = np.concatenate([[0], np.flatnonzero(prefix[1:] != prefix[:-1]) + 1, [len(e)]]) if len(e) else np.zeros(1, np.int64)
    group = int(_text.mix(np.array([src], np.uint64))[0] % U64(groups))
    return [(int(prefix[i]) * groups + group, src, 1, e.cut(i, j).body()) for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]


def reply_body(columns: list[np.ndarray]) -> bytes:
    return squeeze(np.array([len(columns[0]), len(columns)], np.int64), *[ints(c) for c in columns])


def replied(bodies: list[bytes]) -> list[np.ndarray]:
    """The answers to a pack's entries, in their order, from its replies by ascending src."""
    parts = []
    for body in bodies:
        head, *cols = expand(body)
        parts.append([unints(c, int(head[0])) for c in cols])
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else []


def exchange(packs: DataFrame, ask, answer, n_packs: int, notes: bool = False, level: int = 0, most: int = 256, bits: int = FAN_BITS) -> DataFrame:
    """Replies (dest: the pack, src, kind 1, body) to what packs ask.

    ask: from an iterator of batches of packs, (pack, Entries); answer: from all
    entries with one range of keys, the columns of the reply to each and, where
    ``notes`` holds, numbers about the range (sent along as kind 9, dest -1).
    """
    groups = 1 if n_packs <= most else -(-n_packs >> bits)

    def deal(it):
        for pack, e in ask(it):
            if len(e):
                yield batch(_deal(pack, e, level, groups, bits))

    asked = packs.mapInArrow(deal, SCHEMA)

    def split(entry, at, rows, columns):
        return [(src, 0, 1, [c[entry[at[k] : at[k + 1]]] for c in columns]) for k, (src, _, _) in enumerate(rows)]

    if groups == 1:

        def settle(dest, rows):
            e, entry, at = _merged(rows)
            columns, note = answer(e)
            out = [(src, dest, 1, reply_body(c)) for src, _, _, c in split(entry, at, rows, columns)]
            yield batch(out + ([(-1, dest, 9, np.asarray(note, np.int64).tobytes())] if notes else []))

        return by_dest(asked, settle)

    asked = _shared.store(asked, "asked")

    def merge(dest, rows):
        yield batch([(dest, len(rows), 0, _merged(rows)[0].body())])

    relays = _shared.store(by_dest(asked, merge), "relays")

    # a range of keys has as many relays as there are groups
    replies = _shared.store(exchange(relays, read_entries, answer, groups, notes, level + 1, most, bits), "relayed")

    def back(dest, rows):
        asks = [r for r in rows if r[1] == 1]
        _, entry, at = _merged(asks)
        columns = replied([body for _, kind, body in rows if kind == 2])
        yield batch([(src, dest, 1, reply_body(c)) for src, _, _, c in split(entry, at, asks, columns)])

    out = by_dest(asked.unionByName(replies.where("kind = 1").withColumn("kind", F.lit(2))), back)
    return out.unionByName(replies.where("kind = 9")) if notes else out
