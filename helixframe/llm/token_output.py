"""Token-ID output: documents as patched frame-of-reference blocks of token ids.

``encode_documents`` tokenises every whole text, appends an end id and writes
the ids in ascending ``doc_id`` order, one file a range of documents;
``decode_files`` reads such files back.  A file holds blocks of 1,024 ids.  A
block subtracts its minimum and packs the differences at the width that covers
``percentile`` of them; larger ones stand in the block's exception list.  The
footer indexes the starts of the blocks and of the documents, so that a reader
may seek to either.

Nulls: a null text is an empty one (its ids are the end id alone); a null
doc_id sorts first and is kept.  Repeated doc_ids are kept in order of their
text.  An empty table gives no rows and no files.  Other columns are ignored.
"""

from __future__ import annotations

import itertools
import json
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import _files, _shared, _text

U64 = np.uint64
MAGIC = b"HXPFOR01"
BLOCK = 1024
BLOCK_HEAD = struct.Struct("<IBBHI")  # minimum, width, 0, exceptions, ids


# ---------------------------------------------------------------- tokenizing


def _gather(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of all ranges, one after another."""
    n = ends - starts
    return data[np.repeat(starts - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]


class PieceTokenizer:
    """A byte-level BPE tokenizer behind a table of pieces already encoded.

    The pattern of byte-level BPE never joins a character to a space or a
    newline right of it, nor an ASCII letter to certain punctuation, so texts
    are cut there and each different piece is encoded once by the tokenizers
    library.  A piece found by its hash is compared byte by byte with the one in
    the table.  The table is emptied at ``max_pieces`` (a bound of memory, not of
    results), and pieces of more than ``LONGEST`` bytes never enter it.
    """

    CUT_PUNCTUATION = np.zeros(256, bool)
    CUT_PUNCTUATION[np.frombuffer(b".,!?;:#$%&*()", np.uint8)] = True
    LETTER = np.zeros(256, bool)
    LETTER[65:91] = LETTER[97:123] = True
    PRINTABLE = np.zeros(256, bool)
    PRINTABLE[0x21:0x7F] = True
    TWO_BYTE_LEAD = np.zeros(256, bool)
    TWO_BYTE_LEAD[0xC3:0xE0] = True

    LONGEST = 64
    #: Bytes of pieces that are encoded as one text.
    RUN = 16384

    def __init__(self, path: str, max_pieces: int = 600_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.width = np.zeros(size, np.int64)
        for token, i in self.tokenizer.get_vocab().items():
            self.width[i] = len(token)
        self.max_pieces = max_pieces
        self.clear()

    def clear(self) -> None:
        self.size, self.used = 1 << 16, 0
        self.keys = np.zeros(self.size, np.uint64)
        self.entry = np.zeros(self.size, np.int32)
        #: of each entry: its first id and byte; the last one's end
        self.at, self.byte = np.zeros(1, np.int64), np.zeros(1, np.int64)
        self.ids, self.raw = np.zeros(0, np.uint32), np.zeros(0, np.uint8)

    def _slots(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, or -1."""
        mask = self.size - 1
        slot = (h & U64(mask)).astype(np.int64)
        out = np.full(len(h), -1, np.int64)
        left = np.arange(len(h))
        while len(left):
            k = self.keys[slot]
            hit = k == h[left]
            out[left[hit]] = slot[hit]
            go = ~hit & (k != 0)
            left, slot = left[go], (slot[go] + 1) & mask
        return out

    def _insert(self, h: np.ndarray, entry: np.ndarray) -> None:
        while self.used + len(h) > self.size // 2:
            full = self.keys != 0
            old = self.keys[full], self.entry[full]
            self.size *= 2
            self.keys, self.entry, self.used = np.zeros(self.size, np.uint64), np.zeros(self.size, np.int32), 0
            self._place(*old)
        self._place(h, entry)

    def _place(self, h, entry) -> None:
        self.used += len(h)
        slot = (h & U64(self.size - 1)).astype(np.int64)
        left = np.arange(len(h))
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[left[free]]
            own = free & (self.keys[slot] == h[left])
            self.entry[slot[own]] = entry[left[own]]
            go = ~own
            left, slot = left[go], (slot[go] + 1) & (self.size - 1)

    def _find(self, h, data, starts, ends) -> np.ndarray:
        """The entry of each piece, or -1: only one with the very bytes counts."""
        slot = self._slots(h)
        out = np.where(slot >= 0, self.entry[slot], -1)
        got = np.flatnonzero(out >= 0)
        e = out[got]
        size = ends[got] - starts[got]
        same = size == self.byte[e + 1] - self.byte[e]
        same[same] = _text.equal_ranges(data, starts[got][same], self.raw, self.byte[e][same], size[same])
        out[got[~same]] = -1
        return out

    def _encode(self, texts: list[str]) -> np.ndarray:
        """Ids of all texts, one after another."""
        out = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return np.concatenate([np.zeros(0, np.uint32), *[np.array(e.ids, np.uint32) for e in out]])

    def _encode_pieces(self, data, starts, ends) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces, number of ids of each); pieces go to the tokenizer in runs that it is sure to cut where they meet."""
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        raw, edge = _gather(data, starts, ends), np.concatenate([[0], np.cumsum(ends - starts)])
        sure, _ = self.cuts(raw, np.array([0, len(raw)]))
        sure = np.isin(edge[:-1], sure, assume_unique=True)
        sure[np.flatnonzero(np.diff(edge[:-1] // self.RUN, prepend=-1))] = False
        text, cut = raw.tobytes(), np.append(edge[:-1][~sure], len(raw)).tolist()
        flat = self._encode([text[a:b].decode() for a, b in zip(cut[:-1], cut[1:], strict=True)])
        own = np.concatenate([[0], np.cumsum(self.width[flat])])
        at = np.searchsorted(own, edge)
        if own[-1] != edge[-1] or not np.array_equal(own[at], edge):
            raise ValueError("the tokenizer does not keep the bytes of a text")
        return flat, np.diff(at)

    def cuts(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts of pieces, and each document's first piece (an empty document has none)."""
        n = len(data)
        flag = np.zeros(n + 1, bool)
        if n > 1:
            prev, this = data[:-1], data[1:]
            solid = self.PRINTABLE[prev]
            solid[1:] |= self.TWO_BYTE_LEAD[prev[:-1]] & (prev[1:] >= 0x80)
            line = solid & (this == 10)
            flag[1:n] = solid & (this == 32) | line | self.LETTER[prev] & self.CUT_PUNCTUATION[this]
            if n > 2:
                after = data[2:]
                flag[2:n] |= line[:-1] & (self.PRINTABLE[after] | (after == 0xC3))
        flag[offs[:-1]] = True
        flag[n] = False
        starts = np.flatnonzero(flag)
        return starts, np.searchsorted(starts, offs)

    def encode(self, data: np.ndarray, offs: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all documents with the end id after each, number of ids of each)."""
        # a newline cut at a document's first byte would see the document before: offsets always start a piece
        starts, ptr = self.cuts(data, offs)
        ends = np.append(starts[1:], len(data))
        h = _text.range_hash(data, starts, ends)
        h[h == 0] = 1
        if self.used > self.max_pieces:
            self.clear()
        entry = self._find(h, data, starts, ends)
        miss = np.flatnonzero(entry < 0)
        own_ids, at, n = self.ids, np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        if len(miss):
            # one of each hash goes to the table; a long piece, or one that shares its hash with another, is encoded by itself
            short = miss[ends[miss] - starts[miss] <= self.LONGEST]
            new, first = np.unique(h[short], return_index=True)
            first = short[first]
            fresh = self._slots(new) < 0
            new, first = new[fresh], first[fresh]
            flat, count = self._encode_pieces(data, starts[first], ends[first])
            base = len(self.at) - 1
            self.at = np.append(self.at, self.at[-1] + np.cumsum(count))
            self.byte = np.append(self.byte, self.byte[-1] + np.cumsum(ends[first] - starts[first]))
            self.ids = np.append(self.ids, flat)
            self.raw = np.append(self.raw, _gather(data, starts[first], ends[first]))
            self._insert(new, (base + np.arange(len(new))).astype(np.int32))
            entry[miss] = self._find(h[miss], data, starts[miss], ends[miss])
            rest = miss[entry[miss] < 0]
            flat, count = self._encode_pieces(data, starts[rest], ends[rest])
            own_ids = np.append(self.ids, flat)
            at[rest], n[rest] = len(self.ids) + np.cumsum(count) - count, count
        known = entry >= 0
        at[known], n[known] = self.at[entry[known]], (self.at[entry[known] + 1] - self.at[entry[known]])
        # the end id as one more piece after each document's
        at, n = np.insert(at, ptr[1:], 0), np.insert(n, ptr[1:], 1)
        is_end = np.zeros(len(at), bool)
        is_end[ptr[1:] + np.arange(len(ptr) - 1)] = True
        edge = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(at - edge[:-1], n) + np.arange(edge[-1])
        ids = own_ids[place] if len(own_ids) else np.zeros(len(place), np.uint32)
        ids[edge[:-1][is_end]] = end_id
        doc_ends = edge[1:][is_end]
        return ids, np.diff(doc_ends, prepend=0)


_tokenizers: dict[str, PieceTokenizer] = {}


def tokenizer(path: str) -> PieceTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = PieceTokenizer(path)
    return _tokenizers[path]


# --------------------------------------------------------------- file format


def _bits(x: np.ndarray) -> np.ndarray:
    out = np.zeros(x.shape, np.int64)
    for b in range(32):
        out += (x >> np.uint32(b)) > 0
    return out


def _blocks(ids: np.ndarray, percentile: float) -> list[bytes]:
    """Whole blocks of ids; the last one may be short."""
    n = len(ids)
    n_blocks = -(-n // BLOCK)
    if not n:
        return []
    low = np.minimum.reduceat(ids, np.arange(0, n, BLOCK))
    v = np.zeros((n_blocks, BLOCK), np.uint32)
    v.reshape(-1)[:n] = ids
    v -= low[:, None]
    v.reshape(-1)[n:] = 0
    width = _bits(np.sort(v, axis=1)[:, int(percentile * (BLOCK - 1))])
    over = (v.astype(np.uint64) >> width.astype(np.uint64)[:, None]) > 0
    packed: list[bytes] = [b""] * n_blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        if not w:
            continue
        x = np.where(over[rows], 0, v[rows]).astype(np.uint64).reshape(len(rows) * (BLOCK // 64), 64).T.copy()
        out = np.zeros((int(w), x.shape[1]), np.uint64)
        for j in range(64):
            word, off = divmod(j * int(w), 64)
            out[word] |= x[j] << U64(off)
            if off + w > 64:
                out[word + 1] |= x[j] >> U64(64 - off)
        for r, b in zip(rows, out.T.reshape(len(rows), -1), strict=True):
            packed[r] = b.astype("<u8").tobytes()
    done = []
    for b in range(n_blocks):
        where = np.flatnonzero(over[b])
        done.append(BLOCK_HEAD.pack(int(low[b]), int(width[b]), 0, len(where), min(BLOCK, n - b * BLOCK)) + packed[b] + where.astype("<u2").tobytes() + v[b][where].astype("<u4").tobytes())
    return done


class Writer:
    """Writes a token file to a stream, block by block: it holds less than GROUP blocks at a time."""

    GROUP = 256

    def __init__(self, out, meta: dict, percentile: float = 0.9):
        self.out, self.meta, self.percentile = out, meta, percentile
        self.starts, self.at, self.n = [], len(MAGIC), 0
        self.doc_ids, self.lens, self.rest = [], [], np.zeros(0, np.uint32)
        out.write(MAGIC)

    def add(self, ids: np.ndarray, doc_ids: list, lens: np.ndarray) -> None:
        self.doc_ids += doc_ids
        self.lens.append(lens.astype("<u8"))
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        step = self.GROUP * BLOCK
        whole = len(ids) // BLOCK * BLOCK
        for i in range(0, whole, step):
            self._put(ids[i : min(whole, i + step)])
        self.rest = ids[whole:].copy()

    def _put(self, ids: np.ndarray) -> None:
        for b in _blocks(ids, self.percentile):
            self.starts.append(self.at)
            self.at += len(b)
            self.out.write(b)

    def close(self) -> None:
        self._put(self.rest)
        starts = np.array([*self.starts, self.at], "<u8")
        null = np.array([d is None for d in self.doc_ids], np.uint8)
        lens = np.concatenate(self.lens) if self.lens else np.zeros(0, "<u8")
        tail = json.dumps(self.meta | {"blocks": len(starts) - 1, "docs": len(self.doc_ids), "ids": self.n}).encode()
        for x in (starts.tobytes(), np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(), null.tobytes(), lens.tobytes(), tail, struct.pack("<I", len(tail)), MAGIC):
            self.out.write(x)


class Reader:
    """A token file's bytes: documents by the footer, ids by blocks."""

    def __init__(self, raw: bytes):
        raw = memoryview(raw)
        if raw[:8] != MAGIC or raw[-8:] != MAGIC:
            raise ValueError("not a token file")
        size = struct.unpack("<I", raw[-12:-8])[0]
        self.raw, self.meta = raw, json.loads(bytes(raw[-12 - size : -12]))
        n_blocks, n_docs = self.meta["blocks"], self.meta["docs"]
        at = len(raw) - 12 - size - 8 * (n_blocks + 1) - 17 * n_docs
        self.starts = np.frombuffer(raw, "<u8", n_blocks + 1, at).astype(np.int64)
        ids = np.frombuffer(raw, "<i8", n_docs, at + 8 * (n_blocks + 1))
        null = np.frombuffer(raw, "u1", n_docs, at + 8 * (n_blocks + 1 + n_docs))
        self.doc_ids = [None if z else int(d) for d, z in zip(ids, null, strict=True)]
        self.lens = np.frombuffer(raw, "<u8", n_docs, at + 8 * (n_blocks + 1) + 9 * n_docs).astype(np.int64)

    def ids(self, first: int = 0, last: int | None = None) -> np.ndarray:
        """Ids of the blocks from first to before last."""
        raw, starts = self.raw, self.starts[first : (self.meta["blocks"] if last is None else last)]
        heads = [BLOCK_HEAD.unpack_from(raw, s) for s in starts.tolist()]
        width = np.array([h[1] for h in heads], np.int64)
        v = np.zeros((len(heads), BLOCK), np.uint32)
        for w in np.unique(width):
            rows = np.flatnonzero(width == w)
            if not w:
                continue
            x = np.stack([np.frombuffer(raw, "<u8", BLOCK // 64 * int(w), starts[r] + BLOCK_HEAD.size) for r in rows])
            x = x.reshape(len(rows) * (BLOCK // 64), int(w)).T.copy()
            out = np.empty((64, x.shape[1]), np.uint64)
            for j in range(64):
                word, off = divmod(j * int(w), 64)
                out[j] = x[word] >> U64(off)
                if off + w > 64:
                    out[j] |= x[word + 1] << U64(64 - off)
            out &= U64((1 << int(w)) - 1)
            v[rows] = out.T.reshape(len(rows), BLOCK)
        for b, (low, w, _, n_exc, _) in enumerate(heads):
            if n_exc:
                p = starts[b] + BLOCK_HEAD.size + BLOCK // 64 * 8 * w
                v[b, np.frombuffer(raw, "<u2", n_exc, p)] = np.frombuffer(raw, "<u4", n_exc, p + 2 * n_exc)
            v[b] += np.uint32(low)
        return v.reshape(-1)[: sum(h[4] for h in heads)]

    def documents(self, group: int = 256):
        """(first document, last + 1, ids of them, or a part of one document's), a group of blocks after another."""
        ends = np.cumsum(self.lens)
        at, doc, carry = 0, 0, np.zeros(0, np.uint32)
        for b in range(0, self.meta["blocks"], group):
            ids = np.concatenate([carry, self.ids(b, min(self.meta["blocks"], b + group))])
            whole = int(np.searchsorted(ends, at + len(ids), "right"))
            if whole > doc:
                cut = int(ends[whole - 1]) - at
                yield doc, whole, ids[:cut]
                doc, at, ids = whole, at + cut, ids[cut:]
            if len(ids) >= group * BLOCK:  # a document longer than a group of blocks goes out in parts
                yield doc, doc, ids
                at, ids = at + len(ids), ids[:0]
            carry = ids


# ----------------------------------------------------------------- operators


def encode_documents(docs: DataFrame, out: str, tokenizer_path: str, end_id: int = 2, shard_bytes: int = 16 << 20, percentile: float = 0.9) -> DataFrame:
    """Writes ``out``/shard-*.pfor in ascending doc_id order; returns the manifest (shard, path, n_docs, n_ids)."""
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    n = max(1, -(-_shared.text_bytes(src) // shard_bytes))
    # ranges of doc_id are whole partitions, so that partition order is file order
    src = src.repartitionByRange(int(n), "doc_id").sortWithinPartitions("doc_id", "text")

    def write(it):
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        pieces = _text.batches(it, "text", 1 << 20)
        first = next(pieces, None)
        if first is None:
            return
        tok, n_docs, n_ids = tokenizer(tokenizer_path), 0, 0
        path = f"{out}/shard-{shard:08d}.pfor"
        with _files.writing(path) as stream:
            w = Writer(stream, {"shard": shard}, percentile)
            for b, data, offs in itertools.chain([first], pieces):
                ids, lens = tok.encode(data, offs, end_id)
                w.add(ids, b.column(0).to_pylist(), lens)
                n_docs, n_ids = n_docs + len(lens), n_ids + len(ids)
            w.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "path": [path], "n_docs": pa.array([n_docs], pa.int64()), "n_ids": pa.array([n_ids], pa.int64())})

    found = src.mapInArrow(write, "shard long, path string, n_docs long, n_ids long")
    return _shared.store(found, "token-manifest")


def decode_files(spark: SparkSession, out: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, start, n_tokens, ids_crc32 (and the ids), all from the files."""

    def read(it):
        for b in it:
            for raw in b.column(0):
                f = Reader(raw.as_buffer())
                ends = np.cumsum(f.lens)
                part_crc, part_ids = 0, []
                for i, j, ids in f.documents():
                    ids = ids.astype("<u4", copy=False)
                    if i == j:
                        part_crc = zlib.crc32(ids, part_crc)
                        part_ids += [ids] if with_ids else []
                        continue
                    # ids of documents i to j, without what went before of the first one
                    edge = np.concatenate([[0], np.cumsum(f.lens[i:j])])
                    edge[1:] -= edge[-1] - len(ids)
                    crc = [zlib.crc32(ids[a:z], part_crc if k == 0 else 0) for k, (a, z) in enumerate(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))]
                    cols = {
                        "shard": pa.array(np.full(j - i, f.meta["shard"]), pa.int64()),
                        "doc_id": pa.array(f.doc_ids[i:j], pa.int64()),
                        "local": pa.array((ends - f.lens)[i:j], pa.int64()),
                        "n_tokens": pa.array(f.lens[i:j], pa.int64()),
                        "ids_crc32": pa.array(crc, pa.int64()),
                    }
                    if with_ids:
                        all_ids = np.concatenate([*part_ids, ids]).astype(np.int32)
                        cols["ids"] = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(f.lens[i:j])), pa.int32()), pa.array(all_ids))
                    part_crc, part_ids = 0, []
                    yield pa.RecordBatch.from_pydict(cols)

    schema = "shard long, doc_id long, local long, n_tokens long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    if manifest.isEmpty():
        return spark.createDataFrame([], schema.replace("shard long, ", "").replace("local", "start"))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pfor").load(out).select("content")
    rows = files.mapInArrow(read, schema)
    # one row a file
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    base = manifest.select("shard", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))
    more = [F.col("ids")] if with_ids else []
    return rows.join(base, "shard").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32", *more)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _shared.read(spark, sf_dir, "documents")
    out = _shared.new_folder(spark, "tokens")
    return decode_files(spark, out, encode_documents(docs, out, default_tokenizer()))
