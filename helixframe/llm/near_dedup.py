"""Near-duplicate documents by MinHash with odd sketches.

One pass over whole texts gives each document the distinct five-word shingles
of its words, ``samples`` MinHash values of them, their banded keys and an odd
sketch: the samples folded into a bitmap of parities.  The population count of
two sketches' XOR estimates a high similarity precisely and clears candidates
of the bands cheaply; what it lets through is confirmed on full shingle sets.

Documents with equal sets are first collapsed to one node.  In a band
bucket every member is tried against the smallest id; components that result
are merged, and only buckets whose members still lie in different components
have their other cross-component pairs tried, in blocks of bounded size, by
sketch and then on full sets in place.  A block gives back links that join its
components and no others, fewer than it has members.  So a group of copies costs
what it has members, and no candidate link between two components goes untested.

Nulls and texts without words have an empty set and link to nothing.  Null
doc_ids are kept as singletons of component null.  Rows that repeat a doc_id
are one document: the sets of all of them link it; each row comes back with the
size of its own set.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _shared, _text
from .components import connected_components

U64 = np.uint64
SAMPLES, ROWS, BANDS, BITS = 256, 4, 32, 1024
FINE_SAMPLES, FINE_BITS = 2048, 8192
BLOCK_SHINGLES = 2 << 20
_rng = np.random.Generator(np.random.PCG64(0x0DD))
SEED_XOR = _rng.integers(0, 2**63, 4096, dtype=np.uint64)
SEED_MUL = _rng.integers(0, 2**62, 4096, dtype=np.uint64) * U64(2) + U64(1)


def sketch_distance(similarity: float, samples: int = SAMPLES, bits: int = BITS) -> int:
    """Differing bits that are expected at a similarity: J = 1 + bits / (4 samples) * ln(1 - 2 d / bits)."""
    return math.ceil(bits / 2 * (1 - math.exp((similarity - 1) * 4 * samples / bits)))


def minhashes(h: np.ndarray, starts: np.ndarray, samples: int) -> np.ndarray:
    """(samples, documents); every document has a shingle."""
    out = np.empty((samples, len(starts)), np.uint64)
    for i in range(samples):
        out[i] = np.minimum.reduceat((h ^ SEED_XOR[i]) * SEED_MUL[i], starts)
    return out


def odd_sketch(mins: np.ndarray, bits: int = BITS) -> np.ndarray:
    """(documents, bits / 8) parity bitmaps."""
    n = mins.shape[1]
    flip = np.zeros((n, bits), np.uint8)
    rows = np.arange(n)
    for i, m in enumerate(mins):
        flip[rows, (_text.mix(m + U64(i)) % U64(bits)).astype(np.int64)] ^= 1
    return np.packbits(flip, axis=1)


def set_keys(vals: np.ndarray, starts: np.ndarray, size: np.ndarray) -> np.ndarray:
    """(sets, 3): what tells sets of shingles apart, 128 bits of hashes and the size."""
    return np.stack([np.add.reduceat(_text.mix(vals), starts), np.add.reduceat(_text.mix(vals ^ SEED_XOR[0]), starts), size.astype(np.uint64)], axis=1)


def features(docs: DataFrame, n: int = 5, samples: int = SAMPLES, rows: int = ROWS, bands: int = BANDS) -> DataFrame:
    """doc_id, n_shingles, set_key (of the whole set), bands, sketch."""

    def run(it):
        for b, data, offs in _text.batches(it, "text"):
            _, _, ptr, h = _text.words(data, offs, _text.NOT_SPACE)
            vals, _, at = _text.shingles(h, ptr, n)
            size = np.diff(at)
            has = np.flatnonzero(size)
            sketches, band_keys, keys = [None] * len(size), [None] * len(size), [None] * len(size)
            if len(has):
                starts = at[:-1][has]
                mins = minhashes(vals, starts, samples)
                sk = odd_sketch(mins)
                banded = np.zeros((bands, len(has)), np.uint64)
                for i in range(bands):
                    banded[i] = _text.mix(_text.combine(np.ascontiguousarray(mins[i * rows : (i + 1) * rows].T).reshape(-1), rows)[::rows] + U64(i))
                key = set_keys(vals, starts, size[has])
                banded = banded.T.astype(np.int64, casting="unsafe")
                for j, d in enumerate(has.tolist()):
                    sketches[d], band_keys[d], keys[d] = sk[j].tobytes(), banded[j], key[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(keys, pa.binary()), pa.array(band_keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())],
                names=["doc_id", "n_shingles", "set_key", "bands", "sketch"],
            )

    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return src.mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>, sketch binary")


def shingle_sets(texts: DataFrame, n: int = 5) -> DataFrame:
    """id, shingles (binary: sorted unsigned 64-bit hashes) of rows (id, set_key, text) whose text has that set."""

    def run(it):
        for b, data, offs in _text.batches(it, "text"):
            _, _, ptr, h = _text.words(data, offs, _text.NOT_SPACE)
            vals, _, at = _text.shingles(h, ptr, n)
            has = np.flatnonzero(np.diff(at))
            keys = set_keys(vals, at[:-1][has], np.diff(at)[has]) if len(has) else []
            same = [d for d, k, want in zip(has.tolist(), keys, b.column(1).take(pa.array(has)).to_pylist(), strict=True) if k.tobytes() == want]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(same, pa.int64())), pa.array([vals[at[d] : at[d + 1]].tobytes() for d in same], pa.binary())], names=["id", "shingles"])

    return texts.select("id", "set_key", "text").mapInArrow(run, "id long, shingles binary")


def fine_sketches(sets: DataFrame) -> DataFrame:
    """id, fine: a larger sketch, for the documents whose pairs are many and near the threshold."""

    def run(it):
        for b in it:
            ids, out = b.column(0), []
            for i in range(0, b.num_rows, 256):
                raw, offs = _text.buffers(b.column(1).slice(i, 256))
                vals = np.ascontiguousarray(raw).view(np.uint64)
                out += [x.tobytes() for x in odd_sketch(minhashes(vals, offs[:-1] // 8, FINE_SAMPLES), FINE_BITS)]
            yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary())], names=["id", "fine"])

    return sets.mapInArrow(run, "id long, fine binary")


def _sketches_allow(pairs: DataFrame, most: int) -> DataFrame:
    """Keeps pairs (a, b, sa, sb) whose sketches differ in at most ``most`` bits."""

    def run(it):
        for b in it:
            if not b.num_rows:
                continue
            x, _ = _text.buffers(b.column(2))
            y, _ = _text.buffers(b.column(3))
            far = np.bitwise_count(x ^ y).reshape(b.num_rows, -1).sum(axis=1, dtype=np.int64)
            keep = pa.array(far <= most)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


def _linked(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are as similar as asked for."""
    if len(x) > len(y):
        x, y = y, x
    if 100 * len(x) < percent * len(y) or not len(x):
        return False
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return 100 * both >= percent * (len(x) + len(y) - both) and both > 0


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links among candidate pairs (a, b), by their full shingle sets."""
    joined = pairs.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b").join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").select("a", "b", "sa", "sb")

    def run(it):
        for b in it:
            keep = [_linked(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(b.column(2), b.column(3), strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(mask), b.column(1).filter(mask)], names=["a", "b"])

    return _shared.store(joined.mapInArrow(run, "a long, b long"), "links")


def _in_blocks(members: DataFrame, block: int, *columns: str) -> DataFrame:
    """Members (key, id, component, size, sketch) by pairs (p, q) of their bucket's blocks.

    A bucket is cut into blocks of about ``block`` members, or of BLOCK_SHINGLES shingles if those are fewer, and each
    pair of blocks is a group of its own: no task holds more than two blocks.
    """
    sizes = members.groupBy("key").agg(F.ceil(F.greatest(F.count("*") / block, F.sum("size") / BLOCK_SHINGLES)).cast("int").alias("k"))
    placed = members.join(sizes, "key").withColumn("i", F.pmod(F.xxhash64("id"), F.col("k")).cast("int"))
    placed = placed.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    return placed.select("key", F.least("i", "j").alias("p"), F.greatest("i", "j").alias("q"), "i", "id", "component", "size", "sketch", *columns)


class _Block:
    """A pair of blocks in memory: for a member, the ones that it may be linked with."""

    def __init__(self, t: pa.Table, percent: int):
        self.ids, comp, i, self.size = (t.column(c).to_numpy() for c in ("id", "component", "i", "size"))
        self.percent, self.sketch = percent, self.bits(t.column("sketch"))
        self.one = t.column("p")[0].as_py() == t.column("q")[0].as_py()
        self.side = np.zeros(len(self.ids), bool) if self.one else i == i.min()
        self.kinds, self.inv, count = np.unique(comp, return_inverse=True, return_counts=True)
        self.largest = count.argmax()
        self.small = np.flatnonzero(self.inv != self.largest).tolist()

    def bits(self, column) -> np.ndarray:
        raw, _ = _text.buffers(column)
        return np.ascontiguousarray(raw).view(np.uint64).reshape(len(self.ids), -1)

    def others(self, x: int, both_ways: bool) -> tuple[np.ndarray, np.ndarray]:
        """Members of other components whose sizes rule no link out, and how far their sketches are from x's."""
        # both members outside the largest component: once, unless both ways are asked for
        ok = (self.inv != self.inv[x]) & (both_ways | (self.inv == self.largest) | (self.ids > self.ids[x]))
        ok &= (self.one | (self.side != self.side[x])) & (100 * np.minimum(self.size, self.size[x]) >= self.percent * np.maximum(self.size, self.size[x]))
        other = np.flatnonzero(ok)
        return other, np.bitwise_count(self.sketch[other] ^ self.sketch[x]).sum(axis=1, dtype=np.int64)

    def pairs(self, a: list, b: list) -> pa.Table:
        a, b = self.ids[np.array(a, np.int64)], self.ids[np.array(b, np.int64)]
        return pa.table({"a": pa.array(np.minimum(a, b), pa.int64()), "b": pa.array(np.maximum(a, b), pa.int64())})


def _nearest_pairs(members: DataFrame, percent: int, most: int, block: int, nearest: int) -> DataFrame:
    """Candidates: of each member outside its block's largest component the ``nearest`` few of other components, by sketch."""

    def run(t: pa.Table) -> pa.Table:
        m, a, b = _Block(t, percent), [], []
        for x in m.small:
            other, d = m.others(x, True)
            if len(d) > nearest:
                best = np.argpartition(d, nearest)[:nearest]
                other, d = other[best], d[best]
            near = other[d <= most].tolist()
            a += [x] * len(near)
            b += near
        return m.pairs(a, b)

    return _in_blocks(members, block).groupBy("key", "p", "q").applyInArrow(run, "a long, b long").distinct()


def _joining_links(members: DataFrame, percent: int, most: int, most_fine: int, block: int) -> DataFrame:
    """Links between the components of each bucket, confirmed on full sets (columns fine and shingles beside the others).

    Every pair of different components that both sketches allow is compared, nearest first, unless links found before
    join the two: a pair of blocks gives less links than it has components.
    """

    def run(t: pa.Table) -> pa.Table:
        m, a, b = _Block(t, percent), [], []
        fine, shingles = m.bits(t.column("fine")), t.column("shingles")
        held: dict[int, np.ndarray] = {}

        def shingles_of(x: int) -> np.ndarray:
            if x not in held:
                held[x] = np.frombuffer(shingles[x].as_buffer(), np.uint64)
            return held[x]

        label = np.arange(len(m.kinds))  # of a component: the one that it is joined to so far
        for x in m.small:
            other, d = m.others(x, False)
            other = other[d <= most]
            far = np.bitwise_count(fine[other] ^ fine[x]).sum(axis=1, dtype=np.int64)
            for k in np.argsort(far, kind="stable").tolist():
                if far[k] > most_fine:
                    break
                y = int(other[k])
                u, v = label[m.inv[x]], label[m.inv[y]]
                if u != v and _linked(shingles_of(x), shingles_of(y), percent):
                    label[label == v] = u
                    a.append(x)
                    b.append(y)
        return m.pairs(a, b)

    return _in_blocks(members, block, "fine", "shingles").groupBy("key", "p", "q").applyInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, percent: int = 75, n: int = 5, margin: float = 0.14, fine_margin: float = 0.05, block: int = 4096) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, for each row of ``docs``."""
    most = sketch_distance(percent / 100 - margin)
    found = _shared.store(features(docs, n), "near-features")
    own = found.where("set_key is not null and doc_id is not null")
    reps = own.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    # numbered as they are stored, so that a retry sees the same ones
    reps = _shared.store(_shared.store(reps, "near-sets").withColumn("id", F.monotonically_increasing_id()), "near-nodes")
    repeated_ids = not found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()

    banded = reps.select("id", F.explode("bands").alias("key"))
    heads = banded.groupBy("key").agg(F.min("id").alias("head"), F.count("*").alias("n")).where("n > 1")
    members = _shared.store(banded.join(heads, "key").select("key", "head", "id"), "near-buckets")
    sk = reps.select("id", "sketch", "size")

    def with_sketches(pairs):
        return pairs.join(sk.select(F.col("id").alias("b"), F.col("sketch").alias("sb")), "b").join(sk.select(F.col("id").alias("a"), F.col("sketch").alias("sa")), "a").select("a", "b", "sa", "sb")

    # ids grow with the input: never broadcast
    nodes = reps.join(members.select("id").distinct().hint("merge"), "id", "left_semi").select("id", "set_key", "rep")
    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), F.col("text").cast("string").alias("text")).join(nodes.hint("merge"), "rep").select("id", "set_key", "text")
    sets = shingle_sets(texts, n)
    sets = _shared.store(sets.dropDuplicates(["id"]) if repeated_ids else sets, "near-shingles")

    stars = members.where("id <> head").select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()
    tested = _shared.store(_sketches_allow(with_sketches(stars), most), "near-candidates")
    links = _confirm(tested, sets, percent)
    if repeated_ids:
        # the sets of one document belong together
        one = own.select("doc_id", "set_key").join(reps.select("set_key", "id"), "set_key").groupBy("doc_id").agg(F.min("id").alias("a"), F.collect_set("id").alias("ids"))
        links = links.unionByName(one.where(F.size("ids") > 1).select("a", F.explode("ids").alias("b")).where("a <> b"))
    comps = _shared.store(connected_components(links), "near-components")
    for nearest in (2, 0):
        # buckets that still hold several components
        now = members.select("key", "id").join(comps, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
        split = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("key")
        rest = now.join(split, "key").join(sk, "id").select("key", "id", "component", "size", "sketch")
        if nearest:
            pairs = _nearest_pairs(rest, percent, most, block, nearest)
            links = _confirm(_shared.store(pairs.join(tested, ["a", "b"], "left_anti"), "near-candidates"), sets, percent)
        else:
            rest = _shared.store(rest, "near-rest")
            open_ = sets.join(rest.select("id").distinct(), "id", "left_semi")
            rest = rest.join(_shared.store(fine_sketches(open_), "near-fine"), "id").join(open_, "id")
            most_fine = sketch_distance(percent / 100 - fine_margin, FINE_SAMPLES, FINE_BITS)
            links = _shared.store(_joining_links(rest, percent, most, most_fine, block), "near-links")
        if not links.isEmpty():
            # components so far stand for their links
            comps = _shared.store(connected_components(links.unionByName(comps.select(F.col("id").alias("a"), F.col("component").alias("b")))), "near-components")

    # a component is known by its smallest doc_id
    labelled = reps.select("id", "set_key", "rep").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    label = labelled.groupBy("component").agg(F.min("rep").alias("least"))
    per_set = labelled.join(label, "component").select("set_key", "least")
    out = found.select("doc_id", "n_shingles", "set_key").join(per_set, "set_key", "left")
    if repeated_ids:
        # a row without shingles belongs where its document's other rows do
        per_doc = out.where("doc_id is not null and least is not null").groupBy(F.col("doc_id").alias("d")).agg(F.min("least").alias("doc_least"))
        out = out.join(per_doc, F.col("doc_id") == F.col("d"), "left").withColumn("least", F.coalesce("least", "doc_least"))
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_shared.read(spark, sf_dir, "documents"))


OP5_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2)::BIGINT)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
pair AS (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS n_both FROM s p JOIN s q ON p.x = q.x AND p.doc_id < q.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n AS m ON m.doc_id = a JOIN n AS k ON k.doc_id = b WHERE 100 * n_both >= 75 * (m.n + k.n - n_both)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a),
least_of AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m, d.doc_id)) AS component_id, least(d.doc_id, coalesce(m, d.doc_id)) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN least_of USING (doc_id)
"""
