"""Each training-data operator against brute force, on tables with odd rows."""

import hashlib
import io
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import SMALL

from helixframe.llm import decontaminate, exact_substrings, fingerprints, language_model, line_dedup, mixing, near_dedup, quality, token_output, warc
from helixframe.llm import queries as q

LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(x):
    return SPLIT.findall((x or "").translate(LOW))


def odd_docs(spark, extra=()):
    rng = np.random.default_rng(4)
    long = " ".join(rng.choice(WORDS, 3000)) + "\n" + "x" * 500
    base = " ".join(rng.choice(WORDS, 80))
    near = base.replace("alpha", "ALPHA", 1) + " tail"
    rows = [None, "", " \n\t", "one", "One", long, base, base, near, "a\0b c", "<|endoftext|> x  y\n\nz", "漢字 かな　テスト", base[:230] + " other " + base[300:], *extra]
    df = spark.createDataFrame([(i, x, "s" if i % 3 else None, 7, i) for i, x in enumerate(rows)], "doc_id long, text string, source string, label int, key long")
    return df.repartition(3), rows


def thue_morse(n=11):
    """Texts that a polynomial hash of bytes, or of words, takes for one another."""
    t = [0]
    for _ in range(n):
        t += [1 - x for x in t]
    return ["".join("ab"[x] for x in t), "".join("ba"[x] for x in t), " ".join("ab"[x] for x in t), " ".join("ba"[x] for x in t)]


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string")


def by_id(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


# ------------------------------------------------------------------- quality


def test_forward_backward_sums_over_all_labellings():
    rng = np.random.default_rng(0)
    u, a = rng.normal(size=5), rng.normal(size=(2, 2))
    good, pairs, z = quality.forward_backward(u, np.array([0, 3, 3, 5]), a)
    total, want = 0.0, np.zeros(5)
    for lo, hi in ((0, 3), (3, 5)):
        n = hi - lo
        weight = {}
        for code in range(2**n):
            y = [code >> k & 1 for k in range(n)]
            weight[tuple(y)] = math.exp(sum(u[lo + k] * y[k] for k in range(n)) + sum(a[y[k - 1], y[k]] for k in range(1, n)))
        s = sum(weight.values())
        total += math.log(s)
        for k in range(n):
            want[lo + k] = sum(w for y, w in weight.items() if y[k]) / s
    assert np.allclose(good, want) and math.isclose(z, total) and math.isclose(pairs.sum(), 3)


def test_quality_held_out(spark):
    rows = by_id(q.op1_quality(spark, SMALL))
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    held = [d for d in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert all(rows[d]["held_out"] for d in held)
    assert np.mean([rows[d]["predicted"] == labels[d] for d in held]) > 0.9


def test_quality_odd_rows(spark):
    docs, raw = odd_docs(spark)
    labels = spark.createDataFrame([(5, 1), (6, 0), (6, None), (99, 1)], "doc_id long, quality int")
    s = quality.score(docs, quality.fit(docs, labels)).collect()
    assert len(s) == len(raw) and all(0 <= r["score"] <= 1 for r in s)
    assert quality.score(empty(spark), quality.Crf()).count() == 0
    assert quality.fit(docs, labels.where("false")).share == 0.5


# ---------------------------------------------------------------- line dedup


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_lines(docs):
    """Lines equal to an earlier one, or within a tenth of the words of one (one edit from 5 words)."""
    first, out = {}, {}
    for i, x in sorted(docs):
        for k, line in enumerate((x or "").split("\n")):
            w = tuple(SPLIT.findall(line))
            if not w:
                continue
            if w in first:
                out.setdefault(i, ([], []))[0].append(k)
                continue
            for v in first:
                bound = 0 if max(len(v), len(w)) < 5 else max(1, max(len(v), len(w)) // 10)
                if abs(len(v) - len(w)) <= bound and (Counter(w) - Counter(v)).total() <= bound and edits(v, w) <= bound:
                    out.setdefault(i, ([], []))[1].append(k)
                    break
            first[w] = True
    return {i: (len(a), len(b), ",".join(map(str, sorted(a + b)))) for i, (a, b) in out.items()}


def lines_found(rows):
    return {r["doc_id"]: (r["n_equal"], r["n_near"], r["dropped"]) for r in rows if r["dropped"]}


def test_line_dedup(spark, tmp_path):
    rng = np.random.default_rng(11)
    line = " ".join(WORDS[:9])
    extra = [line, line.replace("beta", "BETA"), line + " more\n" + line + " more and more", "short line\nshort line\nshort lines", line.replace("alpha ", "")]
    extra += ["a b c d\na b c x\na b c d e\nb c d e f\nb c d e\nb c d e g h", "p q r s t u v\np q r s t u v w"]
    for n in (5, 7, 18, 19, 20, 29, 30, 51, 88, 140):
        # few different words, so that triples repeat
        line = list(rng.choice(WORDS[:9], n))
        for cut in range(0, n // 10 + 3):
            x = list(line)
            for _ in range(cut):
                at, what = int(rng.integers(len(x))), rng.integers(3)
                x[at : at + int(what != 0)] = [] if what == 1 else ["new" + str(rng.integers(99))]
            extra.append(" ".join(x) + "\n" + "  ".join(line))
    extra += thue_morse()
    docs, raw = odd_docs(spark, extra)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want = brute_lines(enumerate(raw))
    assert sum(x[1] for x in want.values()) >= 10
    assert lines_found(q.op2_line_dedup(spark, str(tmp_path)).collect()) == want
    # the same by relays, as many packs exchange their keys
    rows = line_dedup.dropped_lines(docs.repartition(7), pack_bytes=500, most=2, bits=1).collect()
    assert {r["doc"]: (len(r["equal"]), len(r["near"])) for r in rows if r["equal"] or r["near"]} == {i: x[:2] for i, x in want.items()}
    clean = line_dedup.without_lines(docs)
    assert clean.columns == docs.columns
    gone = {i: set(x[2].split(",")) for i, x in want.items()}
    kept = by_id(clean)
    assert all(kept[i]["text"] == (None if x is None else "\n".join(y for k, y in enumerate(x.split("\n")) if str(k) not in gone.get(i, ()))) for i, x in enumerate(raw))


def test_line_dedup_on_the_small_table(spark):
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = q.op2_line_dedup(spark, SMALL).collect()
    assert len(rows) == len(texts)
    assert lines_found(rows) == brute_lines(texts)


def test_line_dedup_repeated_ids(spark):
    a, b = " ".join(WORDS[:9]), " ".join(WORDS[9:18])
    rows = [(0, a), (1, b), (1, a.rsplit(" ", 1)[0] + " X"), (None, b + " y"), (2, a), (2, a)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((-1 if r["doc"] is None else r["doc"], len(r["equal"]), len(r["near"])) for r in line_dedup.dropped_lines(docs).collect())
    # the line of row b is near that of the null id; the altered one near that of row 0
    assert got == [(-1, 0, 0), (0, 0, 0), (1, 0, 1), (1, 0, 1), (2, 1, 0), (2, 1, 0)]
    assert line_dedup.dropped_lines(empty(spark)).count() == 0


def test_line_dedup_in_hot_groups(spark):
    """Copies of a line with a word of their own each share a key; pairs of them grow in proportion, and none is lost."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(7)
    short, long = list(rng.choice(WORDS, 12)), list(rng.choice(WORDS, 70)) + [f"w{k}" for k in range(30)]

    def lines_of(g):
        out = [" ".join([*short[:6], f"x{i}", *short[7:]]) for i in range(g)]  # near each other at one word
        for i in range(g // 2):  # a hot passage between words of their own; some are near an earlier one
            x = [f"y{i if i % 5 else i - i % 10}.{k}" for k in range(40)]
            x[int(rng.integers(40))] = f"z{i}"
            out.append(" ".join(x + long[70:90]))
        for i in range(g // 2):  # copies of a long line with 12 words changed each: more than a tenth between them
            x = list(long)
            for at in rng.choice(100, 12, replace=False):
                x[at] = f"v{i}.{at}"
            out.append(" ".join(x))
        return out

    made = {}
    for g in (40, 160):
        raw = lines_of(g)
        docs = spark.createDataFrame(list(enumerate(raw)), "doc_id long, text string")
        got = sorted(r["doc"] for r in line_dedup.dropped_lines(docs).collect() if r["near"])
        assert got == sorted(i for i, x in brute_lines(enumerate(raw)).items() if x[1])
        cand = line_dedup.candidates(line_dedup.line_packs(docs))
        keys = cand.select("id", "doc", "rk", "line", "n", "p0", "p1", F.explode(F.arrays_zip("keys", "places")).alias("k"))
        made[g] = line_dedup.likely_pairs(keys.select("*", F.col("k.keys").alias("key"), F.col("k.places").alias("place"))).count()
    assert made[160] < 6 * made[40]


def test_hashes_do_not_depend_on_blocks():
    from helixframe.llm import _text

    rng = np.random.default_rng(6)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    size = rng.choice([0, 1, 8, 9, 40, 512, 513], 2 * _text.BLOCK + 7)
    start = rng.integers(0, 4000, len(size))
    whole = _text.range_digest(data, start, start + size)
    grams = _text.combine(whole[0], 6)
    assert len(grams) == len(size) - 5
    for i in (0, _text.BLOCK - 3, 2 * _text.BLOCK - 3):
        part = _text.range_digest(data, start[i : i + 9], (start + size)[i : i + 9])
        assert all((x[i : i + 9] == y).all() for x, y in zip(whole, part, strict=True))
        assert (grams[i : i + 4] == _text.combine(whole[0][i : i + 9], 6)).all()


def test_lines_within_the_bound_share_a_key():
    """Edits spread evenly over a line, which leave the shortest runs, at lengths where grams and windows change."""
    rng = np.random.default_rng(9)
    for n in [*range(18, 44), *range(76, 96), 120, 205]:
        for _ in range(6):
            a = [f"w{rng.integers(1 << 40)}" for _ in range(n)]
            b, k = list(a), max(1, n // 10)
            # an inserted word may raise the bound no more: the longer line is a
            for at in np.linspace(0, n, k + 2).astype(int)[-2:0:-1]:
                b[at : at + 1] = [] if rng.integers(2) else [f"x{rng.integers(1 << 40)}"]
            rows = [" ".join(x).encode() for x in (a, b)]
            _, _, row, _, key = line_dedup.line_keys(np.frombuffer(b"".join(rows), np.uint8), np.cumsum([0, *map(len, rows)]))
            assert set(key[row == 0].tolist()) & set(key[row == 1].tolist()), n


def test_long_lines_that_share_five_words_are_no_candidates(spark):
    rng = np.random.default_rng(4)
    raw = []
    for i in range(40):  # pairs of lines of 60 words with the same five words in a row
        both = [f"both{i}.{k}" for k in range(5)]
        for side in "ab":
            x = [f"{side}{i}.{k}" for k in range(55)]
            at = int(rng.integers(5, 50))
            raw.append(" ".join([*x[:at], *both, *x[at:]]))
    docs = spark.createDataFrame(list(enumerate(raw * 2)), "doc_id long, text string")  # copies in other packs are no other lines
    assert line_dedup.candidates(line_dedup.line_packs(docs.repartition(5), pack_bytes=3000)).count() == 0
    # with ten words in common each line is one
    docs = spark.createDataFrame(list(enumerate(x + " " + " ".join(f"more{i // 2}.{k}" for k in range(10)) for i, x in enumerate(raw))), "doc_id long, text string")
    assert line_dedup.candidates(line_dedup.line_packs(docs.repartition(5), pack_bytes=3000)).count() == 80


def test_line_dedup_of_repeated_rows_in_several_packs(spark):
    a, b = " ".join(WORDS[:9]), " ".join(WORDS[9:18])
    near, text = a.rsplit(" ", 1)[0] + " X", a + "\n" + b
    rows = [(5, text)] * 6 + [(7, b)] * 4 + [(3, near)] * 3 + [(None, "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    for dealt in ({}, {"most": 2, "bits": 1}):
        got = Counter((r["doc"], r["n_lines"], tuple(r["equal"]), tuple(r["near"])) for r in line_dedup.dropped_lines(docs, pack_bytes=60, **dealt).collect())
        # all rows of one kind alike: line 0 of 5 is near that of 3, line 1 is its own; that of 7 equals it
        assert got == {(5, 2, (), (0,)): 6, (7, 1, (0,), ()): 4, (3, 1, (), ()): 3, (None, 1, (), ()): 2}


def test_keys_with_more_likely_lines_than_are_named(spark):
    """Rows of a key go on as a whole only if a line has more likely lines than a row names."""
    from pyspark.sql import functions as F

    def likely(g):
        docs = spark.createDataFrame([(i, " ".join([*WORDS[:6], f"x{i}", *WORDS[7:12]])) for i in range(g)], "doc_id long, text string")
        cand = line_dedup.candidates(line_dedup.line_packs(docs))
        keys = cand.select("*", F.explode(F.arrays_zip("keys", "places")).alias("k")).select("*", F.col("k.keys").alias("key"), F.col("k.places").alias("place"))
        return line_dedup.likely_pairs(keys).collect()

    few, many = likely(line_dedup.NAMED + 1), likely(30)
    assert [len(r["bs"]) for r in sorted(few, key=lambda r: len(r["bs"]))] == list(range(1, line_dedup.NAMED + 1))
    assert not any(r["open"] or r["pos"] is not None for r in few)
    assert sorted(r["pos"] for r in many) == list(range(30))
    assert [r["open"] for r in sorted(many, key=lambda r: r["pos"])] == [k > line_dedup.NAMED for k in range(30)]


def test_word_counts_allow_what_edits_do():
    rng = np.random.default_rng(5)
    for n in (20, 90, 1500):
        wh = rng.integers(0, 1 << 63, 40).astype(np.uint64)
        rows = [rng.integers(0, 40, n)]
        for _ in range(6):  # as many edits as the bound has, words that repeat
            x = rows[0].tolist()
            for _ in range(n // 10):
                at, what = int(rng.integers(len(x) - 1)), rng.integers(3)
                x[at : at + int(what != 0)] = [] if what == 1 else [0]
            rows.append(np.array(x))
        ptr = np.concatenate([[0], np.cumsum([len(x) for x in rows])])
        flat = wh[np.concatenate(rows)]
        counts = line_dedup.word_counts(flat, ptr[:-1], ptr[1:], line_dedup.BUCKETS)
        zero = np.zeros(7, np.int64)
        parity = np.packbits(counts & 1, axis=1).view(np.int64).T
        g = line_dedup.Groups(zero, np.diff(ptr), zero - 1, *[p.copy() for p in parity])
        # every row with the first one
        asked = np.array([False] + [True] * 6)
        a, b = g.all(asked, counts)
        assert set(a[b == 0].tolist()) == {k for k in range(1, 7) if abs(len(rows[k]) - n) <= max(n, len(rows[k])) // 10}


def test_within_edits():
    rng = np.random.default_rng(3)
    for _ in range(400):
        a, b = (list(rng.choice([b"x", b"y", b"z"], rng.integers(0, 9))) for _ in range(2))
        d = edits(a, b)
        assert [line_dedup.within_edits(a, b, k) for k in range(10)] == [d <= k for k in range(10)]


# ---------------------------------------------------------------------- WARC


def test_archive_round_trip(spark, tmp_path):
    body = "<p>" + "é" * 60 + "\r\n\r\n</p>"
    pages = spark.createDataFrame([(3, "u3", body, 1), (1, "u1", body, 1), (2, None, None, 1), (4, "u4", "", 1), (5, "u5", "short", 1), (6, "u6", "short", 1), (7, "a\r\nb", "y" * 200, 1)], "page_id long, url string, html string, digest int")
    warc.write_archive(pages, str(tmp_path / "w"))
    got = by_id(warc.read_archive(spark, str(tmp_path / "w"), with_record=True), "page_id")
    assert [(got[k]["record_type"], got[k]["refers_to"]) for k in range(1, 8)] == [("response", None), ("response", None), ("revisit", 1), *[("response", None)] * 4]
    assert got[3]["payload_digest"] == hashlib.sha256(body.encode()).hexdigest() and got[3]["payload_bytes"] == len(body.encode())
    assert spark.read.parquet(str(tmp_path / "w" / "payloads")).count() == 4
    warc.export_records(spark, str(tmp_path / "w"), str(tmp_path / "files"))
    back = warc.read_records(spark, str(tmp_path / "files")).collect()
    assert sorted(bytes(r["header"]) + bytes(r["payload"]) + b"\r\n\r\n" for r in back) == sorted(bytes(r["record"]) for r in got.values())
    warc.write_archive(pages.where("false"), str(tmp_path / "e"))
    assert warc.read_archive(spark, str(tmp_path / "e")).count() == 0


def test_archive_query_reads_rebuilt_records(spark, tmp_path, monkeypatch):
    pages = spark.createDataFrame([(1, "u", "x" * 200), (2, "v", "x" * 200), (3, "wé漢", "é\r\n\r\né"), (4, "y", ""), (5, "z", None)], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = by_id(q.op3_warc(spark, str(tmp_path)), "page_id")
    assert [(got[k]["record_type"], got[k]["payload_bytes"], got[k]["content_length"]) for k in range(1, 6)] == [("response", 200, 200), ("revisit", 200, 0), ("response", 8, 8), ("response", 0, 0), ("response", 0, 0)]
    assert got[3]["payload_digest"] == hashlib.sha256("é\r\n\r\né".encode()).hexdigest() and got[2]["refers_to"] == 1
    # a record that lost a byte is found out
    real = warc.read_archive
    short = lambda *a, **k: real(*a, **k).withColumn("record", warc.F.expr("substring(record, 1, octet_length(record) - 1)"))
    monkeypatch.setattr(warc, "read_archive", short)
    with pytest.raises(Exception, match="unlike its header"):
        q.op3_warc(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{SMALL}/{t}.parquet'")
    want = con.sql(q.ORACLE_SQL[name])
    got = q.QUERIES[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda rows: sorted(map(str, rows))
    assert key(tuple(r) for r in got.select(*want.columns).collect()) == key(want.fetchall())


# ------------------------------------------------------------ language model


def test_language_model(spark):
    docs, raw = odd_docs(spark, [" ".join(WORDS[k : k + 12]) for k in range(8)] * 3)
    got = by_id(language_model.score_documents(docs))
    toks = [[*words(x), None] for x in raw]
    held = [zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(raw))]
    c = Counter(w for t, h in zip(toks, held, strict=True) if not h for w in t)
    n, v = sum(c.values()), len(c)
    for i, t in enumerate(toks):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (len(t), sum(c[w] > 0 for w in t), n, held[i])
        assert math.isclose(r["base_score"], sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r["score"] <= 0
    # the same whatever the packs, partitions and relays
    again = by_id(language_model.score_documents(docs.repartition(6), pack_bytes=4000, most=2, bits=1))
    assert all(math.isclose(again[i]["score"], got[i]["score"], rel_tol=1e-9) for i in got)
    assert language_model.score_documents(empty(spark)).count() == 0


def test_language_model_beats_base_on_held_out(spark):
    rows = [r for r in q.op4_language_model(spark, SMALL).collect() if r["held_out"]]
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_language_model_uses_two_word_contexts(spark):
    # "b" is followed by "c" after "a" and by "e" after "d": one word of context cannot tell
    docs = spark.createDataFrame([(i, "a b c" if i % 2 else "d b e") for i in range(200)] + [(200 + i, x) for i, x in enumerate(["a b c", "a b e"] * 30)], "doc_id long, text string")
    got = [r for r in language_model.score_documents(docs).collect() if r["held_out"]]
    texts = dict(docs.collect())
    right, wrong = ([r["score"] for r in got if texts[r["doc_id"]] == x] for x in ("a b c", "a b e"))
    assert min(right) > max(wrong) + 0.5


def test_language_model_keeps_bigram_where_two_words_are_unseen():
    p = np.array([[0.01, 0.1, 0.9, 0.0], [0.01, 0.1, 0.0, 0.0]])
    cells = np.array([language_model.SPAN + 3, 0])
    w, _ = language_model.em(cells, np.array([100.0, 10.0]), p, np.unique(cells))
    assert w[language_model.SPAN + 3, 2] > 0.5 and w[language_model.SPAN + 3, 3] == 0
    assert (w[0, 2:] == 0).all() and np.allclose(w.sum(axis=1), 1)


# ------------------------------------------------------------ near duplicates


def brute_near(docs):
    sets = {}
    for i, x in docs:
        w = words(x)
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_near_dedup(spark):
    rng = np.random.default_rng(7)
    base = list(rng.choice(WORDS, 60))
    family = []
    for _ in range(40):
        w = base.copy()
        for k in rng.integers(0, 60, rng.integers(0, 4)):
            w[k] = str(rng.integers(1000))
        family.append(" ".join(w))
    docs, raw = odd_docs(spark, family)
    for block in (4096, 5):
        got = by_id(near_dedup.near_duplicates(docs, block=block))
        want = brute_near(enumerate(raw))
        assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
        assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got.values())
    assert near_dedup.near_duplicates(empty(spark)).count() == 0
    rows = near_dedup.near_duplicates(docs.unionByName(docs).where("doc_id is null or doc_id < 9")).collect()
    assert len(rows) == 18


def test_near_dedup_repeated_ids_and_whole_table(spark):
    a, b = ([f"{x}{k}" for k in range(18)] for x in "ab")
    rows = [(1, " ".join(a)), (1, " ".join(b)), (1, None), (2, " ".join([*a, "z"])), (3, " ".join([*b, "z"])), (None, "x y"), (4, None)]
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"], r["kept"]) for r in got) == [(0, None, True), (1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True)]
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute_near([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in q.op5_near_dedup(spark, SMALL).collect()} == want


def test_joining_links_are_fewer_than_members(spark):
    rng = np.random.default_rng(11)
    fresh = lambda n: rng.integers(0, 2**63, n, dtype=np.uint64)
    base = fresh(200)
    sets = [np.unique(np.concatenate([rng.choice(base, 186, replace=False), fresh(14)])) for _ in range(60)]
    starts = np.cumsum([0, *map(len, sets[:-1])])
    coarse, fine = (near_dedup.odd_sketch(near_dedup.minhashes(np.concatenate(sets), starts, n), bits) for n, bits in ((near_dedup.SAMPLES, near_dedup.BITS), (near_dedup.FINE_SAMPLES, near_dedup.FINE_BITS)))
    rows = [(1, i, i, len(x), bytearray(coarse[i].tobytes()), bytearray(fine[i].tobytes()), bytearray(x.tobytes())) for i, x in enumerate(sets)]
    members = spark.createDataFrame(rows, "key long, id long, component long, size long, sketch binary, fine binary, shingles binary")

    def joined(links):
        label = list(range(len(sets)))
        for a, b in links:
            label = [label[a] if v == label[b] else v for v in label]
        return {frozenset(i for i, v in enumerate(label) if v == w) for w in label}

    def linked(a, b):
        both = len(np.intersect1d(sets[a], sets[b]))
        return 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both)

    all_links = [(a, b) for a in range(60) for b in range(a + 1, 60) if linked(a, b)]
    assert len(all_links) > 200
    most, most_fine = near_dedup.sketch_distance(0.61), near_dedup.sketch_distance(0.70, near_dedup.FINE_SAMPLES, near_dedup.FINE_BITS)
    for block in (4096, 16):
        got = [(r["a"], r["b"]) for r in near_dedup._joining_links(members, 75, most, most_fine, block).collect()]
        assert all(linked(a, b) for a, b in got) and joined(got) == joined(all_links)
        assert block == 16 or len(got) < len(sets)


def test_odd_sketch_estimates():
    rng = np.random.default_rng(2)
    both = rng.integers(0, 2**63, 800, dtype=np.uint64)
    a, b = (np.concatenate([both, rng.integers(0, 2**63, 100, dtype=np.uint64)]) for _ in range(2))
    sk = near_dedup.odd_sketch(near_dedup.minhashes(np.concatenate([a, b]), np.array([0, 900]), 2048), 8192)
    d = int(np.bitwise_count(sk[0] ^ sk[1]).sum())
    j = 1 + 8192 / (4 * 2048) * math.log(1 - 2 * d / 8192)
    assert abs(j - 0.8) < 0.05


# -------------------------------------------------------------------- mixing


def brute_targets(docs):
    """doc_id -> (size, size of its source, target of its source)."""
    size, per = {}, Counter()
    for i, x, source in docs:
        size[i] = len(SPLIT.findall(x or ""))
        per[source] += size[i]
    order = sorted(per, key=lambda v: (v is None, v or ""))
    weight = {v: (3, 1, 2)[k % 3] for k, v in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(per.values()), set(order)
    while open_:
        level = left / sum(weight[v] for v in open_)
        full = {v for v in open_ if level * weight[v] > 2 * per[v]}
        for v in full or open_:
            target[v] = 2.0 * per[v] if full else level * weight[v]
            left -= target[v]
        open_ -= full or open_
    return {i: (size[i], per[source], target[source]) for i, _, source in docs}


def test_mixing_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    want = brute_targets([(r["doc_id"], r["text"], r["source"]) for r in docs.collect()])
    source = {r["doc_id"]: r["source"] for r in docs.collect()}
    rows = by_id(q.op6_mixing(spark, SMALL))
    assert rows.keys() == want.keys()
    taken = Counter()
    for i, r in rows.items():
        assert (r["size"], r["source_size"]) == want[i][:2] and math.isclose(r["target"], want[i][2]) and r["taken"] <= 2 * r["size"]
        taken[source[i]] += r["taken"]
    assert all(abs(taken[source[i]] - w[2]) <= 1 for i, w in want.items())
    assert {i: r["taken"] for i, r in by_id(q.op6_mixing(spark, SMALL)).items()} == {i: r["taken"] for i, r in rows.items()}


@pytest.mark.parametrize("max_decks", [4096, 1])
def test_mixing(spark, max_decks):
    docs, raw = odd_docs(spark, [" ".join(WORDS) * 40 for _ in range(12)])
    how = dict(block_words=50, shard_blocks=30, max_decks=max_decks)
    shards, sizes, per = mixing.mix(docs, **how)
    t = {r["sk"]: r for r in per.collect()}
    total = sum(len(words(x)) for x in raw)
    assert math.isclose(sum(r["target"] for r in t.values()), 1.5 * total)
    size = {r["doc_id"]: (r["sk"], r["size"]) for r in sizes.collect()}
    rows = shards.collect()
    taken, by_source, number, mixed = Counter(), Counter(), Counter(), {}
    for r in rows:
        taken[r["doc_id"]] += r["words"]
        by_source[size[r["doc_id"]][0]] += r["words"]
        number[r["shard"]] += 1
        mixed.setdefault(r["shard"], []).append(r["ord_in_shard"])
    assert all(taken[d] <= 2 * n for d, (_, n) in size.items())
    assert all(abs(by_source[k] - r["target"]) <= 1 for k, r in t.items())
    assert max(number.values()) - min(number.values()) <= 1 and len(number) == -(-len(rows) // 30) > 3
    assert all(x == sorted(x) for x in mixed.values())
    again = mixing.mix(docs.repartition(2), **how)[0].collect()
    assert sorted(map(tuple, again)) == sorted(map(tuple, rows))
    text = mixing.take_text(docs, shards, 50)
    assert text.columns == docs.columns
    got = Counter()
    for r in text.collect():
        got[r["doc_id"]] += len(words(r["text"]))
    assert got == Counter({d: n for d, n in taken.items() if n})
    assert mixing.mix(empty(spark))[0].count() == 0


def test_mixing_repeated_rows(spark):
    x = " ".join(WORDS * 5)
    docs = spark.createDataFrame([(1, x, "a"), (1, x, "a"), (1, x, "b"), (None, x, None), (None, x, None), (2, None, "b")], "doc_id long, text string, source string")
    shards, sizes, per = mixing.mix(docs, block_words=30)
    assert sizes.count() == 6 and shards.agg({"words": "sum"}).first()[0] == round(sum(r["target"] for r in per.collect()))
    rows = mixing.take_text(docs, shards, 30).collect()
    assert sum(len(words(r["text"])) for r in rows) == shards.agg({"words": "sum"}).first()[0]


def test_split_tree_and_large_draws():
    counts = np.array([1000, 10, 0, 390])
    tree = mixing.SplitTree(counts, 7, 3)
    deck = np.repeat(np.arange(4), counts)
    place = np.concatenate([np.arange(n) for n in counts])
    shard = tree.assign(deck, place)
    assert sorted(np.bincount(shard).tolist()) == [200] * 7
    # a shard has a run of each deck, and its share of it within the law's spread
    for d in (0, 3):
        assert (np.diff(shard[deck == d]) >= 0).all()
        n = np.bincount(shard[deck == d], minlength=7)
        assert abs(n - counts[d] / 7).max() < 40
    rng = np.random.default_rng(1)
    big = np.array([mixing.hypergeometric(rng, 3 * 10**9, 10**9, 10**6) for _ in range(60)])
    sd = (10**6 * 0.75 * 0.25) ** 0.5
    assert abs(big.mean() - 750_000) < 5 * sd / 60**0.5 and 0.6 * sd < big.std() < 1.5 * sd
    assert mixing.hypergeometric(rng, 2 * 10**9, 0, 5) == 5 and mixing.hypergeometric(rng, 0, 2 * 10**9, 5) == 0


# ------------------------------------------------------------ decontamination


def brute_hits(docs, items, n=13):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    split = lambda x: pat.findall((x or "").translate(LOW))
    out = {}
    for i, x in docs:
        w, hit, found = split(x), set(), set()
        for key, y in items:
            v = split(y)
            m = min(n, len(v))
            wins = {tuple(v[k : k + m]) for k in range(len(v) - m + 1)} if m else set()
            for k in range(len(w) - m + 1):
                if m and tuple(w[k : k + m]) in wins:
                    hit |= set(range(k, k + m))
                    found.add(str(key))
        out[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("part", [32 << 20, 100])
def test_decontaminate(spark, part):
    docs, raw = odd_docs(spark, ["prefix " + " ".join(WORDS[:15]).upper() + " suffix", "eta-theta eta theta", " ".join(WORDS * 2)])
    items = [(1, " ".join(WORDS[:14])), (2, "eta theta"), (10, "Eta, THETA!"), (3, None), (4, "..."), (5, " ".join(WORDS[3:19])), (6, "漢字")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = by_id(decontaminate.report(decontaminate.find_benchmark(docs, bench, max_item_bytes=part)))
    want = brute_hits(enumerate(raw), items)
    assert {i: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for i, r in got.items()} == want
    spans = by_id(decontaminate.find_benchmark(docs, bench, max_item_bytes=part))[len(raw) - 3]["spans"]
    x = raw[len(raw) - 3].encode()
    assert b"ETA THETA" in x[spans[0]["start"] : spans[0]["end"]]
    assert decontaminate.find_benchmark(empty(spark), bench).count() == 0
    assert decontaminate.find_benchmark(docs, bench.where("false")).where("size(items) > 0").count() == 0


def test_fm_index_counts_and_places():
    rng = np.random.default_rng(1)
    t = np.concatenate([rng.integers(1, 5, 500), [0]])
    fm = decontaminate.FMIndex(t, 5)
    for m in (1, 3, 6):
        pats = rng.integers(1, 5, (40, m))
        lo, hi = fm.search(pats.reshape(-1), np.arange(40) * m, m)
        for p, a, b in zip(pats, lo, hi, strict=True):
            want = [i for i in range(len(t) - m + 1) if (t[i : i + m] == p).all()]
            assert sorted(fm.locate(np.arange(a, b)).tolist()) == want


# -------------------------------------------------------------- fingerprints


def test_fingerprints(spark, tmp_path):
    docs, raw = odd_docs(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = by_id(q.op8_fingerprints(spark, str(tmp_path)))
    for i, x in enumerate(raw):
        x, nxt = x or "", raw[(i + 1) % len(raw)] or ""
        k = len(x) // 4
        edited = x[: len(x) - k] + nxt[:k]
        assert (got[i]["n_chars"], got[i]["edited_sha256"]) == (len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i]["near_edited"] <= 1 and 0 <= got[i]["near_next"] <= 1
    assert got[6]["fingerprint"] == got[7]["fingerprint"] and got[6]["near_next"] == 1.0 and got[0]["near_next"] == 1.0
    assert got[5]["near_edited"] > 0.4
    # texts without a hash below the threshold are told apart by their tag
    assert got[3]["fingerprint"] != got[4]["fingerprint"]


def brute_sketch(x, fraction=1 / 4):
    import struct

    import xxhash

    signed = lambda v: v - 2**64 if v >= 2**63 else v
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in SPLIT.findall(x)]
    runs = [words[k : k + 5] for k in range(len(words) - 4)] or ([words] if words else [])
    out, every = set(), set()
    for r in runs:
        h = 42
        for w in r:
            h = xxhash.xxh64_intdigest(struct.pack("<Q", w), h)
        every.add(h & (2**63 - 1))
    out = sorted(h for h in every if h < int(fraction * 2**63))
    return f"{signed(xxhash.xxh64_intdigest(x.encode(), 42)) % 2**64:x}:" + ",".join(f"{h:x}" for h in out), set(out), every


def test_fingerprint_query(spark):
    """Sketches and likeness against plain sets, and the estimates against exact likeness."""
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    ids, errors = sorted(texts), []
    for k, r in enumerate(sorted(q.op8_fingerprints(spark, SMALL).collect(), key=lambda r: r["doc_id"])):
        x, nxt = texts[ids[k]], texts[ids[(k + 1) % len(ids)]]
        cut = len(x) // 4
        edited = x[: len(x) - cut] + nxt[:cut]
        (fp, a, all_a), (fe, b, all_b), (_, c, _) = (brute_sketch(y) for y in (x, edited, nxt))
        assert (r["doc_id"], r["n_chars"], r["edited_sha256"]) == (ids[k], len(x), hashlib.sha256(edited.encode()).hexdigest())
        assert (r["fingerprint"].lstrip("0") or "0", r["edited_fingerprint"].lstrip("0")) == (fp, fe)
        for got, s, t, same in ((r["near_edited"], a, b, x == edited), (r["near_next"], a, c, x == nxt)):
            assert math.isclose(got, len(s & t) / len(s | t) if s | t else float(same))
        if len(all_a) > 200:
            errors.append(abs(r["near_edited"] - len(all_a & all_b) / len(all_a | all_b)))
    assert np.mean(errors) < 0.05


@pytest.mark.parametrize("n", [0, 1, 2, 3, 26, 27, 200])
def test_bucket_levels(spark, monkeypatch, n):
    monkeypatch.setattr(fingerprints, "FAN", 3)
    cuts = [5 * k for k in range(n)]
    got = spark.range(-3, 5 * n + 3).withColumnRenamed("id", "doc_id").withColumn("at", fingerprints._bucket(cuts)).collect()
    assert all(r["at"] == sum(c <= r["doc_id"] for c in cuts) for r in got)


def test_fingerprint_next_across_ranges(spark):
    docs = spark.createDataFrame([(i * 7 % 101, f"text {i * 7 % 101} " * 30) for i in range(101)], "doc_id long, text string")
    rows, order = fingerprints.with_next(docs, bucket_bytes=2000)
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r["n"] for r in rows.withColumn("n", F.lead("text").over(order)).where("flag = 0").collect()}
    assert len(got) == 101 and all(got[i].startswith(f"text {(i + 1) % 101} ") for i in range(101))
    fp = fingerprints.fingerprint(docs.limit(2), "text", "fp")
    assert fp.select(fingerprints.merge("fp", "fp").alias("m"), "fp").where("m = fp").count() == 2


# -------------------------------------------------------------- token output


def test_token_output(spark, tmp_path):
    from tokenizers import Tokenizer

    docs, raw = odd_docs(spark, ["a'll b's\n\nc", " lead", "x." * 50])
    tok = Tokenizer.from_file(token_output.default_tokenizer())
    out = f"file://{tmp_path}/t"
    rows = by_id(token_output.decode_files(spark, out, token_output.encode_documents(docs, out, token_output.default_tokenizer(), shard_bytes=2000), with_ids=True))
    start = 0
    for i, x in enumerate(raw):
        ids = [*tok.encode(x or "", add_special_tokens=False).ids, 2]
        assert (rows[i]["start"], rows[i]["n_tokens"], rows[i]["ids"]) == (start, len(ids), ids)
        assert rows[i]["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    e = f"file://{tmp_path}/e"
    assert token_output.decode_files(spark, e, token_output.encode_documents(empty(spark), e, token_output.default_tokenizer())).count() == 0


def test_new_pieces_go_to_the_tokenizer_in_runs():
    from tokenizers import Tokenizer

    rng = np.random.default_rng(9)
    ends = ["", " ", "  ", "\n", "\n\n", ".", "7", "7,", "),", "é", "\u3000", "\t", "'ll", "...", "\r\n", "-"]
    texts = ["".join(f"{a}x{rng.integers(10**6)}{b}" for a, b in zip(rng.choice([" ", "\n", ",", "é", "("], 40), rng.choice(ends, 40), strict=True)) for _ in range(300)]
    raw = [x.encode() for x in texts]
    plain = Tokenizer.from_file(token_output.default_tokenizer())
    want = [[*plain.encode(x, add_special_tokens=False).ids, 2] for x in texts]
    tok, seen = token_output.PieceTokenizer(token_output.default_tokenizer()), []
    encode = tok._encode
    tok._encode = lambda x: seen.append(len(x)) or encode(x)
    ids, n = tok.encode(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in raw])]), 2)
    assert ids.tolist() == [i for x in want for i in x] and n.tolist() == [len(x) for x in want]
    # many pieces a text, where each was a text of its own
    words = b"".join(b" word%d" % k for k in range(50_000))
    seen.clear()
    tok.encode(np.frombuffer(words, np.uint8), np.array([0, len(words)]), 2)
    assert 0 < sum(seen) < 100


def test_equal_hashes_and_long_texts(spark, tmp_path):
    """Texts made to collide, and one beyond every piece that operators work on."""
    from tokenizers import Tokenizer

    rows = [*thue_morse(), (" ".join(WORDS) + " " + "zeta" * 160 + "\n") * 3300]
    tok = Tokenizer.from_file(token_output.default_tokenizer())
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    out = f"file://{tmp_path}/t"
    got = by_id(token_output.decode_files(spark, out, token_output.encode_documents(docs, out, token_output.default_tokenizer())))
    for i, x in enumerate(rows):
        ids = [*tok.encode(x, add_special_tokens=False).ids, 2]
        assert (got[i]["n_tokens"], got[i]["ids_crc32"]) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    scored = by_id(language_model.score_documents(docs))
    assert all(scored[i]["n_tokens"] == len(words(x)) + 1 for i, x in enumerate(rows))
    split = [words(x) for x in rows]
    want = {i: len({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}) for i, w in enumerate(split)}
    assert {i: r["n_shingles"] for i, r in by_id(near_dedup.near_duplicates(docs)).items()} == want
    spans = by_id(exact_substrings.repeated_spans(docs))
    assert [sum(z["end"] - z["start"] for z in spans[4]["spans"])] == [len(rows[4].encode())]


@pytest.mark.parametrize("n", [1, 1023, 1024, 5000])
def test_patched_blocks(n):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.03, rng.integers(0, 2**32, n), rng.integers(500, 900, n)).astype(np.uint32)
    buf = io.BytesIO()
    w = token_output.Writer(buf, {"shard": 3})
    w.add(ids[:1], [None], np.array([1]))
    w.add(ids[1:], [7], np.array([n - 1]))
    w.close()
    r = token_output.Reader(buf.getvalue())
    assert np.array_equal(r.ids(), ids) and r.doc_ids == [None, 7] and r.lens.tolist() == [1, n - 1] and r.meta["shard"] == 3
    assert np.array_equal(np.concatenate([x for _, _, x in r.documents(group=2)]), ids)
    assert n < 1024 or len(buf.getvalue()) < 2.2 * n + 400


# --------------------------------------------------------- exact substrings


def brute_spans(texts, length):
    data = [(x or "").encode() for x in texts]
    c = Counter(b[i : i + length] for b in data for i in range(len(b) - length + 1))
    out = []
    for b in data:
        f = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if c[b[i : i + length]] > 1:
                f[i] += 1
                f[i + length] -= 1
        gone = np.cumsum(f[:-1]) > 0
        edge = np.diff(np.concatenate([[0], gone.astype(int), [0]]))
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out.append((list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("length,how", [(200, {}), (40, {}), (200, {"hot": 1}), (40, {"hot": 5, "most": 1, "bits": 1})])
def test_exact_substrings(spark, length, how):
    rng = np.random.default_rng(5)
    base = "".join(rng.choice(list("abcdé \n"), 900))
    extra = [base[a : a + n] for a, n in rng.integers(1, 500, (30, 2)).tolist()] + ["ab" * n for n in (20, 150, 151)] + ["\0" * 250, "\0" * 250 + base[:220], base[:300] + "!" + base[300:]]
    other = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    common = other(150)  # one passage in ever new surroundings
    extra += [other(60 + k) + common + other(70) for k in range(20)] + [other(60) + common[:140] + other(20) for _ in range(5)] + thue_morse()
    docs, raw = odd_docs(spark, extra)
    got = by_id(exact_substrings.repeated_spans(docs.repartition(5), length, with_kept=True, **how))
    for i, (spans, sha) in enumerate(brute_spans(raw, length)):
        assert ([(s["start"], s["end"]) for s in got[i]["spans"]], got[i]["kept_sha256"]) == (spans, sha)
        assert hashlib.sha256(bytes(got[i]["kept"])).hexdigest() == sha
    assert exact_substrings.repeated_spans(empty(spark)).count() == 0


def test_exact_substrings_query(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = by_id(q.op10_exact_substrings(spark, SMALL))
    for (i, x), (spans, sha) in zip(texts.items(), brute_spans(texts.values(), 200), strict=True):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == (len((x or "").encode()), sum(b - a for a, b in spans), len(spans), sha)
