"""Sequence, quality and model-fit queries on documents (text as sequence or as quality characters)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import randomness as R
from ..functions import sequence as S
from ..operators import intervals, models
from ._registry import Registry

query = Registry()

SEQ = "seq AS (SELECT doc_id, lang, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS s FROM documents)"
#: positions of a sequence as rows
POS = """ch AS (SELECT doc_id, lang, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i FROM seq WHERE length(s) >= 3),
p AS (SELECT doc_id, lang, i, c, lead(c, 1) OVER w AS c1, lead(c, 2) OVER w AS c2 FROM ch WINDOW w AS (PARTITION BY doc_id ORDER BY i)), k AS (SELECT doc_id, lang, i, c || c1 || c2 AS kmer FROM p WHERE c2 IS NOT NULL)"""
QUAL = """q AS (SELECT doc_id, i, n, greatest(0, least(93, ascii(c) - 33)) AS q FROM (SELECT doc_id, length(t) AS n, unnest(string_split(t, '')) AS c, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '.', 'g') AS t FROM documents) WHERE length(t) > 0))"""


def seqs(t):
    return t.documents.select("doc_id", "lang", F.regexp_replace(F.upper("text"), "[^ACGTN]", "").alias("seq"))


def kmers(t):
    # the array is a column of its own: inside the lambda it would be split again for every k-mer
    return seqs(t).withColumn("b", S.bases("seq")).select("doc_id", "lang", F.posexplode(S.kmers("b")).alias("i", "kmer"))


def quals(t):
    """A whole text as one read's qualities."""
    return t.documents.select("doc_id", F.transform(S.bases(F.regexp_replace("text", "[^ -~]", ".")), lambda c: S.phred_score(c)).alias("quals"))


@query(f"WITH {SEQ} SELECT doc_id, md5(reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))) AS h FROM seq")
def revcomp(t):
    return seqs(t).select("doc_id", F.md5(S.reverse_complement("seq")).alias("h"))


@query("SELECT doc_id, md5(upper(a)) AS unmasked, md5(lower(a)) AS masked FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '.', 'g') AS a FROM documents)")
def mask_unmask(t):
    a = F.regexp_replace("text", "[^ -~]", ".")  # engines differ on the case of some letters beyond ASCII
    return t.documents.select("doc_id", F.md5(S.unmask(a)).alias("unmasked"), F.md5(S.mask(a)).alias("masked"))


@query(f"WITH {SEQ} SELECT doc_id, md5(translate(s, 'N', 'A')) AS h FROM seq")
def canonical_base(t):
    return seqs(t).select("doc_id", F.md5(S.canonical("seq")).alias("h"))


@query(f"WITH {SEQ} SELECT doc_id, substr(s, 11, 25) AS piece FROM seq")
def subseq(t):
    return seqs(t).select("doc_id", S.subsequence("seq", 11, 25).alias("piece"))


@query("SELECT doc_id, upper(substr(a, 1, length(a) // 2)) = upper(substr(a, length(a) // 2 + 1)) AS same FROM (SELECT doc_id, regexp_replace(text, '[^ -~]', '.', 'g') AS a FROM documents)")
def ci_equal(t):
    half = F.floor(F.length("a") / 2).cast("int")
    a = t.documents.select("doc_id", F.regexp_replace("text", "[^ -~]", ".").alias("a"))
    return a.select("doc_id", S.same_bases(F.substr("a", F.lit(1), half), F.substr("a", half + 1)).alias("same"))


@query(f"""WITH {SEQ}
SELECT doc_id, reverse(translate(s, 'ACGTacgt', 'TGCAtgca')) AS seq, reverse(translate(s, 'ACGTN', 'MIDSM')) AS cigar FROM seq""")
def reverse_record(t):
    r = seqs(t).select("doc_id", F.col("seq").alias("s"))
    r = r.withColumn("c", S.bases(F.translate("s", "ACGTN", "MIDSM"))).select("doc_id", S.reverse_record("s", "c", "c").alias("r"))
    return r.select("doc_id", "r.seq", F.array_join("r.cigar", "").alias("cigar"))


@query(f"WITH {SEQ}, a AS (SELECT doc_id, unnest(r) AS s, generate_subscripts(r, 1) - 1 AS k FROM (SELECT doc_id, regexp_extract_all(s, '.{{1,70}}') AS r FROM seq)) SELECT doc_id, k, substr(s, 1, 70) || substr(repeat('AGATCGGAAGAGC', 6), 1, greatest(0, 70 - length(s))) AS read FROM a")
def adapter_pad(t):
    a = seqs(t).select("doc_id", F.posexplode(F.regexp_extract_all("seq", F.lit(".{1,70}"), F.lit(0))).alias("k", "s"))
    return a.select("doc_id", F.col("k").cast("long").alias("k"), S.adapter_pad("s", F.lit("AGATCGGAAGAGC"), 70).alias("read"))


@query(f"WITH {SEQ} SELECT doc_id, length(s)::BIGINT AS n FROM seq")
def fasta_lengths(t):
    return seqs(t).select("doc_id", F.length("seq").cast("long").alias("n"))


@query(f"WITH {SEQ}, w AS (SELECT doc_id, regexp_replace(text, '[^ACGTacgt]', 'N', 'g') AS s FROM documents) SELECT doc_id, round((length(s) - length(replace(s, 'N', ''))) / length(s)::DOUBLE, 9) AS f FROM w WHERE length(s) > 0")
def n_fraction_window(t):
    w = t.documents.select("doc_id", F.regexp_replace("text", "[^ACGTacgt]", "N").alias("s")).where(F.length("s") > 0)
    return w.select("doc_id", F.round(S.n_fraction("s"), 9).alias("f"))


@query(f"WITH {SEQ}, {POS} SELECT kmer, count(*) AS n FROM k GROUP BY kmer")
def trinuc_opportunity(t):
    return kmers(t).groupBy("kmer").agg(F.count("*").alias("n"))


@query(f"WITH {SEQ}, {POS} SELECT kmer, count(*) FILTER ((doc_id + i) % 17 = 0)::BIGINT AS mutations, round(count(*) FILTER ((doc_id + i) % 17 = 0) / count(*)::DOUBLE, 9) AS mutability FROM k GROUP BY kmer")
def mutability(t):
    # kmer positions start at 0 here and at 1 in the statement
    k = kmers(t).groupBy("kmer").agg(F.count("*").alias("n"), F.sum(((F.col("doc_id") + F.col("i") + 1) % 17 == 0).cast("long")).alias("mutations"))
    return k.select("kmer", "mutations", F.round(F.col("mutations") / F.col("n"), 9).alias("mutability"))


_TRANS = "tr AS (SELECT ref, alt, count(*) AS n FROM (SELECT substr(kmer, 1, 1) AS ref, substr(kmer, 2, 1) AS alt FROM k) GROUP BY ref, alt)"


def _pairs(t):
    return kmers(t).groupBy(F.substring("kmer", 1, 1).alias("ref"), F.substring("kmer", 2, 1).alias("alt")).agg(F.count("*").alias("n"))


@query(f"WITH {SEQ}, {POS}, {_TRANS} SELECT ref, alt, n, round(n / sum(n) OVER (PARTITION BY ref), 9) AS p FROM tr")
def transition_matrix(t):
    return models.shares(_pairs(t), ["ref"]).withColumn("p", F.round("p", 9))


@query(f"""WITH {SEQ}, {POS}, {_TRANS}, g AS (SELECT * FROM (VALUES ('A'), ('C'), ('G'), ('T')) a(ref), (VALUES ('A'), ('C'), ('G'), ('T')) b(alt)),
d AS (SELECT g.ref, g.alt, coalesce(tr.n, 0) AS n FROM g LEFT JOIN tr ON tr.ref = g.ref AND tr.alt = g.alt AND g.ref <> g.alt AND g.ref <> 'T')
SELECT ref, alt, n, round(CASE WHEN ref = alt THEN 0 WHEN sum(n) OVER (PARTITION BY ref) > 0 THEN n / sum(n) OVER (PARTITION BY ref) ELSE 1.0 / 3 END, 9)::DOUBLE AS p FROM d""")
def grid_fallback(t):
    return models.base_changes(_pairs(t).where("ref <> 'T'")).withColumn("p", F.round("p", 9))


@query(f"""WITH {SEQ}, {POS}, c AS (SELECT substr(kmer, 1, 1) || substr(kmer, 3, 1) AS context, substr(kmer, 2, 1) AS ref, count(*) AS n FROM k WHERE kmer NOT LIKE '%N%' GROUP BY 1, 2),
g AS (SELECT l || r AS context, ref FROM (VALUES ('A'), ('C'), ('G'), ('T')) a(l), (VALUES ('A'), ('C'), ('G'), ('T')) b(r), (VALUES ('A'), ('C'), ('G'), ('T')) e(ref))
SELECT context, ref, coalesce(n, 0) AS n FROM g LEFT JOIN c USING (context, ref)""")
def context_pool(t):
    k = kmers(t).where(~F.col("kmer").contains("N")).groupBy(F.concat(F.substring("kmer", 1, 1), F.substring("kmer", 3, 1)).alias("context"), F.substring("kmer", 2, 1).alias("ref")).agg(F.count("*").alias("n"))
    grid = t.spark.createDataFrame([(a + b, c) for a in models.BASES for b in models.BASES for c in models.BASES], "context string, ref string")
    return grid.join(k, ["context", "ref"], "left").fillna(0, ["n"])


@query(f"WITH {SEQ}, {POS} SELECT kmer, count(*) AS n FROM k GROUP BY kmer ORDER BY n DESC, kmer LIMIT 12")
def top_contexts(t):
    return kmers(t).groupBy("kmer").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kmer").limit(12)


@query(f"""WITH {SEQ}, {POS}, y AS (SELECT lang, CASE WHEN substr(kmer, 2, 1) IN ('A', 'G') THEN reverse(translate(kmer, 'ACGT', 'TGCA')) ELSE kmer END AS c FROM k WHERE kmer NOT LIKE '%N%'),
n AS (SELECT lang, c, count(*)::DOUBLE AS n FROM y GROUP BY lang, c), a AS (SELECT * FROM n WHERE lang = 'en'), b AS (SELECT * FROM n WHERE lang = 'de')
SELECT round(sum(coalesce(a.n, 0) * coalesce(b.n, 0)) / sqrt(sum(coalesce(a.n, 0) ** 2) * sum(coalesce(b.n, 0) ** 2)), 9) AS cosine FROM a FULL JOIN b ON a.c = b.c""")
def sbs_cosine(t):
    y = kmers(t).where(~F.col("kmer").contains("N")).select("lang", S.pyrimidine_context("kmer", F.lit("A"))["context"].alias("c"))
    n = y.groupBy("lang", "c").agg(F.count("*").cast("double").alias("n"))
    a, b = (n.where(F.col("lang") == x).select("c", F.col("n").alias(x)) for x in ("en", "de"))
    j = a.join(b, "c", "full").fillna(0.0)
    return j.agg(F.round(F.sum(F.col("en") * F.col("de")) / F.sqrt(F.sum(F.col("en") ** 2) * F.sum(F.col("de") ** 2)), 9).alias("cosine"))


@query(f"""WITH {SEQ}, x AS (SELECT doc_id, s, unnest(range(0, (length(s) - 3) // 50)) * 50 + 25 AS pos FROM seq WHERE length(s) >= 53)
SELECT doc_id, pos, substr(s, pos - 1, 3) AS context, substr(s, pos, 1) = substr('ACGT', (doc_id % 4)::INT + 1, 1) AS ref_ok FROM x""")
def context_lookup(t):
    s = seqs(t).where(F.length("seq") >= 53)
    n = F.floor((F.length("seq") - 3) / 50).cast("int")
    x = s.withColumn("pos", F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * 50 + 25)))
    got = x.select("doc_id", F.col("pos").cast("long").alias("pos"), F.substr("seq", F.col("pos") - 1, F.lit(3)).alias("context"), F.substr(F.lit("ACGT"), (F.col("doc_id") % 4 + 1).cast("int"), F.lit(1)).alias("b"))
    return got.select("doc_id", "pos", "context", (F.substring("context", 2, 1) == F.col("b")).alias("ref_ok"))


# ------------------------------------------------------------------- quality


@query(f"WITH {QUAL} SELECT q, count(*) AS n FROM q GROUP BY q")
def quality_hist(t):
    return quals(t).select(F.explode("quals").alias("q")).groupBy("q").agg(F.count("*").alias("n"))


@query(f"WITH {QUAL} SELECT q, count(*) AS n FROM q WHERE i = 1 GROUP BY q")
def seed_hist(t):
    return models.quality_counts(quals(t), "doc_id", "quals").where("prev = -1").groupBy(F.col("cur").alias("q")).agg(F.sum("n").alias("n"))


@query(f"WITH {QUAL}, l AS (SELECT least(150 * (i - 1) // n, 149) AS pos, lag(q) OVER (PARTITION BY doc_id ORDER BY i) AS prev, q FROM q), c AS (SELECT pos, prev, q AS cur, count(*) AS n FROM l WHERE prev IS NOT NULL GROUP BY 1, 2, 3) SELECT pos, prev, cur, n, round(n / sum(n) OVER (PARTITION BY pos, prev), 9) AS p FROM c")
def quality_markov(t):
    # places of a read of any length on the model's 150
    c = models.quality_counts(quals(t), "doc_id", "quals", places=150).where("prev >= 0")
    return models.shares(c, ["pos", "prev"]).withColumn("p", F.round("p", 9)).withColumn("pos", F.col("pos").cast("long"))


@query(f"WITH {QUAL}, h AS (SELECT q, count(*) AS n FROM q GROUP BY q) SELECT round(sum(pow(10.0, -q / 10.0) * n) / sum(n), 9) AS rate FROM h")
def error_rate(t):
    h = quals(t).select(F.explode("quals").alias("q")).groupBy("q").agg(F.count("*").alias("n"))
    return h.agg(F.round(F.sum(S.error_probability("q") * F.col("n")) / F.sum("n"), 9).alias("rate"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, (SELECT b FROM (VALUES (2), (12), (23), (37)) v(b) ORDER BY abs(b - l_quantity), b LIMIT 1) AS bin FROM lineitem")
def snap_to_bin(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", S.snap_to_bin("l_quantity", [2, 12, 23, 37]).alias("bin"))


@query("SELECT doc_id, i, least(greatest(floor(150.0 * i / n_chars)::BIGINT, 0), 149) AS j FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars, 97)) AS i FROM documents WHERE n_chars > 0)")
def index_remap(t):
    d = t.documents.where("n_chars > 0").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") - 1, F.lit(97).cast("long"))).alias("i"))
    return d.select("doc_id", "i", S.remap_index("i", "n_chars", 150).cast("long").alias("j"))


@query(f"WITH {QUAL} SELECT doc_id, string_agg(chr(q + 33), '' ORDER BY i) AS text FROM q GROUP BY doc_id")
def phred_roundtrip(t):
    return quals(t).where(F.size("quals") > 0).select("doc_id", S.phred_string("quals").alias("text"))


@query(f"""WITH {SEQ}, c AS (SELECT doc_id, i, o, sum((o <> po)::INT) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM (
SELECT doc_id, i, o, coalesce(lag(o) OVER (PARTITION BY doc_id ORDER BY i), o) AS po FROM (SELECT doc_id, translate(c, 'ACGTN', 'MMIDM') AS o, i FROM (SELECT doc_id, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i FROM seq WHERE length(s) > 0))))
SELECT doc_id, string_agg(n || o, '' ORDER BY g) AS cigar FROM (SELECT doc_id, g, any_value(o) AS o, count(*) AS n FROM c GROUP BY doc_id, g) GROUP BY doc_id""")
def cigar_rle(t):
    s = seqs(t).where(F.length("seq") > 0).select("doc_id", S.bases(F.translate("seq", "ACGTN", "MMIDM")).alias("ops"))
    return s.select("doc_id", S.run_length("ops").alias("cigar"))


# ------------------------------------------------------------------------ GC

_GC = f"""WITH {SEQ}, w AS (SELECT doc_id, i * 100 AS start, substr(s, (i * 100 + 1)::INT, 100) AS w FROM (SELECT doc_id, s, unnest(range(0, length(s) // 100)) AS i FROM seq)),
g AS (SELECT doc_id, start, w, round(100.0 * (length(w) - length(replace(replace(w, 'G', ''), 'C', ''))) / length(replace(w, 'N', '')))::INT AS gc, (doc_id % 30 + 1)::DOUBLE AS depth FROM w WHERE length(replace(w, 'N', '')) > 0),
b AS (SELECT gc, count(*) AS windows, sum(depth) AS total FROM g GROUP BY gc)"""


def _windows(t):
    w = intervals.windows(seqs(t).withColumnRenamed("doc_id", "contig"), 100, 100)
    return w.withColumn("depth", (F.col("contig") % 30 + 1).cast("double"))


@query(f"{_GC} SELECT gc, windows, round(total / windows, 9) AS mean_depth FROM b")
def gc_window_bins(t):
    return models.gc_bins(_windows(t)).where("windows > 0").select("gc", "windows", F.round("mean_depth", 9).alias("mean_depth"))


_WEIGHTS = ", o AS (SELECT sum(total) / sum(windows) AS overall FROM b WHERE windows >= 5), wt AS (SELECT i::INT AS gc, CASE WHEN windows >= 5 AND overall > 0 THEN total / windows / overall ELSE 1 END AS weight FROM range(101) r(i) LEFT JOIN b ON b.gc = r.i, o)"


@query(f"{_GC}{_WEIGHTS} SELECT gc, round(weight, 9)::DOUBLE AS weight FROM wt")
def gc_weights(t):
    return models.gc_bins(_windows(t), min_windows=5).select("gc", F.round("weight", 9).alias("weight"))


@query(f"{_GC}{_WEIGHTS} SELECT round(max(weight), 9)::DOUBLE AS most, round(avg(weight), 9) AS mean, min(weight) = max(weight) AS uniform FROM wt")
def weight_scalars(t):
    return models.gc_bins(_windows(t), min_windows=5).agg(F.round(F.max("weight"), 9).alias("most"), F.round(F.avg("weight"), 9).alias("mean"), (F.min("weight") == F.max("weight")).alias("uniform"))


@query(f"{_GC}{_WEIGHTS} SELECT doc_id, start, round(coalesce(weight, 1), 9)::DOUBLE AS weight FROM g LEFT JOIN wt USING (gc)")
def gc_weight_lookup(t):
    w = _windows(t)
    upper = lambda ch: F.length("text") - F.length(F.replace("text", F.lit(ch), F.lit("")))
    called = F.length(F.regexp_replace("text", "[^ACGT]", ""))
    g = w.withColumn("called", called).where("called > 0").withColumn("gc", F.round(F.lit(100.0) * (upper("G") + upper("C")) / F.col("called")).cast("int"))
    table = models.gc_bins(w, min_windows=5).select("gc", "weight")
    # 101 rows
    return g.join(F.broadcast(table), "gc", "left").select(F.col("contig").alias("doc_id"), "start", F.round(F.coalesce("weight", F.lit(1.0)), 9).alias("weight"))


_U = "('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0"


@query(f"""{_GC}, c AS (SELECT doc_id, start, gc, sum(gc + 1) OVER (PARTITION BY doc_id ORDER BY start) AS hi, sum(gc + 1) OVER (PARTITION BY doc_id) AS total FROM g),
d AS (SELECT DISTINCT doc_id FROM g), u AS (SELECT doc_id, k, {_U.format(key="concat_ws('|', '5', 'fragment', doc_id, k)")} AS u FROM d, range(3) r(k))
SELECT u.doc_id, u.k, c.start FROM u JOIN c ON c.doc_id = u.doc_id AND greatest(u.u, 1e-12) > (c.hi - c.gc - 1) / total AND greatest(u.u, 1e-12) <= c.hi / total""")
def weighted_fragments(t):
    w = _windows(t)
    upper = lambda ch: F.length("text") - F.length(F.replace("text", F.lit(ch), F.lit("")))
    called = F.length(F.regexp_replace("text", "[^ACGT]", ""))
    g = w.withColumn("called", called).where("called > 0").withColumn("n", F.round(F.lit(100.0) * (upper("G") + upper("C")) / F.col("called")).cast("long") + 1)
    table = models.cdf(g.select(F.col("contig").alias("doc_id"), "start", "n"), ["doc_id"], ["start"])
    u = table.select("doc_id").distinct().withColumn("k", F.explode(F.array(*[F.lit(x).cast("long") for x in range(3)])))
    u = u.withColumn("u", F.greatest(R.uniform("doc_id", "k", seed=5, stream="fragment"), F.lit(1e-12)))
    return u.join(table, "doc_id").where((F.col("u") > F.col("cum_lo")) & (F.col("u") <= F.col("cum_hi"))).select("doc_id", "k", "start")


@query(f"""WITH {SEQ}, {POS}, kw AS (SELECT kmer, count(*) AS w FROM k GROUP BY kmer), j AS (SELECT doc_id, i, w FROM k JOIN kw USING (kmer)),
c AS (SELECT doc_id, i, w, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS hi, sum(w) OVER (PARTITION BY doc_id) AS total FROM j),
u AS (SELECT DISTINCT doc_id, {_U.format(key="concat_ws('|', '5', 'snp', doc_id)")} AS u FROM j)
SELECT doc_id, i - 1 AS i FROM c JOIN u USING (doc_id) WHERE greatest(u, 1e-12) > (hi - w) / total AND greatest(u, 1e-12) <= hi / total""")
def context_placement(t):
    k = kmers(t)
    kw = k.groupBy("kmer").agg(F.count("*").alias("n"))
    # at most 125 different contexts
    j = k.join(F.broadcast(kw), "kmer").select("doc_id", F.col("i").cast("long").alias("i"), "n")
    table = models.cdf(j, ["doc_id"], ["i"])
    u = F.greatest(R.uniform("doc_id", seed=5, stream="snp"), F.lit(1e-12))
    return table.withColumn("u", u).where("u > cum_lo and u <= cum_hi").select("doc_id", "i")


@query("""WITH c AS (SELECT doc_id, unnest(string_split(t, '')) AS ch, generate_subscripts(string_split(t, ''), 1) AS i FROM (SELECT doc_id, upper(regexp_replace(text, '[^ -~]', '.', 'g')) AS t FROM documents) WHERE length(t) > 0),
m AS (SELECT * FROM (VALUES ('R','AG'),('Y','CT'),('M','AC'),('K','GT'),('S','CG'),('W','AT'),('H','ACT'),('B','CGT'),('V','ACG'),('D','AGT')) v(code, options))
SELECT doc_id, string_agg(CASE WHEN options IS NULL THEN ch ELSE substr(options, (floor((('0x' || substr(md5(concat_ws('|', '5', 'iupac', doc_id, i - 1)), 1, 8))::BIGINT / 4294967296.0) * length(options)) + 1)::INT, 1) END, '' ORDER BY i) AS seq
FROM c LEFT JOIN m ON m.code = c.ch GROUP BY doc_id""")
def iupac_resolve(t):
    d = t.documents.where(F.length("text") > 0)
    chars = S.bases(F.upper(F.regexp_replace("text", "[^ -~]", ".")))
    return d.select("doc_id", F.array_join(F.transform(chars, lambda c, i: S.resolve_iupac(c, R.uniform("doc_id", i, seed=5, stream="iupac"))), "").alias("seq"))


@query(f"WITH {SEQ}, {POS}, n AS (SELECT kmer, count(*) AS n FROM k GROUP BY kmer), c AS (SELECT kmer, sum(n) OVER (ORDER BY kmer) / sum(n) OVER () AS cum FROM n) SELECT kmer, round(greatest(cum - coalesce(lag(cum) OVER (ORDER BY kmer), 0), 0), 9) AS density FROM c")
def cumulative_diff(t):
    n = kmers(t).groupBy("kmer").agg(F.count("*").alias("n")).withColumn("g", F.lit(1))
    return models.density(models.cdf(n, ["g"], ["kmer"]), ["g"], ["kmer"]).select("kmer", F.round("density", 9).alias("density"))


QUERIES, ORACLE_SQL = query.queries, query.sql
