"""Scoring of a call set against a truth set, bound to the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import randomness as R
from ..functions import variants as V
from ..operators import compare, intervals
from ._registry import Registry
from .interval_queries import BED, bed

query = Registry()
KEY = ["contig", "pos", "ref", "alt"]


def truth_and_calls(t):
    li = t.lineitem
    rows = li.select(F.col("l_returnflag").alias("contig"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("ref"), F.col("l_suppkey").alias("alt"))
    pick = F.col("pos") * 7 + F.col("ref")
    return rows.where(pick % 10 != 0), rows.where(pick % 11 != 0)


_SETS = """
WITH li AS (SELECT l_returnflag AS contig, l_orderkey AS pos, l_linenumber AS ref, l_suppkey AS alt FROM lineitem),
golden AS (SELECT * FROM li WHERE (pos * 7 + ref) % 10 <> 0),
called AS (SELECT * FROM li WHERE (pos * 7 + ref) % 11 <> 0)
"""


@query(
    _SETS
    + """, tp AS (SELECT contig, count(*) AS n FROM (SELECT * FROM golden INTERSECT SELECT * FROM called) GROUP BY contig),
fn AS (SELECT contig, count(*) AS n FROM golden g WHERE NOT EXISTS (SELECT 1 FROM called c WHERE c.contig = g.contig AND c.pos = g.pos AND c.ref = g.ref AND c.alt = g.alt) GROUP BY contig),
fp AS (SELECT contig, count(*) AS n FROM called c WHERE NOT EXISTS (SELECT 1 FROM golden g WHERE c.contig = g.contig AND c.pos = g.pos AND c.ref = g.ref AND c.alt = g.alt) GROUP BY contig),
per AS (SELECT k.contig, coalesce(tp.n, 0) AS tp, coalesce(fn.n, 0) AS fn, coalesce(fp.n, 0) AS fp
        FROM (SELECT contig FROM golden UNION SELECT contig FROM called) k LEFT JOIN tp USING (contig) LEFT JOIN fn USING (contig) LEFT JOIN fp USING (contig)),
s AS (SELECT coalesce(contig, 'TOTAL') AS contig, sum(tp)::BIGINT AS tp, sum(fn)::BIGINT AS fn, sum(fp)::BIGINT AS fp FROM per GROUP BY ROLLUP (contig))
SELECT contig, tp, fn, fp, round(tp::DOUBLE / nullif(tp + fp, 0), 9) AS precision, round(tp::DOUBLE / nullif(tp + fn, 0), 9) AS recall,
       round(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 9) AS f1 FROM s"""
)
def tp_fn_fp_rollup(t):
    """TP counts distinct keys; FN and FP count rows (duplicates kept).

    One pass: both sets are tagged and summed by key, so that a single shuffle
    on the key serves the intersection and both anti joins.
    """
    truth, calls = truth_and_calls(t)
    tagged = truth.withColumns({"t": F.lit(1), "c": F.lit(0)}).unionByName(calls.withColumns({"t": F.lit(0), "c": F.lit(1)}))
    keys = tagged.groupBy(*KEY).agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
    scored = keys.select(
        "contig",
        F.when((F.col("t") > 0) & (F.col("c") > 0), 1).otherwise(0).alias("tp"),
        F.when(F.col("c") == 0, F.col("t")).otherwise(0).alias("fn"),
        F.when(F.col("t") == 0, F.col("c")).otherwise(0).alias("fp"),
    )
    total = scored.rollup("contig").agg(F.sum("tp").alias("tp"), F.sum("fn").alias("fn"), F.sum("fp").alias("fp"))
    p, r = F.expr("try_divide(tp, tp + fp)"), F.expr("try_divide(tp, tp + fn)")
    return total.select(
        F.coalesce("contig", F.lit("TOTAL")).alias("contig"),
        "tp",
        "fn",
        "fp",
        F.round(p, 9).alias("precision"),
        F.round(r, 9).alias("recall"),
        F.round(F.expr("try_divide(2.0D * tp, 2 * tp + fp + fn)"), 9).alias("f1"),
    )


_FN = _SETS + ", fn AS (SELECT g.* FROM golden g WHERE NOT EXISTS (SELECT 1 FROM called c WHERE c.contig = g.contig AND c.pos = g.pos AND c.ref = g.ref AND c.alt = g.alt))"
_FP = _SETS + ", fp AS (SELECT g.* FROM called g WHERE NOT EXISTS (SELECT 1 FROM golden c WHERE c.contig = g.contig AND c.pos = g.pos AND c.ref = g.ref AND c.alt = g.alt))"


@query(
    f"""{_SETS}, {BED}, x AS (SELECT CASE WHEN contig = 'R' AND pos % 5 = 0 THEN 'outside_simulated_contigs' WHEN ref = 7 THEN 'symbolic' WHEN alt % 10 = 0 THEN 'hom_ref' WHEN alt % 9 = 0 THEN 'filtered'
WHEN NOT EXISTS (SELECT 1 FROM bed WHERE bed.contig = li.contig AND s <= pos AND pos < e) THEN 'outside_target_bed' END AS skip FROM li)
SELECT coalesce(skip, 'kept') AS skip, count(*) AS n FROM x GROUP BY 1"""
)
def skip_reason_counts(t):
    li = t.lineitem.select(F.col("l_returnflag").alias("contig"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("ref"), F.col("l_suppkey").alias("alt"))
    hit = intervals.points_in(li.select("contig", "pos").distinct(), bed(t)).withColumn("hit", F.lit(True))
    x = li.join(hit, ["contig", "pos"], "left")
    reason = compare.skip_reason(~((F.col("contig") == "R") & (F.col("pos") % 5 == 0)), F.col("ref") == 7, F.col("alt") % 10 == 0, F.col("alt") % 9 == 0, F.coalesce("hit", F.lit(False)))
    return x.groupBy(F.coalesce(reason, F.lit("kept")).alias("skip")).agg(F.count("*").alias("n"))


@query(
    f"""{_FN}, {BED}, x AS (SELECT CASE WHEN alt % 20 = 0 THEN 'outside_simulated_contigs' WHEN alt % 20 = 1 THEN 'outside_target_bed'
WHEN NOT EXISTS (SELECT 1 FROM bed WHERE bed.contig = fn.contig AND s <= pos AND pos < e) THEN 'outside_mutation_bed' END AS reason FROM fn)
SELECT reason, count(*) AS n FROM x WHERE reason IS NOT NULL GROUP BY reason"""
)
def fn_attribution(t):
    truth, calls = truth_and_calls(t)
    _, fn, _ = compare.split_sets(truth, calls)
    hit = intervals.points_in(fn.select("contig", "pos").distinct(), bed(t)).withColumn("hit", F.lit(True))
    x = fn.join(hit, ["contig", "pos"], "left")
    reasons = compare.miss_reasons(F.col("alt") % 20 != 0, F.col("alt") % 20 != 1, F.coalesce("hit", F.lit(False)))
    return x.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("WITH a AS (SELECT DISTINCT 'c' || p_size AS c FROM part EXCEPT SELECT DISTINCT 'c' || l_linenumber FROM lineitem) SELECT count(*) AS n, list_sort(list(c))[1:5]::VARCHAR AS sample FROM a")
def naming_mismatch(t):
    a = t.part.select(F.concat(F.lit("c"), "p_size").alias("contig"))
    b = t.lineitem.select(F.concat(F.lit("c"), "l_linenumber").alias("contig"))
    return compare.naming_mismatch(a, b).select("n", F.concat(F.lit("["), F.array_join("sample", ", "), F.lit("]")).alias("sample"))


@query(f"{_SETS} SELECT DISTINCT contig FROM (SELECT contig FROM golden UNION SELECT contig FROM called)")
def contig_union(t):
    truth, calls = truth_and_calls(t)
    return truth.select("contig").union(calls.select("contig")).distinct()


@query(f"{_FP} SELECT contig, count(*) AS n FROM golden WHERE contig IN (SELECT contig FROM fp) GROUP BY contig")
def contigs_needing_sweep(t):
    truth, calls = truth_and_calls(t)
    fp = compare.split_sets(truth, calls)[2].select("contig").distinct()
    return truth.join(fp, "contig", "left_semi").groupBy("contig").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS contig, l_orderkey AS pos, l_linenumber AS ref, l_suppkey AS alt, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def duplicate_keys(t):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("contig"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("ref"), F.col("l_suppkey").alias("alt")).agg(F.count("*").alias("n")).where("n > 1")


@query("SELECT l_returnflag AS contig, l_orderkey AS pos, min(l_suppkey) AS alt FROM lineitem GROUP BY 1, 2")
def first_wins_dedup(t):
    w = Window.partitionBy("l_returnflag", "l_orderkey").orderBy("l_suppkey", "l_linenumber")
    x = t.lineitem.withColumn("k", F.row_number().over(w)).where("k = 1")
    return x.select(F.col("l_returnflag").alias("contig"), F.col("l_orderkey").alias("pos"), F.col("l_suppkey").alias("alt"))


@query("SELECT DISTINCT least(vec_id % 60, vec_id % 37) AS low, greatest(vec_id % 60, vec_id % 37) AS high FROM embeddings")
def symmetric_pair_dedup(t):
    k = V.mate_pair_key(F.lit("c"), F.col("vec_id") % 60, F.lit("c"), F.col("vec_id") % 37)
    return t.embeddings.select(k.alias("k")).dropDuplicates().select(F.col("k.low.pos").alias("low"), F.col("k.high.pos").alias("high"))


_MERGE = "d AS (SELECT DISTINCT l_returnflag AS contig, l_orderkey AS pos, l_linenumber AS ref, l_suppkey AS alt FROM lineitem), tumor AS (SELECT * FROM d WHERE alt % 3 <> 0), normal AS (SELECT * FROM d WHERE alt % 2 = 0)"


def _tumor_normal(t):
    d = t.lineitem.select(F.col("l_returnflag").alias("contig"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("ref"), F.col("l_suppkey").alias("alt")).distinct()
    d = d.withColumn("provenance", F.when(F.col("alt") % 5 == 0, "denovo").otherwise("input"))
    return d.where("alt % 3 <> 0"), d.where("alt % 2 = 0")


@query(f"""WITH {_MERGE}, m AS (SELECT *, CASE WHEN alt % 5 = 0 THEN 'somatic' ELSE 'shared' END AS origin FROM tumor UNION ALL SELECT *, 'germline' FROM normal n WHERE NOT EXISTS (SELECT 1 FROM tumor t WHERE t.contig = n.contig AND t.pos = n.pos AND t.ref = n.ref AND t.alt = n.alt))
SELECT origin, contig, count(*) AS n, sum(pos)::BIGINT AS total FROM m GROUP BY origin, contig""")
def origin_merge(t):
    tumor, normal = _tumor_normal(t)
    return compare.origin_merge(tumor, normal, KEY).groupBy("origin", "contig").agg(F.count("*").alias("n"), F.sum("pos").alias("total"))


@query(f"WITH {_MERGE} SELECT CASE WHEN t.pos IS NULL THEN 'normal_only' WHEN n.pos IS NULL THEN 'tumor_only' ELSE 'both' END AS part, count(*) AS n FROM tumor t FULL JOIN normal n ON t.contig = n.contig AND t.pos = n.pos AND t.ref = n.ref AND t.alt = n.alt GROUP BY 1")
def isec_partition(t):
    a, b = (x.select(*KEY) for x in _tumor_normal(t))
    # tagged union: one shuffle on the key in place of a full outer join
    tagged = a.withColumn("s", F.lit(1)).unionByName(b.withColumn("s", F.lit(2))).groupBy(*KEY).agg(F.sum("s").alias("s"))
    return tagged.groupBy(F.when(F.col("s") == 1, "tumor_only").when(F.col("s") == 2, "normal_only").otherwise("both").alias("part")).agg(F.count("*").alias("n"))


@query("SELECT 'N_' || conv_id AS name, turn FROM conversations WHERE role = 'user' UNION ALL SELECT 'T_' || conv_id, turn FROM conversations WHERE role <> 'user'")
def tagged_union(t):
    c = t.conversations
    tag = lambda d, p: d.select(F.concat(F.lit(p), "conv_id").alias("name"), "turn")
    return tag(c.where("role = 'user'"), "N_").unionByName(tag(c.where("role <> 'user'"), "T_"))


_UN = "('0x' || substr(md5({k}), 1, 8))::BIGINT / 4294967296.0"


@query(f"SELECT l_returnflag, count(*) AS n FROM lineitem WHERE {_UN.format(k="concat_ws('|', '5', 'suppress', l_orderkey, l_linenumber)")} >= l_discount GROUP BY l_returnflag")
def bernoulli_suppress(t):
    return t.lineitem.where(R.uniform("l_orderkey", "l_linenumber", seed=5, stream="suppress") >= F.col("l_discount")).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag AS contig, l_orderkey AS pos, sum(CASE WHEN l_linenumber % 2 = 0 THEN 1 ELSE 0 END)::BIGINT AS ref_count, sum(l_linenumber % 2)::BIGINT AS alt_count, printf('%.4f', sum(l_linenumber % 2) / count(*)::DOUBLE) AS af FROM lineitem GROUP BY 1, 2")
def ad_dp_af(t):
    odd = F.col("l_linenumber") % 2
    a = t.lineitem.groupBy(F.col("l_returnflag").alias("contig"), F.col("l_orderkey").alias("pos")).agg(F.sum(1 - odd).alias("ref_count"), F.sum(odd).alias("alt_count"))
    return a.withColumn("af", V.four_digits(F.col("alt_count") / (F.col("ref_count") + F.col("alt_count"))))


@query("SELECT l_returnflag AS contig, l_orderkey AS pos, l_linenumber AS ref, l_suppkey AS alt, l_extendedprice AS price, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_orderkey, l_linenumber, l_suppkey, l_extendedprice) AS rank FROM lineitem")
def sorted_by_contig(t):
    # ranks in bins of positions and the bins' first ranks: no task sorts a whole contig
    x = t.lineitem.withColumn("bin", F.expr("l_orderkey div 4096"))
    upto = Window.partitionBy("l_returnflag").orderBy("bin")
    first = x.groupBy("l_returnflag", "bin").agg(F.count("*").alias("n"))
    first = first.select("l_returnflag", "bin", (F.sum("n").over(upto) - F.col("n")).alias("before"))
    w = Window.partitionBy("l_returnflag", "bin").orderBy("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return x.withColumn("k", F.row_number().over(w)).join(first, ["l_returnflag", "bin"]).select(F.col("l_returnflag").alias("contig"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("ref"), F.col("l_suppkey").alias("alt"), F.col("l_extendedprice").alias("price"), (F.col("before") + F.col("k")).cast("long").alias("rank"))


@query("SELECT o_orderstatus AS contig, o_orderkey AS id, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_custkey) AS rank FROM orders")
def start_order(t):
    return t.orders.select(F.col("o_orderstatus").alias("contig"), F.col("o_orderkey").alias("id"), F.rank().over(Window.partitionBy("o_orderstatus").orderBy("o_custkey")).cast("long").alias("rank"))


def equivalence_sweep(t):
    """Calls and misses that spell the same haplotype: each document's sequence, with a repeat of its first bases behind it."""
    d = t.documents.select(F.col("doc_id").cast("string").alias("contig"), F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("seq"))
    d = d.where(F.length("seq") >= 4).select("contig", F.concat("seq", F.repeat(F.substring("seq", 1, 4), 15)).alias("seq"), F.length("seq").alias("n"))
    at = lambda p: F.col("n") + p
    cut = lambda p: F.substr("seq", at(p), F.lit(5))
    row = lambda p: d.select("contig", at(p).cast("long").alias("pos"), cut(p).alias("ref"), F.substring(cut(p), 1, 1).alias("alt"), at(p).cast("long").alias("ord"))
    return compare.equivalent(row(21), row(25), d.drop("n"))


query(None)(equivalence_sweep)

QUERIES, ORACLE_SQL = query.queries, query.sql
