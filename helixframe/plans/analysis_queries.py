"""Statistics, comparisons of tables, and report-style aggregations."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import randomness as R
from ..operators import compare, models
from ._registry import Registry

query = Registry()


@query("""WITH m AS (SELECT median(l_quantity) AS median FROM lineitem), d AS (SELECT median(round(abs(l_quantity - median))) AS mad FROM lineitem, m),
c AS (SELECT l_quantity AS q, count(*) AS n FROM lineitem GROUP BY 1), k AS (SELECT q, n FROM c, m, d WHERE q > 0 AND q <= median + 10 * mad AND n >= 10)
SELECT (SELECT median FROM m) AS median, (SELECT mad FROM d) AS mad, round(sum(q * n) / sum(n), 9) AS mean, round(sqrt(sum(q * q * n) / sum(n) - (sum(q * n) / sum(n)) ** 2), 9) AS sd, sum(n)::BIGINT AS n FROM k""")
def median_mad_filter(t):
    li = t.lineitem.select("l_quantity")
    fit = models.normal_fit(models.length_filter(li, "l_quantity", 10), "l_quantity")
    # both sides are one row
    return models.median_mad(li, "l_quantity").crossJoin(F.broadcast(fit)).select("median", "mad", F.round("mean", 9).alias("mean"), F.round("sd", 9).alias("sd"), "n")


@query("SELECT o_orderpriority AS kind, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 9) AS p, round(avg(ln(o_totalprice)), 7) AS mu, round(stddev_pop(ln(o_totalprice)), 7) AS sigma FROM orders WHERE o_totalprice >= 50 GROUP BY 1 HAVING count(*) >= 2")
def lognormal_fit(t):
    f = models.sv_fit(t.orders.select(F.col("o_orderpriority").alias("kind"), F.col("o_totalprice").alias("span")), "kind", "span")
    return f.select("kind", "n", F.round("p", 9).alias("p"), F.round("mu", 7).alias("mu"), F.round("sigma", 7).alias("sigma"))


_MIX = "v AS (SELECT ['SNP','SNP','INS','DEL','CPX'][(o_orderkey % 5)::INT + 1] AS kind, o_custkey % 10 = 0 AS hom FROM orders)"


@query(f"""WITH {_MIX} SELECT count(*) AS n, round(avg((kind = 'SNP')::INT), 9) AS p_snp, round(avg((kind = 'INS')::INT), 9) AS p_ins, round(avg((kind = 'DEL')::INT), 9) AS p_del, round(avg(hom::INT), 9) AS p_hom,
round(count(*) FILTER (kind = 'INS') / count(*) FILTER (kind IN ('INS', 'DEL'))::DOUBLE, 9) AS insertion_share FROM v WHERE kind <> 'CPX'""")
def variant_mix(t):
    kinds = F.array(*[F.lit(x) for x in ("SNP", "SNP", "INS", "DEL", "CPX")])
    m = models.variant_mix(t.orders.select(F.element_at(kinds, (F.col("o_orderkey") % 5 + 1).cast("int")).alias("kind"), (F.col("o_custkey") % 10 == 0).alias("hom")), "kind", "hom")
    return m.select("n", *[F.round(c, 9).alias(c) for c in m.columns[1:]])


@query("SELECT o_orderstatus AS kind, count(*) AS n, round(count(*) / (sum(count(*)) OVER ())::DOUBLE, 9) AS share FROM orders GROUP BY 1")
def type_spread(t):
    c = t.orders.groupBy(F.col("o_orderstatus").alias("kind")).agg(F.count("*").alias("n"))
    return models.shares(c, [], out="share").withColumn("share", F.round("share", 9))


_CDF = "c AS (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2), cdf AS (SELECT p_type, p_size, (sum(n) OVER w - n) / sum(n) OVER (PARTITION BY p_type) AS lo, sum(n) OVER w / sum(n) OVER (PARTITION BY p_type) AS hi FROM c WINDOW w AS (PARTITION BY p_type ORDER BY p_size))"


def _cdf(t):
    return models.cdf(t.part.groupBy("p_type", "p_size").agg(F.count("*").alias("n")), ["p_type"], ["p_size"])


@query(f"WITH {_CDF} SELECT p_type, p_size, round(lo, 9) AS lo, round(hi, 9) AS hi FROM cdf")
def cdf_table(t):
    return _cdf(t).select("p_type", "p_size", F.round("cum_lo", 9).alias("lo"), F.round("cum_hi", 9).alias("hi"))


def _u(stream, *keys):
    return f"('0x' || substr(md5(concat_ws('|', '5', '{stream}', {', '.join(keys)})), 1, 8))::BIGINT / 4294967296.0"


@query(f"WITH {_CDF}, d AS (SELECT p_partkey, p_type, greatest({_u('draw', 'p_partkey')}, 1e-12) AS u FROM part) SELECT d.p_partkey, cdf.p_size AS drawn FROM d JOIN cdf ON cdf.p_type = d.p_type AND u > lo AND u <= hi")
def inverse_cdf_sample(t):
    d = t.part.select("p_partkey", "p_type", R.uniform("p_partkey", seed=5, stream="draw").alias("u"))
    return models.draw(d, _cdf(t).drop("n"), ["p_type"]).select("p_partkey", F.col("p_size").alias("drawn"))


@query(f"""WITH s AS (SELECT p_partkey, p_partkey * 10 AS s, p_size AS len, p_size * p_retailprice AS w FROM part), c AS (SELECT *, sum(w) OVER (ORDER BY p_partkey) AS hi, sum(w) OVER () AS total FROM s),
d AS (SELECT k, greatest({_u('seg', 'k')}, 1e-12) AS u, {_u('pos', 'k')} AS v FROM range(500) r(k))
SELECT k, p_partkey, s + floor(v * len)::BIGINT AS pos FROM d JOIN c ON u > (hi - w) / total AND u <= hi / total""")
def segment_position_sample(t):
    s = t.part.select(F.lit(1).alias("g"), "p_partkey", (F.col("p_partkey") * 10).alias("s"), "p_size", (F.col("p_size") * F.col("p_retailprice")).alias("n"))
    d = t.spark.range(500).select(F.lit(1).alias("g"), F.col("id").alias("k"), R.uniform("id", seed=5, stream="seg").alias("u"), R.uniform("id", seed=5, stream="pos").alias("v"))
    got = models.draw(d, models.cdf(s, ["g"], ["p_partkey"]).drop("n"), ["g"])
    return got.select("k", "p_partkey", (F.col("s") + F.floor(F.col("v") * F.col("p_size"))).alias("pos"))


@query(f"SELECT o_orderkey, {_u('u', 'o_orderkey')} AS u FROM orders")
def hash_uniform(t):
    return t.orders.select("o_orderkey", R.uniform("o_orderkey", seed=5, stream="u").alias("u"))


@query(f"SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderstatus ORDER BY {_u('shuffle', 'o_orderkey')}, o_orderkey) AS place FROM orders")
def hash_shuffle(t):
    w = Window.partitionBy("o_orderstatus").orderBy(R.uniform("o_orderkey", seed=5, stream="shuffle"), "o_orderkey")
    return t.orders.select("o_orderkey", F.row_number().over(w).cast("long").alias("place"))


_AF = """a AS (SELECT l_orderkey AS pos, avg(l_discount * 10) AS af, count(*) AS dp FROM lineitem WHERE l_linenumber <= 4 GROUP BY 1), b AS (SELECT l_orderkey AS pos, avg(l_tax * 12.5) AS af, count(*) AS dp FROM lineitem WHERE l_linenumber >= 3 GROUP BY 1),
ga AS (SELECT * FROM a WHERE dp >= 2), gb AS (SELECT * FROM b WHERE dp >= 2)"""


def _af(t, spread=False):
    li = t.lineitem
    a = li.where("l_linenumber <= 4").groupBy(F.col("l_orderkey").alias("pos")).agg(F.avg(F.col("l_discount") * 10).alias("a"), F.count("*").alias("dp")).where("dp >= 2").drop("dp")
    b = li.where("l_linenumber >= 3").groupBy(F.col("l_orderkey").alias("pos")).agg(F.avg(F.col("l_tax") * 12.5).alias("b"), F.count("*").alias("dp")).where("dp >= 2").drop("dp")
    return a.join(b, "pos", "full" if spread else "inner")


@query(f"""WITH {_AF}, j AS (SELECT ga.af AS a, gb.af AS b FROM ga FULL JOIN gb ON ga.pos = gb.pos)
SELECT count(*) FILTER (a IS NOT NULL AND b IS NOT NULL) AS shared, count(*) FILTER (b IS NULL) AS only_a, count(*) FILTER (a IS NULL) AS only_b, round(corr(a, b), 6) AS pearson, round(avg(abs(a - b)), 6) AS mae, round(sqrt(avg((a - b) ** 2)), 6) AS rmse, round(avg(a - b), 6) AS bias FROM j""")
def af_compare(t):
    d = F.col("a") - F.col("b")
    return _af(t, True).agg(
        F.count_if(d.isNotNull()).alias("shared"), F.count_if(F.col("b").isNull()).alias("only_a"), F.count_if(F.col("a").isNull()).alias("only_b"),
        F.round(F.corr("a", "b"), 6).alias("pearson"), F.round(F.avg(F.abs(d)), 6).alias("mae"), F.round(F.sqrt(F.avg(d * d)), 6).alias("rmse"), F.round(F.avg(d), 6).alias("bias"),
    )


@query(f"WITH {_AF}, j AS (SELECT round(ga.af, 9) AS a, gb.af AS b FROM ga JOIN gb ON ga.pos = gb.pos) SELECT least(floor(a * 10), 9)::BIGINT AS decile, count(*) AS n, round(avg(abs(a - b)), 6) AS mae FROM j GROUP BY 1")
def af_decile_mae(t):
    x = _af(t).withColumn("a", F.round("a", 9))
    return x.groupBy(F.least(F.floor(F.col("a") * 10), F.lit(9)).cast("long").alias("decile")).agg(F.count("*").alias("n"), F.round(F.avg(F.abs(F.col("a") - F.col("b"))), 6).alias("mae"))


@query(f"""WITH {_AF}, j AS (SELECT round(ga.af, 9) AS a, round(gb.af, 9) AS b FROM ga JOIN gb ON ga.pos = gb.pos),
r AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0 AS ra, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0 AS rb FROM j) SELECT round(corr(ra, rb), 6) AS rho FROM r""")
def spearman(t):
    x = _af(t).select(F.round("a", 9).alias("a"), F.round("b", 9).alias("b"))

    def ranks(c):
        # ranks of distinct values by counts: the window is over distinct values, not rows
        n = x.groupBy(c).agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.orderBy(c)) - F.col("n")
        return n.select(c, (before + (F.col("n") + 1) / 2).alias(f"r{c}"))

    return x.join(ranks("a"), "a").join(ranks("b"), "b").agg(F.round(F.corr("ra", "rb"), 6).alias("rho"))


@query("""WITH m AS (SELECT 'm' || s_suppkey * 2 AS metric, s_nationkey::VARCHAR AS now FROM supplier),
b AS (SELECT 'm' || n_nationkey AS metric, n_regionkey * 4 AS value, n_regionkey / 2.0 AS sd, ['exact','ge2sd','band','lepct20'][n_nationkey % 4 + 1] AS gate FROM nation)
SELECT b.metric, gate, CASE WHEN now IS NULL THEN 'SKIP' WHEN CASE gate WHEN 'exact' THEN now::DOUBLE = value WHEN 'ge2sd' THEN now::DOUBLE >= value - 2 * sd WHEN 'band' THEN abs(now::DOUBLE - value) <= 2 * sd ELSE now::DOUBLE <= value * 1.2 END THEN 'PASS' ELSE 'FAIL' END AS status FROM b LEFT JOIN m USING (metric)""")
def regression_gate(t):
    m = t.supplier.select(F.concat(F.lit("m"), F.col("s_suppkey") * 2).alias("metric"), F.col("s_nationkey").cast("string").alias("value"))
    gates = F.array(*[F.lit(x) for x in ("exact", "ge2sd", "band", "lepct20")])
    b = t.nation.select(F.concat(F.lit("m"), "n_nationkey").alias("metric"), (F.col("n_regionkey") * 4).cast("string").alias("value"), (F.col("n_regionkey") / 2).cast("string").alias("sd"), F.element_at(gates, F.col("n_nationkey") % 4 + 1).alias("gate"))
    return compare.regression_gate(m, b).select("metric", "gate", "status")


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, min(value) AS best FROM events GROUP BY 1")
def replicate_stats(t):
    return t.events.groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.min("value").alias("best"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, any_value(n) AS n, max(value) FILTER (k = n // 2) AS median, max(value) FILTER (k = floor(0.9 * n)) AS p90, max(value) AS most FROM r GROUP BY 1""")
def nearest_rank_p90(t):
    w = Window.partitionBy("event_type")
    r = t.events.select("event_type", "value", (F.row_number().over(w.orderBy("value")) - 1).alias("k"), F.count("*").over(w).alias("n"))
    at = lambda i: F.max(F.when(F.col("k") == i, F.col("value")))
    return r.groupBy("event_type", "n").agg(at(F.floor(F.col("n") / 2)).alias("median"), at(F.floor(F.col("n") * F.lit(0.9))).alias("p90"), F.max("value").alias("most")).select("event_type", "n", "median", "p90", "most")


@query("""WITH s AS (SELECT o_orderstatus AS arm, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS sd FROM orders GROUP BY 1)
SELECT a.arm, b.arm AS other, round(a.mean - b.mean, 3) AS delta, abs(a.mean - b.mean) <= greatest(a.sd, b.sd, 0.005) AS within FROM s a JOIN s b ON a.arm < b.arm""")
def contrast_delta(t):
    s = t.orders.groupBy(F.col("o_orderstatus").alias("arm")).agg(F.round(F.avg("o_totalprice"), 4).alias("mean"), F.round(F.stddev_samp("o_totalprice"), 4).alias("sd"))
    o = s.select(F.col("arm").alias("other"), F.col("mean").alias("m2"), F.col("sd").alias("sd2"))
    # arms of an experiment: a handful of rows
    d = F.col("mean") - F.col("m2")
    return s.join(o, F.col("arm") < F.col("other")).select("arm", "other", F.round(d, 3).alias("delta"), (F.abs(d) <= F.greatest("sd", "sd2", F.lit(0.005))).alias("within"))


@query("WITH w AS (SELECT user_id, count(*) AS n, min(value) AS lo, round(median(value), 6) AS median, round(avg(value), 6) AS mean, max(value) AS hi FROM events GROUP BY 1) SELECT * FROM w ORDER BY hi DESC, user_id LIMIT 5")
def timing_summary(t):
    w = t.events.groupBy("user_id").agg(F.count("*").alias("n"), F.min("value").alias("lo"), F.round(F.median("value"), 6).alias("median"), F.round(F.avg("value"), 6).alias("mean"), F.max("value").alias("hi"))
    return w.orderBy(F.desc("hi"), "user_id").limit(5)


@query("SELECT count(*) AS n, sum(hash_key)::BIGINT AS total FROM (SELECT DISTINCT 'chr' || l_linenumber AS chrom, l_orderkey AS pos, l_returnflag AS ref, l_linestatus AS alt, l_orderkey * 3 + l_linenumber AS hash_key FROM lineitem WHERE l_quantity >= 5)")
def corpus_dedup(t):
    x = t.lineitem.where("l_quantity >= 5").select(F.concat(F.lit("chr"), "l_linenumber").alias("chrom"), F.col("l_orderkey").alias("pos"), F.col("l_returnflag").alias("ref"), F.col("l_linestatus").alias("alt"), (F.col("l_orderkey") * 3 + F.col("l_linenumber")).alias("hash_key"))
    return x.dropDuplicates(["chrom", "pos", "ref", "alt"]).agg(F.count("*").alias("n"), F.sum("hash_key").alias("total"))


@query("SELECT o_custkey AS donor, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 4) AS mean_f, count(*) FILTER (o_orderstatus <> 'F') AS others FROM orders GROUP BY 1")
def sidecar_means(t):
    f = F.col("o_orderstatus") == "F"
    return t.orders.groupBy(F.col("o_custkey").alias("donor")).agg(F.round(F.avg(F.when(f, F.col("o_totalprice"))), 4).alias("mean_f"), F.count_if(~f).alias("others"))


@query("WITH c AS (SELECT o_orderpriority AS kind, least(o_custkey % 12, 8) AS cn, count(*) AS n FROM orders WHERE o_custkey % 12 <> 2 GROUP BY 1, 2) SELECT kind, cn, n, round(n / (sum(n) OVER (PARTITION BY kind))::DOUBLE, 9) AS p FROM c")
def cn_cap_renorm(t):
    c = t.orders.where("o_custkey % 12 <> 2").groupBy(F.col("o_orderpriority").alias("kind"), F.least(F.col("o_custkey") % 12, F.lit(8)).alias("cn")).agg(F.count("*").alias("n"))
    return models.shares(c, ["kind"]).withColumn("p", F.round("p", 9))


@query("""SELECT o_orderkey, least(a, b) AS start, greatest(a, b) AS \"end\", kind, CASE WHEN kind = 'INV' THEN 0.5 ELSE 1 END::DOUBLE AS weight FROM (
SELECT o_orderkey, o_custkey * 3 AS a, (o_orderkey * 7) % 4000 AS b, ['DEL','DUP','INV','TRA'][(o_orderkey % 4)::INT + 1] AS kind FROM orders) WHERE kind <> 'TRA' AND abs(a - b) >= 50""")
def sv_rows_from_pairs(t):
    kinds = F.array(*[F.lit(x) for x in ("DEL", "DUP", "INV", "TRA")])
    x = t.orders.select("o_orderkey", (F.col("o_custkey") * 3).alias("a"), ((F.col("o_orderkey") * 7) % 4000).alias("b"), F.element_at(kinds, (F.col("o_orderkey") % 4 + 1).cast("int")).alias("kind"))
    x = x.where((F.col("kind") != "TRA") & (F.abs(F.col("a") - F.col("b")) >= 50))
    return x.select("o_orderkey", F.least("a", "b").alias("start"), F.greatest("a", "b").alias("end"), "kind", F.when(F.col("kind") == "INV", 0.5).otherwise(1.0).alias("weight"))


@query("""SELECT p_partkey, p_size % 7 AS cn, coalesce(round_even(s.ploidy, 0), 2)::INT AS ploidy, CASE WHEN p_size % 7 = 0 THEN '1/1' ELSE '0/1' END AS gt FROM part LEFT JOIN (SELECT s_suppkey, s_nationkey / 4.0 AS ploidy FROM supplier) s ON s.s_suppkey = p_partkey % 100
WHERE p_size % 7 <> coalesce(round_even(s.ploidy, 0), 2)""")
def focal_segments(t):
    s = t.supplier.select("s_suppkey", (F.col("s_nationkey") / 4).alias("ploidy_raw"))
    # banker's rounding here: the figures it must match were rounded that way
    x = t.part.join(s, F.col("p_partkey") % 100 == F.col("s_suppkey"), "left").withColumn("ploidy", F.coalesce(F.bround("ploidy_raw", 0), F.lit(2)).cast("int")).withColumn("cn", F.col("p_size") % 7)
    return x.where(F.col("cn") != F.col("ploidy")).select("p_partkey", "cn", "ploidy", F.when(F.col("cn") == 0, "1/1").otherwise("0/1").alias("gt"))


@query("SELECT p_brand, count(*) AS n FROM part WHERE EXISTS (SELECT 1 FROM region WHERE p_brand LIKE 'Brand#' || r_regionkey || '%') GROUP BY 1")
def tissue_filter(t):
    prefix = t.region.select(F.concat(F.lit("Brand#"), "r_regionkey").alias("prefix"))
    return t.part.join(F.broadcast(prefix), F.col("p_brand").startswith(F.col("prefix")), "left_semi").groupBy("p_brand").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, concat_ws(chr(9), 'chr' || o_custkey % 22, o_orderkey, '.', 'A', 'G', '.', 'PASS') AS line FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority LIKE '1%'")
def snp_pass_filter(t):
    x = t.orders.where("o_orderstatus = 'F' and o_orderpriority like '1%'")
    return x.select("o_orderkey", F.concat_ws("\t", F.concat(F.lit("chr"), F.col("o_custkey") % 22), "o_orderkey", F.lit("."), F.lit("A"), F.lit("G"), F.lit("."), F.lit("PASS")).alias("line"))


@query("SELECT year(o_orderdate) AS run, count(*) AS jobs, round(sum(o_totalprice) / 3600, 4) AS core_hours, max(o_totalprice) AS longest FROM orders GROUP BY 1")
def manifest_rollup(t):
    return t.orders.groupBy(F.year("o_orderdate").cast("long").alias("run")).agg(F.count("*").alias("jobs"), F.round(F.sum("o_totalprice") / 3600, 4).alias("core_hours"), F.max("o_totalprice").alias("longest"))


@query("WITH c AS (SELECT o_orderpriority AS kind, o_orderstatus AS x, count(*) AS n FROM orders GROUP BY 1, 2), p AS (SELECT kind, n / (sum(n) OVER (PARTITION BY kind))::DOUBLE AS p FROM c) SELECT kind, abs(sum(p) - 1) < 1e-9 AS sums_to_one, count(*) AS outcomes FROM p GROUP BY kind")
def model_sanity(t):
    c = models.shares(t.orders.groupBy(F.col("o_orderpriority").alias("kind"), "o_orderstatus").agg(F.count("*").alias("n")), ["kind"])
    return c.groupBy("kind").agg((F.abs(F.sum("p") - 1) < 1e-9).alias("sums_to_one"), F.count("*").alias("outcomes"))


QUERIES, ORACLE_SQL = query.queries, query.sql
