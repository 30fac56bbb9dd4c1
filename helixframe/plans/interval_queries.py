"""Interval joins and interval algebra on lineitem, part, orders, supplier and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import variants as V
from ..operators import compare, intervals
from ._registry import Registry

query = Registry()

# ------------------------------------------------------------------ bindings


def bed(t, contigs=("A", "N", "R")):
    """part as intervals."""
    c = F.element_at(F.array(*[F.lit(x) for x in contigs]), F.col("p_size") % 3 + 1)
    return t.part.select(c.alias("contig"), (F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + 7).alias("end"), F.col("p_retailprice").alias("value"), F.col("p_partkey").alias("ord"))


def points(t):
    return t.lineitem.select(F.col("l_returnflag").alias("contig"), F.col("l_orderkey").alias("pos"), F.col("l_linenumber").alias("ref"), F.col("l_suppkey").alias("alt"), F.col("l_quantity").alias("quantity"))


def spans(t):
    """orders as intervals on the priorities' first characters."""
    return t.orders.select(F.substring("o_orderpriority", 1, 1).alias("contig"), F.col("o_orderkey").alias("start"), (F.col("o_orderkey") + 5 + F.col("o_custkey") % 40).alias("end"), F.col("o_custkey").alias("cust"))


def tiles(t):
    """Disjoint segments of one contig: each part's key in steps of 100, value from the price."""
    return t.part.select(F.lit("s").alias("contig"), (F.col("p_partkey") * 100).alias("start"), (F.col("p_partkey") * 100 + 80).alias("end"), F.col("p_retailprice").cast("double").alias("value"))


def overrides(t):
    return t.supplier.select(F.lit("s").alias("contig"), (F.col("s_suppkey") * 37).alias("start"), (F.col("s_suppkey") * 37 + 120).alias("end"), (F.col("s_nationkey") / 4.0).alias("value"), F.col("s_suppkey").alias("ord"))


BED = "bed AS (SELECT ['A','N','R'][p_size % 3 + 1] AS contig, p_partkey * 10 AS s, p_partkey * 10 + 7 AS e, p_retailprice AS value FROM part)"
PTS = "pts AS (SELECT l_returnflag AS contig, l_orderkey AS pos, l_linenumber AS ref, l_suppkey AS alt, l_quantity AS quantity FROM lineitem)"
SPANS = "spans AS (SELECT substr(o_orderpriority, 1, 1) AS contig, o_orderkey AS s, o_orderkey + 5 + o_custkey % 40 AS e, o_custkey AS cust FROM orders)"
TILES = "tiles AS (SELECT p_partkey * 100 AS s, p_partkey * 100 + 80 AS e, p_retailprice::DOUBLE AS value FROM part)"
OVER = "ov AS (SELECT s_suppkey * 37 AS s, s_suppkey * 37 + 120 AS e, s_nationkey / 4.0 AS value, s_suppkey AS ord FROM supplier)"
ATOMS = """cuts AS (SELECT s AS p FROM tiles UNION SELECT e FROM tiles UNION SELECT s FROM ov UNION SELECT e FROM ov),
atoms AS (SELECT p AS s, lead(p) OVER (ORDER BY p) AS e FROM cuts QUALIFY e IS NOT NULL)"""

# --------------------------------------------------------------------- joins


@query(f"WITH {BED}, {PTS} SELECT contig, count(*) AS n, sum(pos)::BIGINT AS total FROM pts WHERE EXISTS (SELECT 1 FROM bed WHERE bed.contig = pts.contig AND s <= pos AND pos < e) GROUP BY contig")
def interval_semi(t):
    return intervals.points_in(points(t), bed(t)).groupBy("contig").agg(F.count("*").alias("n"), F.sum("pos").alias("total"))


@query(f"WITH {BED}, {PTS} SELECT contig, count(*) AS n, sum(pos)::BIGINT AS total FROM pts WHERE NOT EXISTS (SELECT 1 FROM bed WHERE bed.contig = pts.contig AND s <= pos AND pos < e) GROUP BY contig")
def interval_anti(t):
    return intervals.points_in(points(t), bed(t), how="anti").groupBy("contig").agg(F.count("*").alias("n"), F.sum("pos").alias("total"))


_SPAN_BED = "sb AS (SELECT contig, s, e, cust FROM spans WHERE contig IN ('1', '2')), pb AS (SELECT CASE p_size % 2 WHEN 0 THEN '1' ELSE '2' END AS contig, p_partkey * 10 AS s, p_partkey * 10 + 7 AS e, p_partkey AS part FROM part)"


def _two(t):
    b = t.part.select(F.when(F.col("p_size") % 2 == 0, "1").otherwise("2").alias("contig"), (F.col("p_partkey") * 10).alias("start"), (F.col("p_partkey") * 10 + 7).alias("end"), F.col("p_partkey").alias("part"))
    return spans(t).where(F.col("contig").isin("1", "2")), b


@query(f"WITH {SPANS}, {_SPAN_BED} SELECT contig, s AS start, e AS \"end\", cust FROM sb WHERE EXISTS (SELECT 1 FROM pb WHERE pb.contig = sb.contig AND sb.s < pb.e AND pb.s < sb.e)")
def interval_overlap(t):
    a, b = _two(t)
    return intervals.overlaps(a, b, "semi")


@query(f"WITH {SPANS}, {_SPAN_BED} SELECT sb.contig, greatest(sb.s, pb.s) AS start, least(sb.e, pb.e) AS \"end\", cust, part FROM sb JOIN pb ON pb.contig = sb.contig AND sb.s < pb.e AND pb.s < sb.e")
def interval_intersect(t):
    a, b = _two(t)
    return intervals.intersect(a, b).select("contig", "start", "end", "cust", F.col("b_part").alias("part"))


@query(f"WITH {PTS}, {TILES}, d AS (SELECT DISTINCT pos FROM pts) SELECT pos, (SELECT max(value) FROM tiles WHERE s <= pos AND pos < e) AS value FROM d")
def rate_at_position(t):
    p = points(t).select(F.lit("s").alias("contig"), "pos").distinct()
    return intervals.value_at(p, tiles(t)).select("pos", "value")


@query(f"""WITH {PTS}, a AS (SELECT DISTINCT contig, pos, alt FROM pts WHERE ref = 1), b AS (SELECT DISTINCT contig, pos, alt FROM pts WHERE ref = 2)
SELECT a.contig, a.pos, a.alt, b.pos AS b_pos, b.alt AS b_alt FROM a JOIN b ON a.contig = b.contig AND b.pos BETWEEN a.pos - 1 AND a.pos + 1""")
def band_join_candidates(t):
    p = points(t)
    a, b = (p.where(F.col("ref") == k).select("contig", "pos", "alt").distinct() for k in (1, 2))
    return intervals.band_pairs(a, b, 1).select("contig", "pos", "alt", "b_pos", "b_alt")


@query(f"""WITH {PTS}, {SPANS}, w AS (SELECT DISTINCT s, e FROM spans WHERE contig = '1'), p AS (SELECT DISTINCT pos FROM pts WHERE contig = 'A' AND ref = 1)
SELECT s AS start, e AS \"end\", count(pos) AS n FROM w LEFT JOIN p ON s <= pos AND pos < e GROUP BY s, e""")
def window_variants(t):
    w = spans(t).where("contig = '1'").select(F.lit("x").alias("contig"), "start", "end").distinct()
    p = points(t).where("contig = 'A' and ref = 1").select(F.lit("x").alias("contig"), "pos").distinct()
    n = intervals.points_in(p, w, how="inner", width=64).groupBy(F.col("i_start").alias("start"), F.col("i_end").alias("end")).agg(F.count("*").alias("n"))
    return w.select("start", "end").join(n, ["start", "end"], "left").fillna(0, ["n"])


@query(f"""WITH {PTS}, {SPANS}, w AS (SELECT DISTINCT s, e FROM spans WHERE contig = '2'), p AS (SELECT pos, max(quantity) / 50 AS f FROM pts WHERE contig = 'R' GROUP BY pos)
SELECT s AS start, e AS \"end\", max(f) AS fraction FROM w JOIN p ON s <= pos AND pos < e GROUP BY s, e""")
def window_max_fraction(t):
    w = spans(t).where("contig = '2'").select(F.lit("x").alias("contig"), "start", "end").distinct()
    p = points(t).where("contig = 'R'").groupBy("pos").agg((F.max("quantity") / 50).alias("f")).withColumn("contig", F.lit("x"))
    return intervals.points_in(p, w, how="inner", width=64).groupBy(F.col("i_start").alias("start"), F.col("i_end").alias("end")).agg(F.max("f").alias("fraction"))


# ------------------------------------------------------------------- algebra


@query(f"""WITH {TILES}, {OVER}, {ATOMS}
SELECT a.s AS start, a.e AS \"end\", coalesce((SELECT arg_max(ov.value, ov.ord) FROM ov WHERE ov.s < a.e AND a.s < ov.e), t.value) AS value
FROM atoms a JOIN tiles t ON t.s < a.e AND a.s < t.e""")
def rate_override(t):
    return intervals.override(tiles(t), overrides(t)).select("start", "end", "value")


@query(f"""WITH {TILES}, {OVER}, {ATOMS}
SELECT a.s AS start, a.e AS \"end\", round(t.value * coalesce((SELECT product(ov.value) FROM ov WHERE ov.s < a.e AND a.s < ov.e), 1), 4) AS value
FROM atoms a JOIN tiles t ON t.s < a.e AND a.s < t.e""")
def coverage_product(t):
    return intervals.multiply(tiles(t), overrides(t).drop("ord")).select("start", "end", F.round("value", 4).alias("value"))


@query(f"""WITH {TILES}, holes AS (SELECT DISTINCT s_suppkey * 53 AS p FROM supplier),
cuts AS (SELECT s AS p FROM tiles UNION SELECT e FROM tiles UNION SELECT p FROM holes UNION SELECT p + 1 FROM holes),
atoms AS (SELECT p AS s, lead(p) OVER (ORDER BY p) AS e FROM cuts QUALIFY e IS NOT NULL)
SELECT a.s AS start, a.e AS \"end\", t.value FROM atoms a JOIN tiles t ON t.s < a.e AND a.s < t.e WHERE NOT EXISTS (SELECT 1 FROM holes h WHERE a.s <= h.p AND h.p < a.e)""")
def exclude_points(t):
    holes = t.supplier.select(F.lit("s").alias("contig"), (F.col("s_suppkey") * 53).alias("pos")).distinct()
    return intervals.exclude_points(tiles(t), holes).select("start", "end", "value")


@query("""WITH r AS (SELECT doc_id, n_chars AS len, ceil(n_chars / 700.0)::BIGINT AS n FROM documents WHERE n_chars > 0),
x AS (SELECT doc_id, len, n, unnest(range(n)) AS chunk FROM r)
SELECT doc_id, chunk, chunk * (len // n) + least(chunk, len % n) AS start, chunk * (len // n) + least(chunk, len % n) + len // n + (chunk < len % n)::BIGINT AS \"end\" FROM x""")
def chunk_split(t):
    r = t.documents.select("doc_id", F.lit(0).cast("long").alias("start"), F.col("n_chars").alias("end"))
    return intervals.chunks(r, 700).select("doc_id", "chunk", "start", "end")


@query('SELECT doc_id, unnest(range(0, n_chars, 1000)) AS start, least(start + 1000, n_chars) AS "end" FROM documents WHERE n_chars > 0')
def shard_windows(t):
    return intervals.shards(t.documents.select("doc_id", F.col("n_chars").alias("length")), 1000).select("doc_id", "start", "end")


@query(f"""WITH {SPANS}, ev AS (SELECT contig, p, sum(d) AS d FROM (SELECT contig, s AS p, 1 AS d FROM spans UNION ALL SELECT contig, e, -1 FROM spans) GROUP BY contig, p),
r AS (SELECT contig, p AS s, lead(p) OVER w AS e, sum(d) OVER w AS depth FROM ev WINDOW w AS (PARTITION BY contig ORDER BY p))
SELECT contig, s AS start, e AS \"end\", depth::BIGINT AS depth FROM r WHERE depth > 0""")
def coverage_depth(t):
    return intervals.depth(spans(t))


@query("""SELECT doc_id, k, start, start + length(run) AS \"end\", run LIKE 'N%' AS is_n FROM (
SELECT doc_id, k, run, coalesce(sum(length(run)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM (
SELECT doc_id, unnest(runs) AS run, generate_subscripts(runs, 1) - 1 AS k FROM (
SELECT doc_id, regexp_extract_all(upper(regexp_replace(text, '[^ACGTacgt]', 'N', 'g')), 'N+|[^N]+') AS runs FROM documents)))""")
def n_runs(t):
    s = t.documents.select(F.col("doc_id").alias("contig"), F.upper(F.regexp_replace("text", "[^ACGTacgt]", "N")).alias("seq"))
    from pyspark.sql import Window

    r = intervals.n_runs(s)
    return r.select(F.col("contig").alias("doc_id"), (F.row_number().over(Window.partitionBy("contig").orderBy("start")) - 1).cast("long").alias("k"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "is_n")


@query(f"WITH {BED} SELECT contig, sum(e - s)::BIGINT AS total FROM bed WHERE e - s >= 3 GROUP BY contig")
def region_lengths(t):
    return bed(t).where("end - start >= 3").groupBy("contig").agg(F.sum(F.col("end") - F.col("start")).alias("total"))


_KIND = "['DEL','DUP','CNV','INV','BND'][s_suppkey % 5 + 1]"


def _svs(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in ("DEL", "DUP", "CNV", "INV", "BND")]), (F.col("s_suppkey") % 5 + 1).cast("int"))
    return t.supplier.select(F.col("s_suppkey").alias("id"), kind.alias("kind"), (F.col("s_suppkey") * 37 + 1).alias("pos"), (F.col("s_suppkey") * 37 + 50 + F.col("s_nationkey")).alias("end"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey") % 5).alias("cn"), (F.col("s_nationkey") % 2 == 0).alias("hom"))


_SV = f"sv AS (SELECT s_suppkey AS id, {_KIND} AS kind, s_suppkey * 37 + 1 AS pos, s_suppkey * 37 + 50 + s_nationkey AS e, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey % 5 END AS cn, s_nationkey % 2 = 0 AS hom FROM supplier)"


@query(f"""WITH {_SV} SELECT id, least(greatest(CASE WHEN kind = 'DEL' THEN pos ELSE pos - 1 END, 0), 3000) AS start, least(greatest(e, 0), 3000) AS \"end\",
CASE WHEN cn IS NOT NULL THEN cn / 2.0 WHEN kind = 'DEL' THEN CASE WHEN hom THEN 0 ELSE 0.5 END WHEN kind = 'DUP' THEN CASE WHEN hom THEN 2 ELSE 1.5 END WHEN kind = 'CNV' THEN NULL ELSE 1 END::DOUBLE AS multiplier FROM sv""")
def sv_modulation(t):
    r = V.modulation_range("kind", "pos", "end", F.lit(3000).cast("long"))
    return _svs(t).select("id", r["start"].alias("start"), r["end"].alias("end"), V.copy_multiplier("kind", "cn", "hom").cast("double").alias("multiplier"))


@query(f"WITH {_SV} SELECT id, pos AS p FROM sv WHERE kind IN ('BND','DEL','CNV','INV') UNION ALL SELECT id, e FROM sv WHERE kind = 'INV'")
def junction_points(t):
    return _svs(t).select("id", F.explode(V.junction_points("kind", "pos", "end")).alias("p"))


@query(f"""WITH {_SV}, j AS (
SELECT id, 0 AS k, pos - 29 AS ls, pos AS le, false AS lr, e + 1 AS rs, e + 30 AS re, false AS rr FROM sv WHERE kind = 'DEL'
UNION ALL SELECT id, 0, e - 29, e, false, pos + 1, pos + 30, false FROM sv WHERE kind = 'DUP'
UNION ALL SELECT id, 0, pos - 29, pos, false, e - 29, e, true FROM sv WHERE kind = 'INV'
UNION ALL SELECT id, 1, pos + 1, pos + 30, true, e + 1, e + 30, false FROM sv WHERE kind = 'INV')
SELECT id, k, greatest(ls, 1) AS left_start, le AS left_end, lr AS left_reversed, greatest(rs, 1) AS right_start, re AS right_end, rr AS right_reversed FROM j""")
def junction_pieces(t):
    p = _svs(t).select("id", F.posexplode(V.junction_pieces("kind", "pos", "end", F.lit(30))).alias("k", "j"))
    return p.select("id", "k", *[F.col(f"j.{s}.{c}").alias(f"{s}_{c}") for s in ("left", "right") for c in ("start", "end", "reversed")])


@query(f"""WITH {TILES}, {OVER}, {ATOMS},
o AS (SELECT a.s, a.e, coalesce((SELECT arg_max(ov.value, ov.ord) FROM ov WHERE ov.s < a.e AND a.s < ov.e), t.value) AS value FROM atoms a JOIN tiles t ON t.s < a.e AND a.s < t.e)
SELECT count(*) AS segments, floor(sum((o.e - o.s) * o.value / 1000 * CASE WHEN m.f IS NULL THEN 1 ELSE m.f END))::BIGINT AS expected
FROM o LEFT JOIN (SELECT s, e, value AS f FROM ov WHERE ord = 7) m ON m.s <= o.s AND o.e <= m.e""")
def segment_pipeline(t):
    o = intervals.override(tiles(t), overrides(t))
    m = overrides(t).where("ord = 7").select(F.col("start").alias("ms"), F.col("end").alias("me"), F.col("value").alias("f"))
    # one row by its key
    j = o.join(F.broadcast(m), (F.col("ms") <= F.col("start")) & (F.col("end") <= F.col("me")), "left")
    return j.agg(F.count("*").alias("segments"), F.floor(F.sum((F.col("end") - F.col("start")) * F.col("value") / 1000 * F.coalesce("f", F.lit(1.0)))).alias("expected"))


@query(f"WITH {BED} SELECT floor(sum((e - s) * value / 100000))::BIGINT AS expected FROM bed")
def expected_mutations(t):
    return bed(t).agg(F.floor(F.sum((F.col("end") - F.col("start")) * F.col("value") / 100000)).alias("expected"))


@query("SELECT max(length(p_name) - 1) FILTER (p_size > 25) AS longest FROM part")
def max_span(t):
    return t.part.where("p_size > 25").agg(F.max(F.length("p_name") - 1).cast("long").alias("longest"))


@query("SELECT r.r_name AS contig, coalesce(n.n_name, r.r_name) AS renamed FROM region r LEFT JOIN nation n ON n.n_nationkey = r.r_regionkey AND n.n_nationkey <> 2")
def alias_remap(t):
    alias = t.nation.where("n_nationkey <> 2").join(t.region, F.col("n_nationkey") == F.col("r_regionkey")).select(F.col("r_name").alias("bed_name"), F.col("n_name").alias("reference_name"))
    names = t.region.select(F.col("r_name").alias("old"), F.col("r_name").alias("contig"))
    return compare.rename_contigs(names, alias).select(F.col("old").alias("contig"), F.col("contig").alias("renamed"))


QUERIES, ORACLE_SQL = query.queries, query.sql
