"""Parsing, building and filtering of variant, alignment and read records."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequence as S
from ..functions import variants as V
from ..sources import vcf
from ._registry import Registry

query = Registry()

ALT = "['A','ACG','<DEL:ME>','<DUP>','<CNV>','G]chr2:' || p_partkey || ']','[chr3:' || p_partkey || '[T','.ACG','<INS>','<X>','RY'][(p_partkey % 11)::INT + 1]"


def alleles(t):
    k = F.col("p_partkey")
    alts = F.array(F.lit("A"), F.lit("ACG"), F.lit("<DEL:ME>"), F.lit("<DUP>"), F.lit("<CNV>"), F.concat(F.lit("G]chr2:"), k, F.lit("]")), F.concat(F.lit("[chr3:"), k, F.lit("[T")), F.lit(".ACG"), F.lit("<INS>"), F.lit("<X>"), F.lit("RY"))
    return t.part.select("p_partkey", "p_size", F.when(k % 2 == 0, "A").otherwise("ACC").alias("ref"), F.element_at(alts, (k % 11 + 1).cast("int")).alias("alt"))


_AL = f"al AS (SELECT p_partkey, p_size, CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'ACC' END AS ref, {ALT} AS alt FROM part)"
_LIT = "regexp_full_match(alt, '[ACGTNacgtn]+')"
_SYM = f"""CASE WHEN {_LIT} THEN NULL WHEN regexp_extract(alt, '^<([^:>]+)', 1) IN ('DEL','DUP','CNV','INS','INV','BND') THEN regexp_extract(alt, '^<([^:>]+)', 1)
WHEN regexp_matches(alt, '[\\[\\]][^:]+:[0-9]+[\\[\\]]') OR regexp_full_match(alt, '\\.[ACGTNacgtn]+') OR regexp_full_match(alt, '[ACGTNacgtn]+\\.') THEN 'BND' ELSE 'UNKNOWN' END"""


@query(f"""WITH {_AL} SELECT p_partkey, CASE WHEN {_LIT} THEN CASE WHEN length(ref) = 1 AND length(alt) = 1 THEN 'SNP' WHEN length(ref) = 1 THEN 'INS' WHEN length(alt) = 1 THEN 'DEL' ELSE 'COMPLEX' END END AS kind, {_SYM} AS symbolic FROM al""")
def alt_classify(t):
    return alleles(t).select("p_partkey", V.allele_class("ref", "alt").alias("kind"), V.symbolic_class("alt").alias("symbolic"))


@query(f"""WITH {_AL} SELECT p_partkey, regexp_extract(alt, '[\\[\\]]([^:]+):([0-9]+)[\\[\\]]', 1) AS mate_contig, regexp_extract(alt, '[\\[\\]]([^:]+):([0-9]+)[\\[\\]]', 2)::BIGINT AS mate_pos,
alt NOT LIKE '[%' AND alt NOT LIKE ']%' AS join_after, regexp_extract(alt, '([\\[\\]])', 1) = '[' AS mate_right FROM al WHERE regexp_matches(alt, '[\\[\\]][^:]+:[0-9]+[\\[\\]]')""")
def breakend_parse(t):
    return alleles(t).select("p_partkey", V.breakend("alt").alias("b")).where("b is not null").select("p_partkey", "b.*")


_STYPE = "CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN 'del' WHEN p_size % 4 = 2 THEN 'DUP' ELSE 'BND' END"


@query(f"WITH {_AL}, x AS (SELECT p_partkey, {_STYPE} AS svtype, {_SYM} AS kind FROM al) SELECT p_partkey, coalesce(svtype IS NULL OR kind = 'UNKNOWN' OR upper(svtype) = kind, false) AS agrees FROM x WHERE kind IS NOT NULL")
def svtype_check(t):
    s = F.when(F.col("p_size") % 4 == 1, "del").when(F.col("p_size") % 4 == 2, "DUP").when(F.col("p_size") % 4 == 3, "BND")
    x = alleles(t).select("p_partkey", s.alias("svtype"), V.symbolic_class("alt").alias("kind")).where("kind is not null")
    return x.select("p_partkey", F.coalesce(V.svtype_agrees("svtype", "kind"), F.lit(False)).alias("agrees"))


@query(f"WITH {_AL} SELECT count(*) AS n FROM al WHERE NOT coalesce({_LIT} AND length(ref) > 1 AND length(alt) > 1, false)")
def drop_complex(t):
    return alleles(t).where(F.coalesce(V.allele_class("ref", "alt") != "COMPLEX", F.lit(True))).agg(F.count("*").alias("n"))


_INFO = """i AS (SELECT event_id, event_id % 500 AS pos, concat_ws(';', 'K=' || regexp_extract(props, '([0-9]+)', 1), CASE event_id % 3 WHEN 0 THEN 'END=' || (event_id % 700) WHEN 1 THEN 'END=x' END,
CASE WHEN event_id % 2 = 0 THEN 'SVLEN=-' || (event_id % 90) END, 'FLAG', 'SVTYPE=' || upper(substr(event_type, 1, 3)), CASE WHEN event_id % 5 = 0 THEN 'AF=' || (event_id % 7) / 4.0 END) AS info FROM events)"""


def infos(t):
    e = F.col("event_id")
    parts = [
        F.concat(F.lit("K="), F.regexp_extract("props", "([0-9]+)", 1)),
        F.when(e % 3 == 0, F.concat(F.lit("END="), e % 700)).when(e % 3 == 1, "END=x"),
        F.when(e % 2 == 0, F.concat(F.lit("SVLEN=-"), e % 90)), F.lit("FLAG"), F.concat(F.lit("SVTYPE="), F.upper(F.substring("event_type", 1, 3))),
        F.when(e % 5 == 0, F.concat(F.lit("AF="), (e % 7) / F.lit(4.0))),
    ]
    return t.events.select("event_id", (e % 500).alias("pos"), F.concat_ws(";", *parts).alias("info"))


_GET = "nullif(regexp_extract(info, '(?:^|;){k}=([^;]*)', 1), '')"


@query(f"""WITH {_INFO}, f AS (SELECT event_id, pos, TRY_CAST({_GET.format(k='END')} AS BIGINT) AS e, TRY_CAST({_GET.format(k='SVLEN')} AS BIGINT) AS svlen, {_GET.format(k='SVTYPE')} AS svtype FROM i),
g AS (SELECT event_id, pos, CASE WHEN e >= pos THEN e END AS e, svlen, svtype FROM f)
SELECT event_id, e AS \"end\", svlen, svtype, CASE WHEN svtype = 'INS' THEN abs(svlen) ELSE coalesce(e - pos + 1, abs(svlen)) END AS span FROM g""")
def info_parse(t):
    x = infos(t).select("event_id", "pos", V.info_fields("info", "pos").alias("f"))
    return x.select("event_id", "f.end", "f.svlen", "f.svtype", V.sv_span("f.svtype", "pos", "f.end", "f.svlen").alias("span"))


_GT = """g AS (SELECT o_orderkey, ['0/1','1|1','./1','0|0','1/2','.'][(o_orderkey % 6)::INT + 1] AS gt, CASE WHEN o_custkey % 3 = 0 THEN 'AF=' || (o_custkey % 9) / 8.0 ELSE 'DP=3' END AS info, (o_custkey % 11) || ',' || (o_orderkey % 13) AS ad FROM orders)"""


def genotypes(t):
    gts = F.array(*[F.lit(x) for x in ("0/1", "1|1", "./1", "0|0", "1/2", ".")])
    return t.orders.select("o_orderkey", F.element_at(gts, (F.col("o_orderkey") % 6 + 1).cast("int")).alias("gt"), F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("AF="), (F.col("o_custkey") % 9) / F.lit(8.0))).otherwise("DP=3").alias("info"), F.concat(F.col("o_custkey") % 11, F.lit(","), F.col("o_orderkey") % 13).alias("ad"))


_AF_INFO = "TRY_CAST(nullif(regexp_extract(info, '(?:^|;)AF=([^;,]*)', 1), '') AS DOUBLE)"
_AF_AD = "split_part(ad, ',', 2)::DOUBLE / nullif(split_part(ad, ',', 1)::DOUBLE + split_part(ad, ',', 2)::DOUBLE, 0)"


@query(f"WITH {_GT} SELECT o_orderkey, CASE WHEN gt LIKE '%0%' THEN 'HET' ELSE 'HOM' END AS genotype, round(CASE WHEN coalesce({_AF_INFO}, {_AF_AD}) > 0 THEN least(coalesce({_AF_INFO}, {_AF_AD}), 1) END, 9) AS af FROM g")
def genotype_af(t):
    return genotypes(t).select("o_orderkey", V.genotype_label("gt").alias("genotype"), F.round(V.allele_fraction("info", "ad"), 9).alias("af"))


@query(f"WITH {_GT} SELECT o_orderkey, round(CASE WHEN coalesce({_AF_AD}, {_AF_INFO}) > 0 THEN least(coalesce({_AF_AD}, {_AF_INFO}), 1) END, 9) AS af FROM g")
def af_precedence(t):
    return genotypes(t).select("o_orderkey", F.round(V.allele_fraction("info", "ad", ("ad", "info")), 9).alias("af"))


@query(f"WITH {_GT} SELECT o_orderkey, CASE WHEN gt LIKE '%0%' THEN '0/0/1' ELSE '1/1/1' END AS gt FROM g")
def genotype_build(t):
    return genotypes(t).select("o_orderkey", V.genotype_text(V.genotype_label("gt"), 3).alias("gt"))


@query("SELECT l_orderkey, l_linenumber, l_suppkey, CASE WHEN x IN ('', '.') THEN 'R=1' ELSE x || ';R=1' END AS info FROM (SELECT *, ['','.','DP=' || l_suppkey][(l_suppkey % 3)::INT + 1] AS x FROM lineitem)")
def info_append(t):
    x = F.element_at(F.array(F.lit(""), F.lit("."), F.concat(F.lit("DP="), "l_suppkey")), (F.col("l_suppkey") % 3 + 1).cast("int"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_suppkey", V.append_info(x, F.lit("R=1")).alias("info"))


@query("SELECT s_suppkey, concat_ws(';', 'SVTYPE=DUP', 'END=' || CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey END, 'SVLEN=' || s_nationkey, 'CN=' || CASE WHEN s_suppkey % 3 = 0 THEN 4 END) AS info FROM supplier")
def sv_info_build(t):
    k = F.col("s_suppkey")
    return t.supplier.select("s_suppkey", V.sv_info(F.lit("DUP"), F.when(k % 2 == 0, k), "s_nationkey", F.when(k % 3 == 0, 4)).alias("info"))


_NAME = "['chr1','CHR2','x','MT','Chry','10','un_1'][(n_nationkey % 7)::INT + 1]"


@query(f"""WITH n AS (SELECT n_nationkey, upper(regexp_replace({_NAME}, '^chr', '', 'i')) AS b FROM nation), c AS (SELECT n_nationkey, 'chr' || CASE WHEN b = 'MT' THEN 'M' ELSE b END AS chrom FROM n)
SELECT n_nationkey, chrom, CASE WHEN regexp_full_match(chrom, 'chr[0-9]+') THEN substr(chrom, 4)::INT WHEN chrom = 'chrX' THEN 1001 WHEN chrom = 'chrY' THEN 1002 WHEN chrom = 'chrM' THEN 1003 ELSE 2000 END AS place FROM c""")
def chrom_normalise(t):
    names = F.element_at(F.array(*[F.lit(x) for x in ("chr1", "CHR2", "x", "MT", "Chry", "10", "un_1")]), F.col("n_nationkey") % 7 + 1)
    c = t.nation.select("n_nationkey", V.chromosome(names).alias("chrom"))
    return c.select("n_nationkey", "chrom", V.chromosome_order("chrom").alias("place"))


@query(f"""WITH n AS (SELECT DISTINCT upper(regexp_replace({_NAME}, '^chr', '', 'i')) AS b FROM nation), c AS (SELECT 'chr' || CASE WHEN b = 'MT' THEN 'M' ELSE b END AS chrom FROM n)
SELECT chrom, row_number() OVER (ORDER BY CASE WHEN regexp_full_match(chrom, 'chr[0-9]+') THEN substr(chrom, 4)::INT WHEN chrom = 'chrX' THEN 1001 WHEN chrom = 'chrY' THEN 1002 WHEN chrom = 'chrM' THEN 1003 ELSE 2000 END, chrom) AS rank FROM c""")
def natural_order(t):
    from pyspark.sql import Window

    c = chrom_normalise(t).select("chrom", "place").distinct()
    # a dimension of contigs
    return c.select("chrom", F.row_number().over(Window.orderBy("place", "chrom")).cast("long").alias("rank"))


@query("SELECT substr('ACDEFGHIKLMNPQRSTVWY', n_nationkey % 20 + 1, 1) AS code, any_value(['Alanine','Cysteine','Aspartic acid','Glutamic acid','Phenylalanine','Glycine','Histidine','Isoleucine','Lysine','Leucine','Methionine','Asparagine','Proline','Glutamine','Arginine','Serine','Threonine','Valine','Tryptophan','Tyrosine'][n_nationkey % 20 + 1]) AS name, count(r_name) AS regions FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1")
def code_lookup(t):
    n = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    code = F.substr(F.lit("ACDEFGHIKLMNPQRSTVWY"), F.col("n_nationkey") % 20 + 1, F.lit(1))
    return n.groupBy(code.alias("code")).agg(F.count("r_name").alias("regions")).select("code", S.amino_acid("code").alias("name"), "regions")


@query("SELECT o_orderkey, n, regexp_extract(n, '^@?[A-Za-z]+_generated_(.+)_([0-9]+)_([0-9]+)_([0-9a-f]+)(?:/[0-9])?$', 1) AS contig, o_orderkey AS start, o_orderkey + o_custkey AS \"end\" FROM (SELECT *, printf('SIM_generated_chr_%d_%010d_%010d_%016x/1', o_custkey % 5, o_orderkey, o_orderkey + o_custkey, o_orderkey * 31) AS n FROM orders)")
def read_name_parse(t):
    n = F.concat(S.read_name("SIM_generated", F.concat(F.lit("chr_"), F.col("o_custkey") % 5), "o_orderkey", F.col("o_orderkey") + F.col("o_custkey"), F.col("o_orderkey") * 31), F.lit("/1"))
    x = t.orders.select("o_orderkey", n.alias("n"))
    return x.select("o_orderkey", "n", S.parse_read_name("n").alias("r")).select("o_orderkey", "n", "r.*")


_FLAG = "(CASE WHEN l_linenumber % 2 = 0 THEN 99 ELSE 147 END + CASE WHEN l_suppkey % 10 = 0 THEN 1024 ELSE 0 END + CASE WHEN l_suppkey % 7 = 0 THEN 8 ELSE 0 END)"


@query(f"SELECT count(*) AS seen, count(*) FILTER ({_FLAG} & 3844 = 0 AND {_FLAG} & 65 = 65 AND {_FLAG} & 8 = 0 AND l_quantity > 10) AS kept FROM lineitem")
def walk_stats(t):
    ok = V.alignment_filter("fragment", "flag", "mapq", "l_returnflag", "l_returnflag")
    return _reads(t).agg(F.count("*").alias("seen"), F.count_if(ok).alias("kept"))


def _reads(t):
    flag = F.when(F.col("l_linenumber") % 2 == 0, 99).otherwise(147) + F.when(F.col("l_suppkey") % 10 == 0, 1024).otherwise(0) + F.when(F.col("l_suppkey") % 7 == 0, 8).otherwise(0)
    return t.lineitem.withColumn("flag", flag).withColumn("mapq", F.col("l_quantity"))


@query(f"SELECT l_returnflag, count(*) AS n FROM lineitem WHERE {_FLAG} & 3844 = 0 AND l_quantity > 10 GROUP BY l_returnflag")
def flag_filter(t):
    return _reads(t).where(V.alignment_filter("bases")).groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query("SELECT l_linenumber, count(*) AS n, any_value(CASE WHEN l_linenumber > 6 THEN CASE WHEN l_linenumber % 2 = 0 THEN 16 ELSE 0 END ELSE 3 + CASE WHEN l_linenumber % 2 = 0 THEN 16 ELSE 32 END + CASE WHEN l_linenumber % 3 = 0 THEN 64 ELSE 128 END END) AS flag FROM lineitem GROUP BY l_linenumber")
def flag_build(t):
    k = F.col("l_linenumber")
    return t.lineitem.groupBy("l_linenumber").agg(F.count("*").alias("n")).withColumn("flag", V.flags(k <= 6, k % 2 == 0, k % 3 == 0))


@query("SELECT o_orderstatus, abs(o_custkey - 700) AS tlen, count(*) AS n FROM orders WHERE o_custkey <> 700 GROUP BY 1, 2")
def tlen_filter(t):
    x = t.orders.select("o_orderstatus", V.template_length(F.col("o_custkey") - 700).alias("tlen")).where("tlen is not null")
    return x.groupBy("o_orderstatus", "tlen").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, CASE WHEN p_size * (p_retailprice / 1000 - 1) <= 0 THEN 0 ELSE round(p_size * (p_retailprice / 1000 - 1)) END::BIGINT AS coverage FROM part")
def scale_coverage(t):
    return t.part.select("p_partkey", V.scale_coverage("p_size", F.col("p_retailprice") / 1000 - 1).alias("coverage"))


@query("""SELECT concat_ws(chr(9), l_returnflag, l_orderkey + 1, '.', 'A', 'C', 37, 'PASS', CASE WHEN l_tax > 0.04 THEN 'ORIGIN=denovo' ELSE 'ORIGIN=input' END, 'GT:AD:DP:AF',
'0/1:' || l_linenumber || ',' || l_suppkey || ':' || (l_linenumber + l_suppkey) || ':' || printf('%.4f', l_suppkey / (l_linenumber + l_suppkey)::DOUBLE)) AS line
FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY l_linenumber, l_suppkey, l_tax, l_extendedprice) AS k FROM lineitem) WHERE k = 1""")
def vcf_lines(t):
    from pyspark.sql import Window

    w = Window.partitionBy("l_returnflag", "l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_tax", "l_extendedprice")
    x = t.lineitem.withColumn("k", F.row_number().over(w)).where("k = 1")
    v = x.select(F.col("l_returnflag").alias("contig"), F.col("l_orderkey").alias("location"), F.lit("A").alias("ref"), F.lit("C").alias("alt"), F.lit("0/1").alias("gt"), F.when(F.col("l_tax") > 0.04, "denovo").otherwise("input").alias("provenance"), F.col("l_linenumber").alias("ref_count"), F.col("l_suppkey").alias("alt_count"))
    return v.select(vcf.truth_line().alias("line"))


@query("SELECT '@r' || doc_id || chr(10) || s || chr(10) || '+' || chr(10) || repeat('I', length(s)) AS record FROM (SELECT doc_id, regexp_replace(upper(text), '[^ACGTN]', '', 'g') AS s FROM documents)")
def fastq_lines(t):
    s = t.documents.select("doc_id", F.regexp_replace(F.upper("text"), "[^ACGTN]", "").alias("s"))
    return s.select(F.concat_ws("\n", F.concat(F.lit("@r"), "doc_id"), "s", F.lit("+"), F.repeat(S.phred_char(F.lit(40)), F.length("s"))).alias("record"))


@query("SELECT concat_ws(chr(9), l_returnflag, l_orderkey, l_linenumber, CASE WHEN l_suppkey % 2 = 0 THEN 'DP=1;REASON=outside_mutation_bed' ELSE 'REASON=outside_mutation_bed' END) AS line FROM lineitem")
def annotated_lines(t):
    info = V.append_info(F.when(F.col("l_suppkey") % 2 == 0, "DP=1").otherwise("."), F.lit("REASON=outside_mutation_bed"))
    return t.lineitem.select(F.concat_ws("\t", "l_returnflag", "l_orderkey", "l_linenumber", info).alias("line"))


_LINE = """v AS (SELECT l_orderkey, l_linenumber, l_suppkey, concat_ws(chr(9), l_returnflag, l_orderkey, '.', 'A', ['C','AT','<DEL>','C,G'][(l_suppkey % 4)::INT + 1], CASE WHEN l_suppkey % 3 = 0 THEN '.' ELSE l_suppkey::VARCHAR END, 'PASS', 'SVTYPE=DEL;END=' || (l_orderkey + 9), CASE WHEN l_linenumber % 2 = 0 THEN 'GT:DP' ELSE 'DP' END, CASE WHEN l_linenumber % 2 = 0 THEN '1/1:7' ELSE '7' END) AS line FROM lineitem)"""


def vcf_text(t):
    k = F.col("l_suppkey")
    alt = F.element_at(F.array(*[F.lit(x) for x in ("C", "AT", "<DEL>", "C,G")]), (k % 4 + 1).cast("int"))
    even = F.col("l_linenumber") % 2 == 0
    return t.lineitem.select(F.concat_ws("\t", "l_returnflag", "l_orderkey", F.lit("."), F.lit("A"), alt, F.when(k % 3 == 0, ".").otherwise(k.cast("string")), F.lit("PASS"), F.concat(F.lit("SVTYPE=DEL;END="), F.col("l_orderkey") + 9), F.when(even, "GT:DP").otherwise("DP"), F.when(even, "1/1:7").otherwise("7")).alias("value"))


@query(f"""WITH {_LINE}, c AS (SELECT string_split(line, chr(9)) AS f FROM v)
SELECT f[1] AS contig, f[2]::BIGINT AS pos, f[5] AS alt, coalesce(TRY_CAST(f[6] AS INT), 0) AS qual, CASE WHEN f[9] LIKE 'GT%' THEN '1/1' ELSE '0/1' END AS gt,
CASE f[5] WHEN 'C' THEN 'SNP' WHEN 'AT' THEN 'INS' ELSE 'DEL' END AS vtype, f[5] = '<DEL>' AS is_symbolic, f[2]::BIGINT + 9 AS \"end\" FROM c WHERE f[5] NOT LIKE '%,%'""")
def vcf_parse_full(t):
    v = vcf.parse(vcf_text(t))
    return v.select("contig", "pos", "alt", "qual", "gt", F.coalesce("vtype", F.col("sv.sv_type")).alias("vtype"), "is_symbolic", F.coalesce("sv.end", F.col("pos") + 9).alias("end"))


@query(f"""WITH {_LINE}, c AS (SELECT string_split(line, chr(9)) AS f FROM v) SELECT f[1] AS contig, f[2]::BIGINT AS pos, f[4] AS ref, f[5] AS alt, CASE WHEN f[9] LIKE 'GT%' THEN '1/1' ELSE '0/1' END AS gt FROM c WHERE f[5] NOT LIKE '%,%'""")
def vcf_parse_lean(t):
    return vcf.parse(vcf_text(t)).select("contig", "pos", "ref", "alt", "gt")


@query("SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size / 8.0 END AS mut_rate FROM part")
def bed_attribute(t):
    from ..sources import bed

    line = F.concat_ws("\t", F.lit("c"), F.col("p_partkey"), F.col("p_partkey") + 5, F.when(F.col("p_size") % 3 == 0, "mut_rate=oops").when(F.col("p_size") % 3 == 1, F.concat(F.lit("x;MUT_RATE="), F.col("p_size") / F.lit(8.0), F.lit(";y"))).otherwise(F.concat(F.lit("mut_rate="), F.col("p_size") / F.lit(8.0))))
    b = bed.parse(t.part.select(line.alias("value")))
    return b.select(F.col("start").alias("p_partkey"), "mut_rate")


@query("SELECT n_nationkey::VARCHAR AS bed_name, 'chr' || n_nationkey AS reference_name FROM nation WHERE n_nationkey % 5 <> 0")
def alias_parse(t):
    from ..sources import tables

    k = F.col("n_nationkey")
    line = F.when(k % 10 == 0, "# note").when(k % 5 == 0, "  ").otherwise(F.concat(k, F.lit("\t"), F.lit("chr"), k))
    return tables.parse_aliases(t.nation.select(line.alias("value")))


@query("SELECT r_name AS id FROM region WHERE NOT EXISTS (SELECT 1 FROM nation WHERE n_nationkey = r_regionkey + 22) UNION ALL SELECT n_name FROM nation")
def header_merge(t):
    have = t.nation
    new = t.region.join(have, F.col("n_nationkey") == F.col("r_regionkey") + 22, "left_anti")
    return new.select(F.col("r_name").alias("id")).unionByName(have.select(F.col("n_name").alias("id")))


@query("SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 25")
def first_n_reads(t):
    return t.documents.select("doc_id", "text").orderBy("doc_id").limit(25)


QUERIES, ORACLE_SQL = query.queries, query.sql
