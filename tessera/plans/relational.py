"""Queries over filters, joins, validation and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.operators import numbering
from tessera.operators import relational as r
from tessera.plans import views as v
from tessera.plans.registry import query
from tessera.session import table


@query("cohort_filter_reasons", 47, 48, sql="""
WITH c AS (SELECT c_custkey, c_nationkey, c_acctbal, c_mktsegment, EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey) AS ordered FROM customer)
SELECT CASE WHEN c_acctbal < 0 THEN 'negative' WHEN c_nationkey IN (1, 2, 3) THEN 'excluded' WHEN NOT ordered THEN 'no_orders'
  WHEN c_mktsegment = 'MACHINERY' THEN 'segment' ELSE 'retained' END AS reason, count(*) AS n FROM c GROUP BY 1""")
def cohort_filter_reasons(spark: SparkSession, sf: str) -> DataFrame:
    customer, orders = table(spark, sf, "customer"), table(spark, sf, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct().withColumn("ordered", F.lit(True))
    rules = [("negative", F.col("c_acctbal") < 0), ("excluded", F.col("c_nationkey").isin(1, 2, 3)), ("no_orders", F.col("ordered").isNull()), ("segment", F.col("c_mktsegment") == "MACHINERY")]
    return r.reason_counts(customer.join(orders, "c_custkey", "left"), rules)


@query("last_key_wins", 3, 7, 29, sql="""
SELECT o_custkey, o_orderkey, coalesce(nullif(trim(o_orderpriority), ''), 'NA') AS priority
FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) = 1""")
def last_key_wins(spark: SparkSession, sf: str) -> DataFrame:
    last = r.one_of_key(table(spark, sf, "orders"), ["o_custkey"], [F.desc("o_orderkey")])
    return last.select("o_custkey", "o_orderkey", F.coalesce(F.nullif(F.trim("o_orderpriority"), F.lit("")), F.lit("NA")).alias("priority"))


@query("first_key_wins", 28, sql="""
SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""")
def first_key_wins(spark: SparkSession, sf: str) -> DataFrame:
    return r.one_of_key(table(spark, sf, "orders"), ["o_custkey"], [F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("free_text_edges", 11, 24, sql=r"""
WITH t AS (SELECT regexp_extract_all(text, '[a-z]{4,5}') AS w FROM documents),
p AS (SELECT unnest(list_zip(w[:-2], w[2:])) AS z FROM t WHERE len(w) > 1)
SELECT DISTINCT least(z[1], z[2]) AS a, greatest(z[1], z[2]) AS b FROM p WHERE z[1] <> z[2]""")
def free_text_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Edges of all whole texts: each id is linked to the next one of its text, which connects what all pairs would."""
    ids = table(spark, sf, "documents").select(F.expr(r"regexp_extract_all(text, '([a-z]{4,5})', 1)").alias("w")).where("size(w) > 1")
    pairs = ids.select(F.explode(F.arrays_zip(F.expr("slice(w, 1, size(w) - 1)").alias("x"), F.expr("slice(w, 2, size(w) - 1)").alias("y"))).alias("p"))
    return pairs.where("p.x <> p.y").select(F.least("p.x", "p.y").alias("a"), F.greatest("p.x", "p.y").alias("b")).distinct()


@query("flag_codes", 49, 50, 105, 106, sql="""
WITH u AS (SELECT 'nation' AS col, CAST(c_nationkey AS DOUBLE) AS x FROM customer UNION ALL SELECT 'thousands', floor(c_acctbal / 1000)
  FROM customer),
h AS (SELECT col, CAST(CAST(x AS BIGINT) AS VARCHAR) AS code, CASE WHEN x < 0 THEN 'below' WHEN x > 0 THEN 'above' ELSE 'NA' END AS sign, count(*) AS n
  FROM u GROUP BY ALL)
SELECT col, code, sign, n, round(n / sum(n) OVER (PARTITION BY col), 9) AS share FROM h""")
def flag_codes(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "customer").select(F.col("c_nationkey").cast("string").alias("nation"), F.floor(F.col("c_acctbal") / 1000).cast("double").cast("string").alias("thousands"))
    long = wide.unpivot([], ["nation", "thousands"], "col", "text")
    code = values.flag_code(F.col("text"))
    counts = long.select("col", code.alias("code"), values.sign_class(values.number(F.col("text")), "below", "above").alias("sign")).groupBy("col", "code", "sign").agg(F.count("*").alias("n"))
    return counts.select("*", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("col")), 9).alias("share"))


@query("truth_and_xor", 51, sql="""
SELECT count(*) FILTER (WHERE (l_returnflag = 'R') <> (l_linestatus = 'F')) AS exactly_one, count(*) FILTER (WHERE l_returnflag = 'R') AS returned
  FROM lineitem""")
def truth_and_xor(spark: SparkSession, sf: str) -> DataFrame:
    told = table(spark, sf, "lineitem").select(F.when(F.col("l_returnflag") == "R", " TRUE").otherwise("no").alias("a"), F.when(F.col("l_linestatus") == "F", "True").otherwise(None).alias("b"))
    a, b = values.truth(F.col("a")), values.truth(F.col("b"))
    return told.agg(F.count_if(values.exactly_one(a, b)).alias("exactly_one"), F.count_if(a).alias("returned"))


@query("region_exclusion", 52, views="variant", sql="""
SELECT variant, chrom, pos FROM variant WHERE NOT ((chrom = 'chr1' AND pos BETWEEN 100000 AND 900000) OR (chrom = 'chr3' AND pos BETWEEN 1200000 AND 1500000))""")
def region_exclusion(spark: SparkSession, sf: str) -> DataFrame:
    out = r.in_any_region(F.col("chrom"), F.col("pos"), [("chr1", 100_000, 900_000), ("chr3", 1_200_000, 1_500_000)])
    return v.variant(spark, sf).where(~out).select("variant", "chrom", "pos")


@query("biallelic_sites", 53, 15, views="variant", sql="""
SELECT chrom, count(*) AS sites, count(*) FILTER (WHERE length(ref) = 1 AND length(alt) = 1) AS biallelic, min(pos) AS first, max(pos) AS last
  FROM variant GROUP BY chrom""")
def biallelic_sites(spark: SparkSession, sf: str) -> DataFrame:
    single = values.single_base(F.col("ref"), F.col("alt"))
    return v.variant(spark, sf).groupBy("chrom").agg(F.count("*").alias("sites"), F.count_if(single).alias("biallelic"), F.min("pos").alias("first"), F.max("pos").alias("last"))


@query("dosage_decode", 54, 231, sql="""
WITH a AS (SELECT l_linenumber % 3 AS x, CAST(l_quantity AS BIGINT) % 2 AS y FROM lineitem),
d AS (SELECT CASE WHEN x IN (0, 1) AND y IN (0, 1) THEN x + y END AS dosage FROM a)
SELECT CAST(dosage AS BIGINT) AS dosage, CASE WHEN dosage IS NULL THEN 'missing' WHEN dosage = 0 THEN 'ref' WHEN dosage = 1 THEN 'het' ELSE 'alt' END AS token, count(*) AS n
  FROM d GROUP BY ALL""")
def dosage_decode(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "lineitem").select(values.dosage_of((F.col("l_linenumber") % 3).cast("bigint"), F.col("l_quantity").cast("bigint") % 2).alias("dosage"))
    token = F.when(F.col("dosage").isNull(), "missing").when(F.col("dosage") == 0, "ref").when(F.col("dosage") == 1, "het").otherwise("alt")
    return d.select("dosage", token.alias("token")).groupBy("dosage", "token").agg(F.count("*").alias("n"))


@query("manifest_violations", 59, 60, 62, 67, 69, 212, views="genotype sample", sql="""
WITH t AS (SELECT 'missing_dosage' AS check, CAST(variant AS VARCHAR) AS key FROM genotype
  GROUP BY variant HAVING count(*) FILTER (WHERE dosage IS NULL) > 3
UNION ALL SELECT 'unknown_sample', CAST(g.sample AS VARCHAR) FROM (SELECT DISTINCT sample FROM genotype) g ANTI JOIN sample s USING (sample)
UNION ALL SELECT 'stratum_crosses_splits', stratum FROM sample GROUP BY stratum HAVING count(DISTINCT split) > 1
UNION ALL SELECT 'stratum_size', stratum FROM sample GROUP BY stratum HAVING count(*) <> 4)
SELECT * FROM t""")
def manifest_violations(spark: SparkSession, sf: str) -> DataFrame:
    g, s = v.genotype(spark, sf), v.sample(spark, sf)
    found = [
        g.groupBy("variant").agg(F.count_if(F.col("dosage").isNull()).alias("n")).where("n > 3").select(F.lit("missing_dosage").alias("check"), F.col("variant").cast("string").alias("key")),
        g.select("sample").distinct().join(s, "sample", "left_anti").select(F.lit("unknown_sample").alias("check"), F.col("sample").cast("string").alias("key")),
        r.crossing_groups(s, "stratum", "split").select(F.lit("stratum_crosses_splits").alias("check"), F.col("stratum").alias("key")),
        s.groupBy("stratum").count().where("count <> 4").select(F.lit("stratum_size").alias("check"), F.col("stratum").alias("key")),
    ]
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


@query("grid_completeness", 64, sql="""
WITH g AS (SELECT c.c_mktsegment, r.c_nationkey FROM (SELECT DISTINCT c_mktsegment FROM customer) c, (SELECT DISTINCT c_nationkey FROM customer) r)
SELECT g.* FROM g ANTI JOIN (SELECT DISTINCT c_mktsegment, c_nationkey FROM customer WHERE c_acctbal > 8000) o USING (c_mktsegment, c_nationkey)""")
def grid_completeness(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    return r.missing_cells(c.where("c_acctbal > 8000"), {"c_mktsegment": c, "c_nationkey": c})


@query("keyed_update", 79, sql="""
SELECT c_custkey, coalesce(p.seg, c_mktsegment) AS c_mktsegment, CASE WHEN p.c IS NULL THEN c_acctbal ELSE p.bal END AS c_acctbal
FROM customer LEFT JOIN (SELECT o_custkey AS c, 'ORDERED' AS seg, CAST(count(*) AS DOUBLE) AS bal FROM orders GROUP BY o_custkey) p ON p.c = c_custkey""")
def keyed_update(spark: SparkSession, sf: str) -> DataFrame:
    patch = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.lit("ORDERED").alias("c_mktsegment"), F.count("*").cast("double").alias("c_acctbal"))
    return r.updated(table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), patch, "c_custkey")


@query("p_on_grid", 80, sql="""
SELECT o_orderkey, round((o_orderkey % 1000) / 1000.0, 6) = 0 OR false AS zero, (o_orderkey % 1000) > 0 AS on_grid FROM orders""")
def p_on_grid(spark: SparkSession, sf: str) -> DataFrame:
    return _on_grid(table(spark, sf, "orders"))


def _on_grid(orders: DataFrame) -> DataFrame:
    p = (F.col("o_orderkey") % 1000) / 1000.0
    return orders.select("o_orderkey", (p == 0).alias("zero"), values.on_grid(p, 999).alias("on_grid"))


@query("counted_left_join", 81, sql="""
WITH j AS (SELECT o_orderkey, c_custkey, n_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON o_custkey = c_custkey LEFT
  JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON n_nationkey = c_nationkey)
SELECT CASE WHEN c_custkey IS NULL THEN 'no_customer' WHEN n_name IS NULL THEN 'no_nation' ELSE 'retained' END AS reason, count(*) AS n FROM j
  GROUP BY 1""")
def counted_left_join(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", F.lit(1).alias("known"))
    n = table(spark, sf, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    joined = table(spark, sf, "orders").select("o_custkey").join(c, "o_custkey", "left").join(n, "c_nationkey", "left")
    return r.reason_counts(joined, [("no_customer", F.col("known").isNull()), ("no_nation", F.col("n_name").isNull())])


@query("key_overlap", 82, 213, 215, sql="""
WITH a AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 200000), b AS (SELECT DISTINCT c_custkey AS k
  FROM customer WHERE c_acctbal > 0)
SELECT count(*) FILTER (WHERE b.k IS NULL) AS only_a, count(*) FILTER (WHERE a.k IS NOT NULL AND b.k IS NOT NULL) AS both, count(*) FILTER (WHERE a.k IS NULL) AS only_b
  FROM a FULL JOIN b ON a.k = b.k""")
def key_overlap(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("k"))
    return r.overlap_counts(a, table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")), "k")


@query("composite_join_checks", 83, 90, sql="""
WITH a AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity > 45), b AS (SELECT l_partkey, l_suppkey FROM lineitem WHERE l_quantity < 25)
SELECT l_partkey, l_suppkey, 'repeated' AS violation FROM b GROUP BY ALL HAVING count(*) > 1
UNION ALL SELECT a.l_partkey, a.l_suppkey, 'missing' FROM a ANTI JOIN b USING (l_partkey, l_suppkey)""")
def composite_join_checks(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").select("l_partkey", "l_suppkey", "l_quantity")
    return r.checked_join(line.where("l_quantity > 45").drop("l_quantity"), line.where("l_quantity < 25").drop("l_quantity"), ["l_partkey", "l_suppkey"])[1]


@query("exact_key_semi_join", 91, 158, views="genotype", sql="""
SELECT sample, count(*) AS n, CAST(sum(dosage) AS BIGINT) AS dosage FROM genotype WHERE variant IN (SELECT p_partkey
  FROM part WHERE p_size < 10) AND sample IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0) GROUP BY sample""")
def exact_key_semi_join(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("variant"))
    samples = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("sample"))
    return v.genotype(spark, sf).join(parts, "variant", "left_semi").join(samples, "sample", "left_semi").groupBy("sample").agg(F.count("*").alias("n"), F.sum("dosage").alias("dosage"))


@query("schema_union", 43, 217, sql="""
SELECT CAST(c_custkey AS VARCHAR) AS id, coalesce(c_mktsegment, '') AS segment, '' AS size FROM customer
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), '', CAST(p_size AS VARCHAR) FROM part""")
def schema_union(spark: SparkSession, sf: str) -> DataFrame:
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment"))
    return r.union_with_blanks([a, table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_size").alias("size"))])


@query("split_summary", 44, 107, views="sample", sql="""
SELECT coalesce(stratum, 'ALL') AS stratum, split, count(*) AS n FROM sample GROUP BY GROUPING SETS ((stratum, split), (split))""")
def split_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = v.sample(spark, sf)
    return s.groupingSets([[F.col("stratum"), F.col("split")], [F.col("split")]], "stratum", "split").agg(F.count("*").alias("n")).select(F.coalesce("stratum", F.lit("ALL")).alias("stratum"), "split", "n")


@query("group_derangement", 95, sql="""
WITH o AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n
  FROM supplier)
SELECT a.s_suppkey, b.s_suppkey AS donor FROM o a JOIN o b ON a.s_nationkey = b.s_nationkey AND b.i = (a.i + a.n - 2) % a.n + 1 WHERE a.n > 1""")
def group_derangement(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    donor = F.coalesce(F.lag("s_suppkey").over(w), F.last("s_suppkey").over(whole))
    return table(spark, sf, "supplier").select("s_suppkey", donor.alias("donor")).where("donor <> s_suppkey")


@query("metadata_reconciliation", 94, sql="""
SELECT c_custkey, coalesce(nullif(c_mktsegment, ''), CAST(c_custkey AS VARCHAR)) AS family, n_regionkey = r_regionkey AND c_nationkey = n_nationkey AS agrees
FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""")
def metadata_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    return _reconciled(table(spark, sf, "customer"), table(spark, sf, "nation"), table(spark, sf, "region"))


def _reconciled(c: DataFrame, n: DataFrame, g: DataFrame) -> DataFrame:
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(g, n.n_regionkey == g.r_regionkey)
    return joined.select("c_custkey", F.coalesce(F.nullif("c_mktsegment", F.lit("")), F.col("c_custkey").cast("string")).alias("family"), ((F.col("n_regionkey") == F.col("r_regionkey")) & (F.col("c_nationkey") == F.col("n_nationkey"))).alias("agrees"))


@query("duplicate_positions", 115, 116, views="variant", sql="""
SELECT chrom, pos // 4000 AS slot, count(*) AS n FROM variant GROUP BY ALL HAVING count(*) > 1""")
def duplicate_positions(spark: SparkSession, sf: str) -> DataFrame:
    return v.variant(spark, sf).groupBy("chrom", F.floor(F.col("pos") / 4000).alias("slot")).agg(F.count("*").alias("n")).where("n > 1")


@query("field_presence", 155, 26, sql="""
WITH f AS (SELECT event_type, user_id, 'k' || CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 10 AS VARCHAR) AS field FROM events)
SELECT event_type, field, array_to_string(list_slice(list_sort(list(DISTINCT user_id)), 1, 6), ',') AS first_six, count(DISTINCT user_id) AS holders
  FROM f GROUP BY ALL""")
def field_presence(spark: SparkSession, sf: str) -> DataFrame:
    f = table(spark, sf, "events").select("event_type", "user_id", F.concat(F.lit("k"), (F.get_json_object("props", "$.k").cast("bigint") % 10).cast("string")).alias("field")).distinct()
    least = Window.partitionBy("event_type", "field").orderBy("user_id")
    six = f.withColumn("rank", F.row_number().over(least)).where("rank <= 6").groupBy("event_type", "field").agg(F.array_join(F.sort_array(F.collect_list("user_id")), ",").alias("first_six"))
    return six.join(f.groupBy("event_type", "field").agg(F.count("*").alias("holders")), ["event_type", "field"])


@query("build_vote", 156, views="variant", sql="""
WITH m AS (SELECT chrom, max(pos) AS top FROM variant GROUP BY chrom),
b AS (SELECT * FROM (VALUES ('a', 1990000), ('b', 2000000), ('c', 1900000)) t(build, length)),
w AS (SELECT build, count(*) AS votes FROM m JOIN b ON top <= length GROUP BY build),
k AS (SELECT *, row_number() OVER (ORDER BY votes DESC, build) AS i, lead(votes) OVER (ORDER BY votes DESC, build) AS next FROM w)
SELECT CASE WHEN next IS NULL OR next < votes THEN build END AS hint, votes FROM k WHERE i = 1""")
def build_vote(spark: SparkSession, sf: str) -> DataFrame:
    lengths = spark.createDataFrame([("a", 1990000), ("b", 2000000), ("c", 1900000)], "build string, length bigint")
    top = v.variant(spark, sf).groupBy("chrom").agg(F.max("pos").alias("top"))
    votes = top.join(F.broadcast(lengths), F.col("top") <= F.col("length")).groupBy("build").agg(F.count("*").alias("votes"))
    w = Window.orderBy(F.desc("votes"), "build")
    return votes.select("build", "votes", F.row_number().over(w).alias("i"), F.lead("votes").over(w).alias("next")).where("i = 1").select(F.when(F.col("next").isNull() | (F.col("next") < F.col("votes")), F.col("build")).alias("hint"), "votes")


@query("kinship_thresholds", 12, 109, views="edges", sql="""
SELECT count(*) AS pairs, count(*) FILTER (WHERE (a * 31 + b) % 1000 >= 354) AS first_degree,
    count(*) FILTER (WHERE (a * 31 + b) % 1000 >= 177) AS second_degree, min((a * 31 + b) % 1000) AS least, max((a * 31 + b) % 1000) AS most
  FROM edges""")
def kinship_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    return _kinship_counts(v.edges(spark, sf))


def _kinship_counts(edges: DataFrame) -> DataFrame:
    k = edges.select(((F.col("a") * 31 + F.col("b")) % 1000).alias("k"))
    return k.agg(F.count("*").alias("pairs"), F.count_if(F.col("k") >= 354).alias("first_degree"), F.count_if(F.col("k") >= 177).alias("second_degree"), F.min("k").alias("least"), F.max("k").alias("most"))


@query("role_binding", 70, views="sample", sql="""
SELECT split AS role, count(*) AS n, count(DISTINCT stratum) AS strata FROM sample WHERE split <> 'holdout' GROUP BY split""")
def role_binding(spark: SparkSession, sf: str) -> DataFrame:
    return v.sample(spark, sf).where("split <> 'holdout'").groupBy(F.col("split").alias("role")).agg(F.count("*").alias("n"), F.count_distinct("stratum").alias("strata"))


@query("readiness_verdict", 73, 74, 150, views="sample", sql="""
WITH c AS (SELECT split AS task, count(*) >= 15 AS ok FROM sample GROUP BY split)
SELECT bool_and(ok) AS ready, coalesce(array_to_string(list_sort(list(task) FILTER (WHERE NOT ok)), ','), '') AS blockers FROM c""")
def readiness_verdict(spark: SparkSession, sf: str) -> DataFrame:
    checks = v.sample(spark, sf).groupBy(F.col("split").alias("task")).agg((F.count("*") >= 15).alias("ok"))
    return checks.agg(F.every("ok").alias("ready"), F.array_join(F.sort_array(F.collect_list(F.when(~F.col("ok"), F.col("task")))), ",").alias("blockers"))


@query("lineage_check", 63, 76, views="sample", sql="""
WITH a AS (SELECT stratum, count(*) AS n FROM sample GROUP BY stratum),
    b AS (SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS stratum, CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE n_nationkey % 7 END AS n
  FROM nation)
SELECT b.stratum, a.n IS NOT DISTINCT FROM b.n AS matches FROM b LEFT JOIN a USING (stratum)""")
def lineage_check(spark: SparkSession, sf: str) -> DataFrame:
    a = v.sample(spark, sf).groupBy("stratum").agg(F.count("*").alias("got"))
    b = table(spark, sf, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("stratum"), F.when(F.col("n_nationkey") % 5 != 0, F.col("n_nationkey") % 7).cast("bigint").alias("n"))
    return b.join(a, "stratum", "left").select("stratum", F.col("got").eqNullSafe(F.col("n")).alias("matches"))


@query("ordered_equality", 214, 216, sql="""
WITH a AS (SELECT row_number() OVER (ORDER BY c_custkey) AS i, c_custkey AS k
  FROM customer WHERE c_acctbal > 0), b AS (SELECT row_number() OVER (ORDER BY o_custkey) AS i, o_custkey AS k FROM (SELECT DISTINCT o_custkey
  FROM orders))
SELECT count(*) FILTER (WHERE a.k IS DISTINCT FROM b.k) AS differing, count(*) AS places FROM a FULL JOIN b USING (i)""")
def ordered_equality(spark: SparkSession, sf: str) -> DataFrame:
    place = lambda df: numbering.numbered(df, "i", "k").select("i", "k")
    a = place(table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k")))
    b = place(table(spark, sf, "orders").select(F.col("o_custkey").alias("k")).distinct()).withColumnRenamed("k", "other")
    return a.join(b, "i", "full").agg(F.count_if(~F.col("k").eqNullSafe(F.col("other"))).alias("differing"), F.count("*").alias("places"))


@query("text_cleaning", 218, 219, 220, 66, 227, sql=r"""
SELECT page_id, lower(coalesce(nullif(trim(regexp_replace(url, '[^0-9A-Za-z]+', '_', 'g'), '_'), ''), 'state')) AS slug,
  regexp_extract(url, '([0-9]+)', 1) AS digits, regexp_matches(url, 'blog|news|wiki') AS named,
      CASE WHEN regexp_matches(url, '^https') THEN 'secure' ELSE 'other' END AS role
    FROM pages""")
def text_cleaning(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", values.slug(F.col("url")).alias("slug"), F.regexp_extract("url", "([0-9]+)", 1).alias("digits"), F.col("url").rlike("blog|news|wiki").alias("named"), F.when(F.col("url").rlike("^https"), "secure").otherwise("other").alias("role"))


@query("json_fields", 31, 225, 78, sql="""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k,
    CASE WHEN value = floor(value) AND abs(value) < 1e15 THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE 'real' END AS value_text
  FROM events""")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    parsed = F.from_json("props", "k bigint")
    text = values.number_text(F.col("value"))
    return table(spark, sf, "events").select("event_id", parsed["k"].alias("k"), F.when(F.col("value") == F.floor("value"), text).otherwise("real").alias("value_text"))


@query("map_counts", 224, sql="""
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
SELECT user_id, string_agg(event_type || '=' || CAST(n AS VARCHAR), ',' ORDER BY event_type) AS counts FROM c GROUP BY user_id""")
def map_counts(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    counted = c.groupBy("user_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return counted.select("user_id", F.array_join(F.transform(F.map_entries("m"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",").alias("counts"))
