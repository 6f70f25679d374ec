"""Queries over aggregates, models, resampling, graphs and gates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import values
from tessera.functions.keys import unit_draw
from tessera.operators import components, gates, graph, kernels, numbering, regression, relational, resample, stats
from tessera.plans import views as v
from tessera.plans.registry import query
from tessera.session import table

#: The draw that Spark and DuckDB share: 32 bits of an MD5, as SQL over a text.
DRAW = "(('0x' || substr(md5({}), 1, 8))::BIGINT / 4294967296.0::DOUBLE)"
#: Per-variant quality in SQL.
QUALITY = """q AS (SELECT variant, count(*) AS n, count(dosage) AS called, count(*) FILTER (WHERE dosage = 0) AS n0, count(*) FILTER (WHERE dosage = 1) AS n1, count(*) FILTER (WHERE dosage = 2) AS n2,
  CAST(sum(dosage) AS BIGINT) / (2.0::DOUBLE * count(dosage)) AS af FROM genotype GROUP BY variant)"""


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query("variant_quality", 97, 98, 99, 55, 56, views="genotype sample", sql=f"""
WITH g AS (SELECT g.* FROM genotype g JOIN sample USING (sample) WHERE split = 'train'),
{QUALITY.replace('FROM genotype', 'FROM g')}
SELECT variant, n, called, n0, n1, n2, round(af, 9) AS af, round(least(af, 1 - af), 9) AS maf, round(1 - called / n::DOUBLE, 9) AS missing_rate
  FROM q WHERE least(af, 1 - af) > 0.01""")
def variant_quality(spark: SparkSession, sf: str) -> DataFrame:
    train = v.sample(spark, sf).where("split = 'train'").select("sample")
    return rounded(stats.variant_quality(v.genotype(spark, sf).join(train, "sample", "left_semi")).where("maf > 0.01"))


@query("imputed_dosage", 97, 136, views="genotype", sql=f"""
WITH {QUALITY}
SELECT sample, round(sum(coalesce(dosage, 2 * af)), 6) AS total, round(sum(coalesce((dosage - 2 * af) / sqrt(greatest(2 * af * (1 - af), 1e-12)), 0)), 6) AS z
  FROM genotype JOIN q USING (variant) GROUP BY sample""")
def imputed_dosage(spark: SparkSession, sf: str) -> DataFrame:
    g = v.genotype(spark, sf)
    quality = stats.variant_quality(g)
    mean, zero = stats.mean_imputed(g, quality), stats.zero_imputed_scores(g, quality)
    return rounded(mean.join(zero, ["variant", "sample"]).groupBy("sample").agg(F.sum("value").alias("total"), F.sum("z").alias("z")), 6)


@query("genotype_class_metrics", 100, 101, 102, 104, 239, views="genotype sample", sql=f"""
WITH t AS (SELECT variant, count(*) FILTER (WHERE dosage = 0) AS n0, count(*) FILTER (WHERE dosage = 1) AS n1,
    count(*) FILTER (WHERE dosage = 2) AS n2, count(dosage) AS c, sum(dosage) / (2.0 * count(dosage)) AS af
  FROM genotype JOIN sample USING (sample) WHERE split = 'train' GROUP BY variant HAVING count(dosage) > 0),
e AS (SELECT stratum, g.dosage AS d, (n0 + 0.5) / (c + 1.5) AS p0, (n1 + 0.5) / (c + 1.5) AS p1, (n2 + 0.5) / (c + 1.5) AS p2,
    (1 - af) * (1 - af) AS h0, 2 * af * (1 - af) AS h1, af * af AS h2
  FROM genotype g JOIN sample USING (sample) JOIN t USING (variant) WHERE split = 'validation' AND dosage IS NOT NULL),
s AS (SELECT *, CASE d WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END AS p, CASE d WHEN 0 THEN h0 WHEN 1 THEN h1 ELSE h2 END AS h,
  CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS bp, CASE WHEN h0 >= h1 AND h0 >= h2 THEN 0 WHEN h1 >= h2 THEN 1 ELSE 2 END AS bh
    FROM e)
SELECT stratum, count(*) AS n, round(avg(-ln(greatest(p, 1e-12))), 9) AS cross_entropy, round(avg(CASE WHEN bp = d THEN 1.0 ELSE 0 END), 9) AS accuracy,
  round(avg(-ln(greatest(h, 1e-12))), 9) AS hwe_cross_entropy, round(avg(CASE WHEN bp = d THEN 1.0 ELSE 0 END) - avg(CASE WHEN bh = d THEN 1.0 ELSE 0 END), 9) AS lift
    FROM s GROUP BY stratum""")
def genotype_class_metrics(spark: SparkSession, sf: str) -> DataFrame:
    g = v.genotype(spark, sf).join(v.sample(spark, sf), "sample")
    q = stats.variant_quality(g.where("split = 'train'")).where("called > 0")
    shares = values.smoothed_shares([F.col("n0"), F.col("n1"), F.col("n2")])
    chances = q.select("variant", *[s.alias(f"p{k}") for k, s in enumerate(shares)], *[s.alias(f"h{k}") for k, s in enumerate(values.hardy_weinberg(F.col("af")))])
    rows = g.where("split = 'validation' and dosage is not null").join(chances, "variant")
    own = stats.class_metrics(rows, ["stratum"], "dosage", ["p0", "p1", "p2"])
    hwe = stats.class_metrics(rows, ["stratum"], "dosage", ["h0", "h1", "h2"]).select("stratum", F.col("cross_entropy").alias("hwe_cross_entropy"), F.col("accuracy").alias("hwe"))
    return rounded(own.join(hwe, "stratum").select("stratum", "n", "cross_entropy", "accuracy", "hwe_cross_entropy", (F.col("accuracy") - F.col("hwe")).alias("lift")))


@query("cell_macro", 103, views="curve", sql="""
WITH c AS (SELECT cell, avg(metric) AS m FROM curve GROUP BY cell) SELECT round(avg(m), 9) AS m, count(*) AS cells FROM c""")
def cell_macro(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.macro(v.curve(spark, sf).groupBy("cell").agg(F.avg("metric").alias("m")), ["m"]))


@query("component_sizes", 108, 209, views="edges", sql="""
WITH RECURSIVE u AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges),
r AS (SELECT x AS node, x AS root FROM u UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node WHERE u.y > r.root),
c AS (SELECT node, min(root) AS component FROM (SELECT node, root FROM r) GROUP BY node),
s AS (SELECT component, count(*) AS size FROM c GROUP BY component)
SELECT size, count(*) AS components FROM s GROUP BY size""")
def component_sizes(spark: SparkSession, sf: str) -> DataFrame:
    found = graph.connected_components(v.edges(spark, sf))
    return found.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("components"))


@query("component_ids", 210, 211, views="edges", sql="""
WITH RECURSIVE u AS (SELECT a AS x, b AS y FROM edges UNION SELECT b, a FROM edges),
r AS (SELECT x AS node, x AS root FROM u UNION SELECT u.y, r.root FROM r JOIN u ON u.x = r.node WHERE u.y > r.root),
c AS (SELECT node, min(root) AS component FROM r GROUP BY node),
n AS (SELECT c_custkey AS node, coalesce(component, c_custkey) AS component FROM customer LEFT JOIN c ON c.node = c_custkey),
d AS (SELECT component, 'FC_' || substr(sha256(string_agg(CAST(node AS VARCHAR), chr(31) ORDER BY CAST(node AS VARCHAR))), 1, 16) AS component_id, count(*) AS size
  FROM n GROUP BY component)
SELECT node, component_id, size, CAST(0 AS BIGINT) AS differing FROM n JOIN d USING (component)""")
def component_ids(spark: SparkSession, sf: str) -> DataFrame:
    nodes = table(spark, sf, "customer").select(F.col("c_custkey").alias("node"))
    named = components.named_components(nodes, v.edges(spark, sf))
    again = components.named_components(nodes, v.edges(spark, sf).orderBy(F.desc("a")))
    differing = relational.same_partition(named, again, "node", "component_id").agg(F.count("*").alias("differing"))
    return named.crossJoin(differing)


@query("trait_description", 110, 113, sql="""
SELECT l_returnflag, count(l_extendedprice) AS n, round(avg(l_extendedprice), 4) AS mean, round(stddev_pop(l_extendedprice), 4) AS sd,
    min(l_extendedprice) AS least, max(l_extendedprice) AS most,
  round(quantile_cont(l_extendedprice, 0.01), 4) AS q01, round(quantile_cont(l_extendedprice, 0.5), 4) AS q5, round(quantile_cont(l_extendedprice, 0.999), 4) AS q999
    FROM lineitem GROUP BY l_returnflag""")
def trait_description(spark: SparkSession, sf: str) -> DataFrame:
    d = stats.described(table(spark, sf, "lineitem"), ["l_returnflag"], "l_extendedprice")
    return rounded(d.select("l_returnflag", "n", "mean", "sd", "least", "most", "q01", "q5", "q999"), 4)


@query("trait_value_shape", 111, sql="""
WITH k AS (SELECT l_linestatus, l_quantity AS val, count(*) AS k FROM lineitem GROUP BY ALL),
m AS (SELECT l_linestatus, avg(l_quantity) AS m, stddev_pop(l_quantity) AS s FROM lineitem GROUP BY ALL),
t AS (SELECT l_linestatus, count(*) FILTER (WHERE l_quantity < 0) AS negative, count(*) FILTER (WHERE abs(l_quantity - m) > 1.5 * s) AS far
  FROM lineitem JOIN m USING (l_linestatus) GROUP BY ALL)
SELECT l_linestatus, CAST(sum(k) AS BIGINT) AS n, count(*) AS distinct, arg_max(val, (k, -val)) AS mode,
    round(max(k) / sum(k)::DOUBLE, 9) AS mode_share, any_value(negative) AS negative, any_value(far) AS far
  FROM k JOIN t USING (l_linestatus) GROUP BY l_linestatus""")
def trait_value_shape(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.value_shape(table(spark, sf, "lineitem"), ["l_linestatus"], "l_quantity", far=1.5))


@query("trait_screen", 112, sql="""
WITH t AS (SELECT o_orderpriority AS trait, count(*) AS n, avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s, count(DISTINCT o_custkey) AS k
  FROM orders GROUP BY 1)
SELECT trait, n, array_to_string(list_filter([CASE WHEN n < 3000 THEN 'few' END, CASE WHEN m < 250000 THEN 'low' END,
    CASE WHEN k < 900 THEN 'narrow' END], lambda x: x IS NOT NULL), ',') AS reasons, NOT (n < 3000 OR m < 250000 OR k < 900) AS usable
  FROM t""")
def trait_screen(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("trait")).agg(F.count("*").alias("n"), F.avg("o_totalprice").alias("m"), F.count_distinct("o_custkey").alias("k"))
    broken = stats.failed_rules({"few": F.col("n") < 3000, "low": F.col("m") < 250000, "narrow": F.col("k") < 900})
    return t.select("trait", "n", F.array_join(broken, ",").alias("reasons"), (F.size(broken) == 0).alias("usable"))


@query("upper_quantiles", 114, 113, views="curve", sql="""
WITH r AS (SELECT cell, metric, row_number() OVER (PARTITION BY cell ORDER BY metric) AS i, count(*) OVER (PARTITION BY cell) AS n FROM curve)
SELECT cell, max(metric) AS upper FROM r WHERE i = ceil((n - 1) * 0.9) + 1 GROUP BY cell""")
def upper_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    return stats.exact_quantiles(v.curve(spark, sf), ["cell"], "metric", {"upper": 0.9}, "higher")


@query("out_of_sample_r2", 117, 118, sql="""
WITH t AS (SELECT *, CASE WHEN o_orderkey % 5 < 4 THEN 'train' ELSE 'test' END AS part FROM orders),
m AS (SELECT o_orderstatus, avg(o_totalprice) AS p FROM t WHERE part = 'train' GROUP BY 1), g AS (SELECT avg(o_totalprice) AS mu
  FROM t WHERE part = 'train'),
s AS (SELECT o_orderpriority, o_totalprice AS y, p, mu FROM t JOIN m USING (o_orderstatus), g WHERE part = 'test')
SELECT o_orderpriority, round(1 - sum((y - p) ** 2) / sum((y - mu) ** 2), 9) AS r2_train, round(1 - sum((y - p) ** 2) / (var_pop(y) * count(y)), 9) AS r2_own
  FROM s GROUP BY 1""")
def out_of_sample_r2(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    train = o.where("o_orderkey % 5 < 4")
    fitted = train.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("p"))
    rows = o.where("o_orderkey % 5 >= 4").join(fitted, "o_orderstatus").crossJoin(train.agg(F.avg("o_totalprice").alias("mu")))
    return rounded(rows.groupBy("o_orderpriority").agg(stats.r2_from_train_mean("o_totalprice", "p", "mu").alias("r2_train"), stats.r2_from_own_mean("o_totalprice", "p").alias("r2_own")))


@query("pearson_by_group", 119, sql="""
SELECT l_returnflag, round(coalesce(corr(l_quantity, l_extendedprice), 0), 9) AS r FROM lineitem GROUP BY 1""")
def pearson_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(table(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.coalesce(F.corr("l_quantity", "l_extendedprice"), F.lit(0.0)).alias("r")))


@query("spearman_by_group", 120, sql="""
WITH r AS (SELECT l_linestatus, rank() OVER (PARTITION BY l_linestatus ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_linestatus,
    l_quantity) - 1) / 2.0 AS x, rank() OVER (PARTITION BY l_linestatus ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_linestatus,
    l_extendedprice) - 1) / 2.0 AS y
  FROM lineitem)
SELECT l_linestatus, round(corr(x, y), 9) AS rho FROM r GROUP BY 1""")
def spearman_by_group(spark: SparkSession, sf: str) -> DataFrame:
    return rounded(stats.spearman(table(spark, sf, "lineitem"), ["l_linestatus"], "l_quantity", "l_extendedprice"))


@query("rank_deciles", 121, sql="""
WITH r AS (SELECT o_custkey % 3 AS g, o_orderkey % 50 AS x FROM orders),
d AS (SELECT g, least(CAST(floor((rank() OVER (PARTITION BY g ORDER BY x) + (count(*) OVER (PARTITION BY g,
    x) - 1) / 2.0 - 1) / count(*) OVER (PARTITION BY g) * 10) AS BIGINT), 9) AS decile
  FROM r)
SELECT g, decile, count(*) AS n FROM d GROUP BY ALL""")
def rank_deciles(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("g"), (F.col("o_orderkey") % 50).alias("x"))
    return stats.strata_by_rank(rows, "x", 10, ["g"], "decile").groupBy("g", "decile").agg(F.count("*").alias("n"))


_TWO = """WITH m AS (SELECT count(*) AS n, sum(l_quantity) AS x, sum(l_discount) AS z, sum(l_extendedprice) AS y, sum(l_quantity * l_quantity) AS xx, sum(l_discount * l_discount) AS zz, sum(l_quantity * l_discount) AS xz, sum(l_quantity * l_extendedprice) AS xy, sum(l_discount * l_extendedprice) AS zy, sum(l_extendedprice * l_extendedprice) AS yy FROM lineitem),
c AS (SELECT n, x / n AS mx, z / n AS mz, y / n AS my, xx - x * x / n AS a, zz - z * z / n AS d, xz - x * z / n AS b, xy - x * y / n AS p, zy - z * y / n AS q, yy - y * y / n AS t
  FROM m)"""


@query("least_squares", 122, 123, 228, sql=_TWO + """, s AS (SELECT *, a * d - b * b AS det, (p * d - q * b) / (a * d - b * b) AS bx, (q * a - p * b) / (a * d - b * b) AS bz FROM c),
e AS (SELECT *, t - bx * p - bz * q AS rest, (t - bx * p - bz * q) / (n - 3) AS noise, my - bx * mx - bz * mz AS b0 FROM s),
r AS (SELECT 'l_quantity' AS term, bx AS coefficient, bx / sqrt(noise * d / det) AS t_value, 1 - rest / t AS r2 FROM e
  UNION ALL SELECT 'l_discount', bz, bz / sqrt(noise * a / det), 1 - rest / t FROM e
  UNION ALL SELECT '1', b0, b0 / sqrt(noise * (1.0 / n + (mx * mx * d - 2 * mx * mz * b + mz * mz * a) / det)), 1 - rest / t FROM e)
SELECT term, round(coefficient, 4) AS coefficient, round(t_value, 4) AS t_value, round(r2, 8) AS r2 FROM r""")
def least_squares(spark: SparkSession, sf: str) -> DataFrame:
    gram = regression.grams(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")[0]
    rows = [(k, round(b, 4), round(t, 4), round(gram.explained(), 8)) for k, (b, t) in gram.fit_report().items()]
    return spark.createDataFrame(rows, "term string, coefficient double, t_value double, r2 double")


@query("ridge", 124, sql=_TWO + """, s AS (SELECT *, (p * (d + 50) - q * b) / ((a + 50) * (d + 50) - b * b) AS bx, (q * (a + 50) - p * b) / ((a + 50) * (d + 50) - b * b) AS bz FROM c)
SELECT 'l_quantity' AS term, round(bx, 4) AS coefficient FROM s UNION ALL SELECT 'l_discount', round(bz, 4) FROM s""")
def ridge(spark: SparkSession, sf: str) -> DataFrame:
    b = regression.grams(table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")[0].solve(50.0)
    return spark.createDataFrame([("l_quantity", round(float(b[1]), 4)), ("l_discount", round(float(b[2]), 4))], "term string, coefficient double")


@query("cross_validated_ridge", 125, 129)
def cross_validated_ridge(spark: SparkSession, sf: str) -> DataFrame:
    folds = regression.grams(table(spark, sf, "lineitem"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", F.col("l_orderkey") % 5)
    grid = [0.0, 1.0, 10.0, 100.0, 1000.0, 1e5]
    chosen, errors = regression.cross_validated_penalty(folds, grid)
    return spark.createDataFrame([(p, e, p == chosen) for p, e in zip(grid, errors, strict=True)], "penalty double, squared_error double, chosen boolean")


@query("dual_ridge_by_group", 126)
def dual_ridge_by_group(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select((F.col("label") % 4).cast("bigint").alias("g"), F.col("embedding").cast("array<double>").alias("x"), F.col("embedding")[0].cast("double").alias("y"), F.when(F.col("vec_id") % 5 < 3, "train").when(F.col("vec_id") % 5 == 3, "validation").otherwise("evaluation").alias("role"))
    return regression.grouped_ridge(rows, "g", "x", "y", "role", [0.1, 1.0, 10.0])


@query("marginal_scan", 130, views="genotype phenotype", sql="""
WITH r AS (SELECT sample, y, CAST(sample % 7 AS DOUBLE) AS c FROM phenotype),
s AS (SELECT variant, count(*) AS n, regr_slope(y, c) AS sy, regr_slope(dosage, c) AS sg, regr_intercept(y, c) AS iy, regr_intercept(dosage, c) AS ig
  FROM genotype JOIN r USING (sample) WHERE dosage IS NOT NULL GROUP BY variant),
e AS (SELECT variant, n, dosage - ig - sg * c AS g, y - iy - sy * c AS t FROM genotype JOIN r USING (sample)
  JOIN s USING (variant) WHERE dosage IS NOT NULL),
f AS (SELECT variant, any_value(n) AS n, sum(g * g) AS gg, sum(g * t) AS gt, sum(t * t) AS tt FROM e
  GROUP BY variant HAVING sum(g * g) > 1e-9 AND any_value(n) > 3)
SELECT variant, n, round(gt / gg, 3) AS beta, round(sqrt((tt - gt * gt / gg) / (n - 3) / gg), 3) AS se FROM f WHERE n > 10""")
def marginal_scan(spark: SparkSession, sf: str) -> DataFrame:
    response = v.phenotype(spark, sf).withColumn("c", (F.col("sample") % 7).cast("double"))
    return rounded(regression.marginal_scan(v.genotype(spark, sf), response, "c", "y").where("n > 10").select("variant", "n", "beta", "se"), 3)


@query("association_p_values", 131, 206)
def association_p_values(spark: SparkSession, sf: str) -> DataFrame:
    response = v.phenotype(spark, sf).withColumn("c", (F.col("sample") % 7).cast("double"))
    scan = regression.marginal_scan(v.genotype(spark, sf), response, "c", "y")
    return scan.select("variant", "z", values.two_sided_p("z").alias("p"))


@query("threshold_scores", 132, views="genotype", sql="""
WITH e AS (SELECT variant, (variant % 9 - 4) / 10.0::DOUBLE AS beta, (variant % 100) / 100.0::DOUBLE AS p FROM (SELECT DISTINCT variant
  FROM genotype)),
s AS (SELECT sample, sum(CASE WHEN p < 0.05 THEN dosage * beta ELSE 0 END) AS s0, sum(CASE WHEN p < 0.5 THEN dosage * beta ELSE 0 END) AS s1
  FROM genotype JOIN e USING (variant) WHERE dosage IS NOT NULL GROUP BY sample)
SELECT sample, round(s0, 9) + 0 AS score_0, round(s1, 9) + 0 AS score_1 FROM s""")
def threshold_scores(spark: SparkSession, sf: str) -> DataFrame:
    g = v.genotype(spark, sf)
    effects = g.select("variant").distinct().select("variant", ((F.col("variant") % 9 - 4) / 10.0).alias("beta"), ((F.col("variant") % 100) / 100.0).alias("p"))
    scores = rounded(regression.threshold_scores(g, effects, [0.05, 0.5]))
    return scores.select("sample", *[(F.col(c) + 0.0).alias(c) for c in ("score_0", "score_1")])  # no negative zero


@query("design_matrix", 134, 137, sql="""
WITH t AS (SELECT *, c_custkey % 10 < 7 AS train FROM customer), m AS (SELECT avg(c_acctbal) AS m, stddev_pop(c_acctbal) AS s FROM t WHERE train)
SELECT c_custkey, round((c_acctbal - m) / s, 9) AS balance, round(((c_acctbal - m) / s) ** 2, 8) AS balance_2,
    CAST(c_mktsegment = 'BUILDING' AS INT) AS seg_BUILDING, CAST(c_mktsegment = 'MACHINERY' AS INT) AS seg_MACHINERY
  FROM t, m""")
def design_matrix(spark: SparkSession, sf: str) -> DataFrame:
    train = F.col("c_custkey") % 10 < 7
    scaled = stats.train_standardised(table(spark, sf, "customer"), ["c_acctbal"], train)
    coded = stats.one_hot(scaled, "c_mktsegment", train)
    return coded.select("c_custkey", F.round("c_acctbal", 9).alias("balance"), F.round(F.col("c_acctbal") ** 2, 8).alias("balance_2"), F.col("c_mktsegment_BUILDING").alias("seg_BUILDING"), F.col("c_mktsegment_MACHINERY").alias("seg_MACHINERY"))


@query("phenotype_transforms", 135, sql="""
WITH t AS (SELECT *, o_orderkey % 10 < 7 AS train FROM orders), m AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s
  FROM t WHERE train),
c AS (SELECT t.*, greatest(least(o_totalprice, m + 1.5 * s), m - 1.5 * s) AS y FROM t, m), n AS (SELECT avg(y) AS m, stddev_pop(y) AS s, count(*) AS k
  FROM c WHERE train),
r AS (SELECT o_orderkey, round((y - m) / s, 8) AS z, (SELECT k FROM n) AS k,
    count(*) FILTER (WHERE train) OVER (ORDER BY o_totalprice RANGE UNBOUNDED PRECEDING) - count(*) FILTER (WHERE train) OVER (PARTITION BY o_totalprice) AS below
  FROM c, n)
SELECT o_orderkey, z, round((below + 0.5) / (k + 1), 9) AS share FROM r""")
def phenotype_transforms(spark: SparkSession, sf: str) -> DataFrame:
    train = F.col("o_orderkey") % 10 < 7
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    z = stats.clipped_scores(o, "o_totalprice", train, 1.5).select("o_orderkey", F.round("o_totalprice", 8).alias("z"))
    return z.join(stats.rank_share(o, "o_totalprice", train).select("o_orderkey", F.round("share", 9).alias("share")), "o_orderkey")


@query("rank_inverse_normal", 135)
def rank_inverse_normal(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return stats.rank_share(o, "o_totalprice", F.col("o_orderkey") % 10 < 7).select("o_orderkey", values.normal_quantile("share").alias("rint"))


@query("train_principal_components", 138, 143)
def train_principal_components(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    mean, axes, _ = regression.principal_axes(e.where("vec_id % 10 < 7"), "embedding", 3)
    return e.select("vec_id", *[c.alias(f"pc{k + 1}") for k, c in enumerate(regression.projected("embedding", mean, axes))])


@query("annotation_scores", 140, views="genotype", sql=f"""
WITH {QUALITY}, z AS (SELECT variant, sample, coalesce((dosage - 2 * af) / sqrt(greatest(2 * af * (1 - af), 1e-12)), 0) AS z FROM genotype
  JOIN q USING (variant)),
w AS (SELECT variant, 't' || CAST(k AS VARCHAR) AS track, CAST((variant * (k + 1)) % 5 AS DOUBLE) AS w FROM q, range(3) r(k))
SELECT sample, track, variant % 2 AS half, round(sum(z * w), 6) AS score FROM z JOIN w USING (variant) GROUP BY ALL""")
def annotation_scores(spark: SparkSession, sf: str) -> DataFrame:
    g = v.genotype(spark, sf)
    quality = stats.variant_quality(g)
    tracks = spark.range(3).select(F.col("id").alias("k"))
    w = quality.select("variant").crossJoin(tracks).select("variant", (F.col("variant") % 2).alias("half"), F.concat(F.lit("t"), F.col("k").cast("string")).alias("track"), ((F.col("variant") * (F.col("k") + 1)) % 5).cast("double").alias("w"))
    return rounded(stats.weighted_scores(stats.zero_imputed_scores(g, quality), w, ["half"]), 6)


@query("kernel_components", 141)
def kernel_components(spark: SparkSession, sf: str) -> DataFrame:
    """Axes from the first half of a label group's vectors by vec_id, three at least; scores of all."""
    e = table(spark, sf, "embeddings").where("embedding IS NOT NULL").select((F.col("label") % 4).cast("bigint").alias("g"), "vec_id", F.col("embedding").alias("x"))
    e = e.withColumn("key", F.coalesce(F.col("g").cast("string"), F.lit("")))
    sizes = e.groupBy("key").agg(F.count("*").alias("n"))
    placed = numbering.running_in_groups(e, "key", [F.col("vec_id"), F.col("x")], {"place": F.lit(1)}).join(F.broadcast(sizes), "key")
    return kernels.kernel_scores(placed, "g", "vec_id", "x", "place", F.col("place") <= F.greatest(F.lit(3), F.floor(F.col("n") / 2)), 2)


@query("canonical_correlation", 142)
def canonical_correlation(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select(F.slice(F.col("embedding").cast("array<double>"), 1, 6).alias("l"), F.slice(F.col("embedding").cast("array<double>"), 5, 6).alias("r"))
    found = regression.canonical_correlations(e, "l", "r", 4)
    return spark.createDataFrame([(i + 1, float(c)) for i, c in enumerate(found)], "place int, correlation double")


@query("subspace_features", 144, 146, 233)
def subspace_features(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings").select((F.col("label") % 4).cast("bigint").alias("g"), F.slice(F.col("embedding").cast("array<double>"), 1, 8).alias("x"))
    return regression.subspace_features(e, ["g"], "x", 2)


@query("distance_pooling", 145, sql="""
SELECT l_partkey, round(avg(l_quantity), 9) AS uniform, round(sum(exp(-l_linenumber / 3.0) * l_quantity) / sum(exp(-l_linenumber / 3.0)), 9) AS decayed
  FROM lineitem GROUP BY 1""")
def distance_pooling(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem").groupBy("l_partkey")
    return rounded(line.agg(F.avg("l_quantity").alias("uniform"), stats.decayed_mean(F.col("l_quantity"), F.col("l_linenumber"), 3.0).alias("decayed")))


@query("wilson_intervals", 147, sql="""
WITH k AS (SELECT l_returnflag, l_linestatus, count(*) FILTER (WHERE l_discount > 0.05)::DOUBLE AS k, count(*)::DOUBLE AS n FROM lineitem
  GROUP BY ALL), z AS (SELECT *, 1.959963984540054 AS z, k / n AS p FROM k)
SELECT l_returnflag, l_linestatus, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS low,
    round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 9) AS high
  FROM z""")
def wilson_intervals(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count_if(F.col("l_discount") > 0.05).cast("double").alias("k"), F.count("*").cast("double").alias("n"))
    low, high = values.wilson(F.col("k"), F.col("n"))
    return rounded(rows.select("l_returnflag", "l_linestatus", low.alias("low"), high.alias("high")))


@query("variance_proxy", 149, sql="""
WITH s AS (SELECT n_regionkey AS region, c_mktsegment AS seg, CASE WHEN count(*) >= 2 THEN stddev_samp(c_acctbal) END AS sd, count(DISTINCT c_nationkey) AS seeds
  FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
SELECT a.region, a.seg, b.seg AS other, round(a.sd + b.sd, 6) AS total FROM s a JOIN s b ON a.region = b.region AND a.seg < b.seg""")
def variance_proxy(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    s = c.groupBy(F.col("n_regionkey").alias("region"), F.col("c_mktsegment").alias("seg")).agg(F.stddev_samp("c_acctbal").alias("sd"))
    return rounded(gates.pair_spread(s, "region", "seg", "sd"), 6)


@query("capacity_envelope", 151, sql="""
SELECT round(sum(p_retailprice / 1000.0 * p_size * 12) / 3600.0 * 1.25, 6) AS hours, sum(p_retailprice / 1000.0 * p_size * 12) / 3600.0 * 1.25 <= 0.8 * 300 AS fits
  FROM part""")
def capacity_envelope(spark: SparkSession, sf: str) -> DataFrame:
    grid = table(spark, sf, "part").select((F.col("p_retailprice") / 1000.0).alias("s"), F.col("p_size").alias("steps"), F.lit(12).alias("runs"))
    return rounded(gates.envelope(grid, "s", "steps", "runs", 1.25, 300.0), 6)


@query("shared_level_choice", 152, 192, sql="""
WITH s AS (SELECT CAST(l_linenumber AS DOUBLE) AS level, l_returnflag AS cell, avg(l_discount) AS score FROM lineitem GROUP BY ALL),
g AS (SELECT a.level, min(b.score - a.score) AS least, avg(b.score - a.score) AS mean, median(b.score - a.score) AS med FROM s a
  JOIN s b ON a.cell = b.cell AND b.level = 1 GROUP BY a.level HAVING min(b.score - a.score) >= -0.002)
SELECT level, round(least, 9) AS least, round(mean, 9) AS mean, round(med, 9) AS median FROM g WHERE mean >= (SELECT max(mean)
  FROM g) - 0.0005 ORDER BY level LIMIT 1""")
def shared_level_choice(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "lineitem").groupBy(F.col("l_linenumber").cast("double").alias("level"), F.col("l_returnflag").alias("cell")).agg(F.avg("l_discount").alias("score"))
    return rounded(gates.shared_level(s, "level", "cell", "score", 1.0, 0.002, 0.0005))


@query("power_and_replicates", 153, 154, sql=f"""
WITH t AS (SELECT s.r AS sigma, n.r AS size, d.r AS draw FROM range(1, 4) s(r), range(1, 9) n(r), range(200) d(r)),
p AS (SELECT sigma, size, avg(CASE WHEN {DRAW.format("'pow:' || sigma || ':' || size || ':' || draw")} > sigma / (size * 2.0::DOUBLE) THEN 1.0 ELSE 0 END) AS power
  FROM t GROUP BY ALL),
r AS (SELECT sigma, min(size) FILTER (WHERE power >= 0.8) AS needed FROM p GROUP BY sigma)
SELECT sigma, needed, CASE WHEN count(*) FILTER (WHERE needed IS NULL) OVER () = 0 THEN max(needed) OVER () END AS formal FROM r""")
def power_and_replicates(spark: SparkSession, sf: str) -> DataFrame:
    grid = spark.range(1, 4).select(F.col("id").alias("sigma")).crossJoin(spark.range(1, 9).select(F.col("id").alias("size")))
    drawn = grid.crossJoin(spark.range(200).select(F.col("id").alias("draw")))
    hit = unit_draw(F.lit("pow"), "sigma", "size", "draw") > F.col("sigma") / (F.col("size") * 2.0)
    power = drawn.groupBy("sigma", "size").agg(F.avg(hit.cast("double")).alias("power"))
    needed = gates.least_sufficient(power, ["sigma"], "size", "power", 0.8)
    return needed.crossJoin(needed.agg(gates.complete_max(F.col("needed")).alias("formal")))


_BOOT = f"""u AS (SELECT o_custkey AS id, sum((o_totalprice - 150000) ** 2) AS a, sum((o_totalprice - 140000) ** 2) AS b, sum((o_totalprice - 145000) ** 2) AS t FROM orders GROUP BY 1),
n AS (SELECT *, row_number() OVER (ORDER BY id) - 1 AS i, count(*) OVER () AS n FROM u),
d AS (SELECT rep, CAST(floor({DRAW.format("'boot:' || rep || ':' || i")} * n) AS BIGINT) AS i FROM n, range(100) r(rep)),
s AS (SELECT rep, (sum(a) - sum(b)) / sum(t) AS gain FROM d JOIN n USING (i) GROUP BY rep)"""


@query("cluster_bootstrap", 157, 158, 159, sql=f"""
WITH {_BOOT} SELECT round(quantile_cont(gain, 0.025), 8) AS low, round(quantile_cont(gain, 0.975), 8) AS high, count(gain) AS replicates FROM s""")
def cluster_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    return _gain_interval(table(spark, sf, "orders"))


def _gain_interval(orders: DataFrame) -> DataFrame:
    square = lambda m: F.sum((F.col("o_totalprice") - m) ** 2)
    u = orders.groupBy(F.col("o_custkey").alias("id")).agg(square(150000).alias("a"), square(140000).alias("b"), square(145000).alias("t"))
    units = resample.numbered(u, ["id"])
    weighted = lambda c: F.sum(F.col("w") * F.col(c))
    reps = resample.replicated(units, 100, "boot", [((weighted("a") - weighted("b")) / weighted("t")).alias("gain")])
    return rounded(resample.interval(reps, "gain"), 8)


@query("paired_row_bootstrap", 157, 163, sql=f"""
WITH n AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n, s_acctbal AS y, s_nationkey * 100.0::DOUBLE AS b
  FROM supplier),
d AS (SELECT rep, CAST(floor({DRAW.format("'pair:' || rep || ':' || i")} * n) AS BIGINT) AS i FROM n, range(200) r(rep)),
s AS (SELECT rep, (sum(y * y) - sum((y - b) * (y - b))) / nullif(sum((y - 4500) * (y - 4500)), 0) AS gain FROM d JOIN n USING (i) GROUP BY rep)
SELECT round(quantile_cont(gain, 0.025), 8) AS low, round(quantile_cont(gain, 0.975), 8) AS high, count(gain) AS replicates FROM s""")
def paired_row_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("y"), F.lit(0.0).alias("a"), (F.col("s_nationkey") * 100.0).alias("b"), F.lit(4500.0).alias("m"))
    reps = resample.replicated(resample.numbered(rows, ["s_suppkey"]), 200, "pair", [resample.gain("y", "a", "b", "m").alias("gain")])
    return rounded(resample.interval(reps, "gain"), 8)


def _side_weights(side: str) -> str:
    """How often each replicate draws each unit of one side, in SQL."""
    draw = DRAW.format(f"'two-{side}:' || rep || ':' || i")
    return f"""(SELECT x.rep, y.{side}, count(*) AS w FROM
  (SELECT rep, CAST(floor({draw} * n) AS BIGINT) AS i FROM n_{side}, range(50) r(rep)) x JOIN n_{side} y USING (i) GROUP BY ALL)"""


def _side_numbers(side: str) -> str:
    return f"n_{side} AS (SELECT {side}, row_number() OVER (ORDER BY {side}) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT {side} FROM cells))"


@query("two_way_bootstrap", 160, sql=f"""
WITH cells AS (SELECT c_mktsegment, c_nationkey, avg(c_acctbal) AS y FROM customer GROUP BY ALL),
{_side_numbers("c_mktsegment")}, {_side_numbers("c_nationkey")},
a AS {_side_weights("c_mktsegment")}, b AS {_side_weights("c_nationkey")},
v AS (SELECT a.rep, c_mktsegment, a.w, sum(b.w * y) / sum(b.w) AS val FROM cells JOIN a USING (c_mktsegment)
  JOIN b ON b.rep = a.rep AND b.c_nationkey = cells.c_nationkey GROUP BY ALL)
SELECT rep, round(sum(w * val) / sum(w), 7) AS mean FROM v GROUP BY rep""")
def two_way_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    cells = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.avg("c_acctbal").alias("y"))
    reps = resample.two_way(cells, "c_mktsegment", "c_nationkey", 50, "two", F.sum(F.col("w") * F.col("y")) / F.sum("w"))
    return rounded(reps.groupBy("rep").agg((F.sum(F.col("w_c_mktsegment") * F.col("value")) / F.sum("w_c_mktsegment")).alias("mean")), 7)


@query("stratified_permutation", 162, 163, sql="""
WITH r AS (SELECT rep, s_nationkey AS g, s_suppkey AS id, s_acctbal AS y FROM supplier, range(20) t(rep)),
k AS (SELECT *, row_number() OVER (PARTITION BY rep, g ORDER BY id) AS i FROM r),
h AS (SELECT rep, g, y AS permuted, row_number() OVER (PARTITION BY rep,
    g ORDER BY sha256('perm' || chr(9) || CAST(rep AS VARCHAR) || chr(9) || CAST(id AS VARCHAR)), id) AS i
  FROM r)
SELECT rep, round(corr(y, permuted), 9) AS r FROM k JOIN h USING (rep, g, i) GROUP BY rep""")
def stratified_permutation(spark: SparkSession, sf: str) -> DataFrame:
    s = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("y"))
    return rounded(resample.permuted(s, "y", "id", 20, "perm", "g").groupBy("rep").agg(F.corr("y", "permuted").alias("r")))


@query("family_wise_p", 164, sql=f"""
WITH t AS (SELECT l_returnflag AS candidate, l_suppkey AS unit, avg(l_discount - 0.05) AS term FROM lineitem GROUP BY ALL),
o AS (SELECT candidate, abs(sum(term)) / sqrt(nullif(sum(term * term), 0)) AS statistic FROM t GROUP BY candidate),
f AS (SELECT rep, candidate, abs(sum(CASE WHEN {DRAW.format("'flip:' || rep || ':' || unit")} < 0.5 THEN -term ELSE term END)) / sqrt(nullif(sum(term * term), 0)) AS s
  FROM t, range(99) r(rep) GROUP BY ALL),
m AS (SELECT rep, max(s) AS top FROM f GROUP BY rep)
SELECT candidate, round(any_value(statistic), 7) AS statistic, (1 + count(*) FILTER (WHERE top >= statistic)) / 100.0::DOUBLE AS p FROM o, m
  GROUP BY candidate""")
def family_wise_p(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("candidate"), F.col("l_suppkey").alias("unit")).agg(F.avg(F.col("l_discount") - 0.05).alias("term"))
    found = resample.largest_of_family(terms, "candidate", "unit", "term", 99, "flip")
    return found.withColumn("statistic", F.round("statistic", 7))


@query("keyed_mask", 169, 170, views="genotype", sql=f"""
WITH f AS (SELECT sample, (row_number() OVER (ORDER BY sha256('fold' || chr(9) || CAST(sample AS VARCHAR))) - 1) % 5 AS fold
  FROM (SELECT DISTINCT sample FROM genotype))
SELECT fold, count(*) AS masked FROM genotype JOIN f USING (sample) WHERE dosage IS NOT NULL AND {DRAW.format("'mask:' || variant || ':' || sample")} < 0.15
  GROUP BY fold""")
def keyed_mask(spark: SparkSession, sf: str) -> DataFrame:
    g = v.genotype(spark, sf).where("dosage is not null")
    masked = g.where(resample.bernoulli(0.15, F.lit("mask"), "variant", "sample"))
    return resample.folds(v.genotype(spark, sf), "sample", 5, "fold").select("variant", "sample", "fold").join(masked, ["variant", "sample"], "left_semi").groupBy("fold").agg(F.count("*").alias("masked"))


@query("perturbation_score", 238, views="curve", sql="""
SELECT cell, round(stddev_samp(metric - prev), 9) AS score FROM (SELECT cell, metric, lag(metric) OVER (PARTITION BY cell ORDER BY step) AS prev
  FROM curve) GROUP BY cell""")
def perturbation_score(spark: SparkSession, sf: str) -> DataFrame:
    step = F.col("metric") - F.lag("metric").over(Window.partitionBy("cell").orderBy("step"))
    return rounded(v.curve(spark, sf).select("cell", step.alias("d")).groupBy("cell").agg(F.stddev_samp("d").alias("score")))


@query("leading_subspace_energy", 233, 146)
def leading_subspace_energy(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators import subspace

    rows = table(spark, sf, "embeddings")
    space = subspace.leading_subspace(rows, "embedding", 4, oversample=28)
    found = subspace.energies(rows, "vec_id", "embedding", space)
    return found.select(F.col("id").alias("vec_id"), F.round("inside", 6).alias("inside"), F.round("outside", 6).alias("outside"))
