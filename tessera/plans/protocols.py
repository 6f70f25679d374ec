"""Queries of whole protocols: threshold choice, leave-one-out ridge, power and spread calibration, diverse choice."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.keys import unit_draw
from tessera.operators import gates, guards, power, regression, resample
from tessera.plans import views as v
from tessera.plans.registry import query
from tessera.plans.statistics import _TWO, DRAW, rounded
from tessera.session import table

THRESHOLDS = [0.0, 0.01, 0.05, 0.2, 0.5]


@query("threshold_selection", 132, 133, views="genotype sample phenotype", sql="""
WITH e AS (SELECT variant, (variant % 9 - 4) / 10.0::DOUBLE AS beta, (variant % 100) / 100.0::DOUBLE AS p FROM (SELECT DISTINCT variant
  FROM genotype)),
k AS (SELECT CAST(k AS INTEGER) AS place, [0.0, 0.01, 0.05, 0.2, 0.5][k + 1]::DOUBLE AS threshold FROM range(5) r(k)),
n AS (SELECT place, threshold, count(*) FILTER (WHERE p < threshold) AS selected FROM k, e GROUP BY ALL),
s AS (SELECT place, sample, sum(CASE WHEN p < threshold THEN dosage * beta ELSE 0 END) AS x
  FROM genotype JOIN e USING (variant), k WHERE dosage IS NOT NULL GROUP BY ALL),
d AS (SELECT s.place, split, y, CAST(s.sample % 7 AS DOUBLE) AS c, x FROM s JOIN sample USING (sample) JOIN phenotype USING (sample)
  JOIN n USING (place) WHERE selected > 0),
m AS (SELECT place, avg(y) AS my, avg(c) AS mc, avg(x) AS mx FROM d WHERE split = 'train' GROUP BY place),
t AS (SELECT d.place, sum((c - mc) * (c - mc)) AS cc, sum((x - mx) * (x - mx)) AS xx, sum((c - mc) * (x - mx)) AS cx, sum((c - mc) * (y - my)) AS cy,
    sum((x - mx) * (y - my)) AS xy
  FROM d JOIN m USING (place) WHERE split = 'train' GROUP BY d.place),
b AS (SELECT place, cy / cc AS a, (cy * xx - xy * cx) / (cc * xx - cx * cx) AS bc, (xy * cc - cy * cx) / (cc * xx - cx * cx) AS bx FROM t),
r AS (SELECT d.place, 1 - sum(power(y - my - a * (c - mc), 2)) / sum(power(y - my, 2)) AS r2_a,
  1 - sum(power(y - my - bc * (c - mc) - bx * (x - mx), 2)) / sum(power(y - my, 2)) AS r2_b
  FROM d JOIN m USING (place) JOIN b USING (place) WHERE split = 'validation' GROUP BY d.place)
SELECT threshold, selected, round(r2_a, 6) AS r2_a, round(r2_b, 6) AS r2_b, round(r2_b - r2_a, 6) AS gain,
    row_number() OVER (ORDER BY r2_b - r2_a DESC, place) = 1 AS chosen
FROM r JOIN n USING (place)""")
def threshold_selection(spark: SparkSession, sf: str) -> DataFrame:
    g = v.genotype(spark, sf)
    effects = g.select("variant").distinct().select("variant", ((F.col("variant") % 9 - 4) / 10.0).alias("beta"), ((F.col("variant") % 100) / 100.0).alias("p"))
    counts = effects.agg(*[F.count_if(F.col("p") < t).alias(f"n{k}") for k, t in enumerate(THRESHOLDS)]).first()
    scores = regression.threshold_scores(g, effects, THRESHOLDS)
    long = scores.select("sample", F.posexplode(F.array(*[F.col(f"score_{k}") for k in range(len(THRESHOLDS))])).alias("place", "score"))
    used = [k for k in range(len(THRESHOLDS)) if counts[k]]
    rows = long.where(F.col("place").isin(used)).join(v.sample(spark, sf), "sample").join(v.phenotype(spark, sf), "sample").withColumn("c", (F.col("sample") % 7).cast("double"))
    found = [(THRESHOLDS[k], counts[k], round(a, 6), round(b, 6), round(gain, 6), best) for k, a, b, gain, best in regression.chosen_threshold(rows, THRESHOLDS, "c", "y")]
    return spark.createDataFrame(found, "threshold double, selected bigint, r2_a double, r2_b double, gain double, chosen boolean")


@query("leave_one_out_ridge", 126, 127, 128)
def leave_one_out_ridge(spark: SparkSession, sf: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    response = e[0] + 0.5 * e[1] * e[2]
    rows = table(spark, sf, "embeddings").select(
        (F.col("label") % 4).cast("bigint").alias("g"),
        F.concat(F.array(F.lit(1.0), e[1]), F.slice(e, 3, F.size(e) - 2), F.array(response)).alias("x"),
        F.when(F.col("vec_id") % 5 < 4, "train").otherwise("test").alias("role"))
    return regression.leave_one_out_ridge(rows, "g", "x", 2, "role", [0.1, 1.0, 10.0, 100.0])


_NORMAL = f"sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {DRAW.format("{0} || ':r'")})) * cos(2.0::DOUBLE * pi() * {DRAW.format("{0} || ':t'")})"


@query("detection_power", 153, 165, sql=f"""
WITH u AS (SELECT s.size, m.m, i.i FROM (SELECT unnest([5, 10, 20])::BIGINT AS size) s, range(100) m(m), range(20) i(i) WHERE i.i < s.size),
x AS (SELECT *, {_NORMAL.format("'det:' || size || ':' || m || ':' || i")} AS x FROM u),
d AS (SELECT size, m, b, CAST(floor({DRAW.format("'det-boot:' || size || ':' || m || ':' || b || ':' || i")} * size) AS BIGINT) AS i
  FROM u, range(100) b(b)),
w AS (SELECT d.size, d.m, d.b, avg(x) AS mean FROM d JOIN x USING (size, m, i) GROUP BY ALL),
l AS (SELECT size, m, quantile_cont(mean, 0.025) AS bound FROM w GROUP BY ALL),
c AS (SELECT e.e AS effect, s.s AS spread FROM (SELECT unnest([0.5, 1.0])::DOUBLE AS e) e, (SELECT unnest([0.5, 1.0, 2.0])::DOUBLE AS s) s),
p AS (SELECT effect, spread, size, avg(CASE WHEN bound > -effect / spread THEN 1.0 ELSE 0.0 END) AS power FROM l, c GROUP BY ALL)
SELECT effect, spread, min(size) FILTER (WHERE power >= 0.9) AS needed, round(max(power), 9) AS best FROM p GROUP BY ALL""")
def detection_power(spark: SparkSession, sf: str) -> DataFrame:
    bounds = power.unit_lower_bounds(spark, [5, 10, 20], 100, 100, "det")
    found = power.detection_power(bounds, [0.5, 1.0], [0.5, 1.0, 2.0])
    needed = gates.least_sufficient(found, ["effect", "spread"], "size", "power", 0.9)
    return rounded(needed.join(found.groupBy("effect", "spread").agg(F.max("power").alias("best")), ["effect", "spread"]))


@query("cell_spread", 154, 167, 168, sql=f"""
WITH c AS (SELECT c_mktsegment AS cell, c_custkey AS id, c_custkey % 2 AS fold, c_acctbal / 10000.0::DOUBLE AS x FROM customer),
r AS (SELECT rep, cell, fold, x, x * x AS x2, x + 0.5::DOUBLE * x * x + {DRAW.format("'cell:' || rep || ':' || id")} AS y FROM c, range(6) p(rep)),
f AS (SELECT rep, cell, fold, regr_slope(y, x) AS s1, regr_intercept(y, x) AS i1, regr_slope(y, x2) AS s2, regr_intercept(y, x2) AS i2 FROM r
  GROUP BY ALL),
m AS (SELECT rep, cell, fold, avg(y) AS m FROM r GROUP BY ALL),
q AS (SELECT r.rep, r.cell, r.fold, 1 - sum(power(y - i1 - s1 * x, 2)) / sum(power(y - m, 2)) AS a, 1 - sum(power(y - i2 - s2 * x2, 2)) / sum(power(y - m, 2)) AS b
  FROM r JOIN f ON f.rep = r.rep AND f.cell = r.cell AND f.fold = 1 - r.fold JOIN m ON m.rep = r.rep AND m.cell = r.cell AND m.fold = r.fold
    GROUP BY ALL),
d AS (SELECT rep, cell, avg(b) - avg(a) AS delta FROM q GROUP BY ALL),
s AS (SELECT cell, stddev_samp(delta) AS sigma, count(*) AS pilots FROM d GROUP BY cell),
n AS (SELECT cell, sigma, pilots, (SELECT min(g) FROM (SELECT unnest([5, 10, 20, 50])::BIGINT AS g) z WHERE 1.96 * sigma / sqrt(g) < 0.01) AS needed
  FROM s)
SELECT cell, pilots, round(sigma, 9) AS sigma, needed, CASE WHEN count(*) FILTER (WHERE needed IS NULL) OVER () = 0 THEN max(needed) OVER () END AS formal
  FROM n""")
def cell_spread(spark: SparkSession, sf: str) -> DataFrame:
    """Pilots of a difference of two arms' cross-fitted R2 by cell, its spread, and the replicates that a margin needs."""
    c = table(spark, sf, "customer").select(F.col("c_mktsegment").alias("cell"), F.col("c_custkey").alias("id"), (F.col("c_custkey") % 2).alias("fold"), (F.col("c_acctbal") / 10000.0).alias("x"))
    pilots = F.explode(F.sequence(F.lit(0), F.lit(5))).alias("rep")
    r = c.select("*", pilots).select("*", (F.col("x") * F.col("x")).alias("x2"), (F.col("x") + 0.5 * F.col("x") * F.col("x") + unit_draw(F.lit("cell"), "rep", "id")).alias("y"))
    fits = r.groupBy("rep", "cell", "fold").agg(*[f("y", x).alias(n) for x, k in (("x", 1), ("x2", 2)) for f, n in ((F.regr_slope, f"s{k}"), (F.regr_intercept, f"i{k}"))], F.avg("y").alias("m"))
    other = fits.select("rep", "cell", (1 - F.col("fold")).alias("fold"), "s1", "i1", "s2", "i2")
    own = fits.select("rep", "cell", "fold", "m")
    joined = r.join(other, ["rep", "cell", "fold"]).join(own, ["rep", "cell", "fold"])
    r2 = lambda i, s, x: 1 - F.sum((F.col("y") - F.col(i) - F.col(s) * F.col(x)) ** 2) / F.sum((F.col("y") - F.col("m")) ** 2)
    folds = joined.groupBy("rep", "cell", "fold").agg(r2("i1", "s1", "x").alias("a"), r2("i2", "s2", "x2").alias("b"))
    deltas = folds.groupBy("rep", "cell").agg((F.avg("b") - F.avg("a")).alias("delta"))
    spread = deltas.groupBy("cell").agg(F.stddev_samp("delta").alias("sigma"), F.count("*").alias("pilots"))
    sizes = F.array(*[F.lit(n).cast("bigint") for n in (5, 10, 20, 50)])
    needed = spread.select("cell", "pilots", "sigma", F.array_min(F.filter(sizes, lambda n: 1.96 * F.col("sigma") / F.sqrt(n) < 0.01)).alias("needed"))
    return rounded(needed.crossJoin(needed.agg(gates.complete_max(F.col("needed")).alias("formal"))))


@query("diverse_choice", 187, sql="""
WITH RECURSIVE m AS (SELECT c_nationkey AS nation, c_mktsegment AS seg, avg(c_acctbal) AS y FROM customer GROUP BY ALL),
c AS (SELECT nation, list(y ORDER BY seg) AS vec, max(y) AS score FROM m GROUP BY nation HAVING count(*) = 5),
o AS (SELECT *, row_number() OVER (ORDER BY score DESC, nation) AS i FROM c),
p AS (SELECT a.nation, b.nation AS other, corr(x.y, z.y) AS r FROM c a JOIN c b ON a.nation <> b.nation JOIN m x ON x.nation = a.nation
  JOIN m z ON z.nation = b.nation AND z.seg = x.seg GROUP BY ALL),
k AS (SELECT nation, list(other) AS bad FROM p WHERE abs(r) > 0.8 OR abs(nation - other) < 2 GROUP BY nation),
s AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS chosen
  UNION ALL
  SELECT o.i, CASE WHEN len(chosen) < 6 AND NOT list_has_any(chosen, coalesce(bad, [])) THEN list_append(chosen, CAST(o.nation AS BIGINT)) ELSE chosen END
  FROM s JOIN o ON o.i = s.i + 1 LEFT JOIN k ON k.nation = o.nation),
f AS (SELECT chosen FROM s ORDER BY i DESC LIMIT 1)
SELECT unnest(chosen) AS nation, CAST(generate_subscripts(chosen, 1) AS INTEGER) AS rank FROM f""")
def diverse_choice(spark: SparkSession, sf: str) -> DataFrame:
    m = table(spark, sf, "customer").groupBy(F.col("c_nationkey").cast("bigint").alias("nation"), "c_mktsegment").agg(F.avg("c_acctbal").alias("y"))
    vector = F.transform(F.sort_array(F.collect_list(F.struct("c_mktsegment", "y"))), lambda s: s["y"])
    candidates = m.groupBy("nation").agg(vector.alias("vec"), F.max("y").alias("score")).where(F.size("vec") == 5)
    return guards.greedy_diverse(candidates, ["-score", "nation"], "nation", "nation", "vec", 2, 0.8, 6)


@query("feasibility_grid", 148, sql="""
WITH c AS (SELECT c_nationkey AS stratum, c_mktsegment AS cell, c_custkey % 2 = 0 AS null_row, c_acctbal AS score FROM customer),
q AS (SELECT stratum, quantile_cont(score, 0.95) AS threshold FROM c WHERE null_row GROUP BY stratum),
g AS (SELECT stratum, cell, count(*) AS n, avg(CASE WHEN score > threshold THEN 1.0 ELSE 0.0 END) AS exceeding, quantile_cont(score, 0.5) AS median
  FROM c JOIN q USING (stratum) WHERE NOT null_row GROUP BY ALL)
SELECT stratum, cell, n, round(exceeding, 9) AS exceeding, round(median, 6) AS median,
  round(avg(CASE WHEN exceeding >= 0.05 AND n >= 5 THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY stratum), 9) AS workable FROM g""")
def feasibility_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Cells against their stratum's null quantile: share beyond it, median, and the stratum's share of workable cells."""
    c = table(spark, sf, "customer").select(F.col("c_nationkey").alias("stratum"), F.col("c_mktsegment").alias("cell"), (F.col("c_custkey") % 2 == 0).alias("null_row"), F.col("c_acctbal").alias("score"))
    thresholds = c.where("null_row").groupBy("stratum").agg(F.percentile("score", F.lit(0.95)).alias("threshold"))
    beyond = F.avg((F.col("score") > F.col("threshold")).cast("double"))
    g = c.where("not null_row").join(thresholds, "stratum").groupBy("stratum", "cell").agg(F.count("*").alias("n"), beyond.alias("exceeding"), F.percentile("score", F.lit(0.5)).alias("median"))
    workable = F.avg(((F.col("exceeding") >= 0.05) & (F.col("n") >= 5)).cast("double")).over(Window.partitionBy("stratum"))
    return g.select("stratum", "cell", "n", F.round("exceeding", 9).alias("exceeding"), F.round("median", 6).alias("median"), F.round(workable, 9).alias("workable"))


_RANK = "rank() OVER (PARTITION BY rep ORDER BY {0}) + (count(*) OVER (PARTITION BY rep, {0}) - 1) / 2.0::DOUBLE"


@query("paired_rank_bootstrap", 161, sql=f"""
WITH n AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS i, count(*) OVER () AS n, s_acctbal AS y, CAST(s_nationkey AS DOUBLE) AS a,
    CAST(s_suppkey % 13 AS DOUBLE) AS b
  FROM supplier),
d AS (SELECT rep, CAST(floor({DRAW.format("'rank:' || rep || ':' || i")} * n) AS BIGINT) AS i FROM n, range(40) r(rep)),
k AS (SELECT rep, {_RANK.format("y")} AS ry, {_RANK.format("a")} AS ra, {_RANK.format("b")} AS rb FROM d JOIN n USING (i)),
s AS (SELECT rep, corr(ra, ry) - corr(rb, ry) AS difference FROM k GROUP BY rep)
SELECT round(quantile_cont(difference, 0.025), 8) AS low, round(quantile_cont(difference, 0.975), 8) AS high, count(difference) AS replicates FROM s""")
def paired_rank_bootstrap(spark: SparkSession, sf: str) -> DataFrame:
    """Interval of the difference of two rank correlations with one response, over the same draws of units."""
    units = table(spark, sf, "supplier").select("s_suppkey", F.col("s_acctbal").alias("y"), F.col("s_nationkey").cast("double").alias("a"), (F.col("s_suppkey") % 13).cast("double").alias("b"))
    units = resample.numbered(units, ["s_suppkey"])
    drawn = resample.draws(units, 40, "rank").join(units.select("i", "y", "a", "b"), "i")
    rank = lambda c: F.rank().over(Window.partitionBy("rep").orderBy(c)) + (F.count("*").over(Window.partitionBy("rep", c)) - 1) / 2.0
    ranked = drawn.select("rep", *[rank(c).alias(f"r{c}") for c in ("y", "a", "b")])
    reps = ranked.groupBy("rep").agg((F.corr("ra", "ry") - F.corr("rb", "ry")).alias("difference"))
    return rounded(resample.interval(reps, "difference"), 8)


@query("fit_equivariance", 171, sql=_TWO + """, s AS (SELECT (p * d - q * b) / (a * d - b * b) AS bx, (q * a - p * b) / (a * d - b * b) AS bz FROM c),
w AS (SELECT l_quantity AS x, l_discount AS z, 2 * l_extendedprice + 100 * l_quantity AS y FROM lineitem),
g AS (SELECT covar_pop(x, y) AS p, covar_pop(z, y) AS q, var_pop(x) AS a, var_pop(z) AS d, covar_pop(x, z) AS b FROM w),
k AS (SELECT (p * d - q * b) / (a * d - b * b) AS mx, (q * a - p * b) / (a * d - b * b) AS mz FROM g),
r AS (SELECT 'l_quantity' AS term, bx AS plain, mx AS moved, 2 * bx + 100 AS want FROM s, k UNION ALL SELECT 'l_discount', bz, mz, 2 * bz FROM s, k)
SELECT term, round(plain, 4) AS plain, round(moved, 4) AS moved, abs(moved - want) <= 1e-6 * greatest(1, abs(want)) AS equivariant FROM r""")
def fit_equivariance(spark: SparkSession, sf: str) -> DataFrame:
    """Coefficients refitted after the response is scaled and turned towards a predictor: they must scale and move with it."""
    rows = table(spark, sf, "lineitem").withColumn("moved", 2 * F.col("l_extendedprice") + 100 * F.col("l_quantity"))
    terms = ["l_quantity", "l_discount"]
    plain, moved = (regression.grams(rows, terms, y)[0].solve() for y in ("l_extendedprice", "moved"))
    want = 2 * plain[1:] + [100.0, 0.0]
    same = [bool(abs(m - w) <= 1e-6 * max(1.0, abs(w))) for m, w in zip(moved[1:], want, strict=True)]
    return spark.createDataFrame([(t, round(float(a), 4), round(float(b), 4), s) for t, a, b, s in zip(terms, plain[1:], moved[1:], same, strict=True)], "term string, plain double, moved double, equivariant boolean")


@query("block_components", 139)
def block_components(spark: SparkSession, sf: str) -> DataFrame:
    return regression.block_components(table(spark, sf, "embeddings"), "vec_id", "embedding", F.col("vec_id") % 10 < 7, 8, 2)
