"""Queries over intervals, curves, deterministic order, sampling and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import keys
from tessera.operators import curves as c
from tessera.operators import intervals as i
from tessera.operators import numbering
from tessera.operators import sampling as s
from tessera.plans import views as v
from tessera.plans.registry import query
from tessera.session import table


@query("interval_cover_value", 84, 31, views="variant interval", sql="""
WITH c AS (SELECT v.variant, arg_max(i.score, (i.start, i.stop, i.score)) AS value FROM variant v
  JOIN interval i ON v.chrom = i.chrom AND i.start <= v.pos AND v.pos < i.stop GROUP BY v.variant)
SELECT v.variant, coalesce(c.value, 0.0) AS value FROM variant v LEFT JOIN c USING (variant)""")
def interval_cover_value(spark: SparkSession, sf: str) -> DataFrame:
    return i.cover_value(v.variant(spark, sf), v.interval(spark, sf), "variant").select("variant", "value")


@query("interval_coverage", 85, 89, views="variant interval", sql="""
SELECT count(*) FILTER (WHERE EXISTS (SELECT 1 FROM interval i WHERE i.chrom = v.chrom AND i.start <= v.pos AND v.pos < i.stop)) AS covered, count(*) AS points
  FROM variant v""")
def interval_coverage(spark: SparkSession, sf: str) -> DataFrame:
    return i.covered_count(v.variant(spark, sf), v.interval(spark, sf))


@query("nearest_site_decay", 86, views="variant interval", sql="""
WITH n AS (SELECT v.variant, min(abs(v.pos - i.start)) AS distance FROM variant v LEFT JOIN interval i USING (chrom) GROUP BY v.variant)
SELECT variant, CAST(distance AS BIGINT) AS distance, round(exp(-distance / 10000.0), 9) AS score FROM n""")
def nearest_site_decay(spark: SparkSession, sf: str) -> DataFrame:
    near = i.nearest_distance(v.variant(spark, sf).select("chrom", "pos", "variant"), v.interval(spark, sf).select("chrom", F.col("start").alias("site")), "variant")
    return near.select("variant", "distance", F.round(F.exp(-F.col("distance") / 10000.0), 9).alias("score"))


@query("cis_window_join", 87, views="variant interval", sql="""
SELECT v.variant, i.start AS center, v.pos - i.start AS offset_bp FROM variant v
  JOIN interval i ON v.chrom = i.chrom AND abs(v.pos - i.start) <= 50000""")
def cis_window_join(spark: SparkSession, sf: str) -> DataFrame:
    centers = v.interval(spark, sf).select("chrom", F.col("start").alias("center"))
    return i.within_radius(centers, v.variant(spark, sf), 50_000).select("variant", "center", (F.col("pos") - F.col("center")).alias("offset_bp"))


@query("interval_overlap_join", 88, views="interval", sql="""
SELECT a.chrom, a.start, b.start AS r_start, least(a.stop, b.stop) - greatest(a.start, b.start) AS shared FROM interval a
  JOIN interval b ON a.chrom = b.chrom AND a.start < b.stop AND b.start < a.stop AND a.start < b.start""")
def interval_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    spans = v.interval(spark, sf).select("chrom", "start", "stop")
    return i.overlapping(spans, spans).where("start < r_start").select("chrom", "start", "r_start", (F.least("stop", "r_stop") - F.greatest("start", "r_start")).alias("shared"))


@query("block_runs", 204, views="variant", sql="""
SELECT variant, (row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1) // 64 AS run FROM variant""")
def block_runs(spark: SparkSession, sf: str) -> DataFrame:
    return i.runs(v.variant(spark, sf), 64, "chrom", ["pos"]).select("variant", "run")


@query("block_tiles", 205, views="interval", sql="""
SELECT chrom, start AS begin, t AS start, least(t + 4000, stop) AS stop FROM (SELECT *, unnest(range(start, stop, 4000)) AS t FROM interval)""")
def block_tiles(spark: SparkSession, sf: str) -> DataFrame:
    spans = v.interval(spark, sf)
    made = i.tiles(spans.select("chrom", "start", "stop"), 4000)
    return i.overlapping(made, spans.select("chrom", "start", "stop")).where("r_start <= start and stop <= r_stop and (start - r_start) % 4000 = 0 and (stop - start = 4000 or stop = r_stop)").select("chrom", F.col("r_start").alias("begin"), "start", "stop").distinct()


@query("map_tiles", 205, views="variant", sql="""
WITH m AS (SELECT chrom, pos AS x, pos / 100000.0::DOUBLE + (variant // 40) * 0.5 AS y FROM variant WHERE pos > 0),
k AS (SELECT *, lag(floor(y / 2.0)) OVER (PARTITION BY chrom ORDER BY x) AS before, max(x) OVER (PARTITION BY chrom) AS far FROM m),
b AS (SELECT chrom, x, far FROM k WHERE before IS NULL OR floor(y / 2.0) > before)
SELECT chrom, row_number() OVER w - 1 AS block, x - 1 AS start, coalesce(lead(x) OVER w - 1, far) AS stop FROM b WINDOW w AS (PARTITION BY chrom ORDER BY x)""")
def map_tiles(spark: SparkSession, sf: str) -> DataFrame:
    y = F.col("pos") / 100000.0 + F.floor(F.col("variant") / 40) * 0.5
    return i.map_tiles(v.variant(spark, sf).where("pos > 0").select("chrom", F.col("pos").alias("x"), y.alias("y")), 2.0)


@query("map_interpolation", 206, 30, views="variant", sql="""
WITH m AS (SELECT chrom, pos AS x, CAST(variant % 97 + variant AS DOUBLE) / 100 AS y FROM variant WHERE variant % 11 = 0),
b AS (SELECT v.chrom, v.pos, v.variant, (SELECT max(x) FROM m WHERE m.chrom = v.chrom AND x <= v.pos) AS lx, (SELECT min(x)
  FROM m WHERE m.chrom = v.chrom AND x >= v.pos) AS rx FROM variant v)
SELECT b.variant, round(CASE WHEN lx IS NULL THEN r.y WHEN rx IS NULL OR lx = rx THEN l.y ELSE l.y + (r.y - l.y) * (b.pos - lx) / (rx - lx) END, 9) AS value
FROM b LEFT JOIN m l ON l.chrom = b.chrom AND l.x = lx LEFT JOIN m r ON r.chrom = b.chrom AND r.x = rx""")
def map_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    variants = v.variant(spark, sf).select("chrom", "pos", "variant")
    curve = variants.where("variant % 11 = 0").select("chrom", F.col("pos").alias("x"), ((F.col("variant") % 97 + F.col("variant")).cast("double") / 100).alias("y"))
    return i.interpolated(variants, curve, "variant").select("variant", F.round("value", 9).alias("value"))


@query("monotone_check", 203, views="curve", sql="""
SELECT cell, step, metric, before FROM (SELECT *, lag(metric) OVER (PARTITION BY cell ORDER BY step) AS before FROM curve) WHERE metric <= before""")
def monotone_check(spark: SparkSession, sf: str) -> DataFrame:
    return i.sorted_violations(v.curve(spark, sf), "cell", "step", "metric").select("cell", "step", "metric", "before")


@query("curve_tail_mean", 192, views="curve", sql="""
SELECT cell, round(CASE WHEN count(*) = 5 THEN avg(metric) END, 9) AS tail
  FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY step DESC) AS n FROM curve WHERE step <= 40) WHERE n <= 5 GROUP BY cell""")
def curve_tail_mean(spark: SparkSession, sf: str) -> DataFrame:
    return c.tail_mean(v.curve(spark, sf), 40).select("cell", F.round("tail", 9).alias("tail"))


@query("curve_rolling_mean", 193, views="curve", sql="""
SELECT cell, step, round(rolling, 9) AS rolling FROM (SELECT cell, step, avg(metric) OVER w AS rolling, count(*) OVER w AS n
  FROM curve WINDOW w AS (PARTITION BY cell ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) WHERE n = 5""")
def curve_rolling_mean(spark: SparkSession, sf: str) -> DataFrame:
    return c.rolling_mean(v.curve(spark, sf)).select("cell", "step", F.round("rolling", 9).alias("rolling"))


@query("curve_interval_drops", 194, 195, views="curve", sql="""
WITH m AS (SELECT cell, step, CASE WHEN count(*) OVER w = 5 THEN avg(metric) OVER w END AS mean
  FROM curve WINDOW w AS (PARTITION BY cell ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
t AS (SELECT cell, arg_max(mean, step) FILTER (WHERE step <= 5) AS t5, arg_max(mean, step) FILTER (WHERE step <= 8) AS t8,
    arg_max(mean, step) FILTER (WHERE step <= 12) AS t12
  FROM m GROUP BY cell HAVING max(step) >= 12),
d AS (SELECT cell, t5 - t8 AS a, t8 - t12 AS b FROM t)
SELECT cell, round(a, 9) AS drop_5_8, round(b, 9) AS drop_8_12, a <= 2 AND b <= 2 AS all_small, a > 0 AND b > 0 AS all_positive,
  CASE WHEN NOT (a <= 2 AND b <= 2) THEN 'NOT_STABLE' WHEN b / a > 1 THEN 'STABLE_BUT_ACCELERATING' ELSE 'STABLE' END AS shape FROM d""")
def curve_interval_drops(spark: SparkSession, sf: str) -> DataFrame:
    curve = v.curve(spark, sf)
    long = curve.groupBy("cell").agg(F.max("step").alias("n")).where("n >= 12")
    found = c.drops(c.tails_at(curve.join(long, "cell", "left_semi"), [5, 8, 12]), [5, 8, 12], 2.0)
    return found.select("cell", F.round("drop_5_8", 9).alias("drop_5_8"), F.round("drop_8_12", 9).alias("drop_8_12"), "all_small", "all_positive", c.shape(F.col("all_small"), F.col("ratio")).alias("shape"))


@query("curve_degradation", 196, views="curve", sql="""
WITH r AS (SELECT cell, step, avg(metric) OVER w AS x, count(*) OVER w AS n
  FROM curve WINDOW w AS (PARTITION BY cell ORDER BY step ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)),
d AS (SELECT cell, arg_max(x, step) - min(x) AS rise FROM r WHERE n = 5 GROUP BY cell)
SELECT cell, round(rise, 9) AS rise, rise > 0.002 AS degraded FROM d""")
def curve_degradation(spark: SparkSession, sf: str) -> DataFrame:
    return c.degradation(v.curve(spark, sf)).select("cell", F.round("rise", 9).alias("rise"), "degraded")


@query("curve_late_change", 197, views="curve", sql="""
WITH n AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY step DESC) AS n FROM curve)
SELECT cell, round(CASE WHEN count(*) = 8 THEN avg(metric) FILTER (WHERE n <= 4) - avg(metric) FILTER (WHERE n > 4) END, 9) AS change
  FROM n WHERE n <= 8 GROUP BY cell""")
def curve_late_change(spark: SparkSession, sf: str) -> DataFrame:
    return c.late_change(v.curve(spark, sf), 4).select("cell", F.round("change", 9).alias("change"))


@query("curve_nonincreasing_fit", 198, views="curve", sql="""
WITH k AS (SELECT * FROM curve),
s AS (SELECT a.cell, a.step AS lo, b.step AS hi, (SELECT avg(metric) FROM k WHERE k.cell = a.cell AND k.step BETWEEN a.step AND b.step) AS mean
  FROM k a JOIN k b ON a.cell = b.cell AND a.step <= b.step),
f AS (SELECT i.cell, i.step, s.lo, max(s.mean) AS top FROM k i JOIN s ON s.cell = i.cell AND s.lo <= i.step AND s.hi >= i.step GROUP BY ALL)
SELECT cell, step, round(min(top), 7) AS fit FROM f GROUP BY cell, step""")
def curve_nonincreasing_fit(spark: SparkSession, sf: str) -> DataFrame:
    return c.nonincreasing_fit(v.curve(spark, sf)).select("cell", "step", F.round("fit", 7).alias("fit"))


_FITS = """
WITH k AS (SELECT * FROM curve WHERE cell LIKE '%:view' OR cell LIKE '%:click'),
s AS (SELECT a.cell, a.step AS lo, b.step AS hi, (SELECT avg(metric) FROM k WHERE k.cell = a.cell AND k.step BETWEEN a.step AND b.step) AS mean
  FROM k a JOIN k b ON a.cell = b.cell AND a.step <= b.step),
t AS (SELECT i.cell, i.step, s.lo, max(s.mean) AS top FROM k i JOIN s ON s.cell = i.cell AND s.lo <= i.step AND s.hi >= i.step GROUP BY ALL),
f AS (SELECT split_part(cell, ':', 1) AS cell, split_part(cell, ':', 2) AS kind, step, round(min(top), 9) AS fit FROM t GROUP BY ALL),"""


@query("curve_acceleration", 199, 93, views="curve", sql=_FITS + """
e AS (SELECT cell, kind, max(fit) AS hi, min(fit) AS lo FROM f GROUP BY ALL),
c AS (SELECT cell, min(hi) AS hi, max(lo) AS lo FROM e GROUP BY cell HAVING count(*) = 2 AND min(hi) > max(lo)),
l AS (SELECT cell, n, hi - (hi - lo) * n / 6 AS level FROM c, range(1, 6) r(n)),
r AS (SELECT l.cell, l.n, f.kind, min(f.step) AS step FROM l JOIN f ON f.cell = l.cell AND f.fit <= l.level GROUP BY ALL)
SELECT x.cell, round(median(x.step / y.step), 9) AS speedup, count(*) AS levels FROM r x
  JOIN r y ON x.cell = y.cell AND x.n = y.n WHERE x.kind = 'view' AND y.kind = 'click' GROUP BY x.cell""")
def curve_acceleration(spark: SparkSession, sf: str) -> DataFrame:
    return c.acceleration(*_fit_pair(spark, sf)).select("cell", F.round("speedup", 9).alias("speedup"), "levels")


def _fit_pair(spark: SparkSession, sf: str) -> list[DataFrame]:
    curve = v.curve(spark, sf)
    kind = F.substring_index("cell", ":", -1)
    control = curve.where(kind == "view").withColumn("cell", F.substring_index("cell", ":", 1))
    chosen = curve.where(kind == "click").withColumn("cell", F.substring_index("cell", ":", 1))
    return [c.nonincreasing_fit(df).withColumn("fit", F.round("fit", 9)) for df in (control, chosen)]


@query("curve_unpaired", 199, 200, views="curve", sql=_FITS + """
p AS (SELECT cell, count(*) FILTER (WHERE kind = 'view') AS n, count(*) FILTER (WHERE kind = 'click') AS m, max(step) FILTER (WHERE kind = 'view') AS x,
    max(step) FILTER (WHERE kind = 'click') AS y, least(max(fit) FILTER (WHERE kind = 'view'), max(fit) FILTER (WHERE kind = 'click')) AS hi,
    greatest(min(fit) FILTER (WHERE kind = 'view'), min(fit) FILTER (WHERE kind = 'click')) AS lo FROM f GROUP BY cell),
q AS (SELECT cell, CASE WHEN n = 0 OR m = 0 THEN 'one curve' WHEN n <> m OR x <> y THEN 'steps differ' WHEN hi <= lo THEN 'no common range' END AS problem FROM p)
SELECT cell, problem FROM q WHERE problem IS NOT NULL""")
def curve_unpaired(spark: SparkSession, sf: str) -> DataFrame:
    return c.unpaired(*_fit_pair(spark, sf))


@query("curve_step_check", 200, views="curve", sql="""
SELECT cell, count(*) AS n FROM (SELECT cell, step * CASE WHEN cell LIKE '%:view' AND step > 10 THEN 2 ELSE 1 END AS step FROM curve)
  GROUP BY cell HAVING max(step) <> count(*) OR min(step) <> 1""")
def curve_step_check(spark: SparkSession, sf: str) -> DataFrame:
    odd = F.when(F.col("cell").like("%:view") & (F.col("step") > 10), F.col("step") * 2).otherwise(F.col("step"))
    return c.step_violations(v.curve(spark, sf).withColumn("step", odd), 1, 1)


@query("curve_boundary_change", 201, 202, views="curve", sql="""
SELECT cell, round(arg_max(metric, step) FILTER (WHERE step <= 6) - arg_min(metric, step) FILTER (WHERE step > 6), 9) AS change FROM curve
  GROUP BY cell HAVING max(step) > 6""")
def curve_boundary_change(spark: SparkSession, sf: str) -> DataFrame:
    curve = v.curve(spark, sf)
    return c.boundary_change(curve.where("step <= 6"), curve.where("step > 6")).select("cell", F.round("change", 9).alias("change"))


@query("hash_keys", 172, 173, 174, 175, 222, sql="""
WITH h AS (SELECT s_suppkey, sha256('s' || chr(31) || CAST(s_suppkey AS VARCHAR)) AS hex, sha256('s' || chr(9) || CAST(s_suppkey AS VARCHAR)) AS tab,
    substr(sha256('salt|' || CAST(s_suppkey AS VARCHAR)), 1, 16) AS surrogate
  FROM supplier)
SELECT s_suppkey, hex, tab, surrogate, row_number() OVER (ORDER BY substr(hex, 1, 16)) AS place FROM h""")
def hash_keys(spark: SparkSession, sf: str) -> DataFrame:
    h = keys.stable_hex(F.lit("s"), "s_suppkey")
    rows = table(spark, sf, "supplier").select("s_suppkey", h.alias("hex"), keys.ranking_key(F.lit("s"), "s_suppkey").alias("tab"), keys.surrogate_id("salt", "s_suppkey").alias("surrogate"))
    return numbering.numbered(rows, "__i", keys.stable_int(F.col("hex"))).select("s_suppkey", "hex", "tab", "surrogate", (F.col("__i") + 1).alias("place"))


@query("window_top_k", 176, 185, views="variant", sql="""
WITH w AS (SELECT *, pos // 40000 AS win, sha256('seed' || chr(9) || CAST(variant AS VARCHAR)) AS h FROM variant),
f AS (SELECT * FROM w QUALIFY dense_rank() OVER (PARTITION BY chrom ORDER BY win) <= 20)
SELECT chrom, win, variant, row_number() OVER (PARTITION BY chrom, win ORDER BY h) AS rank FROM f
  QUALIFY row_number() OVER (PARTITION BY chrom, win ORDER BY h) <= 3""")
def window_top_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = v.variant(spark, sf).withColumn("win", F.floor(F.col("pos") / 40000))
    return s.top_by(s.first_windows(rows, "chrom", "win", 20), ["chrom", "win"], [keys.ranking_key(F.lit("seed"), "variant")], 3).select("chrom", "win", "variant", F.col("rank").cast("bigint").alias("rank"))


@query("window_qc_retry", 58, 57, 98, views="genotype variant", sql="""
WITH q AS (SELECT variant, count(*) AS n, count(dosage) AS called, least(sum(dosage) / (2.0 * count(dosage)), 1 - sum(dosage) / (2.0 * count(dosage))) AS maf
  FROM genotype GROUP BY variant),
w AS (SELECT q.*, chrom, pos // 40000 AS win, row_number() OVER (PARTITION BY chrom, pos // 40000 ORDER BY sha256('qc' || chr(9) || CAST(variant AS VARCHAR))) AS try
  FROM q JOIN variant USING (variant)),
r AS (SELECT *, CASE WHEN 1 - called / n::DOUBLE > 0.05 THEN 'missing' WHEN maf = 0 THEN 'monomorphic' WHEN maf < 0.4 THEN 'maf' ELSE 'pass' END AS reason
  FROM w WHERE try <= 6),
f AS (SELECT chrom, win, min(try) FILTER (WHERE reason = 'pass') AS hit FROM r GROUP BY ALL)
SELECT r.reason, count(*) AS reads FROM r JOIN f USING (chrom, win) WHERE f.hit IS NULL OR r.try <= f.hit GROUP BY r.reason""")
def window_qc_retry(spark: SparkSession, sf: str) -> DataFrame:
    g = v.genotype(spark, sf).groupBy("variant").agg(F.count("*").alias("n"), F.count("dosage").alias("called"), (F.sum("dosage") / (2.0 * F.count("dosage"))).alias("af"))
    rows = g.join(v.variant(spark, sf), "variant").withColumn("win", F.floor(F.col("pos") / 40000))
    tried = s.top_by(rows, ["chrom", "win"], [keys.ranking_key(F.lit("qc"), "variant")], 6)
    maf = F.least("af", 1 - F.col("af"))
    reason = F.when(1 - F.col("called") / F.col("n") > 0.05, "missing").when(maf == 0, "monomorphic").when(maf < 0.4, "maf").otherwise("pass")
    hit = F.min(F.when(F.col("reason") == "pass", F.col("rank"))).over(Window.partitionBy("chrom", "win"))
    return tried.withColumn("reason", reason).withColumn("hit", hit).where("hit is null or rank <= hit").groupBy("reason").agg(F.count("*").alias("reads"))


@query("proportional_sample", 177, views="sample", sql="""
WITH n AS (SELECT split, greatest(1, CAST(round_even(40 * count(*) / (SELECT count(*) FROM sample)::DOUBLE, 0) AS BIGINT)) AS quota FROM sample
  GROUP BY split)
SELECT sample, split FROM sample JOIN n USING (split) QUALIFY row_number() OVER (PARTITION BY split ORDER BY sha256('p' || chr(9) || CAST(sample AS VARCHAR))) <= any_value(quota) OVER (PARTITION BY split)""")
def proportional_sample(spark: SparkSession, sf: str) -> DataFrame:
    return s.proportional(v.sample(spark, sf), "split", [keys.ranking_key(F.lit("p"), "sample")], 40).select("sample", "split")


@query("largest_remainder", 178, views="sample", sql="""
WITH n AS (SELECT stratum, count(*) AS n FROM sample GROUP BY stratum),
e AS (SELECT *, n * 60.0 / sum(n) OVER () AS x FROM n),
p AS (SELECT *, 60 - sum(floor(x)) OVER () AS spare, row_number() OVER (ORDER BY round(x - floor(x), 9) DESC, stratum) AS place FROM e)
SELECT stratum, n, CAST(floor(x) AS BIGINT) + CASE WHEN place <= spare THEN 1 ELSE 0 END AS seats FROM p""")
def largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    return s.largest_remainder(v.sample(spark, sf).groupBy("stratum").agg(F.count("*").alias("n")), "stratum", "n", 60)


@query("population_split", 179, views="sample", sql="""
SELECT sample, row_number() OVER (PARTITION BY stratum ORDER BY sha256('v' || chr(9) || CAST(sample AS VARCHAR))) <= least(greatest(floor(count(*) OVER (PARTITION BY stratum) * 0.25 + 0.5), 1), count(*) OVER (PARTITION BY stratum) - 1) AS is_validation
  FROM sample""")
def population_split(spark: SparkSession, sf: str) -> DataFrame:
    return s.hash_split(v.sample(spark, sf), "stratum", "sample", "v", 0.25).select("sample", "is_validation")


@query("split_firewall", 180, views="sample", sql="""
SELECT sample, row_number() OVER (PARTITION BY split ORDER BY sha256('x' || chr(9) || CAST(sample AS VARCHAR))) <= 5 OR row_number() OVER (PARTITION BY split ORDER BY sha256('y' || chr(9) || CAST(sample AS VARCHAR))) <= 5 AS historic
  FROM sample""")
def split_firewall(spark: SparkSession, sf: str) -> DataFrame:
    return s.firewall(v.sample(spark, sf), "split", "sample", ["x", "y"], 5).select("sample", "historic")


def _left(part: str) -> str:
    """Squared deviation if the unit goes to a part, the hash that breaks ties, and the part."""
    away = [f"({h} + size * {int(part == p)} - {w}::DOUBLE * total)" for h, p, w in (("a", "train", 0.6), ("b", "validation", 0.2), ("c", "test", 0.2))]
    key = " || chr(31) || ".join(("'seed'", "CAST(stratum AS VARCHAR)", "CAST(unit AS VARCHAR)", f"'{part}'"))
    return f"{{'e': round({' + '.join(f'{d} * {d}' for d in away)}, 6), 'h': sha256({key}), 'n': '{part}'}}"


@query("greedy_component_split", 181, 107, sql=f"""
WITH RECURSIVE u AS (SELECT o_custkey AS unit, count(*) AS size, o_custkey % 5 AS stratum FROM orders GROUP BY o_custkey),
o AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY size DESC,
    sha256('seed' || chr(31) || CAST(stratum AS VARCHAR) || chr(31) || CAST(unit AS VARCHAR))) AS i,
  CAST(sum(size) OVER (PARTITION BY stratum) AS DOUBLE) AS total FROM u),
r AS (
  SELECT DISTINCT stratum, CAST(0 AS BIGINT) AS i, unit - unit AS unit, CAST(0 AS BIGINT) AS size, '' AS split, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b, 0.0::DOUBLE AS c
    FROM o
  UNION ALL
  SELECT stratum, i, unit, size, best, a + size * CAST(best = 'train' AS INT), b + size * CAST(best = 'validation' AS INT), c + size * CAST(best = 'test' AS INT)
  FROM (SELECT *, list_sort([{_left("train")}, {_left("validation")}, {_left("test")}])[1].n AS best
        FROM (SELECT r.stratum, o.i, o.unit, o.size, o.total, r.a, r.b, r.c FROM r JOIN o ON o.stratum = r.stratum AND o.i = r.i + 1)))
SELECT stratum, unit, size, split FROM r WHERE i > 0""")
def greedy_component_split(spark: SparkSession, sf: str) -> DataFrame:
    units = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("unit")).agg(F.count("*").alias("size"), (F.max("o_custkey") % 5).alias("stratum"))
    return s.greedy_split(units, "stratum", "unit", "size", {"train": 0.6, "validation": 0.2, "test": 0.2}, "seed")


@query("mode_stratum", 183, sql="""
SELECT o_custkey, o_orderpriority FROM (SELECT o_custkey, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, o_orderpriority) = 1""")
def mode_stratum(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    return s.top_by(n, ["o_custkey"], [F.desc("n"), F.asc("o_orderpriority")], 1).select("o_custkey", "o_orderpriority")


@query("even_thinning", 186, views="variant", sql="""
WITH r AS (SELECT variant, chrom, row_number() OVER (PARTITION BY chrom ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY chrom) AS n FROM variant)
SELECT DISTINCT variant, chrom FROM r, range(50) t(j) WHERE i = CAST(round_even(j * (n - 1) / 49.0, 0) AS BIGINT)""")
def even_thinning(spark: SparkSession, sf: str) -> DataFrame:
    return s.even_thin(v.variant(spark, sf), "chrom", ["pos"], 50).select("variant", "chrom")


@query("per_trait_top_k", 188, 189, 191, sql="""
SELECT l_returnflag, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank
  FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) <= 10""")
def per_trait_top_k(spark: SparkSession, sf: str) -> DataFrame:
    top = s.top_by(table(spark, sf, "lineitem"), ["l_returnflag"], [F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber")], 10)
    return top.select("l_returnflag", "l_orderkey", "l_linenumber", F.col("rank").cast("bigint").alias("rank"))


@query("factorial_schedule", 190, sql="""
WITH g AS (SELECT a.n_nationkey AS nation, r_regionkey AS region, s AS seed FROM nation a, region, range(4) t(s)),
p AS (SELECT *, row_number() OVER (ORDER BY sha256('plan' || chr(9) || CAST(nation AS VARCHAR) || chr(9) || CAST(region AS VARCHAR) || chr(9) || CAST(seed AS VARCHAR))) - 1 AS place
  FROM g)
SELECT nation, region, seed, place, place % 4 AS worker, place // 4 AS round FROM p""")
def factorial_schedule(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("nation"))
    grid = nation.crossJoin(table(spark, sf, "region").select(F.col("r_regionkey").alias("region"))).crossJoin(spark.range(4).select(F.col("id").alias("seed")))
    return s.schedule(grid, ["nation", "region", "seed"], "plan", 4)


@query("stratified_group_folds", 170)
def stratified_group_folds(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators import dealing

    return dealing.stratified_group_folds(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", 5, "outer")


@query("exact_allocation", 182)
def exact_allocation(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators import dealing

    member = table(spark, sf, "customer").select(F.concat_ws("-", F.col("c_nationkey").cast("string"), F.floor(F.col("c_custkey") / (F.col("c_nationkey") % 3 * 40 + 20)).cast("string")).alias("family"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("population"))
    families = member.groupBy("family", "population").agg(F.count("*").alias("size"))
    n = member.count()
    targets = {"development": n * 35 // 100, "task_gate": n * 12 // 100}
    return dealing.exact_allocation(families, "family", "population", "size", targets | {"bridge_test": n - sum(targets.values())}, "freeze").select("family", "size", "role")
