"""Queries over manifests, contracts, positions and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import keys
from tessera.operators import guards, intervals, numbering
from tessera.operators.resample import bernoulli
from tessera.plans import views as v
from tessera.plans.registry import query
from tessera.session import table


@query("wide_to_long", 22, 23, sql="""
SELECT l_orderkey, l_linenumber, name, round(value, 6) AS value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_tax
  FROM lineitem) ON l_quantity, l_discount INTO NAME name VALUE value)""")
def wide_to_long(spark: SparkSession, sf: str) -> DataFrame:
    wide = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_discount")
    return wide.unpivot(["l_orderkey", "l_linenumber"], ["l_quantity", "l_discount"], "name", "value").withColumn("value", F.round("value", 6))


@query("content_manifest", 38, 39, 33, 92, sql="""
WITH f AS (SELECT source, CAST(doc_id AS VARCHAR) AS name, sha256(coalesce(text, '')) AS h, strlen(coalesce(text, '')) AS bytes,
    len(coalesce(text, '')) - len(replace(coalesce(text, ''), chr(10), '')) AS newlines, sha256(CAST(doc_id AS VARCHAR)) AS place
  FROM documents),
l AS (SELECT source, substr(place, 1, 4) AS leaf, count(*) AS files, sum(bytes) AS bytes, sum(newlines) AS newlines,
    sha256(string_agg(name || '  ' || h, chr(10) ORDER BY name, h)) AS h FROM f GROUP BY ALL),
b AS (SELECT source, substr(leaf, 1, 2) AS branch, sum(files) AS files, sum(bytes) AS bytes, sum(newlines) AS newlines,
    sha256(string_agg(leaf || '  ' || h, chr(10) ORDER BY leaf)) AS h FROM l GROUP BY ALL)
SELECT source, CAST(sum(files) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(newlines) AS BIGINT) AS newlines,
    sha256(string_agg(branch || '  ' || h, chr(10) ORDER BY branch)) AS tree
  FROM b GROUP BY source""")
def content_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """Files, bytes, lines and one digest a source, of a tree: 65,536 leaves by the name's hash, then 256 branches, so no row lists a source."""
    text = F.coalesce("text", F.lit(""))
    name = F.col("doc_id").cast("string")
    f = table(spark, sf, "documents").select("source", name.alias("name"), F.sha2(text, 256).alias("h"), F.sha2(name, 256).alias("place"), F.lit(1).alias("files"), F.octet_length(text).cast("bigint").alias("bytes"), (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))).cast("bigint").alias("newlines"))

    def joined(rows: DataFrame, level: str, width: int, of: str) -> DataFrame:
        lines = F.transform(F.array_sort(F.collect_list(F.struct(of, "h"))), lambda r: F.concat(r[of], F.lit("  "), r["h"]))
        sums = [F.sum(c).alias(c) for c in ("files", "bytes", "newlines")]
        return rows.groupBy("source", F.substring("place", 1, width).alias(level)).agg(*sums, F.sha2(F.array_join(lines, "\n"), 256).alias("h"))

    leaves = joined(f, "leaf", 4, "name").withColumn("place", F.col("leaf"))
    branches = joined(leaves, "branch", 2, "leaf").withColumn("place", F.col("branch"))
    return joined(branches, "root", 0, "branch").select("source", F.col("files").cast("bigint").alias("files"), "bytes", "newlines", F.col("h").alias("tree"))


@query("export_tables", 35, 36, 42, 45, sql="""
SELECT substr(sha256('export|' || CAST(s_suppkey AS VARCHAR)), 1, 16) AS surrogate,
    CASE WHEN s_acctbal IS NULL THEN '' WHEN s_acctbal = floor(s_acctbal) THEN CAST(CAST(s_acctbal AS BIGINT) AS VARCHAR) ELSE CAST(s_acctbal AS VARCHAR) END AS shown
  FROM supplier""")
def export_tables(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.functions.values import number_text

    s = table(spark, sf, "supplier")
    return s.select(keys.surrogate_id("export", "s_suppkey").alias("surrogate"), number_text(F.col("s_acctbal")).alias("shown"))


@query("open_splits_only", 65, 70, 71, views="sample", sql="""
SELECT split, count(*) AS n FROM sample WHERE split IN ('train', 'validation') GROUP BY split""")
def open_splits_only(spark: SparkSession, sf: str) -> DataFrame:
    return v.sample(spark, sf).where(F.col("split").isin(*map(guards.open_split, ("train", "validation")))).groupBy("split").agg(F.count("*").alias("n"))


@query("head_audit", 68, 15, 16, sql="""
WITH h AS (SELECT * FROM lineitem ORDER BY l_orderkey, l_linenumber LIMIT 100)
SELECT count(*) AS called, count(*) FILTER (WHERE l_returnflag = 'N') AS phased,
    round(count(*) FILTER (WHERE l_returnflag = 'N') / nullif(count(*), 0)::DOUBLE, 9) AS share
  FROM h""")
def head_audit(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    head = line.orderBy(*keys, *[c for c in line.columns if c not in keys]).limit(100)  # rows of one key by their other columns, so that reruns agree
    return head.agg(F.count("*").alias("called"), F.count_if(F.col("l_returnflag") == "N").alias("phased")).withColumn("share", F.round(F.try_divide("phased", "called"), 9))


@query("block_gating", 72, 75, views="variant", sql="""
WITH b AS (SELECT chrom, pos // 300000 AS block, count(*) AS sites FROM variant GROUP BY ALL HAVING count(*) >= 6),
r AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY block) AS i, count(*) OVER (PARTITION BY chrom) AS n FROM b)
SELECT chrom, block, sites, CASE WHEN i = 1 OR i = n THEN 'signal' ELSE 'context' END AS use FROM r WHERE i <= 4 OR i = n""")
def block_gating(spark: SparkSession, sf: str) -> DataFrame:
    b = v.variant(spark, sf).groupBy("chrom", F.floor(F.col("pos") / 300000).alias("block")).agg(F.count("*").alias("sites")).where("sites >= 6")
    r = b.select("*", F.row_number().over(Window.partitionBy("chrom").orderBy("block")).alias("i"), F.count("*").over(Window.partitionBy("chrom")).alias("n"))
    return r.where("i <= 4 or i = n").select("chrom", "block", "sites", F.when((F.col("i") == 1) | (F.col("i") == F.col("n")), "signal").otherwise("context").alias("use"))


@query("order_invariance", 77, views="genotype", sql="""
WITH a AS (SELECT variant, count(*) AS n, count(dosage) AS called, avg(dosage) / 2 AS af FROM genotype GROUP BY variant),
b AS (SELECT variant, count(*) AS n, count(dosage) AS called, avg(dosage) / 2 AS af FROM (SELECT * FROM genotype ORDER BY sample DESC, variant DESC) GROUP BY variant)
SELECT 'variant_quality' AS operator, (SELECT count(*) FROM b) AS variants, (SELECT CAST(sum(called) AS BIGINT) FROM b) AS called,
    NOT EXISTS (FROM a EXCEPT FROM b) AND NOT EXISTS (FROM b EXCEPT FROM a) AS unchanged""")
def order_invariance(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.stats import variant_quality

    quality = lambda g: variant_quality(g).select("variant", "n", "called", "af")
    same = guards.unchanged_by_order(v.genotype(spark, sf), quality)
    dealt_anew = quality(v.genotype(spark, sf).repartition(7, F.rand(1)))
    return dealt_anew.agg(F.count("*").alias("variants"), F.sum("called").alias("called")).select(F.lit("variant_quality").alias("operator"), "variants", "called", F.lit(same).alias("unchanged"))


@query("positional_pairing", 96, 216, sql="""
WITH a AS (SELECT row_number() OVER (ORDER BY p_partkey) AS i, p_partkey AS left_key
  FROM part), b AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS i, o_orderkey AS right_key FROM orders)
SELECT left_key, right_key FROM a JOIN b USING (i)""")
def positional_pairing(spark: SparkSession, sf: str) -> DataFrame:
    number = lambda df, c, n: numbering.numbered(df.select(c), "i", c).select("i", F.col(c).alias(n))
    return number(table(spark, sf, "part"), "p_partkey", "left_key").join(number(table(spark, sf, "orders"), "o_orderkey", "right_key"), "i").select("left_key", "right_key")


@query("simulated_genotypes", 166, sql="""
WITH g AS (SELECT s.r AS site, p.r AS person, (('0x' || substr(md5('sim:' || s.r || ':' || p.r || ':a'), 1,
    8))::BIGINT / 4294967296.0::DOUBLE) < 0.3 AS a, (('0x' || substr(md5('sim:' || s.r || ':' || p.r || ':b'), 1, 8))::BIGINT / 4294967296.0::DOUBLE) < 0.3 AS b
  FROM range(50) s(r), range(200) p(r))
SELECT site, count(*) AS n, CAST(sum(CAST(a AS INT) + CAST(b AS INT)) AS BIGINT) AS dosage FROM g GROUP BY site""")
def simulated_genotypes(spark: SparkSession, sf: str) -> DataFrame:
    grid = spark.range(50).select(F.col("id").alias("site")).crossJoin(spark.range(200).select(F.col("id").alias("person")))
    allele = lambda x: bernoulli(0.3, F.lit("sim"), "site", "person", F.lit(x)).cast("int")
    return grid.groupBy("site").agg(F.count("*").alias("n"), F.sum(allele("a") + allele("b")).alias("dosage"))


@query("greedy_spaced_sites", 187)
def greedy_spaced_sites(spark: SparkSession, sf: str) -> DataFrame:
    scored = v.variant(spark, sf).select("chrom", "pos", "variant", F.substring(keys.ranking_key(F.lit("g"), "variant"), 1, 8).alias("score"))
    return guards.greedy_apart(scored, "chrom", ["-score", "variant"], "pos", 50_000, 10)


def _holdout_sql(k: int, part: str, share: float) -> str:
    """One part's choice, from the blocks b<k - 1> to b<k>. Runs are lists of the rows that follow each block."""
    return f"""
n{k} AS (SELECT greatest(1, CAST(round_even(count(*) * {share}::DOUBLE, 0) AS BIGINT)) AS n FROM b0),
i{k} AS (SELECT *, row_number() OVER (PARTITION BY chrom ORDER BY start) AS i FROM b{k - 1}),
r{k} AS (SELECT x.chrom, x.block AS first, x.start AS s, max(y.stop) AS e, arg_max(y.block, y.i) AS last
  FROM i{k} x JOIN i{k} y ON x.chrom = y.chrom AND y.i BETWEEN x.i AND x.i + (SELECT n FROM n{k}) - 1
  GROUP BY ALL HAVING count(*) FILTER (WHERE y.role = 'train') = (SELECT n FROM n{k})),
c{k} AS (SELECT chrom AS c, s, e FROM r{k}
  ORDER BY sha256('hold' || chr(31) || '{part}' || chr(31) || first || chr(31) || last), chrom, s LIMIT 1),
b{k} AS (SELECT chrom, block, start, stop,
  CASE WHEN chrom = c AND start >= s AND stop <= e THEN '{part}'
       WHEN chrom = c AND role = 'train' AND start < e + 150000 AND greatest(0, s - 150000) < stop THEN 'buffer_{part}'
       ELSE role END AS role FROM b{k - 1}, c{k})"""


@query("guarded_block_holdout", 207, views="variant", sql=f"""
WITH b0 AS (SELECT DISTINCT chrom, chrom || ':' || CAST(pos // 100000 AS VARCHAR) AS block, pos // 100000 * 100000 AS start,
    pos // 100000 * 100000 + 100000 AS stop, 'train' AS role
  FROM variant),
{_holdout_sql(1, "test", 0.02)},
{_holdout_sql(2, "validation", 0.03)}
SELECT * FROM b2""")
def guarded_block_holdout(spark: SparkSession, sf: str) -> DataFrame:
    place = F.floor(F.col("pos") / 100_000)
    name = F.concat_ws(":", "chrom", place.cast("string"))
    blocks = v.variant(spark, sf).select("chrom", name.alias("block"), (place * 100_000).alias("start"), (place * 100_000 + 100_000).alias("stop")).distinct()
    return guards.guarded_holdout(blocks, {"test": 0.02, "validation": 0.03}, 150_000, "hold")


@query("scalar_math", 221, 223, 226, sql="""
SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS argmax,
    round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x))), 6) AS norm,
    round(ln(1 + abs(CAST(embedding[1] AS DOUBLE))), 9) AS log1p, round_even(CAST(label AS DOUBLE) / 4, 0) AS half_even,
  round(least(greatest(CAST(embedding[2] AS DOUBLE), -0.1), 0.1), 7) AS clipped,
      strftime(make_timestamp(1700000000000000 + vec_id * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS stamp
    FROM embeddings""")
def scalar_math(spark: SparkSession, sf: str) -> DataFrame:
    e = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1700000000) + F.col("vec_id")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, sf, "embeddings").select("vec_id", (F.array_position(e, F.array_max(e)) - 1).cast("int").alias("argmax"), F.round(F.sqrt(F.aggregate(e, F.lit(0.0), lambda s, x: s + x * x)), 6).alias("norm"), F.round(F.log1p(F.abs(e[0])), 9).alias("log1p"), F.bround(F.col("label").cast("double") / 4, 0).alias("half_even"), F.round(F.least(F.greatest(e[1], F.lit(-0.1)), F.lit(0.1)), 7).alias("clipped"), stamp.alias("stamp"))


@query("arm_registry", 229, 230, sql="""
SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 7) AS first, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) / len(embedding), 7) AS mean
  FROM embeddings""")
def arm_registry(spark: SparkSession, sf: str) -> DataFrame:
    return _arms(table(spark, sf, "embeddings"))


def _arms(embeddings: DataFrame) -> DataFrame:
    e = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    arms = {"first": e[0], "mean": F.aggregate(e, F.lit(0.0), lambda s, x: s + x) / F.size(e)}
    return embeddings.select("vec_id", *[F.round(c, 7).alias(name) for name, c in arms.items()])


@query("schema_contract", 61, 137, sql="""
SELECT table_name AS name, CAST(count(*) AS INTEGER) AS columns,
  coalesce(string_agg(column_name, ',' ORDER BY ordinal_position) FILTER (WHERE lower(column_name) IN ('name', 'email', 'phone', 'address',
      'birth_date')), '') AS identifying
FROM information_schema.columns WHERE table_schema = 'main' GROUP BY table_name""")
def schema_contract(spark: SparkSession, sf: str) -> DataFrame:
    folder = spark._jvm.org.apache.hadoop.fs.Path(sf)
    files = [f.getPath().getName() for f in folder.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(folder)]
    names = sorted(f.removesuffix(".parquet") for f in files if f.endswith(".parquet"))
    found = [(n, len(table(spark, sf, n).columns), ",".join(guards.identifying_paths(table(spark, sf, n).schema))) for n in names]
    return spark.createDataFrame(found, "name string, columns int, identifying string")


@query("interval_contract", 59, views="interval", sql="""
SELECT 'empty' AS problem, chrom, start FROM interval WHERE start >= stop UNION ALL SELECT 'overlap', a.chrom, a.start FROM interval a
  JOIN interval b ON a.chrom = b.chrom AND a.start < b.start AND b.start < a.stop GROUP BY ALL""")
def interval_contract(spark: SparkSession, sf: str) -> DataFrame:
    spans = v.interval(spark, sf).select("chrom", "start", "stop")
    crossing = intervals.overlapping(spans, spans).where("start < r_start").select(F.lit("overlap").alias("problem"), "chrom", "start").distinct()
    return spans.where("start >= stop").select(F.lit("empty").alias("problem"), "chrom", "start").unionByName(crossing)


@query("inventory_violations", 61, 218, sql="""
WITH o AS (SELECT o_orderkey AS k, o_orderstatus AS s, o_orderpriority AS p, o_totalprice AS t FROM orders),
l AS (SELECT l_orderkey AS k, list({'name': CAST(l_linenumber AS VARCHAR), 'digest': {'algorithm': CASE l_returnflag WHEN 'A' THEN 'md5' WHEN 'R' THEN 'none' ELSE 'sha256_full' END}} ORDER BY l_linenumber, translate(l_returnflag, 'ANR', '132')) AS files,
    list(l_returnflag ORDER BY l_linenumber) AS flags FROM lineitem GROUP BY l_orderkey),
j AS (SELECT CAST(o.k AS VARCHAR) AS id, s, p, files, flags FROM o LEFT JOIN l USING (k)),
f AS (SELECT id, unnest(files) AS f, generate_subscripts(files, 1) - 1 AS i FROM j)
SELECT id, 'unknown algorithm' AS problem, 'genotype_filesets[0].files[' || i || '].digest.algorithm' AS path FROM f WHERE f.digest.algorithm = 'md5'
UNION ALL SELECT id, 'not false', 'identifiers_included' FROM j WHERE s = 'P'
UNION ALL SELECT id, 'missing', 'blocking' FROM j WHERE p = '1-URGENT'
UNION ALL SELECT id, 'not as declared', 'classification' FROM j WHERE s = 'F'
UNION ALL SELECT id, 'forbidden key', 'kinship_files.parsed.members' FROM j WHERE len(flags) > 2
UNION ALL SELECT id, 'long text list', 'kinship_files.parsed.members' FROM j WHERE len(flags) > 4""")
def inventory_violations(spark: SparkSession, sf: str) -> DataFrame:
    from tessera.operators.inventory import violations

    line = table(spark, sf, "lineitem")
    algorithm = F.when(F.col("l_returnflag") == "A", "md5").when(F.col("l_returnflag") == "R", "none").otherwise("sha256_full")
    member = F.struct("l_linenumber", F.struct(F.col("l_linenumber").cast("string").alias("name"), F.struct(algorithm.alias("algorithm")).alias("digest")).alias("file"), F.col("l_returnflag").alias("flag"))
    lines = line.groupBy(F.col("l_orderkey").alias("k")).agg(F.array_sort(F.collect_list(member)).alias("m"))  # an order's lines
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p")).join(lines, "k", "left")
    body = F.struct(
        F.when(F.col("s") == "F", "OTHER").otherwise("INVENTORY").alias("classification"),
        (F.col("s") == "P").alias("identifiers_included"),
        F.array(F.struct(F.transform("m", lambda x: x["file"]).alias("files"))).alias("genotype_filesets"),
        F.struct(F.struct(F.when(F.size("m") > 2, F.transform("m", lambda x: x["flag"])).alias("members")).alias("parsed")).alias("kinship_files"),
        F.when(F.col("p") != "1-URGENT", F.array().cast("array<string>")).alias("blocking"),
    )
    documents = o.select(F.col("k").cast("string").alias("id"), F.to_json(body).alias("body"))
    return violations(documents, "id", "body", required=["blocking"], must_be_false=["identifiers_included"], constants={"classification": "INVENTORY"}, longest_list=4)
