"""Text tables: headers, keys, lists, curves and interval files."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.values import bare_chromosome, number
from tessera.operators.relational import one_of_key

#: Names under which files give a pair of ids and their kinship (fixed values).
PAIR_NAMES = {"a": ("id1", "iid1", "sample1", "ind1"), "b": ("id2", "iid2", "sample2", "ind2"), "value": ("kinship", "phi", "pi_hat", "coefficient")}


def read_tsv(spark: SparkSession, path: str | list[str], sep: str = "\t") -> DataFrame:
    """A table with a header, every column as text; gzip and a byte-order mark are handled by the reader."""
    return spark.read.csv(path, sep=sep, header=True, inferSchema=False, mode="PERMISSIVE")


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    """df, or an error that names the columns it lacks."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_line(df: DataFrame) -> DataFrame:
    """df with line: an order of rows that follows the files' order within each file."""
    return df.select("*", F.struct(F.col("_metadata.file_path"), F.monotonically_increasing_id()).alias("line"))


def read_keyed(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """Chosen columns by key; rows without a key are skipped and the last of equal keys stays."""
    rows = with_line(required(read_tsv(spark, path), [key, *columns])).where(F.trim(F.coalesce(key, F.lit(""))) != "")
    return one_of_key(rows, [key], [F.desc("line")]).select(key, *columns)


def read_strata(spark: SparkSession, path: str, key: str, columns: list[str]) -> DataFrame:
    """Keyed strata; blanks are NA."""
    rows = read_keyed(spark, path, key, columns)
    return rows.select(key, *[F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit("NA")).alias(c) for c in columns])


def read_ids(spark: SparkSession, path: str | list[str], column: int = 0) -> DataFrame:
    """Distinct ids: the given field of each line, without blank and # lines."""
    line = F.trim("value")
    return spark.read.text(path).where((line != "") & ~line.startswith("#")).select(F.get(F.split(line, r"\s+"), F.lit(column)).alias("id")).where("id is not null").distinct()


#: Id field, from 0, and header lines of sample files by suffix (fixed values).
SAMPLE_FORMATS = {".fam": (1, 0), ".psam": (0, 1), ".sample": (1, 2)}


def read_sample_ids(spark: SparkSession, path: str, column: int | None = None) -> DataFrame:
    """Ids of a sample file in file order, by its suffix; other files give their first field."""
    field, skip = next((v for s, v in SAMPLE_FORMATS.items() if path.endswith(s)), (0, 0))
    lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("n"), F.split(F.trim("value"), r"\s+").alias("f"))
    heads = [r["n"] for r in lines.orderBy("n").limit(skip).collect()]
    return lines.where(~F.col("n").isin(heads) if heads else F.lit(True)).select("n", F.get("f", F.lit(field if column is None else column)).alias("id")).where("id <> ''")


def aliased(df: DataFrame, names: dict[str, tuple[str, ...]], default: str = "UNKNOWN") -> DataFrame:
    """Columns under their first alias that the table has, or the default."""
    present = {c.lower(): c for c in df.columns}
    pick = lambda aliases: next((F.coalesce(F.nullif(F.trim(present[a.lower()]), F.lit("")), F.lit(default)) for a in aliases if a.lower() in present), F.lit(default))
    return df.select(*[pick(aliases).alias(name) for name, aliases in names.items()])


def read_first_column(spark: SparkSession, path: str) -> DataFrame:
    """The first field of each line; tabs, commas or nothing part the fields, as the first line shows."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    head = lines.first()
    sep = "\t" if head and "\t" in head[0] else "," if head and "," in head[0] else None
    value = F.trim(F.substring_index("value", sep, 1) if sep else F.col("value"))
    titled = head is not None and re.fullmatch(r"(?i)#?(sample|id|iid|sample_id)", (head[0].split(sep)[0] if sep else head[0]).strip())
    return lines.select(value.alias("id")).where(F.col("id") != (head[0].split(sep)[0] if sep else head[0]).strip() if titled else F.lit(True))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """Headerless site metrics of nine fields; a line of another length is an error."""
    schema = "chrom string, pos long, ref string, alt string, ac long, an long, af double, maf double, f_missing double"
    return spark.read.csv(path, sep="\t", schema=schema, mode="FAILFAST")


def named_in_head(spark: SparkSession, path: str, pattern: str, head: int = 64 << 20, overlap: int = 64) -> list[str]:
    """Distinct matches of a pattern in the first `head` bytes of one file of any format: the columns that its header names."""
    raw = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, head).alias("b"))
    pieces = raw.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("b"), F.lit(1 << 20)), lambda lo: F.expr("b").substr(lo + 1, F.lit((1 << 20) + overlap)))).alias("piece"))
    found = pieces.select(F.explode(F.regexp_extract_all(F.decode("piece", "ISO-8859-1"), F.lit(f"({pattern})"), F.lit(1))).alias("name"))
    return sorted(r["name"] for r in found.distinct().collect())


def pair_columns(columns: list[str]) -> dict[str, str]:
    """Which columns hold the pair's ids and its value; what is missing is left out."""
    low = {c.lower(): c for c in columns}
    return {name: low[a] for name, aliases in PAIR_NAMES.items() for a in aliases[::-1] if a in low}


def read_kinship(spark: SparkSession, path: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Undirected pairs at or over the threshold, and a frame with the number of lines that cannot be read."""
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.split(F.trim("value"), r"\s+").alias("f"))
    head = lines.first()
    names = [x.lower() for x in head["f"]] if head else []
    found = pair_columns(names)
    if len(found) < 3:
        raise ValueError("no id pair and kinship value in the header")
    get = lambda name: F.get("f", F.lit(names.index(found[name])))
    rows = lines.where(F.lower(F.array_join("f", " ")) != " ".join(names)).select(get("a").alias("x"), get("b").alias("y"), get("value").try_cast("double").alias("value"))
    bad = rows.agg(F.count_if(F.col("value").isNull() | F.col("y").isNull()).alias("unreadable"))
    pairs = rows.where((F.col("value") >= threshold) & (F.col("x") != F.col("y"))).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "value")
    return pairs.groupBy("a", "b").agg(F.max("value").alias("value")), bad


def relationship_edges(df: DataFrame, text: str, own: str, allowed: DataFrame) -> DataFrame:
    """Edges from texts such as "sibling: id1,id2" between allowed ids (column id)."""
    others = F.transform(F.split(F.element_at(F.split(text, ":", 2), -1), ","), lambda x: F.trim(x))  # noqa: PLW0108  trim has a second parameter
    edges = df.select(F.col(own).alias("x"), F.explode(others).alias("y")).where("x <> y and y <> ''")
    for side in ("x", "y"):
        edges = edges.join(allowed.select(F.col("id").alias(side)), side, "left_semi")
    return edges.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def read_curve(spark: SparkSession, path: str, metric: str, step: str = "step") -> DataFrame:
    """(step, metric) of a JSON-lines curve."""
    return spark.read.json(path).select(F.col(step).cast("bigint").alias("step"), F.col(metric).cast("double").alias("metric"))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """BED lines as (chrom without chr, start, stop, name, score)."""
    f = F.split("value", r"\t")
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^(#|track|browser|\s*$)"))
    return lines.select(bare_chromosome(F.get(f, F.lit(0))).alias("chrom"), F.get(f, F.lit(1)).try_cast("bigint").alias("start"), F.get(f, F.lit(2)).try_cast("bigint").alias("stop"), F.coalesce(F.get(f, F.lit(3)), F.lit(".")).alias("name"), F.coalesce(F.get(f, F.lit(4)).try_cast("double"), F.lit(1.0)).alias("score")).where("start is not null and stop is not null")


def promoter_windows(genes: DataFrame, radius: int = 50_000) -> DataFrame:
    """(chrom, tss, start, stop) around each transcription start once; genes: chrom, strand, start, stop."""
    tss = F.when(F.col("strand") == "-", F.col("stop") - 1).otherwise(F.col("start"))
    return genes.select(bare_chromosome(F.col("chrom")).alias("chrom"), tss.alias("tss")).distinct().select("chrom", "tss", F.greatest(F.col("tss") - radius, F.lit(0)).alias("start"), (F.col("tss") + radius).alias("stop"))


def read_point_scores(spark: SparkSession, path: str, column: str) -> DataFrame:
    """(chrom, pos, score); unreadable scores are dropped and the last of equal positions stays."""
    rows = with_line(required(read_tsv(spark, path), ["chrom", "pos", column]))
    rows = rows.select(bare_chromosome(F.col("chrom")).alias("chrom"), F.col("pos").try_cast("bigint").alias("pos"), number(F.col(column)).alias("score"), "line").where("score is not null and not isnan(score)")
    return one_of_key(rows, ["chrom", "pos"], [F.desc("line")]).drop("line")


def long_matrix(df: DataFrame, ids: list[str], wanted: list[str], name: str = "sample", value: str = "value") -> DataFrame:
    """A wide matrix as (ids, name, value), reading the wanted columns only."""
    required(df, [*ids, *wanted])
    return df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in wanted]).unpivot(ids, [F.col(f"`{c}`") for c in wanted], name, value)


def path_kind(path: Column) -> Column:
    """Category of a file by its name (fixed rules)."""
    rules = [("genotype", r"\.(bed|bim|fam|pgen|pvar|psam|bgen|vcf|bcf)(\.gz)?$"), ("kinship", r"(kin|king|related)[^/]*$"), ("map", r"(genetic_map|\.map)[^/]*$"), ("table", r"\.(tsv|csv|txt|parquet)(\.gz)?$")]
    out = F.when(F.lower(path).rlike(rules[0][1]), rules[0][0])
    for name, rule in rules[1:]:
        out = out.when(F.lower(path).rlike(rule), name)
    return out.otherwise("other")


def inventory(spark: SparkSession, root: str) -> DataFrame:
    """One row a file below root: path, bytes, kind, stem; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    stem = F.regexp_replace("path", r"(\.gz)?$", "")
    return files.select("path", F.col("length").alias("bytes"), path_kind(F.col("path")).alias("kind"), F.regexp_replace(stem, r"\.[^./]+$", "").alias("stem"))


def filesets(files: DataFrame) -> DataFrame:
    """Files by stem: their suffixes in order, total bytes, and whether bed, bim and fam are all there."""
    suffix = F.regexp_extract("path", r"\.([^./]+)(\.gz)?$", 1)
    sets = files.groupBy("stem").agg(F.sort_array(F.collect_set(suffix)).alias("suffixes"), F.sum("bytes").alias("bytes"))
    return sets.withColumn("complete", F.size(F.array_intersect("suffixes", F.array(*map(F.lit, ("bed", "bim", "fam"))))) == 3)
