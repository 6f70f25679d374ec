"""Mixing sources to target weights, with DataFrame functions only.

Each row gets a hash-random key. Within a source the rows are dealt by the
key's leading hex digits into ranges, so that a source with any share of all
rows spreads over every range; range sums give each range its offset, and a
window inside a range finishes the distributed prefix sum. The source's whole
budget is then whole epochs of all its rows plus a cut through that order.

Defined cases: null text has size 0 and takes nothing; very long texts count
and are cut whole, by words; a null source is a source of its own, last in
order; rows that repeat an id stand beside each other in the order and each
counts, those that are alike in size too in any order; a table without words
has targets 0; an empty table gives an empty result; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import WORDS, whole_row
from tessera.session import keep

#: Leading hex digits of a key that name its range: 4096 ranges of a source.
RANGE_DIGITS = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("bigint")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """source, source_size, target from (source, source_size), one row a source.

    Sorted by how soon a source reaches its cap, the level with the first k
    sources capped is (total - caps) / (weights left); the final level is the
    largest of these.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double")
    weighed = sizes.select("source", "source_size", weight.alias("weight"))
    by_cap = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(1))
    level = (F.sum("source_size").over(every).cast("double") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)).cast("double")) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    levels = weighed.select("*", level.alias("level")).select("*", F.max("level").over(every).alias("final"))
    return levels.select("source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.col("weight") * F.col("final")).alias("target"))


def mix_to_weights(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, source, size, source_size, target, key, epochs, taken for every row of docs.

    taken words of a row are `epochs` times its size plus the words that the
    cut leaves of it in the last, partial epoch.
    """
    key = F.md5(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary"))
    rows = keep(docs.select(docs[id_col].alias("doc_id"), docs[source_col].alias("source"), word_count(docs[text_col]).alias("size"), key.alias("key")).withColumn("range", F.substring("key", 1, RANGE_DIGITS)), "mix")
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("range_size"))
    targets = source_targets(ranges.groupBy("source").agg(F.sum("range_size").alias("source_size")), weights, most)
    offset = F.sum("range_size").over(Window.partitionBy("source").orderBy("range")) - F.col("range_size")
    budgets = ranges.select("source", "range", offset.alias("offset")).alias("r").join(targets.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.source", "r.range", "r.offset", "t.source_size", "t.target")
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = rows.select("*", (F.sum("size").over(inside) - F.col("size")).alias("before"))
    joined = local.alias("d").join(budgets.alias("b"), F.col("d.source").eqNullSafe(F.col("b.source")) & (F.col("d.range") == F.col("b.range"))).select("d.*", "b.offset", "b.source_size", "b.target")
    budget = F.floor("target")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    cut = F.greatest(F.lit(0), F.least("size", budget - F.col("epochs") * F.col("source_size") - F.col("offset") - F.col("before"))).cast("bigint")
    return joined.withColumn("epochs", epochs).select("doc_id", "source", "size", "source_size", "target", "key", "epochs", (F.col("epochs") * F.col("size") + cut).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """docs with each row as often as the mix takes it.

    The row that a source's cut goes through gives one more copy, of its
    first words joined by single spaces. Rows that repeat (doc_id, source,
    size) are told apart by a digest of all their columns.
    """
    text = F.col("row.text")
    named = docs.select(whole_row(docs))
    fields = named.schema["row"].dataType.fieldNames()
    bare = F.col("row").dropFields("text") if len(fields) > 1 else F.lit(None)
    digest = F.sha2(F.concat_ws("\u001f", F.to_json(F.struct(bare.alias("rest")), {"ignoreNullFields": "false"}), text.isNull().cast("string"), F.coalesce(text, F.lit(""))), 256)
    unique = named.select("row", digest.alias("id"))
    plan = mix_to_weights(unique.select("id", text.alias("text"), F.col("row.source").alias("source")), weights, most, id_col="id")
    plan = plan.groupBy(F.col("doc_id").alias("id")).agg(F.max("size").alias("size"), F.sum("taken").alias("taken"))
    full = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size"))).otherwise(F.lit(0))
    rest = F.col("taken") - full * F.col("size")
    # equal rows share one total; the first of them carries all their copies
    firsts = unique.dropDuplicates(["id"]).join(plan, "id")
    lengths = F.concat(F.array_repeat(F.lit(-1).cast("bigint"), full.cast("int")), F.when(rest > 0, F.array(rest.cast("bigint"))).otherwise(F.array().cast("array<bigint>")))
    cut = firsts.select("row", F.explode(lengths).alias("words"))
    words = F.regexp_extract_all(text, F.lit(f"({WORDS})"), F.lit(1))
    shown = F.when(F.col("words") < 0, text).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("words").cast("int")), " "))
    out = cut.withColumn("row", F.col("row").withField("text", shown))
    if "n_chars" in fields:
        out = out.withColumn("row", F.col("row").withField("n_chars", F.length("row.text").cast(dict(docs.dtypes)["n_chars"])))
    return out.select("row.*")
