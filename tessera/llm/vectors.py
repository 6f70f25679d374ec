"""A stated query set against all vectors, in blocks: the base of both searches.

Vectors are dealt by a hash of their place into shards of bounded size, however
often an id repeats, and each shard becomes
one index, held as one row of bytes. Queries are dealt into blocks of bounded
size. Each block meets each shard of its own dimension once, in a task that
holds one shard and one block, and gives at most k rows a query; the k best of
these are the result. A dimension's first shard is searched before its others,
which then need no rows that score less than a query's k-th best there.

Vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows without an id. Rows that repeat an id are candidates each,
but never for a query of that id. Queries that repeat an id give one ranking,
that of the shortest vector, among these of the first by its components.
Vectors are compared only with those of their own dimension. An empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.blocks import bounded_batches
from tessera.session import keep

#: Rows of a shard and of a query block.
SHARD_ROWS, BLOCK_ROWS = 8192, 4096
HITS = "query_id bigint, vec_id bigint, score {score}"


def usable(vectors: DataFrame, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """vec_id, v (array<double>), dim of the rows that take part."""
    v = F.col("v")
    rows = vectors.select(vectors[id_col].cast("bigint").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    if nonzero:
        rows = rows.where(F.exists(v, lambda x: x != 0))
    return rows.withColumn("dim", F.size(v))


def _stacked(batch: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column("vec_id").combine_chunks().to_numpy()
    flat = batch.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    rows = flat.reshape(len(ids), -1)
    order = np.lexsort([*rows.T[::-1], ids])
    return ids[order], rows[order]


def _dealt(rows: DataFrame, size: int, make: Callable[[np.ndarray, np.ndarray], object], name: str) -> DataFrame:
    """One row (dim, part, parts, blob) for each part of about `size` vectors of a dimension."""
    counts = rows.groupBy("dim").agg(F.count("*").alias("n")).select("dim", F.greatest(F.lit(1), F.ceil(F.col("n") / size)).cast("int").alias("parts"))
    parted = rows.join(F.broadcast(counts), "dim") if _few(counts) else rows.join(counts, "dim")
    parted = parted.withColumn("part", F.pmod(F.xxhash64("place"), F.col("parts")).cast("int"))

    def run(group: pa.Table) -> pa.Table:
        ids, values = _stacked(group)
        return pa.table({"dim": group.column("dim")[:1], "part": group.column("part")[:1], "parts": group.column("parts")[:1], "blob": pa.array([pickle.dumps(make(ids, values), protocol=5)], pa.binary())})

    return keep(parted.groupBy("dim", "part").applyInArrow(run, "dim int, part int, parts int, blob binary"), name)


def _few(counts: DataFrame, most: int = 10_000) -> bool:
    """Whether the table of dimensions is small enough to broadcast."""
    return len(counts.limit(most + 1).collect()) <= most


def search(vectors: DataFrame, queries, k: int, make: Callable, probe: Callable, score_type: str, id_col: str, vector_col: str, nonzero: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score.

    queries: predicate column over vec_id. make(ids, rows) gives a shard's
    index; probe(index, ids, rows, floors) yields (query_id, vec_ids, scores), and
    may leave out rows that score less than the query's floor, if it has one.
    """
    bounded_batches(vectors.sparkSession)
    vectors.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    rows = keep(usable(vectors, id_col, vector_col, nonzero).withColumn("place", F.monotonically_increasing_id()), "vectors")
    shards = _dealt(rows, SHARD_ROWS, make, "shards")
    # the least row of each id, so that no ranking mixes two rows or two dimensions
    asking = rows.where(queries).groupBy("vec_id").agg(F.min(F.struct("dim", "v", "place")).alias("least")).select("vec_id", "least.*")
    blocks = _dealt(asking, BLOCK_ROWS, lambda ids, values: (ids, values), "query-blocks")
    counts = shards.select("dim", F.col("parts").alias("shards")).distinct()
    sent = blocks.select("dim", F.col("part").alias("block"), F.col("blob").alias("asked")).join(counts, "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("part"), "block", "asked")
    met = shards.select("dim", "part", "blob").join(sent, ["dim", "part"]).select("dim", "part", "block", "blob", "asked")
    kind = pa.int64() if score_type == "bigint" else pa.float64()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                name = (batch.column(0)[i].as_py(), batch.column(1)[i].as_py())
                if name != held:
                    held, index = name, pickle.loads(batch.column(3)[i].as_buffer())
                ids, values = pickle.loads(batch.column(4)[i].as_buffer())
                floors = {f["query_id"]: f["score"] for f in batch.column(5)[i].as_py() or []}
                q, v, s = [], [], []
                for query, found, scores in probe(index, ids, values, floors):
                    q.append(np.full(len(found), query, np.int64))
                    v.append(found)
                    s.append(scores)
                if q:
                    n = sum(map(len, q))
                    block = np.full(n, batch.column(2)[i].as_py(), np.int32)
                    columns = [pa.array(np.full(n, name[0], np.int32)), pa.array(block), pa.array(np.concatenate(q)), pa.array(np.concatenate(v)), pa.array(np.concatenate(s), kind)]
                    yield pa.RecordBatch.from_arrays(columns, ["dim", "block", "query_id", "vec_id", "score"])

    schema = "dim int, block int, " + HITS.format(score=score_type)
    columns = ["dim", "part", "block", "blob", "asked", "floors"]
    hits_of = lambda rows: rows.select(columns).mapInArrow(run, schema)
    # the first shard's k-th best scores are floors for all other shards
    none = F.lit(None).cast(f"array<struct<query_id:bigint,score:{score_type}>>")
    first = keep(hits_of(met.where("part = 0").withColumn("floors", none)), "hits")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("dim", "query_id").orderBy(F.col("score").desc(), "vec_id")))
    floors = ranked.where(F.col("rank") == k).groupBy("dim", "block").agg(F.collect_list(F.struct("query_id", "score")).alias("floors"))
    hits = first.unionByName(hits_of(met.where("part > 0").join(floors, ["dim", "block"], "left")))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
