"""The trie of conversation prefixes, with its shared tokens.

Every conversation is rebuilt (the first turns of another one, then its own)
and each of its prefixes gets a digest: running sums, over turns, of hashes that
depend on the turn's place, so that a conversation of any length spreads over
many ranges. A prefix's owner is the smallest conversation that starts with it.
Whoever owns a prefix owns its own longer ones too, so the owned part of a
conversation is a chain down to its end, and a binary search finds where it
begins: each round joins all open conversations, one row each, with the prefix
minima. The last prefix found not to be owned names the chain's parent. Sums
run from each chain's end upwards; each chain then adds its total to every
prefix above its head, in one partially aggregated pass instead of one round a
level of the trie.

Defined cases: turns follow turn (null first), role, text; a null role or text
is empty; rows with a null conv_id belong to no conversation and take no part;
repeated rows are turns of their own; texts are handled whole; an empty table
has no conversations and no nodes, not even a root; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.numbering import running_in_groups
from tessera.session import keep, ship

#: A key with at least this many rows, and at least a thousandth of all, is joined by broadcast: at most a thousand keys.
HEAVY, SHARE = 10_000, 1000
LANES = 4
EMPTY_SHA = hashlib.sha256(b"").hexdigest()
ENDS_SCHEMA = "node string, ends_sha256 string"


def looked_up(rows: DataFrame, known: DataFrame, key: str, total: int) -> DataFrame:
    """rows left-joined with known, one row a key; keys that many of the rows ask for are broadcast, the others shuffled."""
    often = rows.groupBy(key).count().where(F.col("count") >= max(HEAVY, total // SHARE)).select(key)
    heavy = F.broadcast(known.join(F.broadcast(often), key, "left_semi"))
    return rows.join(heavy, key).unionByName(rows.join(F.broadcast(heavy.select(key)), key, "left_anti").join(known, key, "left"))


def rebuilt(conversations: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """(conv_id, depth, chars, turn digest) of all rebuilt turns, depth from 1; and conv_id of all conversations."""
    rows = conversations.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    placed = running_in_groups(rows, "conv_id", [F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")], {"place": F.lit(1)})
    parts = F.concat_ws(":", F.octet_length("role"), "role", "text")
    turns = keep(placed.select("conv_id", "place", F.char_length("text").cast("bigint").alias("chars"), F.sha2(parts, 256).alias("turn")), "turns")
    own = turns.groupBy("conv_id").agg(F.max("place").alias("n"))
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % most
    base = F.col("conv_id") - F.col("conv_id") % block
    lengths = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = keep(own.select("conv_id", "n", head.alias("head"), base.alias("base")).join(lengths, "base", "left").select("conv_id", "n", "head", "base", F.least("head", F.coalesce("base_n", F.lit(0))).alias("taken")), "conversations")
    first = turns.where(F.col("place") < most).select(F.col("conv_id").alias("base"), "place", "chars", "turn")
    borrowed = convs.where("taken > 0").select("conv_id", "base", "taken").join(first, "base").where("place <= taken").select("conv_id", F.col("place").alias("depth"), "chars", "turn")
    later = turns.where(F.col("place") > head)
    kept = looked_up(later, convs.select("conv_id", "head", "taken"), "conv_id", turns.count())
    return borrowed.unionByName(kept.select("conv_id", (F.col("place") - F.col("head") + F.col("taken")).alias("depth"), "chars", "turn")), convs.select("conv_id")


def _node(depth: Column, sums: list[str]) -> Column:
    return F.md5(F.concat_ws(",", depth, *sums).cast("binary"))


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, node) of every prefix of every conversation, the root's of depth 0 included."""
    names = [f"s{i}" for i in range(LANES)]
    salted = F.md5(F.concat_ws(":", "depth", "turn").cast("binary"))
    lanes = {n: F.conv(F.substring("hash", 8 * i + 1, 8), 16, 10).cast("bigint") for i, n in enumerate(names)}
    summed = running_in_groups(turns.withColumn("hash", salted).drop("turn"), "conv_id", [F.col("depth")], lanes)
    deeper = summed.select("conv_id", "depth", "chars", _node(F.col("depth"), names).alias("node"))
    return keep(deeper.unionByName(convs.select("conv_id", F.lit(0).cast("bigint").alias("depth"), F.lit(0).cast("bigint").alias("chars"), F.md5(F.lit("root").cast("binary")).alias("node"))), "prefixes")


def first_owned(paths: DataFrame, shared: DataFrame, lengths: DataFrame) -> DataFrame:
    """(conv_id, last, first, parent): the depth of the first prefix that each conversation owns, last + 1 if none, and the owner of the one before.

    shared: (node, owner) of the prefixes with several members; any other is its only member's.
    """
    n, longest = lengths.agg(F.count("*"), F.max("last")).first()
    nothing = F.lit(None).cast("bigint")
    open_, done = lengths.select("conv_id", "last", F.lit(0).cast("bigint").alias("low"), (F.col("last") + 1).alias("high"), nothing.alias("parent")), []
    for _ in range(((longest or 0) + 1).bit_length() if n else 0):
        asked = open_.withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2)).join(paths.select("conv_id", "depth", "node"), ["conv_id", "depth"])
        found = looked_up(asked, shared, "node", n)
        owned = F.col("owner").isNull() | (F.col("owner") == F.col("conv_id"))
        moved = found.select("conv_id", "last", F.when(owned, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owned, F.col("depth")).otherwise(F.col("high")).alias("high"), F.when(owned, F.col("parent")).otherwise(F.col("owner")).alias("parent"))
        moved = keep(moved, "searched")
        done.append(moved.where("low = high"))
        open_ = moved.where("low < high")
    every = reduce(DataFrame.unionByName, done) if done else open_
    return every.select("conv_id", "last", F.col("low").alias("first"), "parent")


def _runs(values: list) -> list[tuple[int, int]]:
    cuts = [0, *[i for i in range(1, len(values)) if values[i] != values[i - 1]], len(values)]
    return list(zip(cuts[:-1], cuts[1:], strict=True)) if values else []


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) rows as comma-joined runs."""
    for batch in batches:
        nodes, ids = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        runs = _runs(nodes)
        yield pa.RecordBatch.from_arrays([pa.array([nodes[a] for a, _ in runs]), pa.array(ids[[a for a, _ in runs]] if runs else np.zeros(0, np.int64)), pa.array([",".join(map(str, ids[a:b].tolist())) for a, b in runs])], ["node", "from_id", "ids"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node, over its runs in order; only a running hash is held."""
    now, running = None, None
    for batch in batches:
        nodes, hashes = [], []
        for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if node != now:
                if now is not None:
                    nodes.append(now)
                    hashes.append(running.hexdigest())
                now, running = node, hashlib.sha256(ids.encode())
            else:
                running.update(("," + ids).encode())
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.string()), pa.array(hashes, pa.string())], ["node", "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([running.hexdigest()])], ["node", "ends_sha256"])


def ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of (node, conv_id): ids are joined within ranges, so that one task gets runs of them and not a crowded node's rows."""
    alone = ends.groupBy("node").agg(F.count("*").alias("n"), F.min("conv_id").alias("conv_id")).where("n = 1")
    crowded = ends.join(alone.select("node"), "node", "left_anti")
    runs = keep(crowded.select("node", "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_chunks, "node string, from_id bigint, ids string"), "end-runs")
    many = runs.repartition("node").sortWithinPartitions("node", "from_id").mapInArrow(_digests, ENDS_SCHEMA)
    return many.unionByName(alone.select("node", F.sha2(F.col("conv_id").cast("string"), 256).alias("ends_sha256")))


def prefix_trie(conversations: DataFrame, block: int = 100, most: int = 6) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    ship(conversations.sparkSession)
    turns, convs = rebuilt(conversations, block, most)
    paths = prefixes(turns, convs)
    lengths = keep(paths.groupBy("conv_id").agg(F.max("depth").alias("last")), "lengths")
    nodes = keep(paths.groupBy("node").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.min("chars").alias("chars")), "nodes")
    chains = keep(first_owned(paths, nodes.where("n_convs > 1").select("node", "owner"), lengths), "chains")
    # what is known of single nodes, named by owner and depth: chain heads, chain ends, chains that hang below
    nothing = F.lit(None).cast("bigint")
    owning = chains.where("first <= last")
    heads = owning.select("conv_id", F.col("first").alias("depth"), F.lit(True).alias("head"), "parent", F.lit(False).alias("end"), F.lit(0).alias("below"))
    ends = owning.select("conv_id", F.col("last").alias("depth"), F.lit(False).alias("head"), nothing.alias("parent"), F.lit(True).alias("end"), F.lit(0).alias("below"))
    below = owning.where("parent IS NOT NULL").select(F.col("parent").alias("conv_id"), (F.col("first") - 1).alias("depth"), F.lit(False).alias("head"), nothing.alias("parent"), F.lit(False).alias("end"), F.lit(1).alias("below"))
    facts = heads.unionByName(ends).unionByName(below).groupBy("conv_id", "depth").agg(F.max("head").alias("head"), F.max("parent").alias("parent"), F.max("end").alias("end"), F.sum("below").alias("below"))
    known = nodes.withColumnRenamed("owner", "conv_id").join(facts, ["conv_id", "depth"], "left")
    children = F.coalesce("below", F.lit(0)) + F.when(F.coalesce("end", F.lit(False)), 0).otherwise(1)
    # sums from each chain's end up to each of its nodes
    own = known.select("node", "conv_id", "depth", "n_convs", F.when(F.col("head"), F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), children.cast("bigint").alias("n_children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved"))
    summed = keep(running_in_groups(own, "conv_id", [F.col("depth").desc()], {"leaves_in_chain": (F.col("n_children") == 0).cast("bigint"), "saved_in_chain": F.col("saved")}), "chain-sums")
    # each chain's total goes to every prefix above its head
    top = chains.where("first <= last").join(summed.select("conv_id", F.col("depth").alias("first"), "leaves_in_chain", "saved_in_chain"), ["conv_id", "first"]).select("conv_id", "first", "leaves_in_chain", "saved_in_chain")
    n_paths = paths.count()
    above = looked_up(paths.select("conv_id", "depth", "node"), top, "conv_id", n_paths).where("depth < first")
    sent = above.groupBy("node").agg(F.sum("leaves_in_chain").alias("more_leaves"), F.sum("saved_in_chain").alias("more_saved"))
    last = paths.join(lengths.select("conv_id", F.col("last").alias("depth")), ["conv_id", "depth"], "left_semi")
    out = summed.join(sent, "node", "left").join(ends_digests(last.select("node", "conv_id")), "node", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_in_chain") + F.coalesce("more_leaves", F.lit(0))).alias("n_leaves"),
        (F.col("saved_in_chain") + F.coalesce("more_saved", F.lit(0))).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
