"""Sharding by weighted rendezvous hashing of stable record keys. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import chunks_for, documents, number_rows, salted

SHARDS = 16


def rendezvous(key: Column, weights: Sequence[float], seed: int = 17) -> Column:
    """The shard of `key`: the one with the least -ln(u) / weight, u being a hash of (key, shard) in (0, 1).

    A shard wins a share of the keys in proportion to its weight. Adding a shard leaves
    the other costs as they are, so a key either stays or moves to the new shard; taking
    one away moves its own keys only. A shard of weight 0 gets nothing. Null keys are
    one key of their own.
    """
    if not weights or min(weights) < 0 or max(weights) <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    named = F.coalesce(F.concat(F.lit("="), key.cast("string")), F.lit("null"))
    costs = []
    for j, w in enumerate(weights):
        if w > 0:
            bits = F.shiftrightunsigned(F.xxhash64(named, F.lit(seed), F.lit(j)), 11)
            u = (bits.cast("double") + 0.5) / float(2**53)
            costs.append(F.struct((-F.log(u) / float(w)).alias("cost"), F.lit(j).alias("shard")))
    return (F.least(*costs) if len(costs) > 1 else costs[0])["shard"]


def shard(
    df: DataFrame,
    key: str,
    weights: Sequence[float] = (1.0,) * SHARDS,
    grown: Sequence[float] | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    """Adds `shard`, `slot` (gapless from 0 in each shard) and, if `grown` weights are given, `grown_shard`.

    Only the columns of `df` are shuffled, once, to number the slots: keep payloads out.
    Repeated keys share a shard and get slots of their own, in chunks by key and `order`; an empty table stays empty.
    Columns of `df` named shard, slot or grown_shard are replaced.
    """
    df = df.drop("shard", "slot", "grown_shard")
    df = df.withColumn("shard", rendezvous(F.col(key), weights))
    if grown is not None:
        df = df.withColumn("grown_shard", rendezvous(F.col(key), grown))
    n = chunks_for(df.count())
    order_by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    return number_rows(df, ["shard"], salted(n, F.col(key), *map(F.col, order)), order_by, "slot")


def op10_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 equal shards under the law `key`; `grown_shard` is the shard among 17."""
    docs = documents(spark, sf_dir).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    placed = shard(docs, "doc_id", (1.0,) * SHARDS, (1.0,) * (SHARDS + 1), order=("size", "text_crc32"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
