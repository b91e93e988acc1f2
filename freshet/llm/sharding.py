"""Sharding by rendezvous (highest random weight) hashing of stable record keys.

Each key draws one uniform number per shard, u = hash(key, shard), and goes to the
shard with the least ``-ln(u) / weight``. Only the key and the set of shards decide,
so one more shard takes rows only into itself, about its share of all rows.

``slot`` numbers the rows of a shard from 0 without gaps. It is counted in two
levels: rows per (shard, bucket of the key's hash), whose running totals are a table
of at most shards x buckets rows (the buckets grow with the rows), then a row number inside each bucket. No task gets
a whole shard.

Defined results: a null key is one key like any other; a null text has no bytes and
the CRC of nothing, 0; repeated rows take one slot each; an empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes that a record takes besides its text.
RECORD_OVERHEAD = 16
#: Rows of all shards that share a bucket of the key's hash, about.
BUCKET_ROWS = 500_000
#: Running totals of more rows than this are joined by a shuffle, not broadcast.
BROADCAST_ROWS = 200_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) of a key; shard i holds a share by ``weights[i]``."""
    if not weights or min(weights) <= 0:
        raise ValueError("weights must be positive")
    table = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])

    def cost(shard: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, shard["i"]), 11)
        u = (bits.cast("double") + 0.5) / float(1 << 53)
        return F.struct((-F.log(u) / shard["w"]).alias("cost"), shard["i"].alias("i"))

    return F.array_min(F.transform(table, cost))["i"]


def with_slots(df: DataFrame, shard: str, key: Column, order: Sequence[Column], shards: int, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``slot``: gapless from 0 in each shard, in order of bucket, then ``order``."""
    buckets = max(64, -(-df.count() // bucket_rows))
    dealt = df.withColumn("_bucket", F.pmod(F.xxhash64(key, F.lit("slot")), F.lit(buckets)).cast("int"))
    totals = dealt.groupBy(shard, "_bucket").agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(shard).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        F.col(shard).alias("_shard"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before")
    )
    hinted = F.broadcast(offsets) if shards * buckets <= BROADCAST_ROWS else offsets.hint("shuffle_hash")
    inside = Window.partitionBy(shard, "_bucket").orderBy(*order)
    return (
        dealt.withColumn("_in", F.row_number().over(inside) - 1)
        .join(hinted, (F.col(shard) == F.col("_shard")) & (F.col("_bucket") == F.col("_b")))
        .withColumn("slot", (F.col("_before") + F.col("_in")).cast("long"))
        .drop("_bucket", "_shard", "_b", "_before", "_in")
    )


def shard_documents(
    docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None, extra: float = 1.0, carry: Sequence[str] = ()
) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``docs``, then its ``carry`` columns.

    ``grown_shard`` is the shard with one more shard of weight ``extra``.
    """
    weights = list(weights or [1.0] * shards)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        (F.octet_length(text) + RECORD_OVERHEAD).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        F.lit("key").alias("law"),
        rendezvous(F.col("doc_id"), weights).alias("shard"),
        rendezvous(F.col("doc_id"), [*weights, extra]).alias("grown_shard"),
        *[F.col(c) for c in carry],
    )
    order = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    out = with_slots(rows, "shard", F.col("doc_id"), order, len(weights))
    return out.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", *carry)
