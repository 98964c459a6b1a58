"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: slot = (offset + k * skip) mod
size, from digests of its name. Shards take turns claiming their next free slot, so shares differ by at
most one slot, and losing a shard moves few other slots. The filled table, of fixed size, is broadcast;
placing a row is one digest and one lookup.

Edge cases: null ids are placed as ""; repeated ids go to one shard; a shard named twice counts once; no
shards is an error; empty tables give empty results; other columns are kept, but for columns named slot or
shard, which the answer replaces (the key itself may be one of them).
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SIZE = 65_537
HEX = 15


def _digest(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:HEX], 16)


def lookup_table(shards: list[str], size: int = SIZE) -> list[int]:
    """Index of the shard that owns each slot; size is a prime above the number of shards."""
    shards = list(dict.fromkeys(shards))
    if not shards or len(shards) > size:
        raise ValueError("between one shard and as many shards as slots")
    if size < 2 or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("the table's size must be a prime")
    at = [_digest(s, "offset") % size for s in shards]
    skip = [_digest(s, "skip") % (size - 1) + 1 for s in shards]
    owner, left = [-1] * size, size
    while left:
        for i in range(len(shards)):
            while owner[at[i]] >= 0:
                at[i] = (at[i] + skip[i]) % size
            owner[at[i]] = i
            left -= 1
            if not left:
                break
    return owner


def slot_of(key: Column, size: int = SIZE) -> Column:
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, HEX)
    return F.pmod(F.conv(digits, 16, 10).cast("long"), F.lit(size)).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], size: int = SIZE) -> DataFrame:
    """The rows with slot and shard (the shard's name)."""
    shards = list(dict.fromkeys(shards))
    owner = lookup_table(shards, size)
    # the table as one literal of bounded size, opened into rows by Spark and broadcast
    text = ",".join(map(str, owner))
    table = rows.sparkSession.range(1).select(F.posexplode(F.split(F.lit(text), ",")).alias("slot", "owner"))
    named = table.select("slot", F.get(F.array(*map(F.lit, shards)), F.col("owner").cast("int")).alias("shard"))
    kept = [c for c in rows.columns if c not in ("slot", "shard")]
    return rows.select(slot_of(F.col(key), size).alias("slot"), *kept).join(F.broadcast(named), "slot")


def write_shards(placed: DataFrame, path: str, *, rows_per_file: int = 1_000_000) -> None:
    """One folder a shard; a shard with many rows is dealt by a hash of the row to as many tasks as it has files."""
    counts = placed.groupBy("shard").agg(F.ceil(F.count("*") / rows_per_file).alias("_files"))
    salted = placed.join(F.broadcast(counts), "shard").withColumn("_part", F.pmod(F.xxhash64(*placed.columns), F.col("_files")))
    salted.drop("_files").repartition("shard", "_part").drop("_part").write.partitionBy("shard").option("maxRecordsPerFile", rows_per_file).parquet(path)


SHARDS = [f"shard-{k:04d}" for k in range(64)]


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: place every document on one of 64 shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id")
    return place(docs, "doc_id", SHARDS).select("doc_id", "slot", "shard")


def oracle() -> str:
    """The same rows in DuckDB SQL, the filled table given as a literal; tests fill it by another program."""
    names = ", ".join(f"'{s}'" for s in SHARDS)
    return f"""
WITH t AS MATERIALIZED (SELECT unnest(range({SIZE})) AS slot, unnest(string_split('{",".join(map(str, lookup_table(SHARDS)))}', ',')) AS owner),
d AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, {HEX}) AS BIGINT) % {SIZE} AS INT) AS slot FROM documents)
SELECT doc_id, d.slot, [{names}][CAST(owner AS INT) + 1] AS shard FROM d JOIN t ON t.slot = d.slot"""
