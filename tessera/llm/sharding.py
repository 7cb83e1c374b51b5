"""Sharding by a permutation-filled lookup table, in DataFrame functions only.

Each shard has its own permutation of the slots of a prime-sized table, given by an offset
and a step. Shards take turns, in the order given, each claiming the first slot of its
permutation that is still free, until the table is full. A key's hash picks a slot, and
the slot names the shard. The filled table is broadcast; its size is the prime, whatever
the number of rows, so placement takes constant time and moves no row. Removing a shard
moves few keys other than its own.

Defined results: a null key is hashed as the empty text, so every row has a shard; equal
keys have equal shards; with no shard, or more shards than slots, ValueError is raised.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime above a hundred times the number of shards: shares differ by a hundredth at most.
TABLE_SIZE = 6_421
#: Largest table that is broadcast.
LARGEST_TABLE = 10_000_019
SHARDS = tuple(f"shard-{k:02d}" for k in range(64))


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def hash60(data: str) -> int:
    """First 60 bits of md5, as :func:`slot_of` computes them."""
    return int(hashlib.md5(data.encode()).hexdigest()[:15], 16)


def fill(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """The shard number of every slot. Claims are few: each shard looks at each slot of its
    permutation once at most."""
    if not shards or len(shards) > size or len(set(shards)) < len(shards):
        raise ValueError("one to table-size distinct shards are needed")
    if not is_prime(size) or size > LARGEST_TABLE:
        raise ValueError("the table size must be a prime of bounded size")
    place = [hash60(f"offset:{s}") % size for s in shards]
    step = [hash60(f"step:{s}") % (size - 1) + 1 if size > 2 else 1 for s in shards]
    table, left = [-1] * size, size
    while True:
        for k in range(len(shards)):
            while table[place[k]] >= 0:
                place[k] = (place[k] + step[k]) % size
            table[place[k]] = k
            left -= 1
            if not left:
                return table


def lookup_table(spark, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``slot, shard`` of every slot: a text literal that the JVM splits."""
    packed = ",".join(map(str, fill(shards, size)))
    numbers = spark.range(1).select(F.posexplode(F.split(F.lit(packed), ",")).alias("slot", "number"))
    names = F.array(*map(F.lit, shards))
    return numbers.select("slot", F.get(names, F.col("number").cast("int")).alias("shard"))


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """Slot of a key: the first 60 bits of its md5, modulo the table size."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % size).cast("int")


def place(rows: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``, by a broadcast join; no row moves."""
    table = lookup_table(rows.sparkSession, shards, size)
    keyed = rows.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), size))
    return keyed.join(F.broadcast(table), "slot").select(*[c for c in rows.columns if c not in ("slot", "shard")], "slot", "shard")


def write_shards(rows: DataFrame, key: str, shards: list[str], path: str, size: int = TABLE_SIZE, files_per_shard: int = 1) -> None:
    """Write ``rows`` in a folder for each shard. A shard is dealt over ``files_per_shard`` tasks by key."""
    placed = place(rows, key, shards, size)
    salt = F.pmod(F.xxhash64(key), F.lit(files_per_shard))
    placed.repartition(len(shards) * files_per_shard, "shard", salt).write.partitionBy("shard").parquet(path)


def placement_sql(shards: list[str], size: int = TABLE_SIZE, table: str = "documents", key: str = "doc_id") -> str:
    """The same placement in DuckDB: turns are taken in a recursive query over the shards'
    permutations. Each step is one claim; the claimed slots are kept as a bit string."""
    names = ", ".join(f"({k}, '{s}')" for k, s in enumerate(shards))
    return f"""
WITH RECURSIVE shards(n, shard) AS (VALUES {names}),
permutations AS (
  SELECT n, ('0x' || substr(md5('offset:' || shard), 1, 15))::BIGINT % {size} AS first,
         ('0x' || substr(md5('step:' || shard), 1, 15))::BIGINT % {size - 1} + 1 AS step FROM shards),
firsts AS (SELECT list(first ORDER BY n) AS f, list(step ORDER BY n) AS s FROM permutations),
claims(turn, slot, taken, places) AS (
  SELECT -1, -1::BIGINT, repeat('0', {size})::BIT, (SELECT f FROM firsts)
  UNION ALL
  SELECT turn + 1, won, set_bit(taken, won::INTEGER, 1), list_transform(places, lambda p, i: CASE WHEN i = k THEN won ELSE p END)
  FROM (SELECT turn, taken, places, k, arg_min(slot, j) AS won
        FROM (SELECT c.turn, c.taken, c.places, (c.turn + 1) % {len(shards)} + 1 AS k, r.j,
                     (c.places[(c.turn + 1) % {len(shards)} + 1] + r.j * f.s[(c.turn + 1) % {len(shards)} + 1]) % {size} AS slot
              FROM claims c, firsts f, range({size}) r(j) WHERE c.turn < {size - 1}) x
        WHERE get_bit(taken, slot::INTEGER) = 0 GROUP BY turn, taken, places, k) y)
SELECT d.{key}, slots.slot::INTEGER AS slot, shards.shard
FROM (SELECT {key}, ('0x' || substr(md5(coalesce({key}::VARCHAR, '')), 1, 15))::BIGINT % {size} AS slot FROM {table}) d
JOIN claims slots ON slots.slot = d.slot AND slots.turn >= 0
JOIN shards ON shards.n = slots.turn % {len(shards)}"""
