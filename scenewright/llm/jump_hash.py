"""Sharding by jump consistent hashing, as column expressions.

A stable key and the number of shards decide the shard; no ring table is kept. When shards are appended, only the
rows that must move do, and only into the new shards. The pseudo-random sequence is the published one: a 64-bit
linear congruential generator seeded with the key. Spark's long arithmetic raises on overflow, so its state is kept
as two halves of 32 bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scenewright.llm.common import gapless

#: Fixed value of the published method: the generator's multiplier, 2862933555777941757, in 32-bit halves.
MULTIPLIER_HIGH, MULTIPLIER_LOW = 2862933555777941757 >> 32, 2862933555777941757 & 0xFFFFFFFF
MASK = 0xFFFFFFFF

#: Jumps that are unrolled at first; a key that needs more (its number is logarithmic in the shards) takes the long way.
JUMPS = 48


def _next(high: Column, low: Column) -> tuple[Column, Column]:
    """The halves of (state * multiplier + 1) mod 2**64."""
    low_0, low_1 = low.bitwiseAND(0xFFFF), F.shiftright(low, 16)
    high_0, high_1 = high.bitwiseAND(0xFFFF), F.shiftright(high, 16)
    a = low_0 * MULTIPLIER_LOW + F.lit(1)
    b = low_1 * MULTIPLIER_LOW
    c = a + F.shiftleft(b.bitwiseAND(0xFFFF), 16)
    carry = F.shiftright(c, 32) + F.shiftright(b, 16)
    cross = high_0 * MULTIPLIER_LOW + F.shiftleft((high_1 * MULTIPLIER_LOW).bitwiseAND(0xFFFF), 16)
    low_high = low_0 * MULTIPLIER_HIGH + F.shiftleft((low_1 * MULTIPLIER_HIGH).bitwiseAND(0xFFFF), 16)
    return (carry + cross.bitwiseAND(MASK) + low_high.bitwiseAND(MASK)).bitwiseAND(MASK), c.bitwiseAND(MASK)


def _jump(key: Column, shards: int, jumps: int) -> Column:
    """A struct after so many jumps: b, the last bucket below `shards`, and j, the next (at least `shards` if done)."""
    start = F.struct(
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
        F.shiftrightunsigned(key, 32).alias("high"),
        key.bitwiseAND(MASK).alias("low"),
    )

    def step(s: Column, _: Column) -> Column:
        high, low = _next(s["high"], s["low"])
        upper = F.shiftright(high, 1)  # the state's upper 31 bits
        j = F.floor((s["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / (upper + 1).cast("double"))).cast("long")
        moved = F.struct(s["j"].alias("b"), j.alias("j"), high.alias("high"), low.alias("low"))
        return F.when(s["j"] < shards, moved).otherwise(s)

    return F.aggregate(F.sequence(F.lit(1), F.lit(jumps)), start, step)


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, 0 to shards - 1, of a 64-bit key, by jump consistent hashing. A null key counts as 0."""
    if shards < 1:
        raise ValueError("there must be at least one shard")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    # every jump moves on by one bucket at least, so `shards` of them always suffice
    out = _jump(key, shards, min(shards, JUMPS))
    if shards <= JUMPS:
        return out["b"].cast("int")
    return F.when(out["j"] >= shards, out["b"]).otherwise(_jump(key, shards, shards)["b"]).cast("int")


def shard_key(df: DataFrame, column: str) -> Column:
    """A 64-bit key: integer columns as they are, any other by its hash. Null stays null."""
    if isinstance(df.schema[column].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.col(column).cast("long")
    return F.when(F.col(column).isNotNull(), F.xxhash64(column))


def shard(
    df: DataFrame, key: str, shards: int, *, name: str = "shard", slot: str | None = "slot", order: list[str] = ()
) -> DataFrame:
    """df with the shard of each row, and, if slot is named, the row's gapless number from 0 within its shard.

    Each row is dealt by its key and the number of shards alone. The slots go by slices of about 50,000 rows, so no
    task holds a whole shard. order: columns besides the key by which equal keys are told apart. Rows with a null key
    go to the shard of key 0; repeated rows keep one slot each; an empty table stays empty; columns of df named like
    the new ones are replaced."""
    out = df.drop(name, *([slot] if slot else [])).withColumn(name, jump_hash(shard_key(df, key), shards))
    return gapless(out, [name], [key, *order], slot, df.count()) if slot else out
