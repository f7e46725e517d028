"""Sharding by jump consistent hash, in built-in expressions only.

The published function (Lamping and Veach, 2014) walks a row's own random
sequence of jumps b -> floor((b + 1) * 2^31 / (r + 1)), r the top 31 bits of a
64-bit linear congruential generator, and stays at the last b below the number
of shards. No ring or table is kept; with one more shard a row stays or goes
to the new shard.

ANSI arithmetic raises an error where 64-bit products overflow, so the
generator's state is held as two unsigned 32-bit halves and multiplied in
16-bit limbs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: The generator's multiplier, a fixed value of the published function.
MULTIPLIER = 2862933555777941757
_C0, _C1, _C2, _C3 = ((MULTIPLIER >> s) & 0xFFFF for s in (0, 16, 32, 48))
_LOW32, _LOW16 = 0xFFFFFFFF, 0xFFFF


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _step(state: Column) -> Column:
    """The generator's next state: multiplier * state + 1 modulo 2^64, as halves hi and lo."""
    hi, lo = state["hi"], state["lo"]
    low = lo * _C0 + F.shiftleft((lo * _C1).bitwiseAND(_LOW16), 16) + 1
    carry = F.shiftright(low, 32) + F.shiftright(lo * _C1, 16)
    high = (
        carry
        + lo * _C2
        + F.shiftleft((lo * _C3).bitwiseAND(_LOW16), 16)
        + hi * _C0
        + F.shiftleft((hi * _C1).bitwiseAND(_LOW16), 16)
    ).bitwiseAND(_LOW32)
    return F.struct(high.alias("hi"), low.bitwiseAND(_LOW32).alias("lo"))


def jump_hash(key: Column, shards: int) -> Column:
    """The shard, from 0, of a 64-bit key; a null key counts as 0.

    A row takes about ln(shards) + 1 jumps; the fold has `shards` rounds, the
    most that can be needed, and passes through unchanged once a jump is over.
    """
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    begin = F.struct(
        F.lit(-1).cast("long").alias("b"),
        F.lit(0).cast("long").alias("j"),
        F.struct(
            F.shiftrightunsigned(key, 32).bitwiseAND(_LOW32).alias("hi"), key.bitwiseAND(_LOW32).alias("lo")
        ).alias("k"),
    )

    def jump(acc: Column, _: Column) -> Column:
        def moved(k: Column) -> Column:
            r = F.shiftright(k["hi"], 1) + 1
            # r >= 1, so j < 2^31 * shards and the product stays exact in a double
            j = F.floor((acc["j"] + 1).cast("double") * (F.lit(float(1 << 31)) / r.cast("double"))).cast("long")
            return F.struct(acc["j"].alias("b"), j.alias("j"), k.alias("k"))

        return F.when(acc["j"] < shards, _let(_step(acc["k"]), moved)).otherwise(acc)

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), begin, jump, lambda acc: acc["b"].cast("int"))


def key_of(df: DataFrame, id_col: str) -> Column:
    """Integers are their own key; anything else is hashed to 64 bits."""
    kind = df.schema[id_col].dataType
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return F.coalesce(df[id_col].cast("long"), F.lit(0).cast("long"))
    return F.xxhash64(df[id_col])


def assign_shards(
    docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", slot_parts: int = 512
) -> DataFrame:
    """Shard and slot of every row, law `key`: id and shard count decide alone.

    Returns id, size (UTF-8 bytes of the text plus 8), text_crc32 (unsigned),
    law, shard, slot (gapless from 0 in its shard), grown_shard (with one more
    shard). Slots: each shard's rows fall into slot_parts parts by the
    crc32 of the key; parts are ranked apart and offset by the counts of those before
    them, so no task sees a whole shard. The counts read only the id column
    and are shards * slot_parts rows whatever the input.

    Null texts count as empty (size 8, crc32 0), a null id as key 0. Equal
    rows get a slot each. Ties of the id inside a part are ordered by crc32
    and size. Only id and text are read; an empty table gives no rows.
    """
    key = key_of(docs, id_col)
    part = (F.crc32(key.cast("string").cast("binary")) % slot_parts).cast("int")
    counts = (
        docs.select(jump_hash(key, shards).alias("shard"), part.alias("part"))
        .groupBy("shard", "part")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col("shard").alias("o_shard"), F.col("part").alias("o_part"),
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("o_before"),
    )
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    rows = docs.select(
        docs[id_col].alias("id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        jump_hash(key, shards).alias("shard"),
        jump_hash(key, shards + 1).alias("grown_shard"),
        part.alias("part"),
    )
    rank = Window.partitionBy("shard", "part").orderBy("id", "text_crc32", "size")
    ranked = rows.withColumn("rank", F.row_number().over(rank) - 1)
    placed = ranked.join(offsets, (F.col("shard") == F.col("o_shard")) & (F.col("part") == F.col("o_part")))
    return placed.select(
        F.col("id").alias(id_col), "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("o_before") + F.col("rank")).cast("long").alias("slot"), "grown_shard",
    )
