"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size (a start and a stride from a hash of its name). The shards take turns; a
shard whose turn it is claims its first slot that is still free. A row's slot
is a hash of its key, so placing is one look-up in a broadcast table whose size
is a parameter, and taking a shard away moves few rows of the other shards.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pairlake.functions.draws import draw
from pairlake.llm.common import fresh

SHARDS, SLOTS, SEED = 32, 4093, 42


def _draw(*parts) -> int:
    """functions.draws.draw for plain values."""
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:15], 16)


def fill(shards: Sequence[str], slots: int = SLOTS, seed: int = SEED) -> list[int]:
    """The number of the shard that owns each slot.

    ``slots`` has to be prime, so that every stride visits all slots, and not
    below the number of shards; names have to be distinct. Shards own
    ``slots / len(shards)`` slots, rounded up or down.
    """
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"the number of slots must be prime: {slots}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("give distinct shard names, at least one and at most one per slot")
    at = [_draw(seed, "start", s) % slots for s in shards]
    stride = [_draw(seed, "stride", s) % (slots - 1) + 1 for s in shards]
    owner = [-1] * slots
    for turn in range(slots):
        i = turn % len(shards)
        while owner[at[i]] >= 0:
            at[i] = (at[i] + stride[i]) % slots
        owner[at[i]] = i
    return owner


def lookup(spark: SparkSession, shards: Sequence[str], slots: int = SLOTS, seed: int = SEED) -> DataFrame:
    """(slot, shard): the filled table, ``slots`` rows."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, slots, seed)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    rows = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return rows.select(F.col("slot").cast("bigint").alias("slot"), F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def slot_of(key: str, text: str | None, slots: int = SLOTS, seed: int = SEED) -> Column:
    """The slot of a row: a hash of its key; of its text where the key is null, so that null keys do not share one slot."""
    shown = F.col(key).cast("string")
    if text:
        shown = F.coalesce(shown, F.concat(F.lit("text "), F.md5(F.coalesce(F.col(text), F.lit("")))))
    return F.pmod(draw(seed, "slot", F.coalesce(shown, F.lit("null"))), F.lit(slots))


def place(
    df: DataFrame, shards: Sequence[str], key: str = "doc_id", text: str | None = "text", slots: int = SLOTS, seed: int = SEED
) -> DataFrame:
    """``df`` with ``slot`` and ``shard`` (underscores put before if it has such columns).

    One row for each row given, no shuffle. Rows with equal keys get equal
    shards (repeated rows too); a null key is replaced by the text's digest, a
    null text by the empty one; other columns and an empty table pass through.
    """
    slot, shard, join = fresh(df, "slot", "shard", "_at")
    known = lookup(df.sparkSession, shards, slots, seed).select(F.col("slot").alias(join), F.col("shard").alias(shard))
    at = df.withColumn(slot, slot_of(key, text, slots, seed))
    # bounded by ``slots`` rows
    return at.join(F.broadcast(known), F.col(slot) == F.col(join)).select(*[F.col(f"`{c}`") for c in df.columns], slot, shard)


def write(df: DataFrame, path: str, shards: Sequence[str], **options) -> None:
    """One folder per shard; a shard's rows are split over tasks, so no task holds a whole shard."""
    placed = place(df, shards, **options)
    placed.hint("rebalance", placed.columns[-1]).write.partitionBy(placed.columns[-1]).parquet(path)
