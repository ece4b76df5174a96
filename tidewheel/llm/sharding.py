"""Sharding by a permutation-filled lookup table, with DataFrame functions only.

Every shard has an order of preference over the slots of a table whose size is prime: an offset and a step,
hashed from its name. The shards take turns, each claiming the first slot of its order that is free, until the table
is full. So slots are shared evenly to within one, and a shard added or lost moves few keys beside its own.
A key's hash gives its slot, and the table, which is broadcast, the shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots, a prime; the table that is broadcast has this many rows, whatever the data.
SLOTS = 1021
SHARDS = tuple(f"shard-{i:02d}" for i in range(16))


def number_of(text: Column, first: int = 1) -> Column:
    """A number below 2**32 from eight hexadecimal digits of the text's MD5."""
    return F.conv(F.substring(F.md5(text), first, 8), 16, 10).cast("long")


def lookup_table(spark: SparkSession, shards: tuple[str, ...] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """(slot, shard) for each slot. ``slots`` must be a prime above the number of shards; names must differ.

    The turns are one fold over the slots: its state is the table so far and each shard's place in its order.
    """
    names = sorted(set(shards))
    if not names or len(names) != len(shards) or slots < len(names) or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("shards must have different names, and slots be a prime that is no smaller than their number")
    own = spark.createDataFrame([(n,) for n in names], "name string").withColumns({
        "offset": number_of(F.encode("name", "utf-8"), 1) % slots, "step": number_of(F.encode("name", "utf-8"), 9) % (slots - 1) + 1})
    orders = own.select("name", F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda j: (
        (F.col("offset") + j * F.col("step")) % slots).cast("int")).alias("slots"))
    order = orders.agg(F.sort_array(F.collect_list(F.struct("name", "slots"))).alias("all")).select(
        F.col("all.name").alias("names"), F.col("all.slots").alias("order"))
    # The state: shard of each slot (-1: free) and each shard's place in its order.
    start = F.struct(F.array_repeat(F.lit(-1), slots).alias("owner"), F.array_repeat(F.lit(0), len(names)).alias("place"))

    def turn(state: Column, t: Column) -> Column:
        shard = (t % len(names)).cast("int")
        row = F.get(F.col("order"), shard)
        rest = F.slice(row, F.get(state["place"], shard) + 1, slots)
        free = F.get(F.filter(rest, lambda slot: F.get(state["owner"], slot) == -1), F.lit(0))
        # A lambda over one element names the claimed slot, which would else be searched for at every use.
        return F.get(F.transform(F.array(free), lambda slot: F.struct(
            F.transform(state["owner"], lambda o, i: F.when(i == slot, shard).otherwise(o)).alias("owner"),
            F.transform(state["place"], lambda p, i: F.when(i == shard, F.array_position(row, slot).cast("int")).otherwise(p)).alias("place"),
        )), F.lit(0))

    filled = order.select("names", F.aggregate(F.sequence(F.lit(0), F.lit(slots - 1)), start, turn)["owner"].alias("owner"))
    return filled.select("names", F.posexplode("owner").alias("slot", "owner")).select("slot", F.get("names", F.col("owner")).alias("shard"))


def place(rows: DataFrame, key: str, table: DataFrame, slots: int = SLOTS) -> DataFrame:
    """``rows`` with ``slot`` and ``shard``; the table has ``slots`` rows and is broadcast, no row is shuffled.

    A null key is placed like the empty text; rows with one key share a shard. Columns named slot or shard are replaced.
    """
    slot = (number_of(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "utf-8")) % slots).cast("int")
    return rows.drop("slot", "shard").withColumn("slot", slot).join(F.broadcast(table), "slot").select(
        *rows.drop("slot", "shard").columns, "slot", "shard")
