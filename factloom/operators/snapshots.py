"""What changed between full snapshots (problem 5).

Each snapshot is unpivoted into key-field-value cells plus one presence marker per
key.  A cell counts +1 in the comparison that ends in its snapshot and -1 in the
one that starts there; what does not sum to zero has changed.  The snapshots that
have a cell are bits of one word, so that a cell is shuffled once for all snapshots
of a task and its signed sums over all comparisons are one shift and one
exclusive or.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import BROADCAST_LIMIT

#: Snapshots per word; the lowest bit repeats the last snapshot of the word before.
WORD = 61


def snapshot_sequence(df: DataFrame, snapshot: str) -> DataFrame:
    """(snapshot, following): one row per delivered snapshot, in the order of ids."""
    ids = df.select(F.col(snapshot).alias("snapshot")).filter("snapshot is not null").distinct()
    return ids.withColumn("following", F.lead("snapshot").over(Window.orderBy("snapshot")))


def snapshot_changes(df: DataFrame, snapshot: str, keys: list[str], fields: list[str]) -> DataFrame:
    """(snapshot_id, keys, change_kind, changed_fields) of each key from one snapshot to the next.

    A key may have several rows in a snapshot: it has the set of values of each
    field.  Repeated rows are one, null keys and null values equal each other,
    rows without snapshot id belong to none.  snapshot_id is the later snapshot.
    changed_fields is null for added and removed keys.  No rows give no rows.
    """
    spark, kind = df.sparkSession, dict(df.dtypes)[snapshot]
    # One id per delivery; their place in the order is broadcast below a checked size.
    ids = [r[0] for r in df.select(snapshot).filter(F.col(snapshot).isNotNull()).distinct().orderBy(snapshot).toLocalIterator()]
    places = spark.createDataFrame(list(zip(ids, range(len(ids)))), f"_s {kind}, _at long")
    places = F.broadcast(places) if sum(len(str(i)) + 16 for i in ids) < BROADCAST_LIMIT else places
    # Field 0 marks the presence of the key.
    cells = F.array(F.struct(F.lit(0).cast("tinyint").alias("f"), F.lit(None).cast("string").alias("v")), *[F.struct(F.lit(i + 1).cast("tinyint").alias("f"), F.col(c).cast("string").alias("v")) for i, c in enumerate(fields)])
    d = df.withColumnRenamed(snapshot, "_s").select("_s", *keys, cells.alias("_cells")).join(places, "_s")
    # The last snapshot of a word is also the lowest bit of the next one.
    word, bit = F.floor(F.col("_at") / WORD), (F.col("_at") % WORD + 1).cast("int")
    marks = F.array_compact(F.array(F.struct(word.alias("w"), bit.alias("b")), F.when(bit == WORD, F.struct((word + 1).alias("w"), F.lit(0).alias("b")))))
    d = d.select(*keys, "_cells", F.explode(marks).alias("_m")).select(*keys, "_m.w", F.expr("shiftleft(1L, _m.b)").alias("bits"), F.explode("_cells").alias("c"))
    held = d.select(*keys, "w", "bits", "c.f", "c.v").groupBy(*keys, "f", "v", "w").agg(F.bit_or("bits").alias("bits"))
    # Bit j of the sum's trace is set where snapshots j - 1 and j differ; bit j of bits tells its sign.
    at = F.expr(f"filter(sequence(1, {WORD}), j -> (shiftrightunsigned(bits ^ shiftleft(bits, 1), j) & 1) = 1)")
    sums = held.select(*keys, "f", "w", "bits", F.explode(at).alias("j")).select(*keys, "f", (F.col("w") * WORD + F.col("j") - 1).alias("_at"), F.when(F.expr("(shiftrightunsigned(bits, j) & 1) = 1"), 1).otherwise(-1).alias("n"))
    sums = sums.filter((F.col("_at") > 0) & (F.col("_at") < len(ids)))
    changed = F.array_sort(F.collect_set(F.when(F.col("f") > 0, F.element_at(F.array(*map(F.lit, fields)), F.col("f").cast("int")))))
    rows = sums.groupBy("_at", *keys).agg(F.max(F.when(F.col("f") == 0, F.col("n"))).alias("p"), changed.alias("changed"))
    kind_of = F.when(F.col("p") > 0, "added").when(F.col("p") < 0, "removed").otherwise("changed")
    return rows.join(places, "_at").select(F.col("_s").alias("snapshot_id"), *keys, kind_of.alias("change_kind"), F.when(F.col("p").isNull(), F.col("changed")).alias("changed_fields"))
