"""Validity history of changing attributes (problem 1) from snapshots or updates.

``difference_consecutive`` compares each state with the one before it by a
null-safe full outer join and classifies every key as inserted, changed or
deleted.  ``validity`` gives each event its end by lead().  Both work on
(key, sequence) pairs, and lead() runs inside chunks of a key's sequence that
overlap by one event, so a key with a third of all rows is spread over tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import staged
from .timestamps import iso_micros

OPEN_START = -(2**63)


def with_sequence(df: DataFrame, key: str, at: str, bucket_us: int = 30 * 86_400_000_000, out: str = "_seq") -> DataFrame:
    """df with the 1-based position of each row in its key's order by ``at``, which no two rows of a key share.

    Ranks are counted inside (key, time bucket), where a bucket holds as many rows as
    it has different instants, and shifted by the rows of the key's earlier buckets,
    which are summed over one row per bucket.  df is read twice.  Keys are not null.
    """
    d = df.withColumn("_bucket", F.when(F.col(at) == OPEN_START, F.lit(OPEN_START)).otherwise(F.floor(F.col(at) / bucket_us)))
    before = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = d.groupBy(key, "_bucket").agg(F.count("*").alias("_n")).select(key, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    d = d.withColumn("_r", F.row_number().over(Window.partitionBy(key, "_bucket").orderBy(at)))
    return d.join(sizes, [key, "_bucket"]).withColumn(out, F.col("_r") + F.col("_shift")).drop("_r", "_shift", "_bucket")


def difference_consecutive(states: DataFrame, keys: list[str], order: str, values: list[str], absent: str | None = None) -> DataFrame:
    """Each state against the state before it: keys, order, change and the new values.

    ``order`` numbers the states 1, 2, ... for the keys (of full snapshots: the
    snapshot's number; of updates: the position in the key's own history).
    change is ``inserted``, ``changed``, ``unchanged`` or ``deleted``; a deleted
    event stands at the first state without the key.  A state may be without the key
    by having no row, its event then has null values, or by a row whose column
    ``absent`` is true, whose values the event has; of two such states the second is
    ``unchanged``.  Null keys and values equal each other.
    """
    gone = F.coalesce(F.col(absent), F.lit(False)) if absent else F.lit(False)
    now = states.select(*keys, order, *values, gone.alias("_gone")).alias("n")
    was = states.select(*keys, (F.col(order) + 1).alias(order), *values, gone.alias("_gone")).alias("w")
    on = reduce(lambda a, b: a & b, [F.col(f"n.{c}").eqNullSafe(F.col(f"w.{c}")) for c in [*keys, order]])
    same = reduce(lambda a, b: a & b, [F.col(f"n.{v}").eqNullSafe(F.col(f"w.{v}")) for v in values], F.lit(True))
    here, before = (F.coalesce(~F.col(f"{x}._gone"), F.lit(False)) for x in "nw")
    change = F.when(here & ~before, "inserted").when(~here & before, "deleted").when(~here | same, "unchanged").otherwise("changed")
    pick = lambda c: F.when(F.col(f"n.{order}").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"w.{c}")).alias(c)
    return now.join(was, on, "full_outer").select(*map(pick, [*keys, order]), change.alias("change"), *[F.col(f"n.{v}").alias(v) for v in values])


def validity(events: DataFrame, key: str, order: str, start: str, chunk: int = 4096, out: str = "period_end") -> DataFrame:
    """events with the start of the key's next event, by lead() in overlapping chunks.

    The order numbers of a key must have no gap but at its end.
    """
    n = (F.col(order) - 1) % chunk
    number = F.floor((F.col(order) - 1) / chunk)
    copies = F.when((n == 0) & (number > 0), F.array(number, number - 1)).otherwise(F.array(number))
    d = events.withColumn("_home", number).withColumn("_chunk", F.explode(copies))
    w = Window.partitionBy(key, "_chunk").orderBy(order)
    return d.withColumn(out, F.lead(start).over(w)).filter(F.col("_home") == F.col("_chunk")).drop("_home", "_chunk")


def snapshot_history(snapshots: DataFrame, keys: list[str], snapshot: str, values: list[str]) -> DataFrame:
    """History of full snapshots: keys, values, valid_from, valid_to (the first snapshot without them).

    Snapshots follow each other in the order of their ids.  Rows of one key in a
    snapshot must agree (else the least values count); rows without snapshot id
    belong to none.  Unchanged states extend the period; a key that returns after
    an absence starts a new one.
    """
    rows = snapshots.filter(F.col(snapshot).isNotNull()).groupBy(*keys, snapshot).agg(F.min(F.struct(*values)).alias("_v")).select(*keys, snapshot, "_v.*")
    # One row per delivery, not per record.
    ids = rows.select(snapshot).distinct().withColumn("_seq", F.row_number().over(Window.orderBy(snapshot)).cast("long"))
    ids = ids.select(snapshot, "_seq")
    states = rows.join(ids, snapshot)
    events = difference_consecutive(states, keys, "_seq", values).filter("change <> 'unchanged'")
    w = Window.partitionBy(*keys).orderBy("_seq")
    d = events.withColumn("_next", F.lead("_seq").over(w)).filter("change <> 'deleted'")
    names = ids.select(F.col("_seq").alias("_s"), F.col(snapshot).alias("_name"))
    d = d.join(names.select(F.col("_s").alias("_seq"), F.col("_name").alias("valid_from")), "_seq")
    d = d.join(names.select(F.col("_s").alias("_next"), F.col("_name").alias("valid_to")), "_next", "left")
    return d.select(*keys, *values, "valid_from", "valid_to")


def _iso(us: Column) -> Column:
    s = F.timestamp_seconds(F.floor(us / 1_000_000))
    return F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), s.cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def version_history(versions: DataFrame) -> DataFrame:
    """(logical_fact_id, fact_version_id, period_start, period_end) of versions that revise each other.

    State n of a fact is what its n-th change says: a version, or nothing after a
    retraction.  Consecutive states meet in :func:`difference_consecutive`; inserted
    and changed facts begin a period with what they say then, deleted ones only end
    one, and each event lasts until the fact's next event or its version's own end.

    Redelivered rows are one version (the first by value counts where they differ).
    A version superseded by another one of its fact that starts no later has no
    period.  Null or unreadable starts are open.  Of several versions with one start
    the greatest id holds, as the periods of the others are empty.  Rows without
    version id name no version; null facts are one fact.
    """
    # A prefix keeps null facts apart from every text, so that keys are plain strings.
    fact = F.coalesce(F.concat(F.lit("="), "logical_fact_id"), F.lit(""))
    v = (
        versions.filter(F.col("fact_version_id").isNotNull())
        .select("fact_version_id", fact.alias("fact"), "supersedes_version_id", "revision_type", iso_micros(F.col("valid_from")).alias("s"), iso_micros(F.col("valid_to")).alias("e"))
        .groupBy("fact_version_id")
        .agg(F.min(F.struct("fact", F.coalesce("s", F.lit(OPEN_START)).alias("s"), "e", "revision_type", "supersedes_version_id")).alias("v"))
        .select("fact_version_id", "v.*")
    )
    v = staged(v, "versions")
    later = v.filter("supersedes_version_id is not null and supersedes_version_id <> fact_version_id").groupBy(F.col("supersedes_version_id").alias("fact_version_id"), "fact").agg(F.min("s").alias("_by"))
    kept = v.join(later, ["fact_version_id", "fact"], "left").filter("_by is null or _by > s")
    # One version per start: of versions that start together the last has the whole period.
    said = F.struct("fact_version_id", "e", F.col("revision_type").eqNullSafe("retraction").alias("gone"))
    starts = staged(kept.groupBy("fact", "s").agg(F.max(said).alias("x")).select("fact", "s", "x.*"), "starts")
    states = staged(with_sequence(starts, "fact", "s"), "states")
    # A state without the fact is a row of its own, which says when the fact went.
    events = difference_consecutive(states, ["fact"], "_seq", ["fact_version_id", "s", "e"], absent="gone").filter("s is not null")
    spans = validity(events, "fact", "_seq", "s", out="_next").filter("change in ('inserted', 'changed')")
    end = F.least("e", "_next")
    return spans.filter(end.isNull() | (end > F.col("s"))).select(
        F.when(F.col("fact") != "", F.expr("substring(fact, 2)")).alias("logical_fact_id"),
        "fact_version_id",
        F.when(F.col("s") == OPEN_START, "").otherwise(_iso(F.col("s"))).alias("period_start"),
        F.coalesce(_iso(end), F.lit("")).alias("period_end"),
    )


def lineage_roots(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, root, depth): where each record's chain of parents ends and how long it is.

    Pointers are doubled each round, so a chain of n records takes log2(n) rounds.
    A parent that is no record ends the chain.  Records of a cycle, or above one,
    have a null root and depth.  Of repeated keys the least parent counts.
    """
    d = df.filter(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(parent).alias("p"))
    held = d.select(F.col("k").alias("p"), F.lit(True).alias("held"))
    d = d.join(held, "p", "left").select("k", F.when(F.col("held"), F.col("p")).otherwise(F.col("k")).alias("up"), F.when(F.col("held"), 1).otherwise(0).cast("long").alias("depth"))
    d = staged(d, "lineage")
    for _ in range(max(1, d.count()).bit_length() + 1):
        over = d.select(F.col("k").alias("up"), F.col("up").alias("next"), F.col("depth").alias("more"))
        d = staged(d.join(over, "up").select("k", F.col("next").alias("up"), (F.col("depth") + F.col("more")).alias("depth"), (F.col("more") > 0).alias("moved")), "lineage")
        if not d.filter("moved").limit(1).count():
            break
    return d.select(F.col("k").alias(key), F.when(~F.col("moved"), F.col("up")).alias("root"), F.when(~F.col("moved"), F.col("depth")).alias("depth"))
