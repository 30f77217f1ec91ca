"""Attributes as known at event time (problem 7).

Decisions become known one after another.  A decision holds from the moment it is
available until one that supersedes it is; these half-open periods are exploded
into time buckets, and events meet them by an equi-join on entity and bucket.
A hot entity is spread over its buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timestamps import iso_micros

DAY_US = 86_400_000_000


def decision_periods(decisions: DataFrame, key: str, mention: str, available: str, supersedes: str) -> DataFrame:
    """(entity, id, since, until) in microseconds; until is null for decisions that still hold.

    Copies of a decision are one (its least availability counts).  Letter case of
    the mention does not matter.  Decisions without mention, id or readable
    availability are never known.  A decision whose superseder was available no
    later than itself never holds.
    """
    d = (
        decisions.select(F.col(key).alias("id"), F.lower(mention).alias("entity"), iso_micros(F.col(available)).alias("since"), F.col(supersedes).alias("old"))
        .filter("id is not null and entity is not null and since is not null")
        .groupBy("id", "entity")
        .agg(F.min("since").alias("since"), F.min("old").alias("old"))
    )
    ends = d.filter("old is not null and old <> id").groupBy(F.col("old").alias("id"), "entity").agg(F.min("since").alias("until"))
    return d.join(ends, ["id", "entity"], "left").filter("until is null or until > since").select("entity", "id", "since", "until")


def _bucket(us: Column, width: int, low: int, high: int) -> Column:
    """Outside of [low, high] the outermost buckets take everything."""
    return F.greatest(F.lit(low), F.least(F.lit(high), F.floor(us / width)))


def join_as_known(events: DataFrame, entity: str, at: str, periods: DataFrame, bucket_days: int = 120, since_year: int = 2000, until_year: int = 2040) -> DataFrame:
    """events with ``id`` of every period of their entity that contains their instant.

    ``at`` is in microseconds.  Events without entity, instant or period have no row.
    """
    width = bucket_days * DAY_US
    low, high = ((y - 1970) * 365 // bucket_days for y in (since_year, until_year))
    b = lambda c: _bucket(c, width, low, high)
    spans = periods.withColumn("_b", F.explode(F.sequence(b(F.col("since")), F.coalesce(b(F.col("until") - 1), F.lit(high).cast("long")))))
    e = events.filter(F.col(entity).isNotNull() & F.col(at).isNotNull()).withColumn("_e", F.lower(entity)).withColumn("_b", b(F.col(at)))
    s = spans.select(F.col("entity").alias("_e"), "_b", F.col("id").alias("_id"), F.col("since").alias("_since"), F.col("until").alias("_until"))
    hit = (F.col("_since") <= F.col(at)) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    return e.join(s, ["_e", "_b"]).filter(hit).drop("_e", "_b", "_since", "_until").withColumnRenamed("_id", "id")


def mappings_as_known(versions: DataFrame, instants: DataFrame, mappings: DataFrame) -> DataFrame:
    """(fact_version_id, endpoint, entity_mapping_id) known at each version's instant.

    ``instants``: fact_version_id, us.  A redelivered version is one event per
    distinct instant and mention; of several decisions that nothing supersedes the
    latest one counts (then the least id).
    """
    ends = F.array(F.struct(F.lit("subject").alias("endpoint"), F.col("subject_id").alias("mention")), F.struct(F.lit("object").alias("endpoint"), F.col("object_id").alias("mention")))
    m = versions.filter(F.col("fact_version_id").isNotNull()).select("fact_version_id", F.explode(ends).alias("x")).select("fact_version_id", "x.*")
    events = m.join(instants.filter("us is not null"), "fact_version_id").dropDuplicates(["fact_version_id", "endpoint", "mention", "us"])
    periods = decision_periods(mappings, "entity_mapping_id", "mention", "mapping_available_at", "supersedes_mapping_id")
    known = join_as_known(events, "mention", "us", periods.withColumn("id", F.struct(F.col("since"), F.col("id"))))
    best = known.groupBy("fact_version_id", "endpoint", "us").agg(F.min_by(F.col("id.id"), F.struct(-F.col("id.since"), F.col("id.id"))).alias("entity_mapping_id"))
    return best.select("fact_version_id", "endpoint", "entity_mapping_id").distinct()
