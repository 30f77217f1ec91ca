"""The domain's tables as the operators take them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.timestamps import iso_micros, normalise_timestamps
from ..runtime import load, staged


def version_instants(spark: SparkSession, d: str) -> DataFrame:
    """(fact_version_id, us): when the evidence of each row of fact_versions was observed."""
    return normalise_timestamps(load(spark, d, "fact_versions"), "fact_version_id", "evidence_observed_at", "source_id", "evidence_time_basis", "ingested_at_real", load(spark, d, "publisher_zones"))


def facts(spark: SparkSession, d: str) -> DataFrame:
    """Fact versions with their clocks in microseconds and the claims that support them.

    A redelivered version is one: observed and accepted are the earliest, the rest is
    that of the least row.  A fact is accepted when it first arrives.
    """
    f = load(spark, d, "fact_versions").filter("fact_version_id is not null")
    said = F.struct("logical_fact_id", "subject_id", "relation_id", "object_id", iso_micros(F.col("valid_from")).alias("valid_from"), iso_micros(F.col("valid_to")).alias("valid_to"), "supersedes_version_id", "revision_type", "supporting_claim_ids")
    one = f.groupBy("fact_version_id").agg(F.min(said).alias("f"), F.min(iso_micros(F.col("ingested_at_real"))).alias("accepted"))
    seen = version_instants(spark, d).groupBy("fact_version_id").agg(F.min("us").alias("observed"))
    d = one.join(seen, "fact_version_id").select(
        F.col("fact_version_id").alias("version"),
        F.col("f.logical_fact_id").alias("logical"),
        F.col("f.subject_id").alias("subject"),
        F.col("f.relation_id").alias("relation"),
        F.col("f.object_id").alias("object"),
        "observed",
        "accepted",
        "f.valid_from",
        "f.valid_to",
        F.col("f.supersedes_version_id").alias("supersedes"),
        F.col("f.revision_type").eqNullSafe("retraction").alias("retraction"),
        F.col("f.supporting_claim_ids").alias("claims"),
    )
    return staged(d, "facts")


def edges(spark: SparkSession, d: str, snapshot: str | None = None) -> DataFrame:
    """(snapshot_id, h, r, t): the different triples of ``snapshot_edges``."""
    e = load(spark, d, "snapshot_edges")
    e = e.filter(F.col("snapshot_id") == snapshot) if snapshot else e.filter("snapshot_id is not null")
    return e.select("snapshot_id", F.col("subject_id").alias("h"), F.col("relation_id").alias("r"), F.col("object_id").alias("t")).filter("h is not null and r is not null and t is not null").distinct()


EDGES_SQL = """e AS (SELECT DISTINCT snapshot_id, subject_id AS h, relation_id AS r, object_id AS t FROM snapshot_edges
  WHERE snapshot_id IS NOT NULL AND subject_id IS NOT NULL AND relation_id IS NOT NULL AND object_id IS NOT NULL)"""
